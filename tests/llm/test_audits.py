"""Alignment of tokenizers, source divergence and line dedup against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest

from fieldtrace.llm import bpe, crosstoken, divergence, lines
from fieldtrace.llm.common import WRITTEN, release

rng = random.Random(11)
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, lang string, source string, N_A long, row string, kept string, rank int"
WORDS = ["The", "cat", "don't", "straße", "日本", "naïve", "x" * 30, "42", "<s>", "<|endoftext|>", "<0x41>", "é", "ﬁ①", "\U0001f600"]


def prose(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\n", "\t", ", ", ""]) for _ in range(n))


def table():
    texts = [None, "", " ", "  ", "\n", "a▁b", "a", "a\0b", "　x", " lead", "trail ", "trail  \n", "no" * 400, prose(4000)] + [prose(rng.randint(1, 60)) for _ in range(40)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), 1, "r", "k", 3) for k, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, texts[20], None, None, 1, "r", "k", 3), (None, texts[21], None, None, 1, "r", "k", 3)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.no_truncation()
    first.no_padding()
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    characters = bpe.byte_characters()

    def spans(parts):
        at = 0
        for i, b in parts:
            yield i, at, at + len(b)
            at += len(b)

    def piece(i):
        name = second.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    out, counts = [], collections.Counter()
    for text in texts:
        a = [(i, bytes(characters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in second.encode(text)] if text else []
        if not text or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            out.append(([], [], [], []))
            continue
        a, b = list(spans(a)), list(spans(b))
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi))
        counts.update(links)
        out.append((a, b, groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g)) for a, b, g, x in out]


@pytest.mark.parametrize("portion", [crosstoken.PORTION, 500])
def test_alignment(spark, docs, rows, monkeypatch, portion):
    """Whole tables in one portion a task, and in many."""
    monkeypatch.setattr(crosstoken, "PORTION", portion)
    monkeypatch.setattr(crosstoken, "STEP", max(portion // 10, 100))
    short = [r for r in rows if not r[1] or len(r[1]) < 3000]
    got = crosstoken.align(docs.where("text IS NULL OR length(text) < 3000"), *PATHS).collect()
    want = collections.Counter((r[0], r[1], *x) for r, x in zip(short, aligned_by_hand([r[1] for r in short]), strict=True))
    assert collections.Counter((r["doc_id"], r["text"], *(r[c] for c in crosstoken.ADDED)) for r in got) == want
    assert sum(n for *_, n, _, _ in want) > 100 and all(r["row"] == "r" and r["kept"] == "k" for r in got)


def test_alignment_of_a_long_text(spark, docs, rows):
    whole = crosstoken.align(docs.where("length(text) > 3000"), *PATHS).first()
    text = next(r[1] for r in rows if r[1] and len(r[1]) > 3000)
    a, b = (x.split("|") for x in whole["groups"].split(";")[:2])
    assert whole["n_groups"] == whole["groups"].count(";") + 1 and whole["n_links"] >= max(whole["n_a"], whole["n_b"]) and len(a) == len(b) == 2
    one = bpe.Encoder(bpe.Vocabulary(PATHS[0]))
    one.special = None
    assert [int(i) for g in whole["groups"].split(";") for i in g.split("|")[0].split(",")] == one.batch([" " + text])[0].tolist()


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert crosstoken.align(empty, *PATHS).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 2, SCHEMA)
    assert [(r["n_a"], r["n_links"], r["groups"]) for r in crosstoken.align(nulls, *PATHS).collect()] == [(0, 0, "")] * 2
    assert WRITTEN
    release(spark)
    assert not WRITTEN


def diverging(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in r[1] or ""))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in within.items() if n >= least), key=str.encode)
        counts = collections.defaultdict(collections.Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if within[t] >= least)
        whole = sum(counts.values(), collections.Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in [*counts.items(), (None, whole)]}
        for s, c in counts.items():
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if c[t] and p[s][t] > p[None][t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize(("block", "entries", "top"), [(256, divergence.ENTRIES, 50), (2, 10, 3)])
def test_divergence(spark, docs, rows, monkeypatch, block, entries, top):
    """One block of sources and several; tasks that send once and often; ties at the last rank."""
    monkeypatch.setattr(divergence, "SOURCES", block)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "HELD", 100 if entries == 10 else divergence.HELD)
    got = divergence.audit(docs, least=4, top=top).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == diverging(rows, 4, top)
    assert {r["part"] for r in got} == {"pair", "term"} and sum(r["part"] == "term" for r in got) > 10


def test_divergence_without_terms(spark, docs):
    got = divergence.audit(docs, least=10_000).collect()
    assert got and {(r["part"], r["value"]) for r in got} == {("pair", 0)}
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in ["", "abc", "a b c d e f g h", "x" * 40 + " y " + "z" * 20, " " * 30, "Ab-Cd é日本 " * 9]:
        assert [t for x in divergence.terms_of(text.encode()) for t in x] == text.encode().translate(divergence.FOLDED).split()


def without_lines(rows, least, many):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(list)
    for k, r in enumerate(rows):
        for x in {key(x) for x in (r[1] or "").split("\n")}:
            if len(x) >= least:
                holders[x].append(k)
    number = lambda k: float("-inf") if rows[k][0] is None else rows[k][0]
    last = {x: max(map(number, own)) for x, own in holders.items() if len(own) >= many}
    out = []
    for k, r in enumerate(rows):
        own = (r[1] or "").split("\n")
        stay = [x for x in own if last.get(key(x), number(k)) == number(k)]
        out.append((r[0], r[1], len(own), len(own) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


def line_rows():
    common = ["  This line comes in MANY documents ", "Straße und Übermut überall immer", "short", "é" * 19, "é" * 20, "twice only, in two documents", "\v\fEdges \r", ""]
    rows = []
    for k in range(60):
        own = [rng.choice(common) if rng.random() < 0.6 else "own line %d of the document %d" % (rng.randint(0, 3), k) for _ in range(rng.randint(0, 9))]
        own = [x.upper() if x.isascii() and rng.random() < 0.3 else x + " " for x in own]
        rows.append((k, "\n".join(own), "en", "a", 1, "r", "k", 3))
    rows += [(3, common[5], "en", "a", 1, "r", "k", 3), rows[7], rows[7], (None, None, None, None, 1, "r", "k", 3), (None, common[0] + "\n" + common[0], None, None, 1, "r", "k", 3), (-4, "\n".join(["a line of a very long document number one"] * 5000), None, None, 1, "r", "k", 3)]
    return rows


@pytest.mark.parametrize(("bits", "held"), [(lines.BITS, lines.HELD), ((1 << 15, 1 << 15), 500)])
def test_lines(spark, monkeypatch, bits, held):
    """Filters that tell keys apart and filters so small that nearly every key is suspected; tasks that send once and often."""
    monkeypatch.setattr(lines, "BITS", bits)
    monkeypatch.setattr(lines, "HELD", held)
    rows = line_rows()
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == without_lines(rows, 20, 3)
    assert sum(r["n_dropped"] for r in got) > 50 and all(r["row"] == "r" and r["N_A"] == 1 for r in got)


def test_lines_of_nothing(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    got = lines.dedup(spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)).first()
    assert (got["n_lines"], got["n_dropped"], got["kept"]) == (1, 0, "")


def test_filters_of_two_tasks(spark):
    """A key is seen twice if one task saw it twice or two tasks saw it; others are, but for few, not."""
    keys = [("key %d" % k).encode() for k in range(4000)]
    parts = []
    for own in ([keys[:1000], keys[500:600]], [keys[900:2500]]):
        f = lines.Filters(1 << 17)
        for x in own:
            f.add(lines.hashed(x))
        parts.append(f.pages())
    (out,) = lines.merged(iter(parts))
    bits = [dict(zip(out["page"].to_pylist(), map(lines.opened, out[c].to_pylist()), strict=True)) for c in ("once", "twice")]
    has = lambda b, k: all(b[i // 8 // lines.PAGE][i // 8 % lines.PAGE] >> i % 8 & 1 for i in lines.places(lines.hashed([k]), 1 << 17)[0].tolist())
    assert all(has(bits[0], k) for k in keys[:2500]) and all(has(bits[1], k) for k in keys[500:600] + keys[900:1000])
    assert sum(has(bits[1], k) for k in keys[:500] + keys[1000:]) < 100
    assert hashlib.sha1(bits[0][0].tobytes()).hexdigest() != hashlib.sha1(bits[1][0].tobytes()).hexdigest()
