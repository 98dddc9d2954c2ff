"""Each operator against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import bpe, hnsw, jaccard, mixing, neardup, passages, sharding, substrings, suffix_array, toxicity, warc
from fieldtrace.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, size string, row string, Shard string"
rng = random.Random(5)
WORDS = ["w%d" % k for k in range(400)] + ["é", "straße", "日本"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table():
    base, passage = prose(150), prose(70)
    texts = [None, "", " \t\n", "one", "one two three", base, base, base.upper(), base + " tail end", prose(20) + " " + passage, passage + "\n" + prose(30), prose(5000) + passage, passage + " " + passage, "a" * 700, "ab" * 400]
    near = base.split(" ")
    for k in range(12):
        own = list(near)
        own[10 * k] = "changed"
        texts.append(" ".join(own))
    texts += [prose(rng.randint(1, 300)) for _ in range(40)]
    rows = [(k, t, "en", rng.choice(["a", "b", "é", None]), "x", None, "y") for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[9], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None), (-7, passage, None, "a", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in out)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 2 * max(r["size"] for r in v)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs).select("doc_id", "taken").collect())
    assert mixing.repeated(mixing.mix(docs), ["doc_id"]).count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty(spark)).count() == 0


def test_sharding(spark, docs, rows):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(rows)
    loads = collections.Counter()
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
        loads[r["shard"]] += r["size"]
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty(spark)).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("ab c "), (F.col("id") % 50).cast("int"))).alias("text"))
    sizes = [r["s"] for r in sharding.shard(many, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) < 1.03 * sum(sizes) / 8


def test_mixing_at_the_cap(spark):
    """A small source with a large weight stops at three times its size, and the rest is reshared by weight."""
    rows = [(k, "w " * 10, "a") for k in range(60)] + [(100 + k, "w " * 10, "b") for k in range(60)] + [(200 + k, "w " * 5, "c") for k in range(4)] + [(None, "w", "a"), (None, None, None), (7, "w " * 10, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    target = {r["source"]: r["target"] for r in out}
    assert target["c"] == 60 and target["a"] + target["b"] + target["c"] + target[None] == pytest.approx(sum(r["size"] for r in out))
    assert target["b"] == pytest.approx(2 * target["a"])
    assert all(r["taken"] == 15 for r in out if r["source"] == "c") and len(out) == len(rows)


def test_sharding_of_groups(spark):
    """Equal texts stay together unless their group is above 1/64 of a shard; ties, nulls and repeats have places; shards are as even as a greedy loop over all groups makes them, or nearly."""
    own = random.Random(9)
    texts = [f"text {k} " + "x" * own.randrange(200) for k in range(600)]
    rows = [(k, texts[k % 600]) for k in range(1500)] + [(None, "n"), (None, "n"), (None, None), (5, texts[5]), (5, "other")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    shards = collections.defaultdict(set)
    for r in out:
        shards[r["text"]].add(r["shard"])
    weight = collections.Counter()
    for r in out:
        weight[r["text"]] += r["size"]
    few = sum(weight.values()) / 6 / 64
    assert all(len(s) == 1 for t, s in shards.items() if weight[t] <= few) and any(w <= few for w in weight.values())
    load, greedy = collections.Counter(), [0] * 6
    for r in out:
        load[r["shard"]] += r["size"]
    sizes = collections.Counter()
    for _, t in rows:
        sizes[t] += len((t or "").encode()) + 8
    for n in sorted(sizes.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert max(load.values()) <= max(greedy) * 1.02 and len(out) == len(rows)
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out))) for s in range(6))


def test_passages(spark, docs, rows):
    out = passages.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    first = {}
    ids = [(-(1 << 63) if r[0] is None else r[0], words(r[1])) for r in rows]  # only one null doc_id has words
    for i, w in ids:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    expected = collections.Counter()
    for i, w in ids:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        expected[None if i == -(1 << 63) else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    assert collections.Counter(map(tuple, out)) == expected
    assert passages.dedup(empty(spark)).count() == 0


def test_substrings(spark, docs, rows):
    out = substrings.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    expected = collections.Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        expected[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    assert collections.Counter((*r[:4], bytes(r[4])) for r in map(tuple, out)) == expected
    assert substrings.dedup(empty(spark)).count() == 0


def test_rows_with_one_doc_id(spark):
    """Different texts with one doc_id are different documents, that lose and link only what is theirs."""
    a, b, long = prose(130), " ".join("z%d" % k for k in range(90)), " ".join("q%d" % (k * 9973) for k in range(500_000))
    rows = [(0, a), (1, a), (1, b), (2, long), (3, a + " end"), (4, "tail " + long + " " + b), (4, b), (4, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 5_000_000
    gone = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substrings.dedup(docs).collect()]
    n = [len(x.encode()) for x in (a, b, long)]
    assert sorted(gone) == sorted([(0, n[0], n[0], 1), (1, n[0], n[0], 1), (1, n[1], n[1], 1), (2, n[2], n[2], 1), (3, n[0] + 4, n[0], 1), (4, n[1] + n[2] + 6, n[1] + n[2], 2), (4, n[1], n[1], 1), (4, n[1], n[1], 1)])
    kept = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.dedup(docs).collect()]
    assert sorted(kept) == sorted([(0, 130, 0), (1, 130, 130), (1, 90, 0), (2, 500_000, 0), (3, 131, 130), (4, 500_091, 500_090), (4, 90, 90), (4, 90, 90)])
    linked = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()]
    size = len(set(zip(*[a.split()[k:] for k in range(5)], strict=False)))
    tail = len({tuple(w[k : k + 5]) for w in [(a + " end").split()] for k in range(127)})
    assert sorted(linked) == sorted([(0, size, 0), (1, size, 0), (1, 86, 1), (2, 499_996, 2), (3, tail, 0), (4, 500_087, 2), (4, 86, 1), (4, 86, 1)])
    one = sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    assert one == sorted([(0, a), (1, b), (2, long)])
    again = spark.createDataFrame([(None, a), (None, a), (5, a), (None, ""), (None, None), (6, ""), (6, "")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in jaccard.one_of_each(again).collect()))) == ["6", "None", "None", "None"]


def test_nul_and_hot_anchors(spark, monkeypatch):
    assert [list(x) for x in substrings.repeated([b"ab\0cd", b"ab", b"cda", b"ab\0cdzz"], 5)] == [[0], [], [], [0]]
    monkeypatch.setattr(substrings, "HOT", 3)
    own = random.Random(4)
    word = lambda n: "".join(own.choice("abcdefghij ") for _ in range(n))
    line = word(150)
    texts = [word(40 + k % 30) + line + word(60) for k in range(60)]
    texts += [texts[k][5:] + word(9) for k in range(0, 40, 3)] + ["ab\0cd" * 60, "ab" + "\0cd" + "ab\0cd" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for r in substrings.dedup(docs).collect():
        t = texts[r["doc_id"]]
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert bytes(r["kept"]).decode() == "".join(x for x, g in zip(t, gone, strict=True) if not g)


def test_suffix_array():
    for _ in range(300):
        s = bytes(rng.choice(rng.choice([b"a", b"ab", b"abc", bytes(range(256))])) for _ in range(rng.randint(1, 60)))
        data = np.frombuffer(s, np.uint8)
        order = suffix_array.suffix_array(data)
        assert list(order) == sorted(range(len(s)), key=lambda k: s[k:])
        before, common = suffix_array.permuted_common_prefixes(data, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert (before[b], common[b]) == (a, n)


@pytest.mark.parametrize(("n", "least"), [(4, 85), (5, 80)])
def test_jaccard(spark, docs, rows, n, least):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs, n, least).where("doc_id IS NOT NULL").collect()}
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0] if r[0] is not None else f"null{len(sets)}"] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    numbers = [i for i in sets if not isinstance(i, str)]

    def find(i):
        return i if root[i] == i else find(root[i])

    low = lambda i: -(1 << 63) if isinstance(i, str) else i
    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])), key=low)
                root[q] = p
    assert out == {i: (len(sets[i]), None if isinstance(find(i), str) else find(i)) for i in numbers}
    assert jaccard.link(empty(spark)).count() == 0


def test_jaccard_of_a_common_line(spark, monkeypatch):
    """Many classes share a line: the key is split, the descent is cut in chunks, and the result stays that of brute force."""
    from fieldtrace.llm import signatures

    monkeypatch.setattr(jaccard, "MEET", 60)
    monkeypatch.setattr(jaccard, "SENT", 0)
    monkeypatch.setattr(jaccard, "SENT_EACH", 0)
    own = random.Random(3)
    line = "a line of eight words that all have"
    texts = [line + " " + " ".join("v%d" % own.randrange(3000) for _ in range(own.randrange(6, 30))) for _ in range(300)]
    texts += [t + " more" for t in texts[:150]]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    low = list(range(len(texts)))
    for _ in range(10):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(docs, n=4, least=80).collect()} == dict(enumerate(low))
    sizes, bits = np.full(300, 8), np.full((300, 1), 255, np.uint64)
    a, b = signatures.pairs(signatures.Tree(sizes, bits), 80)
    assert len(a) == len({*zip(a.tolist(), b.tolist(), strict=True)}) == 300 * 299 // 2
    monkeypatch.setattr(signatures, "CHUNK", 16)
    assert max(len(x) for x, _ in signatures.pair_chunks(signatures.Tree(sizes, bits), 80)) <= 16 * signatures.FANOUT**2


def vectors():
    g = np.random.default_rng(3)
    x = g.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[0] + g.normal(size=(60, 16)).astype(np.float32) * 0.02
    x[200:260] = x[1]
    rows = [(k, [float(v) for v in x[k]], None if k % 97 == 5 else k % 3 if k > 300 else 0) for k in range(len(x))]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 0), (2005, [None] * 16, 0), (None, rows[0][1], 0), (2006, [1.0, 2.0], 0)]
    return rows, bad


def test_neardup(spark):
    rows, bad = vectors()
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    out = {r["vec_id"]: r for r in neardup.link(df, 0.98).where("vec_id IS NOT NULL").collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label) & (label[:, None] >= 0)
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(50):
        low = np.array([min([low[i], *low[np.flatnonzero(link[i])]]) for i in range(len(x))])
    for i in range(len(x)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (link[i].sum(), low[i], low[i] == i)
    for i in range(2000, 2007):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert neardup.link(df.limit(0)).count() == 0


def test_hnsw(spark):
    rows, bad = vectors()
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = hnsw.search(hnsw.index(df, shard_rows=600), queries, k=20).collect()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    by = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = {k for k in np.lexsort((np.arange(len(x)), -score))[:20]}
        hits += len(best & {r["vec_id"] for r in found})
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-9) for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
    assert hits / (20 * len(by)) >= 0.9
    assert hnsw.search(hnsw.index(df.limit(0)), queries).count() == 0
    few = df.where("vec_id < 5")
    assert hnsw.search(hnsw.index(few), queries.where("query_id = 0")).count() == 4


def test_hnsw_in_double(spark):
    """Vectors that differ beyond single precision stay apart, and scores are exact; clashing columns don't matter."""
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 8))
    x[1] = x[0] * (1 + 1e-12)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], "s", 7) for k in range(60)], "vec_id long, embedding array<double>, shard string, dim int")
    queries = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(1).alias("block"))
    for shard_rows in (20, 100):
        for r in hnsw.search(hnsw.index(df, shard_rows=shard_rows), queries).collect():
            assert r["score"] == pytest.approx(x[r["query_id"]] @ x[r["vec_id"]], abs=1e-15)


def test_neardup_in_blocks(spark, monkeypatch):
    """Many small blocks that meet by cells of several dimensions, clashing columns and repeated rows, against brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LEAF", 4)
    g = np.random.default_rng(7)
    x = (g.normal(size=(40, 6))[g.integers(0, 40, 500)] + g.normal(size=(500, 6)) * 0.12).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], k % 2, "c", 1) for k in range(500)]
    df = spark.createDataFrame([*rows, rows[4]], "vec_id long, embedding array<float>, label int, cell string, block int")
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    link = (unit @ unit.T >= 0.98) & (np.arange(500)[:, None] % 2 == np.arange(500)[None] % 2)
    low = np.arange(500)
    for _ in range(60):
        low = np.array([low[np.flatnonzero(link[i])].min() for i in range(500)])
    out = collections.defaultdict(list)
    for r in neardup.link(df, 0.98).collect():
        out[r["vec_id"]].append((r["component_id"], r["n_links"], r["cell"]))
    copies = link[:, 4].astype(int)
    assert {i: {v[0] for v in out[i]} for i in out} == {i: {low[i]} for i in range(500)}
    assert all(out[i][0][1:] == (link[i].sum() - 1 + copies[i], "c") for i in range(500)) and len(out[4]) == 2


def test_bpe(spark, docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    marks = "aab c\n\t\r  ''sl l1½²\x85\xa0\x1c é漢😀’<|endoftext|>٣Ⅷ"
    odd = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|endoftext|> x"]) for _ in range(300)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        text = r["text"] or ""
        ids = own.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == own.decode(ids, skip_special_tokens=False) == text
    assert bpe.encode(df.limit(0), path).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [447]), (4, [-1, 1_000_000, None, *own.encode("ab", add_special_tokens=False).ids])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(some, path).orderBy("doc_id").collect()] == [None, "", "�", "ab"]


def test_warc(spark):
    body = "<p>" + "x" * 1200
    rows = [(1, "http://a/", body), (2, "http://b/ c\n", body), (9, None, body), (9, None, body), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", body), (7, "ü", "é" * 5000), (8, "u", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"{shared_folder(spark)}/warc-test"
    warc.write(warc.records(pages).repartition(2), path)
    back = warc.read(spark, path)
    got = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_length"], None if r["payload"] is None else bytes(r["payload"])) for r in back.collect()}
    expected = set()
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == body and i != 9
        expected.add((f"urn:page:{'' if i is None else i}", "revisit" if revisit else "response", "urn:page:9" if revisit else None, hashlib.sha1(raw).hexdigest(), len(raw), None if revisit else raw))
    assert got == expected and back.count() == len(rows)
    only = back.where("record_type = 'revisit'")
    assert only.count() == 3
    plan = spark._jvm.PythonSQLUtils.explainString(only._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(record_type,revisit)]" in plan and "= revisit" not in plan
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))) == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    assert warc.read(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    none = f"{shared_folder(spark)}/warc-none"
    warc.write(warc.records(pages.limit(0)), none)
    assert warc.read(spark, none).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    data = [warc.record("response", f"urn:x:{k}", "http://h/", None, None, 3, b"abc", "2020-01-01T00:00:00Z") for k in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    assert [bytes(r["payload"]) for r in warc.read(spark, str(tmp_path)).collect()] == [b"abc"] * 6


def test_toxicity(spark):
    def text(k):
        return prose(60) + (" rotten foul" if k % 4 == 0 else "") + " " + prose(20)

    rows = [(k, text(k), "en", "s", "x") for k in range(1200)] + [(5000, None, None, None, None), (5001, "", None, None, None), (None, "rotten foul", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 1200, 2)] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    out = toxicity.score(docs, index).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == (r["doc_id"] % 4 == 0 and r["doc_id"] < 5000)
    assert toxicity.score(docs.limit(0), index).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(5), toxicity.fit(docs.limit(0), labels)).count() == 5


def test_block_max_search():
    """Places, ties and products of the block-max search against a scan of all examples."""
    g = np.random.default_rng(2)
    n, v = 700, 900
    counts = []
    for k in range(n):
        t = np.unique(np.minimum(g.zipf(1.3, size=g.integers(0, 40)) - 1, v - 1) if k % 5 else g.integers(0, 5, 2))
        counts.append((t, g.integers(1, 4, len(t))))
    idf = 1 + g.random(v) * np.where(np.arange(v) % 50 == 0, 30, 1)
    docs, toxic = g.permutation(n).astype(np.int64), g.integers(0, 2, n)
    index = toxicity.Index({f"t{k}": k for k in range(v)}, idf, docs, toxic, counts, np.ones(n), 0.1)
    dense = np.zeros((n, v))
    for k, (t, c) in enumerate(counts):
        dense[k, t] = (1 + np.log(c)) * idf[t]
    dense /= np.maximum(1e-300, np.sqrt((dense**2).sum(1)))[:, None]
    queries = [(t, index.weights(t, c)) for t, c in counts[:200]]
    for (terms, weights), (places, dots) in zip(queries, index.nearest(queries, 7), strict=True):
        whole = dense[:, terms] @ weights
        order = np.lexsort((docs, -np.round(whole / max(1e-300, whole.max()), 11)))[:7]
        order = order[whole[order] > 0]
        assert list(index.docs[places]) == list(docs[order]) and dots == pytest.approx(whole[order])
    assert index.nearest([(np.zeros(0, np.int64), np.zeros(0))], 7)[0][0].size == 0


def test_toxicity_of_given_labels(spark):
    """Held-out quality, calibration, and labels that contradict each other."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the given tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert len(out) > 50 and (out.predicted == out.toxic).mean() >= 0.95
    assert ((out.score - out.toxic) ** 2).mean() <= 0.05
    for low, high in ((0, 0.2), (0.8, 1.01)):
        some = out[(out.score >= low) & (out.score < high)]
        assert len(some) == 0 or abs(some.score.mean() - some.toxic.mean()) <= 0.1
    rows = [(k, "calm words here" if k % 2 else "same bad text") for k in range(40)]
    fitted = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int"))
    real = fitted.index.docs[fitted.index.docs < 100]
    assert len(real) == 2 and dict(zip(real.tolist(), fitted.index.toxic[: len(real)].tolist(), strict=True)) == {min(k for k in range(40) if k % 2 == p and zlib.crc32(str(k).encode()) % 5): 1 - p for p in (0, 1)}


def test_toxicity_of_rare_words(spark):
    """A word that stands in few toxic examples counts; so do all words of a text, those that no example has too."""
    own = random.Random(8)
    common = lambda n: " ".join("c%d" % own.randrange(60) for _ in range(n))
    vile = [hashlib.md5(str(k).encode()).hexdigest()[:7] for k in range(20)]
    rows = [(k, common(40) + (" " + vile[k % 40 // 2] if k % 2 else "")) for k in range(400)]
    rows += [(1000 + k, vile[k] + " " + common(40)) for k in range(20)] + [(2000, vile[3] + " " + " ".join(f"fresh{k}" for k in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int"))
    assert {w for k, t in rows[:400] if zlib.crc32(str(k).encode()) % 5 for w in t.split()} <= set(fitted.index.terms)
    got = {r["doc_id"]: r for r in toxicity.score(docs, fitted).collect()}
    assert all(got[1000 + k]["predicted"] for k in range(20))
    assert got[2000]["evidence"][0]["similarity"] < got[1003]["evidence"][0]["similarity"] - 0.1


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the one before it kept; a user's columns keep their values, whatever their names."""
    import corpus_pipeline

    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    rows = [(*r[:4], len(r[1] or ""), 0.25, "mine", 3) for r in table()] + [(900 + k, f"vile{k % 3} " + prose(30), "en", "a", 1, 0.25, "mine", 3) for k in range(30)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(30)] + [(900 + k, 1) for k in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, str(tmp_path))
        got = spark.createDataFrame(got.collect(), got.schema)
        kept[name] = got.collect()
        if name != "bpe":
            assert got.columns == [c.split()[0] for c in kind.split(", ")]
            assert all((r["score"], r["kept"], r["size"]) == (0.25, "mine", 3) for r in kept[name])
    given = spark.read.parquet(f"{tmp_path}/documents.parquet").drop("score")
    scored = toxicity.score(given, toxicity.fit(given, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept["toxicity"]) == sorted(str((r["doc_id"], r["text"])) for r in scored if r["score"] < 0.5)
    assert sum(r["doc_id"] is not None and r["doc_id"] >= 900 for r in kept["toxicity"]) <= 15 and len(kept["toxicity"]) >= len(rows) - 34
    # One row of each group: the one with the smallest doc_id, null before all.
    before = kept["toxicity"]
    sets = []
    for r in before:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(before)))
    same = lambda i, j: before[i]["doc_id"] is not None and (before[i]["doc_id"], before[i]["text"]) == (before[j]["doc_id"], before[j]["text"])
    for i in range(len(before)):
        for j in range(i):
            if same(i, j) or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    order = lambda i: (before[i]["doc_id"] is not None, before[i]["doc_id"] or 0)
    chosen = [before[min((i for i in range(len(before)) if root[i] == g), key=order)]["doc_id"] for g in set(root)]
    assert sorted(map(str, chosen)) == sorted(str(r["doc_id"]) for r in kept["jaccard"])
    raw = {i: (r["text"] or "").encode() for i, r in enumerate(kept["jaccard"])}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    expected = collections.Counter()
    for i, r in enumerate(kept["jaccard"]):
        gone = bytearray(len(raw[i]))
        for k in range(len(raw[i]) - 199):
            if seen[raw[i][k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        expected[r["doc_id"], bytes(x for x, g in zip(raw[i], gone, strict=True) if not g).decode("utf-8", "replace")] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept["substrings"]) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substrings"])
    words_of = lambda rows: sum(len(words(r["text"])) for r in rows)
    assert abs(words_of(kept["mixing"]) - words_of(kept["substrings"])) <= 4 * max(len(words(r["text"])) for r in kept["substrings"])
    assert {r["doc_id"] for r in kept["mixing"]} <= {r["doc_id"] for r in kept["substrings"]}
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = collections.Counter((r["doc_id"], tuple(own.encode(r["text"] or "", add_special_tokens=False).ids)) for r in kept["mixing"])
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in kept["bpe"]) == tokens
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["bpe"])


def test_warc_members_of_several_records(spark, tmp_path):
    """One gzip member with three records, the second larger than what is read at a time; records of several members; skippable members between others."""
    import gzip

    sizes = [3, 500_000, 7]
    data = [warc.record("response", f"urn:x:{k}", "http://h/", None, None, n, bytes(rng.getrandbits(8) for _ in range(n)), "2020-01-01T00:00:00Z") for k, n in enumerate(sizes)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(data)))
    whole = b"".join(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole[:1000]) + gzip.compress(whole[1000:]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(data[0]) + warc.member(data[1], 4) + gzip.compress(data[2] + data[0]))
    (tmp_path / "d.warc").write_bytes(whole)
    back = warc.read(spark, str(tmp_path)).collect()
    assert sorted(len(r["payload"]) for r in back) == sorted(sizes * 4 + [3]) and all(r["payload_length"] == len(r["payload"]) for r in back)
    assert {hashlib.sha1(r["payload"]).hexdigest() for r in back} == {hashlib.sha1(d.split(b"\r\n\r\n", 2)[2][:n]).hexdigest() for d, n in zip(data, sizes, strict=True)}
    heads = warc.read(spark, str(tmp_path), payload=False).collect()
    assert sorted(r["payload_length"] for r in heads) == sorted(sizes * 4 + [3]) and all(r["payload"] is None for r in heads)


def test_toxicity_keeps_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(60)], "doc_id long, toxic boolean")
    named = docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in ("found_", "mark_", "beside_", "scored", "row", "Held_Out")])
    out = toxicity.score(named, toxicity.fit(docs, labels)).collect()
    assert len(out) == named.count() and all((r["found_"], r["mark_"], r["beside_"], r["scored"], r["row"]) == ("found_", "mark_", "beside_", "scored", "row") for r in out)
    assert all(isinstance(r["held_out"], bool) for r in out)
    few, all_of_them = (int((toxicity.fit(docs, labels, example_bytes=n).index.docs < np.iinfo(np.int64).max).sum()) for n in (3000, 64 << 20))
    assert 0 < few < all_of_them


def test_neardup_spreads_a_cell(spark):
    """A cell with nearly all vectors is ranged by vec_id too."""
    near = np.random.default_rng(3)
    spread = near.normal(size=(300, 16))
    close = spread[0] + near.normal(size=(9000, 16)) * 1e-4
    rows = [(k, [float(v) for v in x], "a") for k, x in enumerate(np.concatenate([close, spread]))]
    out = neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    links = {r["vec_id"]: r["n_links"] for r in out.collect()}
    assert all(links[k] == 9000 for k in range(9000))


def test_hnsw_keeps_repeated_ids(spark):
    points = np.random.default_rng(4).normal(size=(40, 6))
    rows = [(k % 30, [float(v) for v in x]) for k, x in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hnsw.search(hnsw.index(vectors), vectors.where("vec_id = 29").select(F.col("vec_id").alias("query_id"), "embedding"), k=50).collect()
    asked = points[29]
    want = sorted(((-float(points[k] @ asked), k % 30) for k in range(40) if k % 30 != 29))
    assert [(r["vec_id"], round(r["score"], 9)) for r in sorted(found, key=lambda r: r["rank"])] == [(v, round(-s, 9)) for s, v in want]
