"""Review states: rejects with reasons, and history records against a plain reading of the JSON."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from fieldtrace.sources import reviews

STATE = {
    "segment": "s1", "workflowId": "w", "canvasId": "c",
    "additionalProposals": [{"id": "C3", "x": 1}, {"eventKey": "C12", "id": 7}, {"id": "E4"}, {"id": "C0"}, "C5", None, {"proposal_key": "C9", "event_key": "no", "imported": False}],
    "engineBefore": {"predictions": [{"id": "E1"}]}, "engineAfter": {"predictions": [{"id": "E2", "nested": {"b": [1, {"z": 2, "a": None}], "a": "é"}}, {"id": 3}]},
    "decisions": {"0": {"status": "accepted"}, "other": "yes", "k": {"id": "C4", "status": 5}, "12": None},
    "conversation": [{"role": "user", "type": "own"}, "text", 5], "engineEventReviews": {"E2": {"status": "ok"}, "M1": "fine", "x": {"n": 1}},
}


def records(state):
    def key(v, stream):
        return next((v[f] for f in reviews.KEY_FIELDS if isinstance(v.get(f), str) and re.fullmatch(f"{stream}[1-9][0-9]*", v[f])), None) if isinstance(v, dict) else None

    def body(v, **own):
        return json.dumps({**(v if isinstance(v, dict) else {"value": v}), **own, "imported": True}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    mapped = lambda f: sorted(state[f].items()) if isinstance(state.get(f), dict) else []
    listed = lambda f: state[f] if isinstance(state.get(f), list) else []
    out = []
    for v in listed("additionalProposals"):
        if k := key(v, "C"):
            out.append(("C", k, None, None, body(v, event_key=k)))
    runs = [r for r in (state.get("engineAfter"), state.get("engineBefore")) if isinstance(r, dict) and isinstance(r.get("predictions"), list)]
    for v in runs[0]["predictions"] if runs else []:
        if k := key(v, "E"):
            out.append(("E", k, None, None, body(v, event_key=k)))
    status = lambda v, other: str(v.get("status", other)) if isinstance(v, dict) else other
    for n, v in mapped("decisions"):
        p = key(v, "C") or (f"decision-index:{n}" if n.isdigit() else n)
        out.append(("decision", None, p, status(v, "decision"), body(v, proposal_key=p, type=status(v, "decision"))))
    for v in listed("conversation"):
        out.append(("activity", None, None, "conversation", body(v, type="conversation")))
    for n, v in mapped("engineEventReviews"):
        out.append(("verdict", n, None, status(v, "reviewed"), body(v, event_key=n, type=status(v, "reviewed"))))
    return out


def test_history_records(spark):
    states = [STATE, {"segment": "s"}, {"decisions": [1], "conversation": {"a": 1}, "engineAfter": 5, "engineBefore": {"predictions": [{"id": "E7"}]}, "additionalProposals": None}]
    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(states)], "state_id int, text string").select("state_id", F.parse_json("text").alias("state"))
    got = sorted((r["state_id"], r["stream"], r["place"], r["event_key"], r["proposal_key"], r["type"], r["payload"], r["fingerprint"]) for r in reviews.history_records(df, ["state_id"]).collect())
    for k, s in enumerate(states):
        own = {}
        for r in got:
            if r[0] == k:
                own.setdefault(r[1], []).append(r[3:7])
        want = {}
        for r in records(s):
            want.setdefault(r[0], []).append(r[1:])
        assert own == want
    assert all(r[7] == hashlib.sha256(r[6].encode()).hexdigest() for r in got) and len(got) == 15


def test_review_states(spark, tmp_path):
    folders = {"base/one": ("w", "c"), "base/two": ("v", "d")}
    cases = {
        "base/one/s1": STATE, "base/two/s1": {"segment": "s1"}, "base/one/blank": {"segment": "blank", "workflowId": "", "canvasId": None}, "base/one/moved": {"segment": "other", "workflowId": "v", "canvasId": "c"},
        "base/one/number": {"segment": "number", "workflowId": 5}, "base/one/list": [1], "base/one/unlisted": STATE, "base/one/changed": STATE, "base/two/twice": {"segment": "twice"},
    }
    sums = ["# sums", ""]
    for name, state in cases.items():
        path = tmp_path / f"{name}-review-state.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(state))
        digest = hashlib.sha256(path.read_bytes()).hexdigest() if "changed" not in name else "0" * 64
        sums += [f"{digest}  ./{name}-review-state.json"] * (2 if "twice" in name else "unlisted" not in name)
    (tmp_path / "base/one/bad-review-state.json").write_bytes(b"{\xff")
    (tmp_path / "base/one/notes.json").write_text("{}")
    sums += [f"{hashlib.sha256(b'{' + bytes([255])).hexdigest().upper()} *base\\one\\bad-review-state.json", "nonsense"]
    (tmp_path / "sums.txt").write_text("\n".join(sums))
    got = {r["logical_key"].removesuffix("-review-state.json"): r for r in reviews.review_states(spark, str(tmp_path), str(tmp_path / "sums.txt"), folders).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "base/one/s1": None, "base/two/s1": None, "base/one/blank": None, "base/one/moved": "identity mismatch: workflowId, segment", "base/one/number": "identity mismatch: workflowId", "base/one/list": "not a JSON object",
        "base/one/unlisted": "absent from the manifest", "base/one/changed": "checksum mismatch", "base/two/twice": "listed twice in the manifest", "base/one/bad": "invalid JSON",
    }
    assert got["base/two/s1"]["canonicalized"] == got["base/one/blank"]["canonicalized"] == ["workflowId", "canvasId"] and got["base/one/s1"]["canonicalized"] == []
    assert (got["base/two/s1"]["workflow_id"], got["base/two/s1"]["segment_id"], got["base/one/s1"]["n_bytes"]) == ("v", "s1", len(json.dumps(STATE)))
    assert json.loads(got["base/two/s1"]["state"].toJson()) == {"segment": "s1", "workflowId": "v", "canvasId": "d"} and json.loads(got["base/one/s1"]["state"].toJson()) == STATE
    assert got["base/one/list"]["state"] is None
    faults = {(r["fault"], r["line"]) for r in reviews.manifest_faults(spark, str(tmp_path / "sums.txt")).collect()}
    assert faults == {("no entry", "nonsense"), ("listed twice", "base/two/twice-review-state.json")}


def test_regression_registries(spark, tmp_path):
    cases = {"a.json": ({"workflow": "w", "runs": [1]}, "w"), "b.json": ([{"run": 1}], "v"), "c.json": ({"workflow": "v"}, "w"), "d.json": ("text", "w"), "e.json": ({"workflow": "w"}, "w"), "in/f.json": ({"workflow": "w", "n": 2}, "w")}
    digests = {}
    for name, (value, _) in cases.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value))
        digests[name] = hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "sums.txt").write_text(f"{digests['a.json']}  a.json\n{'0' * 64}  e.json\n")
    ledger = spark.createDataFrame([("w", "in/f.json", digests["in/f.json"], "inserted"), ("v", "b.json", digests["b.json"], "rejected"), ("w", "a.json", "0" * 64, "inserted")], "workflow_id string, logical_key string, digest string, status string")
    asked = {name: w for name, (_, w) in cases.items()} | {"bad.json": "w", "none.json": "w"}
    out = reviews.regression_registries(spark, str(tmp_path), str(tmp_path / "sums.txt"), asked, ledger).cache()
    got = {r["logical_key"]: (r["status"], r["reason"], r["verified"]) for r in out.collect()}
    assert got == {
        "a.json": ("inserted", None, True), "b.json": ("inserted", None, False), "c.json": ("rejected", "workflow mismatch", False), "d.json": ("rejected", "neither an object nor a list", False), "e.json": ("rejected", "checksum mismatch", False),
        "in/f.json": ("unchanged", None, False), "bad.json": ("rejected", "invalid JSON", False), "none.json": ("rejected", "cannot be read", False),
    }
    prints = {r["logical_key"]: r["fingerprint"] for r in out.collect()}
    assert prints["a.json"] == hashlib.sha256(json.dumps(cases["a.json"][0], sort_keys=True, separators=(",", ":")).encode()).hexdigest() and prints["c.json"] is None
    report = {r["workflow_id"]: r.asDict() for r in reviews.import_report(out, ["workflow_id"]).collect()}
    assert report["v"] == {"workflow_id": "v", "inserted": 1, "unchanged": 0, "conflicting": 0, "rejected": 0, "succeeded": True} and (report["w"]["rejected"], report["w"]["succeeded"]) == (5, False)
