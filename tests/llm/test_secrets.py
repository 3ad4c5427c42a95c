import hashlib
import random
import re

import pytest

from gradewell.llm.secret_scan import BASE, LEDGER, RULES, Ledger, Rule, op12_secret_scan


def by_hand(text):
    """All spans of the base kinds, each pattern written as the contract has it."""
    out, text = [], text or ""
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for kind, pattern, keep in (
        ("assign", rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    order = ["assign", "access", "hex"]
    return [f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], order.index(x[1])))]


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "0123456789abcdef" * 2, "deadbeef", "ABCDEFGH1234", "longvalue_1", "é", "🫨", "\n", "ſecret", "toKen", "x", "ghp_" + "a1" * 20, "xoxb-1234567890-ab"]
    return [None, "", "password=short", "password=longenough1"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(n)] + ["x " * 200_000 + "secret: abcdefgh9"]


def update(ledger, spark, rows, schema="doc_id long, text string"):
    return {(r[0]): [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in ledger.update(spark.createDataFrame(rows, schema)).collect()}


def test_spans_equal_a_plain_search(spark, tmp_path):
    rows = list(enumerate(texts(1, 150)))
    got = update(Ledger(spark, str(tmp_path / "l"), BASE), spark, rows)
    assert got == {i: by_hand(t) for i, t in rows} and sum(map(len, got.values())) > 100


def test_further_rules_add_spans_only(spark, tmp_path):
    rows = list(enumerate(texts(2, 80) + ["-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh1.eyJabcdefgh2.sigsigsig_"]))
    got = update(Ledger(spark, str(tmp_path / "l")), spark, rows)
    assert {i: [x for x in v if x.split(":")[0] in ("assign", "access", "hex")] for i, v in got.items()} == {i: by_hand(t) for i, t in rows}
    assert {x.split(":")[0] for v in got.values() for x in v} == {r.kind for r in RULES}


def test_only_unseen_blobs_and_rules_are_scanned(spark, tmp_path):
    path = str(tmp_path / "l")
    entered = lambda: sorted((bytes(r.blob_id).hex(), tuple(r.rules)) for r in spark.read.schema(LEDGER).parquet(path).collect())
    name = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = Ledger(spark, path, BASE[:2])
    tags = tuple(r.tag for r in BASE[:2])
    assert update(first, spark, [(1, "AKIA" + "B" * 12), (2, "plain"), (3, "AKIA" + "B" * 12)]) == {1: ["access:0:16"], 2: [], 3: ["access:0:16"]}
    assert entered() == sorted([(name("AKIA" + "B" * 12), tags), (name("plain"), tags)])
    # the same again, a moved copy and a new text: only the new text is entered
    before = entered()
    got = update(first, spark, [(1, "AKIA" + "B" * 12), (9, "plain"), (4, "token=12345678")])
    assert got == {1: ["access:0:16"], 9: [], 4: ["assign:0:14"]}
    assert sorted(set(entered()) - set(before)) == [(name("token=12345678"), tags)] and len(entered()) == len(before) + 1
    # a new version of one rule and a new rule: these alone are applied to what is known
    newer = Ledger(spark, path, (BASE[0], Rule("access", 2, "AKIA[A-Z0-9]+", "AKIA", 10), BASE[2]))
    before = entered()
    assert update(newer, spark, [(1, "AKIA" + "B" * 12), (5, "AKIABBBBBB")]) == {1: ["access:0:16"], 5: ["access:0:10"]}
    assert sorted(set(entered()) - set(before)) == sorted([(name("AKIA" + "B" * 12), ("access@2", "hex@1")), (name("AKIABBBBBB"), ("assign@1", "access@2", "hex@1"))])
    # nothing to do: the ledger stays as it is, and the older rules still give their own findings
    before = entered()
    assert update(newer, spark, [(7, "AKIABBBBBB")]) == {7: ["access:0:10"]} and update(first, spark, [(1, "AKIA" + "B" * 12)]) == {1: ["access:0:16"]} and entered() == before


def test_edge_rows(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    schema = "doc_id long, text string, spans string, blob_id int, path string"
    assert ledger.update(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "secret=abcdefgh", "a", 1, None), (1, None, "b", 2, "p"), (1, "secret=abcdefgh", "c", 3, "p"), (1, "secret=abcdefgh", "c", 3, "p")]
    clash = spark.createDataFrame(rows, schema).drop("spans")
    got = sorted((str(r.doc_id), r.blob_id, len(r.spans)) for r in ledger.update(clash).collect())
    assert got == [("1", 2, 0), ("1", 3, 1), ("1", 3, 1), ("None", 1, 1)]
    with pytest.raises(ValueError):
        Ledger(spark, "x", (BASE[0], BASE[0]))


def test_query(spark, tmp_path):
    rows = list(enumerate(texts(3, 60)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op12_secret_scan(spark, str(tmp_path)).collect():
        spans = by_hand(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
