import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradewell.functions import cleaning as clean
from gradewell.functions import pages
from gradewell.functions import responses as R
from gradewell.operators import dedupe, lookups, sampling, scoring

PARSED = [
    ("A", "A"), ("A good reason", "A"), ("A)", "A"), ("A: x", "A"), ("B, because", None), ("**B**", None), ("Answer: B", None), ("b", None), ("", None), (None, None),
    ("text\nC", "C"), ('text\nC"\n', "C"), ("  D.\nfoo\nE", "D"), ("<think>x</think> so B", "B"), ("<think>x</think>\nBAD", "D"), ("<think>x</think> B.", None),
    ("## Step 1: hm\nthe answer is C. \n", "C"), ("H", None), ("A\rz", "A"), ("text\nC\r", None), ("A" + " x" * 150_000, "A"), ("x\n" * 150_000 + "F", "F"),
]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_choice(spark):
    assert column(spark, [p for p, _ in PARSED], R.parse_choice) == [w for _, w in PARSED]


def test_keys_and_scores(spark):
    assert column(spark, [" A and B ", "C ", None], R.clean_key) == ["A, B", "C", None]
    assert column(spark, ["1,5", "x", None, "3"], clean.decimal_comma) == [1.5, None, None, 3.0]
    assert column(spark, ["a,b", "a", "a,b,c"], clean.second_of_two) == ["b", None, None]
    assert column(spark, ["12. a", "no", "x 7."], clean.question_number) == [12, None, 7]
    assert column(spark, ["a\nb\n3", "x"], clean.without_last_line) == ["a\nb", ""]
    assert column(spark, ["Page 3", "Page x"], clean.page_number) == [3, None]


def test_replacements_see_earlier_ones(spark):
    got = column(spark, ["a", "b", "c", None], lambda c: clean.replace_in_turn(c, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert got == ["a", "a", "a", None]


def test_question_text_with_a_gap(spark):
    df = spark.createDataFrame([("q", "x", None, "z")], "q string, a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    plain, listed = df.select(R.question_text(F.col("q"), cols), R.question_text(F.col("q"), cols, positional=True)).first()
    assert plain == "q\nA. x\nB. z" and listed == "q\nA. x\nB. nan"


def test_prompts_hold_examples(spark):
    rows = [(0, "s", "q0", "x", "A", True), (1, "s", "q1", "y", "A", False)]
    df = spark.createDataFrame(rows, "row_id int, question_set string, q string, a string, answer string, is_example boolean")
    got = R.with_prompts(df, "q", ["a"], "answer", "question_set").collect()
    assert len(got) == 1 and got[0]["prompt"].startswith(R.EXAMPLES_FOLLOW + "q0\nA. x\nA\n\n" + R.REAL_QUESTION + "q1\nA. y")


def test_segments():
    page = "1. one\nA a\nD d\nmore\n2. two\nD e"
    assert list(pages.segment(page)) == ["1. one\nA a\nD d\nmore", "2. two\nD e"]
    assert list(pages.segment("no number\nD")) == list(pages.segment(None)) == []


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert dedupe.common_subsequence(a, b) == plain_common(a, b)
    assert dedupe.fuzzy_ratio(None, "x") == 0 and dedupe.fuzzy_ratio("", "") == 100


@pytest.mark.parametrize("span", [8, 65_536])
def test_fuzzy_flags_equal_the_double_loop(spark, monkeypatch, span):
    monkeypatch.setattr(dedupe, "RANGE", span)  # windows of many ranges, and of one
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 30))) for _ in range(12)]
    texts = [t if rng.random() < 0.4 else t[:-1] + rng.choice("xyz") for t in base for _ in range(4)] + [None, None]
    n = len(texts)
    flag, version, ratio = [False] * n, [None] * n, [None] * n
    for i in range(n):
        for j in range(i + 1, n):
            r = dedupe.fuzzy_ratio(texts[i], texts[j])
            if r > 80:
                flag[j], version[j], ratio[j] = True, "duplicate", float(r)
                version[i] = version[i] if version[i] == "duplicate" else "original"
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, q string")
    got = dedupe.fuzzy_flags(df, ["q"], 80, versions=True, ratios=True).orderBy("row_id").collect()
    assert [r["is_fuzzy_duplicate"] for r in got] == flag
    assert [r["version"] for r in got] == version
    assert [r["fuzzy_ratio"] for r in got] == ratio
    plain = dedupe.fuzzy_flags(df, ["q"], 80).orderBy("row_id").collect()
    assert [r["is_fuzzy_duplicate"] for r in plain] == flag


def test_must_match_raises(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    keys = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, at int, v string")
    assert {tuple(r) for r in lookups.first_match(df, keys, "k", "at", ["v"]).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(Exception, match="no match"):
        lookups.first_match(df, keys, "k", "at", ["v"], must=True).collect()


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([("m", "A", "A"), ("m", None, "A"), ("m", None, None)], "model_id string, pred string, answer string")
    r = scoring.score(df, ["model_id"]).first()
    assert (r["accuracy"], r["bad_format"], r["n"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 3)


def test_positions_keep_the_answer(spark):
    df = spark.createDataFrame([(0, "w", "x", "y", "z", "B")], "row_id long, a string, b string, c string, d string, answer string")
    got = sampling.all_positions(df, list("abcd")).orderBy("variant").collect()
    assert [r["answer"] for r in got] == ["B", "A", "C", "D"]
    assert all(r["abcd"["ABCD".index(r["answer"])]] == "x" for r in got)


@pytest.mark.parametrize("most", [4, 10_000])
def test_fuzzy_matches_of_more_queries_than_are_sent(spark, most):
    from gradewell.operators import dedupe

    texts = [f"question {i * 37} about {'x' * (i % 9)} fractions" for i in range(40)] + ["", "a"]
    known = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    queries = known.where("item_id % 2 = 0").select(known["text"].alias("query"))
    want = sorted((i, q, dedupe.fuzzy_ratio(q, x)) for i, x in enumerate(texts) for q in texts[::2] if 70 <= dedupe.fuzzy_ratio(q, x) <= 100)
    got = dedupe.fuzzy_matches(queries, known, "query", "text", 70, 100, most_queries=most)
    assert sorted((r.item_id, r["query"], r.ratio) for r in got.collect()) == want


def test_copies_are_compared_once_and_meet_everywhere(spark, monkeypatch):
    from gradewell.operators import dedupe

    monkeypatch.setattr(dedupe, "COPIES", 100)
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([dedupe.fuzzy_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    monkeypatch.setattr(dedupe, "fuzz_ratio", counted)
    texts = ["large ring", "large rings", "cold plate", None]
    known = spark.range(2000).select(F.col("id").alias("row_id"), F.get(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 4).cast("int")).alias("text"))
    asked = known.where("row_id % 100 < 4").select(F.col("row_id").alias("seed"), F.col("text").alias("query"))
    got = dedupe.fuzzy_matches(asked, known, "query", "text", 80).groupBy("query", "text", "ratio").agg(F.count("*").alias("n"), F.count_distinct("row_id", "seed").alias("pairs")).collect()
    want = {(x, y, dedupe.fuzzy_ratio(x, y), 500 * 20, 500 * 20) for x in texts[:3] for y in texts[:3] if dedupe.fuzzy_ratio(x, y) >= 80}
    assert {tuple(r) for r in got} == want
    assert compared.value <= 2 * 9  # of 2,000 rows and 80 queries; both filters may ask for the ratio
    listed = dedupe.candidate_report(asked, known, "query", "text", 80, seed="seed").collect()
    assert len(listed) == 80 and all(r.partners[0].row == r.seed and len(r.partners) == (1 if r["query"] is None else 500 if r["query"] == "cold plate" else 1000) for r in listed)


def test_no_join_forms_the_rows_of_fuzzy_matches(spark, monkeypatch):
    from gradewell.operators import dedupe

    monkeypatch.setattr(dedupe, "COPIES", 100)

    def rows_of_joins(node) -> int:
        below = [node.children().apply(k) for k in range(node.children().size())]
        kind = node.getClass().getSimpleName()
        below += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStageExec" in kind else []
        return (node.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0) + sum(map(rows_of_joins, below))

    # rows without a number agree in all columns, and a column of both sides is kept twice
    known = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "large ring").otherwise("large rings").alias("text"), F.lit("k").alias("side"))
    asked = spark.range(100).select(F.lit("large ring").alias("query"), F.lit("q").alias("side"))
    got = dedupe.fuzzy_matches(asked, known, "query", "text", 80)
    assert got.columns == ["text", "side", "query", "side", "ratio"]
    rows = got.collect()
    counts = {x: sum(tuple(r) == x for r in rows) for x in {tuple(r) for r in rows}}
    assert counts == {("large ring", "k", "large ring", "q", 100): 200_000, ("large rings", "k", "large ring", "q", 95): 200_000}
    # lists of about 100 rows: before, the last join formed all 400,000 rows
    assert rows_of_joins(got._jdf.queryExecution().executedPlan()) < 20_000
    bare = dedupe.fuzzy_matches(asked.select("query"), known.select("text"), "query", "text", 96)
    assert bare.columns == ["text", "query", "ratio"] and bare.count() == 200_000


def test_hashes_of_prompts_are_those_of_whole_prompts(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else f"quéstion {i}", f"c{i}" if i % 4 else None, "ABCD"[i % 4], None if i % 17 == 0 else i % 5 == 1 and i % 3 > 0) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, set string, q string, a string, answer string, is_example boolean").repartition(5)
    want = R.with_prompts(df, "q", ["a"], "answer", "set").withColumn("prompt_md5", F.md5(F.col("prompt").cast("binary"))).drop("prompt")
    got = R.with_prompt_md5(df, "q", ["a"], "answer", "set")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # no row holds a set's examples
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
