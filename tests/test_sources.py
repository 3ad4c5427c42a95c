import pytest
from pyspark.sql import functions as F

from gradewell.functions.cleaning import MISSING
from gradewell.operators import scoring
from gradewell.sources import tables
from gradewell.streaming import responses as streaming


def test_csv_keeps_line_breaks_and_nulls(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Question,Answer A\n"two\nlines ""x""",10\nplain,None\n', encoding="utf-8")
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "q.csv"), ["Question", "Answer A"]).collect()]
    assert got == [('two\nlines "x"', "10"), ("plain", None)]
    assert "None" in MISSING


def test_long_rows_are_skipped_and_short_ones_kept(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n1;2;3\n4\n", encoding="utf-8")
    got = {tuple(r) for r in tables.read_csv_without_long_rows(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()}
    assert got == {("1", "2"), ("4", None)}


def test_files_with_origin_and_counts(spark, tmp_path):
    for folder, n in (("EX_a", 2), ("EX_b", 1), ("other", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x y.csv").write_text("q\n" + "1\n" * n, encoding="utf-8")
    (tmp_path / "EX_a" / "z.csv").write_text("q\n" + "1\n" * 9, encoding="utf-8")
    origins = {r.origin for r in tables.read_files_with_origin(spark, str(tmp_path), ["q"], "EX_").where(F.col("origin").startswith("a/") | F.col("origin").startswith("b/")).collect()}
    assert origins == {"a/x y.csv", "b/x y.csv", "a/z.csv"}
    assert tuple(tables.count_rows_by_folder(spark, str(tmp_path), "EX_", ["q"]).first()) == (3, 2)


def test_pages_and_paths(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"one\ftwo")
    pages = tables.read_pages(spark, str(tmp_path / "d.bin"), lambda content: content.decode().split("\f")).orderBy("page").collect()
    assert [(p.page, p.text, p.error) for p in pages] == [(1, "one", None), (2, "two", None)]

    def failing(content):
        yield "first"
        raise OSError("torn")

    pages = tables.read_pages(spark, str(tmp_path / "d.bin"), failing).orderBy("page").collect()
    assert [(p.page, p.text, p.error) for p in pages] == [(1, "first", None), (2, None, "OSError: torn")]
    assert tables.local_path(None, tmp_path) is None
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f.csv").write_text("")
    assert tables.local_path("f.csv", tmp_path) == tmp_path / "data" / "f.csv"
    with pytest.raises(FileNotFoundError):
        tables.local_path("a\\b.csv", tmp_path)


def test_cache_is_replaced_by_group_and_failures_are_rows(spark, tmp_path):
    prompts = spark.createDataFrame([("s", m, i, f"p{i}") for m in ("m1", "m2") for i in range(3)], "question_set string, model_id string, row_id long, prompt string")

    def provider(model, prompt):
        if prompt == "p2":
            raise RuntimeError("no answer")
        return f"A {model}"

    path = str(tmp_path / "cache")
    tables.write_cache(tables.ask(prompts, provider), path)
    tables.write_cache(tables.ask(prompts.where("model_id = 'm1' and row_id = 0"), provider), path)
    got = spark.read.parquet(path).groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("bad")).orderBy("model_id").collect()
    assert [tuple(r) for r in got] == [("m1", 1, 0), ("m2", 3, 1)]


def test_json_fails_on_a_value_that_is_no_number(spark, tmp_path):
    good = spark.createDataFrame([("m", 0.5), ("n", None)], "model string, accuracy double")
    tables.write_json(good, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(Exception, match="not a number"):
        tables.write_json(spark.createDataFrame([("m", float("nan"))], "model string, accuracy double"), str(tmp_path / "k"))
    assert tables.markdown(good, "accuracy").splitlines()[2] == "| m | 0.5 |"


def test_streamed_scores_equal_batch(spark, tmp_path):
    schema = "model_id string, pred string, answer string, ts timestamp, id long"
    rows = [(f"m{i % 2}", "A" if i % 3 else None, "A", i) for i in range(40)]
    df = spark.createDataFrame(rows, "model_id string, pred string, answer string, id long").withColumn("ts", F.timestamp_seconds(F.col("id") * 60 + 86_400)).select("model_id", "pred", "answer", "ts", "id")
    df.unionByName(df.limit(7)).repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = streaming.once(streaming.arriving(spark, str(tmp_path / "in"), schema), ["id"])
    run = streaming.running_scores(arriving, ["model_id"]).writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    want = {r.model_id: (r.accuracy, r.bad_format, r.n) for r in scoring.score(df, ["model_id"]).collect()}
    got = {r.model_id: (r.accuracy, r.bad_format, r.n) for r in spark.table("scores").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
