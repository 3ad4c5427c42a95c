"""A benchmark run from files to the published table."""

import pytest
from pyspark.sql import functions as F

from gradewell.operators import columns, dedupe, evaluation
from gradewell.sources import tables


@pytest.fixture
def root(tmp_path):
    for folder in ("configs/questions/more", "configs/models", "data/test", "data/dev"):
        (tmp_path / folder).mkdir(parents=True)
    head = "Source,Question," + ",".join(f"Answer {x}" for x in "ABCDEFG") + ",Correct answer,Category\n"
    (tmp_path / "data/test/S_test.csv").write_text(head + "".join(f"s,q{i},a,b,c,d,,,,{'AB'[i % 2]},Science\n" for i in range(4)), encoding="utf-8")
    (tmp_path / "data/dev/S_dev.csv").write_text(head + "".join(f"s,e{i},a,b,c,d,,,,A,Science\n" for i in range(3)), encoding="utf-8")
    (tmp_path / "configs/questions/S.yaml").write_text(
        "test_file: test\\S_test.csv\ntest_header: 0\nexample_file: dev\\S_dev.csv\nexample_header: 0\nchoices: [A, B, C, D, E, F, G]\nchoice_cols: [2, 3, 4, 5, 6, 7, 8]\nanswer_col: 9\nquestion_col: 1\nexample_rows: [0, 2]\n"
    )
    (tmp_path / "configs/questions/more/S2.yaml").write_text("test_file: none\n")
    (tmp_path / "configs/models/two.yaml").write_text("m-1: Model One\nm-2: Model Two\n")
    return tmp_path


def test_run_from_files(spark, root):
    models = evaluation.load_models(root, "two")
    assert models == {"m-1": "Model One", "m-2": "Model Two"} and evaluation.configs(root, "S*") == ["S", "S2"]
    sets = evaluation.load_questions(spark, root, "S")
    rows = sets.orderBy("row_id").collect()
    assert [r.question for r in rows] == ["e0", "e2", "q0", "q1", "q2", "q3"] and [r.is_example for r in rows] == [True] * 2 + [False] * 4
    cached = spark.createDataFrame([("S", "m-1", i, "A") for i in range(2, 6)], "question_set string, model_id string, row_id long, resps string")

    def provider(model, prompt):
        assert model == "m-2" and "e0\nA. a" in prompt and "e1" not in prompt
        return "no letter" if "q3" in prompt else "B"

    done = evaluation.run(sets, list(models), cached, provider=provider, cache=str(root / "cache"))
    got = {r.model_id: (r.accuracy, r.bad_format, r.n) for r in done.summary.collect()}
    assert got == {"m-1": (0.5, 0.0, 4), "m-2": (0.25, 0.25, 4)}
    full = {r.row_id: r for r in done.full.collect()}
    assert full[0]["pred_m-1"] == evaluation.EXAMPLE and full[2]["pred_m-1"] == "A" and full[5]["pred_m-2"] is None
    text = evaluation.publish(done, ["Science"], str(root / "out"), models, offset=920).splitlines()
    assert text[2:] == ["| Model One | 50.0 |", "| Model Two | 25.0 |"]
    ids = sorted(int(r.question_id) for r in spark.read.option("header", True).csv(str(root / "out/full")).collect())
    assert ids == [922, 923, 924, 925]
    # a group in the local place replaces the general one's
    local = spark.createDataFrame([("S", "m-1", i, "B") for i in range(2, 6)], cached.schema)
    assert evaluation.run(sets, ["m-1"], cached, local).summary.first().accuracy == 0.5
    # without cache and provider nothing is answered
    assert evaluation.run(sets, ["m-2"], cached.limit(0)).summary.count() == 0
    with pytest.raises(ValueError, match="reworded"):
        evaluation.collect_runs({"reworded": done}, ["permute"])


def test_generated_configs(root):
    made = evaluation.experiment_configs(["data/x/test/exp_A_test.csv", "data/x/test/other_test.csv", "data/x/test/exp_B.txt"], {"choices": ["A", "B"]}, {"exp_A": 2}, prefix="exp_")
    assert list(made) == ["exp_A"]
    path = root / "c.yaml"
    path.write_text(made["exp_A"], encoding="utf-8")
    assert tables.read_config(path) == {"choices": ["A", "B"], "test_file": "x/test/exp_A_test.csv", "example_file": "x/dev/exp_A_dev.csv", "example_rows": [0, 1]}


def test_long_leaderboards_are_whole(spark):
    table = spark.range(1500).select(F.col("id").cast("string").alias("model"), F.col("id").cast("double").alias("score"))
    assert len(tables.markdown(table, "score").splitlines()) == 1502


def test_places_in_ranges_and_missing_groups(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = {r.row_id: r.at for r in columns.numbered(df.repartition(7), "row_id", "at", ["g"]).collect()}
    assert got == {i: i // 3 for i in range(500)}
    assert columns.numbered(df.limit(0), "row_id", "at").count() == 0
    assert [r.row_id for r in columns.without_rows(df, []).where("row_id < 2").orderBy("row_id").collect()] == [0, 1]


def test_one_value_is_checked_when_it_runs(spark):
    from gradewell.operators.scoring import one_value

    two = spark.createDataFrame([("a",), ("b",)], "category string")
    with pytest.raises(Exception, match="more than one value"):
        one_value(two, "category").collect()


def test_exact_flags_with_missing_texts_and_a_hot_one(spark):
    rows = [(i, "hot" if i % 2 else None) for i in range(200)] + [(200, "once")]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(5)
    flags = lambda keep: {r.row_id for r in dedupe.exact_flags(df, ["text"], keep=keep).collect() if not r.is_duplicate}
    assert (flags("first"), flags("last"), flags(False)) == ({0, 1, 200}, {198, 199, 200}, {200})


def test_command_line(spark, root, capsys):
    from gradewell.__main__ import main

    for model, letters in (("m-1", "ABAB"), ("m-2", "B?AA")):
        (root / "data/cache/S").mkdir(parents=True, exist_ok=True)
        (root / f"data/cache/S/{model}.csv").write_text("answers,resps,success\n" + "".join(f"A,{x}. so,True\n" for x in letters), encoding="utf-8")
    text = main(["--root", str(root), "--questions", "S", "--models", "two", "--offset", "900"], spark)
    assert text.splitlines()[2:] == ["| Model One | 100.0 |", "| Model Two | 25.0 |"]
    rates = spark.read.option("header", True).csv(str(root / "data/results/two/bad_format")).collect()
    assert {r.model_id: float(r.Science) for r in rates} == {"m-1": 0.0, "m-2": 25.0}
    assert {r.category for r in spark.read.option("header", True).csv(str(root / "data/results/two/full")).collect()} == {"Science"}
    main(["--root", str(root), "--questions", "S", "--models", "two", "--category", "SEND", "--output", str(root / "out")], spark)
    assert "SEND" in spark.read.option("header", True).csv(str(root / "out/two/accuracy")).columns
    with pytest.raises(SystemExit):
        main(["--root", str(root), "--questions", "S", "--models", "two", "--cache", str(root / "none")], spark)


def test_collected_sets(spark, root):
    sets = evaluation.load_sets(spark, root, ["S"])
    cached = spark.createDataFrame([("S", "m-1", i, "A") for i in range(2, 6)], "question_set string, model_id string, row_id long, resps string")
    found = evaluation.collect_sets(evaluation.run(sets, ["m-1"], cached), ["S", "T"])
    assert [tuple(r) for r in found.accuracy.collect()] == [("m-1", 0.5, None)] and [tuple(r) for r in found.sizes.collect()] == [("S", 4)]
    assert {r.category for r in found.full.collect()} == {"S"} and found.full.count() == 4
    mixed = (root / "data/test/S_test.csv").read_text().replace("Science", "Maths", 1)
    (root / "data/test/S_test.csv").write_text(mixed)
    with pytest.raises(ValueError, match="more than one category"):
        evaluation.load_sets(spark, root, ["S"])


def test_written_configs(spark, root):
    made = evaluation.write_configs(spark, str(root / "data"), root / "made", {"choices": ["A"]})
    assert [p.name for p in made] == ["S.yaml"] and tables.read_config(made[0])["example_rows"] == [0, 1, 2]


def test_tables_beside_each_other(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "row_id int, a string")
    b = spark.createDataFrame([(2, 5), (3, None)], "row_id int, b int")
    c = spark.createDataFrame([(4, "w")], "row_id int, `c.d` string")
    got = columns.beside([a, b, c])
    assert got.columns == ["row_id", "a", "b", "c.d"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", None, None), (2, "y", 5, None), (3, None, None, None), (4, None, None, "w")]
    with pytest.raises(Exception, match="twice: 2"):
        columns.beside([a, b.union(b)]).collect()
    with pytest.raises(ValueError):
        columns.beside([a, a])
    from gradewell.operators import lookups

    order = spark.createDataFrame([(2, 3), (0, 1), (1, 3), (3, 2)], "pos int, row_id int")
    assert [r.row_id for r in lookups.pick_rows(spark.createDataFrame([(1,), (2,), (3,)], "row_id int"), order).select("row_id").collect()] == [1, 3, 3, 2]
