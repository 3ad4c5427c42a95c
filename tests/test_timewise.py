import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradewell.functions import props
from gradewell.operators import sketches, timewise
from gradewell.streaming import sessions as S

ZERO = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else ZERO + timedelta(seconds=seconds)


@pytest.mark.parametrize("rows", [3, 100_000])
def test_asof_equals_a_plain_search(spark, monkeypatch, rows):
    monkeypatch.setattr(timewise, "ROWS", rows)  # many ranges a key, and one
    rng = random.Random(rows)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), 7) for i in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    a = spark.createDataFrame([(i, k, at(t), x) for i, k, t, x in left], "id long, k string, ts timestamp, _row int")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, at timestamp, v int")
    for within in (None, 5):
        got = {r.id: r.v for r in timewise.asof_join(a, b, ["k"], "ts", "at", ["v"], within).collect()}
        want = {}
        for i, k, t, _ in left:
            best = max(((u, v is not None, v or 0, v) for j, u, v in right if k is not None and j == k and t is not None and u is not None and u <= t and (within is None or t - u <= within)), default=None)
            # the latest row counts even where an older one is nearer than it may be
            want[i] = best[3] if best else None
        assert got == want


def test_intervals_meet_once(spark):
    rng = random.Random(2)
    span = lambda: (s := rng.choice([None, *range(400)]), None if s is None else s + rng.choice([0, 1, 1, 3, 8, 50, 399]))
    left, right = ([(i, rng.choice(["a", "b", None]), *span()) for i in range(90)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], "id long, k string, start timestamp, end timestamp")
    joined = timewise.interval_join(frame(left), frame(right), ["k"])
    got = sorted((r.left.id, r.right.id) for r in joined.collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] is not None and None not in (a[2], b[2]) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    assert got == want and len(want) > 50
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert timewise.interval_join(frame(left).limit(0), frame(right), ["k"]).collect() == []


def test_rolling_frames(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(100)]), rng.choice([None, 1.0, 2.0])) for i in range(150)]
    df = spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in rows], "id long, k string, ts timestamp, v double")
    got = {r.id: (r.n, r.total) for r in timewise.rolling(df, ["k"], "ts", 7, {"n": lambda: F.count("*"), "total": lambda: F.sum("v")}).collect()}
    for i, k, t, _ in rows:
        near = [v for _, j, u, v in rows if j == k and t is not None and u is not None and t - 7 <= u <= t]
        sums = [v for v in near if v is not None]
        assert got[i] == ((len(near), sum(sums) if sums else None) if t is not None else (None, None))


@pytest.mark.parametrize("rows", [4, 100_000])
def test_streaks_over_borders(spark, monkeypatch, rows):
    monkeypatch.setattr(timewise, "ROWS", rows)
    rng = random.Random(4)
    events = [(i, rng.choice(["a", "b"]), rng.choice([None, *range(90)]), rng.choice([True, True, True, False, None])) for i in range(160)]
    df = spark.createDataFrame([(i, k, at(t), f) for i, k, t, f in events], "id long, k string, ts timestamp, good boolean")
    got = sorted((r.k, r.start, r.end, r.n) for r in timewise.streaks(df, ["k"], "ts", "good", "id").collect())
    want = []
    for key in "ab":
        run = []
        for i, _, t, f in [*sorted((e for e in events if e[1] == key and e[2] is not None), key=lambda e: (e[2], e[0])), (0, 0, 0, False)]:
            if f:
                run.append(at(t))
            elif run:
                want.append((key, run[0], run[-1], len(run)))
                run = []
    assert got == sorted(want)


def test_sketches_of_groups_unite(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 3000).alias("item"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"))
    parts = sketches.sketched(df, ["g"], "item", "v")
    (whole,) = sketches.estimates(sketches.united(parts, []), [0.1, 0.5]).collect()
    assert whole.n == 20_000 and abs(whole.n_items - 3000) <= sketches.DISTINCT_ERROR * 3000
    assert abs(whole.q50 - 10_000) <= sketches.RANK_ERROR * 20_000 and abs(whole.q10 - 2000) <= sketches.RANK_ERROR * 20_000
    (none,) = sketches.estimates(sketches.united(sketches.sketched(df.withColumn("v", F.lit(None).cast("double")), ["g"], "item", "v"), [])).collect()
    assert none.q50 is None


def test_paths_and_merged_maps(spark):
    rows = [(1, '{"a": {"b": 3}, "t": "x"}'), (2, '{"a": {"b": "no"}}'), (3, "{cut"), (4, None), (5, "[1]")]
    df = spark.createDataFrame(rows, "_variant_ long, j string")
    got = {r[0]: (r.b, r.t) for r in props.with_paths(df, "j", {"b": ("$.a.b", "int"), "t": ("$.t", "string")}).collect()}
    assert got == {1: (3, "x"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    maps = spark.createDataFrame([({"x": 1, "y": 2}, {"y": 5, "z": 7}), (None, {"z": 1}), ({"z": 1}, None), (None, None)], "a map<string,int>, b map<string,int>")
    assert [r.m for r in maps.select(props.merged(F.col("a"), F.col("b"), lambda x, y: x + y).alias("m")).collect()] == [{"x": 1, "y": 7, "z": 7}, {"z": 1}, {"z": 1}, None]


def streamed(spark, tmp_path, name, frames, make):
    """Batches one after the other, each a file; what the query has given out, and its rows that came too late."""
    source = tmp_path / name
    schema = "user long, ts timestamp, v double"
    source.mkdir()
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(arriving).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        for rows in frames:
            spark.createDataFrame([(u, at(t), v) for u, t, v in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        return sorted((r.user, r.start, r.end, r.n, r.total) for r in spark.table(name).collect()), S.late_rows(query)
    finally:
        query.stop()


def test_streamed_sessions_equal_those_of_a_table(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(6)
    events = [(u, 40 * k + rng.choice([0, 3, 9, 25]), float(k)) for u in (1, 2) for k in range(12)]
    # each batch out of order, and events up to a minute behind those of the batch before
    order = sorted(events, key=lambda e: (e[1] + rng.randint(0, 50), e[0]))
    frames = [order[i : i + 6] for i in range(0, len(order), 6)]
    end = [(9, 5000, 0.0)]  # moves the watermark past everything
    late = [(1, 10, 100.0), (2, 30, 100.0)]
    batch = S.sessions(spark.createDataFrame([(u, at(t), v) for u, t, v in events], "user long, ts timestamp, v double"), "user", "ts", "v", "20 seconds")
    want = sorted((r.user, r.start, r.end, r.n, r.total) for r in batch.collect())
    built_in, n = streamed(spark, tmp_path, "built", [*frames, end, late], lambda df: S.sessions(df, "user", "ts", "v", "20 seconds", "10 minutes"))
    assert built_in == want and n == 2
    own, n = streamed(spark, tmp_path, "own", [*frames, end, late], lambda df: S.session_stream(df, "user", "ts", "v", 20, "10 minutes"))
    assert own == want and n == 2


@pytest.mark.parametrize("rows", [3, 100_000])
def test_order_of_long_groups(spark, monkeypatch, rows):
    from gradewell.operators import dedupe

    monkeypatch.setattr(timewise, "ROWS", rows)
    good = [("a", i, i // 2 if i % 5 else None) for i in range(40)]
    bad = [("b", i, 40 - i if i == 33 else i) for i in range(40)]
    df = spark.createDataFrame(good + bad + [("c", 1, 5)], "k string, row_id long, v int")
    assert {r.k: r.in_order for r in dedupe.in_order(df, "v", by=["k"]).collect()} == {"a": True, "b": False, "c": True}
    assert dedupe.in_order(df.where("k = 'a'"), "v").first().in_order and not dedupe.in_order(df.where("k = 'b'"), "v").first().in_order


def test_counts_of_many_united_sketches_lie_within_their_error(spark):
    n = 5000
    df = spark.range(300 * n).select((F.col("id") % 300).alias("g"), (F.col("id") % 2).alias("h"), F.xxhash64("id").alias("item"), F.lit(1.0).alias("v"))
    found = sketches.estimates(sketches.united(sketches.sketched(df, ["g", "h"], "item", "v"), ["g"])).collect()
    assert len(found) == 300 and all(abs(r.n_items - n) <= sketches.DISTINCT_ERROR * n for r in found)
    assert sketches.DISTINCT_ERROR <= 3 * 0.83 / 64  # no wider than once stated


def test_merged_frames_equal_plain_ones_and_see_each_row_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, 1.0, 2.5, 4.0])) for i in range(400)]
    df = spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in rows], "id long, k string, ts timestamp, v double")
    of = {"n": (lambda: F.count("*"), timewise.added), "total": (lambda: F.sum("v"), timewise.added), "most": (lambda: F.max("v"), F.greatest)}
    out = timewise.rolling(df, ["k"], "ts", 7, of)
    assert out.columns == [*df.columns, *of]
    # no frame slides over rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -7000000" not in plan and "unboundedpreceding" in plan
    for r in out.collect():
        _, k, t, v = rows[r.id]
        near = [x for _, j, u, x in rows if j == k and t is not None and u is not None and t - 7 <= u <= t]
        held = [x for x in near if x is not None]
        assert (r.k, r.v, r.n, r.total, r.most) == (k, v, *((len(near), sum(held) if held else None, max(held, default=None)) if t is not None else (None,) * 3))


def test_intervals_move_few_rows(spark, monkeypatch):
    # keys and times that the other side lacks do not move, and lengths of many powers share a level
    left = spark.range(2000).select((F.col("id") % 200).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("start"), F.timestamp_seconds(F.col("id") * 10 + F.pow(F.lit(2), F.col("id") % 16)).alias("end"), "id")
    right = left.where("k < 20").withColumnRenamed("id", "other")
    joined = timewise.interval_join(left, right, ["k"])
    want = left.alias("a").join(right.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))).select(F.struct("a.*").alias("left"), F.struct("b.*").alias("right"))
    assert joined.schema == want.schema or joined.dtypes == want.dtypes
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
    sizes, kind = [], type(left)
    plain = kind.join
    monkeypatch.setattr(kind, "join", lambda a, b, *of: (sizes.append(a.count() + b.count()) if "_bin" in a.columns else None) or plain(a, b, *of))
    timewise.interval_join(left, right, ["k"])
    assert len(sizes) == 2 and sum(sizes) < 4000, sizes  # of 2,200 intervals, in both joins
