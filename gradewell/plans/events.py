"""Queries over events in time, with their SQL: sessions, latest values, overlapping intervals, frames, streaks, sketches, JSON paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import props
from gradewell.operators import sketches, timewise
from gradewell.plans.catalog import query, read
from gradewell.streaming import sessions as S


@query("k_sessions", """WITH o AS (SELECT user_id, ts, value, ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def _(spark, d):
    found = S.sessions(read(spark, d, "events"), "user_id", "ts", "value", "2 hours")
    return found.select("user_id", "start", "end", "n", F.round("total", 4).alias("total"))


def moved_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the events' users and month."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("o_orderkey") * 173) % 2_592_000)
    return read(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), at.alias("ordered"), "o_orderkey", "o_totalprice")


ORDERS = "o AS (SELECT o_custkey % 150 AS user_id, make_timestamp((1704067200 + (o_orderkey * 173) % 2592000) * 1000000) AS ordered, o_orderkey, o_totalprice FROM orders)"


@query("k_asof", f"""WITH {ORDERS}, u AS (SELECT user_id, ordered, max(o_totalprice) AS o_totalprice FROM o GROUP BY ALL)
SELECT event_id, u.o_totalprice FROM events e ASOF LEFT JOIN u ON e.user_id = u.user_id AND e.ts >= u.ordered""")
def _(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "ts")
    return timewise.asof_join(events, moved_orders(spark, d), ["user_id"], "ts", "ordered", ["o_totalprice"]).select("event_id", "o_totalprice")


@query("k_interval", f"""WITH {ORDERS}, a AS (SELECT event_id, user_id, ts AS s, ts + to_microseconds(CAST(1000000 * (event_id % 97 + 1) * (CASE WHEN event_id % 50 = 0 THEN 3600 ELSE 60 END) AS BIGINT)) AS e FROM events),
b AS (SELECT o_orderkey, user_id, ordered AS s, ordered + to_microseconds(CAST(1000000 * (o_orderkey % 61) * (CASE WHEN o_orderkey % 40 = 0 THEN 3600 ELSE 30 END) AS BIGINT)) AS e FROM o)
SELECT event_id, o_orderkey FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE b.s < b.e""")
def _(spark, d):
    after = lambda time, n: F.timestamp_micros(F.unix_micros(time) + F.lit(1_000_000) * n)
    i, k = F.col("event_id"), F.col("o_orderkey")
    shown = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("start"), after(F.col("ts").cast("timestamp"), (i % 97 + 1) * F.when(i % 50 == 0, 3600).otherwise(60)).alias("end"))
    sent = moved_orders(spark, d).select("o_orderkey", "user_id", F.col("ordered").alias("start"), after(F.col("ordered"), (k % 61) * F.when(k % 40 == 0, 3600).otherwise(30)).alias("end"))
    return timewise.interval_join(shown, sent, ["user_id"]).select("left.event_id", "right.o_orderkey")


@query("k_rolling", """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS most FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 90 MINUTE PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type", "ts", "value")
    of = {"n": (lambda: F.count("*"), timewise.added), "total": (lambda: F.sum("value"), timewise.added), "most": (lambda: F.max("value"), F.greatest)}
    out = timewise.rolling(events, ["event_type"], "ts", 90 * 60, of)
    return out.select("event_id", "n", F.round("total", 4).alias("total"), "most")


@query("k_streaks", """WITH n AS (SELECT user_id, ts, value >= 8 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value >= 8 ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM n WHERE good GROUP BY user_id, k""")
def _(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") >= 8).alias("good"))
    return timewise.streaks(events, ["user_id"], "ts", "good", "event_id")


@query("k_sketches", """WITH e AS (SELECT event_type, hour(ts) AS hour, user_id, value FROM events)
SELECT event_type, hour, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within FROM e GROUP BY GROUPING SETS ((event_type, hour), (event_type), ())""")
def _(spark, d):
    # the estimates of united sketches against exact values: each has to lie within its stated error
    events = read(spark, d, "events").select("event_type", F.hour("ts").cast("long").alias("hour"), "user_id", "value")
    fine = sketches.sketched(events, ["event_type", "hour"], "user_id", "value")
    grains = [["event_type", "hour"], ["event_type"], []]
    kinds = dict(events.dtypes)
    out = None
    for by in grains:
        exact = events.groupBy(*by).agg(F.count_distinct("user_id").alias("users"))
        found = sketches.estimates(sketches.united(fine, by), [0.5])
        # of a quantile the rank is what is stated: how many values lie below the estimate, and how many not above
        # over all rows each side is one row
        both = found.join(exact, by) if by else found.crossJoin(F.broadcast(exact))
        ranked = events.join(both, by) if by else events.crossJoin(F.broadcast(both))
        below, upto = F.avg((F.col("value") < F.col("q50")).cast("double")), F.avg((F.col("value") <= F.col("q50")).cast("double"))
        sides = ranked.groupBy(*by, "n", "users", "n_items").agg(below.alias("below"), upto.alias("upto"))
        users = F.abs(F.col("n_items") - F.col("users")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("users"))
        median = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
        own = [F.col(c) if c in by else F.lit(None).cast(kinds[c]).alias(c) for c in ("event_type", "hour")]
        part = sides.select(*own, "n", "users", users.alias("users_within"), median.alias("median_within"))
        out = part if out is None else out.unionByName(part)
    return out


@query("k_props", """WITH p AS (SELECT user_id, event_type, day(ts) % 2 AS odd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT user_id, event_type, coalesce(max(k) FILTER (odd = 0), 0) + coalesce(max(k) FILTER (odd = 1), 0) AS v FROM (SELECT user_id, event_type, odd, sum(k) AS k FROM p GROUP BY ALL) GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || CAST(v AS BIGINT), ',' ORDER BY event_type) AS sums FROM s GROUP BY user_id""")
def _(spark, d):
    # maps of even and of odd days, merged by key
    events = props.with_paths(read(spark, d, "events").select("user_id", "event_type", "ts", "props"), "props", {"k": ("$.k", "bigint")})
    even = props.sums_by_key(events.where(F.day("ts") % 2 == 0), ["user_id"], "event_type", "k", "a")
    odd = props.sums_by_key(events.where(F.day("ts") % 2 == 1), ["user_id"], "event_type", "k", "b")
    both = even.join(odd, "user_id", "full").select("user_id", props.merged(F.col("a"), F.col("b"), lambda x, y: x + y).alias("m"))
    listed = F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return both.select("user_id", F.array_join(listed, ",").alias("sums"))
