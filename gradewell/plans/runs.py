"""Queries of whole benchmark runs, with their SQL.

Brands stand for question sets, types for categories; line items are cached responses, of which one model has newer ones in a second place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators import evaluation as E
from gradewell.plans.catalog import query, read, rounded
from gradewell.sources.shared import shared_path

MODELS = ("m0", "m1", "m2")


def question_sets(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, d, "part").select(
        F.col("p_brand").alias("question_set"), F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 40 == 0).alias("is_example"), F.col("p_name").alias("question"),
        *[F.concat(F.lit(x), size.cast("string")).alias(f"c{i}") for i, x in enumerate("abcd", start=1)], F.concat(F.lit(" "), F.substring(F.lit("ABCD"), (size % 4 + 1).cast("int"), F.lit(1))).alias("answer"), F.col("p_type").alias("category"),
    )


def caches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = question_sets(spark, d).where("not is_example").select("question_set", "row_id")
    k = F.col("row_id")
    both = q.select("question_set", "row_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m"))
    said = F.concat(F.substring(F.lit("ABCDX"), ((k + F.col("m")) % 5 + 1).cast("int"), F.lit(1)), F.lit(". so"))
    general = both.select("question_set", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_id"), "row_id", said.alias("resps"))
    local = q.where("question_set = 'Brand#5'").select("question_set", F.lit("m1").alias("model_id"), "row_id", F.lit("text\nA").alias("resps"))
    return general, local


def done(spark: SparkSession, d: str) -> E.Run:
    general, local = caches(spark, d)
    return E.run(question_sets(spark, d), MODELS, general, local)


RUN = """WITH q AS (SELECT p_brand AS question_set, p_partkey AS row_id, p_partkey % 40 = 0 AS is_example, p_name AS question, substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) AS answer, p_type AS category FROM part),
r AS (SELECT question_set, row_id, category, answer, 'm' || m AS model_id, CASE WHEN question_set = 'Brand#5' AND m = 1 THEN 'A' ELSE nullif(substring('ABCDX', CAST((row_id + m) % 5 + 1 AS INTEGER), 1), 'X') END AS pred FROM q, (SELECT unnest([0, 1, 2]) AS m) WHERE NOT is_example)"""
SCORES = """round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END) * {s}, 6) AS accuracy, round(avg(CASE WHEN pred IS NULL THEN 1.0e0 ELSE 0.0e0 END) * {s}, 6) AS bad_format"""


@query("e26_run_summary", RUN + "SELECT question_set, model_id, " + SCORES.format(s=1) + ", count(*) AS n FROM r GROUP BY ALL")
def _(spark, d):
    return rounded(done(spark, d).summary, "accuracy", "bad_format")


@query("e26_run_full", RUN + """SELECT q.row_id, question, """ + ", ".join(f"CASE WHEN q.is_example THEN 'Few-shot example' ELSE max(pred) FILTER (model_id = '{m}') END AS pred_{m}" for m in MODELS) + " FROM q LEFT JOIN r USING (row_id) GROUP BY q.row_id, question, q.is_example")
def _(spark, d):
    return done(spark, d).full.select("row_id", "question", *[f"pred_{m}" for m in MODELS])


@query("e27_leaderboard", RUN + ", s AS (SELECT model_id, category, " + SCORES.format(s=100) + " FROM r GROUP BY ALL UNION ALL SELECT model_id, 'Overall', " + SCORES.format(s=100) + """ FROM r GROUP BY ALL)
SELECT model_id, max(accuracy) FILTER (category = 'ECONOMY') AS "ECONOMY", max(accuracy) FILTER (category = 'PROMO') AS "PROMO", max(accuracy) FILTER (category = 'Overall') AS "Overall", max(bad_format) FILTER (category = 'Overall') AS bad FROM s GROUP BY model_id""")
def _(spark, d):
    accuracy, bad = E.leaderboard(done(spark, d), ["ECONOMY", "PROMO"])
    return rounded(accuracy.join(bad.select("model_id", F.col("Overall").alias("bad")), "model_id"), "ECONOMY", "PROMO", "Overall", "bad")


@query("e27_scored_questions", RUN + "SELECT question_id, row_id, question FROM (SELECT *, row_number() OVER (ORDER BY question_set, row_id) - 1 + 920 AS question_id FROM q) WHERE NOT is_example")
def _(spark, d):
    return E.scored_questions(done(spark, d), 920).select(F.col("question_id").cast("long").alias("question_id"), "row_id", "question")


@query("e6_questions_per_category", RUN + "SELECT category, count(*) FILTER (NOT is_example) AS n FROM q GROUP BY category")
def _(spark, d):
    return E.questions_per_category(question_sets(spark, d))


@query("e24_collected_sets", RUN + ", s AS (SELECT model_id, question_set, " + SCORES.format(s=1) + """ FROM r GROUP BY ALL), z AS (SELECT sum(n) AS asked, count(*) AS n_sets FROM (SELECT question_set, count(*) AS n FROM q WHERE NOT is_example GROUP BY 1))
SELECT model_id, max(accuracy) FILTER (question_set = 'Brand#1') AS first, max(accuracy) FILTER (question_set = 'Brand#5') AS fifth, max(bad_format) FILTER (question_set = 'Brand#5') AS bad, CAST(any_value(asked) AS BIGINT) AS asked, any_value(n_sets) AS n_sets FROM s, z GROUP BY model_id""")
def _(spark, d):
    found = E.collect_sets(done(spark, d), ["Brand#1", "Brand#5"])
    both = found.accuracy.toDF("model_id", "first", "fifth").join(found.bad_format.select("model_id", F.col("`Brand#5`").alias("bad")), "model_id")
    sizes = found.sizes.agg(F.sum("n").alias("asked"), F.count("*").alias("n_sets"))
    return rounded(both.crossJoin(F.broadcast(sizes)), "first", "fifth", "bad")  # sizes is one row


@query("e25_experiments", RUN + """SELECT experiment, model_id, """ + SCORES.format(s=1) + """, count(*) AS n FROM (SELECT *, 'duplicate' AS experiment FROM r WHERE model_id = 'm0' UNION ALL SELECT *, 'permute' FROM r) GROUP BY ALL""")
def _(spark, d):
    from gradewell.operators.scoring import score

    general, local = caches(spark, d)
    sets = question_sets(spark, d)
    found = E.collect_runs({"duplicate": E.run(sets, MODELS[:1], general), "permute": E.run(sets, MODELS, general, local)}, ["duplicate", "permute", "reworded"])
    return rounded(score(found, ["experiment", "model_id"]), "accuracy", "bad_format")


@query("b2_published", RUN + ", s AS (SELECT model_id, category, " + SCORES.format(s=100) + " FROM r GROUP BY ALL UNION ALL SELECT model_id, 'Overall', " + SCORES.format(s=100) + """ FROM r GROUP BY ALL)
SELECT model_id, max(accuracy) FILTER (category = 'PROMO') AS promo, max(accuracy) FILTER (category = 'Overall') AS overall, max(bad_format) FILTER (category = 'Overall') AS bad, (SELECT count(*) FROM q WHERE NOT is_example) AS n_full FROM s GROUP BY model_id""")
def _(spark, d):
    # the files of a published run, read back
    path = shared_path(spark, "published")
    general, local = caches(spark, d)
    E.publish(E.run(question_sets(spark, d), MODELS, general, local, settle=True), ["PROMO"], path)
    csv = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    rates = csv("accuracy").select("model_id", F.col("PROMO").cast("double").alias("promo"), F.col("Overall").cast("double").alias("overall"))
    both = rates.join(csv("bad_format").select("model_id", F.col("Overall").cast("double").alias("bad")), "model_id")
    sizes = csv("full").agg(F.count("*").alias("n_full"))
    return rounded(both.crossJoin(F.broadcast(sizes)), "promo", "overall", "bad")  # sizes is one row
