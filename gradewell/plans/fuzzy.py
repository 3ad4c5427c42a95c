"""Queries of fuzzy duplicates on short texts, with SQL that finds the longest common subsequence bit by bit.

Part names with their types stand for questions; the SQL holds a text's places of each letter in a 64-bit number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators import dedupe
from gradewell.plans.catalog import query, questions, read


def short(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("row_id", F.concat_ws(" ", "question", "category").alias("text"), "question", "category", (F.col("p_size") % 5).alias("year"))


def ratios(column: str) -> str:
    """SQL of a table of ratios (x, y, ratio) between all different values of a column of q, and of each with itself."""
    return f"""
t_{column} AS (SELECT {column} AS v, length({column}) AS n, string_split({column}, '') AS cs FROM (SELECT DISTINCT {column} FROM q)),
m_{column} AS (SELECT v, n, cs, map(list_distinct(cs), list_transform(list_distinct(cs), lambda c: CAST(list_sum(list_transform(range(n), lambda i: CASE WHEN cs[i + 1] = c THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT))) AS places FROM t_{column}),
l_{column} AS (SELECT a.v AS x, b.v AS y, a.n AS na, b.n AS nb, list_reduce(list_prepend((CAST(1 AS BIGINT) << CAST(a.n AS INTEGER)) - 1, list_transform(b.cs, lambda c: coalesce(a.places[c], 0))),
 lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((CAST(1 AS BIGINT) << CAST(a.n AS INTEGER)) - 1)) AS r FROM m_{column} a, m_{column} b WHERE a.v <= b.v),
h_{column} AS (SELECT x, y, CASE WHEN x = y THEN 100 ELSE CAST(round_even(200.0e0 * (na - bit_count(r)) / (na + nb), 0) AS INTEGER) END AS ratio FROM l_{column}),
r_{column} AS (SELECT x, y, ratio FROM h_{column} UNION ALL SELECT y, x, ratio FROM h_{column} WHERE x <> y)"""


def long_ratios(column: str, table: str = "q") -> str:
    """ratios() for texts of any length: the places of a letter are a list of 60-bit numbers, added from the lowest with a carry."""
    full = (1 << 60) - 1
    added = "x.o[1] + (x.o[1] & x.o[2]) + acc.c"
    step = f"""list_reduce(list_prepend({{'c': CAST(0 AS BIGINT), 'o': CAST([] AS BIGINT[])}}, list_transform(range(len(r)), lambda k: {{'c': CAST(0 AS BIGINT), 'o': [r[k + 1], m[k + 1]]}})),
   lambda acc, x: {{'c': ({added}) >> 60, 'o': list_append(acc.o, (({added}) | (x.o[1] - (x.o[1] & x.o[2]))) & {full})}}).o"""
    return f"""
t_{column} AS (SELECT {column} AS v, length({column}) AS n, CAST(ceil(length({column}) / 60.0) AS BIGINT) AS w, string_split({column}, '') AS cs FROM (SELECT DISTINCT {column} FROM {table})),
m_{column} AS (SELECT v, n, w, cs, map(list_distinct(cs), list_transform(list_distinct(cs), lambda c: list_transform(range(w), lambda g: CAST(list_sum(list_transform(range(60), lambda i: CASE WHEN cs[g * 60 + i + 1] = c THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT)))) AS places FROM t_{column}),
l_{column} AS (SELECT a.v AS x, b.v AS y, a.n AS na, b.n AS nb, 60 * a.w AS bits, list_reduce(list_prepend(list_transform(range(a.w), lambda k: CAST({full} AS BIGINT)), list_transform(b.cs, lambda c: coalesce(a.places[c], list_transform(range(a.w), lambda k: CAST(0 AS BIGINT))))),
 lambda r, m: {step}) AS r FROM m_{column} a, m_{column} b WHERE a.v <= b.v),
h_{column} AS (SELECT x, y, CASE WHEN x = y THEN 100 ELSE CAST(round_even(200.0e0 * (bits - list_sum(list_transform(r, lambda b: bit_count(b)))) / (na + nb), 0) AS INTEGER) END AS ratio FROM l_{column}),
r_{column} AS (SELECT x, y, ratio FROM h_{column} UNION ALL SELECT y, x, ratio FROM h_{column} WHERE x <> y)"""


Q = "WITH q AS (SELECT p_partkey AS row_id, p_name || ' ' || p_type AS text, p_name AS question, p_type AS category, p_size % 5 AS year FROM part), "
TEXT = Q + ratios("text")
PAIRS = ", w AS (SELECT a.row_id AS i, b.row_id AS j, ratio FROM q a JOIN r_text ON x = a.text JOIN q b ON b.text = y WHERE a.row_id <> b.row_id)"


@query("f2_fuzzy_versions", TEXT + PAIRS + """, e AS (SELECT j, max_by(ratio, i) AS fuzzy_ratio FROM w WHERE i < j AND ratio > 85 GROUP BY j)
SELECT row_id, e.j IS NOT NULL AS is_fuzzy_duplicate, CASE WHEN e.j IS NOT NULL THEN 'duplicate' WHEN row_id IN (SELECT i FROM w WHERE i < j AND ratio > 85) THEN 'original' END AS version, CAST(fuzzy_ratio AS DOUBLE) AS fuzzy_ratio FROM q LEFT JOIN e ON e.j = row_id""")
def _(spark, d):
    return dedupe.fuzzy_flags(short(spark, d), ["text"], 85, versions=True, ratios=True).select("row_id", "is_fuzzy_duplicate", "version", "fuzzy_ratio")


@query("f5_ratios", TEXT + "SELECT x, y, ratio FROM r_text WHERE x < y AND ratio >= 70")
def _(spark, d):
    texts = short(spark, d).select("row_id", "text")
    found = dedupe.fuzzy_links(texts, ["text"], 70, strict=False)
    named = texts.groupBy("text").agg(F.min("row_id").alias("id"))
    both = found.join(named.select(F.col("id").alias("a"), F.col("text").alias("p")), "a").join(named.select(F.col("id").alias("b"), F.col("text").alias("q")), "b")
    return both.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.col("ratio").cast("int").alias("ratio"))


@query("f6_either_flag", Q + ratios("question") + "," + ratios("category") + """,
w AS (SELECT b.row_id AS j, r_question.ratio AS rq, r_category.ratio AS rc FROM q a JOIN r_question ON r_question.x = a.question JOIN q b ON b.question = r_question.y JOIN r_category ON r_category.x = a.category AND r_category.y = b.category WHERE a.row_id < b.row_id)
SELECT row_id, row_id IN (SELECT j FROM w WHERE rq > 95 OR (rq + rc) / 2.0e0 > 90) AS is_duplicate FROM q""")
def _(spark, d):
    q = short(spark, d)
    one = dedupe.fuzzy_flags(q, ["question"], 95, "by_question").select("row_id", "by_question")
    both = dedupe.fuzzy_flags(q, ["question", "category"], 90, "by_all").select("row_id", "by_all")
    return one.join(both, "row_id").select("row_id", dedupe.either(F.col("by_question"), F.col("by_all")).alias("is_duplicate"))


@query("f7_within_groups", TEXT + """, w AS (SELECT b.row_id AS j FROM q a JOIN r_text ON x = a.text JOIN q b ON b.text = y AND a.year = b.year WHERE a.row_id < b.row_id AND ratio > 88)
SELECT year, count(*) AS n, count(*) FILTER (row_id IN (SELECT j FROM w)) AS n_duplicates FROM q GROUP BY year""")
def _(spark, d):
    marked = dedupe.fuzzy_flags(short(spark, d), ["text"], 88, by=["year"])
    return marked.groupBy("year").agg(F.count("*").alias("n"), F.count_if("is_fuzzy_duplicate").alias("n_duplicates"))


@query("f9_share_by_threshold", TEXT + PAIRS + """, b AS (SELECT j, max(ratio) AS best FROM w WHERE i < j GROUP BY j)
SELECT t AS threshold, count(*) FILTER (best > t) AS n, round(100.0e0 * count(*) FILTER (best > t) / count(*), 6) AS percent FROM (SELECT row_id, coalesce(best, 0) AS best FROM q LEFT JOIN b ON j = row_id), (SELECT unnest([60, 70, 80, 90]) AS t) GROUP BY t""")
def _(spark, d):
    return dedupe.flag_totals(dedupe.sweep(short(spark, d), ["text"], [60, 70, 80, 90]), {t: f"above_{t}" for t in (60, 70, 80, 90)})


@query("f10_pairs", TEXT + """, f AS (SELECT text, min(row_id) AS id FROM q GROUP BY text)
SELECT least(a.id, b.id) AS row_id, string_agg(greatest(a.id, b.id) || ':' || ratio, ',' ORDER BY greatest(a.id, b.id)) AS partners FROM r_text JOIN f a ON a.text = x JOIN f b ON b.text = y WHERE a.id < b.id AND ratio >= 80 AND ratio < 95 GROUP BY 1""")
def _(spark, d):
    out = dedupe.pair_report(short(spark, d), ["text"], 80, 95)
    return out.select("row_id", F.array_join(F.transform("partners", lambda p: F.concat_ws(":", p["row"], p["ratio"].cast("int"))), ",").alias("partners"))


CANDIDATES = ", k AS (SELECT DISTINCT text, question FROM q), c AS (SELECT k.text AS known, x AS asked, ratio FROM r_text JOIN k ON k.text = y)"


@query("d7_matches", TEXT + "SELECT a.row_id AS query_id, b.row_id, ratio FROM q a JOIN r_text ON x = a.text JOIN q b ON b.text = y WHERE a.row_id % 100 = 0 AND ratio BETWEEN 70 AND 90")
def _(spark, d):
    # the queries are the rows whose number is divisible by 100, against all rows
    q = short(spark, d).select("row_id", "text")
    asked = q.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("text").alias("query"))
    return dedupe.fuzzy_matches(asked, q, "query", "text", 70, 90).select("query_id", "row_id", "ratio")


@query("d8_seeded_matches", TEXT + """, o AS (SELECT a.row_id AS seed, b.row_id, ratio FROM q a JOIN r_text ON x = a.text JOIN q b ON b.text = y WHERE a.row_id % 100 = 0 AND ratio >= 80 AND b.row_id <> a.row_id)
SELECT a.row_id AS seed, 1 + count(o.seed) AS n, a.row_id || coalesce(',' || string_agg(o.row_id, ',' ORDER BY ratio DESC, o.row_id), '') AS rows FROM q a LEFT JOIN o ON o.seed = a.row_id WHERE a.row_id % 100 = 0 GROUP BY a.row_id""")
def _(spark, d):
    q = short(spark, d).select("row_id", "text")
    asked = q.where("row_id % 100 = 0").select(F.col("row_id").alias("seed"), F.col("text").alias("query"))
    out = dedupe.candidate_report(asked, q, "query", "text", 80, seed="seed")
    return out.select("seed", F.size("partners").cast("long").alias("n"), F.array_join(F.transform("partners", lambda p: p["row"].cast("string")), ",").alias("rows"))


@query("d9_one_row", TEXT + "SELECT b.row_id, ratio FROM q a JOIN r_text ON x = a.text JOIN q b ON b.text = y WHERE a.row_id = 7 AND ratio > 75")
def _(spark, d):
    q = short(spark, d)
    return dedupe.similar_to(q, q.where("row_id = 7").first()["text"], "text", 75).select("row_id", "ratio")


@query("f11_candidates", TEXT + CANDIDATES + """SELECT asked AS query, count(*) AS n, string_agg(known || ':' || ratio, ',' ORDER BY ratio DESC, known) AS partners FROM c WHERE ratio BETWEEN 80 AND 99 GROUP BY asked""")
def _(spark, d):
    known = short(spark, d).select("text").distinct()
    out = dedupe.candidate_report(known.select(F.col("text").alias("query")), known, "query", "text", 80, 99, row="text")
    listed = F.array_join(F.transform("partners", lambda p: F.concat_ws(":", p["row"], p["ratio"])), ",")
    return out.select("query", F.size("partners").cast("long").alias("n"), listed.alias("partners"))


@query("f12_flag_audit", Q + ratios("question") + "," + ratios("category") + """,
w AS (SELECT a.row_id AS i, r_question.ratio AS rq, (r_question.ratio + r_category.ratio) / 2.0e0 AS ra FROM q a JOIN r_question ON r_question.x = a.question JOIN q b ON b.question = r_question.y JOIN r_category ON r_category.x = a.category AND r_category.y = b.category WHERE a.row_id <> b.row_id),
s AS (SELECT i, count(*) FILTER (rq >= 96) AS n1, count(*) FILTER (ra >= 96) AS n2, count(*) FILTER (rq >= 98) AS h1, count(*) FILTER (ra >= 98) AS h2 FROM w GROUP BY i)
SELECT row_id, coalesce(n1 > 0 OR n2 > 0, false) AS has_match, coalesce(h1 > 30 OR h2 > 30, false) AS many_matches FROM q LEFT JOIN s ON i = row_id WHERE year = 1""")
def _(spark, d):
    marked = short(spark, d).withColumn("flag", F.col("year") == 1)
    return dedupe.audit(marked, "flag", 96, "question", ["question", "category"], many=30, high=98)


@query("f13_staged", TEXT + """, e AS (SELECT row_id, text, row_number() OVER (PARTITION BY text ORDER BY row_id) > 1 AS dup FROM q), f AS (SELECT * FROM e WHERE NOT dup)
SELECT row_id, dup AS is_duplicate, NOT dup AND row_id IN (SELECT b.row_id FROM f a JOIN r_text ON x = a.text JOIN f b ON b.text = y WHERE a.row_id < b.row_id AND ratio > 85) AS is_fuzzy_duplicate FROM e""")
def _(spark, d):
    return dedupe.staged_flags(short(spark, d), ["text"], 85).select("row_id", "is_duplicate", "is_fuzzy_duplicate")


#: Whole benchmark items, and each once more without its first two words.
LONG = r"WITH q AS (SELECT item_id * 2 AS row_id, text AS question FROM benchmark UNION ALL SELECT item_id * 2 + 1, regexp_replace(text, '^[^ ]+ [^ ]+ ', '') FROM benchmark), " + long_ratios("question")
LONG_PAIRS = LONG + ", w AS (SELECT a.row_id AS i, b.row_id AS j, ratio FROM q a JOIN r_question ON x = a.question JOIN q b ON b.question = y WHERE a.row_id < b.row_id)"


def items(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    near = b.select((F.col("item_id") * 2 + 1).alias("row_id"), F.regexp_replace("text", "^[^ ]+ [^ ]+ ", "").alias("question"))
    return b.select((F.col("item_id") * 2).alias("row_id"), F.col("text").alias("question")).unionByName(near)


@query("f2_fuzzy_flag", LONG_PAIRS + """, e AS (SELECT j, max_by(ratio, i) AS fuzzy_ratio FROM w WHERE ratio > 80 GROUP BY j)
SELECT row_id, question, CAST(fuzzy_ratio AS DOUBLE) AS fuzzy_ratio, j IS NOT NULL AS is_fuzzy_duplicate, CASE WHEN j IS NOT NULL THEN 'duplicate' WHEN row_id IN (SELECT i FROM w WHERE ratio > 80) THEN 'original' END AS version FROM q LEFT JOIN e ON j = row_id""")
def _(spark, d):
    return dedupe.fuzzy_flags(items(spark, d), ["question"], 80, versions=True, ratios=True)


@query("f9_threshold_sweep", LONG_PAIRS + """, b AS (SELECT j, max(ratio) AS best FROM w GROUP BY j)
SELECT row_id, question, coalesce(best > 60, false) AS above_60, coalesce(best > 70, false) AS above_70, coalesce(best > 80, false) AS above_80, coalesce(best > 90, false) AS above_90 FROM q LEFT JOIN b ON j = row_id""")
def _(spark, d):
    return dedupe.sweep(items(spark, d), ["question"], [60, 70, 80, 90])


@query("f10_pair_report", LONG + """, f AS (SELECT question, min(row_id) AS id FROM q GROUP BY question)
SELECT a.id AS row_id, '[' || string_agg('{"row":' || b.id || ',"ratio":' || ratio || '.0}', ',' ORDER BY b.id) || ']' AS partners FROM r_question JOIN f a ON a.question = x JOIN f b ON b.question = y WHERE a.id < b.id AND ratio >= 70 AND ratio < 100 GROUP BY 1""")
def _(spark, d):
    out = dedupe.pair_report(items(spark, d), ["question"], 70, 100)
    return out.select("row_id", F.to_json("partners").alias("partners"))


@query("d7_fuzzy_matches", "WITH q AS (SELECT text FROM benchmark UNION ALL SELECT regexp_replace(text, '^[^ ]+ ', '') FROM benchmark), " + long_ratios("text") + """
SELECT b.item_id, a.item_id AS query_id, ratio FROM benchmark a JOIN r_text ON x = regexp_replace(a.text, '^[^ ]+ ', '') JOIN benchmark b ON b.text = y WHERE ratio BETWEEN 70 AND 100""")
def _(spark, d):
    # every item without its first word, against all items
    b = read(spark, d, "benchmark")
    asked = b.select(F.col("item_id").alias("query_id"), F.regexp_replace("text", "^[^ ]+ ", "").alias("query"))
    return dedupe.fuzzy_matches(asked, b, "query", "text", 70, 100).select("item_id", "query_id", "ratio")
