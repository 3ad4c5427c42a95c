"""All queries of the benchmark engine by name, each with SQL that gives the same rows.

The test tables hold no questions, so parts stand for questions, line items for
responses of five models, suppliers for the registry and nations for providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.functions import cleaning as clean
from gradewell.functions import responses as R
from gradewell.operators import dedupe, leaderboard, lookups, sampling, scoring

FLAGSHIP = "e5_overall_grouping_sets"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_type").alias("category"), F.substring(F.lit("ABCD"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("answer"), F.col("p_name").alias("question"), "p_size"
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    letter = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.substring(F.lit("ABCDH"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1)))
    text = F.concat(letter, F.when(F.col("l_linestatus") == "F", ". because").otherwise(""))
    said = line.select(F.col("l_partkey").alias("row_id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model_id"), text.alias("resps"))
    out = said.join(questions(spark, d).select("row_id", "category", "answer"), "row_id")
    return out.withColumn("pred", R.parse_choice(F.col("resps")))


RESPONSES = """
WITH responses AS (
  SELECT l_partkey AS row_id, 'm' || CAST(l_suppkey % 5 AS VARCHAR) AS model_id, p_type AS category,
         substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) AS answer, resps,
         nullif(regexp_extract(resps, '^\\s*([A-G])(?:[.(?:*)\\s]|$)', 1), '') AS pred
  FROM (SELECT *, (CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE substring('ABCDH', CAST(l_partkey % 5 + 1 AS INTEGER), 1) END)
               || (CASE WHEN l_linestatus = 'F' THEN '. because' ELSE '' END) AS resps FROM lineitem)
  JOIN part ON p_partkey = l_partkey)
"""
RATES = """round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END) * {s}, 6) AS accuracy,
  round(avg(CASE WHEN pred IS NULL THEN 1.0e0 ELSE 0.0e0 END) * {s}, 6) AS bad_format, count(*) AS n"""


@query("h1_parse", RESPONSES + "SELECT resps, pred, count(*) AS n FROM responses GROUP BY ALL")
def _(spark, d):
    return responses(spark, d).groupBy("resps", "pred").agg(F.count("*").alias("n"))


@query("e1_accuracy", RESPONSES + "SELECT model_id, category, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM responses GROUP BY ALL")
def _(spark, d):
    return rounded(scoring.score(responses(spark, d), ["model_id", "category"]), "accuracy").select("model_id", "category", "accuracy")


@query("e2_bad_format", RESPONSES + "SELECT model_id, round(avg(CASE WHEN pred IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS bad_format, count(*) AS n FROM responses GROUP BY ALL")
def _(spark, d):
    return rounded(scoring.score(responses(spark, d), ["model_id"]), "bad_format").select("model_id", "bad_format", "n")


@query("e3_category_micro", RESPONSES + "SELECT model_id, " + RATES.format(s=100) + """ FROM responses JOIN (SELECT 'ECONOMY' AS category UNION ALL SELECT 'PROMO' UNION ALL SELECT 'PROMO') c USING (category)
 GROUP BY model_id HAVING avg(CASE WHEN pred IS NULL THEN 1.0e0 ELSE 0.0e0 END) * 100 < 60""")
def _(spark, d):
    return rounded(scoring.accuracy_by_category(responses(spark, d), ["ECONOMY", "PROMO", "PROMO"], threshold=0.6), "accuracy", "bad_format")


@query("e5_overall_grouping_sets", RESPONSES + "SELECT category, model_id, CAST(grouping(category) * 2 + grouping(model_id) AS BIGINT) AS grain, " + RATES.format(s=100) + " FROM responses GROUP BY GROUPING SETS ((category, model_id), (model_id))")
def _(spark, d):
    out = scoring.score_grains(responses(spark, d), [["category", "model_id"], ["model_id"]])
    return rounded(out, "accuracy", "bad_format").withColumn("grain", F.col("grain").cast("long"))


@query("e4_category_table", RESPONSES + """, s AS (SELECT model_id, category, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END) * 100, 6) AS v FROM responses GROUP BY ALL)
SELECT model_id, max(v) FILTER (category = 'ECONOMY') AS "ECONOMY", max(v) FILTER (category = 'PROMO') AS "PROMO" FROM s GROUP BY model_id HAVING max(v) FILTER (category = 'ECONOMY') IS NOT NULL""")
def _(spark, d):
    s = rounded(scoring.score(responses(spark, d), ["model_id", "category"], scale=100.0), "accuracy")
    return scoring.wide_table(s, "model_id", "category", "accuracy", ["ECONOMY", "PROMO"], first_only=True)


@query("e7_flag_shares", """SELECT lang, round(avg(CASE WHEN coalesce(quality = 1, false) THEN 1.0e0 ELSE 0.0e0 END) * 100, 6) AS is_good,
 round(avg(CASE WHEN coalesce(toxic = 1, false) THEN 1.0e0 ELSE 0.0e0 END) * 100, 6) AS is_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def _(spark, d):
    marked = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    marked = marked.withColumn("is_good", F.col("quality") == 1).withColumn("is_toxic", F.col("toxic") == 1)
    return rounded(scoring.flag_shares(marked, ["is_good", "is_toxic"], "lang"), "is_good", "is_toxic")


@query("e8_nunique_mean", "SELECT p_type AS category, count(DISTINCT l_suppkey) AS n_models, round(avg(l_quantity), 6) AS score_mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def _(spark, d):
    line = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    out = line.join(part, "l_partkey").groupBy("category").agg(F.count_distinct("l_suppkey").alias("n_models"), F.avg("l_quantity").alias("score_mean"))
    return rounded(out, "score_mean")


@query("e9_value_counts", RESPONSES + "SELECT model_id, pred, count(*) AS n FROM responses WHERE pred IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return scoring.frequencies(responses(spark, d), "pred", "model_id")


@query("e10_distinct_values", "SELECT count(DISTINCT event_type) AS n_types, count(DISTINCT user_id) AS n_users FROM events")
def _(spark, d):
    return read(spark, d, "events").agg(F.count_distinct("event_type").alias("n_types"), F.count_distinct("user_id").alias("n_users"))


@query("e12_category_of_question", """SELECT p_name AS question, CASE WHEN count(DISTINCT p_type) + max(CASE WHEN p_type IS NULL THEN 1 ELSE 0 END) = 1 THEN min(p_type) ELSE 'Multiple' END AS category,
 count(*) AS copies FROM part GROUP BY p_name""")
def _(spark, d):
    return scoring.category_of_question(questions(spark, d), "question")


@query("e13_all_correct", RESPONSES + """, q AS (SELECT row_id, category, model_id, bool_and(coalesce(pred = answer, false)) AS ok FROM responses GROUP BY ALL)
SELECT category, model_id, round(avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END) * 100, 6) AS reliability, count(*) AS n FROM q GROUP BY ALL""")
def _(spark, d):
    return rounded(scoring.reliable(responses(spark, d), "row_id", ["category", "model_id"]), "reliability")


@query("e15_bar_stats", """SELECT p_type AS category, round(avg(p_size), 6) AS mean, CAST(min(p_size) AS BIGINT) AS low, CAST(max(p_size) AS BIGINT) AS high,
 round(stddev_samp(p_size) / sqrt(count(p_size)), 6) AS standard_error FROM part GROUP BY p_type""")
def _(spark, d):
    out = scoring.bar_statistics(questions(spark, d).withColumn("p_size", F.col("p_size").cast("long")), ["category"], "p_size")
    return rounded(out, "mean", "standard_error")


@query("e19_by_position", RESPONSES + """SELECT category, model_id, position, round(avg(CASE WHEN pred IS NOT DISTINCT FROM answer AND answer IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) FILTER (has), 6) AS accuracy
FROM (SELECT g.category, g.model_id, g.position, r.pred, r.answer, r.answer IS NOT NULL AS has FROM (SELECT DISTINCT category, model_id, unnest(['A','B','C','D']) AS position FROM responses) g
LEFT JOIN responses r ON r.category = g.category AND r.model_id = g.model_id AND r.answer = g.position) GROUP BY ALL""")
def _(spark, d):
    return rounded(scoring.by_position(responses(spark, d), ["category", "model_id"]), "accuracy")


@query("e20_null_profile", "SELECT count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (lang IS NULL) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    return scoring.null_profile(read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("quality", "lang"))


@query("e22_collect", "SELECT CAST(s_nationkey AS BIGINT) AS provider, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS models FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("provider"), F.col("s_suppkey").cast("string").alias("model"), "s_suppkey")
    return lookups.collect_by(s, "provider", "model", "s_suppkey").select("provider", F.array_join("models", ",").alias("models"))


@query("d1_registry_inner", "SELECT s_suppkey AS model_id, n_name AS provider FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("provider"))
    return read(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("model_id"), "provider")


@query("d2_first_match_lookup", """SELECT p_partkey AS row_id, l_returnflag AS flag FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_returnflag, l_orderkey * 10000000000 + l_linenumber * 100000 + l_suppkey) AS l_returnflag
 FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def _(spark, d):
    at = F.col("l_orderkey") * 10000000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")
    keys = read(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_returnflag").alias("flag"), at.alias("at"))
    return lookups.first_match(questions(spark, d).select("row_id"), keys, "row_id", "at", ["flag"])


@query("d3_mean_lookup_left", """SELECT c_custkey AS row_id, round(m, 4) AS score FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def _(spark, d):
    out = lookups.mean_lookup(read(spark, d, "customer").select(F.col("c_custkey").alias("row_id")), read(spark, d, "orders"), "row_id", "o_custkey", "o_totalprice", "score")
    return out.select("row_id", F.round("score", 4).alias("score"))


@query("d3_unmatched", "SELECT count(*) AS rows, count(DISTINCT c_custkey) AS keys FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return lookups.unmatched(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey")


@query("d4_multi_origin", """SELECT c_custkey AS row_id, round(m, 4) AS score FROM customer LEFT JOIN (
 SELECT row_id, avg(v) AS m FROM (SELECT c_custkey AS row_id, unnest([c_custkey, c_custkey + 1, c_custkey + 1]) AS k FROM customer) JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders GROUP BY o_custkey) USING (k) GROUP BY row_id) ON row_id = c_custkey""")
def _(spark, d):
    k = F.col("c_custkey")
    own = read(spark, d, "customer").select(k.alias("row_id"), F.array(k, k + 1, k + 1).alias("keys"))
    out = lookups.mean_over_list(own, read(spark, d, "orders"), "row_id", "keys", "o_custkey", "o_totalprice", "score")
    return out.select("row_id", F.round("score", 4).alias("score"))


@query("d10_guarded_anti", """SELECT p_partkey AS row_id, p_name AS question FROM part WHERE p_name NOT IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) = 1 AND max(p_size) > 25)""")
def _(spark, d):
    q = questions(spark, d)
    return lookups.delete_unique(q, q.where("p_size > 25"), "question").select("row_id", "question")


@query("d15_exactly_one", "SELECT s_suppkey AS model_id, CAST(s_nationkey AS VARCHAR) AS provider FROM supplier")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_nationkey").alias("provider"))
    return lookups.exactly_one(s, "model_id", "provider")


@query("a7_cache_override", """WITH l AS (SELECT l_suppkey % 7 AS model_id, l_linenumber AS row_id, count(*) AS n FROM lineitem WHERE l_suppkey % 7 < 3 GROUP BY ALL),
g AS (SELECT l_suppkey % 7 AS model_id, l_linenumber AS row_id, -1 AS n FROM lineitem GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT * FROM g WHERE model_id NOT IN (SELECT model_id FROM l)""")
def _(spark, d):
    base = read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("model_id"), F.col("l_linenumber").alias("row_id"))
    local = base.where("model_id < 3").groupBy("model_id", "row_id").agg(F.count("*").alias("n"))
    return lookups.with_override(base.distinct().withColumn("n", F.lit(-1).cast("long")), local, ["model_id"])


for _keep, _sql in (("first", "row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1"), ("last", "row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) > 1"), (False, "count(*) OVER (PARTITION BY text) > 1")):

    @query(f"f1_dup_{_keep or 'all'}", f"SELECT doc_id, {_sql} AS is_duplicate FROM documents")
    def _(spark, d, keep=_keep):
        # the digest stands for the text: the shuffle carries 32 bytes a row
        docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("text"))
        return dedupe.exact_flags(docs, ["text"], keep=keep).select(F.col("row_id").alias("doc_id"), "is_duplicate")


@query("f15_order_check", "SELECT o_custkey AS grp, bool_and(ok) AS in_order FROM (SELECT o_custkey, coalesce(o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS ok FROM orders) GROUP BY o_custkey")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return dedupe.in_order(o, "o_totalprice", by=["grp"])


@query("g5_union", "SELECT name, phone, kind FROM (SELECT c_name AS name, NULL AS phone, 'c' AS kind FROM customer UNION ALL SELECT s_name, NULL, 's' FROM supplier)")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind"))
    s = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("phone"), F.lit("s").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True).select("name", "phone", "kind")


@query("g4_top_models", RESPONSES + "SELECT model_id, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM responses GROUP BY model_id ORDER BY accuracy DESC, model_id LIMIT 3")
def _(spark, d):
    s = rounded(scoring.score(responses(spark, d), ["model_id"]), "accuracy").select("model_id", "accuracy")
    return s.orderBy(F.desc("accuracy"), "model_id").limit(3)


@query("g8_sample", "SELECT p_partkey AS row_id FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey LIMIT (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM part)")
def _(spark, d):
    return sampling.sample_rows(questions(spark, d).select("row_id"), 0.1)


@query("g9_stratified", "SELECT p_partkey AS row_id, p_type AS category FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey) <= 5")
def _(spark, d):
    return sampling.stratified(questions(spark, d).select("row_id", "category"), "category", 5)


@query("g10_few_shot", """WITH p AS (SELECT p_partkey AS row_id, p_type AS category, (['Pre-primary', 'Primary', 'Secondary', 'All'])[p_size % 4 + 1] AS age FROM part),
a AS (SELECT *, 0 AS pool FROM p WHERE age IN ('Pre-primary', 'All') QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) <= 1),
b AS (SELECT *, 1 AS pool FROM p WHERE age IN ('Primary', 'All') AND row_id NOT IN (SELECT row_id FROM a) QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(CAST(row_id AS VARCHAR) || ':43'), row_id) <= 1),
c AS (SELECT *, 2 AS pool FROM p WHERE age IN ('Secondary', 'All') AND row_id NOT IN (SELECT row_id FROM a UNION SELECT row_id FROM b) QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(CAST(row_id AS VARCHAR) || ':44'), row_id) <= 1)
SELECT row_id, category, CAST(pool AS BIGINT) AS pool FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def _(spark, d):
    age = F.get(F.array(*[F.lit(x) for x in ("Pre-primary", "Primary", "Secondary", "All")]), (F.col("p_size") % 4).cast("int"))
    q = questions(spark, d).select("row_id", "category", age.alias("age_group"))
    return sampling.few_shot(q, 3, "category").select("row_id", "category", F.col("pool").cast("long").alias("pool"))


@query("g12_replicate", "SELECT p_partkey * 3 + r AS row_id, p_type AS category, r AS rep FROM part, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS r)")
def _(spark, d):
    return sampling.replicate(questions(spark, d).select("row_id", "category"), 3).withColumn("rep", F.col("rep").cast("long"))


@query("g13_permute", """WITH q AS (SELECT p_partkey AS row_id, substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) AS a0, ['a' || p_size, 'b' || p_size, 'c' || p_size, 'd' || p_size] AS x FROM part),
v AS (SELECT *, unnest(['A', 'B', 'C', 'D']) AS n FROM q), w AS (SELECT *, position(a0 IN 'ABCD') AS o, position(n IN 'ABCD') AS m FROM v)
SELECT row_id, CAST(CASE WHEN n = a0 THEN 0 WHEN m > o THEN m - 1 ELSE m END AS BIGINT) AS variant,
 CASE WHEN m = 1 THEN x[o] WHEN o = 1 THEN x[m] ELSE x[1] END AS c1, CASE WHEN m = 2 THEN x[o] WHEN o = 2 THEN x[m] ELSE x[2] END AS c2,
 CASE WHEN m = 3 THEN x[o] WHEN o = 3 THEN x[m] ELSE x[3] END AS c3, CASE WHEN m = 4 THEN x[o] WHEN o = 4 THEN x[m] ELSE x[4] END AS c4, n AS answer FROM w""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    q = questions(spark, d).select("row_id", "answer", *[F.concat(F.lit(x), size).alias(f"c{i}") for i, x in enumerate("abcd", start=1)])
    return sampling.all_positions(q, ["c1", "c2", "c3", "c4"]).withColumn("variant", F.col("variant").cast("long"))


@query("g15_picker", """WITH q AS (SELECT p_partkey * 4 + r AS row_id, p_type AS category, r FROM part, (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS r)),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1 AS k, count(*) OVER (PARTITION BY category) // 4 AS c FROM q)
SELECT row_id, category FROM n WHERE k % 4 = 1 + CASE WHEN c > 1 THEN floor(2 * (k // 4) / (c - 1)) ELSE 0 END""")
def _(spark, d):
    copies = sampling.replicate(questions(spark, d).select("row_id", "category"), 4)
    return sampling.pick_replicates(copies, 1, 4, ["category"]).select("row_id", "category")


@query("g16_unpivot", "SELECT o_orderkey AS row_id, 'status' AS variable, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.unpivot("row_id", ["status", "priority"], "variable", "value")


@query("g17_pivot", RESPONSES + "SELECT row_id, max(pred) FILTER (model_id = 'm0') AS m0, max(pred) FILTER (model_id = 'm1') AS m1 FROM responses GROUP BY row_id")
def _(spark, d):
    return responses(spark, d).groupBy("row_id").pivot("model_id", ["m0", "m1"]).agg(F.max("pred"))


@query("g22_grains", RESPONSES + """SELECT category, model_id, CAST(grouping(category) * 2 + grouping(model_id) AS BIGINT) AS grain, """ + RATES.format(s=100) + " FROM responses GROUP BY GROUPING SETS ((category), (model_id), ())")
def _(spark, d):
    out = scoring.score_grains(responses(spark, d), [["category"], ["model_id"], []]).withColumn("grain", F.col("grain").cast("long"))
    return rounded(out.select("category", "model_id", "grain", "accuracy", "bad_format", "n"), "accuracy", "bad_format")


@query("h2_clean_key", "SELECT s_suppkey AS row_id, trim(replace('  ' || s_name || ' and B ', ' and', ',')) AS answer FROM supplier")
def _(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), R.clean_key(F.concat(F.lit("  "), "s_name", F.lit(" and B "))).alias("answer"))


@query("h3_question_text", "SELECT p_partkey AS row_id, p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || CAST(p_size AS VARCHAR) AS prompt FROM part")
def _(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("row_id"), R.question_text(F.col("p_name"), [F.col("p_type"), F.lit(None).cast("string"), F.col("p_size").cast("string")]).alias("prompt"))


@query("h5_prompts", "SELECT p_partkey AS row_id, md5('Answer the following question using the answer format specified below: ' || chr(10) || p_name || chr(10) || 'A. ' || p_type || chr(10) || chr(10) || 'Only provide the letter for your answer.' || chr(10) || chr(10) || 'Stop exactly after the letter.') AS prompt_md5 FROM part")
def _(spark, d):
    text = R.prompt_without_examples(R.question_text(F.col("p_name"), [F.col("p_type")]))
    return read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.md5(text.cast("binary")).alias("prompt_md5"))


@query("h7_temperature", "SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 7 < 5 THEN 1 ELSE 0 END AS temperature FROM supplier")
def _(spark, d):
    kinds = F.array(*[F.lit(x) for x in (*R.WARM_PREFIXES, "go1-", "o1")])
    model = F.concat(F.get(kinds, (F.col("s_suppkey") % 7).cast("int")), F.col("s_name"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), R.temperature(model).alias("temperature"))


@query("h10_typos", "SELECT p_partkey AS row_id, replace(replace(p_type, 'PROMO', 'Promo'), 'ECO', 'Eco') AS category FROM part")
def _(spark, d):
    return questions(spark, d).select("row_id", clean.replace_literals(F.col("category"), [("PROMO", "Promo"), ("ECO", "Eco")]).alias("category"))


@query("h11_seq_replace", "SELECT p_partkey AS row_id, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'Z' WHEN p_type = 'SMALL' THEN 'S' ELSE p_type END AS category FROM part")
def _(spark, d):
    pairs = [("PROMO", "ECONOMY"), ("ECONOMY", "Z"), ("SMALL", "S")]
    return questions(spark, d).select("row_id", clean.replace_in_turn(F.col("category"), pairs).alias("category"))


@query("h15_exam_code", "SELECT s_suppkey AS row_id, replace(s_name, '-', '_') || '_' || s_nationkey AS exam FROM supplier")
def _(spark, d):
    code = F.concat(F.lit(" "), "s_name", F.lit("-"), F.col("s_nationkey").cast("string"), F.lit(" (x-"), "s_name", F.lit(")"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), clean.exam_code(code).alias("exam"))


@query("h16_split_pair", """SELECT c_custkey AS row_id, split_part(v, ',', 1) AS processed, CASE WHEN len(string_split(v, ',')) = 2 THEN split_part(v, ',', 2) END AS score
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'a,' || c_custkey ELSE 'a,b,c' END AS v FROM customer)""")
def _(spark, d):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, "a").when(k % 3 == 1, F.concat(F.lit("a,"), k.cast("string"))).otherwise("a,b,c")
    return read(spark, d, "customer").select(k.alias("row_id"), clean.first_part(v).alias("processed"), clean.second_of_two(v).alias("score"))


@query("h17_decimal_comma", "SELECT c_custkey AS row_id, try_cast(replace(CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_custkey || ',5' END, ',', '.') AS DOUBLE) AS score FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("row_id"), clean.decimal_comma(F.when(k % 5 == 0, "x").otherwise(F.concat(k.cast("string"), F.lit(",5")))).alias("score"))


@query("h19_levels", """SELECT p_partkey AS row_id, coalesce((a LIKE '%Primary%' AND a NOT LIKE '%Pre-Primary%') OR a = 'All', false) AS is_primary, coalesce(a LIKE '%Secondary%' OR a = 'All', false) AS is_secondary
 FROM (SELECT p_partkey, (['Pre-Primary, Primary', 'Primary', 'Secondary', 'All', NULL])[p_size % 5 + 1] AS a FROM part)""")
def _(spark, d):
    ages = F.array(*[F.lit(x).cast("string") for x in ("Pre-Primary, Primary", "Primary", "Secondary", "All", None)])
    q = questions(spark, d).withColumn("age", F.get(ages, (F.col("p_size") % 5).cast("int")))
    return q.select("row_id", clean.is_primary(F.col("age")).alias("is_primary"), clean.is_secondary(F.col("age")).alias("is_secondary"))


@query("h21_cost", "SELECT s_suppkey AS row_id, round(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 0.8 * s_acctbal + 0.2 * s_nationkey END, 4) AS cost FROM supplier")
def _(spark, d):
    out = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("double"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.round(clean.cost(F.col("s_acctbal").cast("double"), out, combined=True), 4).alias("cost"))


@query("h31_question_number", "SELECT c_custkey AS row_id, try_cast(nullif(regexp_extract('Q ' || c_custkey || '. text 7.', '([0-9]+)\\.', 1), '') AS INTEGER) AS number FROM customer")
def _(spark, d):
    text = F.concat(F.lit("Q "), F.col("c_custkey").cast("string"), F.lit(". text 7."))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), clean.question_number(text).alias("number"))


def question_pages(spark: SparkSession, d: str, number: Column) -> DataFrame:
    """row_id, text: five parts to a page, a question each; number: of a question, from its part's key and its place on the page."""
    w = Window.partitionBy(F.floor(F.col("p_partkey") / 5)).orderBy("p_partkey")
    part = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 5).alias("row_id"), "p_partkey", "p_name", "p_type", "p_brand", F.row_number().over(w).alias("place"))
    line = F.concat(number.cast("string"), F.lit(". "), "p_name", F.lit("\nA "), "p_type", F.lit("\nD "), "p_brand")
    pages = part.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("t")))).alias("ts"))  # five rows a page
    return pages.select("row_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("text"))


PAGES = """WITH p AS (SELECT p_partkey // 5 AS row_id, row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey) AS place, p_partkey, '. ' || p_name || chr(10) || 'A ' || p_type || chr(10) || 'D ' || p_brand AS t FROM part)
"""


@query("i1_segment", PAGES + "SELECT row_id, place - 1 AS place, p_partkey || t AS paragraph FROM p")
def _(spark, d):
    pages = question_pages(spark, d, F.col("p_partkey"))
    out = pages.select("row_id", F.posexplode(clean.paragraphs(F.col("text"))).alias("place", "paragraph"))
    return out.withColumn("place", F.col("place").cast("long"))


@query("c7_null_neq", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def _(spark, d):
    marked = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return marked.where(clean.differs(F.col("quality"), 1)).select("doc_id")


@query("c9_pattern_filter", "SELECT p_partkey AS row_id FROM part WHERE NOT regexp_matches(p_type, 'RO|AL')")
def _(spark, d):
    return questions(spark, d).where(~clean.contains_pattern(F.col("category"), "RO|AL")).select("row_id")


@query("c12_bool_int", "SELECT event_type, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.count_if((F.col("value") > 50).cast("int") == 1), F.lit(0)).alias("n"))


@query("c17_value_mapping", "SELECT p_partkey AS row_id, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Creative arts' ELSE p_type END AS category FROM part")
def _(spark, d):
    c = F.col("category")
    return questions(spark, d).select("row_id", F.when(c.isin("PROMO", "SMALL"), "Creative arts").otherwise(c).alias("category"))


@query("c20_range_check", "SELECT l_orderkey AS row_id, count(*) AS n FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 3 GROUP BY l_orderkey")
def _(spark, d):
    return read(spark, d, "lineitem").where(~F.col("l_linenumber").between(1, 3)).groupBy(F.col("l_orderkey").alias("row_id")).agg(F.count("*").alias("n"))


@query("d17_subsets", """SELECT p_partkey AS row_id, file FROM part JOIN (SELECT 'PROMO' AS p_type, 'f1' AS file UNION ALL SELECT 'PROMO', 'f2' UNION ALL SELECT 'ECONOMY', 'f1') USING (p_type)""")
def _(spark, d):
    rows = [("PROMO", [("f1", "College"), ("f2", "College"), ("f3", "Other")]), ("ECONOMY", [("f1", "College")])]
    mapping = spark.createDataFrame(rows, "category string, subsets array<struct<file: string, level: string>>")
    return lookups.subsets_of_categories(questions(spark, d), mapping, "College").select("row_id", "file")


@query("g23_provider_documents", "SELECT CAST(s_nationkey AS VARCHAR) AS provider, count(*) AS n_models FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("provider"), F.col("s_suppkey").alias("model_id"), F.col("s_acctbal").alias("size"), (F.col("s_suppkey") % 2 == 0).alias("open"))
    return leaderboard.by_provider(s).select("provider", F.get_json_object("document", "$.n_models").cast("long").alias("n_models"))


@query("k_rank_in_category", RESPONSES + """, s AS (SELECT category, model_id, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM responses GROUP BY ALL)
SELECT category, model_id, CAST(rank() OVER (PARTITION BY category ORDER BY accuracy DESC) AS BIGINT) AS place FROM s""")
def _(spark, d):
    s = rounded(scoring.score(responses(spark, d), ["category", "model_id"]), "accuracy")
    return s.select("category", "model_id", F.rank().over(Window.partitionBy("category").orderBy(F.desc("accuracy"))).cast("long").alias("place"))


def keyed(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))
    return c, F.col("row_id").cast("string")


@query("h12_exam_name", "SELECT c_custkey AS row_id, 'maths ' || c_custkey AS exam FROM customer")
def _(spark, d):
    c, k = keyed(spark, d)
    return c.select("row_id", clean.exam_name(F.concat(F.lit("a/EN_maths_"), k, F.lit("_x21.xlsx"))).alias("exam"))


@query("h14_exam_key", "SELECT c_custkey AS row_id, 'MATHS_BASIC_' AS name, '20' || substring(CAST(c_custkey % 90 + 10 AS VARCHAR), 1, 2) AS year FROM customer")
def _(spark, d):
    c, _ = keyed(spark, d)
    key = clean.exam_key(F.concat(F.lit("Maths Basic 0"), (F.col("row_id") % 90 + 10).cast("string"), F.lit(".XLSX")))
    return c.select("row_id", key["name"].alias("name"), key["year"].alias("year"))


@query("h25_slug", "SELECT p_partkey AS row_id, lower(replace(replace(p_name || ' PCK', ' PCK', ''), ' ', '_')) AS slug FROM part")
def _(spark, d):
    return questions(spark, d).select("row_id", clean.slug(F.concat("question", F.lit(" PCK"))).alias("slug"))


@query("h27_choices", "SELECT c_custkey AS row_id, c_name || c_custkey || '.' AS choice, c_name || ' ' || c_mktsegment AS question, c_custkey % 2 = 0 AS complete FROM customer")
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    other = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    choice, question = F.concat("c_name", k, F.lit("..")), F.concat("c_name", F.lit("\n"), "c_mktsegment")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), clean.without_final_stop(choice).alias("choice"), clean.one_line(question).alias("question"), clean.complete_choices(k, other).alias("complete"))


@query("h30_leading_number", "SELECT c_custkey AS row_id, CAST(c_custkey AS INTEGER) AS number, substring('. ' || c_name, CAST(length(CAST(c_custkey AS VARCHAR)) AS BIGINT)) AS rest FROM customer")
def _(spark, d):
    found = clean.leading_number(F.concat(F.col("c_custkey").cast("string"), F.lit(". "), "c_name"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), found["number"].alias("number"), found["rest"].alias("rest"))


@query("h32_page_text", "SELECT c_custkey AS row_id, CAST(c_custkey AS INTEGER) AS page, c_name || chr(10) || c_mktsegment AS text FROM customer")
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat_ws("\n", "c_name", "c_mktsegment", k)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), clean.page_number(F.concat(F.lit("Page "), k)).alias("page"), clean.without_last_line(text).alias("text"))


@query("i2_segment_page", PAGES + "SELECT row_id, CAST(place - 1 AS INTEGER) AS place, place || t AS paragraph FROM p")
def _(spark, d):
    from gradewell.functions.pages import SegmentPage

    pages = question_pages(spark, d, F.col("place"))
    return pages.lateralJoin(SegmentPage(F.col("text").outer())).select("row_id", "place", "paragraph")


@query("c14_pick_rows", "SELECT o_orderkey AS row_id, o_totalprice FROM orders JOIN (SELECT unnest([1, 3, 3, 7]) AS k) ON o_orderkey = k")
def _(spark, d):
    places = spark.createDataFrame([(0, 1), (1, 3), (2, 3), (3, 7)], "pos int, row_id long")
    return lookups.pick_rows(read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice"), places).select("row_id", "o_totalprice")


@query("e21_list_lengths", "SELECT CAST(sum(n) AS BIGINT) AS total, count(DISTINCT k) AS keys FROM (SELECT len(l) AS n, unnest(l) AS k, row_number() OVER () AS r FROM (SELECT [c_custkey] AS l FROM customer))")
def _(spark, d):
    lists = read(spark, d, "customer").select(F.array("c_custkey").alias("l"))
    sizes = lists.agg(F.sum(F.size("l")).alias("total"))
    return sizes.crossJoin(lists.select(F.explode("l").alias("k")).agg(F.count_distinct("k").alias("keys")))  # one row each


@query("e8_teacher_scores", """SELECT y AS year, 'A-' || p || ' (x)' AS exam_code, count(DISTINCT o_custkey) AS n_teachers, round(avg(v), 4) AS score_mean, 'A_' || p AS exam FROM (
 SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2017' ELSE '2020' END AS y, o_custkey % 5 AS p, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 + 0.5 ELSE o_orderkey % 10 END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0) GROUP BY ALL""")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        F.when(k % 2 == 0, "2017").otherwise("2020").alias("year"), F.concat(F.lit("A-"), (F.col("o_custkey") % 5).cast("string"), F.lit(" (x)")).alias("CAT_PRUEBA"), F.col("o_custkey").alias("MRUN"),
        F.concat((k % 100).cast("string"), F.lit(",5")).alias("PROM_DOM_DOCENTE"), F.when(k % 3 == 0, "low").otherwise(F.concat(F.lit("x,"), (k % 10).cast("string"))).alias("PTJE_FINAL"),
    )
    return leaderboard.teacher_scores(rows).select("year", F.col("CAT_PRUEBA").alias("exam_code"), "n_teachers", F.round("score_mean", 4).alias("score_mean"), "exam")


@query("k_window_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    from gradewell.streaming.responses import tumbling_counts

    out = tumbling_counts(read(spark, d, "events").select("ts", "event_type"), "ts", "1 hour", ["event_type"])
    return out.select("event_type", F.col("window.start").alias("start"), "n")


# further queries register themselves here
from gradewell.plans import calls, columns, events, files, fuzzy, runs  # noqa: E402, F401
