"""Queries of columns, rows and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.functions import cleaning as clean
from gradewell.functions import responses as R
from gradewell.operators import columns as C
from gradewell.operators import dedupe, leaderboard, lookups, sampling, scoring
from gradewell.plans.catalog import RESPONSES, query, questions, read, responses, rounded


@query("c1_column_at", "SELECT p_partkey AS row_id, p_type AS second, CAST(p_size AS BIGINT) AS last FROM part")
def _(spark, d):
    q = questions(spark, d)
    return q.select("row_id", C.column_at(q, 1).alias("second"), C.column_at(q, -1).cast("long").alias("last"))


@query("c2_insert_columns", "SELECT p_partkey AS row_id, 'exam' AS source, CAST(NULL AS VARCHAR) AS note, p_name AS question FROM part")
def _(spark, d):
    q = questions(spark, d).select("row_id", "question")
    return C.insert_columns(q, 1, {"source": F.lit("exam"), "note": F.lit(None).cast("string")})


@query("c3_drop_columns", "SELECT p_partkey AS row_id, p_name AS question FROM part")
def _(spark, d):
    q = questions(spark, d).withColumn("pred_m1", F.lit("A")).withColumn("pred_m2", F.lit("B"))
    return C.drop_columns(q, ["category", "answer", "p_size", "not there"], ["pred_"])


@query("c4_keep_columns", "SELECT p_type AS category, p_partkey AS row_id FROM part")
def _(spark, d):
    return C.keep_columns(questions(spark, d), ["category", "row_id"])


@query("c5_rename_columns", "SELECT s_suppkey AS model_id, s_name AS name, s_nationkey AS provider, s_acctbal FROM supplier")
def _(spark, d):
    return C.rename_at(read(spark, d, "supplier").withColumnRenamed("s_name", "name"), {0: "model_id", 2: "provider"})


@query("c6_constant_category", "SELECT p_partkey AS row_id, p_name AS question, 'SEND' AS category FROM part")
def _(spark, d):
    return questions(spark, d).withColumn("category", F.lit("SEND")).select("row_id", "question", "category")


@query("c8_membership", "SELECT p_partkey AS row_id, p_type AS category FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def _(spark, d):
    return questions(spark, d).where(F.col("category").isin("PROMO", "ECONOMY")).select("row_id", "category")


@query("c10_present", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def _(spark, d):
    marked = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    return C.present(marked, ["quality", "lang"]).select("doc_id", "quality")


@query("c11_flag_complement", "SELECT coalesce(toxic = 1, false) AS is_toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    marked = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left").withColumn("is_toxic", F.col("toxic") == 1)
    of = lambda complement: C.flagged(marked, "is_toxic", complement).agg(F.count("*").alias("n")).select(F.lit(not complement).alias("is_toxic"), "n").where("n > 0")
    return of(False).unionByName(of(True))


@query("c13_drop_rows", "SELECT p_partkey AS row_id FROM part WHERE p_partkey NOT IN (1, 5, 7)")
def _(spark, d):
    return C.without_rows(questions(spark, d), [1, 5, 7, 7]).select("row_id")


@query("c15_from_row", "SELECT p_partkey AS row_id, p_name AS question FROM part WHERE p_partkey >= 5")
def _(spark, d):
    return C.from_row(questions(spark, d), 5).select("row_id", "question")


@query("c16_ranges", """SELECT count(*) FILTER (l_discount > 0.07) AS above, count(*) FILTER (l_discount >= 0.02 AND l_discount < 0.05) AS half_open,
 count(*) FILTER (l_discount BETWEEN 0.02 AND 0.05) AS closed, count(*) FILTER (l_discount >= 0.07) AS from_on FROM lineitem""")
def _(spark, d):
    x = F.col("l_discount")
    return read(spark, d, "lineitem").agg(
        F.count_if(x > 0.07).alias("above"), F.count_if((x >= 0.02) & (x < 0.05)).alias("half_open"), F.count_if(x.between(0.02, 0.05)).alias("closed"), F.count_if(x >= 0.07).alias("from_on")
    )


@query("c18_value_map", "SELECT p_partkey AS row_id, CASE p_type WHEN 'PROMO' THEN 'Arts' WHEN 'SMALL' THEN 'Maths' END AS category FROM part")
def _(spark, d):
    return questions(spark, d).select("row_id", clean.lookup(F.col("category"), {"PROMO": "Arts", "SMALL": "Maths"}).alias("category"))


@query("c19_without_topic", "SELECT regexp_matches(p_name, 'small|cold') AS removed, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def _(spark, d):
    kept, removed = C.without_topic(questions(spark, d), "question", "small|cold")
    count = lambda df, gone: df.agg(F.count("*").alias("n"), F.min("row_id").alias("first")).select(F.lit(gone).alias("removed"), "n", "first").where("n > 0")
    return count(kept, False).unionByName(count(removed, True))


@query("c22_preview", "(SELECT 'head' AS part, p_partkey AS row_id FROM part ORDER BY p_partkey LIMIT 3) UNION ALL (SELECT 'tail', p_partkey FROM part ORDER BY p_partkey DESC LIMIT 2) UNION ALL SELECT 'rows', count(*) FROM part UNION ALL SELECT 'columns', 5")
def _(spark, d):
    q = questions(spark, d)
    size = C.shape(q)
    parts = [C.preview(q, 3).select(F.lit("head").alias("part"), "row_id"), C.preview(q, 2, last=True).select(F.lit("tail").alias("part"), "row_id")]
    parts += [size.select(F.lit("rows").alias("part"), F.col("n_rows").alias("row_id")), size.select(F.lit("columns").alias("part"), F.col("n_columns").cast("long").alias("row_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("c23_for_inference", """SELECT p_partkey AS row_id, p_name AS question, 'a' || p_size AS "Answer A", CAST(NULL AS VARCHAR) AS "Answer E", CAST(NULL AS VARCHAR) AS "Answer F", CAST(NULL AS VARCHAR) AS "Answer G",
 substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) AS answer FROM part""")
def _(spark, d):
    q = questions(spark, d).select("row_id", "question", F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("Answer A"), "answer", "category")
    return C.for_inference(q, 3, drop=["category"])


@query("d11_assign_by_row", "SELECT p_partkey AS row_id, p_name AS question, CASE WHEN p_size > 25 THEN p_brand END AS flag FROM part WHERE p_type <> 'PROMO'")
def _(spark, d):
    flags = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("flag"))
    kept = questions(spark, d).where("category != 'PROMO'").select("row_id", "question")
    return kept.join(flags, "row_id", "left")


@query("d13_column_concat", RESPONSES + """, p AS (SELECT row_id, max(pred) FILTER (model_id = 'm0') AS pred_m0, max(pred) FILTER (model_id = 'm1') AS pred_m1 FROM responses GROUP BY row_id)
SELECT p_partkey AS row_id, p_name AS question, pred_m0, pred_m1 FROM part LEFT JOIN p ON p_partkey = row_id""")
def _(spark, d):
    wide = responses(spark, d).groupBy("row_id").pivot("model_id", ["m0", "m1"]).agg(F.max("pred")).toDF("row_id", "pred_m0", "pred_m1")
    return questions(spark, d).select("row_id", "question").join(wide, "row_id", "left")


@query("d13_outer", RESPONSES + """, p AS (SELECT row_id, max(pred) FILTER (model_id = 'm0') AS pred_m0 FROM responses WHERE row_id % 3 <> 0 GROUP BY row_id), r AS (SELECT row_id + 5 AS row_id, max(pred) FILTER (model_id = 'm1') AS pred_m1, count(*) AS n FROM responses GROUP BY row_id)
SELECT coalesce(a.row_id, p.row_id, r.row_id) AS row_id, question, pred_m0, pred_m1, n FROM (SELECT p_partkey AS row_id, p_name AS question FROM part WHERE p_size > 10) a FULL JOIN p ON p.row_id = a.row_id FULL JOIN r ON r.row_id = coalesce(a.row_id, p.row_id)""")
def _(spark, d):
    # rows that only the questions, only the one or only the other prediction has
    said = responses(spark, d)
    of = lambda m, name: F.max(F.when(F.col("model_id") == m, F.col("pred"))).alias(name)
    first = said.where("row_id % 3 != 0").groupBy("row_id").agg(of("m0", "pred_m0"))
    second = said.groupBy((F.col("row_id") + 5).alias("row_id")).agg(of("m1", "pred_m1"), F.count("*").alias("n"))
    return C.beside([questions(spark, d).where("p_size > 10").select("row_id", "question"), first, second])


@query("d14_two_keys", RESPONSES + """, s AS (SELECT model_id, category, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM responses GROUP BY ALL)
SELECT w.model_id, w.category, accuracy FROM (SELECT 'm0' AS model_id, 'PROMO' AS category UNION ALL SELECT 'm3', 'SMALL' UNION ALL SELECT 'none', 'PROMO') w LEFT JOIN s USING (model_id, category)""")
def _(spark, d):
    wanted = spark.createDataFrame([("m0", "PROMO"), ("m3", "SMALL"), ("none", "PROMO")], "model_id string, category string")
    s = rounded(scoring.score(responses(spark, d), ["model_id", "category"]), "accuracy").select("model_id", "category", "accuracy")
    return wanted.join(s, ["model_id", "category"], "left")


@query("d16_dimensions", """SELECT m.model_id, n, n_name AS provider, s_suppkey % 2 = 0 AS open, s_acctbal AS size, round(0.8 * s_acctbal + 0.2 * s_nationkey, 4) AS cost FROM (SELECT l_suppkey % 40 AS model_id, count(*) AS n FROM lineitem GROUP BY 1) m
LEFT JOIN supplier ON s_suppkey = m.model_id AND s_suppkey % 3 <> 0 LEFT JOIN nation ON n_nationkey = s_nationkey""")
def _(spark, d):
    scores = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("model_id")).agg(F.count("*").alias("n"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("provider"))
    models = read(spark, d, "supplier").where("s_suppkey % 3 <> 0").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("model_id"), "provider", (F.col("s_suppkey") % 2 == 0).alias("open"), F.col("s_acctbal").alias("size"), F.col("s_acctbal").alias("input_cost"), F.col("s_nationkey").cast("double").alias("output_cost")
    )
    return leaderboard.with_registry(scores, models, combined=True).withColumn("cost", F.round("cost", 4))


@query("d18_same_keys", """SELECT NOT EXISTS (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem) AS all_used, NOT EXISTS (SELECT p_type FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 25) AND NOT EXISTS (SELECT p_type FROM part WHERE p_size > 25 EXCEPT SELECT p_type FROM part) AS same_types,
 NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS same_customers""")
def _(spark, d):
    used, known = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct(), read(spark, d, "supplier").select("s_suppkey")
    missing = known.subtract(used).agg((F.count("*") == 0).alias("all_used"))
    q = read(spark, d, "part")
    types = lookups.same_keys(q.select("p_type"), q.where("p_size > 25").select("p_type"))
    people = lookups.same_keys(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return missing.select("all_used", F.lit(types).alias("same_types"), F.lit(people).alias("same_customers"))


@query("d19_equal_columns", "SELECT bool_and(p_name = p_name) AS same, bool_and(p_size = p_partkey) AS other FROM part")
def _(spark, d):
    a = read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("x"), "p_size")
    b = read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("y"), F.col("p_partkey").alias("z"))
    both = a.join(b, "row_id")
    return both.agg(F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"), F.bool_and(F.coalesce(F.col("p_size") == F.col("z"), F.lit(False))).alias("other"))


@query("e11_one_category", "SELECT p_type AS category, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY p_type")
def _(spark, d):
    one = scoring.one_value(questions(spark, d).where("category = 'PROMO'"), "category")
    return one.groupBy("category").agg(F.count("*").alias("n"))


@query("e12_arrays_of_question", RESPONSES + """SELECT p_name AS question, CASE WHEN count(DISTINCT category) = 1 THEN min(category) ELSE 'Multiple' END AS category, count(*) AS copies,
 string_agg(r.answer, '' ORDER BY r.row_id, model_id, coalesce(pred, '')) AS answers, string_agg(coalesce(pred, '-'), '' ORDER BY r.row_id, model_id, coalesce(pred, '')) AS preds FROM responses r JOIN part ON p_partkey = row_id GROUP BY p_name""")
def _(spark, d):
    r = responses(spark, d).join(questions(spark, d).select("row_id", "question"), "row_id")
    out = scoring.arrays_of_question(r, "question", ["row_id", "model_id"])
    dash = F.transform("preds", lambda p: F.coalesce(p, F.lit("-")))
    return out.select("question", "category", "copies", F.array_join("answers", "").alias("answers"), F.array_join(dash, "").alias("preds"))


@query("e14_mean_of_positions", RESPONSES + """, a AS (SELECT category, model_id, answer, avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END) AS v FROM responses GROUP BY ALL)
SELECT category, model_id, round(avg(v), 6) AS accuracy FROM a GROUP BY ALL""")
def _(spark, d):
    return rounded(scoring.mean_of_positions(responses(spark, d), ["category", "model_id"]), "accuracy")


@query("e16_counts_by_hue", "SELECT category, hue, n, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS of_category FROM (SELECT p_type AS category, p_size % 3 AS hue, count(*) AS n FROM part GROUP BY ALL)")
def _(spark, d):
    return scoring.counts_by_hue(read(spark, d, "part").select(F.col("p_type").alias("category"), (F.col("p_size") % 3).alias("hue")), "category", "hue")


@query("e18_one_letter", RESPONSES + """, s AS (SELECT category, pred, answer FROM responses WHERE answer = 'B')
SELECT category, round(avg(CASE WHEN pred = answer THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy, count(*) AS n, count(pred) AS n_read, count(*) FILTER (pred = 'A') AS said_a FROM s GROUP BY category""")
def _(spark, d):
    return rounded(scoring.one_letter(responses(spark, d), "B", ["category"], ["A"]), "accuracy").withColumnRenamed("said_A", "said_a")


@query("e23_series_size", RESPONSES + "SELECT model_id, count(*) AS n, (SELECT count(*) FROM responses) AS n_all FROM responses GROUP BY model_id")
def _(spark, d):
    r = responses(spark, d)
    # one row
    return r.groupBy("model_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(r.agg(F.count("*").alias("n_all"))))


@query("f14_repeated_ids", "SELECT l_partkey AS row_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey HAVING count(*) > 1")
def _(spark, d):
    ids = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("row_id"))
    return dedupe.repeated(ids, "row_id")


@query("g2_sorted_distinct", "SELECT string_agg(p_type, ',' ORDER BY p_type) AS categories FROM (SELECT DISTINCT p_type FROM part)")
def _(spark, d):
    found = questions(spark, d).select("category").distinct()
    return found.agg(F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories"))


@query("g3_first_and_last", "SELECT (SELECT arg_min(p_name, p_partkey) FROM part) AS first, (SELECT arg_max(p_name, p_partkey) FROM part) AS last")
def _(spark, d):
    return questions(spark, d).agg(F.min_by("question", "row_id").alias("first"), F.max_by("question", "row_id").alias("last"))


@query("g7_missing_keys", "SELECT c_custkey AS row_id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id")).subtract(read(spark, d, "orders").select(F.col("o_custkey").alias("row_id")))


@query("g11_split", """SELECT p_partkey AS row_id, p_partkey IN (SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey) <= 2) AS is_example FROM part""")
def _(spark, d):
    q = questions(spark, d).select("row_id", "category")
    return sampling.split(q, sampling.stratified(q, "category", 2)).select("row_id", "is_example")


@query("g18_explode", "SELECT o_custkey AS row_id, unnest(ids) AS o_orderkey FROM (SELECT o_custkey, list(o_orderkey) AS ids FROM orders GROUP BY o_custkey)")
def _(spark, d):
    lists = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.collect_list("o_orderkey").alias("ids"))
    return lists.select("row_id", F.explode("ids").alias("o_orderkey"))


@query("g19_zip_lists", """SELECT o_custkey AS row_id, to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS orders FROM orders GROUP BY o_custkey""")
def _(spark, d):
    listed = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    lists = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(listed.alias("l"))
    lists = lists.select("row_id", F.col("l.o_orderkey").alias("ids"), F.col("l.o_orderstatus").alias("statuses"))
    return lists.select("row_id", F.to_json(C.zipped({"id": "ids", "status": "statuses"})).alias("orders"))


@query("g20_row_numbers", "SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 + 920 AS question_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place FROM orders")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", F.struct("o_totalprice", "o_orderkey").alias("at"))
    out = C.numbered(C.numbered(o, "at", "question_id", start=920), "row_id", "place", ["o_orderstatus"])
    return out.select("row_id", F.col("question_id").cast("long").alias("question_id"), F.col("place").cast("long").alias("place"))


@query("g21_index", "SELECT s_name AS model, s_acctbal AS score FROM supplier")
def _(spark, d):
    return C.rename_at(C.keep_columns(read(spark, d, "supplier"), ["s_name", "s_acctbal"]), {0: "model", 1: "score"})


@query("h4_examples", "SELECT p_partkey AS row_id, md5(p_name || chr(10) || 'A. ' || p_type || chr(10) || substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) || chr(10) || chr(10)) AS example_md5 FROM part")
def _(spark, d):
    text = R.example_text(F.col("question"), [F.col("category")], F.col("answer"))
    return questions(spark, d).select("row_id", F.md5(text.cast("binary")).alias("example_md5"))


@query("h5_few_shot_prompts", """WITH q AS (SELECT p_partkey AS row_id, p_type AS s, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_size AS t, substring('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1) AS a, p_partkey % 50 = 1 AS e FROM part),
x AS (SELECT s, string_agg(t || chr(10) || a || chr(10) || chr(10), '' ORDER BY row_id) AS shown FROM q WHERE e GROUP BY s)
SELECT row_id, md5('The following are example multiple choice questions (with answers).' || chr(10) || chr(10) || coalesce(shown, '') || 'Answer the following real question using same answer format: ' || chr(10) || t
 || chr(10) || chr(10) || 'Only answer the real question.' || chr(10) || chr(10) || 'Only provide the letter for your answer.' || chr(10) || chr(10) || 'Stop exactly after the letter.') AS prompt_md5 FROM q LEFT JOIN x USING (s) WHERE NOT e""")
def _(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("question_set"), F.col("p_name").alias("question"), F.col("p_brand").alias("c1"), F.col("p_size").cast("string").alias("c2"),
                                      F.substring(F.lit("ABCD"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("answer"), (F.col("p_partkey") % 50 == 1).alias("is_example"))
    return R.with_prompt_md5(p, "question", ["c1", "c2"], "answer", "question_set").select("row_id", "prompt_md5")


@query("h1_all_patterns", r"""WITH t AS (SELECT c_custkey, substring('ABCDEFG', CAST(c_custkey % 7 + 1 AS INTEGER), 1) AS l FROM customer)
SELECT c_custkey AS row_id, CASE c_custkey % 9 WHEN 0 THEN l WHEN 1 THEN l WHEN 2 THEN l WHEN 3 THEN l WHEN 4 THEN l WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN l ELSE NULL END AS pred FROM t""")
def _(spark, d):
    # all four forms, and three that are none of them
    forms = ["{} (sure)", "<think>A or B?\nno</think> it is {}", "## Step 1: read\nthe answer is {}. ", "so\nthus\n{}\"", "  {}.\nbecause", "the answer is {}, I think", "{}ab", "\n{}", "<think>x</think> {}."]
    k = F.col("c_custkey")
    letter = F.substring(F.lit("ABCDEFG"), (k % 7 + 1).cast("int"), F.lit(1))
    said = F.get(F.array(*[F.replace(F.lit(f), F.lit("{}"), letter) for f in forms]), (k % 9).cast("int"))
    return read(spark, d, "customer").select(k.alias("row_id"), R.parse_choice(said).alias("pred"))


@query("h8_delays", "SELECT s_suppkey AS row_id, CASE s_suppkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 5 ELSE 0 END AS seconds FROM supplier")
def _(spark, d):
    s = F.col("s_suppkey") % 3
    model = F.when(s == 0, "slow-1").when(s == 1, "middle-2").otherwise("other")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), R.delay(model, {"slow-1": 15, "middle-2": 5}).alias("seconds"))


@query("h18_domain", "SELECT o_orderkey AS row_id FROM orders WHERE o_orderpriority LIKE '%-H%'")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.replace("o_orderpriority", F.lit("-H"), F.lit(" ENSEÑANZA ")).alias("GLOSA_DOMINIO"))
    return leaderboard.domain_scores(o).select("row_id")


@query("h20_suffix", "SELECT p_partkey AS row_id, p_type || ' PCK x' AS kept, p_type AS stripped FROM part")
def _(spark, d):
    q, c = questions(spark, d), F.col("category")
    return q.select("row_id", clean.without_suffix(F.concat(c, F.lit(" PCK x"))).alias("kept"), clean.without_suffix(F.concat(c, F.lit(" PCK"))).alias("stripped"))


@query("h22_records", """SELECT s_suppkey AS row_id, to_json({'id': s_name, 'provider': CAST(s_nationkey AS VARCHAR), 'open': s_suppkey % 2 = 0}) AS model, to_json({'n': CAST(s_nationkey AS BIGINT), 'accuracy': 0.5, 'bad_format': NULL::DOUBLE}) AS result FROM supplier""")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("id"), F.col("s_nationkey").cast("string").alias("provider"), (F.col("s_suppkey") % 2 == 0).alias("open"),
                                          F.col("s_nationkey").cast("long").alias("n"), F.lit(0.5).alias("accuracy"), F.lit(None).cast("double").alias("bad_format"))
    return s.select("row_id", leaderboard.record("id", "provider", "open").alias("model"), leaderboard.record("n", "accuracy", "bad_format").alias("result"))


@query("h23_nan_to_null", "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS score FROM customer")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("score"))
    return C.without_nan(c)


@query("h24_percent", "SELECT c_custkey AS row_id, round(c_acctbal / 100, 2) AS share, round(c_acctbal * 100, 0) AS percent FROM customer")
def _(spark, d):
    x = F.col("c_acctbal")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.round(x / 100, 2).alias("share"), F.round(x * 100, 0).alias("percent"))


@query("h26_date_stamp", "SELECT o_orderkey AS row_id, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), C.date_stamp(F.col("o_orderdate")).alias("stamp"))


@query("h33_colours", "SELECT s_suppkey AS row_id, CASE s_suppkey % 3 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#0000ff' END AS colour FROM supplier")
def _(spark, d):
    name = F.when(F.col("s_suppkey") % 3 == 0, "red").when(F.col("s_suppkey") % 3 == 1, "blue").otherwise("unknown")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), clean.lookup(name, {"red": "#ff0000", "blue": "#0000ff"}).alias("colour"))


@query("g23_documents", """SELECT CAST(s_nationkey AS VARCHAR) AS provider, to_json({'n_models': count(*), 'models': list({'model_id': s_suppkey, 'size': s_acctbal, 'open': s_suppkey % 2 = 0} ORDER BY s_suppkey)}) AS document FROM supplier GROUP BY s_nationkey""")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("provider"), F.col("s_suppkey").alias("model_id"), F.col("s_acctbal").alias("size"), (F.col("s_suppkey") % 2 == 0).alias("open"))
    return leaderboard.by_provider(s)


@query("c14_pick_in_order", "SELECT c_custkey AS place, o_orderkey AS row_id, o_totalprice FROM customer JOIN orders ON o_orderkey = c_custkey * 7 % 1000")
def _(spark, d):
    places = read(spark, d, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_custkey") * 7 % 1000).alias("row_id"))
    return lookups.pick_rows(read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice"), places, order="place")


@query("h14_odd_keys", """SELECT c_custkey AS row_id, CASE c_custkey % 3 WHEN 0 THEN 'A_B_' WHEN 1 THEN 'LENGUA_' ELSE 'X.XLS' END AS name, '20' || CASE c_custkey % 3 WHEN 0 THEN '19' WHEN 1 THEN '16' ELSE 'ls' END AS year,
 CASE c_custkey % 2 WHEN 0 THEN 'one' ELSE '' END AS exam, CASE c_custkey % 2 WHEN 0 THEN 'a b' ELSE 'a' END AS code FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    origin = F.when(k % 3 == 0, "a b 2019.xlsx").when(k % 3 == 1, "Lengua 16.XLSX").otherwise("x12.xls")
    path = F.when(k % 2 == 0, "x/EN_one").otherwise("no marker")
    key = clean.exam_key(origin)
    return read(spark, d, "customer").select(k.alias("row_id"), key["name"].alias("name"), key["year"].alias("year"), F.coalesce(clean.exam_name(path), F.lit("")).alias("exam"), clean.exam_code(F.when(k % 2 == 0, " a b ").otherwise("a(b(c")).alias("code"))
