"""Queries of readers and writers: a table goes to files in the shared folder, and what is read back has its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.plans.catalog import query, questions, read
from gradewell.sources import tables, workbooks
from gradewell.sources.shared import shared_path


@query("a2_csv", "SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'say \"' || p_name || '\",' || chr(10) || 'twice' AS question, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS source FROM part")
def _(spark, d):
    path = shared_path(spark, "csv")
    p = read(spark, d, "part")
    text = F.concat(F.lit('say "'), "p_name", F.lit('",\ntwice'))
    p.select(F.col("p_partkey").alias("row_id"), text.alias("question"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("None").alias("source")).write.options(header=True, escape='"').csv(path)
    return tables.read_csv(spark, path, ["row_id", "question", "source"])


@query("a3_csv_long_rows", "SELECT CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 3 <> 1 THEN p_name END AS b FROM part WHERE p_partkey % 3 <> 2")
def _(spark, d):
    path = shared_path(spark, "csv")
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat_ws(";", k, "p_name")).when(k % 3 == 1, k.cast("string")).otherwise(F.concat_ws(";", k, "p_name", F.lit("more")))
    read(spark, d, "part").select(line.alias("a;b")).write.options(header=True, quote="").csv(path)
    return tables.read_csv_without_long_rows(spark, path, ["a", "b"])


@query("a5_json", "SELECT s_suppkey AS model_id, s_name AS name, s_acctbal AS size FROM supplier")
def _(spark, d):
    path = shared_path(spark, "json")
    tables.write_json(read(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("size")), path)
    return spark.read.schema("model_id long, name string, size double").json(path)


@query("a8_files_with_origin", "SELECT p_brand AS origin, count(*) AS n FROM part GROUP BY p_brand")
def _(spark, d):
    path = shared_path(spark, "csv")
    questions_of = read(spark, d, "part").select(F.col("p_name").alias("question"), F.regexp_replace("p_brand", "#", "-").alias("brand"))
    questions_of.repartition("brand").write.partitionBy("brand").option("header", True).csv(path)
    found = tables.read_files_with_origin(spark, path, ["question"], "brand=")
    return found.groupBy(F.replace(F.substring_index("origin", "/", 1), F.lit("-"), F.lit("#")).alias("origin")).agg(F.count("*").alias("n"))


@query("a11_counted_files", "SELECT count(*) AS n_rows, count(DISTINCT p_type) AS n_folders FROM part")
def _(spark, d):
    path = shared_path(spark, "csv")
    # one file for each category
    questions(spark, d).select("question", "category").repartition("category").write.partitionBy("category").option("header", True).csv(path)
    return tables.count_rows_by_folder(spark, path, "category=", ["question"])


@query("b1_cache", "SELECT 'm' || (l_suppkey % 3) AS model_id, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def _(spark, d):
    path = shared_path(spark, "cache")
    line = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    said = line.select(F.lit("s").alias("question_set"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model_id"), F.col("l_partkey").alias("row_id"), F.lit("A").alias("resps"), F.lit(True).alias("success"))
    tables.write_cache(said, path)
    return spark.read.parquet(path).groupBy("model_id").agg(F.count("*").alias("n"))


@query("b6_splits", "SELECT split, slug, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'dev' ELSE 'test' END AS split, lower(p_type) AS slug FROM part) GROUP BY ALL")
def _(spark, d):
    path = shared_path(spark, "splits")
    tables.write_splits(questions(spark, d).select("row_id", "question", "category", (F.col("row_id") % 10 == 0).alias("is_example")), path)
    return spark.read.option("header", True).csv(path).groupBy("split", F.col("category_slug").alias("slug")).agg(F.count("*").alias("n"))


@query("a4_sheets", """SELECT CAST(p_partkey AS VARCHAR) AS number, p_name || chr(10) || ' "' || p_type || '" <&> _x0041_' || chr(13) AS question, CASE WHEN p_size % 5 <> 0 THEN p_brand WHEN p_size % 2 = 0 THEN '' END AS source FROM part""")
def _(spark, d):
    path = shared_path(spark, "sheets")
    p = read(spark, d, "part")
    text = F.concat("p_name", F.lit('\n "'), "p_type", F.lit('" <&> _x0041_\r'))
    source = F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).when(F.col("p_size") % 2 == 0, "")
    workbooks.write_sheets(p.select(F.col("p_partkey").alias("number"), text.alias("question"), source.alias("source")).repartition(3, "number"), path)
    return workbooks.read_sheets(spark, path, ["number", "question", "source"]).select("number", "question", "source")


def text_pages(content: bytes, page: int, last: int):
    """Pages of a text from one on; a page of digits alone is taken for one that cannot be read."""
    for text in workbooks.form_feeds(content)[page - 1 : last]:
        if text.isdigit():
            raise ValueError("no text")
        yield text.decode()


@query("a14_page_ranges", """WITH p AS (SELECT o_custkey % 20 AS book, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority || ' ' || o_orderkey END AS t FROM orders)
SELECT book, CAST(page AS INTEGER) AS page, CASE WHEN t NOT SIMILAR TO '[0-9]+' THEN t END AS text, CASE WHEN t SIMILAR TO '[0-9]+' THEN 'ValueError: no text' END AS error FROM p WHERE page BETWEEN 5 AND 60""")
def _(spark, d):
    # every book is one file, its pages between form feeds
    path = shared_path(spark, "books")
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, k.cast("string")).otherwise(F.concat_ws(" ", "o_orderpriority", k))
    pages = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("book"), k, text.alias("value"))
    pages.repartition("book").sortWithinPartitions("book", "o_orderkey").drop("o_orderkey").write.partitionBy("book").option("lineSep", "\f").text(path)
    found = workbooks.read_page_ranges(spark, path, text_pages, lambda content: len(workbooks.form_feeds(content)), first=5, last=60, suffix=".txt")
    return found.select(F.regexp_extract("path", "book=([0-9]+)", 1).cast("long").alias("book"), "page", "text", "error")


@query("a9_listed_files", "SELECT 'type=' || p_type AS folder, count(DISTINCT p_brand) AS n_files, true AS written FROM part GROUP BY p_type")
def _(spark, d):
    # a file for each type and brand, beside files of another kind
    path = shared_path(spark, "folders")
    p = read(spark, d, "part").select("p_name", "p_brand", F.col("p_type").alias("type"))
    p.repartition(7, "type", "p_brand").sortWithinPartitions("type", "p_brand").select("p_name", "type", F.col("p_brand").alias("brand")).write.partitionBy("type", "brand").csv(path)
    p.select("p_name", "type").write.mode("append").partitionBy("type").json(path)
    found = tables.list_files(spark, path, ".csv")
    by = F.regexp_extract("path", "(type=[^/]*)/", 1)
    return found.groupBy(by.alias("folder")).agg(F.count_distinct("folder").alias("n_files"), F.bool_and(F.col("bytes") > 0).alias("written"))
