"""Secrets in texts, by a ledger of what has been scanned.

A version of a file is a path and a text; its blob is the SHA-256 of the text's UTF-8 bytes. The ledger is a Parquet table, a row for each
blob and scan, of the rules (kind and version) applied and the spans found. An update addresses all versions in one pass, takes the blobs
whose ledger rows lack some current rule, scans each once for the rules that it lacks, appends what was found, and joins the findings of the
current rules to every path. Texts that no missing rule can match (a pattern that all its matches contain, tested by the JVM in the same pass)
are entered as scanned without leaving the JVM, so only the texts with a candidate are moved. Copies of a text meet in partial aggregates.

Edge cases: a null text is the empty blob; null and repeated paths keep their rows; rows that repeat a path and its text are one blob; an empty table
gives no rows and leaves the ledger as it is. Offsets count code points, the end is exclusive. All path columns of any names ride along
as one struct. A match that fails its rule's length is dropped, and the search goes on behind it. An update that fails before its commit leaves the
ledger as it was; one that is repeated finds nothing to scan; rows that two updates wrote at once for one blob count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._store import _on, fresh_path, store, table


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern, each behind the last, of which group has `least` characters or more. needs: found in every text that has one."""

    kind: str
    version: int
    pattern: str
    needs: str
    least: int = 0
    group: int = 0

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds of the contract, in their order.
BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
)
#: Further public token formats.
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", r"-----BEGIN "),
    Rule("github", 1, r"gh[opsru]_[A-Za-z0-9]{36,}", r"gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
)
RULES = BASE + MORE
SPANS = "array<struct<rule:string,start:bigint,end:bigint>>"
LEDGER = f"blob_id binary, rules array<string>, spans {SPANS}"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans_of(text: str, rules) -> list[dict]:
    return [
        {"rule": r.tag, "start": m.start(), "end": m.end()} for r, p in rules for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least
    ]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tag = {r.tag: (r, re.compile(r.pattern)) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            # of a list of rules many texts share, and of large texts, one at a time becomes a Python string
            found = [spans_of(t.as_py(), [by_tag[x] for x in missing.as_py()]) for t, missing in zip(b.column("text"), b.column("missing"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("blob_id"), pa.array(found, kind)], names=["blob_id", "spans"])

    return run


class Ledger:
    """What has been scanned, in a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, tuple(rules)
        if len({r.tag for r in self.rules}) < len(self.rules):
            raise ValueError("two rules of one kind and version")

    def rows(self) -> DataFrame:
        """The ledger: blob_id, rules and spans of every scan so far."""
        files, where = _on(self.spark, self.path)
        if not files.exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """Scan what the ledger lacks, append it, and give every row of versions, text left out, with spans: (start, end, kind, by) of the current rules.

        spans are in order of start, then of the rule's place in the list.
        """
        path = [F.col(f"`{c}`") for c in versions.columns if c != text]
        body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        maybe = F.lit(False)
        for r in self.rules:
            maybe = maybe | body.rlike(r.needs)
        addressed = store(versions.select(F.struct(*path).alias("path"), blob(body).alias("blob_id"), F.when(maybe, body).alias("text")), "addressed")
        todo = store(self._missing(addressed.select("blob_id").distinct()), "todo")
        if not todo.isEmpty():
            self._append(todo, addressed)
        return self._joined(addressed)

    def _missing(self, blobs: DataFrame) -> DataFrame:
        """blob_id and missing: the current rules that no scan of the blob has applied."""
        current = F.array(*[F.lit(r.tag) for r in self.rules])
        known = self.rows().groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
        missing = F.array_except(current, F.coalesce("known", F.array().cast("array<string>")))
        return blobs.join(known, "blob_id", "left").select("blob_id", missing.alias("missing")).where(F.size("missing") > 0)

    def _append(self, todo: DataFrame, addressed: DataFrame) -> None:
        """Scan each blob of todo that has a candidate once; all of todo is entered."""
        texts = addressed.where(F.col("text").isNotNull()).select("blob_id", "text").dropDuplicates(["blob_id"])
        found = texts.join(todo, "blob_id").mapInArrow(_scan(self.rules), f"blob_id binary, spans {SPANS}").where(F.size("spans") > 0)
        found = store(found, "found")
        none = F.array().cast(SPANS)
        scanned = todo.join(found, "blob_id", "left").select("blob_id", F.col("missing").alias("rules"), F.coalesce("spans", none).alias("spans"))
        scanned.write.mode("append").option("compression", "zstd").parquet(self.path)

    def _joined(self, addressed: DataFrame) -> DataFrame:
        tags = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.tag, i)])
        kinds = F.array(*[F.lit(r.kind) for r in self.rules])
        current = F.filter("spans", lambda s: s["rule"].isin([r.tag for r in self.rules]))
        found = self.rows().select("blob_id", current.alias("spans")).where(F.size("spans") > 0)
        # of a blob the ledger has a row for each of its scans, so few rows meet here
        ordered = F.transform(
            F.array_distinct(F.flatten(F.collect_list("spans"))), lambda s: F.struct(s["start"].alias("start"), F.element_at(tags, s["rule"]).alias("by"), s["end"].alias("end"))
        )
        found = found.groupBy("blob_id").agg(F.sort_array(ordered).alias("spans"))
        named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["by"]).alias("kind"), s["by"].alias("by")))
        out = addressed.select("path", "blob_id").join(found, "blob_id", "left").select("path", F.coalesce(named, F.array().cast("array<struct<start:bigint,end:bigint,kind:string,by:int>>")).alias("spans"))
        return out.select("path.*", "spans")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = Ledger(spark, fresh_path(spark, "ledger")).update(docs)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["by"] < len(BASE))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
