"""Conversations with faults, repaired at the least cost so that the roles read (system?)(user assistant)+.

Copies of a row are counted before they are moved, rows are dealt by ranges of conversation and turn, and each partition cuts its conversations
into strings of at most 256 role/fault symbols. A Re-Pair grammar is counted over the distinct strings, a min-plus transfer matrix with the
audit as a rope is made for each rule, bottom-up, and every string's matrix is a product of those of its parsed symbols, shared by
all conversations that have it. A conversation of many strings takes their matrices in order; then every string is repaired by itself.

The audit and the hash of a conversation are one cell each, made by one pass over its rows in order: that pass streams, and holds no
more of a conversation than its audit. Everything else is independent of how long a conversation is.

Edge cases: a null role or text is one space, so a null text is blank and a null role is neither system, user nor assistant; null turns
come first; rows of one turn are ordered by role and text; null conversation ids are one conversation; a role's initial decides; a conversation
without rows (of those asked for) has zeros, an empty audit and the hash of the empty string; an empty table gives no rows; other columns are not
read, so any names may stand beside the four. Turns more than 2^63 apart wrap round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._grammar import INSERT, Grammar, Path, apart, edited, text_of
from gradewell.llm._store import store, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = 256  # rows of one string
BYTES = 4 << 20  # of text of one string, unless one row has more
#: The size of the grammar: what it leaves over costs another product, never another result.
ROUNDS, RULES = 12, 48

_COUNTED = "illegal long, first string, last string, first_turn long, last_turn long, turns long"
SEGMENT = f"conv_id {{id}}, part int, no long, symbols string, {_COUNTED}, roles array<string>, texts array<string>"
WAY = "conv_id {id}, part int, no long, i int, j int, closes string"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _fault(text: Column) -> Column:
    """blank, truncated or neither."""
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated")


def marked(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation, turn, role and text: n copies, the symbol of the first and that of the others."""
    said = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = store(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")), "copies")
    # only what is said at several turns needs to know which was the first; a null turn comes before all
    again = rows.groupBy("conv_id", "role", "text").agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
    again = again.where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "least", "unnumbered")
    both = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    repeated = F.coalesce(F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = _fault(F.col("text"))
    first = F.when(fault == "blank", "b").when(repeated, "d").when(fault == "truncated", F.upper(kind)).otherwise(kind)
    return both.select("conv_id", "turn", "role", "text", "n", first.alias("symbol"), F.when(fault == "blank", "b").otherwise("d").alias("copy"))


class _String:
    """The string of symbols that is being filled."""

    def __init__(self, conv_id, no: int):
        self.row = {"conv_id": conv_id, "no": no, "symbols": "", "illegal": 0, "first": None, "last": None, "first_turn": None, "last_turn": None, "turns": 0, "roles": [], "texts": []}
        self.bytes = 0

    def room(self) -> int:
        return SYMBOLS - len(self.row["symbols"])

    def add(self, r: dict, symbols: str, kept: bool) -> None:
        x, initial = self.row, r["role"][:1]
        x["illegal"] += _illegal(x["last"], initial) + (len(symbols) - 1) * _illegal(initial, initial)
        x["first"] = initial if x["last"] is None else x["first"]
        x["last"] = initial
        if r["turn"] is not None and r["turn"] != x["last_turn"]:
            x["turns"] += 1
            x["first_turn"] = r["turn"] if x["first_turn"] is None else x["first_turn"]
            x["last_turn"] = r["turn"]
        x["symbols"] += symbols
        if kept:
            x["roles"].append(r["role"])
            x["texts"].append(r["text"])
            self.bytes += len(r["text"])


def _illegal(a: str | None, b: str) -> int:
    return int(a is not None and (a, b) not in {("s", "u"), ("u", "a"), ("a", "u")})


def _strings(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, no, done, size = TaskContext.get().partitionId(), None, 0, [], 0
        for b in batches:
            for r in b.to_pylist():
                left, symbol = r["n"], r["symbol"]
                while left:
                    if now is None or now.row["conv_id"] != r["conv_id"] or not now.room() or now.bytes > BYTES:
                        if now is not None:
                            done.append(now.row | {"part": part})
                            size += now.bytes + SYMBOLS
                        now, no = _String(r["conv_id"], no), no + 1
                    take = min(left, now.room())
                    now.add(r, symbol + r["copy"] * (take - 1), kept=symbol not in "bd")
                    left, symbol = left - take, r["copy"]
                if size > BYTES:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
        if now is not None:
            done.append(now.row | {"part": part})
        yield pa.RecordBatch.from_pylist(done, schema)

    return run


def grammar_of(texts: DataFrame) -> Grammar:
    """Re-Pair over the distinct strings (symbols, n): each round makes rules of the most frequent pairs that can be replaced together.

    What comes to the driver are the RULES * 4 most frequent pairs of a round.
    """
    grammar = Grammar()
    for _ in range(ROUNDS):
        pairs = texts.mapInArrow(_pairs(grammar), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        found = [(r.a, r.b) for r in pairs.orderBy(F.desc("n"), "a", "b").limit(RULES * 4).collect()]
        if not found:
            break
        grammar = grammar.with_round(apart(found, RULES))
    return grammar


def _pairs(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for text, n in zip(b.column("symbols").to_pylist(), b.column("n").to_pylist(), strict=True):
                for pair, k in grammar.pairs(text).items():
                    found[pair] = found.get(pair, 0) + k * n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["a", "b", "n"])

    return run


def _ways(grammar: Grammar, schema: pa.Schema):
    """The states before and after each string on its conversation's cheapest path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, keys, conv, out = None, [], None, []

        def close():
            ways, _, last = path.ways()
            return [{"conv_id": conv, "part": p, "no": k, "i": i, "j": j, "closes": last if at == len(keys) - 1 else ""} for at, ((p, k), (i, j)) in enumerate(zip(keys, ways, strict=True))]

        for b in batches:
            for c, p, k, symbols in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "no", "symbols")), strict=True):
                if path is None or c != conv:
                    out += close() if path else []
                    path, keys, conv = Path(), [], c
                path.add(grammar.of_text(symbols))
                keys.append((p, k))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out + (close() if path else []), schema)

    return run


def _lines(grammar: Grammar, x: dict, i: int, j: int, closes: str):
    """Of one string and its way: cost, audit, and (letter, role, text) of what stays."""
    cost, rope = grammar.of_text(x["symbols"])[i][j]
    audit = text_of(rope) + closes
    held = [None] * len(x["symbols"])
    kept = iter(range(len(x["roles"])))
    for at, s in enumerate(x["symbols"]):
        held[at] = None if s in "bd" else next(kept)
    out = []
    for letter, at, role, _ in edited(x["symbols"], audit, i):
        if letter != "D":
            mine = None if at is None else held[at]
            out.append((letter, role or x["roles"][mine], "" if mine is None else x["texts"][mine]))
    return cost + INSERT * len(closes), audit, out


def _reported(grammar: Grammar, schema: pa.Schema):
    """Strings with their ways, in order, to one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, way, out = None, None, None, []

        def close():
            s, low, high = state, state["low"], state["high"]
            gaps = 0 if low is None else (high - low + 1 - s["turns"] + 2**63) % 2**64 - 2**63
            return {"conv_id": conv, "gaps": gaps, "audit": "".join(s["audit"]), "repaired_sha256": s["sha"].hexdigest()} | {k: s[k] for k in REPORT[1:]}

        for b in batches:
            for x in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                if state is None or x["conv_id"] != conv:
                    if state:
                        out.append(close())
                    conv = x["conv_id"]
                    state = dict.fromkeys(REPORT[1:], 0) | {"turns": 0, "low": None, "high": None, "last": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                if x["symbols"] is None:
                    way = (x["i"], x["j"], x["closes"])
                    continue
                cost, audit, lines = _lines(grammar, x, *way)
                state["cost"] += cost
                state["audit"].append(audit)
                for _, role, text in lines:
                    state["sha"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode())
                    state["any"] = True
                symbols = x["symbols"]
                state["blank"] += symbols.count("b")
                state["duplicate"] += symbols.count("d")
                state["truncated"] += sum(map(symbols.count, "SUAO"))
                state["illegal"] += x["illegal"] + _illegal(state["last"], x["first"])
                state["last"] = x["last"]
                state["turns"] += x["turns"] - (x["turns"] > 0 and x["first_turn"] == state["high"])
                state["low"] = x["first_turn"] if state["low"] is None else state["low"]
                state["high"] = state["high"] if x["last_turn"] is None else x["last_turn"]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out + ([close()] if state else []), schema)

    return run


def _spoken(grammar: Grammar, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                lines = _lines(grammar, x, x["i"], x["j"], x["closes"])[2]
                place = {"conv_id": x["conv_id"], "part": x["part"], "no": x["no"]}
                yield pa.RecordBatch.from_pylist([place | {"k": k, "edit": e, "role": r, "text": t} for k, (e, r, t) in enumerate(lines)], schema)

    return run


class Repair:
    """The repaired conversations of a table: turns() has their rows, report() a row for each conversation."""

    def __init__(self, df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        rows = store(marked(df, conv_id, turn, role, text), "marked")
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        # rows that the range keys tell apart by their first letters only lie in one partition, and are sorted there
        dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(200))).sortWithinPartitions("conv_id", "turn", "role", "text")
        schema = SEGMENT.format(id=self.kind)
        self.strings = store(dealt.mapInArrow(_strings(self._arrow(schema)), schema), "strings")
        self.grammar = grammar_of(store(self.strings.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "texts"))
        way = WAY.format(id=self.kind)
        keys = self.strings.select("conv_id", "part", "no", "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
        self.ways = store(keys.mapInArrow(_ways(self.grammar, self._arrow(way)), way), "ways")

    def _arrow(self, ddl: str) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        return to_arrow_schema(StructType.fromDDL(ddl))

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        schema = f"conv_id {self.kind}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string"
        both = self.ways.unionByName(self.strings, allowMissingColumns=True).repartition("conv_id")
        both = both.sortWithinPartitions("conv_id", "part", "no", F.col("symbols").isNotNull())
        return both.mapInArrow(_reported(self.grammar, self._arrow(schema)), schema)

    def turns(self) -> DataFrame:
        """conv_id, part, no, k (together the order), edit (K, R or I), role and text of every repaired row."""
        schema = f"conv_id {self.kind}, part int, no long, k int, edit string, role string, text string"
        both = self.strings.join(self.ways.drop("conv_id"), ["part", "no"])
        return both.mapInArrow(_spoken(self.grammar, self._arrow(schema)), schema)


def with_all(ids: DataFrame, report: DataFrame) -> DataFrame:
    """report with a row for every one of ids, a table of one column."""
    asked = ids.toDF("_asked").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = asked.join(report, F.col("_asked").eqNullSafe(F.col("conv_id")), "left")
    none = hashlib.sha256().hexdigest()
    return out.select(F.col("_asked").alias("conv_id"), *map(zero, REPORT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults that a hash of conversation and turn decides: dropped, emptied, without sentence ends, repeated, or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).cast("int")
    cut = F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    out = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"), cut.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_all(rows.select("conv_id"), Repair(damaged(rows)).report())
