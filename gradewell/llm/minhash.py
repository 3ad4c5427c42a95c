"""MinHash near-duplicates: universal hash minima, banding, verification on full sets, components.

Texts of one set of shingles are one class, stored as its smallest doc_id, so
copies are never paired. Signatures of classes are cut into bands; classes that share a band are
candidates. No pairs of a whole bucket are formed: each member is held against
the bucket's smallest, and pairs whose signatures leave a link possible tie
classes; members of one bucket that are tied to different classes are compared by
signature in blocks inside tasks, which give one tie for each two of these. Components
of ties are clusters, and every link lies within one. One pair of each class is confirmed on full sets and
gives first components; where a cluster still holds several, blocks of their full
sets meet in tasks, which count all intersections exactly and give only the links
that join components. Blocks of one large component never meet each other.

With 128 minima in 32 bands of 4 a pair of similarity 0.8 is missed with a probability below 1e-7;
an estimate under 0.6 at a true 0.8 has one below 1e-7 as well.

Edge cases: a null text, and one without words, has the empty set and is linked
with nothing; a text of fewer words than a shingle has its whole sequence as one
shingle; doc_id identifies a document, so rows that repeat one are one node, for which one of its texts stands if they differ (one_text());
rows of a null doc_id are not linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._store import one_text, spread_join, store, table
from gradewell.llm._words import Words, mix, slices
from gradewell.llm.components import components

SHINGLE, MINIMA, BAND, PERCENT, POSSIBLE = 4, 128, 4, 80, 0.6
BLOCK = 256  # members of a bucket compared at once
WEIGHT = 1 << 19  # shingles of a block: 4 MB, unless one set alone has more


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n multiplicative hash functions on 32 bits."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128 bits that identify the set) and sig (minima, binary)."""
    id_type = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, offset = _hashes(MINIMA)
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                h, at = Words(raw, off).shingles(shingle, True)
                full = np.flatnonzero(np.diff(at) > 0)
                n, k1, k2 = (np.zeros(b - a, dtype=np.int64) for _ in range(3))
                with np.errstate(over="ignore"):
                    for t in full.tolist():
                        own = np.unique(h[at[t] : at[t + 1]])
                        n[t] = len(own)
                        k1[t] = own.sum(dtype=np.uint64).view(np.int64)
                        k2[t] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)
                    sig = np.zeros((b - a, MINIMA), dtype=np.uint32)
                    if len(full):
                        x = (h >> np.uint64(32)).astype(np.uint32)
                        starts = at[full]
                        for j in range(MINIMA):
                            sig[full, j] = np.minimum.reduceat(x * factor[j] + offset[j], starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sig], type=pa.binary())],
                    names=[doc_id, "n", "k1", "k2", "sig"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {id_type}, n long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """band (a hash), doc, n: a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1, BAND).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, sig.shape[1] + 1, dtype=np.uint64), sig.shape[:2])
                for j in range(BAND):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
            times = sig.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), times)),
                    pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), times)),
                ],
                names=["band", "doc", "n"],
            )

    return classes.select("doc", "n", "sig").mapInArrow(run, "band long, doc long, n long")


def _sets(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc, members: the sorted hashes of the set (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1)):
                h, at = Words(raw, off).shingles(shingle, True)
                own = [np.unique(h[at[t] : at[t + 1]]).tobytes() for t in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, type=pa.binary())], names=["doc", "members"])

    return docs.select(F.col(doc_id).alias("doc"), text).mapInArrow(run, "doc long, members binary").dropDuplicates(["doc"])


def _possible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave a similarity of 0.8 possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = (x == y).mean(axis=1) >= POSSIBLE
            yield batch.select([0, 1]).filter(pa.array(keep))

    both = (
        pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return (
        pairs.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("ma")), "a")
        .join(sets.select(F.col("doc").alias("b"), F.col("members").alias("mb")), "b")
        .select("a", "b", "ma", "mb")
        .mapInArrow(run, "a long, b long")
    )


def _spanning(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of links, one for each two labels that they join, leaving out what earlier ones joined."""
    low, high = np.minimum(left, right), np.maximum(left, right)
    names, code = np.unique(np.concatenate([low, high]), return_inverse=True)
    n = len(low)
    _, first = np.unique(code[:n].astype(np.int64) * len(names) + code[n:], return_index=True)
    root = list(range(len(names)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i in first.tolist():
        p, q = find(int(code[i])), find(int(code[n + i]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append(i)
    return np.array(out, dtype=np.int64)


def _meetings(members: DataFrame, group: str) -> DataFrame:
    """meeting, doc, component: pairs of blocks whose members are of different components of a group, as rows of both blocks.

    members: group, doc, component, w (a member's weight). A block has about BLOCK members or WEIGHT of weight. A component of half a block or
    more has blocks of its own, which do not meet each other; smaller ones of a group share blocks. So members that
    one component holds already cost rows only for those that it does not hold.
    """
    key = F.xxhash64(group, "component").alias("key")
    size = members.groupBy(group, "component").agg(F.count("*").alias("s"), F.sum("w").alias("w"))
    own = (F.col("s") >= BLOCK // 2) | (F.col("w") >= WEIGHT // 2)
    parts = lambda s, w: F.ceil(F.greatest(s / BLOCK, w / WEIGHT)).cast("int")
    rest = size.where(~own).groupBy(group).agg(parts(F.sum("s"), F.sum("w")).alias("rest"))
    # pure: the component that a block holds alone
    kinds = size.join(rest, group, "left").select(
        key, group, "component", "s", F.when(own, F.col("component")).alias("pure"), F.greatest(F.lit(1), F.when(own, parts(F.col("s"), F.col("w"))).otherwise(F.col("rest"))).alias("parts")
    )
    kinds = store(kinds, "kinds")
    total = kinds.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    placed = spread_join(members.select(key, group, "doc", "component"), kinds.select("key", "s", "pure", "parts"), "key", "doc", "s", total)
    placed = placed.select(group, "doc", "component", F.struct("pure", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part")).alias("block"))
    # kinds of blocks meet first, so blocks of one component are never paired
    kind = kinds.select(group, "pure", "parts").distinct()
    of = lambda name: F.struct("pure", "parts").alias(name)
    met = kind.select(group, of("x")).join(kind.select(group, of("y")), group)
    loose, same = F.col("x.pure").isNull() & F.col("y.pure").isNotNull(), F.col("x.pure").isNull() & F.col("y.pure").isNull()
    first = loose | F.coalesce(F.col("x.pure") < F.col("y.pure"), F.lit(False))
    number = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}.parts") - 1))
    met = met.where(first | same).select(group, "x", "y", number("x").alias("i")).select(group, "x", "y", "i", number("y").alias("j"))
    block = lambda side, n: F.struct(F.col(f"{side}.pure").alias("pure"), F.col(n).alias("part"))
    met = met.where(~same | (F.col("i") <= F.col("j"))).select(group, block("x", "i").alias("x"), block("y", "j").alias("y"))
    met = met.select("*", F.xxhash64(group, "x", "y").alias("meeting"))
    sides = met.select(group, F.col("x").alias("block"), "meeting").unionByName(met.where("x != y").select(group, F.col("y").alias("block"), "meeting"))
    at = F.xxhash64(group, "block")
    return placed.select("doc", "component", at.alias("at")).join(sides.select(at.alias("at"), "meeting"), "at").select("meeting", "doc", "component")


def _across(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Possible pairs (a, b) that tie members of different components within one bucket, found in blocks.

    rows: band, doc, component. Rows of one meeting of blocks lie next to each other in a partition and are read as a stream.
    """
    dealt = _meetings(rows.withColumn("w", F.lit(0)), "band").join(sigs.select("doc", "sig"), "doc")
    spread = dealt.repartition("meeting").sortWithinPartitions("meeting")

    def compare(doc, comp, sig) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for s in range(0, len(doc), 64):
            own = np.arange(s, min(s + 64, len(doc)))
            same = np.zeros((len(own), len(doc)), dtype=np.int16)
            for m in range(sig.shape[1]):
                same += sig[own, m][:, None] == sig[:, m][None, :]
            p, q = np.nonzero((same >= POSSIBLE * sig.shape[1]) & (comp[own][:, None] != comp[None, :]))
            left.append(own[p])
            right.append(q)
        p, q = np.concatenate(left), np.concatenate(right)
        at = _spanning(p, q, comp[p], comp[q]) if len(p) else p
        return doc[p[at]], doc[q[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            doc, comp = t["doc"].to_numpy(), t["component"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(len(doc), -1)
            cuts = _groups(t)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1 and (comp[a:b] != comp[a]).any():
                    p, q = compare(doc[a:b], comp[a:b], sig[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group of a batch may go on in the next
            cuts = _groups(pa.Table.from_batches([batch]))
            if held and held[-1]["meeting"][-1].as_py() != batch["meeting"][0].as_py():
                yield from flush()
                held = []
            if len(cuts) > 2:
                held.append(batch.slice(0, int(cuts[-2])))
                yield from flush()
                held = [batch.slice(int(cuts[-2]))]
            else:
                held.append(batch)
        if held:
            yield from flush()

    return spread.mapInArrow(run, "a long, b long").distinct()


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of one cluster, confirmed on full sets in blocks.

    members: doc, cluster, component, w (the size of its set, which bounds what a meeting holds).
    """
    dealt = _meetings(members, "cluster").join(sets, "doc")

    def links(t: pa.Table) -> pa.Table:
        doc, comp = t["doc"].to_numpy(), t["component"].to_numpy()
        lists = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t["members"]]
        n = np.array([len(x) for x in lists], dtype=np.int64)
        names, times = np.unique(np.concatenate(lists), return_counts=True)
        shared = names[times > 1]
        common = np.zeros((len(doc), len(doc)), dtype=np.float32)
        # shared shingles as columns of zeros and ones, some thousands at a time: products count intersections
        for s in range(0, len(shared), 4096):
            some = shared[s : s + 4096]
            held = np.zeros((len(doc), len(some)), dtype=np.float32)
            for i, x in enumerate(lists):
                at = np.searchsorted(some, x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")])
                mine = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
                held[i, at[some[at] == mine]] = 1
            common += held @ held.T
        both = np.rint(common).astype(np.int64)
        ok = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
        p, q = np.nonzero(np.triu(ok, 1))
        at = _spanning(p, q, comp[p], comp[q]) if len(p) else p
        return pa.table({"a": np.maximum(doc[p[at]], doc[q[at]]), "b": np.minimum(doc[p[at]], doc[q[at]])})

    return dealt.groupBy("meeting").applyInArrow(links, "a long, b long").distinct()


def _groups(t: pa.Table) -> np.ndarray:
    v = t["meeting"].to_numpy()
    return np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [t.num_rows]])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept. doc_id is an integer."""
    docs, others = one_text(docs.select(doc_id, text), doc_id, text)
    base = store(signatures(docs, doc_id, text, shingle).withColumn(doc_id, F.col(doc_id).cast("long")), "signatures")
    keyed = base.where(f"n > 0 and `{doc_id}` is not null")
    rows = keyed.select(F.col(doc_id).alias("id"), F.struct("k1", "k2", "n").alias("set"))
    copies = store(rows.groupBy("set").agg(F.min("id").alias("doc"), F.count("*").alias("c")).where("c > 1"), "copies")
    n_copies = copies.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    member = spread_join(rows, copies, "set", "id", "c", n_copies, "left")
    member = store(member.select("id", F.coalesce("doc", "id").alias("doc")).distinct(), "classes")
    sigs = base.join(member.where("id = doc").select(F.col("id").alias(doc_id)), doc_id, "left_semi").select(F.col(doc_id).alias("doc"), "n", "sig")

    bands = _bands(sigs)
    shared = store(bands.groupBy("band").agg(F.min("doc").alias("m"), F.count("*").alias("c")).where("c > 1"), "bands")
    n_rows = shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    buckets = store(spread_join(bands, shared, "band", "doc", "c", n_rows), "buckets")
    involved = buckets.select("doc").distinct()
    sigs = store(sigs.join(involved, "doc", "left_semi"), "bucket-signatures")
    wanted = docs.join(involved.select(F.col("doc").alias(doc_id)), doc_id, "left_semi")
    sets = store(_sets(wanted, doc_id, text, shingle), "bucket-sets")

    sizes = sigs.select("doc", "n")
    star = buckets.where("doc != m").select(F.col("doc").alias("a"), F.col("m").alias("b")).distinct()
    fit = (
        star.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .select("a", "b")
    )
    ties = store(_possible(fit, sigs), "ties")
    # one step is enough to tell most members of a bucket apart from strangers: the smallest class a member is tied to
    near = ties.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("component"))
    labelled = buckets.select("band", "doc").join(near, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo != hi").select("band", "c")
    rows = store(spread_join(labelled, store(mixed, "mixed"), "band", "doc", "c", n_rows).select("band", "doc", "component"), "mixed-buckets")
    more = store(_across(rows, sigs), "ties-across")
    clusters = components(ties.unionByName(more))

    first = store(_confirmed(ties.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "links")
    found = components(first)
    placed = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")).join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = store(placed.join(sizes.select("doc", F.col("n").alias("w")), "doc"), "clusters")
    several = placed.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo != hi").select("cluster", "c")
    loose = store(spread_join(placed, store(several, "several"), "cluster", "doc", "c", n_rows).drop("c"), "loose")
    rest = store(_within(loose, sets, percent), "links-within")
    if not rest.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    labels = member.join(found.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("id").alias(doc_id), F.coalesce("component", "doc").alias("component"))
    counts = base.select(doc_id, F.col("n").alias("n_shingles"))
    if others is not None:
        counts = counts.unionByName(signatures(others, doc_id, text, shingle).select(F.col(doc_id).cast("long").alias(doc_id), F.col("n").alias("n_shingles")))
    out = counts.join(labels, doc_id, "left").withColumn("component_id", F.coalesce("component", F.col(doc_id)))
    return out.select(doc_id, "n_shingles", "component_id", F.col(doc_id).eqNullSafe(F.col("component_id")).alias("kept"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles: that with the smallest doc_id, in one row if rows repeat its id and text."""
    gone = near_duplicates(docs, shingle=5).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = store(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    once = left.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
