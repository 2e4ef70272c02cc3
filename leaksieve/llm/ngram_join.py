"""Exact Jaccard self-join of word-shingle sets, reduced to its linked classes, by set-relation skipping.

Equal sets are one node. Nodes are indexed by the prefix of their shingles in one global order: shingles
that many documents hold go last (``FREQUENT`` of them at most are told apart, a bounded broadcast), the
others by hash. Any order gives the same links; this one keeps lists short. Linked nodes share a prefix
shingle, so the index lists hold every candidate pair:

1. *Anchors.* Each list has one head in a round, and each node is compared with one hub, the head of
   another class with which it shares most prefix shingles. A verified hub can become its anchor, with
   the exact distance |x Δ anchor| kept, and both are in one class. A round is linear in the index, and
   large groups of near copies collapse in a few.
2. *Anchor pairs.* Lists are cut into blocks by set size. Blocks whose sizes can't reach the threshold
   are skipped as a whole, entries too late in their sets to reach it are skipped by position, and
   entries of one class are skipped since a link inside a class tells nothing new. What is left gives
   pairs of anchors, which are compared once whatever number of members stand behind them.
3. *Derived answers.* For members x, z of anchors a, b the answer follows from the anchors' by
   |x Δ z| >= |a Δ b| - |x Δ a| - |z Δ b|; only pairs that this leaves open, in classes still apart, are
   compared.

Two sets link when 100 |x ∩ z| >= 100 t |x ∪ z|. No cap is set on lists, partners or candidates.

Defined results: a null text, or one without words, has an empty set and links with nothing; it is its
own class. Rows that repeat an id get equal results, a null id takes part and gives no class name unless
alone. An empty table gives an empty result. Columns other than the id and the text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, sliced, stage
from .graph import components
from .shingles import SHINGLE, Shingler, node_of

THRESHOLD = 75
#: Frequent shingles that are told apart at most (8 bytes each in the broadcast), and the least documents that hold one.
FREQUENT, FREQUENT_DF = 1 << 20, 8
#: Bits of a shingle that tell whether it may be a frequent one, before it is looked up.
FILTER_BITS = 22
#: Shingles that a task gathers before it hands them on, buckets for each shuffle partition, and rows whose sets it holds together.
GATHERED, BUCKETS_EACH, AT_ONCE = 1 << 19, 4, 500
#: Rounds of anchors at most; they end when fewer than one in ROUND_YIELD comparisons links.
ROUNDS, ROUND_YIELD = 8, 25
#: Levels of the share of a node's prefix that others hold too; heads are drawn from the best level of a list.
LEVELS = 10
#: Shingles in a block of members that are compared together, about.
MEMBER_BLOCK = 1 << 13
#: Keys of more than one in so many of all rows are brought to their rows by a broadcast of fewer keys than this.
HOT_SHARE = 10_000
#: Ids of documents to fetch are broadcast up to this number of rows (16 bytes each), and joined by a shuffle beyond it.
BROADCAST_ROWS = 1_000_000


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(column(text_col).cast("binary").alias("text"))


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps, byte by byte: the high bytes of small steps are zeros, which compress away."""
    return np.diff(ascending, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _split(values: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int, buckets: int) -> np.ndarray:
    """The shingles that most documents hold, rarest first.

    Counts cover all documents. Each task hands on what it gathered as packed arrays by the hash's high
    bits. The counts only set an order, so 32 bits of a bucket's hashes are enough to count by.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        held, n = [], 0

        def hand_on():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            bucket = ((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for b, at in _split(found, bucket, buckets):
                low, c = found[at].astype(np.uint32), count[at]
                more = np.argsort(low[c > 1], kind="stable")
                rows.append((b, _packed(np.sort(low[c == 1])), _packed(low[c > 1][more]), c[c > 1][more].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "once", "more", "times"])

        for batch in sliced(batches, AT_ONCE):
            for found in shingler.sets_of(batch.column(0).to_pylist()):
                held.append(found)
                n += len(found)
                if n >= 4 * GATHERED:
                    yield hand_on()
                    held, n = [], 0
        if n:
            yield hand_on()

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # a bucket's arrays from all tasks
        low = np.concatenate([_unpacked(x) for col in ("once", "more") for x in pdf[col]])
        ones = sum(len(x) // 4 for x in pdf["once"])
        times = np.concatenate([np.ones(ones, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["times"])])
        order = np.argsort(low, kind="stable")
        low, times = low[order], times[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        df = np.add.reduceat(times, first) if len(low) else times
        keep = df >= FREQUENT_DF
        return pd.DataFrame({"bucket": np.full(keep.sum(), key[0], np.int32), "low": low[first][keep].astype(np.int64), "df": df[keep]})

    packed = _texts(docs, text_col).mapInArrow(gather, "bucket int, once binary, more binary, times binary")
    counted = packed.groupBy("bucket").applyInPandas(count, "bucket int, low long, df long")
    counted = stage(counted.withColumn("level", F.floor(F.log2(F.col("df").cast("double")) * 16).cast("int")), "shingle-counts")
    # the lowest level from which on all fit in the broadcast: a level is a sixteenth of a doubling
    levels = counted.groupBy("level").count().orderBy(F.desc("level")).collect()
    least = next((x["level"] + 1 for x, n in zip(levels, np.cumsum([x["count"] for x in levels]), strict=True) if n > FREQUENT), 0)
    top = counted.where(F.col("level") >= least).select("bucket", "low", "df").toArrow()
    bucket, low, df = (top.column(k).to_numpy() for k in ("bucket", "low", "df"))
    name = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    return name[np.lexsort((name, df))]


def _name(found: np.ndarray, buckets: int) -> np.ndarray:
    """What a shingle is counted as: its bucket and its low bits."""
    return ((found >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (found & np.uint64(0xFFFFFFFF))


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _index(docs: DataFrame, text_col: str, shingle: int, threshold: int, buckets: int) -> DataFrame:
    """The index lists of two nodes or more: token, node, n (set size), at (position in its set)."""
    spark = docs.sparkSession
    ranked = frequent_shingles(docs, text_col, shingle, buckets)
    by_name = np.argsort(ranked, kind="stable")
    some = np.zeros(1 << FILTER_BITS, bool)
    some[(ranked & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast((ranked[by_name], by_name, np.packbits(some)))  # 18 MB at most

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks, bits = shared.value
        some, low = np.unpackbits(bits).view(bool), np.uint64((1 << FILTER_BITS) - 1)
        shingler = Shingler(shingle)
        held, seen, n = [], set(), 0

        def hand_on():
            token, node, size, at, sure = (np.concatenate(x) for x in zip(*held, strict=True))
            size = np.where(sure, -size, size).astype(np.int32)
            # a frequent shingle has its list for certain, and its entries are dealt out by node as well
            bucket = (((token >> np.uint64(32)) + np.where(sure, node.view(np.uint64) >> np.uint64(33), 0)) % np.uint64(buckets)).astype(np.int64)
            rows = [(b, *(x[k].tobytes() for x in (token, node, size, at))) for b, k in _split(token, bucket, buckets)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["bucket", "token", "node", "n", "at"])

        for batch in sliced(batches, AT_ONCE):
            for found in shingler.sets_of(batch.column(0).to_pylist()):
                if not len(found):
                    continue
                node, p = node_of(found), prefix_length(len(found), threshold)
                if node in seen:
                    continue
                seen.add(node)
                rank = np.zeros(len(found), np.int64)
                maybe = np.flatnonzero(some[(found & low).astype(np.int64)]) if len(names) else ()
                if len(maybe):
                    name = _name(found[maybe], buckets)
                    k = np.minimum(np.searchsorted(names, name), len(names) - 1)
                    rank[maybe] = np.where(names[k] == name, ranks[k] + 1, 0)
                    order = np.argsort(rank, kind="stable")
                    found, rank = found[order], rank[order]
                held.append((found[:p], np.full(p, node, np.int64), np.full(p, len(found), np.int32), np.arange(p, dtype=np.int32), rank[:p] > 0))
                n += p
                if n >= GATHERED:
                    yield hand_on()
                    held, n = [], 0
                    seen.clear()
        if n:
            yield hand_on()

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        token, node, size, at = (np.concatenate([np.frombuffer(x, kind) for x in pdf[col]]) for col, kind in (("token", np.uint64), ("node", np.int64), ("n", np.int32), ("at", np.int32)))
        order = np.lexsort((node, token))
        order = order[np.r_[True, (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1])]]
        token, node, size, at = token[order], node[order], size[order], at[order]
        sure, size = size < 0, np.abs(size)  # the sign marks a frequent shingle
        same = token[1:] == token[:-1]
        keep = np.r_[same, False] | np.r_[False, same] | sure
        return pd.DataFrame({"token": token[keep].view(np.int64), "node": node[keep], "n": size[keep], "at": at[keep]})

    packed = _texts(docs, text_col).mapInArrow(gather, "bucket int, token binary, node binary, n binary, at binary")
    return packed.groupBy("bucket").applyInPandas(lists, "token long, node long, n int, at int")


def document_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, node (null for an empty set), text_hash."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in sliced(batches, AT_ONCE):
            sets = list(shingler.sets_of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), batch.column("text_hash")], names=["doc_id", "n_shingles", "node", "text_hash"])

    text = column(text_col)
    source = docs.select(column(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text.cast("string")).alias("text_hash"))
    return source.mapInArrow(name, "doc_id long, n_shingles long, node long, text_hash long")


def _node_sets(docs: DataFrame, ends: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, shingles (packed) of the nodes in ``ends``, from the text of one document each."""
    wanted = nodes.join(ends, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select(F.col("doc_id").alias("wanted")).distinct()
    wanted = stage(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in sliced(batches, AT_ONCE):
            sets = list(shingler.sets_of(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return stage(texts.mapInArrow(pack, "node long, shingles binary"), "sets")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v pairs to u, v, common, nu, nv by their whole sets."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            us, vs = batch.column("su"), batch.column("sv")
            out = np.zeros((len(us), 3), np.int64)
            for i in range(len(us)):
                a, b = np.frombuffer(us[i].as_py(), np.uint64), np.frombuffer(vs[i].as_py(), np.uint64)
                k = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                out[i] = int((b[k] == a).sum()), len(a), len(b)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *(pa.array(out[:, k]) for k in range(3))], names=["u", "v", "common", "nu", "nv"])

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").mapInArrow(common, "u long, v long, common long, nu long, nv long")


def _linked(threshold: int):
    return F.col("common") * 100 >= (F.col("nu") + F.col("nv") - F.col("common")) * threshold


def _reachable(threshold: int, shared, n1, at1, n2, at2):
    """Whether two sets with this many shared prefix shingles, the last at these positions, can still link."""
    most = shared + F.least(n1 - at1 - 1, n2 - at2 - 1)
    return (most * (100 + threshold) >= (n1 + n2) * threshold) & (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * threshold)


def _low_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, AT_ONCE):
        low = [np.frombuffer(x.as_py(), np.uint64).astype(np.uint32).tobytes() for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(low, pa.binary())], names=["node", "low"])


def _member_candidates(threshold: int):
    """Pairs of two blocks that their anchors' answer leaves open and whose hashes' low halves agree often enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, AT_ONCE):
            us, vs = [], []
            for i in range(len(batch)):  # a row at a time: a batch of blocks is large
                apart, one, two = (batch.column(k)[i].as_py() for k in range(3))
                ones = [(x, np.frombuffer(x["low"], np.uint32)) for x in one]
                for z in two:
                    b = np.sort(np.frombuffer(z["low"], np.uint32))
                    for x, a in ones:
                        n, m = len(a), len(b)
                        if x["root"] == z["root"] or min(n, m) * 100 < max(n, m) * threshold or (apart - x["off"] - z["off"]) * (100 + threshold) > (n + m) * (100 - threshold):
                            continue
                        common = int((b[np.minimum(np.searchsorted(b, a), m - 1)] == a).sum())
                        if common * 100 >= (n + m - common) * threshold:
                            us.append(x["node"])
                            vs.append(z["node"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return compare


def _linked_rows(docs: DataFrame, id_col: str, text_col: str, threshold: int, shingle: int) -> DataFrame:
    """One row per input row: doc_id, n_shingles, text_hash, first (id and text hash of its class's first row) and alone (whether it has no word)."""
    spark = docs.sparkSession
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = stage(document_nodes(docs, id_col, text_col, shingle), "nodes")
    index = stage(_index(docs, text_col, shingle, threshold, buckets), "index")
    hundred = 100 + threshold

    fetched: list[DataFrame] = []

    def sets(pairs: DataFrame) -> DataFrame:
        """Sets of the pairs' nodes; those fetched before are not read again."""
        every = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
        ends = every
        for have in fetched:
            ends = ends.join(have.select("node"), "node", "left_anti")
        if fetched:
            ends = stage(ends, "ends")
        if not fetched or not ends.isEmpty():
            fetched.append(_node_sets(docs, ends, nodes, id_col, text_col, shingle))
        every = F.broadcast(every) if every.count() <= BROADCAST_ROWS else every
        return reduce(DataFrame.union, fetched).join(every, "node", "left_semi")

    apart = (F.col("nu") + F.col("nv") - 2 * F.col("common")).alias("apart")

    # 1. anchors: in each round one head for each list, and one head for each node
    # a node most of whose prefix others share is near the middle of its copies, and makes a good head
    size = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    level = index.groupBy("node").agg((F.lit(LEVELS) - F.floor(F.count(F.lit(1)) * LEVELS / F.max(size))).alias("level"))
    index = stage(index.join(level, "node"), "levels")
    live = index.withColumn("root", F.col("node"))
    links = None
    for turn in range(ROUNDS):
        key = F.col("level") + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        heads = live.withColumn("k", key).groupBy("token").agg(
            *(F.min_by(c, "k").alias(f"h{c}") for c in ("node", "n", "at", "root")), F.min("root").alias("r0"), F.max("root").alias("r1")
        )
        met = live.join(heads.where("r0 != r1").drop("r0", "r1"), "token").where("root != hroot").groupBy("node", "hnode").agg(
            F.count(F.lit(1)).alias("shared"), *(F.max(c).alias(c) for c in ("n", "at", "hn", "hat"))
        )
        met = met.where(_reachable(threshold, F.col("shared"), F.col("n"), F.col("at"), F.col("hn"), F.col("hat")))
        hubs = stage(met.groupBy("node").agg(F.max_by("hnode", "shared").alias("v")).select(F.col("node").alias("u"), "v"), "hubs")
        fresh = stage(_compare(hubs, sets(hubs)).where(_linked(threshold)).select("u", "v", apart).distinct(), "anchors")
        links = fresh if links is None else links.union(fresh)
        roots = components(links)
        live = stage(index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
        if fresh.count() * ROUND_YIELD <= hubs.count():
            break
    # of a node's verified heads its anchor is the one with most nodes; the distance to it is known
    crowd = links.groupBy("v").agg(F.count(F.lit(1)).alias("crowd"))
    anchor = links.join(crowd, "v").groupBy("u").agg(F.max_by("v", "crowd").alias("anchor"), F.max_by("apart", "crowd").alias("off")).withColumnRenamed("u", "node")

    # 2. pairs of anchors in lists, over blocks, positions and classes
    # set sizes of one block differ by less than what the threshold allows, so only neighbouring blocks can link
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / min(threshold, 99)))).cast("int")
    placed = live.join(anchor, "node", "left").withColumns({"anchor": F.coalesce("anchor", "node"), "off": F.coalesce("off", F.lit(0)), "block": block})
    placed = stage(placed, "placed")

    def across(entries: DataFrame, name: str) -> DataFrame:
        """Pairs of entries' ``name`` in one list, of neighbouring blocks and different classes, with what bounds their overlap."""
        low = entries.groupBy("token", "block", name, "root").agg(F.min("n").alias("n"), F.max("n").alias("top"), F.min("at").alias("at"))
        many = low.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token")
        low = low.join(many, "token", "left_semi")
        a = low.select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("block").alias("own"), F.col(name).alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("top").alias("tu"), F.col("at").alias("pu"))
        b = low.select("token", "block", F.col(name).alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("top").alias("tv"), F.col("at").alias("pv"))
        met = a.join(b, ["token", "block"]).where("ru != rv and (own < block or u < v)")
        sizes = (F.col("tu") * 100 >= F.col("nv") * threshold) & (F.col("tv") * 100 >= F.col("nu") * threshold)
        most = F.least(F.col("tu") - F.col("pu"), F.col("tv") - F.col("pv"))  # from the first shared shingle on
        return met.where(sizes & (most * hundred >= (F.col("nu") + F.col("nv")) * threshold)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    pairs = stage(across(placed, "anchor"), "anchor-pairs")
    compared = stage(_compare(pairs, sets(pairs)).distinct(), "anchor-answers")
    links2 = compared.where(_linked(threshold)).select("u", "v")

    # 3. members whose anchors' answer leaves them open, in classes that are still apart
    roots = components(links.select("u", "v").union(links2))
    placed = placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_pairs = compared.where(~_linked(threshold)).select("u", "v", apart)
    one = placed.select("node", "n", "anchor", "off", "root").distinct()
    reach = one.groupBy("anchor").agg(F.max("off").alias("off"), F.max("n").alias("n"), F.min("root").alias("root"), F.sum("n").alias("total"))
    near = (
        open_pairs.join(reach.toDF("u", "ou", "nu", "ru", "tu"), "u").join(reach.toDF("v", "ov", "nv", "rv", "tv"), "v").where("ru != rv")
        .where((F.col("ou") + F.col("ov") > 0) & ((F.col("apart") - F.col("ou") - F.col("ov")) * hundred <= (F.col("nu") + F.col("nv")) * (100 - threshold)))
        .select("u", "v", "apart")
    )
    near = stage(near, "near")
    ends = near.select(F.explode(F.array("u", "v")).alias("anchor")).distinct()
    members = stage(one.join(ends, "anchor").join(reach.select("anchor", "total"), "anchor"), "members")
    member_sets = sets(members.select(F.col("node").alias("u"), F.col("node").alias("v"))).mapInArrow(_low_halves, "node long, low binary")
    part = F.pmod(F.xxhash64("node"), 1 + F.floor(F.col("total") / MEMBER_BLOCK))
    item = F.struct("node", "n", "off", "root", "low")
    blocks = stage(members.join(member_sets, "node").groupBy("anchor", part.alias("part")).agg(F.collect_list(item).alias("items")), "member-blocks")
    met = near.join(blocks.select(F.col("anchor").alias("u"), F.col("items").alias("one")), "u").join(blocks.select(F.col("anchor").alias("v"), F.col("items").alias("two")), "v")
    open_members = stage(met.select("apart", "one", "two").mapInArrow(_member_candidates(threshold), "u long, v long").distinct(), "open-members")
    links3 = _compare(open_members, sets(open_members)).where(_linked(threshold)).select("u", "v")

    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links3))
    # a class's name is found node by node: rows of equal sets are counted together before classes meet
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")  # any id comes before none
    least = nodes.where("node is not null").groupBy("node").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("rows"))
    least = stage(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "node-classes")
    names = stage(least.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "names")
    named = stage(_brought(least.select("node", "root", "rows"), names, "root", "members"), "named-nodes")
    labelled = _brought(nodes.where("node is not null"), named.select("node", "first", "rows"), "node", "rows")
    columns = ("doc_id", "n_shingles", "text_hash")
    alone = nodes.where("node is null").select(*columns, F.lit(None).cast(least.schema["least"].dataType).alias("first"), F.lit(True).alias("alone"))
    return labelled.select(*columns, "first", F.lit(False).alias("alone")).unionByName(alone)


def _brought(rows: DataFrame, names: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``names``, which has one row for each key and how many rows hold it.

    Keys of more than one in HOT_SHARE of all rows are fewer than HOT_SHARE: they are brought to where their
    rows lie. Rows of the other keys meet by key.
    """
    total = names.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(names.where(F.col(weight) * HOT_SHARE > total))
    cold = names.where(F.col(weight) * HOT_SHARE <= total)
    return rows.join(hot.drop(*(set(names.columns) & set(rows.columns) - {key})), key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.drop(*(set(names.columns) & set(rows.columns) - {key})), key))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    linked = _linked_rows(docs, id_col, text_col, threshold, shingle)
    return linked.select("doc_id", "n_shingles", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns: the one of the smallest id, and of the least hash of its text where near copies repeat that id.

    Rows are told apart by id and text, so of rows that repeat an id each stays or goes with its own class.
    Documents without a word are classes of their own and stay; a null id comes after all others.
    """
    linked = stage(_linked_rows(docs, id_col, text_col, THRESHOLD, SHINGLE).where("not alone"), "linked")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    lost = stage(linked.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.min(first).alias("tie"), F.count(F.lit(1)).alias("n")).where("n > 1 or not tie"), "near-copies")
    sizes = lost.agg(F.count(F.lit(1)).alias("n"), F.max("tie").alias("ties")).first()
    small = F.broadcast if sizes["n"] <= BROADCAST_ROWS else lambda x: x
    rows = docs.select(carried(docs), column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col).cast("string")).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("hash") == F.col("lost_hash"))
    out = rows.join(small(lost.where("not tie")), same, "left_anti")
    if sizes["ties"]:  # equal rows that stay are cut to one
        ties = lost.where("tie")
        once = out.join(small(ties), same, "left_semi").dropDuplicates(["id", "hash"])
        out = out.join(small(ties), same, "left_anti").unionByName(once)
    return out.select("rest.*")
