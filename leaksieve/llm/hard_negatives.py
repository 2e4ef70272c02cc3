"""Hard negatives by exact inner products: a rotation first, so that few components tell most pairs apart.

Components are fixed-point integers, and scores their integer products. An orthogonal rotation onto principal
components leaves products as they are and moves their weight to the leading components. Each task streams
through its rows of the table with a chunk of the anchors at hand: it accumulates partial products over more
and more leading components; what is missing is at most the product of the two residual norms, and the
rounding of the rotated products has a proven bound that is added as slack. Pairs that can't come into a list
any more are discarded at each step, survivors get their integer product, and only that decides. Rows come in
tiles that grow, so lists fill up before many pairs are looked at.

The rotation is fitted on at most ``SAMPLE`` rows, those of least hashed ids: it decides how soon a pair is
discarded, and nothing else. Anchors go out in chunks of at most ``CHUNK`` components, whatever their number,
and each chunk's lists are written before the next starts; every row of the table meets every anchor.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with one whose
fixed-point value is so large that a score could leave 64 bits, take no part. Shorter vectors count as
filled up with zeros. An id stands once in a list, with its best score there, however many rows have it; an
anchor isn't among its own positives, nor is another row of its id; of anchors of one id, the row of the least
label and vector stands. Ties go by id. An empty table, or one without anchors, gives no rows. Other columns
are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, discard, give_back, shared_dir, sliced, stage

#: Rows that the rotation is fitted on at most; components of the anchors of one chunk at most.
SAMPLE, CHUNK = 4096, 1 << 20
#: Steps of the leading components, as parts of all; rows of a task's first and of its largest tile, and anchors of a tile.
STEPS, FIRST, TILE, ACROSS = (8, 4, 2, 1), 64, 2048, 1024
#: Below this share of survivors, pairs are followed one by one.
SPARSE = 1 / 32
SCALE = 256
NONE = np.iinfo(np.int64).min
VECTORS = "id long, label long, q array<long>"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def fixed_point(batch: pa.RecordBatch, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and integer vectors of a batch's rows (id, label, vector) that take part."""
    lists = batch.column(2)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * float(scale))
    q = np.zeros((len(batch), dim))
    q[np.arange(dim) < lengths[:, None]] = values
    good = (np.abs(q) <= isqrt(np.iinfo(np.int64).max // max(dim, 1))).all(axis=1)  # nan and infinity fail as well
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False)[good] for k in (0, 1))
    return ids, labels, q[good].astype(np.int64)


@dataclass
class Rotation:
    """An orthogonal matrix, columns by falling weight, and how far rounded products may be off, as a part of the norms' product."""

    matrix: np.ndarray
    slack: float

    @classmethod
    def fit(cls, q: np.ndarray, dim: int) -> Rotation:
        x = q.astype(float)
        _, vectors = np.linalg.eigh(x.T @ x)  # products aren't centred, so neither are the components
        r = np.ascontiguousarray(vectors[:, ::-1])
        eps = np.finfo(float).eps
        # each rotated component is a sum of dim rounded products; products of two of them sum dim more; r is orthogonal but for ``off``
        off = float(np.linalg.norm(r.T @ r - np.eye(dim)) + np.linalg.norm(r @ r.T - np.eye(dim)))
        return cls(r, 16 * dim**1.5 * eps + 2 * off)

    def steps(self) -> list[int]:
        dim = len(self.matrix)
        return sorted({max(1, dim // s) for s in STEPS})


class Turned:
    """Rotated vectors with their residual norms after each step."""

    def __init__(self, q: np.ndarray, rotation: Rotation):
        self.q, self.cuts = q, rotation.steps()
        self.u = q @ rotation.matrix
        squares = np.cumsum(self.u[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, k]) if k < self.u.shape[1] else np.zeros(len(q)) for k in self.cuts]
        self.norm = np.sqrt((self.u**2).sum(axis=1))


def survivors(rows: Turned, anchors: Turned, own: np.ndarray, to: np.ndarray, least: np.ndarray, most: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``own`` rows and ``to`` anchors whose score may lie from the anchor's ``least`` to its ``most``."""
    i, j, done = own, to, 0
    total = np.zeros((len(i), len(j)))
    pairs = None
    for step, cut in enumerate(rows.cuts):
        if pairs is None:
            total = total + rows.u[i, done:cut] @ anchors.u[j, done:cut].T
            margin = np.outer(rows.rest[step][i], anchors.rest[step][j]) + slack * np.outer(rows.norm[i], anchors.norm[j])
            may = (total + margin >= least[j]) & (total - margin <= most[j])
            keep = may.any(axis=1)
            i, total, may = i[keep], total[keep], may[keep]
            if may.mean() < SPARSE if may.size else True:
                a, b = np.nonzero(may)
                pairs, total = (i[a], j[b]), total[a, b]
        else:
            a, b = pairs
            total = total + np.einsum("ij,ij->i", rows.u[a, done:cut], anchors.u[b, done:cut])
            margin = rows.rest[step][a] * anchors.rest[step][b] + slack * rows.norm[a] * anchors.norm[b]
            may = (total + margin >= least[b]) & (total - margin <= most[b])
            pairs, total = (a[may], b[may]), total[may]
        done = cut
    if pairs is None:
        a, b = np.nonzero(may)
        pairs = i[a], j[b]
    return pairs


def products(rows: Turned, anchors: Turned, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The pairs' integer scores."""
    a, b = pairs
    out, each = np.empty(len(a), np.int64), max(1, (1 << 20) // max(rows.q.shape[1], 1))
    for k in range(0, len(a), each):
        out[k : k + each] = np.einsum("ij,ij->i", rows.q[a[k : k + each]], anchors.q[b[k : k + each]])
    return out


class Lists:
    """The first ``most`` (score, id) of each slot, best scores first, then least ids."""

    def __init__(self, slots: int, most: int):
        self.scores, self.ids, self.most = np.full((slots, most), NONE), np.zeros((slots, most), np.int64), most

    @property
    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.last[slot]
        slot, score, ids = slot[keep], score[keep], ids[keep]
        if not len(slot):
            return
        touched = np.unique(slot)
        held = self.scores[touched] != NONE
        old = np.repeat(touched, held.sum(axis=1))
        slot, score, ids = np.r_[old, slot], np.r_[self.scores[touched][held], score], np.r_[self.ids[touched][held], ids]
        order = np.lexsort((-score, ids, slot))  # of an id's scores the best
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.r_[True, (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1])]
        slot, score, ids = slot[first], score[first], ids[first]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = rank < self.most
        self.scores[touched], self.ids[touched] = NONE, 0
        self.scores[slot[kept], rank[kept]], self.ids[slot[kept], rank[kept]] = score[kept], ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, k = np.nonzero(self.scores != NONE)
        return slot, self.ids[slot, k], self.scores[slot, k]


def tiles(batches: Iterator[pa.RecordBatch], dim: int, scale: int, alike: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A task's rows in tiles that double; of rows alike in label and vector, a tile keeps the ``alike`` ids that come first, more of which no list takes."""
    size = FIRST
    for batch in sliced(batches, max(64, min(TILE, (1 << 20) // max(dim, 1)))):
        ids, labels, q = fixed_point(batch, dim, scale)
        at = 0
        while at < len(ids):
            part = slice(at, at + size)
            at, size = at + size, min(size * 2, TILE)
            i, y, v = ids[part], labels[part], q[part]
            _, kind = np.unique(np.ascontiguousarray(np.c_[y, v]).view(np.dtype((np.void, 8 * (dim + 1)))).ravel(), return_inverse=True)
            order = np.lexsort((i, kind))
            i, y, v, kind = i[order], y[order], v[order], kind[order]
            once = np.r_[True, (kind[1:] != kind[:-1]) | (i[1:] != i[:-1])]
            i, y, v, kind = i[once], y[once], v[once], kind[once]
            starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            near = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < alike
            yield i[near], y[near], v[near]


def _across(n: int) -> Iterator[np.ndarray]:
    for k in range(0, n, ACROSS):
        yield np.arange(k, min(n, k + ACROSS))


def _groups(labels: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(labels, kind="stable")
    values, starts = np.unique(labels[order], return_index=True)
    return {int(v): g for v, g in zip(values, np.split(order, starts[1:]), strict=True)} if len(labels) else {}


def positives_of(batches: Iterator[pa.RecordBatch], ids, labels, q, rotation: Rotation, most: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor's label, of those that this task sees."""
    dim, anchors, best = q.shape[1], Turned(q, rotation), Lists(len(ids), most)
    by_label = _groups(labels)
    for i, y, v in tiles(batches, dim, scale, most + 1):  # one may be the anchor itself
        rows, no_end = Turned(v, rotation), np.full(len(ids), np.inf)
        for label, own in _groups(y).items():
            to = by_label.get(label, np.empty(0, np.int64))
            for part in _across(len(to)):
                a, b = survivors(rows, anchors, own, to[part], best.last.astype(float), no_end, rotation.slack)
                other = i[a] != ids[b]
                a, b = a[other], b[other]
                best.add(b, products(rows, anchors, (a, b)), i[a])
    slot, found, score = best.rows()
    yield pa.RecordBatch.from_arrays([pa.array(ids[slot]), pa.array(found), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])
    give_back()


def negatives_of(batches: Iterator[pa.RecordBatch], ids, labels, q, rotation: Rotation, found: np.ndarray, bounds: np.ndarray, most: int, scale: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The best rows of other labels in the window of each anchor's positives (``found`` ids and ``bounds`` scores, NONE where there is none)."""
    dim, anchors, wide = q.shape[1], Turned(q, rotation), bounds.shape[1]
    there = bounds != NONE
    safe = np.where(there, bounds, 0)
    # low * p <= 100 * s <= high * p, in Python's integers as products may leave 64 bits
    least = np.array([[-(-low * int(p) // 100) for p in r] for r in safe], dtype=object).reshape(bounds.shape)
    top = np.array([[high * int(p) // 100 for p in r] for r in safe], dtype=object).reshape(bounds.shape)
    open_ = there & (least <= top).astype(bool)
    least, top = np.where(open_, least, 0).astype(np.int64), np.where(open_, top, 0).astype(np.int64)
    best = [Lists(len(ids), most) for _ in range(wide)]
    used = open_.any(axis=1)
    ceiling = np.where(open_, top.astype(float), -np.inf).max(axis=1, initial=-np.inf)
    for i, y, v in tiles(batches, dim, scale, most):
        rows = Turned(v, rotation)
        floor = np.min([np.where(open_[:, k], np.maximum(least[:, k], best[k].last).astype(float), np.inf) for k in range(wide)], axis=0)
        for part in _across(len(ids)):
            part = part[used[part]]
            if not len(part):
                continue
            a, b = survivors(rows, anchors, np.arange(len(i)), part, floor, ceiling, rotation.slack)
            other = y[a] != labels[b]
            a, b = a[other], b[other]
            score = products(rows, anchors, (a, b))
            for k in range(wide):
                fits = open_[b, k] & (score >= least[b, k]) & (score <= top[b, k])
                best[k].add(b[fits], score[fits], i[a[fits]])
    out = [(ids[s], found[s, k], bounds[s, k], n, x) for k in range(wide) for s, n, x in [best[k].rows()]]
    columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in NEGATIVES.split(", ")])
    give_back()


def _best(rows: DataFrame, by: list[str], found: str, score: str, most: int) -> DataFrame:
    """The first of the tasks' lists: an id once, by score and id, with rank."""
    once = rows.groupBy(*by, found).agg(F.max(score).alias(score))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), found))).where(F.col("rank") <= most)


def _stacked(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = pa.chunked_array([c.flatten() for c in lists.chunks], pa.int64()).to_numpy() if lists.num_chunks else np.empty(0, np.int64)
    return values.reshape(-1, dim)


def mine(
    vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that ``anchor`` names.

    ``label`` may replace the label column. Negatives have scores from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(column(id_col).cast("long").alias("id"), (column(label_col) if label is None else label).cast("long").alias("label"), column(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    plain = rows.select("id", "label", "vector")

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max(64, (1 << 20) // max(dim, 1))):
            i, y, q = fixed_point(batch, dim, scale)
            ends = pa.array(np.arange(0, q.size + 1, dim or 1, dtype=np.int32)[: len(q) + 1]) if dim else pa.array(np.zeros(len(q) + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(y), pa.ListArray.from_arrays(ends, pa.array(q.ravel()))], names=["id", "label", "q"])

    if not dim:
        return _no_rows(spark) if rows.where("_anchor").isEmpty() else _mined_in_chunks(spark, plain, rows, fixed, 0, positives, negatives, low, high, scale, chunk)
    return _mined_in_chunks(spark, plain, rows, fixed, dim, positives, negatives, low, high, scale, chunk)


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def _mined_in_chunks(spark, plain, rows, fixed, dim, positives, negatives, low, high, scale, chunk) -> DataFrame:
    sample = plain.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(fixed, VECTORS).select("q").toArrow()
    rotation = Rotation.fit(_stacked(sample.column(0), dim), dim) if dim else Rotation(np.zeros((0, 0)), 0.0)
    first = Window.partitionBy("id").orderBy("label", "q")
    anchors = rows.where("_anchor").select("id", "label", "vector").mapInArrow(fixed, VECTORS)
    anchors = stage(anchors.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k"), "anchors")
    chunks = -(-anchors.count() * max(dim, 1) // chunk)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for c in range(chunks):
        some = anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).orderBy("id").toArrow()
        if some.num_rows:
            ids, labels = (some.column(k).to_numpy() for k in (0, 1))
            _mine_chunk(spark, plain, ids, labels, _stacked(some.column(2), dim) if dim else np.zeros((len(ids), 0), np.int64), rotation, positives, negatives, low, high, scale).write.mode("append").parquet(path)
    discard(anchors)
    return spark.read.schema(RESULT).parquet(path) if chunks else _no_rows(spark)


def _mine_chunk(spark, plain, ids, labels, q, rotation, positives, negatives, low, high, scale) -> DataFrame:
    """The lists of one chunk's anchors, in two passes over all rows."""
    sent = spark.sparkContext.broadcast((ids, labels, q, rotation))  # at most CHUNK components
    near = plain.mapInArrow(lambda batches: positives_of(batches, *sent.value, positives, scale), POSITIVES)
    near = _best(near, ["anchor_id"], "positive_id", "positive_score", positives).toArrow()  # at most so many for each anchor of the chunk
    found, bounds = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), NONE)
    slot, rank = np.searchsorted(ids, near["anchor_id"].to_numpy()), near["rank"].to_numpy() - 1
    found[slot, rank], bounds[slot, rank] = near["positive_id"].to_numpy(), near["positive_score"].to_numpy()
    lists = spark.sparkContext.broadcast((found, bounds))
    far = plain.mapInArrow(lambda batches: negatives_of(batches, *sent.value, *lists.value, negatives, scale, low, high), NEGATIVES)
    best = _best(far, ["anchor_id", "positive_id", "positive_score"], "negative_id", "negative_score", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
