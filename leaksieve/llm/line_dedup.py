"""Line deduplication by common blocks of lines.

A line is deleted if it lies in a block that an earlier document holds too: neighbouring lines of
``MIN_WORDS`` words or more in all, wherever they stand in either document and however often.

1. Lines are hashed after white space is evened out. From each line on, and back from each line, the
   shortest run of neighbours with words enough is a window. Every line of a block lies in a window inside
   it, so windows find all of a block, one of short lines too.
2. The earliest document with a window is its keeper. Documents that share a rare window, one of at most
   ``RARE`` holders, overlap: each is paired with the window's keeper, so pairs grow with the lines and
   never with the square of a group.
3. A pair's line lists, from the first to the last window they share, are aligned by patience diff. Where it
   leaves a shared window out, because one order can't hold a block that moved or repeats, what is left of
   the document is aligned once more, against the place where the keeper has it.
4. Windows of more holders name pairs only where the rare ones left them: a document that still has such a
   window is paired with its keeper and aligned in the same way. So no frequency is cut off.
5. Aligned blocks are deleted from the later document. A line's earliest holder keeps it, as no earlier
   document holds a window around it: of every deleted line one copy stays.

A window pairs documents by one 64-bit hash and is deleted only if lines of another, independent 64-bit hash
align over all of it; texts themselves aren't compared. A keeper of very many documents is copied by
``SALTS``, so that its pairs are spread over tasks.

Defined results: a null or empty text has one empty line, which is never deleted; earlier means the
smaller id, a null id comes last, and of equal ids the one read first. Repeated rows are documents of
their own. Lines that only their own document repeats stay. An empty table gives no rows. Other columns
are kept by ``drop_repeated_lines`` and never looked at.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stage

MIN_WORDS = 5
#: Documents that hold a window at most for it to be rare.
RARE = 16
#: Parts over which the pairs of one keeper are spread.
SALTS = 64
LAST = (1 << 63) - 1
#: Hashes of runs of lines: a polynomial in this base, modulo a prime.
BASE, PRIME = 0x1B873593CC9E2D51, (1 << 61) - 1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hashes(text: bytes | None) -> tuple[list[int], list[int], list[int]]:
    """Of each line the hash of its words (signed, 64 bits), their number, and a second hash of them."""
    hashes, words, marks = [], [], []
    for line in (text or b"").split(b"\n"):
        w = line.split()
        plain = b" ".join(w)
        hashes.append(_signed(xxhash.xxh64_intdigest(plain)))
        words.append(len(w))
        marks.append(_signed(xxhash.xxh3_64_intdigest(plain, 1)))
    return hashes, words, marks


def spans(words: list[int]) -> list[tuple[int, int]]:
    """First places and ends of the shortest runs with words enough, from each line on and back from each line."""
    found, end, total = set(), 0, 0
    for first in range(len(words)):
        while end < len(words) and total < MIN_WORDS:
            total += words[end]
            end += 1
        if total < MIN_WORDS:
            break
        found.add((first, end))
        total -= words[first]
    first = total = 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= MIN_WORDS:
            total -= words[first]
            first += 1
        if total >= MIN_WORDS:
            found.add((first, last + 1))
    return sorted(found)


def windows(text: bytes | None) -> tuple[list[int], list[int], list[int], list[int], list[bool]]:
    """The second hashes of a text's lines; of each window its key (signed, 64 bits), first place, end, and whether the text holds it for the first time."""
    hashes, words, marks = line_hashes(text)
    places = spans(words)
    keys, sums = [], []
    for i, j in places:
        if j == i + 1:
            keys.append(hashes[i])
            continue
        sums = sums or list(accumulate(hashes, lambda s, h: (s * BASE + h) % PRIME, initial=0))
        run = (sums[j] - sums[i] * pow(BASE, j - i, PRIME)) % PRIME
        keys.append(_signed(xxhash.xxh64_intdigest(struct.pack("<4q", j - i, hashes[i], hashes[j - 1], run))))
    met: set[int] = set()
    fresh = [not (k in met or met.add(k)) for k in keys]
    return marks, keys, [i for i, _ in places], [j for _, j in places], fresh


def covered(places: list[dict]) -> list[int]:
    """The places of lines that lie in any of these runs, ascending."""
    out, at = [], 0
    for first, end in sorted((p["first"], p["end"]) for p in places):
        out.extend(range(max(first, at), end))
        at = max(at, end)
    return out


def _matches(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, cut down to the longest run that increases in both. Without any, the least frequent common line in its order."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    pairs = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
    if not pairs:
        line = min((x for x in in_a if x in in_b), key=lambda x: in_a[x] * in_b[x], default=None)
        return list(zip((i for i in range(a0, a1) if a[i] == line), (j for j in range(b0, b1) if b[j] == line), strict=False))
    ends: list[int] = []  # of increasing runs by length: the least last place in b
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
            at.append(n)
        else:
            ends[k], at[k] = j, n
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists of line hashes, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        matched = _matches(a, b, a0, a1, b0, b1)
        if not matched:
            continue
        ends = [(a0 - 1, b0 - 1), *matched, (a1, b1)]
        found.extend(matched)
        todo.extend((i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(ends, ends[1:], strict=False))
    return sorted(found)


def common_blocks(a: list[int], b: list[int], align: Callable = patience) -> list[tuple[int, int, int]]:
    """Runs of aligned lines that are neighbours in both: first places and length."""
    blocks: list[list[int]] = []
    for i, j in align(a, b):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def deleted_lines(own: list[int], words: list[int], other: list[int]) -> list[int]:
    """Places in a document that lie in large enough blocks common with an earlier one, by one diff."""
    return [k for i, _, n in common_blocks(own, other) if sum(words[i : i + n]) >= MIN_WORDS for k in range(i, i + n)]


def _inside(shared: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]]) -> tuple[list, list]:
    """The shared windows (ascending) that lie in one of the blocks, and the others."""
    firsts = [i for i, _, _ in blocks]
    found, left = [], []
    for w in shared:
        k = bisect_right(firsts, w[0]) - 1
        (found if k >= 0 and w[1] <= blocks[k][0] + blocks[k][2] else left).append(w)
    return found, left


def aligned_blocks(own: list[int], other: list[int], shared: list[tuple[int, int, int]], align: Callable = patience) -> list[tuple[int, int]]:
    """First places and ends, in the later document, of what aligning finds of the windows shared with its keeper (place, end, the keeper's place)."""
    found, left = _inside(sorted(shared), common_blocks(own, other, align))
    left.sort(key=lambda w: (w[2] - w[0], w[0]))
    at = 0
    while at < len(left):  # windows that overlap at one distance are one range
        step, start, end = left[at][2] - left[at][0], left[at][0], left[at][1]
        to = at + 1
        while to < len(left) and left[to][2] - left[to][0] == step and left[to][0] <= end:
            end = max(end, left[to][1])
            to += 1
        blocks = [(i + start, j, n) for i, j, n in common_blocks(own[start:end], other[start + step : end + step], align)]
        found.extend(_inside(left[at:to], blocks)[0])
        at = to
    out: list[list[int]] = []
    for first, end, _ in sorted(found):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _lines(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """row (a number of its own), doc_id, the lines' second hashes as marks, windows as key, first, end and fresh, and the columns to keep in ``kept``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        for batch in batches:
            found = [windows(x.as_py()) for x in batch.column("_text")]
            arrays = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), *arrays, batch.column("_kept")], names=["row", "doc_id", "marks", "key", "first", "end", "fresh", "kept"])

    kept = F.struct(*(column(c).alias(f"c{n}") for n, c in enumerate(keep))) if keep else F.lit(0)
    source = docs.select(F.monotonically_increasing_id().alias("_row"), column(id_col).cast("long").alias("_id"), column(text_col).cast("binary").alias("_text"), kept.alias("_kept"))
    kept_type = source.schema["_kept"].dataType.simpleString()
    return stage(source.mapInArrow(split, f"row long, doc_id long, marks array<long>, key array<long>, first array<int>, end array<int>, fresh array<boolean>, kept {kept_type}"), "lines")


def _shared(lines: DataFrame) -> DataFrame:
    """The windows of documents that aren't their keepers: row, first, end, keeper, place (the keeper's), holders."""
    each = lines.select("row", "doc_id", F.explode(F.arrays_zip("key", "first", "end", "fresh")).alias("x")).select("row", "doc_id", "x.*")
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("row").alias("row"), F.col("first").alias("place"))
    held = each.groupBy("key").agg(F.min(order).alias("keeper"), F.sum(F.col("fresh").cast("long")).alias("holders"))
    held = stage(held.where("holders > 1").select("key", F.col("keeper.row").alias("keeper"), F.col("keeper.place").alias("place"), "holders"), "keepers")  # read anew, so that a join skewed by a common line can be split
    return stage(each.select("row", "key", "first", "end").join(held, "key").where("row != keeper").drop("key"), "shared")


def _aligned(shared: DataFrame, lines: DataFrame) -> DataFrame:
    """row, first, end of the blocks that the pairs named by these windows align."""
    pairs = shared.groupBy("row", "keeper").agg(
        F.collect_list(F.struct("first", "end", "place")).alias("shared"),  # no more than the row's own windows
        F.min("first").alias("own_from"), F.max("end").alias("own_to"), F.min("place").alias("from"), F.max(F.expr("place + end - first")).alias("to"),
    ).withColumn("salt", F.pmod("row", F.lit(SALTS)))
    keepers = pairs.select("keeper", "salt").distinct().join(lines.select(F.col("row").alias("keeper"), F.col("marks").alias("theirs")), "keeper")
    both = pairs.join(keepers, ["keeper", "salt"]).withColumn("other", F.expr("slice(theirs, from + 1, to - from)")).drop("theirs")
    both = both.join(lines.select("row", "marks"), "row").withColumn("own", F.expr("slice(marks, own_from + 1, own_to - own_from)"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, ends = [], [], []
            for k, row in enumerate(batch.column("row").to_pylist()):
                own_from, other_from = batch.column("own_from")[k].as_py(), batch.column("from")[k].as_py()
                windows = [(w["first"] - own_from, w["end"] - own_from, w["place"] - other_from) for w in batch.column("shared")[k].as_py()]
                for first, end in aligned_blocks(batch.column("own")[k].as_py(), batch.column("other")[k].as_py(), windows):
                    rows.append(row)
                    firsts.append(first + own_from)
                    ends.append(end + own_from)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())], names=["row", "first", "end"])

    return both.select("row", "own_from", "from", "shared", "own", "other").mapInArrow(align, "row long, first int, end int")


def _deletions(lines: DataFrame) -> DataFrame:
    """row, deleted (places of lines) of the documents that lose lines."""
    shared = _shared(lines)
    blocks = F.collect_list(F.struct("first", "end")).alias("gone")
    rare = stage(_aligned(shared.where(F.col("holders") <= RARE), lines).groupBy("row").agg(blocks), "aligned")
    common = shared.where(F.col("holders") > RARE).join(rare, "row", "left")
    common = common.where("gone is null or not exists(gone, g -> g.first <= first and end <= g.end)")
    gone = rare.select("row", F.explode("gone").alias("g")).select("row", "g.*").unionByName(_aligned(common, lines)).groupBy("row").agg(blocks)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [covered(x.as_py()) for x in batch.column("gone")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int32()))], names=["row", "deleted"])

    return gone.mapInArrow(places, "row long, deleted array<int>")


def label_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted, deleted (places from 0, comma-joined)."""
    lines = _lines(docs, id_col, text_col, [])
    out = lines.select("row", "doc_id", F.size("marks").cast("long").alias("n_lines")).join(_deletions(lines), "row", "left")
    deleted = F.coalesce("deleted", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(deleted).cast("long").alias("n_deleted"), F.array_join(deleted.cast("array<string>"), ",").alias("deleted"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the deleted lines; a null text stays null."""
    lines = _lines(docs, id_col, text_col, docs.columns)
    out = lines.select("row", "kept").join(_deletions(lines), "row", "left")
    text = F.col("kept")[f"c{docs.columns.index(text_col)}"]
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("deleted"), i)), "\n")
    return out.select(*(F.when(F.col("deleted").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col("kept")[f"c{n}"].alias(c) for n, c in enumerate(docs.columns)))
