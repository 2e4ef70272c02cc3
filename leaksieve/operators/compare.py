"""The lines that one state of a tree adds to another, by an exact line diff of each changed file.

Files that are equal in both states are told by their digests, so only digests move for them. A changed file's two
texts meet in a join by path, and its lines are compared in the task that holds them: what both states have in
front and at the end is set aside, lines that only one state has can't be matched and are set aside too, and a
longest common subsequence of the rest is found with rows of the matrix held as the bits of one integer.

Defined results: a null text counts as empty; of rows with the same path in one state, the least text stands;
lines are equal with their line ends, so a last line with and without one differ; a file whose first 8,000
characters have a NUL is no text and adds nothing. Without an old state every line is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, is_excluded
from ..sources.lines import ALLOW, EXCLUDE_DIRS, EXCLUDE_FILES, SKIP_FILE

#: Characters in which a NUL tells a file that is no text.
LOOKED_AT = 8000


def text_lines(text: str) -> list[str]:
    """A text's lines with their ends; a text's end starts no line."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class Places:
    """The places of each value in a text, as the bits of an integer. Only frequent values' bits are kept: all would grow with the square of the text."""

    def __init__(self, b: list[int]):
        self.width, self.at, self.kept = len(b), {}, {}
        for k, x in enumerate(b):
            self.at.setdefault(x, []).append(k)

    def bits(self, x: int) -> int:
        at = self.at.get(x, ())
        if len(at) < 4:
            return sum(1 << k for k in at)
        if x in self.kept:
            return self.kept[x]
        found = bytearray(self.width // 8 + 1)
        for k in at:
            found[k >> 3] |= 1 << (k & 7)
        out = int.from_bytes(found, "little")
        if len(at) * 64 > self.width:
            self.kept[x] = out
        return out


def _last_row(a: list[int], b: list[int]) -> int:
    """The last row of the matrix of common subsequences as bits: a 0 wherever one more place of ``b`` gains a match."""
    full, places = (1 << len(b)) - 1, Places(b)
    row = full
    for x in a:
        hit = row & places.bits(x)
        row = ((row + hit) | (row - hit)) & full
    return row


def _gains(row: int, width: int) -> list[int]:
    """Matches of the first 0, 1, 2, … places, from a row's bits."""
    out, n = [0], 0
    for bit in bin(row | 1 << width)[:2:-1]:
        n += bit == "0"
        out.append(n)
    return out


def _matched(a: list[int], b: list[int], at: int, out: list[int]) -> None:
    """Append the places of ``b``, counted from ``at``, of a longest common subsequence: halves of ``a`` tell where to part ``b``."""
    todo = [(a, b, at)]
    while todo:
        a, b, at = todo.pop()
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        out += range(at, at + same)
        a, b, at = a[same:], b[same:], at + same
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0] in b:
                out.append(at + b.index(a[0]))
            continue
        half, n = len(a) // 2, len(b)
        front = _gains(_last_row(a[:half], b), n)
        back = _gains(_last_row(a[: half - 1 : -1], b[::-1]), n)
        cut = max(range(n + 1), key=lambda k: (front[k] + back[n - k], -k))
        todo += [(a[half:], b[cut:], at + cut), (a[:half], b[:cut], at)]


def added_places(old: list[str], new: list[str]) -> list[int]:
    """The places, from 0, of ``new``'s lines outside one longest common subsequence with ``old``."""
    first = 0
    while first < min(len(old), len(new)) and old[first] == new[first]:
        first += 1
    last = 0
    while last < min(len(old), len(new)) - first and old[-1 - last] == new[-1 - last]:
        last += 1
    old, middle = old[first : len(old) - last], new[first : len(new) - last]
    both = {x: k for k, x in enumerate(set(old) & set(middle))}
    a = [both[x] for x in old if x in both]
    kept = [(k, both[x]) for k, x in enumerate(middle) if x in both]
    found: list[int] = []
    _matched(a, [x for _, x in kept], 0, found)
    stays = {kept[k][0] for k in found}
    return [first + k for k in range(len(middle)) if k not in stays]


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old, new of the files whose text differs, or that only ``new`` has (old is null). Texts of others don't move."""
    digests = lambda d: d.groupBy("path").agg(F.min(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), F.count(F.lit(1)).alias("n"))
    was = digests(old).select("path", F.col("digest").alias("old_digest"), F.col("n").alias("old_n"))
    # where a path is repeated, the texts themselves decide
    paths = digests(new).join(was, "path", "left").where("old_digest is null or digest <> old_digest or n > 1 or old_n > 1").select("path")
    texts = lambda d, name: d.join(paths, "path", "left_semi").groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias(name))
    both = texts(new, "new").join(texts(old, "old"), "path", "left")
    return both.where("old is null or old <> new").select("path", "old", "new")


def added_between(old: DataFrame | None, new: DataFrame, exclude_dirs=EXCLUDE_DIRS, exclude_files=EXCLUDE_FILES, unit: str = "range") -> DataFrame:
    """unit_id, file, ext, line_no, text of the lines that ``new`` (path, text) adds to ``old``, markers and excluded paths left out as in a diff."""
    kept = lambda d: d.where(~is_excluded(F.col("path"), exclude_dirs, exclude_files)).select("path", "text")
    if old is None:
        both = kept(new).groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias("new")).withColumn("old", F.lit(None).cast("string"))
    else:
        both = changed_files(kept(old), kept(new))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, old_text, text in zip(pdf["path"], pdf["old"], pdf["new"], strict=True):
                if "\0" in text[:LOOKED_AT] or "\0" in (old_text or "")[:LOOKED_AT]:
                    continue
                lines = text_lines(text)
                places = added_places(text_lines(old_text or ""), lines)
                rows.append((path, [(k + 1, lines[k].removesuffix("\n").removesuffix("\r")) for k in places]))
            yield pd.DataFrame(rows, columns=["path", "added"])

    added = both.select("path", "old", "new").mapInPandas(compare, "path string, added array<struct<line_no int, text string>>")
    whole = added.where(~F.exists("added", lambda x: x["text"].contains(SKIP_FILE)))
    d = whole.select(F.lit(unit).alias("unit_id"), F.col("path").alias("file"), extension(F.col("path")).alias("ext"), F.inline("added"))
    return d.where(~F.col("text").contains(ALLOW))
