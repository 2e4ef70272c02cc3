"""Unified diffs (no context) and commit logs to numbered added lines, by a scan over blocks of lines.

What a diff's line means depends on the lines before: the last file header, the last hunk's start, and the lines
since. A diff is cut into blocks, each of which is numbered by windows as if nothing stood before it; a block's
summary says how it would change what comes before (a header or not, a start or not, how many lines). Summaries
are few, and composed over a diff's blocks they tell each block what to go on from. So a diff of any length is
many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension, is_excluded, split_lines
from .lines import ALLOW, EXCLUDE_DIRS, EXCLUDE_FILES, SKIP_FILE

#: What stands before each commit in a log: sha and subject follow, NUL between.
COMMIT = "\x01commit\x01"
#: Lines of a block where a diff is a text in a row, as a power of two.
BLOCK = 16


def _units(texts: DataFrame, text_col: str, unit: Column | None) -> DataFrame:
    """unit_id and _text of diff texts."""
    if unit is None:
        # copies are alike: one of each with their number, counted in every task first, gives them all
        text = texts.select(F.col(text_col).alias("_text")).where("_text != ''")  # neither null nor empty texts have lines
        each = text.groupBy(F.sha2(F.col("_text").cast("binary"), 256).alias("_digest")).agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_n"))
        texts, text_col = each.select("_digest", "_text", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")), "_text"
        unit = F.when(F.col("_copy") > 1, F.concat_ws("-", "_digest", F.col("_copy").cast("string"))).otherwise(F.col("_digest"))
    return texts.select(F.coalesce(unit.cast("string"), F.lit("")).alias("unit_id"), F.col(text_col).alias("_text"))


def diff_rows(texts: DataFrame, text_col: str = "text", unit: Column | None = None) -> DataFrame:
    """unit_id, block, pos, text and split (whether the unit has several blocks) of each line of diff texts.

    Each text is a unit: ``unit`` (unique; null counts as empty), or else its digest and, from the second copy on, a number.
    """
    lines = split_lines(F.col("_text"))
    d = _units(texts, text_col, unit).select("unit_id", (F.size(lines) > 1 << BLOCK).alias("split"), F.posexplode(lines).alias("pos", "text"))
    return d.select("unit_id", F.shiftright("pos", BLOCK).cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "text", "split")


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """The same of diff files, read in splits: each file is a unit, named by its path, and each split a block."""
    m, lines = F.col("_metadata"), spark.read.option("lineSep", "\n").text(path, recursiveFileLookup=True)
    return lines.select(
        m["file_path"].alias("unit_id"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("text"),
        (m["file_block_length"] < m["file_size"]).alias("split"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with kind, name (a header's file), start (a hunk's) and skip (whether an added line has the marker): all that numbering needs of a text."""
    text = F.col("text")
    kind = F.when(text.startswith("+++ b/"), "file").when(text.startswith("@@ "), "hunk").when(text.startswith("+"), "added").when(text.startswith(" "), "context").otherwise("other")
    d = rows.withColumn("kind", kind)
    start = F.coalesce(F.regexp_extract("text", r"\+(\d*)", 1).try_cast("int"), F.lit(0))
    of = lambda k: F.col("kind") == k
    return d.withColumns({"name": F.when(of("file"), F.substring("text", 7, 1 << 30)), "start": F.when(of("hunk"), start), "skip": of("added") & text.contains(SKIP_FILE)})


def _within_blocks(marked: DataFrame) -> DataFrame:
    """Lines numbered as if each block stood alone.

    file: the last header's name; files, marks: headers, headers and hunks up to here; steps: lines that count up to here;
    base: what to add to them for the number; own_skip: whether a line of the same file within the block has the marker.
    """
    block = Window.partitionBy("unit_id", "block")
    w = block.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    d = marked.withColumns({
        "file": F.last("name", ignorenulls=True).over(w), "files": F.sum(of("file").cast("long")).over(w), "marks": F.sum(of("file", "hunk").cast("long")).over(w),
        "steps": F.sum(of("added", "context").cast("long")).over(w),
    })
    base = F.when(of("hunk"), F.col("start") - F.col("steps")).when(of("file"), -F.col("steps"))
    own = Window.partitionBy("unit_id", "block", "files")
    return d.withColumns({"base": F.last(base, ignorenulls=True).over(w), "own_skip": F.max("skip").over(own)})


def _carried(d: DataFrame) -> DataFrame:
    """unit_id, block and what the blocks before leave to it: a row for each block of ``_within_blocks``."""
    last = F.max_by(F.struct("file", "base"), "pos")
    s = d.groupBy("unit_id", "block").agg(
        F.max("files").alias("n_files"), F.max("marks").alias("n_marks"), F.max("steps").alias("n_steps"), last.alias("last"),
        F.max(F.when(F.col("files") == 0, F.col("skip"))).alias("skip_first"), F.max(F.struct("files", "skip"))["skip"].alias("skip_last"),
    )
    through = Window.partitionBy("unit_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("unit_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all_steps", F.sum("n_steps").over(through))
    reset = F.when(F.col("last.base").isNotNull(), F.col("last.base") + F.col("n_steps") - F.col("all_steps"))
    s = s.withColumns({
        "before_file": F.last("last.file", ignorenulls=True).over(before), "before_files": F.coalesce(F.sum("n_files").over(before), F.lit(0)), "before_marks": F.coalesce(F.sum("n_marks").over(before), F.lit(0)),
        "before_lines": F.coalesce(F.last(reset, ignorenulls=True).over(before), F.lit(0)) + F.col("all_steps") - F.col("n_steps"),
    })
    # a file that goes over a block's end has its marker anywhere: before a block's first header, behind its last, or in blocks between
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("before_files").alias("no"), F.coalesce("skip_first", F.lit(False)).alias("skip")), F.struct(F.lit(1).alias("end"), (F.col("before_files") + F.col("n_files")).alias("no"), F.coalesce("skip_last", F.lit(False)).alias("skip")))
    kept = ("before_file", "before_files", "before_marks", "before_lines", "n_files")
    e = s.select("unit_id", "block", *kept, F.explode(ends).alias("e")).withColumn("whole", F.max("e.skip").over(Window.partitionBy("unit_id", "e.no")))
    either = lambda n: F.max(F.when(F.col("e.end") == n, F.col("whole")))
    return e.groupBy("unit_id", "block", *kept).agg(either(0).alias("first_skipped"), either(1).alias("last_skipped"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (unit_id, pos, text; block and split where they are known) with file, file_no, hunk_no, kind, line_no and skipped."""
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.shiftright(F.col("pos").cast("long"), BLOCK))
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.lit(True))
    # of units of one block nothing is carried; summaries need no text
    carried = _carried(_within_blocks(_marked(rows.where("split")).select("unit_id", "block", "pos", "kind", "name", "start", "skip")))
    d = _within_blocks(_marked(rows)).join(carried, ["unit_id", "block"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    skipped = F.when(F.col("files") == 0, F.col("first_skipped")).when(F.col("files") == F.col("n_files"), F.col("last_skipped"))
    return d.withColumns({
        "line_no": (F.coalesce("base", "before_lines", F.lit(0)) + F.col("steps") - 1).cast("int"), "file": F.coalesce("file", "before_file"),
        "file_no": zero("before_files") + F.col("files"), "hunk_no": zero("before_marks") + F.col("marks"), "skipped": F.coalesce(skipped, "own_skip"),
    }).select(*rows.columns, "kind", "file", "file_no", "hunk_no", "line_no", "skipped")


def added_lines(rows: DataFrame, exclude_dirs=EXCLUDE_DIRS, exclude_files=EXCLUDE_FILES) -> DataFrame:
    """The lines that a diff adds. A deletion's ``+++ /dev/null`` reads as an added line, as it does in the format."""
    d = numbered(rows).where((F.col("kind") == "added") & F.col("file").isNotNull() & (F.col("file") != ""))
    d = d.where(~F.col("skipped") & ~F.col("text").contains(ALLOW) & ~is_excluded(F.col("file"), exclude_dirs, exclude_files))
    return d.select("unit_id", "file", extension(F.col("file")).alias("ext"), "line_no", F.substring("text", 2, 1 << 30).alias("text"))


#: Where, in a text, a file's part and a hunk begin.
FILE_START, HUNK_START = r"(?<=\n)(?=\+\+\+ b/)", r"(?<=\n)(?=@@ )"


def text_added_lines(texts: DataFrame, text_col: str = "text", unit: Column | None = None, exclude_dirs=EXCLUDE_DIRS, exclude_files=EXCLUDE_FILES) -> DataFrame:
    """``added_lines`` of diff texts that are each a row; units are those of ``diff_rows``.

    A text is cut into files, and these into hunks. A line's number is its hunk's start and the count of the
    hunk's counting lines before it, which is its place among them: nothing is shuffled or sorted.
    """
    part, hunk = F.col("part"), F.col("hunk")
    d = _units(texts, text_col, unit).select("unit_id", F.explode(F.split("_text", FILE_START, -1)).alias("part"))
    d = d.where(part.startswith("+++ b/") & ~(part.contains(SKIP_FILE) & part.rlike(rf"\n\+[^\n]*{SKIP_FILE}")))
    d = d.select("unit_id", F.regexp_extract(part, r"^\+\+\+ b/([^\n]*?)(?:\r?\n|\z)", 1).alias("file"), F.explode(F.split(part, HUNK_START, -1)).alias("hunk"))
    d = d.where((F.col("file") != "") & ~is_excluded(F.col("file"), exclude_dirs, exclude_files))
    start = F.when(hunk.startswith("@@ "), F.regexp_extract(hunk, r"^[^\n+]*\+(\d*)", 1).try_cast("int"))
    counting = F.filter(split_lines(hunk), lambda x: (x.startswith("+") | x.startswith(" ")) & ~x.startswith("+++ b/"))
    d = d.select("unit_id", "file", F.coalesce(start, F.lit(0)).cast("long").alias("start"), F.posexplode(counting).alias("pos", "text"))
    d = d.where(F.col("text").startswith("+") & ~F.col("text").contains(ALLOW))
    return d.select("unit_id", "file", extension(F.col("file")).alias("ext"), (F.col("start") + F.col("pos")).cast("int").alias("line_no"), F.substring("text", 2, 1 << 30).alias("text"))


def _commit(record: Column) -> list[Column]:
    """sha, subject and text of what follows a COMMIT."""
    head = F.substring_index(record, "\n", 1)
    return [F.substring_index(head, "\0", 1).alias("sha"), F.substring(head, F.locate("\0", head) + 1, F.length(head)).alias("subject"), F.substring(record, F.length(head) + 2, F.length(record)).alias("text")]


def commits(log: DataFrame, text_col: str = "text") -> DataFrame:
    """sha, subject, text of each commit in log texts that begin each with COMMIT, sha, NUL, subject."""
    each = log.select(F.explode(F.filter(F.split(text_col, COMMIT, -1), lambda x: x != "")).alias("c"))
    return each.select(*_commit(F.col("c")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, subject, text of each commit of log files of any size: a file is read in splits, and only a commit is a row."""
    return spark.read.option("lineSep", COMMIT).text(path, recursiveFileLookup=True).where("value != ''").select(*_commit(F.col("value")))


def commit_lines(commits: DataFrame, exclude_dirs=EXCLUDE_DIRS, exclude_files=EXCLUDE_FILES) -> DataFrame:
    """Added lines of each commit (sha, subject, text); the unit is the commit, as ``commit_unit`` writes it. Commits that add nothing leave."""
    return text_added_lines(commits, "text", commit_unit(F.col("sha"), F.col("subject")), exclude_dirs, exclude_files)


def commit_unit(sha: Column, subject: Column) -> Column:
    """A commit's name as a unit: its sha, NUL and subject, so that a finding needs no join to tell its commit."""
    return F.concat(F.coalesce(sha, F.lit("")), F.lit("\0"), F.coalesce(subject, F.lit("")))


def of_unit(unit: Column) -> tuple[Column, Column]:
    """sha and subject of a commit's unit."""
    sha = F.substring_index(unit, "\0", 1)
    return sha, F.substring(unit, F.length(sha) + 2, F.length(unit))


def history_lines(log: DataFrame, text_col: str = "text") -> DataFrame:
    """Added lines of each commit of log texts; the commit is the unit."""
    return commit_lines(commits(log, text_col)).withColumn("unit_id", of_unit(F.col("unit_id"))[0])
