"""Ignore files evaluated over paths: which files of a tree its own rules leave out.

A rule holds below the folder of its file. For every entry (a file, or a folder on the way to one) the last rule
that fits decides, those of deeper folders after those of higher ones; what lies in an ignored folder is ignored
whatever else fits. Entries meet the rules of the folders above them in a join by folder. A folder's rules are
one alternation first, which most entries fail: rows come sorted by folder, so it is compiled once for each; only
entries that pass meet the rules one by one.

Syntax: blank lines and those that begin with ``#`` are none; ``!`` takes back; a slash at the end means folders
only; one elsewhere ties a pattern to the rule's folder; ``*``, ``?`` and ``[…]`` stay within a name, ``**`` goes
over folders; a backslash takes a sign as it is, and keeps a blank at the end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.text import file_name, normalised_path, split_lines

IGNORE_FILE = ".gitignore"
RULE = StructType([StructField("pattern", StringType()), StructField("keeps", BooleanType()), StructField("folders", BooleanType())])


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """A bracket's class from ``at``, and where it ends; None where it isn't closed."""
    end = at + 1
    negated = glob[end : end + 1] in ("!", "^")
    end += negated
    first = end
    while end < len(glob) and (glob[end] != "]" or end == first):
        end += 2 if glob[end] == "\\" else 1
    if end >= len(glob):
        return None
    inside = re.sub(r"([\[&~^])", r"\\\1", glob[first:end].replace("\\]", "]").replace("]", "\\]"))
    return f"(?!/)[{'^' if negated else ''}{inside}]", end + 1


def rule_of(line: str) -> tuple[str, bool, bool] | None:
    """A line's rule: a pattern of whole paths below its folder, whether it takes back, and whether it is for folders only."""
    glob = line.removesuffix("\r")
    while glob.endswith(" ") and (len(glob) - len(glob[:-1].rstrip("\\")) - 1) % 2 == 0:
        glob = glob[:-1]
    if not glob or glob.startswith("#"):
        return None
    keeps = glob.startswith("!")
    glob = glob[1:] if keeps else glob
    folders = glob.endswith("/") and not glob.endswith("\\/")
    glob = glob.rstrip("/") if folders else glob
    tied = "/" in glob
    glob = glob.removeprefix("/")
    if not glob:
        return None
    out, at = "" if tied else "(?:.*/)?", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif glob[at:] == "**" and at and glob[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif c == "*":
            out, at = out + "[^/]*", at + len(glob[at:]) - len(glob[at:].lstrip("*"))
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and (found := _class(glob, at)):
            out, at = out + found[0], found[1]
        elif c == "[":
            return None  # a class that isn't closed fits nothing
        else:
            at += c == "\\" and at + 1 < len(glob)
            out, at = out + re.sub(r"([^\w/])", r"\\\1", glob[at], flags=re.A) if glob[at].isascii() else out + glob[at], at + 1
    return out, keeps, folders


@F.pandas_udf(RULE)
def _rules(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule_of(x) or (None, None, None) for x in lines], columns=["pattern", "keeps", "folders"])


def rules_of(ignore_files: DataFrame) -> DataFrame:
    """folder, line_no, pattern, keeps, folders of ``path, text`` rows of ignore files; the root folder is the empty text."""
    path = normalised_path(F.col("path"))
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    lines = ignore_files.select(folder.alias("folder"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    found = lines.where("line <> '' and not startswith(line, '#')").withColumn("rule", _rules("line"))
    return found.where("rule.pattern is not null").select("folder", "line_no", "rule.*")


def _above(path: Column) -> Column:
    """The folders above a path, from the root (the empty text) down."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_entries(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """entry: the files and folders on the way to ``paths`` (path) that the rule which decides ignores."""
    path = normalised_path(F.col("path"))
    files = paths.select(path.alias("entry"), F.lit(False).alias("folder"))
    folders = paths.select(F.explode(F.slice(_above(path), 2, 1 << 30)).alias("entry"), F.lit(True).alias("folder"))
    entries = files.unionByName(folders).distinct()
    below = F.when(F.col("home") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("home") + 2, F.length("entry")))
    tries = entries.select("entry", "folder", F.explode(_above(F.col("entry"))).alias("home")).withColumn("below", below)
    some = F.struct((F.size(F.split("folder", "/")) - (F.col("folder") == "").cast("int")).alias("depth"), "line_no", "keeps", "pattern", "folders")
    homes = rules.groupBy(F.col("folder").alias("home")).agg(F.collect_list(some).alias("rules"))  # the lines of one ignore file
    any_of = F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform("rules", lambda r: r["pattern"]), "|"), F.lit(")$"))
    homes = homes.withColumn("any", any_of)
    met = tries.join(homes.hint("merge"), "home").where("below rlike any")
    each = met.select("entry", "folder", "below", F.explode("rules").alias("r")).where("(folder or not r.folders) and below rlike concat('(?s)^(?:', r.pattern, ')$')")
    last = each.groupBy("entry").agg(F.max_by("r.keeps", F.struct("r.depth", "r.line_no")).alias("keeps"))
    return last.where("not keeps").select("entry")


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path: those of ``paths`` that are ignored themselves or lie in an ignored folder."""
    way = F.concat(F.slice(_above(F.col("n")), 2, 1 << 30), F.array("n"))
    ways = paths.select("path", normalised_path(F.col("path")).alias("n")).select("path", F.explode(way).alias("entry"))
    return ways.join(ignored_entries(paths, rules), "entry", "left_semi").select("path").distinct()


def without_ignored_files(files: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``files`` (path, text) less what the ignore files among them leave out. ``more`` (path, text) are ignore files that aren't among them."""
    own = files.where(file_name(normalised_path(F.col("path"))) == IGNORE_FILE).select("path", "text")
    rules = rules_of(own if more is None else own.unionByName(more.select("path", "text")))
    return files.join(ignored_paths(files.select("path"), rules), "path", "left_anti")
