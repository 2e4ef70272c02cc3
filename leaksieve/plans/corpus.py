"""A derived corpus of code lines from the key columns of the star tables, the same in Spark and in SQL.

``documents`` holds few leaks, so lines of every kind (tokens, passwords, links with credentials, cut
strings, placeholders, marked lines, clean ones) are made from hashed order keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import spread

EXTENSIONS = ("py", "env", "json", "yaml", "js", "lock")
#: Text templates by key modulo their number; {a:b} is that part of the key's hash, {A:b} in upper case.
TEMPLATES = (
    'api_key = "{1:40}"',
    'password = "{1:12}"',
    'url = "postgres://user:{1:10}@db.host/x"',
    'key = "AKIA{A1:8}" + "{A9:8}"',
    'token = "<{1:20}>"',
    'secret = "{1:40}"  # leaksieve:allow',
    "total = compute({1:6})",
    'host = "db-{1:4}.internal"',
    'token = "ghp_{1:40}" # and ghp_{21:36}',
    'session: "{1:8}Zq{9:8}Xw{17:8}Kj{25:8}Vb{33:8}Yt{41:6}RsLmNpQoGhTuEi-/+.~!@^&*("',
    'checksum: "{1:64}"',
    'client_secret = "{1:24}"; client_secret = "your-secret-goes-here"',
    'build = "1.2.{1:8}-rc.{9:8}+{17:10}"',
)


def _parts(template: str) -> list[tuple[str, str, int, int]]:
    """(literal, "", 0, 0) or ("", case, start, length)."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{(A?)(\d+):(\d+)\}", template):
        out += [(template[at : m.start()], "", 0, 0), ("", m[1] or "a", int(m[2]), int(m[3]))]
        at = m.end()
    return [p for p in [*out, (template[at:], "", 0, 0)] if p != ("", "", 0, 0)]


def _column(template: str, h: Column) -> Column:
    return F.concat(*(F.lit(s) if not case else (F.upper if case == "A" else lambda x: x)(F.substring(h, a, n)) for s, case, a, n in _parts(template)))


def template_column(templates: Sequence[str], key: Column, h: Column) -> Column:
    """The key's template with the parts of its hash filled in."""
    text = F.lit("")
    for i, t in enumerate(templates):
        text = F.when(key % len(templates) == i, _column(t, h)).otherwise(text)
    return text


def template_sql(templates: Sequence[str], key: str) -> str:
    part = lambda p: quoted(p[0]) if not p[1] else f"upper(substr(h, {p[2]}, {p[3]}))" if p[1] == "A" else f"substr(h, {p[2]}, {p[3]})"
    return f"CASE {key} % {len(templates)} " + " ".join(f"WHEN {i} THEN {' || '.join(map(part, _parts(t)))}" for i, t in enumerate(templates)) + " END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, file, ext, line_no, text and template of one line for each order."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    k, h = F.col("o_orderkey"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    text, ext = template_column(TEMPLATES, k, h), F.lit("")
    for i, e in enumerate(EXTENSIONS):
        ext = F.when(F.col("o_custkey") % len(EXTENSIONS) == i, e).otherwise(ext)
    d = o.select(F.concat(F.lit("u"), (F.col("o_custkey") % 100).cast("string")).alias("unit_id"), ext.alias("ext"), k.cast("int").alias("line_no"), F.explode(F.array(text)).alias("text"), (k % len(TEMPLATES)).cast("int").alias("template"), "o_custkey")
    # an explode, so that no test of the text is pushed below, where it would make the text again, and in the few tasks of a small file
    return d.select("unit_id", F.concat(F.lit("src/f"), F.col("o_custkey").cast("string"), F.lit("."), F.col("ext")).alias("file"), "ext", "line_no", "text", "template")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_sql() -> str:
    n, m = len(TEMPLATES), len(EXTENSIONS)
    exts = " ".join(f"WHEN {i} THEN {quoted(e)}" for i, e in enumerate(EXTENSIONS))
    return f"""SELECT unit_id, 'src/f' || o_custkey || '.' || ext AS file, ext, line_no, text, template FROM (
        SELECT 'u' || (o_custkey % 100) AS unit_id, CASE o_custkey % {m} {exts} END AS ext, CAST(o_orderkey AS INTEGER) AS line_no,
               {template_sql(TEMPLATES, "o_orderkey")} AS text, CAST(o_orderkey % {n} AS INTEGER) AS template, o_custkey
        FROM (SELECT *, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))"""
