"""How filters overlap: what each removes, in every order of five, from the survivors of every subset.

Each row's five failure flags are plain columns; equal texts are found by digest and counted, not joined in
pairs. What is left is a table of counts by part and flags (at most 128 rows a part), over which SQL's CUBE
runs: of its grouping sets, those rows whose selected flags are all false count the survivors of that subset
of filters. A step of an order leads from one subset to another with one filter more, so all its figures come
from two rows of survivors, which two joins fetch.

Defined results: a null text counts as empty, a null language as the part ``''``; empty texts fail A, and E if
an earlier row is empty too. Rows with equal ids don't copy one another, and a row without an id copies none and
is copied by none; each repeated row counts. Labels that repeat an id count where any of them says so. An empty
table gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stage, whole_text, words_of

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
# The filters' bounds.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails A to D, each a plain column."""
    words = words_of(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < MIN_WORDS, "B": F.lit(100) * distinct < F.lit(MIN_DISTINCT) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(MAX_CAPITALS).cast("long") * F.length(text), "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether the row fails), good, toxic and n: how many rows are so.

    One shuffle by id brings the labels; another by digest and flags finds each text's least id. Rows of one text
    are summed up in every task before that, so a text that a third of all rows share is a handful of rows.
    """
    text = whole_text(column("text"))
    source = docs.select(column("doc_id").alias("doc_id"), F.coalesce(column("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = source.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *(v.alias(k) for k, v in text_flags(F.col("text")).items()))
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ("digest", *FILTERS[:4], "part", "good", "toxic")
    once = rows.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    alike = once.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"),
    )
    # rows of one digest are now as many as its parts and labels
    alike = alike.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    alike = alike.withColumn("alone", F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.coalesce("nameless", F.lit(0)))
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("alone").alias("k")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("k")))
    counts = alike.select(*kinds[1:], F.explode(both).alias("x"))
    return counts.where("x.k > 0").groupBy("part", *FILTERS[:4], F.col("x.E").alias("E"), "good", "toxic").agg(F.sum("x.k").alias("n"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, chosen (bits of the filters) and the rows, good and toxic rows that pass all chosen, with zeros: 32 rows a part."""
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    cube = counts.withColumnRenamed("part", "_part").cube(*FILTERS, "_part").agg(*sums, *(F.grouping(f).alias(f"_{f}") for f in FILTERS), F.grouping("_part").alias("_all"))
    chosen, failed = F.lit(0), F.lit(False)
    for i, f in enumerate(FILTERS):
        chosen, failed = chosen + (1 - F.col(f"_{f}").cast("int")) * (1 << i), failed | F.coalesce(F.col(f), F.lit(False))
    found = cube.where((F.col("_all") == 0) & ~failed).select(F.col("_part").alias("part"), chosen.alias("chosen"), "n", "good", "toxic")
    # a subset that nothing survives has no row in the cube
    grid = found.where("chosen = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("chosen"))
    return grid.join(found, ["part", "chosen"], "left").fillna(0, ["n", "good", "toxic"])


def steps(counts: DataFrame) -> DataFrame:
    """One row per part, order and step: what the step's filter removes there, and what it does whatever the order."""
    spark = counts.sparkSession
    left = survivors(counts)
    subsets = [(s, i) for s in range(ALL + 1) for i in range(len(FILTERS)) if not s >> i & 1]
    # an edge of the lattice: a subset and one filter more; among all orders it is met so often
    edges = spark.createDataFrame([(s, s | 1 << i, FILTERS[i], factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1"))) for s, i in subsets], "before int, after int, filter string, orders int")
    of = lambda p: left.select("part", F.col("chosen").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "good", "toxic")))
    e = of("before").join(F.broadcast(edges), "before").join(of("after"), ["part", "after"])  # 80 edges
    removed = F.col("before_n") - F.col("after_n")
    per = e.groupBy("part", "filter").agg(
        F.sum(removed * F.col("orders")).alias("shapley"), F.sum(F.when(F.col("before") == 0, removed)).alias("failing"),
        F.sum(F.when(F.col("after") == ALL, removed)).alias("unique_fails"),
    )
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = [("".join(p), k + 1, p[k], sum(bit[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    plan = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    out = e.join(F.broadcast(plan), ["filter", "before"]).join(per, ["part", "filter"])  # 600 steps
    return out.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails",
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of ``documents`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic). The counts are staged: all that follows reads them, not the texts."""
    return steps(stage(flagged(docs, labels), "filter-counts"))
