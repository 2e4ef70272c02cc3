"""The scans a user starts from: texts, trees, diffs, histories and labelled corpora to routed findings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..operators import baseline, detect, metrics, route
from ..sources import diffs
from ..sources.lines import file_lines, snippet_lines
from ..sources.settings import Settings


def _reported(found: DataFrame, settings: Settings, known: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    out = route.routed(found, labels, settings.fallback)
    return route.in_order(baseline.suppress(out, known) if known is not None else out)


def scan_lines(lines: DataFrame, settings: Settings = Settings(), known: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """All layers over numbered lines, routed, less a baseline's findings, in the order of confidence."""
    return _reported(detect.scan_lines(lines, settings.rules, settings.sensitive_names, **settings.entropy()), settings, known, labels)


def scan_texts(docs: DataFrame, id_col: str, text_col: str, ext: str = "", settings: Settings = Settings(), **more) -> DataFrame:
    """Each row's text is a unit; markers in it aren't looked at."""
    return scan_lines(snippet_lines(docs, text_col, F.col(id_col), ext), settings, **more)


def scan_files(files: DataFrame, settings: Settings = Settings(), **more) -> DataFrame:
    """``path, text`` rows as one unit."""
    return scan_lines(file_lines(files, settings.exclude_dirs, settings.exclude_files), settings, **more)


def scan_diffs(texts: DataFrame, text_col: str = "text", settings: Settings = Settings(), id_col: str | None = None, **more) -> DataFrame:
    """Each row's diff is a unit, named by ``id_col`` (unique), or else by its text's digest."""
    lines = diffs.text_added_lines(texts, text_col, F.col(id_col) if id_col else None, settings.exclude_dirs, settings.exclude_files)
    return scan_lines(lines, settings, **more)


def scan_commits(commits: DataFrame, settings: Settings = Settings(), **more) -> DataFrame:
    """Findings of each commit (sha, subject, text), with sha and subject; a commit is a unit."""
    lines = diffs.commit_lines(commits, settings.exclude_dirs, settings.exclude_files)
    # a commit that names nothing sensitive binds nothing: its lines needn't meet
    naming = diffs.commit_lines(commits.where(detect.may_bind(F.col("text"), settings.sensitive_names)), settings.exclude_dirs, settings.exclude_files)
    found = detect.line_findings(lines, settings.rules, entropy=settings.entropy()).unionByName(detect.binding_findings(naming, settings.sensitive_names))
    sha, subject = diffs.of_unit(F.col("unit_id"))
    return _reported(found.withColumns({"sha": sha, "subject": subject, "unit_id": sha}), settings, **more)


def scan_history(log: DataFrame, text_col: str = "text", settings: Settings = Settings(), **more) -> DataFrame:
    """The same of the commits of log texts."""
    return scan_commits(diffs.commits(log, text_col), settings, **more)


def adjudicate(findings: DataFrame, classify: Callable[[str], str]) -> DataFrame:
    """Labels (route.KEY, label) of what is to be adjudicated: at most three snippets of a unit go to ``classify``, on the executors."""
    schema = f"unit_id string, file string, line_no int, rule_id string, phase int, match_ord {detect.MATCH_ORD}, label string"

    def ask(batches):
        for pdf in batches:
            yield pd.DataFrame({**{k: pdf[k] for k in route.KEY}, "label": [classify(s) for s in pdf["snippet"]]})

    return route.to_adjudicate(findings).select(*route.KEY, "snippet").mapInPandas(ask, schema)


def _flagged(samples: DataFrame, ext: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    good = samples.where("usable").select(F.col("id").alias("unit_id"), "code", "label", "category")
    found = detect.scan_lines(snippet_lines(good, "code", F.col("unit_id"), ext), settings.rules, settings.sensitive_names, **settings.entropy())
    return good, route.routed(found).select("unit_id").distinct()


def bench(samples: DataFrame, ext: str = "py", settings: Settings = Settings(), latencies: DataFrame | None = None) -> DataFrame:
    """Accuracy over labelled samples (id, code, label, category, usable): one row, with how many were passed over.

    ``latencies`` (ms) are a caller's own timings of single snippets; a scan here has none, so p50_ms and p95_ms are else null.
    """
    good, flagged = _flagged(samples, ext, settings)
    skipped = samples.agg(F.count_if(~F.col("usable")).alias("skipped"))
    one = metrics.confusion(good, flagged).crossJoin(F.broadcast(skipped))  # one row beside one row
    if latencies is None:
        return one.withColumns({"p50_ms": F.lit(None).cast("double"), "p95_ms": F.lit(None).cast("double")})
    ranks = metrics.nearest_rank(latencies, "ms", {"p50_ms": 0.5, "p95_ms": 0.95}).select(*(F.round(c, 2).alias(c) for c in ("p50_ms", "p95_ms")))
    return one.join(ranks, F.lit(True), "left")  # one row beside at most one


def bench_lists(samples: DataFrame, ext: str = "py", settings: Settings = Settings(), most: int = 10) -> DataFrame:
    """kind (missed, false alarm), items (labels of the first ones, by id) and more, the number of those left out: what a report lists."""
    good, flagged = _flagged(samples, ext, settings)
    d = good.join(flagged.withColumn("_hit", F.lit(True)), "unit_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    leak = F.lower("label") == "leak"
    d = d.withColumn("kind", F.when(leak & ~F.col("_hit"), "missed").when(~leak & F.col("_hit"), "false alarm")).where("kind is not null")
    totals = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("kind").orderBy("unit_id")
    shown = d.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    items = shown.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", first_line(F.col("code")).alias("label")))), lambda x: x["label"]).alias("items"))
    return items.join(totals, "kind").select("kind", "items", (F.col("n") - F.size("items")).alias("more"))
