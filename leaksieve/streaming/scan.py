"""The scan over a stream of texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import detect, route
from ..operators.rules import RULES, Rule
from ..sources.lines import snippet_lines


def stream_rule_findings(docs: DataFrame, unit_col: str, text_col: str, ext: str = "", rules: Sequence[Rule] = RULES, nfkc: bool = True) -> DataFrame:
    """Rule findings of each text as it comes: no state, so any output mode works."""
    return detect.rule_findings(snippet_lines(docs, text_col, F.col(unit_col), ext), rules, nfkc)


def scan_stream(docs: DataFrame, unit_col: str, text_col: str, sink: Callable[[DataFrame, int], None], ext: str = "", rules: Sequence[Rule] = RULES) -> DataStreamWriter:
    """A writer that hands each batch's routed findings to ``sink``; a unit must come in one batch, as its ranking needs it whole."""

    def batch(df: DataFrame, number: int) -> None:
        sink(route.routed(detect.scan_lines(snippet_lines(df, text_col, F.col(unit_col), ext), rules)), number)

    return docs.writeStream.foreachBatch(batch)
