"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a Boolean expression over a document that says "reject". What it costs and how often it rejects
is estimated on a bounded sample of all rows, and the rules run in the order of rejections per cost: one
CASE expression stops at the first rule that rejects. Where only the verdict is wanted (``keep_good``) each
rule works out its own statistic, so those after the first rejection cost nothing. The order changes what
a run costs, never which documents are kept.

Defined results: a null text has no words and fails; ties of rules keep their listed order; repeated
rows are judged apart; an empty table gives no rows (and the listed order). ``keep_good`` keeps all columns
as they are, whatever their names; ``judge`` replaces columns of the names that it adds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, column, whole_text, words_of

#: Words in a window that may repeat.
WINDOW = 8
#: Rows of the sample that orders the rules, the bytes beyond which a row isn't sampled, and how often each is judged: the first times warm the engine up.
SAMPLE_ROWS, SAMPLE_BYTES, REPEATS = 256, 1 << 16, 4
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The verdict's own bounds.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_SHARE, MEAN_WORD_MIN, MEAN_WORD_MAX, MAX_STUTTER = 0.2, 0.6, 2.0, 15.0, 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Document:
    """A document's text, words and statistics, as expressions: columns that are there, or worked out where a rule asks."""

    text: Column
    words: Column
    known: Callable[[str], Column] | None = None

    def _of(self, name: str, work: Callable[[], Column]) -> Column:
        return self.known(name) if self.known else work()

    @property
    def n_words(self) -> Column:
        return self._of("n_words", lambda: F.size(self.words))

    @property
    def word_chars(self) -> Column:
        return self._of("word_chars", lambda: F.length(F.array_join(self.words, "")))

    @property
    def n_symbols(self) -> Column:
        return self._of("n_symbols", lambda: F.length(F.regexp_replace(self.text, r"[^#*$%&|<>]+", "")))

    @property
    def n_dup_lines(self) -> Column:
        lines = F.filter(F.split(self.text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return self._of("n_dup_lines", lambda: _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))

    @property
    def n_repeat_words(self) -> Column:
        return self._of("n_repeat_words", lambda: F.coalesce(_repeat_words(self.words), F.lit(0)))


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[Document], Column]


@dataclass(frozen=True)
class Estimate:
    name: str
    cost_s: float
    rejects: float

    @property
    def worth(self) -> float:
        return self.rejects / max(self.cost_s, 1e-9)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in ``words``, the first included.

    Windows are compared by a 64-bit hash within one text. Only texts with a repeated window sort theirs.
    """
    n = F.size(words) - F.lit(WINDOW)
    seen = F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW)))))

    def count(windows: Column) -> Column:
        at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, j, k: F.get(a, j)["h"] == F.get(a, k)["h"]
        twice = lambda a: F.filter(a, lambda x, k: F.coalesce(same(a, k - 1, k), F.lit(False)) | F.coalesce(same(a, k + 1, k), F.lit(False)))
        starts = F.sort_array(F.transform(_let(at, twice), lambda x: x["i"]))
        cover = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        )
        return cover["n"]

    return _let(seen, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), count(w)).otherwise(0))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _judged_text(text: Column, body: Callable[[Document], Column]) -> Column:
    """``body`` of a text as a document whose words are worked out once, and statistics where they're asked for."""
    return _let(F.struct(text.alias("text"), words_of(text).alias("words")), lambda x: body(Document(x["text"], x["words"])))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the BASE columns, each a long."""
    text = whole_text(column(text_col))
    d = docs.select(carried(docs), text.alias("text"), words_of(text).alias("words"))
    one = Document(F.col("text"), F.col("words"))
    d = d.select("rest", *(getattr(one, name).cast("long").alias(name) for name in BASE))
    return d.select(*(F.col("rest")[c].alias(c) for c in docs.columns if c.lower() not in BASE), *BASE)


def base_rules() -> list[Rule]:
    """The rules of the base verdict."""
    return [
        Rule("few_words", lambda d: d.n_words < MIN_WORDS),
        Rule("repeated_windows", lambda d: d.n_repeat_words * 100 > d.n_words * MAX_REPEAT_PERCENT),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def default_rules() -> list[Rule]:
    """Rules over a document. Each rejects plain junk; clean prose passes all."""

    def mean_length(d: Document) -> Column:
        mean = d.word_chars / F.nullif(d.n_words, F.lit(0))
        return (mean < MEAN_WORD_MIN) | (mean > MEAN_WORD_MAX)

    def stutters(d: Document) -> Column:
        same = lambda w: F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False)))
        return F.size(_let(d.words, same)) > d.n_words * MAX_STUTTER

    return [
        *base_rules(),
        Rule("symbols", lambda d: d.n_symbols > d.n_words * MAX_SYMBOLS_PER_WORD),
        Rule("repeated_lines", lambda d: d.n_dup_lines > F.size(F.split(d.text, "\n", -1)) * MAX_DUP_LINE_SHARE),
        Rule("word_length", mean_length),
        Rule("stutter", stutters),
        Rule("few_letters", lambda d: F.length(F.regexp_replace(d.text, r"\P{L}+", "")) * 2 < d.word_chars),
    ]


def estimate_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> list[Estimate]:
    """Each rule's seconds and share of rejections over a sample of ``SAMPLE_ROWS`` rows: those of the least hashes among all.

    One job judges each sampled row with one rule after the other and reads the clock in between, inside the
    task; the words, which all rules share, are worked out before.
    """
    spark: SparkSession = docs.sparkSession
    text = whole_text(column(text_col))
    drawn = docs.select(text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("at", F.xxhash64("text", F.monotonically_increasing_id()))
    rows = drawn.orderBy("at").limit(SAMPLE_ROWS).select("text").collect()
    if not rows:
        return [Estimate(r.name, 1.0, 0.0) for r in rules]
    sample = spark.createDataFrame(rows * REPEATS, "text string").coalesce(1)
    clock = lambda: F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    verdict = lambda body: _judged_text(F.col("text"), lambda d: F.coalesce(body(d), F.lit(True)).cast("int"))
    steps = [verdict(lambda d: d.n_words < 0).alias("none"), clock().alias("t0")]
    for n, r in enumerate(rules, 1):
        steps += [verdict(r.reject).alias(f"v{n}"), clock().alias(f"t{n}")]
    seconds = [F.percentile(F.col(f"t{n}") - F.col(f"t{n - 1}"), 0.5) / 1e9 for n in range(1, len(rules) + 1)]
    found = sample.select(*steps).agg(*seconds, *(F.avg(f"v{n}") for n in range(1, len(rules) + 1))).first()
    return [Estimate(r.name, found[n], found[len(rules) + n]) for n, r in enumerate(rules)]


def cascade(rules: Sequence[Rule], estimates: Sequence[Estimate], document: Document) -> Column:
    """The name of the first rule that rejects, in the order of rejections per cost; null where none does."""
    worth = {e.name: e.worth for e in estimates}
    first = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -worth[r.name])):  # built from the last asked to the first
        first = F.when(F.coalesce(r.reject(document), F.lit(True)), F.lit(r.name)).otherwise(first)
    return first


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with the BASE columns, base_failed, rejected_by and kept."""
    rules = list(rules or default_rules())
    estimates = estimate_rules(docs, rules, text_col)
    added = ("base_failed", "rejected_by", "kept")
    own = [c for c in docs.columns if c.lower() not in (*BASE, *added)]
    text = whole_text(column(text_col))
    out = with_statistics(docs.select(F.struct(*(column(c) for c in own)).alias("rest"), text.alias("text")))
    known = Document(F.col("text"), words_of(F.col("text")), F.col)
    out = out.withColumns({"base_failed": base_failed(), "rejected_by": cascade(rules, estimates, known)})
    return out.select(*(F.col("rest")[c].alias(c) for c in own), *BASE, *added[:2], (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor ``rules`` reject, with all their columns: one filter."""
    given = list(rules or default_rules())
    names = {r.name for r in given}
    rules = [*(r for r in base_rules() if r.name not in names), *given]
    estimates = estimate_rules(docs, rules, text_col)
    return docs.where(_judged_text(whole_text(column(text_col)), lambda d: cascade(rules, estimates, d)).isNull())
