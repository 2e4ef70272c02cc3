"""Detectors: rules, entropy and bindings over lines, to one relation of findings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import FLAGS, MIN_TOKEN_BYTES, SEAM, THRESHOLD, TOKEN_SPLIT, byte_entropy, entropy_confidence, fixed, free_names, is_harmless_token, is_placeholder, let, sensitive_context, split_lines, threshold
from .bindings import LANGUAGES, SENSITIVE_NAMES, bindings_in
from .rules import REDACTED, RULES, Rule

#: Characters that compatibility normalisation may change: all but ASCII, Latin letters, Greek, Cyrillic and Hebrew.
MAY_CHANGE = r"[^\x00-\x7Fµ¶·¿¡«»§°±À-ÿĀ-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ʯΑ-ΡΣ-ώЀ-ӿא-ת–—‘’“”€]|[µ]"

#: Only lines that assign something are looked at for entropy.
ASSIGNMENT = "[=:]"


@F.pandas_udf(StringType())
def _nfkc(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised(lines: DataFrame) -> DataFrame:
    """``lines`` with view: the text under compatibility normalisation. Python sees a null for each line that can't change."""
    odd = F.when(_may_change(F.col("text")), F.col("text"))
    return lines.withColumn("view", F.coalesce(_nfkc(odd), F.col("text")))


def _may_change(text: Column) -> Column:
    """Whether compatibility normalisation may change a text: one of as many bytes as characters is ASCII."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(MAY_CHANGE)


def _held(text: Column, low: Column, rule: Rule) -> Column:
    """Whether a text, also given in lower case, holds one of the rule's literals."""
    out = F.lit(False)
    for g in rule.gates:
        out = out | ((low if rule.any_case else text).contains(g) if g else F.lit(True))
    return out


#: The only characters other than A-Z that have an ASCII letter in their lower case.
LOWER_TO_ASCII = "[\u0130\u212a]"


def _may_hit(rules: Sequence[Rule], nfkc: bool) -> Column:
    """Lines worth a look: those that hold some rule's literal, may hold one when normalised, or have strings to join.

    One pattern for all of that, searched over Arrow batches: its time doesn't grow with the number of literals.
    """
    plain, lower = sorted({g for r in rules if not r.any_case for g in r.gates}), sorted({g for r in rules if r.any_case for g in r.gates})
    if "" in plain or "" in lower:
        return F.lit(True)
    any_of = lambda gs: "|".join(map(re.escape, gs))
    parts = [any_of(plain), f"(?i:{any_of(lower)})" if lower else "", LOWER_TO_ASCII, SEAM.replace(r"\s", r"[\s\x0b]"), MAY_CHANGE if nfkc else ""]
    return _matches("|".join(p for p in parts if p))(F.col("text"))


def _matches(pattern: str):
    """Whether a text holds a match, by an engine whose time is linear in the text."""

    def search(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.match_substring_regex(texts, pattern)

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "boolean")


#: Characters, the same in both cases, that many literals have and many lines haven't.
MARKS = "_-/:.="


def _by_mark(items: Sequence, literals) -> dict[str, list]:
    """The items by the first mark that all their literals have, or "": a line without it needs no look at any of them."""
    out: dict[str, list] = {}
    for x in items:
        out.setdefault(next((m for m in MARKS if all(m in g for g in literals(x))), ""), []).append(x)
    return out


ABSENT = -9


def _candidates(text: Column, low: Column, rules: Sequence[Rule]) -> Column:
    """The numbers of the rules of which the text, also given in lower case, holds a literal, among ABSENT.

    To be worked out in a column of its own: inside a lambda or as a generator's argument it is interpreted node by node.
    The empty list comes from a lambda, as Spark then makes many short methods of the step, not one too long to be compiled.
    """
    empty = F.array().cast("array<int>")
    parts = [F.filter(empty, lambda n: n >= 0)]
    for mark, some in _by_mark(list(enumerate(rules)), lambda x: x[1].gates).items():
        numbers = F.array(*(F.when(_held(text, low, r), F.lit(n)).otherwise(F.lit(ABSENT)) for n, r in some))
        parts.append(F.when(text.contains(mark), numbers).otherwise(empty) if mark else numbers)
    return F.concat(*parts)


def _hits(text: Column, r: Rule) -> Column:
    """What a rule captures in a text, match by match. The pattern is a constant, so it is compiled once."""
    pattern = F.lit(FLAGS + r.pattern)
    captured = F.regexp_extract_all(text, pattern, F.lit(r.group))
    if not r.optional or not r.group:
        return captured
    return F.zip_with(captured, F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, whole: F.when(g == "", whole).otherwise(g))


def _found(text: Column, rules: Sequence[Rule]) -> Column:
    """All that the row's rule finds in a text."""

    def among(first: int, end: int) -> Column:  # halves, as one case of all rules would try them in turn
        if end - first == 1:
            return _hits(text, rules[first])
        half = (first + end) // 2
        return F.when(F.col("rule_no") < half, among(first, half)).otherwise(among(half, end))

    nothing = F.lit(None).cast("array<string>")
    return F.when(F.col("rule_no") >= 0, among(0, len(rules))) if rules else nothing


ENTROPY_NO = -1


def _hit_rows(lines: DataFrame, rules: Sequence[Rule], nfkc: bool, entropy: Mapping | None) -> DataFrame:
    """One row per hit, in one pass over the lines: their columns, rule_no, occurrence, collapsed, secret and best (the entropy token, where that is the hit)."""
    names = free_names(lines.columns, ("view", "flat", "both", "low", "todo", "kept", "again", "hit", "best"))
    view, flat, both, low, todo, kept, again, hit, best = names.values()
    may_hit = _may_hit(rules, nfkc)
    d = lines.where(may_hit | F.col("text").rlike(ASSIGNMENT) if entropy is not None else may_hit)
    odd = F.when(_may_change(F.col("text")), F.col("text"))
    d = d.withColumn(view, F.coalesce(_nfkc(odd), F.col("text")) if nfkc else F.col("text"))
    d = d.withColumn(flat, F.when(F.col(view).rlike(SEAM), F.regexp_replace(view, SEAM, "")))
    d = d.withColumn(both, F.concat_ws("\n", view, flat)).withColumn(low, F.lower(both))
    numbers = _candidates(F.col(both), F.col(low), rules)
    if entropy is not None:
        d = d.withColumn(best, best_token(F.col("text"), F.col("ext"), **entropy))
        numbers = F.concat(numbers, F.when(F.col(best).isNotNull(), F.array(F.lit(ENTROPY_NO))).otherwise(F.array().cast("array<int>")))
    # not the bare column: of that, a test for being empty would be pushed below, and work it out twice
    d = d.withColumn(todo, numbers).withColumn("rule_no", F.explode(F.array_remove(todo, ABSENT)))
    plain = F.transform(_found(F.col(view), rules), lambda x, i: F.struct((i + 1).alias("occurrence"), F.lit(False).alias("collapsed"), x.alias("secret")))
    d = d.withColumn(kept, F.filter(plain, lambda h: ~F.coalesce(is_placeholder(h["secret"]), F.lit(False))))
    d = d.withColumn(again, F.when((F.size(kept) == 0) & F.col(flat).isNotNull(), F.size(_found(F.col(flat), rules))).otherwise(0))
    once = F.array(F.struct(F.lit(1).alias("occurrence"), F.lit(True).alias("collapsed"), F.lit(None).cast("string").alias("secret")))
    hits = F.when(F.col(again) > 0, once).otherwise(F.col(kept))
    if entropy is not None:
        token = F.array(F.struct(F.lit(1).alias("occurrence"), F.lit(False).alias("collapsed"), F.col(best)["token"].alias("secret")))
        hits = F.when(F.col("rule_no") == ENTROPY_NO, token).otherwise(hits)
    own = [F.col(f"`{c}`") for c in lines.columns]
    d = d.select(*own, "rule_no", *([best] if entropy is not None else []), F.explode(hits).alias(hit))
    return d.select(*own, "rule_no", f"{hit}.*", *([F.col(best).alias("best")] if entropy is not None else []))


def rule_hits(lines: DataFrame, rules: Sequence[Rule] = RULES, nfkc: bool = True) -> DataFrame:
    """One row per hit of a rule in a line: the line's columns, rule_no, occurrence, collapsed and secret.

    A line meets only the rules of which it holds a literal, and most lines hold none: those leave before
    anything else is done with them. A line whose strings are joined is looked at once more with the joints
    gone: of a rule that found nothing in it as it is, the first hit counts, without a secret. Placeholders
    don't count, but keep their number. A null text has no hits; repeated lines are looked at apart.
    """
    return _hit_rows(lines, rules, nfkc, None)


def _lookup(rules: Sequence[Rule], value) -> Column:
    return F.get(F.array(*(F.lit(value(r)) for r in rules)), F.col("rule_no"))


FINDING = ("unit_id", "file", "ext", "line_no", "layer", "rule_id", "description", "snippet", "secret", "redacted", "confidence", "tier", "ai_skipped", "phase", "match_ord")
#: Where a finding stands among its line's: view 0 as written, 1 joined, 2 entropy; then the rule and its occurrence.
MATCH_ORD = "struct<view:int,rule_no:int,occurrence:int>"


def match_ord(view: Column, rule_no: Column, occurrence: Column) -> Column:
    return F.struct(view.alias("view"), rule_no.alias("rule_no"), occurrence.alias("occurrence")).cast(MATCH_ORD)


def line_findings(lines: DataFrame, rules: Sequence[Rule] = RULES, nfkc: bool = True, entropy: Mapping | None = None) -> DataFrame:
    """Findings of the rules and, with ``entropy`` settings, of the tokens of most entropy, in one pass."""
    h = _hit_rows(lines, rules, nfkc, entropy)
    of = lambda value: _lookup(rules, value)
    view, rule_no = F.col("collapsed").cast("int"), F.col("rule_no")
    columns = {
        "layer": F.lit("regex"), "rule_id": of(lambda r: r.id), "description": of(lambda r: r.text), "redacted": F.concat_ws("_", of(lambda r: r.token), F.col("occurrence").cast("string")),
        "confidence": of(lambda r: float(r.confidence)), "tier": of(lambda r: r.tier), "match_ord": match_ord(view, rule_no, F.col("occurrence")),
    }
    if entropy is not None:
        other = _entropy_columns(F.col("best"))
        columns = {c: F.when(rule_no == ENTROPY_NO, other[c]).otherwise(v) for c, v in columns.items()}
    return h.withColumns(columns | {"snippet": F.substring("text", 1, 120), "ai_skipped": F.lit(False), "phase": F.lit(0)}).select(*FINDING)


def rule_findings(lines: DataFrame, rules: Sequence[Rule] = RULES, nfkc: bool = True) -> DataFrame:
    return line_findings(lines, rules, nfkc)


def _harmless(token: Column, context: Column, allow: Sequence[str]) -> Column:
    return reduce(or_, (token.rlike(FLAGS + p) for p in allow), is_harmless_token(token, context))


def best_token(text: Column, ext: Column, overrides: Mapping[str, float] | None = None, default: float = THRESHOLD, min_bytes: int = MIN_TOKEN_BYTES, allow: Sequence[str] = ()) -> Column:
    """token, h and threshold of a line's token of most entropy, the first of equals, from the threshold on; null where there is none. Worked out inside the row."""
    limit = threshold(ext, overrides, default)

    def best(line: Column) -> Column:
        long = F.filter(F.split(line["text"], TOKEN_SPLIT, -1), lambda t: F.octet_length(t) >= min_bytes)
        sure = F.filter(long, lambda t: ~_harmless(t, line["context"], allow))
        rated = F.transform(sure, lambda t, i: F.struct(byte_entropy(t).alias("h"), (-i).alias("back"), t.alias("token"), line["limit"].alias("threshold")))
        return F.array_max(F.filter(rated, lambda x: x["h"] >= x["threshold"]))

    line = F.struct(text.alias("text"), sensitive_context(text).alias("context"), limit.alias("limit"))
    return F.when(text.rlike(ASSIGNMENT), let(line, best))


def entropy_tokens(lines: DataFrame, overrides: Mapping[str, float] | None = None, default: float = THRESHOLD, min_bytes: int = MIN_TOKEN_BYTES, allow: Sequence[str] = ()) -> DataFrame:
    """One row per token long enough of a line with an assignment: the line's columns, token_no, token, h, threshold, harmless."""
    d = lines.where(F.col("text").rlike(ASSIGNMENT)).select(*lines.columns, F.posexplode(F.split("text", TOKEN_SPLIT, -1)).alias("token_no", "token"))
    d = d.where(F.octet_length("token") >= min_bytes)
    harmless = _harmless(F.col("token"), sensitive_context(F.col("text")), allow)
    return d.withColumns({"h": byte_entropy(F.col("token")), "threshold": threshold(F.col("ext"), overrides, default), "harmless": harmless})


def _entropy_columns(best: Column) -> dict[str, Column]:
    return {
        "layer": F.lit("entropy"), "rule_id": F.lit("high_entropy"), "description": F.concat(F.lit("High entropy token (H="), fixed(best["h"], 2), F.lit(")")), "redacted": F.lit(f"{REDACTED}_HIGH_ENTROPY"),
        "confidence": entropy_confidence(best["h"], best["threshold"]), "tier": F.lit("T2"), "match_ord": match_ord(F.lit(2), F.lit(0), F.lit(1)),
    }


def entropy_findings(lines: DataFrame, **settings) -> DataFrame:
    """At most one finding a line. Repeated lines give one each; nothing is shuffled."""
    # an explode, not a filter: that would be pushed below, and work the token out twice
    d = lines.withColumn("best", F.explode(F.array_compact(F.array(best_token(F.col("text"), F.col("ext"), **settings)))))
    more = {"snippet": F.substring("text", 1, 120), "secret": F.col("best.token"), "ai_skipped": F.lit(False), "phase": F.lit(0)}
    return d.withColumns(_entropy_columns(F.col("best")) | more).select(*FINDING)


BINDING = "unit_id string, file string, ext string, line_no int, var_name string, snippet string, value string, confidence double, ord int"


def may_bind(text: Column, names: Sequence[str] = SENSITIVE_NAMES) -> Column:
    """Whether a text may name something sensitive, as ``bindings.is_sensitive`` tells a name; true of all that isn't ASCII, whose lower case may differ."""
    flat = [n.replace("_", "") for n in names]
    held = let(F.replace(F.lower(text), F.lit("_"), F.lit("")), lambda t: reduce(or_, (t.contains(n.lower()) for n in flat), F.lit(False)))
    return held | (F.octet_length(text) > F.length(text))


def binding_findings(lines: DataFrame, names: Sequence[str] = SENSITIVE_NAMES) -> DataFrame:
    """Sensitive names bound to string literals, a file at a time: its lines together are the source. Files that name nothing sensitive don't leave the JVM."""
    known = lines.where(F.col("ext").isin(*LANGUAGES))
    text = F.coalesce("text", F.lit(""))
    files = known.groupBy("unit_id", "file", "ext").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))).alias("lines"), F.max(may_bind(text, names)).alias("may"))
    return _bound(files.where("may").select("unit_id", "file", "ext", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("source"), F.transform("lines", lambda x: x["line_no"]).alias("rows")), names)


def text_binding_findings(texts: DataFrame, names: Sequence[str] = SENSITIVE_NAMES) -> DataFrame:
    """The same of whole texts (unit_id, file, ext, text), each a file: nothing is shuffled."""
    d = texts.where(F.col("ext").isin(*LANGUAGES) & may_bind(F.col("text"), names))
    return _bound(d.select("unit_id", "file", "ext", F.array_join(split_lines(F.col("text")), "\n").alias("source"), F.lit(None).cast("array<int>").alias("rows")), names)


def _bound(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Findings of files (unit_id, file, ext, source; rows: the lines' numbers, null: from 1 on)."""

    def find(batches):
        for batch in batches:
            at, out = [], []
            rows = batch.column("rows")
            for i, (source, ext) in enumerate(zip(batch.column("source").to_pylist(), batch.column("ext").to_pylist(), strict=True)):
                found = bindings_in(source, ext, names)
                numbers = rows[i].as_py() if found else None
                at += [i] * len(found)
                out += [(numbers[b.row] if numbers else b.row + 1, b.name, b.snippet, b.value, b.confidence, n) for n, b in enumerate(found)]
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("unit_id", "file", "ext")]
            columns = zip(*out, strict=True) if out else [()] * 6
            types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in BINDING.split(", ")])

    b = files.mapInArrow(find, BINDING)
    return b.withColumns({
        "layer": F.lit("ast"), "rule_id": F.lit("ast_taint"), "description": F.format_string("Sensitive variable '%s' assigned string literal", "var_name"), "snippet": F.substring("snippet", 1, 120), "secret": F.col("value"),
        "redacted": F.concat(F.lit(f"{REDACTED}_"), F.upper("var_name")), "tier": F.lit("T1"), "ai_skipped": F.lit(False), "phase": F.lit(1), "match_ord": match_ord(F.lit(0), F.col("ord"), F.lit(1)),
    }).select(*FINDING)


def scan_lines(lines: DataFrame, rules: Sequence[Rule] = RULES, names: Sequence[str] = SENSITIVE_NAMES, nfkc: bool = True, **entropy) -> DataFrame:
    """All findings of all layers: rules and entropy in one pass, bindings in another over the lines of known languages."""
    return line_findings(lines, rules, nfkc, entropy).unionByName(binding_findings(lines, names))


def scan_texts(texts: DataFrame, rules: Sequence[Rule] = RULES, names: Sequence[str] = SENSITIVE_NAMES, nfkc: bool = True, **entropy) -> DataFrame:
    """The same of whole texts (unit_id, file, ext, text), each a file of its own."""
    lines = texts.select("unit_id", "file", "ext", F.posexplode(split_lines(F.col("text"))).alias("pos", "text"))
    lines = lines.select("unit_id", "file", "ext", (F.col("pos") + 1).alias("line_no"), "text")
    return line_findings(lines, rules, nfkc, entropy).unionByName(text_binding_findings(texts, names))
