"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame operations only. The patterns' repeated parts are possessive, so the matcher neither recurses
nor backtracks on long texts; none of them can match less than its greedy form would.

Kinds beyond the contract's start from a lower score, so the words nearby decide on them: a number alone
isn't a social security or routing number, one beside such words is.

Defined results: a null text counts as empty and has no spans; offsets are code points, the end
exclusive; matches of one kind never overlap, those of two kinds may; spans are in the order of start,
then kind as in KINDS, then end. Repeated rows get equal results, an empty table none.
``find_spans`` replaces a column ``pii``; other columns stay, whatever their names, and ``redact`` keeps all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, column, whole_text

#: Matches whose offsets are summed in one go; a longer list is done in such blocks.
BLOCK = 256
#: Characters before and after a span in which words count as nearby, and what they add or take.
NEARBY, FOR, AGAINST, ACCEPT = 40, 0.2, 0.2, 0.5


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97),
    )
    return left == 1


def _card(x: Column) -> Column:
    d = digits_of(x)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _ip(x: Column) -> Column:
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(plain(p)) <= 3, plain(p).cast("int") <= 255).otherwise(False))


def _phone(x: Column) -> Column:
    return F.length(digits_of(x)).between(9, 15)


def _ssn(x: Column) -> Column:
    """A number that is given out: no part is all zeros, the area is neither 666 nor 9xx."""
    return ~x.rlike("^(?:000|666|9)|-00-|-0000$")


def _routing(x: Column) -> Column:
    """A bank's routing number: its digits times 3, 7, 1 in turn sum to a multiple of 10."""
    digit = lambda i: F.substring(x, i, 1).cast("int")
    total = digit(1) * 3
    for i in range(2, 10):
        total = total + digit(i) * (3, 7, 1)[(i - 1) % 3]
    return (total % 10 == 0) & (x != "000000000")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheaper test that every text with a match passes.
    gate: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    #: Words nearby that speak for the kind.
    context: str
    #: Spans of a contract's kind stay whatever their score.
    always: bool = True


LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda x: F.lit(True), 0.8, "mail|contact|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, 0.7, r"\bip\b|host|server|addr"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][0-9\x20-]{10,}[0-9]"), _card, 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), _phone, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), mod97, 0.6, "iban|bank|konto|cuenta|compte|account", always=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn, 0.4, r"\bssn\b|social security", always=False),
    Kind("routing", r"\b[0-9]{9}\b", lambda t: t.rlike(r"[0-9]{9}"), _routing, 0.4, r"\baba\b|routing|bank", always=False),
)
#: Words nearby that speak against any kind.
DOUBT = "example|sample|dummy|version|checksum"
MATCH = "struct<start:int,end:int,text:string>"
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,text:string,score:double>>"


def _matches(text: Column, kind: Kind) -> Column:
    """All matches of the kind's pattern, with offsets: summed lengths of the matches and the gaps between."""
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))
    found = F.filter(found, lambda x: x["hit"].isNotNull())

    def offsets(part: Column, start: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("pos"), F.array().cast(f"array<{MATCH}>").alias("out")),
            lambda a, x: F.struct(
                (a["pos"] + F.length(x["gap"]) + F.length(x["hit"])).cast("int").alias("pos"),
                F.array_append(
                    a["out"],
                    F.struct((a["pos"] + F.length(x["gap"])).cast("int").alias("start"), (a["pos"] + F.length(x["gap"]) + F.length(x["hit"])).cast("int").alias("end"), x["hit"].alias("text")),
                ).cast(f"array<{MATCH}>").alias("out"),
            ),
        )

    def blocks(all_of: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_of), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(all_of, i, F.lit(BLOCK)))
        width = lambda p: F.aggregate(p, F.lit(0), lambda a, x: (a + F.length(x["gap"]) + F.length(x["hit"])).cast("int"))
        done = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{MATCH}>>").alias("out")),
            lambda a, p: F.struct((a["pos"] + width(p)).cast("int").alias("pos"), F.array_append(a["out"], offsets(p, a["pos"])["out"]).cast(f"array<array<{MATCH}>>").alias("out")),
        )
        return F.flatten(done["out"])

    return F.get(F.transform(F.array(found), blocks), F.lit(0))


def _spans(text: Column, no: int, kind: Kind) -> Column:
    def scored(x: Column) -> Column:
        near = F.lower(F.concat(F.substring(text, F.greatest(x["start"] - NEARBY + 1, F.lit(1)), F.least(x["start"], F.lit(NEARBY))), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(NEARBY))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), FOR).otherwise(0.0) - F.when(near.rlike(DOUBT), AGAINST).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), x["text"].alias("text"), F.round(score, 3).alias("score"))

    confirmed = F.transform(F.filter(_matches(text, kind), lambda x: kind.confirm(x["text"])), scored)
    if not kind.always:
        confirmed = F.filter(confirmed, lambda x: x["score"] >= ACCEPT)
    return F.when(kind.gate(text), confirmed.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with pii: an array of start, kind_no, end, kind, text and score."""
    text = whole_text(column(text_col))
    each = {f"_pii_{k.name}": _spans(text, no, k) for no, k in enumerate(KINDS)}
    names = list(each)
    found = F.array_sort(F.concat(*names))
    return docs.select(carried(docs), *(v.alias(k) for k, v in each.items())).select(*(F.col("rest")[c].alias(c) for c in docs.columns if c != "pii"), found.alias("pii"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The spans' scores in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span's characters replaced by ``<KIND>``; of overlapping spans the first tells the kind."""
    text = whole_text("text")
    found = find_spans(docs.select(carried(docs), column(text_col).alias("text")), "text")

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["pos"]
        gap = F.substring(text, a["pos"] + 1, F.greatest(x["start"] - a["pos"], F.lit(0)))
        return F.struct(
            F.greatest(a["pos"], x["end"]).cast("int").alias("pos"),
            F.when(fresh, F.concat(a["out"], F.array(gap, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))).otherwise(a["out"]).alias("out"),
        )

    done = F.aggregate(F.col("pii"), F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")), step)
    tail = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["pos"] + 1, F.length(text)))
    clean = F.when(F.size("pii") == 0, F.col("text")).otherwise(F.get(F.transform(F.array(done), tail), F.lit(0)))
    done = found.select("rest", clean.alias("clean"))
    return done.select(*(F.col("clean").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))
