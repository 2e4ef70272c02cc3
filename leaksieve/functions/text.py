"""Expressions over lines, names and values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's flags for Unicode classes and "\n" as the only line end.
FLAGS = "(?dU)"
#: Quote, joiner, quote: where a string was cut in two.
SEAM = r"""["']\s*(?:\+|\.{1,2})\s*["']"""
TOKEN_SPLIT = "[\"' \\t,;]"
# Entropy thresholds by extension, and what the confidence runs over.
EXT_THRESHOLDS = {"env": 4.2, "yaml": 4.2, "yml": 4.2, "tf": 4.2, "tfvars": 4.2, "properties": 4.2, "ini": 4.2, "toml": 4.2, "lock": 5.5, "map": 5.5, "json": 5.0, "md": 5.0, "txt": 5.0, "rst": 5.0}
THRESHOLD, MIN_TOKEN_BYTES = 4.5, 20
SENSITIVE_CONTEXT = ("key", "secret", "token", "passw", "credential", "auth")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_names(taken: Sequence[str], wanted: Sequence[str]) -> dict[str, str]:
    """A column name for each wanted one that isn't taken, whatever the case."""
    used = {t.lower() for t in taken}
    out = {}
    for w in wanted:
        name = f"_{w}"
        while name.lower() in used:
            name += "_"
        used.add(name)
        out[w] = name
    return out


def split_lines(text: Column) -> Column:
    """A text's lines: an end of line is "\\n" or "\\r\\n", and one at the text's end starts no line."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """What follows the name's last dot, unless that dot comes first."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def is_placeholder(value: Column) -> Column:
    low = F.lower(value)
    return (
        value.startswith("test_") | value.startswith("fake_") | low.startswith("placeholder") | value.startswith("${") | value.startswith("{{")
        | (value.startswith("<") & value.endswith(">")) | (low.startswith("your") & low.endswith("here")) | low.isin("changeme", "xxx")
    )


def byte_entropy(value: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes, in bits; 0 for the empty string."""
    single = F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")  # a character for each byte

    def bits(x: Column) -> Column:
        count = lambda b: F.length(x) - F.length(F.replace(x, b, F.lit("")))
        shares = F.transform(F.sort_array(F.array_distinct(F.array_remove(F.split(x, "", -1), ""))), lambda b: count(b) / F.length(x))
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(single, bits)


def threshold(ext: Column, overrides: Mapping[str, float] | None = None, default: float = THRESHOLD) -> Column:
    own = F.lit(None).cast("double")
    for table in (EXT_THRESHOLDS, overrides or {}):
        for name, value in table.items():
            own = F.when(ext == name, F.lit(float(value))).otherwise(own)
    return F.coalesce(own, F.lit(float(default)))


def entropy_confidence(h: Column, t: Column) -> Column:
    return F.least((h - t) / 2, F.lit(1.0)) * 0.7 + 0.3


def sensitive_context(line: Column) -> Column:
    low = F.lower(line)
    found = F.lit(False)
    for word in SENSITIVE_CONTEXT:
        found = found | low.contains(word)
    return found


def is_harmless_token(token: Column, context: Column) -> Column:
    """High-entropy tokens that are no secrets: images, checksums, ids, integrity and password hashes, versions, links, paths."""
    starts = lambda *xs: _any(token.startswith(x) for x in xs)
    checksum = ~context & F.octet_length(token).isin(32, 40, 64, 128) & token.rlike("^[0-9a-fA-F]+$")
    uuid = token.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    version = (dots >= 2) & token.rlike(r"^[A-Za-z0-9._+-]+$")
    return starts("iVBORw0KGgo", "/9j/", "data:") | checksum | uuid | starts("sha512-", "sha256-", "sha1-", "$2a$", "$2b$", "$2y$", "$argon2", "$scrypt$") | version | starts("http", "/")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_excluded(path: Column, dirs: Sequence[str], files: Sequence[str]) -> Column:
    """A whole path component is an excluded directory, or the name fits: ``*suffix``, else ``prefix*``, else equal."""
    name = file_name(path)
    fits = (name.endswith(f[1:]) if f.startswith("*") else name.startswith(f[:-1]) if f.endswith("*") else name == f for f in files)
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*(F.lit(d) for d in dirs)).cast("array<string>")) | _any(fits)


def wildcard_pattern(wildcard: str) -> str:
    """A wildcard as an anchored pattern: ``*`` is any run."""
    import re

    return "^" + ".*".join(re.escape(p) for p in wildcard.split("*")) + "$"


def normalised_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def rfc3339_now() -> Column:
    """The query's time in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def first_line(text: Column, width: int = 80) -> Column:
    """The first line that isn't blank, cut to a width: a sample's label."""
    lines = F.filter(split_lines(text), lambda x: F.trim(x) != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, width)


def _adding(add, x: Column):
    return lambda t: add(t, x)  # of one argument only: a second would be taken for the array's index


def fixed(value: Column, digits: int) -> Column:
    """A number from 0 on with so many digits, rounded by its exact binary value, exact halves to the even digit.

    The double's multiple that decides (twice the scaled value against an odd number) is a sum of its products with
    powers of two, which are exact, so each addition's error is known and the comparison is exact too.
    """
    scale = 10**digits

    def rounded(v: Column) -> Column:
        terms = [v * float(1 << k) for k in range(10, -1, -1) if 2 * scale >> k & 1]

        def add(sum_: Column, x: Column) -> Column:
            def with_error(t: Column) -> Column:
                part = t - sum_["high"]
                return F.struct(t.alias("high"), (sum_["low"] + (sum_["high"] - (t - part)) + (x - part)).alias("low"))

            return let(sum_["high"] + x, with_error)

        twice = F.struct(terms[0].alias("high"), F.lit(0.0).alias("low"))
        for x in terms[1:]:
            twice = let(twice, _adding(add, x))
        down = F.floor(v * float(scale))

        def digit(t: Column) -> Column:
            over = (t["high"] - (down * 2 + 1).cast("double")) + t["low"]
            return F.when((over > 0) | (over == 0) & (F.pmod(down, F.lit(2)) == 1), down + 1).otherwise(down)

        whole = let(twice, digit)
        return let(whole, lambda w: F.concat(F.floor(w / scale).cast("string"), F.lit("."), F.lpad(F.pmod(w, F.lit(scale)).cast("string"), digits, "0")))

    return let(value.cast("double"), rounded)


def human_bytes(n: Column) -> Column:
    """A number of bytes in units of 1000."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    value = n.cast("double")
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        value = value / 1000.0  # step by step, as the rounding of each step counts
        out = F.when(n >= 1000**i, F.concat(fixed(value, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    """A link's host, without scheme, user, port or path; an address in brackets stays in them."""
    host = F.substring_index(F.regexp_extract(url, r"(?s)^(?:.*?://)?([^/?]*)", 1), "@", -1)
    return F.when(host.contains("]"), F.concat(F.substring_index(host, "]", 1), F.lit("]"))).otherwise(F.regexp_replace(host, r":[^:]*$", ""))


def is_loopback(url: Column) -> Column:
    """Whether a link names this machine."""
    host = F.lower(F.regexp_replace(F.trim(host_of(url)), r"^\[+|\]+$", ""))
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (host == "localhost") | host.rlike(rf"^127\.{part}\.{part}\.{part}$") | host.rlike("^(?:0{1,4}:){7}0{0,3}1$|^::(?:0{1,4}:){0,5}0{0,3}1$")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 from two digests; the padded keys are made on the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)
