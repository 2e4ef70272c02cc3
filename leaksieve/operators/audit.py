"""A tamper-evident chain of audit entries: each holds the hash of the one before and a keyed signature."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256, rfc3339_now
from ..sources.staging import discard, staged
from .route import ORDER, verdict

GENESIS = "genesis"
ENTRY = "seq long, timestamp string, event string, file string, tier string, layer string, verdict string, version string, scan_duration_ms long, ai_layer string, prev_hash string, hmac string"
SIGNED = ("event", "file", "layer", "prev_hash", "seq", "tier", "timestamp", "verdict")
OPTIONAL = ("version", "scan_duration_ms", "ai_layer")


def payload(row=F.col) -> Column:
    """What is signed: the keys in sorted order, nulls kept, optional ones only where set."""
    return F.concat(F.lit("{"), F.concat_ws(",", *_members(sorted((*SIGNED, *OPTIONAL)), row)), F.lit("}"))


def _members(names: Iterable[str], row=F.col) -> list[Column]:
    """A JSON member for each name; null for an optional one that isn't set, which ``concat_ws`` passes over."""
    part = lambda c: F.concat(F.lit(f'"{c}":'), F.coalesce(_json(row(c), c), F.lit("null")))
    return [F.when(row(c).isNotNull(), part(c)) if c in OPTIONAL else part(c) for c in names]


def _json(value: Column, name: str) -> Column:
    if name in ("seq", "scan_duration_ms"):
        return value.cast("string")
    text = F.to_json(F.struct(value.alias("v")))  # {"v":...}
    return F.when(value.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


def entry_json(row=F.col) -> Column:
    """The entry as its line holds it, in the order of ENTRY."""
    return F.concat(F.lit("{"), F.concat_ws(",", *_members(NAMES, row)), F.lit("}"))


def entry_hash() -> Column:
    return F.sha2(entry_json(), 256)


def events_of(findings: DataFrame, timestamp: str | None = None, version: str = "1") -> DataFrame:
    """A finding's entry before it is chained: event is the verdict, ``verdict`` ALLOW or the tier."""
    v = F.upper(verdict(F.col("tier"), F.col("confidence")))
    ai = F.when(F.col("ai_skipped"), "skipped").when(F.col("layer") == "semantic", "used")
    return findings.select((F.lit(timestamp) if timestamp else rfc3339_now()).alias("timestamp"), v.alias("event"), "file", "tier", "layer", F.when(v == "ALLOW", v).otherwise(F.coalesce("tier", v)).alias("verdict"), F.lit(version).alias("version"), F.lit(None).cast("long").alias("scan_duration_ms"), ai.alias("ai_layer"), *(F.col(c).alias(f"_{c}") for c in ("confidence", *ORDER)))


NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _line(entry: dict, names: Iterable[str]) -> bytes:
    """The members of an entry as Spark's JSON has them, which writes \\u001F in upper case."""
    text = json.dumps({n: entry[n] for n in names if n not in OPTIONAL or entry[n] is not None}, separators=(",", ":"), ensure_ascii=False)
    return re.sub(r"\\(u[0-9a-f]{4}|.)", lambda m: f"\\u{m[1][1:].upper()}" if len(m[1]) > 1 else m[0], text).encode()


def chained(events: Iterable[dict], key: bytes, seq: int = 0, prev_hash: str = GENESIS) -> Iterator[dict]:
    """Events as entries, each with the hash of the one before and its signature."""
    for event in events:
        entry = {n: event.get(n) for n in NAMES} | {"seq": seq, "prev_hash": prev_hash}
        entry["hmac"] = hmac.new(key, _line(entry, sorted((*SIGNED, *OPTIONAL))), hashlib.sha256).hexdigest()
        yield entry
        seq, prev_hash = seq + 1, hash_of(entry)


def append(events: list, key: bytes, last: dict | None = None) -> list[dict]:
    """Chain a few events after ``last``, on the driver. For a scan's events use ``append_log``."""
    if not last:
        return [*chained(events, key)]
    return [*chained(events, key, last["seq"] + 1, hash_of(last))]


def hash_of(entry: dict) -> str:
    """The hash that the entry after this one holds."""
    return hashlib.sha256(_line(entry, NAMES)).hexdigest()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and the entries of a log, a file or a folder that ``append_log`` wrote: files by time and name, lines as they stand. No log has no entries."""
    lines = _numbered(spark, path)
    if lines is None:
        return spark.createDataFrame([], f"line_no long, {ENTRY}")
    return lines.select("line_no", F.from_json("value", ENTRY).alias("e")).select("line_no", "e.*")


def _numbered(spark: SparkSession, path: str) -> DataFrame | None:
    """line_no and value of a log's lines; None where there is no log.

    A file's part is read by one task, so its lines' ids follow one another: only the parts' first ids and counts meet, and no line is shuffled.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    m = F.col("_metadata")
    place = F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["file_block_start"].alias("start"))
    d = lines.select(place.alias("_part"), "value").where(F.trim("value") != "").withColumn("_i", F.monotonically_increasing_id())
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    starts = parts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    return d.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_i")).alias("line_no"), "value")


#: Entries that one task chains, about.
CHUNK = 1 << 19


def append_log(events: DataFrame, path: str, key: bytes) -> None:
    """Append a scan's events (``events_of``) to the log in a folder, its entries after the log's last.

    A chain is sequential, but only its hashes are: the texts around them are made and sorted in parallel, into
    ranges of the findings' order. The ranges are chained one after the other, each a job that writes one file
    and hands on the last hash, so that no task holds the scan. One that fails leaves the chain whole up to the
    range before. There must be one writer.
    """
    spark = events.sparkSession
    log = _numbered(spark, path)
    last = log.orderBy(F.desc("line_no")).limit(1).select(F.from_json("value", ENTRY).alias("e")).select("e.*").select("seq", entry_hash().alias("_hash")).first() if log is not None else None
    seq, prev_hash = (last["seq"] + 1, last["_hash"]) if last else (0, GENESIS)

    order = [f"_{c}" for c in ("confidence", *ORDER)]
    pieces = staged(events.select(*order, *_pieces()), "events")
    ranges = max(1, -(-pieces.count() // CHUNK))
    by = [F.desc(order[0]), *order[1:]]
    d = pieces.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"), *PIECES)
    d = staged(d, "ranges")
    for n in range(ranges):
        seen = Observation()
        one = d.where(F.col("range") == n).repartition(1).sortWithinPartitions("at").select(*PIECES)
        lines = one.mapInArrow(_chain(key, seq, prev_hash), "seq long, value string").observe(seen, F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        lines.select("value").write.mode("append").text(path)
        if seen.get["seq"] is not None:
            seq, prev_hash = seen.get["seq"] + 1, hashlib.sha256(seen.get["value"].encode()).hexdigest()
    discard(d)
    discard(pieces)


PIECES = ("before", "between", "after", "line")


def _pieces() -> tuple[Column, ...]:
    """An entry's JSON texts around what the chain puts in: of what is signed, those around prev_hash and seq; of its line, what stands between them."""
    keys = sorted((*SIGNED, *OPTIONAL))
    hash_at, seq_at, line_at = keys.index("prev_hash"), keys.index("seq"), NAMES.index("prev_hash")
    opening = F.lit('"prev_hash":"')
    texts = (
        F.concat(F.lit("{"), F.concat_ws(",", *_members(keys[:hash_at]), opening)), F.concat_ws(",", F.lit('"'), *_members(keys[hash_at + 1 : seq_at]), F.lit('"seq":')),
        F.concat(F.concat_ws(",", F.lit(""), *_members(keys[seq_at + 1 :])), F.lit("}")), F.concat_ws(",", F.lit(""), *_members(NAMES[1:line_at]), opening),
    )
    return tuple(t.cast("binary").alias(name) for t, name in zip(texts, PIECES, strict=True))


def _chain(key: bytes, seq: int, prev_hash: str):
    """A task's work: seq and line of the entries whose pieces come in order. The padded keys are digested once."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        inner, outer = (hashlib.sha256(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
        n, prev = seq, prev_hash.encode()
        for batch in batches:
            first, lines = n, []
            for before, between, after, line in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in PIECES), strict=True):
                number = b"%d" % n
                digest, signature = inner.copy(), outer.copy()
                digest.update(before + prev + between + number + after)
                signature.update(digest.digest())
                lines.append(b'{"seq":%b%b%b","hmac":"%b"}' % (number, line, prev, signature.hexdigest().encode()))
                prev = hashlib.sha256(lines[-1]).hexdigest().encode()
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(range(first, n), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], names=["seq", "value"])

    return chain


def verify_log(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """n_entries and first_broken of a log."""
    return first_break(read_log(spark, path), key)


def checked(entries: DataFrame, key: bytes, part: str | None = None) -> DataFrame:
    """``entries`` (ENTRY and line_no) with linked and signed: whether each link and signature holds.

    Every entry meets the one of the line before in a join, so a log of any length is checked in parallel.
    Signatures are checked before that, so that the join needn't move what they are of.
    """
    keys = [part, "line_no"] if part else ["line_no"]
    d = entries.withColumns({"_hash": entry_hash(), "signed": F.coalesce(F.col("hmac") == hmac_sha256(key, payload()), F.lit(False))})
    before = d.select(*keys[:-1], (F.col("line_no") + 1).alias("line_no"), F.col("_hash").alias("_before"))
    d = d.join(before, keys, "left").withColumn("linked", F.col("prev_hash") == F.coalesce("_before", F.lit(GENESIS)))
    return d.drop("_hash", "_before")


def first_break(entries: DataFrame, key: bytes, part: str | None = None) -> DataFrame:
    """n_entries and the first line whose link or signature fails (null: none). A log cut off at its end isn't seen."""
    d = checked(entries, key, part)
    return (d.groupBy(part) if part else d.groupBy()).agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.when(~(F.col("linked") & F.col("signed")), F.col("line_no"))).alias("first_broken"))
