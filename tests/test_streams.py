"""Ranked adjudication over streams: the same as over a batch, however units are split; restarts; units that fall silent."""

import random
import time

from pyspark.sql import functions as F

from leaksieve.operators import detect, route
from leaksieve.streaming.ranked import ranked_lines

SCHEMA = "unit_id string, file string, ext string, line_no int, text string, ended boolean"
TEXTS = ["proprietary", "not for release", "x = 's3://bucket/a/b'", "nothing", f"k = AKIA{'Q7' * 8}", "'acme-internal'", "lora_r = 3", "secret_key = '0123456789abcdef0123456789abcdef'"]


def some_lines(seed, units=9):
    rng = random.Random(seed)
    return [[(f"u{u}", None if u == 3 else f"f{n % 2}.py", "py", n, rng.choice(TEXTS), False) for n in range(1, rng.randint(2, 25))] for u in range(units)]


def wanted(spark, units):
    d = spark.createDataFrame([r for u in units for r in u], SCHEMA).drop("ended")
    f = detect.line_findings(d, entropy={}).where(route.band(F.col("confidence")) != "dropped")
    first = {(r.unit_id, r.line_no, r.rule_id, r.match_ord.occurrence): r.rank for r in route.to_adjudicate(f).collect()}
    return sorted((r.unit_id, r.line_no, r.rule_id, r.match_ord.occurrence, first.get((r.unit_id, r.line_no, r.rule_id, r.match_ord.occurrence), 0)) for r in f.collect())


def run(spark, source, out, checkpoint):
    """One batch over what is new, from where the last run stopped: each call is a restart."""
    lines = spark.readStream.schema(SCHEMA).parquet(str(source))
    q = ranked_lines(lines, F.col("ended")).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(once=True).start()
    try:
        assert q.awaitTermination(120) and q.exception() is None
    finally:
        q.stop()


def found(spark, out):
    return sorted((r.unit_id, r.line_no, r.rule_id, r.occurrence, r.rank or 0) for r in spark.read.parquet(str(out)).collect())


def test_any_split_and_restarts(spark, tmp_path):
    units, rng = some_lines(1), random.Random(1)
    marks = [(u[0][0], None, None, None, None, True) for u in units if u]
    rows = [r for u in units for r in u]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 2))
    for part in [*(rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)), marks]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")
    assert found(spark, tmp_path / "out") == wanted(spark, units)
    assert "AKIA" not in str(spark.read.parquet(str(tmp_path / "out")).select("fingerprint", "redacted").collect())


def test_a_silent_unit_ends(spark, tmp_path):
    units = some_lines(5, 3)
    spark.createDataFrame([r for u in units for r in u], SCHEMA).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = ranked_lines(lines, F.col("ended"), silence="1 second").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    try:
        want, ends = wanted(spark, units), time.monotonic() + 60
        while time.monotonic() < ends and not ((tmp_path / "out").exists() and found(spark, tmp_path / "out") == want):
            time.sleep(1)
        assert found(spark, tmp_path / "out") == want
    finally:
        q.stop()
