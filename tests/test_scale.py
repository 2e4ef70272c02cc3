"""What keeps the scan's queries linear: each line looked at once, by one pattern, and each document read once."""

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import baseline, detect
from leaksieve.operators.rules import RULES
from leaksieve.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_is_one_pattern_and_passes_every_line_with_a_literal(spark):
    odd = ["toKen = 1", "APİ", "'a'\x0b+\x0b'b'", "Ａ", "\U0001d400", "plain", "", None, "é", "Köln"]
    texts = [f"x{g.upper() if r.any_case else g}y" for r in RULES for g in r.gates] + odd
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    gate = d.where(detect._may_hit(RULES, True))
    assert "contains" not in plan(gate).lower()
    passed = {r.text for r in gate.collect()}
    assert passed >= {*texts[: -len(odd)], *odd[:5]} and not passed & {"plain", "", None, "Köln"}
    assert {r.text for r in d.where(detect._may_hit(RULES, False)).collect()} & set(odd) == set(odd[:3])


def test_candidates_are_no_generators_argument(spark):
    d = spark.createDataFrame([("u", "f", "py", 1, "k = 1")], "unit_id string, file string, ext string, line_no int, text string")
    generators = [x for x in plan(detect.rule_hits(d, nfkc=False)).splitlines() if "Generate explode" in x]
    assert generators and not any("AKIA" in x for x in generators)
    assert plan(detect.rule_hits(d, nfkc=False)).count("Contains(") < 150  # each literal's test stands there once


@pytest.mark.parametrize("name", ["adjudicated", "baseline_suppress"])
def test_findings_are_worked_out_once(spark, monkeypatch, name):
    seen, plain = spark.sparkContext.accumulator(0), queries._findings

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def counted(spark, sf_dir):
        f = plain(spark, sf_dir)
        return f.mapInArrow(count, f.schema)

    n = plain(spark, SF).count()
    monkeypatch.setattr(queries, "_findings", counted)
    assert queries.QUERIES[name](spark, SF).count() and seen.value == n


def test_documents_read_by_lines_are_not_read_whole(spark, tmp_path):
    f = spark.createDataFrame([("f", "r", str(i), None) for i in range(5)], "file string, rule_id string, secret string, snippet string")
    baseline.write_baseline(f, str(tmp_path / "a"))
    known = baseline.read_baseline(spark, str(tmp_path))
    assert plan(known).count("Relation [") == 1 and known.count() == 5
    (tmp_path / "b c").write_text('{"fingerprints": ["x", "y"]}')
    assert baseline.read_baseline(spark, str(tmp_path)).count() == 7


def test_lines_of_a_sarif_log_are_told_by_their_start(spark):
    d = queries.QUERIES["sarif_run"](spark, SF)
    assert plan(d).count("StartsWith(") >= 3 and d.count() == queries._findings(spark, SF).count()
