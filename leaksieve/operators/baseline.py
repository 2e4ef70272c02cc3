"""Accepted findings by one-way fingerprints, redaction, and reports that hold no secret."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import normalised_path, rfc3339_now
from ..sources.staging import discard, staged
from .documents import write_document
from .redact import redact
from .route import ORDER, verdict


def fingerprint(file: Column, rule: Column, secret: Column, snippet: Column, normalize_paths: bool = False) -> Column:
    """sha256 over file, rule and secret (else snippet), NUL between; a line's number plays no part."""
    name = normalised_path(file) if normalize_paths else file
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(empty(name), F.lit("\0"), empty(rule), F.lit("\0"), F.coalesce(secret, snippet, F.lit(""))), 256)


def with_fingerprint(findings: DataFrame, normalize_paths: bool = False) -> DataFrame:
    """``findings`` with their fingerprint. Those that have one keep it: so they can be staged without secret and snippet."""
    if "fingerprint" in findings.columns:
        return findings
    return findings.withColumn("fingerprint", fingerprint(F.col("file"), F.col("rule_id"), F.col("secret"), F.col("snippet"), normalize_paths))


def baseline_of(findings: DataFrame, normalize_paths: bool = False) -> DataFrame:
    return with_fingerprint(findings, normalize_paths).select("fingerprint").distinct()


def suppress(findings: DataFrame, baseline: DataFrame, normalize_paths: bool = False) -> DataFrame:
    """``findings`` without those of the baseline. The planner broadcasts a baseline it knows to be small."""
    return with_fingerprint(findings, normalize_paths).join(baseline.select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint")


#: Lines of a baseline that has a fingerprint a line, as it is written here and, with indents, elsewhere.
_OPEN, _CLOSE, _HASH = r"^\s*\{\s*$", r"^\s*\]?\s*\}\s*$", r'^\s*,?"([^"\\]*)",?\s*$'
_OTHER = r'^\s*(?:\],?|"version"\s*:\s*\d+,|"generated_at"\s*:\s*"[^"\\]*",|"fingerprints"\s*:\s*\[(?:\s*\])?)?\s*$'


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of a baseline's documents, in a file or a folder. Where there is none, or nothing in it parses, it is empty.

    A document with a fingerprint a line is read by lines, in as many tasks as it has splits. Any other is parsed whole.
    """
    try:
        lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "fingerprint string")
    v = F.col("value")
    of = lambda p: F.count_if(v.rlike(p))
    known = v.rlike(_OPEN) | v.rlike(_CLOSE) | v.rlike(_HASH) | v.rlike(_OTHER)
    ends = v.rlike(r'"\s*$') & v.rlike(_HASH)  # elements that no comma follows, less those that one precedes: all but one
    shape = lines.groupBy("file").agg(F.count_if(~known).alias("odd"), of(_OPEN).alias("opens"), of(_CLOSE).alias("closes"), of(_HASH).alias("n"), F.count_if(ends).alias("last"), F.count_if(v.rlike(r"^\s*,")).alias("led"), of("fingerprints").alias("lists"))
    fits = "odd = 0 and opens = 1 and closes = 1 and lists = 1 and (n = 0 or last = 1 and led = 0 or last = n and led = n - 1)"
    fitting = F.coalesce(F.expr(fits), F.lit(False)).alias("fits")
    documents = shape.select("file", fitting).collect()  # a row a document
    rest = [r.file for r in documents if not r.fits]
    file = F.col("file")
    by_line = (lines.where(~file.isin(rest)) if rest else lines).where(v.rlike(_HASH)).select(F.regexp_extract(v, _HASH, 1).alias("fingerprint"))
    if not rest:
        return by_line.where("fingerprint is not null").distinct()
    # documents read by lines are passed over before this, as one may be longer than a row can be
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(F.col("_metadata.file_path").isin(rest)).select("value")
    parsed = whole.select(F.explode(F.from_json("value", "fingerprints array<string>")["fingerprints"]).alias("fingerprint"))
    return by_line.unionByName(parsed).where("fingerprint is not null").distinct()


def write_baseline(findings: DataFrame, path: str, normalize_paths: bool = False, generated_at: str | None = None) -> None:
    """Accept all of ``findings``: one JSON document, the file ``path``, with version, generated_at and sorted fingerprints. ``read_baseline`` reads it."""
    prints = baseline_of(findings, normalize_paths).select("fingerprint", F.to_json(F.array("fingerprint")).alias("value"))
    at = generated_at or findings.sparkSession.range(1).select(rfc3339_now()).first()[0]
    element = prints.withColumn("value", F.substring("value", F.lit(2), F.length("value") - 2))
    write_document(element, ["fingerprint"], path, f'{{\n"version": 1,\n"generated_at": {json.dumps(at)},\n"fingerprints": [\n', "]\n}\n")


def replace_first(text: Column, secret: Column, token: Column) -> Column:
    """``text`` with the first occurrence of ``secret`` replaced; unchanged where there is none."""
    at = F.instr(text, secret)
    return F.when((F.length(secret) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), token, F.substring(text, at + F.length(secret), F.length(text)))).otherwise(text)


def needle(secret: Column, snippet: Column) -> Column:
    """What redaction looks for: the secret, else the snippet without a diff's mark in front."""
    return F.coalesce(secret, F.regexp_replace(snippet, r"^[+\- ]+|[+\- ]+$", ""))


def preview(snippet: Column, secret: Column, token: Column) -> Column:
    """The start of a snippet as redaction would leave it; the token alone where the secret isn't in that."""
    short, t = F.substring(snippet, 1, 80), F.coalesce(token, F.lit("REDACTED"))
    return F.when(short.isNotNull(), F.when(F.coalesce(short.contains(secret), F.lit(False)), replace_first(short, secret, t)).otherwise(t))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n", IntegerType())]))
def _redacted(texts: pd.Series, steps: pd.Series) -> pd.DataFrame:
    done = [(None, None) if t is None else redact(t, [(s["needle"], s["token"]) for s in found]) for t, found in zip(texts, steps, strict=True)]
    return pd.DataFrame(done, columns=["text", "n"]).astype({"n": "Int32"})


def redact_files(files: DataFrame, findings: DataFrame, only_blocked: bool = True) -> DataFrame:
    """path, text, n_redacted of ``path, text`` rows. A file's findings are applied in their order, each to its first occurrence, in time linear in both; files without findings don't leave the JVM."""
    f = findings.where(F.col("secret").isNotNull() & (verdict(F.col("tier"), F.col("confidence")) == "block")) if only_blocked else findings
    word = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    step = F.struct((-F.col("confidence")).alias("c"), *(F.col(c) for c in ORDER if c != "file"), word(needle(F.col("secret"), F.col("snippet")), "needle"), word(F.col("redacted"), "token"))
    steps = f.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    d = files.join(steps, "path", "left")
    plain = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(s["needle"].alias("needle"), s["token"].alias("token")))
    d = d.withColumn("done", _redacted(F.when(F.col("steps").isNotNull(), F.col("text")), plain))
    return d.select("path", F.coalesce("done.text", "text").alias("text"), F.coalesce("done.n", F.lit(0)).alias("n_redacted"))


LEVELS = {"T0": "error", "T1": "warning", "T2": "note"}


def level(tier: Column) -> Column:
    out = F.lit("none")
    for t, name in LEVELS.items():
        out = F.when(tier == t, name).otherwise(out)
    return out


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, level, message, uri, start_line, fingerprint: what a report says of a finding. Neither secret nor snippet."""
    return with_fingerprint(findings).select(*_result_columns())


def _result_columns() -> tuple[Column, ...]:
    return (
        F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), level(F.col("tier")).alias("level"),
        F.concat(F.lit("["), F.coalesce("tier", F.lit("?")), F.lit("] "), F.coalesce("description", F.lit("Potential secret or IP leak"))).alias("message"),
        normalised_path(F.coalesce("file", F.lit(""))).alias("uri"), F.greatest(F.coalesce("line_no", F.lit(1)), F.lit(1)).alias("start_line"), "fingerprint",
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, description: each rule once, with its first finding's description."""
    first = F.struct((-F.col("confidence")).alias("c"), "unit_id", *ORDER, "description")
    return findings.where("rule_id is not null").groupBy("rule_id").agg(F.min(first).alias("f")).select("rule_id", F.coalesce("f.description", "rule_id").alias("description"))


SARIF = "2.1.0"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def write_sarif(findings: DataFrame, path: str, tool: str = "leaksieve", version: str = "1") -> None:
    """A SARIF log of one run, the file ``path``, with all results by place and each rule once. ``findings`` are worked out once.

    What is staged for that has neither secrets nor snippets. The rules are at most the catalog's, and stand behind the results.
    """
    report = with_fingerprint(findings).select(*_result_columns(), F.struct((-F.col("confidence")).alias("c"), "unit_id", *ORDER, "description").alias("first"), F.col("rule_id").alias("id"))
    report = staged(report, "report")
    text = lambda c: F.struct(F.col(c).alias("text"))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", text("message").alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias(f"{tool}Fingerprint/v1")).alias("partialFingerprints"))
    rules = report.where("id is not null").groupBy("id").agg(F.min("first").alias("first")).select("id", F.coalesce("first.description", "id").alias("text")).orderBy("id").collect()
    catalog = [{"id": r.id, "name": r.id, "shortDescription": {"text": r.text}} for r in rules]
    driver = json.dumps({"driver": {"name": tool, "version": version, "rules": catalog}}, ensure_ascii=False)
    write_document(
        report.withColumn("value", F.to_json(result)), ["uri", "start_line", "rule_id", "fingerprint"], path,
        f'{{"$schema": {json.dumps(SCHEMA)}, "version": "{SARIF}", "runs": [{{"results": [\n', f'],\n"tool": {driver}\n}}]}}\n',
    )
    discard(report)


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, for logs: no secret, no snippet."""
    out = F.struct("file", F.col("line_no").alias("line"), F.col("rule_id").alias("match_type"), "tier", "layer", "confidence", "description", F.upper(verdict(F.col("tier"), F.col("confidence"))).alias("verdict"))
    return findings.select(F.to_json(out, {"ignoreNullFields": "false"}).alias("value"))


def history_json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object a finding of a history scan (with sha and subject): no secret, no snippet."""
    out = F.struct(F.col("sha").alias("commit"), "subject", "file", F.col("line_no").alias("line"), F.col("rule_id").alias("match_type"), "tier", "layer", "confidence", "description")
    return findings.select(F.to_json(out, {"ignoreNullFields": "false"}).alias("value"))


def json_documents(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON object a file: file, clean and its findings in order. Snippets are part of it, secrets are not."""
    one = F.struct((-F.col("confidence")).alias("_c"), *(F.col(c).alias(f"_{c}") for c in ORDER if c != "file"), F.struct(F.col("line_no").alias("line"), F.col("rule_id").alias("match_type"), "tier", "layer", "confidence", "description", "snippet", "redacted").alias("f"))
    found = findings.groupBy(F.col("file").alias("path")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["f"]).alias("found"))
    d = files.select("path").distinct().join(found, "path", "left")
    return d.select(F.to_json(F.struct(F.col("path").alias("file"), F.col("found").isNull().alias("clean"), F.coalesce("found", F.array()).alias("findings")), {"ignoreNullFields": "false"}).alias("value"))
