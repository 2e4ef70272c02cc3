"""The pipeline and the queries against the small tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from leaksieve.llm import pii, quality
from leaksieve.llm.queries import ORACLE_SQL, QUERIES

from .test_free import classes
from .test_native import WS, spans, statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in found.fetchall())


def test_ngram_query(spark, documents):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard_join"](spark, SF).collect()]
    assert sorted(got) == sorted(classes(documents))


def kept_by_rules(text):
    import re

    n, chars, symbols, dup, repeat = statistics(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    letters = sum(c.isalpha() for c in text)
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return not (symbols > 0.2 * n or dup > 0.6 * (text.count("\n") + 1) or not 2 <= chars / n <= 15 or stutter > 0.3 * n or letters * 2 < chars)


def test_pipeline_against_brute_force(spark, documents):
    docs = [(i, t) for i, t in documents if kept_by_rules(t or "")]
    first = {}
    for i, t in sorted(docs):
        first.setdefault(WS.sub(" ", t or ""), i)
    docs = [(i, t) for i, t in docs if first[WS.sub(" ", t or "")] == i]
    names = {i: c for i, _, c in classes(docs)}
    docs = [(i, t) for i, t in docs if names[i] == i]

    def redacted(text):
        out, at = [], 0
        for start, _, end, kind in spans(text):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join(out) + text[at:]

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*t.encode(redacted(x), add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    sizes = {}
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(x) for i, x in want.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert step(spark, docs.limit(0), SF).count() == 0


def test_redaction_only_touches_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same = docs.join(pii.redact(docs).select("doc_id", "text").withColumnRenamed("text", "clean"), "doc_id")
    assert all((r.text == r.clean) == (not spans(r.text)) for r in same.collect())
