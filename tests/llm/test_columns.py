"""Columns of any name stay what they are where an operator keeps rows, and change nothing where it returns its own."""

import corpus_pipeline
import public_tokenizers
import pytest

from leaksieve.llm import exact_dedup, html_extract, line_dedup, packing, pii, quality, sentencepiece_scan, sharding, toxicity

NAMES = [
    "pii", "kept", "_words", "_lines", "_id", "_sha", "_row", "_kept", "_text", "a.b", "my col", "x`y", "rest", "id", "sha", "hash", "to", "part", "row", "at", "node", "digest", "norm",
    "salt", "token", "root", "deleted", "clean", "words", "n_words", "base_failed", "lost_id", "lost_sha", "lost_hash", "wanted", "text_hash", "first", "size", "slot", "score", "bucket",
]
PROSE = "The old river runs by the town and the green hills, where long roads meet; nobody knows who built the stone bridge there, or when it fell."
TEXTS = [PROSE, PROSE, PROSE + " Yes.", "Call +1 (743) 555-3824 or write to a@b.cd about " + PROSE[40:], None, "", "x", " ".join(PROSE.split()[::-1])]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pair(spark):
    """The same documents with and without the extra columns."""
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (7, "another text under an id that is there"), (None, PROSE)]
    odd = spark.createDataFrame([(i, t, *(f"{n} of {t and len(t)}" for n in NAMES)) for i, t in rows], f"doc_id long, text string, {quoted}")
    return odd, odd.select("doc_id", "text")


KEEP = {
    "quality": quality.keep_good,
    "exact": exact_dedup.drop_copies,
    "redact": pii.redact,
    "lines": line_dedup.drop_repeated_lines,
}


@pytest.mark.parametrize("name", list(KEEP))
def test_rows_keep_their_columns(pair, name):
    odd, plain = pair
    got = KEEP[name](odd)
    assert got.columns == odd.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted((r[:2] for r in got), key=repr) == rows_of(KEEP[name](plain))
    was = [tuple(r) for r in odd.collect()]
    assert all(any(r[2:] == o[2:] and r[0] == o[0] for o in was) for r in got)


def test_shards_keep_their_columns(pair, tmp_path):
    odd, _ = pair
    sharding.write_shards(odd, str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out")).drop("shard")
    assert back.columns == odd.columns and rows_of(back) == rows_of(odd)
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(odd.withColumnRenamed("to", "Shard"), str(tmp_path / "other"))


WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
OWN = {
    "sentencepiece": lambda d: sentencepiece_scan.summarise(sentencepiece_scan.encode_documents(d, PIECES)),
    "sharding": sharding.assign_shards,
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.Model({"river": 1.0}, frozenset(["river"]), (0.0,) * (len(toxicity.HITS) + 2), 0.0)),
    "packing": lambda d: packing.pack_documents(d.coalesce(1), WORDS),
    "lines": line_dedup.label_lines,
    "exact": exact_dedup.label_documents,
    "html": lambda d: html_extract.extract_pages(d.selectExpr("*", "text AS html", "'u' AS url"), "doc_id"),
}


@pytest.mark.parametrize("name", list(OWN))
def test_own_results_dont_see_them(pair, name):
    odd, plain = pair
    assert rows_of(OWN[name](odd)) == rows_of(OWN[name](plain))


@pytest.mark.parametrize("judge", [quality.judge, pii.find_spans])
def test_only_names_that_are_added_change(pair, judge):
    odd, plain = pair
    got, want = judge(odd), judge(plain)
    added = [c for c in want.columns if c not in plain.columns]
    assert [c for c in got.columns if c not in added] == [c for c in odd.columns if c not in added]
    assert rows_of(got.select("doc_id", "text", *added)) == rows_of(want)


def test_pipeline_takes_them(spark, pair):
    docs, _ = pair
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == pair[0].columns
        docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
