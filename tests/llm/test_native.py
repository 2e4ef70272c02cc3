"""Exact dedup, sharding, quality rules and PII against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leaksieve.llm import exact_dedup, pii, quality, sharding

WS, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def numbered(texts):
    return list(enumerate(texts))


def test_exact_dedup(make_docs, texts):
    rows = [*numbered(texts), (None, "a"), (None, "only null id"), (3, texts[3])]
    groups = defaultdict(list)
    for i, t in rows:
        groups[WS.sub(" ", t or "")].append(i)
    got = exact_dedup.label_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        (ids,) = [g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = exact_dedup.drop_copies(make_docs(rows))
    assert left.columns == make_docs([]).columns
    assert Counter(WS.sub(" ", r.text or "") for r in left.collect()) == Counter(list(groups))


def test_exact_dedup_compares_texts_beside_digests(make_docs, monkeypatch):
    real = exact_dedup._normalised
    monkeypatch.setattr(exact_dedup, "_normalised", lambda *a: real(*a).withColumn("digest", F.unhex(F.lit("00"))))
    got = exact_dedup.label_documents(make_docs([(0, "a"), (1, "b"), (2, "a")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_sharding(make_docs, texts, tmp_path):
    rows = [*numbered(texts), (None, "x"), (None, "y"), (7, "again"), *[(9, "same")] * 5]
    got = sharding.assign_shards(make_docs(rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    docs = make_docs([(i, "") for i in range(6000)])
    share = Counter(r.shard for r in sharding.assign_shards(docs, weights=(1.0, 2.0, 0.0)).collect())
    assert share[2] == 0 and 1.8 < share[1] / share[0] < 2.2
    sharding.write_shards(make_docs(numbered(texts)), str(tmp_path / "s"), files_per_shard=2)
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(texts)


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(make_docs, texts):
    more = ["w1 w2 w3 w4 w5 w6 w7 w8 " * 3 + "tail", "a b\na b\nc " * 9, "## ** | " * 30, "ab " * 200]
    rows = numbered([*texts, *more])
    got = {r.doc_id: r for r in quality.judge(make_docs(rows)).collect()}
    for i, t in rows:
        n, chars, symbols, dup, repeat = want = statistics(t)
        r = got[i]
        assert tuple(r[c] for c in quality.BASE) == want, (i, t)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.base_failed and r.kept)
        assert r.kept == (r.rejected_by is None)
    assert got[15].kept and not got[len(texts) + 2].kept


def test_the_order_of_rules_changes_no_verdict(make_docs, texts):
    docs, rules = make_docs(numbered(texts)), quality.default_rules()
    forth = [quality.Estimate(r.name, 1.0, float(i)) for i, r in enumerate(rules)]
    back = [quality.Estimate(r.name, 1.0, -float(i)) for i, r in enumerate(rules)]
    d = quality.with_statistics(docs)
    known = quality.Document(quality.whole_text("text"), quality.words_of(quality.whole_text("text")), F.col)
    got = d.select("doc_id", quality.cascade(rules, forth, known).isNull().alias("a"), quality.cascade(rules, back, known).isNull().alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
    found = quality.estimate_rules(docs, rules)
    assert [e.name for e in found] == [r.name for r in rules] and all(e.cost_s > 0 and 0 <= e.rejects <= 1 for e in found)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


ODD = [
    "mail a@b.c_d@e.f and x..y@z.de, u@v..w", "ip 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x 4111  1111 1111 1111", "+1 (743) 555-3824 +49+30 1234567 +1 2",
    "é漢字🎉 a@b.cd 🎉 +1 (743) 555-3824", "@@ a@ @b.c a@b", "1 " * 3000, "a@b" + ".c" * 3000, "9" * 20000, "a." * 20000 + "@b.c", "1.1." * 5000, "+" * 5000, "x@y.zz " * 2000, None, "",
]


def test_pii(make_docs, texts):
    rows = numbered([*texts, *ODD])
    got = {r.doc_id: r for r in pii.find_spans(make_docs(rows)).collect()}
    for i, t in rows:
        found = [(s.start, s.kind_no, s.end, s.kind) for s in got[i].pii if s.kind_no < 4]
        assert found == spans(t), (i, (t or "")[:80])
        assert all(t[s.start : s.end] == s.text for s in got[i].pii)


def test_ibans_by_remainder_and_context(make_docs):
    good, bad = "DE89370400440532013000", "DE89370400440532013001"
    rows = numbered([f"pay {good} now", f"pay {bad} now", f"x{good}", f"bank account {good}", f"example {good}"])
    got = {r.doc_id: [(s.kind, s.score) for s in r.pii if s.kind == "iban"] for r in pii.find_spans(make_docs(rows)).collect()}
    assert got == {0: [("iban", 0.6)], 1: [], 2: [], 3: [("iban", 0.8)], 4: []}


def test_redaction(make_docs):
    rows = [(0, "to a@b.cd, +1 (743) 555-3824."), (1, None), (2, "nothing"), (3, "🎉 1.2.3.4 🎉"), (4, "+4111111111111111 x"), (5, "x@y.zz " * 500)]
    got = {r.doc_id: r.text for r in pii.redact(make_docs(rows)).collect()}
    assert got == {0: "to <EMAIL>, <PHONE>.", 1: None, 2: "nothing", 3: "🎉 <IP> 🎉", 4: "+<CARD> x", 5: "<EMAIL> " * 500}


def test_empty_tables(make_docs):
    none = make_docs([])
    assert exact_dedup.label_documents(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert sharding.assign_shards(none).count() == 0 and quality.judge(none).count() == 0 and pii.find_spans(none).count() == 0


def test_rules_of_equal_worth_keep_their_order(spark):
    rules = [quality.Rule(name, lambda d: d.n_words > 0) for name in ("first", "second", "third")]
    docs = spark.createDataFrame([("a b",)], "text string")
    d = quality.Document(F.col("text"), quality.words_of(F.col("text")), lambda n: F.size(quality.words_of(F.col("text"))))
    asked = lambda *worth: docs.select(quality.cascade(rules, [quality.Estimate(r.name, 1.0, w) for r, w in zip(rules, worth, strict=True)], d)).first()[0]
    assert asked(0.0, 0.0, 0.0) == "first" and asked(0.1, 0.5, 0.5) == "second" and asked(0.1, 0.2, 0.5) == "third"
