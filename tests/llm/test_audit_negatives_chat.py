"""The filter audit, hard negatives and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import chat_format, filter_audit, hard_negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Of (doc_id, text, lang) rows the letters that each fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append({k for k, v in f.items() if v})
    return out


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                early = sum(f in x[1] for x in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), early, sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
    for part in {p for p, _, _ in out}:
        for f in "ABCDE":
            of = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in of)
            for k in of:
                out[k].append(total)
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, texts):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(900, long, "en"), (901, long, "de"), (902, long + " #", "en"), (903, long.upper(), "en"), (904, "a b " * 60, "de"), (None, long, "en"), (None, None, None), (900, long, "en"), (900, long, "de"), (5, long, "fr"), (2, "a", "en")]
    labels = [(i, i % 2, i % 3) for i in range(0, 910, 5)] + [(900, 0, 1), (900, 1, 0), (900, None, None), (None, 1, 1), (904, None, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, A int, part string, n int")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert Counter(r.removed for r in one) == {1: 120, 0: 480} and {r.part for r in one} == {""}


def brute_negatives(rows, dim, most=5):
    """Of (vec_id, embedding, label) rows, labels changed as the query does."""
    limit = math.isqrt((2**63 - 1) // dim)
    good = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v] + [0] * (dim - len(v))
        if all(abs(x) <= limit for x in q):
            good.append((i, (y + 1) % 10 if i % 7 == 0 else y, q))
    anchors = {}
    for r in good:
        if r[0] % 100 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r, key=lambda r: r[1:])
    out = set()
    for a, label, q in anchors.values():
        score = [(i, y, sum(s * t for s, t in zip(q, p, strict=True))) for i, y, p in good]

        def first(found):
            best = {}
            for i, s in found:
                best[i] = max(best.get(i, s), s)
            return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]

        for p, ps in first((i, s) for i, y, s in score if y == label and i != a):
            for k, (n, s) in enumerate(first((i, s) for i, y, s in score if y != label and 80 * ps <= 100 * s <= 100 * ps)):
                out.add((a, p, k + 1, n, ps, s))
    return out


def vectors(seed, n, dim, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in centres[i % 4]], i % 4) for i in range(n)]
    same = rows[5][1]
    rows += [(n + i, same, 1) for i in range(40)] + [(2 * n + i, same, 2) for i in range(40)]  # many ties
    rows += [(3 * n, None, 1), (3 * n + 1, rows[0][1], None), (None, rows[0][1], 1), (3 * n + 2, [1.0, None], 1), (3 * n + 3, [math.nan] * dim, 1), (3 * n + 4, [math.inf] * dim, 1)]
    rows += [(3 * n + 5, [3e30] * dim, 1), (3 * n + 6, [1e5] * dim, 1), (3 * n + 7, [0.5], 2), (3 * n + 8, [], 3), (3 * n + 9, [0.0] * dim, 0)]
    rows += [rows[0], (0, rows[7][1], 3), (100, rows[9][1], 2), rows[3], (3, rows[8][1], 3)]  # ids that repeat
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int"


def negatives(spark, rows, **more):
    i, y = F.col("vec_id"), F.col("label").cast("long")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, i % 100 == 0, F.when(i % 7 == 0, (y + 1) % 10).otherwise(y), **more).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize(("dim", "spread", "more"), [(16, 0.6, {}), (3, 2.0, {"chunk": 6}), (1, 1.0, {})])
def test_hard_negatives(spark, dim, spread, more):
    rows = vectors(dim, 700, dim, spread)
    assert negatives(spark, rows, **more) == brute_negatives([(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, y) for i, v, y in rows], dim)


def test_hard_negatives_of_nothing(spark):
    assert negatives(spark, []) == set() and negatives(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == {(0, 2, 1, 1, 0, 0)} and negatives(spark, [(1, [1.0], 1)]) == set()


def test_rotation_slack_covers_rounding():
    rng = np.random.default_rng(1)
    for dim, size in ((64, 300), (5, 2**30), (128, 2**27)):
        q = rng.integers(-size, size, (200, dim))
        turn = hard_negatives.Rotation.fit(q[:50], dim)
        t = hard_negatives.Turned(q, turn)
        exact = q.astype(object) @ q.T.astype(object)
        assert all(abs(int(e) - u) <= turn.slack * n for e, u, n in zip(exact.ravel(), (t.u @ t.u.T).ravel(), np.outer(t.norm, t.norm).ravel(), strict=True))
        a, b = hard_negatives.survivors(t, t, np.arange(200), np.arange(200), np.percentile(exact.astype(float), 90, axis=0), np.full(200, np.inf), turn.slack)
        want = {(i, j) for i, j in zip(*np.nonzero(exact.astype(float) >= np.percentile(exact.astype(float), 90, axis=0)[None]), strict=True)}
        assert want <= set(zip(a, b, strict=True)) and (size > 300 or len(a) < 1.5 * len(want))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEMPLATE = chat_format.Template()
NASTY = ["</s>", "[INST]", "[/INST] x", "[\\INST]", "[\\\\INST][\\", "a[", "<", "[", "\\", "<|endoftext|>", "<\\|endoftext|>", "[[INST]]", "<</s>>", "[ROLE]system[/ROLE]", "<s", "s>", "INST]", "[INST", "\u2028\u0000 é漢🎉", " lead", "trail ", "", "\n\n", "</s>[INST] ok [/INST]"]


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        text, loss, chars = "", "", 0
        for _, _, r, x in turns:
            text += f"{r}\n{x}\n"
            loss += x if r == "assistant" else ""
            open_, close = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}.get(r, (f"[ROLE]{TEMPLATE.escape(r)}[/ROLE][TURN]", "[/TURN]"))
            chars += len(open_ + TEMPLATE.escape(x) + close)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def chats(texts):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "[INST]", "", None, "Assistant"]
    pool = [*NASTY, *texts]
    rows = [(c, t, rng.choice(roles), rng.choice(pool)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(-30, 30000, 7)]  # over several blocks
    rows += [(51, t, "user", "x") for t in (None, None, 3, 9000)] + [(None, 1, "user", "none"), (None, 0, "assistant", None), (0, 1, "user", "again"), (0, 1, "user", "again"), (0, 1, "assistant", "b")]
    return rows


def test_chat_format_reads_back(spark, texts):
    rows = chats(texts)
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, block int, x boolean").repartition(5)
    got = chat_format.read_back(df, TOKENIZER).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == brute_chat(rows) and len(got) == len({r[0] for r in rows})


def test_chat_pieces_lie_behind_each_other(spark, texts):
    rows = chats(texts)
    df = spark.createDataFrame(rows, "`a.b` long, turn long, role string, text string")
    by = defaultdict(list)
    for r in chat_format.format_turns(df, TOKENIZER, conv_col="a.b").collect():
        by[r.conv_id].append(r)
    assert {c: len(v) for c, v in by.items()} == Counter(r[0] for r in rows)
    codec = chat_format.Codec(open(TOKENIZER, encoding="utf-8").read(), TEMPLATE)
    for c, pieces in by.items():
        pieces.sort(key=lambda r: r.turn_no)
        assert [r.turn_no for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [sum(len(p.ids) for p in pieces[:k]) for k in range(len(pieces))] if len(pieces) < 100 else pieces[-1].start == sum(len(p.ids) for p in pieces[:-1])
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        for p, (_, _, role, text) in zip(pieces, own, strict=True):
            plain = codec.tokenizer.encode(TEMPLATE.escape(text), add_special_tokens=False).ids
            learned = [i for i, m in zip(p.ids, p.loss, strict=True) if m]
            assert learned == (plain if role == "assistant" else []) and p.ids[-1] >= codec.base and p.ids[-1 - len(plain) : -1] == plain


def test_chat_template():
    for a in NASTY:
        for b in NASTY:
            t = TEMPLATE.escape(a + b)
            assert TEMPLATE.unescape(t) == a + b and not any(c in t for c in (*TEMPLATE.controls, *TEMPLATE.reserved))
    with pytest.raises(ValueError, match="can't be escaped"):
        chat_format.Template(reserved=("<<x>",))
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("ab é.1\n") for _ in range(rng.randint(1, 9))) for _ in range(60000))
    codec = chat_format.Codec(open(TOKENIZER, encoding="utf-8").read(), TEMPLATE)
    assert len(list(chat_format._parts(long))) > 3 and codec.encode([long])[0].tolist() == codec.tokenizer.encode(long, add_special_tokens=False).ids


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(df, TOKENIZER).collect() == [] and chat_format.format_turns(df, TOKENIZER).collect() == []
