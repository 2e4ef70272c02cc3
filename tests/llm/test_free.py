"""The other operators: round trips, brute force, held-out accuracy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leaksieve.llm import html_extract, line_dedup, ngram_join, packing, sentencepiece_scan, toxicity
from leaksieve.llm.graph import components
from leaksieve.llm.sentencepiece_scan import Pieces, chunk_ids, chunks_of, combine, marked, path_of_states, transfer
from leaksieve.llm.shingles import Shingler

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as f:
        return Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECES, "rb") as f:
        model = f.read()
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.pieces[500], "type", 4)):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        change(proto)
        with pytest.raises(ValueError, match="can't be used"):
            Pieces(proto.SerializeToString())


# HTML --------------------------------------------------------------------------------------------------------------------

ARTICLE = '<article><h1>Ti&amp;tle</h1><p><b>First, long enough paragraph of the text.<br><p>Second &lt;p&gt;  with\n\tspace &eacute;.</p><ul><li>one<li>two</ul></article>'
PAGES = [
    (f'<html><head><title>x</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy, buy, buy a lot of it now.</div>{ARTICLE}<footer>&copy; foot</footer></body></html>', "Ti&tle First, long enough paragraph of the text. Second <p> with space é. one two"),
    ('<body><div id="menu"><a href=x>Home</a></div><div class="content"><h1>Head</h1><p>One, two, three is a long paragraph, indeed.<p>Second paragraph is long enough too.</div><div class="sidebar"><p>Other, long, long, long paragraph there.</p></div><div id="comments"><p>I like it, really, very much, thanks.</p></div>', "Head One, two, three is a long paragraph, indeed. Second paragraph is long enough too."),
    ("<main><p>Short.</p><form>name <input></form><aside>no</aside><!-- c --><style>p{}</style></main>", "Short."),
    ("plain & simple", "plain & simple"), ("", ""), (None, ""), ("<p>cut o", "cut o"), ("<div", ""), ("a < b", "a < b"), ("<table><tr><td>aa<td>bb<tr><td>cc</table>", "aa bb cc"),
    ("<script>only()", ""), ("<p hidden>x</p><p>y</p>", "y"),
    # blocks of links go from inside the best container, headers of main without a title too
    ("<main><header><a href=/>Site name</a> Log in</header><h1>Head</h1><p>One, two, three is a long paragraph, indeed.<div><h3>Related stories</h3><ul><li><a href=1>One story</a><li><a href=2>Two story</a></ul></div></main>", "Head One, two, three is a long paragraph, indeed."),
    ("<main><header><h1>Title</h1></header><p>Text of it, with <a href=1>one</a> and <a href=2>two</a> links.</p></main>", "Title Text of it, with one and two links."),
    # a form is the page's frame, or a form
    (f"<body><form action=/><div><h1>Title</h1><p>{'One, two, three is long. ' * 8}</p></div><input></form>", "Title" + " One, two, three is long." * 8),
    ("<body><form><p>Search this site</p><input name=q></form><article><p>Text of it, long enough for points.</p></article>", "Text of it, long enough for points."),
    # points decide between containers: a teaser in an article goes where most text is beside it, and a wrapper inside an article doesn't lose its title
    (f"<body><article><p>A teaser, short as it is here.</p></article><div><p>{'The real text, with commas, and more. ' * 30}</p>{'<p>Another paragraph, of the same, real text, that goes on.</p>' * 20}</div>", ("The real text, with commas, and more. " * 30).strip() + " Another paragraph, of the same, real text, that goes on." * 20),
    (f"<body><article><h1>T</h1><div><div><div>{'<p>Some text, of a long, long kind, that is deep inside.</p>' * 30}</div></div></div></article>", "T" + " Some text, of a long, long kind, that is deep inside." * 30),
    # the only title comes along from before the container; not where there are two, nor from boilerplate
    (f"<body><div><h1>The title</h1></div><div><div class=content>{'<p>Some text, of a long, long kind, that is deep inside.</p>' * 3}</div></div>", "The title" + " Some text, of a long, long kind, that is deep inside." * 3),
    (f"<body><div><h1>One</h1></div><div><h1>Two</h1></div><div><div class=content>{'<p>Some text, of a long, long kind, that is deep inside.</p>' * 3}</div></div>", ("Some text, of a long, long kind, that is deep inside. " * 3).strip()),
    (f"<body><nav><h1>Menu</h1></nav><div><div class=content>{'<p>Some text, of a long, long kind, that is deep inside.</p>' * 3}</div></div>", ("Some text, of a long, long kind, that is deep inside. " * 3).strip()),
]


def test_html(spark):
    docs = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(docs).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.extract_pages(docs.limit(0)).count() == 0


def test_html_of_known_blocks():
    """Pages put together of blocks whose text is known: exactly the article's blocks come out, in order."""
    rng = random.Random(11)
    words = "stone river, light of the old town, green hills and a long road; tea for two, warm bread, some salt".split()
    prose = lambda least=12: " ".join(rng.choice(words) for _ in range(rng.randint(least, 60)))
    wrap = [("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="story"><div>', "</div></div>"), ("<article><section>", "</section></article>")]
    junk = [
        lambda: f"<nav><ul><li><a href=/a>{prose()}</a><li><a href=/b>b</a></ul></nav>",
        lambda: f'<div class="{rng.choice(["ad", "sidebar", "cookie-notice", "comments", "share social"])}"><p>{prose()}</p></div>',
        lambda: f"<aside><p>{prose()}</p></aside>",
        lambda: f"<script>var x = '<p>{prose()}</p>';</script><style>p {{}}</style><!-- {prose()} -->",
        lambda: f"<form><label>{prose()}</label><input></form>",
    ]
    for _ in range(300):
        blocks, want = [], []
        for _ in range(rng.randint(2, 12)):
            text = prose()
            kind = rng.choice(["p", "p", "p", "open p", "inline", "list", "quote"])
            want.append(text)
            a, b = text.split(" ", 1)
            blocks.append({"p": f"<p>{text}</p>", "open p": f"<p>{text}", "inline": f"<p><b>{a}</b>\n <a href=x>{b.split(' ')[0]}</a> {' '.join(b.split(' ')[1:])}</p>", "list": f"<ul><li>{a}<li>{b}</ul>", "quote": f"<blockquote>{text}</blockquote>"}[kind])
        title = " ".join(rng.choice(words) for _ in range(4))
        inside = [f"<h1>{title}</h1>", *blocks]
        for _ in range(rng.randint(0, 3)):
            inside.insert(rng.randint(1, len(inside)), rng.choice(junk)())
        start, end = rng.choice(wrap)
        page = "<html><head><title>t</title></head><body><header><a href=/>Site</a></header>" + "".join(rng.choice(junk)() for _ in range(rng.randint(0, 3))) + start + "".join(inside) + end + "".join(rng.choice(junk)() for _ in range(rng.randint(0, 3))) + "<footer>&copy; foot</footer></body></html>"
        assert html_extract.main_text(page) == " ".join([title, *want]), page


def test_html_never_fails_and_is_linear():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<li>", "<ul>", "<td>", "<tr>", "</table>", "<a href='x>'>", "text, ", "<", "<script>", "<!--", "-->", "&amp;", "<article>", "</b>", "<b>", "<body>", "</html>", "<h1>", "<![CDATA["]
    for _ in range(500):
        html_extract.main_text("".join(rng.choice(parts) for _ in range(40)))
    for part in ("<div>", "<p>a", "<li>", "<a ", "<b>", "</div>", "<!--", "&amp;", "<"):
        html_extract.main_text(part * 20_000)


# SentencePiece -----------------------------------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(3)
    bits = ["a", "b", " ", "the", "\n", "in", "  ", "一", "🎉", "é", ".", "ing", "er", "s", "on", "tion", "▁", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 400))) for _ in range(150)] + ["", " ", "   a  b ", " " * 500, "x" * 500, "the" * 200, "a<s>b</s>", "\x00"]


def test_encoding_is_the_librarys(pieces, library):
    for t in odd_texts():
        assert pieces.encode(marked(t)).tolist() == library.encode(t), t[:60]


def test_chunks_give_the_same(pieces, library):
    for t in odd_texts():
        parts = chunks_of(marked(t), 70, pieces.longest)
        matrices = [transfer(pieces, *p) for p in parts]
        if not t:
            continue
        left, right = matrices[0], matrices[-1]
        for m in matrices[1:]:
            left = combine(left, m)
        for m in matrices[-2::-1]:
            right = combine(m, right)
        assert left == right and len(left) == 1  # associative, and one path is left
        path = path_of_states(matrices)
        assert np.concatenate([chunk_ids(pieces, *p, a, b) for p, a, b in zip(parts, path, path[1:], strict=False)]).tolist() == library.encode(t)


def test_sentencepiece_documents(make_docs, texts, library):
    docs = make_docs(list(enumerate([*texts, *odd_texts()[:20], "x" * 3000])))
    encoded = sentencepiece_scan.encode_documents(docs, PIECES, chunk=512).cache()
    got = {r.doc_id: r for r in sentencepiece_scan.summarise(encoded).collect()}
    parts = defaultdict(list)
    for r in sentencepiece_scan.decode_documents(encoded, PIECES).collect():
        parts[r.doc_id].append((r.chunk_no, r.text))
    for r in docs.collect():
        ids = library.encode(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sum, g.ids_weighted) == (len(ids), sum(ids), sum(i * (k + 1) for k, i in enumerate(ids)))
        assert "".join(t for _, t in sorted(parts[r.doc_id])) == (r.text or "").replace("▁", " ")
        assert g.round_trip or "▁" in r.text
    assert max(len(p) for p in parts.values()) > 20
    assert sentencepiece_scan.summarise(sentencepiece_scan.encode_documents(make_docs([]), PIECES)).count() == 0


# Packing -----------------------------------------------------------------------------------------------------------------


def test_packing(make_docs, texts):
    t = Tokenizer.from_file(WORDS)
    rows = list(enumerate([*texts, "¬ a¬b ¬¬", "<|endoftext|> it's WE'LL", "a<|endoftext|>b ¬<|startoftext|> <|ENDOFTEXT|>", "nbsp and em \x1c sep"]))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(make_docs(rows), WORDS).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))

    def total(parts):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        return at

    assert {i: total(p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    sizes = [total(p) for p in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert max(sizes) <= 2048 and padding < 0.05 * sum(sizes)
    assert packing.pack_documents(make_docs([]), WORDS).count() == 0


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(100):
        at = [0, *sorted(rng.sample(range(1, 120), 30))]
        if max(b - a for a, b in zip(at, at[1:], strict=False)) > 20:
            continue
        cost = [0, *(rng.choice((0, 4, 32)) for _ in at[1:])]
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost[j] + 20 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 20)
        cuts = packing.best_cuts(np.array(at), np.array(cost), 20)
        worth = sum(cost[at.index(b)] + 20 - (b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == at[-1] and worth == best[len(at) - 1]


def test_sentences_that_fit_a_window_stay_whole():
    rng = random.Random(9)
    for window in (20, 64, 100):
        sizes = [rng.choice((1, 3, window // 2, window - 1, window, window + 1, 3 * window)) for _ in range(300)]
        tokens = np.concatenate([np.r_[np.zeros(n - 1, int), 7] for n in sizes])  # 7 ends a sentence
        ends = np.cumsum(sizes)
        docs = np.union1d(ends[rng.sample(range(300), 40)], ends[-1:])
        cuts = packing.best_cuts(*packing.cut_points(tokens, docs, np.array([7]), window), window)
        assert all(b - a <= window for a, b in zip(cuts, cuts[1:], strict=False))
        inside = np.searchsorted(ends, [c for c in cuts[1:] if c not in {*ends.tolist()}])
        assert all(sizes[k] > window for k in inside)


# Near copies -------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, z = sets[a][1], sets[b][1]
            if s and z and 100 * len(s & z) >= 75 * len(s | z):
                root[find(a)] = find(b)
    named = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        named[find(k)].append(i)
    return [(i, len(s), min((x for x in named[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)]


def test_ngram_join(make_docs, texts):
    rows = [*((100 + i, t) for i, t in enumerate(texts)), (5, texts[15]), (5, texts[20]), (None, texts[16]), (None, "lonely null id")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(make_docs(rows)).collect()]
    assert sorted(got, key=key) == sorted(classes(rows), key=key)
    assert ngram_join.link_documents(make_docs([])).count() == 0


def test_ngram_join_loses_no_link_of_loose_groups(make_docs):
    """Copies whose similarities lie around the threshold, with no text in the middle that all are near."""
    rng = random.Random(9)
    base, rows = [f"w{k}" for k in range(90)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(make_docs(rows)).collect()]
    assert sorted(got) == sorted(classes(rows))
    assert 1 < len({c for _, _, c in got}) < 160


def test_keep_one_of_each(make_docs, texts):
    rows = list(enumerate(texts))
    left = ngram_join.keep_one_of_each(make_docs(rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in classes(rows)})


def test_shingles_of_blocks_are_those_of_texts(texts):
    s = Shingler()
    raw = [None if t is None else t.encode() for t in [*texts, "word " * 60_000, "y" * 300_000 + " z z z z z"]]
    for a, t in zip(s.sets_of(raw), raw, strict=True):
        assert (a == s.sets(t)).all() and len(a) == len(shingle_set((t or b"").decode()))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Lines -------------------------------------------------------------------------------------------------------------------


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x < y and u < v for (x, u), (y, v) in zip(p, p[1:], strict=False))
    assert line_dedup.patience(list(range(5000)), list(range(2500, 7500))) == [(i, i - 2500) for i in range(2500, 5000)]


def test_patience_aligns_what_repeats():
    p = [1, 2, 3]
    assert line_dedup.patience([7, *p, 8, *p, 9], [5, *p, 6]) == [(1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([5, *p, 6], [7, *p, 8, *p, 9]) == [(1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([7, *p, 8, *p, 9], [5, *p, 6, *p, 4]) == [(1, 1), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7)]
    rng = random.Random(2)
    for _ in range(500):  # no common line is left between two aligned ones
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 15))] for _ in range(2))
        ends = [(-1, -1), *line_dedup.patience(a, b), (len(a), len(b))]
        assert not any(set(a[i + 1 : i2]) & set(b[j + 1 : j2]) for (i, j), (i2, j2) in zip(ends, ends[1:], strict=False))


def test_line_dedup(make_docs):
    p = [f"this is a rather long line number {k}" for k in range(9)]
    rows = [
        (1, "\n".join(p[:4])), (2, "new\n" + "\n".join(p[1:4]) + "\nshort\nown line of some words here"), (3, "\n".join([p[5], "ok", p[6]])), (4, "\n".join([p[5], "ok", p[6], p[0]])),
        (5, None), (6, ""), (7, "\n".join([p[8], p[8]])), (0, p[7]), (None, p[7]), (8, "ok\nshort\nnew"), (9, p[3] + "  \r\n" + "x"),
    ]
    got = {r.doc_id: (r.n_lines, r.deleted) for r in line_dedup.label_lines(make_docs(rows)).collect()}
    assert got == {0: (1, ""), 1: (4, ""), 2: (6, "1,2,3"), 3: (3, ""), 4: (4, "0,1,2,3"), 5: (1, ""), 6: (1, ""), 7: (2, ""), None: (1, "0"), 8: (3, ""), 9: (2, "0")}
    left = line_dedup.drop_repeated_lines(make_docs(rows))
    assert left.columns == make_docs([]).columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[2] == "new\nshort\nown line of some words here" and texts[5] is None and texts[1] == rows[0][1] and texts[None] == ""
    kept = [x for t in texts.values() if t for x in t.split("\n")]
    assert all(line in kept for line in p if any(line in (t or "") for _, t in rows))  # one copy of each stays
    assert line_dedup.label_lines(make_docs([])).count() == 0


def lines_by_brute_force(texts):
    """Of texts in the order of their ids, the lines in blocks that an earlier one holds too."""
    split = [[tuple(x.split()) for x in t.split("\n")] for t in texts]
    enough = lambda run: sum(map(len, run)) >= line_dedup.MIN_WORDS
    runs = lambda d: {(i, j): tuple(d[i:j]) for i in range(len(d)) for j in range(i + 1, len(d) + 1) if enough(d[i:j])}
    want, held = [], set()
    for d in split:
        want.append(sorted({k for (i, j), run in runs(d).items() if run in held for k in range(i, j)}))
        held.update(runs(d).values())
    return want


def deleted_by_query(make_docs, texts):
    got = {r.doc_id: r.deleted for r in line_dedup.label_lines(make_docs([*enumerate(texts)])).collect()}
    return [[int(k) for k in got[i].split(",") if k] for i in range(len(texts))]


def test_line_dedup_finds_blocks_in_any_order(make_docs):
    a, p, q, r = ("\n".join(f"line {k} of the passage {name}" for k in range(2)) for name in "apqr")
    texts = ["\n".join(x) for x in ([a, p, q], [p, a, q], [p, a, q], ["x", p, "y", p, "z"], [r, "own", r], ["u", r, "w"])]
    assert deleted_by_query(make_docs, texts) == [[], [*range(6)], [*range(6)], [1, 2, 4, 5], [], [1, 2]]
    rng = random.Random(3)
    longs = [f"some line of many words {k}" for k in range(6)]
    texts = ["\n".join(rng.choice([*longs, "", "one", "two words"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = deleted_by_query(make_docs, texts)
    assert got == lines_by_brute_force(texts)
    split = [line_dedup.line_hashes(t.encode()) for t in texts]
    for i, (own, words, _) in enumerate(split):  # and no pair can align a block that stayed
        assert all({*line_dedup.deleted_lines(own, words, other)} <= {*got[i]} for other, _, _ in split[:i])


def test_line_dedup_aligns_before_it_deletes():
    own, keeper = [1, 2, 3, 9, 4, 5], [4, 5, 7, 1, 2, 3]
    shared = [(0, 2, 3), (1, 3, 4), (4, 6, 0)]  # two windows in order, one that moved
    assert line_dedup.aligned_blocks(own, keeper, shared) == [(0, 3), (4, 6)]
    assert line_dedup.aligned_blocks(own, keeper, shared, align=lambda a, b: []) == []  # no alignment, no deletion
    asked = []
    line_dedup.aligned_blocks(own, keeper, shared, align=lambda a, b: asked.append((a, b)) or line_dedup.patience(a, b))
    assert asked == [(own, keeper), ([4, 5], [4, 5])]  # the whole lists, then what one order can't hold
    assert line_dedup.aligned_blocks([1, 2], [1, 8], [(0, 2, 0)]) == []  # a key that only seems equal
    assert line_dedup.aligned_blocks([1, 2, 1, 2], [1, 2], [(0, 2, 0), (2, 4, 0)]) == [(0, 4)]


def test_line_dedup_of_common_lines(make_docs):
    """More holders than are rare: rare windows pair near copies, common ones what is left."""
    notice = "\n".join(f"line {k} of a notice that all hold" for k in range(3))
    texts = [f"{'' if n % 3 else notice + chr(10)}own text of number {n} and more\n{notice}" for n in range(3 * line_dedup.RARE)]
    texts += [texts[5] + "\nits own last line, longer than five words", texts[6] + "\n" + texts[5]]
    assert deleted_by_query(make_docs, texts) == lines_by_brute_force(texts)


def test_line_dedup_finds_blocks_of_short_lines(make_docs):
    verse = [f"short {k}" for k in range(30)]
    texts = ["\n".join(x) for x in (verse, verse, ["own", *verse[5:9], "", "end"], verse[2:4], ["a b", "", "c d", "e"], ["x", "a b", "", "c d", "e", ""])]
    assert deleted_by_query(make_docs, texts) == lines_by_brute_force(texts) == [[], [*range(30)], [1, 2, 3, 4], [], [], [1, 2, 3, 4]]
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", "one", "two words", "now three words", "four words in all"]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    assert deleted_by_query(make_docs, texts) == lines_by_brute_force(texts)


# Toxicity ----------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, make_docs):
    rng = random.Random(6)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    bad = ["vilest", "scumword", "grubbed", "loutish"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(3, 6) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if i % 3:
            continue
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "plain"), (0, rows[0][1])]
    labels += [(2000, 1, None), (99999, 1, 1)]
    docs, known = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == y for p, y in held) > 0.97 * len(held) and sum(p for p, y in held if y) > 0.9 * sum(y for _, y in held)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, known.limit(0))).collect()} == {0.0}
    assert toxicity.score_documents(make_docs([]), model).count() == 0
    assert toxicity.score_documents(make_docs([]), toxicity.fit(make_docs([]), known.limit(0))).count() == 0


def test_held_out_labels_are_never_seen(spark, make_docs):
    rows = [(i, f"word{i % 7} bad" if i % 2 else f"word{i % 7} good") for i in range(60)]
    train = toxicity.training_rows(make_docs(rows), spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int"))
    assert train.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)


def test_equal_columns_and_lists_of_comments():
    column = "<p>A paragraph of some length, with a comma.</p>"
    assert html_extract.main_text(f"<div><div class=col>{column}</div><div class=col>{column.replace('A', 'Another')}</div></div>").count("paragraph") == 2
    page = f"<article>{column * 3}<ol class=commentlist><li>I like it, really, very much.</ol><div class='comment-form'>Say, say</div><p class=commentary>Some commentary, kept as it is.</p></article>"
    assert "like" not in html_extract.main_text(page) and "Say" not in html_extract.main_text(page) and "commentary" in html_extract.main_text(page)
