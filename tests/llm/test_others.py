"""Pages, vectors, archives and pieces."""

import gzip
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docfacts.llm import html_text, queries, sentencepiece_lattice, topk, warc

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">one</a></li><li><a>two</a></li></ul></nav><div class="ad">Buy our many fine things today now.</div>'
    "<article><h1>Head line</h1><p>First &amp; second\n  part.<br><p>More <b>bold</b>text here, with enough words to count.</p><form>Your mail <input></form><div class='comments'>I agree</div></article>"
    "<footer>&copy; site and other words of the footer that go on</footer></body></html>"
)


def test_html_extraction(spark):
    pages = [(i, f"http://h/{i}", PAGE.replace("First", f"First{i}"), 1) for i in range(20)] + [(50, None, None, 1), (51, "u", "", 1), (None, "u", "<p>plain words", 1), (52, "u", "<div><div <p>broken <!-- never closed", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[3].text == "Head line\nFirst3 & second part.\nMore boldtext here, with enough words to count."
    assert got[50].text == got[51].text == "" and got[50].n_chars == 0 and got[50].url is None
    assert got[None].text == "plain words" and "never" not in got[52].text
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ['class="entry-content no-sidebar"', 'id="page" class="has-sidebar"', 'id="related-work"', 'class="single social-share-enabled"', 'data-id="x-nav"', 'data-x="a class=nav"', 'class="sidebar"', "class=search"])
def test_wrappers_do_not_hide_the_page(wrap):
    text = "Head line\nFirst & second part.\nMore boldtext here, with enough words to count."
    weights = html_text.learn([PAGE] * 5)
    assert html_text.main_text(PAGE.replace("<article>", f"<div {wrap}><article>").replace("</article>", "</article></div>"), weights) == text
    assert html_text.main_text(f"<div {wrap}><p>plain words of the page</p></div><p>more", html_text.Weights()) == "plain words of the page"


@pytest.mark.parametrize("hint", ['class="ad"', 'class="x share y"', "id=comments", "role='navigation'", 'aria-label="breadcrumb"'])
def test_hinted_elements_are_skipped(hint):
    assert html_text.main_text(f"<p>one two three four five six seven <div {hint}>eight nine</div> ten eleven twelve", html_text.Weights()) == "one two three four five six seven\nten eleven twelve"


BODY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<p class="ad">Buy now cheap</p>', ""), ("<p class=ad>Buy<p>after it", "after it\n"), ('<div class="user-comments">I agree</div>', ""), ('<span id="cookie-notice">We use cookies</span>', ""),
        ("<header><h1>The title of this whole article</h1></header>", "The title of this whole article\n"), ('<header class="site banner">x y</header>', ""), (f'<div class="notice board"><p>{BODY} board</p></div>', f"{BODY} board\n"),
        (f'<table class="search results"><tr><td>{BODY} cell</td></tr></table>', f"{BODY} cell\n"), ('<div class="notice board">short</div>', ""), ('<li class="no-comments">one item</li>', "one item\n"), ("<p class='has-ads'>two words</p>", "two words\n"),
        ('<b class="promo">now</b> then', "then\n"), ('<img class="ad">picture text', "picture text\n"), ('<ul><li class="share">share me<li>stay here</ul>', "stay here\n"),
    ],
)
def test_what_is_dropped_within_the_content(inside, kept):
    weights = html_text.learn([PAGE] * 5)
    page = f"<html><body><nav><a>x</a></nav><article>{inside}<p>{BODY}</p></article><footer>f g</footer></body></html>"
    assert html_text.main_text(page, weights) == kept + BODY


def test_words_outside_the_content_are_learnt():
    page = "<body><div class='zeta x'>one two</div><div class=wrap><article><p class=x>{}</p></article></div><div class=zeta>three</div></body>".format(BODY)
    assert html_text.outside_only([page] * 5) == {"zeta"} and not html_text.outside_only([page] * 4)
    weights = html_text.learn([page] * 5)
    assert html_text.main_text(f"<p>{BODY}<div class=zeta>{BODY}</div>", weights) == BODY  # also on a page without article
    assert html_text.main_text(f"<p>{BODY}<div class=other>more words of the page</div>", weights) == f"{BODY}\nmore words of the page"


def test_raw_names_end_and_closed_images_are_empty():
    weights = html_text.Weights()
    assert html_text.main_text("<p>one two <svg width='1'/>three four</p><p>five six", weights) == "one two three four\nfive six"
    assert html_text.main_text("<title-bar>one two</title-bar> three <svg><text>x</text></svg>four", weights) == "one two three four"


def test_best_region_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randrange(-5, 6) for _ in range(rng.randrange(9))]
        a, b = html_text.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def top_by_hand(rows, k):
    good = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = Counter()
    for i, q in {(i, tuple(v)) for i, v in good if i % 5 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
        out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("size", [3, 700])
def test_top_k_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(size)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(5, None), (None, [1.0] * 6), (15, [None] * 6), (20, [float("nan")] * 6), (25, [float("inf")] * 6), (2030, [0.1, 0.2]), (2035, [0.3, 0.2]), (1000, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == top_by_hand(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_the_tree_leaves_out_candidates():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (2000, 8)) + c for c in (0, 500, -500)]).astype(np.int64)
    top = float((x * x).sum(axis=1).max())
    tree, count, best = topk.build(np.arange(len(x)), x, top), [0], []
    topk.search(tree, -1, x[2500], float((x[2500] ** 2).sum()), top, best, 5, -np.inf, count)
    assert sorted((s for s, _ in best), reverse=True) == sorted((x @ x[2500]).tolist(), reverse=True)[:5]
    assert count[0] < len(x) / 2


def test_scores_of_doubles_are_whole_and_equal():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 16))
    top = float((x * x).sum(axis=1).max())
    tree = topk.build(np.arange(len(x)), x, top)
    tree["x"] = x.astype(float)
    for n in range(0, 3000, 500):
        best = []
        topk.search(tree, n, x[n].astype(float), float((x[n] ** 2).sum()), top, best, 5, -np.inf)
        scores = [(int(s), -i) for i, s in enumerate(x @ x[n]) if i != n]
        assert sorted(best) == sorted(scores)[-5:] and all(type(s) is int for s, _ in best)  # before: doubles, which the result does not hold



def test_queries_search_a_tree_together():
    import numpy as np

    class Counted(np.ndarray):
        products = 0

        def __matmul__(self, other):
            Counted.products += 1
            return np.asarray(self) @ other

    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (3000, 6))  # with ties, and equal rows
    x[100:400] = x[7]
    ids, sizes = np.arange(len(x)) // 2, (x * x).sum(axis=1).astype(float)
    asked = [*range(0, 3000, 20)]
    for kind, floor in ((np.int64, -np.inf), (float, 0.0), (object, -np.inf)):
        tree = topk.build(ids, x.astype(kind).view(Counted) if kind is not object else x.astype(object), float(sizes.max()))
        Counted.products = 0
        for n in asked:
            topk.search(tree, int(ids[n]), x[n].astype(kind), sizes[n], float(sizes.max()), [], 5, floor)
        alone, best, Counted.products = Counted.products, [[(10**6, -10**6)] if n == 40 else [] for n in asked], 0
        topk.search_all(tree, [int(ids[n]) for n in asked], x[asked].astype(kind), sizes[asked].tolist(), float(sizes.max()), best, 5, [floor] * len(asked))
        for n, heap in zip(asked, best, strict=True):
            scores = [(int(s), -int(i)) for s, i in zip((x @ x[n]).tolist(), ids, strict=True) if i != ids[n]] + ([(10**6, -10**6)] if n == 40 else [])
            assert sorted(heap) == sorted(scores)[-5:] and all(type(s) is int for s, _ in heap)
        assert Counted.products <= alone / 2  # before: one for each query and page
    big = np.array([[1 << 30, 1], [1 << 30, 255], [1 << 30, 255], [5, 5]], object)  # scores that doubles do not tell apart
    for ids in ([1, 2, 3, 4], [1, 3, 2, 4]):
        tree, best = topk.build(np.array(ids), big, 2.0**60 + 2**17), [[]]
        topk.search_all(tree, [9], np.array([[1 << 30, 1]], object), [2.0**60], 2.0**60 + 2**17, best, 1, [-np.inf])
        assert best == [[((1 << 60) + 255, -2)]]


def test_crowded_regions_have_groups_of_their_own(spark):
    """Most groups are out of reach of a query by their bounds; one vector many times over is split and still found."""
    import pickle

    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.integers(-3, 4, (40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 8)).tolist()) for i in range(3000)] + [(5000 + i, [1.0] * 8) for i in range(1000)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    trees, known = topk.index(vectors, group_rows=100)
    found = [(np.array(r["centre"]), r["radius"], len(pickle.loads(r["tree"])["ids"])) for r in trees.collect()]
    assert sum(n for _, _, n in found) == 4000 and len(found) > 30 and len(known[8][1]) == topk.SEEDS
    x = np.array([[int(256 * c // 1) for c in v] for _, v in rows], np.int64)
    top, near = known[8][0], 0
    for q in x[:3000:100]:
        far = np.sqrt(float((q * q).sum()) + top - 2.0 * np.sort(x @ q)[-5])
        near += sum(n for centre, radius, n in found if np.sqrt(((np.append(q, 0.0) - centre) ** 2).sum()) - radius <= far)
    assert near < 0.3 * 30 * 4000
    got = Counter(map(tuple, topk.top_k(spark.createDataFrame(rows[::7], "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()))
    assert got == top_by_hand(rows[::7], 5)


def test_warc_round_trip(spark):
    big = "x" * 150 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "u", "small"), (2, "u", "small"), (9, "u\r\nv", big), (4, None, big), (5, "u", big), (6, "u", None), (7, "u", ""), (4, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    n = len(big.encode())
    assert got == Counter([(1, 5, "response", None), (2, 5, "response", None), (9, n, "revisit", 4), (4, n, "response", None), (4, n, "response", None), (5, n, "revisit", 4), (6, 0, "response", None), (7, 0, "response", None)])
    assert warc.round_trip(df.limit(0)).count() == 0


def record(i, body):
    import hashlib

    digest = hashlib.sha256(body).hexdigest()
    return f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_later_records(zipped):
    made = [gzip.compress(r) if zipped else r for r in (record(i, bytes([65 + i]) * (40 + i)) for i in range(5))]
    hurt = bytearray(made[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = made[0] + bytes(hurt) + b"junk \x1f\x8b\x08 junk" + made[2] + made[3][:-7] + made[4] + b"tail"
    found = list(warc.salvage(data))
    good = [h["warc-record-id"] for _, _, why, h, _ in found if why is None]
    assert good == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert sum(1 for f in found if f[2]) == 3


def test_members_of_many_records():
    rng = random.Random(3)
    made = [record(i, rng.randbytes(40_000)) for i in range(8)]
    whole = gzip.compress(b"".join(made))
    assert [h["warc-record-id"] for _, _, why, h, _ in warc.salvage(whole) if why is None] == [f"<urn:page:{i}>" for i in range(8)]
    hurt = gzip.compress(b"".join([*made[:3], made[3][:-9], *made[4:]])) + record(9, b"nine")
    found = list(warc.salvage(hurt))
    assert [h["warc-record-id"] for _, _, why, h, _ in found if why is None] == [f"<urn:page:{i}>" for i in (0, 1, 2, 4, 5, 6, 7, 9)]
    assert sum(1 for f in found if f[2]) == 1
    short = whole[: len(whole) // 2] + gzip.compress(record(9, b"nine"))
    found = list(warc.salvage(short))
    assert [h["warc-record-id"] for _, _, why, h, _ in found if why is None] == [f"<urn:page:{i}>" for i in (0, 1, 2, 9)]
    assert any(f[2] for f in found)
    zeros = gzip.compress(b"".join(record(i, bytes(90)) for i in range(3)).replace(b"WARC-Block-Digest", b"X"))
    assert [f[2] is None for f in warc.salvage(zeros)] == [True] * 3
    assert not [f for f in warc.salvage(zeros[:-6]) if f[2] is None]  # damaged, and without digests


def test_many_members_take_linear_time():
    one = gzip.compress(record(1, random.Random(1).randbytes(7_000)))
    began = time.time()
    assert sum(1 for f in warc.salvage(one * 4_000) if f[2] is None) == 4_000
    assert time.time() - began < 20


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", f"{i} " * (20_000 if i % 10 == 0 else 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), archive_records=20, archive_bytes=130_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < 150_000 and len(sizes) <= 12
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.page_records(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), "response") for i, _, h in rows}


def test_gaps_are_logged(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"one") + b"garbage" + record(2, b"two"))
    got = warc.read(spark, str(tmp_path)).orderBy("begin").collect()
    assert [r.status for r in got] == ["record", "gap", "record"] and got[1].end - got[1].begin == 7 and got[1].reason


def test_pieces_equal_the_library(spark, tmp_path):
    import sentencepiece

    path = queries.piece_model_path()
    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_lattice.load(path)
    texts = ["Hello  world\n\n x  ", "", None, "日本語 ünï\t tab ▁ mark", " lead", "%%% the*** 12345 https://a.b/c?d=1", "the the the", "the the the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).write.parquet(str(tmp_path / "d"))
    got = sentencepiece_lattice.encode(spark.read.parquet(str(tmp_path / "d")), pieces)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sentencepiece_lattice.decode(got, pieces).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert sentencepiece_lattice.encode(spark.read.parquet(str(tmp_path / "d")).limit(0), pieces).count() == 0


def test_viterbi_equals_brute_force(spark):
    rows = [(0, "▁", -3.0), (1, "▁a", -1.5), (2, "a", -2.0), (3, "b", -2.1), (4, "ab", -2.5), (5, "ba", -2.2), (6, "▁ab", -4.5), (7, "aba", -4.4)]
    pieces = sentencepiece_lattice.Pieces(rows, [], 99, 3, True)
    by = {p: (i, s) for i, p, s in rows}

    def best(w):
        if not w:
            return 0.0, []
        options = [(by[w[:n]][1] + best(w[n:])[0], [by[w[:n]][0], *best(w[n:])[1]]) for n in range(1, 4) if w[:n] in by]
        return max(options)

    words = ["▁abab", "▁bbaab", "▁", "▁aab", "▁babaab"]
    got = {r.word: r.ids for r in sentencepiece_lattice.word_ids(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    score = {i: s for i, _, s in rows}
    for w in words:
        assert abs(sum(score[i] for i in got[w]) - best(w)[0]) < 1e-9


def test_viterbi_of_whole_texts_by_brute_force(spark, monkeypatch):
    """Ids of every kind of text against a plain dynamic program over the whole text's words, and the round trip."""
    import hashlib
    import re

    pieces = sentencepiece_lattice.load(queries.piece_model_path())
    by, worst = {p: (i, s) for i, p, s in pieces.rows}, min(s for _, _, s in pieces.rows) - 10
    texts = ["Hello  world\n\n x  ", "", None, "日本語 ünï\t tab mark", "a" * 1200 + " b", "abcdefghij" * 3000 + " é" + "z" * 64 + "é" * 70, "x" * 199 + " " + "y" * 201, "%%% the*** 12345 https://a.b/c?d=1", "the the the", "the the the", "𝔘𝔫 é \u0301"]

    def plain(text):
        out = []
        for w in re.findall("▁*[^▁\\n]+|▁+|\\n", "▁" + text.replace(" ", "▁")) if text else []:
            best = [(0.0, 0, [])]
            for e in range(1, len(w) + 1):
                options = [(best[b][0] + by[w[b:e]][1], b, [by[w[b:e]][0]]) for b in range(max(0, e - 16), e) if w[b:e] in by]
                if w[e - 1] not in by:
                    options.append((best[e - 1][0] + worst, e - 1, [pieces.bytes[x] for x in w[e - 1].encode()]))
                best.append(max(options))
            ids, e = [], len(w)
            while e:
                ids, e = best[e][2] + ids, best[e][1]
            out += ids
        return out

    docs = spark.createDataFrame([(i, t, 9, 8) for i, t in enumerate(texts)], "doc_id long, text string, ids int, number int").repartition(2)
    for most in (sentencepiece_lattice.SLICE, 100):  # one slice a task, and many
        monkeypatch.setattr(sentencepiece_lattice, "SLICE", most)
        got = sentencepiece_lattice.encode(docs, pieces, rule="viterbi")
        rows = sentencepiece_lattice.decode(got, pieces, to="decoded").collect()
        assert len(rows) == len(texts) and {r.doc_id: r.ids for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
        assert all(r.decoded == (texts[r.doc_id] or "") and r.digest == hashlib.sha256(r.decoded.encode()).hexdigest() for r in rows)
    assert sentencepiece_lattice.encode(docs.limit(0), pieces, rule="viterbi").count() == 0
    assert sentencepiece_lattice.decode(spark.createDataFrame([(1, [0, 1, None, 2]), (2, None)], "doc_id long, ids array<int>"), pieces).orderBy("doc_id").collect()[1].text == ""


def test_a_bpe_word_of_many_characters_ends(spark):
    import sentencepiece

    path = queries.piece_model_path()
    text = "abcdefgh" * 2000
    got = sentencepiece_lattice.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), sentencepiece_lattice.load(path))
    assert got.first().ids == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_unclosed_elements_are_parsed_in_linear_time():
    import time

    def took(n):
        page = "<div>word </section>" * n
        began = time.perf_counter()
        html_text.parse(page, frozenset())
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 40 * took(2_000)  # 16 times the page; quadratic were 256


def test_words_end_where_no_piece_can_span(spark, monkeypatch):
    """Words with all that follows them were words of their own before: more of them, with more edges each. And a slice came back, and was decoded, in one piece of memory."""
    import pyarrow as pa

    pieces = sentencepiece_lattice.load(queries.piece_model_path())
    texts = [f"ÿÿ a{i}ÿtheÿ*** b\n" if i else "" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = {r.word for r in sentencepiece_lattice.word_rows(sentencepiece_lattice.sliced(docs, pieces)).collect()}
    assert {"ÿ", "the", "\n", "▁b"} <= words and not any(len(w) > 1 and ("ÿ" in w or "\n" in w) for w in words)

    pairs = sorted({p[i : i + 2] for _, p, _ in pieces.rows for i in range(len(p) - 1)})
    plain = [sentencepiece_lattice.Cutter(pairs).words(t) for t in texts]
    assert ["".join(w) for w in plain] == ["▁" + t.replace(" ", "▁") if t else "" for t in texts] and {w for p in plain for w in p} == words
    monkeypatch.setattr(sentencepiece_lattice, "CUT", 7)  # longer texts are cut in parts, at the same places
    assert [sentencepiece_lattice.Cutter(pairs).words(t) for t in texts] == plain
    monkeypatch.setattr(sentencepiece_lattice, "KINDS", 5)  # kinds that characters share only leave cuts out
    ends = lambda parts: {sum(map(len, parts[:i])) for i in range(len(parts))}
    assert all(ends(sentencepiece_lattice.Cutter(pairs).words(t)) <= ends(p) for t, p in zip(texts, plain, strict=True))
    monkeypatch.setattr(sentencepiece_lattice, "RUN_IDS", 40)
    few = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(docs, pieces, rule="viterbi").collect()}
    monkeypatch.undo()
    assert few == {r.doc_id: r.ids for r in sentencepiece_lattice.encode(docs, pieces, rule="viterbi").collect()} and len(few) == 60 and few[0] == []

    squeezed = sentencepiece_lattice.squeezed
    np = sentencepiece_lattice.np
    blocks = [squeezed(np.array([0, 1, 0], np.int32)), squeezed(np.array([1], np.int32))]
    slice_ = pa.table({"slice": [0], "doc_ids": [[5, 6, 7, 8]], "sizes": pa.array([[0, 3, 0, 1]], pa.list_(pa.int32())), "digests": [["a", "b", "c", "d"]], "numbers": pa.array([blocks], pa.list_(pa.binary())), "words": [b""]})
    back = pa.table({"slice": [0], **{c: pa.array([squeezed(np.array(x, np.int32))], pa.binary()) for c, x in {"number": [0, 1], "size": [2, 1], "ids": [9, 8, 7]}.items()}})
    got = sentencepiece_lattice.placed((0,), slice_, back)
    assert got.to_pydict() == {"doc_id": [5, 6, 7, 8], "digest": ["a", "b", "c", "d"], "ids": [[], [9, 8, 7, 9, 8], [], [7]]} and got["ids"].num_chunks == 2
