"""The operators on documents, against brute force on small fixtures with nulls, blanks, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.llm import jaccard, linededup, lm_score, merkle, packing, queries, toxicity

SCHEMA = "doc_id long, text string, source string, n_chars long, row string, span int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "x", 1) for i, t, s in rows], SCHEMA).coalesce(2)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "epsilon.", "zeta", "Éta", "theta!!"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 2, 3, 5, 30, 60, 200])) for _ in range(60)]
    out = [(i, t, f"src{i % 3}") for i, t in enumerate(base)]
    for i in range(20):  # near copies, and copies of those
        words = base[40 + i].split()
        words[len(words) // 2] = "changed"
        out.append((100 + i, " ".join(words), "src0"))
        out.append((200 + i, " ".join(words).upper(), None))
    out += [(300, None, "src1"), (301, "", "src1"), (302, " \n\t ", "src2"), (303, base[50], "src2"), (303, base[50], "src2"), (None, base[51], None), (304, "long " * 20_000, "src1")]
    return out


def test_packing_is_a_partition_of_all_ids(spark, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    got = packing.pack(make(spark, rows), path, window=256, open_windows=4).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and 0 < r.length <= 256
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        mine = sorted(pieces[i, len(ids)])
        joined = [x for _, part in mine for x in part]
        if n == 1 and sum(1 for (j, other) in want if j == i and len(other) == len(ids)) == 1:
            assert tuple(joined) == ids and [s for s, _ in mine] == [0, *np.cumsum([len(p) for _, p in mine])[:-1].tolist()]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0  # no padding at all


def test_packing_of_nothing(spark, rows):
    assert packing.pack(make(spark, rows).limit(0), queries.tokenizer_path()).count() == 0


def test_word_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["It's a 12.5% rise, isn't it? ÉTÉ <|endoftext|> end", "", " \t", "é İ ß ǅ 日本  x y", "don't!!"]
    ids, at = packing.WordEncoder(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_special_tokens_keep_their_case():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["End <|ENDOFTEXT|> Now<|StartOfText|>x", "<|endoftext|> A<B a<b 日本 日本", "WORD word Word é É"]
    ids, at = packing.WordEncoder(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_an_encoder_keeps_the_words_of_some_slices():
    import pyarrow as pa

    encoder = packing.WordEncoder(queries.tokenizer_path())
    encoder.encode(pa.array([" ".join(f"w{i}" for i in range(120_000))]))
    encoder.encode(pa.array(["w1 w2"]))
    assert len(encoder.slot) == 120_000  # before: the cache began anew, and frequent words were split and encoded again
    assert len(encoder.parts) < 100  # their parts are encoded once



def components_by_hand(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, rows, k, num):
    got = jaccard.near_duplicates(make(spark, rows), k, num, 100).collect()
    assert Counter(map(tuple, got)) == components_by_hand(rows, k, num, 100)


def test_chains_and_large_groups_keep_their_links(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(60):  # each differs a little from the one before: the ends are far apart
        words[rng.randrange(120)] = f"n{i}"
        out.append((1000 - i, " ".join(words), "s"))
    got = jaccard.near_duplicates(make(spark, out), 4, 85, 100, rounds=2).collect()
    assert Counter(map(tuple, got)) == components_by_hand(out, 4, 85, 100)


def test_a_template_under_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Every two texts have a likeness of 0.785; all are in the entries of the template's tokens."""
    template, seen, meetings = [f"t{i}" for i in range(340)], [], jaccard.meetings

    def watched(live, heads, num, den):
        parts = meetings(live, heads, num, den)
        seen.append((live.alias("p").join(live.alias("q"), "token").where("p.node < q.node").count(), sum(low.join(high, ["token", "band"]).count() for low, high in parts)))
        return parts

    monkeypatch.setattr(jaccard, "meetings", watched)
    out = [(i, " ".join([*template, *(f"own{i}x{j}" for j in range(46))]), "s") for i in range(60)]
    got = jaccard.near_duplicates(make(spark, out), 5, 80, 100).collect()
    assert sorted(map(tuple, got)) == [(i, 382, i) for i in range(60)]
    ((all_pairs, joined),) = seen
    assert all_pairs > 60 * 59 // 4 and joined == 0


def test_templates_with_parts_of_all_sizes(spark):
    rng = random.Random(11)
    out = []
    for i in range(90):  # own parts of few words, shared by some: links, near misses, and nodes apart in entries with a large component
        own = [f"v{rng.randrange(25)}" for _ in range(rng.randrange(4, 34))]
        out.append((i, " ".join([*(f"t{j}" for j in range(100)), *own]), "s"))
    for rounds in (0, 1, 2):
        got = jaccard.near_duplicates(make(spark, out), 4, 85, 100, rounds=rounds).collect()
        assert Counter(map(tuple, got)) == components_by_hand(out, 4, 85, 100)


@pytest.mark.parametrize("k", [4, 5])
def test_shingles_of_a_few_words_in_all(k):
    import pyarrow as pa

    for n in range(1, k + 1):
        (own,) = jaccard.shingle_sets(pa.array([" ".join("abcde"[:n])]), k)
        both = list(jaccard.shingle_sets(pa.array([" ".join("abcde"[:n]), "p q r s t u v"]), k))
        assert len(own) == 1 and own.tolist() == both[0].tolist() and len(both[1]) == 8 - k


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_of_one_short_document(spark, k):
    for n in (2, 3):
        got = jaccard.near_duplicates(make(spark, [(7, " ".join("abcde"[:n]), "s")]), k, 80, 100).collect()
        assert list(map(tuple, got)) == [(7, 1, 7)]


def test_near_duplicates_of_nothing(spark, rows):
    assert jaccard.near_duplicates(make(spark, rows).limit(0)).count() == 0


def test_one_of_each_keeps_the_smallest(spark, rows):
    kept = sorted(r.doc_id for r in jaccard.one_of_each(make(spark, rows)).collect() if r.doc_id is not None)
    want = sorted(i for (i, _, c), n in components_by_hand(rows, 5, 80, 100).items() for _ in range(n) if i is not None and i == c)
    assert kept == want


def test_merkle_compares_with_the_next(spark, rows):
    known = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in merkle.compare_with_next(make(spark, rows)).collect())
    want = Counter()
    for n, (i, t) in enumerate(known):
        m, after = len(t) // 4, known[(n + 1) % len(known)][1]
        edited = t[: len(t) - m] + after[:m]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), merkle.tree(t).digest.hex(), merkle.tree(edited).digest.hex()] += 1
    assert got == want
    assert merkle.compare_with_next(make(spark, rows).limit(0)).count() == 0


def test_merkle_tree_locates_edits():
    text = "One sentence. Two more here.\nThird line is long enough.\n\nLast part. End."
    changed = text.replace("Third", "Fifth")
    a, b = merkle.tree(text), merkle.tree(changed)
    assert a.digest != b.digest and merkle.tree(text).digest == a.digest
    (span,) = merkle.edits(a, b)
    assert "Fifth" in changed[slice(*span)] and 0.5 < merkle.likeness(a, b) < 1
    assert merkle.likeness(merkle.tree(""), merkle.tree("")) == 1.0 and merkle.likeness(a, merkle.tree("")) == 0.0
    assert merkle.tree("a b").digest != merkle.tree("a  b").digest


def test_merkle_trees_cover_the_text(spark, rows):
    for r in merkle.fingerprints(make(spark, rows)).collect():
        spans = [(p.start, p.end) for s in r.sections for q in s.paragraphs for p in q.parts]
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == r.n_chars and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(["Menu | Home ", *[prose(rng, 4) for _ in range(3)], "", "footer" if i % 2 else prose(rng, 2)]), f"h{i % 2}" if i % 7 else None) for i in range(80)]
    rows += [(900, None, "h0"), (901, "", "h1"), (902, "Menu | Home", "lone"), *[(910 + j, "copy\nof one page", "h0") for j in range(30)]]
    pages, count = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        pages[h].add(t or "")
        for line in (t or "").split("\n"):
            if line.strip():
                count[h, line.strip()].add(t)
    want = Counter()
    for i, t, h in rows:
        keep = [x for x in (t or "").split("\n") if not (x.strip() and len(count[h, x.strip()]) >= 5 and len(count[h, x.strip()]) > 0.05 * len(pages[h]))]
        want[i, h, None if t is None else "\n".join(keep)] += 1
    for few in (100_000, 0):  # broadcast, and salted
        got = linededup.drop_lines(make(spark, rows), F.col("source"), broadcast_lines=few)
        assert got.columns[:-1] == make(spark, rows).columns
        assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == want
    assert linededup.drop_lines(make(spark, rows).limit(0), F.col("source")).count() == 0


def test_host_of(spark):
    r = spark.createDataFrame([("HTTPS://User@Www.A.example:80/x",), ("nope",), (None,)], "u string").select(linededup.host_of(F.col("u"))).collect()
    assert [x[0] for x in r] == ["www.a.example", "", None]


def test_lm_scores_prefer_the_target(spark):
    rng = random.Random(2)
    good, bad = ["cat", "dog", "bird", "fish"], ["xx", "yy", "zz", "qq"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), "s") for i in range(60)] + [(70, None, "s"), (71, "", "s"), (None, "cat", "s")]
    docs = make(spark, rows)
    ids = spark.createDataFrame([(i,) for i in range(1, 30, 2)] + [(None,), (999,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, ids).collect()}
    assert all(got[i].score < 0 for i in range(31, 60, 2)) and all(got[i].score > 0 for i in range(0, 60, 2))
    assert got[70].score == got[71].score == 0 and got[70].n_tokens == 0
    models = lm_score.train(lm_score.flagged(docs, ids))
    size = len(models.words)
    for row in range(2):  # a proper distribution after every history
        for h in range(size + 2):
            p = np.exp(models.word[row] - models.history[row][h])
            mine = models.pairs // (size + 2) == h
            p[models.pairs[mine] % (size + 2)] = np.exp(models.seen[row][mine])
            assert abs(p.sum() - 1) < 1e-9
    assert lm_score.cross_entropy_difference(docs.limit(0), ids).count() == 0


def test_lm_scores_are_of_the_uncut_models(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(4000)), "s") for i in range(30)]
    rows += [(40 + i, f"a rare{i // 2} b lone{i} {'x' * 70}{i // 3} rare{i // 2} c", "s") for i in range(6)] + [(50, None, "s"), (None, "rare1 b a", "s"), (41, "b rare0 b", "s")]
    good = {0, 1, 41, 42, 44}
    lists = [(i, (t or "").lower().split(), i in good) for i, t, _ in rows]
    one, two, before = ([Counter(), Counter()] for _ in range(3))
    for _, ws, target in lists:
        for r in range(1 + target):
            one[r].update(ws)
            two[r].update(zip(["<s>", *ws], ws, strict=False))
            before[r].update(["<s>", *ws][: len(ws)])
    assert sum(one[0].values()) > 100_000 and min(one[0].values()) == 1
    want = Counter()
    for i, ws, _ in lists:
        ce = []
        for r in range(2):
            p = {w: (one[r][w] + 1) / (sum(one[r].values()) + len(one[0]) + 1) for w in ws}
            logs = [np.log((two[r][h, w] + 50 * p[w]) / (before[r][h] + 50)) for h, w in zip(["<s>", *ws], ws, strict=False)]
            ce.append(-sum(logs) / max(1, len(ws)))
        want[i, len(ws), round(ce[0], 6), round(ce[1], 6), round(ce[1] - ce[0], 6)] += 1
    got = lm_score.cross_entropy_difference(make(spark, rows), spark.createDataFrame([(i,) for i in good], "doc_id long"))
    assert Counter((r.doc_id, r.n_tokens, *(round(x, 6) for x in r[2:])) for r in got.collect()) == want


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.choice([5, 40, 120])).split()
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["blarg", "snork", "vileish", "vilely", "vileness"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_tags(spark):
    rows, labels = toxic_rows(random.Random(4), 400)
    docs = make(spark, [*rows, (5000, None, "s"), (5001, "", "s"), (None, "blarg", "s")])
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    truth = dict(labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    right = [got[i].predicted == truth[i] for i in truth if got[i].held_out]
    assert sum(right) / len(right) > 0.95
    texts = {i: t for i, t, _ in rows}
    marked = [texts[i][s.start : s.end] for i in truth if got[i].held_out and truth[i] for s in got[i].spans]
    assert marked and all(re.search("blarg|snork|vile", m) for m in marked)
    assert got[5000].predicted == 0 and got[5000].score == got[5001].score
    kept = toxicity.reject_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got.values() if r.score < 0.5)


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(random.Random(4), 8)
    got = toxicity.score(make(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 8 and all(r.score == 0 and r.predicted == 0 for r in got)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, step, bounds = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    got = toxicity.marginals(score, bounds, step)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total, hot = 0.0, np.zeros(b - a)
        for states in np.ndindex(*[2] * (b - a)):
            w = np.exp(sum(score[a + i] * s for i, s in enumerate(states)) + sum(step[x, y] for x, y in zip(states, states[1:], strict=False)))
            total += w
            hot += w * np.array(states)
        assert np.allclose(got[a:b], hot / total if b > a else hot)


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(1)
    score, step, bounds = rng.normal(size=10), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 10])
    p, pairs = toxicity.expected_counts(score, bounds, step)
    truth = np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total, seen = 0.0, np.zeros((2, 2))
        for states in np.ndindex(*[2] * (b - a)):
            w = np.exp(sum(score[a + i] * s for i, s in enumerate(states)) + sum(step[x, y] for x, y in zip(states, states[1:], strict=False)))
            total += w
            for x, y in zip(states, states[1:], strict=False):
                seen[x, y] += w
        truth += seen / total
    assert np.allclose(pairs, truth) and np.allclose(p, toxicity.marginals(score, bounds, step))
    assert toxicity.expected_counts(score[:0], np.array([0, 0]), step)[1].tolist() == [[0, 0], [0, 0]]
