"""Vector codes and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from docfacts.llm import filter_audit, vector_codes


def test_branch_and_bound_equals_brute_force():
    rng = np.random.default_rng(0)
    computed = whole = 0
    for n, width, span in [(1, 1, 3), (5, 2, 2), (64, 4, 3), (64, 4, 1000), (64, 1, 5), (200, 3, 40)]:
        book, x = rng.integers(-span, span, (n, width)), rng.integers(-2 * span, 2 * span, (500, width))
        d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        visits = [0]
        index, least = vector_codes.nearest(vector_codes.kd_tree(book), x, visits)
        assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        computed, whole = computed + visits[0], whole + d.size
    assert computed < whole * 0.6  # boxes leave entries out
    same = np.zeros((64, 4), int)
    assert vector_codes.nearest(vector_codes.kd_tree(same), same)[0].max() == 0
    assert len(vector_codes.nearest(vector_codes.kd_tree(book), x[:0])[0]) == 0


def codes_by_hand(rows, parts, entries, rounds):
    good = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    able = sorted((i, v) for i, _, v in good if i is not None and len(v) >= parts and len(v) % parts == 0)
    width = len(able[0][1]) // parts
    good = [g for g in good if len(g[2]) == width * parts]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v in able if len(v) == width * parts][:entries] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = {}
            for _, _, v in good:
                mine.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            new.append([tuple(sum(c) // len(c) for c in zip(*mine[k], strict=True)) if k in mine else e for k, e in enumerate(book)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in good]
    total = Counter()
    for _, label, f in found:
        total[label] += sum(d for d, _ in f)
    return Counter((i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[label], sha) for i, label, f in found)


KIND = "vec_id long, embedding array<float>, label int, code int, error string, q string, v string, `part` int, `__label` int"


def vectors(n=120, width=32):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.3, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(width)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], 7), rows[5], rows[5], (None, rows[8][1], 1), (500, None, 1), (501, [None] * width, 1), (502, [float("nan")] + [0.0] * (width - 1), 1), (503, [float("inf")] * width, 1), (-1, [0.5] * 7, 1), (504, [], 1)]
    return rows


@pytest.mark.parametrize("few", [100, 0])
def test_codes_equal_brute_force(spark, few):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "e", "q", "v", 1, 1) for r in rows], KIND).repartition(5)
    got = Counter(map(tuple, vector_codes.compress(df, parts=16, entries=20, few_labels=few).collect()))
    assert got == codes_by_hand(rows, 16, 20, 2)


def test_codes_of_few_and_no_vectors(spark):
    rows = vectors(9)
    df = spark.createDataFrame([(*r, 1, "e", "q", "v", 1, 1) for r in rows], KIND)
    assert Counter(map(tuple, vector_codes.compress(df).collect())) == codes_by_hand(rows, 16, 64, 2)
    assert vector_codes.compress(df.limit(0)).collect() == [] and vector_codes.compress(df.where("vec_id >= 500")).collect() == []


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame([(*r, 1, "e", "q", "v", 1, 1) for r in vectors(30)], KIND)
    kept = vector_codes.quantised(df)
    books = vector_codes.learn(kept)
    for r in vector_codes.decode(vector_codes.assign(kept, books), books).collect():
        assert len(r["vector"]) == 32
    one = vector_codes.decode(spark.createDataFrame([(1, "0001" * 8)], "vec_id long, code string"), books).first()
    assert one["vector"] == [x / 256 for p in range(16) for x in books[p][p % 2].tolist()]


def audit_by_hand(docs, labels):
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        ws = words(t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        rows.append((part or "", {f for f, x in fails.items() if x}, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out, shapley = {}, Counter()
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in orders:
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in mine if not r[1] & before]
                gone = [r for r in here if f in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = (len(here) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "g#", "delta", "é", " x", "two"]
    texts = [None, "", " \t\n", "ABC", *[" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 49, 50, 51, 60]))) for _ in range(30)], *[" ".join(f"w{rng.randrange(10**6)}" for _ in range(70)) for _ in range(10)], "long words " * 20_000]
    docs = [(rng.choice([i, i, i, i // 2, None]), rng.choice(texts), rng.choice(["a", "a", "b", None, "", f"s{i}"])) for i in range(150)]
    docs += [docs[0], docs[0]]
    labels = [(rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1)]
    table = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], "doc_id long, text string, source string, part int, fails string, good int, digest int").repartition(4)
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    got = filter_audit.filter_interactions(table, marks)
    rows = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert rows == audit_by_hand(docs, labels) and got.count() == len(rows)
    assert filter_audit.filter_interactions(table.limit(0), marks).count() == 0
    assert filter_audit.filter_interactions(table, marks.limit(0)).where("good_lost <> 0 OR toxic_lost <> 0").count() == 0


def test_audit_of_other_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "ab", "s"), (2, "b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.failures(docs, none, {"X": F.col("text").contains("a"), "Y": F.col("text").contains("b")}, duplicates=None)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(filter_audit.subset_counts(rows, 2), ["X", "Y"]).collect()}
    assert got == {("XY", 1): (2, 1, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (1, 0, 1, 0, 1)}
