"""The four stages of the corpus pipeline, each against plain Python on the rows that the stage before kept."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the stages use for columns of their own.
CLASH = ["line_dedup", "row", "__keys", "__gone", "score", "key", "fails"]


def corpus():
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(300)]  # all of them in documents of both kinds
    bad = ["vilefool", "scumbag", "nastycur", "rottenpig"]
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        body = prose(rng.randrange(40, 90))
        if toxic:
            words = body.split()
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(bad)
            body = " ".join(words)
        lines = ["Menu of the site | home", body, "All rights reserved 2024"] if i % 3 else [body, f"line {i}"]
        docs.append((i, "\n".join(lines), "en", f"host{i % 4}"))
        if i % 5 < 4:
            labels.append((i, int(not toxic), int(toxic)))
    base = prose(120)
    for k in range(40):  # a group of near copies: one word differs
        words = base.split()
        words[k % 5] = f"copy{k}"
        docs.append((1000 + k, " ".join(words), "en", f"host{k % 4}"))
    docs += [(2000, None, "en", "host1"), (2001, "", None, None), (2002, " \n\t", "de", "host1"), (2003, "one", "en", "host2"), docs[1], docs[1], (None, prose(50), "en", "host3"), (2004, prose(30_000), "en", "host0"), (2005, docs[1][1], "en", "host9")]
    return [(*d, None if d[1] is None else len(d[1])) for d in docs], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("sf")
    docs, labels = corpus()
    df = spark.createDataFrame(docs, KIND)
    for n, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(n))
    df.repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_lines(rows):
    """Line dedup: a trimmed line on more than a twentieth of a host's distinct pages, and on five at least, goes."""
    trim = lambda x: x.strip("\t\x0b\x0c\r ")
    pages = defaultdict(set)
    for r in rows:
        pages[r["source"]].add(r["text"] or "")
    n = Counter((s, line) for s, texts in pages.items() for t in texts for line in {trim(x) for x in t.split("\n")} - {""})
    gone = {(s, line) for (s, line), k in n.items() if k >= 5 and k > 0.05 * len(pages[s])}
    out = []
    for r in rows:
        text = r["text"]
        kept = None if text is None else "\n".join(x for x in text.split("\n") if (r["source"], trim(x)) not in gone)
        out.append({**r, "text": kept, "n_chars": r["n_chars"] if kept == text else len(kept)})
    return out


def groups_of_near(rows, k=5, num=80, den=100):
    """The group of each row: rows joined by chains of links."""
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = [shingles(r["text"]) for r in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, j in {(i, j) for at in holders.values() for i in at for j in at if i < j}:
        common = len(sets[i] & sets[j])
        if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
            head[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def test_stages_equal_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    made = dict(corpus_pipeline.STAGES)
    given = [r.asDict() for r in docs.collect()]
    # toxicity: the planted words decide, and no clean document goes
    kept = made["toxicity"](spark, docs, tables)
    assert kept.columns == names
    clean = [r.asDict() for r in kept.collect()]
    bad = lambda r: bool(re.search("vilefool|scumbag|nastycur|rottenpig", r["text"] or ""))
    assert Counter(map(repr, clean)) == Counter(repr(r) for r in given if not bad(r))
    # line dedup
    docs = spark.createDataFrame([tuple(r[c] for c in names) for r in clean], kept.schema)
    kept = made["line dedup"](spark, docs, tables)
    assert kept.columns == names
    lined = [r.asDict() for r in kept.collect()]
    assert Counter(map(repr, lined)) == Counter(map(repr, by_lines(clean)))
    assert any(r["text"] != b["text"] for r, b in zip(sorted(lined, key=lambda r: str(r["doc_id"])), sorted(clean, key=lambda r: str(r["doc_id"])), strict=True))
    # n-gram Jaccard join: one of each group, and of every group
    docs = spark.createDataFrame([tuple(r[c] for c in names) for r in lined], kept.schema)
    kept = made["n-gram Jaccard join"](spark, docs, tables)
    assert kept.columns == names
    group = groups_of_near(lined)
    by_row = defaultdict(set)
    for r, g in zip(lined, group, strict=True):
        by_row[repr(r)].add(g)
    stayed = [r.asDict() for r in kept.collect()]
    empty = {i for i, r in enumerate(lined) if not re.search(r"[^\x20\x09-\x0d]", r["text"] or "")}
    # rows of one id are one document: they stay or go together
    documents = {(r["doc_id"], next(iter(by_row[repr(r)]))) for r in stayed}
    found = Counter(g for _, g in documents if g not in empty)
    nameless = {g for r, g in zip(lined, group, strict=True) if r["doc_id"] is None}
    assert set(found) | nameless >= {g for i, g in enumerate(group) if i not in empty} and set(found.values()) <= {1}
    # packing: each kept token in one piece
    docs = spark.createDataFrame([tuple(r[c] for c in names) for r in stayed], kept.schema)
    pieces = made["packing"](spark, docs, tables).collect()
    length, tokens = defaultdict(int), {}
    for p in pieces:
        length[p.doc_id] += p.length
        tokens[p.doc_id] = p.doc_tokens
    repeats = Counter(r["doc_id"] for r in stayed)
    assert set(length) == set(repeats) and all(length[d] == tokens[d] for d, n in repeats.items() if n == 1)
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert o2 == (o + n if s2 == s else 0) and o + n <= 4096


def test_the_pipeline_runs_its_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    toxic = {i for i in range(400) if i % 4 == 0}
    assert not ids & toxic and ids >= {i for i in range(400) if i % 4 and i > 1} and len(ids & set(range(1000, 1040))) == 1
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "packing"]


def test_an_empty_table_gives_no_rows(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
