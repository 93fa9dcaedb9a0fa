"""N-gram Jaccard join with several global orders, and its connected components.

A document is its set of distinct word shingles. When two sets reach the
threshold t, the first |A| - ceil(t |A|) + 1 tokens of each under any global
order share a token (prefix filter). Here that must hold under four orders. The first
puts a zone of the hash range first and, within it, rare tokens before frequent
ones by their number of sets; most sets have so many tokens of their own there
that nothing is left to meet others on, and they are done. Over the others the
second order puts all tokens the same way: a passage or a template shared by many documents
comes last. Its prefixes are indexed. The last two orders go by hashes. A candidate must share a prefix
token under each of them, have a size that can reach t and enough in common in the first
part of the second order; only then are whole sets compared, exactly.

Equal sets are one node from the start. Within an index entry (the nodes
that share a prefix token) pairs are not enumerated: one node, the leader, meets
the others, and nodes that are connected by now need not meet. What is left apart after
a few leaders is met by a join on token and size band. The place of a token within the smaller
set bounds the larger set's size, so a set enters only the bands that it can still reach; a template that
falls short of the threshold comes after the sets' own tokens, from where it reaches none. Nodes of an
entry's greatest component meet the others only, not one another. A pair is made once, at its
first common token, if sizes and the common part of their first tokens allow the threshold: no link is lost.

Memory and skew: one slice of texts a task; tokens are counted with partial
sums, and entries are joined by token, so that a hot token is split by the adaptive skew join.
What is broadcast: lists of ids where they were counted to be few, with a
shuffled join beyond. Tokens, links and components stay distributed. Tables of a
finished step are removed from the shared folder.

Defined cases: null or blank text is an empty set, linked with nothing, its own
component; texts shorter than a shingle are one token, the whole sequence;
rows without id take part in no link and have no component; rows with the same
id are one document with several texts; repeated rows each give a row; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import discard, free_name, stored, tidy, with_text
from docfacts.llm.packing import slices

FEW_IDS = 1_000_000


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (runs without ASCII white space, A-Z lowered), and where each text's words begin."""
    from xxhash import xxh3_64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    bounds = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    own = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes, bounds = own[np.asarray(coded.indices)], bounds - bounds[0]
    full = pc.not_equal(flat, "")  # a text without words splits into one empty string
    if not pc.all(full).as_py():
        keep = np.asarray(full)
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        hashes = hashes[keep]
    return hashes, bounds


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        grams = words.copy()
        for j in range(1, min(k, len(words))):
            grams[: len(words) - j] = mixed(grams[: len(words) - j] * np.uint64(0x2545F4914F6CDD1D) + words[j:], j)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                short = words[a]
                for w in words[a + 1 : b]:
                    short = mixed(np.array([short * np.uint64(0x2545F4914F6CDD1D) + w]), 100)[0]
                yield mixed(np.array([short]), 1000 + b - a)
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def lists(parts: list[np.ndarray], kind: type, arrow: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, parts[0].dtype if parts else kind)]).view(kind), arrow))


def fingerprint(s: np.ndarray, key: np.ndarray | None = None) -> tuple[int, int]:
    """Two sums over the hashes of a set, which tell sets apart."""
    key = mixed(s, 20) if key is None else key
    with np.errstate(over="ignore"):
        return int(key.sum(dtype=np.uint64).view(np.int64)), int((key * key).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, a fingerprint (f1, f2) of the set, its tokens in the zone, and as many tokens after it as its prefix needs beyond."""
    limit = np.uint64(min((1 << 64) - 1, 2 * (den - num) * (1 << 64) // den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                n, prints, zone, rest = [], [], [], []
                for s in shingle_sets(batch.column(1).slice(i, j - i), k):
                    key = mixed(s, 20)
                    prints.append(fingerprint(s, key))
                    inside = key < limit
                    more = (prefix_size(len(s), num, den) if len(s) else 0) - np.count_nonzero(inside)
                    beyond = np.flatnonzero(~inside) if more > 0 else inside[:0].nonzero()[0]
                    n.append(len(s))
                    zone.append(s[inside])
                    rest.append(s[beyond[np.argpartition(key[beyond], more - 1)[:more]]] if 0 < more < len(beyond) else s[beyond])
                columns = [pa.array(n, pa.int64()), *[pa.array(f, pa.int64()) for f in zip(*prints, strict=True)], *[lists(x, np.int64, pa.int64()) for x in (zone, rest)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", "n", "f1", "f2", "zone", "rest"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, zone array<long>, rest array<long>")


def whole_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, n, the prefixes under the second and third order (32-bit hashes), and all tokens, of the texts that have the set (f1, f2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(3)):
                rows = batch.slice(i, j - i)
                n, second, third, tokens, fits = [], [], [], [], []
                for s, f in zip(shingle_sets(rows.column(3), k), zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True), strict=True):
                    fits.append(fingerprint(s) == f)
                    p = prefix_size(len(s), num, den) if len(s) else 0
                    for out, seed in ((second, 21), (third, 22)):
                        key = mixed(s, seed)
                        key = np.partition(key, p - 1)[:p] if p < len(s) else key
                        out.append(np.unique((key >> np.uint64(16)).astype(np.uint32)))
                    n.append(len(s))
                    tokens.append(s)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), *[lists(x, np.int32, pa.int32()) for x in (second, third)], lists(tokens, np.int64, pa.int64())], ["node", "n", "second", "third", "tokens"]
                ).filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(tidy(run), "node long, n long, second array<int>, third array<int>, tokens array<long>")


def small(df: DataFrame) -> DataFrame:
    """Broadcast where it was counted to be short, else as it is."""
    return F.broadcast(df) if df.count() <= FEW_IDS else df


def nodes_of(sets: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2, node of every row with an id and a set. A node is the smallest id of its set, or a hash where that id has several sets."""
    part = sets.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "f1", "f2")
    classes = part.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    several = classes.groupBy("rep").count().where("count > 1").select("rep", F.lit(True).alias("several"))
    named = classes.join(several, "rep", "left").select("f1", "f2", "rep", F.when(F.col("several"), F.xxhash64("rep", "f1", "f2")).otherwise(F.col("rep")).alias("node"))
    return part.join(named, ["f1", "f2"])


def rare_first(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """node, n, reach, head, lead: of the first ``reach`` tokens in the order by the number of nodes that have them, those that others have too (head, in order), ``lead`` of them in the prefix.

    ``nodes`` has node, n (the size of its set) and tokens (those of the set that come first in the order, all the prefix at least).
    Nodes whose whole prefix is their own have no row: they link with nothing.
    """
    flat = nodes.select("node", F.explode("tokens").alias("token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = flat.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("c", "token"))).alias("met"))
    prefix = F.expr(f"cast(n - (n * {num} + {den - 1}) div {den} + 1 AS int)")
    alone = nodes.select("node", "n", F.size("tokens").alias("m"), prefix.alias("p")).distinct().join(met, "node").withColumn("alone", F.col("m") - F.size("met")).where("p > alone")
    reach = F.least(F.col("p") * 2, F.col("n").cast("int"))
    head = F.transform(F.slice("met", 1, F.greatest(reach - F.col("alone"), F.lit(0))), lambda t: t["token"])
    return alone.select("node", "n", reach.alias("reach"), head.alias("head"), (F.col("p") - F.col("alone")).alias("lead"))


def prefixes(heads: DataFrame) -> DataFrame:
    return heads.select("node", F.explode(F.slice("head", 1, F.col("lead"))).alias("token"))


def representatives(sets: DataFrame, member: DataFrame) -> DataFrame:
    """node, n, zone, rest of each node."""
    copies = member.where("doc_id <> rep").select("doc_id", "f1", "f2").distinct()
    renamed = member.where("node <> rep AND doc_id = rep").select("doc_id", "f1", "f2", "node").distinct()
    lone = sets.where("doc_id IS NOT NULL AND n > 0").join(small(copies), ["doc_id", "f1", "f2"], "left_anti").join(small(renamed), ["doc_id", "f1", "f2"], "left")
    return lone.select(F.coalesce("node", "doc_id").alias("node"), "n", "zone", "rest")


def entries(postings: DataFrame) -> DataFrame:
    """token, node, leader: the postings of the tokens that several nodes have, with the smallest of these."""
    entry = postings.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("token", "leader")
    return postings.join(entry, "token").distinct()


def reachable(x: str, y: str, num: int, den: int):
    """Whether the sizes and heads of two nodes allow the threshold, with what the heads have in common in order.

    Tokens in common are in both heads, or beyond the head that ends first.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    common = F.array_intersect(F.col(f"{x}.head"), F.col(f"{y}.head"))
    most = F.size(common) + F.greatest(n - F.col(f"{x}.reach"), m - F.col(f"{y}.reach"))
    return (n * den >= m * num) & (m * den >= n * num) & (most * (num + den) >= num * (n + m)), common


def meetings(live: DataFrame, heads: DataFrame, num: int, den: int) -> list[tuple[DataFrame, DataFrame]]:
    """What is left of the entries (token, node, own: its component), to be joined on token and band: pairs of tables of the smaller sets and of the larger ones.

    With its first common token at place i the smaller set x has at most |x| + 1 - i tokens in common with another;
    so that one has at most M = ((|x| + 1 - i) (num + den) - num |x|) / num tokens, and x enters the bands from |x| to M.
    Each pair of different components of an entry has a node out of the entry's greatest, so those within that one are left out.
    """
    greatest = live.groupBy("token", "own").count().groupBy("token").agg(F.max_by("own", F.struct("count", "own")).alias("greatest"))
    n, place = F.col("n"), F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1 - F.col("lead") + F.array_position("head", F.col("token"))
    rows = live.join(heads, "node").join(greatest, "token").withColumn("left", n + 1 - place).withColumn("most", F.expr(f"(left * {num + den} - n * {num}) div {num}"))
    band = lambda size: F.floor(F.log(size.cast("double")) * 20)  # noqa: E731  sizes of one band differ by 5 % at most
    row = F.struct("node", "own", "n", "left", "most", "reach", "head")
    apart = F.col("own") != F.col("greatest")

    def low(which):
        able = rows.where(which & (F.col("most") >= n))
        return able.select("token", row.alias("x"), F.explode(F.sequence(band(n), band(F.col("most")))).alias("band"))

    def high(which):
        return rows.where(which).select("token", row.alias("y"), band(n).alias("band"))

    return [(low(apart), high(F.lit(True))), (low(~apart), high(apart))]


def verified(pairs: DataFrame, heads: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Of the distinct pairs (a, b), those whose sets reach the threshold: sizes, heads, the other orders' prefixes, then whole sets."""
    side = lambda c: heads.select(F.col("node").alias(c), F.struct("n", "reach", "head", "second", "third").alias(f"of_{c}"))
    fits = reachable("of_a", "of_b", num, den)[0] & F.arrays_overlap("of_a.second", "of_b.second") & F.arrays_overlap("of_a.third", "of_b.third")
    left = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: whole.select(F.col("node").alias(c), F.col("tokens").alias(f"w{c}"))
    met = left.join(of("a"), "a").join(of("b"), "b")
    return stored(met.select("a", "b", "wa", "wb").mapInArrow(tidy(compare), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of all nodes with a link: least labels of neighbours, with jumps over labels."""
    both = stored(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).where("src <> dst").distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = stored(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        discard(labels)
        labels = moved.select("node", "comp")
        if moved.where("was <> comp").isEmpty():
            discard(both)
            return labels


def near_duplicates(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links at den * |A and B| >= num * |A or B|."""
    docs = with_text(df, id_col, text_col)
    sets = stored(signatures(docs, k, num, den), "signatures")
    rows = stored(sets.where("doc_id IS NULL OR n = 0").select("doc_id", "n"), "empty")
    member = stored(nodes_of(sets), "members")
    lone = representatives(sets, member)
    first = rare_first(lone.select("node", "n", F.col("zone").alias("tokens")), num, den)
    postings = stored(prefixes(first).union(lone.select("node", F.explode("rest").alias("token"))), "postings")
    alive = stored(entries(postings).select("node").distinct(), "alive")
    discard(sets, postings)

    ids = member.where("doc_id = rep").select("doc_id", "node", "f1", "f2").distinct().join(alive, "node", "left_semi")
    whole = whole_sets(docs.join(small(ids), "doc_id").select("node", "f1", "f2", "text"), k, num, den)
    if not member.where("doc_id = rep").groupBy("doc_id", "f1", "f2").count().where("count > 1").isEmpty():  # repeated rows
        whole = whole.dropDuplicates(["node"])
    whole = stored(whole, "sets")
    heads = stored(rare_first(whole.select("node", "n", "tokens"), num, den).join(whole.select("node", "second", "third"), "node"), "heads")
    rest = stored(entries(prefixes(heads)), "entries")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first_of = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("m")).where("a <> m")  # one id, several texts
    links = stored(member.join(first_of.select("doc_id", "a"), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "links")
    tested = links
    live, done = rest.withColumns({"own": F.col("node"), "of": F.col("leader")}), []
    for turn in range(rounds + 1):
        if turn < rounds:
            now = live.where("own <> of").select(*pair("leader", "node"))
        else:
            fits, common = reachable("x", "y", num, den)
            n, m = F.col("x.n"), F.col("y.n")
            smaller = (n < m) | ((n == m) & (F.col("x.node") < F.col("y.node")))
            near = (m <= F.col("x.most")) & (F.col("y.left") * (num + den) >= (n + m) * num) & (F.col("x.own") != F.col("y.own"))
            # of the tokens that two nodes share, the first makes the pair
            once = smaller & near & fits & (F.try_element_at(common, F.lit(1)) == F.col("token"))
            now = None
            for low, high in meetings(live, heads, num, den):
                made = low.join(high, ["token", "band"]).where(once).select(*pair(F.col("x.node"), F.col("y.node")))
                now = made if now is None else now.union(made)
        fresh = stored(now.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(verified(fresh, heads, whole, num, den))
        tested = tested.unionByName(fresh)
        comp = components(links)
        if turn < rounds:
            # the leaders are settled and go; entries whose other nodes are all connected are settled as well
            of = lambda c, to: comp.select(F.col("node").alias(c), F.col("comp").alias(to))
            placed = live.where("node <> leader").select("token", "node", F.col("leader").alias("met")).join(of("node", "own"), "node", "left").join(of("met", "of_met"), "met", "left")
            placed = stored(placed.select("token", "node", F.coalesce("own", "node").alias("own"), (F.coalesce("own", "node") != F.coalesce("of_met", "met")).alias("apart")), "placed")
            next_one = F.coalesce(F.min(F.when(F.col("apart"), F.struct("node", "own"))), F.min(F.struct("node", "own")))
            spread = placed.groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high"), next_one.alias("next")).where("low <> high")
            live = stored(placed.join(spread.select("token", F.col("next.node").alias("leader"), F.col("next.own").alias("of")), "token").select("token", "node", "leader", "own", "of"), "live")
            done += [placed, live]
            if live.isEmpty():
                break
    discard(alive, rest, whole, heads, tested, links, *done)

    named = member.join(comp, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))  # a node that is a hash gives no id
    named = named.join(least, "comp").select("doc_id", "n", "component_id")
    others = rows.select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(others).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay when one document of each component does: the one whose id names it. Rows without id all stay."""
    found = near_duplicates(df, k, num, den, id_col=id_col, text_col=text_col)
    name = free_name(df, "__gone")
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= FEW_IDS
    return df.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col(name), "left_anti")
