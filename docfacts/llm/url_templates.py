"""URL filters by a path-template tree, in DataFrame functions only.

Rules decide first: a rule names a host (with all its subdomains) and the begin
of a path; the longest that fits wins. The URLs that rules decide are labels for
the others.

Every host has a tree of path segments, grown level by level. At a node, a
segment that many of the node's pages share (``share``, at least ``support``)
stays a literal branch; all others become wildcards of their shape: {n} digits,
{w} letters, {x} anything else, with a file's extension. So a node has at most
1 / share literal branches, whatever its pages. These are merged where they are
statistically similar: in order of what mostly follows them, then of their
labelled purity, each joins the branches before it unless a chi-square test tells the
pooled counts apart, by what follows the segment or by the labels. The next level grows under the merged
branch. What lies deeper than ``depth`` levels is one last wildcard of all its
segments' shapes.

A template is judged by its purity, the share of its labelled pages that are
good, smoothed by what the same paths show over all hosts, and that by the share
of all good labels; under ``least`` it is rejected.

Counts are pre-aggregated before their shuffle, and nothing is collected but a
node's literal branches (at most 1 / share) and single counts. What a level finds is written as a
table; it is broadcast if it is counted to be small, else repeated for
``salts`` salts, so that a hot host's pages meet it in several tasks.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
an empty path is the root; empty segments (repeated or closing slashes) count
for nothing; rows without page_id and repeated rows are judged each; an empty
table gives no row; without labels the share of good ones is a half, which is
not under ``least``; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import stored

#: (host, begin of the path, verdict)
Rule = tuple[str, str, str]

DEPTH, SHARE, SUPPORT = 3, 0.05, 4
LEAST, WEIGHT = 0.5, 2.0
#: The kinds of segments, for the comparison of branches by what follows them; a longer wildcard is a file.
KINDS = ["{n}", "{w}", "{x}"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda i: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are literals of the plan: a list, not a table."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,host:int,rule:string,verdict:string>")
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def shape(segment: Column) -> Column:
    """The wildcard of a segment: its kind of characters, and a file's extension."""
    stem, extension = (F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{2,5})?\z", i) for i in (1, 2))
    kind = F.when(F.regexp_like(stem, F.lit(r"^[0-9]+\z")), "{n}").when(F.regexp_like(stem, F.lit(r"^[A-Za-z_-]+\z")), "{w}").otherwise("{x}")
    return F.concat(kind, extension)


def follows(segment: Column, after: Column) -> Column:
    """0 if nothing follows a branch, else 1 to 8: four kinds of the next segment, each with or without more after it."""
    wild = shape(segment)
    kind = F.when(F.length(wild) > 3, len(KINDS)).otherwise(F.array_position(F.array(*[F.lit(x) for x in KINDS]), wild).cast("int") - 1)
    return F.when(segment.isNull(), 0).otherwise(1 + 2 * kind + after.isNotNull().cast("int"))


def meet(rows: DataFrame, found: DataFrame, keys: list[str], few: int, salts: int, seed: str) -> DataFrame:
    """``rows`` left-joined with a stored table that is unique by ``keys``, a hot key in ``salts`` tasks."""
    right = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    if found.count() <= few:
        met = rows.join(F.broadcast(right), same, "left")
    else:
        spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.join(spread, same & (F.pmod(F.xxhash64(seed), F.lit(salts)) == F.col("__salt")), "left").drop("__salt")
    return met.drop(*[f"__{k}" for k in keys])


def apart(a: Column, b: Column) -> Column:
    """Whether two arrays of counts differ by a chi-square test of homogeneity, three standard deviations over its mean."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    na, nb = total(a), total(b)
    terms = F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x * nb - y * na) * (x * nb - y * na) / (x + y)).otherwise(0.0))
    freedom = F.aggregate(F.zip_with(a, b, lambda x, y: x + y), F.lit(-1.0), lambda s, x: s + F.when(x > 0, 1.0).otherwise(0.0))
    return F.when((na > 0) & (nb > 0) & (freedom > 0), total(terms) / (na * nb) > freedom + 3.0 * F.sqrt(2.0 * freedom)).otherwise(False)


def merged(branches: Column) -> Column:
    """Groups of similar branches: array of struct(segments, next, labels). ``branches``: array of struct(segment, next, labels) in order.

    A branch is compared with the pooled counts of the last group, so that a
    chain of small steps does not join its ends.
    """
    added = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    group = lambda s, n, c: F.struct(s.alias("segments"), n.alias("next"), c.alias("labels"))

    def place(groups: Column, b: Column) -> Column:
        last = F.element_at(groups, -1)
        differs = apart(last["next"], b["next"]) | apart(last["labels"], b["labels"])
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(group(F.concat(last["segments"], F.array(b["segment"])), added(last["next"], b["next"]), added(last["labels"], b["labels"]))))
        return F.when(differs, F.concat(groups, F.array(group(F.array(b["segment"]), b["next"], b["labels"])))).otherwise(grown)

    none = F.array().cast("array<struct<segments:array<string>,next:array<double>,labels:array<double>>>")
    return F.aggregate(branches, none, lambda groups, b: F.when(F.size(groups) == 0, F.array(group(F.array(b["segment"]), b["next"], b["labels"]))).otherwise(place(groups, b)))


def literal_branches(rows: DataFrame, level: int, share: float, support: int, few: int, salts: int) -> DataFrame:
    """host, template, segment, branch (the name of its group) of the segments that stay literal at a level; few a node."""
    here, after, last = (F.get("segments", F.lit(level + i)) for i in range(3))
    at = rows.where(F.size("segments") > level).select("host", "template", here.alias("segment"), follows(after, last).alias("next"), "good", "bad")
    n = lambda test: F.count_if(test).cast("double")
    counts = at.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("double").alias("good"), F.sum("bad").cast("double").alias("bad"), F.array(*[n(F.col("next") == i) for i in range(3 + 2 * len(KINDS))]).alias("next"))
    often = counts.where(F.col("n") >= support)
    nodes = stored(at.groupBy("host", "template").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= support), "url-nodes")
    literal = meet(often, nodes, ["host", "template"], few, salts, "segment").where(F.col("n") >= F.lit(share) * F.col("pages"))
    purity = (F.col("good") + 1.0) / (F.col("good") + F.col("bad") + 2.0)
    branch = F.struct(F.array_position("next", F.array_max("next")).alias("mostly"), purity.alias("purity"), "segment", "next", F.array("good", "bad").alias("labels"))
    groups = literal.groupBy("host", "template").agg(merged(F.sort_array(F.collect_list(branch), asc=False)).alias("groups"))
    each = groups.select("host", "template", F.explode("groups").alias("g")).select("host", "template", F.sort_array("g.segments").alias("members"))
    name = F.when(F.size("members") == 1, F.element_at("members", 1)).otherwise(F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}")))
    return each.select("host", "template", F.explode("members").alias("segment"), name.alias("branch"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, share: float = SHARE, support: int = SUPPORT, least: float = LEAST, weight: float = WEIGHT, few: int = 100_000, salts: int = 32) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template (host-relative, merged) and purity of every page."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumns({
        "segments": F.array_remove(F.split("path", "/"), ""), "template": F.lit(""), "plain": F.lit(""),
        "good": F.coalesce((F.col("ruled.verdict") == "allow").cast("long"), F.lit(0)), "bad": F.coalesce((F.col("ruled.verdict") == "block").cast("long"), F.lit(0)),
    })
    for level in range(depth):
        found = stored(literal_branches(rows, level, share, support, few, salts), "url-branches")
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        rows = meet(rows, found, ["host", "template", "segment"], few, salts, "path")
        more = lambda branch: F.when(F.col("segment").isNotNull(), F.concat(F.lit("/"), branch)).otherwise("")
        wild = shape(F.col("segment"))
        literal = F.when(F.col("branch").isNotNull(), F.col("segment")).otherwise(wild)
        rows = rows.withColumns({"template": F.concat("template", more(F.coalesce("branch", wild))), "plain": F.concat("plain", more(literal))}).drop("segment", "branch")
        if found.count() > few:  # the join above shuffles: once a level
            rows = stored(rows, "url-rows")
    tail = F.array_join(F.transform(F.slice("segments", depth + 1, F.greatest(F.size("segments") - depth, F.lit(0))), lambda s: F.concat(F.lit("/"), shape(s))), "")
    rows = rows.withColumns({"template": F.concat("template", tail), "plain": F.concat("plain", tail)}).drop("segments")
    leaves = stored(rows.groupBy("host", "template", "plain").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-leaves")
    total = leaves.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    base = (total["good"] + 1.0) / (total["good"] + total["bad"] + 2.0)
    smoothed = lambda prior: (F.col("good") + F.lit(weight) * prior) / (F.col("good") + F.col("bad") + F.lit(weight))
    everywhere = leaves.groupBy("plain").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # in millionths, so that sums do not depend on their order
    everywhere = stored(everywhere.select("plain", F.bround(smoothed(F.lit(base)) * 1e6).cast("long").alias("prior")), "url-plain")
    both = meet(leaves, everywhere, ["plain"], few, salts, "host")
    # the prior of a merged template: that of its paths, by how many of the host's pages each has
    judged = both.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("prior")).alias("prior"), F.sum("n").alias("n"))
    judged = stored(judged.select("host", "template", smoothed(F.col("prior") / F.col("n") / 1e6).alias("purity")), "url-templates")
    done = meet(rows, judged, ["host", "template"], few, salts, "path")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") < least, "block").otherwise("allow"))
    return done.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
