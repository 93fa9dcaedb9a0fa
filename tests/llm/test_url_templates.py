"""URL filters: rules, the template tree and its verdicts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docfacts.llm import url_templates
from docfacts.llm.queries import URL_RULES

KIND = "page_id long, url string, html string, host int, segment string, branch int, template int, `__host` int, good string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, 1, "s", 1, 1, 1, "g") for i, u in enumerate(urls)], KIND).repartition(3)


def judged(spark, urls, rules=URL_RULES, **how):
    return {r.page_id: r for r in url_templates.judge(pages(spark, urls), rules, **how).collect()}


def rule_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x=/y", "http://example.org/en/12#t", "http://notexample.org/es/1", "http://example.org", "http://example.org?q", "http://org/", "x://É.COM/de/", "http://com/fr",
        "a://b://c.com/de/", "http://u@h.com:80/fr/x", "http://xcom/de/1", "http://h.com/de/a\nb", "  http://h.com/de/1", "http://h.com//de/1",
    ]
    got = judged(spark, urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = rule_by_hand(url, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
        assert got[i].verdict in ("allow", "block")


def site(rng, n=400):
    """A host whose /blog/ and /news/ are alike and good, /x1../ are trackers under the blocked /go/, and /shop/ goes deeper."""
    out = []
    for i in range(n):
        k = rng.randrange(4)
        out.append(["/blog/{}", "/news/{}", "/go/{}/t.php", "/shop/{}/cart/{}/a/b-1"][k].format(i, f"v{i}"))
    return ["http://s.example" + p for p in out]


def test_similar_branches_merge_and_others_do_not(spark):
    rules = [("s.example", "/blog/", "allow"), ("s.example", "/shop/1", "allow"), ("s.example", "/go/1", "block")]
    urls = site(random.Random(0))
    got = judged(spark, urls, rules)
    templates = {r.template for r in got.values()}
    assert "/{blog|news}/{n}" in templates and "/go/{n}/t.php" in templates and "/shop/{n}/cart/{x}/{w}/{x}" in templates and len(templates) == 3
    verdicts = {r.template: r.verdict for r in got.values() if r.rule is None}
    assert verdicts["/{blog|news}/{n}"] == "allow" and verdicts["/go/{n}/t.php"] == "block"  # learnt from the pages that rules decide
    purity = {r.template: r.purity for r in got.values()}
    assert purity["/{blog|news}/{n}"] > 0.9 and purity["/go/{n}/t.php"] < 0.2


def test_other_hosts_take_the_paths_prior(spark):
    rules = [("a.example", "/ads/", "block"), ("a.example", "/text/", "allow")]
    urls = [f"http://a.example/{k}/{i}" for k in ("ads", "text") for i in range(20)] + [f"http://b.example/{k}/{i}" for k in ("ads", "text") for i in range(20)]
    got = judged(spark, urls, rules)
    assert {(r.template, r.verdict) for r in got.values() if r.host == "b.example"} == {("/{ads|text}/{n}", "allow")}  # alike there, and not told apart by labels
    assert {(r.template, r.verdict) for r in got.values() if r.host == "a.example"} == {("/ads/{n}", "block"), ("/text/{n}", "allow")}
    only = judged(spark, urls[:40] + [u for u in urls[40:] if "ads" in u], rules)
    assert {r.verdict for r in only.values() if r.host == "b.example"} == {"block"}


def test_hot_hosts_give_the_same_by_salted_joins(spark):
    rng = random.Random(1)
    urls = [f"http://hot.com/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(10**6)}{rng.choice(['', '/', '.html'])}" for _ in range(600)] + [f"http://h{i % 40}.net/{rng.choice(['en', 'de'])}/{i}" for i in range(300)] + [None, "http://hot.com"] * 3
    few, many = judged(spark, urls), judged(spark, urls, few=0, salts=4)
    assert few == many and len(few) == len(urls)


@pytest.mark.parametrize("rules", [[], URL_RULES])
def test_tables_without_rows_or_rules(spark, rules):
    df = pages(spark, ["http://h.com/de/1"] * 5 + [None])
    assert url_templates.judge(df.limit(0), rules).count() == 0
    got = url_templates.judge(df.withColumn("page_id", F.lit(None).cast("long")), rules).collect()
    assert len(got) == 6 and all(r.page_id is None for r in got)
    assert [r.verdict for r in got if not r.host] == ["block" if rules else "allow"] or not rules


def test_very_long_paths(spark):
    urls = ["http://h.com/" + "a/" * 50_000, "http://h.com/" + "b" * 300_000, *[f"http://h.com/p/{i}" for i in range(10)]]
    got = judged(spark, urls)
    assert got[0].template.startswith("/{w}/{w}") and got[0].template.count("/") == 50_000 and got[1].template == "/{w}"


def test_branches_are_compared_with_pooled_counts(spark):
    x = lambda s, good, bad: (0.0, s, [0.0, 100.0] + [0.0] * 7, [float(good), float(bad)])
    rows = [([x("a", 50, 0), x("b", 0, 0), x("c", 0, 0), x("d", 0, 50)],), ([],)]
    df = spark.createDataFrame(rows, "b array<struct<purity:double,segment:string,next:array<double>,labels:array<double>>>")
    got = [[g.segments for g in r.g] for r in df.select(url_templates.merged(F.col("b")).alias("g")).collect()]
    assert got == [[["a", "b", "c"], ["d"]], []]


def test_the_plan_has_no_python(spark, capsys):
    url_templates.judge(pages(spark, ["http://h.com/de/1"] * 5), URL_RULES).explain()
    assert not re.search("Python|Arrow|Pandas|RDD", capsys.readouterr().out.replace("ExistingRDD", ""))
