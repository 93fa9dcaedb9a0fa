"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import filter_audit, html_text, jaccard, linededup, lm_score, merkle, packing, sentencepiece_lattice, topk, toxicity, url_templates, vector_codes, warc
from docfacts.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good).select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_background", "ce_target", "score")])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.drop_lines(table(spark, sf_dir, "documents"), F.col("source"))
    return cleaned.select("doc_id", "source", "line_dedup.n_lines", "line_dedup.n_dropped", "text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_lattice.load(piece_model_path())
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), pieces, rule="viterbi")
    both = sentencepiece_lattice.decode(encoded, pieces, to="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("restored"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of op11: host, begin of the path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_line_dedup, op4_ngram_jaccard_join, op5_document_fingerprints, op6_toxicity, op7_html_extraction, op8_exact_top_k, op9_sentencepiece, op10_warc, op11_url_filters, op12_vector_codes, op13_filter_audit)}

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT DISTINCT source, md5(t) AS page, unnest(list_filter(list_transform(lines, lambda x: trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: x <> '')) AS line FROM d
), n AS (
  SELECT source, line, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 5
), p AS (
  SELECT source, count(DISTINCT md5(t)) AS pages FROM d GROUP BY source
), b AS (
  SELECT n.source, list(line) AS bad FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n > 0.05 * pages GROUP BY n.source
), k AS (
  SELECT doc_id, d.source, text, lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' '))) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS target FROM documents
), k AS (
  SELECT doc_id, target, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), c AS (
  SELECT w, count(*) AS n, count(*) FILTER (WHERE target) AS t FROM k GROUP BY w
), s AS (
  SELECT sum(n) AS n, sum(t) AS t FROM c
), v AS (
  SELECT c.w, c.n, c.t FROM c
), z AS (
  SELECT s.n AS n, s.t AS t, count(v.w) AS size, s.n - sum(v.n) AS un, s.t - sum(v.t) AS ut FROM v, s GROUP BY s.n, s.t
), one AS (
  SELECT w, (v.n + 1) / (z.n + size + 1)::DOUBLE AS pn, (v.t + 1) / (z.t + size + 1)::DOUBLE AS pt FROM v, z
  UNION ALL SELECT NULL, (un + 1) / (n + size + 1)::DOUBLE, (ut + 1) / (t + size + 1)::DOUBLE FROM z
), b AS (
  SELECT doc_id, target, i, v.w AS w, CASE WHEN i = 1 THEN chr(1) ELSE lag(v.w) OVER (PARTITION BY doc_id ORDER BY i) END AS h FROM k LEFT JOIN v USING (w)
), two AS (
  SELECT h, w, count(*) AS n, count(*) FILTER (WHERE target) AS t FROM b WHERE h IS NOT NULL AND w IS NOT NULL GROUP BY h, w
), his AS (
  SELECT h, sum(n) AS n, sum(t) AS t FROM two GROUP BY h
), g AS (
  SELECT doc_id, ln((coalesce(two.n, 0) + 50 * pn) / (coalesce(his.n, 0) + 50)) AS ln_n, ln((coalesce(two.t, 0) + 50 * pt) / (coalesce(his.t, 0) + 50)) AS ln_t
  FROM b JOIN one ON b.w IS NOT DISTINCT FROM one.w LEFT JOIN two ON b.h = two.h AND b.w = two.w LEFT JOIN his ON b.h = his.h
), e AS (
  SELECT doc_id, count(*) AS k, -avg(ln_n) AS cn, -avg(ln_t) AS ct FROM g GROUP BY doc_id
)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_tokens, round(coalesce(cn, 0), 6) AS ce_background, round(coalesce(ct, 0), 6) AS ce_target, round(coalesce(ct - cn, 0), 6) AS score FROM d LEFT JOIN e USING (doc_id)
"""



def op11_sql(depth: int = 3, share: float = 0.05, support: int = 4, least: float = 0.5) -> str:
    """The template tree level by level; branches are folded by recursion over their order."""
    stem = r"regexp_extract({0}, '(?s)^(.*?)(\.[A-Za-z]{{2,5}})?\z', 1)"
    shape = (r"(CASE WHEN regexp_matches(" + stem + r", '^[0-9]+\z') THEN '{{n}}' WHEN regexp_matches(" + stem + r", '^[A-Za-z_-]+\z') THEN '{{w}}' ELSE '{{x}}' END || regexp_extract({0}, '(?s)^(.*?)(\.[A-Za-z]{{2,5}})?\z', 2))").format
    total = "list_sum({0})".format
    terms = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] + z[2] > 0 THEN (z[1] * list_sum({1}) - z[2] * list_sum({0})) ** 2 / (z[1] + z[2]) ELSE 0 END))".format
    freedom = "(len(list_filter(list_zip({0}, {1}), lambda z: z[1] + z[2] > 0)) - 1)".format
    apart = lambda a, b: f"({total(a)} > 0 AND {total(b)} > 0 AND {freedom(a, b)} > 0 AND {terms(a, b)} / ({total(a)} * {total(b)}) > {freedom(a, b)} + 3 * sqrt(2.0 * {freedom(a, b)}))"
    added = "list_transform(list_zip({0}, {1}), lambda z: z[1] + z[2])".format
    kinds = ", ".join(f"count(*) FILTER (WHERE {w})::DOUBLE" for w in ("k IS NULL", *[f"{k} AND {m}" for k in ("k = '{n}'", "k = '{w}'", "k = '{x}'", "length(k) > 3") for m in ("NOT more", "more")]))
    step = lambda i, literal: f"CASE WHEN segs[{i + 1}] IS NULL THEN '' ELSE '/' || coalesce({literal}, {shape(f'segs[{i + 1}]')}) END"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    ctes = [
        "u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)",
        "h AS (SELECT r, page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)",
        f"x AS (SELECT r, max((length(h || p), length(h), h || p, v)) AS x FROM h JOIN (VALUES {rules}) l(h, p, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)",
        "t0 AS (SELECT h.*, x[3] AS rule, x[4] AS ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS template, '' AS plain, coalesce(x[4] = 'allow', false)::INT AS good, coalesce(x[4] = 'block', false)::INT AS bad FROM h LEFT JOIN x USING (r))",
    ]
    for i in range(depth):
        ctes += [
            f"a{i} AS (SELECT host, template, segs[{i + 1}] AS s, CASE WHEN segs[{i + 2}] IS NOT NULL THEN {shape(f'segs[{i + 2}]')} END AS k, len(segs) > {i + 2} AS more, good, bad FROM t{i} WHERE len(segs) > {i})",
            f"c{i} AS (SELECT host, template, s, count(*) AS n, sum(good)::DOUBLE AS good, sum(bad)::DOUBLE AS bad, [{kinds}] AS nx FROM a{i} GROUP BY ALL)",
            f"l{i} AS (SELECT c.*, [good, bad] AS lb, row_number() OVER (PARTITION BY host, template ORDER BY list_position(nx, list_max(nx)) DESC, (good + 1) / (good + bad + 2) DESC, s DESC) AS rn FROM c{i} c JOIN (SELECT host, template, count(*) AS pages FROM a{i} GROUP BY ALL) USING (host, template) WHERE n >= {support} AND n >= {share} * pages)",
            f"m{i} AS (SELECT host, template, s, rn, 1 AS g, nx, lb FROM l{i} WHERE rn = 1 UNION ALL SELECT host, template, s, rn, g + new::INT, CASE WHEN new THEN nb ELSE {added('na', 'nb')} END, CASE WHEN new THEN lbb ELSE {added('la', 'lbb')} END FROM "
            f"(SELECT l.host, l.template, l.s, l.rn, m.g, m.nx AS na, m.lb AS la, l.nx AS nb, l.lb AS lbb, {apart('m.nx', 'l.nx')} OR {apart('m.lb', 'l.lb')} AS new FROM m{i} m JOIN l{i} l ON m.host = l.host AND m.template = l.template AND l.rn = m.rn + 1) y)",
            f"b{i} AS (SELECT host, template, s, CASE WHEN count(*) OVER w = 1 THEN s ELSE '{{' || array_to_string(list_sort(list(s) OVER w), '|') || '}}' END AS branch FROM m{i} WINDOW w AS (PARTITION BY host, template, g))",
            f"t{i + 1} AS (SELECT t.* EXCLUDE (template, plain), t.template || {step(i, 'branch')} AS template, plain || {step(i, 'b.s')} AS plain FROM t{i} t LEFT JOIN b{i} b ON t.host = b.host AND t.template = b.template AND b.s = segs[{i + 1}])",
        ]
    tail = f"array_to_string(list_transform(segs[{depth + 1}:], lambda s: '/' || {shape('s')}), '')"
    ctes += [
        f"t AS (SELECT * EXCLUDE (template, plain), template || {tail} AS template, plain || {tail} AS plain FROM t{depth})",
        "e AS (SELECT (sum(good) + 1.0::DOUBLE) / (sum(good) + sum(bad) + 2) AS base FROM t)",
        "p AS (SELECT plain, round_even((sum(good) + 2 * base) / (sum(good) + sum(bad) + 2) * 1e6, 0)::BIGINT AS prior FROM t, e GROUP BY plain, base)",
        "f AS (SELECT host, template, (sum(good) + 2 * (sum(prior)::DOUBLE / count(*) / 1e6)) / (sum(good) + sum(bad) + 2) AS purity FROM t JOIN p USING (plain) GROUP BY host, template)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {least} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM t JOIN f USING (host, template)"


OP12_ROUND = """, d{n} AS (
  SELECT s.r, s.p, min((list_sum(list_transform(list_zip(s.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e)) AS m FROM s JOIN b{n} b USING (p) GROUP BY s.r, s.p
)"""
OP12_UPDATE = """, u{n} AS (
  SELECT p, e, i, sum(v)::HUGEINT AS total, count(*)::HUGEINT AS n FROM (SELECT p, m[2] AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s JOIN d{n} USING (r, p)) y GROUP BY p, e, i
), b{m} AS (
  SELECT p, e, coalesce(mean, c) AS c FROM b{n} LEFT JOIN (SELECT p, e, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS mean FROM u{n} GROUP BY p, e) t USING (p, e)
)"""
OP12_SQL = (
    """
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), f AS (
  SELECT q, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM (SELECT * FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id, q LIMIT 64) h
), s AS (
  SELECT r, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS x FROM k, range(16) t(p)
), b0 AS (
  SELECT p, e, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS c FROM f, range(16) t(p)
)"""
    + OP12_ROUND.format(n=0) + OP12_UPDATE.format(n=0, m=1) + OP12_ROUND.format(n=1) + OP12_UPDATE.format(n=1, m=2) + OP12_ROUND.format(n=2)
    + """, z AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM b2
), c AS (
  SELECT r, string_agg(lower(lpad(to_hex(m[2]), 2, '0')), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM d2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM c JOIN k USING (r), z
"""
)

OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t
), m AS (
  SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
    doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad FROM w
), g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY part, mask
), o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS own, 0 AS all_before
  UNION ALL SELECT filter_order || chr(65 + i), step + 1, all_before, 1 << i, all_before + (1 << i) FROM o, (SELECT unnest(range(5))::INT AS i) l WHERE step < 5 AND all_before & (1 << i) = 0
), s AS (
  SELECT p.filter_order, x.step, x.before, x.own FROM o p JOIN o x ON p.step = 5 AND x.step > 0 AND left(p.filter_order, x.step) = x.filter_order
), r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

ORACLES = {"op11_url_filters": op11_sql(), "op12_vector_codes": OP12_SQL, "op13_filter_audit": OP13_SQL, "op2_lm_scoring": OP2_SQL, "op3_line_dedup": OP3_SQL, "op8_exact_top_k": OP8_SQL, "op10_warc": OP10_SQL}
