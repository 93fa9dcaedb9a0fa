"""DuckDB building blocks of the oracles: relational forms of what the operators do within a row."""

from __future__ import annotations

from docfacts.operators.fields import ANCHORS, LABELS

LINES_SQL = r"""
pg AS (SELECT doc_id, unnest(pages) AS t, generate_subscripts(pages, 1) AS page FROM om),
ln0 AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pg),
ln AS (SELECT doc_id, page, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM ln0),
lines AS (SELECT doc_id, page, i, line, ls[i + 1] AS below, trim(rtrim(lower(line), ':')) AS low FROM ln)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kv_sql(name: str, labels: list[str] | None = None) -> str:
    """A CTE kv_name: doc_id, value, page, line of the first label hit."""
    labels = [x.lower() for x in (labels or LABELS[name])]
    rest = ", ".join(
        f"CASE WHEN starts_with(low, {quoted(x + ':')}) OR (starts_with(low, {quoted(x)}) AND length(low) > {len(x) + 1} AND substr(low, {len(x) + 1}, 1) IN (' ', chr(9))) THEN nullif(trim(ltrim(substr(line, {len(x) + 1}), ': ' || chr(9))), '') END"
        for x in labels
    )
    given = ", ".join(quoted(x) for x in labels)
    return f"""kv_{name} AS (
  SELECT doc_id, arg_min(value, o) AS value, arg_min(page, o) AS page, arg_min(line, o) AS line FROM (
    SELECT doc_id, page, line, page * 100000 + i AS o, coalesce(CASE WHEN low IN ({given}) THEN below END, {rest}) AS value FROM lines
  ) x WHERE value IS NOT NULL GROUP BY doc_id)"""


def near_sql(name: str, pattern: str, anchors: list[str] | None = None, window: int | None = None) -> str:
    """A CTE near_name: doc_id, value, page of the first match within the window after an anchor."""
    if anchors is None:
        anchors, window = ANCHORS[name]
    anchor = "(?i)(" + "|".join(anchors) + ")"
    return f"""near_{name} AS (
  SELECT doc_id, arg_min(value, o) AS value, arg_min(page, o) AS page FROM (
    SELECT doc_id, page, page * 1000000 + pos AS o, regexp_extract(seg, {quoted('(?i)' + pattern)}, 1) AS value FROM (
      SELECT doc_id, page, pos, substr(t, pos + 1, {window}) AS seg FROM (
        SELECT doc_id, page, t, j, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, page ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS pos FROM (
          SELECT doc_id, page, t, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j FROM (
            SELECT doc_id, page, t, string_split(regexp_replace(t, {quoted(anchor)}, chr(1) || '\\1', 'g'), chr(1)) AS ps FROM pg) a) b) c
      WHERE j > 1) d WHERE regexp_matches(seg, {quoted('(?i)' + pattern)})) e GROUP BY doc_id)"""


def first_sql(name: str, pattern: str) -> str:
    """A CTE first_name: doc_id, value, page of the first match over the pages."""
    p = quoted("(?i)" + pattern)
    return f"first_{name} AS (SELECT doc_id, arg_min(regexp_extract(t, {p}, 1), page) AS value, min(page) AS page FROM pg WHERE regexp_matches(t, {p}) GROUP BY doc_id)"


def money_sql(x: str) -> str:
    return f"CAST(round_even(try_cast(replace(replace({x}, ',', ''), '$', '') AS DOUBLE), 0) AS BIGINT)"


PCT_SQL = r"([0-9]{1,2}(?:\.[0-9]{1,3})?)\s*%"
MONEY_SQL = r"\$?\s?([0-9][0-9,]{2,}(?:\.[0-9]+)?)"
DATE_SQL = r"([A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
MONTHS_SQL = "['january','february','march','april','may','june','july','august','september','october','november','december']"


def date_sql(x: str) -> str:
    long, numeric, short = r"([A-Za-z]+)\s+([0-9]{1,2}),?\s+((?:19|20)[0-9]{2})", r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]((?:19|20)?[0-9]{2})", r"([A-Za-z]+)\s+((?:19|20)[0-9]{2})"
    g = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
    m = lambda p: f"list_position({MONTHS_SQL}, lower({g(p, 1)}))"
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    year = f"try_cast({g(numeric, 3)} AS INT)"
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN {m(long)} > 0 THEN {g(long, 3)} || '-' || {two(m(long))} || '-' || {two(g(long, 2))}
      WHEN regexp_matches({x}, '{numeric}') THEN CAST(CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END AS VARCHAR) || '-' || {two(g(numeric, 1))} || '-' || {two(g(numeric, 2))}
      WHEN {m(short)} > 0 THEN {g(short, 2)} || '-' || {two(m(short))} || '-01' END"""


def rate_sql(x: str, digits: int = 5) -> str:
    return f"round_even(try_cast({x} AS DOUBLE) / 100, {digits})"


def field_sql(name: str, kv: str | None, other: str | None, ok: str, other_cte: str) -> str:
    """A CTE f_name: doc_id, v, conf, page; high by label, else medium by pattern. ok: a test of {v}."""
    tries = []
    if kv:
        tries.append((kv, "high", f"kv_{name}"))
    if other:
        tries.append((other, "medium", other_cte))
    v = "CASE " + " ".join(f"WHEN {ok.format(v=e)} THEN {e}" for e, _, _ in tries) + " END"
    conf = "CASE " + " ".join(f"WHEN {ok.format(v=e)} THEN '{c}'" for e, c, _ in tries) + " ELSE 'unknown' END"
    page = "CASE " + " ".join(f"WHEN {ok.format(v=e)} THEN {t}.page" for e, _, t in tries) + " END"
    joins = " ".join(f"LEFT JOIN {t} USING (doc_id)" for _, _, t in tries)
    return f"f_{name} AS (SELECT om.doc_id, {v} AS v, {conf} AS conf, CAST({page} AS INT) AS page FROM om {joins})"
