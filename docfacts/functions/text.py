"""Text primitives as Column builders: lines, label lookup, anchored windows, parsing.

A document's pages are one ``array<string>`` column, so every primitive stays in
its row: no shuffle, no Python in the tasks. First hits follow the order of
pages, then of lines or offsets.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.schemas import NOT_FOUND, UNKNOWN, field

#: Number and date patterns of the document model.
MONEY = r"\$?\s?([0-9][0-9,]{2,}(?:\.[0-9]+)?)"
PCT = r"([0-9]{1,2}(?:\.[0-9]{1,3})?)\s*%"
LONG_OR_NUMERIC_DATE = r"([A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
LONG_DATE = r"([A-Za-z]+)\s+([0-9]{1,2}),?\s+((?:19|20)[0-9]{2})"
NUMERIC_DATE = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]((?:19|20)?[0-9]{2})"
MONTH_DATE = r"([A-Za-z]+)\s+((?:19|20)[0-9]{2})"
MONTHS = "january february march april may june july august september october november december".split()

def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value named: what holds a lambda is evaluated anew at every place where its expression stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[\s ]+", ""), r"[\s ]+$", "")


def squeeze(text: Column) -> Column:
    """White-space runs as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def texts(pages: Column | str) -> Column:
    """The pages, a null one as an empty one: a page that was not read hides no other."""
    pages = F.col(pages) if isinstance(pages, str) else pages
    return F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))


def page_lines(pages: Column) -> Column:
    """Of each page the trimmed, non-empty lines, as struct(line, low): low is in lower case and without closing colons."""
    low = lambda x: strip(F.regexp_replace(F.lower(x), ":+$", ""))
    lines = lambda t: F.filter(F.transform(F.split(t, r"\R"), strip), lambda x: x != "")
    return F.transform(texts(pages), lambda t: F.transform(lines(t), lambda x: F.struct(x.alias("line"), low(x).alias("low"))))


def numbered_lines(pages: Column) -> Column:
    """The lines of ``page_lines`` as one text: of each the number of its page, a form feed, the line and a line feed. No line holds the last two; a blank page has one empty line."""
    blank = r"[\s \x{85}\x{2028}\x{2029}]"
    # a text without other ends of lines than a line feed, and without blanks beside one or at its own ends, needs no search for them
    odd = rf"{blank}(?:\n|$|(?<=[\r\x0B\f\x{{85}}\x{{2028}}\x{{2029}}])|(?<=\n(?s:.))|(?<=^(?s:.)))"

    def of_page(t: Column, page: Column) -> Column:
        lead = F.concat((page + 1).cast("string"), F.lit("\f"))
        inner = F.regexp_replace(F.regexp_replace(t, f"^{blank}+", ""), f"{blank}+$", "")
        begin = F.concat(F.lit("\n"), lead)
        return F.concat(lead, F.when(F.regexp_like(t, F.lit(odd)), F.regexp_replace(inner, rf"[\s ]*\R{blank}*", begin)).otherwise(F.replace(t, F.lit("\n"), begin)), F.lit("\n"))

    return F.array_join(F.transform(texts(pages), of_page), "")


def full_text(pages: Column) -> Column:
    return F.array_join(texts(pages), "\n")


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def kv_lookup(lines: Column | str, labels: list[str]) -> Column:
    """struct(value, page, line) of the first label hit, or null. ``lines``: see numbered_lines.

    A line that is a label has its value in the next line; one that begins with
    a label, in its rest. The first hit counts, whatever its value is worth.
    One search over all lines: the hit is cut out, then taken apart.
    """
    names = "|".join(_escaped(x.lower()) for x in labels)  # in the order of the labels
    alone = names.replace("k", "[k\u212a]")  # the one letter beyond ASCII whose lower case is a letter of ASCII
    begins = _first_letters(labels).replace("k", "k\u212a")  # most lines begin with none of these, and need no label tried
    hit = rf"(?dm)^(\d+)\f(?=[{begins}])(?:((?i:{alone})[\s ]*:*)\n\1\f([^\n]+)|((?i:{names})[: \t]+([^: \t\n][^\n]*)))"
    part = lambda m, i: F.nullif(F.regexp_extract(m, hit, i), F.lit(""))

    def parts(m: Column) -> Column:
        return F.when(m != "", F.struct(F.coalesce(part(m, 3), strip(part(m, 5))).alias("value"), part(m, 1).cast("int").alias("page"), F.coalesce(part(m, 2), part(m, 4)).alias("line")))

    return let(F.regexp_extract(lines, hit, 0), parts)


def says(low: Column, words: list[str]) -> Column:
    """Whether a text in lower case holds one of the words: a plain search, some times cheaper than a pattern."""
    return reduce(operator.or_, [F.contains(low, F.lit(w)) for w in _shortest(words)])


def _shortest(words: list[str]) -> list[str]:
    """The words in lower case, without those that hold another of them."""
    kept: list[str] = []
    for w in sorted({w.lower() for w in words}, key=lambda w: (len(w), w)):
        kept += [] if any(k in w for k in kept) else [w]
    return kept


def regex_near(pages: Column | str, anchors: list[str], pattern: str, window: int, group: int = 1, low: Column | None = None) -> Column:
    """struct(value, page, snippet) of the first match within ``window`` characters from an anchor's start, or null.

    ``low``: the document's text in lower case (lines as in numbered_lines will
    do); where it names no anchor, no page is searched. A page is searched only
    where those before it have no hit.
    """
    anchor = "(?i:" + "|".join(_escaped(a) for a in anchors) + ")"
    windows = F.lit(f"(?=[{_first_letters(anchors)}])(?={anchor})(?=((?s:.{{1,{window}}}))){anchor}")
    inside = F.lit("(?i)" + pattern)
    of_page = lambda text: first(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), windows, 1), lambda s: F.regexp_like(s, inside)))
    made = lambda s, page: F.struct(F.regexp_extract(s, "(?i)" + pattern, group).alias("value"), page.alias("page"), F.substring(squeeze(s), 1, 120).alias("snippet"))
    hit = _first_page(F.col(pages) if isinstance(pages, str) else pages, "string", of_page, made)
    # an anchor of other letters may have a lower case that depends on its neighbours
    return hit if low is None or not all(a.isascii() for a in anchors) else F.when(says(low, anchors), hit)


def _first_page(pages: Column, kind: str, search: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """``made(found, page)`` of the first page in which ``search`` finds something (of type ``kind``), or null. Later pages are not searched."""
    none = F.struct(F.lit(0).alias("page"), F.lit(None).cast(kind).alias("found"))
    step = lambda done, t: F.when(done["found"].isNotNull(), done).otherwise(F.struct((done["page"] + 1).alias("page"), search(t).alias("found")))
    return F.aggregate(pages, none, step, lambda done: F.when(done["found"].isNotNull(), made(done["found"], done["page"])))


def regex_first(pages: Column | str, pattern: str, group: int = 1, low: Column | None = None, words: list[str] | None = None) -> Column:
    """struct(value, page, snippet) of the first match over the pages, or null.

    ``words``: every match holds one of them in lower case, without blanks;
    where ``low`` (see regex_near) does not, no page is searched.
    """
    p = "(?i)" + pattern
    at = lambda t: let(F.regexp_instr(t, F.lit(p)), lambda at: F.when(at > 0, F.struct(t.alias("t"), at.alias("at"))))
    search = lambda t: let(F.coalesce(t, F.lit("")), at)

    def made(x: Column, page: Column) -> Column:
        begin = F.greatest(x["at"] - 30, F.lit(1))
        around = lambda m: F.substr(x["t"], begin, x["at"] + F.length(m) + 30 - begin)
        return let(F.regexp_extract(x["t"], p, 0), lambda m: F.struct(F.regexp_extract(x["t"], p, group).alias("value"), page.alias("page"), F.substring(squeeze(around(m)), 1, 120).alias("snippet")))

    hit = _first_page(F.col(pages) if isinstance(pages, str) else pages, "struct<t:string,at:int>", search, made)
    return hit if low is None or not words else F.when(says(low, words), hit)


def _first_letters(words: list[str]) -> str:
    """The first letters of the words, in both cases, as what stands in a pattern's brackets."""
    return "".join(sorted({c if c.isalnum() else "\\" + c for w in words for c in (w[0].lower(), w[0].upper())}))


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def decimal(text: Column) -> Column:
    """A plain decimal number; the type suffixes that a cast would accept (1d, 2f) are none."""
    plain = F.trim(text)
    return F.when(F.regexp_like(plain, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), plain.try_cast("double"))


def money(text: Column) -> Column:
    """$ and commas dropped, rounded half to even; null if it is no number."""
    return F.bround(decimal(F.translate(text, "$,", "")), 0).try_cast("bigint")


def number(text: Column) -> Column:
    return decimal(F.replace(text, F.lit(","), F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """array of struct(found, at): every match and its 0-based offset. The pattern may match no empty string."""
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    before = F.lit(rf"\G((?s:.*?))(?:{pattern})")  # a split would compile its pattern for every text
    placed = lambda found: let(F.regexp_extract_all(text, before, 1), lambda gaps: F.transform(found, lambda m, i: F.struct(m.alias("found"), (length(gaps, i + 1) + length(found, i)).alias("at"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, placed(found)).when(found.isNotNull(), F.array().cast("array<struct<found:string,at:int>>")))


def parse_date(text: Column) -> Column:
    """ISO text of "Month d, yyyy", "m/d/y" or "Month yyyy"; month and day are not checked."""
    names = literal(MONTHS)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")

    def month(name: Column) -> Column:
        return F.nullif(F.array_position(names, F.lower(name)), F.lit(0).cast("bigint"))

    long, numeric, short = LONG_DATE, NUMERIC_DATE, MONTH_DATE
    g = lambda p, i: F.regexp_extract(text, p, i)
    year = g(numeric, 3).try_cast("int")
    return F.coalesce(
        F.when(month(g(long, 1)).isNotNull(), F.concat_ws("-", g(long, 3), two(month(g(long, 1))), F.lpad(g(long, 2), 2, "0"))),
        F.when(F.regexp_like(text, F.lit(numeric)), F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), F.lpad(g(numeric, 1), 2, "0"), F.lpad(g(numeric, 2), 2, "0"))),
        F.when(month(g(short, 1)).isNotNull(), F.concat_ws("-", g(short, 2), two(month(g(short, 1))), F.lit("01"))),
    )


def norm(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def found_field(value: Column, kind: str, confidence: str | Column, method: str | Column, page: Column, snippet: Column, notes: str | Column | None = None, ok: Column | None = None) -> Column:
    """A field, or null where the value is null or ``ok`` does not hold."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(
        value.alias("value"), lit(confidence).alias("confidence"), lit(method).alias("method"), page.cast("int").alias("source_page"), snippet.cast("string").alias("source_snippet"),
        lit(notes).cast("string").alias("notes"), F.array().alias("paths"), F.lit(False).alias("review_required"),
    ).cast(field(kind))
    return F.when(value.isNotNull() & (ok if ok is not None else F.lit(True)), made)


def missing(kind: str, note: str) -> Column:
    return F.struct(
        F.lit(None).alias("value"), F.lit(UNKNOWN).alias("confidence"), F.lit(NOT_FOUND).alias("method"), F.lit(None).alias("source_page"), F.lit(None).alias("source_snippet"),
        F.lit(note).alias("notes"), F.array().alias("paths"), F.lit(False).alias("review_required"),
    ).cast(field(kind))


def found(f: Column) -> Column:
    return f["value"].isNotNull() & (f["method"] != NOT_FOUND)


