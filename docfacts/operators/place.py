"""Where a document's subject is: contact blocks, weighted votes for city and state, zip, address.

Everything stays in the document's row: matches with their offsets are arrays,
blocks are merged intervals, and a match inside a block has no vote.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import first, found_field, kv_lookup, let, matches, missing, norm, regex_first, squeeze, texts
from docfacts.schemas import HIGH, KINDS, LOW, MEDIUM, VERBATIM

#: States by their names.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
#: Signs of a contact block, and how far it reaches.
LICENSE = r"(?i)\b(?:CRE\s*Lic|DRE|BRE|Lic(?:ense)?\.?\s*#|CA\s*Lic|broker\s*of\s*record|License\s*No|CalDRE|Cal\.?\s*DRE)\b"
PANEL = (
    r"(?i)\b(?:exclusively\s+(?:listed|marketed|represented)\s+by|listed\s+by|presented\s+by|marketed\s+by|in\s+conjunction\s+with|broker\s+of\s+record"
    r"|advisor(?:s)?\s*:|listing\s+(?:agent|broker)|contact\s*:)\b"
)
PHONE = r"\b\d{3}[.\-)\s]\s?\d{3}[.\-\s]\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PAD, NEAR = 160, 120
#: What every match of a sign holds in lower case: a plain search for it spares most pages the pattern.
LICENSE_WORDS = ["lic", "dre", "bre", "broker"]
PANEL_WORDS = ["listed", "marketed", "sented", "conjunction", "broker", "advisor", "listing", "contact"]
#: Places in texts, and the weights of their votes. A run ends at a comma, which is none of its characters: giving some back helps none.
STREET = r"(?=\d)\b\d{2,6}\s+[A-Za-z0-9.\-' ]{3,40}+,\s*"
CITY = r"([A-Z][A-Za-z .'\-]{1,28}+)"
CITY_STATE_ZIP = CITY + r",\s*([A-Z]{2})\b\.?\s*(\d{5})?"
CITY_NAME = CITY + r",\s*(" + "|".join(STATES) + r")\b"
CODE_END, NAME_END = r",\s*[A-Z]{2}\b", r"(?i),\s*(?:" + "|".join(STATES) + r")\b"
COVER_CITY = r"([A-Z][A-Za-z.'\- ]{2,22}),\s*([A-Z]{2})\b"
PATH_CITY = r"([A-Za-z][A-Za-z .']{1,28}?)[, ]+([A-Z]{2})\b\.?\s*(\d{5})?(?:[\s,]|$)"
NO_CITY = ["suite", "ste", "unit", "po box"]
VOTING_PAGES, FILE_WEIGHT, STREET_WEIGHT, ZIP_WEIGHT = 5, 25, 4, 2
ADDRESS_LABELS = ["Address", "Property Address", "Location", "Site Address"]

SPAN = "array<struct<begin:int,end:int>>"
VOTE = "struct<city:string,state:string,zip:string,page:int,snippet:string,weight:int>"


def state_codes() -> Column:
    return F.array(*[F.lit(v) for v in STATES.values()])


def state_of(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.lower(name))


def contact_line(line: Column) -> Column:
    """Whether one line belongs to a contact block: a licence, a panel's head, or phone with mail."""
    return F.regexp_like(line, F.lit(LICENSE)) | F.regexp_like(line, F.lit(PANEL)) | (F.regexp_like(line, F.lit(PHONE)) & F.regexp_like(line, F.lit(EMAIL)))


def contact_blocks(text: Column) -> Column:
    """The merged intervals [begin, end) of a page's contact blocks: every sign with PAD characters around it."""
    around = lambda m: F.struct(F.greatest(m["at"] - PAD, F.lit(0)).alias("begin"), (m["at"] + F.length(m["found"]) + PAD).alias("end"))
    none = F.array().cast("array<struct<found:string,at:int>>")
    holding = lambda low, words, found: F.when(reduce(operator.or_, [F.contains(low, F.lit(w)) for w in words]), found).otherwise(F.when(low.isNotNull(), none))
    merged = lambda signs: F.when(F.size(signs) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(F.sort_array(F.transform(signs, around)), F.array().cast(SPAN), merge))
    near = lambda phones, mails: F.filter(phones, lambda p: F.exists(mails, lambda e: F.abs(p["at"] - e["at"]) <= NEAR))
    phones = let(matches(text, EMAIL), lambda mails: F.when(F.size(mails) > 0, near(matches(text, PHONE), mails)).otherwise(none))
    signs = lambda low: F.concat(holding(low, LICENSE_WORDS, matches(text, LICENSE)), holding(low, PANEL_WORDS, matches(text, PANEL)), holding(low, ["@"], phones))

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["begin"] <= last["end"]), wider).otherwise(F.concat(done, F.array(s)))

    return let(let(F.lower(text), signs), merged)


def in_block(blocks: Column, at: Column) -> Column:
    return F.exists(blocks, lambda s: (s["begin"] <= at) & (at < s["end"]))


def file_stem(path: Column) -> Column:
    """The name of a path's file without folders, .pdf and a number of copies."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.pdf$", ""), r"\s*\(\d+\)\s*$", "")


def file_place(path: Column) -> Column:
    """struct(city, state, zip) that the file's name gives, or null: its last segment that names a state."""
    parts = F.split(file_stem(path), r"\s+-\s+")
    codes = "(" + "|".join(STATES.values()) + ")"
    named = F.filter(parts, lambda s: F.regexp_like(s, F.lit(rf"\b{codes}\b")))
    search = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(parts, F.lit(-1)))
    g = lambda m, i: F.regexp_extract(m, PATH_CITY, i)
    made = F.transform(F.regexp_extract_all(search, F.lit(PATH_CITY), 0), lambda m: F.struct(F.regexp_replace(g(m, 1), r"^[ ,.\-]+|[ ,.\-]+$", "").alias("city"), g(m, 2).alias("state"), F.nullif(g(m, 3), F.lit("")).alias("zip")))
    return F.try_element_at(F.filter(made, lambda m: F.array_contains(state_codes(), m["state"])), F.lit(-1))


def votes(path: Column, pages: Column) -> Column:
    """Every vote in order: the file's name, then of each page the streets with state, with its name, and bare places."""
    def of_file(named: Column) -> Column:
        return F.when(named.isNotNull(), F.array(F.struct(named["city"].alias("city"), named["state"].alias("state"), named["zip"].alias("zip"), F.lit(None).cast("int").alias("page"), F.concat(F.lit("filename:"), named["city"], F.lit(", "), named["state"]).alias("snippet"), F.lit(FILE_WEIGHT).alias("weight")).cast(VOTE)))

    own = let(file_place(path), of_file)

    none = F.array().cast(f"array<{VOTE}>")

    def of_page(text: Column, p: Column) -> Column:
        base = F.greatest(F.lit(1), VOTING_PAGES - p)

        def kind(blocks: Column, pattern: str, groups: int, factor: int, zip_bonus: int) -> Column:
            g = lambda m, i: F.regexp_extract(m["found"], pattern, i)
            zip_ = (lambda m: F.nullif(g(m, 3), F.lit(""))) if groups == 3 else (lambda m: F.lit(None).cast("string"))
            state = (lambda m: g(m, 2)) if groups == 3 else (lambda m: state_of(g(m, 2)))
            made = lambda m: F.struct(F.trim(g(m, 1)).alias("city"), state(m).alias("state"), zip_(m).alias("zip"), (p + 1).cast("int").alias("page"), F.substring(squeeze(m["found"]), 1, 80).alias("snippet"), (base * factor + F.when(zip_(m).isNotNull(), zip_bonus).otherwise(0)).cast("int").alias("weight")).cast(VOTE)
            # where there is no block, no match is in one: its place is not asked for
            free = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(m.alias("found"), F.lit(0).alias("at")))
            return F.transform(F.when(F.size(blocks) > 0, F.filter(matches(text, pattern), lambda m: ~in_block(blocks, m["at"]))).otherwise(free), made)

        def of_ends(ends: Column) -> Column:
            where = lambda end, made: F.when(end, made).otherwise(none)
            of_blocks = lambda blocks: F.concat(
                where(ends["code"], kind(blocks, STREET + CITY_STATE_ZIP, 3, STREET_WEIGHT, ZIP_WEIGHT)), where(ends["name"], kind(blocks, "(?i)" + STREET + CITY_NAME, 2, STREET_WEIGHT, 0)),
                where(ends["code"], kind(blocks, CITY_STATE_ZIP, 3, 1, 0)), where(ends["name"], kind(blocks, "(?i)" + CITY_NAME, 2, 1, 0)),
            )
            return where(ends["code"] | ends["name"], let(contact_blocks(text), of_blocks))

        # a match of either kind ends in one of these: most pages hold none, and need no blocks
        ends = let(F.struct(F.regexp_like(text, F.lit(CODE_END)).alias("code"), F.regexp_like(text, F.lit(NAME_END)).alias("name")), of_ends)
        return F.when(F.contains(text, F.lit(",")), ends).otherwise(none)

    every = F.concat(F.coalesce(own, none), F.flatten(F.transform(F.slice(texts(pages), 1, VOTING_PAGES), of_page)))
    return F.filter(every, lambda v: v["state"].isin(list(STATES.values())) & ~F.lower(v["city"]).isin(NO_CITY) & (F.length(v["city"]) >= 2))


def elected(every: Column) -> Column:
    """struct(city, state, zip, page, snippet, votes) of the greatest sum of weights, the earliest of equals; zip, page and snippet are those of its first vote with a zip, else of its first."""
    same = lambda k, v: (v["city"] == k["city"]) & (v["state"] == k["state"])

    def best(votes: Column) -> Column:
        keys = F.array_distinct(F.transform(votes, lambda v: F.struct(v["city"], v["state"])))
        total = lambda k: F.aggregate(votes, F.lit(0), lambda a, v: a + F.when(same(k, v), v["weight"]).otherwise(0))
        return F.array_max(F.transform(keys, lambda k, i: F.struct(total(k).alias("votes"), (-i).alias("order"), k["city"].alias("city"), k["state"].alias("state"))))

    def told(b: Column, own: Column) -> Column:
        with_zip = F.coalesce(first(F.filter(own, lambda v: v["zip"].isNotNull())), first(own))
        return let(with_zip, lambda t: F.struct(b["city"].alias("city"), b["state"].alias("state"), t["zip"].alias("zip"), t["page"].alias("page"), t["snippet"].alias("snippet"), b["votes"].alias("votes")))

    return let(every, lambda votes: let(best(votes), lambda b: F.when(b.isNotNull(), let(F.filter(votes, lambda v: same(b, v)), lambda own: told(b, own)))))


def zip_of(path: Column, pages: Column, city: Column, state: Column) -> Column:
    """The zip next to the city (6 pages; the first place on a page counts), else next to the state (4 pages, no year), never in a contact block; else that of the file's name."""
    def beside(t: Column) -> Column:
        quoted = F.regexp_replace(city, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
        at = F.regexp_instr(t, F.concat(F.lit("(?i)"), quoted, F.lit(r"\W{0,4}"), state, F.lit(r"\.?\s*(\d{5})\b")))
        hit = F.regexp_extract(F.substring(F.substr(t, F.greatest(at, F.lit(1))), 1, 80), r"(\d{5})\b", 1)
        return F.when((at > 0) & ~in_block(contact_blocks(t), at - 1), hit)

    def after_state(t: Column) -> Column:
        hits = F.filter(matches(t, r"\b[A-Z]{2}\.?\s+\d{5}\b"), lambda m: F.substring(m["found"], 1, 2) == state)
        free = lambda some: let(contact_blocks(t), lambda blocks: F.filter(some, lambda m: ~in_block(blocks, m["at"])))
        return let(hits, lambda some: F.transform(F.when(F.size(some) > 0, free(some)).otherwise(some), lambda m: F.regexp_extract(m["found"], r"(\d{5})", 1)))

    some = lambda n, f: first(F.filter(F.transform(F.slice(texts(pages), 1, n), f), lambda z: z.isNotNull()))
    fallback = first(F.filter(F.flatten(F.transform(F.slice(texts(pages), 1, 4), after_state)), lambda z: ~z.cast("int").between(1900, 2099)))
    return F.coalesce(some(6, beside), fallback, F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"\b(\d{5})\b", 1), F.lit("")))


def portfolio_cover(pages: Column, least: int = 4) -> Column:
    """Whether the cover names so many different places that none is the subject."""
    cover = F.substring(F.coalesce(first(pages), F.lit("")), 1, 700)
    g = lambda m, i: F.regexp_extract(m, COVER_CITY, i)
    places = F.array_distinct(F.transform(F.regexp_extract_all(cover, F.lit(COVER_CITY), 0), lambda m: F.struct(norm(g(m, 1)).alias("c"), g(m, 2).alias("s"))))
    commas = F.length(cover) - F.length(F.replace(cover, F.lit(","), F.lit("")))  # every place has one of its own
    return (commas >= least) & (F.size(F.filter(places, lambda x: F.length(x["c"]) > 2)) >= least)


def corroborated(path: Column, pages: Column, value: Column) -> Column:
    """Whether the file's name or the cover's head names the value, and the cover is no portfolio's."""
    signal = F.concat(norm(F.regexp_extract(path, r"([^/]*)$", 1)), norm(F.substring(F.coalesce(first(pages), F.lit("")), 1, 400)))
    return F.coalesce(let(norm(value), lambda name: (name != "") & signal.contains(name)) & ~portfolio_cover(pages), F.lit(False))


def extract_address(df: DataFrame) -> DataFrame:
    """``df`` (path, pages, lines) with the field ``address``: high with a zip and a corroborated city, else medium; low for a street alone."""
    keep, kind = [c for c in df.columns if c != "address"], KINDS["address"]
    path, pages = F.col("path"), F.col("pages")
    df = df.withColumns({"_votes": votes(path, pages), "_at": kv_lookup("lines", ADDRESS_LABELS), "_any": regex_first(pages, r"\b(\d{1,6}\s+[A-Z][\w .'\-]{3,38})(?:,|\s+[A-Z][a-z])")})
    df = df.withColumns({"_won": elected(F.col("_votes")), "_labelled": F.nullif(F.trim(F.regexp_extract("_at.value", r"^\s*(\d[\w .'\-]+?)(?:,|$)", 1)), F.lit(""))})
    won = F.col("_won")
    df = df.withColumns({
        "_zip": F.coalesce(won["zip"], F.when(won.isNotNull(), zip_of(path, pages, won["city"], won["state"]))), "_sure": corroborated(path, pages, won["city"]),
        "_street": F.coalesce("_labelled", F.trim(F.col("_any.value"))), "_page": F.when(F.col("_labelled").isNotNull(), F.col("_at.page")).otherwise(F.col("_any.page")),
    })
    street, none = F.col("_street"), F.lit(None).cast("string")
    value = lambda city, state, zip_: F.struct(street.alias("address"), city.alias("city"), state.alias("state"), zip_.alias("zip"))
    full = found_field(F.when(won.isNotNull(), value(won["city"], won["state"], F.col("_zip"))), kind, F.when(F.col("_zip").isNotNull() & F.col("_sure"), HIGH).otherwise(MEDIUM), VERBATIM, won["page"], won["snippet"], F.when(~F.col("_sure"), "city only in the body"))
    alone = found_field(F.when(street.isNotNull(), value(none, none, none)), kind, LOW, VERBATIM, F.col("_page"), street)
    return df.select(*keep, F.coalesce(full, alone, missing(kind, "not found")).alias("address"))
