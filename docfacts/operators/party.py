"""Who a document is about and who offers it: tenant from file name, brand, label and title; firm from fingerprints.

Brand and firm tables are parameters: the user's own lists, small enough to be literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import _escaped, first, found_field, kv_lookup, let, missing, texts
from docfacts.operators.place import STATES, file_stem, state_codes
from docfacts.operators.verify import cand, reconcile, same_text
from docfacts.schemas import HIGH, INTERPRETED, KINDS, LOW, MEDIUM, VERBATIM

#: Words that a file name adds, heads that are no tenant, lines of a cover that are no title, and the labels.
FILE_WORDS = r"(?i)\b(om|offering|memorandum|package|lowres|low res|hires|final|draft|copy|brochure|flyer|for sale|nnn|investment)\b"
NO_TENANT = ["overview", "summary", "profile", "information", "trade name", "name", "of record", "highlights", "initial lease term", "tenant", "lease", "details", "abstract", "the tenant", "company", "credit"]
NO_TITLE = ["offering memorandum", "cap rate", "for sale", "exclusively", "net lease", "investment", "confidential", "represented by", "presented by", "listed by", "broker", "memorandum"]
TENANT_LABELS = ["Tenant Trade Name", "Tenant Name", "Trade Name", "Tenant of Record", "Tenant"]
RECONCILE_LABELS = ["Tenant Trade Name", "Tenant Name", "Tenant"]


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’", "''")


def brand_in(text: Column, brands: list[str]) -> Column:
    """The longest of the brands that the text names as a word, or null."""
    # each pattern is a literal: one that is read from a table of brands would be compiled anew for every text
    named = lambda t: [F.when(F.regexp_like(t, F.lit(f"(?i)(?<![A-Za-z]){_escaped(b)}(?![A-Za-z])")), F.lit(b)) for b in sorted(brands, key=len, reverse=True)]
    return let(straight_quotes(text), lambda t: F.coalesce(*named(t), F.lit(None).cast("string")))


def file_tenant(path: Column, brands: list[str]) -> Column:
    """The tenant with which a file's name begins, or null: a brand, else its first segment without the usual words."""
    trimmed = lambda c: F.regexp_replace(c, r"^[ \-_]+|[ \-_]+$", "")
    tokens = lambda head: F.filter(F.split(head, "-"), lambda t: (t != "") & ~F.regexp_like(t, F.lit("^" + FILE_WORDS.replace("(?i)", "(?i:") + ")")))
    names = F.array(*[F.lit(n) for n in STATES])

    def head_of(stem: Column) -> Column:
        head = trimmed(F.regexp_replace(F.trim(F.try_element_at(F.split(stem, r"\s+[-_]\s+"), F.lit(1))), FILE_WORDS, ""))
        return trimmed(F.regexp_replace(head, r"(?i)^om[-_ ]+", ""))

    def of_head(head: Column) -> Column:
        return F.when(head.contains("-") & ~head.contains(" "), F.coalesce(first(tokens(head)), head)).otherwise(head)

    def judged(head: Column) -> Column:
        bad = (F.length(head) < 3) | F.regexp_like(head, F.lit(r"^\d")) | F.array_contains(state_codes(), F.upper(head)) | F.array_contains(names, F.lower(head))
        return F.when(~bad, F.trim(head))

    return let(file_stem(path), lambda stem: F.coalesce(brand_in(F.replace(stem, F.lit("-"), F.lit(" ")), brands), let(let(head_of(stem), of_head), judged)))


def cover_title(spans: Column) -> Column:
    """The cover's line in the largest type that can be a name (struct text, page), the first of equals, or null."""
    other = lambda x: let(F.lower(F.trim(x["text"])), lambda low: F.exists(F.array(*[F.lit(r) for r in NO_TITLE]), lambda r: low.contains(r)))
    fits = lambda x: F.length(x["text"]).between(2, 49) & ~F.regexp_like(x["text"], F.lit(r"(?U)[$%]|^\d|^[\d\W]+$")) & ~other(x)
    kept = F.filter(spans, fits)
    top = F.array_max(F.transform(kept, lambda x: x["size"]))
    return first(F.transform(F.filter(kept, lambda x: x["size"] == top), lambda x: F.struct(F.trim(x["text"]).alias("text"), x["page"].alias("page"))))


def clean_tenant(value: Column) -> Column:
    """A labelled or titled tenant, or null where it is a head, a number or of the wrong length."""
    fits = lambda v: F.when(~F.lower(v).isin(NO_TENANT) & F.length(v).between(2, 49) & ~F.regexp_like(v, F.lit(r"(?iU)^(overview|summary|profile)( |$)| (overview|summary|profile)$|^[\d\W]+$")), v)
    return let(F.trim(F.regexp_replace(F.trim(value), "^:+|:+$", "")), fits)


def title_tenant(title: Column) -> Column:
    fits = lambda v: F.when(~F.regexp_like(v, F.lit(r"(?i)contents|healthcare|holdings")) & ~F.regexp_like(v, F.lit(r"^(?:[A-Za-z] ){3,}[A-Za-z]?$")), v)
    return let(clean_tenant(title["text"]), fits)


def _gathered(df: DataFrame, brands: list[str], labels: list[str]) -> DataFrame:
    df = df.withColumns({"_file": file_tenant(F.col("path"), brands), "_brand": brand_in(first(texts("pages")), brands), "_kv": kv_lookup("lines", labels), "_title": cover_title(F.col("cover_spans"))})
    return df.withColumns({"_kv_v": clean_tenant(F.col("_kv.value")), "_title_v": title_tenant(F.col("_title"))})


def extract_tenant(df: DataFrame, brands: list[str]) -> DataFrame:
    """``df`` (path, pages, lines, cover_spans) with the field ``tenant``: file name, brand on the cover, label, title."""
    keep, kind, none = [c for c in df.columns if c != "tenant"], KINDS["tenant"], F.lit(None)
    df = _gathered(df, brands, TENANT_LABELS)
    c = F.col
    return df.select(*keep, F.coalesce(
        found_field(c("_file"), kind, HIGH, VERBATIM, none, F.concat(F.lit("filename:"), c("_file")), "file name"),
        found_field(c("_brand"), kind, MEDIUM, INTERPRETED, F.lit(1), c("_brand"), "brand on the cover"),
        found_field(c("_kv_v"), kind, MEDIUM, VERBATIM, c("_kv.page"), c("_kv.line")),
        found_field(c("_title_v"), kind, LOW, VERBATIM, c("_title.page"), c("_title.text"), "title of the cover"),
        missing(kind, "not found")).alias("tenant"))


def verify_tenant(df: DataFrame, brands: list[str]) -> DataFrame:
    """The tenant reconciled from all its sources."""
    keep, c = [x for x in df.columns if x != "tenant"], F.col
    done = reconcile(_gathered(df, brands, RECONCILE_LABELS), tenant=("string", same_text, [
        cand("filename", c("_file"), F.lit(None), F.concat(F.lit("filename:"), c("_file"))), cand("brand-cover", c("_brand"), F.lit(1), c("_brand"), INTERPRETED),
        cand("tenant-label", c("_kv_v"), c("_kv.page"), c("_kv.line")), cand("cover-title", c("_title_v"), c("_title.page"), c("_title.text"))]))
    return done.select(*keep, "tenant")


def offering_firm(pages: Column, fingerprints: list[tuple[str, str]], domains: dict[str, str]) -> Column:
    """The firm whose sign stands on the first four pages, else that of a mail address, else whose sign stands anywhere."""
    low = lambda t: F.lower(t)
    head, every = low(F.array_join(F.slice(texts(pages), 1, 4), " ")), F.array_join(texts(pages), "\n")
    signs = F.array(*[F.struct(F.lit(s.lower()).alias("sign"), F.lit(f).alias("firm")) for s, f in fingerprints])
    of = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    mails = F.transform(F.regexp_extract_all(every, F.lit(r"@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})"), 1), lambda d: F.try_element_at(of, F.lower(d)))
    return F.coalesce(first(F.filter(signs, lambda s: head.contains(s["sign"])))["firm"], first(F.filter(mails, lambda m: m.isNotNull())), first(F.filter(signs, lambda s: low(every).contains(s["sign"])))["firm"])


def extract_firm(df: DataFrame, fingerprints: list[tuple[str, str]], domains: dict[str, str]) -> DataFrame:
    keep, kind = [c for c in df.columns if c != "offeringFirm"], KINDS["offeringFirm"]
    df = df.withColumn("_firm", offering_firm(F.col("pages"), fingerprints, domains))
    return df.select(*keep, F.coalesce(found_field(F.col("_firm"), kind, HIGH, INTERPRETED, F.lit(None), F.col("_firm")), missing(kind, "not found")).alias("offeringFirm"))
