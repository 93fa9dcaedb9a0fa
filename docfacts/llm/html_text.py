"""HTML extraction: maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive, by the kind of
element that holds them, and tags negative, by name; one linear scan finds the
contiguous region with the greatest sum. The weights are learnt from pages that
label their content themselves, by exactly one ``article`` (or else ``main``)
element: passive-aggressive updates until the scan's region is that element's
inside, also when the words outside it count threefold.

Within the region, elements that are never content (scripts, forms, menus,
adverts, notices, comments, ...) are skipped; the rest becomes blocks of text.
Any element can say so by a word of its class, id or role, by the last part of a
word in dashes (unless a "no" or "has" goes before), or by its whole label;
words that labelled pages use outside their content only are learnt besides. An
element that says it with one word among others is kept if its inside outweighs
a toll by the learnt weights. None is skipped that holds the page's one
``article`` (or else ``main``) element, or, on pages without, most of the page's
words. A header within an article is content.

Defined cases: null or empty html gives an empty text; a page without words
gives an empty text; repeated rows give equal texts; without labelled pages the
start weights (word 1, tag -1) hold; unclosed elements, broken tags and
comments end with the page; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import tidy
from docfacts.llm.packing import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<closed>svg)(?=[\s/])[^>]*/>"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|svg|title|object)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<[a-z][^<>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HINT = re.compile(r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|side-?bar|foot(?:er)?|cookies?|consent|notices?|alert|popup|modal|comments?|repl(?:y|ies)|disqus|share|social|related|recommend\w*|breadcrumbs?|subscribe|newsletter|login|search|pager|pagination|toolbar|complementary|navigation|contentinfo|dialog)", re.I)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside div footer form header main nav section table ul ol dl figure body head button select details dialog label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where a block (or another of their kind) begins.
SOFT = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
#: Before the last part of a word in dashes: it tells of the page, not of the element.
OTHERWISE = frozenset("no not non has have with without is in".split())
#: What the inside of an element with a mixed class has to score.
TOLL = 20.0
NEVER = frozenset("nav footer aside form header button select dialog menu head".split())


@dataclass
class Weights:
    tag: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    outside: frozenset[str] = frozenset()  # words of classes that labelled pages use outside their content only

    def of_tag(self, key: str) -> float:
        return self.tag.get(key, -1.0)

    def of_word(self, key: str) -> float:
        return self.word.get(key, 1.0)


@dataclass
class Unit:
    """A tag (words 0) or a run of text."""

    key: str
    words: int
    text: str
    breaks: bool
    skipped: bool


def names_of(rest: str) -> list[str]:
    """The words of an element's class, id and role."""
    return [w.lower() for m in ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id", "role") for w in (m[2] or m[3] or m[4] or "").split()]


def hinted_word(word: str, outside: frozenset[str]) -> bool:
    if word in outside or HINT.fullmatch(word):
        return True
    *before, last = re.split("[-_]+", word)
    return bool(before) and before[-1] not in OTHERWISE and bool(HINT.fullmatch(last))


def hints(rest: str, outside: frozenset[str] = frozenset()) -> float:
    """The share of an element's words that name what is never content; its label, as a whole, counts for all of them."""
    if any(m[1].lower() == "aria-label" and HINT.fullmatch((m[2] or m[3] or m[4] or "").strip()) for m in ATTRIBUTE.finditer(rest)):
        return 1.0
    words = names_of(rest)
    return sum(hinted_word(w, outside) for w in words) / len(words) if words else 0.0


@dataclass
class Held:
    """What a hinted element holds, and the place of the hinted one around it (-1: none)."""

    around: int
    words: int = 0
    article: int = 0
    main: int = 0
    mixed: bool = False  # not all of its words are hints
    score: float = 0.0  # of its inside


def units(page: str, weights: Weights | None = None) -> list[Unit]:
    weights = weights or Weights()
    out, held = parse(page, frozenset(), weights)
    opens = [u.key for u in out]
    one = next((name for name in ("article", "main") if opens.count(f"<{name}") == 1), None)
    total = sum(u.words for u in out)
    spared = frozenset(i for i, h in enumerate(held) if (getattr(h, one) if one else 2 * h.words > total) or (h.mixed and h.score > TOLL))
    return parse(page, spared, weights)[0] if spared else out


def parse(page: str, spared: frozenset[int], weights: Weights = Weights()) -> tuple[list[Unit], list[Held]]:
    """The units, and what each hinted element holds; the hints of those ``spared`` do not count."""
    out: list[Unit] = []
    held: list[Held] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, key, whether it or one above is never content, the innermost hinted one
    opened: dict[str, int] = {}  # how many of each name are on the stack, so that a foreign end tag searches nothing
    at = 0

    def words(text: str) -> None:
        if n := len(text.split()):
            top = stack[-1] if stack else ("", "", False, -1)
            out.append(Unit(top[1], n, text, False, top[2]))
            if top[3] >= 0:
                held[top[3]].words += n
                held[top[3]].score += n * weights.of_word(top[1].rstrip("~"))
        elif text:
            out.append(Unit("", 0, " ", False, False))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            out.append(Unit("<" + (m["raw"] or m["closed"] or "!").lower(), 0, "", False, False))
            continue
        while not m["end"] and stack and stack[-1][0] in SOFT and (name in BLOCKS or name == stack[-1][0]) and not (stack[-1][0] in ("li", "td", "th", "dd") and name not in SOFT - {"p"}) and not (stack[-1][0] == "tr" and name != "tr"):
            opened[stack.pop()[0]] -= 1  # of the others only hinted ones are on the stack
        share = hints(m["rest"], weights.outside) if not m["end"] and m["rest"] and name not in VOID and name not in ("body", "html", "article", "main") else 0.0
        if stack and stack[-1][3] >= 0:
            held[stack[-1][3]].score += weights.of_tag(f"<{m['end']}{name}")
        if name not in HOLDERS and not share and not (m["end"] and opened.get(name)):
            out.append(Unit(f"<{m['end']}{name}", 0, "", name in BLOCKS, False))
            continue
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened.get(name) else None
            key = stack[depth][1] if depth is not None else name
            if depth is not None:
                for gone in stack[depth:]:
                    opened[gone[0]] -= 1
                del stack[depth:]
            out.append(Unit(f"</{key}", 0, "", name in BLOCKS, False))
        else:
            within = stack[-1][3] if stack else -1
            key = name
            if name in ("article", "main"):
                if within >= 0:
                    setattr(held[within], name, 1)
            elif share:
                if len(held) not in spared:
                    key = f"{name}~"
                held.append(Held(within, mixed=share < 1))
                within = len(held) - 1
            never = key.endswith("~") or (name in NEVER and not (name == "header" and (opened.get("article") or opened.get("main"))))
            out.append(Unit(f"<{key}", 0, "", name in BLOCKS, False))
            if not m["rest"].endswith("/"):
                stack.append((name, key, never or bool(stack and stack[-1][2]), within))
                opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        words(page[at:])
    for h in reversed(held):
        if h.around >= 0:
            up = held[h.around]
            up.words, up.article, up.main, up.score = up.words + h.words, up.article + h.article, up.main + h.main, up.score + h.score
    return out, held


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest positive sum, the first and longest of equals; (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and start == where[0] and best > 0):
            best, where = total, (start, i + 1)
    return where


def score_units(seq: list[Unit], weights: Weights) -> list[float]:
    return [u.words * weights.of_word(u.key) if u.words else (weights.of_tag(u.key) if u.key else 0.0) for u in seq]


def labelled_region(seq: list[Unit]) -> tuple[int, int] | None:
    for name in ("article", "main"):
        opens = [i for i, u in enumerate(seq) if u.key == f"<{name}"]
        if len(opens) == 1:
            end = next((i for i in range(opens[0] + 1, len(seq)) if seq[i].key == f"</{name}"), len(seq))
            inside = [i for i in range(opens[0] + 1, end) if seq[i].words]
            return (inside[0], inside[-1] + 1) if inside else None
    return None


def outside_only(pages: list[str], least: int = 5) -> frozenset[str]:
    """The words of classes that are on ``least`` labelled pages at least, on each outside its one ``article`` (or else ``main``) element and not around it."""
    outside: dict[str, int] = {}
    other: set[str] = set()
    for page in pages:
        opens = {name: [m for m in TOKEN.finditer(page) if (m["name"] or "").lower() == name and not m["end"]] for name in ("article", "main")}
        one = next((name for name in ("article", "main") if len(opens[name]) == 1), None)
        if one is None:
            continue
        begin = opens[one][0].start()
        end = page.lower().find(f"</{one}", begin)
        end = len(page) if end < 0 else end
        here: set[str] = set()
        depth: list[tuple[str, list[str], int]] = []
        for m in TOKEN.finditer(page):
            name = (m["name"] or "").lower()
            if not name or name in VOID:
                continue
            if m["end"]:
                at = next((i for i in range(len(depth) - 1, max(-1, len(depth) - 50), -1) if depth[i][0] == name), None)
                if at is not None:
                    for _, words, start in depth[at:]:
                        around = start < begin < m.start() or begin <= start < end
                        (other if around else here).update(words)
                    del depth[at:]
            else:
                depth.append((name, names_of(m["rest"] or ""), m.start()))
        for _, words, _ in depth:  # never closed
            other.update(words)
        for w in here:
            outside[w] = outside.get(w, 0) + 1
    return frozenset(w for w, n in outside.items() if n >= least and w not in other)


def learn(pages: list[str], rounds: int = 12) -> Weights:
    weights = Weights(outside=outside_only(pages))
    known = [(seq, gold) for page in pages if (gold := labelled_region(seq := units(page, weights)))]
    for _ in range(rounds):
        wrong = 0
        for seq, (a, b) in known:
            plain = score_units(seq, weights)
            tried = [s * (3 if u.words and not a <= i < b else 1) for i, (s, u) in enumerate(zip(plain, seq, strict=True))]
            c, d = best_region(tried)
            inside = lambda i, j: {k for k in range(i, j) if seq[k].words}
            if inside(a, b) == inside(c, d):
                continue
            wrong += 1
            change: dict[tuple[bool, str], float] = {}
            for i, u in enumerate(seq):
                if u.key and (a <= i < b) != (c <= i < d):
                    change[bool(u.words), u.key] = change.get((bool(u.words), u.key), 0.0) + (1 if a <= i < b else -1) * (u.words or 1)
            loss = sum(tried[c:d]) - sum(plain[a:b]) + 1
            rate = loss / max(1.0, sum(v * v for v in change.values()))
            for (is_word, key), v in change.items():
                if is_word:
                    weights.word[key] = max(0.01, weights.of_word(key) + rate * v)
                else:
                    weights.tag[key] = min(-0.01, weights.of_tag(key) + rate * v)
        if not wrong:
            break
    return weights


def main_text(page: str, weights: Weights) -> str:
    seq = units(page, weights)
    a, b = best_region(score_units(seq, weights))
    blocks, held = [], []
    for u in [*seq[a:b], Unit("", 0, "", True, False)]:
        if u.breaks:
            if text := " ".join(entities.unescape("".join(held)).split()):
                blocks.append(text)
            held = []
        elif u.text and not u.skipped:
            held.append(u.text)
    return "\n".join(blocks)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = 300) -> Weights:
    """Weights from at most ``most_pages`` pages: those with the smallest hashes of their ids.

    A first cut by hash, at twice the share needed, keeps what tasks send to the driver from growing with their number.
    """
    n = pages.count()
    part = 1 << 30
    share = min(part, -(-2 * most_pages * part // max(n, 1)))
    low = F.pmod(F.xxhash64(F.col(id_col)), F.lit(part))
    rows = pages.where(low < share).select(F.col(html_col).alias("html"), low.alias("h")).where(F.length("html") > 0).orderBy("h", "html").limit(most_pages).collect()
    return learn([r["html"] for r in rows])


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    weights = weights or train(pages, id_col, html_col)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                rows = batch.slice(i, j - i)
                texts = [main_text(h, weights) for h in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
