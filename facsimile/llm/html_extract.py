"""Main text of web pages: the best-scoring contiguous run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import free_name
from facsimile.llm.common import arrow_limits

# Elements whose text is never article text.
DROPPED = frozenset("""head title script style noscript template iframe svg canvas object audio video map math nav header
footer aside form button select option textarea dialog menu""".split())
# Elements whose content is not markup, up to their end tag.
RAW = frozenset("script style noscript template iframe svg textarea title".split())
# Words in a class, id or role that mark page furniture.
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
complementary contentinfo consent cookie cookies copyright disclaimer discussion feedback footer footnav form gdpr header login
masthead menu menubar modal nav navbar navigation navigationlist newsletter notice notices notification overlay pager pagination paywall popup promo
promoted promotion recommended related replies reply respond search share sharing sidebar sidemenu signup skip social sponsor
sponsored subscribe subscription tags toolbar toc widget widgets alert dialog""".split())
# Words that say nothing of their own beside a furniture word ("ad-slot", "comment-list").
GENERIC = frozenset("""area articles bar block bottom box btn button buttons col column container footer form frame group header heading
icon icons inner item items left link links list outer panel placeholder posts right row section slot stories sub text title top unit
wrap wrapper zone""".split())
# Furniture words that also name readers' comments, and those that also name subjects of an article's sections.
COMMENT = frozenset("comment comments reply replies respond".split())
SUBJECT = frozenset("alert copyright disclaimer discussion feedback search social tags toc".split())
EXEMPT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span
strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())

#: Text after a tag of these is a link or an item; it may count against a region.
LISTED = frozenset("a button dd dt label li option span td th".split())
BARE = frozenset("div section span".split())
CACHED = 256    # length of the tags whose facts are remembered

_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PART = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _TagEnds:
    """Where a tag that begins before a place ends: its first > outside quotes, for all places in one pass from the right."""

    def __init__(self, page: str):
        found = [(m.start(), m[0]) for m in _SPECIAL.finditer(page)]
        self.place = [at for at, _ in found]
        self.end = [-1] * (len(found) + 1)
        following = {">": -1, '"': -1, "'": -1}     # the next of each kind, by number
        for k in range(len(found) - 1, -1, -1):
            at, c = found[k]
            if c == ">":
                self.end[k] = at
            elif following[c] >= 0:
                self.end[k] = self.end[following[c] + 1]
            if self.end[k] < 0 and following[">"] >= 0:     # a quote that never closes is none
                self.end[k] = found[following[">"]][0]
            following[c] = k

    def after(self, at: int) -> int:
        return self.end[bisect_left(self.place, at)]


def scan(page: str) -> list[tuple[str, str]]:
    """("tag", markup) and ("text", characters) of a page without comments, declarations and raw elements.

    One pass: every place of the page is looked at a fixed number of times, however
    broken its tags are.  What does not end is text, but for a comment or raw element.
    """
    out: list[tuple[str, str]] = []
    low, ends, at, size = page.lower(), _TagEnds(page), 0, len(page)
    if len(low) != size:        # a letter whose lower case is longer
        low = re.sub("[A-Z]", lambda m: m[0].lower(), page)
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            out.append(("text", page[at:lt] if lt >= 0 else page[at:]))
            if lt < 0:
                break
        kind = low[lt + 1:lt + 2]
        named = low[lt + 2:lt + 3] if kind == "/" else kind
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        end = page.find(">", lt) if kind in ("!", "?") and kind and ends.after(lt) >= 0 else ends.after(lt) if "a" <= named <= "z" else -1
        if end < 0:
            out.append(("text", "<"))
            at = lt + 1
            continue
        at = end + 1
        if kind in ("!", "?"):
            continue
        tag = page[lt:at]
        name = _NAME.match(tag)[1].lower()
        if name in RAW and kind != "/":
            if not tag.endswith("/>"):
                close = low.find(f"</{name}", at)
                end = ends.after(close) if close >= 0 else -1
                at = end + 1 if end >= 0 else size
            continue
        out.append(("tag", tag))
    return out


def _facts(tag: str) -> tuple[str, bool, int, str]:
    name = _NAME.match(tag)[1].lower()
    opens = not tag.startswith("</")
    found, first = 0, ""
    if opens:
        found = 2 * (name in DROPPED)
        for kind, value in _ATTRIBUTE.findall(tag[len(name) + 1:]):
            kind, value, hidden = kind.lower(), value.strip("\"'"), 0
            if kind == "style":
                hidden = 2 * ("display:none" in value.replace(" ", "").lower())
            elif kind == "hidden":
                hidden = 2
            elif kind == "aria-hidden":
                hidden = 2 * (value.lower() == "true")
            elif kind in ("class", "id", "role"):
                for part in value.split():
                    parts = [w.lower() for w in _PART.findall(_CAMEL.sub(" ", part))]
                    first = first or (parts[0] if kind == "class" and parts else "")
                    if not FURNITURE.isdisjoint(parts):
                        whole = all(w in FURNITURE or w in GENERIC for w in parts)
                        own = FURNITURE.intersection(parts)
                        hidden = max(hidden, 1 if not whole else 4 if own <= COMMENT else 3 if own <= SUBJECT else 2)
            found = max(found, hidden if name not in EXEMPT else 0)
    return name, opens, found, f"{name}.{first}" if first else name if opens else "/" + name


_remembered = lru_cache(maxsize=4096)(_facts)


def tag_facts(tag: str) -> tuple[str, bool, int, str]:
    """(name, opens, furniture, key) of a tag; the key is its name, direction and first class word.

    Furniture is 1 if a furniture word is only a part of a name in its class, id or role
    ("has-sidebar", "related-work"); 2 if the tag's name or such a whole name says so
    ("sidebar", "ad-slot"), 3 if that name may also be the subject of a section
    ("feedback"), and 4 if it names readers' comments.
    """
    return _remembered(tag) if len(tag) <= CACHED else _facts(tag)


def tokens(page: str) -> list[tuple[str, str]]:
    """Tags and text of a page without furniture elements.

    A furniture element goes with all it holds; one that is never closed loses its tag
    alone (one that ends itself, such as a paragraph, ends at the next block tag).  An
    article or main element that is no reader's comment is the page's content: an element
    that holds one stays, and so does, on a page without any, one with most of the words
    that are not comments.  Inside of it headers and names that may be subjects stay.  What stays
    costs more where a name on the lists says so, and the scan decides.
    """
    found = scan(page)
    facts = [tag_facts(s) if kind == "tag" else None for kind, s in found]
    close: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for i, (_, s) in enumerate(found):
        if facts[i]:
            name, opens, _, _ = facts[i]
            if name in VOID or s.endswith("/>"):
                continue
            if opens:
                if name in ENDS_ITSELF and stacks.get(name) and name == "p":
                    close[stacks[name].pop()] = i - 1
                stacks.setdefault(name, []).append(i)
            elif stacks.get(name):
                close[stacks[name].pop()] = i
    comment = [False] * (len(found) + 1)      # inside readers' comments
    until = -1
    for i, f in enumerate(facts):
        if f and f[2] == 4 and i > until:
            until = close.get(i, i)
        comment[i] = i <= until
    core = [bool(f and f[1] and f[0] in MAIN and not comment[i] and f[2] < 2) for i, f in enumerate(facts)]
    mains, articles, words = ([0, *accumulate(x)] for x in (
        (c and f[0] == "main" for c, f in zip(core, facts)), (c and f[0] == "article" for c, f in zip(core, facts)),
        (0 if f or comment[i] else len(s.split()) for i, ((_, s), f) in enumerate(zip(found, facts)))))

    def stays(lo: int, hi: int) -> bool:
        if mains[-1] or articles[-1]:
            return mains[hi] > mains[lo] or 0 < articles[-1] == articles[hi] - articles[lo]
        return 2 * (words[hi] - words[lo]) > words[-1]

    out, skip, inside = [], -1, -1
    for i, t in enumerate(found):
        if i <= skip:
            continue
        if core[i]:
            inside = max(inside, close.get(i, i))
        if facts[i] and facts[i][2] >= 2:
            end = close.get(i, i)
            within = i <= inside and (facts[i][2] == 3 or facts[i][0] == "header" and facts[i][2] == 2)
            if not within and not stays(i, end + 1):
                skip = end
                out.append(("tag", "</cut>"))
                continue
        out.append(t)
    return out


@dataclass(frozen=True)
class ExtractModel:
    """Score of a word by the tag before it, and cost of a tag by key, by name, or else by its kind."""

    word: float = 1.0
    words: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)
    block: float = 0.4
    inline: float = 0.05
    holder: float = 2.0
    cut: float = 0.01
    marked: float = 5.0     # more for a tag with a furniture word, outside article and main, whose element was not cut

    def of(self, key: str) -> float:
        if key == "/cut":
            return self.cut
        name = key.lstrip("/").split(".")[0]
        plain = f"/{name}" if key[0] == "/" else name
        known = self.cost.get(key, self.cost.get(plain))
        if known is not None:
            return known
        if name in INLINE or name in VOID:
            return self.inline
        return self.block if name in ENDS_ITSELF or re.fullmatch("h[1-6]|blockquote|pre|ul|ol|dl|figure|figcaption", name) else self.holder

    def scores(self, found: list[tuple[str, str]]) -> list[float]:
        """Score of every token."""
        out, inside, before = [], 0, ""
        for kind, s in found:
            if kind == "text":
                out.append(self.words.get(before, self.word) * len(s.split()))
            elif s == "</cut>":
                out.append(-self.cut)
                before = ""
            else:
                name, opens, furniture, key = tag_facts(s)
                if name in MAIN:
                    inside = max(0, inside + (1 if opens else -1))
                cost = self.inline if inside and name == "header" else self.of(key)     # of the article, not the page
                out.append(-cost - (self.marked if furniture and not inside else 0.0))
                before = name if opens else "/" + name
        return out


def best_region(items: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the first and longest of equal ones; empty if none is positive."""
    best, lo, hi, at, run = 0.0, 0, 0, 0, 0.0
    for i, x in enumerate(items):
        if run < 0:
            run, at = 0.0, i
        run += x
        if run > best or run == best and best > 0 and at == lo:
            best, lo, hi = run, at, i + 1
    return lo, hi


def joined(found: list[tuple[str, str]]) -> str:
    """Text of tokens: references decoded, blocks and line breaks as one space, inline tags as nothing."""
    parts = []
    for kind, s in found:
        if kind == "text":
            parts.append(entities.unescape(s))
        elif (name := tag_facts(s)[0] if s != "</cut>" else "cut") not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def main_text(page: str | None, model: ExtractModel) -> str:
    """The article's text of a whole page; empty for a null or empty page."""
    if not page:
        return ""
    found = tokens(page)
    lo, hi = best_region(model.scores(found))
    return joined(found[lo:hi])


def labelled_tokens(page: str) -> list[tuple[str, str, bool]] | None:
    """All tokens with whether they are inside the page's one article or main element; None if there isn't just one.

    Furniture inside the element is outside the content.
    """
    found = scan(page)
    facts = [tag_facts(s) if kind == "tag" else None for kind, s in found]
    for want in ("article", "main"):
        opened = [i for i, f in enumerate(facts) if f and f[:2] == (want, True) and f[2] < 2]
        closed = [i for i, f in enumerate(facts) if f and f[:2] == (want, False)]
        if len(opened) == 1 and len(closed) == 1 and opened[0] < closed[0]:
            depth: dict[str, int] = {}
            out, until = [], ""
            for i, ((k, s), f) in enumerate(zip(found, facts)):
                if f and not until and f[2] in (2, 4) and f[0] != "header" and not s.endswith("/>"):
                    until, depth = f[0], {f[0]: 0}
                out.append((k, s, not until and opened[0] < i < closed[0]))
                if f and until == f[0]:
                    depth[until] += 1 if f[1] else -1
                    if depth[until] <= 0:
                        until = ""
            return out
    return None


def fit(pages: DataFrame, html_col: str = "html", keys: int = 512, smooth: float = 2.0, strength: float = 60.0) -> ExtractModel:
    """Costs of tags and scores of words from the pages that label their own content with one article or main element.

    All such pages count how often each tag stands inside the content; a tag's cost is
    ``strength`` times how much more of its uses are outside or on the limit than inside
    (smoothed), and never 0.  They also count the words after each tag inside and outside; half the
    log-odds, within -1 and 1, are the score of such a word, but only words of links and
    items score below a quarter: any other tag may hold an article's text on another page.
    A container that bears no name says nothing on other pages and keeps its kind's cost.
    The ``keys`` most frequent tags are kept.  Without labelled pages the
    costs of a tag's kind hold and every word scores 1.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    src = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null")
    schema = pa.schema([("key", pa.string()), ("inside", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, list[int]] = {}
            for page in b.column(0).to_pylist():
                before = ""
                for kind, s, inside in labelled_tokens(page) or ():
                    if kind == "tag":
                        name, opens, _, key = tag_facts(s)
                        before, n = name if opens else "/" + name, 1
                    else:
                        key, n = f"word {before}", len(s.split())
                    c = got.setdefault(key, [0, 0])
                    c[0] += n * inside
                    c[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([c[0] for c in got.values()], pa.int64()),
                                              pa.array([c[1] for c in got.values()], pa.int64())], schema=schema)

    counted = src.mapInArrow(run, "key string, inside long, n long").groupBy("key").agg(
        F.sum("inside").alias("inside"), F.sum("n").alias("n"))
    base = ExtractModel()
    cost, word = {}, {}
    of_words = F.col("key").startswith("word ")
    for r in counted.where(~of_words).orderBy(F.desc("n"), "key").limit(keys).collect():
        if r["key"].lstrip("/") in BARE:
            continue
        prior = min(1.0, base.of(r["key"]) / 10)
        outside = (r["n"] - r["inside"] + smooth * prior) / (r["n"] + smooth)
        name = r["key"].lstrip("/").split(".")[0]
        most = 1.0 if name not in LISTED and (name in INLINE or re.fullmatch("p|br|h[1-6]", name)) else strength
        cost[r["key"]] = max(0.01, min(most, strength * (2 * outside - 1)))
    for r in counted.where(of_words).orderBy(F.desc("n"), "key").limit(keys).collect():
        before = r["key"][5:]
        odds = math.log((r["inside"] + 4 * smooth) / (r["n"] - r["inside"] + smooth)) / 2
        if before in LISTED:
            word[before] = max(-1.0, min(1.0, odds))
        elif before and before[0] != "/" and before not in INLINE and not re.fullmatch("p|br|h[1-6]", before):
            word[before] = max(0.25, min(1.0, odds))
    return ExtractModel(words=word, cost=cost)


def extract(pages: DataFrame, model: ExtractModel, html_col: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` without the html, with the main text and its number of code points.

    Other columns pass through; one that has an output's name is replaced.  A null or
    empty page, or one without content, has an empty text.
    """
    spark = pages.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in pages.schema if f.name not in names and f.name != html_col]
    src = pages.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{html_col}`").cast("string").alias(free_name("html", pages.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p, shared.value) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                                             names=[*(f.name for f in rest), *names])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest),
                                          f"`{names[0]}` string, `{names[1]}` long"]))
