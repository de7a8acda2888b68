"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by where they stand (in an article, in
a link, ...) and by the names of the elements that hold them (landmark tags, parts of class, id and
role names), tags score negative by name; the weights are log-odds of being content, counted on
labelled pages over prior counts. Words under a name of log-odds OFF or less score against the
content by that weight, in part (SHARE), so that an advert does not cut an article in two. One linear
scan finds the contiguous run with the greatest sum; its blocks are the text, without the words in it
whose names score against them. The word lists below are prior counts only: labels can outweigh them.

A labelled page is one whose address names a document: its blocks that occur in that document are
content. At most SAMPLE pages are used; without any, the priors alone decide.

Defined cases: null or empty html, and pages whose best run scores nothing, give an empty text;
of equal runs the first and shortest wins; unclosed tags end with their parent; a `<` that opens no
tag, and a tag that the page ends in, are text; a tag may hold any number of attributes; null ids and
addresses and repeated rows are kept, one result each. Only `page_id`, `url` and `html` are read.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages that training reads.
SAMPLE = 400
#: A tag's attributes. A quote counts after an equals sign only, so each tag is read in one go.
WITHIN = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b{WITHIN}(?<=/)>|"
    r"<(?P<raw>script|style|noscript|template|iframe|svg|object|textarea|select)\b"
    rf"{WITHIN}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"
    rf"<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<given>{WITHIN})(?:>|(?P<cut>\Z))", re.S | re.I)
#: An attribute's name and value.
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[a-z]+")
#: Elements inside a line of text; all others end the block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
             "q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
#: Elements whose names say nothing of what they hold.
GENERIC = INLINE | VOID | ARTICLE | set(
    "html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption center details summary".split())
#: Elements whose words are not the article's; a header may be the article's own.
ASIDE = set("nav footer aside form button dialog menu fieldset".split())
#: Parts of class, id and role names that mark such elements.
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
            "banner menu menubar nav navbar navigation sidebar side aside complementary footer "
            "header masthead contentinfo cookie cookies consent gdpr notice notices alert "
            "newsletter subscribe subscription signup login share sharing social related "
            "recommended breadcrumb breadcrumbs comment comments commentlist disqus respond "
            "replies reply discussion pagination pager popup modal overlay dialog search form "
            "widget toolbar tags copyright legal disclaimer skip outbrain taboola".split())
#: First parts of names that tell how a page is laid out, not what an element is.
LAYOUT = {"has", "no", "with", "without", "is", "not"}
#: Elements that no mark on what holds them switches off, see `nodes`.
SPARED = {"article", "main", "h1"}
#: Prior counts of words inside and outside the content, by place.
PRIOR = {"article": (20.0, 1.0), "plain": (5.0, 1.0), "link": (1.0, 2.0), "beside": (1.0, 4.0)}
#: Prior counts of words inside and outside under a listed name and under any other.
LISTED, OTHER = (0.5, 50.0), (10.0, 1.0)
MOST, TAG_MOST, TAG_LEAST = 4.0, -0.02, -0.5
#: Log-odds from which a name scores against its words, and the part of it that a word scores.
OFF, SHARE = -2.0, 1 / 256


@dataclass
class Node:
    """A stretch of text in one block (`text` set) or a tag."""

    kind: str
    block: int
    text: str | None = None
    words: int = 0
    tag: str = ""
    names: frozenset[str] = frozenset()
    against: float = 0.0         # least log-odds of the names, where they switch it off


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)}


def _parts(given: dict[str, str]) -> set[str]:
    """Parts of an element's class, id and role names, layout words left out."""
    return {part for k in ("class", "id", "role") for token in given.get(k, "").lower().split()
            if (parts := PART.findall(token)) and parts[0] not in LAYOUT for part in parts}


def _against(weights: dict[str, float], names: set[str], inside: bool) -> float:
    """Least log-odds of the names if it is OFF or less, else 0; inside an article only listed ones
    count, since labels tell a headline or byline from a document's text, not from the article's."""
    least = min((weights.get("@" + n, 0.0) for n in names
                 if not inside or n in MARKS or n in ASIDE), default=0.0)
    return least if least <= OFF else 0.0


def nodes(page: str | None, weights: dict[str, float]) -> list[Node]:
    """Text and tags in page order; words after `article` elements' rules get their place.

    A mark says nothing of an element that holds an article, a first headline or most of the
    page's words outside menus and the like, nor does a form that holds an article or, with
    paragraphs, most of the words: pages are read once more where one holds these.
    """
    held: dict[int, tuple[int, bool, bool]] = {}
    out = _read(page, weights, set(), held)
    if not held:
        return out
    total = sum(n.words for n in _read(page, weights, set(held), {}) if n.kind != "off")
    spared = {at for at, (words, keeps, may) in held.items() if keeps or may and 2 * words > total}
    return _read(page, weights, spared, {}) if spared else out


def _read(page: str | None, weights: dict[str, float], spared: set[int],
          held: dict[int, tuple[int, bool, bool]]) -> list[Node]:
    """The nodes, but for the names of the tags that start at `spared`. Into `held` goes, for each
    other tag that its names switch off, the number of words in it, whether it holds what spares it
    and whether many words may."""
    page, out, block, at = page or "", [], 0, 0
    open_: list[tuple[str, float, bool, bool, frozenset]] = []  # name, and what held outside it
    begun: list[tuple[int, int, bool] | None] = []        # of marked: place in page, in out, a form?
    off, article, link, names = 0.0, False, False, frozenset()

    def marks(m: re.Match, inside: bool) -> tuple[set[str], float, float]:
        """Names of a tag, their log-odds against its words, and the part that is never spared."""
        name, given = m["name"].lower(), _attributes(m["given"]) if m["given"] else {}
        own = set() if name in GENERIC or name == "header" and inside else {name}
        if name in ("html", "body", "main"):
            return own, 0.0, 0.0
        firm = own - {"form"}
        # never shown, whatever the labels say
        if (name in ("head", "title") or "hidden" in given or UNSEEN.search(given.get("style", ""))
                or given.get("aria-hidden", "").lower() == "true"):
            return own, -MOST, -MOST
        own |= _parts(given)
        # labels speak of the elements beside an article, not of articles
        known = inside or name in ARTICLE
        return own, _against(weights, own, known), _against(weights, firm, known and name != "header")

    has_article = any(m.start() in spared or not marks(m, False)[1] for m in TOKEN.finditer(page)
                      if m["name"] and not m["end"] and m["name"].lower() in ARTICLE)

    def text(raw: str) -> None:
        plain = markup.unescape(raw)
        if plain:
            kind = ("off" if off else "article" if article else "link" if link
                    else "beside" if has_article else "plain")
            out.append(Node(kind, block, plain, len(plain.split()), names=names, against=off))

    def done(k: int) -> None:
        for mark in filter(None, begun[k:]):
            inner = out[mark[1]:]
            tags = {n.tag for n in inner}
            form = mark[2]
            held[mark[0]] = (sum(n.words for n in inner),
                             not tags.isdisjoint(ARTICLE if form else SPARED), not form or "p" in tags)
        del open_[k:], begun[k:]

    def close(ended: set[str], limit: set[str]) -> None:
        nonlocal off, article, link, names
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in ended:
                off, article, link, names = open_[k][1:]
                done(k)
                return
            if open_[k][0] in limit:
                return

    for m in TOKEN.finditer(page):
        if m["cut"] is not None:                          # the page ends in it
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        if m["name"] is None:                             # comment, script, declaration
            if m["raw"]:
                block += 1
            continue
        name = m["name"].lower()
        if open_ and open_[-1][0] == "title" and name != "title":
            close({"title"}, set())                       # a title holds no tags
        if name not in INLINE:
            block += 1
        out.append(Node("off" if off else name, block, tag="" if m["end"] else name, names=names))
        if name == "br":
            out.append(Node("off" if off else "article", block, " "))
        if m["end"]:
            close({name}, set())
        elif name not in VOID:
            if name not in INLINE:
                close({"p"}, {"div", "article", "section", "td", "li", "blockquote"})
            if name == "li":
                close({"li"}, {"ul", "ol"})
            open_.append((name, off, article, link, names))
            own, all_, firm = marks(m, article)
            loose = all_ and not firm and m.start() not in spared
            begun.append((m.start(), len(out), name == "form") if loose else None)
            off = min(off, all_ if loose else firm)
            article = article or name in ARTICLE
            link = link or name == "a"
            names = names | own
    text(page[at:])
    done(0)
    return out


def blocks(found: list[Node]) -> list[tuple[int, str]]:
    """Number and text of each block, white space single, blocks without text left out."""
    parts: dict[int, list[str]] = {}
    for n in found:
        if n.text is not None and n.kind != "off":
            parts.setdefault(n.block, []).append(n.text)
    joined = ((b, " ".join("".join(p).split())) for b, p in parts.items())
    return [(b, t) for b, t in joined if t]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest positive sum; (0, 0) if there is none."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(weights: dict[str, float], page: str | None) -> str:
    found = nodes(page, weights)
    a, b = best_run([SHARE * n.against * n.words if n.kind == "off" else weights[n.kind] * n.words
                     if n.text is not None else weights.get("<" + n.kind, TAG_MOST)
                     for n in found])
    return "\n".join(t for _, t in blocks(found[a:b]))


def counts(page: str | None, document: str | None) -> Counter:
    """(kind, names over it, in the labelled region?, in a block of the document?) of the words and
    tags of a labelled page; no name switches anything off here."""
    found = nodes(page, {})
    known = " ".join((document or "").split())
    lines = {" ".join(x.split()) for x in (document or "").split("\n")}
    whole: dict[int, list[str]] = {}
    for n in found:
        if n.text is not None and n.kind != "off":
            whole.setdefault(n.block, []).append(n.text)
    content = {b for b, p in whole.items() if (t := " ".join("".join(p).split())) and (
        t in lines or t.count(" ") > 2 and t in known)}
    # shared phrases match outside the article too: the labelled region is the best run of matches
    a, b = best_run([n.words * (0.0 if n.kind == "off" else 1.0 if n.block in content else -1.0)
                     for n in found])
    out: Counter = Counter()
    for i, n in enumerate(found) if b else ():
        if n.kind != "off" and (n.text is None or n.words):
            inside = a <= i < b
            out[n.kind if n.text is not None else "<" + n.kind, " ".join(sorted(n.names)), inside,
                inside and n.block in content] += n.words or 1
    return out


def fit(pages: DataFrame, documents: DataFrame, limit: int = SAMPLE) -> dict[str, float]:
    """Weights from pages whose address ends in the number of a document."""
    number = F.regexp_extract("url", r"/(\d+)(?:\.\w+)?/?(?:[?#].*)?$", 1)
    named = pages.select("page_id", "html", number.try_cast("long").alias("doc_id"))
    chosen = named.where(F.col("doc_id").isNotNull()).select("page_id", "doc_id").orderBy(
        F.xxhash64("page_id"), "page_id", "doc_id").limit(limit)
    html = named.select("page_id", "html").join(F.broadcast(chosen), "page_id")
    both = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()),
                                                   "doc_id").join(html, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            total: Counter = Counter()
            for page, text in zip(frame["html"], frame["text"]):
                total.update(counts(page, text))
            yield pd.DataFrame([(*k, n) for k, n in total.items()],
                               columns=["kind", "names", "inside", "known", "n"])

    key = ["kind", "names", "inside", "known"]
    seen = both.mapInPandas(run, "kind string, names string, inside boolean, known boolean, n long"
                            ).groupBy(*key).agg(F.sum("n").alias("n")).collect()
    return weights_of({tuple(r[k] for k in key): r["n"] for r in seen})


def weights_of(seen: dict[tuple[str, str, bool, bool], int]) -> dict[str, float]:
    """Bounded log-odds over the prior counts; tags score from TAG_LEAST to TAG_MOST. Names come
    first; what they switch off does not count for the places and tags."""
    listed = {"@" + n for n in MARKS | ASIDE}
    names: Counter = Counter()
    for (kind, over, _, known), n in seen.items():
        if kind[0] != "<":
            for name in over.split():
                names["@" + name, known] += n
    out = {k: _odds(names, k, LISTED if k in listed else OTHER) for k in listed | {k for k, _ in names}}
    places: Counter = Counter()
    for (kind, over, inside, _), n in seen.items():
        if not _against(out, set(over.split()), kind == "article"):
            places[kind, inside] += n
    for kind in set(PRIOR) | {k for k, _ in places}:
        odds = _odds(places, kind, PRIOR.get(kind, (1.0, 1.0)))
        out[kind] = max(TAG_LEAST, min(TAG_MOST, odds)) if kind[0] == "<" else odds
    return out


def _odds(seen: Counter, key: str, prior: tuple[float, float]) -> float:
    odds = math.log((seen[key, True] + prior[0]) / (seen[key, False] + prior[1]))
    return max(-MOST, min(MOST, odds))


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            text = [main_text(weights, h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long")
