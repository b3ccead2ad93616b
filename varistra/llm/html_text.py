"""Main text of web pages: the maximum-scoring run of words and tags, with weights from labelled pages.

A page is read as a row of words and tags. Each block's tag has a weight by its name and class (items of lists and tables by
the block around the list as well), each word one by the block that it stands in; both are log-odds counted on labelled
pages, where the label is the page's own single ``<article>`` element. Content blocks' words come out positive, tags that
never stand in an article strongly negative; tags within a line weigh nothing. One linear scan finds the run with the
largest sum. Blocks that are menus, headers, footers, forms, adverts, notices or comments by their tag, or by a whole name
among their classes, id or role, weigh nothing either: they neither end a run nor are they part of its text, like scripts and
styles. A name of several parts counts if all parts are such names or say where it stands; names of paragraphs, headings, cells and the
like never do. What is left is cut into blocks at block-level tags.

The labelled sample is bounded (``LABELLED`` pages with the smallest hashes); keys seen less than ``LEAST`` times there, and those that it
doesn't have, take the fixed weights.

Defined results. A null, empty or broken html gives what text it has, perhaps none (an empty string). A repeated row
gets the same text. A reference that names no character stays as it is. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 400
SPACE = " \t\n\x0b\x0c\r"
#: A comment, an element whose content is no text, a declaration, or a tag; RAW and MARKUP are tried where a ``<`` stands.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
MARKUP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that stand within a block, that never hold content, and words of classes and ids that say so.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav header footer aside form button select option input head title menu dialog".split())
BAD_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Parts of names that say where a block stands; list and table parts; elements that their names leave alone.
PLACES = frozenset("site page main top bottom left right middle global primary secondary list links link item items box bar block section area wrapper container inner outer content text".split())
PARTS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th dt dd address".split())
LEAST = 3
#: Weights of what the labelled pages don't show.
GOOD_TAG, GOOD_WORD, LIMIT = -0.1, 1.0, 8.0


def bad_name(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    return name in BAD_NAMES or (not BAD_NAMES.isdisjoint(parts) and all(x in BAD_NAMES or x in PLACES for x in parts))


def bad(tag: str, names: list[str]) -> bool:
    return tag in NEVER or (tag not in TEXTS and bool(names))


def pieces(page: str):
    """Text nodes (text,) and tags (whether it closes, name in lower case, attributes) of a page, in time that follows its length.

    A quote that is never closed would make every later tag read on to the page's end, so from the first tag that finds no
    end outside quotes on, tags end at the next ``>`` whatever the quotes; after the last ``>`` all is text."""
    at, last, tag = 0, page.rfind(">"), MARKUP
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            m = page.find("<!--", at)  # a comment may run to the end without a >
            yield (page[at:m] if m >= 0 else page[at:],)
            return
        if begin > at:
            yield (page[at:begin],)
        if m := RAW.match(page, begin):
            at = m.end()
            continue
        m = tag.match(page, begin)
        if m is None and tag is MARKUP and (m := LOOSE.match(page, begin)):
            tag = LOOSE
        if m:
            yield m.group(1), m.group(2).lower(), m.group(3)
            at = m.end()
        else:
            yield ("<",)
            at = begin + 1


def tokens(page: str):
    """(kind, key, value, out): a text node under the key of its block, or an opening or closing tag, whose key is empty within a
    line; out tells that it belongs to a block that is no content."""
    stack: list[tuple[str, str, bool]] = []  # tag, key, whether it or an element around it holds no content
    opened: Counter = Counter()
    for piece in pieces(page):
        if len(piece) == 1:
            key, out = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            yield "text", key, piece[0], out
            continue
        closes, tag, rest = piece
        if tag in INLINE and not (closes and opened[tag]):
            yield "tag", "", tag, bool(stack and stack[-1][2])
        elif closes:
            key, out = f"{tag}", bool(stack and stack[-1][2])
            if opened[tag]:
                while True:
                    name, key, out = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            yield "tag", f"/{key}", tag, out
        else:
            names = sorted({x for found in MARK.findall(rest) for x in "".join(found).lower().split() if bad_name(x)})
            key = ".".join((tag, *names))
            if stack and stack[-1][0] == "p":
                stack.pop()
                opened["p"] -= 1
            out = bool(stack and stack[-1][2]) or bad(tag, names)
            if tag in PARTS:  # an item is what the block around its list is
                around = stack[-1] if stack else ("", "", False)
                key += "<" + (around[1].rpartition("<")[2] if around[0] in PARTS else around[1])
            yield "tag", key, tag, out
            if tag not in VOID and not rest.rstrip().endswith("/"):
                stack.append((tag, key, out))
                opened[tag] += 1


def counts(page: str) -> tuple[Counter, Counter] | None:
    """What a labelled page has within and outside its article: words by block, tags by key."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return None
    inside, outside, now = Counter(), Counter(), False
    for kind, key, value, out in tokens(page):
        if out or kind == "tag" and not key:
            continue
        if kind == "text":
            (inside if now else outside)["w " + key] += len(value.split())
        elif value == "article":
            outside["t " + key] += 1
            now = not key.startswith("/")
        else:
            (inside if now else outside)["t " + key] += 1
    return inside, outside


def learn(pages: DataFrame, most: int = LABELLED) -> dict[str, float]:
    """Weights by key: log-odds within an article, at most LIMIT either way; tags never weigh more than GOOD_TAG."""

    def run(batches):
        import pyarrow as pa

        total = (Counter(), Counter())
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if found := counts(page):
                    total[0].update(found[0])
                    total[1].update(found[1])
        keys = list(total[0].keys() | total[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[0][x] for x in keys], pa.int64()), pa.array([total[1][x] for x in keys], pa.int64())], ["key", "a", "b"])

    sample = pages.filter(F.col("html").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id").select(F.col("html").cast("string")).limit(most)
    found = sample.mapInArrow(run, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= LEAST)
    out = {}
    for r in found.collect():  # at most the kinds of tags of the labelled pages
        odds = max(-LIMIT, min(LIMIT, math.log((r.a + 0.5) / (r.b + 0.5))))
        out[r.key] = min(GOOD_TAG, odds) if r.key[0] == "t" else max(-2.0, min(GOOD_WORD, odds))
    return out


def token_score(weights: dict[str, float], kind: str, key: str, value: str, out: bool) -> float:
    if out or kind == "tag" and not key:
        return 0.0
    if kind == "tag":
        return weights.get("t " + key, GOOD_TAG)
    return weights.get("w " + key, GOOD_WORD) * len(value.split())


def best_run(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the run with the largest sum, in one scan; the first and shortest of equals, (0, 0) if none is over 0."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += x
        if run > best:
            best, span = run, (begin, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    row = list(tokens(page))
    begin, end = best_run([token_score(weights, *x) for x in row])
    blocks, now = [], []

    def close():
        text = re.sub("[ \t\n\x0b\x0c\r]+", " ", "".join(now)).strip(SPACE)
        if text:
            blocks.append(text)
        now.clear()

    for kind, _, value, out in row[begin:end]:
        if kind == "tag":
            if value == "br":
                now.append(" ")
            elif value not in INLINE:
                close()
        elif not out:
            now.append(entities.unescape(value))
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """page_id, url, text of each of pages(page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(learn(pages, labelled))  # at most the kinds of tags of the labelled pages

    @F.pandas_udf("string")
    def texts(page):
        return page.map(lambda x: main_text(x, sent.value))

    return pages.select("page_id", "url", texts(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
