"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable, content or not, linked to
its parent block.  Potentials between parent and child depend on the child's
kind of tag, or on a class name that is made of words for furniture alone; each
variable also sees words for content, the share of links in its own text and
that text's length.
Sum-product messages go up and down the tree and give every block's marginal;
text in blocks over one half is the main text.

The potentials are smoothed counts over a bounded sample of labelled pages.
Labels are the pages' own semantic elements: what stands inside <article> or
<main>, apart from <nav>, <form>, <footer> and the like and from what is named
as readers' comments, is content; other class names are learned.  Each labelled page
counts three times: as it is, with its semantic elements made plain divisions,
so that other features carry weight, and with its menus, notices and footers
moved into the content, so that such blocks are recognised there too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SAMPLE_PAGES = 2_000
SMOOTHING = 0.5
#: what tag and class names say before a page is read, as so many blocks; as many labelled ones outweigh it
NAMES_WEIGHT = 20.0
INSIDE_WEIGHT = 100.0
FURNITURE_WEIGHT = 500.0
#: share of a feature's probability that is spread evenly, as the sample doesn't show all pages
EVEN_SHARE = 0.1

# fixed values: HTML's element classes
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template iframe noembed noframes xmp textarea svg math object canvas audio video select".split())
_PLAIN = frozenset("div section body html center table tbody thead tfoot tr td th figure figcaption details summary fieldset hgroup address".split())
_KINDS = {
    **dict.fromkeys("article main".split(), "article"), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"),
    **dict.fromkeys("p blockquote pre".split(), "paragraph"), **dict.fromkeys("ul ol li dl dt dd".split(), "list"),
    **dict.fromkeys("nav header footer aside form menu dialog button search dir".split(), "chrome"), **dict.fromkeys(_PLAIN, "plain"),
}
_CLOSES_P = frozenset(_KINDS) - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "button"} | {"hr"}
# an open element that a start tag of the group ends, and where the search for it stops
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# fixed values: words of class, id and role that mark furniture or content
_FURNITURE = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies "
    "consent notice alert popup modal overlay comment comments reply replies discussion disqus share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager login signin signup register subscribe subscription newsletter form search widget toolbar copyright legal disclaimer "
    "skip contentinfo complementary dialog toc".split()
)
_READERS = frozenset("comment comments reply replies discussion disqus".split())
# words that say where or how large a block is, not what it holds
_LAYOUT = frozenset(
    "list item items link links box wrapper wrap container block slot bar area section inner outer left right top bottom main site page global primary "
    "secondary user users button buttons icon icons title content group panel unit row col column grid sticky fixed mobile desktop small large first last "
    "article articles post posts the my text inline html js".split()
)
_CONTENT = frozenset("article content post entry story main body text prose".split())

_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*)(?P<rest>[^<>]*)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Page:
    """Blocks of a page in order: ``parents``, ``tags``, ``names``, ``length``, ``linked``; ``chunks`` are (line, block, text)."""

    def __init__(self, html: str) -> None:
        self.parents, self.tags, self.names, self.length, self.linked = [-1], ["html"], [""], [0], [0]
        self.chunks: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        count = Counter({"html": 1})
        line, links, at, n = 0, 0, 0, len(html)

        def text(part: str) -> None:
            part = unescape(part) if "&" in part else part
            self.chunks.append((line, stack[-1][1], part))
            seen = len(part.strip())
            self.length[stack[-1][1]] += seen
            self.linked[stack[-1][1]] += seen * (links > 0)

        def pop() -> str:
            name, _ = stack.pop()
            count[name] -= 1
            return name

        quotes, start = True, 0
        while at < n:
            # text runs from ``at``, the next sign is looked for from ``start`` on
            sign = html.find("<", start)
            if sign < 0:
                text(html[at:])
                break
            if html.startswith(("<!", "<?"), sign):
                close = html.find("-->", sign + 4) if html.startswith("<!--", sign) else html.find(">", sign)
                found, after = None, n if close < 0 else html.index(">", close) + 1
            else:
                found = _TAG.match(html, sign) if quotes else None
                if found is None and re.match("[A-Za-z]", html[sign + 1 : sign + 2]):
                    # a quote that never closes: from here on tags end at the next sign
                    quotes = False
                found = found or _PLAIN_TAG.match(html, sign)
                if found is None:
                    start = sign + 1
                    continue
                after = found.end()
            if sign > at:
                text(html[at:sign])
            at = start = after
            if found is None:
                continue
            name = found["name"].lower()
            block = name in _KINDS
            if found["end"]:
                if name in _KINDS or name == "a":
                    line += block
                    if count[name] > 0 and name != "html":
                        while (gone := pop()) != name:
                            links -= gone == "a"
                        links -= name == "a"
                continue
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = start = n if close is None else (html.find(">", close.end()) + 1 or n)
                continue
            if name in _VOID:
                line += name == "hr"
                if name == "br":
                    self.chunks.append((line, stack[-1][1], " "))
                continue
            if name == "a":
                if count["a"] > 0:
                    while (gone := pop()) != "a":
                        pass
                    links = 0
                stack.append(("a", stack[-1][1]))
                count["a"] += 1
                links += 1
                continue
            if not block or name == "html":
                continue
            line += 1
            if name in _CLOSES_P and count["p"] > 0:
                while (gone := pop()) != "p":
                    links -= gone == "a"
            ended, stops = _ENDS.get(name, ((), ()))
            if any(count[e] > 0 for e in ended):
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] not in ended and stack[depth][0] not in stops:
                    depth -= 1
                if stack[depth][0] in ended:
                    while len(stack) > depth:
                        links -= pop() == "a"
            self.parents.append(stack[-1][1])
            self.tags.append(name)
            words = " ".join(a or b or c for a, b, c in _NAMES.findall(found["rest"]))
            self.names.append(words)
            self.length.append(0)
            self.linked.append(0)
            stack.append((name, len(self.parents) - 1))
            count[name] += 1

    def observed(self) -> list[tuple[str, str, str, str]]:
        """(kind of tag, class words, share of links, length) of every block; the last two of its own text."""
        out = []
        for tag, names, n, k in zip(self.tags, self.names, self.length, self.linked):
            share = "none" if n == 0 else "few" if k < 0.5 * n else "most"
            size = "0" if n == 0 else "short" if n < 30 else "line" if n < 80 else "long"
            word = named(names)
            out.append(("furniture", "none", share, size) if word == "furniture" else (_KINDS[tag], word, share, size))
        return out


def named(names: str) -> str:
    """``furniture``, ``content`` or ``none`` by the names of a block; a name that also holds other words tells nothing."""
    parts = [set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())) for name in names.split()]
    furniture = any(words & _FURNITURE and words <= _FURNITURE | _LAYOUT for words in parts)
    words = set().union(*parts) if parts else set()
    if words & _CONTENT and not words & _READERS:
        return "none" if words & _FURNITURE else "content"
    return "furniture" if furniture else "none"


def readers(names: str) -> bool:
    return not _READERS.isdisjoint(re.findall("[a-z]+", names.lower()))


def labels(page: Page) -> list[bool] | None:
    """Content or not for every block, from the page's semantic elements; None without them."""
    out = [False] * len(page.tags)
    if not {"article", "main"} & set(page.tags):
        return None
    for i, tag in enumerate(page.tags):
        inside = tag in ("article", "main") or (i > 0 and out[page.parents[i]])
        out[i] = inside and _KINDS[tag] != "chrome" and not (named(page.names[i]) == "furniture" and readers(page.names[i]))
    return out


def _examples(page: Page, truth: list[bool]) -> Iterator[tuple[list[int], list[tuple[str, str, str, str]]]]:
    """(parents, observed) of the three versions of a labelled page."""
    seen = page.observed()
    yield page.parents, seen
    yield page.parents, [("plain" if o[0] in ("article", "chrome", "furniture") else o[0], "none", *o[2:]) for o in seen]
    home = next(i for i, t in enumerate(page.tags) if t in ("article", "main"))
    moved = [home if i > home and not truth[i] and not truth[max(p, 0)] and (_KINDS[t] == "chrome" or named(w) == "furniture") else p
             for i, (p, t, w) in enumerate(zip(page.parents, page.tags, page.names))]
    yield moved, seen


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total: Counter = Counter()
        for html in batch["html"]:
            page = Page(html)
            truth = labels(page)
            if truth is None:
                continue
            for parents, seen in _examples(page, truth):
                for i in range(1, len(parents)):
                    kind, names, share, size = seen[i]
                    total["step", kind, truth[parents[i]], truth[i]] += 1
                    for what, value in (("names", names), ("share", share), ("size", size)):
                        total[what, value, truth[i], truth[i]] += 1
        rows = [(*k, n) for k, n in total.items()]
        yield pd.DataFrame(rows, columns=["what", "value", "parent", "own", "n"])


class Potentials:
    """Log-potentials of the tree."""

    def __init__(self, counts: Counter) -> None:
        counts = Counter(counts)
        # what names alone say, for kinds that the sample lacks
        for parent in (False, True):
            counts["step", "chrome", parent, False] += FURNITURE_WEIGHT
            counts["step", "furniture", parent, False] += FURNITURE_WEIGHT
            counts["step", "article", parent, True] += NAMES_WEIGHT
            counts["step", "plain", parent, parent] += NAMES_WEIGHT
        for kind in ("paragraph", "heading", "list"):
            # such blocks follow their container, into content rarely
            counts["step", kind, True, True] += NAMES_WEIGHT
            counts["step", kind, False, False] += INSIDE_WEIGHT
        counts["names", "content", True, True] += NAMES_WEIGHT
        for own in (False, True):
            counts["names", "none", own, own] += NAMES_WEIGHT
        self.step = {}
        for kind in {*_KINDS.values(), "furniture"}:
            for parent in (False, True):
                pair = [counts["step", kind, parent, own] + SMOOTHING for own in (False, True)]
                self.step[kind, parent] = [math.log(x / sum(pair)) for x in pair]
        self.seen = {}
        values = {"names": ("content", "none"), "share": ("none", "few", "most"), "size": ("0", "short", "line", "long")}
        for what, known in values.items():
            for own in (False, True):
                row = [counts[what, v, own, own] + SMOOTHING for v in known]
                for v, x in zip(known, row):
                    self.seen[what, v, own] = math.log((1 - EVEN_SHARE) * x / sum(row) + EVEN_SHARE / len(row))

    def unary(self, observed: tuple[str, str, str, str]) -> list[float]:
        _, names, share, size = observed
        return [self.seen["names", names, s] + self.seen["share", share, s] + self.seen["size", size, s] for s in (False, True)]


def _sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(parents: list[int], observed: list[tuple[str, str, str, str]], potentials: Potentials) -> list[float]:
    """Probability of content for every block; parents stand before their children, the root is not content."""
    n = len(parents)
    up = [potentials.unary(o) for o in observed]
    sent: list[list[float]] = [[0.0, 0.0]] * n
    up[0] = [0.0, -50.0]
    for i in range(n - 1, 0, -1):
        steps = [potentials.step[observed[i][0], p] for p in (False, True)]
        sent[i] = [_sum(steps[p][0] + up[i][0], steps[p][1] + up[i][1]) for p in (0, 1)]
        up[parents[i]] = [up[parents[i]][p] + sent[i][p] for p in (0, 1)]
    whole = [up[0]] + [[0.0, 0.0]] * (n - 1)
    out = [0.0] * n
    for i in range(1, n):
        rest = [whole[parents[i]][p] - sent[i][p] for p in (0, 1)]
        steps = [potentials.step[observed[i][0], p] for p in (False, True)]
        down = [_sum(rest[0] + steps[0][s], rest[1] + steps[1][s]) for s in (0, 1)]
        whole[i] = [up[i][s] + down[s] for s in (0, 1)]
        out[i] = 1 / (1 + math.exp(min(700.0, whole[i][0] - whole[i][1])))
    return out


def main_text(html: str | None, potentials: Potentials) -> str:
    """The main text, one line per block; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    chance = marginals(page.parents, page.observed(), potentials)
    lines: list[str] = []
    last, parts = -1, []
    for line, block, text in [*page.chunks, (-1, 0, "")]:
        if line != last:
            if joined := " ".join("".join(parts).split()):
                lines.append(joined)
            last, parts = line, []
        if chance[block] > 0.5:
            parts.append(text)
    return "\n".join(lines)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Potentials:
    """Potentials from about ``sample`` pages; without labelled ones the names of tags and classes decide."""
    known = pages.where(F.col(html).isNotNull())
    total = known.count()
    share = 1.0 if total <= sample else sample / total
    place = F.pmod(F.xxhash64(F.col(key), F.length(html)), F.lit(1_000_000))
    counts = known.where(place < int(share * 1_000_000)).select(F.col(html).alias("html")).mapInPandas(
        _counted, "what string, value string, parent boolean, own boolean, n long"
    ).groupBy("what", "value", "parent", "own").agg(F.sum("n").alias("n"))
    # as many rows as there are potentials
    return Potentials(Counter({(r.what, r.value, r.parent, r.own): r.n for r in counts.collect()}))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``output`` (replaced if it is there).

    A null or empty page has empty text.  Broken markup is read as far as it
    goes: unclosed elements end with their parent, stray end tags are passed
    over.  Repeated rows get the same answer.
    """
    potentials = fit(pages, key, html)

    @F.pandas_udf(StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h, potentials) for h in batch], dtype=object)

    return pages.withColumn(output, text(F.col(html)))
