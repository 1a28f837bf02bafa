"""Operator 9: main text of web pages by tree scoring.

A page is cut into tags and text, and built into a tree with the usual implied
end tags.  Subtrees that are never main text (navigation, footers, forms,
scripts, and elements whose class, id or role says advert, sidebar, comment,
notice and the like) are cut off.  Every paragraph passes points for its length
and commas to its parent, half to its grandparent and a third beyond; a
container's points are discounted by the share of its text that is inside links.
The best container is kept with those siblings that score near it or read like
text.  Blocks are put out in page order.

Per page, Arrow batches, no shuffle.  The page is read once from left to right:
time is linear in its size, whatever its markup.  Defined results: null and
empty html give an empty text; broken markup is read as far as it goes, never
refused: a tag whose quotes never end ends at its first >, one without any > is
text, or dropped if the page ends in it; a comment without an end takes the rest;
number references beyond Unicode become U+FFFD; references are decoded in each
text between two tags; equal scores go to the first container; repeated rows get
equal results; other columns pass through, result columns replace input columns
of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, released, tucked

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
LONG_NUMBER = re.compile(r"&#([xX]?)0*+([0-9a-fA-F]*+);?")
OPEN_QUOTES = 64  # tags with a quote that never ends, after which quotes of a page are plain characters
DEPTH = 512  # open elements; further ones inside become neighbours
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
CUT = frozenset("nav footer aside form script style noscript template iframe textarea title head button select dialog menu svg math object canvas audio video".split())
BLOCK = frozenset(
    "html body article main section div header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption address details summary fieldset center hgroup hr caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = frozenset("p pre td th li dd dt blockquote h2 h3 h4 h5 h6 figcaption div section article main body center summary address".split())
ENDS_P = BLOCK | {"form", "nav", "footer", "aside", "menu"}
#: A new element of the first kind ends an open one of the second kinds, up to an element of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners promo promos promotion sponsor sponsored sponsors sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended pagination pager pagenav widget login hidden masthead topbar toolbar skip search complementary contentinfo dialog".split()
)
CONTENT = frozenset("article main content post entry story body text".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
COMMAS = re.compile("[,،、，]")


class Tree:
    """Elements as parallel lists; children are element numbers or texts."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kids, self.cut, self.names = ["#root"], [-1], [[]], [False], [frozenset()]
        self._read(html)

    def _open(self, tag: str, attrs: str, at: int) -> int:
        self.tag.append(tag)
        self.parent.append(at)
        self.kids.append([])
        noise, names = tag in CUT, frozenset()
        if attrs and ("=" in attrs or "hidden" in attrs):
            names, hidden = self._names(attrs)
            noise = noise or hidden or (tag not in ("html", "body", "article", "main") and bool(names & NOISE)) or (tag == "article" and bool(names & {"comment", "reply", "ad", "advert", "related"}))
        self.cut.append(noise)
        self.names.append(names)
        self.kids[at].append(len(self.tag) - 1)
        return len(self.tag) - 1

    @staticmethod
    def _names(attrs: str) -> tuple[frozenset, bool]:
        words, hidden = [], False
        for name, *values in NAMED.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
            elif name in ("class", "id", "role"):
                words += SPLIT.split(value.lower())
        return frozenset(words), hidden

    def _read(self, html: str) -> None:
        self.stack = stack = [0]
        at, end, last, open_quotes = 0, len(html), html.rfind(">"), 0
        while at < end:
            tag = html.find("<", at)
            if tag < 0:
                tag = end
            if tag > at:
                self._say(html[at:tag])
            if tag == end:
                break
            if html.startswith("<!--", tag):
                stop = html.find("-->", tag + 4)
                at = stop + 3 if stop >= 0 else end
            elif tag > last:  # no tag ends any more
                at = self._unended(html, tag)
            elif html.startswith(("<!", "<?"), tag):
                at = html.find(">", tag) + 1
            elif m := TAG.match(html, tag):
                whole = ATTRIBUTES.match(html, m.end()) if open_quotes < OPEN_QUOTES else None
                if not whole:
                    open_quotes += 1
                at = whole.end() if whole else html.find(">", m.end()) + 1
                if m[1]:
                    self._close(stack, m[2].lower())
                else:
                    at = self._start(html, m[2].lower(), html[m.end() : at - 1], at)
            else:
                self._say("<")
                at = tag + 1

    def _say(self, text: str) -> None:
        self.kids[self.stack[-1]].append(text)

    def _unended(self, html: str, tag: int) -> int:
        """The rest of a page without a >: text, up to a comment or a tag that is cut off."""
        comment = html.find("<!--", tag)
        stop = comment if comment >= 0 else html.rfind("<")
        if stop > tag:
            self._say(html[tag:stop])
            return stop
        if not TAG.match(html, tag) and not html.startswith("<!--", tag):
            self._say(html[tag:])
        return len(html)

    def _start(self, html: str, tag: str, attrs: str, at: int) -> int:
        stack = self.stack
        self._imply(stack, tag)
        k = self._open(tag, attrs, stack[-1])
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{tag}\s*+/?>", re.I).search(html, at)
            return close.end() if close else len(html)
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK) and len(stack) < DEPTH:
            stack.append(k)
        return at

    def _imply(self, stack: list[int], tag: str) -> None:
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[depth]]
                if t == "p" or (t in HEADING and tag in HEADING):
                    del stack[depth:]
                    break
                if t in BLOCK or t in CUT:
                    break
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            last = None
            for depth in range(len(stack) - 1, 0, -1):
                if self.tag[stack[depth]] in until:
                    break
                if self.tag[stack[depth]] in ends:
                    last = depth
            if last is not None:
                del stack[last:]

    def _close(self, stack: list[int], tag: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[depth]]
            if t == tag:
                del stack[depth:]
                return
            if t in BLOCK and tag not in BLOCK and tag not in CUT:
                return  # an inline end tag doesn't leave its block

    # -- scoring

    def measure(self) -> None:
        """Text lengths, link lengths, commas and direct text of each element, without what is cut."""
        n = len(self.tag)
        self.length, self.linked, self.commas, self.own = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(1, n):  # cutting goes down; parents come before their children
            if self.cut[self.parent[k]]:
                self.cut[k] = True
            elif self.tag[k] == "header" and not self.cut[k] and not self._within(k, ("article", "main")):
                self.cut[k] = True
        for k in range(n - 1, -1, -1):
            if self.cut[k]:
                continue
            for x in self.kids[k]:
                if isinstance(x, str):
                    size = len(x) if not x.isspace() else 0
                    self.own[k] += size
                    self.length[k] += size
                    if "," in x or not x.isascii():
                        self.commas[k] += len(COMMAS.findall(x))
            if self.tag[k] == "a":
                self.linked[k] = self.length[k]
            if (p := self.parent[k]) >= 0:
                self.length[p] += self.length[k]
                self.linked[p] += self.linked[k]
                self.commas[p] += self.commas[k]
                if self.tag[k] not in BLOCK:
                    self.own[p] += self.own[k]

    def _within(self, k: int, tags: tuple) -> bool:
        while (k := self.parent[k]) > 0:
            if self.tag[k] in tags:
                return True
        return False

    def density(self, k: int) -> float:
        return self.linked[k] / self.length[k] if self.length[k] else 0.0

    def kept(self) -> list[int]:
        """The best container and the siblings to keep with it."""
        self.measure()
        points = [0.0] * len(self.tag)
        for k in range(1, len(self.tag)):
            if self.cut[k] or self.tag[k] not in TEXTUAL or not self.own[k]:
                continue
            gain = min(1.0, self.own[k] / 25) * (1 + self.commas[k] + min(self.own[k] / 100, 3)) * (1 - self.density(k))
            up = k if self.tag[k] not in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote", "h2", "h3", "h4", "h5", "h6", "figcaption") else self.parent[k]
            share = 1.0
            for step in range(1, 5):
                if up <= 0:
                    break
                points[up] += gain * share
                up, share = self.parent[up], 1 / (step * 1.0 + 1)
        for k, names in enumerate(self.names):
            if points[k]:
                points[k] *= (1 - self.density(k)) * (1.25 if self.tag[k] in ("article", "main") or names & CONTENT else 1.0)
        best = max(range(len(points)), key=points.__getitem__)
        if not points[best]:
            return self._fallback()
        around = [x for x in self.kids[self.parent[best]] if not isinstance(x, str) and not self.cut[x]]
        least = max(10.0, 0.2 * points[best])
        return [x for x in around if x == best or self._joins(x, x < best, points, least)]

    def _joins(self, x: int, before: bool, points: list[float], least: float) -> bool:
        if self.tag[x] in HEADING:
            return before
        if points[x] >= least:
            return True
        return self.tag[x] == "p" and (self.length[x] > 80 and self.density(x) < 0.25 or 0 < self.length[x] and not self.linked[x] and self.commas[x] > 0)

    def _fallback(self) -> list[int]:
        for wanted in ("article", "main", "body"):
            for k, t in enumerate(self.tag):
                if t == wanted and not self.cut[k] and self.length[k]:
                    return [k]
        return [0]

    def text(self) -> str:
        blocks: list[str] = []
        line: list[str] = []

        def end() -> None:
            if words := "".join(line).split():
                blocks.append(" ".join(words))
            line.clear()

        todo: list = list(reversed(self.kept()))
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(_decoded(x) if "&" in x else x)
            elif not self.cut[x]:
                if self.tag[x] in BLOCK:
                    end()
                    todo.append(None)
                elif self.tag[x] == "br":
                    line.append(" ")
                todo += reversed(self.kids[x])
        end()
        return "\n".join(blocks)


def _decoded(text: str) -> str:
    try:
        return unescape(text)
    except ValueError:  # a number of thousands of digits
        return unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1]}{m[2]};" if len(m[2]) < 9 else "\ufffd", text))


def main_text(html: str | None) -> str:
    return Tree(html).text() if html else ""


def html_text(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``pages`` (html, ...) plus text, n_chars."""
    if carry is None:
        packed, out = tucked(pages, "html")
        return out(html_text(packed, packed.columns), "text", "n_chars")
    bounded_batches(pages.sparkSession)
    made = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    taken = {f.name for f in made} | {"_html"}
    through = [c for c in carry if c.lower() not in taken]
    rows = pages.select(*[F.col(f"`{c}`") for c in through], F.col("html").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["_html"]]
            at = batch.schema.get_field_index("_html")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(released(run), T.StructType([rows.schema[c] for c in through] + made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text(pages, ["page_id", "url"])
