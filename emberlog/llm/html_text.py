"""Main text of web pages by composite text density.

A tolerant parser builds the element tree.  Every node has a link-adjusted
density, characters per tag made smaller by the share of link text; the
density sum of a block adds the densities of the blocks right below it (what
is inline counts as tags and text of its block).  The block of the largest sum
carries the text.  The smallest density on its path to the body is the
threshold: every subtree beside the path that reaches it gives its own block
of the largest sum.  If these hold at least half the text of an article or
main element around the best block, that element is taken with its short
parts.

What HTML says is no text (navigation, forms, scripts, asides and the like)
does not count and is left out.  Containers whose class, id or role names such
a part are left out too, for density cannot tell an advert or a reader's
comment from a paragraph; but one that holds more than half of the page's text,
in blocks, is taken for a wrapper, unless it is named after comments, and if
nothing is left on a page without an article or main element, names are not
looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._shared import lean

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only after an equals sign
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")
_SPACES = re.compile(r"\s+")

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())
# Elements and the names in class or id that are not part of an article.
_NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option textarea title iframe object embed svg canvas audio video menu dialog xmp noembed noframes input fieldset label legend datalist optgroup".split()
)
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar "
    "comment comments disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead social share sharing related recommended newsletter subscribe "
    "popup modal overlay widget pagination pager toolbar".split()
)
_BEGINNINGS = ("comment", "advert", "sidebar", "cookie", "newsletter", "breadcrumb", "promo", "sponsor", "banner", "footer", "navbar", "subscri", "popup")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_READERS = ("comment", "disqus", "respond")
#: Why an element is left out: never text; named as a part that is none; named after readers' comments.
_NO, _ALWAYS, _NAMED, _REMARKS = 0, 1, 2, 3


def _reason(tag: str, attrs: str, in_article: bool) -> int:
    if tag in _NEVER or (tag == "header" and not in_article):
        return _ALWAYS
    if not attrs or tag in ("html", "body", "article", "main"):
        return _NO
    found = _NO
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = _WORDS.split(value)
            if any(w.startswith(_READERS) and w != "commentary" for w in words):
                return _REMARKS
            if not _NAMES.isdisjoint(words) or ("header" in words and not in_article) or any(w.startswith(_BEGINNINGS) and w != "commentary" for w in words):
                found = _NAMED
        elif name == "role" and value in _ROLES:
            found = _NAMED
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _ALWAYS
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _ALWAYS
    return found


class _Tree:
    """Nodes in page order; node 0 is the root and stands for the body."""

    def __init__(self, page: str):
        self.tag, self.parent, self.reason = ["body"], [-1], [_NO]
        self.texts: list[tuple[int, str]] = []  # (node, decoded text); a block break is (node, None)
        open_, at, drop, article = [0], 0, 0, 0
        add = self.texts.append
        find = _TOKEN.search
        while m := find(page, at):
            if m.start() > at and not drop:
                add((open_[-1], html.unescape(page[at : m.start()])))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["close"]:
                if tag == "br":
                    add((open_[-1], " "))
                if tag in ("body", "html"):
                    continue
                for i in range(len(open_) - 1, 0, -1):
                    node = open_[i]
                    if self.tag[node] == tag:
                        for x in open_[i:]:
                            drop -= self.reason[x] == _ALWAYS
                            article -= self.tag[x] in ("article", "main")
                        del open_[i:]
                        break
                    if tag in _INLINE and self.tag[node] not in _INLINE and self.tag[node] != "p":
                        break
                if tag not in _INLINE and not drop:
                    add((open_[-1], None))
                continue
            if tag in ("html", "body"):
                # what stands open of the head ends here
                for x in open_[1:]:
                    drop -= self.reason[x] == _ALWAYS
                    article -= self.tag[x] in ("article", "main")
                del open_[1:]
                continue
            ends = {"p"} if tag in _CLOSES_P else _SAME.get(tag, ())
            if ends:
                for i in range(len(open_) - 1, 0, -1):
                    name = self.tag[open_[i]]
                    if name in ends:
                        for x in open_[i:]:
                            drop -= self.reason[x] == _ALWAYS
                            article -= self.tag[x] in ("article", "main")
                        del open_[i:]
                        break
                    if name not in _INLINE and (name in _LISTS or tag in _CLOSES_P):
                        break
            if tag not in _INLINE and not drop:
                add((open_[-1], " " if tag == "br" else None))
            reason = _NO if drop else _reason(tag, m["attrs"], article > 0)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.reason.append(reason)
            if tag in _VOID or m["attrs"].endswith("/") and tag not in _RAW and tag not in _CLOSES_P:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            open_.append(node)
            drop += reason == _ALWAYS
            article += tag in ("article", "main")
        if at < len(page) and not drop:
            add((open_[-1], html.unescape(page[at:])))

    def _left_out(self) -> list[bool]:
        """Which nodes do not count: never text, or in a named part that is no wrapper."""
        n = len(self.tag)
        chars = [0] * n
        for i, t in self.texts:
            chars[i] += len(t.strip()) if t else 0
        blocks = [0] * n
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            blocks[self.parent[i]] += blocks[i] + (self.tag[i] not in _INLINE and self.tag[i] not in _VOID)
        wrapper = [blocks[i] > 1 and 2 * chars[i] > chars[0] for i in range(n)]
        out = [False] * n
        for use_names in (True, False):
            left = chars[0]
            for i in range(1, n):
                named = use_names and (self.reason[i] == _REMARKS or (self.reason[i] == _NAMED and not wrapper[i]))
                out[i] = out[self.parent[i]] or self.reason[i] == _ALWAYS or named
                left -= chars[i] if out[i] and not out[self.parent[i]] else 0
            if left > 0 or "article" in self.tag or "main" in self.tag:
                break
        return out

    def densities(self) -> tuple[list[float], list[float]]:
        n = len(self.tag)
        self.out = out = self._left_out()
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for i, t in self.texts:
            if t and not out[i]:
                k = len(t.strip())
                chars[i] += k
                if linked[i]:
                    links[i] += k
        for i in range(n - 1, 0, -1):
            if out[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        self.chars = chars
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            c = chars[i]
            if out[i] or not c or (i and self.tag[i] in _INLINE):
                continue
            lc, lt, t = links[i], max(link_tags[i], 1), max(tags[i], 1)
            ratio = c / max(lc, 1) * t / lt
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            # without any link text the base is 1; the natural logarithm stands in
            density[i] = c / t * (math.log(ratio + 1) / math.log(base) if base > math.e else math.log(ratio + 1))
            if i:
                total[self._block(i)] += density[i]
        return density, total

    def _block(self, i: int) -> int:
        """The nearest block around a node."""
        i = self.parent[i]
        while i and self.tag[i] in _INLINE:
            i = self.parent[i]
        return i

    def content(self) -> set[int]:
        """Nodes whose subtrees are the text."""
        density, total = self.densities()
        n = len(self.tag)
        blocks = [i for i in range(n) if not i or self.tag[i] not in _INLINE]
        best = max(blocks, key=lambda i: (total[i], -i))
        if total[best] <= 0:
            return {0}
        low, i, path = density[best], best, {best}
        while i > 0:
            i = self._block(i)
            path.add(i)
            low = min(low, density[i])
        # the block of the largest sum in every subtree
        top = list(range(n))
        for i in reversed(blocks[1:]):
            p = self._block(i)
            if (total[top[i]], -top[i]) > (total[top[p]], -top[p]):
                top[p] = top[i]
        # subtrees that hang on the path
        beside = (i for i in blocks[1:] if i not in path and (p := self._block(i)) in path and p != best)
        found = {top[i] for i in beside if density[i] >= low and density[i] > 0} | {best}
        # short parts of an article that is mostly found belong to it
        whole, i = best, best
        while i > 0:
            if self.tag[i] in ("article", "main") and 2 * sum(self.chars[x] for x in found if self._within(x, i)) >= self.chars[i]:
                whole = i
            i = self.parent[i]
        return {x for x in found if not self._within(x, whole)} | {whole}

    def _within(self, node: int, around: int) -> bool:
        while node > around:
            node = self.parent[node]
        return node == around

    def text(self) -> str:
        chosen = self.content()
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = not self.out[i] and (i in chosen or (i > 0 and inside[self.parent[i]]))
        blocks, now = [], []

        def flush() -> None:
            if now:
                if block := _SPACES.sub(" ", "".join(now)).strip():
                    blocks.append(block)
                now.clear()

        for i, t in self.texts:
            if t is None:
                flush()
            elif inside[i]:
                now.append(t)
        flush()
        return " ".join(blocks)


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    return _Tree(page).text() if page else ""


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``pages`` without the html, with its main text and the text's code points.

    A null or empty page has the empty text.  Columns of these names are
    replaced.  Rows are independent: no shuffle.
    """
    keep = [c for c in pages.columns if c not in (html_col, text_col, count_col)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(text_col, T.StringType()), T.StructField(count_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(html_col)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=schema.names,
            )

    return pages.select(*keep, html_col).mapInArrow(lean(run), schema)
