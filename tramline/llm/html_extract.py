"""HTML extraction: each host's pages vote on the tag-class path of their main container, and all are extracted by the winner."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, join_bounded

#: Fixed words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
#: A start tag of the key ends open elements of the values, up to the nearest container or list.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
#: Elements that are never part of the main text.
DROP = frozenset("aside audio button canvas datalist dialog footer form head iframe input label menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split())
#: A name of class, id or role tells the same outside the article if its words are all of these and of PLACES, one of these at least.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog discussion disqus"
    " footer gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification outbrain pager pagination popup promo promotion recommended related replies respond"
    " share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola teaser teasers toc toolbar tooltip topbar tracking warning widget widgets".split()
)
PLACES = frozenset("area articles bar bottom box buttons container form global left links list main message mobile page posts primary reader readers right secondary site slot stories top user users wrap wrapper".split())
#: What can stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Whole names that tell the same anywhere, within an article too.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox breadcrumb breadcrumbs comment comments commentlist comment-list comments-area comments-list comment-section comments-section reader-comments user-comments cookie-notice cookie-banner cookie-bar cookie-consent"
    " consent-banner disqus disqus-thread footer masthead nav navbar newsletter-signup outbrain pagination related-articles related-posts share-buttons sharing-buttons site-footer site-nav social-share sidebar sidebars taboola".split()
)
#: A block whose class, or a part whose id, has one of these words and otherwise only such, places and kinds of parts, is no part of an article anywhere.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox comment comments commenter commenters commentlist consent cookie cookies disqus gdpr newsletter newsletters outbrain promo promos promotion promotions"
    " recommended related replies respond share sharing signup sponsor sponsored sponsors subscribe taboola".split()
)
KINDS = frozenset("author block body count date entry heading holder inner item label meta module name news outer panel part section text thread time title unit user content message messages story stories links".split())
#: Elements whose id is a name of a part; a section's or a heading's may be made of its words.
PARTS = frozenset("aside div ol ul".split())
DROP_ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar tooltip".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: How an element is left out: not at all, but within the winning container, everywhere.
KEPT, OUTSIDE, ALWAYS = 0, 1, 2

# A tag as most are, in one match, and its attributes.
USUAL = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:\s++[^\s/>="'<]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'>=<`]++))?+)*+)\s*+>""")
ATTRIBUTE = re.compile(r"""([^\s=]++)(?:=(?:"([^"]*+)"|'([^']*+)'|(\S++)))?+""")
# The parts of any other, each matched where the one before ended, so that a page is read once from left to right.
TAG = re.compile(r"[A-Za-z][^\s/>]*+")
GAP = re.compile(r"[\s/]*+")
NAME = re.compile(r"[^\s/>][^\s/>=]*+")
EQUALS = re.compile(r"\s*+=\s*+")
VALUE = re.compile(r"[^\s>]*+")
#: The end tags of elements whose content is no markup.
ENDED = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def read_tag(source: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from behind a tag's name, the end of the tag, and whether it has one.

    A quote counts as one right behind an equals sign only. One that is never closed ends with the tag.
    """
    found: dict[str, str] = {}
    while True:
        at = GAP.match(source, at).end()
        if at >= len(source):
            return found, at, False
        if source[at] == ">":
            return found, at + 1, True
        m = NAME.match(source, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := EQUALS.match(source, at):
            at = m.end()
            end = source.find(source[at], at + 1) if source[at : at + 1] in ("'", '"') else -1
            if end >= 0:
                value, at = source[at + 1 : end], end + 1
            elif source[at : at + 1] != ">":
                m = VALUE.match(source, at)
                value, at = m[0], m.end()
        if name not in found:
            found[name] = html.unescape(value) if "&" in value else value


def _dropped(tag: str, found: dict[str, str], inside: bool) -> int:
    """inside: within an article or main element, where a header is the article's own, and only names that are never an article's part drop."""
    if tag in DROP or (tag == "header" and not inside):
        return ALWAYS
    if tag in ("html", "body", "main") or not found:
        return KEPT
    if found.get("role", "").lower() in DROP_ROLES:
        return ALWAYS
    if not ("class" in found or "id" in found or "role" in found):
        return KEPT
    out = KEPT
    classes, own = found.get("class", "").split(), "" if tag in HEADINGS else found.get("id", "")
    for k, name in enumerate((*classes, own, found.get("role", ""))):
        words = [w.lower() for w in SPLIT.split(name) if w]
        if "-".join(words) in DROP_NAMES:
            return ALWAYS
        part = tag in BLOCK if k < len(classes) else tag in PARTS
        if part and not NEVER.isdisjoint(words) and all(w in NEVER or w in PLACES or w in KINDS for w in words):
            return ALWAYS
        if not inside and not DROP_WORDS.isdisjoint(words) and all(w in DROP_WORDS or w in PLACES for w in words):
            out = OUTSIDE
    return out


class Page:
    """containers: (parent, path); blocks: (container, text, characters in links, text with what is left out outside the winner only).

    A path is a digest of all that is around a container, and its own tag and classes.
    """

    def __init__(self, source: str):
        self.containers: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int, str]] = []
        self._stack: list[tuple[str, int, int]] = [("", 0, KEPT)]  # tag, container, dropped
        self._at: dict[str, list[int]] = {}  # where in the stack each tag is
        self._blocks: list[int] = [0]  # where in the stack blocks are
        self._parts: list[tuple[str, int]] = []
        self._linked = self._links = self._articles = 0
        at = 0
        while (lt := source.find("<", at)) >= 0:
            after = source[lt + 1 : lt + 2]
            if after == "!" or after == "?":
                self._text(source[at:lt])
                at = _past(source, lt)
                continue
            if m := USUAL.match(source, lt):
                if at < lt:
                    self._text(source[at:lt])
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self._close(tag)
                    continue
                at = self._start(source, tag, _attributes(m[3]) if m[3] else {}, at)
                continue
            closing = after == "/"
            m = TAG.match(source, lt + 1 + closing)
            if m is None:
                empty = source.startswith("</>", lt)
                self._text(source[at : lt + 1 - empty])
                at = lt + (3 if empty else 1)
                continue
            self._text(source[at:lt])
            tag = m[0].lower()
            found, at, ended = read_tag(source, m.end())
            if not ended:
                break  # the page ends within a tag
            if closing:
                self._close(tag)
                continue
            at = self._start(source, tag, found, at)
        self._text(source[at:])
        self._flush()

    def _start(self, source: str, tag: str, found: dict[str, str], at: int) -> int:
        """Opens the element whose tag ends before ``at``; where the page goes on: behind an element whose content is no markup."""
        self._open(tag, found)
        if tag in RAW and source[at - 2] != "/":
            end = ENDED[tag].search(source, at)
            self._text(source[at : end.start()] if end else source[at:])
            at = end.end() if end else len(source)
            self._close(tag)
        return at

    def _end_head(self, tag: str) -> None:
        """An open head ends where a body, or content right within the head, begins."""
        if (self._stack[-1][0] == "head" and tag not in HEAD or tag == "body") and self._at.get("head"):
            self._pop(self._at["head"][0])

    def _text(self, raw: str) -> None:
        if self._stack[-1][0] == "head" and raw.strip():
            self._end_head("")
        dropped = self._stack[-1][2]
        if raw and dropped != ALWAYS:
            text = html.unescape(raw) if "&" in raw else raw
            self._parts.append((text, dropped))
            if self._links and not dropped:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            whole = " ".join("".join(t for t, _ in self._parts).split())
            text = whole if not any(d for _, d in self._parts) else " ".join("".join(t for t, d in self._parts if not d).split())
            if whole:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text)), whole))
        self._parts, self._linked = [], 0

    def _pop(self, n: int) -> None:
        """Down to n open elements."""
        while len(self._stack) > n:
            if self._stack[-1][0] in BLOCK:
                self._flush()
            tag = self._stack.pop()[0]
            self._at[tag].pop()
            if tag in BLOCK:
                self._blocks.pop()
            self._links -= tag == "a"
            self._articles -= tag in ("article", "main")

    def _open(self, tag: str, found: dict[str, str]) -> None:
        self._end_head(tag)
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            if self._stack[self._blocks[-1]][0] == "p":  # a paragraph ends where a block begins
                self._pop(self._blocks[-1])
            if tag in ENDS:
                limit = max((self._at[t][-1] for t in (*LIMITS[tag], *(CONTAINER - {"td"})) if self._at.get(t)), default=0)
                ended = [own[k] for t in ENDS[tag] if (own := self._at.get(t)) and (k := bisect_right(own, limit)) < len(own)]
                if ended:
                    self._pop(min(ended))
            self._flush()
        if tag in VOID:
            return
        _, container, dropped = self._stack[-1]
        dropped = max(dropped, _dropped(tag, found, self._articles > 0)) if dropped != ALWAYS else ALWAYS
        if tag in CONTAINER and not dropped:
            names = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
            own = ".".join([tag, *names])
            around = xxhash.xxh64_hexdigest(self.containers[container][1].encode("utf-8", "surrogatepass"))
            self.containers.append((container, f"{around}>{own}"))
            container = len(self.containers) - 1
        self._links += tag == "a"
        self._articles += tag in ("article", "main")
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, container, dropped))

    def _close(self, tag: str) -> None:
        """An inline end tag closes nothing beyond its block."""
        own = self._at.get(tag)
        if own and (tag in BLOCK or own[-1] > self._blocks[-1]):
            self._pop(own[-1])
        elif tag == "p":
            self._flush()

    def scores(self) -> list[int]:
        """A block counts for its container, half for the one around it, and a quarter beyond; links don't count. An article or main counts three times."""
        out = [0] * len(self.containers)
        for at, text, linked, _ in self.blocks:
            worth, node = 4 * max(0, len(text) - 2 * linked), at
            for share in (1, 2, 4):
                if node < 0:
                    break
                out[node] += worth // share
                node = self.containers[node][0]
        for k, (_, path) in enumerate(self.containers):
            if path.rpartition(">")[2].partition(".")[0] in ("article", "main"):
                out[k] *= 3
        return out

    def votes(self) -> list[tuple[str, int]]:
        """Each path once, with its best container's share of the page's best score."""
        best: dict[str, int] = {}
        for s, (_, path) in zip(self.scores(), self.containers):
            if s > best.get(path, 0):
                best[path] = s
        return [(path, 1000 * s // max(best.values())) for path, s in best.items()]

    def text(self, path: str | None) -> str:
        """All blocks under the containers with the path, in page order; without one, with the path of the page's best."""
        scores = self.scores()
        fit = [k for k, (_, p) in enumerate(self.containers) if p == path and scores[k] > 0] or [k for k, s in enumerate(scores) if s > 0]
        if not fit:
            return ""
        path = self.containers[max(fit, key=lambda k: (scores[k], -k))][1]
        under = [False] * len(self.containers)
        for k, (parent, p) in enumerate(self.containers):
            under[k] = p == path or (parent >= 0 and under[parent])
        whole = path.rpartition(">")[2].partition(".")[0] not in ("", "body")  # in a body names tell what isn't the article's
        return "\n".join(x for k, t, _, w in self.blocks if under[k] and (x := w if whole else t))


def _past(source: str, at: int) -> int:
    """Behind the comment, marked section or declaration that begins at ``at``; one without an end goes to the page's."""
    for opening, ending, least in (("<!--", "-->", 2), ("<![CDATA[", "]]>", 9), ("<", ">", 1)):
        if source.startswith(opening, at):
            end = source.find(ending, at + least)
            return len(source) if end < 0 else end + len(ending)
    return at


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the container path with the most votes, ties to the smaller path.

    A null URL, or one without ://, is of the host without a name. Null and empty html, and pages without text outside what is dropped,
    have no votes; a host of such pages only has no row. Repeated rows vote each. Empty table: no rows.
    """

    def step(batch: pa.RecordBatch) -> dict:
        out = [(h, p, n) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p, n in Page(x or "").votes()]
        return {k: [x[i] for x in out] for i, k in enumerate(("host", "path", "votes"))}

    votes = arrow_pass(pages.select(host_of(F.col("url")).alias("host"), "html"), step, "host string, path string, votes long")
    each = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return each.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html).

    Null and empty html, and pages without text outside what is dropped, have an empty text. Pages
    with a null URL or one without a host vote together as the host without a name. A page without
    its host's winning path is extracted by its own best container. Repeated rows each give a row.
    Empty table: no rows. Other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> dict:
        found = [Page(x or "").text(p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(x) for x in found]}

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = join_bounded(rows, cut(host_paths(pages)), "host", F.struct("page_id", "url")).select("page_id", "url", "html", "path")
    return arrow_pass(joined, step, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages)
