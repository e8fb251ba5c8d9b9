"""Main text of web pages by template deduction over the pages of a host.

A page is read as a tree of block elements. Its tokens are the elements, by their path of tags and classes, the texts of
blocks by the path that they are at, and the words of blocks whose path a page has once. Over the pages of a host, each
token has an occurrence vector: how often it comes in each page. Tokens of equal vectors form an equivalence class. A
class is valid if it has an element, comes in PAGES pages or more, and hangs in one other class or in none; classes nest
so in a template, of which the class of the outermost element is the root. What a class's element holds always and alike
is fixed text of the template; what is left are slots. The main text is the slots of the region: of the element that has
all of the host's articles or, without articles, of the innermost element of the root class that has all slots but
little ones beside its heaviest. Slots that are mostly links are menus. Elements that are navigation, forms and the like
by tag are no slots at all. A class, id or role that says so ("comments", as a whole name) counts outside articles; inside one
it does so only where the element is in a valid class of the host, but for comments and adverts, and never for a paragraph or
for an article below it.

Paths are hashes, and vectors are sums of hashes, so that a host's pages meet in sums only, which are partly added up before
any shuffle. A class's tokens all come in one page, so that no group is larger than the tokens of a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import materialize

# HTML elements by kind, and the words of class names that mark what is no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "noembed"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul",
}
NO_CONTENT = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "template", "select", "button", "svg", "canvas", "object", "audio", "video", "math", *RAW}
NO_CONTENT_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay",
    "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "responses", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
HEADER_WORDS = {"header", "head"}
#: Names that leave no doubt inside articles either: readers' comments and adverts.
SURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "disqus"}
#: What an article is made of: no name of theirs hides them there.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that an opening tag ends: {tag: (open elements it ends, elements at which the search stops)}.
P_END = BLOCKS - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "legend", "summary", "figcaption", "template"}
ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS |= {t: ({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "table"}) for t in P_END}

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Pages from which on tokens are believed; the share of links that makes a menu, of fixed words that makes a template's block,
#: of the heaviest slot below which a slot beside it is little, and of the letters that the heaviest must have.
PAGES, LINKS, WORDY, LITTLE, HEAVY = 3, 0.6, 0.8, 0.1, 0.6
#: Of an article's letters, the share from which on repeated text means copies and not a template.
COPIES = 0.5
#: Kinds of tokens.
ELEMENT, ARTICLE, HEADING, MARKED, TEXT, WORD = range(6)
#: Bytes of all templates up to which they are broadcast, and tokens that a task holds before it hands them on.
BROADCAST_BYTES, HELD = 32 * 2**20, 100_000
SALT = 16


def digest(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


class Element:
    """no_content: by its tag or one above; marked: so named, outside articles or itself; named: its own name says so."""

    __slots__ = ("tag", "path", "no_content", "article", "link", "marked", "named")

    def __init__(self, tag, path, no_content=False, article=False, link=False, marked=False, named=False):
        self.tag, self.path, self.no_content, self.article, self.link, self.marked, self.named = tag, path, no_content, article, link, marked, named

    @property
    def content(self) -> bool:
        return not self.no_content and not self.marked


def opened(tag: str, attributes: str, up: Element) -> Element:
    names: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        names.setdefault(k.lower(), (a or b or c).lower())
    words = {w for k in ("class", "id", "role") for w in names.get(k, "").split()}
    holds = tag in ("article", "main") or names.get("role") in ("main", "article")
    article = up.article or holds
    hidden = "hidden" in names or names.get("aria-hidden") == "true"
    no_content = up.no_content or hidden or tag in NO_CONTENT or (not article and tag == "header")
    if tag in ("article", "main", "body", "html") and not up.no_content and not hidden:
        no_content = False
    named = bool(words & NO_CONTENT_WORDS) or (not article and bool(words & HEADER_WORDS))
    named = named and not holds and tag not in ("body", "html") and not (article and tag in PROSE)
    marked = not holds and (up.marked or (named and (not article or bool(words & SURE_WORDS))))
    step = tag + ("." + ".".join(sorted(names.get("class", "").split())) if names.get("class") else "")
    return Element(tag, digest(step, up.path) if tag in BLOCKS else up.path, no_content, article, up.link or tag == "a", marked, named)


class Page:
    """blocks: (path, text, letters in links, content or not, inside an article) of each block of text in page order. elements:
    {path: [path above, times, kind]} of the block elements, those above before those below. Comments, declarations and raw
    text of scripts and the like are skipped."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str, int, bool, bool]] = []
        self.elements: dict[int, list] = {}
        stack, count = [Element("", 0)], {}
        held, linked, at = [], 0, None

        def flush() -> None:
            nonlocal held, linked, at
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self.blocks.append((at.path, text, linked, at.content, at.article))
            held, linked, at = [], 0, None

        def cut(k: int) -> None:
            for e in stack[k:]:
                count[e.tag] -= 1
            del stack[k:]

        pos, n = 0, len(page)
        while pos < n:
            m = PIECE.match(page, pos)
            pos = m.end()
            tag = m.group(2)
            if tag is None:
                piece = m.group(0)
                if piece[0] != "<" or piece == "<":
                    top = stack[-1]
                    if at is not None and at is not top and at.content != top.content:
                        flush()
                    at = at or top
                    held.append(piece)
                    linked += len(piece) * top.link
                continue
            tag = tag.lower()
            if tag in BLOCKS or tag == "hr":
                flush()
            elif tag == "br" and held:
                held.append(" ")
            if m.group(1):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if count.get(tag) else 0
                # An end tag of an inline element does not end the blocks around it.
                if k and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[k:])):
                    cut(k)
                continue
            if tag in ENDS and any(count.get(t) for t in ENDS[tag][0]):
                ends, stops = ENDS[tag]
                k, last = len(stack) - 1, 0
                while k > 0 and stack[k].tag not in stops:
                    if stack[k].tag in ends:
                        last = k
                    k -= 1
                if last:
                    cut(last)
            if tag in VOID:
                continue
            up = stack[-1]
            e = opened(tag, m.group(3), up)
            if tag in BLOCKS:
                kind = ELEMENT if not e.content else ARTICLE if e.article and not up.article else MARKED if e.named else HEADING if tag in HEADINGS else ELEMENT
                self.elements.setdefault(e.path, [up.path, 0, kind])[1] += 1
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else n
                continue
            if not m.group(3).endswith("/") or tag in BLOCKS:
                stack.append(e)
                count[tag] = count.get(tag, 0) + 1
        flush()

    def letters(self) -> dict[int, list[int]]:
        """{path: [letters of content at or below it, letters in links]}"""
        out = {p: [0, 0] for p in self.elements}
        for path, text, linked, content, _ in self.blocks:
            if path in out:
                out[path][0] += len(text) * content
                out[path][1] += linked
        for p in reversed(self.elements):
            if (up := out.get(self.elements[p][0])) is not None:
                up[0] += out[p][0]
                up[1] += out[p][1]
        return out

    def below(self, tops: set[int]) -> set[int]:
        """The paths that are one of these or below one."""
        out: set[int] = set()
        for p, (up, _, _) in self.elements.items():
            if p in tops or up in out:
                out.add(p)
        return out

    def words(self) -> Iterator[tuple[int, str, list[str]]]:
        """(path, text, words) of the blocks; words only where the page has the path, and a block at it, once."""
        at: dict[int, int] = {}
        for b in self.blocks:
            at[b[0]] = at.get(b[0], 0) + 1
        for path, text, *_ in self.blocks:
            yield path, text, text.split() if at[path] == 1 and self.elements.get(path, (0, 1))[1] == 1 else []

    def tokens(self) -> dict[int, list]:
        """{token: [path, kind, times, letters, linked]}; an element's path is that above it, a text's or word's that of its block."""
        letters = self.letters()
        out = {p: [up, kind, times, *letters[p]] for p, (up, times, kind) in self.elements.items()}
        for path, text, words in self.words():
            out.setdefault(digest(text, path ^ TEXT), [path, TEXT, 0, 0, 0])[2] += 1
            for w in words:
                out.setdefault(digest(w, path ^ WORD), [path, WORD, 0, 0, 0])[2] += 1
        return out


TOKENS = "host long, page long, content long, token long, path long, kind int, times int, letters long, linked long"


def page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens of pages (host, page, html); content is a hash of all of a page's content."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    held: list[tuple] = []
    for batch in batches:
        for host, number, source in zip(batch["host"], batch["page"], batch["html"]):
            page = Page(source or "")
            whole = digest("\n".join(b[1] for b in page.blocks if b[3]))
            held += [(host, number, whole, token, *rest) for token, rest in page.tokens().items()]
            if len(held) >= HELD:
                yield pd.DataFrame(held, columns=names)
                held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; of another text, or null, the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def classes(pages: DataFrame) -> DataFrame:
    """(host, pages, members) for the equivalence classes of the tokens of pages (host, page, html) that have an element and come
    in PAGES pages or more, not all of the same content; members: array of (token, path, kind, letters, linked)."""
    t = pages.mapInPandas(page_tokens, TOKENS)
    h = F.xxhash64("page", "times")
    # A vector is two sums of 31 bits of a hash for each page, so that they hold four billion pages.
    vector = [F.sum(F.shiftrightunsigned(h, 33)).alias("v0"), F.sum(h.bitwiseAND(F.lit(2**31 - 1))).alias("v1")]
    of = t.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), *vector, F.min("content").alias("d0"), F.max("content").alias("d1"), F.min("path").alias("path"), F.min("kind").alias("kind"), F.sum("letters").alias("letters"), F.sum("linked").alias("linked"))
    of = of.where((F.col("pages") >= PAGES) & (F.col("d0") != F.col("d1")))
    grouped = of.groupBy("host", "pages", "v0", "v1").agg(F.min("kind").alias("least"), F.collect_list(F.struct("token", "path", "kind", "letters", "linked")).alias("members"))
    return grouped.where(F.col("least") < TEXT).select("host", "pages", "members")


class Template:
    """The nested classes of a host: region, the element whose slots are the main text (None: no template); fixed, the texts and
    words that are the template's own; dropped, the elements that are menus or little slots."""

    def __init__(self, found: list[list[tuple[int, int, int, int, int]]]):
        self.of: dict[int, int] = {}
        self.up: dict[int, int] = {}
        self.kind: dict[int, int] = {}
        self.letters: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        for k, members in enumerate(found):
            for token, path, kind, letters, linked in members:
                if kind < TEXT:
                    self.of[token], self.up[token], self.kind[token], self.letters[token], self.linked[token] = k, path, kind, letters, linked
        self.nested = self.nest(len(found))
        self.fixed = sorted({token for k, members in enumerate(found) if k in self.nested for token, path, kind, _, _ in members if kind >= TEXT and self.holds(k, path)})
        self.below: dict[int, list[int]] = {}
        for p, up in self.up.items():
            self.below.setdefault(up, []).append(p)
        self.dropped: list[int] = []
        self.region = self.main()
        for p in self.of:
            if self.kind[p] == MARKED and self.of[p] in self.nested:
                self.dropped.append(p)
            if self.linked[p] > LINKS * max(self.letters[p], 1) and not any(self.kind[q] == ARTICLE for q in self.above(p)):
                self.dropped.append(p)
        self.dropped = sorted(set(self.dropped) - set(self.above(self.region) if self.region is not None else ()))

    def above(self, p: int) -> list[int]:
        """p and the elements above it, outward."""
        out = []
        while p in self.of:
            out.append(p)
            p = self.up[p]
        return out

    def nest(self, n: int) -> dict[int, int | None]:
        """{class: the class that it hangs in, or None}, of the valid classes."""
        hangs: dict[int, set] = {k: set() for k in range(n)}
        for p, k in self.of.items():
            if self.of.get(self.up[p]) != k:
                hangs[k].add(self.of.get(self.up[p]))
        return {k: next(iter(over)) for k, over in hangs.items() if len(over) == 1}

    def holds(self, k: int, path: int) -> bool:
        """Whether an element of the class is at the path or above it."""
        while path in self.of:
            if self.of[path] == k:
                return True
            path = self.up[path]
        return False

    def main(self) -> int | None:
        articles = [p for p, kind in self.kind.items() if kind == ARTICLE and self.letters[p]]
        if articles:
            common = self.above(articles[0])
            for p in articles[1:]:
                mine = set(self.above(p))
                common = [q for q in common if q in mine]
            return common[0] if common else None
        tops = [p for p in self.of if self.up[p] not in self.of and self.letters[p]]
        if not tops:
            return None
        at = max(tops, key=lambda p: (self.letters[p], p))
        while True:
            kids = [p for p in self.below.get(at, ()) if self.letters[p]]
            if not kids:
                return at
            heavy = max(kids, key=lambda p: (self.letters[p], p))
            others = [p for p in kids if p != heavy]
            if self.of[heavy] not in self.nested or self.of[heavy] != self.of[at] or self.letters[heavy] < HEAVY * self.letters[at] or not self.below.get(heavy):
                return at
            little = [p for p in others if self.kind[p] != HEADING and self.letters[p] < LITTLE * self.letters[heavy]]
            self.dropped += little
            own = self.letters[at] - sum(self.letters[p] for p in kids)
            if len(little) < len(others) or own:
                return at
            at = heavy


def templates(pages: DataFrame) -> DataFrame:
    """(host, region, dropped, fixed) for each host of pages (host, page, html) with a template."""

    def deduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, found in zip(batch["host"], batch["found"]):
                by_class: dict[int, list] = {}
                for m in found:
                    by_class.setdefault(m["class"], []).append(tuple(m[c] for c in ("token", "path", "kind", "letters", "linked")))
                t = Template(list(by_class.values()))
                if t.region is not None:
                    rows.append((host, t.region, t.dropped, t.fixed))
            yield pd.DataFrame(rows, columns=["host", "region", "dropped", "fixed"])

    # Classes with an element: no more than the paths that PAGES pages of the host share.
    hosts = classes(pages).groupBy("host").agg(F.sort_array(F.collect_list("members")).alias("found"))
    flat = F.flatten(F.transform("found", lambda c, k: F.transform(c, lambda m: F.struct(k.alias("class"), *(m[x].alias(x) for x in ("token", "path", "kind", "letters", "linked"))))))
    return hosts.select("host", flat.alias("found")).mapInPandas(deduce, "host long, region long, dropped array<long>, fixed array<long>")


def slots(source: str | None, region: int | None, dropped, fixed) -> str:
    """The text of a page's main slots, by its host's template where the page has the region, else by its elements alone."""
    page = Page(source or "")
    if region is None or region not in page.elements:
        content = [b for b in page.blocks if b[3]]
        return "\n".join(b[1] for b in [b for b in content if b[4]] or content)
    inside, out, own = page.below({region}), page.below(set(dropped)), set(fixed)
    kept, repeated = [], 0
    total = sum(len(b[1]) for b in page.blocks if b[3] and b[0] in inside)
    marked = []
    for (path, text, _, content, article), (_, _, words) in zip(page.blocks, page.words()):
        if not content or path not in inside or path in out:
            continue
        same = digest(text, path ^ TEXT) in own
        if not article and words and sum(digest(w, path ^ WORD) in own for w in words) >= WORDY * len(words):
            same = True
        repeated += len(text) * same
        marked.append((text, same))
    copies = repeated > COPIES * total
    kept = [text for text, same in marked if copies or not same]
    return "\n".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points). Null and empty html gives an empty text;
    pages with no host, or of a host with no template, are read by their elements alone; equal rows stay apart; an empty
    table gives an empty one. Templates of no more than `broadcast_bytes` are broadcast, others joined by salted hosts."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    name = host_of(F.col("url"))
    rows = rows.withColumn("host", F.when(name != "", F.xxhash64(name)))
    found = materialize(templates(rows.where("host IS NOT NULL").select("host", F.xxhash64("page_id", "url").alias("page"), "html")), "templates")
    size = found.agg(F.sum(64 + 8 * (F.size("dropped") + F.size("fixed")))).first()[0] or 0

    @F.pandas_udf("string")
    def fill(page: pd.Series, region: pd.Series, dropped: pd.Series, fixed: pd.Series) -> pd.Series:
        return pd.Series([slots(p, None if d is None else int(r), d, f) for p, r, d, f in zip(page, region, dropped, fixed)], dtype=object)

    if size <= broadcast_bytes:
        out = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    out = out.select("page_id", "url", fill("html", F.coalesce("region", F.lit(0).cast("long")), "dropped", "fixed").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
