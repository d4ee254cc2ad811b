"""Main text of web pages by consensus host paths.

1. Each page is read once; its containers are scored by the text they hold, and the
   page votes for its best one, named by a generalised path: tags with their classes,
   digits replaced, so that `div.post-17` and `div.post-18` are the same. Layout wrappers
   below an article or main don't stand for it: the vote goes to the nearest article or
   main around the best container, or else to the nearest named main container.
2. Spark counts the votes per host (map-side combined, so a host with a third of all
   pages is no burden) and keeps each host's winning path.
3. Each page is read again and the text below its host's winning path is taken. A page
   without that path uses its own best container.

Inside the container, menus, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by tag, role or whole class name. A name counts when all
its words are such words or say where or how (`site-footer`; not `has-sidebar` or
`related-work`). Ids count alike, but not on headings, nor on sections of an article;
words that may name a text's own subject don't count on its paragraphs and headings.
What a class or id, a form or a role would leave out is kept all the same when it holds
`main` or the page's longest `article`, and what a layout word names (`sidebar`) when it
holds most of the page's unlinked text and is in an article, or no article has text; other
words (`ad`, `comments`) only where no main container has text. Character references are
decoded, white space inside a block becomes one space, blocks are joined by one line break
in page order; nothing else is dropped.

Defined results: null, empty or text-free pages give an empty text; a null URL, or one
without `://`, is the host ''; votes that tie go to the path first in order; repeated
rows give repeated output rows; broken markup is read as browsers do in the simple
cases (open paragraphs end where a block starts, unknown end tags are ignored).
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from riskgate.llm.arrow import map_texts, texts_of
from riskgate.llm.storage import stored
from riskgate.llm.url_filter import url_host

# What markup means.
CONTAINERS = frozenset("html body main article section div header footer nav aside form ul ol dl table tbody thead tfoot "
                       "tr figure fieldset blockquote details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr figcaption caption address summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Left out and holding no blocks of the page: a block's start ends them if they are open.
SEALED = frozenset("svg select".split())
DROPPED = RAW | SEALED | frozenset("noscript template object head nav footer aside form button canvas audio video dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments "
    "commentlist disqus respond replies sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets pagination pager toolbar".split())
#: Words that don't tell by themselves what an element is.
PLACE_WORDS = frozenset(
    "site page main primary secondary left right top bottom global inner outer box bar block blocks list item items area "
    "container wrapper wrap section panel link links button buttons inline fixed sticky mobile desktop unit slot group row "
    "post posts article articles blog author google form js c l o wp".split())
#: Words of the page's frame, which may name a wrapper of the text.
LAYOUT_WORDS = frozenset("sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer banner popup modal "
                         "overlay social related recommended recommendations widget widgets toolbar pagination pager".split())
#: Words that a text may use for its own paragraphs.
SUBJECT_WORDS = frozenset("comment comments notice notices related respond replies consent banner recommended promotion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("article content post entry story main text body".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
            "tr": ("tr", "td", "th"), "option": ("option",)}
MAIN_FACTOR = 3
ANCESTOR_FACTOR = 0.5

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*)/?>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Chain:
    """Paths in a tree by number: each but 0, the empty one, is its parent and one value more.
    Parents have smaller numbers, so sums and flags pass along in one loop."""

    def __init__(self):
        self.parent, self.value = [0], [None]
        self.known: dict[tuple[int, object], int] = {}

    def step(self, at: int, value) -> int:
        number = self.known.setdefault((at, value), len(self.parent))
        if number == len(self.parent):
            self.parent.append(at)
            self.value.append(value)
        return number

    def values(self, at: int) -> tuple:
        """From the first to the last."""
        out = []
        while at:
            out.append(self.value[at])
            at = self.parent[at]
        return tuple(out[::-1])

    def summed(self, own: list[float], share: float = 1.0) -> list[float]:
        """Each path's own amount and the share that its extensions hand on."""
        out = list(own)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += share * out[k]
        return out


class Element(NamedTuple):
    """An open element: the number of its path, whether its content is left out for sure
    (dropped) or unless it turns out to hold the main text (doubts: the number of the chain
    of such elements around), and the chain of article and main elements around."""
    tag: str
    path: int
    dropped: bool
    main: bool
    link: bool
    in_article: bool = False
    doubts: int = 0
    articles: int = 0


class Found(NamedTuple):
    """A block and what is around it."""
    path: int
    text: str
    linked: float
    doubts: int
    articles: int


class Page:
    """The blocks of a page and the chains that their numbers mean."""

    def __init__(self):
        self.paths, self.doubts, self.articles = Chain(), Chain(), Chain()
        self.found: list[Found] = []


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values, read from left to right; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _names(raw: str, words: frozenset[str]) -> bool:
    """Whether one of the names has no words but these and those of place, and one of these."""
    return any((parts := set(_WORD.findall(name))) and not parts.isdisjoint(words) and parts <= words | PLACE_WORDS
               for name in raw.split())


@lru_cache(4096)
def _is_main(step: str) -> bool:
    """Whether a step of a path is an article, a main or a named main container."""
    tag, *classes = step.split(".")
    return tag in ("article", "main") or (tag not in ("html", "body")
                                          and any(w in MAIN_WORDS for c in classes for w in _WORD.findall(c)))


def _opened(page: Page, tag: str, raw: str, parent: Element, number: int) -> Element:
    path, dropped, main, doubts, articles = parent.path, parent.dropped, parent.main, parent.doubts, parent.articles
    has = _attributes(raw) if raw and not raw.isspace() else {}
    classes, own_id = has.get("class", "").lower(), has.get("id", "").lower()
    words = set(_WORD.findall(classes + " " + own_id))
    free, inline = tag in ("html", "body", "article", "main"), parent.main and (tag not in CONTAINERS or tag == "blockquote")
    named = False
    if not dropped:
        ids = "" if tag in HEADINGS or inline or (parent.in_article and tag == "section") else own_id
        names, subject = f"{classes} {ids}", SUBJECT_WORDS if inline or tag in HEADINGS else frozenset()
        named = _names(names, DROPPED_WORDS - subject)
        dropped = ((tag in DROPPED and tag != "form") or (tag == "header" and not main) or "hidden" in has
                   or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "").lower())
        if tag == "form" or has.get("role", "").lower() in DROPPED_ROLES:
            doubts = page.doubts.step(doubts, (number, "form"))
        elif not free and (named or (not main and _names(names, frozenset(["header"])))):
            kind = "reader" if _names(names, DROPPED_WORDS - LAYOUT_WORDS - subject) else "part" if parent.in_article else "layout"
            doubts = page.doubts.step(doubts, (number, kind))
    if tag in CONTAINERS:
        path = page.paths.step(path, ".".join([tag, *(re.sub(r"\d+", "#", c) for c in classes.split())]))
        main = main or tag in ("article", "main") or not words.isdisjoint(MAIN_WORDS)
        if tag == "main" or (tag == "article" and not named):
            articles = page.articles.step(articles, (tag, number, doubts))
    return Element(tag, path, dropped, main, parent.link or tag == "a", parent.in_article or tag in ("article", "main"),
                   doubts, articles)


def _along(chain: Chain, own: list[bool], every: bool) -> list[bool]:
    """For each path whether all (every) or any of its steps have the flag."""
    out = [every] * len(own)
    for k in range(1, len(own)):
        out[k] = (own[k] and out[chain.parent[k]]) if every else (own[k] or out[chain.parent[k]])
    return out


def _kept(page: Page) -> list[Found]:
    """Without the blocks of elements in doubt, but for elements that hold the main text."""
    found, doubts, articles = page.found, page.doubts, page.articles
    if not any(x.doubts for x in found):
        return found
    worth = [[0.0] * len(c.parent) for c in (doubts, articles)]  # unlinked text below elements in doubt and articles
    for x in found:
        for own, k in zip(worth, (x.doubts, x.articles), strict=True):
            own[k] += len(x.text) * (1 - x.linked)
    in_doubt, in_articles = (c.summed(own) for c, own in zip((doubts, articles), worth, strict=True))
    used = [False] * len(articles.parent)
    for x in found:
        used[x.articles] = True
    for k in range(len(used) - 1, 0, -1):
        used[articles.parent[k]] |= used[k]
    longest = max((k for k in range(1, len(used)) if used[k] and articles.value[k][0] == "article"),
                  key=lambda k: (in_articles[k], -k), default=0)
    # around a main or the longest article is what was open when it was opened
    saved = [False] * len(doubts.parent)
    for k in range(1, len(used)):
        if used[k] and (k == longest or articles.value[k][0] == "main"):
            around = articles.value[k][2]
            while around and not saved[around]:
                saved[around] = True
                around = doubts.parent[around]
    sure = _along(doubts, saved, every=True)
    mains = _along(page.paths, [bool(k) and _is_main(v) for k, v in enumerate(page.paths.value)], every=False)
    in_article = any(x.articles for x in found if sure[x.doubts])
    in_main = any(mains[x.path] for x in found if sure[x.doubts])
    blocked = {"form"} | ({"layout"} if in_article else set()) | ({"reader"} if in_article or in_main else set())
    for k in range(1, len(saved)):
        saved[k] |= doubts.value[k][1] not in blocked and in_doubt[k] > in_doubt[0] / 2
    sure = _along(doubts, saved, every=True)
    return [x for x in found if sure[x.doubts]]


def blocks(html: str) -> Page:
    """The blocks of a page that are not left out, in page order: the number of the
    container's path, the text, and the share of it inside links."""
    page = Page()
    stack = [Element("", page.paths.step(0, "page"), False, False, False)]
    open_: dict[str, int] = defaultdict(int)
    text: list[str] = []
    linked = at = number = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join("".join(text).split())
            if clean:
                top = stack[-1]
                page.found.append(Found(top.path, clean, min(1.0, linked / len(clean)), top.doubts, top.articles))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.dropped:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if top.link:
                linked += len(raw)

    def end(k: int) -> None:
        for element in stack[k:]:
            open_[element.tag] -= 1
        del stack[k:]

    def close(tags: tuple[str, ...]) -> None:
        """Pop the nearest of these elements within the current container."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                end(k)
                return
            if stack[k].tag in CONTAINERS:
                return

    def unseal() -> None:
        """End what can hold no block."""
        while any(open_[t] for t in SEALED):
            end(max(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in SEALED))

    while (m := _TOKEN.search(html, at)) is not None:
        add(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    if stack[k].dropped or stack[-1].doubts != stack[k - 1].doubts:
                        flush()
                    end(k)
                    break
                if stack[k].tag in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag in BLOCKS:
            flush()
            unseal()
            close(ENDED_BY.get(tag, ()))
            close(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
        elif tag == "br":
            add(" ")
        raw = m[3] or ""
        # in svg, and for svg itself, a slash closes the element; elsewhere in HTML it means nothing
        if tag in VOID or ((tag == "svg" or open_["svg"]) and raw.endswith("/")):
            continue
        if tag in RAW:
            ended = _RAW_END[tag].search(html, at)
            at = ended.end() if ended else len(html)
            continue
        number += 1
        element = _opened(page, tag, raw, stack[-1], number)
        if (element.dropped and not stack[-1].dropped) or element.doubts != stack[-1].doubts:
            flush()
        stack.append(element)
        open_[tag] += 1
    add(html[at:])
    flush()
    page.found = _kept(page)
    return page


def best_path(page: Page) -> tuple[str, ...] | None:
    """The container that holds most of the text: its own blocks count in full, those
    of inner containers by half for each level, and named main containers threefold.
    From there up to the nearest article or main, or else to the nearest named one."""
    paths = page.paths
    own, has = [0.0] * len(paths.parent), [False] * len(paths.parent)
    for x in page.found:
        own[x.path] += len(x.text) * (1 - x.linked)
        has[x.path] = True
    for k in range(len(has) - 1, 0, -1):
        has[paths.parent[k]] |= has[k]
    score = paths.summed(own, ANCESTOR_FACTOR)
    scored = {k: score[k] * (MAIN_FACTOR if _is_main(paths.value[k]) else 1) for k in range(1, len(has)) if has[k]}
    if not scored:
        return None
    most = max(scored.values())
    best = min((k for k, v in scored.items() if v == most), key=paths.values) if most else min(scored, key=paths.values)
    at, named = best, 0
    while at:
        if paths.value[at].split(".")[0] in ("article", "main"):
            return paths.values(at)
        named = named or (at if _is_main(paths.value[at]) else 0)
        at = paths.parent[at]
    return paths.values(named or best)


def text_below(page: Page, path: tuple[str, ...]) -> str | None:
    """The text of the blocks below a path, or None where the page has none there."""
    top = 0
    for step in path:
        top = page.paths.known.get((top, step), -1)
        if top < 0:
            return None
    below = _along(page.paths, [k == top for k in range(len(page.paths.parent))], every=False)
    own = [x.text for x in page.found if below[x.path]]
    return "\n".join(own) if own else None


_VOTE = StructType([StructField("path", ArrayType(StringType()))])
_TEXT = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path) with the most votes of each host."""
    def make():
        return lambda texts: {"path": [best_path(blocks((t or b"").decode("utf-8", "replace"))) for t in texts]}

    votes = map_texts(pages, {"host": url_host(F.col(url))}, F.col(html), make, _VOTE).where(F.col("path").isNotNull())
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    # the least (-votes, path) of a host is its most voted path, the first in order among equals
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("best")) \
        .select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, the main text and its length in code points."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"),
                        url_host(F.col(url)).alias("host"))
    # written first, so that Spark knows its size: a small table is broadcast and no page is moved
    paths = stored(host_paths(pages, url, html), "host-paths")
    rows = base.join(paths, "host", "left").select("page_id", "url", "path", "html")
    schema = StructType([*rows.schema.fields[:2], *_TEXT.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from riskgate.llm.arrow import slices

        target = to_arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole, 3):
                texts = []
                for path, raw in zip(batch.column(2).to_pylist(), texts_of(batch.column(3)), strict=True):
                    found = blocks((raw or b"").decode("utf-8", "replace"))
                    got = text_below(found, tuple(path)) if path is not None else None
                    if got is None:
                        own = best_path(found)
                        got = text_below(found, own) if own else ""
                    texts.append(got or "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(target.field(0).type), batch.column(1).cast(target.field(1).type),
                     pa.array(texts, target.field(2).type), pa.array([len(t) for t in texts], pa.int64())], schema=target)

    return rows.mapInArrow(run, schema)
