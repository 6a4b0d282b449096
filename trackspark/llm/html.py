"""Operator 8: main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node per path of (tag, class) from the body down.
A node's presentation importance is the entropy of the child sequences it shows on the host's pages,
its content importance falls with the share of pages that repeat its texts; the importance of a branch
mixes those of all nodes below it, nearer ones counting more.  How far it moves from one half, either way, grows
with the number of pages that show the node.  From each page the branches of low importance are removed.

Entropy alone cannot tell an article from a menu that differs on every page, so importance is mixed with a prior
of the style itself, with which every branch is decided by one sum: 0 for tags and whole class names of menus, headers,
footers, adverts, forms and the like, 1 for articles, ``INSIDE`` for what lies in them, ``BESIDE`` for unmarked
blocks on pages that have an article, ``NEUTRAL`` for anything else.  So an unmarked block beside an article
stays if its texts differ from page to page, and one inside an article goes if they are the same on many pages.
Names that speak both for and against a branch (``post share``, ``content-widget-list``) prove nothing: such a branch
goes beside an article, counts as ``BESIDE`` next to other text, and as ``NEUTRAL`` where a page has nothing else.
A page whose article would lose all its text keeps the article.

Trees are sums over (host, path, feature) rows, added up within tasks first, so that a host with a third
of all pages is spread like others.  Only the list of removed branches goes back to the pages: broadcast while it
has at most ``BROADCAST_PATHS`` rows, joined on the host beyond.

Cases: null html gives an empty text; a host with one page is decided by the priors; a null or odd url counts as host ''; repeated pages count as pages of their own; broken
nesting is closed where a block tag demands it; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Weight of the prior against the style tree's importance, and the least sum that is kept.
PRIOR_WEIGHT = 0.6
LEAST = 0.49
BOILER, DOUBTFUL, BESIDE, NEUTRAL, INSIDE, MAIN = 0.0, 0.1, 0.25, 0.5, 0.7, 1.0
#: What a node one level further down counts against one above.
DECAY = 0.9
BROADCAST_PATHS = 50_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes open elements of the value.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOILER_TAGS = frozenset("nav footer aside form menu head script style noscript template iframe select button textarea dialog svg object label input title".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply rss search share sharing sidebar signup social sponsor sponsored subscribe tagcloud toolbar widget widgets".split())
#: Words that may stand beside those above in the name of a class or id.
FILLER_WORDS = frozenset("area bar block bottom box button container content form inner item items left link links list main outer right row section top wrap wrapper".split())
MAIN_WORDS = frozenset("article articlebody entry post story".split())
MAIN_FILLER = frozenset("body container content inner main text wrap wrapper".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: In the name of a class or id, these speak for content too, though not as loud as those above.
CONTENT_WORDS = frozenset("content main text".split())
CONTAINERS = frozenset("article div main section td".split())
#: Elements that class names say nothing about.
WHOLE = frozenset("html body main article".split())


def _named(name: str, words: frozenset[str], filler: frozenset[str]) -> bool:
    """Whether a whole class name or id consists of such words: ``post-body``, but not ``no-ad``."""
    parts = {x for x in _WORDS.findall(name) if not x.isdigit()}
    return not parts.isdisjoint(words) and parts <= words | filler


def _prior(tag: str, attrs: str, outer: float) -> tuple[str, float]:
    """Style label of an element, and the prior of its branch inside one of prior ``outer``."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
    classes, own_id, role = sorted(found.get("class", "").lower().split()), found.get("id", "").lower().strip(), found.get("role", "").lower()
    names = [*classes, own_id] if own_id else classes
    boiler = tag not in WHOLE and any(_named(x, BOILER_WORDS, FILLER_WORDS) for x in names)
    hidden = "hidden" in found or "hidden" in _ATTR.sub(" ", attrs).lower().split()
    header = tag == "header" or "header" in names
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    main = main or tag in CONTAINERS and any(_named(x, MAIN_WORDS, MAIN_FILLER) for x in names)
    # what speaks for or against a branch is a part of its style
    marks = [x for x, is_so in ((f"#{own_id}", boiler or main or header), (f"@{role}", role), ("?hidden", hidden)) if is_so and len(x) > 1]
    label = ".".join([tag, *classes]) + "".join(marks)
    if outer == BOILER or tag in BOILER_TAGS or role in BOILER_ROLES or hidden:
        return label, BOILER
    if boiler:
        own_words = {w for x in names for w in _WORDS.findall(x)}
        return label, DOUBTFUL if tag in CONTAINERS and (main or not own_words.isdisjoint(CONTENT_WORDS)) else BOILER
    if outer in (MAIN, INSIDE):
        return label, INSIDE
    if header:
        return label, BOILER
    return label, MAIN if main else outer


class Page:
    """Blocks of text with the style path and prior of where they stand, and each node's child sequences."""

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[str, float, str]] = []
        self.children: dict[str, list[str]] = {}
        self._stack: list[tuple[str, str, float]] = [("", "", NEUTRAL)]  # tag, path, prior
        self._text: list[str] = []
        self._where: tuple[str, float] | None = None
        self._parse(source or "")

    def _flush(self) -> None:
        if self._text and (text := " ".join("".join(self._text).split())):
            self.blocks.append((*self._where, text))
        self._text, self._where = [], None

    def _say(self, text: str) -> None:
        if self._where is None and text.strip():
            # a block belongs to its nearest block element; inline elements inside may still be dropped
            self._where = next((p, w) for t, p, w in reversed(self._stack) if t in BLOCK or not t)
        if self._where is not None or self._text:
            if self._stack[-1][2] != BOILER or self._where[1] == BOILER:
                self._text.append(text)

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                del self._stack[i:]
                return
            if self._stack[i][0] in stop:
                return

    def _parse(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._say(entities.unescape(source[at : m.start()]))
            at = m.end()
            if m[1] is not None:
                self._say(m[1])
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if m[2]:
                if tag in BLOCK:
                    self._flush()
                self._close({tag})
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in BLOCK:
                self._flush()
                if tag not in ("html", "body", "head", "option"):
                    self._close({"p"}, frozenset(("td", "th", "li", "div", "article", "section", "blockquote")))
                if tag in CLOSES:
                    self._close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
            _, path, outer = self._stack[-1]
            label, prior = _prior(tag, m[4], outer)
            self.children.setdefault(path, []).append(label)
            if tag == "br":
                self._say(" ")
            if tag not in VOID and not m[4].endswith("/"):
                self._stack.append((tag, f"{path}/{label}", prior))
        if at < len(source):
            self._say(entities.unescape(source[at:]))
        self._flush()
        found = {p for _, p, _ in self.blocks}
        if any(p >= INSIDE for p in found):
            means = {NEUTRAL: BESIDE, DOUBTFUL: BOILER}
        else:
            means = {DOUBTFUL: BESIDE if NEUTRAL in found else NEUTRAL}
        self.blocks = [(path, means.get(p, p), text) for path, p, text in self.blocks]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def text_of(page: Page, removed: frozenset[str] | set[str] | None = None) -> str:
    """The blocks that stay, joined.

    ``removed``: paths of branches that the host's tree removes; None: no tree, so only the priors speak."""
    if removed is None:
        gone = [mixed(prior, 0.5) < LEAST for _, prior, _ in page.blocks]
    else:
        gone = [any(path[:i] in removed for i, c in enumerate(path + "/") if c == "/") for path, _, _ in page.blocks]
    main = [prior >= INSIDE for _, prior, _ in page.blocks]
    if any(main) and all(g for g, m in zip(gone, main, strict=True) if m):
        gone = [g and not m for g, m in zip(gone, main, strict=True)]
    return "\n".join(text for (_, _, text), g in zip(page.blocks, gone, strict=True) if not g)


def mixed(prior, importance):
    """The sum that decides: of numbers or of columns."""
    return PRIOR_WEIGHT * prior + (1 - PRIOR_WEIGHT) * importance


STATS = "host string, path string, kind string, feature long, n long, prior double"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STATS, summed within a batch.  kind p: pages with the node; c: a child sequence; t: a text."""
    for batch in batches:
        tally: Counter = Counter()
        priors: dict[tuple[str, str], float] = {}
        for url, source in zip(batch.column(0), batch.column(1), strict=True):
            page, host = Page(source.as_py()), host_of(url.as_py())
            seen = set()
            for path, labels in page.children.items():
                seen |= {(path, "p", 0), (path, "c", _number(",".join(labels)))}
            for path, prior, text in page.blocks:
                seen |= {(path, "p", 0), (path, "t", _number(text))}
                priors[host, path] = max(prior, priors.get((host, path), 0.0))
            tally.update((host, *x) for x in seen)
        rows = [(*k, n, priors.get(k[:2])) for k, n in tally.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "kind", "feature", "n", "prior"])


def _number(text: str) -> int:
    data = common.as_bytes(text)
    return 0 if not len(data) else int(common.prefix_hash(data)[-1].astype("int64"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance, prior (the greatest in the branch): one row per node of each host's style tree."""
    rows = pages.select("url", "html").mapInArrow(_statistics, STATS)
    merged = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("prior").alias("prior"))
    # pages of the host that have the node stand on its own row; the rest is summed beside it
    x_log = F.col("n") * F.log(F.col("n"))
    nodes = merged.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "p", F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == "c", F.col("n"))).alias("c_n"),
        F.sum(F.when(F.col("kind") == "c", x_log)).alias("c_x"),
        F.sum(F.when(F.col("kind") == "t", F.col("n"))).alias("t_n"),
        F.sum(F.when(F.col("kind") == "t", x_log)).alias("t_x"),
        F.max("prior").alias("prior"),
    )
    m = F.log(F.col("pages"))
    # entropy of the child sequences, in units of the most that so many pages can show; one shape for all says nothing
    shown = F.when((F.col("pages") > 1) & (F.col("c_n") > 0), 0.5 + 0.5 * (F.log("c_n") - F.col("c_x") / F.col("c_n")) / m)
    # one minus the mean entropy of the texts over the pages that show them: log f / log m
    told = F.when((F.col("pages") > 1) & (F.col("t_n") > 0), 1 - F.col("t_x") / F.col("t_n") / m)
    # a few pages prove little: the value moves from one half by the square of 1 - 1 / pages
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(told, shown, F.lit(0.5))))
    own = nodes.select("host", "path", "pages", "prior", (0.5 + (value - 0.5) * F.pow(1 - 1 / F.col("pages"), 2)).alias("own"))
    # every node counts for each branch that it lies in
    depth = F.size(F.split("path", "/"))
    above = own.withColumn("up", F.explode(F.sequence(F.lit(1), depth))).select(
        "host", F.array_join(F.slice(F.split("path", "/"), 1, F.col("up")), "/").alias("path"),
        (F.col("pages") * F.pow(F.lit(DECAY), depth - F.col("up"))).alias("w"), "own", "prior",
        F.when(F.col("up") == depth, F.col("pages")).alias("pages"),
    )
    return above.groupBy("host", "path").agg(F.max("pages").alias("pages"), (F.sum(F.col("w") * F.col("own")) / F.sum("w")).alias("importance"), F.max("prior").alias("prior"))


def removed_branches(tree: DataFrame) -> DataFrame:
    """host, path of the branches that are, like everything below them, of low importance."""
    depth = F.size(F.split("path", "/"))
    branch = F.array_join(F.slice(F.split("path", "/"), 1, F.col("up")), "/").alias("path")
    above = tree.withColumn("up", F.explode(F.sequence(F.lit(1), depth))).select("host", branch, mixed(F.col("prior"), F.col("importance")).alias("sum"))
    return above.groupBy("host", "path").agg(F.max("sum").alias("most")).where(F.col("most") < LEAST).select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    spark = pages.sparkSession
    removed = common.materialise(removed_branches(style_tree(pages)), "html-removed")
    source = pages.select("page_id", "url", "html")
    types = common.extended(source.select("page_id", "url"), "text string")
    if removed.count() <= BROADCAST_PATHS:
        by_host: dict[str, set[str]] = {}
        for host, path in removed.collect():
            by_host.setdefault(host, set()).add(path)
        shipped = common.Shipped(spark, by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shipped.get()
            for batch in batches:
                texts = [text_of(Page(s.as_py()), own.get(host_of(u.as_py()), frozenset())) for u, s in zip(batch.column(1), batch.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return source.mapInArrow(run, types)

    lists = removed.groupBy("host").agg(F.collect_set("path").alias("_op_removed"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = source.withColumn("_op_host", host).join(lists, F.col("_op_host") == lists["host"], "left").select("page_id", "url", "html", "_op_removed")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(Page(s.as_py()), set(r.as_py() or ())) for s, r in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run_joined, types)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
