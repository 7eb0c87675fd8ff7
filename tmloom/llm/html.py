"""Main text of pages by a style tree of each site."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tmloom.llm.urls import host_of
from tmloom.operators.scale import materialize

MIN_PAGES = 4  # a node seen on fewer pages of its site is judged by its markup alone
MIN_IMPORTANCE = 0.3
DAMPING = 0.9  # of what a node's branches add to its importance, once for each of its styles
EVERYWHERE = 0.8  # share of a node's pages on which a text within an article is a fixture of the site
MOST = 0.5  # of an article's letters; the tree never takes more
SAME_PAGE = 0.9  # share of letters in the longest texts, by which copies of a page are known
MAX_LINKED = 0.75  # share of a node's letters inside links, above which it is a menu

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names of HTML by how their content is laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
SPACING = {"br", "td", "th"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
# Elements and words of class, id and role that name parts around an article.
NOISE_TAGS = set(
    "nav footer aside form menu dialog button select label input head search".split()
) | RAW
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promotion related search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_TAGS = {"article", "main"}
UNNAMED = ARTICLE_TAGS | {"html", "body"}  # their names say nothing of their contents
_SCOPE = {"table", "ul", "ol", "dl", "select", "div", "article", "main", "section", "body"}


TEXT = -1  # stands for a text among the children of a node
# First words that turn the meaning of a compound name (has-sidebar), and names too common to tell alone.
TURNING = set("has have no non not with without hide hides show".split())
WEAK_WORDS = set("notice notices search".split())


class Block:
    """A text block of a page: the path of style nodes it stands at, noise mark, linked letters."""

    __slots__ = ("article", "linked", "noise", "path", "suspects", "text")

    def __init__(self, text, path, noise, article, linked, suspects):
        self.text, self.path, self.noise, self.article, self.linked = text, path, noise, article, linked
        self.suspects = suspects

    @property
    def node(self) -> int:
        return self.path[-1]


class Element:
    """A block element with text in it: its path, whether it is a frame of pages, and its children in order."""

    __slots__ = ("children", "frame", "path")

    def __init__(self, path, frame):
        self.path, self.frame, self.children = path, frame, []


def page_blocks(source: str | None) -> list[Block]:
    return parsed(source)[0]


def parsed(source: str | None) -> tuple[list[Block], list[Element]]:
    """Cut a page into its blocks in page order, and list the elements they stand in.

    A style node is the path of element names and classes from the root.  End
    tags close the nearest open element of their name, and elements whose end
    may be left out close where HTML says so.  Contents of scripts, styles and
    the like are passed over whole.

    Noise by name are elements of NOISE_TAGS, and elements but html, body, main
    and article of which a whole class, id or role is in NOISE_WORDS.  If no
    article or main element of the page stands outside noise, those below a
    noise word are taken, so that a word never empties a page.  An element with
    such a word in a compound name (post-comments, ad-slot) is noise too if it
    holds no article, or another article stands outside all such elements; but
    not if the name's first word turns its meaning (has-sidebar), nor if
    nothing of the page would be left.  Compounds of WEAK_WORDS only leave the
    article around them, for the site's tree to judge.
    """
    source = source or ""
    lowered = None
    root = Element((0,), True)
    frames = [root]
    elements: list[Element] = []
    # name, has a frame, noise by element, by word, inside an article, inside one below a noise word, noise by word
    # in that, compound names around
    stack: list[tuple] = []
    links = 0
    barred = named = article = buried = inner = False
    suspects: tuple[int, ...] = ()
    holds: list[bool] = []  # of each compound name: an article
    outside = False  # an article that no compound name is around
    out: list[Block] = []
    below: list[bool] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                share = min(1.0, linked / len(text))
                out.append(Block(text, frames[-1].path, barred or named, article, share, suspects))
                below.append(buried and not barred and not inner)
                frames[-1].children.append(TEXT)
            parts.clear()
        linked = 0

    def pop_to(index: int):
        nonlocal barred, named, article, buried, inner, links, suspects
        for name, framed, *_ in reversed(stack[index:]):
            if name == "a":
                links -= 1
            if framed:
                closed = frames.pop()
                if closed.children:
                    elements.append(closed)
                    frames[-1].children.append(closed.path[-1])
        del stack[index:]
        _, _, barred, named, article, buried, inner, suspects = stack[-1] if stack else ("", 0, *[False] * 5, ())

    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        if found is None:
            parts.append(source[at:])
            break
        if found.start() > at:
            piece = source[at : found.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = found.end()
        closing, name, marks = found.group(1), found.group(2), found.group(3)
        if name is None:
            closing, name, marks = found.group(4), found.group(5), found.group(6)
            if name is None:
                continue
        name = name.lower()
        block = name in BLOCK
        if closing:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != name:
                depth -= 1
            if block:
                flush()
            if depth >= 0:
                pop_to(depth)
            continue
        if name in RAW:
            if not marks.rstrip().endswith("/"):
                if lowered is None:
                    lowered = source.lower()
                    if len(lowered) != end:  # a letter whose lower case is longer
                        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), source)
                stop = lowered.find(f"</{name}", at)
                at = end if stop < 0 else stop
            continue
        if block:
            flush()
            if name in CLOSES_P and stack and any(x[0] == "p" for x in stack):
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] != "p" and stack[depth][0] not in _SCOPE:
                    depth -= 1
                if depth >= 0 and stack[depth][0] == "p":
                    pop_to(depth)
            if name in CLOSES:
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in CLOSES[name] and stack[depth][0] not in _SCOPE:
                    depth -= 1
                if depth >= 0 and stack[depth][0] in CLOSES[name]:
                    pop_to(depth)
        if name in SPACING:
            parts.append(" ")
        if name in VOID:
            continue
        style = _CLASS.search(marks) if marks else None
        word = compound = weak = False
        if marks and name not in UNNAMED:
            for m in _MARK.finditer(marks):
                for whole in (m[1] or m[2] or m[3] or "").lower().split():
                    if whole in NOISE_WORDS:
                        word = True
                        continue
                    names = re.findall("[a-z0-9]+", whole)
                    telling = NOISE_WORDS.intersection(names)
                    if telling and names[0] not in TURNING:
                        compound = compound or not telling <= WEAK_WORDS
                        weak = weak or telling <= WEAK_WORDS
        if block:
            above = frames[-1].path
            label = f"{above[-1]}/{name}.{' '.join(sorted((style[1] or style[2] or style[3] or '').split())) if style else ''}"
            frames.append(Element((*above, xxhash.xxh64_intdigest(label) >> 1), name in UNNAMED))
        barred = barred or name in NOISE_TAGS or (name == "header" and not article and not buried)
        if name in ARTICLE_TAGS and not barred:
            if named:
                buried = True
            else:
                article = True
                outside = outside or not suspects
                for k in suspects:
                    holds[k] = True
        named, inner = named or word, inner or (buried and word)
        if compound:
            suspects = (*suspects, len(holds))
            holds.append(False)
        elif weak:
            article = buried = False
        links += name == "a"
        stack.append((name, block, barred, named, article, buried, inner, suspects))
    flush()
    pop_to(0)
    if root.children:
        elements.append(root)
    if not any(b.article and not b.noise for b in out):
        for b, taken in zip(out, below, strict=True):
            if taken:
                b.noise, b.article = False, True
    told = [b for b in out if not b.noise and any(outside or not holds[k] for k in b.suspects)]
    if len(told) < sum(not b.noise for b in out):
        for b in told:
            b.noise = True
    return out, elements


def content_key(block: Block) -> int:
    """A text at its style node: a content node of the site's tree."""
    return xxhash.xxh64_intdigest(f"{block.node}/{block.text}") >> 1


def page_key(blocks: list[Block]) -> int:
    """What copies of a page share: its longest texts, to SAME_PAGE of its letters."""
    texts = sorted({b.text for b in blocks if not b.noise}, key=lambda t: (-len(t), t))
    whole, letters, taken = sum(map(len, texts)), 0, xxhash.xxh64()
    for t in texts:
        if letters >= SAME_PAGE * whole:
            break
        letters += len(t)
        taken.update(f"{len(t)}/{t}")
    return taken.intdigest() >> 1


# What a row of the tree says of a node on a page.
SEEN, CONTENT, STYLE, CHILD = range(4)


def page_rows(blocks: list[Block], elements: list[Element]) -> list[tuple]:
    """(node, kind, key, share, linked letters, letters, path, frame): all that one page adds to its site's tree.

    A node is SEEN once, with its path; has each CONTENT (a text) once, each
    STYLE (its children in order) once, and CHILD rows with the share that each
    kind of child has of all its children on the page.
    """
    rows: dict[tuple, tuple] = {}
    children: dict[int, Counter] = {}
    for e in elements:
        node = e.path[-1]
        rows[node, SEEN, 0] = (1.0, 0.0, 0, e.path, e.frame)
        order = xxhash.xxh64_intdigest(np.array(e.children, np.int64).tobytes()) >> 1
        rows[node, STYLE, order] = (1.0, 0.0, 0, None, None)
        children.setdefault(node, Counter()).update(e.children)
    for node, counted in children.items():
        whole = counted.total()
        for child, n in counted.items():
            rows[node, CHILD, child] = (n / whole, 0.0, 0, None, None)
    for b in blocks:
        rows[b.node, CONTENT, content_key(b)] = (1.0, b.linked * len(b.text), len(b.text), None, None)
    return [(*key, *value) for key, value in rows.items()]


_ROWS = "host string, page long, node long, kind int, key long, share double, linked double, size long, path array<long>, frame boolean"


def style_tree(pages: DataFrame, host_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """All pages of a site merged: its nodes with their importance, and their contents.

    Copies of a page, also but for a small part (``page_key``), count as one.

    Nodes are (``host``, ``node``, ``pages``, ``frame``, ``importance``).  A
    node's own importance is the entropy of its styles over its pages, 1 on a
    single page: a part that always looks alike matters little.  Its contents
    matter as one less the mean entropy of a text over the node's pages (a text
    on all of them has entropy 1, a text of its own 0), less the share of
    letters inside links above MAX_LINKED.  ``importance`` joins both with the
    importance of the branches: own importance weighs 1 - DAMPING^styles, the
    rest goes to the children by their mean share.  As shares multiply along a
    path, a node's importance is one sum over the nodes below it.

    Contents are (``host``, ``node``, ``text``, ``n``, ``pages``), ``n`` being
    the pages with a text.
    """
    names = ["host", "page", "node", "kind", "key", "share", "linked", "size", "path", "frame"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(),
             pa.list_(pa.int64()), pa.bool_()]

    def run(batches):
        for batch in batches:
            out = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, elements = parsed(source)
                key = page_key(blocks)
                out += [(host, key, *row) for row in page_rows(blocks, elements)]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    seen = materialize(
        pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html"))
        .mapInArrow(run, _ROWS)
        .groupBy("host", "node", "kind", "key", "page")
        .agg(*[F.max(c).alias(c) for c in ("share", "linked", "size")], F.first("path").alias("path"), F.first("frame").alias("frame"))
        .groupBy("host", "node", "kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("share", "linked", "size")],
             F.first("path", True).alias("path"), F.first("frame", True).alias("frame")),
        "tree",
    )
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    n = F.col("n")
    sums = seen.groupBy("host", "node").agg(
        of(SEEN, n).alias("pages"), F.first("path", True).alias("path"), F.first("frame", True).alias("frame"),
        of(STYLE, F.lit(1)).alias("styles"), of(STYLE, n).alias("styled"), of(STYLE, n * F.log("n")).alias("alike"),
        of(CONTENT, n).alias("texts"), of(CONTENT, n * F.log("n")).alias("bits"),
        (of(CONTENT, F.col("linked")) / of(CONTENT, F.col("size"))).alias("linked"),
        F.coalesce(F.sum(F.when((F.col("kind") == CHILD) & (F.col("key") == TEXT), F.col("share"))), F.lit(0.0)).alias("own"),
        of(CHILD, F.col("share")).alias("children"),
    )
    single = F.col("pages") <= 1
    own = F.when(single, 1.0).otherwise((F.log("styled") - F.col("alike") / F.col("styled")) / F.log("pages"))
    entropy = F.when(single, 0.0).otherwise(F.least(F.lit(1.0), F.col("bits") / F.col("texts") / F.log("pages")))
    plain = F.when(F.col("linked") > MAX_LINKED, 0.0).otherwise(1.0)
    content = F.coalesce((1 - entropy) * plain, F.lit(0.0))
    passed = F.pow(F.lit(DAMPING), F.col("styles"))
    nodes = materialize(
        sums.select(
            "host", "node", "pages", "frame", "path", "children", passed.alias("passed"),
            ((1 - passed) * F.least(F.lit(1.0), own) + passed * F.col("own") / F.col("children") * content).alias("base"),
        ), "nodes",
    )
    host = F.coalesce("host", F.lit(""))
    edges = seen.where((F.col("kind") == CHILD) & (F.col("key") != TEXT)).select(
        host.alias("_host"), F.col("node").alias("_parent"), F.col("key").alias("_child"), "share"
    ).join(
        nodes.select(host.alias("_host"), F.col("node").alias("_parent"), "passed", "children"), ["_host", "_parent"]
    ).select("_host", "_child", F.log(F.col("passed") * F.col("share") / F.col("children")).alias("_weight"))
    # each node with every node of its path; the weight of the step into a node lies between it and its parent
    below = nodes.select(host.alias("_host"), "node", "base", F.posexplode("path").alias("_depth", "_child"))
    up = Window.partitionBy("_host", "node").orderBy(F.col("_depth").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = below.join(edges, ["_host", "_child"], "left").select(
        "_host", F.col("_child").alias("_above"),
        (F.col("base") * F.exp(F.coalesce(F.sum("_weight").over(up), F.lit(0.0)))).alias("_part"),
    )
    joined = weighed.groupBy("_host", "_above").agg(F.sum("_part").alias("importance"))
    judged = nodes.select("host", "node", "pages", "frame", host.alias("_host"), F.col("node").alias("_above")).join(
        joined, ["_host", "_above"]
    ).select("host", "node", "pages", "frame", "importance")
    contents = seen.where(F.col("kind") == CONTENT).select(
        host.alias("_host"), "node", F.col("key").alias("text"), "n"
    ).join(nodes.select("host", host.alias("_host"), "node", "pages"), ["_host", "node"])
    return judged, contents.select("host", "node", "text", "n", "pages")


def kept_blocks(blocks: list[Block], low: set[int], fixed: set[int]) -> tuple[list[Block], int, int]:
    """The blocks of a page that stay, and how many went by name and by the site's tree.

    ``low`` holds unimportant nodes and, outside articles, texts; ``fixed``
    texts that are fixtures of the site.  If that is more than MOST of the
    article's letters, pages of the site are alike and the article stays as it
    is; if nothing of the page would be left, the page does.
    """
    named = [b for b in blocks if not b.noise and (b.article or b.linked <= MAX_LINKED)]

    def goes(b: Block) -> bool:
        key = content_key(b)
        return key in fixed or (not b.article and key in low) or any(node in low for node in b.path)

    gone = {id(b) for b in named if goes(b)}
    letters = [len(b.text) for b in named if b.article]
    if sum(len(b.text) for b in named if b.article and id(b) in gone) > MOST * sum(letters):
        gone -= {id(b) for b in named if b.article}
    stay = [b for b in named if id(b) not in gone] or named
    return stay, len(blocks) - len(named), len(named) - len(stay)


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES
) -> DataFrame:
    """Every row with ``text``, its main text, instead of ``html_col``, and ``by_name`` and ``by_tree``, blocks gone.

    Columns of ``pages`` with these names give way.

    Names of elements, classes and ids are a first judgement: what they call a
    menu, header, footer, sidebar, notice, advert, form or comments goes (see
    ``parsed``).  Of the rest, in articles too, branches go that are seen on
    ``min_pages`` pages of their site and whose importance in the site's tree
    is below MIN_IMPORTANCE; outside articles also texts of that importance,
    and inside them texts on EVERYWHERE of the pages of their node (see
    ``kept_blocks``).  html, body, main and article are frames that the tree
    does not judge.  Nothing else is dropped.  Null and empty pages give the
    empty text; pages without host are one site.

    What is unimportant in a site is one row, written and joined by host to its
    pages: by broadcast while Spark sees the table small, else by a shuffle that
    splits a site with many pages.  Of m pages with b blocks each, at most b
    times m^0.3 texts can be among them.
    """
    sites = pages.withColumn("_host", host_of(F.col(url_col)))
    nodes, contents = style_tree(sites, "_host", html_col)
    often = contents.where(F.col("n") >= min_pages)
    rare = often.where((1 - F.log("n") / F.log("pages")) < MIN_IMPORTANCE)
    branches = nodes.where((F.col("pages") >= min_pages) & ~F.col("frame") & (F.col("importance") < MIN_IMPORTANCE))
    keys = branches.select("host", F.col("node").alias("key"), F.lit(False).alias("fixed")).unionByName(
        rare.select("host", F.col("text").alias("key"), (F.col("n") >= EVERYWHERE * F.col("pages")).alias("fixed"))
    )
    low = materialize(
        keys.groupBy(F.coalesce("host", F.lit("")).alias("_site")).agg(
            F.collect_list(F.when(~F.col("fixed"), F.col("key"))).alias("_low"),
            F.collect_list(F.when(F.col("fixed"), F.col("key"))).alias("_fixed"),
        ), "low",
    )
    made = ("text", "by_name", "by_tree")
    rest = [c for c in pages.columns if c != html_col and c.lower() not in made]
    joined = sites.join(low, F.coalesce("_host", F.lit("")) == F.col("_site"), "left")
    fields = [*rest, *made]

    def run(batches):
        for batch in batches:
            wide = len(rest)
            texts, by_name, by_tree = [], [], []
            for source, low, fixed in zip(*(batch.column(wide + k).to_pylist() for k in range(3)), strict=True):
                stay, names, tree = kept_blocks(page_blocks(source), set(low or ()), set(fixed or ()))
                texts.append("\n\n".join(b.text for b in stay))
                by_name.append(names)
                by_tree.append(tree)
            made = [pa.array(texts, pa.string()), pa.array(by_name, pa.int32()), pa.array(by_tree, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:wide], *made], fields)

    schema = StructType([
        *[pages.schema[c] for c in rest], *StructType.fromDDL("text string, by_name int, by_tree int").fields
    ])
    return joined.select(*rest, html_col, "_low", "_fixed").mapInArrow(run, schema)
