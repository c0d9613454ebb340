"""Main text of web pages by wrapper induction over the pages of a host.

A page's DOM is folded: siblings of equal tag and class become one node, so that a list or a run of
paragraphs is one slot. For each host the most frequent folded tree is the model; every page's tree is
aligned with it by simple tree matching. A node whose text never changes over the host's distinct pages
is template if enough of them have it, and so is one with few texts in turn, by the measure of the host's
most varied slot; a slot whose text varies is content, if it doesn't stand in a part that is marked as a
menu, header, footer, sidebar, notice, advert, form or discussion. Inside an article, text in turn is
content, and unchanging text is template only if it also stands outside or its element is marked.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.skew import join_per_key
from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

#: Distinct pages of a host that must agree before an unchanging node counts as template, and their least share of all.
LEAST_PAGES, LEAST_SHARE = 5, 0.5
#: A slot outside articles is template, too, if the host's most varied slot has this many times its number of texts.
IN_TURN = 5
#: Elements nested more deeply count as part of the one around them.
DEEPEST = 120
#: Hosts whose wrappers are broadcast, and bytes of them; beyond either, pages are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 200_000, 32 << 20
#: Trees that a task remembers having given; beyond it, it gives them again.
GIVEN = 100_000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
                   "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("table td th ul ol dl select button article section div body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_CONTENT = frozenset("head nav footer aside form menu dialog button select option fieldset legend template search".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NO_CONTENT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay newsletter "
                             "subscribe subscription signup comment comments disqus replies sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead "
                             "topbar share sharing social related recommended recommendations widget login search toolbar skip".split())
#: Words that may stand beside such a name in one class, as in "comment-list"; with any other word ("has-sidebar", "article-header") the class says nothing.
BESIDE_NAMES = frozenset("site top bottom left right box bar list slot link links button buttons icons form posts section area block unit".split())
#: Names that mark the title's place when they stand inside an article.
TITLE_NAMES = frozenset("header masthead".split())
#: Words in a class or id that let unchanging text inside an article count as template.
FIXED_NAMES = NO_CONTENT_NAMES - TITLE_NAMES | frozenset("tag tags tagline byline meta copyright disclaimer legal credits boilerplate".split())
TRUSTED = frozenset("html body article main".split()) | HEADINGS
#: A form that holds one of these is the page's, as some servers write it, and says nothing about its parts.
LANDMARKS = frozenset("article main header nav footer h1".split())
# How an element is closed: not, by being a form, by its names, for good. Forms do not close an article in them; names do only if the page has another one.
OPEN, BY_FORM, BY_NAME, SHUT = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NUMBER = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", re.I)
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}


class Node:
    """A folded element: its place among the page's nodes, its label and its children in order."""

    __slots__ = ("index", "tag", "name", "children", "by_label", "closed")

    def __init__(self, index: int, tag: str, name: str, closed: int):
        self.index, self.tag, self.name, self.closed = index, tag, name, closed
        self.children: list[Node] = []
        self.by_label: dict[tuple[str, str], Node] = {}


def _closed(tag: str, attributes: dict[str, str], inside_article: bool) -> int:
    """Whether and how an element's own marks say that it holds no article text."""
    if tag == "header":
        return OPEN if inside_article else SHUT
    if tag in NO_CONTENT - {"form"} or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in NO_CONTENT_ROLES:
        return SHUT
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return SHUT
    if tag in TRUSTED:
        return OPEN
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        marks = words & NO_CONTENT_NAMES
        if marks and words <= NO_CONTENT_NAMES | BESIDE_NAMES and not (inside_article and marks <= TITLE_NAMES):
            return BY_NAME
    return BY_FORM if tag == "form" else OPEN


def parse(html: str) -> tuple[Node, list[tuple[int, str]]]:
    """The folded tree of a page, and its text blocks in order as (node, text)."""
    root = Node(0, "html", "", OPEN)
    count = 1
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements; an inline one shares its block's node
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((stack[-1][1].index, text))

    def add(text: str) -> None:
        if text:
            parts.append(markup.unescape(text) if "&" in text else text)

    at, articles = 0, 0
    while True:
        token = _TOKEN.search(html, at)
        if not token:
            add(html[at:])
            break
        add(html[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if not open_at:
                continue
            if tag in BLOCKS:
                flush()
                articles -= sum(t in ("article", "main") for t, _ in stack[open_at:])
                del stack[open_at:]
            elif all(t not in BLOCKS for t, _ in stack[open_at:]):
                del stack[open_at:]
            else:
                del stack[open_at]  # an inline element that ends among blocks
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = html.find(">", end.end()) + 1 or len(html) if end else len(html)
            continue
        if tag == "hr":
            flush()
        if tag in VOID or tag == "html":
            continue
        if tag not in BLOCKS:
            if not token[3].endswith("/"):
                stack.append((tag, stack[-1][1]))
            continue
        flush()
        # an open paragraph, item or cell ends where a new one begins
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i][0]
            if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if open_tag in HOLDS:
                break
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token[3])} if token[3] else {}
        parent = stack[-1][1]
        if len(stack) > DEEPEST:
            stack.append((tag, parent))
            continue
        label = tag, _NUMBER.sub("0", attributes.get("class", "") or attributes.get("id", ""))
        node = parent.by_label.get(label)
        if node is None:
            node = Node(count, tag, label[1], _closed(tag, attributes, articles > 0))
            count += 1
            parent.by_label[label] = node
            parent.children.append(node)
        stack.append((tag, node))
        articles += tag in ("article", "main")
    flush()
    return root, blocks


# -- folded trees as text, and their alignment


def written(node: Node) -> str:
    """A folded tree as text: tag, name, index and children of each node."""
    return f"{node.tag}\t{node.name!r}\t{node.index}" + "".join(f"\n{line}" for child in node.children for line in (">", written(child), "<"))


def read(text: str) -> Node:
    root, path = None, []
    for line in text.split("\n"):
        if line == "<":
            path.pop()
        elif line != ">":
            tag, name, index = line.split("\t")
            node = Node(int(index), tag, name, OPEN)
            if path:
                path[-1].children.append(node)
            else:
                root = node
            path.append(node)
    return root


def match(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest ordered match of two trees whose roots agree, as pairs of indexes."""
    if a.tag != b.tag:
        return 0, []
    n, m = len(a.children), len(b.children)
    pair = [[match(x, y) for y in b.children] for x in a.children]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + pair[i][j][0])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.extend(pair[i - 1][j - 1][1])
            i, j = i - 1, j - 1
    # a name that agrees weighs a little more, so that of equal tags the equal class is taken
    return best[n][m] + (3 if a.name == b.name else 2), [(a.index, b.index), *pairs]


class Aligner:
    """Alignments of folded trees, remembered by their text."""

    def __init__(self, most: int = 5000):
        self.most, self.known = most, {}

    def __call__(self, tree: str, model: str) -> dict[int, int]:
        key = tree, model
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = {i: i for i in range(tree.count("\t") // 2)} if tree == model else dict(match(read(tree), read(model))[1])
        return self.known[key]


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# -- wrappers of all hosts


def page_trees(pages: DataFrame) -> DataFrame:
    """By host and distinct page: the hash of its folded tree, and its nodes with the hash of their text.

    ``pages`` has ``url`` and ``html``. The tree itself is given by one row of each task that has it, so
    neither the tree nor the texts are carried by page. Pages of one host with equal ``page`` are copies.
    """

    def run(batches):
        given: set[tuple[str, int]] = set()
        for batch in batches:
            rows: dict[tuple[str, int], tuple] = {}
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root, blocks = parse(html)
                host, tree, texts = host_of(url), written(root), {0: []}
                for node, text in blocks:
                    texts.setdefault(node, []).append(text)
                hashes = [_hash("\n".join(own)) for own in texts.values()]
                page = host, _hash("\n".join([tree, *map(str, texts), *map(str, hashes)]))
                if page in rows:
                    continue
                kind = _hash(tree)
                rows[page] = kind, None if (host, kind) in given else tree, list(texts), hashes
                if len(given) >= GIVEN:
                    given.clear()
                given.add((host, kind))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            flat = [(*k, *v) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], names=["host", "page", "kind", "tree", "nodes", "hashes"])

    return pages.filter("html IS NOT NULL").select("url", "html").mapInArrow(run, "host string, page long, kind long, tree string, nodes array<int>, hashes array<long>")


def template_of(model: str, fixed: list[tuple[int, int | None]]) -> list[int]:
    """The template among a model's nodes that don't vary, given with the hash of their text, None for several in turn."""
    place: dict[int, tuple[bool, bool]] = {}  # whether a node is in an article, and whether it is marked there

    def walk(node: Node, inside: bool, marked: bool) -> None:
        own = not FIXED_NAMES.isdisjoint(re.split(r"[^a-z]+", node.name.lower()))
        marked = own or marked and node.tag not in HEADINGS
        place[node.index] = inside, marked
        inside_below = inside or node.tag in ("article", "main")
        for child in node.children:
            walk(child, inside_below, marked and inside)

    walk(read(model), False, False)
    outside = {h for n, h in fixed if not place[n][0]}
    return sorted(n for n, h in fixed if not place[n][0] or h is not None and (place[n][1] or h in outside))


def induce(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """A wrapper for each host: ``host``, ``model`` (the folded tree of most distinct pages) and ``template`` (nodes).

    Every tree of a host is aligned with the model once; texts meet the alignment by tree and node, and are
    only counted: the texts of a slot by hash, then the slot's texts.
    """
    made = materialise(page_trees(pages))
    distinct = made.dropDuplicates(["host", "page"])
    trees = made.filter("tree IS NOT NULL").groupBy("host", "kind").agg(F.max("tree").alias("tree"))
    trees = materialise(trees.join(distinct.groupBy("host", "kind").agg(F.count("*").alias("pages")), ["host", "kind"]))
    models = trees.groupBy("host").agg(F.max_by("tree", F.struct("pages", "kind")).alias("model"), F.sum("pages").alias("all"))

    def align(batches):
        aligner = Aligner()
        for batch in batches:
            pairs = [aligner(t, m) for t, m in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            nodes, to = (pa.array([list(x) for x in own], pa.list_(pa.int32())) for own in ([p.keys() for p in pairs], [p.values() for p in pairs]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), nodes, to], names=["host", "kind", "pages", "nodes", "slots"])

    aligned = trees.join(models, "host").select("host", "kind", "pages", "tree", "model").mapInArrow(align, "host string, kind long, pages long, nodes array<int>, slots array<int>")
    aligned = aligned.select("host", "kind", "pages", F.explode(F.arrays_zip("nodes", "slots")).alias("n")).select("host", "kind", F.col("n.nodes").alias("node"), "pages", F.col("n.slots").alias("slot"))
    texts = distinct.select("host", "kind", F.explode(F.arrays_zip("nodes", "hashes")).alias("n")).groupBy("host", "kind", F.col("n.nodes").alias("node"), F.col("n.hashes").alias("hash"))
    texts = join_per_key(texts.agg(F.count("*").alias("times")), materialise(aligned), ["host", "kind", "node"], "pages", ["hash"])
    texts = texts.groupBy("host", "slot", "hash").agg(F.sum("times").alias("times"))
    slots = texts.groupBy("host", "slot").agg(F.sum("times").alias("pages"), F.count("*").alias("texts"), F.max("hash").alias("hash"))
    # lists as long as the model has nodes, at most; the root is a node of every page
    held = slots.groupBy("host").agg(F.collect_list(F.when(F.col("pages") >= least_pages, F.struct("slot", "pages", "texts", "hash"))).alias("still"), F.max("texts").alias("most"))
    still = F.filter("still", lambda n: (n["slot"] > 0) & (n["pages"] >= least_share * F.col("all")) & ((n["texts"] == 1) | (n["texts"] * IN_TURN <= F.col("most"))))
    still = F.transform(still, lambda n: F.struct(n["slot"].alias("node"), F.when(n["texts"] == 1, n["hash"]).alias("hash")))
    held = held.join(models, "host").select("host", "model", still.alias("still"))

    def decide(batches):
        for batch in batches:
            made = [template_of(m, [(n["node"], n["hash"]) for n in own]) for m, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32()))], names=["host", "model", "template"])

    return held.mapInArrow(decide, "host string, model string, template array<int>")


def _holds(node: Node, tags: frozenset) -> bool:
    return any(c.tag in tags or _holds(c, tags) for c in node.children)


def _open_blocks(root: Node, blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks outside closed parts: those of articles, if there are any.

    An article in a part that is closed by its names is a teaser or a comment if there is another one,
    and the page's own if not. Without anything else, the texts of a form are the page's.
    """
    level: dict[int, int] = {}      # how a node is closed
    reopened: dict[int, int] = {}   # the same, if names do not close an article either
    inside: set[int] = set()

    def walk(node: Node, above: int, above_reopened: int, within: bool) -> None:
        if node.tag in ("article", "main"):
            within = True
            above = OPEN if above == BY_FORM else above
            above_reopened = above_reopened if above_reopened == SHUT else OPEN
        own = OPEN if node.closed == BY_FORM and _holds(node, LANDMARKS) else node.closed
        level[node.index], reopened[node.index] = max(above, own), max(above_reopened, own)
        if within:
            inside.add(node.index)
        for child in node.children:
            walk(child, level[node.index], reopened[node.index], within)

    walk(root, OPEN, OPEN, False)
    kept = [[(n, t) for n, t in blocks if n in inside and level[n] == OPEN], [(n, t) for n, t in blocks if n in inside and reopened[n] == OPEN],
            [(n, t) for n, t in blocks if level[n] == OPEN], [(n, t) for n, t in blocks if level[n] <= BY_FORM]]
    return next((own for own in kept if own), [])


def article(html: str, model: str | None, template: set[int], aligner: Aligner) -> str:
    """The article text of a page under its host's wrapper."""
    root, blocks = parse(html)
    blocks = _open_blocks(root, blocks)
    if template and model is not None:
        to = aligner(written(root), model)
        varying = [(n, t) for n, t in blocks if to.get(n, -1) not in template]
        blocks = varying or blocks  # pages that are all the same have no slots
    return "\n\n".join(t for _, t in blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``id``, ``url`` and ``text`` of every page: its article, blocks joined by an empty line.

    Character references are decoded, white space inside a block is one space. A null or empty page
    has an empty text; pages with a null or hostless URL share one nameless host; a page without an
    article or main element gives all text outside marked parts. Rows stay as given.
    """
    tb.small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    wrappers = materialise(induce(rows, least_pages).filter(F.size("template") > 0))
    size = wrappers.agg(F.count("*").alias("n"), F.sum(F.length("model") + 4 * F.size("template")).alias("b")).first()
    few = size["n"] <= BROADCAST_HOSTS and (size["b"] or 0) <= BROADCAST_BYTES
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    joined = rows.withColumn("host", F.coalesce(host, F.lit(""))).join(F.broadcast(wrappers) if few else wrappers, "host", "left").select("id", "url", "html", "model", "template")

    def run(batches):
        aligner = Aligner()
        for batch in batches:
            texts = [article(h, m, set(t or ()), aligner) if h else "" for h, m, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    made = joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
