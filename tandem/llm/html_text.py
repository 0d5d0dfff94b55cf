r"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a chain of elements (tag and classes), and holds how many pages have it, the distribution
of its presentation (the sequence of its children's elements) and that of its own content (a hash of all its blocks in a page together, so a list
of many items is one content). Importance follows from entropy: a node whose content is the same on most pages carries nothing of the page
(entropy of "which page am I on" given the content near 0), one whose content differs everywhere carries all of it; an inner node mixes the
entropy of its presentation with the mean of its children's importance and that of its own content, by the pages that have them. What fewer than
MIN_PAGES pages have isn't known to be repeated and counts as 1. The tree holds every branch that has text, also those that HTML itself marks.
A branch goes if its importance is low and nothing in it carries the page (has importance CARRIES); else the low ones of its branches and own
contents go. What HTML says of a branch is a prior: inside <article> or <main> low is below LOW_IN_ARTICLE, elsewhere below LOW (a menu or footer
that comes in some variants per host); and the prior is 0, whatever the entropies, for navigation, headers, footers, sidebars, forms, elements
whose classes, id or role name a menu, notice, advert or reader comments, and for what stands outside of <article> and <main> in a page that has one.
So small hosts, of which no tree can be learnt, are read by the prior alone. Copies of an article on a host are still articles: pages of the same text
(by the prior) count as one page, so an article isn't low for being copied. Scripts and styles are never text.

The statistics are rows (host, node, feature) that are summed before and after one exchange, entropies are sums over these; a host's nodes of
at least MIN_PAGES pages, whose number is that of its templates, make its tree, and what comes back to the pages is the list of its low nodes. A node counts only with at least MIN_PAGES distinct pages.

Edge cases: a null or empty page has the text ""; nodes of equal importance are treated alike, so ties need no rule; a page of any length or depth
is parsed in one pass, in time and memory proportional to it; a null url is a host of its own; unclosed elements end with their parents, stray end tags are
ignored; a page is parsed in one pass whatever its length; a page's copies on a host count once; extra columns don't take part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import table

MIN_PAGES, LOW, LOW_IN_ARTICLE, CARRIES, DECAY = 10, 0.5, 0.2, 0.5, 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
#: A tag whose quotes don't close before the page ends goes up to its first '>'; once that was met, all further tags of the page do.
TAG_START = re.compile(r"</?[a-zA-Z]")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SIMPLE_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|[^<]+|<", re.S)
#: Elements by their meaning in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NOT_ARTICLE = {"nav", "header", "footer", "aside", "form", "head", "button", "menu", "dialog"}
ROOTS = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
NAMES = re.compile(r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side-bar|aside|footer|header|masthead|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|commentlist|disqus|respond|replies|discussion|toolbar|pagination|pager|widget|skip)(?:$|[-_\s\d])", re.I)
#: Elements that a start tag closes if they are open just outside: HTML's optional end tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    key: int
    parent: "Node | None"
    off: bool
    article: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """A parsed page: its nodes (a key for the chain, presentation) and its blocks (node, text)."""

    nodes: list[Node]
    blocks: list[tuple[Node, str]]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def parse(page: str | None) -> Page:
    """One pass over the page's tokens."""
    root = Node("", 0, None, False, False)
    nodes, blocks, now = [root], [], root
    # A run of text and its owner, of what isn't marked and of what is.
    runs, owners = ([], []), [root, root]

    def end_block() -> None:
        for run, owner in zip(runs, owners):
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                blocks.append((owner, text))
            run.clear()

    def leave(tag: str) -> None:
        """Closes the innermost open element of this tag and all in it."""
        nonlocal now
        while now is not root:
            name, now = now.tag, now.parent
            open_[name] -= 1
            if name == tag:
                break

    text, at, plain, open_ = page or "", 0, False, {}
    while at < len(text):
        m = (TOKEN if plain is False else SIMPLE_TOKEN).match(text, at)
        if m[0] == "<" and plain is not None and TAG_START.match(text, at):
            tag = PLAIN_TAG.match(text, at)
            m, plain = tag or m, True if tag else None  # None: no further '>' in the page
        at = m.end()
        tag = m[2] if m.re is not SIMPLE_TOKEN else None
        if tag is None:
            token = m[0]
            if not (token.startswith("<!") or token.startswith("<?")):
                if not runs[now.off]:
                    owners[now.off] = now
                runs[now.off].append(token)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                runs[now.off].append(" ")
            if open_.get(tag):
                if tag not in INLINE:
                    end_block()
                leave(tag)
            continue
        if tag not in INLINE:
            if tag == "br":
                runs[now.off].append(" ")
                continue
            end_block()
        if tag in VOID:
            continue
        if tag in BLOCK_ENDS_P:
            up = now
            while open_.get("p") and up is not root and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                leave("p")
        elif tag in CLOSES and now.tag in CLOSES[tag]:
            leave(now.tag)
            if tag == "tr" and now.tag == "tr":
                leave("tr")
        a = _attributes(m[3])
        name = " ".join(sorted(a.get("class", "").lower().split()))
        label = f"{tag}.{name}" if name else tag
        off = now.off or tag in NOT_ARTICLE or tag in RAW or a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or "hidden" in a
        off = off or bool(tag not in ("html", "body", *ROOTS) and (NAMES.search(name) or NAMES.search(a.get("id", ""))))
        now.children.append(label)
        now = Node(tag, _hash(f"{now.key}>{label}"), now, off, now.article or tag in ROOTS)
        nodes.append(now)
        open_[tag] = open_.get(tag, 0) + 1
        if m[3].endswith("/") and tag not in INLINE and tag in RAW:
            leave(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = close.end() if close else len(text)
            leave(tag)
    end_block()
    return Page(nodes, blocks)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def read_blocks(page: Page) -> list[tuple[Node, str]]:
    """The blocks that the prior leaves: those not marked, and of these the ones in <article> or <main> if there are any."""
    unmarked = [x for x in page.blocks if not x[0].off]
    return [x for x in unmarked if x[0].article] or unmarked


def outline(page: Page) -> list[tuple[int, int | None, int | None, int | None, bool]]:
    """The page's nodes that have text in or below them: key, parent's key, hash of the presentation, hash of the own content (all blocks together), in an article or not."""
    known: dict[int, tuple[int | None, set, list, bool]] = {}
    done: set[int] = set()
    for node, text in page.blocks:
        known.setdefault(node.key, (node.parent and node.parent.key, set(), [], node.article))[2].append(text)
        up = node
        while up is not None and id(up) not in done:
            done.add(id(up))
            known.setdefault(up.key, (up.parent and up.parent.key, set(), [], up.article))[1].add(" ".join(dict.fromkeys(up.children)))
            up = up.parent
    return sorted((k, up, _hash("\n".join(sorted(shapes))) if any(shapes) else None, _hash("\n".join(texts)) if texts else None, article) for k, (up, shapes, texts, article) in known.items())


def features(pages: DataFrame) -> DataFrame:
    """A row per host, node and feature with the number of distinct pages: kind 'n' (the node occurs), 's' (a presentation), 'c' (a content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("node", pa.int64()), ("up", pa.int64()), ("s", pa.int64()), ("c", pa.int64()), ("article", pa.bool_())])
        for batch in batches:
            digests, seen = [], []
            for page in batch.column(1):
                parsed = parse(page.as_py())
                digests.append(_hash("\n".join(f"{node.key} {text}" for node, text in read_blocks(parsed))))
                seen.append([dict(zip(("node", "up", "s", "c", "article"), x)) for x in outline(parsed)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(seen, pa.list_(item))], names=["host", "digest", "seen"])

    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, digest long, seen array<struct<node:long,up:long,s:long,c:long,article:boolean>>")
    # Copies are combined before the exchange, so a page with many is a row per task; the least of their outlines, as copies may differ outside of what is read.
    once = rows.groupBy("host", "digest").agg(F.min("seen").alias("seen")).select("host", F.inline("seen"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("feature")) for k, v in (("n", F.lit(0).cast("long")), ("s", F.col("s")), ("c", F.col("c")))])
    return once.select("host", "node", "up", "article", F.inline(kinds)).where("feature IS NOT NULL").groupBy("host", "node", "kind", "feature").agg(F.min("up").alias("up"), F.max("article").alias("article"), F.count("*").alias("n"))


def nodes(pages: DataFrame) -> DataFrame:
    """A row per node of at least MIN_PAGES distinct pages: host, node, up, article, pages, shown (entropy of its presentation), told (of its own content, null without any),
    c (pages with own content), rare (pages of its children that are on fewer pages each)."""
    seen = features(pages)
    total = lambda k, v: F.sum(F.when(F.col("kind") == k, v))
    sums = seen.groupBy("host", "node").agg(
        F.min("up").alias("up"), F.max("article").alias("article"), total("n", F.col("n")).alias("pages"),
        total("s", F.col("n") * F.log("n")).alias("s_log"), total("s", F.col("n")).alias("s"),
        total("c", F.col("n") * F.log("n")).alias("c_log"), total("c", F.col("n")).alias("c"),
    )
    entropy = lambda k: F.when(F.col(k) < MIN_PAGES, 1.0).otherwise((F.log(k) - F.col(f"{k}_log") / F.col(k)) / F.log(k))
    often = F.col("pages") >= MIN_PAGES
    parts = sums.select("host", F.when(often, F.col("node")).otherwise(F.col("up")).alias("node"), F.when(often, F.struct("up", "article", "pages", entropy("s").alias("shown"), entropy("c").alias("told"), "c")).alias("own"), F.when(~often, F.col("pages")).alias("rare"))
    # A node's own row is one; the rare children below it are summed before their exchange.
    known = parts.groupBy("host", "node").agg(F.max("own").alias("own"), F.coalesce(F.sum("rare"), F.lit(0)).alias("rare")).where("own IS NOT NULL")
    return known.select("host", "node", "own.*", "rare")


def tree_importance(tree: list[dict]) -> dict[int, tuple[float, float]]:
    """For each node of a host's tree (rows of nodes): its importance, and the largest importance of anything in its branch."""
    by, below = {n["node"]: n for n in tree}, {}
    for n in tree:
        below.setdefault(n["up"] if n["up"] in by else None, []).append(n["node"])
    order, ahead = [], list(below.get(None, ()))
    while ahead:
        order.append(ahead.pop())
        ahead += below.get(order[-1], ())
    out: dict[int, tuple[float, float]] = {}
    for key in reversed(order):  # children before their parents
        n, children = by[key], below.get(key, ())
        parts = [(by[k]["pages"], *out[k]) for k in children]
        parts += [(n["rare"], 1.0, 1.0)] if n["rare"] else []
        inner = bool(parts)
        parts += [(n["c"], n["told"], n["told"])] if n["c"] else []
        weight = sum(w for w, _, _ in parts)
        mean = sum(w * x for w, x, _ in parts) / weight if weight else 1.0
        out[key] = ((1 - DECAY) * (n["shown"] if n["shown"] is not None else 0.0) + DECAY * mean if inner else mean, max((x for _, _, x in parts), default=1.0))
    return out


def low_keys(tree: list[dict]) -> list[int]:
    """The low branches of a host's tree by their keys, and by ~key the nodes of which only the own content is low."""
    found, told = tree_importance(tree), {n["node"]: n["told"] if n["c"] else None for n in tree}
    low = {n["node"]: LOW_IN_ARTICLE if n["article"] else LOW for n in tree}
    gone = {k for k, (x, most) in found.items() if x < low[k] and most < CARRIES}
    return sorted(gone | {~k for k, x in told.items() if x is not None and x < low[k] and k not in gone})


def low_nodes(pages: DataFrame) -> DataFrame:
    """host, low: what is low on a host (low_keys), as a list per host (a host's list is as long as its templates are rich)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([low_keys(x.as_py()) for x in batch.column(1)], pa.list_(pa.int64()))], names=["host", "low"])

    trees = nodes(pages).groupBy("host").agg(F.collect_list(F.struct("node", "up", "article", "pages", "shown", "told", "c", "rare")).alias("tree"))
    return table(trees.mapInArrow(run, "host string, low array<long>").where(F.size("low") > 0), "low-nodes")


def main_text(page: str | None, low: frozenset[int] = frozenset(), prior: bool = True) -> str:
    """The text of a page without the branches in low and without what the prior excludes (prior=False: the tree alone decides)."""
    parsed, gone = parse(page), set()
    for node in parsed.nodes if low else ():  # parents come before their children
        if node.key in low or node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
    return " ".join(text for node, text in (read_blocks(parsed) if prior else parsed.blocks) if id(node) not in gone and ~node.key not in low)


def extract(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points)."""
    low = low_nodes(pages).withColumnRenamed("host", "_host")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host(F.col("url")).alias("host"))
    # A row per host with low nodes: Spark broadcasts the lists if they are small, and else splits the pages of a hot host.
    rows = rows.join(low, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for page, low in zip(batch.column(2), batch.column(3).to_pylist()):
                key = tuple(low or ())
                if len(sets) > 1000:
                    sets.clear()
                texts.append(main_text(page.as_py(), sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
