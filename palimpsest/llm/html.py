"""Main text of web pages by consensus paths of hosts.

1. Each page is cut into tags and text in one pass. Some elements never hold main text and are left out by their tag: scripts,
   styles, navigation, form controls and the like. Others only may not: page headers and footers, forms, asides outside
   articles and elements whose class, id or role name a sidebar, notice, advert, share bar or comments. They are candidates, and are left
   out only where the page agrees: never a heading, a paragraph (but for an advert) or an article, never what holds half or more
   of the page's article text (so what wraps the article stays, whatever its class says), never an id in an article, a name that may be
   part of a subject only where most of it is links, and never all that a page has.
2. Every container (an element that holds blocks) gets a score: the text of its blocks less that in links, less what is left out.
   Best are the outermost articles (by tag or by words) where
   they hold half of the page's text or more; if their paths differ, or a title (h1) lies outside, the smallest container
   around all. Else it is the smallest container that holds all text, so several containers or a heading beside one keep
   their parent. The path from the body, tags with their classes, digits generalised, is the page's vote.
3. Votes are counted by host, weighted by text, as partial sums; the path with most weight wins, ties by path.
4. Pages are read again with their host's winning path: the text of all elements at that path, in page order.
   Where none is there, all elements at the page's own best path are taken. Where the two overlap, the host's path is taken
   if it holds more than half of the text of the page's own (a repeated block counts once), else the page's own.
   Where they lie apart, both are taken in page order, since either may be the article.

Only (host, path, weight) rows are shuffled, never pages. The winners (one row a host) are broadcast when counted to be
few, else joined. Time and memory are linear in a page, however deep it nests and whatever it leaves unclosed: open elements
are counted by tag, and paths are numbers until one is voted for. A page is one row's work; its tree takes some 400 bytes a tag.

Null and empty html give an empty text; a null url is a host of its own. Tags that never close or close twice are repaired
as browsers do for paragraphs and list items; a tag, comment or script that the page ends in is dropped as browsers do. Rows that
repeat are votes and results by themselves; an empty table gives no rows; extra columns pass through, whatever their names,
but for one named as the output, which is replaced. Nothing is cut or capped.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, saved, table, unused
from .words import blocks

_SPECIAL = re.compile(r"[>\"']")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"\s+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
ARTICLES = frozenset(("article", "main"))
#: Elements whose text is never main text.
SKIPPED = frozenset("button datalist dialog head input label legend menu nav object select svg video audio canvas".split()) | RAW
#: Elements that may be left out, if the page agrees.
DOUBTFUL = frozenset(("aside", "footer", "form", "header"))
#: Elements that a class, id or role may leave out; headings, paragraphs and what flows in them are none.
NAMED = DOUBTFUL | frozenset("div dl li ol section table td ul".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that name what is no main text: reader comments, adverts, others that mean nothing else, and those that may be part of a subject.
COMMENTS = frozenset("comment comments disqus respond".split())
ADVERTS = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising sponsored".split())
SURE = (
    COMMENTS
    | ADVERTS
    | frozenset(
        "adbox breadcrumb breadcrumbs cookie cookies footer gdpr header masthead modal nav navbar navigation newsletter overlay pager pagination paywall popup sidebar sidebars signup toolbar topbar widget widgets".split()
    )
)
NAMES = SURE | frozenset(
    "banner banners copyright disclaimer login menu menus notice notices notification notifications promo promos promotion promotions recommendations recommended related reply share sharing skip social sponsor sponsors subscribe "
    "subscription teaser teasers".split()
)
#: Words that such a name may go with; by themselves they say nothing.
PLAIN = frozenset(
    "area article articles author bar block body bottom box buttons cell consent container content count desktop entry feed fixed floating form global group icons inner item items label left link links list main message mobile "
    "module outer page panel post posts primary reader right row secondary section site slot sticky stories text thread title top unit user wrap wrapper".split()
)
#: A class that begins so tells a state of the page.
STATES = frozenset("has have hide is no not show with without".split())
#: Words of class and id that say that a container is an article.
ARTICLE_WORDS = frozenset("article content entry post story".split())
_PARAGRAPH_ENDS = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An open element that a new one of these kinds closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORD = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. `path` is its number in the tree's paths; `doubt` tells whether it may be left out, see _doubt."""

    __slots__ = ("article", "children", "doubt", "linked", "own", "parent", "path", "score", "skipped", "tag")

    def __init__(self, tag: str, path: int, parent: Node | None, skipped: bool, article: bool = False, doubt: int = 0) -> None:
        self.tag, self.path, self.parent, self.skipped, self.article, self.doubt = tag, path, parent, skipped, article, doubt
        #: Text and Node children in order.
        self.children: list = []
        #: Characters of text outside links in this element's own blocks, and in links; score is that of all below.
        self.own = self.linked = self.score = 0


class Paths:
    """Paths of steps as numbers; 0 is that of the root."""

    def __init__(self) -> None:
        self.above, self.steps, self.known = [0], [""], {}

    def below(self, path: int, step: str) -> int:
        found = self.known.get((path, step))
        if found is None:
            found = self.known[path, step] = len(self.steps)
            self.above.append(path)
            self.steps.append(step)
        return found

    def written(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.above[path]
        return ">".join(reversed(steps))

    def find(self, written: str) -> int | None:
        path = 0
        for step in written.split(">"):
            path = self.known.get((path, step))
            if path is None:
                return None
        return path


def _words(token: str) -> list[str]:
    return [w for w in (w.lower().rstrip("0123456789") for w in _WORD.split(token)) if w]


def _named(words: list[str]) -> int:
    """What the words of one class or id name: 1 no main text, 2 reader comments, 3 perhaps no main text, 0 nothing of these."""
    if not words or words[0] in STATES or not (words[0] in NAMES or words[-1] in NAMES):
        return 0
    plain = all(w in NAMES or w in PLAIN for w in words)
    if not COMMENTS.isdisjoint(words) and (plain or words[-1] in COMMENTS):
        return 2
    if plain or words[-1] in SURE:
        return 1
    return 3 if words[-1] in NAMES else 0


def _doubt(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """0 for what is taken as it is, 1 for what may be left out, 2 for reader comments, 3 for what may be left out if it is links."""
    classes = attributes.get("class", "").split()
    if tag == "article":
        return 2 if "comment" in map(str.lower, classes) else 0
    if tag == "p":
        return int(not ADVERTS.isdisjoint(map(str.lower, classes)))
    if tag not in NAMED:
        return 0
    found = 1 if tag in ("footer", "form") or tag in ("aside", "header") and not in_article else 0
    if attributes.get("role", "").lower() in ROLES:
        found = 1
    # Headers in an article hold its title; ids there are places to link to, but for those that scripts fill with comments.
    own_id = attributes.get("id", "")
    tokens = classes if in_article and own_id.lower() not in ("comments", "disqus_thread", "respond") else [*classes, own_id]
    kinds = {found}
    for token in (*tokens, attributes.get("aria-label", "")):
        words = _words(token)
        if not (in_article and words and words[-1] in ("header", "banner")):
            kinds.add(_named(words))
    return next((kind for kind in (2, 1, 3) if kind in kinds), 0)


def _step(tag: str, attributes: dict[str, str]) -> str:
    """tag.class.class: classes sorted, runs of digits generalised; none has the mark between steps."""
    classes = sorted({re.sub(r"\d+", "#", c).replace(">", "") for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _tag_end(page: str, at: int) -> int:
    """Place after the > that ends a tag, quoted values passed over; -1 if the page ends in it."""
    while match := _SPECIAL.search(page, at):
        at = match.end()
        if match[0] == ">":
            return at
        if page[max(0, match.start() - 8) : match.start()].rstrip().endswith("="):
            close = page.find(match[0], at)
            # A quote that never closes is a character like others; there is none of its kind behind it.
            at = close + 1 if close >= 0 else at
    return -1


class Tree:
    """The tree of a page."""

    def __init__(self, page: str) -> None:
        self.paths = Paths()
        self.root = Node("#", 0, None, False)
        self._parse(page)

    def _parse(self, page: str) -> None:
        at, n = 0, len(page)
        here, blocks = self.root, [self.root]
        #: Open elements by tag: all blocks; what is open inside each open block.
        open_blocks: dict[str, int] = {}
        inline: list[dict[str, int]] = [{}]

        def close(upto: Node) -> None:
            """Closes all open elements up to one, itself included."""
            nonlocal here
            while True:
                node = here
                here = node.parent
                if node is blocks[-1]:
                    blocks.pop()
                    inline.pop()
                    open_blocks[node.tag] -= 1
                else:
                    inline[-1][node.tag] -= 1
                if node is upto:
                    return

        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                here.children.append(page[at:])
                return
            match = _TAG.match(page, begin)
            if not match:
                nxt = page[begin + 1 : begin + 2]
                if nxt not in ("!", "?", "/"):  # a sign like any other
                    here.children.append(page[at : begin + 1])
                    at = begin + 1
                    continue
                if begin > at:
                    here.children.append(page[at:begin])
                end = page.find("-->", begin + 4) if page.startswith("<!--", begin) else page.find(">", begin)
                if end < 0:
                    return
                at = end + (3 if page.startswith("<!--", begin) else 1)
                continue
            if begin > at:
                here.children.append(page[at:begin])
            at = _tag_end(page, match.end())
            if at < 0:
                return
            tag = match[2].lower()
            if match[1]:
                if tag in BLOCKS:
                    if open_blocks.get(tag):
                        node = next(b for b in reversed(blocks) if b.tag == tag)
                        close(node)
                elif inline[-1].get(tag):  # a block that is still open is not closed by the end of an inline element outside it
                    node = here
                    while node.tag != tag:
                        node = node.parent
                    close(node)
                continue
            if tag in _PARAGRAPH_ENDS and blocks[-1].tag == "p":
                close(blocks[-1])
            closed = _CLOSES.get(tag)
            while closed and blocks[-1].tag in closed:
                close(blocks[-1])
            if tag in VOID:
                here.children.append(Node(tag, here.path, here, False))
                continue
            raw = page[match.end() : at - 1]
            attributes = {}
            if raw:
                for m in _ATTRIBUTE.finditer(raw):
                    attributes.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
            role = attributes.get("role", "").lower()
            if not (article := here.article):
                article = tag in ARTICLES or role in ARTICLES
                if not article and attributes and tag in CONTAINERS and tag != "body":
                    article = any(not ARTICLE_WORDS.isdisjoint(_words(t)) and not _named(_words(t)) for t in (*attributes.get("class", "").split(), attributes.get("id", "")))
            skipped = here.skipped or tag in SKIPPED or "hidden" in attributes
            doubt = 0 if skipped or role in ARTICLES else _doubt(tag, attributes, here.article)
            block = tag in BLOCKS
            path = self.paths.below(here.path, _step(tag, attributes)) if block and tag != "html" else here.path
            node = Node(tag, path, here, skipped, article, doubt)
            here.children.append(node)
            if tag in RAW:
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else n
                continue
            if raw.rstrip().endswith("/") and not block:
                continue
            here = node
            if block:
                blocks.append(node)
                inline.append({})
                open_blocks[tag] = open_blocks.get(tag, 0) + 1
            else:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*+>", re.I)


def parsed(page: str) -> Tree:
    """The tree of a page, with scores; what is left out is marked as skipped."""
    tree = Tree(page)
    _measure(tree.root)
    return tree


def _measure(root: Node) -> None:
    """Counts text, decides on what may be left out, and scores every element by what is left."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, link, title = stack.pop()
        title = title or node.tag == "h1"
        order.append(node)
        # A title that links to its own page is text.
        link = (link or node.tag == "a") and not title
        for child in node.children:
            if isinstance(child, str):
                size = len(child.strip())
                node.linked += size * link
                node.own += size * (not link)
            elif not child.skipped:
                stack.append((child, link, title))
    kept = [n for n in order if not n.skipped]
    # All text, that of articles by tag, that of articles by their words: the first of the latter two that there is speaks for the page.
    texts = {n: n.own + n.linked for n in kept}
    by_tag, by_word = dict.fromkeys(kept, 0), dict.fromkeys(kept, 0)
    for node in reversed(kept):
        own_tag, own_word = by_tag[node], by_word[node]
        if node.doubt != 2:
            own_tag = texts[node] if node.tag in ARTICLES else own_tag
            own_word = texts[node] if node.article and not node.parent.article else own_word
        else:
            own_tag = own_word = 0
        by_tag[node], by_word[node] = own_tag, own_word
        if node.parent:
            texts[node.parent] += texts[node]
            by_tag[node.parent] += own_tag
            by_word[node.parent] += own_word
    inside = {}
    for node in kept:
        inside[node] = bool(node.parent and (inside[node.parent] or node.parent.tag in ARTICLES))
    weight = by_tag if by_tag[root] else by_word if by_word[root] else texts
    if weight is not texts:
        # Text in an article counts with it.
        held = {}
        for node in kept:
            held[node] = bool(node.parent and (held[node.parent] or (node.parent.tag in ARTICLES if weight is by_tag else node.parent.article)))
            if held[node] and node.doubt != 2:
                weight[node] = texts[node]
    # Where no article speaks for the page, what may be left out stays if it holds nearly all that there is.
    clear = 0
    if weight is texts:
        beneath = set()
        for node in kept:
            if node.doubt or node.parent in beneath:
                beneath.add(node)
            else:
                clear += node.own + node.linked
    links = {n: n.linked for n in kept}
    for node in reversed(kept):
        if node.parent:
            links[node.parent] += links[node]
    wraps = lambda n: 2 * weight[n] >= max(1, weight[root]) and (weight is not texts or 4 * clear <= texts[n])
    out = [n for n in kept if n.doubt == 2 or n.doubt and not wraps(n) and (n.doubt == 1 or 2 * links[n] > texts[n])]
    for node in out:
        node.skipped = True
    _score(root, kept)
    if not root.score and out:
        # Nothing would be left: then it is all that the page has.
        for node in out:
            node.skipped = False
        _score(root, kept)


def _score(root: Node, order: list[Node]) -> None:
    gone = set()
    for node in order:
        node.score = 0
        if node.skipped or node.parent in gone:
            gone.add(node)
    for node in reversed(order):
        if node not in gone:
            node.score += max(0, node.own - 2 * node.linked)
            if node.parent:
                node.parent.score += node.score


def blocks_of(node: Node) -> list[str]:
    """The texts of the blocks of an element, in order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", references.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    # A stack of places in children, so that deep pages do not end in a recursion error.
    stack = [(node, iter(node.children))]
    while stack:
        current, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                run.append(child)
            elif child.skipped:
                if child.tag in BLOCKS:
                    flush()
            elif child.tag in VOID:
                run.append(" ")
            else:
                if child.tag in BLOCKS:
                    flush()
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()
            if current.tag in BLOCKS:
                flush()
    flush()
    return out


def _in_order(root: Node) -> Iterator[Node]:
    """All elements that are not skipped, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.skipped)


def best_container(tree: Tree) -> Node:
    """The smallest container that leaves out no text but what lies outside the page's articles."""
    root = tree.root
    order = list(_in_order(root))
    articles = [n for n in order if n.article and not n.parent.article and n.score]
    if articles and 2 * sum(n.score for n in articles) >= root.score:
        titles = [n for n in order if n.tag == "h1" and not n.article and n.score]
        return articles[0] if len({n.path for n in articles}) == 1 and not titles else _around(articles + titles)
    # The containers next below each that hold text: only one that holds all is gone into.
    below: dict[Node, Node | None] = {}
    for node in reversed(order):
        if node.score and node.parent:
            mine = node if node.tag in CONTAINERS else below.get(node, node)
            below[node.parent] = mine if node.parent not in below else None
    best = root
    while (inner := below.get(best)) and inner.tag in CONTAINERS and inner.score == best.score:
        best = inner
    return best


def _above(node: Node) -> list[Node]:
    """A node and what encloses it, outermost first."""
    out = [node]
    while out[-1].parent:
        out.append(out[-1].parent)
    return out[::-1]


def _all_above(nodes: list[Node]) -> set[Node]:
    """Nodes and what encloses any of them."""
    out: set[Node] = set()
    for node in nodes:
        while node and node not in out:
            out.add(node)
            node = node.parent
    return out


def _around(nodes: list[Node]) -> Node:
    """The smallest container around all nodes."""
    depth = {n: i for i, n in enumerate(_above(nodes[0]))}
    lowest = nodes[0]
    for node in nodes[1:]:
        # What lies below the last common element is met once by each node; what is above it stays in depth.
        while node not in depth:
            node = node.parent
        if depth[node] < depth[lowest]:
            lowest = node
    while lowest.parent and lowest.tag not in CONTAINERS:
        lowest = lowest.parent
    return lowest


def at_path(tree: Tree, path: int | None) -> list[Node]:
    """The elements at a path, in page order."""
    return [n for n in _in_order(tree.root) if n.path == path and n.tag in CONTAINERS] if path else []


def _distinct(nodes: list[Node]) -> int:
    """Characters of the blocks of elements, repeated blocks once."""
    return sum(map(len, {b for node in nodes for b in blocks_of(node)}))


def main_text(page: str | None, path: str | None = None) -> str:
    """The blocks of the page's main text joined by newlines, by its host's path if there is something at it."""
    if not page:
        return ""
    tree = parsed(page)
    best = best_container(tree)
    taken = at_path(tree, best.path) or [best]
    shared = tree.paths.find(path) if path else None
    common = at_path(tree, shared) if shared != best.path else []
    if _distinct(common):
        # Elements of one path may lie in each other only by inline tags between them, never as containers.
        inner, around_taken, around_common = set(common), _all_above(taken), _all_above(common)
        if not inner.isdisjoint(around_taken) or not around_common.isdisjoint(taken):
            # Where one lies in the other, the common path has to hold most of the text.
            if 2 * _distinct(common) > _distinct(taken):
                below = _below(common)
                taken = common + [n for n in taken if n not in around_common and n not in below]
        else:
            taken += common
        place = {n: i for i, n in enumerate(_in_order(tree.root))}
        taken.sort(key=place.__getitem__)
    return "\n".join(b for node in taken for b in blocks_of(node))


def _below(nodes: list[Node]) -> set[Node]:
    """Nodes and all that they enclose."""
    return {n for node in nodes for n in _in_order(node)}


def vote(page: str | None) -> tuple[str, int] | None:
    """Path of the page's best container, and its weight."""
    if not page:
        return None
    tree = parsed(page)
    best = best_container(tree)
    return (tree.paths.written(best.path), best.score) if best.path and best.score > 0 else None


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> host, path, weight summed over the batch."""
    for whole in batches:
        for batch in blocks(whole, whole.schema.names[1]):
            sums: dict[tuple, int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found := vote(page.as_py()):
                    sums[host, found[0]] = sums.get((host, found[0]), 0) + found[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["host", "path", "weight"]
            )


def paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the winning path of every host with a vote."""
    votes = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, weight long")
    sums = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("weight"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), _HOST, 1), F.lit("")))


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text") -> DataFrame:
    """pages, with the main text instead of the html and of a column so named."""
    pages = pages.drop(out) if out != html_col else pages
    host, path = unused(pages, "host", "path")
    winners = saved(paths(pages, url_col, html_col), "host-paths")
    few = winners.count() <= BROADCAST_ROWS // 10  # rows of a host and a path
    winners = winners.withColumnsRenamed({"host": host, "path": path})
    keyed = pages.join(F.broadcast(winners) if few else winners, host_of(url_col) == F.col(host), "left").drop(host)
    names = [c for c in pages.columns if c != html_col]
    schema = pages.select(*names).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, html_col):
                at = batch.schema.names.index
                texts = [main_text(page.as_py(), own) for page, own in zip(batch.column(at(html_col)), batch.column(at(path)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(texts, pa.string())], [*names, out])

    return keyed.select(*names, html_col, path).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
