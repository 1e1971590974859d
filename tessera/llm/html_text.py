"""Main text of web pages by consensus paths of their hosts.

1. Every page's containers are scored by the text of their blocks, less links and boilerplate. The score only tells where the article
   lies: the region around the best container is the outermost article about it, else its main, else the outermost container named as
   an article, else the container, and from there
   the highest ancestor (up to the main, or the body where there is neither) that has text of its own. The page votes for the region's
   path: the tags and generalised classes from the body down to it. The regions that it would choose beside that one are passed over.
2. Spark counts the votes by host and path (partial counts before the shuffle) and takes each host's winner; paths that more pages
   passed over than chose are the host's noise.
   Elements of boilerplate tags are left out. A form, or a word that marks boilerplate in a class, id, role or itemprop, leaves an element out
   unless it holds the article: see settled(). The header of an article is no boilerplate.
3. Every page is read again with its host's winning path. All text that is not boilerplate is given below all containers on that path
   and below the page's own region, unless that region is the host's noise and something is on the winning path.

The winners (one short row a host) go to all tasks only if there are at most BROADCAST_HOSTS; else distinct pairs of input file and host are
joined to them, and each task reads those of its own files. The pages themselves are never shuffled. Reading a page takes time and memory in
proportion to its length, however deep its elements are nested.

Cases. Null or empty html, or no text: an empty string. Null url: the host is the empty string. Unclosed and misnested tags close as soon as a
tag that cannot hold them does. Text outside any container counts for the body. Equal rows are returned each; ties of votes go to more text, then to
the path that sorts first. Texts are never cut. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, fresh_dir, no_null_text, written
from tessera.llm.files import read_table

BROADCAST_HOSTS = 50_000
#: Winners looked up by input file, about so many in a bucket.
BUCKET_ROWS = 1_000_000

# Kinds of elements and the words in classes and ids that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp noembed".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
DROPPED = frozenset("script style title textarea iframe noframes xmp noembed head noscript template nav aside footer button select option input svg canvas dialog menu object embed audio video".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer footers footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related reply replies respond share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar toc widget widgets".split())
NOT_MARKED = frozenset("has no with without".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Of these, those that name one whole article; a header of such a one holds its title.
STORY = frozenset("article entry post story".split())
#: What a start tag closes: an open element of these names, unless one of the others lies between.
CLOSES = {
    **{t: (("p",), ("button", "td", "th", "li", "div", "article", "section", "body")) for t in BLOCKS - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup"}},
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")),
    "tr": (("tr", "td", "th", "p"), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select",)), "body": (("head",), ()), "tbody": (("tbody", "thead", "tr", "td", "th", "p"), ("table",)),
}

# a quote opens a value right after = only, and is an ordinary character elsewhere
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>?)""", re.S)
_CLASS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"[\s\x00]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


#: Elements that end the search for what a start tag closes.
STOPS = BLOCKS | {n for closes, walls in CLOSES.values() for n in (*closes, *walls)}
#: Paths of more characters are named by a hash, so that deep nesting costs no more than its tags.
LONGEST_PATH = 400


class Node:
    """An element. Nodes are numbered in page order, so that those below it are the ones from no up to last."""

    __slots__ = ("bad", "best", "block", "box", "chars", "covered", "free", "good", "last", "link", "link_chars", "mark", "name", "no", "out", "own", "parent", "path", "region_own", "main_own", "article", "main", "score", "story", "text", "worth")

    def __init__(self, name: str, parent: Node | None, path: str, bad: bool, link: bool, good: bool, marked: bool = False):
        self.good, self.out = good, False  # out: a marked element that is boilerplate; mark: the innermost marked element about it
        self.mark: Node | None = self if marked else parent.mark if parent is not None else None
        self.name, self.parent, self.path, self.bad, self.link = name, parent, path, bad, link
        # the innermost block and container that it is, or lies in
        self.block: Node = self if name in BLOCKS or parent is None else parent.block
        self.box: Node = self if name in CONTAINERS or parent is None else parent.box
        self.score, self.worth, self.text, self.own = 0.0, 0.0, 0, False  # own: has text outside of inner containers
        self.best = 1.25 if good else 1.0
        self.no = self.last = 0
        self.chars = self.link_chars = 0  # of the text below, before white space is settled
        self.free = self.covered = False
        self.story: Node | None = None  # the outermost container about it that is named as an article


class Page:
    """Blocks of text in page order, each with its node; the scored containers; the marked elements in page order."""

    __slots__ = ("blocks", "containers", "marked", "nodes", "pieces", "root")

    def __init__(self) -> None:
        self.root = Node("body", None, "body", False, False, False)
        self.nodes = [self.root]
        self.blocks: list[tuple[Node, str, int]] = []  # node, text, characters within links
        self.containers = [self.root]
        self.marked: list[Node] = []
        self.pieces: list[tuple[Node, list[tuple[Node, str]]]] = []  # node, text as it stands in the elements


def _path(above: str, shown: str) -> str:
    found = f"{above}/{shown}"
    return found if len(found) <= LONGEST_PATH else "#" + hashlib.blake2b(found.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _described(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """Generalised tag-class name, whether a word marks boilerplate, whether one marks content, whether one names an article. inside: of an article or
    main, where a header is part of it."""
    marked, good, story, shown = False, name in ("article", "main"), False, name
    if "=" in attributes:
        for key, *values in _CLASS.findall(attributes):
            value = next(filter(None, values), "")
            words = [w.lower() for w in _WORD.findall(value)]
            for i, w in enumerate(words):
                if w in MARKS and not (i and words[i - 1] in NOT_MARKED) and not (w == "header" and (inside or i and words[i - 1] in STORY)):
                    marked = True
                    break
            else:
                good |= any(w in GOOD for w in words)
                story |= any(w in STORY for w in words)
            if key.lower() == "class":
                shown += "." + "-".join(w if w.isalpha() else "N" for w in words)
    return shown, marked, good, story


def parsed(html: str, path: str | None = None) -> Page:
    page = Page()
    stack = [page.root]
    stops: list[int] = []  # where in the stack elements of STOPS are
    opened: Counter[str] = Counter()
    pieces: list[tuple[Node, str]] = []
    at, n = 0, len(html)

    def flush(node: Node) -> None:
        if pieces:
            page.pieces.append((node.block, pieces.copy()))
            pieces.clear()

    def close(i: int) -> None:
        """Elements of the stack from i on."""
        for x in stack[i:]:
            opened[x.name] -= 1
        del stack[i:]
        while stops and stops[-1] >= i:
            stops.pop()

    def take(text: str) -> None:
        top = stack[-1]
        if not top.bad:
            pieces.append((top, text))

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" or opened[name]:
                if name in BLOCKS or name in DROPPED:
                    flush(stack[-1])
                if opened[name]:
                    i = len(stack) - 1
                    while stack[i].name != name:
                        i -= 1
                    close(i)
            continue
        if name == "br" or name == "hr" or name == "wbr":
            take(" " if name != "wbr" else "")
            if name == "hr":
                flush(stack[-1])
            continue
        if name in ("html", "body"):
            if name == "body" and len(stack) > 1 and stack[1].name == "head":
                flush(stack[-1])
                close(1)
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS or name in DROPPED:
            flush(stack[-1])
            closes, walls = CLOSES.get(name, ((), ()))
            k = len(stops) - 1
            while k >= 0:
                i = stops[k]
                if stack[i].name in walls or stack[i].name in BLOCKS and stack[i].name not in closes:
                    break
                if stack[i].name in closes:
                    close(i)
                    if name not in ("li", "dt", "dd", "td", "th", "tr", "tbody"):
                        break
                k -= 1
        inside = opened["article"] + opened["main"] > 0
        shown, marked, good, story = _described(name, m[3], inside)
        marked |= name == "form"  # one round the whole page is no form to its reader
        bad = name in DROPPED
        top = stack[-1]
        if name == "header" and not inside and not story:
            bad = True
        unclean = marked
        if name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "article", "main"):
            marked = False
        bad = bad or top.bad
        node = Node(name, top, _path(top.path, shown) if name in CONTAINERS else top.path, bad, top.link or name == "a", good, marked and not bad)
        node.good = good and not unclean
        node.story = node if story and not unclean and name in CONTAINERS else None
        if marked and not bad:
            page.marked.append(node)
        node.no = node.last = len(page.nodes)
        page.nodes.append(node)
        if name in CONTAINERS and not node.bad:
            page.containers.append(node)
        if m[0].endswith("/>") and name in ("path", "g", "use", "rect"):
            continue
        if name in STOPS:
            stops.append(len(stack))
        opened[name] += 1
        stack.append(node)
    flush(stack[-1])
    for x in reversed(page.nodes[1:]):
        x.parent.last = max(x.last, x.parent.last)
    settled(page, path)
    scored(page)
    return page


def scored(page: Page) -> None:
    """Containers' scores, and what region() asks of them: one pass up and one down."""
    # a block's text counts whole for the nearest container, and half as much for each one above
    for node, text, links in page.blocks:
        worth = max(0.0, len(text) - 2.0 * links) + (20.0 if node.name == "p" and len(text) > 40 else 0.0)
        box = node.box
        if worth and (box is not page.root or node.name in HEADS):
            box.own = True
        box.worth += worth
        box.text += len(text)
    boxes = [c for c in page.nodes if c.box is c]
    for c in reversed(boxes):
        c.score = c.worth * c.best
        if c.parent is not None:
            c.parent.box.worth += c.worth / 2
            c.parent.box.text += c.text
    for c in boxes:
        up = c.parent.box if c.parent is not None else None
        # the outermost article and main, and the outermost container with text of its own, from the root and from that main on
        c.article = up.article if up is not None and up.article is not None else c if c.name == "article" else None
        c.main = up.main if up is not None and up.main is not None else c if c.name == "main" else None
        c.story = up.story if up is not None and up.story is not None else c.story
        c.region_own = up.region_own if up is not None and up.region_own is not None else c if c.own else None
        above = up.main_own if up is not None else None
        c.main_own = above if above is not None else c if c.main is not None and c.own else None


def _hidden(node: Node) -> bool:
    return node.mark is not None and node.mark.out


def settled(page: Page, path: str | None) -> None:
    """Decide which marked elements are boilerplate, and make blocks of the remaining text.

    From the outermost on, a marked element stays if it holds a main, or a container on the host's path; or an article whose own class
    bears no mark, if no article or main outside of what is marked has text or this one is longer than all that is outside; or
    more than half of the page's text, most of it not links, while no article, main or container of good name beside it has text.
    """
    if page.marked:
        shown_by: dict[Node | None, list[Node]] = {}  # the elements with text in each marked one, but not in one that it holds
        total = 0
        held: dict[Node, int] = {}
        for _, parts in page.pieces:
            for node, text in parts:
                if size := len(text.strip()):
                    total += size
                    if node not in held:
                        shown_by.setdefault(node.mark, []).append(node)
                    held[node] = held.get(node, 0) + size
                    node.chars += size
                    node.link_chars += size * node.link
        for x in reversed(page.nodes[1:]):
            x.parent.chars += x.chars
            x.parent.link_chars += x.link_chars
        needed: set[Node] = set()  # marked elements that hold a main or the host's path
        longest: dict[Node, int] = {}  # the longest article in a marked element
        for c in page.nodes:
            if c.mark is None or not c.chars or c.box is not c and c.mark is not c:
                continue
            if c.name == "article" and c.good and c.path != path:
                longest[c.mark] = max(c.chars, longest.get(c.mark, 0))
            elif c.name == "main" or c.path == path and c.name in CONTAINERS:
                m: Node | None = c.mark
                while m is not None and m not in needed:
                    needed.add(m)
                    m = m.parent.mark
        for m in reversed(page.marked):
            if m in longest and (up := m.parent.mark) is not None:
                longest[up] = max(longest[m], longest.get(up, 0))
        within: dict[Node | None, list[Node]] = {}
        for m in page.marked:
            m.out = True
            within.setdefault(m.parent.mark, []).append(m)
        # what is not hidden: its characters, whether articles are among it, and where its containers of good name begin and end
        outside, articles, first, last = 0, False, -1, len(page.nodes)
        level, told = within.get(None, []), [None]
        while level:
            for m in told:
                for node in shown_by.get(m, ()):
                    outside += held[node]
                    up = node
                    while up is not None and not up.free:
                        up.free = True
                        articles |= up.name in ("article", "main")
                        if up.good:
                            first, last = max(first, up.no), min(last, up.last)
                        up = up.parent
            told = []
            for m in level:
                if m in needed or m in longest and (not articles or longest[m] > outside):
                    told.append(m)
                elif 2 * m.chars > total and 2 * m.link_chars <= m.chars and first <= m.no <= last:
                    told.append(m)
            for m in told:
                m.out = False
            level = [x for m in told for x in within.get(m, ())]
    for node, parts in page.pieces:
        shown = [(x, text) for x, text in parts if not _hidden(x)] if page.marked else parts
        text = _SPACE.sub(" ", unescape("".join([text for _, text in shown]))).strip()
        if text:
            page.blocks.append((node, text, sum([len(text) for x, text in shown if x.link])))
    if page.marked:
        page.containers = [c for c in page.containers if not _hidden(c)]


def best(page: Page) -> Node:
    return max(page.containers, key=lambda c: c.score)


def region(node: Node) -> Node:
    """What belongs to the container node: its outermost article or main, else container named as an article, and up to the highest ancestor with
    text of its own."""
    at = node.article or node.main or node.story or node
    if node.article is not None and (node.main is None or node.main.no >= node.article.no):
        return at
    wide = node.main_own if node.main is not None else node.region_own
    return wide if wide is not None and wide.no < at.no else at


def alike(page: Page, top: Node) -> list[Node]:
    """top, the containers on its path, and where it is an article those beside it."""
    return [c for c in page.containers if c is top or c.text and (c.path == top.path or c.name == top.name == "article" and c.parent is top.parent)]


def passed_over(page: Page, top: Node) -> set[str]:
    """Paths of the regions that the page would choose in each part beside top."""
    chain, up = set(), top.parent
    while up is not None:
        chain.add(id(up))
        up = up.parent
    chosen = set(map(id, alike(page, top)))
    parts: dict[int, Node | None] = {}  # of each container, the highest above it that is not above top; None within top
    loudest: dict[int, Node] = {}
    shown = set(map(id, page.containers))
    for c in page.nodes:
        if c.box is not c or id(c) in chain:
            continue
        up = c.parent.box if c.parent is not None else None
        if id(c) not in shown:
            if id(up) in parts:
                parts[id(c)] = parts[id(up)]
            continue
        part = None if id(c) in chosen else parts[id(up)] if up is not None and id(up) in parts else c
        parts[id(c)] = part
        if part is not None and c.text and (id(part) not in loudest or c.score > loudest[id(part)].score):
            loudest[id(part)] = c
    return {r.path for r in map(region, loudest.values()) if id(r) not in chain and r.path != top.path}


def text_under(page: Page, tops: list[Node]) -> str:
    for c in tops:
        c.covered = True
    for c in page.nodes:
        if not c.covered and c.parent is not None:
            c.covered = c.parent.covered
    return "\n\n".join(text for node, text, _ in page.blocks if node.covered)


def main_text(html: str, path: str | None, noise: Iterable[str] = ()) -> str:
    """The text below the containers on path and below the page's own region, the latter not if it is noise beside them."""
    page = parsed(html, path)
    own = region(best(page))
    there = [c for c in page.containers if c.path == path and c.text]
    if there and own.path in noise:
        return text_under(page, there)
    return text_under(page, [*there, *alike(page, own)])


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_VOTE = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("voted", T.IntegerType())])
_TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _seen(pages: DataFrame) -> DataFrame:
    """host, path, chars, voted: of each page with text its vote (1), and the paths that it passed over (0)."""

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for hosts, htmls in batches:
            out = []
            for h, html in zip(hosts, htmls):
                page = parsed(html)
                c = region(best(page))
                if c.text:
                    out.append((h, c.path, c.text, 1))
                    out += [(h, path, 0, 0) for path in passed_over(page, c)]
            yield out

    return arrow_rows(pages.select(host().alias("host"), no_null_text("html")), _VOTE, rows)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, chars: one vote a page with text."""
    return _seen(pages).where("voted = 1").select("host", "path", "chars")


def winners(pages: DataFrame) -> DataFrame:
    """host, path, noise: the path with most votes of each host, and those with votes that more pages passed over."""
    counted = _seen(pages).groupBy("host", "path").agg(F.sum("voted").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("seen")).where("n > 0")
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path"))
    return counted.groupBy("host").agg(first.alias("w"), F.collect_list(F.when(F.col("seen") > 2 * F.col("n"), F.col("path"))).alias("noise")).select("host", F.col("w.path").alias("path"), "noise")


def _by_file(pages: DataFrame, won: DataFrame) -> tuple[str, int]:
    """Writes the winners of each input file's hosts, in buckets of files: the folder and the number of buckets. Of a file and host there is one
    row, however many pages."""
    of_file = pages.select(F.col("_metadata.file_path").alias("file"), host().alias("host")).distinct().join(won, "host")
    held = written(of_file, "file-paths")
    buckets = held.count() // BUCKET_ROWS + 1
    path = fresh_dir(pages.sparkSession, "paths-by-file")
    held.withColumn("bucket", F.pmod(F.crc32(F.encode("file", "utf-8")), F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("file").write.partitionBy("bucket").parquet(path)
    return path, buckets


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html). The pages themselves are never shuffled."""
    won = written(winners(pages), "paths")
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), no_null_text("html"), host().alias("host")]
    few = won.count() <= BROADCAST_HOSTS
    if few:
        rows_in = pages.select(*columns).join(F.broadcast(won), "host", "left").select("page_id", "url", "html", "path", "noise")
        folder, buckets = "", 0
    else:
        try:
            pages.select("_metadata.file_path")
        except AnalysisException:  # no scan of files
            pages = written(pages.select("page_id", "url", "html"), "pages")
        folder, buckets = _by_file(pages, won)
        rows_in = pages.select(*columns, F.col("_metadata.file_path").alias("file")).select("page_id", "url", "html", "host", "file")

    def looked_up(batches: Iterator[list[list]]) -> Iterator[tuple]:
        held: tuple[str | None, dict] = (None, {})
        for ids, page_urls, htmls, hosts, files in batches:
            paths, noises = [], []
            for h, file in zip(hosts, files):
                if held[0] != file:  # a task reads its files one after another
                    own = read_table(f"{folder}/bucket={zlib.crc32(file.encode()) % buckets}", [("file", "=", file)])
                    held = (file, {} if own is None else {x["host"]: (x["path"], x["noise"]) for x in own.select(["host", "path", "noise"]).to_pylist()})
                path, noise = held[1].get(h, (None, None))
                paths.append(path)
                noises.append(noise)
            yield ids, page_urls, htmls, paths, noises

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for columns in batches if few else looked_up(batches):
            out = []
            for page_id, url, html, path, noise in zip(*columns):
                text = main_text(html, path, noise or ())
                out.append((page_id, url, text, len(text)))
            yield out

    return arrow_rows(rows_in, _TEXT, rows)
