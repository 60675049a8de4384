"""Main text of HTML pages with a site style tree.

The pages of a host are merged into one style tree (Yi, Liu & Li, KDD 2003): a node is a
path of block elements with their classes and ids, menus and adverts included. A node's
importance is the entropy of what stands there over the host's distinct pages, with the
number of those pages as the logarithm's base: 0 where all pages show the same, 1 where all
differ. Presentation counts the sequence of child elements, content the text; a branch is as
important as the larger of both. Branches of low importance are removed from each page. Names
that speak of menus or adverts raise the importance a branch must have; they never act inside
the article. Where several boxes of a page share a path, one text of theirs that comes back on
most pages goes by its own information, -log of its share of pages, the term whose mean is the
entropy.

What a page's own markup declares not to be the article (nav, footer, aside, form, a box
whose whole class is "sidebar") goes without the tree.

The tree is built by counting in Spark: (host, page, node) rows are reduced to (host, node,
variant) counts and then to entropies, so a host of any size is spread over tasks. Only
low-importance branches come back to the pages: by broadcast while they are few, else by a
join on the host, large hosts in pieces.

Parsing takes time and memory in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from stratasift.llm.common import materialise

#: Distinct pages of a host before it is judged, importance below which a branch goes, and a branch with a telling name.
LEAST_PAGES, LEAST_IMPORTANCE, NAMED_IMPORTANCE = 5, 0.3, 0.9
#: Least share of a host's pages that show one text of several boxes of a path; most broadcast branches; pages of a host in a piece of the join.
VARIANT_SHARE, BROADCAST_ROWS, PIECE = 0.5, 100_000, 10_000
#: Elements whose text is no block of an article, elements that open a block, elements without an end, raw text.
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea input label fieldset dialog menu head title".split())
BLOCK_TAGS = frozenset("html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset hr details summary center dialog menu".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title xmp svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_ROLES = frozenset(["main", "article"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Whole classes and ids that declare what is not the article; those of adverts and reader comments do so inside it too.
MARKS_INSIDE = frozenset("ad ads adbox advert adverts advertisement sponsored comment comments comment-list comments-area disqus_thread respond".split())
MARKS = MARKS_INSIDE | frozenset("nav navbar menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar widget cookie cookies cookie-notice cookie-banner consent banner newsletter share social related pagination toolbar".split())
#: Words of classes and ids that make a branch suspect outside the article.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets notice notices cookie cookies consent gdpr "
    "banner alert popup modal overlay ad ads adbox adslot advert adverts advertisement sponsor sponsored promo promotion form search newsletter subscribe signup login "
    "comment comments disqus respond replies discussion share sharing social related recommended pagination pager toolbar skip".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's attributes up to its end; possessive, so that nothing is read twice.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,});?")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
#: Classes that tell of a layout, such as has-sidebar.
_LAYOUT = re.compile(r"(?:has|with|no|without|is|js)[-_]", re.I)
#: A start tag on the left ends an open element on the right, through an open paragraph.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}


def decode(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, become U+FFFD."""
    if "&#" in text:
        text = _LONG_NUMBER.sub("�", _ZEROS.sub("&#", text))
    return entities.unescape(text)


def digest(*parts: object) -> int:
    return xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def _attributes(source: str) -> tuple[list[str], str, str, bool]:
    """Classes, id, role and whether the element is hidden."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found.get("class", "").split(), found.get("id", ""), found.get("role", "").lower(), "hidden" in found


def _suspect(names: list[str]) -> bool:
    return any(not NOISE_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(n)) for n in names if not _LAYOUT.match(n))


class Page:
    """Blocks of a page and the nodes of its tree.

    A block is (text, in the article, number of its innermost node). Nodes are numbered
    parents first: parent, path (a hash chained along the branch), tag, suspect name, items
    (texts and child nodes in order).
    """

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, bool, int]] = []
        self.parents: list[int] = [-1]
        self.paths: list[int] = [0]
        self.tags: list[str] = [""]
        self.suspect: list[bool] = [False]
        self.items: list[list[str | int]] = [[]]
        self._parse(html or "")

    def _flush(self, pieces: list[str], frame: tuple) -> None:
        if pieces:
            text = " ".join(decode("".join(pieces)).split())
            pieces.clear()
            if text:
                self.items[frame[3]].append(text)
                if not frame[1]:
                    self.blocks.append((text, frame[2], frame[3]))

    def _parse(self, html: str) -> None:
        # An open element: tag, is noise, is in the article, number of its node, is noise by its element.
        stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]
        opened: dict[str, int] = {}
        pieces: list[str] = []
        inline, inline_depth = "", 0  # an inline element that is noise, and how many of its name are open
        quotes = True  # until a quote is found that no tag closes

        def cut(depth: int) -> None:
            for frame in stack[depth:]:
                opened[frame[0]] -= 1
            del stack[depth:]

        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0 or start + 1 >= size:
                start = size
            if start > at and not inline:
                pieces.append(html[at:start])
            if start == size:
                break
            if html[start + 1] in "!?":
                end = html.find("-->", start + 4) + 2 if html.startswith("<!--", start) else html.find(">", start)
                at = size if end < 2 else end + 1
                continue
            name = _NAME.match(html, start + 1)
            if not name:
                if not inline:
                    pieces.append("<")
                at = start + 1
                continue
            end = html.find(">", name.end())
            if end < 0:  # no tag ends any more
                if not inline:
                    pieces.append(html[start:])
                break
            if quotes:
                found = _REST.match(html, name.end())
                end = found.end() - 1 if found else -1
                if end < 0:
                    quotes, end = False, html.find(">", name.end())
            at = end + 1
            tag, rest = name[2].lower(), html[name.end() : end]
            block = tag in BLOCK_TAGS
            if name[1]:
                if inline and tag == inline:
                    inline_depth -= 1
                    if not inline_depth:
                        inline = ""
                if block and opened.get(tag):
                    self._flush(pieces, stack[-1])
                    inline = ""
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    cut(depth)
                elif block:
                    self._flush(pieces, stack[-1])
                continue
            if tag == "br":
                if not inline:
                    pieces.append("\n")
                continue
            if block:
                self._flush(pieces, stack[-1])
                inline = ""
                depth = len(stack) - 1
                if stack[depth][0] == "p":
                    if tag == "p" or tag in _CLOSES:
                        cut(depth)
                    depth -= 1
                if tag in _CLOSES:
                    if tag == "tr" and stack[depth][0] in ("td", "th"):
                        depth -= 1
                    if stack[depth][0] in _CLOSES[tag]:
                        cut(depth)
            if tag in VOID_TAGS:
                continue
            if tag in RAW_TAGS and not rest.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
                continue
            if inline:
                inline_depth += tag == inline
                continue
            classes, ident, role, hidden = _attributes(rest) if rest else ([], "", "", False)
            up = stack[-1]
            names = [*classes, ident] if ident else classes
            declared = up[4] or hidden or tag in NOISE_TAGS or role in NOISE_ROLES
            main = up[2] or tag in ("article", "main") or role in MAIN_ROLES
            noise = up[1] or declared or (tag == "header" and not up[2])
            root = tag in ("html", "body", "main") or role == "main"
            if not noise and names and not root:
                marks = MARKS_INSIDE if main else MARKS
                noise = any(n.lower() in marks for n in names)
            if tag == "main":
                noise = declared
            if not block:
                if noise and not up[1]:
                    inline, inline_depth = tag, 1
                continue
            number = up[3]
            # Below a branch that is noise already nothing is left to judge.
            if not up[1] and tag not in ("html", "body"):
                number = len(self.parents)
                self.items[up[3]].append(number)
                self.parents.append(up[3])
                self.paths.append(digest(self.paths[up[3]], tag, " ".join(classes), ident))
                self.tags.append(tag)
                self.suspect.append(not main and not root and bool(names) and _suspect(names))
                self.items.append([])
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, noise, main, number, declared))
        self._flush(pieces, stack[-1])

    def contents(self) -> tuple[list[int], list[int]]:
        """(content, presentation) hash of each node; 0 for a node without text or child elements."""
        content, look = [0] * len(self.parents), [0] * len(self.parents)
        for n in range(len(self.parents) - 1, -1, -1):
            parts = [content[i] if isinstance(i, int) else digest(i) for i in self.items[n]]
            parts = [p for p in parts if p]
            content[n] = digest(*parts) if parts else 0
            tags = [self.tags[i] for i in self.items[n] if isinstance(i, int)]
            look[n] = digest(*tags) if tags else 0
        return content, look

    def nodes(self) -> list[tuple[int, int, int, int, bool]]:
        """Rows (path, content, presentation, kind, suspect): kind 1 is a node, 2 one text of several boxes of a path, 3 both.

        A path that comes several times on a page is one node of it, with the sum of its
        boxes' hashes.
        """
        content, look = self.contents()
        by_path: dict[int, list[int]] = {}
        for n in range(1, len(self.parents)):
            by_path.setdefault(self.paths[n], []).append(n)
        out = []
        for path, members in by_path.items():
            suspect = self.suspect[members[0]]
            if len(members) == 1:
                out.append((path, content[members[0]], look[members[0]], 3, suspect))
                continue
            whole = (1 << 64) - 1
            out.append((path, sum(content[n] for n in members) & whole, sum(look[n] for n in members) & whole, 1, suspect))
            out += [(path, c, 0, 2, suspect) for c in {content[n] for n in members} if c]
        return out

    def identity(self) -> int:
        """Hash of the article, or of the whole text where nothing is marked as one: copies of an article are one page."""
        main = any(m for _, m, _ in self.blocks)
        return digest(*(t for t, m, _ in self.blocks if m >= main))

    def text(self, low: set[tuple[int, int]] | frozenset = frozenset(), judged: bool = False) -> str:
        """Blocks of the article, or of the body where nothing is marked as one, without branches of low importance.

        low has (path, 0) for a branch and (path, content) for one text of it. Suspect
        names count by themselves only on hosts that are not judged. A heading goes with its
        branch only: "Summary" may head every article of a host.
        """
        main = any(m for _, m, _ in self.blocks)
        gone = [False] * len(self.parents)
        content = self.contents()[0] if low else gone
        for n in range(1, len(self.parents)):
            gone[n] = gone[self.parents[n]] or (not judged and self.suspect[n])
            if low and not gone[n] and self.tags[n] not in HEADINGS:
                gone[n] = (self.paths[n], 0) in low or (self.paths[n], content[n]) in low
        return " ".join(t for t, m, n in self.blocks if m >= main and not gone[n])


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else ""


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts, of rows (url, html). Copies of an article count once.

    Nodes: host (a hash), path, suspect, pages, importance. Variants, texts of boxes that
    share a path: host, path, content, n (pages that show it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, suspect = [], []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html)
                nodes = page.nodes()
                host, own = digest(host_of(url)), page.identity()
                rows += [(host, own, *node[:4]) for node in nodes]
                suspect += [node[4] for node in nodes]
            columns = np.array(rows, dtype=np.uint64).reshape(-1, 6).view(np.int64)
            yield pa.record_batch([*(pa.array(columns[:, c]) for c in range(6)), pa.array(suspect, pa.bool_())], ["host", "page", "path", "content", "look", "kind", "suspect"])

    nodes = pages.select("url", "html").mapInArrow(run, "host long, page long, path long, content long, look long, kind long, suspect boolean")
    nodes, _ = materialise(nodes)  # pages are parsed once for the tree
    # One node a page and path: of copies that differ around the article, the least hashes.
    one = nodes.where("kind <> 2").groupBy("host", "path", "page").agg(F.min("content").alias("content"), F.min("look").alias("look"), F.bool_or("suspect").alias("suspect"))
    variants = nodes.where("kind <> 1 and content <> 0").select("host", "path", "content", "page").distinct().groupBy("host", "path", "content").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    one, _ = materialise(one)

    def entropy(kind: str) -> DataFrame:
        n = one.groupBy("host", "path", kind).agg(F.count("*").alias("n"), F.bool_or("suspect").alias("suspect"))
        n = n.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.bool_or("suspect").alias("suspect"))
        return n.select("host", "path", "suspect", "pages", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0).alias(kind))

    both = entropy("content").join(entropy("look").drop("pages", "suspect"), ["host", "path"])
    return both.select("host", "path", "suspect", "pages", F.greatest("content", "look").alias("importance")), variants


def low_branches(pages: DataFrame) -> DataFrame:
    """What goes from the pages of judged hosts: host, path, content (0: the branch itself); a row with path 0 for each judged host."""
    tree, variants = style_tree(pages)
    tree, _ = materialise(tree)
    judged = tree.where(F.col("pages") >= LEAST_PAGES)
    least = F.when(F.col("suspect"), NAMED_IMPORTANCE).otherwise(LEAST_IMPORTANCE)
    zero = F.lit(0).cast("long").alias("content")
    branches = judged.where(F.col("importance") < least).select("host", "path", zero)
    information = -F.log(F.col("n") / F.col("pages")) / F.log("pages")
    texts = variants.join(judged.select("host", "path", "pages"), ["host", "path"])
    texts = texts.where((information < LEAST_IMPORTANCE) & (F.col("n") >= VARIANT_SHARE * F.col("pages"))).select("host", "path", "content")
    hosts = judged.select("host").distinct().select("host", F.lit(0).cast("long").alias("path"), zero)
    return branches.unionByName(texts).unionByName(hosts)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a page row: page_id, url, text, n_chars (code points).

    Null html counts as empty, a null or odd url as the host "". White space, as str.split()
    has it, becomes one space inside a block; blocks follow the page's order. Repeated rows
    are pages of their own, whose copies count once in the tree; null ids stay; other columns
    are ignored; an empty table gives an empty result. A host of fewer than LEAST_PAGES
    distinct pages has no tree: there suspect names decide, outside the article.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low, _ = materialise(low_branches(source))
    out = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = find(batch, i, url)
                texts.append(Page(html).text(own or frozenset(), judged=own is not None))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out.names)

    whole = (1 << 64) - 1
    if low.count() <= broadcast_rows:
        table: dict[int, set[tuple[int, int]]] = {}
        for r in low.toLocalIterator():
            own = table.setdefault(r.host & whole, set())
            if r.path:
                own.add((r.path & whole, r.content & whole))
        shared = pages.sparkSession.sparkContext.broadcast(table)
        return source.mapInArrow(lambda it: cut(it, lambda batch, i, url: shared.value.get(digest(host_of(url)))), out)

    # More branches than a broadcast should hold: each host's own list travels to its pages, one copy for PIECE pages.
    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([digest(host_of(u)) for u in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(h)], [*batch.schema.names, "host"])

    named = source.mapInArrow(hosts, T.StructType([*source.schema.fields, T.StructField("host", T.LongType())]))
    pieces = named.groupBy("host").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    lists = low.groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("low")).join(pieces, "host")
    lists = lists.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    cut_up = named.join(F.broadcast(pieces.where("pieces > 1")), "host", "left")  # hosts of more than PIECE pages: one row for PIECE pages at most
    cut_up = cut_up.withColumn("piece", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("pieces", F.lit(1))))
    joined = cut_up.join(lists, ["host", "piece"], "left").select("page_id", "url", "html", "low")

    def own_list(batch: pa.RecordBatch, i: int, url: str | None):
        rows = batch.column(3)[i].as_py()
        return None if rows is None else {(r["path"] & whole, r["content"] & whole) for r in rows if r["path"]}

    return joined.mapInArrow(lambda it: cut(it, own_list), out)
