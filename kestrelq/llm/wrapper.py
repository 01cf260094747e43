"""HTML extraction by wrapper induction.

For each host some pages are parsed into trees and aligned by simple tree matching: the largest mapping that keeps labels, order and
parents, where runs of siblings of one structure (paragraphs, rows, list items) count as one node. Pages that map onto the same first page
share a layout. Texts that stand at one node on nearly all pages of a layout are template; what varies are slots. The container is the
innermost element that still holds nearly all slot text, links counting against it; an article or main element, or one with a varying
heading of its own, is not entered further. A page is extracted by its host's wrapper: the blocks of that container less the template.
In an article or main element constant plain paragraphs stay, as articles repeat lines of their own.

Two things are told by tags and by words in class, id and role, as they vary from page to page like an article does: what never is
article text (menus, headers, footers, sidebars, notices, adverts, forms, comments), and, where a host has too few pages to
align or a page does not have the container, the container of the page alone.

At most `SAMPLE` pages a host are aligned, those with the smallest hashes of page_id and url, and of pages whose own texts are alike one.
Sampled ids and wrappers are broadcast while they are few and small; beyond that the same joins are shuffled ones. So no host's pages are
ever gathered. Matching is bounded: of more than `MOST_KIDS` children on both sides those with equal labels are paired in order, and what lies
deeper than `MOST_DEPTH` levels counts as text of its ancestor.

Defined results: a null html counts as empty and gives an empty text; a null or odd url has the host ''; markup that is never closed is
closed where HTML says so; very long pages are parsed whole; of equal candidates for the container the first wins; repeated rows get equal
results and count once in the sample; an empty table gives an empty one; other columns, also those named like its own, are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelq.llm.common import Workspace, slices, small_hash_sample, table, trimmed

#: Pages of a host that are aligned; pages of a layout from which it has a template, and the share of them that a text of it is on; the share
#: of own texts from which two pages are copies; the share of nodes from which two pages have one layout.
SAMPLE, LEAST_PAGES, CONSTANT, ALIKE, SAME_LAYOUT = 16, 3, 0.9, 0.5, 0.5
#: The share of slot text that an element must hold to be entered.
ENTER = 0.75
MOST_KIDS, MOST_DEPTH = 150, 40
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32_000_000
#: Elements of HTML without content, those that end a paragraph, and what an element's start ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr"), "tfoot": ("tbody", "tr"), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "body": ()}
#: Elements that never hold an article's text, and words in class, id or role that name such parts of a page.
NEVER = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea dialog menu audio video".split())
SILENT = frozenset("head script style noscript template".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|aside|widgets?|related|recommend\w*|share|sharing|social|breadcrumbs?|menu\w*|nav\w*|toc|comments?|commentlist|reply|replies|respond|disqus|discussion|footer|foot|masthead|topbar|toolbar|pagination|pager|copyright|legal|skip|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body)(?:$|[\s_-])", re.I)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split()) | {""}
CONTAINERS = frozenset("article main section div table tbody tr td body html center blockquote".split())


class Node:
    __slots__ = ("tag", "label", "parts", "parent", "skip", "linked", "within", "path")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]], parent: Node | None):
        from xxhash import xxh64_intdigest

        held = {k: v or "" for k, v in attributes}
        self.tag, self.parent, self.parts = tag, parent, []
        names = re.sub(r"\d+", "", " ".join(held[k] for k in ("class", "id", "role", "itemprop") if k in held)).strip()
        self.label = f"{tag} {names}" if names else tag
        #: A hash of the labels from the root, as deep trees have long paths.
        self.path = xxh64_intdigest(self.label, parent.path if parent is not None else 0)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        #: Whether it lies in an article.
        self.within = parent is not None and (parent.within or parent.tag == "article")
        hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "")
        self.skip = (parent is not None and parent.skip) or tag in NEVER or hidden or (tag == "header" and not self.within) or bool(names and tag not in ("body", "html", "article", "main") and NAMED.search(names))

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if isinstance(p, Node))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", [], None)
        self.open: Counter[str] = Counter()  # how many elements of a tag are open, so that no end is looked for in vain

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag not in ("html", "body"):
            self._end(("p",), ("button", "td", "th", "table"))
        if tag in ENDS:
            self._end(ENDS[tag], SCOPES[tag])
        node = Node(tag, attrs, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("svg", "path"):
            return  # a slash does not close an element of HTML
        if self.at.tag == tag:
            self._close(self.at)

    def _close(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end((tag,), ())

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def _end(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Closes the innermost of these elements, if it lies within the scope, and all in it."""
        node, found = self.at, None
        if not any(self.open[t] for t in tags):
            return
        while node.tag != "#" and node.tag not in scope:
            if node.tag in tags:
                found = node
                if len(tags) == 1:
                    break
            node = node.parent
        if found is not None:
            self._close(found)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def blocks(node: Node, skipped: bool = False) -> list[tuple[Node, str]]:
    """Element and text of the node's blocks, in page order, with white space made one space; skipped parts are left out unless asked for."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def close(owner: Node) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((owner, text))

    # (node, its next part, element of its block); a stack of its own, as unclosed markup nests deeply
    stack: list[list] = [[node, 0, node]]
    while stack:
        top = stack[-1]
        own, i, owner = top
        if i == len(own.parts):
            stack.pop()
            if own.tag in BLOCK:
                close(owner)
            continue
        top[1] += 1
        part = own.parts[i]
        if isinstance(part, str):
            held.append(part)
        elif part.tag in SILENT or part.skip and not skipped:
            if part.tag in BLOCK or part.tag in NEVER:
                close(owner)
        elif part.tag in ("br", "hr"):
            close(owner)
        elif part.tag in BLOCK:
            close(owner)
            stack.append([part, 0, part])
        else:
            stack.append([part, 0, owner])
    close(node)
    return out


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(node.children())))


def masses(root: Node) -> dict[Node, float]:
    """Text in each element without skipped parts, where text within links counts against it."""
    own: dict[Node, float] = {}
    order = list(_walk(root))
    for node in order:
        own[node] = 0.0 if node.skip else sum(len(p.strip()) for p in node.parts if isinstance(p, str)) * (-0.5 if node.linked else 1.0)
    for node in reversed(order):
        if node.parent is not None:
            own[node.parent] += own[node]
    return own


def container(root: Node, weight: dict[Node, float] | None = None) -> Node:
    """The element that holds the article: an article or main element, or else the innermost one with nearly all text."""
    weight = weight or masses(root)
    named = [n for n in weight if not n.skip and (n.tag in ("article", "main") or n.tag in ("div", "section", "td") and MAIN.search(n.label[len(n.tag) :]))]
    total = max(1.0, weight[root])
    for tags in (("article",), ("main",), ("div", "section", "td")):
        found = [n for n in named if n.tag in tags and weight[n] > 0.3 * total]
        if found:
            node = max(found, key=lambda n: weight[n])
            inner = [n for n in found if n is not node and _within(n, node) and weight[n] > 0.7 * weight[node]]
            return inner[-1] if inner else node
    node = root
    while True:
        deeper = max((n for n in node.children() if not n.skip and n.tag in CONTAINERS), key=lambda n: weight[n], default=None)
        if deeper is None or weight[deeper] < 0.75 * max(1.0, weight[node]):
            return node
        node = deeper


def _within(node: Node | None, ancestor: Node) -> bool:
    while node is not None:
        if node is ancestor:
            return True
        node = node.parent
    return False


# --- simple tree matching ------------------------------------------------------------------------------------------------------


class Shape:
    """A tree for matching: element, label, structure, its own texts, whether they are linked, children; runs of children of one structure are one."""

    __slots__ = ("node", "label", "structure", "texts", "linked", "kids", "size")

    def __init__(self, node: Node, texts: list[str], linked: int, kids: list[Shape]):
        self.node, self.label, self.texts, self.linked, self.kids = node, node.label, texts, linked, kids
        self.structure = (node.label, tuple(k.structure for k in kids)) if len(kids) < MOST_KIDS else (node.label, len(kids))
        self.size = 1 + sum(k.size for k in kids)


def shape(root: Node) -> Shape:
    texts: dict[Node, list[str]] = {}
    for owner, text in blocks(root, skipped=True):
        texts.setdefault(owner, []).append(text)
    return _shape(root, texts, 0)


def _block_kids(node: Node) -> list[Node]:
    """The nearest elements below that are blocks."""
    out, stack = [], list(reversed(list(node.children())))
    while stack:
        child = stack.pop()
        if child.tag in SILENT:
            continue
        if child.tag in BLOCK:
            out.append(child)
        else:
            stack.extend(reversed(list(child.children())))
    return out


def _shape(node: Node, texts: dict[Node, list[str]], depth: int) -> Shape:
    own, kids = list(texts.get(node, ())), []
    if depth >= MOST_DEPTH:
        own += [t for below in list(_walk(node))[1:] for t in texts.get(below, ())]
        return Shape(node, own, 0, [])
    for child in _block_kids(node):
        made = _shape(child, texts, depth + 1)
        if kids and kids[-1].structure == made.structure:
            _merge(kids[-1], made)
        else:
            kids.append(made)
    linked = sum(len(x) for n in _walk_inline(node) if n.linked for x in n.parts if isinstance(x, str))
    return Shape(node, own, linked, kids)


def _walk_inline(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in n.children() if c.tag not in BLOCK and c.tag not in SILENT)


def _merge(a: Shape, b: Shape) -> None:
    a.texts += b.texts
    a.linked += b.linked
    for x, y in zip(a.kids, b.kids, strict=True):
        _merge(x, y)


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """The size of the largest mapping that keeps order, parents and labels, and its pairs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    if m > MOST_KIDS and n > MOST_KIDS:
        found = [match(x, y) for x, y in _in_order(a.kids, b.kids)]
        return 1 + sum(f[0] for f in found), [(a, b), *(p for f in found for p in f[1])]
    sub = [[match(x, y) if x.label == y.label else (0, []) for y in b.kids] for x in a.kids]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + sub[i][j][0])
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += sub[i][j][1]
    return 1 + best[m][n], pairs


def _in_order(xs: list[Shape], ys: list[Shape]) -> Iterator[tuple[Shape, Shape]]:
    """Pairs of equal labels, each with the next one that is left."""
    places: dict[str, list[int]] = {}
    for j in range(len(ys) - 1, -1, -1):
        places.setdefault(ys[j].label, []).append(j)
    at = -1
    for x in xs:
        left = places.get(x.label, [])
        while left and left[-1] <= at:
            left.pop()
        if left:
            at = left.pop()
            yield x, ys[at]


def _own(pages: list[Shape]) -> list[set[tuple[int, str]]]:
    """Each page's texts that are not on most of the pages."""
    texts = [{(s.node.path, t) for s in _shapes(p) if not s.node.skip for t in s.texts} for p in pages]
    often = Counter(x for t in texts for x in t)
    return [{x for x in t if often[x] <= max(1, 0.6 * len(pages))} for t in texts]


def _shapes(root: Shape) -> Iterator[Shape]:
    stack = [root]
    while stack:
        s = stack.pop()
        yield s
        stack.extend(reversed(s.kids))


def layouts(pages: list[str]) -> list[list[Shape]]:
    """Pages that map onto the same first page, without copies."""
    out: list[list[Shape]] = []
    for made in (shape(parse(html)) for html in pages):
        for group in out:
            if 2 * match(group[0], made)[0] >= SAME_LAYOUT * (group[0].size + made.size):
                group.append(made)
                break
        else:
            out.append([made])
    for group in out:
        seen: list[set] = []
        for page, own in zip(list(group), _own(group), strict=True):
            if any(len(own & s) >= ALIKE * len(own | s) for s in seen):
                group.remove(page)
            else:
                seen.append(own)
    return out


def induce(pages: list[str]) -> dict:
    """The wrapper of a host's pages: of each layout its container's path, hashes of template texts and the paths of its elements."""
    out: dict = {"layouts": []}
    for group in layouts(pages):
        if len(group) < LEAST_PAGES:
            continue
        first = group[0]
        seen: dict[Shape, list[tuple[Shape, list[str]]]] = {}
        for page in group:
            for a, b in match(first, page)[1]:
                seen.setdefault(a, []).append((b, b.texts))
        template: dict[Shape, set[str]] = {}
        slots: dict[Shape, float] = {}
        for s, found in seen.items():
            often = Counter(t for _, texts in found for t in set(texts))
            template[s] = {t for t, n in often.items() if n >= CONSTANT * len(group)}
            # what varies, less what is linked
            varying = sum(len(t) for _, texts in found for t in texts if t not in template[s]) - 1.5 * sum(b.linked for b, _ in found if not b.node.skip)
            slots[s] = 0.0 if s.node.skip else varying / len(group)
        node = _container(first, slots, template)
        constant: set[str] = set()
        marked = node.node.tag in ("article", "main")
        for s in _shapes(first):  # of the whole page, as siblings of one label have one path
            if not s.node.skip and not (marked and s.node.label in PLAIN):
                constant |= {_hash(s.node, t) for t in template.get(s, ())}
        out["layouts"].append({"main": node.node.path, "constant": sorted(constant), "paths": sorted({s.node.path for s in _shapes(first)})})
    return out


def _container(first: Shape, slots: dict[Shape, float], template: dict[Shape, set[str]]) -> Shape:
    """The innermost element that holds nearly all slot text."""
    total: dict[Shape, float] = {}
    for s in reversed(list(_shapes(first))):
        total[s] = slots.get(s, 0.0) + sum(total[k] for k in s.kids)
    node = first
    while node.node.tag not in ("article", "main"):
        headed = any(k.label.split()[0] in ("h1", "h2") and not k.node.skip and set(k.texts) - template.get(k, set()) for k in node.kids)
        deeper = max((k for k in node.kids if not k.node.skip and k.node.tag in CONTAINERS and k.node.tag not in ("html", "body") or k.node.tag in ("html", "body")), key=lambda k: total[k], default=None)
        if headed or deeper is None or total[deeper] < ENTER * total[node] or total[deeper] <= 0:
            break
        node = deeper
    return node


def _hash(owner: Node, text: str) -> str:
    from xxhash import xxh64_hexdigest

    return xxh64_hexdigest(text, owner.path)


def _likely(root: Node, layouts_: list[dict]) -> list[dict]:
    """The layouts, those first whose elements are most like the page's."""
    if len(layouts_) < 2:
        return layouts_
    own = {n.path for n in _walk(root) if n.tag in BLOCK or n.tag == "#"}
    return sorted(layouts_, key=lambda x: -len(own & set(x["paths"])) / len(own | set(x["paths"])))


def extract(html: str | None, wrapper: dict | None = None) -> str:
    if not html:
        return ""
    root = parse(html)
    found: list[list[str]] = []
    for layout in _likely(root, (wrapper or {}).get("layouts", ())):
        constant = set(layout["constant"])
        # siblings of one label have one path: the one with most text that is not template
        found = [[x for owner, x in blocks(n) if _hash(owner, x) not in constant] for n in _walk(root) if n.path == layout["main"] and not n.skip]
        if found:
            break
    out = " ".join(max(found or [[x for _, x in blocks(container(root))]], key=lambda xs: sum(map(len, xs))))
    for n in list(_walk(root)):
        n.parent = None  # without cycles a tree is freed at once
    return out


# --- operator ------------------------------------------------------------------------------------------------------------------


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, work: Workspace, sample: int = SAMPLE) -> DataFrame:
    """host, wrapper (JSON): hosts with a page that has text."""
    chosen = work.save(small_hash_sample(pages.select("host", "page_id", "url").distinct(), "host", ["page_id", "url"], sample), "sample").select(F.col("page_id").alias("sample_id"), F.col("url").alias("sample_url"))
    few = chosen.count() <= BROADCAST_ROWS
    found = pages.join(F.broadcast(chosen) if few else chosen, F.col("page_id").eqNullSafe(F.col("sample_id")) & F.col("url").eqNullSafe(F.col("sample_url")))
    htmls = found.groupBy("host", "page_id", "url").agg(F.min("html").alias("html"))  # of rows that repeat both, one

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made = induce([h for h in sorted(x or "" for x in rows.column("html").to_pylist()) if h])
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(made)]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    return work.save(htmls.select("host", "html").groupBy("host").applyInArrow(run, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    work = Workspace(pages.sparkSession, "wrapper")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host())
    known = wrappers(plain, work)
    rows, size = known.select(F.count("*"), F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    joined = plain.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in slices(batches, "html"):
            made = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper and wrapper not in read:
                    if len(read) > 4096:
                        read.clear()
                    read[wrapper] = json.loads(wrapper)
                made.append(extract(html, read[wrapper] if wrapper else None))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
