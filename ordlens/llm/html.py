"""Main text of web pages by wrapper induction.

1. Each page is parsed into a DOM tree. Inline markup is folded into its block
   and runs of like siblings into one node, which leaves the page's skeleton.
2. The skeletons of one host are aligned by simple tree matching and merged
   into the host's wrapper; every skeleton node is mapped to a wrapper node.
   Skeletons are merged in rounds of bounded groups, so a host with any number
   of pages or layouts is no single task.
3. Per wrapper node, the host's distinct texts are measured: each counts once,
   however many pages carry it, by its length outside links, long texts more. The
   content region is the wrapper's subtree that holds most of this varying prose:
   from the root down into the child with the larger part of it, as long as that
   child is a container and not itself a run of text blocks. A subtree with an
   ``<article>`` wins against others of up to twice its prose; names decide nothing
   else here, except that containers named as menus, adverts, forms and the like
   hold no prose.
4. Texts of the region are counted over the host's pages of distinct main text,
   so copies of an article between other menus and adverts are one. A text that
   stands on most of them at one node is constant: template.
5. A page's text is that of its varying slots inside the region, in page order. A
   page without the region, and every page of a host with too few distinct texts
   there, is read by its own tags instead: its article or, without one, what lies
   outside the containers of menus, adverts, forms and the like.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlens.llm.minhash import batches
from ordlens.llm.urlfilter import url_parts
from ordlens.session import materialize

#: A text is template if it stands on this share of a host's distinct pages, of which there must be so many.
CONSTANT_SHARE = 0.5
MIN_PAGES = 8
#: A child subtree is entered if it holds more than this share of its parent's prose; an article's prose counts so many times.
REGION_SHARE = 0.5
ARTICLE_WEIGHT = 2.0
#: A text of n characters outside links is n * n / (n + SHORT_TEXT) of prose.
SHORT_TEXT = 80
#: Skeletons or partial wrappers merged by one group.
FAN_IN = 32

#: Fixed by HTML: elements without content, with raw text, inline elements, and start tags that end an open element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
strike strong sub sup time tt u var br wbr img""".split())
P_ENDS = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
SELF_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
             "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = set("html body table ul ol dl select div section article aside nav header footer main form".split())

#: Fixed names of containers that hold no main text.
CHROME_TAGS = set("nav header footer aside form script style noscript template iframe svg canvas object button select textarea menu "
                  "dialog head title audio video map".split())
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|"
    r"consent|notices?|alert|popup|modal|newsletter|subscribe|subscription|social|share|sharing|comments?|replies|respond|discussion|"
    r"disqus|related|recommended|breadcrumbs?|widget|login|signup|search|toolbar|pagination|pager|copyright|legal|disclaimer)"
    r"(?:$|[\s_-]|\d)", re.I)
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED, _HIDDEN = re.compile("\"[^\"]*\"|'[^']*'"), re.compile(r"\shidden(?:[\s=/>]|$)", re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")


class Node:
    """An element: label (tag and class), children, and the indices of its own text blocks."""

    __slots__ = ("tag", "label", "children", "chrome", "article", "slot")

    def __init__(self, tag: str, label: str, chrome: bool, article: bool):
        self.tag, self.label, self.chrome, self.article = tag, label, chrome, article
        self.children: list[Node] = []
        self.slot = -1


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """('text' | 'start' | 'end', lower-case tag, raw text): raw elements come as one start and end without content."""
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            yield "text", "", source[at:]
            return
        if m.start() > at:
            yield "text", "", source[at : m.start()]
        raw, at = m[0], m.end()
        name = _NAME.match(raw)
        if not name:
            continue
        tag = name[1].lower()
        yield ("end" if raw[1] == "/" else "start"), tag, raw
        if raw[1] != "/" and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else n
            yield "end", tag, ""


def _open(tag: str, raw: str, up: Node) -> Node:
    attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)} if "=" in raw else {}
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    inside = up.article or tag == "article"
    own = (tag in CHROME_TAGS and not (tag == "header" and up.article)) or bool(_HIDDEN.search(_QUOTED.sub("", raw))) or (
        attrs.get("role", "").lower() in CHROME_ROLES) or bool(names and tag not in ("html", "body", "article", "main")
                                                               and CHROME_NAMES.search(names))
    return Node(tag, f"{tag}.{' '.join(sorted(names.lower().split()))}" if names else tag, up.chrome or own, inside)


def parse(source: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page, and its blocks (element, text, characters inside links) in page order.

    Inline elements and line breaks lie inside their block; character
    references are decoded and white space runs become one space.
    """
    root = Node("#root", "#root", False, False)
    stack, blocks, held = [root], [], []
    linked, in_link = 0, False
    open_tags: Counter[str] = Counter()  # of the stack without its root

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            blocks.append((stack[-1], text, min(linked, len(text))))
        held.clear()
        linked = 0

    def close(tag: str) -> None:
        """Closes the innermost open ``tag`` and all inside it."""
        while True:
            last = stack.pop().tag
            open_tags[last] -= 1
            if last == tag:
                return

    for kind, tag, raw in tokens(source):
        if kind == "text":
            held.append(raw)
            linked += len(raw) if in_link else 0
        elif tag in INLINE:
            in_link = kind == "start" if tag == "a" else in_link
            if tag in ("br", "img"):
                held.append(" ")
        elif kind == "start":
            flush()
            if tag in P_ENDS and open_tags["p"]:
                close("p")
            ends = SELF_ENDS.get(tag, ())
            if any(open_tags[t] for t in ends):
                for x in reversed(stack[1:]):
                    if x.tag in ends:
                        close(x.tag)
                        break
                    if x.tag in SCOPES:
                        break
            node = _open(tag, raw, stack[-1])
            stack[-1].children.append(node)
            if tag not in VOID and not raw.endswith("/>"):
                stack.append(node)
                open_tags[tag] += 1
        else:
            flush()
            in_link = False
            if open_tags[tag]:
                close(tag)
    flush()
    return root, blocks


def skeleton(root: Node) -> list:
    """[label, children] of the tree, with runs of like siblings merged; numbers every node's slot in pre-order.

    Like all that walks trees here it keeps its own stack: a page may nest to any depth.
    """
    top: list = [None, []]
    count, todo = 0, [([root], top)]
    while todo:
        group, up = todo.pop()
        for n in group:
            n.slot = count
        count += 1
        tree = [group[0].label, []]
        up[1].append(tree)
        runs: list[list[Node]] = []
        for n in (c for x in group for c in x.children):
            if not runs or runs[-1][0].label != n.label:
                runs.append([])
            runs[-1].append(n)
        todo += [(r, tree) for r in reversed(runs)]
    return top[1][0]


def flat(tree: list) -> str:
    """A tree as the depths and labels of its nodes in pre-order."""
    depths, labels, todo = [], [], [(tree, 0)]
    while todo:
        (label, children), depth = todo.pop()
        depths.append(depth)
        labels.append(label)
        todo += [(c, depth + 1) for c in reversed(children)]
    return json.dumps([depths, labels], separators=(",", ":"))


def unflat(text: str) -> list:
    path: list = []
    for depth, label in zip(*json.loads(text)):
        node = [label, []]
        del path[depth:]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the largest number of node pairs that keep labels, ancestors and order, and those pairs."""
    if a[0] != b[0]:
        return 0, []
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[list, list]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        same = [c[0] for c in x[1]] == [c[0] for c in y[1]]  # the usual case: the children pair off one by one
        pairs = list(zip(x[1], y[1])) if same else [(c, d) for c in x[1] for d in y[1] if c[0] == d[0]]
        if not ready:
            todo.append((x, y, True))
            todo += [(c, d, False) for c, d in pairs]
            continue
        if not same:
            pairs = _alignment(x[1], y[1], weight)
        weight[id(x), id(y)] = 1 + sum(weight[id(c), id(d)] for c, d in pairs)
        chosen[id(x), id(y)] = pairs
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += reversed(chosen[id(x), id(y)])
    return weight[id(a), id(b)], out


def _alignment(x: list, y: list, weight: dict[tuple[int, int], int]) -> list[tuple[list, list]]:
    """The pairs of children of the largest total weight that keep their order."""
    w = [[weight.get((id(c), id(d)), 0) if c[0] == d[0] else 0 for d in y] for c in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], y[j]))
    return pairs[::-1]


def merge(wrapper: list, tree: list) -> None:
    """Adds to ``wrapper`` the nodes of ``tree`` that match none of its own, after the sibling before them."""
    _, pairs = match(wrapper, tree)
    home = {id(b): a for a, b in pairs}
    todo = [(wrapper, tree)] if id(tree) in home else []
    while todo:
        a, b = todo.pop()
        at = 0
        for child in b[1]:
            twin = home.get(id(child))
            if twin is None:
                a[1].insert(at, child)
                at += 1
            else:
                at = next(i for i, c in enumerate(a[1]) if c is twin) + 1
                todo.append((twin, child))


def _preorder(tree: list) -> Iterator[list]:
    todo = [tree]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n[1])


def slots_of(wrapper: list, tree: list) -> list[int]:
    """For each node of ``tree`` in pre-order the pre-order number of its wrapper node (-1: none)."""
    number = {id(n): i for i, n in enumerate(_preorder(wrapper))}
    home = {id(b): number[id(a)] for a, b in match(wrapper, tree)[1]}
    return [home.get(id(n), -1) for n in _preorder(tree)]


def _own_main(blocks: list[tuple[Node, str, int]]) -> list[bool]:
    """Which blocks a page's own tags call main: the article's, or else those outside chrome."""
    inside = [n.article and not n.chrome for n, _, _ in blocks]
    return inside if any(inside) else [not n.chrome for n, _, _ in blocks]


def _parse_pages(it):
    for rb in batches(it, "html"):
        rows = []
        for page, url, host, source in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
            root, blocks = parse(source or "")
            tree = flat(skeleton(root))
            texts = [t for _, t, _ in blocks]
            prose = [0 if n.chrome else len(t) - linked for n, t, linked in blocks]
            rows.append((page, url, host, tree, xxhash.xxh64_intdigest(tree) - (1 << 63), [n.slot for n, _, _ in blocks],
                         [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], texts, prose, _own_main(blocks),
                         [n.chrome for n, _, _ in blocks], [n.article for n, _, _ in blocks]))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.list_(pa.bool_())] * 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)],
            ["page_id", "url", "host", "tree", "layout", "slots", "hashes", "texts", "prose", "own", "chrome", "article"])


def _merge_group(it):
    """Rows (host, part, tree) sorted by (host, part): the merged tree of each group."""
    key, wrapper = None, None
    for rb in it:
        out = []
        for host, part, tree in zip(*(rb.column(c).to_pylist() for c in ("host", "part", "tree"))):
            if (host, part) != key:
                if wrapper is not None:
                    out.append((*key, flat(wrapper)))
                key, wrapper = (host, part), unflat(tree)
            else:
                merge(wrapper, unflat(tree))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.string()))], ["host", "part", "tree"])
    if wrapper is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            (*key, flat(wrapper)), (pa.string(), pa.int32(), pa.string()))],
            ["host", "part", "tree"])


def wrappers(layouts: DataFrame) -> DataFrame:
    """(host, wrapper) from distinct (host, layout, tree): skeletons are merged in rounds of ``FAN_IN``."""
    trees = materialize(layouts.select("host", "layout", "tree"), "html-layouts")
    n = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts = max(-(-n // FAN_IN), 1)
    while True:
        dealt = trees.select("host", F.pmod(F.xxhash64("layout"), F.lit(parts)).cast("int").alias("part"), "layout", "tree")
        merged = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "layout").select(
            "host", "part", "tree").mapInArrow(_merge_group, "host string, part int, tree string")
        trees = materialize(merged.select("host", F.col("part").cast("long").alias("layout"), "tree"), "html-wrappers")
        if parts == 1:
            return trees.select("host", F.col("tree").alias("wrapper"))
        parts = -(-parts // FAN_IN)


def _map_slots(it):
    for rb in it:
        rows = [(h, x, slots_of(unflat(w), unflat(t))) for h, x, t, w in zip(
            *(rb.column(c).to_pylist() for c in ("host", "layout", "tree", "wrapper")))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["host", "layout", "nodes"])


def region(wrapper: list, prose: dict[int, float], articles: set[int]) -> tuple[int, int]:
    """The content region as a range [first, end) of the wrapper's pre-order numbers.

    ``prose`` is the varying prose of single nodes, ``articles`` those with
    text inside an article. Equal subtrees: the first.
    """
    order = list(_preorder(wrapper))
    number = {id(n): i for i, n in enumerate(order)}
    end = [i + 1 for i in range(len(order))]
    total = [prose.get(i, 0.0) for i in range(len(order))]
    article = [i in articles for i in range(len(order))]
    for i in reversed(range(len(order))):
        for c in order[i][1]:
            j = number[id(c)]
            end[i], total[i], article[i] = max(end[i], end[j]), total[i] + total[j], article[i] or article[j]
    at = 0
    while True:
        children = [number[id(c)] for c in order[at][1]]
        # where a whole subtree is article, the weight tells nothing apart
        weight = {j: total[j] * (ARTICLE_WEIGHT if article[j] else 1.0) for j in children}
        best = max(children, key=lambda j: (weight[j], -j), default=None)
        if best is None or weight[best] <= REGION_SHARE * (sum(weight.values()) + prose.get(at, 0.0)):
            return at, end[at]
        if total[best] - prose.get(best, 0.0) <= REGION_SHARE * total[best]:
            return at, end[at]  # a run of text blocks: its parent is the container
        at = best


def _regions(it):
    for rb in it:
        rows = []
        for host, wrapper, found in zip(*(rb.column(c).to_pylist() for c in ("host", "wrapper", "found"))):
            first, end = region(unflat(wrapper), {f["node"]: f["prose"] for f in found}, {f["node"] for f in found if f["article"]})
            texts = sum(f["texts"] for f in found if first <= f["node"] < end)
            if texts >= MIN_PAGES:
                rows.append((host, first, end))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.int32()))], ["host", "first", "end"])


def _content_regions(parsed: DataFrame, nodes: DataFrame, wrapper: DataFrame) -> DataFrame:
    """(host, first, end) of every host with ``MIN_PAGES`` distinct texts in its region."""
    blocks = parsed.join(nodes, ["host", "layout"]).select("host", F.explode(F.arrays_zip(
        F.transform("slots", lambda s: F.get("nodes", s)).alias("node"), "hashes", "prose", "article")).alias("b"))
    texts = blocks.where("b.node >= 0 and b.prose > 0").groupBy("host", F.col("b.node").alias("node"), F.col("b.hashes").alias("hash")).agg(
        F.max("b.prose").cast("double").alias("n"), F.max("b.article").alias("article"))
    found = texts.groupBy("host", "node").agg(F.sum(F.col("n") * F.col("n") / (F.col("n") + SHORT_TEXT)).alias("prose"),
                                              F.count(F.lit(1)).alias("texts"), F.max("article").alias("article"))
    # a row per wrapper node at most, beside the wrapper itself
    by_host = found.groupBy("host").agg(F.collect_list(F.struct("node", "prose", "texts", "article")).alias("found"))
    return wrapper.join(by_host, "host").mapInArrow(_regions, "host string, first int, end int")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Hosts are those of ``urlfilter.url_parts`` ('' for a null or odd url, which
    is one host of its own). Null or empty html gives an empty text. Pages
    of the same main text count once as evidence, whatever menus, adverts or
    layout stand around it. A host with fewer than ``MIN_PAGES`` distinct texts
    in its region is read page by page, and one of fewer distinct pages has no
    template texts, so a repeated page keeps its text. Rows may repeat and have
    null ids, other columns are ignored, an empty table gives an empty result.
    """
    host, _ = url_parts(F.col("url"))
    parsed = materialize(
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html").mapInArrow(
            _parse_pages, "page_id long, url string, host string, tree string, layout long, slots array<int>, "
                          "hashes array<long>, texts array<string>, prose array<int>, own array<boolean>, "
                          "chrome array<boolean>, article array<boolean>"), "html-pages")
    layouts = parsed.groupBy("host", "layout").agg(F.first("tree").alias("tree"))
    wrapper = materialize(wrappers(layouts), "html-host-wrappers")
    nodes = materialize(layouts.join(wrapper, "host").mapInArrow(_map_slots, "host string, layout long, nodes array<int>"),
                        "html-slots")
    regions = materialize(_content_regions(parsed, nodes, wrapper), "html-regions")

    def main_blocks(*columns: str) -> DataFrame:
        """The pages' main blocks as arrays of (node, hash, own columns)."""
        block = F.arrays_zip(F.transform("slots", lambda s: F.get("nodes", s)).alias("node"), F.col("hashes").alias("hash"),
                             "own", "chrome", *columns)
        inside = F.filter("blocks", lambda b: F.when(b["node"] >= 0, (b["node"] >= F.col("first")) & (b["node"] < F.col("end"))
                                                     & ~b["chrome"]).otherwise(b["own"]))
        own = F.filter("blocks", lambda b: b["own"])
        known = F.exists("blocks", lambda b: (b["node"] >= F.col("first")) & (b["node"] < F.col("end")) & ~b["chrome"])
        return parsed.join(nodes, ["host", "layout"], "left").join(regions, "host", "left").withColumn("blocks", block).withColumn(
            "main", F.when(F.coalesce(known, F.lit(False)), inside).otherwise(own))

    seen_pages = main_blocks().select("host", "layout", F.transform("main", lambda b: F.struct(b["node"], b["hash"])).alias("main"),
                                      F.xxhash64(F.transform("main", lambda b: b["hash"])).alias("content"))
    evidence = seen_pages.groupBy("host", "layout", "content").agg(F.first("main").alias("main"))
    seen = evidence.select("host", "content", F.explode("main").alias("b")).select(
        "host", "content", F.col("b.node").alias("node"), F.col("b.hash").alias("hash"))
    n_pages = evidence.groupBy("host").agg(F.count_distinct("content").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    counts = seen.distinct().groupBy("host", "node", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    # at most 1 / CONSTANT_SHARE times the texts of a page can stand on that share of the pages
    template = counts.join(n_pages, "host").where(F.col("n") >= F.col("pages") * CONSTANT_SHARE).groupBy("host").agg(
        F.collect_set(F.struct("node", "hash")).alias("constant"))
    placed = main_blocks("texts").join(materialize(template, "html-template"), "host", "left")
    kept = F.filter("main", lambda b: F.col("constant").isNull() | ~F.exists(
        F.coalesce("constant", F.array().cast("array<struct<node:int,hash:bigint>>")),
        lambda c: (c["node"] == b["node"]) & (c["hash"] == b["hash"])))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), " ")
    return placed.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def text_of_page(source: str | None) -> str:
    """One page's text without a host's wrapper: what its article, or else its blocks outside chrome, hold."""
    _, blocks = parse(source or "")
    return " ".join(t for (_, t, _), own in zip(blocks, _own_main(blocks)) if own)
