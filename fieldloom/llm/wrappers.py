"""Article text of pages by wrappers induced from all pages of a host.

Pages of one host fall into kinds by tree matching of their shapes. Texts that nearly all pages
with their path have, on the host or within a kind, are template; the others are slots. The wrapper
of a kind names the inmost path that holds all of the varying text (labels and menus apart), and
the template texts. Every page is then read by the wrapper of its kind; what names itself
navigation, advert and the like is left out beforehand.

Tree matching pairs nodes with one path of labels only, and a template text is known by its path.
So texts are counted by path, over every page, which counts all that an alignment could pair.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from fieldloom.llm import dom
from fieldloom.llm.batches import add_columns, column, steps, texts
from fieldloom.llm.stage import boxed, opened, written

# Pages with a path that make a text on it template, as a share and as a number.
TEMPLATE_SHARE = 0.8
LEAST_PAGES = 4
# Pages that have more than this share of their text in common are copies of one article.
SHARED = 0.5
# Shapes with this share of matched nodes are of one kind.
KIND_SHARE = 0.8
# Elements whose text is an article's wherever it is, and words in names that say so of others.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figcaption caption".split())
PROSE_NAMES = frozenset("title subtitle headline heading lead lede intro summary abstract standfirst caption".split())
# Elements whose text counts outside links.
ITEMS = frozenset("li dd dt td th".split())
# Longer texts are more than a label.
LABEL_CHARS = 40


def host(url: Column) -> Column:
    """Host of a URL in lower case without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def squeezed(node: dom.Node) -> dom.Node:
    """A copy for alignment: of neighbours with one label that hold no elements, the first stands
    for the run, so that long lists and articles cost no more than short ones."""
    out = dom.Node(node.tag, node.attrs)
    last = None
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.children.append(child)
            continue
        plain = child.label if not child.elements() else None
        if plain is None or plain != last or child.tag not in ("p", "li", "tr", "td", "br", "dd", "dt"):
            out.children.append(squeezed(child))
        last = plain
    return out


def tree_match(a: dom.Node, b: dom.Node) -> tuple[int, list[tuple[dom.Node, dom.Node]]]:
    """Size of the largest order-keeping match of two trees, and its pairs of nodes.

    Roots with different labels do not match; children are matched by dynamic programming over
    both lists, as in simple tree matching.
    """
    if a.label != b.label:
        return 0, []
    left, right = a.elements(), b.elements()
    size = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    inner = {}
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            here = 0
            if x.label == y.label:
                inner[i, j] = tree_match(x, y)
                here = inner[i, j][0]
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + here)
    pairs = [(a, b)]
    i, j = len(left), len(right)
    while i and j:
        if (i, j) in inner and size[i][j] == size[i - 1][j - 1] + inner[i, j][0]:
            pairs += inner[i, j][1]
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + size[len(left)][len(right)], pairs


def own_text(node: dom.Node) -> str:
    """Text directly in a node."""
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


def said(path: str, text: str) -> int:
    """64-bit hash of a text on a path."""
    return int.from_bytes(hashlib.blake2b(f"{path}|{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def told(node: dom.Node, path: str, prose: bool = False, weak: bool = False) -> Iterator[tuple[str, str, int]]:
    """Path, own text and its characters an article may have, of every node in a tree with text.

    Text in headings, paragraphs and what is named like them counts, and in list items and cells
    outside links; elsewhere (labels, menus) only text of more than ``LABEL_CHARS``.
    """
    named = node.tag not in ("html", "body") and any(n.lower() in PROSE_NAMES for n in dom.name_words(node))
    prose = prose or node.tag in PROSE or named
    weak = (weak or node.tag in ITEMS) and node.tag != "a"
    text = own_text(node)
    if text:
        yield path, text, len("".join(text.split())) if prose or weak or len(text) > LABEL_CHARS else 0
    for child in node.elements():
        yield from told(child, f"{path}/{child.label}", prose, weak)


def inmost(own: dict[str, int]) -> str:
    """Down as long as one block has all that ``own`` counts by path; stops at an article."""
    sizes: Counter[str] = Counter()
    inner: dict[str, set[str]] = {}
    for path, size in own.items():
        labels = path.split("/")
        for n in range(2, len(labels) + 1):
            sizes["/".join(labels[:n])] += size
            inner.setdefault("/".join(labels[: n - 1]), set()).add("/".join(labels[:n]))
    path = "/#root"
    while _tag(path) not in ("article", "main"):
        best = max((p for p in inner.get(path, ()) if _tag(p) in dom.BLOCK - {"p"} and p in inner), key=lambda p: (sizes[p], p), default=None)
        if best is None or not sizes[best] or sizes[best] < sizes[path]:
            break
        path = best
    return path


def _tag(path: str) -> str:
    label = path.rsplit("/", 1)[1]
    return label if label == "#root" else label.split(".")[0].split("#")[0]


def shape(node: dom.Node) -> list:
    """Labels of a squeezed tree, nested."""
    return [node.label, *(shape(c) for c in node.elements())]


def _unshaped(found: list) -> dom.Node:
    node = dom.Node("", {})
    node.label = found[0]
    node.children = [_unshaped(c) for c in found[1:]]
    return node


def kind(tree: dom.Node) -> int:
    """Hash of the labels of a tree that name a class or an id; contents change the others."""
    return said("", "\n".join(sorted({n.label for _, n in dom.walk(tree) if n.label != n.tag})))


def merged(kinds: list[tuple[int, int, str]]) -> dict[int, int]:
    """Kind -> the first kind, by number of pages, whose reference shape tree matching finds alike."""
    out: dict[int, int] = {}
    references: list[tuple[int, dom.Node, int]] = []
    for name, _, text in sorted(kinds, key=lambda k: (-k[1], k[0])):
        tree = _unshaped(json.loads(text))
        size = sum(1 for _ in dom.walk(tree))
        for known, other, nodes in references:
            if 2 * min(size, nodes) >= KIND_SHARE * (size + nodes) and 2 * tree_match(other, tree)[0] >= KIND_SHARE * (size + nodes):
                out[name] = known
                break
        else:
            references.append((name, tree, size))
            out[name] = name
    return out


def article(page: str, main: str, fixed: frozenset[int], tree: dom.Node | None = None) -> str:
    """Article text of a page by its wrapper; without one, or where the page has no such path,
    its article and main elements, else the part of the body with all its text. ``tree`` is the
    pruned page where the caller has it; it is changed."""
    tree = tree or dom.pruned(dom.parse(page))
    every = list(dom.walk(tree))
    found = [(path, node) for path, node in every if main and path == main]
    if not any(dom.text_size(node) for _, node in found):
        named = [(p, n) for p, n in _outermost(tree, f"/{tree.label}") if dom.text_size(n)]
        found = [_inmost_node(p, n) if n.tag == "main" else (p, n) for p, n in named] or [_inmost_node(*every[0])]
    out: list[str] = []
    for path, node in found:
        if fixed:
            _drop_fixed(node, path, fixed)
        out += dom.blocks(node)
    return "\n".join(out)


def _outermost(node: dom.Node, path: str) -> list[tuple[str, dom.Node]]:
    """Article and main elements that are in no other one, with their paths."""
    if node.tag in ("article", "main"):
        return [(path, node)]
    return [found for c in node.elements() for found in _outermost(c, f"{path}/{c.label}")]


def _inmost_node(path: str, node: dom.Node) -> tuple[str, dom.Node]:
    """Down from a node as long as one block child has all its text that counts; stops at an article."""
    while node.tag != "article":
        sizes = [(sum(size for _, _, size in told(c, "", False, node.tag in ITEMS)), c) for c in node.elements()]
        whole = sum(size for _, _, size in told(node, ""))
        best = [c for size, c in sizes if size and size == whole and c.tag in dom.BLOCK and c.tag != "p" and c.elements()]
        if not best:
            break
        path, node = f"{path}/{best[0].label}", best[0]
    return path, node


def _drop_fixed(node: dom.Node, path: str, fixed: frozenset[int]) -> None:
    kept: list[dom.Node | str] = []
    for child in node.children:
        if isinstance(child, dom.Node):
            inner = f"{path}/{child.label}"
            if not child.elements() and said(inner, own_text(child)) in fixed:
                continue
            _drop_fixed(child, inner, fixed)
        kept.append(child)
    node.children = kept


PARTS = "host string, kind long, body long, path string, said long, first int, size int, chars int, shape string"


def page_parts(pages: DataFrame, url: str, page: str) -> DataFrame:
    """A row per page and text on a path, and one with the page's shape on the empty path.

    ``first`` is 1 in one row of every path of a page; ``size`` counts for articles, ``chars`` is
    the whole text's length. Pages with the same texts are one body, whose rows are there once.
    """
    rows = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("html")).where(F.length("html") > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in PARTS.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[field.split()[1]] for field in PARTS.split(", ")]
        for part in steps(batches, "html"):
            out: list[tuple] = []
            for name, text in zip(column(part, "host").to_pylist(), texts(part, "html"), strict=True):
                tree = dom.pruned(dom.parse(text))
                found: dict[tuple[str, int], list[int]] = {}
                for path, own, size in told(tree, f"/{tree.label}"):
                    held = found.setdefault((path, said(path, own)), [0, 0])
                    held[0] += size
                    held[1] += len(own)
                if not found:
                    continue
                named, body, met = kind(tree), said("", " ".join(str(s) for _, s in sorted(found))), set()
                out.append((name, named, body, "", 0, 1, 0, 0, json.dumps(shape(squeezed(tree)))))
                for (path, mark), (size, chars) in sorted(found.items()):
                    out.append((name, named, body, path, mark, int(path not in met), size, chars, None))
                    met.add(path)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    one = [F.max(c).alias(c) for c in ("first", "size", "chars", "shape")]
    return written(rows.mapInArrow(read, PARTS).groupBy("host", "kind", "body", "path", "said").agg(*one))


def template(parts: DataFrame) -> DataFrame:
    """``host, group, said`` of texts that enough bodies with their path have."""
    counted = parts.groupBy("host", "group", "path", "said").agg(F.count("*").alias("times"), F.sum("first").alias("first"))
    met = counted.groupBy("host", "group", "path").agg(F.sum("first").alias("met"))
    often = counted.where((F.col("times") >= LEAST_PAGES) & (F.col("path") != ""))
    enough = F.col("times") >= TEMPLATE_SHARE * F.col("met")
    return often.join(met, ["host", "group", "path"]).where(enough).select("host", "group", "said")


def induced(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, wrapper``: JSON of a host's kinds and their wrappers, from all of its pages. Written.

    Texts on a path are counted for the host (group 0) and for every kind, as hashes and with
    partial aggregation. A first count may be tipped by many copies of one article, so bodies
    whose text is mostly what it found are left out of the second, and of bodies with the same
    longest other text one stays.
    """
    parts = page_parts(pages, url, page)
    shapes = parts.where("path = ''").groupBy("host", "kind").agg(F.count("*").alias("n"), F.min("shape").alias("shape"))

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        known = merged(list(zip(frame["kind"].tolist(), frame["n"].tolist(), frame["shape"], strict=True)))
        return pd.DataFrame({"host": frame["host"], "kind": frame["kind"], "grouped": [known[k] for k in frame["kind"].tolist()]})

    kinds = written(shapes.groupBy("host").applyInPandas(group, "host string, kind long, grouped long"))

    def both(rows: DataFrame) -> DataFrame:
        return rows.join(kinds, ["host", "kind"]).withColumn("group", F.explode(F.array("grouped", F.lit(0).cast("long"))))

    texts_ = parts.where("path <> ''")
    often = written(template(both(parts)).select("host", "said").distinct())
    other = texts_.join(often.withColumn("often", F.lit(True)), ["host", "said"], "left").withColumn("own", F.col("often").isNull())
    longest = F.max(F.when(F.col("own") & (F.col("chars") > LABEL_CHARS), F.struct("chars", "said")))
    bodies = other.groupBy("host", "body").agg(
        longest.alias("key"), F.sum(F.when(F.col("own"), F.col("chars")).otherwise(0)).alias("own"), F.sum("chars").alias("chars")
    )
    mostly = bodies.where(F.col("key").isNotNull() & (F.col("own") >= (1 - SHARED) * F.col("chars")))
    chosen = written(mostly.groupBy("host", F.col("key.said")).agg(F.min("body").alias("body")).select("host", "body"))
    # Bodies say what varies, too; without two of them a host has no wrapper.
    differing = both(parts.join(chosen, ["host", "body"], "left_semi"))
    fixed = written(template(differing))
    # Kinds with enough bodies of their own have a wrapper of their own.
    sized = differing.where("path = ''").groupBy("host", "group").agg(F.count("*").alias("n"))
    varying = both(texts_.where("size > 0")).alias("v").join(
        fixed.alias("f"),
        (F.col("v.host") == F.col("f.host")) & (F.col("v.said") == F.col("f.said")) & F.col("f.group").isin(F.lit(0), F.col("v.group")),
        "left_anti",
    )
    sizes = varying.groupBy("host", "group", "path").agg(F.sum("size").alias("n"))

    def facts(rows: DataFrame, fact: str, **given: str) -> DataFrame:
        named = {"group": "group", "path": "cast(null as string)", "n": "cast(null as long)", **given}
        return rows.select("host", F.lit(fact).alias("fact"), *[F.expr(f"`{v}`" if v.isidentifier() else v).cast(t).alias(c) for (c, v), t in zip(named.items(), ("long", "string", "long"), strict=True)])

    known = facts(sized, "bodies", n="n").unionByName(facts(sizes, "size", path="path", n="n"))
    known = known.unionByName(facts(fixed, "fixed", n="said")).unionByName(facts(kinds, "kind", n="kind", group="grouped"))

    def wrap(frame: pd.DataFrame) -> pd.DataFrame:
        by = {name: rows for name, rows in frame.groupby("fact")}
        rows = {name: list(zip(r["group"].tolist(), r["path"].tolist(), map(int, r["n"].tolist()), strict=True)) for name, r in by.items()}
        enough = {g: n for g, _, n in rows.get("bodies", []) if n >= (LEAST_PAGES if g else 2)}
        always = [n for g, _, n in rows.get("fixed", []) if g == 0]
        wrappers = {}
        for g, bodies in enough.items():
            main = inmost({path: n for other, path, n in rows.get("size", []) if other == g})
            # Of too few pages nothing is known as template, so all of a page says nothing.
            whole = _tag(main) in ("#root", "html", "body") and bodies < LEAST_PAGES
            wrappers[str(g)] = ["" if whole else main, sorted({*always, *(n for other, _, n in rows.get("fixed", []) if other == g)})]
        found = {str(n): str(g) for g, _, n in rows.get("kind", []) if g in enough}
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps({"kinds": found, "wrappers": wrappers})]})

    return written(known.groupBy("host").applyInPandas(wrap, "host string, wrapper string"))


Wrappers = tuple[dict[str, str], dict[str, tuple[str, frozenset[int]]]]


def parsed(text: str | None) -> Wrappers:
    """Group of each kind of a host, and the wrapper of each group."""
    if not text:
        return {}, {}
    held = json.loads(text)
    return held["kinds"], {g: (main, frozenset(fixed)) for g, (main, fixed) in held["wrappers"].items()}


def read_page(page: str, wrapper: Wrappers) -> str:
    """Article text of a page by the wrappers of its host."""
    tree = dom.pruned(dom.parse(page))
    kinds, wrappers = wrapper
    group = kinds.get(str(kind(tree)), "0") if kinds else "0"
    return article(page, *wrappers.get(group, ("", frozenset())), tree)


def extract_articles(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page.

    Blocks are joined by a line feed; white space inside a block is one space; character
    references are decoded. Null and empty pages, and pages without an article, give the empty
    text. Pages without a host share one wrapper; repeated rows give repeated texts; a column of
    that name is replaced. Hosts join their wrapper by a broadcast if all wrappers are small by
    their written size, else by a sorted join whose large hosts Spark can split.
    """
    wrappers = induced(pages, url, page)
    kept = pages.drop(*({name} - {page, url}))
    taken = {"_page": page, "_url": url}
    whole = boxed(kept, **taken).withColumn("_host", host(F.col("_url")))
    rows = whole.join(wrappers.toDF("_of", "_wrapper"), F.col("_host") == F.col("_of"), "left").drop("_host", "_of")

    def work():
        # Made in the task, as what a module caches cannot be sent to executors.
        known = lru_cache(maxsize=256)(parsed)

        def act(part: pa.RecordBatch) -> list[pa.Array]:
            values = zip(texts(part, "_page"), column(part, "_wrapper").to_pylist(), strict=True)
            return [pa.array([read_page(p, known(w)) if p else "" for p, w in values], pa.string())]

        return act

    read = add_columns(rows, "_page", [StructField("_article", StringType(), False)], work)
    return read.select(*[c for c, own in zip(opened(kept.columns, **taken), kept.columns, strict=True) if own != name], F.col("_article").alias(name))
