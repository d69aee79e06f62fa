"""Main text of web pages by wrapper induction.

Every page is parsed into a DOM tree, and its blocks of text and its skeleton (the tree
of its tags and classes, equal siblings folded) are taken. Pages of a host with equal
blocks count once. The skeletons of a host are aligned by simple tree matching, and
those that match in most nodes are one layout. A text that stands at one path in nearly
all pages of a layout, or of the host, is template: nodes that tree matching can align
stand at equal paths, so counts of (path, text) hold the evidence of all pages at once.
The wrapper of a host is its template texts. The main text of a page is all its other
blocks, without the parts that are never main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments).

Where nothing varies (a host with one page or copies of one, a page of template texts
only) template cannot be told from text, and all blocks but furniture stay. On fewer
than ``LEAST`` different pages template is believed only where most of a page's text is
its own, so that near copies do not take each other for template.

Defined cases: null html gives an empty text; a null or odd url is the host ""; markup may
be broken or cut off anywhere; repeated rows are extracted row by row; an empty table
gives an empty result; other input columns play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import bounded_batches, giving_back, join_aggregate, materialise, release

#: Wrappers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Share of the pages that makes a text template, and different pages that make this sure.
CONSTANT = 0.8
LEAST = 4
#: Share of nodes (of both trees) that match in skeletons of one layout.
ALIKE = 0.6
#: Commonest skeletons of a host that give its layouts in the first round (twice as many in the next), and
#: skeletons per group that are matched with them.
LEADERS, DEALT = 64, 1024

# Element kinds of HTML, and words in class and id that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav header footer aside form script style noscript iframe button select option textarea template menu dialog svg object embed title head canvas audio video input label fieldset".split())
FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|comments?|disqus|replies|sidebar|side|aside|widget|menu|nav\w*|breadcrumbs?|"
    r"pagination|pager|header|masthead|footer|foot|copyright|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|toolbar|skip|alert)(?:$|[-_\s\d])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details figure".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kind", "children", "noise")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.attrs = ""
        #: Tag and classes, without classes that number pages (those with a digit).
        self.kind = tag
        self.noise = tag in NEVER
        #: Child nodes and texts, in page order.
        self.children: list[Node | str] = []
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                    self.noise = True
                if name in ("class", "id"):
                    self.noise = self.noise or tag not in ("body", "html", "article", "main") and bool(FURNITURE.search(value))
                    if name == "class":
                        names = sorted(value.split())
                        self.attrs += f".{' '.join(names)}"
                        self.kind += "".join(f".{x}" for x in names if not any(map(str.isdigit, x)))

    def key(self) -> str:
        return self.tag + self.attrs


def parse(source: str) -> Node:
    """A tree from any markup, of any depth; never fails."""
    root = Node("html")
    stack, at, n = [root], 0, len(source)
    #: How many elements of each name are open, so that a stray end tag costs no search.
    opened: Counter = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].children.append(source[at:lt])
            at = lt
            continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(source, at) or _LOOSE.match(source, at)
        if not m:
            stack[-1].children.append("<")
            at += 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            continue
        if name == "html" or name == "body" and opened[name]:
            continue
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if name in CLOSED_BY.get(tag, ()):
                close(k)
                break
            if tag not in INLINE:
                break
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[name] += 1
    return root


def blocks(node: Node) -> Iterator[tuple[int, str]]:
    """(path, text) of the blocks below ``node``, furniture left out; a path is a hash of tags and classes."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    paths: dict[tuple[int, str], int] = {}

    def flush(where: int) -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((where, text))

    def below(where: int, kind: str) -> int:
        at = paths.get((where, kind))
        if at is None:
            at = paths[where, kind] = _hash(f"{where}/{kind}")
        return at

    top = below(0, node.kind)
    stack = [(iter(node.children), top, False)]
    while stack:
        children, where, block = stack[-1]
        for c in children:
            if isinstance(c, str):
                held.append(c)
            elif c.noise:
                if c.tag not in INLINE:
                    flush(where)
            elif c.tag in INLINE:
                stack.append((iter(c.children), where, False))
                break
            else:
                flush(where)
                stack.append((iter(c.children), below(where, c.kind), True))
                break
        else:
            if block:
                flush(where)
            stack.pop()
    flush(top)
    yield from out


def matching(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest order-preserving match of two trees with equal roots."""
    if a.key() != b.key():
        return 0
    stack = [(a, b)]
    while stack:
        p, q = stack[-1]
        if (id(p), id(q)) in memo:
            stack.pop()
            continue
        x, y = ([c for c in n.children if isinstance(c, Node)] for n in (p, q))
        names = [c.key() for c in y]
        open_ = [(c, d) for c in x for d, name in zip(y, names, strict=True) if c.key() == name and (id(c), id(d)) not in memo]
        if open_:
            stack += open_
            continue
        row = [0] * (len(y) + 1)
        for c in x:
            diagonal = 0
            for j, d in enumerate(y, 1):
                kept = row[j]
                row[j] = max(row[j], row[j - 1], diagonal + memo.get((id(c), id(d)), 0))
                diagonal = kept
        memo[id(p), id(q)] = 1 + row[-1]
        stack.pop()
    return memo[id(a), id(b)]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def _mark(path: int, text: str) -> int:
    return _hash(f"{path}\0{text}")


def skeleton(node: Node) -> str:
    """Tags and classes of the blocks below ``node``, equal siblings folded, as JSON: depth and name in page order."""
    # Equal subtrees get equal numbers, from the leaves up.
    number: dict[tuple, int] = {}
    made: list[tuple] = []
    stack: list[tuple[Node, Iterator, dict[int, None]]] = [(node, iter(node.children), {})]
    top = 0
    while stack:
        x, children, own = stack[-1]
        for c in children:
            if not isinstance(c, str) and not c.noise:
                # What stands in an inline element counts to the block around it.
                stack.append((c, iter(c.children), own if c.tag in INLINE else {}))
                break
        else:
            stack.pop()
            if x.tag not in INLINE or not stack:
                name = (x.kind, *own)
                top = number.setdefault(name, len(made))
                if top == len(made):
                    made.append(name)
                if stack:
                    stack[-1][2][top] = None
    out: list = []
    todo = [(top, 0)]
    while todo:
        k, depth = todo.pop()
        kind, *below = made[k]
        out += [depth, kind]
        todo += [(c, depth + 1) for c in reversed(below)]
    return json.dumps(out, separators=(",", ":"))


def tree(made: list) -> Node:
    """The tree of a skeleton."""
    path: list[Node] = []
    for depth, kind in zip(made[::2], made[1::2], strict=True):
        node = Node("")
        node.tag = kind
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


class Layouts:
    """Skeletons that stand for layouts, found and matched in the order given."""

    def __init__(self) -> None:
        self.leaders: list[tuple[Node, Counter]] = []

    def find(self, made: str) -> tuple[int | None, tuple[Node, Counter]]:
        """The first layout that matches in most nodes, if any, and what would make a new one."""
        t = tree(json.loads(made))
        paths: Counter = Counter()
        stack = [(t, 0)]
        while stack:
            n, at = stack.pop()
            at = hash((at, n.tag))
            paths[at] += 1
            stack += [(c, at) for c in n.children]
        for k, (leader, its) in enumerate(self.leaders):
            need = ALIKE * (paths.total() + its.total()) / 2
            # Matched nodes have equal paths, which bounds the match from above, as does the smaller tree.
            if min(paths.total(), its.total()) >= need and (paths & its).total() >= need and matching(leader, t, {}) >= need:
                return k, (t, paths)
        return None, (t, paths)


def layouts(skeletons: list[str]) -> list[int]:
    """The layout of each skeleton: the first one before it that it matches in most nodes, or a new one."""
    known, out = Layouts(), []
    for x in skeletons:
        k, new = known.find(x)
        if k is None:
            k = len(known.leaders)
            known.leaders.append(new)
        out.append(k)
    return out


def extract(source: str | None, wrapper: tuple[frozenset[int], frozenset[int]] | None) -> str:
    """All blocks that are neither furniture nor template, by (sure, doubtful) template marks."""
    if not source:
        return ""
    root = parse(source)
    found = list(blocks(root))
    if wrapper:
        sure, doubtful = wrapper
        kept = [(m, s) for p, s in found if (m := _mark(p, s)) not in sure]
        own = [s for m, s in kept if m not in doubtful]
        size = sum(map(len, own))
        if 2 * size < sum(len(s) for _, s in kept):
            own = [s for _, s in kept]
        if own:
            return " ".join(own)
    return " ".join(s for _, s in found)


def host() -> Column:
    """Lower-case host of the column url, "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shapes, marks = [], []
        for source in b.column("html"):
            root = parse(source.as_py())
            shapes.append(skeleton(root))
            marks.append(sorted({_mark(p, s) for p, s in blocks(root)}))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(shapes, pa.string()), pa.array(marks, pa.list_(pa.int64()))], ["host", "skeleton", "marks"])


def _leaders(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["n", "skeleton"], ascending=[False, True])
    found = layouts(group["skeleton"].tolist())
    first = [k for k, x in enumerate(found) if x not in found[:k]]
    return pd.DataFrame({"level": range(len(first))} | {c: group[c].iloc[first].tolist() for c in ("host", "shape", "skeleton")})


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeletons to the leader of their host that they match; those that match none keep their text and have no level."""
    key, known, names = None, Layouts(), []
    for b in batches:
        out = []
        for host, salt, level, shape, n, made in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "level", "shape", "n", "skeleton")), strict=True):
            if (host, salt) != key:
                key, known, names = (host, salt), Layouts(), []
            k, new = known.find(made)
            if level is not None:
                known.leaders.append(new)
                names.append(shape)
            else:
                out.append((host, shape, n, *((None, made) if k is None else (names[k], None))))
        columns = zip(*out, strict=True) if out else ((), (), (), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "shape", "n", "level", "skeleton"])


def _round(shapes: DataFrame, most: int) -> DataFrame:
    """``shapes`` with the layout (its leader's shape) of those that match one of the ``most`` commonest of their host."""
    order = W.partitionBy("host").orderBy(F.desc("n"), "skeleton")
    common = shapes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("host", "shape", "n", "skeleton")
    leaders = materialise(common.groupBy("host").applyInPandas(_leaders, "host string, level long, shape long, skeleton string"), "leaders")
    salts = shapes.groupBy("host").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("salts"))
    salts = materialise(salts, "salts")
    many = leaders.join(salts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None).cast("bigint")
    many = many.select("host", "salt", "level", "shape", none.alias("n"), "skeleton")
    rest = shapes.join(salts, "host").select("host", F.pmod("shape", "salts").cast("int").alias("salt"), none.alias("level"), "shape", "n", "skeleton")
    dealt = many.union(rest).repartition("host", "salt").sortWithinPartitions("host", "salt", F.asc_nulls_last("level"))
    out = materialise(dealt.mapInArrow(giving_back(_assigned), "host string, shape long, n long, level long, skeleton string"), "layouts")
    release(leaders, salts)
    return out


def levels_of(shapes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(host, shape, n, levels): the host as a whole (-1) and the layout of every skeleton; and the tables behind it.

    A host's ``LEADERS`` commonest skeletons are matched among themselves and give its
    first layouts. All others are matched with these, in groups of at most some ``DEALT``,
    so no task grows with a host. What matches none goes into another round, whose
    commonest give the next layouts, until every skeleton has one: that of the first
    leader it matches in the order of all skeletons by commonness, as ``layouts`` finds it.
    """
    done, most = [], LEADERS
    while True:
        done.append(_round(shapes, most))
        shapes = done[-1].where("level is null").select("host", "shape", "n", "skeleton")
        if shapes.isEmpty():
            break
        most = min(2 * most, max(LEADERS, DEALT))
    rounds = [x.where("level is not null").select("host", "shape", "n", F.array(F.lit(-1).cast("bigint"), "level").alias("levels")) for x in done]
    return reduce(DataFrame.union, rounds), done


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, sure, doubtful) from all pages; the marks as texts joined by commas."""
    read = pages.where("html is not null").withColumn("host", host()).select("host", "html")
    once = read.mapInArrow(giving_back(_evidence), "host string, skeleton string, marks array<long>").distinct()
    pages = materialise(once.withColumn("shape", F.xxhash64("skeleton")), "evidence")
    shapes = materialise(pages.groupBy("host", "shape", "skeleton").agg(F.count("*").alias("n")), "shapes")
    levels, rounds = levels_of(shapes)
    hint = F.broadcast if levels.count() <= BROADCAST_ROWS else lambda x: x
    whole = levels.select("host", "n", F.explode("levels").alias("level")).groupBy("host", "level").agg(F.sum("n").alias("pages")).where("pages > 1")
    marks = pages.join(hint(levels.select("host", "shape", "levels")), ["host", "shape"]).select("host", F.explode("levels").alias("level"), "marks")
    counted = marks.select("host", "level", F.explode("marks").alias("mark")).groupBy("host", "level", "mark").agg(F.count("*").alias("n")).where("n > 1")
    template = join_aggregate(counted, whole, "host", "level").where(F.col("n") >= CONSTANT * F.col("pages"))
    template = template.groupBy("host", "mark").agg(F.max(F.col("pages") >= LEAST).alias("sure"))
    one = [F.array_join(F.sort_array(F.collect_list(F.when(x, F.col("mark")))), ",").alias(name) for x, name in ((F.col("sure"), "sure"), (~F.col("sure"), "doubtful"))]
    out = materialise(template.groupBy("host").agg(*one), "wrappers")
    release(pages, shapes, *rounds)
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}
    for b in batches:
        texts = []
        for source, *wrapper in zip(b.column("html"), b.column("sure").to_pylist(), b.column("doubtful").to_pylist(), strict=True):
            key = tuple(wrapper)
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = tuple(frozenset(map(int, filter(None, (x or "").split(",")))) for x in key)
            texts.append(extract(source.as_py(), known[key]))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    w = wrappers(p)
    hint = F.broadcast if w.count() <= BROADCAST_ROWS else lambda x: x
    joined = p.withColumn("host", host()).join(hint(w), "host", "left").select("page_id", "url", "html", "sure", "doubtful")
    return joined.mapInArrow(giving_back(_extracted), "page_id long, url string, text string, n_chars long")
