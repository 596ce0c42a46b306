"""Page DOM as a column: one row per page, `nodes` in document order.

A page is tokenised once, in Arrow batches. Selection and extraction are column
expressions over the node array of the same row, so they need no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPE = (
    "struct<idx:int,last:int,parent:int,anc:array<int>,tag:string,id:string,classes:array<string>,"
    "attrs:map<string,string>,t0:int,t1:int,raw:string,s0:int,s1:int>"
)
# with the places of an element in the pieces of its page
SOURCE_NODE_TYPE = NODE_TYPE[:-1] + ",p0:int,p1:int>"
# a piece of the source: the element whose start tag it is, OTHER or COMMENT
PIECE_TYPE = "struct<node:int,text:string>"
OTHER, COMMENT = -1, -2
_ARROW_NODE = pa.struct([
    ("idx", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("anc", pa.list_(pa.int32())),
    ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("t0", pa.int32()), ("t1", pa.int32()),
    ("raw", pa.string()), ("s0", pa.int32()), ("s1", pa.int32()),
])
_ARROW_SOURCE_NODE = pa.struct([*_ARROW_NODE, ("p0", pa.int32()), ("p1", pa.int32())])
_ARROW_PIECE = pa.struct([("node", pa.int32()), ("text", pa.string())])

# Fixed values of the HTML standard: elements without content, and elements ended by a sibling.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
}
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "main", "aside", "hr"}
RAW_TEXT = {"script", "style"}


class _Tokens(HTMLParser):
    """Collects elements, text pieces and the places of both in the source of one page.

    `cuts` are the offsets where tags, texts and comments of the source begin. An element spans the cuts from its
    start tag to behind its end tag; one that is not closed ends where the element around it does.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.cuts: list[int] = []
        self.kinds: list[int] = []
        self.lines = [0]

    def read(self, html: str) -> None:
        self.source = html
        self.lines += [m.end() for m in re.finditer("\n", html)]
        self.feed(html)

    def _cut(self, kind: int) -> int:
        line, column = self.getpos()
        self.cuts.append(self.lines[line - 1] + column)
        self.kinds.append(kind)
        return len(self.cuts) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._cut(len(self.nodes))
        if self.open and tag in ENDS_P and self.nodes[self.open[-1]]["tag"] == "p":
            self._close(1, at)
        elif self.open and self.nodes[self.open[-1]]["tag"] in CLOSED_BY.get(tag, ()):
            self._close(1, at)
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        self.nodes.append({
            "idx": len(self.nodes), "last": len(self.nodes), "parent": self.open[-1] if self.open else None,
            "anc": list(self.open), "tag": tag, "id": given.get("id"), "classes": given.get("class", "").split(),
            "attrs": list(given.items()), "t0": len(self.texts), "t1": len(self.texts), "raw": None, "p0": at, "p1": at + 1,
        })
        if tag not in VOID_TAGS:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close(1, len(self.cuts))

    def handle_endtag(self, tag: str) -> None:
        at = self._cut(OTHER)
        for up, idx in enumerate(reversed(self.open), 1):
            if self.nodes[idx]["tag"] == tag:
                self._close(up - 1, at)
                self._close(1, at + 1)
                return

    def handle_data(self, data: str) -> None:
        self._cut(OTHER)
        top = self.nodes[self.open[-1]] if self.open else None
        if top is not None and top["tag"] in RAW_TEXT:
            top["raw"] = (top["raw"] or "") + data
        elif data.strip():
            self.texts.append(data.strip())

    def handle_comment(self, data: str) -> None:
        self._cut(COMMENT)

    def handle_decl(self, decl: str) -> None:
        self._cut(OTHER)

    handle_pi = unknown_decl = handle_decl

    def _close(self, count: int, at: int) -> None:
        for _ in range(count):
            node = self.nodes[self.open.pop()]
            node["last"], node["t1"], node["p1"] = len(self.nodes) - 1, len(self.texts), at

    def finish(self) -> tuple[list[dict], list[str]]:
        self.close()
        self._close(len(self.open), len(self.cuts))
        edges = [*self.cuts, len(self.source)]
        for node in self.nodes:
            node["s0"], node["s1"] = edges[node["p0"]], edges[node["p1"]]
        return self.nodes, self.texts

    def pieces(self) -> list[dict]:
        edges = [*self.cuts, len(self.source)]
        return [{"node": k, "text": self.source[a:b]} for k, a, b in zip(self.kinds, edges, edges[1:])]


def _tokenise(html: str | None) -> _Tokens:
    reader = _Tokens()
    reader.read(html or "")
    reader.finish()
    return reader


def page_dom(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",), source: bool = False) -> DataFrame:
    """(keep..., nodes, texts): the element table and the text pieces of each page.

    With `source` also `pieces`, the whole source cut at its tags, and each element's range of them.
    """
    node, arrow = (SOURCE_NODE_TYPE, _ARROW_SOURCE_NODE) if source else (NODE_TYPE, _ARROW_NODE)
    more = [T.StructField("pieces", T.ArrayType(T._parse_datatype_string(PIECE_TYPE)))] if source else []
    schema = T.StructType([
        *[pages.schema[k] for k in keep],
        T.StructField("nodes", T.ArrayType(T._parse_datatype_string(node))),
        T.StructField("texts", T.ArrayType(T.StringType())),
        *more,
    ])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small slices bound the memory of the expanded pages
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                parsed = [_tokenise(h) for h in piece.column(html).to_pylist()]
                cols = [piece.column(n) for n in names]
                cols.append(pa.array([p.nodes for p in parsed], pa.list_(arrow)))
                cols.append(pa.array([p.texts for p in parsed], pa.list_(pa.string())))
                if source:
                    cols.append(pa.array([p.pieces() for p in parsed], pa.list_(_ARROW_PIECE)))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)


def page_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """DOM as a table: one row per element with its text."""
    dom = page_dom(pages, keep=(key,))
    rows = dom.select(key, F.explode(F.transform("nodes", lambda n: F.struct(n.alias("n"), node_text(n).alias("text")))).alias("r"))
    return rows.select(
        key, F.col("r.n.idx").alias("node_id"), F.col("r.n.parent").alias("parent_id"), F.col("r.n.idx").alias("pre"),
        F.col("r.n.last").alias("post"), F.size("r.n.anc").alias("depth"), F.col("r.n.tag").alias("tag"),
        F.col("r.n.id").alias("id"), F.col("r.n.classes").alias("classes"), F.col("r.n.attrs").alias("attrs"),
        F.col("r.text").alias("text"),
    )


# --- node access -------------------------------------------------------------------------


def attr(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], F.lit(name))


def node_text(node: Column, sep: str = " ", texts: str = "texts") -> Column:
    """Visible text of an element; scripts and styles give their own source."""
    joined = F.array_join(F.slice(F.col(texts), node["t0"] + 1, node["t1"] - node["t0"]), sep)
    return F.coalesce(node["raw"], joined)


def visible_text(sep: str = " ", texts: str = "texts") -> Column:
    return F.array_join(F.col(texts), sep)


def within(node: Column, outer: Column) -> Column:
    return (node["idx"] > outer["idx"]) & (node["idx"] <= outer["last"])


# --- selectors ---------------------------------------------------------------------------

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*) | \.(?P<cls>-?[A-Za-z_][\w-]*) | \#(?P<id>[A-Za-z_][\w-]*)
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^*$~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""",
    re.X,
)
_STEP = re.compile(r"\s*>\s*|\s+")


def _simple_test(m: re.Match) -> Callable[[Column], Column]:
    g = m.groupdict()
    if g["tag"]:
        tag = g["tag"].lower()
        return (lambda n: F.lit(True)) if tag == "*" else (lambda n: n["tag"] == tag)
    if g["cls"]:
        return lambda n: F.array_contains(n["classes"], g["cls"])
    if g["id"]:
        return lambda n: F.coalesce(n["id"] == g["id"], F.lit(False))
    name = g["attr"].lower()
    value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)
    if g["op"] is None:
        return lambda n: F.map_contains_key(n["attrs"], F.lit(name))
    tests = {
        "=": lambda a: a == value,
        "^=": lambda a: F.startswith(a, F.lit(value)),
        "*=": lambda a: F.contains(a, F.lit(value)),
        "$=": lambda a: F.endswith(a, F.lit(value)),
        "~=": lambda a: F.array_contains(F.split(a, r"\s+"), value),
    }
    if value == "" and g["op"] != "=":
        return lambda n: F.lit(False)
    return lambda n: F.coalesce(tests[g["op"]](attr(n, name)), F.lit(False))


def _parse_selector(selector: str) -> list[list[tuple[str, list]]] | None:
    """Alternatives of (combinator, tests) steps; None when the selector is not supported or invalid."""
    alternatives = []
    for alternative in selector.split(","):
        text, at, steps, link = alternative.strip(), 0, [], ""
        while at < len(text):
            tests = []
            while m := _SIMPLE.match(text, at):
                if m.group("tag") and tests:
                    return None
                tests.append(_simple_test(m))
                at = m.end()
            if not tests:
                return None
            steps.append((link, tests))
            if at < len(text):
                gap = _STEP.match(text, at)
                if not gap or gap.end() == len(text):
                    return None
                link, at = (">" if ">" in gap.group() else " "), gap.end()
        if not steps:
            return None
        alternatives.append(steps)
    return alternatives


def matches(selector: str | None, nodes: str = "nodes") -> Callable[[Column], Column]:
    """Predicate on a node of the array column `nodes`; blank or invalid selectors match nothing."""
    parsed = _parse_selector(selector) if selector and selector.strip() else None
    if parsed is None:
        return lambda n: F.lit(False)

    def step(n: Column, steps: list, i: int) -> Column:
        ok = F.lit(True)
        for test in steps[i][1]:
            ok = ok & test(n)
        if i == 0:
            return ok
        node_at = lambda j: F.get(F.col(nodes), j)
        if steps[i][0] == ">":
            return ok & n["parent"].isNotNull() & F.coalesce(step(node_at(n["parent"]), steps, i - 1), F.lit(False))
        return ok & F.exists(n["anc"], lambda j: F.coalesce(step(node_at(j), steps, i - 1), F.lit(False)))

    def test(n: Column) -> Column:
        hit = F.lit(False)
        for steps in parsed:
            hit = hit | step(n, steps, len(steps) - 1)
        return hit

    return test


def select(selector: str | None, nodes: str = "nodes") -> Column:
    """Matching nodes in document order."""
    return F.filter(F.col(nodes), matches(selector, nodes))


def select_nodes(dom: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """(key, idx, tag, text, attrs) of all matches."""
    hits = F.transform(select(selector), lambda n: F.struct(n["idx"].alias("idx"), n["tag"].alias("tag"), node_text(n).alias("text"), n["attrs"].alias("attrs")))
    return dom.select(key, F.inline(hits))


def first_inside(found: Column, outer: Column) -> Column:
    """First of the found nodes inside another node."""
    return F.when(F.size(found) > 0, F.get(F.filter(found, lambda n: within(n, outer)), F.lit(0)))


def first_inside_each(found: Column, boxes: Column) -> Column:
    """For every box (in document order) the first of the found nodes inside it, NULL without one.

    Boxes and nodes are merged in document order: the number of nodes up to the start of a box is the place of
    the first node behind it, which is inside if the box reaches so far. One sort, no test of every pair.
    """
    def ends(s: Column) -> Column:
        mark = lambda kind, last: lambda n: F.struct(n["idx"].alias("idx"), F.lit(kind).alias("kind"), last(n).alias("last"))
        both = F.concat(F.transform(s["found"], mark(0, lambda n: F.lit(0))), F.transform(s["boxes"], mark(1, lambda n: n["last"])))
        placed = F.transform(F.sort_array(both), lambda x, i: F.struct(x["kind"].alias("kind"), x["last"].alias("last"), i.alias("at")))
        return F.filter(placed, lambda x: x["kind"] == 1)

    def pick(s: Column) -> Column:
        def first(box: Column, i: Column) -> Column:
            node = F.get(s["found"], box["at"] - i)
            return F.when(node["idx"] <= box["last"], node)

        return F.transform(ends(s), first)

    # both arrays are bound once: a selector must not be evaluated again for every box
    return F.get(F.transform(F.array(F.struct(found.alias("found"), boxes.alias("boxes"))), pick), F.lit(0))


def field_value(node: Column, attribute: str | None) -> Column:
    """Attribute value, or the text of the node."""
    return F.when(node.isNotNull(), attr(node, attribute) if attribute else node_text(node))


def with_matches(dom: DataFrame, selectors: Mapping[str, str | None], prefix: str) -> DataFrame:
    """One array column of matches per selector."""
    return dom.withColumns({f"{prefix}{i}": select(s) for i, s in enumerate(selectors.values())})
