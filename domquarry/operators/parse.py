"""Pages to tables: one map-side Arrow operator parses each page; everything after it is ordinary DataFrame code.

``parse_html`` and its kin give a ``Parsed`` with the tables docs, nodes and errors, all derived from one row a page, so a persisted
parse feeds all three. ``select_html`` matches inside the parse task and returns only the elements found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encodings
from ..plans.matcher import Matcher
from ..plans.selector import Selector
from .serializer import FIELDS, flatten
from .tokenizer import Tokenizer
from .treebuilder import Node, Restart, TreeBuilder

_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_STRINGS = {"node_type", "tag", "ns", "data", "public_id", "system_id"}
_TYPES = {f: pa.string() if f in _STRINGS else _ATTRS if f == "attrs" else pa.bool_() if f == "is_empty" else pa.int32() for f in FIELDS}
_DDL = {f: "string" if f in _STRINGS else "array<struct<name:string,value:string>>" if f == "attrs" else "boolean" if f == "is_empty" else "int" for f in FIELDS}
_DOC = (
    ("encoding", "string"), ("encoding_confidence", "string"), ("quirks_mode", "string"), ("root_id", "int"), ("body_id", "int"), ("doctype_name", "string"),
    ("public_id", "string"), ("system_id", "string"), ("n_nodes", "int"), ("n_errors", "int"), ("text", "string"), ("html", "string"),
)


class Parsed:
    """docs, nodes and errors of the parsed pages. ``cached()`` keeps the parse, so that several tables take it once."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def cached(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Parsed:
        return Parsed(self.rows.persist(level))

    @property
    def docs(self) -> DataFrame:
        return self.rows.select("doc_id", "doc.*")

    @property
    def nodes(self) -> DataFrame:
        n = self.rows.select("doc_id", F.inline("nodes"))
        return with_lookups(n)

    def nodes_with(self, name: str, kind: str, where: Column) -> DataFrame:
        """nodes with the ``text``, ``inner`` or ``outer`` markup (kind) of those for which ``where`` holds, null for the others.

        It is cut out in the row of the page, before nodes are exchanged: one parse serves both and no text goes along.
        """
        source, start, end = {"text": ("text", "text_start", "text_end"), "inner": ("html", "inner_start", "inner_end"), "outer": ("html", "html_start", "html_end")}[kind]
        n = self.rows.select("doc_id", F.col(f"doc.{source}").alias("_source"), F.inline("nodes"))
        cut = F.when(where, F.expr(f"substring(_source, {start} + 1, {end} - {start})"))
        return with_lookups(n.withColumn(name, cut).drop("_source"))

    @property
    def errors(self) -> DataFrame:
        return self.rows.select("doc_id", F.posexplode("errors").alias("seq", "message"))


def with_lookups(nodes: DataFrame) -> DataFrame:
    """nodes with what is derived from attrs: attr (a map), tag_lc and classes."""
    attr = F.map_from_entries("attrs")
    return nodes.withColumns({"tag_lc": F.when(F.col("node_type") == "element", F.lower("tag")), "attr": attr, "classes": F.split(attr["class"], "[ \\t\\n\\r\\f]")})


def _spread(df: DataFrame, key: str, partitions: int | str | None) -> DataFrame:
    """Small inputs come in fewer partitions than there are cores; parsing is worth a shuffle then. Large ones stay as they are."""
    if partitions == "auto":
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.isStreaming or df.rdd.getNumPartitions() >= 2 * cores:
            return df
        partitions = 2 * cores
    return df.repartition(partitions, key) if partitions else df


def _node_columns(rows: list[list], counts: list[int], fields: list[str]) -> pa.Array:
    columns = []
    for f in fields:
        i = FIELDS.index(f)
        if f == "attrs":
            columns.append(pa.array([None if r[i] is None else [{"name": k, "value": v} for k, v in r[i].items()] for r in rows], _ATTRS))
        else:
            columns.append(pa.array([r[i] for r in rows], _TYPES[f]))
    offsets = [0]
    for c in counts:
        offsets.append(offsets[-1] + c)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields))


def _doc_row(builder: TreeBuilder, rows: list[list], text: str, html: str, encoding: str | None, confidence: str) -> dict:
    top = [r for r in rows if r[2] == 0]
    root = next((r for r in top if r[5] == "element"), None)
    body = next((r for r in rows if root is not None and r[2] == root[0] and r[6] == "body"), None)
    doctype = next((r for r in top if r[5] == "doctype"), None)
    return {
        "encoding": encoding, "encoding_confidence": confidence, "quirks_mode": builder.quirks, "root_id": root[0] if root else None, "body_id": body[0] if body else None,
        "doctype_name": doctype[6] if doctype else None, "public_id": doctype[10] if doctype else None, "system_id": doctype[11] if doctype else None,
        "n_nodes": len(rows), "n_errors": len(builder.errors), "text": text, "html": html,
    }


def parse_string(text: str) -> tuple[TreeBuilder, str, str]:
    """As UTF-8, tentatively: a meta element that names another encoding is only an error."""
    state = ["UTF-8", encodings.TENTATIVE]

    def on_meta(builder: TreeBuilder, attrs: dict[str, str]) -> None:
        name = encodings.of_meta(attrs) if state[1] == encodings.TENTATIVE else None
        if name:
            name = "UTF-8" if name.startswith("UTF-16") else name
            if name == state[0]:
                state[1] = encodings.CERTAIN
            else:
                builder.error("meta element names another encoding")

    builder = TreeBuilder(text, on_meta=on_meta).run()
    return builder, state[0], state[1]


def parse_bytes(body: bytes, content_type: str | None) -> tuple[TreeBuilder, str, str]:
    """Reads the bytes as sniffed; a meta element may make it begin again once with another encoding."""
    text, name, confidence = encodings.sniff_decode(body, content_type)
    state = [name, confidence]

    def on_meta(builder: TreeBuilder, attrs: dict[str, str]) -> None:
        new = encodings.of_meta(attrs) if state[1] == encodings.TENTATIVE else None
        if new:
            new = "UTF-8" if new.startswith("UTF-16") else new
            if new != state[0]:
                raise Restart(new)
            state[1] = encodings.CERTAIN

    try:
        return TreeBuilder(text, on_meta=on_meta).run(), state[0], state[1]
    except Restart as other:
        again = encodings.decode(body, other.args[0])
        if again is None:
            return TreeBuilder(text).run(), name, confidence
        return TreeBuilder(again).run(), other.args[0], encodings.CERTAIN


def _pages(df: DataFrame, inputs: list[str], id_col: str, parse, fields: list[str], partitions) -> Parsed:
    if df is None:
        raise ValueError("a DataFrame is needed")
    fields = [f for f in FIELDS if f in fields]
    doc_type = pa.struct([(k, pa.int32() if t == "int" else pa.string()) for k, t in _DOC])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # few trees at a time
                part = batch.slice(lo, 64)
                docs, rows, counts, errors = [], [], [], []
                for values in zip(*(part.column(i).to_pylist() for i in range(1, part.num_columns)), strict=True):
                    builder, encoding, confidence = parse(*values)
                    own, text, html = flatten(builder.document)
                    docs.append(_doc_row(builder, own, text, html, encoding, confidence))
                    rows += own
                    counts.append(len(own))
                    errors.append(builder.errors)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(docs, doc_type), _node_columns(rows, counts, fields), pa.array(errors, pa.list_(pa.string()))], ["doc_id", "doc", "nodes", "errors"])

    # a page without markup has no tree
    source = _spread(df, id_col, partitions).select(F.col(id_col).alias("doc_id"), *inputs).where(F.col(inputs[0]).isNotNull())
    id_type = source.schema["doc_id"].dataType.simpleString()
    doc_ddl = "struct<" + ",".join(f"{k}:{t}" for k, t in _DOC) + ">"
    node_ddl = "array<struct<" + ",".join(f"{f}:{_DDL[f]}" for f in fields) + ">>"
    return Parsed(source.mapInArrow(run, f"doc_id {id_type}, doc {doc_ddl}, nodes {node_ddl}, errors array<string>"))


def parse_html(df: DataFrame, html: str = "html", id_col: str = "doc_id", fields: list[str] = FIELDS, partitions: int | str | None = "auto") -> Parsed:
    """Parses strings. fields: the columns of nodes that leave the parse task."""
    return _pages(df, [html], id_col, parse_string, fields, partitions)


def parse_html_bytes(df: DataFrame, body: str = "content", content_type: str | None = None, id_col: str = "doc_id", fields: list[str] = FIELDS, partitions: int | str | None = "auto") -> Parsed:
    """Parses undecoded bytes, with the column of Content-Type headers if there is one."""
    if content_type is None:
        return _pages(df, [body], id_col, lambda b: parse_bytes(b, None), fields, partitions)
    return _pages(df, [body, content_type], id_col, parse_bytes, fields, partitions)


def parse_fragment(df: DataFrame, html: str = "html", context: str = "div", ns: str = "html", id_col: str = "doc_id", fields: list[str] = FIELDS, partitions: int | str | None = "auto") -> Parsed:
    """Parses strings as the contents of a context element; top-level nodes are children of the document row."""
    return _pages(df, [html], id_col, lambda s: (TreeBuilder(s, (context, ns)).run(), None, encodings.IRRELEVANT), fields, partitions)


def empty_document() -> Node:
    """A document without children, for builders."""
    return Node("document")


_TOKEN = {
    "seq": "int", "kind": "string", "name": "string", "attrs": _DDL["attrs"], "self_closing": "boolean", "data": "string", "public_id": "string", "system_id": "string",
    "force_quirks": "boolean", "error": "string",
}
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), _DDL["attrs"]: _ATTRS}
#: Where a token has what a column is made of; a column that a kind lacks is null.
_PLACES = {"start": {"name": 1, "attrs": 2, "self_closing": 3}, "doctype": {"name": 1, "public_id": 2, "system_id": 3, "force_quirks": 4}, "error": {"error": 1}, "chars": {"data": 1}, "comment": {"data": 1}}
_PLACES["end"] = _PLACES["start"]


def _attr_list(attrs: dict[str, str]) -> list[dict[str, str]]:
    return [{"name": k, "value": v} for k, v in attrs.items()]


def _flat(found, columns: dict[str, str]):
    """Batches of a few thousand rows from a function that gives a page's rows one by one: neither a batch of pages nor a page is ever kept as rows as a whole."""
    names, types = list(columns), [_ARROW[t] for t in columns.values()]

    def batch(ids, at, rows):
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *made], ["doc_id", *names])

    def run(batches):
        for pages in batches:
            ids, html = pages.column(0), pages.column(1)
            at, rows, size = [], [], 0
            for i in range(pages.num_rows):
                for row, n in found(html[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    size += n
                    if len(rows) >= 4096 or size >= 4 << 20:
                        yield batch(ids, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield batch(ids, at, rows)

    return run


def _flat_rows(df: DataFrame, html: str, id_col: str, partitions, found, columns: dict[str, str]) -> DataFrame:
    source = _spread(df, id_col, partitions).select(F.col(id_col).alias("doc_id"), html).where(F.col(html).isNotNull())
    ddl = "".join(f", {k} {t}" for k, t in columns.items())
    return source.mapInArrow(_flat(found, columns), f"doc_id {source.schema['doc_id'].dataType.simpleString()}{ddl}")


def tokenize_html(
    df: DataFrame, html: str = "html", id_col: str = "doc_id", state: str = "data", last_start_tag: str | None = None, partitions: int | str | None = "auto", fields: list[str] | None = None
) -> DataFrame:
    """doc_id and tokens, errors among them; without a tree builder the tokenizer stays in the state it is given. fields: the columns of tokens that leave the task."""
    columns = {k: t for k, t in _TOKEN.items() if fields is None or k in fields}

    def found(page: str):
        for seq, t in enumerate(Tokenizer(page, state, last_start_tag)):
            at, row = _PLACES[t[0]], []
            for k in columns:
                row.append(seq if k == "seq" else t[0] if k == "kind" else None if k not in at else _attr_list(t[at[k]]) if k == "attrs" else t[at[k]])
            yield row, len(t[1] or "")

    return _flat_rows(df, html, id_col, partitions, found, columns)


def select_html(df: DataFrame, selector: Selector | str, html: str = "html", id_col: str = "doc_id", first: bool = False, partitions: int | str | None = "auto") -> DataFrame:
    """doc_id, node_id, tag, attrs, text and html of the matching elements, in one pass and without a shuffle of nodes."""
    selector = Selector.of(selector)

    def found(page: str):
        builder, match = parse_string(page)[0], Matcher(selector)
        for i, node in enumerate(preorder(builder.document)):
            if node.kind == "element" and match.matches(node):
                _, text, outer = flatten(_detached(node))
                yield (i, node.tag, _attr_list(node.attrs), text, outer), len(text) + len(outer)
                if first:
                    break

    return _flat_rows(df, html, id_col, partitions, found, {"node_id": "int", "tag": "string", "attrs": _DDL["attrs"], "text": "string", "html": "string"})


class _View:
    """A node as the root of what is flattened, without touching its tree."""

    def __init__(self, node: Node):
        self.kind, self.children = "document", [node]
        self.tag = self.ns = self.attrs = self.data = self.public_id = self.system_id = None


def _detached(node: Node) -> _View:
    return _View(node)


def preorder(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children))


def attr(name: str) -> Column:
    """An attribute's value, null if the element has none of that name."""
    return F.col("attr")[name]


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains("classes", name), F.lit(False))


def class_in(node: Column, name: str) -> Column:
    """As has_class, for a node of Parsed.rows."""
    value = F.get(F.filter(node["attrs"], lambda a: a["name"] == "class"), 0)["value"]
    return F.coalesce(F.array_contains(F.split(value, "[ \\t\\n\\r\\f]"), name), F.lit(False))
