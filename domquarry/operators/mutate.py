"""Changes to trees: each takes nodes and gives new nodes; trees are renumbered, with offsets, in one pass a document.

Edits name nodes by (doc_id, node_id). An edit that needs no new numbers (attributes, classes) is a column expression. The others are rows
of an edit table, applied in order inside one operator over rows sorted by document: a document is rebuilt once however many edits it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attrs_with, attrs_without
from ..plans.matcher import Matcher
from ..plans.selector import Selector
from .parse import _ATTRS, _DDL, _TYPES, Parsed, _pages, parse_string, preorder, with_lookups
from .serializer import FIELDS, flatten
from .treebuilder import Node

_BLANK = "[ \\t\\n\\r\\f]"


def element(tag: str, attrs: dict[str, str] | None = None) -> dict:
    return {"kind": "element", "tag": tag, "attrs": dict(attrs or {})}


def text(data: str) -> dict:
    return {"kind": "text", "data": data}


def comment(data: str) -> dict:
    return {"kind": "comment", "data": data}


def doctype(name: str = "html", public_id: str = "", system_id: str = "") -> dict:
    return {"kind": "doctype", "tag": name, "public_id": public_id, "system_id": system_id}


def make(spec: dict) -> Node:
    ns = "html" if spec["kind"] == "element" else None
    return Node(spec["kind"], spec.get("tag"), ns, spec.get("attrs"), spec.get("data"), spec.get("public_id"), spec.get("system_id"))


# ---- edits that keep numbers


def set_attr(nodes: DataFrame, name: str, value: Column | str, where: Column | None = None) -> DataFrame:
    """A value set again keeps its place; a new one comes last."""
    return _attrs(nodes, attrs_with(name, value), where)


def remove_attr(nodes: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    return _attrs(nodes, attrs_without(name), where)


def toggle_class(nodes: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """Takes the first such class out, or adds it at the end; classes are joined by single blanks."""
    classes = F.filter(F.split(F.coalesce(F.col("attr")["class"], F.lit("")), _BLANK), lambda c: c != "")
    at = F.array_position(classes, name)
    out = F.when(at > 0, F.filter(classes, lambda c, i: i != at - 1)).otherwise(F.concat(classes, F.array(F.lit(name))))
    return set_attr(nodes, "class", F.array_join(out, " "), where)


def _attrs(nodes: DataFrame, attrs: Column, where: Column | None) -> DataFrame:
    chosen = F.col("node_type") == "element"
    chosen = chosen & where if where is not None else chosen
    return with_lookups(nodes.withColumn("attrs", F.when(F.coalesce(chosen, F.lit(False)), attrs).otherwise(F.col("attrs"))))


# ---- edits of the tree

EDIT = "doc_id long, seq int, op string, node_id int, at int, other int, spec struct<kind:string,tag:string,attrs:map<string,string>,data:string,public_id:string,system_id:string>"


def edit(op: str, node_id: Column | int | str = "node_id", at: int | None = None, other: Column | None = None, spec: dict | None = None, seq: int = 0) -> list[Column]:
    """The columns of EDIT but doc_id. Ops: append, insert, replace, remove, remove_at, remove_children, set_text, insert_text, wrap, move, set_root, set_doctype."""
    kind = "struct<kind:string,tag:string,attrs:map<string,string>,data:string,public_id:string,system_id:string>"
    made = F.lit(None).cast(kind)
    if spec is not None:
        pairs = [F.lit(x) for kv in (spec.get("attrs") or {}).items() for x in kv]
        attrs = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        made = F.struct(F.lit(spec["kind"]), F.lit(spec.get("tag")), attrs, F.lit(spec.get("data")), F.lit(spec.get("public_id")), F.lit(spec.get("system_id"))).cast(kind)
    other = F.lit(None) if other is None else other
    node_id = F.col(node_id) if isinstance(node_id, str) else F.lit(node_id)
    return [F.lit(seq).alias("seq"), F.lit(op).alias("op"), node_id.alias("node_id"), F.lit(at).cast("int").alias("at"), other.cast("int").alias("other"), made.alias("spec")]


def edits(of: DataFrame, op: str, at: int | None = None, other: Column | None = None, spec: dict | None = None, seq: int = 0) -> DataFrame:
    """The same edit for each row of ``of``."""
    return of.select("doc_id", *edit(op, "node_id", at, other, spec, seq))


def tree_of(rows: list[tuple]) -> dict[int, Node]:
    """The tree of a document's rows of TREE in order of node_id, by node_id."""
    by: dict[int, Node] = {}
    for node_id, parent_id, *own in rows:
        node = by[node_id] = Node(*own)
        if parent_id is not None:
            by[parent_id].append(node)
    return by


def _detach(node: Node) -> None:
    if node.parent is not None:
        node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = None


def apply_edit(by: dict[int, Node], e: dict) -> None:
    node, op = by.get(e["target"]), e["op"]
    if node is None:
        return
    new = make(e["spec"] | {"attrs": dict(e["spec"]["attrs"] or {})}) if e["spec"] else None
    at = e["at"]
    if op == "append":
        node.append(new)
    elif op == "insert":
        if not 0 <= at <= len(node.children):
            raise IndexError(f"no child index {at}")
        node.insert(at, new)
    elif op == "replace":
        if node.parent is not None:
            where = next(i for i, c in enumerate(node.parent.children) if c is node)
            parent = node.parent
            _detach(node)
            parent.insert(where, new)
    elif op == "remove":
        _detach(node)
    elif op == "remove_at":
        if not 0 <= at < len(node.children):
            raise IndexError(f"no child index {at}")
        _detach(node.children[at])
    elif op in ("remove_children", "set_text"):
        for c in list(node.children):
            _detach(c)
        if op == "set_text" and new is not None and new.data:
            node.append(new)
    elif op == "insert_text":
        node.insert_text(at, new.data)
    elif op == "wrap":
        if node.parent is not None:
            where = next(i for i, c in enumerate(node.parent.children) if c is node)
            node.parent.insert(where, new)
            new.append(node)
    elif op == "move":
        target = by.get(e["other"])
        up = target
        while up is not None and up is not node:
            up = up.parent
        if target is not None and up is None and node.parent is not target:
            target.append(node)
    elif op in ("set_root", "set_doctype"):
        kind = "element" if op == "set_root" else "doctype"
        old = next((c for c in node.children if c.kind == kind), None)
        if old is not None:
            where = node.children.index(old)
            _detach(old)
            if new is not None:
                node.insert(where, new)
        elif new is not None:
            root = next((i for i, c in enumerate(node.children) if c.kind == "element"), None)
            node.insert(root, new) if op == "set_doctype" and root is not None else node.append(new)
    else:
        raise ValueError(f"unknown edit {op}")


_PLAIN = "doc_id long, " + ", ".join(f"{f} {_DDL[f]}" for f in FIELDS)
#: What a tree is made of, as Node takes it after the two numbers; the other columns are made anew.
TREE = "node_id parent_id node_type tag ns attrs data public_id system_id".split()


def _attr_dicts(column: pa.ListArray) -> list[dict[str, str] | None]:
    names, values, at = column.values.field("name").to_pylist(), column.values.field("value").to_pylist(), column.offsets.to_pylist()
    return [dict(zip(names[lo:hi], values[lo:hi], strict=True)) if known else None for known, lo, hi in zip(column.is_valid().to_pylist(), at, at[1:], strict=False)]


def _documents(batches) -> Iterator[tuple[int, list[tuple], list[dict]]]:
    """doc_id, rows of TREE and edits of each document; batches are in order of document, and a document may begin in one and end in another."""
    doc_id, rows, own = None, [], []
    for batch in batches:
        columns = [_attr_dicts(batch.column(name)) if name == "attrs" else batch.column(name).to_pylist() for name in batch.schema.names]
        for of, *row in zip(*columns, strict=True):
            if of != doc_id:
                if rows:
                    yield doc_id, rows, own
                doc_id, rows, own = of, [], []
            if len(row) > len(TREE) and row[-1] is not None:
                own.append(row[-1])
            else:
                rows.append(row[: len(TREE)])
    if rows:
        yield doc_id, rows, own


def _node_batches(trees: Iterator[tuple[int, Node]]) -> Iterator[pa.RecordBatch]:
    def batch():
        columns = [pa.array(ids, pa.int64())]
        for i, f in enumerate(FIELDS):
            values = [r[i] for r in flat]
            columns.append(pa.array([None if v is None else [{"name": k, "value": x} for k, x in v.items()] for v in values], _ATTRS) if f == "attrs" else pa.array(values, _TYPES[f]))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *FIELDS])

    ids, flat = [], []
    for doc_id, root in trees:
        own = flatten(root)[0]
        ids += [doc_id] * len(own)
        flat += own
        if len(flat) >= 4096:
            yield batch()
            ids, flat = [], []
    if flat:
        yield batch()


def _markup_batches(trees: Iterator[tuple[int, Node]]) -> Iterator[pa.RecordBatch]:
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(htmls, pa.string()), pa.array(texts, pa.string())], ["doc_id", "html", "text"])

    ids, htmls, texts, size = [], [], [], 0
    for doc_id, root in trees:
        _, text, html = flatten(root)
        ids.append(doc_id)
        htmls.append(html)
        texts.append(text)
        size += len(html)
        if len(ids) >= 4096 or size >= 1 << 20:
            yield batch()
            ids, htmls, texts, size = [], [], [], 0
    if ids:
        yield batch()


def _rebuilt(nodes: DataFrame, change: Callable[[dict[int, Node], list[dict]], None], out: Callable, ddl: str, changes: DataFrame | None = None) -> DataFrame:
    """Rebuilds each document's tree, edits it and puts it out. One exchange by document brings its rows together, and its edits before them
    (they have no node_id); then a partition is one sorted stream: a group a document would cost far more than a small document's edits."""
    rows = nodes.select(F.col("doc_id").cast("long"), *TREE)
    if changes is not None:
        own = F.struct("seq", "op", F.col("node_id").alias("target"), "at", "other", "spec")
        own = changes.select(F.col("doc_id").cast("long"), *(F.lit(None).cast(_DDL[f]).alias(f) for f in TREE), own.alias("edit"))
        rows = own.union(rows.withColumn("edit", F.lit(None).cast(own.schema["edit"].dataType)))

    def trees(batches):
        for doc_id, tree, own in _documents(batches):
            by = tree_of(tree)
            change(by, own)
            yield doc_id, by[tree[0][0]]

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "node_id").mapInArrow(lambda batches: out(trees(batches)), ddl)


def _apply_own(by: dict[int, Node], own: list[dict]) -> None:
    for e in sorted(own, key=lambda e: (e["seq"], e["target"])):
        if e["spec"]:
            e["spec"]["attrs"] = dict(e["spec"]["attrs"] or [])
        apply_edit(by, e)


def apply_edits(nodes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """nodes with the edits applied in order of seq, renumbered and with new offsets. Documents stay on one task each."""
    return with_lookups(_rebuilt(nodes, _apply_own, _node_batches, _PLAIN, changes))


def edit_html(df: DataFrame, selector: Selector | str, op: str, at: int | None = None, spec: dict | None = None, html: str = "html", id_col: str = "doc_id", fields: list[str] = FIELDS, partitions="auto") -> Parsed:
    """Parses strings and edits every element that matches before rows are made of the tree: nothing is exchanged."""
    selector = Selector.of(selector)

    def parse(page: str):
        builder, encoding, confidence = parse_string(page)
        by, match = dict(enumerate(preorder(builder.document))), Matcher(selector)
        for i in [i for i, node in by.items() if node.kind == "element" and match.matches(node)]:
            apply_edit(by, {"target": i, "op": op, "at": at, "other": None, "spec": spec})
        return builder, encoding, confidence

    return _pages(df, [html], id_col, parse, fields, partitions)


def edit_pages(df: DataFrame, edits: str = "edits", html: str = "html", id_col: str = "doc_id", fields: list[str] = FIELDS, partitions="auto") -> Parsed:
    """Parses strings and makes each page's own edits, a column with an array of what ``edit`` gives, before rows are made of the tree: no node is exchanged."""

    def parse(page: str, own: list[dict] | None):
        builder, encoding, confidence = parse_string(page)
        if own:
            _apply_own(dict(enumerate(preorder(builder.document))), [e | {"target": e["node_id"]} for e in own])
        return builder, encoding, confidence

    return _pages(df, [html, edits], id_col, parse, fields, partitions)


def edit_matches(nodes: DataFrame, selector: Selector | str, op: str, at: int | None = None, spec: dict | None = None) -> DataFrame:
    """The same edit for every element that matches, found on the tree that is rebuilt anyway: nodes are read and exchanged once."""
    selector = Selector.of(selector)

    def change(by: dict[int, Node], _own: list[dict]) -> None:
        match = Matcher(selector)
        for i in [i for i, node in by.items() if node.kind == "element" and match.matches(node)]:
            apply_edit(by, {"target": i, "op": op, "at": at, "other": None, "spec": spec})

    return with_lookups(_rebuilt(nodes, change, _node_batches, _PLAIN))


def remove_nodes(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return apply_edits(nodes, edits(of, "remove"))


def append_child(nodes: DataFrame, of: DataFrame, spec: dict) -> DataFrame:
    return apply_edits(nodes, edits(of, "append", spec=spec))


def insert_at(nodes: DataFrame, of: DataFrame, at: int, spec: dict) -> DataFrame:
    return apply_edits(nodes, edits(of, "insert", at=at, spec=spec))


def remove_at(nodes: DataFrame, of: DataFrame, at: int) -> DataFrame:
    return apply_edits(nodes, edits(of, "remove_at", at=at))


def replace_nodes(nodes: DataFrame, of: DataFrame, spec: dict) -> DataFrame:
    return apply_edits(nodes, edits(of, "replace", spec=spec))


def wrap(nodes: DataFrame, of: DataFrame, spec: dict) -> DataFrame:
    return apply_edits(nodes, edits(of, "wrap", spec=spec))


def set_text(nodes: DataFrame, of: DataFrame, data: str) -> DataFrame:
    return apply_edits(nodes, edits(of, "set_text", spec=text(data)))


def insert_text(nodes: DataFrame, of: DataFrame, at: int, data: str) -> DataFrame:
    return apply_edits(nodes, edits(of, "insert_text", at=at, spec=text(data)))


def move_to(nodes: DataFrame, of: DataFrame, target: Column) -> DataFrame:
    """Makes each node the last child of the node whose id ``target`` gives; none if it already is its child or would be its own ancestor."""
    return apply_edits(nodes, edits(of, "move", other=target))


def set_root(nodes: DataFrame, spec: dict | None) -> DataFrame:
    return apply_edits(nodes, edits(nodes.where("node_type = 'document'"), "set_root", spec=spec))


def set_document_type(nodes: DataFrame, spec: dict | None) -> DataFrame:
    return apply_edits(nodes, edits(nodes.where("node_type = 'document'"), "set_doctype", spec=spec))


def copy_rows(of: DataFrame) -> DataFrame:
    """Shallow copies: a node's own data without parent, children or place."""
    return of.select("doc_id", *_copied(F.col))


def copy_of(node: Column) -> Column:
    """As copy_rows, for a node of Parsed.rows."""
    return F.struct(*_copied(lambda name: node[name]))


def _copied(of: Callable[[str], Column]) -> list[Column]:
    own = {name: of(name) for name in ("node_type", "tag", "attrs", "data", "public_id", "system_id")}
    own["ns"] = F.when(of("node_type") == "element", "html")
    return [own[name].alias(name) for name in ("node_type", "tag", "ns", "attrs", "data", "public_id", "system_id")]


def serialize(nodes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """doc_id, html and text of whole trees, folded from their rows; for trees whose docs row is out of date. With edits, of the edited trees."""
    return _rebuilt(nodes, _apply_own, _markup_batches, "doc_id long, html string, text string", changes)
