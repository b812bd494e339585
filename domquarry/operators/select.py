"""Queries over nodes: all or first matches, navigation, text and markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import compile_selector
from ..plans.selector import Selector

NODE = ["doc_id", "node_id"]


def with_match(nodes: DataFrame, selector: Selector | str, name: str = "matches") -> DataFrame:
    """The element rows with a boolean column: does the element match?"""
    return compile_selector(nodes, selector, name)


def select_all(nodes: DataFrame, selector: Selector | str, within: DataFrame | None = None) -> DataFrame:
    """The matching elements; ``within``: rows of nodes whose subtrees (themselves included) are searched. Order by doc_id, node_id at the edge."""
    found = with_match(nodes, selector, "_match").where("_match").drop("_match")
    return inside(found, within) if within is not None else found


def select_first(nodes: DataFrame, selector: Selector | str, within: DataFrame | None = None) -> DataFrame:
    """The first match of each document; a document without one has a row of nulls. With ``within``, of the documents of these rows."""
    found = with_match(nodes, selector, "_match")
    found = inside(found, within) if within is not None else found
    columns = [c for c in found.columns if c not in ("doc_id", "_match")]
    # one pass over elements: every document has some, and those that don't match count as nulls
    row = F.min_by(F.when(F.col("_match"), F.struct(*columns)), F.when(F.col("_match"), F.col("node_id")))
    return found.groupBy("doc_id").agg(row.alias("_r")).select("doc_id", "_r.*")


def inside(nodes: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    """Rows of nodes in the subtrees of the roots: an equi-join by document, then an interval."""
    r = roots.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_from"), F.col("subtree_end").alias("_to"))
    low = F.col("_from") if include_self else F.col("_from") + 1
    return nodes.join(r, (F.col("doc_id") == F.col("_doc")) & F.col("node_id").between(low, F.col("_to")), "left_semi")


def descendants(nodes: DataFrame, of: DataFrame, include_self: bool = True, reverse: bool = False) -> DataFrame:
    """Nodes of each subtree with root_id and position (from 0), in tree order or in that of a walk with last children first."""
    r = of.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("root_id"), F.col("subtree_end").alias("_to"), F.col("rev_id").alias("_rev"))
    low = F.col("root_id") if include_self else F.col("root_id") + 1
    rows = nodes.join(r, (F.col("doc_id") == F.col("_doc")) & F.col("node_id").between(low, F.col("_to")))
    position = (F.col("rev_id") - F.col("_rev") if reverse else F.col("node_id") - F.col("root_id")) - F.lit(0 if include_self else 1)
    return rows.withColumn("position", position).drop("_doc", "_to", "_rev")


def _joined(nodes: DataFrame, of: DataFrame, left: str, right: str) -> DataFrame:
    keys = of.select(F.col("doc_id").alias("_doc"), F.col(right).alias("_key")).where("_key IS NOT NULL").distinct()
    return nodes.join(keys, (F.col("doc_id") == F.col("_doc")) & (F.col(left) == F.col("_key")), "left_semi")


def parent(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return _joined(nodes, of, "node_id", "parent_id")


def parent_element(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return _joined(nodes, of, "node_id", "parent_el_id")


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Ordered by child_idx."""
    return _joined(nodes, of, "parent_id", "node_id")


def child_elements(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return children(nodes, of).where(F.col("node_type") == "element")


def child_at(nodes: DataFrame, of: DataFrame, index: int) -> DataFrame:
    """The child of that index, from 0; no row if there is none."""
    return children(nodes, of).where(F.col("child_idx") == index)


def index_of_child(nodes: DataFrame, of: DataFrame, child: DataFrame) -> DataFrame:
    """doc_id, node_id of the rows of ``of`` and index: where ``child``, of the same document, stands among its children; null if it is none."""
    places = child.select("doc_id", F.col("parent_id").alias("node_id"), F.col("child_idx").alias("index"))
    return of.select(*NODE).join(places, NODE, "left")


def text_content(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes with text_content: all text in the subtree, or a comment's own data."""
    text = F.when(F.col("node_type") == "comment", F.col("data")).otherwise(F.expr("substring(_text, text_start + 1, text_end - text_start)"))
    return nodes.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("text_content", text).drop("_text")


def text_components(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """doc_id, node_id and the array of an element's own texts, in order."""
    own = nodes.where(F.col("node_type") == "text").select("doc_id", F.col("parent_id").alias("node_id"), F.struct("child_idx", "data").alias("t"))
    lists = own.groupBy(*NODE).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["data"]).alias("components"))
    return of.select(*NODE).join(lists, NODE, "left").withColumn("components", F.coalesce("components", F.array().cast("array<string>")))


def inner_html(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    return _markup(nodes, docs, "inner_html", "inner_start", "inner_end")


def outer_html(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    return _markup(nodes, docs, "outer_html", "html_start", "html_end")


def _markup(nodes: DataFrame, docs: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Null for nodes below an element whose name has no contents; ``serialize`` of the mutation module has those."""
    h = docs.select("doc_id", F.col("html").alias("_html"))
    return nodes.join(h, "doc_id").withColumn(name, F.expr(f"substring(_html, {start} + 1, {end} - {start})")).drop("_html")


def _outline_line(of: Callable[[str], Column]) -> Column:
    """A node's line; ``of`` gives its columns by name."""
    data = F.when(F.length(of("data")) > 37, F.concat(F.substring(of("data"), 1, 37), F.lit("..."))).otherwise(of("data"))
    attrs = F.array_join(F.transform(of("attrs"), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")
    label = (
        F.when(of("node_type") == "element", F.concat(F.lit("<"), of("tag"), F.coalesce(attrs, F.lit("")), F.lit(">")))
        .when(of("node_type") == "text", F.concat(F.lit('"'), data, F.lit('"')))
        .when(of("node_type") == "comment", F.concat(F.lit("<!-- "), data, F.lit(" -->")))
        .when(of("node_type") == "doctype", F.concat(F.lit("<!DOCTYPE "), of("tag"), F.lit(">")))
        .otherwise(F.lit("#document"))
    )
    return F.concat(F.repeat(F.lit("    "), of("depth")), label)


def describe_tree(nodes: DataFrame) -> DataFrame:
    """doc_id and an indented outline; texts are cut at 37 characters."""
    line = F.struct("node_id", _outline_line(F.col).alias("line"))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("outline"))


# ---- the same within the row of a page, for Parsed.rows: ``nodes`` is its array in tree order, so an element stands at its node_id. A page is
# parsed once for any number of walks and nothing is exchanged, where each of the above joins nodes with nodes.


def elements_of(nodes: Column | str, tag: str) -> Column:
    """The page's elements of that name."""
    return F.filter(nodes, lambda n: (n["node_type"] == "element") & (F.lower(n["tag"]) == tag))


def subtree_of(nodes: Column | str, of: Column, include_self: bool = True, reverse: bool = False) -> Column:
    """The nodes of a subtree in tree order, or in that of a walk with last children first."""
    skip = 0 if include_self else 1
    rows = F.slice(nodes, of["node_id"] + F.lit(1 + skip), of["subtree_end"] - of["node_id"] + F.lit(1 - skip))
    if not reverse:
        return rows
    return F.transform(F.array_sort(F.transform(rows, lambda n: F.struct(n["rev_id"].alias("at"), n.alias("n")))), lambda x: x["n"])


def children_of(nodes: Column | str, of: Column) -> Column:
    return F.filter(subtree_of(nodes, of, include_self=False), lambda n: n["parent_id"] == of["node_id"])


def parent_of(nodes: Column | str, of: Column, name: str = "parent_id") -> Column:
    """The parent, null if there is none; name: parent_el_id for the parent element."""
    return F.get(nodes, of[name])


def index_in(of: Column, child: Column) -> Column:
    """Where the child stands among the children, null if it is none."""
    return F.when(child["parent_id"] == of["node_id"], child["child_idx"])


def texts_of(nodes: Column | str, of: Column) -> Column:
    """An element's own texts, in order."""
    return F.transform(F.filter(children_of(nodes, of), lambda n: n["node_type"] == "text"), lambda n: n["data"])


def outline_of(nodes: Column | str) -> Column:
    return F.array_join(F.transform(nodes, lambda n: _outline_line(lambda name: n[name])), "\n")
