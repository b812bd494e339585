"""What keeps queries in proportion to their input: plans without a Python group a document, small batches, pages parsed once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from domquarry.operators import mutate, parse, select
from domquarry.operators.parse import parse_html

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["markup_edits", "attribute_edits", "relabelled_links"])
def test_edits_make_no_group_a_document(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, SF))
    assert "GroupsInArrow" not in text and text.count("MapInArrow") == (1 if name == "markup_edits" else 2)  # the parse, and the edits unless they are made in it
    assert text.count("Exchange hashpartitioning(doc_id") <= 2


def test_edits_over_small_batches(spark, small_batches):
    """Documents that begin in one batch and end in another, without edits, with several and with edits but without nodes."""
    pages = spark.createDataFrame([(n, f"<p>{n}<b>x</b>") for n in range(7)], "doc_id long, html string")
    nodes = parse_html(pages).nodes
    chosen = spark.createDataFrame([(n, 4) for n in (1, 2, 5, 99)], "doc_id long, node_id int")
    changes = mutate.edits(chosen, "append", spec=mutate.text("!"), seq=1).unionByName(mutate.edits(chosen.where("doc_id = 5"), "append", spec=mutate.element("i", {"a": "1"})))
    edited = mutate.serialize(nodes, changes)
    end = {1: "!", 2: "!", 5: '<i a="1"></i>!'}
    assert {r["doc_id"]: r["html"] for r in edited.collect()} == {n: f"<html><head></head><body><p>{n}<b>x</b>{end.get(n, '')}</p></body></html>" if n else "<html><head></head><body><p>0<b>x</b></p></body></html>" for n in range(7)}
    own = changes.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "op", "node_id", "at", "other", "spec")).alias("edits"))
    in_parse = mutate.edit_pages(pages.join(own, "doc_id", "left")).docs.select("doc_id", "html", "text")
    assert in_parse.exceptAll(edited).count() == edited.exceptAll(in_parse).count() == 0
    again = mutate.serialize(mutate.apply_edits(nodes, changes))
    assert again.exceptAll(edited).count() == edited.exceptAll(again).count() == 0


class Caught(Exception):
    pass


@pytest.mark.parametrize("use", [lambda df: parse.tokenize_html(df, partitions=None), lambda df: parse.select_html(df, "b", partitions=None)])
def test_rows_leave_in_small_batches(spark, monkeypatch, use):
    """Neither the rows of a batch of pages nor those of one page are held together, so memory doesn't grow with either."""
    ran = []

    def catch(df, run, ddl):
        ran.append((run, ddl))
        raise Caught

    df = spark.createDataFrame([(1, "x")], "doc_id long, html string")
    monkeypatch.setattr(type(df), "mapInArrow", catch)
    with pytest.raises(Caught):
        use(df)
    pages = pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9], "html": ["<b></b>" * 10_000, "", "<b></b>" * 5]})
    batches = list(ran[0][0](iter([pages])))
    assert max(b.num_rows for b in batches) <= 4096 and set(batches[0].column(0).to_pylist()) == {7}
    per = 10_005 * (2 if "kind" in ran[0][1] else 1)
    assert sum(b.num_rows for b in batches) == per and batches[-1].column(0)[-1].as_py() == 9
    large = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "html": ["<b>" + "x" * (5 << 20) + "</b>"] * 3})
    assert len(list(ran[0][0](iter([large])))) >= 3


def test_tokens_of_chosen_columns(spark):
    df = spark.createDataFrame([(1, "<!doctype html><p a=1>x</p><!--c-->&#0;")], "doc_id long, html string")
    whole, some = parse.tokenize_html(df), parse.tokenize_html(df, fields=["kind", "name"])
    assert some.columns == ["doc_id", "kind", "name"]
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select("doc_id", "kind", "name").collect()))
    rows = {r["kind"]: r for r in whole.collect()}
    assert rows["start"]["attrs"][0]["value"] == "1" and rows["doctype"]["force_quirks"] is False and rows["comment"]["data"] == "c" and rows["error"]["error"]


@pytest.mark.parametrize("name", ["walks", "reverse_walk", "parents_of_items", "heading_components", "outlines"])
def test_pages_are_parsed_once(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, SF))
    assert text.count("MapInArrow") == 1 and "Join" not in text and "Aggregate" not in text


def test_walks_in_a_row_are_those_of_the_tables(spark):
    """On raw pages and on odd ones: no element of the name, several, one in another, two attributes named class by case."""
    odd = ["<div><p>a<p>b<div>c<p CLASS='y z'>d</div>e</div><!--f-->", "<i>x</i>", "", "<p class=y><b>t</b>u" + "v" * 40]
    pages = spark.createDataFrame([(n, t) for n, t in enumerate(odd, 900)], "doc_id long, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id doc_id", "html"))
    parsed = parse_html(pages).cached()
    n, rows = parsed.nodes, parsed.rows

    def same(table, of_div):
        got = rows.select("doc_id", F.inline(F.flatten(F.transform(select.elements_of("nodes", "div"), of_div))))
        return sorted(map(repr, got.distinct().collect())) == sorted(map(repr, table.distinct().collect()))

    def ids(nodes):
        return F.transform(nodes, lambda x: F.struct(x["node_id"].alias("node_id")))

    div = n.where("tag = 'div'")
    assert same(select.children(n, div).select("doc_id", "node_id"), lambda d: ids(select.children_of("nodes", d)))
    assert same(select.parent(n, div).select("doc_id", "node_id"), lambda d: ids(F.array(select.parent_of("nodes", d))))
    for reverse in (False, True):

        def walk(d):
            place = lambda x, i: F.struct(x["node_id"].alias("node_id"), d["node_id"].alias("root_id"), i.alias("position"))
            return F.transform(select.subtree_of("nodes", d, reverse=reverse), place)  # noqa: B023

        assert same(select.descendants(n, div, reverse=reverse).select("doc_id", "node_id", "root_id", "position"), walk)
    assert same(select.text_components(n, div), lambda d: F.array(F.struct(d["node_id"].alias("node_id"), select.texts_of("nodes", d).alias("components"))))
    body, some = n.where("tag = 'body'"), n.where("tag IN ('div', 'article')")
    places = rows.select("doc_id", F.explode(select.elements_of("nodes", "body")).alias("b"), "nodes").select("doc_id", "b", F.explode(select.elements_of("nodes", "div")).alias("d"))
    places = places.select("doc_id", select.index_in(F.col("b"), F.col("d")).alias("index")).where("index IS NOT NULL")
    table = select.index_of_child(n, body, div).select("doc_id", "index").where("index IS NOT NULL")
    assert sorted(map(repr, places.collect())) == sorted(map(repr, table.collect())) and places.count() > 50
    outlines = rows.select("doc_id", select.outline_of("nodes").alias("outline"))
    assert outlines.exceptAll(select.describe_tree(n)).count() == 0 == select.describe_tree(n).exceptAll(outlines).count()
    every = rows.select("doc_id", F.explode("nodes").alias("n"))
    y = every.where(parse.class_in(F.col("n"), "y")).select("doc_id", "n.node_id")
    assert sorted(map(repr, y.collect())) == sorted(map(repr, n.where(parse.has_class("y")).select("doc_id", "node_id").collect())) and y.count() == 2
    copies = every.select("doc_id", mutate.copy_of(F.col("n")).alias("c")).select("doc_id", "c.*")
    assert copies.exceptAll(mutate.copy_rows(n)).count() == 0 == mutate.copy_rows(n).exceptAll(copies).count()
    parsed.rows.unpersist()
