import json

import pytest
from pyspark.sql import functions as F

from domquarry.functions import attributes
from domquarry.operators import mutate
from domquarry.operators.parse import attr, has_class, parse_fragment, parse_html, parse_html_bytes, select_html, tokenize_html
from domquarry.operators.select import child_at, child_elements, children, describe_tree, descendants, inner_html, outer_html, parent, select_all, text_components, text_content
from domquarry.sources.pages import read_html_files, read_pages, register_functions, register_views, write_nodes
from domquarry.streaming.pages import arrivals, parse_stream, read_page_stream, write_selected

HTML = "<!DOCTYPE html><title>t&amp;</title><div id=a class='x y'>one<b>two</b>three<!--c--></div><ul><li>1<li>2</ul>"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(1, HTML), (2, ""), (3, None), (4, "<p>" * 3)]
    return parse_html(spark.createDataFrame(rows, "doc_id long, html string")).cached()


def one(df, column):
    return [r[0] for r in df.where("doc_id = 1").orderBy("node_id").select(column).collect()]


def test_docs(parsed):
    docs = {r["doc_id"]: r for r in parsed.docs.collect()}
    assert set(docs) == {1, 2, 4}  # null has no tree
    assert docs[1]["quirks_mode"] == "no" and docs[2]["quirks_mode"] == "quirks"
    assert docs[2]["html"] == "<html><head></head><body></body></html>"
    assert docs[1]["html"].startswith("<!DOCTYPE html><html><head><title>t&amp;</title></head><body><div")
    assert docs[1]["n_errors"] == 0 and docs[4]["n_errors"] > 0
    assert parsed.errors.where("doc_id = 2").count() == 1


def test_text_and_markup(parsed):
    n, d = parsed.nodes, parsed.docs
    div = select_all(n, "#a")
    assert one(text_content(div, d), "text_content") == ["onetwothree"]
    assert one(inner_html(div, d), "inner_html") == ["one<b>two</b>three<!--c-->"]
    assert one(outer_html(div, d), "outer_html") == ['<div id="a" class="x y">one<b>two</b>three<!--c--></div>']
    assert one(text_content(n.where("node_type = 'comment'"), d), "text_content") == ["c"]
    assert one(text_components(n, div), "components") == [["one", "three"]]
    assert one(text_components(n, select_all(n, "ul")), "components") == [[]]
    assert one(select_all(n, "div").where(has_class("y") & ~has_class("z")), attr("id")) == ["a"]
    assert one(n.where("tag_lc = 'title'"), attr("none")) == [None]


def test_navigation(parsed):
    n = parsed.nodes
    div, ul = select_all(n, "#a"), select_all(n, "ul")
    assert one(children(n, div), "node_type") == ["text", "element", "text", "comment"]
    assert one(child_elements(n, div), "tag") == ["b"]
    assert one(child_at(n, div, 2), "data") == ["three"] and child_at(n, div, 9).count() == 0
    assert one(parent(n, div), "tag") == ["body"]
    walk = descendants(n, ul, reverse=True).orderBy("position").select("tag", "data").collect()
    assert [r["tag"] or r["data"] for r in walk] == ["ul", "li", "2", "li", "1"]
    walk = descendants(n, ul, include_self=False).orderBy("position").select("position", "tag", "data").collect()
    assert [(r["position"], r["tag"] or r["data"]) for r in walk] == [(0, "li"), (1, "1"), (2, "li"), (3, "2")]
    assert describe_tree(n).where("doc_id = 2").first()["outline"] == "#document\n    <html>\n        <head>\n        <body>"


def test_fused_and_compiled_agree(spark, parsed):
    pages = spark.createDataFrame([(1, HTML)], "doc_id long, html string")
    found = select_html(pages, "li").collect()
    assert [(r["text"], r["html"]) for r in found] == [("1", "<li>1</li>"), ("2", "<li>2</li>")]
    assert [r["node_id"] for r in found] == one(select_all(parsed.nodes, "li"), "node_id")
    assert select_html(pages, "li", first=True).count() == 1


def test_fragments_and_tokens(spark):
    df = spark.createDataFrame([(1, "<td>a<td>b"), (2, None)], "doc_id long, html string")
    p = parse_fragment(df, context="tr")
    assert [r["tag"] for r in p.nodes.where("parent_id = 0").orderBy("node_id").collect()] == ["td", "td"]
    assert p.nodes.where("parent_id = 0 AND parent_el_id IS NULL AND el_idx = 1 AND el_count = 0").count() == 2
    assert p.docs.first()["encoding_confidence"] == "irrelevant"
    kinds = [r["kind"] for r in tokenize_html(df).orderBy("seq").collect()]
    assert kinds == ["start", "chars", "start", "chars"]


@pytest.mark.parametrize(
    ("body", "content_type", "encoding", "confidence", "text"),
    [
        ("<title>é</title>".encode(), "text/html; charset=utf-8", "UTF-8", "certain", "é"),
        (b"<meta charset=koi8-r><title>\xc1</title>", None, "KOI8-R", "certain", "а"),
        (b"<meta charset=windows-1252><title>\xe9</title>", None, "windows-1252", "certain", "é"),
        (b"<meta charset=utf-16><title>\xc3\xa9</title>", None, "UTF-8", "certain", "é"),
        (b"<meta charset=utf-8><title>\xe9</title>", None, "windows-1252", "tentative", "é"),
        (b"<meta charset=koi8-r><title>\xc3\xa9</title>", "charset=utf-8", "UTF-8", "certain", "é"),
    ],
)
def test_bytes(spark, body, content_type, encoding, confidence, text):
    df = spark.createDataFrame([(1, bytearray(body), content_type)], "doc_id long, content binary, ct string")
    r = parse_html_bytes(df, "content", "ct").docs.first()
    assert (r["encoding"], r["encoding_confidence"], r["text"]) == (encoding, confidence, text)


def test_changes(parsed):
    n = parsed.nodes.where("doc_id = 1")
    div, b, ul = select_all(n, "#a"), select_all(n, "b"), select_all(n, "ul")

    def markup(nodes):
        html = mutate.serialize(nodes).first()["html"]
        return html[html.index("<body>") + 6 : html.index("</body>")]

    rest = "<ul><li>1</li><li>2</li></ul>"
    start = '<div id="a" class="x y">'
    assert markup(mutate.remove_nodes(n, b)) == f"{start}onethree<!--c--></div>{rest}"
    assert markup(mutate.append_child(n, div, mutate.element("i", {"k": "v"}))).startswith(f'{start}one<b>two</b>three<!--c--><i k="v"></i></div>')
    assert markup(mutate.insert_at(n, div, 0, mutate.comment("z"))).startswith(f"{start}<!--z-->one")
    assert markup(mutate.replace_nodes(n, b, mutate.text("2"))).startswith(f"{start}one2three")
    assert markup(mutate.wrap(n, b, mutate.element("i"))).startswith(f"{start}one<i><b>two</b></i>three")
    assert markup(mutate.set_text(n, div, "<new>")).startswith(f"{start}&lt;new&gt;</div>")
    assert markup(mutate.set_text(n, div, "")).startswith(f"{start}</div>")
    assert markup(mutate.insert_text(n, div, 1, "+")).startswith(f"{start}one+<b>")
    assert markup(mutate.insert_text(n, div, 2, "+")).startswith(f"{start}one<b>two</b>+three")
    assert markup(mutate.edit_matches(n, "li:first-child, b", "remove")) == f"{start}onethree<!--c--></div><ul><li>2</li></ul>"
    assert markup(mutate.edit_matches(n, "b", "wrap", spec=mutate.element("i"))).startswith(f"{start}one<i><b>two</b></i>three")
    assert markup(mutate.remove_at(n, div, 1)).startswith(f"{start}onethree")
    ul_id = ul.first()["node_id"]
    assert markup(mutate.move_to(n, b, F.lit(ul_id))).endswith("<ul><li>1</li><li>2</li><b>two</b></ul>")
    assert markup(mutate.move_to(n, ul, F.lit(ul_id))) == markup(n)  # not into itself
    assert markup(mutate.set_attr(n, "id", "q", F.col("tag_lc") == "div")).startswith('<div id="q" class="x y">')
    assert markup(mutate.set_attr(n, "z", "q", F.col("tag_lc") == "div")).startswith('<div id="a" class="x y" z="q">')
    assert markup(mutate.remove_attr(n, "id")).startswith('<div class="x y">')
    assert markup(mutate.toggle_class(n, "x", F.col("tag_lc") == "div")).startswith('<div id="a" class="y">')
    assert markup(mutate.toggle_class(n, "w", F.col("tag_lc") == "div")).startswith('<div id="a" class="x y w">')
    assert mutate.serialize(mutate.set_document_type(n, None)).first()["html"].startswith("<html>")
    assert mutate.serialize(mutate.set_document_type(n, mutate.doctype("x"))).first()["html"].startswith("<!DOCTYPE x><html>")
    assert mutate.serialize(mutate.set_root(n, mutate.element("html"))).first()["html"] == "<!DOCTYPE html><html></html>"
    renumbered = mutate.remove_nodes(n, div).orderBy("node_id").collect()
    assert [r["node_id"] for r in renumbered] == list(range(len(renumbered)))
    assert mutate.apply_edits(n).select("node_id", "html_end").exceptAll(n.select("node_id", "html_end")).count() == 0
    assert mutate.copy_rows(b).first()["tag"] == "b"


def test_views_and_functions(spark, parsed, tmp_path):
    register_views(parsed)
    register_functions(spark)
    assert spark.sql("SELECT count(*) FROM nodes n JOIN docs d USING (doc_id) WHERE n.tag_lc = 'li'").first()[0] == 2
    assert spark.sql("SELECT html_text('<p>a<b>c')").first()[0] == "ac"
    assert [r[0] for r in spark.sql("SELECT text FROM html_select('<ul><li>a<li>b', 'li')").collect()] == ["a", "b"]
    assert spark.sql("SELECT text FROM html_nodes('<p>a<b>c') WHERE tag = 'p'").first()[0] == "ac"
    write_nodes(parsed, str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    assert select_all(stored, "ul > li").count() == 2
    found = stored.where("tag_lc = 'li'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag_lc,li)" in found


def test_ordered_attributes(spark):
    n = parse_html(spark.createDataFrame([(1, "<p a=1 b=2 c=3><i>")], "doc_id long, html string")).nodes
    got = n.where("tag in ('p', 'i')").orderBy("node_id").select(
        attributes.attr_index("b"), attributes.attr_index("z"), attributes.attr_at(2)["value"], attributes.first_attr(), attributes.last_attr(), attributes.attr_names(),
        F.to_json(attributes.attrs_with("z", "9", 1)), F.to_json(attributes.attrs_with("b", "9")),
    ).collect()
    assert tuple(got[0])[:6] == (1, None, "3", "a", "c", ["a", "b", "c"])
    assert [x["name"] for x in json.loads(got[0][6])] == ["a", "z", "b", "c"] and [x["value"] for x in json.loads(got[0][7])] == ["1", "9", "3"]
    assert tuple(got[1])[:6] == (None, None, None, None, None, []) and json.loads(got[1][6]) == [{"name": "z", "value": "9"}]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=utf-8><p>é".encode())
    assert read_html_files(spark, str(tmp_path)).docs.first()["text"] == "é"
    assert read_pages(spark, "/root/testdata/sf0.001/pages.parquet").columns == ["doc_id", "url", "html"]


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, HTML), (2, "<li>x")], "doc_id long, html string")
    pages.write.parquet(str(tmp_path / "in"))
    stream = read_page_stream(spark, str(tmp_path / "in"), pages.schema)
    write_selected(stream, "li", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = parse_stream(stream).nodes.where("tag = 'li'").writeStream.format("memory").queryName("li_nodes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM li_nodes").first()[0] == 3
    assert arrivals(stream.withColumn("ts", F.current_timestamp())).isStreaming


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, html string, nodes string")
    assert parse_html(df).nodes.count() == 0 and parse_html(df).docs.count() == 0
    with pytest.raises(ValueError):
        parse_html(None)


def test_edits_in_the_parse_task(spark):
    """The same trees as by rows of nodes, and no exchange in the plan."""
    pages = spark.createDataFrame([(1, HTML), (2, "")], "doc_id long, html string")
    columns = ["doc_id", "node_id", "tag", "data", "html_start", "html_end"]
    fused = mutate.edit_html(pages, "b", "remove", partitions=None).nodes.select(columns)
    by_rows = mutate.edit_matches(parse_html(pages).nodes, "b", "remove").select(columns)
    assert sorted(map(repr, fused.collect())) == sorted(map(repr, by_rows.collect()))
    assert "Exchange" not in fused._jdf.queryExecution().executedPlan().toString()


def test_texts_beside_nodes(spark, parsed):
    nodes = parsed.nodes_with("t", "text", F.col("tag") == "div")
    assert [r["t"] for r in nodes.where("doc_id = 1 AND t IS NOT NULL").collect()] == ["onetwothree"]
    assert one(select_all(parsed.nodes_with("t", "inner", F.col("tag") == "li"), "li"), "t") == ["1", "2"]


def test_first_match_or_null(parsed):
    from domquarry.operators.select import index_of_child, select_first

    n = parsed.nodes
    first = {r["doc_id"]: r["node_id"] for r in select_first(n, "li").collect()}
    assert set(first) == {1, 2, 4} and first[1] is not None and first[2] is first[4] is None
    ul = select_all(n, "ul")
    assert [r["index"] for r in index_of_child(n, ul, select_all(n, "li:last-child")).collect()] == [1]
