import pyarrow.parquet as pq
import pytest
from trees import body, show

from domquarry.operators.serializer import FIELDS, flatten
from domquarry.operators.treebuilder import parse_document, parse_fragment


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p><b>x<br><p>y</p>", "p(b('x', br())), p(b('y'))"),
        ("<article><p><b>x</article><footer>z</footer>", "article(p(b('x'))), footer(b('z'))"),
        ("<table>x<tr><td>y", "'x', table(tbody(tr(td('y'))))"),
        ("<div id=a id=b>", "div id=a()"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "ul(li('a'), li('b', ul(li('c'))))"),
        ("<dl><dt>a<dd>b<dt>c", "dl(dt('a'), dd('b'), dt('c'))"),
        ("<b><p>x</b>y</p>", "b(), p(b('x'), 'y')"),
        ("<b><b><b><b>x</b></b></b></b><p>y", "b(b(b(b('x')))), p('y')"),
        ("<p><b><b><b><b>x<p>y", "p(b(b(b(b('x'))))), p(b(b(b('y'))))"),
        ("<a>1<a>2", "a('1'), a('2')"),
        ("<nobr>1<nobr>2", "nobr('1'), nobr('2')"),
        ("<h1>a<h2>b", "h1('a'), h2('b')"),
        ("<button>a<button>b", "button('a'), button('b')"),
        ("x</p>", "'x', p()"),
        ("</br>", "br()"),
        ("<image src=x>", "img src=x()"),
        ("<select><option>a<option>b<optgroup><option>c</select>d", "select(option('a'), option('b'), optgroup(option('c'))), 'd'"),
        ("<select><select>x", "select(), 'x'"),
        ("<table><select><tr><td>x", "select(), table(tbody(tr(td('x'))))"),
        ("<table><caption>a<colgroup><tr><td>1", "table(caption('a'), tbody(tr(td('1'))))"),
        ("<table><col><tr><th>x", "table(colgroup(col()), tbody(tr(th('x'))))"),
        ("<table><tr><td><table><tr><td>x", "table(tbody(tr(td(table(tbody(tr(td('x'))))))))"),
        ("<table><input type=hidden><input>", "input(), table(input type=hidden())"),
        ("<table><form><input></form>", "input(), table(form())"),
        ("<p>a<table><b>c</table>d", "p('a'), b('c'), table(), b('d')"),
        ("<pre>\n\nx</pre>", "pre('\\nx')"),
        ("<textarea>\n<b></textarea>", "textarea('<b>')"),
        ("<xmp><b></xmp><noscript><i></noscript>", "xmp('<b>'), noscript('<i>')"),
        ("<svg viewbox=1><FOREIGNOBJECT>x</foreignobject><g/></svg>y", "svg viewBox=1(foreignObject('x'), g()), 'y'"),
        ("<svg><p>x", "svg(), p('x')"),
        ("<svg><font color=x>", "svg(), font color=x()"),
        ("<svg><font>x", "svg(font('x'))"),
        ("<math definitionurl=x><mi><b>y", "math definitionURL=x(mi(b('y')))"),
        ("<svg><![CDATA[a<b]]></svg><![CDATA[x]]>", "svg('a<b'), <!--[CDATA[x]]-->"),
        ("<ruby>a<rt>b<rp>c", "ruby('a', rt('b'), rp('c'))"),
        ("<object><b></object>x", "object(b()), 'x'"),
        ("<p><form><form>", "p(), form()"),
        ("<template>x", "template('x')"),
        ("a\0b", "'ab'"),
        ("<body a=1><body a=2 b=3>x", "'x'"),
    ],
)
def test_body(html, expected):
    assert body(parse_document("<!DOCTYPE html>" + html).document) == expected


def test_documents():
    assert show(parse_document("").document) == "#(html(head(), body()))"
    assert show(parse_document("<!--a--><!DOCTYPE html> <html x=1><!--b--><head><title>t</title></head> <body>c</body></html><!--d-->").document) == (
        "#(<!--a-->, !html, html x=1(<!--b-->, head(title('t')), ' ', body('c')), <!--d-->)"
    )
    assert show(parse_document("<frameset><frame></frameset>x").document) == "#(html(head(), frameset(frame())))"
    assert show(parse_document("x</body><!--y-->").document).endswith("body('x'), <!--y-->))")


@pytest.mark.parametrize(
    ("html", "mode"),
    [
        ("", "quirks"),
        ("<!DOCTYPE html>", "no"),
        ("<!DOCTYPE html SYSTEM 'about:legacy-compat'>", "no"),
        ("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 4.01 Transitional//EN'>", "quirks"),
        ("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 4.01 Transitional//EN' 'x'>", "limited"),
        ("<!DOCTYPE html PUBLIC '-//W3C//DTD XHTML 1.0 Transitional//EN' 'x'>", "limited"),
        ("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 3.2 Final//EN'>", "quirks"),
        ("<!DOCTYPE foo>", "quirks"),
    ],
)
def test_quirks(html, mode):
    assert parse_document(html).quirks == mode


def test_a_table_closes_a_paragraph_but_in_quirks_mode():
    assert body(parse_document("<!DOCTYPE html><p>a<table>").document) == "p('a'), table()"
    assert body(parse_document("<p>a<table>").document) == "p('a', table())"


@pytest.mark.parametrize(
    ("html", "context", "ns", "expected"),
    [
        ("<td>x", "tr", "html", "#(td('x'))"),
        ("<li>a<li>b", "ul", "html", "#(li('a'), li('b'))"),
        ("a<b>c", "title", "html", "#('a<b>c')"),
        ("<b>c", "div", "html", "#(b('c'))"),
        ("<option>a<p>b", "select", "html", "#(option('ab'))"),
        ("<clippath/>x", "svg", "svg", "#(clipPath(), 'x')"),
        ("<p>x", "svg", "svg", "#(p('x'))"),
    ],
)
def test_fragments(html, context, ns, expected):
    assert show(parse_fragment(html, context, ns).document) == expected


def test_misnested_links_do_not_fail():
    assert parse_document("<a><font><font><font><font><font><p><a>").document


def test_deep_trees():
    rows, text, html = flatten(parse_document("<div>" * 5000 + "x").document)
    assert len(rows) == 5005 and text == "x" and html.count("</div>") == 5000


def test_invariants_of_flattening():
    at = {f: i for i, f in enumerate(FIELDS)}
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        rows, text, html = flatten(parse_document(page).document)
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert sorted(r[at["rev_id"]] for r in rows) == list(range(len(rows)))
        for r in rows[1:]:
            up = rows[r[at["parent_id"]]]
            assert up[0] < r[0] <= r[1] <= up[1]
            assert up[at["text_start"]] <= r[at["text_start"]] <= r[at["text_end"]] <= up[at["text_end"]]
            if r[at["node_type"]] == "text":
                assert text[r[at["text_start"]] : r[at["text_end"]]] == r[at["data"]]
            if r[at["node_type"]] == "element":
                piece = html[r[at["html_start"]] : r[at["html_end"]]]
                assert piece.startswith("<" + r[at["tag"]])
        again = flatten(parse_document(html).document)[2]
        assert flatten(parse_document(again).document)[2] == again
