"""Queries over markup made from ``page_id``, for what the raw pages lack; the SQL states the results as text of the same column.

A case is a template and what comes of it; ``{k}`` stands for the page's number in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.entities import html_unescape
from .operators import mutate
from .operators.parse import Parsed, attr, class_in, parse_html, parse_html_bytes, tokenize_html
from .operators.select import children_of, elements_of, index_in, outline_of, parent_of, select_first, subtree_of, texts_of, with_match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _quoted(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"


def _filled(column: Column) -> Column:
    return F.replace(column, F.lit("{k}"), F.col("page_id").cast("string"))


def _stated(columns: list[str], rows: list[tuple]) -> str:
    """SQL for the rows of each page: the case's number ``n`` and the columns, filled in."""
    values = ", ".join(f"({n}, {', '.join(map(_quoted, r))})" for n, r in enumerate(rows, 1))
    made = ", ".join(f"replace(v.{c}, '{{k}}', CAST(page_id AS VARCHAR)) AS {c}" for c in columns)
    return f"SELECT page_id, CAST(n AS BIGINT) AS n, {made} FROM pages, (VALUES {values}) v(n, {', '.join(columns)})"


def _made(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    """page_id, n, doc_id (both in one) and html, a row for each page and template."""
    cases = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t")) for n, t in enumerate(templates, 1)))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").withColumn("c", F.explode(cases))
    return pages.select("page_id", F.col("c.n").alias("n"), (F.col("page_id") * 1000 + F.col("c.n")).alias("doc_id"), _filled(F.col("c.t")).alias("html"))


def _numbered(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(F.expr("doc_id div 1000").alias("page_id"), F.expr("doc_id % 1000").alias("n"), *columns)


def _parsed(spark: SparkSession, sf_dir: str, templates: list[str], fields: list[str] | None = None) -> Parsed:
    return parse_html(_made(spark, sf_dir, templates), **({"fields": fields} if fields else {}))


def _add(name: str, f: Callable, sql: str, doc: str) -> None:
    f.__doc__ = doc
    QUERIES[name], ORACLE_SQL[name] = f, sql


def _trees(name: str, doc: str, cases: list[tuple[str, str]], around: tuple[str, str, str] | None = None) -> None:
    """The whole markup of each case's tree; around: what stands before a template, and around what comes of it."""
    lead, before, after = around or ("", "", "")
    templates = [lead + t for t, _ in cases]

    def f(spark, sf_dir):
        return _numbered(_parsed(spark, sf_dir, templates, ["node_id"]).docs, "html")

    _add(name, f, _stated(["html"], [(before + x + after,) for _, x in cases]), doc)


_BODY = ("<!DOCTYPE html><body>", "<!DOCTYPE html><html><head></head><body>", "</body></html>")

_trees(
    "markup_text",
    "Preprocessing, references, tags, attributes and comments.",
    [
        ("a{k}\r\nb\rc", "a{k}\nb\nc"),
        ("&#65;{k}&#x42;&#X43 z", "A{k}BC z"),
        ("&copy{k}", "©{k}"),
        ("&notit;{k} &notin;", "¬it;{k} ∉"),
        ("&#128;{k}&#0;&#xD800;&#x110000;&#99999999999999999999;", "€{k}����"),
        ("&bogus;{k} & &&amp;", "&amp;bogus;{k} &amp; &amp;&amp;"),
        ("&nbsp;{k}", "&nbsp;{k}"),
        ("a\0{k}", "a{k}"),
        ("""<p title="&lt;{k}&quot;" lang='&amp;x' id=i{k}&copy=2>""", '<p title="<{k}&quot;" lang="&amp;x" id="i{k}&amp;copy=2"></p>'),
        ("<p a={k} a=2 B=3 b=4>", '<p a="{k}" b="3"></p>'),
        ("<br/><p/>{k}</p>", "<br><p>{k}</p>"),
        ("</p a={k}>", "<p></p>"),
        ("<?php {k} ?>x", "<!--?php {k} ?-->x"),
        ("</ {k}>y", "<!-- {k}-->y"),
        ("<!-->{k}", "<!---->{k}"),
        ("<!--->{k}", "<!---->{k}"),
        ("<!--a--!>{k}", "<!--a-->{k}"),
        ("<!--a--b-->{k}", "<!--a--b-->{k}"),
        ("<!--a{k}", "<!--a{k}-->"),
        ("<!-- {k} --->", "<!-- {k} --->"),
        ("<!--a-b-{k}-->", "<!--a-b-{k}-->"),
        ("<!x{k}>y", "<!--x{k}-->y"),
        ("<![CDATA[x{k}]]>", "<!--[CDATA[x{k}]]-->"),
        ("<svg><![CDATA[a<{k}]]></svg>", "<svg>a&lt;{k}</svg>"),
        ("<>{k}", "&lt;&gt;{k}"),
        ("<3{k}", "&lt;3{k}"),
        ("</>{k}", "{k}"),
        ("<p{k}>", "<p{k}></p{k}>"),
        ("<P CLASS=X{k}>", '<p class="X{k}"></p>'),
        ("<p =a{k}>", '<p =a{k}=""></p>'),
        ('<p a"b={k}>', '<p a"b="{k}"></p>'),
        ('<p a=b"{k}>', '<p a="b&quot;{k}"></p>'),
        ('<p a="x"b={k}>', '<p a="x" b="{k}"></p>'),
        ("<p a=>{k}", '<p a="">{k}</p>'),
        ("<p a b = {k} c>", '<p a="" b="{k}" c=""></p>'),
        ("\x01{k}", "\x01{k}"),
        ("\U0001f600{k}", "\U0001f600{k}"),
    ],
    _BODY,
)

_trees(
    "markup_raw_text",
    "Scripts with their escapes, and other elements whose text is read as it stands.",
    [
        ('x<script>if (a<{k} && b) "</s";</script>y', 'x<script>if (a<{k} && b) "</s";</script>y'),
        ("x<script><!-- {k} - -- </script>y", "x<script><!-- {k} - -- </script>y"),
        ("x<script><!--<script>{k}</script>--></script>y", "x<script><!--<script>{k}</script>--></script>y"),
        ("x<script><!--<script>{k}</script></script>y", "x<script><!--<script>{k}</script></script>y"),
        ("x<script><!--{k}--><script></script>y", "x<script><!--{k}--><script></script>y"),
        ("x<script><!--<scriptx {k}</script>y", "x<script><!--<scriptx {k}</script>y"),
        ("x<script><!--<script>-{k}--<-</scripty></script>--></script>y", "x<script><!--<script>-{k}--<-</scripty></script>--></script>y"),
        ("x<script><!-- <x {k} </y></script>z", "x<script><!-- <x {k} </y></script>z"),
        ("x<script></scriptx>{k}</script>y", "x<script></scriptx>{k}</script>y"),
        ("x<script></script {k}>y", "x<script></script>y"),
        ("x<script>{k}", "x<script>{k}</script>"),
        ("x<style>a>{k}</b><</style>y", "x<style>a>{k}</b><</style>y"),
        ("x<textarea>&lt;{k}</b></textarea>y", "x<textarea>&lt;{k}&lt;/b&gt;</textarea>y"),
        ("x<plaintext>{k}</plaintext>", "x<plaintext>{k}</plaintext></plaintext>"),
        ("x<xmp><b>{k}</xmp><iframe><i></iframe><noembed><u></noembed>", "x<xmp><b>{k}</xmp><iframe><i></iframe><noembed><u></noembed>"),
        ("x<noscript><i>{k}</noscript>", "x<noscript><i>{k}</noscript>"),
    ],
    _BODY,
)

_trees(
    "markup_tables",
    "Tables in all their modes, with content that doesn't belong there put before them.",
    [
        ("<table><tr><td>{k}", "<table><tbody><tr><td>{k}</td></tr></tbody></table>"),
        ("<table>{k}<tr><td>a", "{k}<table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><b>{k}<tr><td>a", "<b>{k}</b><table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><caption>{k}<tr><td>b", "<table><caption>{k}</caption><tbody><tr><td>b</td></tr></tbody></table>"),
        ("<table><caption>{k}</caption></caption>", "<table><caption>{k}</caption></table>"),
        ("<table><col span={k}><tr><td>b", '<table><colgroup><col span="{k}"></colgroup><tbody><tr><td>b</td></tr></tbody></table>'),
        ("<table><colgroup>{k}<col>", "{k}<table><colgroup></colgroup><colgroup><col></colgroup></table>"),
        ("<table><thead><tr><th>{k}<tfoot><tr><td>c<tbody><tr><td>d", "<table><thead><tr><th>{k}</th></tr></thead><tfoot><tr><td>c</td></tr></tfoot><tbody><tr><td>d</td></tr></tbody></table>"),
        ("<table><td>{k}</table>x", "<table><tbody><tr><td>{k}</td></tr></tbody></table>x"),
        ("<table><tr><td>{k}<table><tr><td>n</table>m</table>", "<table><tbody><tr><td>{k}<table><tbody><tr><td>n</td></tr></tbody></table>m</td></tr></tbody></table>"),
        ("<table><table><tr><td>{k}", "<table></table><table><tbody><tr><td>{k}</td></tr></tbody></table>"),
        ("<table><input type=hidden><input value={k}>", '<input value="{k}"><table><input type="hidden"></table>'),
        ("<table><form id={k}><tr><td><input></form>", '<table><form id="{k}"></form><tbody><tr><td><input></td></tr></tbody></table>'),
        ("<table><style>a{k}</style><script>b</script><tr>", "<table><style>a{k}</style><script>b</script><tbody><tr></tr></tbody></table>"),
        ("<table><tr><td>{k}</tr><tr><th>e</tbody></table>f", "<table><tbody><tr><td>{k}</td></tr><tr><th>e</th></tr></tbody></table>f"),
        ("<table><tr></td></th></caption>{k}", "{k}<table><tbody><tr></tr></tbody></table>"),
        ("<p>{k}<table></p>", "<p>{k}</p><p></p><table></table>"),
        ("<table> <tr> <td>{k}", "<table> <tbody><tr> <td>{k}</td></tr></tbody></table>"),
        ("<table><tr><td>{k}</td></tr></table></table>z", "<table><tbody><tr><td>{k}</td></tr></tbody></table>z"),
        ("<table><!--{k}--><tr>", "<table><!--{k}--><tbody><tr></tr></tbody></table>"),
        ("<div>{k}</td></tr></tbody></col>x", "<div>{k}x</div>"),
    ],
    _BODY,
)

_trees(
    "markup_selects",
    "Select elements, alone and in tables, and option and ruby elements outside them.",
    [
        ("<select><option>{k}<option>b<optgroup label=c><option>d</select>e", '<select><option>{k}</option><option>b</option><optgroup label="c"><option>d</option></optgroup></select>e'),
        ("<select><b>{k}</b><p>x</select>", "<select>{k}x</select>"),
        ("<select>{k}<input>", "<select>{k}</select><input>"),
        ("<select><select>{k}", "<select></select>{k}"),
        ("<select><option>a</optgroup>{k}", "<select><option>a{k}</option></select>"),
        ("<select><optgroup><option>a</optgroup>{k}", "<select><optgroup><option>a</option></optgroup>{k}</select>"),
        ("<select><option>a</option>{k}", "<select><option>a</option>{k}</select>"),
        ("<table><tr><td><select>{k}<tr><td>b", "<table><tbody><tr><td><select>{k}</select></td></tr><tr><td>b</td></tr></tbody></table>"),
        ("<table><tr><td><select>{k}</table>c", "<table><tbody><tr><td><select>{k}</select></td></tr></tbody></table>c"),
        ("<table><select>{k}<tr>", "<select>{k}</select><table><tbody><tr></tr></tbody></table>"),
        ("<select><script>{k}</script>", "<select><script>{k}</script></select>"),
        ("<select><!--{k}-->", "<select><!--{k}--></select>"),
        ("<option>{k}<option>b<optgroup>c", "<option>{k}</option><option>b</option><optgroup>c</optgroup>"),
        ("<ruby>{k}<rt>b<rp>c", "<ruby>{k}<rt>b</rt><rp>c</rp></ruby>"),
        ("<select><keygen>{k}", "<select></select><keygen>{k}"),
    ],
    _BODY,
)

_trees(
    "markup_formatting",
    "The adoption agency and the list of active formatting elements.",
    [
        ("<b>{k}<i>x</b>y</i>", "<b>{k}<i>x</i></b><i>y</i>"),
        ("<p><b>{k}<br><p>y</p>", "<p><b>{k}<br></b></p><p><b>y</b></p>"),
        ("<b><p>{k}</b>y</p>", "<b></b><p><b>{k}</b>y</p>"),
        ("<b><i><p>{k}</b>", "<b><i></i></b><i><p><b>{k}</b></p></i>"),
        ("<a href=1>{k}<a href=2>z", '<a href="1">{k}</a><a href="2">z</a>'),
        ("<a>1<div>{k}<a>3", "<a>1</a><div><a>{k}</a><a>3</a></div>"),
        ("<nobr>{k}<nobr>z", "<nobr>{k}</nobr><nobr>z</nobr>"),
        ("<p><b><b><b><b>{k}<p>y", "<p><b><b><b><b>{k}</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
        ("<em>{k}</i></em>z", "<em>{k}</em>z"),
        ("<object><b>{k}</object>x", "<object><b>{k}</b></object>x"),
        ("<font size={k}><p>a</font>b", '<font size="{k}"></font><p><font size="{k}">a</font>b</p>'),
        ("<span>{k}<div></span>z", "<span>{k}<div>z</div></span>"),
        ("<i>{k}<table><tr><td></i>z</table>y", "<i>{k}<table><tbody><tr><td>z</td></tr></tbody></table>y</i>"),
        ("<big>{k}<code>a<s>b<small>c<strike>d<strong>e<tt>f<u>g", "<big>{k}<code>a<s>b<small>c<strike>d<strong>e<tt>f<u>g</u></tt></strong></strike></small></s></code></big>"),
        ("<article><p><b>{k}</article><footer>z</footer>", "<article><p><b>{k}</b></p></article><footer><b>z</b></footer>"),
    ],
    _BODY,
)

_trees(
    "markup_blocks",
    "What start and end tags do in a body: blocks, lists, forms, headings, void elements.",
    [
        ("<pre>\n\n{k}</pre>", "<pre>\n\n{k}</pre>"),
        ("<pre>\n{k}</pre>", "<pre>{k}</pre>"),
        ("<textarea>\n{k}</textarea><listing>\n{k}", "<textarea>{k}</textarea><listing>{k}</listing>"),
        ("<form id={k}><div><form>x</form>y", '<form id="{k}"><div>xy</div></form>'),
        ("<ul><li>{k}<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>{k}</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<dl><dt>{k}<dd>b<dt>c", "<dl><dt>{k}</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<button>{k}<button>b", "<button>{k}</button><button>b</button>"),
        ("<h1>{k}<h2>b", "<h1>{k}</h1><h2>b</h2>"),
        ("<h1>{k}</h3>b", "<h1>{k}</h1>b"),
        ("<p>{k}<hr>b", "<p>{k}</p><hr>b"),
        ("<image src={k}>", '<img src="{k}">'),
        ("</br>{k}", "<br>{k}"),
        ("{k}</p>", "{k}<p></p>"),
        ("x<title>{k}</title><meta a=1><link><base>", 'x<title>{k}</title><meta a="1"><link><base>'),
        ("<applet><b>{k}</applet><marquee>x</marquee>", "<applet><b>{k}</b></applet><marquee>x</marquee>"),
        ("<div>{k}</div></div></section>x", "<div>{k}</div>x"),
        ("<p>{k}<address>a</address><blockquote>b<center>c", "<p>{k}</p><address>a</address><blockquote>b<center>c</center></blockquote>"),
        ("<address>{k}<p>a</address>b", "<address>{k}<p>a</p></address>b"),
        ("<menu><li>{k}</menu><menuitem>x<hr>{k}", "<menu><li>{k}</li></menu><menuitem><hr>{k}"),
        ("<area a={k}><embed><keygen><wbr><param><source><track><img><bgsound><basefont>", '<area a="{k}"><embed><keygen><wbr><param><source><track><img><bgsound><basefont>'),
        ("<input value={k}><caption><col><td>x", '<input value="{k}">x'),
        ("<x-{k}>a</x-{k}>b", "<x-{k}>a</x-{k}>b"),
    ],
    _BODY,
)

_trees(
    "markup_documents",
    "Around the body: comments, heads, attributes of html and body, framesets, what follows the end.",
    [
        ("{k}", "<html><head></head><body>{k}</body></html>"),
        ("", "<html><head></head><body></body></html>"),
        (
            "<!--{k}--><!DOCTYPE html><!--b--><html lang=x><!--c--><head><!--d--></head><!--e--><body>f</body><!--g--></html><!--h-->",
            '<!--{k}--><!DOCTYPE html><!--b--><html lang="x"><!--c--><head><!--d--></head><!--e--><body>f</body><!--g--></html><!--h-->',
        ),
        ("<!DOCTYPE html><head></head><link href={k}><title>a</title>b", '<!DOCTYPE html><html><head><link href="{k}"><title>a</title></head><body>b</body></html>'),
        ("<!DOCTYPE html>a</body>{k}", "<!DOCTYPE html><html><head></head><body>a{k}</body></html>"),
        ("<!DOCTYPE html>a</html> {k}<!--c-->", "<!DOCTYPE html><html><head></head><body>a {k}<!--c--></body></html>"),
        ("<!DOCTYPE html><body a={k}><body a=2 b=3>x<html c=4>", '<!DOCTYPE html><html c="4"><head></head><body a="{k}" b="3">x</body></html>'),
        (
            "<!DOCTYPE html><frameset rows={k}><frame src=a><frameset><frame></frameset><noframes>x</noframes></frameset>y<noframes>z</noframes>",
            '<!DOCTYPE html><html><head></head><frameset rows="{k}"><frame src="a"><frameset><frame></frameset><noframes>x</noframes></frameset><noframes>z</noframes></html>',
        ),
        ("<!DOCTYPE html><p><frameset cols={k}>", '<!DOCTYPE html><html><head></head><frameset cols="{k}"></frameset></html>'),
        ("<!DOCTYPE html>{k}<frameset>", "<!DOCTYPE html><html><head></head><body>{k}</body></html>"),
        ("<!DOCTYPE html><frameset></frameset></html><!--{k}--> <noframes>a</noframes>", "<!DOCTYPE html><html><head></head><frameset></frameset> <noframes>a</noframes></html><!--{k}-->"),
        ("<!DOCTYPE html><head><noscript><b>{k}</noscript>", "<!DOCTYPE html><html><head><noscript><b>{k}</noscript></head><body></body></html>"),
        ("<!DOCTYPE html><head><base><basefont><bgsound><link><meta><style>{k}</style><script></script><noframes><i></noframes>", "<!DOCTYPE html><html><head><base><basefont><bgsound><link><meta><style>{k}</style><script></script><noframes><i></noframes></head><body></body></html>"),
        ("<head></head> {k}", "<html><head></head> <body>{k}</body></html>"),
        ("<p>{k}<table>", "<html><head></head><body><p>{k}<table></table></p></body></html>"),
    ],
)

_trees(
    "markup_foreign",
    "SVG and MathML: names, integration points, what breaks out of them.",
    [
        ("<svg viewbox={k}><g/><FOREIGNOBJECT>a</foreignobject></svg>y", '<svg viewBox="{k}"><g></g><foreignObject>a</foreignObject></svg>y'),
        ("<svg><foreignObject><p>{k}</foreignObject></svg>y", "<svg><foreignObject><p>{k}y</p></foreignObject></svg>"),
        ("<svg><p>{k}", "<svg></svg><p>{k}</p>"),
        ("<svg><font color={k}>", '<svg></svg><font color="{k}"></font>'),
        ("<svg><font>{k}", "<svg><font>{k}</font></svg>"),
        ("<math definitionurl={k}><mi>x<b>y</b></mi><mo></math>z", '<math definitionURL="{k}"><mi>x<b>y</b></mi><mo></mo></math>z'),
        ("<math><annotation-xml encoding=text/html><p>{k}", '<math><annotation-xml encoding="text/html"><p>{k}</p></annotation-xml></math>'),
        ("<math><annotation-xml><svg><g>{k}", "<math><annotation-xml><svg><g>{k}</g></svg></annotation-xml></math>"),
        ("<svg><desc>{k}</desc><title>t</title>", "<svg><desc>{k}</desc><title>t</title></svg>"),
        ("<svg><a xlink:href={k}>", '<svg><a xlink:href="{k}"></a></svg>'),
        ("<svg><script>a<{k}</script></svg>", "<svg><script>a<{k}</script></svg>"),
        ("<math><mtext><mglyph/><malignmark/>{k}", "<math><mtext><mglyph></mglyph><malignmark></malignmark>{k}</mtext></math>"),
        ("<svg>\0{k}", "<svg>�{k}</svg>"),
        ("{k}</svg></math>", "{k}"),
        ("<svg><CLIPPATH/><!--{k}-->", "<svg><clipPath></clipPath><!--{k}--></svg>"),
        ("<table><tr><svg><td>{k}", "<svg><td>{k}</td></svg><table><tbody><tr></tr></tbody></table>"),
    ],
    _BODY,
)


_NAMESPACES = [
    ("<svg><g><foreignObject><b>{k}", "html:html html:head html:body svg:svg svg:g svg:foreignObject html:b {k}"),
    ("<math><mi><i>{k}", "html:html html:head html:body math:math math:mi html:i {k}"),
    ("<svg/><math/><p>{k}", "html:html html:head html:body svg:svg math:math html:p {k}"),
]


def _namespaces(spark, sf_dir):
    rows = _parsed(spark, sf_dir, [t for t, _ in _NAMESPACES], ["node_type", "tag", "ns", "data"]).rows
    names = F.expr("array_join(transform(filter(nodes, n -> n.node_type IN ('element', 'text')), n -> CASE WHEN n.node_type = 'text' THEN n.data ELSE concat(n.ns, ':', n.tag) END), ' ')")
    return _numbered(rows, names.alias("names"))


_add("markup_namespaces", _namespaces, _stated(["names"], [(x,) for _, x in _NAMESPACES]), "Names and namespaces of elements, in order.")


# ---- document types and tokens

_DOCTYPES = [
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://x/{k}">', "no", "html", "-//W3C//DTD HTML 4.01//EN", "http://x/{k}"),
    ("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 4.01 Transitional//EN'>{k}", "quirks", "html", "-//W3C//DTD HTML 4.01 Transitional//EN", ""),
    ("<!DOCTYPE html PUBLIC '-//W3C//DTD HTML 4.01 Transitional//EN' 'x{k}'>", "limited", "html", "-//W3C//DTD HTML 4.01 Transitional//EN", "x{k}"),
    ("<!DOCTYPE html PUBLIC '-//W3C//DTD XHTML 1.0 Frameset//EN' \"{k}\">", "limited", "html", "-//W3C//DTD XHTML 1.0 Frameset//EN", "{k}"),
    ("<!DOCTYPE html SYSTEM 'about:legacy-compat'>{k}", "no", "html", "", "about:legacy-compat"),
    ('<!doctype html system "s{k}">', "no", "html", "", "s{k}"),
    ("<!DOCTYPE HtMl >{k}", "no", "html", "", ""),
    ("<!DOCTYPE x{k}>", "quirks", "x{k}", "", ""),
    ('<!DOCTYPE html PUBLIC "a{k}>', "quirks", "html", "a{k}", ""),
    ("<!DOCTYPE html bogus{k}>", "quirks", "html", "", ""),
    ('<!DOCTYPE html PUBLIC"p{k}""s">', "no", "html", "p{k}", "s"),
    ('<!DOCTYPE html PUBLIC "p{k}" x>', "quirks", "html", "p{k}", ""),
    ("<!DOCTYPE html SYSTEM>{k}", "quirks", "html", "", ""),
    ('<!DOCTYPE html SYSTEM "s{k}" x>', "no", "html", "", "s{k}"),
    ('<!DOCTYPE html PUBLIC "-//IETF//DTD HTML//EN" "{k}">', "quirks", "html", "-//IETF//DTD HTML//EN", "{k}"),
    ('<!DOCTYPE html SYSTEM "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd">{k}', "quirks", "html", "", "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"),
    ("{k}", "quirks", "", "", ""),
]


def _doctypes(spark, sf_dir):
    docs = _parsed(spark, sf_dir, [t for t, *_ in _DOCTYPES], ["node_id"]).docs
    return _numbered(docs, "quirks_mode", *(F.coalesce(c, F.lit("")).alias(c) for c in ("doctype_name", "public_id", "system_id")))


_add("markup_doctypes", _doctypes, _stated(["quirks_mode", "doctype_name", "public_id", "system_id"], [x for _, *x in _DOCTYPES]), "Names and ids of document types, and the mode they bring; missing ones are empty.")

_TOKENS = [
    ("<!DOCTYPE a PUBLIC 'b' 'c{k}'><p x=1 y='{k}'>d&amp;</p z><br/><!--e{k}-->", "doctype a b c{k} | start p x=1 y={k} | chars d& | end p z= | start br / | comment e{k}"),
    ("<a b=1 b={k}>&#x41;&notit;", "start a b=1 | chars A¬it;"),
    ("a<script>{k}</script>", "chars a | start script | chars {k} | end script"),
]


def _tokens(spark, sf_dir):
    rows = tokenize_html(_made(spark, sf_dir, [t for t, _ in _TOKENS])).where("kind <> 'error'")
    attrs = F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"]))
    slash = F.when(F.col("self_closing"), F.lit("/"))
    line = F.concat_ws(" ", "kind", "name", F.when(F.size("attrs") > 0, F.concat_ws(" ", attrs)), slash, "data", "public_id", "system_id")
    lists = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), " | ").alias("tokens"))
    return _numbered(lists, "tokens")


_add("markup_tokens", _tokens, _stated(["tokens"], [(x,) for _, x in _TOKENS]), "The token stream: all kinds of tokens with what they carry.")

# ---- selectors

_FORM = (
    "<!DOCTYPE html><body><div id=d{k} class='big red'><p id=p1 title=a lang=en-x>x<p id=p2 class=red title=b{k}>y<span id=s1></span><p id=p3 title='a b'>z</div>"
    "<ul id=u><li id=l1>1<li id=l2 class=x>2<li id=l3>3<li id=l4 class=x>4<li id=l5>5</ul>"
    "<fieldset id=f disabled><legend id=g><input id=i1></legend><input id=i2><select id=e><option id=o1 selected><option id=o2></select></fieldset>"
    "<input id=i3 type=checkbox checked><input id=i4 disabled><a id=a1 href=#>l</a><a id=a2>m</a><button id=b{k}></button><h2 id=p1>w</h2>"
)
_SELECTORS = [
    ("[title=a]", "p1"),
    ("p[title='b{k}']", ""),  # braces aren't filled in a selector
    ("[title~=b]", "p3"),
    ("[title~=a]", "p1 p3"),
    ("#p1", "p1 p1"),
    ("p#p1", "p1"),
    (".red", "d{k} p2"),
    (".big.red", "d{k}"),
    ("[lang|=en]", "p1"),
    ("li:nth-of-type(2n)", "l2 l4"),
    ("li.x:nth-of-type(2)", "l4"),
    ("li:nth-last-of-type(1)", "l5"),
    ("li:nth-last-of-type(odd)", "l1 l3 l5"),
    ("li:last-of-type", "l5"),
    ("span:only-of-type", "s1"),
    (":checked", "o1 i3"),
    (":disabled", "f i2 e i4"),
    (":enabled", "i1 o1 o2 i3 a1 b{k}"),
    (":link", "a1"),
    ("span:empty", "s1"),
    ("p:not([title=a], .red)", "p3"),
    ("div > p + p", "p2 p3"),
    ("p ~ p[title]", "p2 p3"),
    ("#p\\32", "p2"),
    ("ul li:nth-child(-n+3)", "l3"),
    ("h2, span", "s1 p1"),
]


def _selected(part: slice):
    def f(spark, sf_dir):
        nodes = _parsed(spark, sf_dir, [_FORM], "node_id subtree_end parent_el_id node_type tag attrs el_idx el_count is_empty".split()).nodes
        for i, (selector, _) in enumerate(_SELECTORS[part], part.start + 1):
            nodes = with_match(nodes, selector, f"m{i}")
        ids = F.struct("node_id", attr("id").alias("id"))
        found = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"m{i}"), ids))), lambda x: x["id"]), " ").alias(f"m{i}") for i in range(part.start + 1, part.stop + 1)]
        return _numbered(nodes.groupBy("doc_id").agg(*found), *(f"m{i}" for i in range(part.start + 1, part.stop + 1)))

    return f


for _part in (slice(0, 9), slice(9, 18), slice(18, len(_SELECTORS))):
    _add(
        f"selectors_{_part.start + 1}_to_{_part.stop}",
        _selected(_part),
        _stated([f"m{i}" for i in range(_part.start + 1, _part.stop + 1)], [tuple(x for _, x in _SELECTORS[_part])]),
        "Ids of the elements that match each selector, in order: " + "; ".join(x for x, _ in _SELECTORS[_part]),
    )


def _first_or_null(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, ["<!DOCTYPE html><p id=a{k}>x<p id=b>y", "<!DOCTYPE html><i>{k}</i>"]).nodes
    return _numbered(select_first(nodes, "p"), attr("id").alias("id"))


_add("select_first_or_null", _first_or_null, _stated(["id"], [("a{k}",), (None,)]), "The first match of a document, null where there is none.")

# ---- walks over trees

_WALK = "<!DOCTYPE html><body><div id=d><!--c{k}--><p>a{k}<b>t</b>u</p>v<i class='x y'></i></div>"
_OUTLINE = """#document
    <!DOCTYPE html>
    <html>
        <head>
        <body>
            <div id="d">
                <!-- c{k} -->
                <p>
                    "a{k}"
                    <b>
                        "t"
                    "u"
                "v"
                <i class="x y">"""


def _walks(spark, sf_dir):
    """One row a kind of walk from the div, as a list of tags and texts; all in the row of the page, which is parsed once."""
    first = {tag: F.get(elements_of("nodes", tag), 0).alias(tag) for tag in ("div", "p", "b", "i")}
    rows = _parsed(spark, sf_dir, [_WALK]).rows.select("doc_id", "nodes", *first.values())
    div, p, b, i = map(F.col, first)
    below = children_of("nodes", div)
    walks = {
        "children": below,
        "child elements": F.filter(below, lambda n: n["node_type"] == "element"),
        "child at 2": F.filter(below, lambda n: n["child_idx"] == 2),
        "child at 9": F.filter(below, lambda n: n["child_idx"] == 9),
        "parent": F.array(parent_of("nodes", div)),
        "tree": subtree_of("nodes", div),
        "reversed tree": subtree_of("nodes", div, reverse=True),
    }
    copied = mutate.copy_of(i)
    # what is walked to, and whether there is a row for it
    found = {name: (F.array_join(F.transform(nodes, lambda n: F.coalesce(n["tag"], n["data"])), " "), F.size(nodes) > 0) for name, nodes in walks.items()} | {
        "index of i": (index_in(div, i).cast("string"), div.isNotNull()),
        "index of b": (index_in(div, b).cast("string"), div.isNotNull()),
        "texts of p": (F.array_join(texts_of("nodes", p), " "), p.isNotNull()),
        "class y": (F.array_join(F.transform(F.filter("nodes", lambda n: class_in(n, "y") & ~class_in(n, "z")), lambda n: n["tag"]), " "), i.isNotNull()),
        "copy of i": (F.concat(copied["node_type"], F.lit(" "), copied["tag"], F.lit(" "), F.get(copied["attrs"], 0)["value"]), i.isNotNull()),
        "outline": (outline_of("nodes"), F.lit(True)),
    }
    every = F.array(*(F.struct(F.lit(name).alias("walk"), nodes.alias("nodes"), row.alias("row")) for name, (nodes, row) in found.items()))
    return rows.select("doc_id", F.inline(every)).where("row").select(F.expr("doc_id div 1000").alias("page_id"), "walk", "nodes")


_WALKED = [
    ("children", "c{k} p v i"),
    ("child elements", "p i"),
    ("child at 2", "v"),
    ("parent", "body"),
    ("tree", "div c{k} p a{k} b t u v i"),
    ("reversed tree", "div i v p u b t a{k} c{k}"),
    ("index of i", "3"),
    ("index of b", None),
    ("texts of p", "a{k} u"),
    ("class y", "i"),
    ("copy of i", "element i x y"),
    ("outline", _OUTLINE),
]
_add("walks", _walks, f"SELECT page_id, walk, nodes FROM ({_stated(['walk', 'nodes'], _WALKED)})", "Children, parents, indexes, walks in both directions, texts, copies and outlines.")

# ---- edits

_EDITED = "<!DOCTYPE html><body><div id=d{k}>s<p class='a b'>x</p><b>y</b></div>"
_NEW, _TEXT, _NOTE = mutate.element("u", {"n": "1"}), mutate.text("new"), mutate.comment("note")
#: op, on what, at, what else, and the markup that comes of it
_EDITS: list[tuple[str, str, int | None, dict | None, str]] = [
    ("append", "p", None, _NEW, '<div id="d{k}">s<p class="a b">x<u n="1"></u></p><b>y</b></div>'),
    ("append", "div", None, _NOTE, '<div id="d{k}">s<p class="a b">x</p><b>y</b><!--note--></div>'),
    ("insert", "div", 1, _NEW, '<div id="d{k}">s<u n="1"></u><p class="a b">x</p><b>y</b></div>'),
    ("insert", "div", 0, _TEXT, '<div id="d{k}">news<p class="a b">x</p><b>y</b></div>'),
    ("replace", "p", None, _NEW, '<div id="d{k}">s<u n="1"></u><b>y</b></div>'),
    ("remove", "p", None, None, '<div id="d{k}">s<b>y</b></div>'),
    ("remove_at", "div", 0, None, '<div id="d{k}"><p class="a b">x</p><b>y</b></div>'),
    ("remove_children", "div", None, None, '<div id="d{k}"></div>'),
    ("set_text", "div", None, _TEXT, '<div id="d{k}">new</div>'),
    ("set_text", "p", None, mutate.text(""), '<div id="d{k}">s<p class="a b"></p><b>y</b></div>'),
    ("insert_text", "div", 1, _TEXT, '<div id="d{k}">snew<p class="a b">x</p><b>y</b></div>'),
    ("insert_text", "div", 3, _TEXT, '<div id="d{k}">s<p class="a b">x</p><b>y</b>new</div>'),
    ("wrap", "b", None, _NEW, '<div id="d{k}">s<p class="a b">x</p><u n="1"><b>y</b></u></div>'),
    ("move", "p", None, None, '<div id="d{k}">s<b>y<p class="a b">x</p></b></div>'),
]
_DOCUMENT_EDITS = [
    ("set_doctype", "document", None, mutate.doctype("x"), '<!DOCTYPE x><html><head></head><body><div id="d{k}">s<p class="a b">x</p><b>y</b></div></body></html>'),
    ("set_doctype", "document", None, None, '<html><head></head><body><div id="d{k}">s<p class="a b">x</p><b>y</b></div></body></html>'),
    ("set_root", "document", None, _NEW, '<!DOCTYPE html><u n="1"></u>'),
    ("set_root", "document", None, None, "<!DOCTYPE html>"),
]
_ALL_EDITS = [*((*e[:4], _BODY[1] + e[4] + _BODY[2]) for e in _EDITS), *_DOCUMENT_EDITS]


def _edits(spark, sf_dir):
    """All kinds of edits of trees, a document each, in one pass."""
    # ids of this one template: document 0, doctype 1, html 2, head 3, body 4, div 5, text 6, p 7, text 8, b 9
    ids = {"document": 0, "div": 5, "p": 7, "b": 9}
    own = F.array(*(F.array(F.struct(*mutate.edit(op, ids[on], at, F.lit(9) if op == "move" else None, spec))) for op, on, at, spec, _ in _ALL_EDITS))
    pages = _made(spark, sf_dir, [_EDITED] * len(_ALL_EDITS)).withColumn("edits", F.get(own, F.col("n").cast("int") - 1))
    return _numbered(mutate.edit_pages(pages, fields=["node_id"]).docs, "html")


_add("markup_edits", _edits, _stated(["html"], [(x,) for *_, x in _ALL_EDITS]), "Appending, inserting, replacing, removing, moving, wrapping, texts, roots and document types.")


def _attribute_edits(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, ["<!DOCTYPE html><body><p class=' a  b ' x=1 y={k}>", "<!DOCTYPE html><body><p>{k}"]).nodes
    p = F.col("tag") == "p"
    nodes = mutate.toggle_class(mutate.toggle_class(nodes, "c{k}", p), "a", p)
    nodes = mutate.remove_attr(mutate.set_attr(mutate.set_attr(nodes, "z", "n", p), "x", "2", p), "y", p)
    return _numbered(mutate.serialize(nodes), "html")


_add(
    "attribute_edits",
    _attribute_edits,
    f"SELECT page_id, n, replace(html, '[', '{{') AS html FROM ({_stated(['html'], [(_BODY[1] + '<p class=\"b c[k}\" x=\"2\" z=\"n\"></p>' + _BODY[2],), (_BODY[1] + '<p class=\"c[k} a\" z=\"n\" x=\"2\">{k}</p>' + _BODY[2],)])})",
    "Classes toggled on and off, attributes set, set again in their place, and removed.",
)

# ---- strings and bytes

_REFERENCES = [
    ("&#65;{k}&#x42;&#X43;", "A{k}BC"),
    ("&#65{k}z", None),
    ("&copy{k}&notit;&notin;", "©{k}¬it;∉"),
    ("&#128;&#0;&#xD800;&#x110000;&#99999999999999999999999;{k}", "€����{k}"),
    ("&CounterClockwiseContourIntegral;{k}&bogus;&", "&CounterClockwiseContourIntegral;{k}&bogus;&"),
    ("&CounterClockwiseContourIntegral;{k}&bogus;& x", "∳{k}&bogus;& x"),
    ("&amp;lt;{k}&lt;&AMP;&Amp;", "&lt;{k}<&&Amp;"),
    ("no{k}", "no{k}"),
]
_REFERENCES = [r for r in _REFERENCES if r[1] is not None]


def _unescaped(spark, sf_dir):
    return _numbered(_made(spark, sf_dir, [t for t, _ in _REFERENCES]), html_unescape("html").alias("text"))


_add("unescape_references", _unescaped, _stated(["text"], [(x,) for _, x in _REFERENCES]), "Numeric, named, legacy and unknown references; a text that ends in an ampersand stays as it is.")

#: lead in hexadecimal, charset of the rest, Content-Type; encoding, confidence and text
_BYTES: list[tuple[str, str, str | None, str, str, str]] = [
    ("EFBBBF", "UTF-8", None, "UTF-8", "certain", "é{k}"),
    ("FEFF", "UTF-16BE", None, "UTF-16BE", "certain", "é{k}"),
    ("FFFE", "UTF-16LE", None, "UTF-16LE", "certain", "é{k}"),
    ("EFBBBF", "UTF-8", "text/html; charset=koi8-r", "UTF-8", "certain", "é{k}"),
    ("", "UTF-8", "text/html; charset=utf-8", "UTF-8", "certain", "é{k}"),
    ("", "ISO-8859-1", 'text/html; charset="iso-8859-1"', "windows-1252", "certain", "é{k}"),
    ("", "ISO-8859-1", None, "windows-1252", "tentative", "é{k}"),
    ("90", "ISO-8859-1", None, "windows-1252", "tentative", "�é{k}"),
    ("", "UTF-8", "text/html; charset=utf-8; x=1", "windows-1252", "tentative", "Ã©{k}"),
]


def _decoded(spark, sf_dir):
    text = F.concat(F.lit("é"), F.col("page_id").cast("string"))
    cases = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.concat(F.unhex(F.lit(lead)), F.encode(text, charset)).alias("body"), F.lit(kind).cast("string").alias("kind")) for n, (lead, charset, kind, *_) in enumerate(_BYTES, 1)))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(cases).alias("c"))
    pages = pages.select((F.col("page_id") * 1000 + F.col("c.n")).alias("doc_id"), "c.body", "c.kind")
    return _numbered(parse_html_bytes(pages, "body", "kind").docs, "encoding", "encoding_confidence", "text")


_add("decoded_bytes", _decoded, _stated(["encoding", "encoding_confidence", "text"], [tuple(x[3:]) for x in _BYTES]), "Byte order marks, headers of several forms, and bytes that Windows-1252 lacks.")
