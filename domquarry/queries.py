"""Queries over the test tables, by name, and SQL that gives the same rows where a regular expression can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.encodings import LABELS, encoding_for_label, encoding_of
from .functions.entities import html_escape, html_unescape
from .operators import mutate
from .operators.parse import Parsed, attr, parse_fragment, parse_html, parse_html_bytes, select_html, tokenize_html
from .operators.select import elements_of, outline_of, select_all, select_first, subtree_of, texts_of, with_match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What a selector's columns need of nodes; fewer columns leave the parse task.
_CORE = "node_id subtree_end parent_el_id node_type tag attrs el_idx el_count is_empty".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def _parsed(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> Parsed:
    return parse_html(_pages(spark, sf_dir), id_col="page_id", **({"fields": fields} if fields else {}))


def _nodes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _parsed(spark, sf_dir, [*_CORE, *more]).nodes


def _counted(selector: str, sql: str) -> Callable:
    """Matches per page, by the compiled selector."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_match(_nodes(spark, sf_dir), selector, "m")
        return found.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.col("m").cast("long")).alias("n"))

    f.__doc__ = f"Elements a page that match {selector}."
    return f


def counts(name: str, selector: str, sql: str | None) -> None:
    QUERIES[name] = _counted(selector, sql)
    if sql:
        ORACLE_SQL[name] = f"SELECT page_id, CAST({sql} AS BIGINT) AS n FROM pages"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


#: Text as it is written again: only ampersands, no-break spaces and angle brackets are references.
_RETEXT = "replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
_UNESCAPE = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _texts(spark: SparkSession, sf_dir: str, selector: str, name: str) -> DataFrame:
    """The text of the matches, found and cut out inside the parse task."""
    found = select_html(_pages(spark, sf_dir), selector, id_col="page_id")
    return found.select(F.col("doc_id").alias("page_id"), F.col("text").alias(name))


def _extracted(pattern: str, name: str) -> str:
    return f"SELECT page_id, {_UNESCAPE.format(f'''regexp_extract(html, '{pattern}', 1)''')} AS {name} FROM pages"


@query(_extracted("<title>([^<]*)</title>", "title"))
def page_title(spark, sf_dir):
    return _texts(spark, sf_dir, "title", "title")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def html_lang(spark, sf_dir):
    return select_all(_nodes(spark, sf_dir), "html[lang]").select(F.col("doc_id").alias("page_id"), attr("lang").alias("lang"))


@query("SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def meta_charset(spark, sf_dir):
    return select_all(_nodes(spark, sf_dir), "head > meta[charset]").select(F.col("doc_id").alias("page_id"), attr("charset").alias("charset"))


_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
unnest(range(1, len(regexp_extract_all(html, '<a href="')) + 1)) AS pos, len(regexp_extract_all(html, '<a href="')) AS n FROM pages"""


@query(f"SELECT page_id, CAST(pos AS BIGINT) AS pos, href, {_UNESCAPE.format('text')} AS text FROM ({_LINKS})")
def nav_links(spark, sf_dir):
    """The flagship: links of the navigation in order, by a compiled descendant selector over nodes."""
    parsed = _parsed(spark, sf_dir, [*_CORE, "text_start", "text_end"])
    # the text comes along in the row of its page, so one parse serves both
    nodes = parsed.rows.select("doc_id", F.col("doc.text").alias("_text"), F.inline("nodes"))
    nodes = mutate.with_lookups(nodes).withColumn("link_text", F.when(F.col("tag") == "a", F.expr("substring(_text, text_start + 1, text_end - text_start)"))).drop("_text")
    found = select_all(nodes, "nav a[href]")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")).cast("long")
    return found.select(F.col("doc_id").alias("page_id"), pos.alias("pos"), attr("href").alias("href"), F.col("link_text").alias("text"))


def _links(selector: str):
    def f(spark, sf_dir):
        return select_all(_nodes(spark, sf_dir), selector).select(F.col("doc_id").alias("page_id"), attr("href").alias("href"))

    return f


for _name, _selector, _test in (
    ("first_link", "li:first-child a", "pos = 1"),
    ("last_link", "li:last-child a", "pos = n"),
    ("odd_links", "li:nth-child(odd) > a", "pos % 2 = 1"),
    ("nth_last_links", "li:nth-last-child(2) > a", "pos = n - 1"),
    ("quirky_nth_links", "li:nth-child(2n+5) > a", "pos % 2 = 1"),
    ("sibling_links", "li + li a", "pos > 1"),
    ("later_links", "li ~ li > a", "pos > 1"),
    ("prefix_links", "a[href^='/a']", "starts_with(href, '/a')"),
    ("suffix_links", "a[href$='.']", "ends_with(href, '.')"),
    ("substring_links", "a[href*=on]", "contains(href, 'on')"),
):
    QUERIES[_name] = _links(_selector)
    ORACLE_SQL[_name] = f"SELECT page_id, href FROM ({_LINKS}) WHERE {_test}"

counts("li_count", "li", _n("<li>"))
counts("p_count", "p", _n("<p>"))
counts("br_count", "br:empty", _n("<br>"))
counts("link_pseudo", ":link", _n("<a href="))
counts("not_first", "li:not(:first-child)", "greatest(" + _n("<li>") + " - 1, 0)")
counts("union_group", "h1, title", "2")
counts("root_elements", ":root", "1")
counts("ul_children", "nav > ul > li", _n("<li>"))
counts("universal_in_nav", "nav *", f"1 + {_n('<li>')} + {_n('<a href=')}")
counts("class_and_type", "div.ad:only-of-type", "1")
counts("only_children", "li > a:only-child", _n("<li>"))
counts("first_of_type", "article p:first-of-type", "CASE WHEN contains(html, '<p>') THEN 1 ELSE 0 END")
counts("dash_match", "html[lang|=en]", "CASE WHEN contains(html, '<html lang=\"en\">') THEN 1 ELSE 0 END")
counts("never_matching", "a:visited, p:hover", "0")
counts("enabled_links", "a:enabled", _n("<a href="))
counts("disabled_controls", ":disabled", "0")
#: Paragraphs of the article: an unclosed b is opened again in each later paragraph and in the footer, three times at most.
_PARAGRAPHS = """WITH a AS (SELECT page_id, html, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS parts FROM pages),
u AS (SELECT page_id, unnest(range(1, len(parts))) AS i, unnest(parts[2:]) AS part FROM a),
p AS (SELECT *, CASE WHEN starts_with(part, '<b>') THEN 1 ELSE 0 END AS own FROM u),
c AS (SELECT *, CAST(least(3, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS again FROM p),
t AS (SELECT page_id, sum(own) AS b, sum(own + again) AS opened, sum(greatest(own + again - 1, 0)) AS nested, sum(CASE WHEN own + again > 0 AND ends_with(part, '</p>') THEN 1 ELSE 0 END) AS closed,
      sum(CASE WHEN own + again > 0 AND NOT ends_with(part, '</p>') THEN 1 ELSE 0 END) AS unclosed, bool_and(ends_with(part, '</p>') OR i < n) AS ended FROM c JOIN (SELECT page_id AS id, max(i) AS n FROM c GROUP BY page_id) ON id = page_id GROUP BY page_id),
s AS (SELECT page_id, html, parts, coalesce(b, 0) AS b, coalesce(opened, 0) + least(3, coalesce(b, 0)) AS opened, coalesce(nested, 0) + greatest(least(3, coalesce(b, 0)) - 1, 0) AS nested,
      coalesce(closed, 0) + coalesce(unclosed, 0) - CASE WHEN coalesce(ended, true) OR b = 0 THEN 0 ELSE 1 END AS closings, CASE WHEN coalesce(ended, true) OR b = 0 THEN 0 ELSE 1 END + CASE WHEN coalesce(b, 0) > 0 THEN 1 ELSE 0 END AS ends FROM a LEFT JOIN t USING (page_id))
"""
counts("b_count", "b", None)
counts("b_nested", "b b", None)
ORACLE_SQL["b_count"] = f"{_PARAGRAPHS} SELECT page_id, CAST(opened AS BIGINT) AS n FROM s"
ORACLE_SQL["b_nested"] = f"{_PARAGRAPHS} SELECT page_id, CAST(nested AS BIGINT) AS n FROM s"


@query(_extracted('<div class="ad">([^<]*)</div>', "text"))
def ad_text(spark, sf_dir):
    return _texts(spark, sf_dir, ".ad", "text")


@query(_extracted('<div class="ad">([^<]*)</div>', "text"))
def nav_next(spark, sf_dir):
    """By compiled selector, with texts cut out of the documents' text by offsets."""
    nodes = _parsed(spark, sf_dir, [*_CORE, "text_start", "text_end"]).nodes_with("text", "text", F.col("tag") == "div")
    return select_all(nodes, "nav + div").select(F.col("doc_id").alias("page_id"), "text")


@query(_extracted("<footer>([^<]*)</footer>", "text"))
def article_footer(spark, sf_dir):
    return _texts(spark, sf_dir, "article ~ footer", "text")


@query(f"""SELECT page_id, {_UNESCAPE.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')")} AS text FROM pages""")
def article_text(spark, sf_dir):
    return _texts(spark, sf_dir, "article", "text")


@query(_extracted("<h1>([^<]*)</h1>", "text"))
def first_heading(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, [*_CORE, "text_start", "text_end"]).nodes_with("text", "text", F.col("tag") == "h1")
    return select_first(nodes, "h1").select(F.col("doc_id").alias("page_id"), "text")


@query("SELECT page_id, regexp_extract(html, '<!--(.*?)-->', 1) AS data FROM pages")
def comments(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, ["node_id", "node_type", "tag", "attrs", "data"]).nodes
    return nodes.where("node_type = 'comment'").select(F.col("doc_id").alias("page_id"), "data")


@query("SELECT page_id, regexp_extract(html, '(?s)<nav>(.*)</nav>', 1) AS inner_html FROM pages")
def nav_inner_html(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, [*_CORE, "inner_start", "inner_end"]).nodes_with("inner_html", "inner", F.col("tag") == "nav")
    return select_all(nodes, "nav").select(F.col("doc_id").alias("page_id"), "inner_html")


@query("SELECT page_id, regexp_extract(html, '(?s)(<nav>.*</nav>)', 1) AS outer_html FROM pages")
def nav_outer_html(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, [*_CORE, "html_start", "html_end"]).nodes_with("outer_html", "outer", F.col("tag") == "nav")
    return select_all(nodes, "nav").select(F.col("doc_id").alias("page_id"), "outer_html")


@query(f"""{_PARAGRAPHS} SELECT page_id, '<article>' || {_RETEXT.format('parts[1]')} || coalesce(markup, '') || '</article>' AS html FROM s LEFT JOIN (
SELECT page_id, string_agg('<p>' || repeat('<b>', again) || {_RETEXT.format("regexp_replace(part, '</p>$', '')")} || repeat('</b>', again + own) || '</p>', '' ORDER BY i) AS markup FROM c GROUP BY page_id) USING (page_id)""")
def serialize_article(spark, sf_dir):
    found = select_html(_pages(spark, sf_dir), "article", id_col="page_id", first=True)
    return found.select(F.col("doc_id").alias("page_id"), "html")


@query(f"""{_PARAGRAPHS} SELECT message, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages FROM (
SELECT page_id, 'closing a p that is not current' AS message, closings AS n FROM s UNION ALL SELECT page_id, 'end tag of an element that is not current', ends FROM s) WHERE n > 0 GROUP BY message""")
def parse_errors(spark, sf_dir):
    e = _parsed(spark, sf_dir, ["node_id"]).errors
    return e.groupBy("message").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("pages"))


@query("SELECT page_id, 'no' AS quirks_mode, 'html' AS doctype_name, 'UTF-8' AS encoding, 'certain' AS encoding_confidence FROM pages")
def page_modes(spark, sf_dir):
    return _parsed(spark, sf_dir, ["node_id"]).docs.select(F.col("doc_id").alias("page_id"), "quirks_mode", "doctype_name", "encoding", "encoding_confidence")


@query(f"""{_PARAGRAPHS} SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) WHERE tag <> 'b' GROUP BY tag
UNION ALL SELECT 'b', CAST(sum(opened) AS BIGINT) FROM s HAVING sum(opened) > 0""")
def tag_histogram(spark, sf_dir):
    nodes = _parsed(spark, sf_dir, ["node_type", "tag"]).rows.select(F.inline("nodes"))
    return nodes.where("node_type = 'element'").groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY name")
def start_tokens(spark, sf_dir):
    """Start tags of the token stream; styles and scripts hold none."""
    return tokenize_html(_pages(spark, sf_dir), id_col="page_id", fields=["kind", "name"]).where("kind = 'start'").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'UTF-8' AS encoding, 'certain' AS encoding_confidence, " + _UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + " AS title FROM pages")
def bytes_with_meta(spark, sf_dir):
    """Bytes without a header: read as Windows-1252, then once more as the meta element says."""
    pages = _pages(spark, sf_dir).withColumn("body", F.encode("html", "UTF-8"))
    parsed = parse_html_bytes(pages, "body", id_col="page_id")
    rows = parsed.rows.select("doc_id", "doc.encoding", "doc.encoding_confidence", F.col("doc.text").alias("_t"), F.expr("filter(nodes, n -> n.tag = 'title' AND n.node_type = 'element')[0]").alias("n"))
    return rows.select(F.col("doc_id").alias("page_id"), "encoding", "encoding_confidence", F.expr("substring(_t, n.text_start + 1, n.text_end - n.text_start)").alias("title"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_li, 'irrelevant' AS confidence FROM pages")
def fragments(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<ul>(.*)</ul>", 1).alias("html"))
    parsed = parse_fragment(pages, context="ul", id_col="page_id")
    n = F.expr("size(filter(nodes, n -> n.tag = 'li' AND n.node_type = 'element' AND n.parent_id = 0))").cast("long")
    return parsed.rows.select(F.col("doc_id").alias("page_id"), n.alias("n_li"), F.col("doc.encoding_confidence").alias("confidence"))


@query("SELECT page_id, 0 AS n_ads, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_li FROM pages")
def remove_ads(spark, sf_dir):
    """A change to trees: elements go in the parse task, before the rest is numbered."""
    fields = ["node_type", "tag", "attrs"]
    left = mutate.edit_html(_pages(spark, sf_dir), ".ad", "remove", id_col="page_id", fields=fields).nodes
    return left.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.sum(F.coalesce(F.array_contains("classes", "ad").cast("int"), F.lit(0))).cast("int").alias("n_ads"), F.sum(F.coalesce((F.col("tag_lc") == "li").cast("long"), F.lit(0))).alias("n_li")
    )


@query("""SELECT page_id, replace(regexp_extract(html, '(?s)(<nav>.*</nav>)', 1), '<a href="', '<a rel="nofollow" href="') AS markup FROM pages""")
def relabelled_links(spark, sf_dir):
    """Attributes set and set again, and markup folded from the changed rows."""
    nodes = _parsed(spark, sf_dir).nodes
    out = mutate.set_attr(nodes, "_href", F.col("attr")["href"], F.col("tag_lc") == "a")
    out = mutate.set_attr(mutate.remove_attr(out, "href"), "rel", "nofollow", F.col("tag_lc") == "a")
    out = mutate.remove_attr(mutate.set_attr(out, "href", F.col("attr")["_href"], F.col("tag_lc") == "a"), "_href")
    html = mutate.serialize(out)
    return html.select(F.col("doc_id").alias("page_id"), F.regexp_extract("html", "(?s)(<nav>.*</nav>)", 1).alias("markup"))


@query("""WITH l AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
SELECT page_id, CAST(14 + 3 * (i - 1) + j AS INTEGER) AS node_id, CAST(3 * (n - i) + j AS INTEGER) AS position, CASE j WHEN 0 THEN 'li' WHEN 1 THEN 'a' END AS tag
FROM (SELECT page_id, n, unnest(range(1, n + 1)) AS i FROM l), (VALUES (0), (1), (2)) v(j)""")
def reverse_walk(spark, sf_dir):
    rows = _parsed(spark, sf_dir, ["node_id", "subtree_end", "node_type", "tag", "rev_id"]).rows

    def walk(ul):
        return F.transform(subtree_of("nodes", ul, include_self=False, reverse=True), lambda n, i: F.struct(n["node_id"].alias("node_id"), i.alias("position"), n["tag"].alias("tag")))

    return rows.select(F.col("doc_id").alias("page_id"), F.inline(F.flatten(F.transform(elements_of("nodes", "ul"), walk))))


@query("SELECT page_id, 'ul' AS tag FROM pages WHERE contains(html, '<li>')")
def parents_of_items(spark, sf_dir):
    rows = _parsed(spark, sf_dir, ["node_id", "parent_el_id", "node_type", "tag"]).rows
    above = F.filter(F.array_distinct(F.transform(elements_of("nodes", "li"), lambda li: li["parent_el_id"])), lambda i: i.isNotNull())
    return rows.select(F.col("doc_id").alias("page_id"), F.explode(F.transform(above, lambda i: F.get("nodes", i)["tag"])).alias("tag"))


@query(_extracted("<h1>([^<]*)</h1>", "part"))
def heading_components(spark, sf_dir):
    rows = _parsed(spark, sf_dir, ["node_id", "subtree_end", "parent_id", "node_type", "tag", "data"]).rows
    return rows.select(F.col("doc_id").alias("page_id"), F.explode(F.flatten(F.transform(elements_of("nodes", "h1"), lambda h: texts_of("nodes", h)))).alias("part"))


@query()
def outlines(spark, sf_dir):
    return _parsed(spark, sf_dir, ["depth", "node_type", "tag", "attrs", "data"]).rows.select(F.col("doc_id").alias("page_id"), outline_of("nodes").alias("outline"))


_ESCAPED = "text"
for _a, _b in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
    _ESCAPED = f"replace({_ESCAPED}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents")
def escape_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", html_escape("text").alias("escaped"))


@query("SELECT doc_id, text FROM documents")
def unescape_documents(spark, sf_dir):
    """Unescaping undoes escaping (but for texts that end in an ampersand, of which there are none)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", html_unescape(html_escape("text")).alias("text"))


@query(f"SELECT conv_id, turn, {_ESCAPED} AS escaped FROM conversations")
def escape_conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", html_escape("text").alias("escaped"))


_SOME_LABELS = [*sorted(LABELS), "nonsense", " UTF8 ", "Latin1"]
_VALUES = ", ".join(f"""('{x}', {"NULL" if encoding_of(x) is None else "'" + encoding_of(x) + "'"})""" for x in _SOME_LABELS)


@query(f"SELECT label, CAST(encoding AS VARCHAR) AS encoding FROM (VALUES {_VALUES}) t(label, encoding)")
def encoding_labels(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in _SOME_LABELS], "label string")
    return labels.select("label", encoding_for_label("label").alias("encoding"))
