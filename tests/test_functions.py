import pytest
from pyspark.sql import functions as F

from domquarry.functions import encodings
from domquarry.functions.entities import html_escape, html_unescape, register, unescape

NBSP = chr(0xA0)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("&amp;&lt;&copy", "&<©"),
        ("&#65;&#x42;&#X43;&#68", "ABCD"),
        ("&#65A;", "AA;"),
        ("&nosuch; &", "&nosuch; &"),
        ("&amp; &", "&amp; &"),
        ("& x &amp;", "& x &"),
        ("&notit;", "¬it;"),
        ("&#128;", "€"),
        ("& #65 ;", "A"),
        ("", ""),
        (None, None),
        ("&amp;lt;", "&lt;"),
    ],
)
def test_unescape(text, expected):
    assert unescape(text) == expected


def test_columns(spark):
    texts = ["&", NBSP, "<b>", '"', "", None, "a&b<c", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", html_escape("t").alias("e"), html_unescape(html_escape("t")).alias("u"), "t").orderBy("i").collect()
    assert [r["e"] for r in rows] == ["&amp;", "&nbsp;", "&lt;b&gt;", "&quot;", "", None, "a&amp;b&lt;c", "plain"]
    assert [r["u"] for r in rows] == texts
    register(spark)
    assert spark.sql("SELECT html_escape('<') AS a, html_unescape('&lt;') AS b").first() == ("&lt;", "<")


def test_escaping_needs_no_python(spark):
    plan = spark.range(1).select(html_escape(F.lit("a"))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_labels(spark):
    assert len(encodings.LABELS) == 219 and len(set(encodings.LABELS.values())) == 40
    for label, name in ((" UTF8\n", "UTF-8"), ("latin1", "windows-1252"), ("x-user-defined", "windows-1252"), ("iso-2022-kr", None), ("nosuch", None), (None, None)):
        assert encodings.encoding_of(label) == name
        assert spark.createDataFrame([(label,)], "l string").select(encodings.encoding_for_label("l")).first()[0] == name
    for name in set(encodings.LABELS.values()) - {"replacement"}:
        assert encodings.decode(b"", name) == ""


@pytest.mark.parametrize(
    ("body", "content_type", "encoding", "confidence"),
    [
        (b"", None, "windows-1252", "tentative"),
        (b"abc", "text/html; charset=iso-8859-1", "windows-1252", "certain"),
        (b"abc", "text/html; charset=utf-8", "UTF-8", "certain"),
        (b"abc", 'text/html; charset="utf-8"; x=1', "UTF-8", "certain"),
        (b"abc", "text/html; charset=utf-8; x=1", "windows-1252", "tentative"),
        (b"\xef\xbb\xbfabc", None, "UTF-8", "certain"),
        (b"\xef\xbb\xbf\xf5", None, "windows-1252", "tentative"),
        (b"\xfe\xff\x00a", None, "UTF-16BE", "certain"),
        (b"\xff\xfea\x00", None, "UTF-16LE", "certain"),
        (b"\x90\x00", "charset=utf-8", "windows-1252", "tentative"),
    ],
)
def test_sniffing(body, content_type, encoding, confidence):
    assert encodings.sniff_decode(body, content_type)[1:] == (encoding, confidence)


def test_lossy():
    assert encodings.sniff_decode(b"\x90a", None)[0] == "�a"


@pytest.mark.parametrize(
    ("attrs", "expected"),
    [
        ({"charset": "utf8"}, "UTF-8"),
        ({"charset": ""}, None),
        ({"http-equiv": "Content-Type", "content": "text/html; charset=koi8-r"}, "KOI8-R"),
        ({"http-equiv": "content-type", "content": "charset charset = 'big5' x"}, "Big5"),
        ({"http-equiv": "refresh", "content": "charset=utf-8"}, None),
        ({"http-equiv": "content-type", "content": "charset='big5"}, None),
        ({}, None),
    ],
)
def test_meta(attrs, expected):
    assert encodings.of_meta(attrs) == expected


def test_numbers_of_any_length():
    """Beyond what an int is read from; the job must not die of one page."""
    from domquarry.functions.entities import unescape
    from domquarry.operators.treebuilder import parse_document

    many = "9" * 5000
    assert unescape(f"&#{many};x&#x{'f' * 5000};y&#{'0' * 5000}65;&#-5;") == "�x�yA�"
    p = parse_document(f"<p title='&#{many};'>&#x{many};&#{'0' * 5000}65;")
    body = p.document.children[0].children[1].children[0]
    assert body.attrs["title"] == "�" and body.children[0].data == "�A"
