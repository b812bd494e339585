import pytest

from domquarry.operators.tokenizer import Tokenizer


def tokens(text, state="data", last=None):
    out = []
    for t in Tokenizer(text, state, last):
        if t[0] == "error":
            continue
        if t[0] == "chars" and out and out[-1][0] == "chars":
            out[-1] = ("chars", out[-1][1] + t[1])
        else:
            out.append(t)
    return out


def errors(text, state="data", last=None):
    return sum(t[0] == "error" for t in Tokenizer(text, state, last))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a&amp;b", [("chars", "a&b")]),
        ("<A HREF='x'>", [("start", "a", {"href": "x"}, False)]),
        ("<a b c=d e = 'f' g=\"h\"/>", [("start", "a", {"b": "", "c": "d", "e": "f", "g": "h"}, True)]),
        ("<a x=1 X=2>", [("start", "a", {"x": "1"}, False)]),
        ("</A b>", [("end", "a", {"b": ""}, False)]),
        ("</>", []),
        ("< a", [("chars", "< a")]),
        ("<", [("chars", "<")]),
        ("</", [("chars", "</")]),
        ("</1>", [("comment", "1")]),
        ("<?x?>", [("comment", "?x?")]),
        ("<!x>", [("comment", "x")]),
        ("<a", []),
        ("<a b='", []),
        ("<a =x>", [("start", "a", {"=x": ""}, False)]),
        ("<a b=>", [("start", "a", {"b": ""}, False)]),
        ("<a/b>", [("start", "a", {"b": ""}, False)]),
        ("<a b='c'd>", [("start", "a", {"b": "c", "d": ""}, False)]),
        ("<a b=\0>", [("start", "a", {"b": "�"}, False)]),
        ("<!--x-->", [("comment", "x")]),
        ("<!-->x", [("comment", ""), ("chars", "x")]),
        ("<!--->x", [("comment", ""), ("chars", "x")]),
        ("<!--a--!>x", [("comment", "a"), ("chars", "x")]),
        ("<!--a--b-->", [("comment", "a--b")]),
        ("<!--a--->", [("comment", "a-")]),
        ("<!--a--", [("comment", "a")]),
        ("<!--a-", [("comment", "a")]),
        ("<!DOCTYPE html>", [("doctype", "html", None, None, False)]),
        ("<!doctype HTML PUBLIC 'p' \"s\">", [("doctype", "html", "p", "s", False)]),
        ("<!DOCTYPE html SYSTEM 's' x>", [("doctype", "html", None, "s", False)]),
        ("<!DOCTYPE html PUBLIC>", [("doctype", "html", None, None, True)]),
        ("<!DOCTYPE html PUBLIC 'p>", [("doctype", "html", "p", None, True)]),
        ("<!DOCTYPE html x>", [("doctype", "html", None, None, True)]),
        ("<!DOCTYPE>", [("doctype", None, None, None, True)]),
        ("<!DOCTYPE", [("doctype", None, None, None, True)]),
        ("a\r\nb\rc", [("chars", "a\nb\nc")]),
        ("a\0b", [("chars", "a\0b")]),
    ],
)
def test_data(text, expected):
    assert tokens(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("&#65;&#x42;&#X43", "ABC"),
        ("&#128;", "€"),
        ("&#0;&#xD800;&#x110000;", "���"),
        ("&copy &copy;", "© ©"),
        ("&notit; &notin;", "¬it; ∉"),
        ("& &; &# &#x &nosuch;", "& &; &# &#x &nosuch;"),
        ("&CounterClockwiseContourIntegral;", "∳"),
    ],
)
def test_references(text, expected):
    assert tokens(text) == [("chars", expected)]


def test_references_in_attributes():
    assert tokens("<a b='&copy=1&copyx&copy;&copy'>") == [("start", "a", {"b": "&copy=1&copyx©©"}, False)]


@pytest.mark.parametrize(
    ("state", "last", "text", "expected"),
    [
        ("rcdata", "title", "a&amp;<b></title>c", [("chars", "a&<b>"), ("end", "title", {}, False), ("chars", "c")]),
        ("rawtext", "style", "a&amp;</b></STYLE >", [("chars", "a&amp;</b>"), ("end", "style", {}, False)]),
        ("rawtext", "style", "a</stylex></style", [("chars", "a</stylex></style")]),
        ("plaintext", None, "a</plaintext>&amp;", [("chars", "a</plaintext>&amp;")]),
        ("script", "script", "<!--<script></script>--></script>", [("chars", "<!--<script></script>-->"), ("end", "script", {}, False)]),
        ("script", "script", "<!--</script>", [("chars", "<!--"), ("end", "script", {}, False)]),
        ("script", "script", "<!--><script></script>x", [("chars", "<!--><script>"), ("end", "script", {}, False), ("chars", "x")]),
        ("script", "script", "a</script/>", [("chars", "a"), ("end", "script", {}, True)]),
    ],
)
def test_other_states(state, last, text, expected):
    assert tokens(text, state, last) == expected


@pytest.mark.parametrize(("text", "n"), [("a", 0), ("&amp", 1), ("\x01", 1), ("<a x x>", 1), ("<!DOCTYPE html>", 0), ("<a", 1), ("</a b/>", 2), ("a\0", 1)])
def test_number_of_errors(text, n):
    assert errors(text) == n
