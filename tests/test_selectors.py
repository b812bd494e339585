import pytest

from domquarry.operators.parse import parse_html, preorder
from domquarry.operators.select import select_all, select_first, with_match
from domquarry.operators.treebuilder import parse_document
from domquarry.plans.matcher import Matcher
from domquarry.plans.selector import Selector, SelectorError, parse_nth, parse_selector

BANG = chr(0x203D)
PAGE = f"""<root id=root><parent id=empty class="big snoopy dog"></parent><arbitrary id=devoid class=big lang=up-dog> </arbitrary>
<parent id=one-child><elem id=only-child></elem></parent><parent id=three-children><elem id=child1></elem><other id=child2></other><elem id=child3></elem></parent>
<input id=root-enabled><input id=root-disabled disabled><fieldset id=fieldset-disabled disabled><input id=in-fieldset>
<legend><input id=in-legend></legend><legend><input id=in-second-legend></legend></fieldset>
<a id=a-enabled href></a><a id=a-neither name></a>
<ahoy{BANG} id=interrobang><there id=there></there><x:colon id=colon></x:colon><tag{chr(0xFFFD)} id=fffd></tag{chr(0xFFFD)}></ahoy{BANG}></root>"""
CASES = [
    ("parent", "empty one-child three-children"),
    ("parent *", "only-child child1 child2 child3"),
    ("PARENT > elem", "only-child child1 child3"),
    ("elem:first-of-type", "only-child child1"),
    ("elem:last-of-type", "only-child child3"),
    ("elem:only-of-type", "only-child"),
    ("parent:first-child", "empty"),
    ("elem:only-child", "only-child"),
    ("elem+other", "child2"),
    ("elem~elem", "child3"),
    ("arbitrary~a", "a-enabled a-neither"),
    (".big:not(arbitrary)", "empty"),
    (".snoopy.dog", "empty"),
    ("#child1, #child3", "child1 child3"),
    ("elem:not(elem#only-child, #child3)", "child1"),
    (":link", "a-enabled"),
    (":disabled", "root-disabled fieldset-disabled in-fieldset in-second-legend"),
    (":enabled", "root-enabled in-legend a-enabled"),
    ("[lang |= 'up']", "devoid"),
    ("[id ^= child]", "child1 child2 child3"),
    ("[id $= '-child']", "one-child only-child"),
    ("[id*=-chi]", "one-child three-children only-child"),
    ("[class~=snoopy]", "empty"),
    ("[disabled]", "root-disabled fieldset-disabled"),
    ("[name='']", ""),
    ("root, there", "root there"),
    ("ahoy\\203d  there", "there"),
    ("ahoy\\203d there", ""),
    ("parent:empty", "empty"),
    ("a:checked, a:hover", ""),
    ("three-children >", ""),
    ("parent >", "only-child child1 child2 child3"),
    ("parent:nth-child(2n+9)", "empty one-child"),
    ("parent > :nth-child(odd)", "only-child child1 child3"),
    ("parent > :nth-child(-n+3)", "child3"),
    ("parent > :nth-last-child(1)", "only-child child3"),
    ("parent > elem:nth-of-type(2)", "child3"),
    ("parent > elem:nth-last-of-type(2)", "child1"),
    ("root > parent ~ parent + input", "root-enabled"),
    ("parent , a", "only-child child1 child2 child3 a-enabled a-neither"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return parse_html(spark.createDataFrame([(1, PAGE)], "doc_id long, html string")).cached().nodes


@pytest.mark.parametrize(("selector", "expected"), CASES)
def test_matcher(selector, expected):
    match = Matcher(selector)
    found = [n.attrs.get("id") for n in preorder(parse_document(PAGE).document) if n.kind == "element" and match.matches(n)]
    assert sorted(x for x in found if x) == sorted(expected.split())


@pytest.mark.parametrize(("selector", "expected"), CASES)
def test_compiled(nodes, selector, expected):
    found = [r[0] for r in select_all(nodes, selector).selectExpr("attr['id']").collect()]
    assert sorted(x for x in found if x) == sorted(expected.split())


STRICT = [
    ("parent , a", "empty one-child three-children a-enabled a-neither"),
    ("parent > :nth-child(-n+2)", "only-child child1 child2"),
    ("root > :nth-child(2n+9)", "a-neither"),
    ("elem:not(:nth-child(1))", "child3"),
    (".big:first-of-type", "empty devoid"),
    ("parent.big:last-of-type", ""),
    ("parent:nth-of-type(2)", "one-child"),
    ("parent:nth-last-of-type(1)", "three-children"),
    ("other:only-of-type", "child2"),
    ("parent:first-child", "empty"),
]


@pytest.mark.parametrize(("selector", "expected"), STRICT)
def test_strict(nodes, selector, expected):
    s = Selector(selector, strict_css=True)
    found = [r[0] for r in select_all(nodes, s).selectExpr("attr['id']").collect()]
    assert sorted(x for x in found if x) == sorted(expected.split())
    match = Matcher(s)
    assert sorted(n.attrs["id"] for n in preorder(parse_document(PAGE).document) if n.kind == "element" and "id" in n.attrs and match.matches(n)) == sorted(expected.split())


def test_strict_root_and_errors(nodes):
    assert select_all(nodes, Selector("html:last-child:first-of-type", strict_css=True)).count() == 1
    for text in ("a >", "a > , b", ":not((a)"):
        with pytest.raises(SelectorError):
            Selector(text, strict_css=True)


def test_root_has_no_place_among_siblings(nodes):
    for selector, n in ((":root", 1), ("html:first-child", 1), ("html:last-child", 0), ("html:nth-last-child(even)", 1), ("html:first-of-type", 0), ("html ~ *", 0)):
        assert select_all(nodes, selector).count() == n, selector
        match = Matcher(selector)
        assert sum(match.matches(x) for x in preorder(parse_document(PAGE).document) if x.kind == "element") == n


def test_first_and_flags(nodes):
    assert select_first(nodes, "parent").selectExpr("attr['id']").collect()[0][0] == "empty"
    assert [r["node_id"] for r in select_first(nodes, "nosuch").collect()] == [None]  # a document without a match
    assert with_match(nodes, "parent").where("matches").count() == 3
    within = select_all(nodes, "#three-children")
    assert select_all(nodes, "elem", within).count() == 2
    assert select_all(nodes, "parent", within).count() == 1  # itself is searched too


@pytest.mark.parametrize(
    "text", ["[id]asdf", "h2..foo", "", ",", ",uh", "buh,", ",,", ":not(,)", "a\\\nb", "a::before", "a > > b", ":nosuch", ":nth-child(x)", ":nth-child(2 - 2n)", ":not(:nth-child(2))", "[a!=b]", "[a", "[a^='']", "[a=+]", "a | b"]
)
def test_errors(text):
    with pytest.raises(SelectorError) as e:
        parse_selector(text)
    assert 0 <= e.value.position <= len(text)


def test_no_text():
    with pytest.raises(ValueError):
        parse_selector(None)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("odd", (2, 1)), ("even", (2, 0)), ("-2", (0, -2)), ("n", (1, 0)), ("-n", (-1, 0)), ("2n - 3", (2, -3)), (" - 3", (0, -3)), ("2n", (2, 0)), ("n + 1", (1, 1)), ("", (0, 1))]
    + [(x, None) for x in ("2 - 2n", "2n + 3b", "+n", "- n", "b", "nn", "0", "0n+0")],
)
def test_nth(text, expected):
    assert parse_nth(text) == expected


@pytest.mark.parametrize("selector", ["li:nth-child(2)", "li:last-of-type", "li ~ li", "li + li", "ul li", "li:only-of-type", "li:nth-last-of-type(odd)"])
def test_matching_takes_steps_in_proportion(selector):
    """Siblings are walked once, not once for each of them."""
    import sys

    from domquarry.operators.parse import preorder
    from domquarry.operators.treebuilder import parse_document
    from domquarry.plans.matcher import Matcher

    def steps(n):
        nodes = [x for x in preorder(parse_document("<ul>" + "<li>a" * n).document) if x.kind == "element"]
        match, count = Matcher(selector), 0

        def tick(frame, event, arg):
            nonlocal count
            count += 1
            return tick

        before = sys.gettrace()
        sys.settrace(tick)
        try:
            for x in nodes:
                match.matches(x)
        finally:
            sys.settrace(before)
        return count

    assert steps(800) < 2.2 * steps(400)


def test_misplaced_content_takes_time_in_proportion():
    import time

    from domquarry.operators.treebuilder import parse_document

    def seconds(n):
        start = time.perf_counter()
        parse_document("<table>" + "<i>x</i>" * n)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16000) < 12 * min(seconds(4000) for _ in range(3))
