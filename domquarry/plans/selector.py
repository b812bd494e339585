"""The selector language: text to a small tree of tuples.

Predicates: ("any",) ("tag", name) ("attr", op, name, value) ("nth", a, b, last) ("nth_type", a, b, last, pred) ("only_child",)
("only_type", pred) ("empty",) ("root",) ("never",) ("and", [...]) ("or", [...]) ("not", pred) and, for what stands to the left,
("descendant", pred) ("child", pred) ("next", pred) ("later", pred).

The grammar is the small one of this engine, with its own ways: a blank before a comma is a descendant combinator, a trailing combinator
means ``*``, parentheses don't nest, ``-of-type`` counts siblings that match everything before it, ``[a='']`` matches nothing.

With ``strict`` it follows the CSS standard in these points: parentheses nest, blanks around commas mean nothing, combinators need both
sides, ``an+b`` has its bounds (("nth_strict", a, b, last)), ``-of-type`` counts siblings of the element's own type (("own_type", a, b, last)).
"""

from __future__ import annotations

import re
from functools import lru_cache

BLANK = " \t\n\r\f"
_HEX = re.compile(r"[0-9A-Fa-f]{1,6}")
_SIMPLE = {
    "first-child": ("nth", 0, 1, False), "last-child": ("nth", 0, 1, True), "only-child": ("only_child",), "empty": ("empty",), "root": ("root",),
    **dict.fromkeys(("visited", "active", "hover", "focus"), ("never",)),
}


class SelectorError(ValueError):
    """reason, position (from 0, in code points) and the selector's text."""

    def __init__(self, reason: str, position: int, text: str):
        super().__init__(f"{reason} at {position}\n{text}\n{' ' * position}^")
        self.reason, self.position, self.text = reason, position, text


def parse_nth(text: str) -> tuple[int, int] | None:
    """``odd``, ``even``, ``an+b`` or ``b`` as (a, b); None if it is none of them or nothing."""
    text = text.strip()
    if text.lower() in ("odd", "even"):
        return 2, int(text.lower() == "odd")
    if re.search(r"[^0-9 nN+\-]", text):
        return None
    parts = re.split("[nN]", text)
    if len(parts) > 2:
        return None
    if len(parts) == 1:
        b = _number(parts[0], 1)
        return (0, b) if b else None
    b = _number(parts[1], 0)
    a = -1 if parts[0] == "-" else _number(parts[0], 1)
    return None if a is None or b is None or (a, b) == (0, 0) else (a, b)


def _number(text: str, default: int) -> int | None:
    """A sign and digits, with blanks between them; the default for nothing."""
    text = text.strip()
    if not text:
        return default
    m = re.fullmatch(r"([+-]?) *([0-9]+)", text)
    return int(m[1] + m[2]) if m else None


def has_attr(name: str) -> tuple:
    return ("attr", "", name, None)


def tags(*names: str) -> tuple:
    return ("or", [("tag", n) for n in names])


LINK = ("and", [tags("a", "area", "link"), has_attr("href")])
CHECKED = ("or", [has_attr("checked"), has_attr("selected")])
_OFF = has_attr("disabled")
_OFF_FIELDSET = ("and", [("tag", "fieldset"), _OFF])
_SHELTER = ("and", [("nth_type", 0, 1, False, ("tag", "legend")), ("descendant", _OFF_FIELDSET)])
DISABLED = (
    "or",
    [
        ("and", [tags("optgroup", "fieldset", "menuitem"), _OFF]),
        ("and", [tags("button", "input", "select", "textarea"), ("or", [_OFF, ("and", [("descendant", _OFF_FIELDSET), ("not", ("descendant", _SHELTER))])])]),
        ("and", [("tag", "option"), ("or", [_OFF, ("descendant", ("and", [("tag", "optgroup"), _OFF]))])]),
    ],
)
ENABLED = ("or", [LINK, ("and", [tags("button", "input", "select", "textarea", "optgroup", "option", "menuitem", "fieldset"), ("not", DISABLED)])])


def _both(a: tuple, b: tuple) -> tuple:
    """``and`` in order, flat."""
    left = a[1] if a[0] == "and" else [a]
    return ("and", [*left, b])


class _Parser:
    def __init__(self, text: str, strict: bool = False):
        self.text, self.at, self.strict = text, 0, strict

    def fail(self, reason: str, back: int = 0):
        raise SelectorError(reason, self.at - back, self.text)

    def more(self) -> bool:
        return self.at < len(self.text)

    def run(self, signs: str) -> str:
        start = self.at
        while self.more() and self.text[self.at] in signs:
            self.at += 1
        return self.text[start : self.at]

    def upto(self, signs: str) -> str:
        start = self.at
        while self.more() and self.text[self.at] not in signs:
            self.at += 1
        return self.text[start : self.at]

    def group(self) -> tuple:
        if not self.text or self.text[0] == ",":
            self.fail("empty selector")
        found = []
        while True:
            pred = self.sequence(None)
            while self.more() and self.text[self.at] != ",":
                pred = self.sequence(pred)
            found.append(pred)
            if not self.more():
                return found[0] if len(found) == 1 else ("or", found)
            self.at += 1
            self.run(BLANK)
            if not self.more():
                self.fail("empty selector in a group")

    def sequence(self, left: tuple | None) -> tuple:
        """A compound and the combinator after it, which makes it what stands to the left of the next."""
        name = self.identifier()
        if name is None and self.more() and self.text[self.at] == "*":
            self.at += 1
        pred = ("any",) if name is None else ("tag", name.lower())
        if left is not None:
            pred = _both(pred, left)
        while self.more():
            sign = self.run(".:#[")
            if not sign:
                break
            if sign == ":":
                pred = _both(pred, self.pseudo(pred))
            elif sign == "[":
                pred = _both(pred, self.attribute())
            elif sign == "." or sign == "#":
                value = self.identifier()
                pred = _both(pred, ("never",) if value is None else ("attr", "~" if sign == "." else "=", "class" if sign == "." else "id", value))
            else:
                self.fail("pseudo-elements are not supported" if sign == "::" else "unexpected sign", len(sign))
        if not self.more():
            return pred
        sign = self.run(">+~" + BLANK)
        if self.strict and (not self.more() or self.text[self.at] == ","):
            if sign.strip():
                self.fail("combinator without its right side", len(sign))
            return pred
        if not sign:
            if self.text[self.at] == ",":
                return pred
            self.fail("expected a combinator")
        kind = {"": "descendant", ">": "child", "+": "next", "~": "later"}.get(sign.strip())
        if kind is None:
            self.fail("unexpected combinator", len(sign))
        return (kind, pred)

    def identifier(self) -> str | None:
        parts = []
        while True:
            start = self.at
            while self.more() and (self.text[self.at] in "-_" or self.text[self.at].isalnum()):
                self.at += 1
            if self.at == start:
                break
            parts.append(self.text[start : self.at])
            escape = self.escape()
            if escape is None:
                break
            parts.append(escape)
        return "".join(parts).strip() or None

    def escape(self) -> str | None:
        if not self.more() or self.text[self.at] != "\\":
            return None
        self.at += 1
        digits = _HEX.match(self.text, self.at)
        if digits:
            self.at = digits.end()
            if self.text.startswith("\r\n", self.at):
                self.at += 2
            elif self.more() and self.text[self.at] in BLANK:
                self.at += 1
            code = int(digits.group(), 16)
            return "�" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)
        if not self.more():
            return "�"
        if self.text[self.at] in "\n\r\f":
            self.fail("escaped line end")
        self.at += 1
        return self.text[self.at - 1]

    def inside(self) -> str:
        """Up to the first closing parenthesis."""
        if not self.more() or self.text[self.at] != "(":
            self.fail("expected an opening parenthesis")
        self.at += 1
        if self.strict:
            depth, start = 1, self.at
            while self.more() and depth:
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
            inner = self.text[start : self.at - 1] if depth == 0 else ""
            self.at -= 1
        else:
            inner = self.upto(")")
        if not inner:
            self.fail("expected something in the parentheses")
        self.at += 1
        return inner

    def pseudo(self, before: tuple) -> tuple:
        name = (self.identifier() or "").lower()
        if name in _SIMPLE and not (self.strict and name in ("first-child", "last-child")):
            return _SIMPLE[name]
        if name in ("link", "enabled", "disabled", "checked"):
            return {"link": LINK, "enabled": ENABLED, "disabled": DISABLED, "checked": CHECKED}[name]
        if self.strict and name in ("first-child", "last-child"):
            return ("nth_strict", 0, 1, name == "last-child")
        if self.strict and name in ("first-of-type", "last-of-type"):
            return ("own_type", 0, 1, name == "last-of-type")
        if self.strict and name == "only-of-type":
            return ("and", [("own_type", 0, 1, False), ("own_type", 0, 1, True)])
        if name in ("first-of-type", "last-of-type"):
            return ("nth_type", 0, 1, name == "last-of-type", before)
        if name == "only-of-type":
            return ("only_type", before)
        if name == "not":
            return ("not", parse_selector(self.inside(), self.strict))
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            nth = parse_nth(self.inside())
            if nth is None:
                self.fail("no valid nth expression")
            last = "last" in name
            if self.strict:
                return ("own_type" if name.endswith("type") else "nth_strict", *nth, last)
            return ("nth_type", *nth, last, before) if name.endswith("type") else ("nth", *nth, last)
        self.fail("unknown pseudo-class")
        raise AssertionError

    def attribute(self) -> tuple:
        name = self.identifier()
        op = self.upto("=]")
        value: str | None = None
        exact = self.more() and self.text[self.at] == "="
        if exact:
            self.at += 1
            op = op.strip() or "="
            self.run(BLANK)
            value = self.identifier()
            if value is None:
                self.run(BLANK)
                quote = self.text[self.at : self.at + 1]
                if not quote or quote not in "\"'":
                    self.fail("expected a quote")
                self.at += 1
                value = self.upto(quote) or None
                self.at += 1
        else:
            op = ""
        self.upto("]")
        if not self.more():
            self.fail("expected a closing bracket")
        self.at += 1
        if op not in ("", "=", "~", "^", "$", "*", "|"):
            self.fail("unexpected operator", len(op))
        if name is None:
            return ("never",)
        if exact and value is None:
            if op in "^$*":
                self.fail("empty value")
            return ("never",)
        return ("attr", op, name, value)


@lru_cache(maxsize=1024)
def parse_selector(text: str, strict: bool = False) -> tuple:
    """The selector's predicate tree. SelectorError if the text is none; ValueError without a text."""
    if text is None:
        raise ValueError("a selector is needed")
    return _Parser(text.strip(), strict).group()


class Selector:
    """A parsed selector, to be used many times."""

    def __init__(self, text: str, strict_css: bool = False):
        self.text, self.tree = text, parse_selector(text, strict_css)

    @staticmethod
    def of(selector: Selector | str) -> Selector:
        return selector if isinstance(selector, Selector) else Selector(selector)
