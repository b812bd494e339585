"""Selectors evaluated on parsed trees inside the parse task, for queries that need no table of nodes."""

from __future__ import annotations

import re
from itertools import accumulate

from .compiler import nth_matches, nth_matches_strictly
from .selector import Selector

_BLANK = re.compile(r"[ \t\n\r\f]")


def _parent(node):
    p = node.parent
    return p if p is not None and p.kind == "element" else None


class Matcher:
    """Remembers, for one document, what each part of the selector gave for each node, and counts along siblings: time is linear in nodes."""

    def __init__(self, selector: Selector | str):
        self.tree = Selector.of(selector).tree
        self.known: dict[tuple[int, int], bool] = {}
        self.above: dict[tuple[int, int], bool] = {}
        self.places: dict[int, tuple[list, dict[int, int]]] = {}
        self.counts: dict[tuple[int, int], list[int]] = {}
        self.types: dict[int, tuple[dict[int, int], dict[str, int]]] = {}

    def _siblings(self, node) -> tuple[list, int]:
        """The element children of a node's parent element, and the node's place among them."""
        parent = _parent(node)
        if parent is None:
            return [], 0
        if id(parent) not in self.places:
            own = [x for x in parent.children if x.kind == "element"]
            self.places[id(parent)] = own, {id(x): i for i, x in enumerate(own)}
        own, at = self.places[id(parent)]
        return own, at[id(node)]

    def _upto(self, p: tuple, own: list, parent) -> list[int]:
        """How many of the first 0, 1, 2 ... siblings match."""
        key = (id(p), id(parent))
        if key not in self.counts:
            self.counts[key] = [0, *accumulate(self.test(p, x) for x in own)]
        return self.counts[key]

    def _of_type(self, own: list, parent, node) -> tuple[int, int]:
        """A node's place among the siblings of its tag, and their number."""
        if parent is None:
            return 0, 1
        if id(parent) not in self.types:
            seen: dict[str, int] = {}
            places = {}
            for x in own:
                places[id(x)] = seen.get(x.tag, 0)
                seen[x.tag] = places[id(x)] + 1
            self.types[id(parent)] = places, seen
        places, seen = self.types[id(parent)]
        return places[id(node)], seen[node.tag]

    def _below(self, p: tuple, node) -> bool:
        """Whether an element above the node matches."""
        todo, up = [], node
        while (id(p), id(up)) not in self.above:
            todo.append(up)
            up = _parent(up)
            if up is None:
                break
        for x in reversed(todo):
            up = _parent(x)
            self.above[id(p), id(x)] = up is not None and (self.test(p, up) or self.above[id(p), id(up)])
        return self.above[id(p), id(node)]

    def matches(self, node) -> bool:
        return self.test(self.tree, node)

    def test(self, p: tuple, node) -> bool:
        key = (id(p), id(node))
        if key not in self.known:
            self.known[key] = self._test(p, node)
        return self.known[key]

    def _test(self, p: tuple, node) -> bool:
        kind = p[0]
        if kind == "any":
            return True
        if kind == "never":
            return False
        if kind == "tag":
            return node.tag.lower() == p[1]
        if kind == "attr":
            return self._attr(node.attrs.get(p[2]), p[1], p[3])
        if kind == "empty":
            return not any(x.kind == "element" or (x.kind == "text" and x.data) for x in node.children)
        if kind == "root":
            return _parent(node) is None
        if kind == "and":
            return all(self.test(x, node) for x in p[1])
        if kind == "or":
            return any(self.test(x, node) for x in p[1])
        if kind == "not":
            return not self.test(p[1], node)
        if kind == "descendant":
            return self._below(p[1], node)
        up = _parent(node)
        if kind == "child":
            return up is not None and self.test(p[1], up)
        own, at = self._siblings(node)
        if kind == "only_child":
            return len(own) == 1
        if kind == "nth":
            return nth_matches((len(own) - at if own else 0) if p[3] else at + 1, p[1], p[2])
        if kind == "nth_strict":
            return nth_matches_strictly(max(len(own), 1) - at if p[3] else at + 1, p[1], p[2])
        if kind == "own_type":
            place, alike = self._of_type(own, up, node)
            return nth_matches_strictly(alike - place if p[3] else place + 1, p[1], p[2])
        if not own:
            return False
        if kind == "next":
            return at > 0 and self.test(p[1], own[at - 1])
        if kind == "later":
            return self._upto(p[1], own, up)[at] > 0
        upto = self._upto(p[-1], own, up)
        first, last = upto[at + 1], upto[-1] - upto[at]
        if kind == "only_type":
            return first == 1 and last == 1
        return nth_matches(last if p[3] else first, p[1], p[2])

    @staticmethod
    def _attr(got: str | None, op: str, value: str | None) -> bool:
        if got is None:
            return False
        if op == "":
            return True
        if op == "~":
            return value in _BLANK.split(got)
        if op == "|":
            return got == value or got.startswith(value + "-")
        return {"=": got.__eq__, "^": got.startswith, "$": got.endswith, "*": got.__contains__}[op](value)
