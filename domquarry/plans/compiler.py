"""Selectors as Catalyst plans over the ``nodes`` table.

A compound is a column predicate. What stands to the left becomes a window: an ancestor matches A if the running maximum of
``subtree_end`` over earlier A rows reaches the row (subtrees never overlap in part); siblings are running maxima or lags of a flag within
the parent; a parent's flag comes by a window over matching rows and their children. Windows of all steps share one exchange by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selector import Selector

_ORDER = {"nth": 1, "nth_type": 3, "only_type": 3, "own_type": 3, "nth_strict": 1, "descendant": 3, "child": 4, "next": 3, "later": 3, "not": 2, "or": 2, "and": 2}


def nth_matches(position, a: int, b: int):
    """Without a lower bound for a > 0; equality for a <= 0. For ints and Columns."""
    return (position - b) % a == 0 if a > 0 else position == b


def nth_matches_strictly(position, a: int, b: int):
    """As CSS has it: some n of 0 or more gives a * n + b. For ints and Columns."""
    return (position == b) if a == 0 else ((position - b) % a == 0) & ((position - b) * a >= 0)


def _attr(op: str, name: str, value: str | None) -> Column:
    if name == "class" and op == "~":
        return F.coalesce(F.array_contains("classes", value), F.lit(False))
    got = F.col("attr")[name]
    test = {
        "": lambda: got.isNotNull(),
        "=": lambda: got == value,
        "~": lambda: F.array_contains(F.split(got, "[ \\t\\n\\r\\f]"), value),
        "^": lambda: got.startswith(value),
        "$": lambda: got.endswith(value),
        "*": lambda: got.contains(value),
        "|": lambda: (got == value) | got.startswith(value + "-"),
    }[op]()
    return F.coalesce(test, F.lit(False))


class _Plan:
    def __init__(self, nodes: DataFrame):
        self.df, self.names, self.done = nodes, 0, {}

    def add(self, expression: Column) -> Column:
        name = f"_sel{self.names}"
        self.names += 1
        self.df = self.df.withColumn(name, expression)
        return F.col(name)

    def column(self, p: tuple) -> Column:
        key = repr(p)
        if key not in self.done:
            self.done[key] = self._column(p)
        return self.done[key]

    def _column(self, p: tuple) -> Column:
        kind = p[0]
        if kind == "any":
            return F.lit(True)
        if kind == "never":
            return F.lit(False)
        if kind == "tag":
            return F.col("tag_lc") == p[1]
        if kind == "attr":
            return _attr(*p[1:])
        if kind == "empty":
            return F.col("is_empty")
        if kind == "root":
            return F.col("parent_el_id").isNull()
        if kind == "only_child":
            return F.col("el_count") == 1
        if kind == "nth":
            position = F.col("el_count") - F.col("el_idx") + 1 if p[3] else F.col("el_idx")
            return nth_matches(F.when(F.col("parent_el_id").isNull() & F.lit(p[3]), F.lit(0)).otherwise(position), p[1], p[2])
        if kind == "nth_strict":
            position = F.greatest("el_count", F.lit(1)) - F.col("el_idx") + 1 if p[3] else F.col("el_idx")
            return nth_matches_strictly(position, p[1], p[2])
        if kind == "own_type":
            alike = Window.partitionBy("doc_id", "parent_el_id", "tag").orderBy(F.desc("node_id") if p[3] else F.asc("node_id"))
            count = self.add(F.row_number().over(alike))
            return nth_matches_strictly(F.when(F.col("parent_el_id").isNull(), 1).otherwise(count), p[1], p[2])
        if kind in ("and", "or"):
            # cheap tests first; windows and joins last
            parts = [self.column(x) for x in sorted(p[1], key=lambda x: _ORDER.get(x[0], 0))]
            out = parts[0]
            for x in parts[1:]:
                out = (out & x) if kind == "and" else (out | x)
            return out
        if kind == "not":
            return ~self.column(p[1])
        if kind in ("nth_type", "only_type"):
            flag = F.when(self.column(p[-1]), 1).otherwise(0)
            has_parent = F.col("parent_el_id").isNotNull()
            if kind == "only_type":
                both = [self.add(F.sum(flag).over(self._siblings(last).rowsBetween(Window.unboundedPreceding, 0))) for last in (False, True)]
                return has_parent & (both[0] == 1) & (both[1] == 1)
            count = self.add(F.sum(flag).over(self._siblings(p[3]).rowsBetween(Window.unboundedPreceding, 0)))
            return has_parent & nth_matches(count, p[1], p[2])
        left = self.column(p[1])
        if kind == "descendant":
            earlier = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
            return self.add(F.coalesce(F.max(F.when(left, F.col("subtree_end"))).over(earlier) >= F.col("node_id"), F.lit(False)))
        if kind == "next":
            return self.add(F.coalesce(F.col("parent_el_id").isNotNull() & F.lag(left).over(self._siblings(False)), F.lit(False)))
        if kind == "later":
            earlier = self._siblings(False).rowsBetween(Window.unboundedPreceding, -1)
            return self.add(F.coalesce(F.col("parent_el_id").isNotNull() & F.max(left).over(earlier), F.lit(False)))
        if kind == "child":
            # matching rows stand a second time under their own number, so parents and children meet in a window: the
            # exchange by doc_id serves it, and nodes (perhaps a parse) are not read twice as in a join
            name = f"_sel{self.names}"
            self.names += 1
            child = F.struct(F.col("parent_el_id").alias("k"), F.lit(False).alias("p"))
            both = F.array(F.struct(F.col("node_id").alias("k"), F.lit(True).alias("p")), child)
            rows = self.df.withColumn("_row", F.explode(F.when(left, both).otherwise(F.array(child))))
            family = Window.partitionBy("doc_id", "_row.k")
            flag = F.col("_row.k").isNotNull() & F.max(F.col("_row.p")).over(family)
            self.df = rows.withColumn(name, flag).where(~F.col("_row.p")).drop("_row")
            return F.col(name)
        raise ValueError(kind)

    @staticmethod
    def _siblings(last: bool) -> Window:
        return Window.partitionBy("doc_id", "parent_el_id").orderBy(F.desc("el_idx") if last else F.asc("el_idx"))


def _steps(p: tuple) -> list[str]:
    """The parts of a predicate that take windows."""
    own = [p[0]] if p[0] in ("nth_type", "only_type", "own_type", "descendant", "child", "next", "later") else []
    for x in p[1:]:
        for y in x if isinstance(x, list) else [x]:
            own += _steps(y) if isinstance(y, tuple) else []
    return own


def compile_selector(nodes: DataFrame, selector: Selector | str, name: str) -> DataFrame:
    """The element rows of ``nodes`` with a boolean column ``name``."""
    columns = [c for c in nodes.columns if c != name]
    elements, tree = nodes.where(F.col("node_type") == "element").select(*columns), Selector.of(selector).tree
    steps = _steps(tree)
    if len(steps) > 1 and set(steps) != {"descendant"}:
        # windows by finer keys would each ask for an exchange of their own; one by doc_id serves them all
        elements = elements.repartition("doc_id")
    plan = _Plan(elements)
    match = plan.column(tree)
    return plan.df.select(*columns, F.coalesce(match, F.lit(False)).alias(name))
