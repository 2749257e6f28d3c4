"""Plain parts of queries as Spark SQL text, for which one call into the JVM does instead of one for each node.

Only nodes whose Spark meaning is the dialect's are written as text: doubles in arithmetic, comparisons of like kinds, AND and OR,
aggregates, CASE. For everything else the answer is None, and the compiler builds Columns by the rules of ``functions``.
"""

from __future__ import annotations

import math

from tessera.functions import predicates as P

from .tree import Bin, Call, Case, Lit, Neg, Not, Star, Test

_PLAIN = ("=", "<", "<=", ">", ">=")
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def literal(value, double: bool = False) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}.0D" if double else str(value) if abs(value) < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else None
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if value.isprintable() else None
    return None


class Texts:
    """Mixed into the compiler, whose ``kind`` it asks."""

    def text(self, node, scope) -> str | None:
        """A value as text."""
        ref = scope.known.get(node, node)
        if hasattr(ref, "outer"):  # a column
            return None if ref.outer or (ref is node and scope.known) else ref.name
        if isinstance(node, Lit):
            return None if node.kind else literal(node.value)
        if isinstance(node, (Neg, Bin)) and not (isinstance(node, Bin) and node.op not in "+-*/"):
            return self._double_text(node, scope)
        if isinstance(node, Case):
            return self._case_text(node, scope)
        if isinstance(node, Call) and node.name == "round" and len(node.args) == 2 and isinstance(node.args[1], Lit) and type(node.args[1].value) is int:
            inner = self._double_text(node.args[0], scope)
            return f"round({inner}, {node.args[1].value})" if inner else None
        return None

    def _double_text(self, node, scope) -> str | None:
        if isinstance(node, Lit):
            return literal(node.value, True) if type(node.value) in (int, float) else None
        if isinstance(node, Neg) and node not in scope.known:
            inner = self._double_text(node.value, scope)
            return f"(- {inner})" if inner else None
        if isinstance(node, Bin) and node.op in "+-*/" and node not in scope.known:
            if node.op == "/" and not (isinstance(node.right, Lit) and node.right.value):
                return None
            a, b = self._double_text(node.left, scope), self._double_text(node.right, scope)
            return f"({a} {node.op} {b})" if a and b else None
        inner = self.text(node, scope)
        if inner is None or self.kind(node, scope) != "num":
            return None
        ref = scope.known.get(node, node)
        return inner if getattr(ref, "double", False) or (isinstance(node, Call) and node.name == "round") else f"cast({inner} AS double)"

    def _case_text(self, node: Case, scope) -> str | None:
        if node.subject is not None:
            return None
        results = [w[1] for w in node.whens] + ([node.otherwise] if node.otherwise is not None else [])
        if len({self.kind(r, scope) for r in results} - {"null"}) != 1:
            return None
        tests, values = [self.condition_text(w[0], scope, False) for w in node.whens], [self.text(r, scope) for r in results]
        if None in tests or None in values:
            return None
        whens = " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values, strict=False))
        return f"(CASE {whens}{f' ELSE {values[-1]}' if node.otherwise is not None else ''} END)"

    def aggregate_text(self, node: Call, scope) -> str | None:
        if len(node.args) != 1:
            return None
        arg = node.args[0]
        if isinstance(arg, Star):
            return "count(1)" if node.name == "count" and not node.distinct else None
        inner = self._double_text(arg, scope) if node.name in ("sum", "avg") else self.text(arg, scope)
        if inner is None or (isinstance(arg, Lit) and node.name != "count") or (node.distinct and node.name != "count"):
            return None
        return f"{node.name}({'DISTINCT ' if node.distinct else ''}{inner})"

    def condition_text(self, node, scope, two: bool) -> str | None:
        if node in scope.known:
            return None
        if isinstance(node, Bin) and node.op in ("and", "or"):
            a, b = self.condition_text(node.left, scope, two), self.condition_text(node.right, scope, two)
            return f"({a} {node.op.upper()} {b})" if a and b else None
        if isinstance(node, Not):
            inner = self.condition_text(node.value, scope, two)
            return None if inner is None else f"coalesce(NOT {inner}, true)" if two else f"(NOT {inner})"
        if isinstance(node, Test):
            return self._test_text(node, scope)
        if isinstance(node, Bin) and node.op in (*_PLAIN, "<>"):
            return self._compare_text(node.op, node.left, node.right, scope, two)
        return None

    def _test_text(self, node: Test, scope) -> str | None:
        v, kind = self.text(node.value, scope), self.kind(node.value, scope)
        if v is None:
            return None
        if node.op == "null":
            return f"({v} IS NULL)"
        given = [literal(a.value) for a in node.args if isinstance(a, Lit) and not a.kind and ((kind == "num" and type(a.value) in (int, float)) or (kind == "str" and isinstance(a.value, str) and hasattr(node.value, "outer")))]
        if len(given) != len(node.args) or None in given:
            return None
        if node.op == "in":
            return f"({v} IN ({', '.join(given)}))"
        return f"({v} BETWEEN {given[0]} AND {given[1]})" if node.op == "between" and kind == "num" else None

    def _compare_text(self, op: str, left, right, scope, two: bool) -> str | None:
        if isinstance(left, Lit):
            if isinstance(right, Lit):
                return None
            op, left, right = _FLIPPED.get(op, op), right, left
        kind, other, column = self.kind(left, scope), self.kind(right, scope), hasattr(left, "outer")
        a = self.text(left, scope)
        if a is None:
            return None
        if kind == "time" and isinstance(right, Lit) and isinstance(right.value, str) and (not two or op != "<>"):
            value = right.value
            if op in ("<=", ">") and P.DATE_ONLY.fullmatch(value):
                op, value = ("<" if op == "<=" else ">="), P.next_day(value)
            b = literal(value)
            return f"({a} {op} cast({b} AS timestamp_ntz))" if b else None
        columns = column and hasattr(right, "outer")
        if not columns and not isinstance(right, Lit):
            return None
        if kind != other or kind not in ("num", "str", "time") or (kind == "str" and not column):
            return None
        b = self.text(right, scope)
        if b is None:
            return None
        return f"(NOT ({a} <=> {b}))" if op == "<>" and two else f"({a} {op} {b})"
