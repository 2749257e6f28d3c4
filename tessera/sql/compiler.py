"""Queries to DataFrames: names are bound to columns, then every node becomes a Column by the rules of ``functions``.

WHERE and HAVING take two-valued predicates (a negation is the complement over all rows); ON, CASE and IF take SQL's three values.
Subqueries are DataFrame subqueries (``exists``, ``scalar``), which Catalyst turns into semi, anti and outer joins: ``NOT IN``
is NOT EXISTS on equality, so NULLs on the right do not matter. Each source's columns get names of their own, so that
repeated aliases and self-joins need no care.

Joined sources that meet only in a common one (the customers and the suppliers of a nation) make a row for each pair of theirs. Where the
aggregates are the same however often a row is repeated, no pair is made: see ``Compiler.siblings``.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.operators.textsearch import match_against
from tessera.operators.topn import topn

from .text import Texts
from .tree import Bin, Call, Case, Cast, Col, Default, Derived, Exists, Item, Join, Lit, Match, Neg, Node, Not, Query, Row, Select, SqlError, Star, Sub, Table, Test, Var

AGGREGATES = frozenset(("count", "sum", "avg", "min", "max"))
_COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_NUMBERS = frozenset("byte short integer long float double decimal".split())

#: What functions return, where it is not text.
_NUMERIC = frozenset(
    """length char_length ascii locate instr isnull abs round floor ceil ceiling truncate mod pow power sign year yy mm monthofyear month yymm day
    dayofmonth quarter week dayofweek hourofday hour hourofweek seconds unixmillis unix_millis toint tonumber connection_id count sum avg""".split()
)
_TIMES = frozenset("now current_timestamp todate".split())
_OF_TIMES = frozenset("year yy mm monthofyear month yymm day dayofmonth dayname monthname quarter week dayofweek hourofday hour hourofweek seconds date date_format timediff unixmillis unix_millis".split())
_LIKE_ARGUMENTS = frozenset(("coalesce", "ifnull", "greatest", "least", "min", "max", "nullif"))
#: Arguments that must be literals, by place.
_LITERAL = {"date_format": (1,), "truncate": (1,), "timediff": (2,), "week": (1,), "trim": (1, 2)}


@dataclass(frozen=True)
class Ref(Node):
    """A column that has been found."""

    name: str  # quoted, with its source
    kind: str
    outer: bool = False
    double: bool = False


def kind_of(type_) -> str:
    name = type_.typeName()
    return "num" if name in _NUMBERS else {"string": "str", "boolean": "bool", "array": "set", "void": "null"}.get(name, "time" if name in ("date", "timestamp", "timestamp_ntz") else "other")


def _numeric(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(name: str) -> Column:
    return F.col(name)


@dataclass
class Source:
    alias: str
    columns: dict[str, tuple[str, Ref]]  # lower name -> (name, column)
    hidden: set[str] = field(default_factory=set)  # the right side's columns of USING
    rownum: Ref | None = None
    name: str = ""  # by which its columns are found
    rows: DataFrame | None = None  # of a table that may be read more than once


@dataclass
class Scope:
    sources: list[Source]
    parent: Scope | None = None
    aliases: dict[str, Node] = field(default_factory=dict)
    #: Nodes that are columns already: group keys and aggregates.
    known: dict[Node, Ref] = field(default_factory=dict)
    #: The conditions of inner joins and of WHERE, and whether each is two-valued; None where there are other joins.
    conditions: list[tuple[Node, bool]] | None = field(default_factory=list)

    def find(self, col: Col) -> Ref | None:
        found = []
        for s in self.sources:
            if col.table is not None and col.table.lower() != s.alias.lower():
                continue
            low = col.name.lower()
            if low in s.columns and (col.table is not None or low not in s.hidden):
                found.append(s.columns[low][1])
            elif low == "rownum" and s.rownum is not None:
                found.append(s.rownum)
        if len(found) > 1:
            raise SqlError(f"column {col.name} is ambiguous")
        return found[0] if found else None


def rebuilt(node, change):
    """The node with ``change`` applied to its direct parts; queries inside are left alone."""
    if isinstance(node, tuple):
        return tuple(rebuilt(x, change) if isinstance(x, tuple) else change(x) if isinstance(x, Node) else x for x in node)
    new = {}
    for f in dataclasses.fields(node):
        old = getattr(node, f.name)
        if isinstance(old, Query):
            continue
        if isinstance(old, Node):
            new[f.name] = change(old)
        elif isinstance(old, tuple):
            new[f.name] = rebuilt(old, change)
    return dataclasses.replace(node, **new) if new else node


def inside(node, wanted) -> list:
    """The outermost nodes inside ``node`` (itself included) for which ``wanted`` holds."""
    if wanted(node):
        return [node]
    out: list = []
    if not isinstance(node, (Ref, Lit)):
        rebuilt(node, lambda x: (out.extend(inside(x, wanted)), x)[1])
    return out


def _is_aggregate(node) -> bool:
    return isinstance(node, Call) and node.name in AGGREGATES


def _owners(*nodes) -> frozenset[str]:
    """The names of the sources whose columns are inside."""
    return frozenset(r.name.split(".", 1)[0] for n in nodes for r in inside(n, lambda x: isinstance(x, Ref)))


def _unsteady(node) -> bool:
    """Whether a value is not one of the row alone."""
    return bool(inside(node, lambda x: isinstance(x, (Sub, Exists, Star)) or (isinstance(x, Ref) and x.outer) or (isinstance(x, Call) and (x.name == "rownum" or _is_aggregate(x)))))


def _same_columns(node) -> bool:
    return isinstance(node, Bin) and node.op == "=" and isinstance(node.left, Ref) and isinstance(node.right, Ref)


def _conjuncts(node) -> list:
    return _conjuncts(node.left) + _conjuncts(node.right) if isinstance(node, Bin) and node.op == "and" else [node]


class Compiler(Texts):
    def __init__(self, engine):
        self.engine, self.sources = engine, 0

    # -- queries -----------------------------------------------------------------------------

    def query(self, q: Query, parent: Scope | None = None) -> tuple[DataFrame, list[str], list[str]]:
        """The rows, their column names and kinds."""
        if len(q.branches) == 1 and isinstance(q.branches[0], Select):
            return self.select(q.branches[0], q, parent)
        parts = [self.query(b, parent) if isinstance(b, Query) else self.select(b, None, parent) for b in q.branches]
        if len({len(names) for _, names, _ in parts}) > 1:
            raise SqlError("the branches of UNION ALL have different numbers of columns")
        names = parts[0][1]
        kinds = [next((k for k in ks if k != "null"), "null") for ks in zip(*(p[2] for p in parts), strict=True)]
        df = reduce(lambda a, b: a.union(b), (p[0] for p in parts))
        if q.order:
            low = {n.lower(): n for n in names}
            keys = []
            for k in q.order:
                name = names[k.value.value - 1] if isinstance(k.value, Lit) and isinstance(k.value.value, int) else low.get(getattr(k.value, "name", "").lower())
                if name is None:
                    raise SqlError("UNION ALL is ordered by its columns")
                keys.append(self._directed(_column(quoted(name)), k))
            df = df.orderBy(*keys)
        return self._limited(df, q), names, kinds

    @staticmethod
    def _limited(df: DataFrame, q: Query | None) -> DataFrame:
        if q is not None and q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q is not None and q.limit is not None else df

    @staticmethod
    def _directed(c: Column, key) -> Column:
        if key.descending:
            return c.desc_nulls_first() if key.nulls == "first" else c.desc_nulls_last()
        return c.asc_nulls_last() if key.nulls == "last" else c.asc_nulls_first()

    def select(self, sel: Select, q: Query | None, parent: Scope | None) -> tuple[DataFrame, list[str], list[str]]:
        order = q.order if q is not None else ()
        df, scope = self.start(sel, parent)
        items: list[Item] = []
        for item in sel.items:
            items += self._starred(item, scope) if isinstance(item, Star) else [item]
        scope.aliases = {i.alias.lower(): i.value for i in items if not (isinstance(i.value, Col) and i.value.name.lower() == i.alias.lower())}
        if sel.where is not None:
            df = self.filtered(df, sel.where, scope)
        bound = [self.bind(i.value, scope) for i in items]
        names = [i.alias for i in items]
        if any(isinstance(b, Call) and b.name == "topn" for b in bound):
            return self._topn(df, sel, bound, scope)

        keys = [dataclasses.replace(k, value=self._order_key(k.value, bound, names, scope)) for k in order]
        having = self.bind(sel.having, scope, aliases_first=True) if sel.having is not None else None
        every = [*bound, *(k.value for k in keys), *([having] if having is not None else [])]
        aggregates = list(dict.fromkeys(a for n in every for a in inside(n, _is_aggregate)))
        if sel.group or aggregates or having is not None:
            df, scope = self._grouped(df, sel.group, aggregates, bound, names, scope)
            if having is not None:
                df = df.where(self.condition(having, scope))
        kinds = [self.kind(b, scope) for b in bound]
        out = [self.value(b, scope).alias(n) for b, n in zip(bound, names, strict=True)]
        if sel.distinct:
            df = df.select(*(c.alias(f"out{i}") for i, c in enumerate(out))).distinct()
            if any(k.value not in bound for k in keys):
                raise SqlError("with DISTINCT the order is by selected columns")
            df = df.orderBy(*(self._directed(F.col(f"out{bound.index(k.value)}"), k) for k in keys)) if keys else df
            return self._limited(df, q).select(*(F.col(f"out{i}").alias(n) for i, n in enumerate(names))), names, kinds
        if not keys:
            return self._limited(df.select(*out), q), names, kinds
        hidden = [self.value(k.value, scope).alias(f"order{i}") for i, k in enumerate(keys)]
        df = df.select(*(c.alias(f"out{i}") for i, c in enumerate(out)), *hidden)
        df = self._limited(df.orderBy(*(self._directed(F.col(f"order{i}"), k) for i, k in enumerate(keys))), q)
        return df.select(*(F.col(f"out{i}").alias(n) for i, n in enumerate(names))), names, kinds

    def start(self, sel: Select, parent: Scope | None) -> tuple[DataFrame, Scope]:
        scope = Scope([], parent)
        if sel.source is None:
            return self.engine.spark.range(1).select(), scope
        return self.source(sel.source, scope), scope

    def _starred(self, star: Star, scope: Scope) -> list[Item]:
        out = []
        for s in scope.sources:
            if star.table is None or star.table.lower() == s.alias.lower():
                out += [Item(ref, name) for low, (name, ref) in s.columns.items() if star.table is not None or low not in s.hidden]
        if not out:
            raise SqlError(f"no columns for {star.table or ''}*")
        return out

    def _order_key(self, node: Node, bound: list[Node], names: list[str], scope: Scope) -> Node:
        if isinstance(node, Lit) and type(node.value) is int:
            return self._ordinal(node.value, bound)
        return self.bind(node, scope, aliases_first=True)

    @staticmethod
    def _ordinal(k: int, bound: list[Node]) -> Node:
        if not 1 <= k <= len(bound):
            raise SqlError(f"there is no column {k}")
        return bound[k - 1]

    def _grouped(self, df: DataFrame, group: tuple, aggregates: list, bound: list, names: list, scope: Scope) -> tuple[DataFrame, Scope]:
        keys = list(dict.fromkeys(self._ordinal(g.value, bound) if isinstance(g, Lit) and type(g.value) is int else self.bind(g, scope) for g in group))
        new = Scope([], scope.parent)
        columns = []
        for i, k in enumerate(keys):
            columns.append(self.value(k, scope).alias(f"key{i}"))
            new.known[k] = Ref(f"key{i}", self.kind(k, scope))
        made = []
        for i, a in enumerate(aggregates):
            made.append(self.aggregate(a, scope).alias(f"agg{i}"))
            new.known[a] = Ref(f"agg{i}", self.kind(a, scope), False, a.name in ("sum", "avg"))
        if (apart := self.siblings(keys, aggregates, scope)) is not None:
            df, columns, made = apart
        if not made:
            return df.select(*columns).distinct(), new
        # Without keys by select, which leaves a correlated subquery to the query around it.
        return (df.groupBy(*columns).agg(*made) if columns else df.select(*made)), new

    def siblings(self, keys: list[Node], aggregates: list[Call], scope: Scope) -> tuple[DataFrame, list[Column], list[Column]] | None:
        """Rows, keys and aggregates for which no two sources are paired that meet only in a centre; None where this does not apply.

        The centre has the sources of the keys, one more where that makes parts, and those that they find by primary key (the smallest
        such centre is taken); the conditions tie the others together into parts. For min, max and DISTINCT it does not matter how often
        a row is repeated: a part's values are those of the centre's rows that have a match in every other part, joined with this part
        alone. The rows of all parts are put below each other, with NULLs, which these aggregates pass over, for the values of the others.
        """
        args = [x for a in aggregates for x in a.args]
        if not (keys or aggregates) or scope.conditions is None or len(scope.sources) < 3 or any(s.rows is None for s in scope.sources) or any(map(_unsteady, (*keys, *args, *(c for c, _ in scope.conditions)))):
            return None
        if not all(a.name in ("min", "max") or (a.distinct and a.name in ("count", "sum")) for a in aggregates):
            return None
        named, every, tied = _owners(*keys), frozenset(s.name for s in scope.sources), [_owners(c) for c, _ in scope.conditions]
        starts = [x for x in (named, *(named | {s.name} for s in scope.sources)) if x]
        for centre in sorted((self._with_parents(x, scope) for x in starts), key=len):
            parts = self._parts(every - centre, tied)
            of = [[p for p in parts if p & _owners(*a.args)] for a in aggregates]
            whole = len(self._parts(centre, [o for o in tied if o <= centre])) == 1 and all(any(o & p and o & centre for o in tied) for p in parts)
            if whole and len(parts) > 1 and all(len(ps) < 2 for ps in of):
                break
        else:
            return None
        home = [ps[0] if ps else None for ps in of]
        wanted = [p for p in parts if p in home] or [None]
        home = [wanted[0] if p is None else p for p in home]
        df = None
        for part in wanted:
            rows = self._product(centre, scope)
            for other in parts:
                if other != part:
                    rows = rows.join(self._matches(other, centre, scope), self._links(centre, other, scope), "left_semi")
            if part is not None:
                rows = rows.join(self._product(part, scope), self._links(centre, part, scope), "inner")
            values = [(self.value(x, scope) if p == part else F.lit(None)).alias(f"arg{i}_{j}") for i, (a, p) in enumerate(zip(aggregates, home, strict=True)) for j, x in enumerate(a.args)]
            rows = rows.select(*(self.value(k, scope).alias(f"key{i}") for i, k in enumerate(keys)), *values)
            df = rows if df is None else df.union(rows)
        made = []
        for i, a in enumerate(aggregates):
            refs = tuple(Ref(f"arg{i}_{j}", self.kind(x, scope), False, isinstance(x, Ref) and x.double) for j, x in enumerate(a.args))
            made.append(self.aggregate(dataclasses.replace(a, args=refs), Scope([])).alias(f"agg{i}"))
        return df, [F.col(f"key{i}") for i in range(len(keys))], made

    @staticmethod
    def _with_parents(names: frozenset, scope: Scope) -> frozenset:
        """These sources and those of which each of their rows finds one at most, by primary key."""
        grown = True
        while grown:
            grown = False
            for s in scope.sources:
                if s.name not in names and any(_same_columns(c) and ((c.left == s.rownum and _owners(c.right) <= names) or (c.right == s.rownum and _owners(c.left) <= names)) for c, _ in scope.conditions):
                    names, grown = names | {s.name}, True
        return names

    @staticmethod
    def _parts(names: frozenset, tied: list[frozenset]) -> list[frozenset]:
        """The sources by part: those together that a condition ties."""
        parts = [frozenset((n,)) for n in sorted(names)]
        for o in tied:
            one = frozenset().union(*(p for p in parts if p & o))
            parts = [p for p in parts if not p & o] + ([one] if one else [])
        return parts

    def _links(self, centre: frozenset, part: frozenset, scope: Scope) -> Column:
        return reduce(lambda a, b: a & b, (self.condition(c, scope, two) for c, two in scope.conditions if (o := _owners(c)) & centre and o & part))

    def _matches(self, part: frozenset, centre: frozenset, scope: Scope) -> DataFrame:
        """A part's rows for the question whether there is one: each once where columns are only compared."""
        df, links = self._product(part, scope), [c for c, _ in scope.conditions if (o := _owners(c)) & centre and o & part]
        if not all(map(_same_columns, links)):
            return df
        columns = dict.fromkeys(r.name for c in links for r in (c.left, c.right) if _owners(r) <= part)
        return df.select(*map(_column, columns)).distinct()

    def _product(self, names: frozenset, scope: Scope) -> DataFrame:
        """The inner join of some sources, by the conditions that need no others."""
        todo, have, df = [s for s in scope.sources if s.name in names], frozenset(), None
        left = [(c, two, o) for c, two in scope.conditions if (o := _owners(c)) <= names]
        while todo:
            s = next((s for s in todo if any(s.name in o and o & have and o <= have | {s.name} for _, _, o in left)), todo[0])
            todo.remove(s)
            have |= {s.name}
            now = [self.condition(c, scope, two) for c, two, o in left if o <= have]
            left = [x for x in left if not x[2] <= have]
            on = reduce(lambda a, b: a & b, now) if now else None
            if df is not None:
                df = df.join(s.rows, on if on is not None else F.lit(True), "inner")
            else:
                df = s.rows if on is None else s.rows.where(on)
        return df

    def _topn(self, df: DataFrame, sel: Select, bound: list[Node], scope: Scope) -> tuple[DataFrame, list[str], list[str]]:
        if len(bound) != 1 or sel.group or sel.having is not None or not bound[0].args or not isinstance(bound[0].args[0], Ref):
            raise SqlError("topn(field[, n]) stands alone")
        ref, *rest = bound[0].args
        name = next(n for s in scope.sources for n, r in s.columns.values() if r == ref)
        n = rest[0].value if rest else 0
        out = topn(df.select(_column(ref.name).alias(name)), name, n)
        return out, [f"topn_{name}", "topn_count", "topn_percent"], ["str", "num", "num"]

    # -- sources -----------------------------------------------------------------------------

    def _named(self, df: DataFrame, alias: str, scope: Scope, key: str | None = None, fields=None) -> DataFrame:
        """A source under a name of its own, by which its columns are found."""
        self.sources += 1
        own = f"s{self.sources}"
        columns = {}
        for f in fields or df.schema.fields:
            columns[f.name.lower()] = (f.name, Ref(f"{own}.{quoted(f.name)}", kind_of(f.dataType), False, f.dataType.typeName() == "double"))
        if any(s.alias.lower() == alias.lower() for s in scope.sources):
            raise SqlError(f"alias {alias} is used twice")
        source = Source(alias, columns, name=own)
        if key is not None and key.lower() in columns:
            source.rownum = columns[key.lower()][1]
        scope.sources.append(source)
        return df.alias(own)

    def source(self, node: Node, scope: Scope) -> DataFrame:
        if isinstance(node, Table):
            df, key = self.engine.table(node.name)
            df = self._named(df, node.alias, scope, key, self.engine.fields(node.name))
            scope.sources[-1].rows = df if self.engine.steady(node.name) else None
            return df
        if isinstance(node, Derived):
            df, names, _ = self.query(node.query, None)
            if len({n.lower() for n in names}) < len(names):
                raise SqlError("a derived table has two columns of one name")
            return self._named(df, node.alias, scope)
        return self._joined(node, scope)

    def _joined(self, node: Join, scope: Scope) -> DataFrame:
        left = self.source(node.left, scope)
        before = len(scope.sources)
        right = self.source(node.right, scope)
        if node.using:
            on = None
            for name in node.using:
                a = Scope(scope.sources[:before]).find(Col(name))
                b = Scope(scope.sources[before:]).find(Col(name))
                if a is None or b is None:
                    raise SqlError(f"USING needs {name} on both sides")
                pair = _column(a.name) == _column(b.name)
                self._noted(scope, [Bin("=", a, b)], False, node.how == "inner" and a.kind == b.kind and a.kind in ("num", "str", "time"))
                on = pair if on is None else on & pair
                for s in scope.sources[:before] if node.how == "right" else scope.sources[before:]:
                    s.hidden.add(name.lower())
            return left.join(right, on, node.how)
        plain, later = [], []
        for c in (self.bind(c, scope) for c in _conjuncts(node.on)):
            (later if inside(c, lambda x: isinstance(x, (Sub, Exists))) else plain).append(c)
        if later and node.how != "inner":
            raise SqlError("a subquery in ON needs an inner join")
        self._noted(scope, [*plain, *later], False, node.how == "inner")
        on = self.condition(reduce(lambda a, b: Bin("and", a, b), plain), scope, two=False) if plain else None
        df = left.join(right, on if on is not None else F.lit(True), node.how)
        for c in later:  # the same for an inner join
            df = df.where(self.condition(c, scope, two=False))
        return df

    @staticmethod
    def _noted(scope: Scope, conditions: list, two: bool, inner: bool = True) -> None:
        scope.conditions = [*scope.conditions, *((c, two) for c in conditions)] if inner and scope.conditions is not None else None

    def filtered(self, df: DataFrame, where: Node, scope: Scope) -> DataFrame:
        node = self.bind(where, scope)
        self._noted(scope, _conjuncts(node), True)
        if isinstance(node, Not) and isinstance(node.value, Test) and node.value.op == "in" and isinstance(node.value.args[0], Sub):
            # Membership as the only predicate looks at rows with a key only.
            for part in node.value.value.items if isinstance(node.value.value, Row) else (node.value.value,):
                df = df.where(self.value(part, scope).isNotNull())
        return df.where(self.condition(node, scope))

    # -- names -------------------------------------------------------------------------------

    def bind(self, node: Node, scope: Scope, aliases_first: bool = False, seen: frozenset = frozenset()) -> Node:
        if isinstance(node, Col):
            return self._bound(node, scope, aliases_first, seen)
        if isinstance(node, (Ref, Lit, Sub, Exists)):
            return node
        if isinstance(node, Call) and node.name in AGGREGATES:
            aliases_first = False
        return rebuilt(node, lambda x: self.bind(x, scope, aliases_first, seen))

    def _bound(self, col: Col, scope: Scope, aliases_first: bool, seen: frozenset) -> Node:
        low = col.name.lower()
        alias = scope.aliases.get(low) if col.table is None and low not in seen else None
        if alias is not None and aliases_first:
            return self.bind(alias, scope, False, seen | {low})
        if (ref := scope.find(col)) is not None:
            return ref
        if alias is not None:
            return self.bind(alias, scope, False, seen | {low})
        up = scope.parent
        if up is not None:
            found = up.find(col)
            if found is None and up.parent is not None and up.parent.find(col) is not None:
                raise SqlError("a subquery sees the query around it only")
            if found is not None:
                return Ref(found.name, found.kind, True, found.double)
        if low == "rownum" and col.table is None and scope.sources:
            return Call("rownum")
        raise SqlError(f"unknown column {col.table + '.' if col.table else ''}{col.name}")

    # -- kinds -------------------------------------------------------------------------------

    def kind(self, node: Node, scope: Scope) -> str:
        if node in scope.known:
            return scope.known[node].kind
        if isinstance(node, Ref):
            return node.kind
        if isinstance(node, Lit):
            v = node.value
            return node.kind or ("null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str")
        if isinstance(node, (Neg,)) or (isinstance(node, Bin) and node.op in "+-*/%"):
            return "num"
        if isinstance(node, (Bin, Not, Test, Match, Exists)):
            return "bool"
        if isinstance(node, Cast):
            made = S._CASTS[node.kind]
            return "num" if made in (S.toint, S.tonumber) else "time" if made is S.todate else "str"
        if isinstance(node, Case):
            return self._common([w[1] for w in node.whens] + ([node.otherwise] if node.otherwise is not None else []), scope)
        if isinstance(node, Sub):
            return self._subquery_kinds(node.query, scope)[0]
        if isinstance(node, Call):
            if node.name == "if":
                return self._common(node.args[1:], scope)
            if node.name in _LIKE_ARGUMENTS:
                return self._common(node.args[:1] if node.name == "nullif" else node.args, scope)
            return "num" if node.name in _NUMERIC or node.name == "rownum" else "time" if node.name in _TIMES else "str"
        return "str"

    def _common(self, nodes, scope: Scope) -> str:
        kinds = {self.kind(n, scope) for n in nodes} - {"null"}
        return kinds.pop() if len(kinds) == 1 else "str" if kinds else "null"

    def _subquery_kinds(self, q: Query, scope: Scope) -> list[str]:
        first = q.branches[0]
        if isinstance(first, Query):
            return self._subquery_kinds(first, scope)
        _, inner = self.start(first, scope)
        items = [i for item in first.items for i in (self._starred(item, inner) if isinstance(item, Star) else [item])]
        return [self.kind(self.bind(i.value, inner), inner) for i in items]

    # -- values ------------------------------------------------------------------------------

    def ref(self, r: Ref, outer: bool = False) -> Column:
        c = _column(r.name)
        return c.outer() if r.outer or outer else c

    def value(self, node: Node, scope: Scope, outer: bool = False) -> Column:
        """``outer``: as seen from a subquery of this scope."""
        if not outer and (plain := self.text(node, scope)) is not None:
            return F.expr(plain)
        if node in scope.known:
            return self.ref(scope.known[node], outer)
        if isinstance(node, Ref):
            if scope.known and not node.outer:
                raise SqlError(f"column {node.name.split('.', 1)[1]} is neither grouped nor aggregated")
            return self.ref(node, outer)
        if isinstance(node, Lit):
            return F.lit(node.value).cast("timestamp_ntz") if node.kind == "time" else F.lit(node.value)
        of = lambda n: self.value(n, scope, outer)
        if isinstance(node, Neg):
            return -self.double(node.value, scope, outer)
        if isinstance(node, Bin) and node.op in "+-*/%":
            return self._arithmetic(node, scope, outer)
        if isinstance(node, (Bin, Not, Test, Match, Exists)):
            return self.condition(node, scope, two=False, outer=outer)
        if isinstance(node, Cast):
            return S.cast(node.value.value if isinstance(node.value, Lit) and not node.value.kind else of(node.value), node.kind)
        if isinstance(node, Case):
            return self._case(node, scope, outer)
        if isinstance(node, Sub):
            return self._scalar(node.query, scope)
        if isinstance(node, Var):
            return F.lit(self.engine.variable(node.name))
        if isinstance(node, Call):
            return self.call(node, scope, outer)
        if isinstance(node, Default):
            raise SqlError("DEFAULT stands in VALUES only")
        raise SqlError(f"{type(node).__name__.lower()} is no value")

    def double(self, node: Node, scope: Scope, outer: bool = False) -> Column:
        """The value as a double; no cast where it is one already."""
        if isinstance(node, Lit) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        v = self.value(node, scope, outer)
        ref = scope.known.get(node, node)
        made = isinstance(node, Neg) or (isinstance(node, Bin) and node.op in "+-*/%") or (isinstance(ref, Ref) and ref.double)
        return v if made else S.num(v)

    def _arithmetic(self, node: Bin, scope: Scope, outer: bool) -> Column:
        a, b = self.double(node.left, scope, outer), self.double(node.right, scope, outer)
        if node.op == "+":
            return a + b
        if node.op == "-":
            return a - b
        if node.op == "*":
            return a * b
        if node.op == "/":
            return a / b if isinstance(node.right, Lit) and node.right.value else S.divide(a, b)
        return S.mod(a, b)

    def _alike(self, nodes, scope: Scope, outer: bool) -> list[Column]:
        """Values of one type: texts where numbers and texts meet."""
        kinds = {self.kind(n, scope) for n in nodes} - {"null"}
        values = [self.value(n, scope, outer) for n in nodes]
        return [S.tostring(v) for v in values] if len(kinds) > 1 else values

    def _case(self, node: Case, scope: Scope, outer: bool) -> Column:
        results = [w[1] for w in node.whens] + ([node.otherwise] if node.otherwise is not None else [])
        made = self._alike(results, scope, outer)
        out = F
        for (test, _), value in zip(node.whens, made, strict=False):
            hit = self.condition(test if node.subject is None else Bin("=", node.subject, test), scope, two=False, outer=outer)
            out = out.when(hit, value)
        return out.otherwise(made[-1]) if node.otherwise is not None else out

    def _scalar(self, q: Query, scope: Scope) -> Column:
        df, names, _ = self.query(q, scope)
        if len(names) != 1:
            raise SqlError("a scalar subquery has one column")
        sel = q.branches[0]
        if len(q.branches) == 1 and isinstance(sel, Select) and not sel.group and sel.having is None and inside(self._plain(sel.items[0]), _is_aggregate):
            return df.scalar()
        one = df.toDF("v").limit(2).agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        wrong = F.when(F.col("n") == 0, F.raise_error(F.lit("a scalar subquery has no row"))).when(F.col("n") > 1, F.raise_error(F.lit("a scalar subquery has several rows")))
        return one.select(F.when(F.col("n") == 1, F.col("v")).otherwise(wrong)).scalar()

    @staticmethod
    def _plain(item) -> Node:
        return item.value if isinstance(item, Item) else item

    def aggregate(self, node: Call, scope: Scope) -> Column:
        if len(node.args) != 1 and not (node.name == "count" and node.distinct):
            raise SqlError(f"{node.name} takes one argument")
        if isinstance(node.args[0], Star):
            if node.name != "count" or node.distinct:
                raise SqlError("only count takes *")
            return F.count(F.lit(1))
        if inside(node.args[0], _is_aggregate):
            raise SqlError("an aggregate inside an aggregate")
        if (plain := self.aggregate_text(node, scope)) is not None:
            return F.expr(plain)
        if node.name in ("sum", "avg"):
            make = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((node.name, node.distinct))
            if make is None:
                raise SqlError("avg(DISTINCT) is not supported")
            return make(self.double(node.args[0], scope))
        values = [self.value(a, scope) for a in node.args]
        if node.name == "count":
            return F.count_distinct(*values) if node.distinct else F.count(values[0])
        return (F.min if node.name == "min" else F.max)(values[0])

    def call(self, node: Call, scope: Scope, outer: bool) -> Column:
        name, args = node.name, node.args
        if name in AGGREGATES:
            raise SqlError(f"{name} is not allowed here")
        if name == "rownum":
            return F.monotonically_increasing_id()
        if name in ("database", "schema", "version", "user", "current_user", "connection_id"):
            return F.lit(self.engine.session_value(name))
        if name not in S.FUNCTIONS:
            raise SqlError(f"unknown function {name}")
        if name == "if":
            if len(args) != 3:
                raise SqlError("if takes three arguments")
            a, b = self._alike(args[1:], scope, outer)
            return F.when(F.coalesce(self.condition(args[0], scope, two=False, outer=outer), F.lit(False)), a).otherwise(b)
        if name in ("coalesce", "ifnull"):
            return F.coalesce(*self._alike(args, scope, outer))
        if name in ("greatest", "least"):
            numeric = all(self.kind(a, scope) == "num" or (isinstance(a, Lit) and isinstance(a.value, str) and _numeric(a.value) is not None) for a in args)
            values = [S.num(self.value(a, scope, outer)) if numeric and isinstance(a, Lit) and isinstance(a.value, str) else self.value(a, scope, outer) for a in args]
            mixed = not numeric and len({self.kind(a, scope) for a in args} - {"null"}) > 1
            return S.FUNCTIONS[name](*([S.tostring(v) for v in values] if mixed else values))
        if name == "nullif":
            same = self.condition(Bin("=", *args), scope, two=False, outer=outer)
            return F.when(same, F.lit(None)).otherwise(self.value(args[0], scope, outer))
        given: list = []
        for i, a in enumerate(args):
            if isinstance(a, Lit) and not a.kind and not (name in _OF_TIMES and i == 0):
                given.append(a.value)
            elif i in _LITERAL.get(name, ()):
                raise SqlError(f"argument {i + 1} of {name} must be a literal")
            else:
                v = self.value(a, scope, outer)
                given.append(S.todate(v) if name in _OF_TIMES and self.kind(a, scope) == "str" and (i == 0 or name == "timediff") else v)
        if name == "timediff":
            given[:2] = [S.todate(F.lit(g)) if isinstance(g, str) else g for g in given[:2]]
        try:
            return S.FUNCTIONS[name](*given)
        except TypeError as error:
            raise SqlError(f"wrong arguments of {name}") from error

    # -- conditions --------------------------------------------------------------------------

    def condition(self, node: Node, scope: Scope, two: bool = True, outer: bool = False) -> Column:
        """A predicate; with ``two`` its negations are complements."""
        if not outer and (plain := self.condition_text(node, scope, two)) is not None:
            return F.expr(plain)
        of = lambda n: self.condition(n, scope, two, outer)
        if node in scope.known:
            return self._truth(node, scope, outer)
        if isinstance(node, Bin) and node.op == "and":
            return of(node.left) & of(node.right)
        if isinstance(node, Bin) and node.op == "or":
            return of(node.left) | of(node.right)
        if isinstance(node, Not):
            return P.negate(of(node.value)) if two else ~of(node.value)
        if isinstance(node, Bin) and node.op in _COMPARISONS:
            return self.compare(node.op, node.left, node.right, scope, two, outer)
        if isinstance(node, Test):
            return self._test(node, scope, two, outer)
        if isinstance(node, Exists):
            return self._rows(node.query, scope).exists()
        if isinstance(node, Match):
            return match_against(self.value(node.column, scope, outer), node.query)
        if isinstance(node, Call) and node.name == "isnull":
            return self.value(node.args[0], scope, outer).isNull()
        return self._truth(node, scope, outer)

    def _truth(self, node: Node, scope: Scope, outer: bool) -> Column:
        v = self.value(node, scope, outer)
        return v if self.kind(node, scope) == "bool" else S.truthy(v)

    def _rows(self, q: Query, scope: Scope) -> DataFrame:
        """The rows of an EXISTS: what is selected does not matter."""
        sel = q.branches[0]
        if len(q.branches) > 1 or not isinstance(sel, Select) or sel.group or sel.having is not None or q.limit is not None or inside(self._plain(sel.items[0]), _is_aggregate):
            return self.query(q, scope)[0]
        df, inner = self.start(sel, scope)
        return self.filtered(df, sel.where, inner) if sel.where is not None else df

    def _test(self, node: Test, scope: Scope, two: bool, outer: bool) -> Column:
        if node.op == "null":
            return self.value(node.value, scope, outer).isNull()
        if node.op == "in":
            return self._in(node, scope, two, outer)
        if node.op == "between":
            low, high = node.args
            v = self.value(node.value, scope, outer)
            if self.kind(node.value, scope) == "time" and all(isinstance(x, Lit) and isinstance(x.value, str) for x in node.args):
                return P.time_between(v, low.value, high.value)
            return self.compare(">=", node.value, low, scope, False, outer) & self.compare("<=", node.value, high, scope, False, outer)
        v, pattern = S.tostring(self.value(node.value, scope, outer)) if self.kind(node.value, scope) == "num" else self.value(node.value, scope, outer), node.args[0]
        if isinstance(pattern, Lit):
            if pattern.value is None:
                return F.lit(None).cast("boolean")
            return (P.like if node.op == "like" else P.regexp)(v, str(pattern.value))
        p = self.value(pattern, scope, outer)
        return P.like_dynamic(v, p) if node.op == "like" else F.rlike(S.text(v), S.text(p))

    def _in(self, node: Test, scope: Scope, two: bool, outer: bool) -> Column:
        if isinstance(node.args[0], Sub):
            return self._member(node, scope, outer)
        if isinstance(node.value, Row):
            out = None
            for row in node.args:
                if not isinstance(row, Row) or len(row.items) != len(node.value.items):
                    raise SqlError("rows of different length")
                every = reduce(lambda a, b: a & b, (self.compare("=", a, b, scope, two, outer) for a, b in zip(node.value.items, row.items, strict=True)))
                out = every if out is None else out | every
            return out
        kind, v = self.kind(node.value, scope), self.value(node.value, scope, outer)
        given = [a.value for a in node.args if isinstance(a, Lit) and not a.kind]
        plain = len(given) == len(node.args) and (
            (kind == "num" and all(type(x) in (int, float) for x in given)) or (kind == "str" and all(isinstance(x, str) and (isinstance(node.value, Ref) or _numeric(x) is None) for x in given))
        )
        if plain:
            return v.isin(*given)
        return reduce(lambda a, b: a | b, (self.compare("=", node.value, a, scope, two, outer) for a in node.args))

    def _member(self, node: Test, scope: Scope, outer: bool) -> Column:
        """IN (SELECT ...): some row of the subquery is equal."""
        parts = node.value.items if isinstance(node.value, Row) else (node.value,)
        df, names, kinds = self.query(node.args[0].query, scope)
        if len(names) != len(parts):
            raise SqlError("the subquery of IN has another number of columns")
        self.sources += 1
        inner = [f"m{self.sources}_{i}" for i in range(len(parts))]
        df = df.toDF(*inner)
        on = None
        for part, name, kind in zip(parts, inner, kinds, strict=True):
            own, mine = self.value(part, scope, outer=True), self.kind(part, scope)
            one = F.col(name) == own
            if {mine, kind} == {"num", "str"}:
                one = S.text(F.col(name)).try_cast("double") == S.text(own).try_cast("double")
            on = one if on is None else on & one
        return df.where(on).exists()

    def compare(self, op: str, left: Node, right: Node, scope: Scope, two: bool, outer: bool) -> Column:
        if isinstance(left, Row) and isinstance(right, Row):
            return reduce(lambda a, b: a & b, (self.compare(op, a, b, scope, two, outer) for a, b in zip(left.items, right.items, strict=True)))
        if isinstance(left, Lit) and not isinstance(right, Lit):
            return self.compare(_FLIPPED.get(op, op), right, left, scope, two, outer)
        lk, rk = self.kind(left, scope), self.kind(right, scope)
        if "null" in (lk, rk) and (isinstance(left, Lit) or isinstance(right, Lit)):
            if not two:
                return F.lit(None).cast("boolean")
            other = self.value(left if rk == "null" else right, scope, outer)
            return other.isNull() if op == "=" else other.isNotNull() if op == "<>" else F.lit(False)
        a = self.value(left, scope, outer)
        literal = right.value if isinstance(right, Lit) else None
        if lk == "set":
            has = P.has_value(a, literal) if isinstance(right, Lit) else F.array_contains(a, self.value(right, scope, outer))
            return self._maybe_not(op, has, two)
        if lk == "time" and isinstance(literal, str):
            made = P.time_compare(a, "=" if op == "<>" else op, literal)
            return self._maybe_not(op, made, two)
        if lk == "num" and isinstance(literal, str):
            number = _numeric(literal)
            return self._plain_compare(op, a, F.lit(number), two) if number is not None else self._plain_compare(op, S.tostring(a), F.lit(literal), two)
        b = self.value(right, scope, outer)
        if lk == "bool" and rk == "num":
            return self._plain_compare(op, a, b != 0, two)
        if rk == "bool" and lk == "num":
            return self._plain_compare(op, a != 0, b, two)
        if "bool" in (lk, rk) and "str" in (lk, rk):
            return self._plain_compare(op, S.text(a), S.text(b), two)
        if {lk, rk} == {"num", "str"}:
            return self._coerced(op, a, b, two)
        if {lk, rk} == {"time", "str"}:
            return self._plain_compare(op, S.todate(a) if lk == "str" else a, S.todate(b) if rk == "str" else b, two)
        if lk == rk == "str" and not (isinstance(left, Ref) and isinstance(right, (Ref, Lit))) and not (isinstance(literal, str) and _numeric(literal) is None):
            return self._coerced(op, a, b, two)
        residual = not isinstance(right, (Lit, Sub)) and not (isinstance(left, Ref) and isinstance(right, Ref))
        joined = any(isinstance(x, Ref) and x.outer for x in (left, right))
        if two and op == "=" and residual and not joined and not inside(left, lambda x: isinstance(x, Sub)):
            return a.eqNullSafe(b)
        return self._plain_compare(op, a, b, two and not joined)

    @staticmethod
    def _maybe_not(op: str, p: Column, two: bool) -> Column:
        return p if op != "<>" else P.negate(p) if two else ~p

    @staticmethod
    def _plain_compare(op: str, a: Column, b: Column, two: bool) -> Column:
        if op == "<>":
            return ~a.eqNullSafe(b) if two else a != b
        return P._OPS[op](a, b)

    def _coerced(self, op: str, a: Column, b: Column, two: bool) -> Column:
        made = P.compare(a, "=" if op == "<>" else op, b)
        if two and op in ("=", "<>"):
            made = F.coalesce(made, a.isNull() & b.isNull())
        return self._maybe_not(op, made, two)
