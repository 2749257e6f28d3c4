"""Text to syntax trees by recursive descent."""

from __future__ import annotations

import re

from .tree import (
    Bin, Call, Case, Cast, Col, Default, Derived, Exists, Item, Join, Key, Lit, Match, Neg, Not, Query, Row, Select, SqlError, Star, Sub, Table, Test, Var,
)

_TOKEN = re.compile(
    r"""\s+ | --[^\n]* | \#[^\n]* | /\*.*?\*/
      | (?P<str>'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*")
      | `(?P<quoted>[^`]+)`
      | (?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<var>@@?(?:\w+\.)?\w+)
      | (?P<word>[^\W\d]\w*)
      | (?P<op><=>|<>|!=|==|<=|>=|\|\||[-+*/%=<>(),.;?])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a", "\\": "\\", "'": "'", '"': '"'}
#: Words that end an expression or a source, so that they are no aliases.
_RESERVED = frozenset(
    """select from where group having order limit offset union join inner left right full outer cross natural on using as and or not in like regexp
    between is null case when then else end by asc desc distinct set values into for mode against nulls div mod escape straight_join""".split()
)
#: Types of CAST, by what they become.
CAST_KINDS = frozenset("signed unsigned int integer bigint smallint tinyint decimal numeric double float real char varchar text string date datetime timestamp".split())


class _Tok:
    __slots__ = ("kind", "text", "low", "at")

    def __init__(self, kind: str, text: str, at: int):
        self.kind, self.text, self.at = kind, text, at
        self.low = text.lower() if kind == "word" else text if kind == "op" else None


def _unquote(raw: str) -> str:
    """The value of a string literal. A backslash before % or _ stays, for patterns."""
    quote, body = raw[0], raw[1:-1].replace(raw[0] * 2, raw[0]) if raw[0] * 2 in raw[1:-1] else raw[1:-1]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0] if m[1] in "%_" else m[1]), body, flags=re.S) if quote else body


def tokens(sql: str) -> list[_Tok]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read {sql[at : at + 20]!r}")
        if m.lastgroup:
            text = m[m.lastgroup]
            out.append(_Tok(m.lastgroup, _unquote(text) if m.lastgroup == "str" else text, at))
        at = m.end()
    return out


class Parser:
    def __init__(self, sql: str, args: list | None = None):
        self.sql, self.toks, self.i, self.args, self.used = sql, tokens(sql), 0, list(args or []), 0

    # -- tokens ------------------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> _Tok | None:
        return self.toks[self.i + ahead] if self.i + ahead < len(self.toks) else None

    def at(self, *words: str) -> bool:
        return all((t := self.peek(k)) is not None and t.low == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.error(f"expected {' '.join(words).upper()}")

    def error(self, what: str) -> SqlError:
        t = self.peek()
        return SqlError(f"{what} at {self.sql[t.at : t.at + 30]!r}" if t else f"{what} at the end")

    def name(self) -> str:
        t = self.peek()
        if t is None or t.kind not in ("word", "quoted"):
            raise self.error("expected a name")
        self.i += 1
        return t.text

    def dotted(self) -> str:
        name = self.name()
        while self.at(".") and (t := self.peek(1)) is not None and t.kind in ("word", "quoted"):
            self.i += 1
            name += "." + self.name()
        return name

    def whole(self) -> int:
        t = self.peek()
        if t is not None and t.low == "?":
            return int(self.literal_parameter().value)
        if t is None or t.kind != "num":
            raise self.error("expected a number")
        self.i += 1
        return int(t.text)

    def literal_parameter(self) -> Lit:
        self.need("?")
        if self.used >= len(self.args):
            raise SqlError("more ? than arguments")
        self.used += 1
        return Lit(self.args[self.used - 1])

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def finish(self, tree):
        self.take(";")
        if self.peek() is not None:
            raise self.error("unexpected text")
        return tree

    # -- queries -----------------------------------------------------------------------------

    def query(self) -> Query:
        branches = [self.branch()]
        while self.take("union"):
            if not self.take("all"):
                raise self.error("only UNION ALL is supported")
            branches.append(self.branch())
        order = self.listed(self.key) if self.take("order", "by") else ()
        limit, offset = None, 0
        if self.take("limit"):
            limit = self.whole()
            if self.take(","):
                offset, limit = limit, self.whole()
            elif self.take("offset"):
                offset = self.whole()
        elif self.take("offset"):
            offset = self.whole()
        return Query(tuple(branches), order, limit, offset)

    def branch(self) -> Select | Query:
        if self.take("("):
            inner = self.query()
            self.need(")")
            return inner
        self.need("select")
        distinct = self.take("distinct")
        if not distinct:
            self.take("all")
        items = self.listed(self.item)
        source = self.source() if self.take("from") else None
        where = self.expression() if self.take("where") else None
        group = self.listed(self.expression) if self.take("group", "by") else ()
        having = self.expression() if self.take("having") else None
        return Select(items, source, where, group, having, distinct)

    def item(self) -> Item | Star:
        if self.take("*"):
            return Star()
        first = self.peek()
        if first is not None and first.kind in ("word", "quoted") and (dot := self.peek(1)) is not None and dot.low == "." and (star := self.peek(2)) is not None and star.low == "*":
            self.i += 3
            return Star(first.text)
        start = first.at if first else 0
        value = self.expression()
        after = self.peek()
        alias = self.alias()
        if alias is None:
            end = after.at if after else len(self.sql)
            alias = value.name if isinstance(value, Col) else self.sql[start:end].strip().rstrip(";").strip()
        return Item(value, alias)

    def alias(self) -> str | None:
        t = self.peek()
        if self.take("as"):
            t = self.peek()
            if t is not None and t.kind == "str":
                self.i += 1
                return t.text
            return self.name()
        if t is not None and (t.kind == "quoted" or (t.kind == "word" and t.low not in _RESERVED)):
            return self.name()
        return None

    def key(self) -> Key:
        value = self.expression()
        descending = self.take("desc")
        if not descending:
            self.take("asc")
        nulls = None
        if self.take("nulls"):
            nulls = "first" if self.take("first") else "last"
            if nulls == "last":
                self.need("last")
        return Key(value, descending, nulls)

    def source(self):
        left = self.one_source()
        while True:
            if self.at(",") or self.at("cross") or self.at("full") or self.at("natural"):
                raise self.error("a join needs ON or USING, and is inner, left or right")
            how = None
            if self.take("inner", "join") or self.take("join"):
                how = "inner"
            elif self.take("left", "outer", "join") or self.take("left", "join") or self.take("outer", "join"):
                how = "left"
            elif self.take("right", "outer", "join") or self.take("right", "join"):
                how = "right"
            if how is None:
                return left
            right = self.one_source()
            if self.take("using"):
                self.need("(")
                using = self.listed(self.name)
                self.need(")")
                left = Join(how, left, right, None, using)
            else:
                self.need("on")
                left = Join(how, left, right, self.expression())

    def one_source(self):
        if self.take("("):
            if self.at("select") or self.at("("):
                inner = self.query()
                self.need(")")
                alias = self.alias()
                return Derived(inner, alias or "")
            inner = self.source()
            self.need(")")
            return inner
        name = self.dotted()
        alias = self.alias()
        return Table(name, alias or name.split(".")[-1])

    # -- expressions -------------------------------------------------------------------------

    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = Bin("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = Bin("and", left, self.negation())
        return left

    def negation(self):
        if self.take("not"):
            return Not(self.negation())
        return self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            t = self.peek()
            if t is None:
                return left
            if t.low in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                self.i += 1
                left = Bin({"==": "=", "!=": "<>"}.get(t.low, t.low), left, self.sum())
            elif t.low == "is":
                self.i += 1
                negated = self.take("not")
                self.need("null")
                left = Test("null", left, ())
                left = Not(left) if negated else left
            elif t.low == "not" or t.low in ("in", "like", "regexp", "between"):
                negated = self.take("not")
                if negated and not any(self.at(w) for w in ("in", "like", "regexp", "between")):
                    raise self.error("expected IN, LIKE, REGEXP or BETWEEN")
                left = self.test(left)
                left = Not(left) if negated else left
            else:
                return left

    def test(self, left):
        if self.take("like"):
            return Test("like", left, (self.sum(),))
        if self.take("regexp"):
            return Test("regexp", left, (self.sum(),))
        if self.take("between"):
            low = self.sum()
            self.need("and")
            return Test("between", left, (low, self.sum()))
        self.need("in")
        self.need("(")
        args = (Sub(self.query()),) if self.at("select") else self.listed(self.expression)
        self.need(")")
        return Test("in", left, args)

    def sum(self):
        left = self.product()
        while (t := self.peek()) is not None and t.low in ("+", "-"):
            self.i += 1
            left = Bin(t.low, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while (t := self.peek()) is not None and t.low in ("*", "/", "%"):
            self.i += 1
            left = Bin(t.low, left, self.unary())
        return left

    def unary(self):
        if self.take("-"):
            value = self.unary()
            return Lit(-value.value) if isinstance(value, Lit) and isinstance(value.value, (int, float)) else Neg(value)
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self):
        t = self.peek()
        if t is None:
            raise self.error("expected an expression")
        if t.kind == "str":
            self.i += 1
            return Lit(t.text)
        if t.kind == "num":
            self.i += 1
            return Lit(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "var":
            self.i += 1
            name = t.text.lstrip("@").split(".")[-1].lower()
            return Col("rownum") if name == "rownum" else Var(name)
        if t.low == "?":
            return self.literal_parameter()
        if t.low == "(":
            self.i += 1
            if self.at("select"):
                inner = self.query()
                self.need(")")
                return Sub(inner)
            items = self.listed(self.expression)
            self.need(")")
            return items[0] if len(items) == 1 else Row(items)
        if t.kind == "word":
            after = self.peek(1)
            if special := self.special(t, after):
                return special
            if t.low in _RESERVED and not (after is not None and after.low == "("):
                raise self.error("expected an expression")
        name = self.dotted()
        if self.at("("):
            return self.call(name.lower())
        *table, column = name.split(".")
        return Col(column, table[-1] if table else None)

    def special(self, t: _Tok, after: _Tok | None):
        """What begins with a word and is neither a column nor a plain call."""
        if t.low in ("null", "true", "false"):
            self.i += 1
            return Lit({"null": None, "true": True, "false": False}[t.low])
        if t.low in ("date", "timestamp") and after is not None and after.kind == "str":
            self.i += 2
            return Lit(after.text, "time")
        if t.low == "case":
            return self.case()
        if t.low == "default" and (after is None or after.low != "("):
            self.i += 1
            return Default()
        if t.low in ("current_timestamp", "current_user") and (after is None or after.low != "("):
            self.i += 1
            return Call(t.low)
        if after is None or after.low != "(":
            return None
        if t.low == "exists":
            self.i += 2
            inner = self.query()
            self.need(")")
            return Exists(inner)
        if t.low == "cast":
            self.i += 2
            value = self.expression()
            self.need("as")
            kind = self.name().lower()
            if kind not in CAST_KINDS:
                raise SqlError(f"unknown type {kind}")
            if self.take("("):
                self.listed(self.whole)
                self.need(")")
            self.take("integer")
            self.need(")")
            return Cast(value, kind)
        if t.low == "match":
            self.i += 2
            column = self.sum()
            self.need(")")
            self.need("against")
            self.need("(")
            query = self.primary()
            if not isinstance(query, Lit) or not isinstance(query.value, str):
                raise self.error("AGAINST takes a text")
            if self.take("in"):
                if not (self.take("natural", "language", "mode") or self.take("boolean", "mode")):
                    raise self.error("unknown search mode")
            self.need(")")
            return Match(column, query.value)
        return None

    def case(self):
        self.need("case")
        subject = None if self.at("when") else self.expression()
        whens = []
        while self.take("when"):
            test = self.expression()
            self.need("then")
            whens.append((test, self.expression()))
        otherwise = self.expression() if self.take("else") else None
        self.need("end")
        return Case(subject, tuple(whens), otherwise)

    def call(self, name: str):
        self.need("(")
        if self.take(")"):
            return Call(name)
        if name == "trim" and any(self.at(w) for w in ("leading", "trailing", "both")):
            where = self.name().lower()
            what = self.expression()
            self.need("from")
            text = self.expression()
            self.need(")")
            return Call("trim", (text, what, Lit(where)))
        if self.take("*"):
            self.need(")")
            return Call(name, (Star(),))
        distinct = self.take("distinct")
        args = self.listed(self.expression)
        if len(args) == 1 and self.take("from"):  # substring(s from a for b), trim(x from s)
            args += (self.expression(),)
            if name == "trim":
                args = (args[1], args[0], Lit("both"))
            elif self.take("for"):
                args += (self.expression(),)
        self.need(")")
        return Call(name, args, distinct)
