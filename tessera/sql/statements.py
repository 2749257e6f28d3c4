"""Parsing of the statements that are not queries."""

from __future__ import annotations

from .parser import Parser
from .tree import Lit, Statement


class StatementParser(Parser):
    def statement(self):
        t = self.peek()
        word = t.low if t is not None else None
        if word in ("select", "("):
            return self.finish(self.query())
        make = getattr(self, f"_{word}", None) if word and word.isalpha() else None
        if make is None:
            raise self.error("unknown statement")
        self.i += 1
        return self.finish(make())

    # -- changes of rows ---------------------------------------------------------------------

    def _insert(self):
        self.take("ignore")
        self.take("into")
        return self._rows_into()

    _replace = _insert

    def _rows_into(self):
        table, columns = self.dotted(), None
        if self.at("(") and not (self.peek(1) is not None and self.peek(1).low == "select"):
            self.need("(")
            columns = () if self.at(")") else self.listed(self.name)
            self.need(")")
        if self.take("values") or self.take("value"):
            rows = self.listed(self._tuple)
            out = Statement("insert", {"table": table, "columns": columns, "rows": rows, "query": None})
        else:
            out = Statement("insert", {"table": table, "columns": columns, "rows": None, "query": self.query()})
        if self.take("on", "duplicate", "key", "update"):  # a known key replaces the row; what is assigned does not matter
            self.listed(self._assignment)
        return out

    def _tuple(self) -> tuple:
        self.need("(")
        row = () if self.at(")") else self.listed(self.expression)
        self.need(")")
        return row

    def _assignment(self) -> tuple:
        name = self.dotted()
        self.need("=")
        return name, self.expression()

    def _tail(self) -> dict:
        where = self.expression() if self.take("where") else None
        order = self.listed(self.key) if self.take("order", "by") else ()
        limit = self.whole() if self.take("limit") else None
        return {"where": where, "order": order, "limit": limit}

    def _update(self):
        source = self.source()
        self.need("set")
        return Statement("update", {"source": source, "assignments": self.listed(self._assignment), **self._tail()})

    def _delete(self):
        target = None
        if not self.at("from"):
            target = self.dotted()
        self.need("from")
        source = self.source()
        return Statement("delete", {"target": target, "source": source, **self._tail()})

    def _truncate(self):
        self.take("table")
        return Statement("truncate", {"table": self.dotted()})

    # -- tables and views --------------------------------------------------------------------

    def _create(self):
        replace = self.take("or", "replace")
        if self.take("view"):
            name, columns = self.dotted(), ()
            if self.take("("):
                columns = self.listed(self.name)
                self.need(")")
            self.need("as")
            return Statement("create view", {"name": name, "columns": columns, "query": self.query(), "replace": replace})
        temporary = self.take("temporary")
        self.need("table")
        absent = self.take("if", "not", "exists")
        name = self.dotted()
        parts = {"name": name, "temporary": temporary, "absent": absent, "query": None, "like": None, "columns": None, "key": ()}
        if self.take("like"):
            parts["like"] = self.dotted()
        elif self.take("as") or self.at("select"):
            parts["query"] = self.query()
        elif self.take("("):
            if self.take("like"):
                parts["like"] = self.dotted()
            else:
                defined = self.listed(self._definition)
                parts["columns"] = tuple(d for d in defined if isinstance(d[0], str))
                parts["key"] = next((d[1] for d in defined if d[0] is None), tuple(d[0] for d in parts["columns"] if d[3]))
            self.need(")")
            if self.take("as") or self.at("select"):
                parts["query"] = self.query()
        return Statement("create table", parts)

    def _definition(self) -> tuple:
        """A column (name, type, default, whether it is the key), or (None, key columns)."""
        if self.take("primary", "key"):
            self.need("(")
            names = self.listed(self.name)
            self.need(")")
            return None, names
        name, kind = self.name(), self.name().lower()
        if self.take("("):
            self.listed(self.whole)
            self.need(")")
        default, key = None, False
        while True:
            if self.take("not", "null") or self.take("null") or self.take("unsigned") or self.take("auto_increment"):
                continue
            if self.take("default"):
                default = self.sum()
            elif self.take("primary", "key"):
                key = True
            else:
                return name, kind, default, key

    def _drop(self):
        if self.take("view"):
            absent = self.take("if", "exists")
            return Statement("drop view", {"name": self.dotted(), "absent": absent})
        temporary = self.take("temporary")
        self.need("table")
        absent = self.take("if", "exists")
        names = self.listed(self.dotted)
        self.take("cascade")
        return Statement("drop table", {"names": names, "temporary": temporary, "absent": absent})

    def _alter(self):
        self.need("table")
        table = self.dotted()
        self.need("add")
        if self.take("primary", "key"):
            self.need("(")
            names = self.listed(self.name)
            self.need(")")
            return Statement("add key", {"table": table, "columns": names})
        self.take("column")
        name, kind, default, _ = self._definition()
        return Statement("add column", {"table": table, "name": name, "type": kind, "default": default})

    # -- catalog and session -----------------------------------------------------------------

    def _explain(self):
        as_json = self.take("format", "=", "json")
        if not self.at("select") and not self.at("("):
            return Statement("show", {"what": "columns", "table": self.dotted(), "like": None, "where": None, "full": False})
        return Statement("explain", {"query": self.query(), "json": as_json})

    def _describe(self):
        return self._explain()

    _desc = _describe

    def _show(self):
        full = self.take("full") or self.take("extended")
        self.take("session") or self.take("global")
        words = []
        while (t := self.peek()) is not None and t.kind == "word" and t.low not in ("from", "in", "like", "where"):
            words.append(t.low)
            self.i += 1
            if words[:1] == ["create"] and len(words) == 2:
                break
        what, table = " ".join(words), None
        if words[:1] == ["create"]:
            table = self.dotted()
        while self.take("from") or self.take("in"):
            name = self.dotted()
            table = table or name
        like = self.primary().value if self.take("like") else None
        where = self.expression() if self.take("where") else None
        if self.take("limit"):
            self.whole()
        return Statement("show", {"what": what, "table": table, "like": like, "where": where, "full": full})

    def _use(self):
        return Statement("use", {"name": self.dotted()})

    def _set(self):
        if self.take("names") or self.take("character", "set"):
            value = self.primary()
            return Statement("set", {"values": (("names", value if isinstance(value, Lit) else Lit(value.name)),)})
        values = []
        while True:
            self.take("session") or self.take("global") or self.take("local")
            t = self.peek()
            if t is not None and t.low == "transaction":
                self.i = len(self.toks)
                return Statement("set", {"values": ()})
            if t is not None and t.kind == "var":
                self.i += 1
                name = t.text.lstrip("@").split(".")[-1]
            else:
                name = self.dotted()
            self.need("=")
            t = self.peek()
            bare = t is not None and t.kind == "word" and (self.peek(1) is None or self.peek(1).low in (",", ";"))
            values.append((name.lower(), Lit(self.name()) if bare else self.expression()))
            if not self.take(","):
                return Statement("set", {"values": tuple(values)})

    def _begin(self):
        self.i = len(self.toks)
        return Statement("transaction", {})

    _start = _commit = _rollback = _begin
