"""A parser of SQL queries and what is read off its trees: tables, columns, joins, conditions, intents, complexity, rewrites.

The grammar is that of queries as people and models write them: WITH, set operations, all joins, subqueries anywhere,
windows, CASE, CAST, quoted names in four styles. Text that is no query raises ``NoQuery``. Names compare in lower case.
``analyse`` runs it over a column in Arrow batches and gives typed rows; a text that repeats in a batch is parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"""(?P<gap>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]\n]*\])
    |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<sign>\|\||<=|>=|<>|!=|==|<<|>>|[-+*/%<>=(),.;&|~?:@])""",
    re.S | re.X,
)
FENCE = re.compile(r"```[a-zA-Z]*")
#: Words that end an expression or a name, so that they are no alias.
RESERVED = frozenset(
    "select from where group having order limit offset union intersect except on using join inner left right full outer cross natural as and or not in is like glob regexp match "
    "between case when then else end exists distinct all by asc desc nulls with window over filter collate escape values ilike rlike lateral fetch".split()
)
COMPARE = {"=": 4, "==": 4, "<>": 4, "!=": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "<<": 6, ">>": 6, "&": 6, "|": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "||": 9}
AGGREGATES = ("count", "sum", "avg", "max", "min")
RANKS = ("row_number", "rank", "dense_rank")
#: Tag of each intent.
TAGS = (
    {t: "sorting" for t in ("order_by_asc", "order_by_desc")}
    | {t: "aggregate" for t in ("group_by", *AGGREGATES)}
    | {"having": "filter", "distinct": "deduplication", "limit": "limit"}
    | {t: "calc" for t in ("division", "ratio", "percentage")}
    | {t: "window" for t in ("window_function", "partition_by", *RANKS)}
    | {t: "subquery" for t in ("subquery", "exists", "in_subquery")}
    | {t: "join" for t in ("join", "inner_join", "left_join", "right_join", "full_join")}
)


class NoQuery(ValueError):
    pass


class Node:
    """A tree node: a kind, and fields that are nodes, lists of them, or plain values."""

    __slots__ = ("kind", "at")

    def __init__(self, kind: str, **at: Any):
        self.kind, self.at = kind, at

    def __getitem__(self, name: str) -> Any:
        return self.at.get(name)

    def kids(self) -> Iterator[Node]:
        stack = list(reversed(self.at.values()))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
            elif isinstance(x, (list, tuple)):
                stack += reversed(x)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(list(n.kids()))


def tokens(sql: str) -> list[tuple[str, str, str]]:
    """(kind, text, text in lower case without quotes) of each token; comments and code fences are left out."""
    out, at, sql = [], 0, FENCE.sub(" ", sql)
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise NoQuery(f"no token at {at}")
        at = m.end()
        if m.lastgroup != "gap":
            text = m.group()
            low = text[1:-1].lower() if m.lastgroup == "quoted" else text.lower()
            out.append((m.lastgroup, text, low))
    return out


class Parser:
    def __init__(self, sql: str):
        self.t, self.i = tokens(sql), 0

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs; quoted names are neither."""
        for k, w in enumerate(words):
            if self.i + k >= len(self.t) or self.t[self.i + k][0] in ("quoted", "text") or self.t[self.i + k][2] != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise NoQuery(f"{' '.join(words)} expected at token {self.i}")

    def is_name(self) -> bool:
        return self.i < len(self.t) and (self.t[self.i][0] == "quoted" or self.t[self.i][0] == "word" and self.t[self.i][2] not in RESERVED)

    def name(self) -> str:
        if not self.is_name():
            raise NoQuery(f"name expected at token {self.i}")
        self.i += 1
        return self.t[self.i - 1][2]

    def parse(self) -> Node:
        q = self.query()
        while self.take(";"):
            pass
        if self.i < len(self.t):
            raise NoQuery(f"text after the query at token {self.i}")
        return q

    def query(self) -> Node:
        ctes = []
        if self.take("with"):
            self.take("recursive")
            while True:
                name, names = self.name(), []
                if self.take("("):
                    names = self.names()
                    self.need(")")
                self.need("as")
                self.take("not") and self.need("materialized") or self.take("materialized")
                self.need("(")
                ctes.append(Node("cte", name=name, names=names, query=self.query()))
                self.need(")")
                if not self.take(","):
                    break
        q = self.term()
        while self.word("union") or self.word("except"):
            q = self.operation(q, self.term)
        order = self.order() if self.take("order", "by") else []
        limit = self.expression() if self.take("limit") else None
        offset = None
        if limit is not None and self.take(","):
            limit, offset = self.expression(), limit
        elif self.take("offset"):
            offset = self.expression()
        if order or limit is not None or offset is not None or ctes:
            if q.kind not in ("select", "setop") or q["order"] or q["limit"] is not None or q["ctes"]:
                q = Node("select", items=[Node("item", value=Node("star"), alias=None)], sources=[Node("derived", query=q, alias=None)], joins=[])
            q.at |= {"order": order, "limit": limit, "offset": offset, "ctes": ctes}
        return q

    def operation(self, left: Node, side) -> Node:
        op = self.t[self.i][2]
        self.i += 1
        all_ = self.take("all") or (self.take("distinct") and False)
        return Node("setop", op=op, all=all_, left=left, right=side())

    def term(self) -> Node:
        q = self.core()
        while self.word("intersect"):
            q = self.operation(q, self.core)
        return q

    def core(self) -> Node:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        if self.take("values"):
            rows = [self.primary()]
            while self.take(","):
                rows.append(self.primary())
            return Node("values", rows=rows)
        self.need("select")
        distinct = self.take("distinct") or (self.take("all") and False)
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        sources, joins, windows = [], [], []
        if self.take("from"):
            sources.append(self.source())
            while True:
                if self.take(","):
                    joins.append(Node("join", how="comma", right=self.source(), on=None, using=[]))
                elif how := self.join_kind():
                    right = self.source()
                    on = self.expression() if self.take("on") else None
                    using = []
                    if self.take("using"):
                        self.need("(")
                        using = self.names()
                        self.need(")")
                    joins.append(Node("join", how=how, right=right, on=on, using=using))
                else:
                    break
        where = self.expression() if self.take("where") else None
        group = self.list() if self.take("group", "by") else []
        having = self.expression() if self.take("having") else None
        if self.take("window"):
            while True:
                self.name()
                self.need("as")
                windows.append(self.window())
                if not self.take(","):
                    break
        return Node("select", distinct=distinct, items=items, sources=sources, joins=joins, where=where, group=group, having=having, windows=windows)

    def join_kind(self) -> str | None:
        at, how = self.i, "inner"
        natural = self.take("natural")
        for kind in ("left", "right", "full", "cross", "inner"):
            if self.take(kind):
                how = kind
                self.take("outer")
                break
        if self.take("join"):
            return f"natural {how}" if natural else how
        self.i = at
        return None

    def alias(self) -> str | None:
        if self.take("as"):
            if self.t[self.i][0] == "text":
                self.i += 1
                return self.t[self.i - 1][1][1:-1].lower()
            return self.name()
        return self.name() if self.is_name() else None

    def source(self) -> Node:
        self.take("lateral")
        if self.take("("):
            if self.word("select") or self.word("with") or self.word("values") or self.word("("):
                q = self.query()
                self.need(")")
                return Node("derived", query=q, alias=self.alias())
            inner = self.source()
            joins = []
            while how := self.join_kind():
                joins.append(Node("join", how=how, right=self.source(), on=self.expression() if self.take("on") else None, using=[]))
            self.need(")")
            q = Node("select", items=[Node("item", value=Node("star"), alias=None)], sources=[inner], joins=joins)
            return Node("derived", query=q, alias=self.alias())
        name = self.name()
        while self.take("."):
            name = self.name()
        if self.take("("):
            args = [] if self.word(")") else self.list()
            self.need(")")
            return Node("called", name=name, args=args, alias=self.alias())
        return Node("table", name=name, alias=self.alias())

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def item(self) -> Node:
        value = self.expression()
        return Node("item", value=value, alias=self.alias())

    def list(self) -> list[Node]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def order(self) -> list[Node]:
        out = []
        while True:
            value, desc = self.expression(), False
            if self.take("desc"):
                desc = True
            else:
                self.take("asc")
            nulls = None
            if self.take("nulls"):
                nulls = self.t[self.i][2]
                self.i += 1
            out.append(Node("sort", value=value, desc=desc, nulls=nulls))
            if not self.take(","):
                return out

    def expression(self, least: int = 0) -> Node:
        if self.word("not") and not self.word("not", "exists"):
            self.i += 1
            left = Node("not", value=self.expression(3))
        else:
            left = self.unary()
        while self.i < len(self.t):
            if least <= 1 and self.take("or"):
                left = Node("or", left=left, right=self.expression(2))
            elif least <= 2 and self.take("and"):
                left = Node("and", left=left, right=self.expression(3))
            elif least <= 4 and (negated := self.negated()) is not None:
                left = self.test(left, negated)
            else:
                kind, _, op = self.t[self.i]
                power = COMPARE.get(op) if kind == "sign" else None
                if power is None or power < least:
                    return left
                self.i += 1
                left = Node("binary", op=op, left=left, right=self.expression(power + 1))
        return left

    def negated(self) -> bool | None:
        """Whether a test follows, and is negated; None if none does."""
        no = self.word("not")
        word = self.t[self.i + no][2] if self.i + no < len(self.t) and self.t[self.i + no][0] == "word" else ""
        if word in ("in", "like", "ilike", "glob", "regexp", "rlike", "match", "between") or word in ("is", "isnull", "notnull", "collate") and not no:
            self.i += no
            return bool(no)
        return None

    def test(self, left: Node, negated: bool) -> Node:
        word = self.t[self.i][2]
        self.i += 1
        if word == "collate":
            self.name()
            return left
        if word in ("isnull", "notnull"):
            return Node("is", value=left, what=Node("null"), negated=word == "notnull")
        if word == "is":
            no = self.take("not")
            self.take("distinct", "from")
            return Node("is", value=left, what=self.expression(5), negated=no)
        if word == "between":
            low = self.expression(5)
            self.need("and")
            return Node("between", value=left, low=low, high=self.expression(5), negated=negated)
        if word == "in":
            if not self.take("("):
                return Node("in", value=left, options=[Node("column", table=None, name=self.name())], query=None, negated=negated)
            if self.word("select") or self.word("with") or self.word("values"):
                q = self.query()
                self.need(")")
                return Node("in", value=left, options=[], query=q, negated=negated)
            options = [] if self.word(")") else self.list()
            self.need(")")
            return Node("in", value=left, options=options, query=None, negated=negated)
        pattern = self.expression(5)
        escape = self.expression(5) if self.take("escape") else None
        return Node("like", op=word, value=left, pattern=pattern, escape=escape, negated=negated)

    def unary(self) -> Node:
        for sign in ("-", "+", "~"):
            if self.take(sign):
                return Node("sign", op=sign, value=self.expression(9))
        return self.primary()

    def primary(self) -> Node:
        if self.i >= len(self.t):
            raise NoQuery("the text ends inside the query")
        kind, text, low = self.t[self.i]
        if kind == "text":
            self.i += 1
            return Node("text", value=text)
        if kind == "number":
            self.i += 1
            return Node("number", value=text)
        if self.take("*"):
            return Node("star")
        if self.take("?") or self.take(":") and self.name():
            return Node("parameter")
        if self.take("("):
            if self.word("select") or self.word("with") or self.word("values"):
                q = self.query()
                self.need(")")
                return Node("subquery", query=q)
            inside = self.list()
            self.need(")")
            return Node("paren", value=inside[0]) if len(inside) == 1 else Node("tuple", values=inside)
        if self.take("exists") or self.take("not", "exists"):
            negated = self.t[self.i - 2][2] == "not" if self.i > 1 else False
            self.need("(")
            q = self.query()
            self.need(")")
            return Node("exists", query=q, negated=negated)
        if self.take("case"):
            of = None if self.word("when") else self.expression()
            arms = []
            while self.take("when"):
                when = self.expression()
                self.need("then")
                arms.append(Node("arm", when=when, then=self.expression()))
            other = self.expression() if self.take("else") else None
            self.need("end")
            return Node("case", of=of, arms=arms, other=other)
        if self.word("cast", "("):
            self.i += 2
            value = self.expression()
            self.need("as")
            kind_ = [self.name()]
            while not self.word(")"):
                kind_.append(self.t[self.i][2])
                self.i += 1
                if self.t[self.i - 1][2] == "(":
                    while not self.take(")"):
                        kind_.append(self.t[self.i][2])
                        self.i += 1
                    kind_.append(")")
            self.need(")")
            return Node("cast", value=value, to="".join(kind_))
        if self.take("null"):
            return Node("null")
        if kind == "word" and low in ("left", "right", "glob", "like", "match") and self.word(low, "("):
            self.i += 1
            return self.call(low)
        name = self.name()
        if kind == "word" and self.word("("):
            return self.call(name)
        table = None
        while self.take("."):
            table = name
            if self.take("*"):
                return Node("star", table=table)
            name = self.name()
        return Node("column", table=table, name=name)

    def call(self, name: str) -> Node:
        self.need("(")
        distinct = self.take("distinct")
        args = [] if self.word(")") else self.list()
        order = self.order() if self.take("order", "by") else []
        self.need(")")
        only = None
        if self.take("filter"):
            self.need("(", "where")
            only = self.expression()
            self.need(")")
        over = None
        if self.take("over"):
            over = Node("window", name=self.name(), partition=[], order=[]) if self.is_name() else self.window()
        return Node("call", name=name, distinct=distinct, args=args, order=order, only=only, over=over)

    def window(self) -> Node:
        self.need("(")
        base = self.name() if self.is_name() and not self.word("partition") and not any(self.word(w) for w in ("rows", "range", "groups")) else None
        partition = self.list() if self.take("partition", "by") else []
        order = self.order() if self.take("order", "by") else []
        deep = 0  # the frame is skipped
        while deep or not self.word(")"):
            deep += self.word("(") - self.word(")")
            self.i += 1
            if self.i >= len(self.t):
                raise NoQuery("the text ends inside a window")
        self.need(")")
        return Node("window", name=base, partition=partition, order=order)


def parse(sql: str) -> Node:
    try:
        return Parser(sql).parse()
    except (IndexError, RecursionError) as e:
        raise NoQuery(str(e)) from e


# --- text of a tree -------------------------------------------------------------------------------------------------


class Writer:
    """Writes a tree as text: keywords in capitals, names bare, one blank between parts. Subclasses change names and queries."""

    def name(self, n: str) -> str:
        return n

    def column(self, n: Node) -> str:
        return f"{self.name(n['table'])}.{self.name(n['name'])}" if n["table"] else self.name(n["name"])

    def alias(self, a: str | None) -> str:
        return f" AS {self.name(a)}" if a else ""

    def source(self, n: Node) -> str:
        if n.kind == "derived":
            return f"({self.query(n['query'])}){self.alias(n['alias'])}"
        if n.kind == "called":
            return f"{n['name']}({self.list(n['args'])}){self.alias(n['alias'])}"
        return self.name(n["name"]) + self.alias(n["alias"])

    def join(self, j: Node) -> str:
        if j["how"] == "comma":
            return f", {self.source(j['right'])}"
        how = {"inner": "JOIN"}.get(j["how"], f"{j['how'].upper()} JOIN")
        on = f" ON {self.expr(j['on'])}" if j["on"] else f" USING ({', '.join(map(self.name, j['using']))})" if j["using"] else ""
        return f" {how} {self.source(j['right'])}{on}"

    def list(self, xs: list[Node]) -> str:
        return ", ".join(self.expr(x) for x in xs)

    def tail(self, q: Node) -> list[str]:
        out = []
        if q["order"]:
            out.append(f"ORDER BY {self.list(q['order'])}")
        if q["limit"] is not None:
            out.append(f"LIMIT {self.expr(q['limit'])}")
        if q["offset"] is not None:
            out.append(f"OFFSET {self.expr(q['offset'])}")
        return out

    def query(self, q: Node) -> str:
        if q.kind == "values":
            return f"VALUES {self.list(q['rows'])}"
        head = [f"WITH {', '.join(f'{self.name(c['name'])} AS ({self.query(c['query'])})' for c in q['ctes'])}"] if q["ctes"] else []
        if q.kind == "setop":
            body = [self.query(q["left"]), q["op"].upper() + (" ALL" if q["all"] else ""), self.query(q["right"])]
            return " ".join(head + body + self.tail(q))
        body = [f"SELECT {'DISTINCT ' if q['distinct'] else ''}{', '.join(self.expr(i['value']) + self.alias(i['alias']) for i in q['items'])}"]
        if q["sources"]:
            body.append("FROM " + self.source(q["sources"][0]) + "".join(self.join(j) for j in q["joins"]))
        body += [f"WHERE {self.expr(q['where'])}"] if q["where"] else []
        body += [f"GROUP BY {self.list(q['group'])}"] if q["group"] else []
        body += [f"HAVING {self.expr(q['having'])}"] if q["having"] else []
        return " ".join(head + body + self.tail(q))

    def expr(self, n: Node) -> str:
        e, no = self.expr, "NOT " if n["negated"] else ""
        match n.kind:
            case "column":
                return self.column(n)
            case "text" | "number":
                return n["value"]
            case "null":
                return "NULL"
            case "parameter":
                return "?"
            case "star":
                return f"{self.name(n['table'])}.*" if n["table"] else "*"
            case "paren":
                return f"({e(n['value'])})"
            case "tuple":
                return f"({self.list(n['values'])})"
            case "subquery":
                return f"({self.query(n['query'])})"
            case "exists":
                return f"{no}EXISTS ({self.query(n['query'])})"
            case "not":
                return f"NOT {e(n['value'])}"
            case "sign":
                return n["op"] + e(n["value"])
            case "and" | "or":
                return f"{e(n['left'])} {n.kind.upper()} {e(n['right'])}"
            case "binary":
                return f"{e(n['left'])} {n['op']} {e(n['right'])}"
            case "is":
                return f"{e(n['value'])} IS {no}{e(n['what'])}"
            case "between":
                return f"{e(n['value'])} {no}BETWEEN {e(n['low'])} AND {e(n['high'])}"
            case "in":
                return f"{e(n['value'])} {no}IN ({self.query(n['query']) if n['query'] else self.list(n['options'])})"
            case "like":
                return f"{e(n['value'])} {no}{n['op'].upper()} {e(n['pattern'])}" + (f" ESCAPE {e(n['escape'])}" if n["escape"] else "")
            case "case":
                arms = " ".join(f"WHEN {e(a['when'])} THEN {e(a['then'])}" for a in n["arms"])
                return f"CASE {e(n['of']) + ' ' if n['of'] else ''}{arms}{' ELSE ' + e(n['other']) if n['other'] else ''} END"
            case "cast":
                return f"CAST({e(n['value'])} AS {n['to'].upper()})"
            case "sort":
                return e(n["value"]) + (" DESC" if n["desc"] else "") + (f" NULLS {n['nulls'].upper()}" if n["nulls"] else "")
            case "call":
                text = f"{n['name'].upper()}({'DISTINCT ' if n['distinct'] else ''}{self.list(n['args'])})"
                if n["only"]:
                    text += f" FILTER (WHERE {e(n['only'])})"
                if (w := n["over"]) is not None:
                    parts = [f"PARTITION BY {self.list(w['partition'])}"] if w["partition"] else []
                    parts += [f"ORDER BY {self.list(w['order'])}"] if w["order"] else []
                    text += f" OVER {w['name']}" if w["name"] and not parts else f" OVER ({' '.join(parts)})"
                return text
        raise NoQuery(n.kind)


class LogicWriter(Writer):
    """The steps of a query in brackets, in the order in which they are carried out, joined by arrows; names in angle brackets."""

    def name(self, n: str) -> str:
        return f"<{n}>"

    def query(self, q: Node) -> str:
        if q.kind == "values":
            return f"[{super().query(q)}]"
        steps = [f"[WITH {self.name(c['name'])} AS ( {self.query(c['query'])} )]" for c in q["ctes"] or []]
        if q.kind == "setop":
            steps += [f"( {self.query(q['left'])} )", f"[{q['op'].upper()}{' ALL' if q['all'] else ''}]", f"( {self.query(q['right'])} )"]
        else:
            if q["sources"]:
                steps.append(f"[FROM {self.source(q['sources'][0])}]")
            steps += [f"[{self.join(j).replace(', ', 'CROSS JOIN ', 1).strip() if j['how'] == 'comma' else self.join(j).strip()}]" for j in q["joins"]]
            steps += [f"[WHERE {self.expr(q['where'])}]"] if q["where"] else []
            steps += [f"[GROUP BY {self.list(q['group'])}]"] if q["group"] else []
            steps += [f"[HAVING {self.expr(q['having'])}]"] if q["having"] else []
            steps.append(f"[SELECT {'DISTINCT ' if q['distinct'] else ''}{', '.join(self.expr(i['value']) + self.alias(i['alias']) for i in q['items'])}]")
        return " -> ".join(steps + [f"[{t}]" for t in self.tail(q)])


# --- names in scope -------------------------------------------------------------------------------------------------


class Scope:
    """Sources of one SELECT by the name that columns are qualified with, and the scope around it."""

    def __init__(self, outer: Scope | None, ctes: dict[str, dict[str, tuple[str, str] | None]]):
        self.outer, self.ctes = outer, ctes
        self.sources: dict[str, str | dict] = {}  #: a stored table's name, or what the columns of a derived one come from
        self.aliases: set[str] = set()


class Resolver:
    """Finds the stored column behind every column of a query. ``schema`` (table -> columns) settles names without a table.

    Without a schema, such a name belongs to the only stored table in scope, if there is but one, and else to no known table
    (''). With a schema, of several tables that have the column the first counts. Names of results are no columns.
    """

    def __init__(self, schema: dict[str, list[str]] | None = None):
        self.schema = {t.lower(): {c.lower() for c in cs} for t, cs in (schema or {}).items()}
        self.found: list[tuple[str, str, str, Node]] = []  #: clause, table, column, node
        self.tables: list[str] = []
        self.joins: list[tuple[str, str, str, str, str]] = []
        self.direct: dict[int, str] = {}  #: the stored table that a column node is read from without a query between

    def run(self, q: Node) -> Resolver:
        self.query(q, None, {})
        return self

    def query(self, q: Node, outer: Scope | None, ctes: dict) -> dict[str, tuple[str, str] | None]:
        """Visits a query and returns the columns of its result."""
        ctes = dict(ctes)
        for c in q["ctes"] or []:
            ctes[c["name"]] = {}  # a recursive one may name itself
            got = self.query(c["query"], None, ctes)
            ctes[c["name"]] = dict(zip(c["names"], got.values())) if c["names"] else got
        if q.kind == "values":
            return {}
        if q.kind == "setop":
            out = self.query(q["left"], outer, ctes)
            self.query(q["right"], outer, ctes)
            return out
        s = Scope(outer, ctes)
        for n in [*q["sources"], *[j["right"] for j in q["joins"]]]:
            self.source(n, s)
        out: dict[str, tuple[str, str] | None] = {}
        for k, i in enumerate(q["items"]):
            v = i["value"]
            if v.kind == "star":
                for name, src in s.sources.items():
                    if v["table"] in (None, name) and isinstance(src, dict):
                        out |= src
                    elif v["table"] in (None, name):
                        out |= {c: (src, c) for c in sorted(self.schema.get(src, ()))}
                continue
            self.expr(v, s, "select")
            name = i["alias"] or (v["name"] if v.kind == "column" else f"#{k}")
            out[name] = self.resolve(v, s) if v.kind == "column" else None
            if i["alias"]:
                s.aliases.add(i["alias"])
        for j in q["joins"]:
            if j["on"]:
                self.expr(j["on"], s, "join")
                self.conditions(j["on"], s, j["how"])
        if q["where"]:
            self.expr(q["where"], s, "where")
        for n in q["windows"] or []:
            self.expr(n, s, "select")
        for clause in ("group", "having", "order"):
            for n in q[clause] if isinstance(q[clause], list) else [q[clause]] if q[clause] else []:
                self.expr(n, s, clause, results=True)
        return out

    def source(self, n: Node, s: Scope) -> None:
        if n.kind == "derived":
            inner = self.query(n["query"], s.outer, s.ctes)
            s.sources[n["alias"] or f"#{len(s.sources)}"] = inner
        elif n.kind == "called":
            s.sources[n["alias"] or n["name"]] = {}
        elif n["name"] in s.ctes:
            s.sources[n["alias"] or n["name"]] = s.ctes[n["name"]]
        else:
            self.tables.append(n["name"])
            s.sources[n["alias"] or n["name"]] = n["name"]

    def resolve(self, n: Node, s: Scope | None) -> tuple[str, str] | None:
        """(table, column) of a column node, ('', column) if the table is not known, None if it is no stored column."""
        name = n["name"]
        while s is not None:
            if n["table"]:
                if (src := s.sources.get(n["table"])) is not None:
                    return src.get(name) if isinstance(src, dict) else self.read(n, src)
                # a table may be named in full though it has an alias
                if any(src == n["table"] for src in s.sources.values()):
                    return self.read(n, n["table"])
            else:
                for src in s.sources.values():
                    if isinstance(src, dict) and name in src:
                        return src[name]
                    if isinstance(src, str) and name in self.schema.get(src, ()):
                        return self.read(n, src)
                open_ = [src for src in s.sources.values() if isinstance(src, str) and src not in self.schema]
                if len(open_) == 1:
                    return self.read(n, open_[0])
                if open_ or s.outer is None:
                    return "", name
            s = s.outer
        return "", name

    def read(self, n: Node, table: str) -> tuple[str, str]:
        self.direct[id(n)] = table
        return table, n["name"]

    def expr(self, n: Node, s: Scope, clause: str, results: bool = False) -> None:
        if n.kind == "column":
            if results and not n["table"] and n["name"] in s.aliases:
                return
            if (at := self.resolve(n, s)) is not None:
                self.found.append((clause, *at, n))
            return
        if n.kind in ("select", "setop", "values"):
            self.query(n, s, s.ctes)
            return
        for k in n.kids():
            self.expr(k, s, clause, results)

    def conditions(self, n: Node, s: Scope, how: str) -> None:
        if n.kind == "paren":
            self.conditions(n["value"], s, how)
        elif n.kind in ("and", "or"):
            self.conditions(n["left"], s, how)
            self.conditions(n["right"], s, how)
        elif n.kind == "binary" and n["op"] in ("=", "==") and n["left"].kind == n["right"].kind == "column":
            a, b = self.resolve(n["left"], s), self.resolve(n["right"], s)
            if a and b:
                a, b = sorted((a, b))
                self.joins.append((how, *a, *b))


class QualifiedWriter(Writer):
    """The query without aliases of stored tables, unless a table occurs twice in a FROM, and with each column's table."""

    def __init__(self, resolver: Resolver, q: Node):
        self.at = resolver.direct
        self.keep: set[str] = set()  # aliases of repeated tables and of derived ones
        ctes = {c["name"] for n in q.walk() for c in (n["ctes"] or [])}
        for n in q.walk():
            if n.kind == "select":
                src = [*n["sources"], *[j["right"] for j in n["joins"]]]
                names = [x["name"] for x in src if x.kind == "table"]
                self.keep |= {x["alias"] for x in src if x["alias"] and (x.kind != "table" or names.count(x["name"]) > 1 or x["name"] in ctes)}

    def column(self, n: Node) -> str:
        if n["table"] in self.keep and n["table"]:
            return f"{n['table']}.{n['name']}"
        t = self.at.get(id(n))
        return f"{t}.{n['name']}" if t else super().column(n)

    def source(self, n: Node) -> str:
        return n["name"] if n.kind == "table" and n["alias"] not in self.keep else super().source(n)


# --- what is read off a tree ----------------------------------------------------------------------------------------


def intents(q: Node) -> list[tuple[str, str, str]]:
    """(type, tag, detail) of everything that a query calculates, in the order of the kinds of intents."""
    w, out = Writer(), []
    selects = [n for n in q.walk() if n.kind in ("select", "setop")]
    for s in selects:
        out += [("order_by_desc" if o["desc"] else "order_by_asc", w.expr(o["value"])) for o in s["order"] or []]
    out += [("group_by", w.list(s["group"])) for s in selects if s["group"]]
    out += [("having", w.expr(s["having"])) for s in selects if s["having"]]
    for s in selects:
        for i in s["items"] or []:
            calls = [c for c in i["value"].walk() if c.kind == "call"]
            out += [(c["name"], w.expr(c)) for c in calls if c["name"] in AGGREGATES and c["over"] is None][:1]
    for n in q.walk():
        for k in n.kids():
            if k.kind == "binary" and k["op"] == "/":
                out.append(("percentage" if n.kind == "call" and n["name"] == "round" else "division", w.expr(k)))
    out += [("distinct", "") for s in selects if s["distinct"]][:1]
    out += [("limit", w.expr(s["limit"])) for s in selects if s["limit"] is not None]
    for c in q.walk():
        if c.kind == "call" and c["over"] is not None:
            out.append((c["name"] if c["name"] in RANKS else "window_function", w.expr(c)))
            out += [("partition_by", w.list(c["over"]["partition"]))] if c["over"]["partition"] else []
    for j in q.walk():
        if j.kind == "join":
            kind = j["how"].split()[-1]
            out.append((f"{kind}_join" if kind in ("inner", "left", "right", "full") else "join", w.source(j["right"])))
    for n in q.walk():
        if n.kind == "exists":
            out.append(("exists", ""))
        elif n.kind == "in" and n["query"]:
            out.append(("in_subquery", w.expr(n["value"])))
        elif n.kind in ("subquery", "derived"):
            out.append(("subquery", ""))
    return [(t, TAGS[t], d) for t, d in out]


def complexity(q: Node) -> int:
    """5 for windows and 3 for common table expressions, once each; 3 for each set operation and each subquery outside of common
    table expressions; 1 for each join and, once, for HAVING."""
    nodes = list(q.walk())
    inside = {id(x) for n in nodes if n.kind == "cte" for x in n.walk()}
    score = 5 * any(n.kind == "call" and n["over"] is not None for n in nodes) + 3 * any(n.kind == "cte" for n in nodes)
    score += 3 * sum(n.kind == "setop" for n in nodes) + sum(n.kind == "join" for n in nodes) + any(bool(n["having"]) for n in nodes)
    inner = [n for n in nodes if (n.kind in ("subquery", "derived", "exists") or n.kind == "in" and n["query"]) and id(n) not in inside]
    return int(score + 3 * len(inner))


def conditions(q: Node) -> list[str]:
    """The single conditions of all WHERE and HAVING clauses as text."""
    w, out = Writer(), []

    def split(n: Node) -> None:
        if n.kind == "paren":
            split(n["value"])
        elif n.kind in ("and", "or"):
            split(n["left"])
            split(n["right"])
        else:
            out.append(w.expr(n))

    for n in q.walk():
        if n.kind == "select":
            for c in (n["where"], n["having"]):
                if c:
                    split(c)
    return out


def analysis(sql: str | None, schema: dict[str, list[str]] | None = None) -> dict[str, Any]:
    """All that ``analyse`` returns for one text. Text that is no query has complexity 100 and nothing else."""
    try:
        if sql is None:
            raise NoQuery("null")
        q = parse(sql)
        r = Resolver(schema).run(q)
        columns = sorted({(clause, t, c) for clause, t, c, _ in r.found})
        return {
            "parsed": True, "tables": sorted(set(r.tables)), "columns": [dict(zip(("clause", "table_name", "column_name"), x)) for x in columns],
            "joins": [dict(zip(("how", "left_table", "left_column", "right_table", "right_column"), j)) for j in r.joins], "conditions": conditions(q),
            "intents": [dict(zip(("type", "tag", "detail"), x)) for x in intents(q)], "complexity": complexity(q),
            "qualified": QualifiedWriter(r, q).query(q), "logic": LogicWriter().query(q),
        }
    except NoQuery:
        return {"parsed": False, "tables": [], "columns": [], "joins": [], "conditions": [], "intents": [], "complexity": 100, "qualified": None, "logic": None}


SHAPE = """struct<parsed: boolean, tables: array<string>, columns: array<struct<clause: string, table_name: string, column_name: string>>,
  joins: array<struct<how: string, left_table: string, left_column: string, right_table: string, right_column: string>>, conditions: array<string>,
  intents: array<struct<type: string, tag: string, detail: string>>, complexity: int, qualified: string, logic: string>"""


def arrow_shape() -> pa.DataType:
    text = pa.string()
    of = lambda *names: pa.list_(pa.struct([(n, text) for n in names]))
    return pa.struct([
        ("parsed", pa.bool_()), ("tables", pa.list_(text)), ("columns", of("clause", "table_name", "column_name")), ("joins", of("how", "left_table", "left_column", "right_table", "right_column")),
        ("conditions", pa.list_(text)), ("intents", of("type", "tag", "detail")), ("complexity", pa.int32()), ("qualified", text), ("logic", text),
    ])


def analyse(df: DataFrame, sql_col: str, out_col: str = "analysis", schema: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with the analysis of each text in ``out_col``; null and text that is no query are not ``parsed``."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    names = df.columns
    place = names.index(sql_col)
    fields = [*df.schema.fields, StructField(out_col, _parse_datatype_string(SHAPE))]
    shape = arrow_shape()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(place).dictionary_encode()
            each = pa.array([analysis(s, schema) for s in coded.dictionary.to_pylist()] + [analysis(None)], shape)
            at = coded.indices.fill_null(len(each) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, each.take(at)], [*names, out_col])

    return df.mapInArrow(work, StructType(fields))


# --- skeletons and masks --------------------------------------------------------------------------------------------


def normal_form(sql: str) -> str:
    """One blank between tokens, lower case but for texts, all texts in single quotes, no semicolon at the end, and ``asc`` after
    sort columns unless a direction is written anywhere."""
    parts = []
    for kind, text, _ in tokens(sql.strip().rstrip(";")):
        quoted = kind == "quoted" and text[0] == '"'
        parts.append("'" + text[1:-1] + "'" if quoted else text if kind == "text" else text.lower())
    out = " ".join(parts)
    if not re.search(r"\b(asc|desc)\b", out):
        out = re.sub(r"(?<=order by )(\w+ \( \S+ \)|\w+ \. \w+|\w+)", r"\1 asc", out)
    return out


#: What a skeleton is reduced by, in this order: conditions of joins, joined tables, lists, comparisons, chains of conditions.
REDUCE = [(r" on _ = _(?: (?:and|or) _ = _)*", ""), (r"_(?: (?:left |inner |outer |right |full |cross )*join _)+", "_"), (r"_(?: , _)+", "_"), (r"_ (?:=|!=|<>|>=|<=|>|<) _", "_"), (r"where _(?: (?:and|or) _)+", "where _")]


def schema_skeleton(sql: str, names: set[str]) -> str:
    """The normal form with ``_`` for names of the schema, with or without their table, and for values, reduced."""
    out: list[str] = []
    seq = tokens(normal_form(sql))
    at = 0
    while at < len(seq):
        kind, text, low = seq[at]
        if kind in ("word", "quoted") and at + 2 < len(seq) and seq[at + 1][1] == "." and (seq[at + 2][2] in names or seq[at + 2][1] == "*"):
            out.append("_")
            at += 3
            continue
        out.append("_" if kind in ("text", "number") or low in names and kind in ("word", "quoted") else text.lower())
        at += 1
    line = " ".join(out).replace("- _", "_")
    for pattern, to in REDUCE:
        line = re.sub(pattern, to, line)
    return re.sub(r"(order by) (?!_)\S+", r"\1 _", line)


def mask_pair(one: str, two: str) -> tuple[str, str, bool]:
    """Both texts with T1, C1, V1 ... for tables, columns and values, numbered over both texts together, and whether they
    differ in values only. A name or value that both have gets one mark."""
    marks: dict[tuple[str, str], str] = {}
    count = {"T": 0, "C": 0, "V": 0}

    def mark(kind: str, what: str) -> str:
        if (kind, what) not in marks:
            count[kind] += 1
            marks[kind, what] = f"{kind}{count[kind]}"
        return marks[kind, what]

    class Masked(Writer):
        def __init__(self, tables: set[str]):
            self.tables = tables

        def column(self, n: Node) -> str:
            return (f"{mark('T', n['table'])}." if n["table"] else "") + mark("C", n["name"])

        def source(self, n: Node) -> str:
            return mark("T", n["name"]) + (f" AS {mark('T', n['alias'])}" if n["alias"] else "") if n.kind == "table" else super().source(n)

        def expr(self, n: Node) -> str:
            return mark("V", n["value"]) if n.kind in ("text", "number") else super().expr(n)

    texts = []
    for sql in (one, two):
        q = parse(sql)
        texts.append(Masked(set()).query(q))
    bare = [re.sub(r"\bV\d+", "V", t) for t in texts]
    return texts[0], texts[1], bare[0] == bare[1] and texts[0] != texts[1]


def quote_names(sql: str, names: set[str]) -> str:
    """The text with backticks around names of tables that are also words of the language, where a table is expected."""
    words = sorted((n for n in names if n.lower() in RESERVED), key=len, reverse=True)
    if not words:
        return sql
    return re.sub(r"(?i)\b(from|join|update|into)(\s+)(" + "|".join(map(re.escape, words)) + r")\b(?!\s+by\b)", r"\1\2`\3`", sql)


def named_in(sql: str, columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (table, column) pairs whose names both occur anywhere in the text, whatever they are there."""
    low = sql.lower()
    return [(t, c) for t, c in columns if t.lower() in low and c.lower() in low]


def closest_name(name: str, known: list[str], least: float = 0.8) -> str | None:
    """The known name that is equal but for case and signs, else the most similar one of at least ``least``; the first of ties."""
    from difflib import SequenceMatcher

    plain = lambda n: re.sub(r"[^a-z0-9_]", "", n.lower())
    want = plain(name)
    for k in known:
        if plain(k) == want:
            return k
    scored = [(SequenceMatcher(None, want, plain(k)).ratio(), -i) for i, k in enumerate(known)]
    best = max(scored, default=(0.0, 0))
    return known[-best[1]] if best[0] >= least else None


def per_text(df: DataFrame, cols: list[str], out: dict[str, str], function) -> DataFrame:
    """``df`` with columns ``out`` (name -> type) of ``function`` over the texts of ``cols``; None where a text is null or no query.

    ``function`` gives one value for one name, else a tuple. Texts that repeat in a batch are worked on once.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    names = df.columns
    places = [names.index(c) for c in cols]
    kinds = {n: _parse_datatype_string(t) for n, t in out.items()}
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}

    def one(args: tuple) -> tuple:
        if any(a is None for a in args):
            return (None,) * len(out)
        try:
            got = function(*args)
        except NoQuery:
            return (None,) * len(out)
        return got if len(out) > 1 else (got,)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}
            rows = []
            for args in zip(*[batch.column(p).to_pylist() for p in places]):
                if args not in known:
                    known[args] = one(args)
                rows.append(known[args])
            made = [pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *out])

    return df.mapInArrow(work, StructType([*df.schema.fields, *[StructField(n, k) for n, k in kinds.items()]]))
