"""A small graph language that compiles to DataFrame joins.

    MATCH (p:Person)-[:KNOWS]->(q:Person {city: 'x'}), (q)-[:LIKES*1..3]->(r)
    WHERE p.age >= 30 AND NOT q.name IS NULL
    RETURN p, q.name LIMIT 10

    VECTOR MATCH (a) USING $query LIMIT 5 MATCH (a)-[:NEXT]->(b) RETURN a, b
    MATCH (a)-[r:KNOWS {since: 1999}]->(b) WHERE r.weight > 2 RETURN a, r.weight
    MATCH (a:Person), (b:Person {city: 'x'}) WHERE a.city = 'x' CREATE (a)-[:NEAR {weight: 1}]->(b)
    CREATE (n:Person {node_id: 'p9', age: 3})       MATCH (a:Robot) DELETE a
    MATCH (a:Person) WHERE a.age > 90 SET a.old = 1, a:Senior REMOVE a.young, a:Junior

Tables: nodes (node_id, labels array<string>, further columns as properties), edges (src, dst, type, ...). Statements that
change something make rows for a log of mutations (see operators/mutations.py), which a fold turns into tables again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reach

_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?(?!\.\.)|-?\d+(?=\.\.))|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>\.\.|<=|>=|<>|->|<-|[-()\[\]{}:,.*=<>|]))")


class QueryError(ValueError):
    pass


@dataclass
class Node:
    alias: str
    labels: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)


@dataclass
class Hop:
    source: str
    target: str
    types: list[str]
    direction: str
    least: int = 1
    most: int = 1
    optional: bool = False
    alias: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Query:
    nodes: dict[str, Node] = field(default_factory=dict)
    hops: list[Hop] = field(default_factory=list)
    where: list = field(default_factory=list)
    items: list[tuple[str, str | None]] = field(default_factory=list)
    limit: int | None = None
    #: nodes that a pattern which isn't optional names
    required: set[str] = field(default_factory=set)
    seed: tuple[str, str, int] | None = None
    #: nodes and hops to create, aliases to delete, (alias, property or None, label or None, value, whether set) to change
    created: Query | None = None
    deleted: list[str] = field(default_factory=list)
    changed: list[tuple] = field(default_factory=list)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 10]!r} at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.unnamed = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *names: str) -> bool:
        kind, value = self.peek()
        if kind == "word" and value.upper() in names:
            self.at += 1
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.peek() == ("sign", value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.sign(value):
            raise QueryError(f"{value!r} expected, {self.peek()[1]!r} found")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "word":
            raise QueryError(f"a name expected, {value!r} found")
        return value

    def integer(self) -> int:
        kind, value = self.next()
        if kind != "number" or not re.fullmatch(r"\d+", value):
            raise QueryError(f"a count expected, {value!r} found")
        return int(value)

    def value(self):
        kind, value = self.next()
        if kind == "number":
            return float(value) if "." in value else int(value)
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "param":
            return Parameter(value[1:])
        if kind == "word" and value.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[value.upper()]
        raise QueryError(f"a value expected, {value!r} found")

    def query(self) -> Query:
        q = self.head()
        if not self.word("RETURN"):
            raise QueryError("RETURN expected")
        while True:
            alias = self.name()
            q.items.append((alias, self.name() if self.sign(".") else None))
            if not self.sign(","):
                break
        if self.word("LIMIT"):
            q.limit = self.integer()
        return self.whole(q)

    def whole(self, q: Query) -> Query:
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        self.check(q)
        return q

    def statement(self) -> Query:
        """MATCH ... and what to create, delete, set and remove."""
        q = self.head()
        while self.peek()[0] != "end":
            if self.word("CREATE"):
                q.created = q.created or Query()
                self.pattern(q.created, False)
                while self.sign(","):
                    self.pattern(q.created, False)
            elif self.word("DELETE"):
                q.deleted.append(self.name())
                while self.sign(","):
                    q.deleted.append(self.name())
            elif (verb := self.word("SET")) or self.word("REMOVE"):
                while True:
                    alias = self.name()
                    if self.sign(":"):
                        q.changed.append((alias, None, self.name(), None, verb))
                    else:
                        self.need(".")
                        key, value = self.name(), None
                        if verb:
                            self.need("=")
                            value = self.value()
                        q.changed.append((alias, key, None, value, verb))
                    if not self.sign(","):
                        break
            else:
                raise QueryError(f"CREATE, DELETE, SET or REMOVE expected, {self.peek()[1]!r} found")
        for alias in [*q.deleted, *(c[0] for c in q.changed)]:
            if alias not in q.nodes and alias not in {h.alias for h in q.hops}:
                raise QueryError(f"{alias} is not declared")
        for h in q.created.hops if q.created else ():
            if len(h.types) != 1 or h.direction == "both" or (h.least, h.most) != (1, 1):
                raise QueryError("an edge to create has one type and one direction")
        if not (q.created or q.deleted or q.changed):
            raise QueryError("nothing to change")
        return self.whole(q)

    def head(self) -> Query:
        q = Query()
        if self.word("VECTOR"):
            if not self.word("MATCH"):
                raise QueryError("MATCH expected")
            node = self.node(q)
            if not self.word("USING"):
                raise QueryError("USING expected")
            kind, param = self.next()
            if kind != "param":
                raise QueryError("a parameter expected")
            k = self.integer() if self.word("LIMIT") else 10
            if self.word("CONTRACT"):  # every contract gets the exact plan
                self.name()
            q.seed = (node.alias, param[1:], k)
        while True:
            optional = self.word("OPTIONAL")
            if not self.word("MATCH"):
                if optional:
                    raise QueryError("MATCH expected")
                break
            self.pattern(q, optional)
            while self.sign(","):
                self.pattern(q, optional)
        if self.word("WHERE"):
            q.where.append(self.disjunction())
        return q

    def check(self, q: Query) -> None:
        for alias in [a for a, _ in q.items] + [a for w in q.where for a in _aliases(w)]:
            if alias not in q.nodes and alias not in {h.alias for h in q.hops}:
                raise QueryError(f"{alias} is not declared")
        for h in q.hops:
            if not 0 < h.least <= h.most <= 255:
                raise QueryError("hops must be in 1..255")
            if h.alias and h.most > 1:
                raise QueryError(f"{h.alias} stands for several edges")
            if h.props and h.most > 1:
                raise QueryError("properties belong to a single edge")
        names = [h.alias for h in q.hops if h.alias]
        if len(set(names)) < len(names) or set(names) & set(q.nodes):
            raise QueryError("an edge's name is used twice")

    def node(self, q: Query) -> Node:
        self.need("(")
        alias = self.name() if self.peek()[0] == "word" else None
        if alias is None:
            self.unnamed += 1
            alias = f"_{self.unnamed}"
        node = q.nodes.setdefault(alias, Node(alias))
        while self.sign(":"):
            node.labels.append(self.name())
        self.properties(node.props)
        self.need(")")
        return node

    def properties(self, into: dict) -> None:
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need(":")
                into[key] = self.value()
                self.sign(",")

    def pattern(self, q: Query, optional: bool) -> None:
        left = self.node(q)
        if not optional:
            q.required.add(left.alias)
        while self.peek() in (("sign", "-"), ("sign", "<-")):
            back = self.next()[1] == "<-"
            types, alias, least, most, props = [], None, 1, 1, {}
            if self.sign("["):
                if self.peek()[0] == "word":
                    alias = self.name()
                if self.sign(":"):
                    types.append(self.name())
                    while self.sign("|"):
                        self.sign(":")
                        types.append(self.name())
                if self.sign("*"):
                    least, most = 1, 255
                    if self.peek()[0] == "number":
                        least = most = self.integer()
                    if self.sign(".."):
                        most = self.integer() if self.peek()[0] == "number" else 255
                self.properties(props)
                self.need("]")
            forward = self.sign("->")
            if not forward:
                self.need("-")
            right = self.node(q)
            if not optional:
                q.required.add(right.alias)
            direction = "in" if back and not forward else "out" if forward and not back else "both"
            q.hops.append(Hop(left.alias, right.alias, types, direction, least, most, optional, alias, props))
            left = right

    def disjunction(self):
        left = self.conjunction()
        while self.word("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.word("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        if self.word("NOT"):
            return ("not", self.negation())
        if self.sign("("):
            inner = self.disjunction()
            self.need(")")
            return inner
        left = self.operand()
        if self.word("IS"):
            negated = self.word("NOT")
            if not self.word("NULL"):
                raise QueryError("NULL expected")
            return ("not", ("null", left)) if negated else ("null", left)
        kind, sign = self.next()
        if sign not in ("=", "<>", "<", "<=", ">", ">="):
            raise QueryError(f"a comparison expected, {sign!r} found")
        return (sign, left, self.operand())

    def operand(self):
        kind, value = self.peek()
        if kind == "word" and value.upper() not in ("TRUE", "FALSE", "NULL"):
            alias = self.name()
            return ("prop", alias, self.name() if self.sign(".") else None)
        return ("value", self.value())


@dataclass(frozen=True)
class Parameter:
    name: str


def _aliases(expr) -> list[str]:
    if expr[0] == "prop":
        return [expr[1]]
    return [a for x in expr[1:] if isinstance(x, tuple) for a in _aliases(x)]


def _item(q: Query, alias: str, prop: str | None) -> Column:
    """A node (its id), a property of a node or an edge, or an edge as a struct."""
    if alias in q.nodes:
        return F.col(alias) if prop in (None, "node_id") else F.col(f"{alias}__{prop}")
    return F.col(f"{alias}__{prop}") if prop else F.struct(*[F.col(f"{alias}__{c}").alias(c) for c in ("src", "type", "dst")])


def parse(text: str) -> Query:
    return Parser(text).query()


class Graph:
    """Compiles queries over node and edge tables; filters on a node sit below its joins."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, vector_col: str | None = None):
        self.nodes, self.edges, self.vector_col = nodes, edges, vector_col

    def run(self, text: str, **params) -> DataFrame:
        """Rows of the RETURN items, named alias or alias_property."""
        q = parse(text)
        out = self._matched(q, params)
        out = out.select(*[_item(q, a, p).alias(a if p is None else f"{a}_{p}") for a, p in q.items])
        return out.orderBy(*out.columns).limit(q.limit) if q.limit is not None else out

    def mutate(self, text: str, lsn: int, **params) -> DataFrame:
        """Rows for the log of mutations that a statement makes, all at `lsn`. A node to create needs a property node_id."""
        from ..operators import mutations

        q = Parser(text).statement()
        bound = lambda v: params[v.name] if isinstance(v, Parameter) else v
        made = q.created or Query()
        used = [*q.deleted, *(c[0] for c in q.changed), *(a for a in made.nodes if a in q.nodes)]
        edges = {h.alias for h in q.hops if h.alias}
        q.items = [(a, None) for a in used if a in q.nodes] + [(a, p) for a in used if a in edges for p in ("src", "type", "dst")]
        rows = self._matched(q, params) if q.nodes else self.nodes.sparkSession.range(1)
        of = lambda a: [F.col(f"{a}__{p}") for p in ("src", "type", "dst")] if a in edges else [F.col(a)]
        text_of = lambda props: {k: None if (v := bound(x)) is None else str(v) for k, x in props.items()}
        out = []
        for alias, node in made.nodes.items():
            if alias not in q.nodes:
                if "node_id" not in node.props:
                    raise QueryError(f"{alias} needs a node_id")
                props = text_of(node.props)
                out.append(mutations.row(rows, lsn, "create_node", [F.lit(props.pop("node_id"))], node.labels, props))
        for h in made.hops:
            a, b = (h.source, h.target) if h.direction == "out" else (h.target, h.source)
            end = lambda x: F.col(x) if x in q.nodes else F.lit(str(bound(made.nodes[x].props["node_id"])))
            out.append(mutations.row(rows, lsn, "create_edge", [end(a), F.lit(h.types[0]), end(b)], [], text_of(h.props)))
        for alias in q.deleted:
            out.append(mutations.row(rows, lsn, "delete_edge" if alias in edges else "delete_node", of(alias), [], {}))
        for alias, key, label, value, sets in q.changed:
            kind = ("patch_edge" if alias in edges else "patch_node") if key else "set_labels" if sets else "remove_labels"
            out.append(mutations.row(rows, lsn, kind, of(alias), [label] if label else [], text_of({key: value}) if key else {}))
        return reduce(DataFrame.unionByName, out)

    def _matched(self, q: Query, params: dict) -> DataFrame:
        bound = lambda v: params[v.name] if isinstance(v, Parameter) else v
        filters = self._split(q)
        frame, done = None, set()
        if q.seed:
            from ..operators.search import top_k

            alias, param, k = q.seed
            best = top_k(self.nodes.where(self._own(q.nodes[alias], filters, bound)), params[param], k, id_col="node_id", vector_col=self.vector_col)
            frame = best.select(F.col("node_id").alias(alias))
            done.add(alias)
        hops = list(q.hops)
        counts = {r["type"]: r["n"] for r in self.edges.groupBy("type").agg(F.count("*").alias("n")).collect()} if len(hops) > 2 else {}
        while hops:
            # rarer types first; optional hops last, when all other nodes are there
            left = [h for h in hops if not h.optional]
            if not left:
                frame = self._alone(frame, done, q, q.required, filters, bound)
            pool = left or hops
            ready = [h for h in pool if not done or h.source in done or h.target in done] or pool
            hop = min(ready, key=lambda h: sum(counts.get(t, 0) for t in (h.types or counts)))
            hops.remove(hop)
            frame = self._hop(frame, done, hop, q, filters, bound)
        frame = self._alone(frame, done, q, set(q.nodes), filters, bound)
        need = {a for w in q.where for a in _aliases(w)} | {a for a, p in q.items if p}
        for alias in sorted(need & set(q.nodes)):
            frame = frame.join(self.nodes.select(F.col("node_id").alias(alias), *[F.col(c).alias(f"{alias}__{c}") for c in self.nodes.columns if c not in ("node_id", "labels")]), alias, "left")
        for w in q.where:
            frame = frame.where(self._expr(w, lambda a, p: _item(q, a, p), bound))
        return frame

    def _alone(self, frame, done: set, q: Query, aliases: set, filters: dict, bound) -> DataFrame:
        """frame with the nodes of aliases that no hop has bound."""
        for alias in [a for a in q.nodes if a in aliases and a not in done]:
            scan = self._scan(q.nodes[alias], filters, bound)
            frame = scan if frame is None else frame.crossJoin(scan)  # a pattern of unconnected parts asks for it
            done.add(alias)
        return frame

    def _split(self, q: Query) -> dict[str, list]:
        """Conjuncts on one alias each, to be pushed to its scan."""
        own: dict[str, list] = {}
        optional = {h.target for h in q.hops if h.optional}

        def walk(e):
            if e[0] == "and":
                walk(e[1])
                walk(e[2])
            elif len(found := set(_aliases(e))) == 1 and (alias := found.pop()) in q.nodes and alias not in optional:
                own.setdefault(alias, []).append(e)

        for w in q.where:
            walk(w)
        return own

    def _own(self, node: Node, filters: dict, bound) -> Column:
        out = F.lit(True)
        for label in node.labels:
            out = out & F.array_contains("labels", label)
        for key, value in node.props.items():
            out = out & (F.col(key) == F.lit(bound(value)))
        for e in filters.get(node.alias, []):
            out = out & self._expr(e, lambda a, p: F.col(p or "node_id"), bound)
        return out

    def _scan(self, node: Node, filters: dict, bound) -> DataFrame:
        return self.nodes.where(self._own(node, filters, bound)).select(F.col("node_id").alias(node.alias))

    def _plain(self, node: Node, filters: dict) -> bool:
        return not node.labels and not node.props and not filters.get(node.alias)

    def _hop(self, frame, done, hop: Hop, q: Query, filters, bound) -> DataFrame:
        rows = self.edges.where(F.col("type").isin(hop.types)) if hop.types else self.edges
        for key, value in hop.props.items():
            rows = rows.where(F.col(key) == F.lit(bound(value)))
        # an edge with a name takes its columns along
        extra = [F.col(c).alias(f"{hop.alias}__{c}") for c in rows.columns] if hop.alias else []
        source, target, direction = hop.source, hop.target, hop.direction
        if source not in done and target in done:
            source, target = target, source
            direction = {"in": "out", "out": "in", "both": "both"}[direction]
        if frame is None:
            frame = self._scan(q.nodes[source], filters, bound)
            done.add(source)
        elif source not in done:
            frame = frame.crossJoin(self._scan(q.nodes[source], filters, bound))  # an unconnected part
            done.add(source)
        if hop.least == hop.most == 1:
            flip = rows.select(F.col("dst").alias("_s"), F.col("src").alias("_t"), *extra)
            plain = rows.select(F.col("src").alias("_s"), F.col("dst").alias("_t"), *extra)
            steps = plain if direction == "out" else flip if direction == "in" else plain.unionByName(flip)
        else:
            starts = frame.select(F.col(source).alias("start")).where(F.col(source).isNotNull()).distinct()
            steps = reach(rows, starts, hop.most, hop.least, direction).select(F.col("start").alias("_s"), F.col("node").alias("_t"))
        steps = steps.withColumnRenamed("_s", source)
        how = "left" if hop.optional else "inner"
        if target == source:
            return frame.join(steps.where(F.col(source) == F.col("_t")).drop("_t"), source, how)
        if target in done:
            # an optional way over several hops between two bound nodes binds nothing
            if hop.most > 1:
                return frame if hop.optional else frame.join(steps.withColumnRenamed("_t", target), [source, target], "left_semi")
            return frame.join(steps.withColumnRenamed("_t", target), [source, target], how)
        done.add(target)
        steps = steps.withColumnRenamed("_t", target)
        if not self._plain(q.nodes[target], filters):
            steps = steps.join(self._scan(q.nodes[target], filters, bound), target)
        return frame.join(steps, source, how)

    def _expr(self, e, column, bound) -> Column:
        kind = e[0]
        if kind == "prop":
            return column(e[1], e[2])
        if kind == "value":
            return F.lit(bound(e[1]))
        if kind == "not":
            return ~self._expr(e[1], column, bound)
        if kind == "null":
            return self._expr(e[1], column, bound).isNull()
        a, b = self._expr(e[1], column, bound), self._expr(e[2], column, bound)
        return {"and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[kind]()

    def explain(self, text: str, **params) -> str:
        return self.run(text, **params)._sc._jvm.PythonSQLUtils.explainString(self.run(text, **params)._jdf.queryExecution(), "formatted")


__all__ = ["Graph", "Parameter", "Query", "QueryError", "parse"]
