"""A restricted Cypher: MATCH of vessels (with their type), WHERE, RETURN, ORDER BY, SKIP and LIMIT, as a lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<sign><=|>=|<>|!=|->|<-|[-=<>()\[\]:,*{}]))")
#: Graph names of properties that the table calls otherwise.
PROPERTIES = {"gross_tonnage": "grossTonnage", "net_tonnage": "netTonnage", "built_year": "builtYear", "launch_year": "launchYear", "builder": "shipBuilder", "latitude": "last_position_latitude", "longitude": "last_position_longitude", "speed": "last_position_speed"}
_AGGREGATES = {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class Item:
    alias: str
    column: Column
    aggregate: bool
    text: str


class Reader:
    """Recursive descent over the tokens of one statement."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"can't read Cypher at: {text[at:at + 20]}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0
        self.labels: dict[str, str] = {}

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][1].lower() if k < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        if [self.peek(i) for i in range(len(words))] == list(words):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            raise ValueError(f"expected {' '.join(words).upper()}, got {self.peek() or 'the end'}")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the statement ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def pattern(self) -> list[str]:
        """Relations of the MATCH pattern; the names of nodes are kept with their labels."""
        self.expect("match")
        relations = []
        self.node()
        while self.take("-"):
            self.expect("[")
            self.expect(":")
            relations.append(self.next()[1])
            self.expect("]")
            if not self.take("->"):
                self.expect("-")
                self.expect(">")
            self.node()
        return relations

    def node(self) -> None:
        self.expect("(")
        name = self.next()[1]
        self.expect(":")
        self.labels[name] = self.next()[1]
        self.expect(")")

    def operand(self) -> tuple[Column, str]:
        kind, value = self.next()
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1])), value
        if kind == "number":
            return F.lit(float(value) if "." in value else int(value)), value
        if kind == "name" and value.lower() in ("true", "false", "null"):
            return F.lit({"true": True, "false": False, "null": None}[value.lower()]), value
        if kind == "name":
            return self.property(value), value
        raise ValueError(f"unexpected {value}")

    def property(self, dotted: str) -> Column:
        first, *rest = dotted.split(".")
        rest = rest[1:] if rest[:1] == ["properties"] else rest
        label = self.labels.get(first)
        if label is None or len(rest) != 1:
            raise ValueError(f"unknown name {dotted}")
        if label == "VesselType":
            return F.col("vessel_type" if rest[0] == "name" else rest[0])
        return F.col(PROPERTIES.get(rest[0], rest[0]))

    def condition(self) -> Column:
        left = self.conjunction()
        while self.take("or"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.take("and"):
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        if self.take("not"):
            return ~self.negation()
        if self.take("("):
            inner = self.condition()
            self.expect(")")
            return inner
        left, _ = self.operand()
        if self.take("is", "not", "null"):
            return left.isNotNull()
        if self.take("is", "null"):
            return left.isNull()
        if self.take("contains"):
            return F.contains(F.lower(left.cast("string")), F.lower(self.operand()[0].cast("string")))
        if self.take("starts", "with"):
            return left.startswith(self.operand()[0])
        if self.take("in"):
            self.expect("[")
            values = [self.operand()[0]]
            while self.take(","):
                values.append(self.operand()[0])
            self.expect("]")
            return left.isin(*values)
        sign = self.next()[1]
        right, _ = self.operand()
        signs = {"=": left == right, "<>": left != right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}
        if sign not in signs:
            raise ValueError(f"unknown comparison {sign}")
        return signs[sign]

    def item(self) -> Item:
        start = self.at
        word = self.peek()
        if word in _AGGREGATES and self.peek(1) == "(":
            self.at += 2
            distinct = self.take("distinct")
            if word == "count" and self.take("*"):
                column = F.count(F.lit(1))
            else:
                inner, _ = self.operand()
                column = F.count_distinct(inner) if distinct and word == "count" else F.bround(F.avg(inner), 2) if word == "avg" else _AGGREGATES[word](inner)
            self.expect(")")
            aggregate = True
        else:
            column, _ = self.operand()
            aggregate = False
        text = "".join(t for _, t in self.tokens[start : self.at])
        alias = self.next()[1] if self.take("as") else text.replace(".", "_")
        return Item(alias, column, aggregate, text)


def cypher(vessels: DataFrame, statement: str) -> DataFrame:
    """The statement's rows. ``vessels`` has a row a vessel with the table's column names.

    A written IS_TYPE pattern keeps vessels with a type only. Comparisons with null are unknown, AND binds tighter than
    OR, ORDER BY takes aliases or expressions (nulls last ascending, first descending), and a global aggregate has one row.
    """
    r = Reader(statement)
    relations = r.pattern()
    rows = vessels
    for relation in relations:
        if relation != "IS_TYPE":
            raise ValueError(f"unknown relation {relation}")
        rows = rows.where(F.col("vessel_type").isNotNull() & (F.col("vessel_type") != ""))
    if r.take("where"):
        rows = rows.where(r.condition())
    r.expect("return")
    distinct = r.take("distinct")
    items = [r.item()]
    while r.take(","):
        items.append(r.item())
    order, hidden = [], []
    if r.take("order", "by"):
        while True:
            name = next((x.alias for x in items if x.alias.lower() == r.peek()), None)
            if name is not None:
                r.at += 1
            else:
                i = r.item()
                name = next((x.alias for x in items if x.text.lower() == i.text.lower()), None)
            if name is None:
                name = f"_order{len(hidden)}"
                hidden.append(i.column.alias(name))
            down = r.take("desc") or r.take("descending")
            if not down:
                r.take("asc") or r.take("ascending")
            order.append(F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_last())
            if not r.take(","):
                break
    if any(i.aggregate for i in items):
        if hidden:
            raise ValueError("with aggregates, ORDER BY takes returned items only")
        keys = [i.column.alias(i.alias) for i in items if not i.aggregate]
        sums = [i.column.alias(i.alias) for i in items if i.aggregate]
        out = (rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)).select(*[i.alias for i in items])
    else:
        out = rows.select(*[i.column.alias(i.alias) for i in items], *hidden)
    out = out.distinct() if distinct else out
    if order:
        out = out.orderBy(*order, *[F.col(i.alias).asc_nulls_last() for i in items])
    if r.take("skip"):
        out = out.offset(int(r.next()[1]))
    if r.take("limit"):
        out = out.limit(int(r.next()[1]))
    if r.at < len(r.tokens):
        raise ValueError(f"unexpected {r.peek()}")
    return out.select(*[i.alias for i in items])


def _listing(rows: DataFrame, shown: dict[str, str], by: Column, most: int = 50) -> DataFrame:
    """The first ``most`` rows by ``by``, then by all that is shown; columns under the names of the report."""
    out = rows.select(*[F.col(c).alias(n) for n, c in shown.items()])
    return out.orderBy(by, *[F.col(n).asc_nulls_last() for n in shown]).limit(most)


def large_tankers(vessels: DataFrame, above: float = 20_000) -> DataFrame:
    kind = F.contains(F.lower("vessel_type"), F.lit("tanker"))
    return _listing(vessels.where(kind & (F.col("grossTonnage") > above)), {"name": "name", "flag": "flag", "tonnage": "grossTonnage", "type": "vessel_type", "record_id": "record_id"}, F.col("tonnage").desc())


def types_by_flag(vessels: DataFrame) -> DataFrame:
    counted = vessels.where(F.col("vessel_type") != "").groupBy("flag", "vessel_type").count()
    return _listing(counted, {"flag": "flag", "type": "vessel_type", "count": "count"}, F.col("count").desc())


def oldest(vessels: DataFrame, before: int = 2010) -> DataFrame:
    year = F.col("builtYear")
    return _listing(vessels.where((year > 0) & (year < before)), {"name": "name", "year": "builtYear", "tonnage": "grossTonnage", "record_id": "record_id"}, F.col("year").asc())


def largest(vessels: DataFrame, above: float = 50_000) -> DataFrame:
    typed = vessels.where((F.col("vessel_type") != "") & (F.col("grossTonnage") > above))
    return _listing(typed, {"name": "name", "tonnage": "grossTonnage", "flag": "flag", "type": "vessel_type", "record_id": "record_id"}, F.col("tonnage").desc())


def fleet_figures(vessels: DataFrame) -> DataFrame:
    return vessels.agg(F.count(F.lit(1)).alias("total_vessels"), F.bround(F.avg("grossTonnage"), 2).alias("avg_tonnage"), F.bround(F.avg("builtYear"), 2).alias("avg_year"))


#: Predefined analytics by topic: whole words decide, the first topic that has one wins. The words are fixed values.
TOPICS = (
    ("energy tanker tankers oil strategic", large_tankers),
    ("jurisdiction flag flags distribution global map", types_by_flag),
    ("aging old oldest risk maintenance compliance lifecycle", oldest),
    ("premium mega ultra large largest high value capacity flagship", largest),
    ("fleet statistics market intelligence analytics overview", fleet_figures),
)


def predefined(vessels: DataFrame, message: str) -> DataFrame | None:
    """The rows of the first topic that the message names, or None."""
    words = set(re.findall(r"\w+", message.lower()))
    return next((report(vessels) for topic, report in TOPICS if words & set(topic.split())), None)
