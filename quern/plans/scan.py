"""The one-table scan builder: columns, computed columns, simple conditions, groups, order, limit; it lowers to DataFrame calls.

    scan(df).columns("a", "b").where("a", ">", 1).group_by("b", total=("sum", "a")).having("total", ">", 10).order_by("-total").limit(10).run()
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.predicates import legacy_like
from quern.operators.relational import aggregate, limit
from quern.plans.infix import infix

#: The seven condition kinds, and the four functions that groups may use.
CONDITIONS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "!=": lambda a, b: a != b,
    "like": legacy_like,
}
FUNCTIONS = ("sum", "count", "max", "min")


class Scan:
    def __init__(self, df: DataFrame):
        self._df, self._columns, self._computed, self._where, self._having = df, [], {}, [], []
        self._infix: dict[str, Column] = {}
        self._keys, self._aggs, self._order, self._limit, self._offset, self._ratios = [], {}, [], None, 0, {}

    def columns(self, *names: str) -> Scan:
        self._columns += names
        return self

    def compute(self, **expressions: str) -> Scan:
        """Columns from expressions over the table's columns."""
        self._computed |= expressions
        return self

    def infix(self, **expressions: str) -> Scan:
        """Columns from expressions of the small infix language over backquoted columns."""
        self._infix |= {n: infix(e) for n, e in expressions.items()}
        return self

    def where_infix(self, condition: str) -> Scan:
        """A condition of the infix language."""
        self._where.append(infix(condition))
        return self

    def where(self, name: str, kind: str, value) -> Scan:
        """All conditions must hold."""
        self._where.append(CONDITIONS[kind](F.col(name), F.lit(value)))
        return self

    def any_of(self, name: str, values: list) -> Scan:
        self._where.append(F.col(name).isin(values))
        return self

    def between(self, name: str, low=None, high=None) -> Scan:
        """A key range, both ends included."""
        if low is not None:
            self.where(name, ">=", low)
        return self if high is None else self.where(name, "<=", high)

    def group_by(self, *keys: str, **aggs: tuple[str, str]) -> Scan:
        for name, (function, _) in aggs.items():
            if function not in FUNCTIONS:
                raise ValueError(f"{name}: groups have {', '.join(FUNCTIONS)} only")
        self._keys += keys
        self._aggs |= aggs
        return self

    def ratio(self, **expressions: str) -> Scan:
        """Columns from expressions over the groups' columns; a division by zero is NULL."""
        self._ratios |= expressions
        return self

    def having(self, name: str, kind: str, value) -> Scan:
        self._having.append(CONDITIONS[kind](F.col(name), F.lit(value)))
        return self

    def order_by(self, *names: str) -> Scan:
        """A name with a leading minus is descending."""
        self._order += names
        return self

    def limit(self, n: int, offset: int = 0) -> Scan:
        self._limit, self._offset = n, offset
        return self

    def topk_precision(self, rows: int, precision: float) -> Scan:
        """Accepted and without effect: top groups are exact here."""
        return self

    def run(self) -> DataFrame:
        every = lambda cs: reduce(lambda a, b: a & b, cs)
        df = self._df.withColumns({**{n: F.expr(e) for n, e in self._computed.items()}, **self._infix})
        if self._where:
            df = df.filter(every(self._where))
        shown: list[Column | str] = [*self._columns, *self._computed, *self._infix]
        if self._aggs or self._keys:
            df = df.groupBy(*self._keys).agg(*[aggregate(f, c).alias(n) for n, (f, c) in self._aggs.items()])
            shown = [*self._keys, *self._aggs]
        if self._ratios:
            df = df.withColumns({n: F.expr(e) for n, e in self._ratios.items()})
            shown += self._ratios
        if self._having:
            df = df.filter(every(self._having))
        if self._order:
            df = df.orderBy(*[F.desc_nulls_last(n[1:]) if n[0] == "-" else F.asc_nulls_first(n) for n in self._order])
        return limit(df.select(*shown) if shown else df, self._limit, self._offset)


def scan(df: DataFrame) -> Scan:
    return Scan(df)
