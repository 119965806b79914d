"""One query text for two engines: what Spark SQL and the DuckDB oracle spell differently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Dialect:
    spark: bool
    folder: str = ""
    #: With a session, what a query fits on its data first (``fitted``) becomes literals of its plan.
    session: SparkSession | None = field(default=None, compare=False)
    fits: dict = field(default_factory=dict, compare=False)

    def t(self, table: str) -> str:
        return f"parquet.`{self.folder}/{table}.parquet`" if self.spark else table

    def text(self, s: str) -> str:
        """A string literal, taken as it stands."""
        return "r'" + s + "'" if self.spark and "\\" in s else "'" + s.replace("'", "''") + "'"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)}" + (")" if self.spark else ", 'g')")

    def matches(self, x: str, pattern: str) -> str:
        """How often the pattern occurs."""
        return f"CAST(regexp_count({x}, {self.text(pattern)}) AS BIGINT)" if self.spark else f"len(regexp_extract_all({x}, {self.text(pattern)}))"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def pct(self, x: str, q: float) -> str:
        return f"percentile({x}, {q}D)" if self.spark else f"quantile_cont({x}, {q})"

    def pcts(self, x: str, qs) -> str:
        """An array of interpolated percentiles, from one aggregate."""
        values = ", ".join(f"{q}D" if self.spark else str(q) for q in qs)
        return f"percentile({x}, array({values}))" if self.spark else f"quantile_cont({x}, [{values}])"

    def when(self, condition: str) -> str:
        """How many rows hold the condition."""
        return f"count(*) FILTER (WHERE {condition})"

    def fitted(self, rows: str, x: str, qs) -> str | None:
        """An array of exact percentiles of a query's column, fitted by bracketing; None without a session."""
        if self.session is None:
            return None
        if (rows, x) not in self.fits:
            self.fits[rows, x] = {}
        known = self.fits[rows, x]
        if new := [q for q in qs if q not in known]:
            found = exact_quantiles(self.session.sql(f"SELECT {x} AS x FROM ({rows}) f"), "x", new) or [None] * len(new)
            known.update(zip(new, found))
        return self.array(*("CAST(NULL AS DOUBLE)" if known[q] is None else f"{known[q]!r}D" for q in qs))

    def micros(self, x: str) -> str:
        """Microseconds of a timestamp without zone, taken as UTC."""
        return f"unix_micros(CAST({x} AS TIMESTAMP))" if self.spark else f"epoch_us({x})"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
        return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def each(self, values: str, name: str) -> str:
        """A table with one row for each element of an array."""
        return f"(SELECT explode({values}) AS {name})" if self.spark else f"(SELECT unnest({values}) AS {name})"

    def array(self, *values) -> str:
        inner = ", ".join(map(str, values))
        return f"array({inner})" if self.spark else f"[{inner}]"

    def chars(self, x: str) -> str:
        return f"split({x}, '')" if self.spark else f"string_split({x}, '')"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.text(by)})" if self.spark else f"regexp_split_to_array({x}, {self.text(by)})"

    def map(self, xs: str, name: str, body: str) -> str:
        return f"transform({xs}, {name} -> {body})" if self.spark else f"list_transform({xs}, lambda {name}: {body})"

    def keep(self, xs: str, name: str, body: str) -> str:
        return f"filter({xs}, {name} -> {body})" if self.spark else f"list_filter({xs}, lambda {name}: {body})"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, '{by}')" if self.spark else f"array_to_string({xs}, '{by}')"

    def at(self, xs: str, i: str) -> str:
        """Element counted from 1; null beyond the end."""
        return f"try_element_at({xs}, CAST({i} AS INT))" if self.spark else f"({xs})[{i}]"

    def size(self, xs: str) -> str:
        return f"CAST(size({xs}) AS BIGINT)" if self.spark else f"len({xs})"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.spark else f"generate_series({a}, {b})"


Text = Callable[[Dialect], str]


def catalogue(texts: dict[str, Text], rows_only: frozenset[str] = frozenset()) -> tuple[dict, dict[str, str]]:
    """The Spark callables and the oracle SQL of a module's query texts."""

    def runner(text: Text):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text(Dialect(True, sf_dir, spark)))

        return run

    queries = {name: runner(text) for name, text in texts.items()}
    return queries, {name: text(Dialect(False)) for name, text in texts.items() if name not in rows_only}
