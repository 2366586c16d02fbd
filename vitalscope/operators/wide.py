"""The structured block for tables of any shape and categories of any number.

Category values get codes in alphabetical order from a dictionary table: the values are sorted by
ranges over all tasks, and a value's code is its place in its range plus the sizes of the
ranges before it. The dictionary stays a table. Rows meet it by a join that is safe for hot values, and
the block is put together as a sparse vector per row, so its width costs nothing but its entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import repair, text as tx
from ..session import checkpointed
from .quantiles import exact_quantiles
from .skew import lookup_join


def value_codes(values: DataFrame, column: str, value: str) -> DataFrame:
    """column, value, code: places from 0 of each column's values in alphabetical order.

    ``values`` has every (column, value) once. No column is sorted in one task.
    """
    placed = values.repartitionByRange(column, value).sortWithinPartitions(column, value)
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    # One row per column and range.
    sizes = placed.groupBy(column, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(column).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(column).alias("_c"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), (F.col(column) == F.col("_c")) & (F.col("_part") == F.col("_p")))
    return joined.select(column, value, (F.col("_before") + F.col("_at") - F.col("_first")).alias("code"))


@dataclass
class WideStructured:
    """Medians, means and deviations of the numbers, and the dictionary of the categories."""

    numeric: list[str]
    categorical: list[str]
    missing: str = "MISSING"
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)  # values of each category
    codes: DataFrame | None = None  # name, value, code

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str], missing: str = "MISSING") -> WideStructured:
        out = cls(list(numeric), list(categorical), missing)
        found = exact_quantiles(df, {c: repair.finite_number(F.col(c)) for c in numeric}, [0.5])
        out.medians = {c: 0.0 if found[c][0] is None else found[c][0] for c in numeric}
        if numeric:
            filled = {c: F.coalesce(repair.finite_number(F.col(c)), F.lit(out.medians[c])) for c in numeric}
            row = df.agg(*[f(x).alias(f"{n}{c}") for c, x in filled.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            out.means = {c: float(row[f"m{c}"] or 0.0) for c in numeric}
            out.sds = {c: float(row[f"s{c}"] or 0.0) or 1.0 for c in numeric}
        if categorical:
            cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), out._value(c).alias("value")) for c in categorical]))
            values = df.select(cells.alias("cell")).select("cell.*").distinct()
            out.codes = checkpointed(value_codes(values, "name", "value"))
            out.sizes = {r["name"]: r["n"] for r in out.codes.groupBy("name").agg(F.count("*").alias("n")).collect()}
        return out

    def _value(self, name: str):
        return tx.as_text(F.col(name), self.missing)

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(self.sizes.get(c, 0) for c in self.categorical)

    def scaled(self, name: str):
        filled = F.coalesce(repair.finite_number(F.col(name)), F.lit(self.medians[name]))
        return (filled - self.means[name]) / self.sds[name]

    def add_codes(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        """A column per category with its code; null for a value that was not fitted."""
        for c in self.categorical:
            own = self.codes.filter(F.col("name") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}{suffix}"))
            df = lookup_join(df.withColumn("_value", self._value(c)), own, "_value").drop("_value")
        return df

    def add_block(self, df: DataFrame, out: str = "structured") -> DataFrame:
        """The scaled numbers, then one flag per category value; a value that was not fitted has no flag."""
        kept = df.columns
        coded = self.add_codes(df, "__code")
        shown, parts = [F.col(c) for c in kept], []
        if self.numeric:
            shown.append(array_to_vector(F.array(*[self.scaled(c) for c in self.numeric])).alias("__numbers"))
            parts.append("__numbers")
        flagged = [c for c in self.categorical if self.sizes.get(c)]
        for c in flagged:
            # The sizes are known, so no stage looks at the data for them.
            facts = {"ml_attr": {"type": "nominal", "num_vals": self.sizes[c]}}
            code = F.coalesce(F.col(f"{c}__code"), F.lit(self.sizes[c])).cast("double")
            shown.append(code.alias(f"{c}__code", metadata=facts))
            parts.append(f"{c}__flags")
        rows = coded.select(*shown)
        if flagged:
            encoder = OneHotEncoder(
                inputCols=[f"{c}__code" for c in flagged], outputCols=[f"{c}__flags" for c in flagged], dropLast=True, handleInvalid="keep")
            rows = encoder.fit(rows).transform(rows)
        return VectorAssembler(inputCols=parts, outputCol=out).transform(rows).select(*kept, out)


def generic_structured(df: DataFrame, exclude=()) -> WideStructured:
    """Split the columns of any table by type and fit the structured block.

    A null is the category MISSING; a category that was not fitted has no flag.
    """
    numeric = [
        c for c, t in df.dtypes
        if c not in exclude and (t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"))
    ]
    return WideStructured.fit(df, numeric, [c for c, t in df.dtypes if c not in exclude and t == "string"])
