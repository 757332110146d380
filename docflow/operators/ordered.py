"""Ordered window columns that stay parallel when one key is very large.

A plain window runs each key in one task. Here keys with more rows than ``GROUP_ROWS``
are found first (one narrow aggregation). Their rows are range-partitioned by key and
the whole order, so a key spans as many partitions as it needs, whatever its leading
order column holds. Windows run per key and partition, and a prefix scan over one row
per partition and key brings each of them what lies before or behind it. Without large
keys the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import work_path

GROUP_ROWS = 1_000_000
MAX_SLICES = 20_000


def row_number() -> tuple[str, Column | None]:
    return ("row_number", None)


def lag(c: Column) -> tuple[str, Column | None]:
    return ("lag", c)


def lead(c: Column) -> tuple[str, Column | None]:
    return ("lead", c)


def running_sum(c: Column) -> tuple[str, Column | None]:
    return ("running_sum", c)


def running_min(c: Column) -> tuple[str, Column | None]:
    return ("running_min", c)


def running_max(c: Column) -> tuple[str, Column | None]:
    return ("running_max", c)


def last_known(c: Column) -> tuple[str, Column | None]:
    """Last non-null value up to and including the row."""
    return ("last_known", c)


@dataclass
class Slicing:
    """Keys, a total order, the large keys (none as a rule) and the partitions for their rows."""

    keys: list[str]
    order: list[str]
    large: DataFrame | None = None
    slices: int = 1

    def order_columns(self) -> list[Column]:
        return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in self.order]

    def _is_large(self, df: DataFrame) -> Column:
        met = [df[k].eqNullSafe(self.large[f"_k_{k}"]) for k in self.keys]
        on = met[0]
        for m in met[1:]:
            on = on & m
        return on

    def small_rows(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.large), self._is_large(df), "left_anti")

    def sliced_rows(self, df: DataFrame) -> DataFrame:
        """Rows of large keys with the number of their range partition, ``_slice``.

        Written out, so that a lost executor cannot deal rows to other partitions
        than those that were summed up.
        """
        rows = df.join(F.broadcast(self.large), self._is_large(df), "left_semi")
        dealt = rows.repartitionByRange(self.slices, *self.keys, *self.order_columns())
        placed = dealt.withColumn("_slice", F.spark_partition_id())
        path = work_path(df.sparkSession, "sliced")
        placed.write.parquet(path)
        return df.sparkSession.read.schema(placed.schema).parquet(path)


def groups_fit(df: DataFrame, keys: list[str], group_rows: int = GROUP_ROWS) -> bool:
    """True if no key has more than ``group_rows`` rows. One narrow aggregation."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) <= group_rows


def slicing(
    df: DataFrame, keys: list[str], order: list[str], group_rows: int = GROUP_ROWS,
    bounded: bool = False,
) -> Slicing:
    """Find large keys.

    ``order`` must be total within a key; a leading ``-`` means descending. A key is
    large beyond ``group_rows`` rows and beyond a part in MAX_SLICES of all rows, so
    there are at most MAX_SLICES of them, and as many partitions for their rows.
    ``bounded`` says that the caller already knows every key to be small
    (``groups_fit`` on an input that the rows come from), so nothing is counted again.
    """
    plan = Slicing(list(keys), list(order))
    if bounded:
        return plan
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not largest or largest <= group_rows:
        return plan
    size = max(group_rows, total // MAX_SLICES + 1)
    large = counts.where(F.col("_n") > size).toDF(*[f"_k_{k}" for k in keys], "_n").collect()
    if not large:
        return plan
    fields = [f for f in counts.schema.fields if f.name != "_n"]
    kinds = ", ".join(f"`_k_{f.name}` {f.dataType.simpleString()}" for f in fields)
    plan.large = df.sparkSession.createDataFrame([tuple(r)[:-1] for r in large], kinds)
    plan.slices = max(2, -(-sum(r["_n"] for r in large) // size))
    return plan


def ordered(df: DataFrame, plan: Slicing, **columns: tuple[str, Column | None]) -> DataFrame:
    """Add window ``columns`` (``row_number()``, ``lag(c)``, ...) under ``plan``."""
    order = plan.order_columns()
    if plan.large is not None:
        small = ordered(plan.small_rows(df), Slicing(plan.keys, plan.order), **columns)
        return small.unionByName(_ordered_slices(plan.sliced_rows(df), plan, df.columns, columns))
    w = Window.partitionBy(*plan.keys).orderBy(*order)
    return df.select("*", *[_local(k, c, w).alias(n) for n, (k, c) in columns.items()])


def _local(kind: str, c: Column | None, w: Window) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "row_number": lambda: F.row_number().over(w).cast("bigint"),
        "lag": lambda: F.lag(c).over(w),
        "lead": lambda: F.lead(c).over(w),
        "running_sum": lambda: F.sum(c).over(upto),
        "running_min": lambda: F.min(c).over(upto),
        "running_max": lambda: F.max(c).over(upto),
        "last_known": lambda: F.last(c, ignorenulls=True).over(upto),
    }[kind]()


def _ordered_slices(base: DataFrame, plan: Slicing, names: list[str], columns: dict) -> DataFrame:
    """Windows per key and slice, corrected by what the other slices of the key hold."""
    w = Window.partitionBy(*plan.keys, "_slice").orderBy(*plan.order_columns())

    # The inputs are kept as columns so that slices can be summed up below.
    raw = base.select(
        "*",
        *[c.alias(f"_in_{n}") for n, (_, c) in columns.items() if c is not None],
        F.row_number().over(w).cast("bigint").alias("_rn"),
        F.lead(F.lit(1)).over(w).isNull().alias("_is_last"),
    )
    rows = raw.select(
        "*",
        *[
            _local(k, F.col(f"_in_{n}") if c is not None else None, w).alias(f"_loc_{n}")
            for n, (k, c) in columns.items()
        ],
    )

    # one row per slice and key: at most MAX_SLICES slices and as many keys that begin inside one
    sums = [F.count(F.lit(1)).alias("_e_count")]
    for n, (k, _) in columns.items():
        v = F.col(f"_in_{n}") if k != "row_number" else None
        sums += {
            "row_number": lambda: [],
            "lag": lambda: [F.max_by(F.struct(v.alias("v")), F.col("_rn")).alias(f"_e_{n}")],
            "lead": lambda: [F.min_by(F.struct(v.alias("v")), F.col("_rn")).alias(f"_e_{n}")],
            "running_sum": lambda: [F.sum(v).alias(f"_e_{n}")],
            "running_min": lambda: [F.min(v).alias(f"_e_{n}")],
            "running_max": lambda: [F.max(v).alias(f"_e_{n}")],
            "last_known": lambda: [
                F.max_by(v, F.when(v.isNotNull(), F.col("_rn"))).alias(f"_e_{n}")
            ],
        }[k]()
    edges = rows.groupBy(*plan.keys, "_slice").agg(*sums)
    by_slice = Window.partitionBy(*plan.keys).orderBy("_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_e_count").over(before).alias("_c_count")]
    for n, (k, _) in columns.items():
        if k == "row_number":
            continue
        e = F.col(f"_e_{n}")
        carried.append(
            {
                "lag": lambda: F.lag(e).over(by_slice),
                "lead": lambda: F.lead(e).over(by_slice),
                "running_sum": lambda: F.sum(e).over(before),
                "running_min": lambda: F.min(e).over(before),
                "running_max": lambda: F.max(e).over(before),
                "last_known": lambda: F.last(e, ignorenulls=True).over(before),
            }[k]().alias(f"_c_{n}")
        )
    carry = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in plan.keys], F.col("_slice").alias("_k_slice"), *carried
    )
    met = F.col("_slice") == F.col("_k_slice")
    for k in plan.keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(F.broadcast(carry), met)

    def whole(n: str, k: str) -> Column:
        here, carried_in = F.col(f"_loc_{n}"), F.col(f"_c_{n}") if k != "row_number" else None
        return {
            "row_number": lambda: here + F.coalesce(F.col("_c_count"), F.lit(0)),
            "lag": lambda: F.when(F.col("_rn") == 1, carried_in["v"]).otherwise(here),
            "lead": lambda: F.when(F.col("_is_last"), carried_in["v"]).otherwise(here),
            "running_sum": lambda: F.when(
                here.isNotNull() | carried_in.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(carried_in, F.lit(0)),
            ),
            "running_min": lambda: F.least(here, carried_in),
            "running_max": lambda: F.greatest(here, carried_in),
            "last_known": lambda: F.coalesce(here, carried_in),
        }[k]()

    return joined.select(
        *[F.col(c) for c in names], *[whole(n, k).alias(n) for n, (k, _) in columns.items()]
    )
