"""Chains of ordered rows by a rule that depends on what the chain has become.

A row joins the open chain or starts a new one, which no window can express. Keys that
fit a task are folded in one pass over their sorted rows, wherever the hash of the key
puts them, and leave it as one row per chain. Larger
keys are cut into range partitions. A piece is folded as if a chain started with it;
the summary that a piece hands to its right is the open chain at its end, and pieces
whose left neighbour hands on something new are folded again until no summary changes.
Most pieces start a new chain of their own soon, so their summary stays as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators.ordered import GROUP_ROWS, Slicing, slicing

# What a row is compared with and becomes part of: its inputs, folded over the chain.
State = tuple
SLICE_SHIFT = 40


@dataclass(frozen=True)
class Rule:
    """``join(state, row)`` gives the state of the longer chain, or None for a new one."""

    inputs: tuple[str, ...]
    join: Callable[[State, tuple], State | None]


class _Fold:
    """Chain numbers of rows that come key by key in order, from what the left side left open."""

    def __init__(self, rule: Rule, carry: dict[int, tuple]):
        self.rule, self.carry = rule, carry
        self.slice = None
        self.key, self.state, self.chain, self.count = None, None, 0, 0

    def enter(self, slice_no: int) -> None:
        self.slice = slice_no
        self.key, self.state, self.chain = self.carry.get(slice_no, (None, None, 0))
        self.count = slice_no << SLICE_SHIFT

    def add(self, key: int, row: tuple) -> int:
        merged = self.rule.join(self.state, row) if key == self.key and self.state is not None else None
        if merged is None:
            self.count += 1
            self.key, self.state, self.chain = key, row, self.count
        else:
            self.state = merged
        return self.chain


def _numbers(rule: Rule, carry: dict[int, tuple]):
    """Column function over (slice, key, inputs) of sorted rows: the chain of each row."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fold = _Fold(rule, carry)
        for batch in batches:
            out = []
            for slice_no, key, *row in batch.itertuples(index=False, name=None):
                if slice_no != fold.slice:
                    fold.enter(slice_no)
                out.append(fold.add(key, tuple(row)))
            yield pd.Series(out, dtype="int64")

    return run.asNondeterministic()  # it reads rows in order, so the sort below it has to stay


def _summaries(rule: Rule, carry: dict[int, tuple]):
    """Task over sorted slices: first key, last key and the open chain at the end of each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        fold, first = _Fold(rule, carry), None

        def summary() -> pa.RecordBatch:
            end = pickle.dumps((first, fold.key, fold.state, fold.chain))
            return pa.RecordBatch.from_arrays([pa.array([fold.slice], pa.int64()), pa.array([end])], names=["slice", "end"])

        for batch in batches:
            for slice_no, key, *row in batch.to_pandas().itertuples(index=False, name=None):
                if slice_no != fold.slice:
                    if fold.slice is not None:
                        yield summary()
                    fold.enter(slice_no)
                    first = key
                fold.add(key, tuple(row))
        if fold.slice is not None:
            yield summary()

    return task


def _settled(rows: DataFrame, rule: Rule) -> dict[int, tuple]:
    """What each slice gets from its left side. The driver sees one short row per slice and round."""
    import pickle

    carry: dict[int, tuple] = {}
    while True:
        ends = rows.mapInArrow(_summaries(rule, carry), "slice long, end binary").collect()
        found, before = {}, None
        for slice_no, (first, *end) in sorted((r["slice"], pickle.loads(bytes(r["end"]))) for r in ends):
            if before is not None and before[0] == first:
                found[slice_no] = tuple(before)
            before = end
        if found == carry:
            return carry
        carry = found


def _fields(rule: Rule, keys: list[str], slice_no: Column) -> list[Column]:
    return [slice_no.cast("long").alias("slice"), F.xxhash64(*keys).alias("key"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(rule.inputs))]


def with_chains(
    df: DataFrame, keys: list[str], order: list[str], rule: Rule, bounded: bool = False, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``_chain``, the number of a row's chain within its key; ``order`` is total within a key.

    ``bounded`` says that every key is known to be small.
    """
    plan = slicing(df, keys, order, group_rows, bounded=bounded)
    small = df if plan.large is None else plan.small_rows(df)
    dealt = small.repartition(*keys).sortWithinPartitions(*keys, *order)
    out = dealt.withColumn("_chain", _numbers(rule, {})(F.struct(*_fields(rule, keys, F.lit(0)))))
    if plan.large is None:
        return out
    return out.unionByName(_sliced_chains(df, plan, rule))


def _sliced_chains(df: DataFrame, plan: Slicing, rule: Rule) -> DataFrame:
    """Chains of the rows of large keys, slice by slice."""
    sliced = plan.sliced_rows(df)
    laid = sliced.repartition(plan.slices, "_slice").sortWithinPartitions("_slice", *plan.keys, *plan.order)
    fields = _fields(rule, plan.keys, F.col("_slice"))
    carry = _settled(laid.select(*fields), rule)
    return laid.withColumn("_chain", _numbers(rule, carry)(F.struct(*fields))).drop("_slice")


def _inputs(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[list]:
    """Columns as Python values; a null number is not a number, so it joins nothing."""
    columns = [batch[n] for n in names]
    return [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in columns]


def _nest(rule: Rule, keys: list[str], names: list[str]):
    """Task over sorted rows: a row per chain with its rows as an array; the open chain is held back."""

    def rows(chunk: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        offsets = pa.array([*starts, chunk.num_rows], pa.int32())
        items = pa.StructArray.from_arrays([chunk[n] for n in names], names=names)
        firsts = pa.array(starts, pa.int64())
        return pa.RecordBatch.from_arrays([*(chunk[k].take(firsts) for k in keys), pa.ListArray.from_arrays(offsets, items)], names=[*keys, "_p"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        held: list[pa.RecordBatch] = []  # rows of the open chain
        for batch in batches:
            starts = []
            places, given = zip(*(batch[k].to_pylist() for k in keys), strict=True), zip(*_inputs(batch, rule.inputs), strict=True)
            for at, (now, row) in enumerate(zip(places, given, strict=True)):
                merged = rule.join(state, row) if state is not None and now == key else None
                if merged is None:
                    starts.append(at)
                    key, state = now, row
                else:
                    state = merged
            if not starts:
                held.append(batch)
                continue
            if held or starts[0]:
                open_chain = pa.Table.from_batches([*held, batch.slice(0, starts[0])]).combine_chunks().to_batches()
                yield from (rows(b, [0]) for b in open_chain)
            last = starts[-1]
            if len(starts) > 1:
                yield rows(batch.slice(0, last).slice(starts[0]), [x - starts[0] for x in starts[:-1]])
            held = [batch.slice(last)]
        if held:
            yield from (rows(b, [0]) for b in pa.Table.from_batches(held).combine_chunks().to_batches())

    return task


def nested_chains(
    df: DataFrame, keys: list[str], order: list[str], rule: Rule, bounded: bool = False, group_rows: int = GROUP_ROWS,
    dealt: bool = False,
) -> DataFrame:
    """One row per chain: the keys and ``_p``, its rows in order as an array of structs of the other columns.

    ``dealt`` says that ``df`` is the narrow outcome of chains under the same keys, so the
    rows of a key lie in one task already; it needs ``bounded``.
    """
    names = [*order, *(c for c in df.columns if c not in keys and c not in order)]
    plan = slicing(df, keys, order, group_rows, bounded=bounded)
    small = df if plan.large is None else plan.small_rows(df)
    own, items = T.StructType([df.schema[k] for k in keys]), T.StructType([df.schema[n] for n in names])
    chosen = small.select(*keys, *names)
    laid = (chosen if dealt and bounded else chosen.repartition(*keys)).sortWithinPartitions(*keys, *order)
    out = laid.mapInArrow(_nest(rule, keys, names), T.StructType([*own.fields, T.StructField("_p", T.ArrayType(items))]))
    if plan.large is None:
        return out
    gathered = F.array_sort(F.collect_list(F.struct(*names))).alias("_p")
    return out.unionByName(_sliced_chains(df, plan, rule).groupBy(*keys, "_chain").agg(gathered).drop("_chain"))
