"""Small sequential rules over the rows of one document.

Packing text into chunks depends on the running length, which no window can
express. These helpers see lengths and flags only and return positions; the
text itself never leaves the JVM.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT = T.IntegerType()


def pack(
    lengths: Sequence[int], max_chars: int, min_chars: int, overlap: int, gap: int,
    breaks=None, alone=None,
) -> list[tuple[int, int]]:
    """Greedy ranges ``[start, end)`` of consecutive parts.

    A range closes before a part that would exceed ``max_chars`` once it has
    ``min_chars``, or when it reaches ``max_chars``. The next one begins
    ``overlap`` parts earlier. ``breaks(first, at, size)`` may close it earlier;
    parts for which ``alone(at)`` holds form a range by themselves.
    """
    out, start, n = [], 0, len(lengths)
    while start < n:
        if alone and alone(start):
            out.append((start, start + 1))
            start += 1
            continue
        size, end = lengths[start], start + 1
        while end < n and size < max_chars:
            if (alone and alone(end)) or (breaks and breaks(start, end, size)):
                break
            grown = size + gap + lengths[end]
            if grown > max_chars and size >= min_chars:
                break
            size, end = grown, end + 1
        out.append((start, end))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def split_points(lengths, max_chars, min_chars, gap, similarity=None, threshold=0.0, paths=None):
    """Starts of non-overlapping ranges, cut by size, by similarity and by path."""
    starts, size, path = [], 0, None
    for i, length in enumerate(lengths):
        cut = False
        if size and similarity is None:
            cut = size + length > max_chars
        elif size and size >= min_chars:
            cut = size + length > max_chars or similarity[i - 1] < threshold
        if size and paths is not None and path and paths[i] and path != paths[i]:
            cut = True
        if not starts or cut:
            starts.append(i)
            size, path = length, None
        else:
            size += gap + length
        if paths is not None and not path:
            path = paths[i] or None
    return starts


def _list(v) -> list | None:
    return None if v is None else list(v)


def _records(ranges) -> list[dict]:
    return [{"s": int(s), "e": int(e)} for s, e in ranges]


def heading_of(first: int, end: int, places: Sequence[int], heads: Sequence[int]) -> int | None:
    """Block of the nearest heading above the first part in the range that has one."""
    for at in range(first, end):
        above = bisect_left(heads, places[at])
        if above:
            return int(heads[above - 1])
    return None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", INT), T.StructField("e", INT), T.StructField("head", INT)])))
def pack_udf(
    lengths: pd.Series, places: pd.Series, heads: pd.Series,
    max_chars: pd.Series, min_chars: pd.Series, overlap: pd.Series,
) -> pd.Series:
    out = []
    for n, at, top, mx, mn, ov in zip(lengths, places, heads, max_chars, min_chars, overlap):
        if n is None:
            out.append(None)
            continue
        at, top = list(at), list(top)
        out.append(
            [
                {"s": s, "e": e, "head": heading_of(s, e, at, top)}
                for s, e in pack(list(n), mx, mn, ov, 2)
            ]
        )
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", INT), T.StructField("e", INT)])))
def pack_segments_udf(
    lengths: pd.Series, kinds: pd.Series, paths: pd.Series, strategy: pd.Series,
    max_chars: pd.Series, min_chars: pd.Series, overlap: pd.Series,
) -> pd.Series:
    out = []
    for n, kind, path, how, mx, mn, ov in zip(
        lengths, kinds, paths, strategy, max_chars, min_chars, overlap
    ):
        if n is None:
            out.append(None)
            continue
        kind, path = list(kind), list(path)

        def breaks(first, at, size, kind=kind, path=path, how=how, mn=mn):
            if size < mn:
                return False
            if how == "paper" and kind[at] in ("caption", "table", "figure"):
                return True
            here = next((p for p in path[first:at] if p and p.strip()), None)
            new = path[at]
            return bool(here and new and new.strip() and here != new)

        def alone(at, kind=kind, how=how):
            return how == "table" and kind[at] in ("table", "caption")

        out.append(_records(pack(list(n), mx, mn, ov, 2, breaks, alone)))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def split_points_udf(
    lengths: pd.Series, similarity: pd.Series, paths: pd.Series, threshold: pd.Series,
    max_chars: pd.Series, min_chars: pd.Series, gap: pd.Series,
) -> pd.Series:
    return pd.Series(
        [
            None
            if n is None
            else split_points(_list(n), mx, mn, g, _list(sim), th, _list(p))
            for n, sim, p, th, mx, mn, g in zip(
                lengths, similarity, paths, threshold, max_chars, min_chars, gap
            )
        ]
    )


@F.pandas_udf(T.ArrayType(T.ArrayType(INT)))
def heading_stack_udf(levels: pd.Series) -> pd.Series:
    """For every block the positions of the headings above it, outermost first."""
    out = []
    for row in levels:
        if row is None:
            out.append(None)
            continue
        stack, here = [], []
        for at, level in enumerate(row):
            if level > 0:
                stack = [*stack[: level - 1], at]
            here.append(stack)
        out.append(here)
    return pd.Series(out)
