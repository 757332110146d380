"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). Tokens of a pattern may be used up to ``repeats`` times; the r-th use
costs 2r - 1, so the flow repeats nothing while fresh tokens are left and spreads
repetition evenly. Patterns send tokens to the quotas of their sources. What the
flow takes from a pattern is drawn from its documents in a seeded order.

Only sources and patterns reach the driver, both behind a checked bound. The draw
is a histogram of the seeded order (4,096 bins a pattern) plus running sums inside
a bin, so a source with a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.blocks import text_or_empty
from docflow.session import cut_lineage

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
MAX_PATTERNS = 20_000
BIN_DIGITS = 3


def target_tokens(sizes: dict, weights: dict, share: Fraction, limit: int = 2) -> dict:
    """Tokens per source: ``share`` of all by weight, at most ``limit`` times its size, the excess reshared."""
    left = share * sum(sizes.values())
    targets, free = {}, set(sizes)
    while free:
        weight = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] > limit * sizes[s] * weight}
        if not above:
            return targets | {s: left * weights[s] / weight for s in free}
        for s in above:
            targets[s] = Fraction(limit * sizes[s])
            left -= targets[s]
        free -= above
    return targets


class Flow:
    """Flow by blocking flows along levels of a breadth-first search."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for start, end, r in ((a, b, room), (b, a, 0)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level, queue = [-1] * len(self.out), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level if level[sink] >= 0 else None

    def run(self, source: int, sink: int) -> None:
        """Send as much more as there is room for."""
        while (level := self._levels(source, sink)) is not None:
            tried, path, at = [0] * len(self.out), [], source
            while True:
                if at == sink:
                    amount = min(self.room[e] for e in path)
                    full = None
                    for i, e in enumerate(path):
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                        if not self.room[e] and full is None:
                            full = i
                    at = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.out[at]
                while tried[at] < len(arcs) and not (self.room[e := arcs[tried[at]]] and level[self.to[e]] == level[at] + 1):
                    tried[at] += 1
                if tried[at] < len(arcs):
                    path.append(arcs[tried[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple, int]:
    """Tokens taken from each pattern, given pattern sizes and source quotas in tokens.

    Only the arc that leads to a pattern has a cost, and the r-th use of all patterns
    costs the same, less than any later use. Cheapest paths first is therefore layer by
    layer: all that first uses can send, then what second uses add to it, and so on.
    """
    order, sources = list(patterns), list(quotas)
    sink = 1 + len(order) + len(sources)
    flow = Flow(sink + 1)
    at = {s: 1 + len(order) + i for i, s in enumerate(sources)}
    for i, p in enumerate(order, 1):
        for s in p:
            flow.arc(i, at[s], repeats * patterns[p])
    for s in sources:
        flow.arc(at[s], sink, quotas[s])
    supply: list[list[int]] = [[] for _ in order]
    for _ in range(repeats):
        for i, p in enumerate(order, 1):
            supply[i - 1].append(flow.arc(0, i, patterns[p]))
        flow.run(0, sink)
    return {p: sum(map(flow.used, arcs)) for p, arcs in zip(order, supply, strict=True)}


def source_weights(sources: list) -> dict:
    """3, 1, 2, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: Fraction = Fraction(3, 2), repeats: int = 2, seed: str = "mix", max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken, and ``copies`` = rows the mix needs of it.

    ``source_col`` holds a string or an array of strings (overlapping sources: the
    document counts for each of them; ``source_size`` and ``target`` are then sums
    over its sources). Null is a source of its own, null text has size 0. A source
    without words has target 0. Order within a pattern is the MD5 of seed and id, so
    reruns agree; the document at the border gives only the words that are missing.
    Rows that repeat an id are drawn separately, in the order of their sizes.
    More than ``max_patterns`` patterns raise an error rather than being cut.
    An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[source_col]
    member = F.array(F.col(source_col).cast("string")) if not kind.startswith("array") else F.when(
        F.size(source_col) > 0, F.array_sort(F.array_distinct(F.col(source_col).cast("array<string>")))
    ).otherwise(F.array(F.lit(None).cast("string")))
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(member, F.array(F.lit(None).cast("string"))).alias("pattern"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("-", F.lit(seed), F.col(id_col).cast("string"))).alias("draw"),
    ))
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    found = totals.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = target_tokens(sizes, source_weights(list(sizes)), share, repeats)
    # an overlapping document counts for several sources, but a token is routed once
    taken = route(patterns, {s: int(round(float(t), 6)) for s, t in targets.items()}, repeats)
    plan = docs.sparkSession.createDataFrame(
        [(list(p), sum(sizes[s] for s in p), round(float(sum(targets[s] for s in p)), 6),
          taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in patterns.items()],
        "pattern array<string>, source_size long, target double, whole long, rest long",
    )
    binned = sized.withColumn("bin", F.substring("draw", 1, BIN_DIGITS))
    bins = binned.groupBy("pattern", "bin").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("n")
    # a row per pattern, at most max_patterns: the bin in which its draw ends
    border = bins.withColumn("before", before).join(F.broadcast(plan.select("pattern", "rest")), "pattern").where(
        "before <= rest and rest < before + n"
    ).select("pattern", F.col("bin").alias("last_bin"), "before")
    plan = plan.join(border, "pattern", "left")
    inside = Window.partitionBy("pattern", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    drawn = binned.withColumn("ahead", F.sum("size").over(inside) - F.col("size"))
    extra = F.when(F.col("bin") < F.col("last_bin"), F.col("size")).when(
        F.col("bin") == F.col("last_bin"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead"))),
    ).otherwise(F.lit(0))
    out = drawn.join(F.broadcast(plan), "pattern").withColumn("taken", F.col("whole") * F.col("size") + extra)
    return out.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int").alias("copies"),
    )
