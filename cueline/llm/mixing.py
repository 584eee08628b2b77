"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that hold them (their membership pattern). A small
network routes words: each pattern offers its words once, twice, ... up to ``max_repeats`` times at
rising (convex) cost, each source takes up to its target. The flow fixes how many words each pattern
contributes; documents are then selected in a seeded order until that number is reached.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, returning, small_batches, small_side, with_row_id

#: Patterns that may be gathered on the driver. A corpus with more distinct source sets is refused.
MAX_PATTERNS = 100_000
#: Documents that a cell of the seeded order holds on average, and from which on a round takes no further cell one by one.
CELL_DOCS, TAIL_DOCS = 500, 1000


def with_word_count(df: DataFrame, text: str, out: str) -> DataFrame:
    """Replace ``text`` by the number of its words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.split() parts at exactly the six ASCII white-space characters
            n = [len(v.as_buffer().to_pybytes().split()) if v.is_valid else 0 for v in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, out])

    return df.withColumn(text, F.col(text).cast("binary")).mapInArrow(returning(count), schema)


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; a share stops at ``cap`` times its size, the excess is reshared."""
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * weights[i] > cap * sizes[i] * weight]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / weight if weight else 0.0
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            open_.discard(i)
        rest -= sum(target[i] for i in over)
    return target


class FlowNetwork:
    """Integer min-cost flow by successive shortest paths; made for hundreds of nodes."""

    def __init__(self) -> None:
        self.arcs: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: object, b: object, room: int, cost: int) -> int:
        for tail, head, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs.setdefault(tail, []).append(len(self.to))
            self.to.append(head)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start: object, end: object) -> int:
        moved = 0
        while True:
            far, via, queue, queued = {start: 0}, {}, deque([start]), {start}
            while queue:
                at = queue.popleft()
                queued.discard(at)
                for e in self.arcs.get(at, ()):
                    if self.room[e] > 0 and far[at] + self.cost[e] < far.get(self.to[e], 1 << 62):
                        far[self.to[e]], via[self.to[e]] = far[at] + self.cost[e], e
                        if self.to[e] not in queued:
                            queue.append(self.to[e])
                            queued.add(self.to[e])
            if end not in far:
                return moved
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            moved += step


def route(patterns: dict[str, int], members: dict[str, list], targets: dict, max_repeats: int) -> dict[str, int]:
    """Words that each pattern contributes. Repeats cost 0, 1, 4, 9, ... a word."""
    net, offers = FlowNetwork(), {}
    for p in sorted(patterns):
        offers[p] = [net.add("from", ("p", p), patterns[p], r * r) for r in range(max_repeats)]
        for s in members[p]:
            net.add(("p", p), ("s", s), patterns[p] * max_repeats, 0)
    for s, t in targets.items():
        net.add(("s", s), "to", round(t), 0)
    net.run("from", "to")
    return {p: sum(net.room[e ^ 1] for e in es) for p, es in offers.items()}


def _fill(sized: DataFrame, rest: dict[str, int], cells: int) -> tuple[dict[str, list[tuple[int, int, int]]], DataFrame | None]:
    """Rows that fill the rest of each pattern's words: spans of cells (first, past, largest size) that are taken whole, and rids taken one by one.

    A round takes whole cells until the next one would pass what is left, then rows one by one in the cells from there on that hold some TAIL_DOCS
    rows. The next round goes on after them. Rows larger than what is left are out; rounds end when no row is open.
    """
    spark, spans, parts = sized.sparkSession, {p: [] for p in rest}, []
    open_ = {p: (0, n) for p, n in rest.items() if n > 0}

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "draw", "tie", "size", "rid"], kind="stable")
        left, taken = int(rows["room"].iloc[0]) if len(rows) else 0, []
        for rid, size in zip(rows["rid"], rows["size"], strict=True):
            if size <= left:
                left -= size
                taken.append((rows["pattern"].iloc[0], rid, size))
        return pd.DataFrame(taken, columns=["pattern", "rid", "size"]).astype({"rid": "int64", "size": "int64"})

    w = Window.partitionBy("pattern").orderBy("cell")
    while open_:
        state = F.broadcast(spark.createDataFrame([(p, *x) for p, x in open_.items()], "pattern string, first long, left long"))  # at most MAX_PATTERNS rows
        rows = sized.join(state, "pattern").filter((F.col("cell") >= F.col("first")) & F.col("size").between(1, F.col("left")))
        filled = rows.groupBy("pattern", "cell", "left").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        filled = filled.withColumn("room", F.col("left") - F.sum("size").over(w) + F.col("size"))
        past = filled.filter(F.col("size") > F.col("room")).select("pattern", "cell", "room")
        past = filled.drop("room").join(past.groupBy("pattern").agg(F.min("cell").alias("edge"), F.max("room").alias("room")), "pattern")
        past = past.filter(F.col("cell") >= F.col("edge")).withColumn("seen", F.sum("docs").over(w) - F.col("docs")).filter(F.col("seen") < TAIL_DOCS)
        edges = past.groupBy("pattern", "edge", "room").agg(F.max("cell").alias("last")).collect()  # at most MAX_PATTERNS rows
        edge = {r["pattern"]: r for r in edges}
        for p, (first, left) in open_.items():
            spans[p].append((first, edge[p]["edge"] if p in edge else cells, left))
        if not edges:
            break
        edges = F.broadcast(spark.createDataFrame([tuple(r) for r in edges], "pattern string, edge long, room long, last long"))
        rows = rows.join(edges, "pattern").filter(F.col("cell").between(F.col("edge"), F.col("last")))
        rows = rows.select("pattern", "cell", "draw", F.xxhash64("key").alias("tie"), "size", "rid", "room")
        picked = Staged(rows.groupBy("pattern").applyInPandas(fill, "pattern string, rid long, size long"), "mix-picked").df
        parts.append(picked.select("rid"))
        used = {r["pattern"]: r["n"] for r in picked.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
        open_ = {p: (r["last"] + 1, r["room"] - used.get(p, 0)) for p, r in edge.items() if r["last"] + 1 < cells and r["room"] > used.get(p, 0)}
    return spans, reduce(DataFrame.union, parts) if parts else None


def _pattern(sources: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    return F.to_json(F.when(F.size(found) == 0, F.array(F.lit(None).cast("string"))).otherwise(found))


@dataclass
class Decision:
    """What the flow decided: the sized rows, the plan's row for each pattern, and the rows (rid) picked one by one."""

    sized: DataFrame
    plan: DataFrame
    picked: DataFrame | None
    cells: int
    draw: Callable[[Column, Column], Column]

    def repeats(self, cell: Column, size: Column, chosen: Column, plan: Column) -> Column:
        """How often a row is taken, by its pattern's plan."""
        whole = F.exists(plan["spans"], lambda x: (cell >= x["first"]) & (cell < x["past"]) & (size <= x["most"]))
        return F.when(size > 0, plan["full"] + F.coalesce(chosen, whole.cast("int"))).otherwise(0).cast("long")

    def cell(self, draw: Column) -> Column:
        return F.shiftrightunsigned(draw, 1) % F.lit(self.cells)


def _decide(
    docs: DataFrame, *, key: str, sources: Column, text: str = "text", weight: Callable[[int, str | None], float] = lambda i, s: 1.0 + i % 3,
    max_repeats: int = 3, budget: float = 1.0, seed: int = 7, order: Column | None = None,
) -> Decision:
    spark = docs.sparkSession
    sized = with_word_count(
        docs.select(F.col(key).alias("key"), _pattern(sources).alias("pattern"), F.col(text).alias("text"), (F.col(key) if order is None else order).alias("place")), "text", "size"
    )
    draw = lambda place, size: F.xxhash64(F.lit(seed), place, size)
    sized = Staged(sized.withColumns({"rid": F.monotonically_increasing_id(), "draw": draw(F.col("place"), F.col("size"))}).drop("place"), "mix-sizes").df

    by_pattern = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct sets of sources")
    words = {r["pattern"]: r["size"] for r in by_pattern}
    members = {p: json.loads(p) for p in words}
    names = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    of_source = dict.fromkeys(names, 0)
    for p, n in words.items():
        for s in members[p]:
            of_source[s] += n
    shares = capped_targets([of_source[s] for s in names], [weight(i, s) for i, s in enumerate(names)], budget * sum(words.values()), max_repeats)
    target = dict(zip(names, shares, strict=True))
    flow = route(words, members, target, max_repeats)

    rank = {s: i for i, s in enumerate(names)}
    cells = max(256, 1 << (max((r["docs"] for r in by_pattern), default=1) // CELL_DOCS).bit_length())
    sized = sized.withColumn("cell", F.shiftrightunsigned("draw", 1) % F.lit(cells))
    full = {p: flow[p] // n if n else 0 for p, n in words.items()}
    spans, picked = _fill(sized, {p: flow[p] - full[p] * n for p, n in words.items()}, cells)
    plan = []
    for p in words:
        first = min(members[p], key=rank.__getitem__)
        plan.append((p, of_source[first], target[first], full[p], spans.get(p, [])))
    schema = "pattern string, source_size long, target double, full long, spans array<struct<first: long, past: long, most: long>>"
    return Decision(sized, F.broadcast(spark.createDataFrame(plan, schema)), picked, cells, draw)  # the plan: at most MAX_PATTERNS rows


def mix(docs: DataFrame, *, key: str, sources: Column, **how) -> DataFrame:
    """Select documents so that each source's words come near its target.

    ``sources`` is an array of the sources that hold a document; ``weight(i, name)`` weighs the i-th
    source by code point, null last; ``text``, ``max_repeats``, ``budget``, ``seed`` and ``order`` may be given too. Returns a row for each
    input row: key, size, pattern (JSON list), source_size and target (of the pattern's first source by code point, null last), repeats, taken.

    Null text has size 0; rows of size 0 are taken 0 times. A null or empty source list counts as the
    null source. Rows with equal keys are selected one by one. An empty table gives an empty result.
    The order of selection depends on ``seed``, ``order`` (the key if not given) and size only, so reruns agree.
    """
    made = _decide(docs, key=key, sources=sources, **how)
    out = made.sized.join(made.plan, "pattern", "left")
    chosen = F.lit(None).cast("int")
    if made.picked is not None:
        out = out.join(made.picked.withColumn("chosen", F.lit(1)), "rid", "left")
        chosen = F.col("chosen")
    out = out.withColumn("repeats", made.repeats(F.col("cell"), F.col("size"), chosen, F.struct("full", "spans")))
    return out.select(F.col("key").alias(key), "size", "pattern", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, *, sources: Column, order: Column, text: str = "text", **how) -> DataFrame:
    """The rows that ``mix`` takes, with all their columns, a row for each time. Whole rows are not exchanged: what a row's number of times follows from is broadcast.

    The plan holds a row for each pattern; rows picked one by one are joined by an exchange only beyond ``BROADCAST_ROWS``.
    """
    rows, row = with_row_id(docs)
    made = _decide(rows, key=row, sources=sources, text=text, order=order, **how)
    # names that are free among the columns, in a struct apart
    own = f"{row}_own"
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    rows = rows.withColumn(own, F.struct(_pattern(sources).alias("pattern"), size.alias("size"), order.alias("place")))
    plan = made.plan.select(F.col("pattern").alias(f"{own}_pattern"), F.struct("full", "spans").alias(f"{own}_plan"))
    rows = rows.join(plan, F.col(own)["pattern"] == F.col(f"{own}_pattern"))
    chosen = F.lit(None).cast("int")
    if made.picked is not None:
        picked = Staged(made.sized.join(made.picked, "rid", "left_semi").select(F.col("key").alias(f"{own}_row")), "mix-taken").df
        rows = rows.join(small_side(picked), F.col(row) == F.col(f"{own}_row"), "left")
        chosen = F.when(F.col(f"{own}_row").isNotNull(), 1)
    size, plan = F.col(own)["size"], F.col(f"{own}_plan")
    cell = made.cell(made.draw(F.col(own)["place"], size))
    times = made.repeats(cell, size, chosen, plan)
    rows = rows.withColumn(f"{own}_times", times).filter(F.col(f"{own}_times") > 0)
    return rows.withColumn(f"{own}_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{own}_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
