"""Budgeted batches, framed text, resume and throughput."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.tables import kept


#: Rows of a block.
BLOCK = 8192


class _Costs:
    """What a block of rows does to the batch that is open before it.

    A state is what that batch has used, or budget + 1 where the next row begins a
    new one in any case.  Which row of the block begins the first new batch depends
    on the state; all that follows depends on that row alone.
    """

    def __init__(self, cost: np.ndarray, alone: np.ndarray, budget: int):
        n, own = len(cost), np.arange(len(cost))
        self.n, self.budget, self.upto = n, budget, np.cumsum(cost)
        before = self.upto - cost
        walls = np.append(np.flatnonzero(alone), n)
        self.wall = int(walls[0])
        after = np.minimum(np.maximum(np.searchsorted(self.upto, before + budget, "right"), own + 1), walls[np.searchsorted(walls, own + 1)] if n else own)
        self.next = np.where(alone, own + 1, after)
        # from each row on to the last batch that begins in the block, by doubling the steps
        self.count, last, jump = np.ones(n, np.int64), own.copy(), self.next.copy()
        while (live := np.flatnonzero(jump < n)).size:
            to = jump[live]
            self.count[live], last[live], jump[live] = self.count[live] + self.count[to], last[to], jump[to]
        used = np.minimum((self.upto[-1] if n else 0) - before[last], budget + 1)
        self.exit = np.where(alone[last], budget + 1, used)

    def begins(self) -> np.ndarray:
        """Rows that can begin the first new batch: up to one that no state lets pass, and none without costs."""
        most = min(int(np.searchsorted(self.upto, self.budget, "right")), self.wall, self.n - 1)
        rows = np.arange(most + 1)
        return rows[(rows == 0) | (np.diff(self.upto[: most + 1], prepend=-1) > 0) | (rows == self.wall)]

    def starts(self, state: int) -> np.ndarray:
        """Rows that begin batches."""
        out, at = [], min(int(np.searchsorted(self.upto, self.budget - state, "right")), self.wall)
        while at < self.n:
            out.append(at)
            at = int(self.next[at])
        return np.array(out, np.int64)


_LISTS = ["upto", "exit", "count"]


def _blocks(ordered: DataFrame, keys: list[str], budget: int, block: int) -> DataFrame:
    """One row for each block of sorted rows of a key: the rows, and what the block does to each state. `ordered` has keys, at, cost and alone."""

    def made(held: list[list[pa.Array]], part: int, number: int) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
        own = _Costs(columns[-2].to_numpy(), columns[-1].to_numpy(zero_copy_only=False), budget)
        rows = [pa.ListArray.from_arrays(pa.array([0, own.n], pa.int32()), c) for c in columns[len(keys) :]]
        begins = own.begins()
        lists = [pa.array([x[begins].tolist()], pa.list_(pa.int64())) for x in (own.upto, own.exit, own.count)]
        ends = [pa.array([own.wall < own.n]), pa.array([int(own.upto[-1])], pa.int64())]
        place = [pa.array([part], pa.int32()), pa.array([number], pa.int64())]
        return pa.RecordBatch.from_arrays([*(c[:1] for c in columns[: len(keys)]), *place, *rows, *lists, *ends], [*keys, "part", "number", "at", "cost", "alone", *_LISTS, "walled", "total"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        key, held, size = None, [], 0
        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            cuts = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1]), len(values)]
            for a, b in itertools.pairwise(cuts):
                while a < b:
                    if held and (values[a] != key or size == block):
                        yield made(held, part, number)
                        held, size, number = [], 0, number + 1
                    n = min(block - size, b - a)
                    held.append([c.slice(a, n) for c in batch.columns])
                    key, size, a = values[a], size + n, a + n
        if held:
            yield made(held, part, number)

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = f"at array<{kinds['at']}>, cost array<long>, alone array<boolean>"
    return ordered.select(*keys, "at", "cost", "alone").mapInArrow(work, f"{own}, part int, number long, {rows}, {', '.join(f'{x} array<long>' for x in _LISTS)}, walled boolean, total long")


def _entries(blocks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(part, number, state, batch): the state that each block begins in and the number of the batch open before it.

    The blocks of a key are folded in order, one number after the other: a block is
    one look-up here, whatever its rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, open_batch = None, budget + 1, -1
        for batch in batches:
            out = []
            values = zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)
            lists = [batch.column(x) for x in _LISTS]
            rest = zip(*(batch.column(x).to_pylist() for x in ("part", "number", "walled", "total")), strict=True)
            for k, (own, (part, number, walled, total)) in enumerate(zip(values, rest, strict=True)):
                if own != key:
                    key, state, open_batch = own, budget + 1, -1
                out.append((part, number, state, open_batch))
                upto, leave, count = (x[k].values.to_numpy() for x in lists)
                if not walled and state + total <= budget:
                    state += total
                    continue
                # the first row whose costs do not fit, or else the wall, which is the last one kept
                at = min(int(np.searchsorted(upto, budget - state, "right")), len(upto) - 1)
                state, open_batch = int(leave[at]), open_batch + int(count[at])
            kinds = [pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "number", "state", "batch"])

    small = blocks.select(*keys, "part", "number", *_LISTS, "walled", "total")
    return small.repartition(*keys).sortWithinPartitions(*keys, "part", "number").mapInArrow(work, "part int, number long, state long, batch long")


def greedy_batches(rows: DataFrame, keys: list[str], order: str, cost: str, budget: int, barrier: str | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, order, cost, batch): rows in order fill a batch until the budget; a barrier row is a batch of its own.

    A batch depends on all before it, yet the rows of one key are read by many
    tasks: sorted rows are cut into blocks, and a block is summed up by what it
    makes of each state it may begin in, at most one number for each row of a
    batch.  A fold over these gives the state at the begin of every block; then
    blocks are numbered independently.  Costs are not negative; null costs nothing.
    """
    alone = F.col(barrier) if barrier else F.lit(False)
    amount = F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    asked = rows.select(*keys, F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")).alias("at"), amount.alias("cost"), F.coalesce(alone, F.lit(False)).alias("alone"))
    ordered = asked.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at")
    blocks = kept(_blocks(ordered, keys, budget, block), "blocks")
    entries = _entries(blocks, keys, budget)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, costs, walls = (batch.column(x)[k].values for x in ("at", "cost", "alone"))
                own = _Costs(costs.to_numpy(), walls.to_numpy(zero_copy_only=False), budget)
                new = np.zeros(own.n, np.int64)
                new[own.starts(batch.column("state")[k].as_py())] = 1
                numbers = pa.array(batch.column("batch")[k].as_py() + np.cumsum(new))
                names = [batch.column(c).take(pa.array(np.full(own.n, k))) for c in keys]
                yield pa.RecordBatch.from_arrays([*names, at.field("o"), at.field("c"), numbers], [*keys, order, cost, "batch"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + f", `{cost}` long, batch long"
    return blocks.drop(*_LISTS, "walled", "total").join(entries, ["part", "number"]).select(*keys, "at", "cost", "alone", "state", "batch").mapInArrow(work, schema)


def frame(rows: DataFrame, keys: list[str], order: str, text: str, page: str) -> DataFrame:
    """(keys, framed): the texts of a batch with a line that names the page before each."""
    piece = F.concat(F.lit("=== PAGE "), F.col(page).cast("string"), F.lit(" ===\n"), F.col(text))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("framed"))


def unframe(framed: DataFrame, keys: list[str], text: str = "framed") -> DataFrame:
    """(keys, page, text): the texts of a framed answer; of a page that is there twice the last one counts."""
    pieces = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n=== PAGE "), lambda x: F.rlike(x, F.lit(r"^\d+ ===")))
    each = framed.select(*keys, F.posexplode(pieces).alias("pos", "x"))
    each = each.select(*keys, "pos", F.regexp_extract("x", r"^(\d+)", 1).cast("long").alias("page"), F.regexp_replace("x", r"^\d+ ===\n?", "").alias("text"))
    return each.groupBy(*keys, "page").agg(F.max_by("text", "pos").alias("text"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def throughput(done: DataFrame, key: str, time: str, units: str, last: int = 12, tie: str | None = None, total: str | None = None) -> DataFrame:
    """Adds per_minute: units of the last `last` completions over the time they took; null for the first.

    With `total`, the units that a key has in all, also minutes_left at that speed.
    """
    order = Window.partitionBy(key).orderBy(time, tie or units)
    recent = order.rowsBetween(1 - last, 0)
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    seconds = at - F.first(at).over(recent)
    speed = F.sum(units).over(recent) / seconds * 60
    out = done.withColumn("per_minute", F.when(seconds > 0, F.round(speed, 6)))
    if total is None:
        return out
    left = F.col(total) - F.sum(units).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("minutes_left", F.when(seconds > 0, F.round(F.greatest(left, F.lit(0)) / speed, 6)))


def page_range(spec: str | None, total: int) -> tuple[int, int]:
    """First and last page of "a-b", "a-", "-b", "n" or, for all of them, nothing."""
    first, dash, last = (spec or "-").strip().partition("-")
    if not dash:
        last = first
    return max(1, int(first or 1)), min(total, int(last or total))


def outcome(answers: DataFrame, keys: list[str], wanted: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(keys, page, text, failed): what came back for each wanted page; one that is missing from its answer keeps its own text, and a batch without any has failed."""
    came = answers.select(*keys, page, F.col(text).alias("_new"))
    some = came.select(*keys).distinct().withColumn("_any", F.lit(True))
    joined = wanted.join(came, [*keys, page], "left").join(some, keys, "left")
    return joined.select(*keys, page, F.coalesce("_new", text).alias(text), F.col("_any").isNull().alias("failed"))
