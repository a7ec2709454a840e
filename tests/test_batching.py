"""Greedy batches of blocks against a fold from the first row to the last."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.operators import batching


def plain(costs, alone, budget):
    out, batch, used, closed = [], -1, 0, True
    for c, single in zip(costs, alone, strict=True):
        if closed or single or used + c > budget:
            batch, used = batch + 1, 0
        used, closed = used + c, single
        out.append(batch)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from([False] * 6 + [True])), min_size=1, max_size=40), st.integers(0, 12), st.integers(1, 9))
def test_blocks_in_a_row(rows, budget, block):
    costs, alone = [c for c, _ in rows], [a for _, a in rows]
    got, state, batch = [], budget + 1, -1
    for k in range(0, len(rows), block):
        own = batching._Costs(np.array(costs[k : k + block]), np.array(alone[k : k + block]), budget)
        new = np.zeros(own.n, np.int64)
        starts = own.starts(state)
        new[starts] = 1
        got += (batch + np.cumsum(new)).tolist()
        begins = own.begins()
        if len(starts):
            assert starts[0] in begins
            state, batch = int(own.exit[starts[0]]), batch + int(own.count[starts[0]])
        else:
            state += int(own.upto[-1])
    assert got == plain(costs, alone, budget)


@pytest.mark.parametrize("block", [1, 3, 64, batching.BLOCK])
def test_keys_over_many_tasks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None, "hot"][min(int(k), 3)], i, None if c == 7 else int(c), bool(a)) for i, (k, c, a) in enumerate(zip(rng.integers(0, 30, 900), rng.integers(0, 12, 900), rng.random(900) < 0.06, strict=True))]
    df = spark.createDataFrame(rows, "k string, i long, c int, wall boolean").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for barrier in (None, "wall"):
            for budget in (0, 17, 100_000):
                got = {(r.k, r.i): r.batch for r in batching.greedy_batches(df, ["k"], "i", "c", budget, barrier, block).collect()}
                by = defaultdict(list)
                for k, i, c, a in rows:
                    by[k].append((i, c or 0, a and barrier is not None))
                want = {(k, i): b for k, own in by.items() for (i, _, _), b in zip(own, plain([c for _, c, _ in own], [a for _, _, a in own], budget), strict=True)}
                assert got == want
        blocks = batching.kept(df, "x")
        ordered = blocks.selectExpr("k", "struct(i as o, c as c) as at", "coalesce(c, 0) * 1L as cost", "false as alone").repartitionByRange("k", "at").sortWithinPartitions("k", "at")
        parts = batching._blocks(ordered, ["k"], 17, 64).where("k = 'hot'").select("part").distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, 5)] * 4, "k string, i long, c long")
    assert sorted(r.batch for r in batching.greedy_batches(df, ["k"], "i", "c", 10).collect()) == [0, 0, 1, 1]
    assert batching.greedy_batches(df.where("false"), ["k"], "i", "c", 10).count() == 0
