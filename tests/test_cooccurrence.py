"""Items bought together against plain counting."""

import itertools
import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators.cooccurrence import _arrays, _planes, _unpacked, related_items


def by_hand(rows, k, min_shared):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = Counter(i for s in baskets.values() for i in s)
    shared = Counter(p for s in baskets.values() for p in itertools.permutations(s, 2))
    best = defaultdict(list)
    for (a, i), c in shared.items():
        if c >= min_shared:
            best[a].append((-c / math.sqrt(n[a] * n[i]), i, c))
    return {(a, r, i, c, -s) for a, rest in best.items() for r, (s, i, c) in enumerate(sorted(rest)[:k], 1)}


def purchases(seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(60), min(int(rnd.expovariate(0.06)), 70)) for _ in range(900)]
    rows += [(b, 1000) for b in range(60)]                  # an item of every basket
    rows += [(7, i) for i in range(90)]                     # a basket of nearly every item
    rows += rows[:100] + [(None, 1), (3, None), (99, 5000)]  # repeats, nulls, a lone item
    return rows


@pytest.mark.parametrize("cell_work,part_items", [(1_000_000, 1024), (400, 1024), (300, 8), (1, 1)])
def test_every_layout_gives_the_same_items(spark, cell_work, part_items):
    rows = purchases()
    df = spark.createDataFrame(rows, "b long, i long").repartition(5)
    got = related_items(df, "b", "i", 4, 2, cell_work, part_items).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 4, 2) and len(got) > 200


def test_small_buffers_and_text_items(spark):
    rows = [(b, None if i is None else f"é{i}" if i % 3 else f"a{i}") for b, i in purchases(5)]
    df = spark.createDataFrame(rows, "b long, i string")
    got = related_items(df, "b", "i", 3, 3, 500, 16, flush=50).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 3, 3)


def test_empty(spark):
    assert related_items(spark.createDataFrame([], "b long, i long"), "b", "i", 3).collect() == []


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {os.path.join(d, f) for top in dirs for d, _, files in os.walk(str(top)) for f in files if f.startswith("shuffle_")}


def test_waves_leave_no_shuffle_files(spark):
    rows = purchases(6)
    df = spark.createDataFrame(rows, "b long, i long").repartition(5)
    before = shuffle_files(spark)
    out = related_items(df, "b", "i", 4, 2, 300, 8, wave_copies=1, wave_work=1)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert {tuple(r) for r in out.collect()} == by_hand(rows, 4, 2)


@pytest.mark.parametrize("flush", [1, 7, 1000])
def test_records_keep_large_numbers(flush):
    i, n = np.array([3, 1 << 24, (1 << 50) + 5, 0, 7]), np.array([1, 70_000, 2, (1 << 40) + 1, 9])
    steps, lists, one = np.array([3, (1 << 24) - 3, (1 << 50) + 5 - (1 << 24), 0, 7]), np.array([0, 1, 2]), np.ones(2, np.int32)
    edges = np.array([0, 3, 5])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([False, True]), pa.array([4, 5]), _arrays(lists, one), _arrays(lists, np.diff(edges).astype(np.int32)), _arrays(lists, i[:2]), _arrays(lists, n[:2]),
         *_planes(edges, steps, 3), *_planes(edges, n, 2)], names=["split", "cell", "p", "m", "a", "na", "i0", "i1", "i2", "i3", "n0", "n1", "n2"])
    small = pa.RecordBatch.from_arrays(
        [*batch.slice(0, 1).columns[:3], _arrays(lists[:2], one[:1]), *batch.slice(0, 1).columns[4:6], *_planes(lists[:2], one[:1], 3), *_planes(lists[:2], one[:1], 2)], names=batch.schema.names)
    both = pa.Table.from_batches([small, batch]).combine_chunks().to_batches()
    got = [r for b in _unpacked(iter(both), flush) for r in b.to_pylist()]
    assert [(r["split"], r["cell"], r["a"], r["na"], r["i"], r["n"]) for r in got] == [
        (False, 4, [3], [1], [1], [1]), (False, 4, [3], [1], i[:3].tolist(), n[:3].tolist()), (True, 5, [1 << 24], [70_000], i[3:].tolist(), n[3:].tolist())]
