"""Items bought together: an exact item-to-item recommendation (J-10).

The incidence matrix of baskets and items is multiplied with itself in cells. A
cell holds some anchor items and, for each basket one of them is in, the
basket's items; it adds up how often each item meets each anchor. An anchor whose
baskets hold few items lies in one cell whole, so its ranking is final there and
only its best partners leave the task. An anchor with long lists is split over
many cells by basket, and their partial counts are added afterwards. Pairs are
never listed: a basket's list is copied once for each cell with an anchor in it, and
a task holds the counts of one cell.

The copies of the lists outgrow the purchases by the length of a basket, so the cells
are taken in waves: a wave copies each list a bounded number of times on the mean, and
its shuffle files are gone before the next one begins. The lists travel packed, as
differences of sorted item numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import top_k_per_group
from tessera.session import ship_library
from tessera.sources.stage import new_folder, shuffles_freed, staged


def related_items(purchases: DataFrame, basket: str, item: str, k: int, min_shared: int = 2,
                  cell_work: int = 1_000_000, part_items: int = 1024, flush: int = 1_000_000,
                  wave_copies: int = 12, wave_work: int = 400_000_000) -> DataFrame:
    """The ``k`` items most alike each item by the baskets they share:
    ``(item, rank, related, shared, score)``.

    ``score`` is the cosine of the two items' basket sets, shared / sqrt(n_a * n_b);
    higher scores come first, ties by the smaller item. Pairs with fewer than ``min_shared`` shared
    baskets don't count, and an item without any partner has no row. Repeated
    purchases count once; rows with a null basket or item take no part.

    ``cell_work`` bounds the meetings of one cell (an anchor with more is split by
    basket), ``part_items`` the items of one record: a longer basket is cut in parts,
    ``flush`` the meetings a task holds before it adds them up. A wave takes cells with
    ``wave_work`` meetings, or ``wave_copies`` for each purchase if these are more. They change the
    layout only, never the result."""
    spark = purchases.sparkSession
    ship_library(spark)
    with shuffles_freed(spark):
        items, lists, total = _numbered_lists(purchases, basket, item, min_shared, cell_work, part_items)
        blocks, waves = max(1, -(-total["work"] // cell_work)), max(1, -(-total["work"] // max(wave_copies * total["n"], wave_work)))
        # both sides of a long basket go by its parts, so it is spread over many tasks
        long = lists.filter("parts > 1")
        others = long.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                             F.col("code").alias("i"), F.col("n").alias("ni"))
        none = F.lit(None).cast("array<long>")
        records = lists.filter("parts = 1").select("b", "code", "n", "slices", none.alias("i"), none.alias("ni")) \
            .unionByName(long.drop("parts").join(others, ["b", "part"]).drop("part"))
        path = new_folder(spark, "meetings")
        schema = "split boolean, a long, i long, na long, n long, shared long"
        for wave in range(waves):
            cells = records.mapInArrow(lambda batches: _cells(batches, blocks, waves, wave, flush), _RECORD)  # noqa: B023
            cells = cells.repartition("split", "cell").sortWithinPartitions("split", "cell")
            cells.mapInArrow(lambda batches: _count_cells(_unpacked(batches, flush), k, min_shared, flush), schema).write.mode("append").parquet(path)
        met = spark.read.schema(schema).parquet(path)
        score = F.col("shared") / F.sqrt((F.col("na") * F.col("n")).cast("double"))
        added = met.filter("split").groupBy("a", "i", "na", "n").agg(F.sum("shared").alias("shared")) \
            .filter(F.col("shared") >= min_shared)
        whole = met.filter("NOT split").select(*added.columns)
        # an item's number keeps the order of the items
        best = staged(top_k_per_group(whole.unionByName(added).withColumn("score", score), ["a"], "score", k, tiebreak=["i"]), "best")
    name = items.select("code", "i")
    return best.join(name.toDF("a", "item"), "a").join(name.toDF("i", "related"), "i") \
        .select("item", "rank", "related", "shared", "score")


def _numbered_lists(purchases: DataFrame, basket: str, item: str, min_shared: int, cell_work: int, part_items: int):
    """The items with numbers in their order, ``(i, n, slices, code)``; the baskets' sorted lists of them,
    ``(b, part, parts, code, n, slices)``; and how many purchases and meetings there are."""
    inc = purchases.select(F.col(basket).alias("k"), F.col(item).alias("i")).filter("k IS NOT NULL AND i IS NOT NULL").distinct()
    sizes = inc.groupBy("k").agg(F.count(F.lit(1)).alias("m")).withColumn("b", F.monotonically_increasing_id())
    inc = staged(inc.join(sizes, "k").select("b", "i", "m"), "incidence")
    stats = inc.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("work")).filter(F.col("n") >= min_shared)
    stats = staged(stats.select("i", "n", F.ceil(F.col("work") / cell_work).alias("slices")), "items")
    # the place in the order: rows of the ranges before, and the row in its range
    place = F.monotonically_increasing_id()
    ranged = staged(stats.repartitionByRange("i").sortWithinPartitions("i").withColumn("place", place), "ranges") \
        .withColumn("range", F.shiftright("place", 33))
    ends = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumn("before", F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).select("range", "before")
    code = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    items = staged(ranged.join(F.broadcast(ends), "range").select("i", "n", "slices", code.alias("code")), "numbers")
    total = inc.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("work")).first()
    rows = inc.filter("m > 1").join(items, "i").withColumn("parts", F.ceil(F.col("m") / part_items)) \
        .withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts"))).select("b", "part", "parts", "code", "n", "slices")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "code")
    return items, staged(rows.mapInArrow(_lists, "b long, part long, parts long, code array<long>, n array<long>, slices array<long>"), "lists"), total


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (basket, part) out of rows sorted by it."""
    names = ["b", "part", "parts", "code", "n", "slices"]
    rest = None

    def rows(x, edges):
        offsets = pa.array(np.r_[edges, len(x[0])].astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(c[edges]) for c in x[:3]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in x[3:])], names=names)

    for batch in batches:
        x = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            x = [np.concatenate(p) for p in zip(rest, x)]
        if not len(x[0]):
            continue
        edges = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
        rest = [c[edges[-1]:] for c in x]
        if len(edges) > 1:
            yield rows([c[:edges[-1]] for c in x], edges[:-1])
    if rest is not None:
        yield rows(rest, np.zeros(1, np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 63 bits (the last step of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all pieces that begin at ``starts``, one piece after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


#: A record of the cells: how many anchors and items each list has, the anchors, and the items byte by byte: most
#: of the upper bytes are 0.
_RECORD = "split boolean, cell long, p array<int>, m array<int>, a array<long>, na array<long>, " + ", ".join(
    f"{c} binary" for c in ("i0", "i1", "i2", "i3", "n0", "n1", "n2"))


def _cells(batches: Iterator[pa.RecordBatch], blocks: int, waves: int, wave: int, flush: int) -> Iterator[pa.RecordBatch]:
    """The anchors of a wave's cells and the lists they meet: one record for each cell and
    stretch of lists; about four times ``flush`` list items at once."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
        length = lambda c: batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
        p, m, a, na, slices, i, n = length("code"), length("i"), column("code"), column("n"), column("slices"), column("i"), column("ni")
        own = batch.column("i").is_null().to_numpy(zero_copy_only=False)
        # a short basket meets itself
        at_i = np.where(own, np.cumsum(p) - p + len(i), np.cumsum(m) - m)
        m, i, n = np.where(own, p, m), np.concatenate([i, a]), np.concatenate([n, na])
        row = np.repeat(np.arange(len(p)), p)
        split = slices > 1
        basket = batch.column("b").to_numpy()[row]
        cell = np.where(split, _mixed(_mixed(a) + basket % np.maximum(slices, 1)), _mixed(a) % blocks)
        now = np.flatnonzero(_mixed(cell) % waves == wave)
        copied = np.cumsum(m[row[now]])
        lo = 0
        while lo < len(now):
            done = copied[lo - 1] if lo else 0
            to = max(lo + 1, int(np.searchsorted(copied, done + 4 * flush, "right")))
            take = now[lo:to]
            take = take[np.lexsort((take, cell[take], split[take]))]
            lo = to
            s, c, r = split[take], cell[take], row[take]
            new_cell = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
            first = np.flatnonzero(new_cell)
            lists = np.flatnonzero(new_cell | np.r_[True, r[1:] != r[:-1]])
            lengths = m[r[lists]]
            where = _spread(at_i[r[lists]], lengths)
            ends = np.r_[0, np.cumsum(lengths)]
            steps = np.diff(i[where], prepend=0)
            steps[ends[:-1]] = i[where[ends[:-1]]]
            # edges of the records among anchors, lists and items
            of_a = np.r_[first, len(take)]
            of_lists = np.searchsorted(lists, of_a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[first]), pa.array(c[first]), _arrays(of_lists, np.diff(np.r_[lists, len(take)]).astype(np.int32)),
                 _arrays(of_lists, lengths.astype(np.int32)), _arrays(of_a, a[take]), _arrays(of_a, na[take]),
                 *_planes(ends[of_lists], steps, 3), *_planes(ends[of_lists], n[where], 2)], names=names)


def _arrays(edges: np.ndarray, x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x))


def _planes(edges: np.ndarray, x: np.ndarray, bytes_: int) -> list[pa.Array]:
    """The lowest bytes of whole numbers >= 0, each in a column, and four more bytes, empty if they are 0."""
    def binary(at, data):
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])

    raw = np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8)
    rest = x >> (8 * bytes_)
    last = binary(4 * edges, rest.astype(np.uint32)) if rest.any() else binary(0 * edges, np.zeros(0, np.uint8))
    return [*(binary(edges, np.ascontiguousarray(raw[:, j])) for j in range(bytes_)), last]


def _unpacked(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Records of :func:`_cells` as rows ``(split, cell, a, na, i, n)``, one for each list."""
    def numbers(batch, names):
        data = []
        for name in names:
            column = batch.column(name)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
            data.append((np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]], np.diff(at)))
        x = sum(d.astype(np.int64) << (8 * j) for j, (d, _) in enumerate(data[:-1]))
        rest, lengths = data[-1]
        if len(rest):
            x[np.repeat(lengths > 0, data[0][1])] += rest.view(np.uint32).astype(np.int64) << (8 * (len(data) - 1))
        return x

    for whole in batches:
        held, lo = np.cumsum(pc.binary_length(whole.column("i0")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while lo < whole.num_rows:
            # as many records as fit, and one at least
            to = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + flush, "right")))
            batch = whole.slice(lo, to - lo)
            lo = to
            p, m = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("p", "m"))
            i, at = np.cumsum(numbers(batch, ["i0", "i1", "i2", "i3"])), np.r_[0, np.cumsum(m)]
            i -= np.repeat(np.r_[0, i][at[:-1]], m)
            lists = batch.column("p").value_lengths().to_numpy()
            split, cell = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lists) for c in ("split", "cell"))
            at_a = np.r_[0, np.cumsum(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(split), pa.array(cell), _arrays(at_a, batch.column("a").flatten().to_numpy()),
                 _arrays(at_a, batch.column("na").flatten().to_numpy()), _arrays(at, i), _arrays(at, numbers(batch, ["n0", "n1", "n2"]))],
                names=["split", "cell", "a", "na", "i", "n"])


def _count_cells(batches: Iterator[pa.RecordBatch], k: int, min_shared: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Counts of (anchor, item) per cell; rows arrive sorted by cell. Whole cells
    give each anchor's best ``k``, cells of split anchors their partial counts."""
    key, buffer, waiting, counts, item_type = None, [], 0, None, None

    def fold(least: int = 1):
        nonlocal buffer, waiting, counts
        if not buffer:
            return
        p, a, na, m, i, n = (np.concatenate([r[j] for r in buffer]) for j in range(6))
        buffer, waiting = [], 0
        was = () if counts is None else (counts["a"].to_numpy(), counts["i"].to_numpy())
        codes, values = pd.factorize(np.concatenate([a, i, *was]))
        size = np.zeros(len(values), np.int64)
        size[codes[:len(a) + len(i)]] = np.concatenate([na, n])
        ca, ci = codes[:len(a)], codes[len(a):]
        # every anchor of a record meets all items of the record
        lists = np.repeat(m, p)
        first = np.repeat(np.cumsum(m) - m, p)
        one, other = np.repeat(ca, lists), ci[_spread(first, lists)]
        met = (one * np.int64(len(values)) + other)[one != other]
        met.sort()
        starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]]) if len(met) else np.zeros(0, np.int64)
        shared, met = np.diff(np.r_[starts, len(met)]), met[starts]
        if counts is not None:
            ka, ki = np.split(codes[len(a) + len(i):], 2)
            size[ka], size[ki] = counts["na"], counts["n"]
            met, shared = np.concatenate([met, ka * np.int64(len(values)) + ki]), np.concatenate([shared, counts["shared"]])
            order = np.argsort(met, kind="stable")
            met, shared = met[order], shared[order]
            starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
            shared, met = np.add.reduceat(shared, starts), met[starts]
        keep = shared >= least
        one, other = np.divmod(met[keep], np.int64(max(1, len(values))))
        new = pd.DataFrame({"a": values[one], "i": values[other], "na": size[one], "n": size[other], "shared": shared[keep]})
        counts = new

    def result():
        nonlocal counts
        fold(1 if key is None or key[0] else min_shared)
        out, counts = counts, None
        if out is None or out.empty:
            return
        if not key[0]:
            out = out[out["shared"] >= min_shared]
            out = out.assign(score=out["shared"] / np.sqrt((out["na"] * out["n"]).astype("float64")))
            out = out.sort_values(["a", "score", "i"], ascending=[True, False, True]).groupby("a", sort=False).head(k)
        if len(out):
            longs = [pa.array(out[c].to_numpy(np.int64)) for c in ("na", "n", "shared")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), key[0])), *(pa.array(out[c], item_type, from_pandas=True) for c in ("a", "i")), *longs],
                                             names=["split", "a", "i", "na", "n", "shared"])

    for batch in batches:
        if not batch.num_rows:
            continue
        item_type = batch.column("a").type.value_type
        flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "na", "i", "n")}
        p, m = (batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "i"))
        split, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("split", "cell"))
        at_a, at_i, work = np.r_[0, np.cumsum(p)], np.r_[0, np.cumsum(m)], np.cumsum(p * m)
        edges = np.flatnonzero(np.r_[True, (split[1:] != split[:-1]) | (cell[1:] != cell[:-1]), True])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if key != (split[lo], cell[lo]):
                yield from result()
                key = (bool(split[lo]), cell[lo])
            while lo < hi:
                # as many records as fit, and one at least
                done = work[lo - 1] if lo else 0
                to = min(hi, max(lo + 1, int(np.searchsorted(work, done + flush - waiting, "right"))))
                sa, si = slice(at_a[lo], at_a[to]), slice(at_i[lo], at_i[to])
                buffer.append((p[lo:to], flat["a"][sa], flat["na"][sa], m[lo:to], flat["i"][si], flat["n"][si]))
                waiting += work[to - 1] - done
                lo = to
                if waiting >= flush:
                    if key[0]:
                        yield from result()
                    else:
                        fold()
    yield from result()
