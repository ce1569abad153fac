"""N-gram Jaccard join (operator 1): T-occurrence search with DivideSkip.

A document is the set of its distinct ``k``-word shingles; two documents link
when 100 * |intersection| >= ``percent`` * |union|. The result is exact for
shingles taken as 64-bit hashes.

1. Every task turns whole texts into shingle sets and a fingerprint of the set;
   equal sets are one class from then on. A count sketch of fixed size over all
   shingles gives a global order: rare shingles first, very common ones last.
2. Two sets that link share one of the first n - ceil(percent% n) + 1 shingles
   of that order, so only those are shuffled. Each shingle's holders, sorted by
   set size, are cut where sizes are too far apart to link; the first holder of
   each run is its pivot, and every holder joins the pivot's block. Two sets
   that link share a block.
3. Members that cannot link with anyone in their block leave it. Each set has a
   parity bitmap of about one bit a shingle: a shingle that only one of two sets
   holds flips one bit, so two sets differ in at least as many shingles as their
   bitmaps in bits, and a pair over the difference a link allows is ruled out.
   Blocks are compared in pairs of chunks, so no task holds a large one.
4. In a block, inverted lists over the members' whole sets are searched for the
   members that reach the required overlap: the short lists are heap-merged,
   the long ones probed by binary search (DivideSkip). The pivot is the first
   query; members it reaches are one component and need no further search
   among themselves, the others are queries against the whole block. Large
   blocks are dealt to chunks that all hold the pivot; members no chunk could
   resolve are then searched in every chunk.
5. Links (a spanning forest of each block) become components.

So a group of near copies costs a search or two a chunk rather than all its
pairs, while every link between different components is still looked for.

Edge cases: a text with fewer than ``k`` words, but not none, is one shingle;
without words (null, empty, white space only) the set is empty, links with
nothing and stands alone. Repeated rows are separate rows of one class. A null
id joins its component, whose id is the smallest non-null id (null if none).
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import scan
from tessera.llm.common import free_name, map_arrow, saved, stream_groups
from tessera.llm.components import components
from tessera.session import ship_library

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
SKETCH_ROW = 1 << 13
CHUNK = 2048
SKIP_WEIGHT = 0.0085
#: Long lists probed at once; between them members that cannot reach the overlap drop out.
PROBES = 64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of each text, sorted."""
    h, _, _, at = scan.word_hashes(buf, offs, scan.NON_SPACE)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    grams = scan.runs_hash(h, k)
    inside = text[: len(grams)] == text[k - 1 :] if len(grams) else np.zeros(0, bool)
    owners, grams = text[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.concatenate([scan.runs_hash(h[at[t] : at[t + 1]], int(n[t])) for t in short])
        owners, grams = np.concatenate([owners, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, owners))
    owners, grams = owners[order], grams[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (grams[1:] != grams[:-1])
        owners, grams = owners[new], grams[new]
    return owners, grams


def fingerprints(owners: np.ndarray, grams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each text's set."""
    n = np.bincount(owners, minlength=texts)
    total = np.zeros(texts, np.uint64)
    if len(grams):
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        with np.errstate(over="ignore"):
            total[owners[starts]] = np.add.reduceat(scan.mix(grams ^ scan.SHINGLE[7]), starts)
            total = scan.mix(total + n.astype(np.uint64))
    return n, total.view(np.int64)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Overlap that any link of a set of n shingles has at least."""
    return (percent * n + 99) // 100


# -- sets and the order of shingles ------------------------------------------

SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_key", T.LongType()), T.StructField("n", T.LongType()),
                     T.StructField("fp", T.LongType()), T.StructField("parity", T.BinaryType()),
                     T.StructField("slot", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def parity_bits(n: int) -> int:
    """Bits of the parity bitmap of n shingles: a power of two, 64 at least."""
    return max(64, 1 << max(n - 1, 0).bit_length())


def parities(owners: np.ndarray, grams: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: bit (hash modulo its size) flips with every shingle."""
    out = []
    at = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = parity_bits(b - a)
        odd = np.bincount((grams[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``size`` words by exclusive or."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def may_link(sizes: np.ndarray, bits: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Marks the sets that a pair (one of ``left``, another of ``right``) allows
    to link: overlap o with (100 + percent) o >= percent (n + m), so they differ
    in n + m - 2 o shingles at most."""
    keep = np.zeros(len(sizes), bool)
    words = np.array([len(b) for b in bits])
    for w in np.unique(words[left]):
        own = left[words[left] == w]
        for v in np.unique(words[right]):
            other = right[words[right] == v]
            if max(w, v) > 4 * min(w, v):  # sizes differ by more than a link allows
                continue
            size = min(w, v)
            a, b = fold(np.stack([bits[i] for i in own]), size), fold(np.stack([bits[i] for i in other]), size)
            step = max(1, (1 << 20) // (size * len(other)))
            for i in range(0, len(own), step):
                o = own[i : i + step]
                differ = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                total = sizes[o][:, None] + sizes[other][None, :]
                can = (differ <= total - 2 * -(-percent * total // (100 + percent))) & (o[:, None] != other[None, :])
                keep[o] |= can.any(axis=1)
                keep[other] |= can.any(axis=0)
    return keep


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """A row per document (doc_id, row_key, n, fp) and partial sketch rows (slot, counts)."""
    rows = 1 << SKETCH_BITS

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        counts = np.zeros(rows, np.int32)
        none = lambda n, t: pa.nulls(n, t)
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            owners, grams = shingle_sets(buf, offs, k)
            n, fp = fingerprints(owners, grams, j - i)
            counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=rows).astype(np.int32)
            part = batch.slice(i, j - i)
            yield {"doc_id": part.column("doc_id"), "row_key": part.column("row_key"), "n": n, "fp": fp, "parity": pa.array(parities(owners, grams, n), pa.binary()),
                   "slot": none(j - i, pa.int32()), "counts": none(j - i, pa.binary())}
        m = rows // SKETCH_ROW
        yield {"doc_id": none(m, pa.int64()), "row_key": none(m, pa.int64()), "n": none(m, pa.int64()), "fp": none(m, pa.int64()), "parity": none(m, pa.binary()),
               "slot": np.arange(m), "counts": pa.array([c.tobytes() for c in counts.reshape(m, -1)], pa.binary())}

    return map_arrow(docs, fn, SETS)


def _sketch(sets: DataFrame) -> np.ndarray:
    """Class (log2 of the count) of every sketch cell; its size is fixed."""
    schema = "slot int, counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(counts.as_buffer(), np.int32)
                if slot not in total:
                    total[slot] = np.zeros(len(got), np.int64)
                total[slot] += got
        names = pa.schema([("slot", pa.int32()), ("counts", pa.binary())])
        for slot, c in total.items():
            level = np.floor(np.log2(c + 1)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([level.tobytes()], pa.binary())], schema=names)

    parts = sets.where("slot IS NOT NULL").select("slot", "counts").repartition("slot").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int8)
    for r in parts.collect():
        out[r["slot"] * SKETCH_ROW : (r["slot"] + 1) * SKETCH_ROW] = np.frombuffer(bytes(r["counts"]), np.int8)
    return out


# -- blocks ------------------------------------------------------------------

def _prefixes(docs: DataFrame, shared: object, k: int, percent: int) -> DataFrame:
    """(shingle, n, fp) for the leading shingles of each set; a set that repeats in a batch is sent once."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType())])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        level = shared.value
        seen: set[int] = set()
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            owners, grams = shingle_sets(buf, offs, k)
            n, fp = fingerprints(owners, grams, j - i)
            first = np.zeros(j - i, bool)
            for t, f in enumerate(fp.tolist()):
                if f not in seen:
                    seen.add(f)
                    first[t] = n[t] > 0
            on = first[owners]
            owners, grams = owners[on], grams[on]
            order = np.lexsort((grams, level[grams >> np.uint64(64 - SKETCH_BITS)], owners))
            owners, grams = owners[order], grams[order]
            starts = np.searchsorted(owners, np.arange(j - i))
            lead = np.arange(len(owners)) - starts[owners] <= (n - least_overlap(n, percent))[owners]
            yield {"shingle": grams[lead].view(np.int64), "n": n[owners[lead]], "fp": fp[owners[lead]]}

    return map_arrow(docs.select("text"), fn, schema)


def _pivots(prefixes: DataFrame, percent: int) -> DataFrame:
    """(fp, pivot): every holder of a shared shingle with the first of its run of similar sizes."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("pivot", T.LongType())])
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[int, int, int, int] | None = None  # shingle, size and set of the last row, pivot of its run
        for batch in batches:
            if not batch.num_rows:
                continue
            sh, n, fp = (batch.column(c).to_numpy().astype(np.int64) for c in range(3))
            if state:
                sh, n, fp = (np.concatenate([[s], a]) for s, a in zip(state, (sh, n, fp)))
            new = np.ones(len(sh), bool)
            new[1:] = (sh[1:] != sh[:-1]) | (100 * n[:-1] < percent * n[1:])
            if state:
                new[0] = state[2] == state[3]
            start = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
            pivot = fp[start]
            if state:
                pivot[start == 0] = state[3]
            other = fp != pivot
            pairs = np.stack([fp[other], pivot[other]], axis=1)
            pairs = np.unique(np.concatenate([pairs, np.repeat(pairs[:, 1:], 2, axis=1)]), axis=0)
            state = (int(sh[-1]), int(n[-1]), int(fp[-1]), int(pivot[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=names)

    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "fp")
    return dealt.mapInArrow(run, schema).distinct()


def _possible(members: DataFrame, classes: DataFrame, percent: int, chunk: int) -> DataFrame:
    """The members (fp, pivot) that may link with another member of their block."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("pivot", T.LongType())])
    names = to_arrow_schema(schema)
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    dealt = members.join(sizes, "pivot").join(classes.select("fp", "n", "parity"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = dealt.select("pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "n", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, int]] = []
        for cell in stream_groups(batches, ["pivot", "a", "b"]):
            fps, n, own = (cell.column(c).to_numpy() for c in ("fp", "n", "own"))
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("parity")]
            a, b = cell.column("a")[0].as_py(), cell.column("b")[0].as_py()
            keep = may_link(n, bits, np.flatnonzero(own == a), np.flatnonzero(own == b), percent)
            found.append((fps[keep], cell.column("pivot")[0].as_py()))
            if len(found) >= 1024:
                yield flush(found)
        if found:
            yield flush(found)

    def flush(found: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        fps = np.concatenate([f for f, _ in found])
        pivots = np.repeat(np.array([p for _, p in found], np.int64), [len(f) for f, _ in found])
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(pivots, pa.int64())], schema=names)

    ordered = cells.repartition("pivot", "a", "b").sortWithinPartitions("pivot", "a", "b")
    return ordered.mapInArrow(run, schema).distinct()


def _cells(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of the wanted rows (row_key, cells) in their cells (pivot, chunk, part, query)."""
    cell = [T.StructField("pivot", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("part", T.IntegerType()),
            T.StructField("query", T.BooleanType())]
    schema = T.StructType([*cell, T.StructField("fp", T.LongType()), T.StructField("grams", T.BinaryType())])
    rows = docs.join(wanted, "row_key").select("text", "cells")

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        cells = batch.column("cells")
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            owners, grams = shingle_sets(buf, offs, k)
            _, fp = fingerprints(owners, grams, j - i)
            at = np.searchsorted(owners, np.arange(j - i + 1))
            part = cells.slice(i, j - i)
            of = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            packed = [grams[a:b].tobytes() for a, b in zip(at, at[1:])]
            for a in range(0, len(of), 512):  # few rows a batch: sets can be large
                o = of[a : a + 512]
                yield {**{f.name: flat.field(f.name).slice(a, 512) for f in cell}, "fp": fp[o], "grams": pa.array([packed[t] for t in o], pa.binary())}

    return map_arrow(rows, fn, schema)


class InvertedLists:
    """Lists of the members that hold each shingle of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.members = flat[order], member[order]
        self.starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        self.lengths = np.diff(np.append(self.starts, len(flat)))
        self.tokens = flat[self.starts]
        #: (list, member) as one sorted key, so many lists are probed by one binary search
        self.keys = np.repeat(np.arange(len(self.starts)), self.lengths) * len(sets) + self.members

    def search(self, own: int, query: np.ndarray, percent: int) -> np.ndarray:
        """Members other than ``own`` (-1: the query is no member) whose Jaccard
        similarity with the query reaches the limit."""
        k = np.searchsorted(self.tokens, query)
        if own < 0:  # some of its shingles may be held by no member
            k = np.minimum(k, len(self.tokens) - 1)
            k = k[self.tokens[k] == query]
        need = int(least_overlap(len(query), percent))
        if len(k) < need:
            return np.zeros(0, np.int64)
        k = k[np.argsort(self.lengths[k], kind="stable")]
        longest = int(self.lengths[k[-1]])
        n_long = min(need - 1, int(need / (SKIP_WEIGHT * np.log2(longest + 1) + 1)))
        short, long_ = k[: len(k) - n_long], k[len(k) - n_long :]
        least = 1 if own < 0 else 2  # a member's list of one entry holds only itself
        lists = [self.members[a : a + n].tolist() for a, n in zip(self.starts[short].tolist(), self.lengths[short].tolist()) if n >= least]
        merged = np.fromiter(heapq.merge(*lists), np.int64)
        found, counts = np.unique(merged, return_counts=True)
        keep = (counts >= need - n_long) & (found != own)
        found, counts = found[keep], counts[keep]
        required = -(-percent * (len(query) + self.sizes[found]) // (100 + percent))
        for a in range(0, n_long, PROBES):
            can = counts + (n_long - a) >= required
            found, counts, required = found[can], counts[can], required[can]
            if not len(found):
                break
            probe = (long_[a : a + PROBES, None] * len(self.sizes) + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            counts = counts + (self.keys[at] == probe).reshape(-1, len(found)).sum(axis=0)
        return found[counts >= required]


#: Members of a component from which its other members are searched only outside of it.
LARGE = 32


def block_links(fps: np.ndarray, sets: list[np.ndarray], is_query: np.ndarray, pivot: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (two arrays of set indices) that connect all of the block's linked
    sets, and the queries that the pivot's component doesn't hold.

    ``is_query`` marks the sets to search; the pivot goes first if it is here, and
    members of its component are not searched: whoever links with one of them and
    isn't in it is. Members of another large component are searched in lists
    without its members, since links inside it are of no more use: near copies then
    meet each other once, not once each."""
    root = np.arange(len(sets))
    size = np.ones(len(sets), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists = InvertedLists(sets)
    outside: dict[int, tuple[np.ndarray, InvertedLists | None]] = {}  # by any member of a large component
    a: list[int] = []
    b: list[int] = []
    here = np.flatnonzero(fps == pivot)
    first = int(here[0]) if len(here) else -1
    queries = np.flatnonzero(is_query).tolist()
    if first >= 0:
        queries = [first, *(q for q in queries if q != first)]
    for q in queries:
        top = find(q)
        if q != first and first >= 0 and top == find(first):
            continue
        if top in outside:
            others, rest = outside[top]
            met = others[rest.search(-1, sets[q], percent)].tolist() if rest else []
        else:
            met = lists.search(q, sets[q], percent).tolist()
        for m in met:
            x, y = find(q), find(m)
            if x != y:
                x, y = min(x, y), max(x, y)
                root[y] = x
                size[x] += size[y]
                a.append(q)
                b.append(m)
                outside.pop(x, None)  # what lies outside has changed
                outside.pop(y, None)
        top = find(q)
        if size[top] >= LARGE and top not in outside and (first < 0 or top != find(first)):
            others = np.array([i for i in range(len(sets)) if find(i) != top], np.int64)
            outside[top] = others, InvertedLists([sets[i] for i in others]) if len(others) else None
    left = [q for q in queries if first < 0 or find(q) != find(first)]
    return np.array(a, np.int64), np.array(b, np.int64), np.array(left, np.int64)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("open_pivot", T.LongType())])


def _search(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of every cell, and rows (a, open_pivot) for members that aren't in the pivot's component."""
    names = to_arrow_schema(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in stream_groups(batches, ["pivot", "chunk", "part"]):
            # a repeated document row repeats its set; a set may be both data and query
            fps = cell.column("fp").to_numpy()
            is_query = cell.column("query").to_numpy(zero_copy_only=False)
            order = np.lexsort((~is_query, fps))
            order = order[np.diff(fps[order], prepend=fps[order[0]] - 1) != 0]
            grams = cell.column("grams")
            sets = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in order]
            fps, is_query = fps[order], is_query[order]
            pivot = cell.column("pivot")[0].as_py()
            a, b, left = block_links(fps, sets, is_query, pivot, percent)
            if cell.column("part")[0].as_py() >= 0:
                left = left[:0]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([fps[a], fps[left]])),
                pa.array(np.concatenate([fps[b], fps[left]])),
                pa.array([None] * len(a) + [pivot] * len(left), pa.int64())], schema=names)

    dealt = cells.repartition("pivot", "chunk", "part").sortWithinPartitions("pivot", "chunk", "part")
    return dealt.mapInArrow(run, LINKS)


def _wanted(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells of each set, with the row that holds its text. A set has at most
    as many cells as leading shingles (times chunks, for a pivot)."""
    cells = rows.groupBy("fp").agg(F.collect_list(F.struct("pivot", "chunk", "part", "query")).alias("cells"))
    return cells.join(classes, "fp").select("row_key", "cells")


def set_links(docs: DataFrame, sets: DataFrame, k: int, percent: int, chunk: int) -> DataFrame:
    """(a, b): fingerprints whose sets link; connects every component."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_sketch(sets))
    classes = sets.where("n > 0").groupBy("fp").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    members = saved(_pivots(_prefixes(docs, shared, k, percent), percent), "members")
    members = saved(_possible(members, classes, percent, chunk), "members")
    classes = classes.select("fp", "row_key")
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    dealt = members.join(sizes, "pivot")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("fp") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    data = dealt.select("fp", "pivot", "chunks", F.explode(cells).alias("chunk"))
    first = data.select("fp", "pivot", "chunk", F.lit(-1).alias("part"), F.lit(True).alias("query"))
    found = saved(_search(_cells(docs, _wanted(first, classes), k), percent), "links")
    links = found.where("open_pivot IS NULL").select("a", "b")
    # members of dealt-out blocks that their own chunk didn't join to the pivot
    unsolved = found.where("open_pivot IS NOT NULL").select(F.col("a").alias("fp"), F.col("open_pivot").alias("pivot")).distinct()
    unsolved = saved(unsolved.join(sizes.where("chunks > 1"), "pivot"), "unsolved")
    if unsolved.isEmpty():
        return links
    parts = unsolved.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts"))
    asked = unsolved.join(parts, "pivot").select(
        "fp", "pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"))
    held = data.where("fp <> pivot").join(parts, "pivot").select(
        "fp", "pivot", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    more = saved(_search(_cells(docs, _wanted(asked.unionAll(held), classes), k), percent), "links")
    return links.unionAll(more.where("open_pivot IS NULL").select("a", "b"))


def _components_of(docs: DataFrame, k: int, percent: int, chunk: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, row_key (a hash of
    id and text) and root, which names the component (null without words)."""
    ship_library(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    sets = saved(_sets(rows, k), "sets")
    per_doc = sets.where("slot IS NULL").select("doc_id", "row_key", "n", "fp")
    roots = components(set_links(rows, sets, k, percent, chunk))
    classes = per_doc.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "root").select("fp", "component_id", "root")
    out = per_doc.join(classes, "fp", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row_key", "root")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and row_key (a hash of id and text)."""
    return _components_of(docs, k, percent, chunk, id_col, text_col).drop("root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with
    all columns. Rows that share that id all stay; so do rows without words
    and, in components without any id, all rows. ``representatives`` keeps a
    single row instead."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    drop = found.where("component_id IS NOT NULL AND NOT (doc_id <=> component_id)").select(F.col("row_key").alias("__dropped"))
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return docs.join(drop.distinct(), key == F.col("__dropped"), "left_anti")


def representatives(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, with all columns: the smallest id (null
    if there is no other), among its texts the smallest row_key, and any one of
    equal rows (same id and text). A row without words stands alone; only equal
    ones with an id count as one document."""
    found = saved(_components_of(docs, k, percent, chunk, id_col, text_col), "found")
    first = found.where("doc_id <=> component_id")
    ties = first.where("root IS NOT NULL").groupBy("root").agg(F.min("row_key").alias("least"), F.max("row_key").alias("most"))
    ties = ties.where("least < most").select("root", "least")
    later = first.join(ties, "root").where("row_key > least").select("row_key")
    drop = found.where("NOT (doc_id <=> component_id)").select("row_key").unionAll(later).distinct()
    key = free_name(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")))
    kept = keyed.join(drop.withColumnRenamed("row_key", key), key, "left_anti").select(*keyed.columns)
    again = first.where("root IS NOT NULL OR doc_id IS NOT NULL").groupBy("row_key").agg(F.count(F.lit(1)).alias("rows"))
    again = saved(again.where("rows > 1").select(F.col("row_key").alias(key)), "repeated-rows")
    if not again.isEmpty():
        copies = kept.join(again, key, "left_semi").select(*keyed.columns).dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").select(*keyed.columns).unionAll(copies)
    return kept.drop(key)
