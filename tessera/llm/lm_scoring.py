"""LM scoring (operator 12): Brown's class-based bigram model.

P(w | history) = P(class(w) | class of the last known token) * P(w | class(w)),
where classes come from exchange clustering and every count from all training
documents. Words are known by 96 bits of hash (``scan`` and a second table).

1. *Core words.* A count sketch over all training tokens gives a threshold
   that at most ``CORE`` buckets reach; the words in those buckets are counted
   exactly, and those that reach it are the core, with the end token.
2. *Exchange clustering.* One shuffle collects, for each core word, the counts
   of its core neighbours on either side, packed. A round takes words
   in turn out of their class and puts each where the log-likelihood of the class bigrams
   gains most. Buckets of words are handled side by side, each against its own
   copy of the class counts (C by C numbers, broadcast); every other bucket rests in
   a round, and a round that loses is undone.
3. *All other words* are exchanged once: one shuffle adds up, for each of them, the
   classes of its neighbours, and the same criterion gives the class. This
   table grows with the corpus and stays distributed.
4. *Scoring.* The ``COMMON`` most frequent words are broadcast (a fixed number);
   what else a document holds is joined with the table of step 3 as distinct (row,
   word) pairs. Then class transitions are counted over all training documents
   and each document's class sequence is scored.

The model is proper over the V training tokens and one symbol for all unknown
words, the events of the unigram base: for a context class g,

    P(unknown | g) = (s(g) + t(g) u) / (N(g) + t(g))
    P(c | g)       = (1 - P(unknown | g)) (N(g, c) + t(g) N(c) / N) / (N(g) + t(g))
    P(w | c)       = count(w) / N(c)

with s(g) the tokens after g whose word occurs once in training, t(g) the
number of classes seen after g (Witten-Bell), and u = 1 / (N + V + 1). Unknown
words don't change the context; a text starts after an end token.

Edge cases: a null or empty text is one end token; a null id trains and is not
held out; repeated rows count and are scored one by one; without training
documents everything is unknown with probability 1, so both scores are 0; an
empty table gives no rows. Only the named columns are read. Memory in a task is
a slice of text, or one longer text, and tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import scan
from tessera.llm.common import list_array, saved
from tessera.session import ship_library

CLASSES = 64
CORE = 1 << 13
COMMON = 1 << 19
ROUNDS = 12
SKETCH = 1 << 18
#: Tokens that a task folds before it hands rows on.
FOLD = 1 << 22
BUCKETS = 128
UNKNOWN, SINGLE = 127, 128
_RNG = np.random.default_rng(1992)
SECOND_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
END_HASH, END_SECOND = np.uint64(0x8E51D2C64B1F0A37), np.uint32(0x5DEECE66)
I64, I32, BIN, DBL = T.LongType(), T.IntegerType(), T.BinaryType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# -- tokens -------------------------------------------------------------------

def _second(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """32 more hash bits of the bytes [s, e)."""
    p = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(SECOND_TABLE[buf] * scan.powers(len(buf))[0], out=p[1:])
    return (scan.span_hash(p, s, e) >> np.uint64(32)).astype(np.uint32)


def _tokens(column: pa.Array, second: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts as (first row, last row, hashes, second hashes, first token of each text).

    Every text is its words and one end token."""
    for i, j, buf, offs in scan.text_slices(column):
        low = scan.LOWER[buf]
        s, e, at = scan.words(low, offs, scan.NON_SPACE)
        n = j - i
        ends = at[1:] + np.arange(n)
        h = np.empty(len(s) + n, np.uint64)
        g = np.empty(len(s) + n if second else 0, np.uint32)
        word = np.ones(len(h), bool)
        word[ends] = False
        h[word], h[ends] = scan.span_hash(scan.prefix_hash(low), s, e), END_HASH
        if second:
            g[word], g[ends] = _second(low, s, e), END_SECOND
        yield i, j, h, g, at + np.arange(n + 1)


class Words:
    """A bounded table of words by hash, with one number array for each column."""

    def __init__(self, h: np.ndarray, g: np.ndarray, **columns: np.ndarray):
        order = np.lexsort((g, h))
        self.h, self.g = h[order], g[order]
        self.columns = {k: v[order] for k, v in columns.items()}

    def find(self, h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
        """Place of each word, -1 for those not in the table."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        if g is not None:
            found &= self.g[at] == g
        return np.where(found, at, -1)


def _arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: T.StructType) -> DataFrame:
    """mapInArrow with one function over all batches of a task, yielding lists of columns."""
    ship_library(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _folds(batches: Iterator[pa.RecordBatch], second: bool, pick: Callable[..., list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """Collects ``pick(hashes, second hashes, first tokens)`` over slices, about ``most`` entries at a time."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        for _, _, h, g, at in _tokens(batch.column("text"), second):
            got = pick(h, g, at)
            if len(got[0]):
                held.append(got)
                n += len(got[0])
            if n >= most:
                yield [np.concatenate(c) for c in zip(*held)]
                held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of the runs of ``values`` that begin at ``starts``."""
    ends = np.append(starts[1:], len(values)) if len(starts) else starts
    width = values.dtype.itemsize
    offsets = np.append(starts, ends[-1:] if len(starts) else 0) * width
    if offsets[-1] >= 1 << 31:
        raise ValueError("a fold is too large")
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


# -- 1 core words ---------------------------------------------------------------

PART = 1 << 10
SKETCHES = _schema(part=I32, salt=I32, counts=BIN)


def _sketch(train: DataFrame) -> np.ndarray:
    """Training tokens in each bucket of the sketch."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, h, _, _ in _tokens(batch.column("text"), False):
                total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        salt = TaskContext.get().partitionId() & 255
        if total.any():
            n = SKETCH // PART
            yield [np.arange(n), np.full(n, salt), [p.tobytes() for p in total.reshape(n, PART)]]

    rows = _arrow_map(train.select("text"), fn, SKETCHES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: tuple[tuple[int, int], np.ndarray] | None = None
        for batch in batches:
            for part, salt, counts in zip(batch.column("part").to_pylist(), batch.column("salt").to_pylist(), batch.column("counts").to_pylist()):
                if held and held[0] == (part, salt):
                    held[1][:] += np.frombuffer(counts, np.int64)
                    continue
                if held:
                    yield [[held[0][0]], [held[0][1]], [held[1].tobytes()]]
                held = (part, salt), np.frombuffer(counts, np.int64).copy()
        if held:
            yield [[held[0][0]], [held[0][1]], [held[1].tobytes()]]

    out = np.zeros((SKETCH // PART, PART), np.int64)
    for keys in (["part", "salt"], ["part"]):
        rows = rows if len(keys) == 2 else rows.withColumn("salt", F.lit(0))
        rows = _arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys), add, SKETCHES)
    for r in rows.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


WORD_COUNTS = _schema(h=I64, g=I32, n=I64)


def core_words(train: DataFrame, most: int) -> tuple[Words, int]:
    """The words that reach the threshold, with their counts (the end token first), and the number of training tokens."""
    sketch = _sketch(train)
    total = int(sketch.sum())
    if not total:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.uint32), n=np.zeros(0, np.int64), id=np.zeros(0, np.int64)), 0
    ranked = np.sort(sketch)[::-1]
    threshold = max(1, int(ranked[min(most, len(ranked) - 1)]) + 1) if ranked[min(most, len(ranked) - 1)] else 1
    heavy = train.sparkSession.sparkContext.broadcast(np.packbits(sketch >= threshold))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        on = np.unpackbits(heavy.value).astype(bool)

        def pick(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            keep = on[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
            return [h[keep], g[keep]]

        for h, g in _folds(batches, True, pick, FOLD):
            starts, h, g, order = _runs(h, g)
            yield [h[starts].view(np.int64), g[starts].view(np.int32), np.diff(np.append(starts, len(h)))]

    counts = _arrow_map(train.select("text"), fn, WORD_COUNTS).groupBy("h", "g").agg(F.sum("n").alias("n"))
    got = counts.where((F.col("n") >= threshold) | (F.col("h") == int(END_HASH.view(np.int64)))).orderBy(F.desc(F.col("h") == int(END_HASH.view(np.int64))), F.desc("n"), "h", "g").limit(most).toArrow()
    heavy.destroy()
    h, g = got.column("h").to_numpy().view(np.uint64), got.column("g").to_numpy().view(np.uint32)
    if not len(h) or h[0] != END_HASH:  # fewer documents than the threshold
        ends = train.count()
        h, g = np.append(END_HASH, h[: most - 1]), np.append(END_SECOND, g[: most - 1])
        n = np.append(ends, got.column("n").to_numpy()[: most - 1])
    else:
        n = got.column("n").to_numpy()
    return Words(h, g, n=n.astype(np.int64), id=np.arange(len(h))), total


def _runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of equal words after sorting; sorted hashes; the order."""
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    if len(h) and ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():
        again = np.lexsort((g, h))
        h, g, order = h[again], g[again], order[again]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return np.flatnonzero(new), h, g, order


# -- 2 exchange clustering --------------------------------------------------------

NEIGHBOURS = _schema(word=I32, salt=I32, other=BIN, n=BIN)


def _pairs_of(codes: np.ndarray, n: np.ndarray, width: int, salt: int) -> list:
    """Rows of packed neighbour counts from sorted codes word * width + other."""
    word, other = codes // width, (codes % width).astype(np.int32)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    return [word[starts].astype(np.int32), np.full(len(starts), salt, np.int32), _lists(other, starts), _lists(n.astype(np.int64), starts)]


def _left_neighbours(train: DataFrame, shared: object, size: int) -> DataFrame:
    """For each core word (or ``size``: any other word) packed counts of the core words before it."""
    width = size + 1

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        core: Words = shared.value
        salt = TaskContext.get().partitionId() & 63

        def pick(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            k = core.find(h)
            ids = np.where(k >= 0, core.columns["id"][k], size)
            left = np.empty_like(ids)
            left[1:] = ids[:-1]
            left[at[:-1]] = 0
            keep = (ids < size) | (left < size)
            return [ids[keep] * width + left[keep]]

        for (codes,) in _folds(batches, False, pick, FOLD):
            yield _pairs_of(*np.unique(codes, return_counts=True), width, salt)

    return _merged(_arrow_map(train.select("text"), fn, NEIGHBOURS), width)


def _merged(rows: DataFrame, width: int) -> DataFrame:
    """Packed rows of a word added up, first within each salt; one word is held at a time."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        key, total = None, np.zeros(width, np.int64)

        def out() -> list:
            other = np.flatnonzero(total)
            return [[key[0]], [key[1]], [other.astype(np.int32).tobytes()], [total[other].tobytes()]]

        for batch in batches:
            for word, salt, other, n in zip(*(batch.column(c).to_pylist() for c in NEIGHBOURS.names)):
                if key != (word, salt):
                    if key is not None:
                        yield out()
                    key = word, salt
                    total[:] = 0
                total[np.frombuffer(other, np.int32)] += np.frombuffer(n, np.int64)
        if key is not None:
            yield out()

    for keys in (["word", "salt"], ["word"]):
        rows = rows if len(keys) == 2 else rows.withColumn("salt", F.lit(0))
        rows = _arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys), fn, NEIGHBOURS)
    return rows


def _turned(rows: DataFrame, width: int) -> DataFrame:
    """The same counts by the other word."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        salt = TaskContext.get().partitionId() & 63
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                other = [np.frombuffer(b, np.int32) for b in part.column("other").to_pylist()]
                word = np.repeat(part.column("word").to_numpy(), [len(o) for o in other])
                codes = np.concatenate(other).astype(np.int64) * width + word
                n = np.concatenate([np.frombuffer(b, np.int64) for b in part.column("n").to_pylist()])
                order = np.argsort(codes)
                yield _pairs_of(codes[order], n[order], width, salt)

    return _merged(_arrow_map(rows, fn, NEIGHBOURS), width)


BUCKET = _schema(bucket=I32, word=BIN, left_size=BIN, left=BIN, left_n=BIN, right_size=BIN, right=BIN, right_n=BIN)


def neighbourhoods(train: DataFrame, shared: object, size: int) -> DataFrame:
    """One row for each bucket of core words: their neighbours and counts on both sides."""
    left = saved(_left_neighbours(train, shared, size), "left-neighbours")
    both = left.withColumn("salt", F.lit(0)).unionAll(_turned(left, size + 1).withColumn("salt", F.lit(1)))
    both = both.withColumn("bucket", F.col("word") % BUCKETS)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: dict[int, dict[int, list]] = {}
        last = None
        for batch in batches:
            for bucket, word, side, other, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "word", "salt", "other", "n"))):
                if bucket != last and last is not None:
                    yield _bucket_row(last, held)
                    held = {}
                last = bucket
                held.setdefault(word, [b"", b"", b"", b""])[2 * side : 2 * side + 2] = [other, n]
        if last is not None:
            yield _bucket_row(last, held)

    rows = both.repartition("bucket").sortWithinPartitions("bucket", "word", "salt")
    return saved(_arrow_map(rows, fn, BUCKET), "neighbourhoods")


def _bucket_row(bucket: int, words: dict[int, list]) -> list:
    keys = sorted(words)
    cols = [np.array(keys, np.int32).tobytes()]
    for side in (0, 2):
        cols += [np.array([len(words[w][side]) // 4 for w in keys], np.int32).tobytes(), b"".join(words[w][side] for w in keys), b"".join(words[w][side + 1] for w in keys)]
    return [[bucket], *([c] for c in cols)]


def _bucket_words(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word, left neighbours, counts, right neighbours, counts) in order."""
    sides = []
    for s in ("left", "right"):
        ends = np.cumsum(np.frombuffer(row[f"{s}_size"], np.int32))
        sides.append((np.split(np.frombuffer(row[s], np.int32), ends[:-1]), np.split(np.frombuffer(row[f"{s}_n"], np.int64), ends[:-1])))
    words = np.frombuffer(row["word"], np.int32).tolist()
    yield from zip(words, *sides[0], *sides[1])


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to a constant of the corpus."""
    return float(_xlog(m).sum() - _xlog(m.sum(axis=0)).sum() - _xlog(m.sum(axis=1)).sum())


def gains(m: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, classes: int) -> np.ndarray:
    """Change of the likelihood when a word joins each class.

    left[c] and right[c] count its neighbours in class c without the word itself, own its
    pairs with itself; m doesn't hold the word."""
    c = classes
    a = _xlog(m[:, :c] + left[:, None]) - _xlog(m[:, :c])
    b = _xlog(m[:c] + right[None, :]) - _xlog(m[:c])
    k = np.arange(c)
    twice = _xlog(m[k, k] + left[k] + right[k] + own) - _xlog(m[k, k])
    # its pairs also count at the ends of its neighbours' classes, alike whatever class it joins
    cols, rows = m.sum(axis=0)[:c] + right[:c], m.sum(axis=1)[:c] + left[:c]
    ends = _xlog(cols + left.sum() + own) - _xlog(cols) + _xlog(rows + right.sum() + own) - _xlog(rows)
    return a.sum(axis=0) - a[k, k] + b.sum(axis=1) - b[k, k] + twice - ends


def _shift(m: np.ndarray, c: int, left: np.ndarray, right: np.ndarray, own: float, sign: int) -> None:
    m[:, c] += sign * left
    m[c] += sign * right
    m[c, c] += sign * own


def exchange(row: dict, m: np.ndarray, of: np.ndarray, classes: int) -> tuple[list[int], list[int]]:
    """Moves the words of one bucket in turn; their classes afterwards."""
    m, of = m.astype(np.float64), of.copy()
    size = len(of) - 1
    words = []
    for w, lw, ln, rw, rn in _bucket_words(row):
        if w == size:
            continue
        own = float(ln[lw == w].sum())
        left = np.bincount(of[lw[lw != w]], ln[lw != w], classes + 1)
        right = np.bincount(of[rw[rw != w]], rn[rw != w], classes + 1)
        old = int(of[w])
        _shift(m, old, left, right, own, -1)
        g = gains(m, left, right, own, classes)
        best = int(np.argmax(g))
        of[w] = best if g[best] > g[old] + 1e-9 * abs(g[old]) else old
        _shift(m, int(of[w]), left, right, own, 1)
        words.append(w)
    return words, of[words].tolist()


CELLS = _schema(a=I32, b=I32, n=I64)
MOVES = _schema(word=I32, cls=I32)


def _class_counts(buckets: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    shared = buckets.sparkSession.sparkContext.broadcast(of)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        cls, width = shared.value, classes + 1
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for w, lw, ln, _, _ in _bucket_words(row):
                    total += np.bincount(cls[lw] * width + cls[w], ln, width * width).astype(np.int64)
        at = np.flatnonzero(total)
        yield [at // width, at % width, total[at]]

    m = np.zeros((classes + 1, classes + 1))
    cols = ["word", "left_size", "left", "left_n", "right_size", "right", "right_n"]
    for a, b, n in _arrow_map(buckets.select(*cols), fn, CELLS).groupBy("a", "b").agg(F.sum("n")).collect():
        m[a, b] = n
    shared.destroy()
    return m


def cluster(buckets: DataFrame, size: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word (entry ``size`` is the class of all other words, ``classes``) and the class bigram counts."""
    of = np.append(np.arange(size) % classes, classes)
    m = _class_counts(buckets, of, classes)
    best = likelihood(m)
    rested = 0
    for k in range(rounds):
        shared = buckets.sparkSession.sparkContext.broadcast((m, of))

        def fn(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[list]:
            counts, cls = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    yield list(exchange(row, counts, cls, classes))

        new = of.copy()
        for w, c in _arrow_map(buckets.where(F.col("bucket") % 2 == k % 2), fn, MOVES).collect():
            new[w] = c
        shared.destroy()
        counts = _class_counts(buckets, new, classes)
        value = likelihood(counts)
        gain = value - best
        if gain > 0:
            of, m, best = new, counts, value
        rested = rested + 1 if gain <= 1e-4 * abs(best) else 0
        if rested == 2:  # neither half of the buckets moves any more
            break
    return of, m


# -- 3 all other words --------------------------------------------------------------

CONTEXTS = _schema(h=I64, g=I32, n=I64, seen=BIN, times=BIN)
VOCABULARY = _schema(h=I64, g=I32, n=I64, cls=I32)


def other_words(train: DataFrame, shared: object, classes: int) -> DataFrame:
    """Every training word outside the core with its count and class."""
    width = classes + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        core, of, _ = shared.value

        def pick(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            k = core.find(h, g)
            cls = np.where(k >= 0, of[core.columns["id"][k]], classes)
            left, right = np.empty_like(cls), np.empty_like(cls)
            left[1:], right[:-1] = cls[:-1], cls[1:]
            left[at[:-1]] = of[0]
            keep = k < 0  # an end token is always core, so every such word has a token after it
            return [h[keep], g[keep], (left[keep] * 256 + right[keep]).astype(np.uint16)]

        for h, g, context in _folds(batches, True, pick, FOLD):
            starts, h, g, order = _runs(h, g)
            context = context[order]
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
            # left classes as 0..127, right ones as 128..255
            codes = np.concatenate([which * 256 + (context >> 8), which * 256 + 128 + (context & 255)])
            codes, n = np.unique(codes, return_counts=True)
            firsts = np.searchsorted(codes, np.arange(len(starts)) * 256)
            yield [h[starts].view(np.int64), g[starts].view(np.int32), np.diff(np.append(starts, len(h))),
                   _lists((codes % 256).astype(np.uint8), firsts), _lists(n.astype(np.uint32), firsts)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        m = shared.value[2]
        tail: tuple | None = None
        for batch in batches:
            h, g, n = (batch.column(c).to_numpy() for c in ("h", "g", "n"))
            seen, times = (_flat(batch.column(c), t) for c, t in (("seen", np.uint8), ("times", np.uint32)))
            size = np.diff(np.frombuffer(batch.column("seen").buffers()[1], np.int32, batch.num_rows + 1, batch.column("seen").offset * 4))
            if tail:
                h, g, n = (np.append(a, b) for a, b in zip(tail[:3], (h, g, n)))
                seen, times, size = np.append(tail[3], seen), np.append(tail[4], times), np.append(len(tail[3]), size)
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            word = np.repeat(np.cumsum(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) - 1, size)
            codes, back = np.unique(word * 256 + seen, return_inverse=True)
            total = np.bincount(back, times, len(codes))
            count = np.add.reduceat(n, new)
            done = len(new) - 1  # the last word may go on in the next batch
            on = codes < done * 256
            if done:
                yield [h[new[:done]], g[new[:done]], count[:done], _classes_of(codes[on], total[on], done, m, classes)]
            tail = (h[new[-1:]], g[new[-1:]], count[-1:], (codes[~on] % 256).astype(np.uint8), total[~on].astype(np.int64))
        if tail:
            codes = tail[3].astype(np.int64)
            yield [*tail[:3], _classes_of(codes, tail[4].astype(np.float64), 1, m, classes)]

    assert width < 128
    rows = _arrow_map(train.select("text"), gather, CONTEXTS)
    return _arrow_map(rows.repartition("h", "g").sortWithinPartitions("h", "g"), assign, VOCABULARY)


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    return np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // width, offsets[0]) if data is not None else np.zeros(0, kind)


def _classes_of(codes: np.ndarray, n: np.ndarray, words: int, m: np.ndarray, classes: int) -> np.ndarray:
    """The class each word gains most in: codes are word * 256 + left class, or + 128 + right class."""
    word, c = codes // 256, codes % 256
    right = c >= 128
    c = c % 128
    known = c < classes  # neighbours outside the core have no class yet
    out = np.empty(words, np.int32)
    cols, rows = m.sum(axis=0)[:classes], m.sum(axis=1)[:classes]
    step = 1 << 13
    bounds = np.searchsorted(word, np.arange(0, words + step, step))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        first, last = i * step, min(words, (i + 1) * step)
        if first >= last:
            break
        gain = np.zeros((last - first, classes))
        for side, ends in ((False, cols), (True, rows)):
            on = np.flatnonzero((right[a:b] == side) & known[a:b]) + a
            if not len(on):
                continue
            w, k, x = word[on] - first, c[on], n[on].astype(np.float64)
            base = (m[:classes].T if side else m)[k, :classes]
            each = _xlog(base + x[:, None]) - _xlog(base)
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            total = np.add.reduceat(x, starts)[:, None]
            gain[w[starts]] += np.add.reduceat(each, starts) - (_xlog(ends + total) - _xlog(ends))
        # a word without a neighbour in the core joins the largest class
        out[first:last] = np.where(gain.any(axis=1), np.argmax(gain, axis=1), int(np.argmax(cols)))
    return out


# -- 4 scoring ----------------------------------------------------------------------

RARE = T.ArrayType(_schema(h=I64, g=I32))
ROWS = _schema(row=I64, doc_id=I64, held_out=T.BooleanType(), classes=BIN, n_known=I64, base=DBL, emission=DBL, hole=BIN, which=BIN, rare=RARE)
SEQUENCES = _schema(doc_id=I64, held_out=T.BooleanType(), classes=BIN, n_known=I64, base=DBL, emission=DBL)
SCORED = _schema(doc_id=I64, held_out=T.BooleanType(), n_tokens=I64, n_known=I64, train_tokens=I64, base_score=DBL, score=DBL)


def _log_base(count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log10((count + 1) / (total + distinct + 1))


def _per_document(docs: DataFrame, shared: object) -> DataFrame:
    """Each row with a number of its own, the classes and sums of its common words, and its other words by place."""
    names = to_arrow_schema(ROWS)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        words, total, distinct, sizes = shared.value
        row = TaskContext.get().partitionId() << 36
        count = words.columns["n"]
        base = _log_base(count, total, distinct)
        with np.errstate(divide="ignore"):
            emission = np.log10(count / sizes[words.columns["cls"]]) if len(count) else base
        marked = (words.columns["cls"] | np.where(count == 1, SINGLE, 0)).astype(np.uint8)
        for batch in batches:
            for i, j, h, g, at in _tokens(batch.column("text"), True):
                k = words.find(h, g)
                on = k >= 0
                cls = np.full(len(h), UNKNOWN, np.uint8)
                cls[on] = marked[k[on]]
                # every text has a token, so no run is empty; equal texts get equal sums
                sums = [np.add.reduceat(np.where(on, t[k], 0.0), at[:-1]) for t in (base, emission)]
                known = np.concatenate([[0], np.cumsum(on)])
                hole = np.flatnonzero(~on)
                text = np.searchsorted(at, hole, "right") - 1
                order = np.lexsort((g[hole], h[hole], text))
                t, hh, gg = text[order], h[hole][order], g[hole][order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1])
                distinct_of = np.bincount(t[new], minlength=j - i)
                firsts = np.cumsum(distinct_of) - distinct_of
                which = np.empty(len(t), np.int32)
                which[order] = np.cumsum(new) - 1 - firsts[t]
                holes = np.searchsorted(hole, at[:-1])
                items = pa.StructArray.from_arrays([pa.array(hh[new].view(np.int64)), pa.array(gg[new].view(np.int32))], fields=list(names.field("rare").type.value_type))
                yield [np.arange(row, row + j - i), batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), _lists(cls, at[:-1]),
                       np.diff(known[at]), *sums, _lists((hole - at[:-1][text]).astype(np.int32), holes), _lists(which, holes),
                       list_array(items, distinct_of).cast(names.field("rare").type)]
                row += j - i

    return _arrow_map(docs.select("doc_id", "held_out", "text"), fn, ROWS)


def _completed(rows: DataFrame, rare: DataFrame, total: int, distinct: int, sizes: np.ndarray) -> DataFrame:
    """Class sequences with the classes, counts and sums of the words found in the distributed table."""
    pairs = rows.select("row", F.posexplode("rare").alias("k", "w")).select("row", "k", "w.h", "w.g")
    found = pairs.join(rare, ["h", "g"]).groupBy("row").agg(F.collect_list(F.struct("k", "n", "cls")).alias("found"))
    joined = rows.drop("rare").join(found, "row", "left")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                classes, known, base, emission = [], batch.column("n_known").to_numpy().copy(), batch.column("base").to_numpy().copy(), batch.column("emission").to_numpy().copy()
                for i, (cls, hole, which) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("classes", "hole", "which")))):
                    hole, which = np.frombuffer(hole, np.int32), np.frombuffer(which, np.int32)
                    if not len(hole):
                        classes.append(cls)
                        continue
                    got = batch.column("found")[i].values
                    n, c = np.zeros(int(which.max()) + 1, np.int64), np.full(int(which.max()) + 1, UNKNOWN, np.int64)
                    if got is not None and len(got):
                        k = got.field("k").to_numpy()
                        n[k], c[k] = got.field("n").to_numpy(), got.field("cls").to_numpy()
                    seq = np.frombuffer(cls, np.uint8).copy()
                    seq[hole] = (c | np.where(n == 1, SINGLE, 0))[which]
                    times = np.bincount(which, minlength=len(n))
                    real = n > 0
                    known[i] += times[real].sum()
                    base[i] += (times * _log_base(n, total, distinct)).sum()
                    emission[i] += (times[real] * np.log10(n[real] / sizes[c[real]])).sum()
                    classes.append(seq.tobytes())
                yield [batch.column("doc_id"), batch.column("held_out"), classes, known, base, emission]

    return _arrow_map(joined, fn, SEQUENCES)


def _steps(cls: np.ndarray, firsts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(context class, marked class) of each token of the concatenated sequences."""
    plain = cls & 127
    known = plain != UNKNOWN
    last = np.where(known, np.arange(len(cls)), -1)
    last = np.maximum.accumulate(last)
    before = np.empty(len(cls), np.int64)
    before[1:] = last[:-1]
    before[:1] = -1
    first_of = np.repeat(firsts, np.diff(np.append(firsts, len(cls))))
    inside = before >= first_of
    return np.where(inside, plain[np.maximum(before, 0)].astype(np.int64), start), cls


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray(pa.compute.binary_length(batch.column("classes")))
    return _flat(batch.column("classes"), np.uint8), np.cumsum(size) - size


def _transitions(rows: DataFrame, start: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigram counts over the training documents, and the single words after each class."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(classes * 256, np.int64)
        for batch in batches:
            context, cls = _steps(*_sequences(batch), start)
            total += np.bincount(context * 256 + cls, minlength=classes * 256)
        at = np.flatnonzero(total)
        yield [at // 256, at % 256, total[at]]

    m, singles = np.zeros((classes, classes)), np.zeros(classes)
    for a, b, n in _arrow_map(rows.where(~F.col("held_out")).select("classes"), fn, CELLS).groupBy("a", "b").agg(F.sum("n")).collect():
        m[a, b & 127] += n
        singles[a] += n if b & SINGLE else 0
    return m, singles


def model(m: np.ndarray, singles: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each class after each class; the last column is that of an unknown word."""
    after = (m > 0).sum(axis=1, keepdims=True).clip(1)
    n = m.sum(axis=1, keepdims=True)
    unknown = (singles[:, None] + after / (total + distinct + 1)) / (n + after)
    share = m.sum(axis=0) / max(1.0, m.sum())
    with np.errstate(divide="ignore"):
        return np.log10(np.hstack([(1 - unknown) * (m + after * share) / (n + after), unknown]))


def score(docs: DataFrame, held_out_of: Callable[[str], object], classes: int = CLASSES, core: int = CORE, common: int = COMMON, rounds: int = ROUNDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out_of`` gives the condition on the id column that holds a row out of training."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                    F.coalesce(held_out_of(id_col), F.lit(False)).alias("held_out"))
    train = d.where(~F.col("held_out"))
    words, total = core_words(train, core)
    if not total:
        size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        return d.select("doc_id", "held_out", (size + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"),
                        F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    size = len(words.h)
    shared = spark.sparkContext.broadcast(words)
    of, m = cluster(neighbourhoods(train, shared, size), size, classes, rounds)
    shared.destroy()
    shared = spark.sparkContext.broadcast((words, of, m))
    others = saved(other_words(train, shared, classes), "class-words")
    shared.destroy()

    cls = of[words.columns["id"]]
    sizes = np.bincount(cls, words.columns["n"], classes)
    distinct = size
    level = F.floor(F.log2("n")).cast("int")
    levels: dict[int, int] = {}
    for r in others.groupBy(level.alias("level"), "cls").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect():
        sizes[r["cls"]] += r["n"]
        distinct += r["words"]
        levels[r["level"]] = levels.get(r["level"], 0) + r["words"]
    cut = max(levels, default=0) + 1
    while cut > 0 and sum(n for k, n in levels.items() if k >= cut - 1) <= common - size:
        cut -= 1
    often = others.where(F.col("n") >= 1 << cut).toArrow()
    table = Words(np.append(words.h, often.column("h").to_numpy().view(np.uint64)), np.append(words.g, often.column("g").to_numpy().view(np.uint32)),
                  n=np.append(words.columns["n"], often.column("n").to_numpy()), cls=np.append(cls, often.column("cls").to_numpy()))
    shared = spark.sparkContext.broadcast((table, total, distinct, sizes))
    rows = saved(_per_document(d, shared), "class-rows")
    shared.destroy()
    done = saved(_completed(rows, others.where(F.col("n") < 1 << cut), total, distinct, sizes), "class-sequences")

    start = int(of[0])
    logs = model(*_transitions(done, start, classes), total, distinct)
    last = np.full((classes, 128), -np.inf)
    last[:, :classes], last[:, UNKNOWN] = logs[:, :classes], logs[:, classes]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            seq, firsts = _sequences(batch)
            context, marked = _steps(seq, firsts, start)
            chances = np.add.reduceat(last[context, marked & 127], firsts)
            yield [batch.column("doc_id"), batch.column("held_out"), np.diff(np.append(firsts, len(seq))), batch.column("n_known"), np.full(batch.num_rows, total),
                   batch.column("base"), chances + batch.column("emission").to_numpy()]

    return _arrow_map(done, fn, SCORED)
