"""Benchmark decontamination (operator 10).

Each task cuts its rows into shards of about ``SHARD_BYTES`` of text and builds
an FM-index per shard over word ids. All windows of the benchmark are searched
backward through the wavelet ranks at once, their occurrences located by
sampled suffix positions, and the removal spans merged. Nothing is shuffled.

A shard indexes the words that may lie in a match: a word is left out only if
no run of ``GRAM`` words over it (or of the window's length, if shorter) occurs
in any benchmark window, which no matching word can be. Left-out words become
separators, so the index is small on clean text.

Definitions: words are maximal runs of ASCII letters, digits and non-ASCII
characters after A-Z is lower-cased. A window is ``window`` consecutive words
of an item; an item with fewer words, but not none, is one window.

Edge cases: null or empty texts have no words and no hits. Repeated rows each
get their own result. Items without words match nothing. An empty benchmark
leaves every document clean. A null item id takes part in hits, but isn't
listed. Columns with the result names are kept under their own names; the
results then get a trailing underscore. Words are compared by 64-bit hashes.

The benchmark is a stated query set: it is read in blocks of bounded text size
and each block is broadcast in its own pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.common import free_name, list_array, map_arrow, saved
from tessera.llm.fm_index import FMIndex

WINDOW = 13
GRAM = 4
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20


class Phrases:
    """The benchmark windows of one block, ready for search."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.large_string())
        self.item_ids = np.array([-1 if i is None else i for i, _ in items], np.int64)
        self.item_null = np.array([i is None for i, _ in items], bool)
        rows, owners = [], []
        for a, b, buf, offs in scan.text_slices(texts, 1 << 62):
            h, _, _, at = scan.word_hashes(buf, offs, scan.ALNUM)
            for k in range(b - a):
                w = h[at[k] : at[k + 1]]
                size = min(window, len(w))
                if size:
                    rows += [w[j : j + size] for j in range(len(w) - size + 1)]
                    owners += [a + k] * (len(w) - size + 1)
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        lengths = np.array([len(r) for r in rows], np.int64)
        ids = np.zeros((len(rows), window), np.int32)
        for j, r in enumerate(rows):
            ids[j, : len(r)] = np.searchsorted(self.vocabulary, r) + 1
        uniq, inverse = np.unique(ids, axis=0, return_inverse=True) if rows else (ids, np.zeros(0, np.int64))
        self.windows, inverse = uniq, inverse.reshape(-1)
        self.lengths = (uniq > 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse, np.array(owners, np.int64)], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(uniq) + 1))
        # runs of GRAM words by their length; of each window also its first one
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.first_gram = np.zeros(len(uniq), np.int64)
        self.gram_size = np.minimum(GRAM, self.lengths)
        words = np.concatenate([np.zeros(1, np.uint64), self.vocabulary])
        for q in np.unique(self.gram_size):
            own = np.flatnonzero(self.gram_size == q)
            h = [scan.runs_hash(words[self.windows[j, : self.lengths[j]]], int(q)) for j in own]
            table = np.unique(np.concatenate(h))
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[table >> np.uint64(64 - FILTER_BITS)] = True
            self.grams[int(q)] = (table, seen)
            self.first_gram[own] = np.searchsorted(table, [x[0] for x in h])


def shard_hits(buf: np.ndarray, offs: np.ndarray, ph: Phrases) -> tuple[np.ndarray, ...]:
    """Of one shard: words of each text, word starts and ends, first word of
    each text, a mask of the words hit, and distinct (text, item) pairs."""
    h, s, e, at = scan.word_hashes(buf, offs, scan.ALNUM)
    n = len(h)
    hit = np.zeros(n, bool)
    none = np.zeros((0, 2), np.int64)
    if not n or not len(ph.windows):
        return np.diff(at), s, e, at, hit, none
    text = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    alive = np.zeros(n + 1, np.int32)
    wanted = np.zeros(len(ph.windows), bool)
    for q, (table, seen) in ph.grams.items():
        g = scan.runs_hash(h, q)
        maybe = np.flatnonzero(seen[g >> np.uint64(64 - FILTER_BITS)])
        maybe = maybe[text[maybe] == text[maybe + q - 1]]
        k = np.minimum(np.searchsorted(table, g[maybe]), len(table) - 1)
        is_in = table[k] == g[maybe]
        starts = maybe[is_in]
        alive += np.bincount(starts, minlength=n + 1).astype(np.int32) - np.bincount(starts + q, minlength=n + 1).astype(np.int32)
        found = np.zeros(len(table), bool)
        found[k[is_in]] = True
        own = ph.gram_size == q
        wanted[own] = found[ph.first_gram[own]]
    words = np.flatnonzero(np.cumsum(alive[:-1]) > 0)
    wanted = np.flatnonzero(wanted)
    if not len(words) or not len(wanted):
        return np.diff(at), s, e, at, hit, none
    fresh = np.ones(len(words), bool)  # a separator goes before it
    fresh[1:] = (np.diff(words) > 1) | (text[words[1:]] != text[words[:-1]])
    place = np.arange(len(words)) + np.cumsum(fresh)
    seq = np.zeros(len(words) + int(fresh.sum()), np.int32)
    seq[place] = np.searchsorted(ph.vocabulary, h[words]) + 1
    back = np.zeros(len(seq), np.int64)
    back[place] = words
    index = FMIndex(seq, len(ph.vocabulary))
    lo, hi = index.search(ph.windows[wanted], ph.lengths[wanted])
    count = hi - lo
    total = int(count.sum())
    if not total:
        return np.diff(at), s, e, at, hit, none
    which = np.repeat(wanted, count)
    rows = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    start = back[index.locate(rows)]
    cover = np.bincount(start, minlength=n + 1) - np.bincount(start + ph.lengths[which], minlength=n + 1)
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(np.stack([text[start], which], axis=1), axis=0)  # (text, window)
    times = np.diff(ph.owner_at)[pairs[:, 1]]
    of = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ph.owner_at[pairs[:, 1]], times)
    items = np.unique(np.stack([np.repeat(pairs[:, 0], times), ph.owner[of]], axis=1), axis=0)
    return np.diff(at), s, e, at, hit, items


def merge_spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked words that stay inside a text: first and last
    word of each, and the number of runs of each text."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return a, b, np.diff(np.searchsorted(a, at))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                 T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType())]))


def _one_pass(df: DataFrame, block: list[tuple[int | None, str | None]], text_col: str, names: dict[str, str], window: int, earlier: bool, drop_text: bool) -> DataFrame:
    """Adds (or extends) the result columns for one block of the benchmark."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Phrases(block, window))
    keep = [f for f in df.schema.fields if f.name not in names.values() and not (drop_text and f.name == text_col)]
    schema = T.StructType([*keep, T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], SPAN),
                           T.StructField(names["items"], T.ArrayType(T.LongType()))])
    n_words, spans, items = (names[k] for k in ("n_words", "spans", "items"))

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        ph: Phrases = shared.value
        for i, j, buf, offs in scan.text_slices(batch.column(text_col), SHARD_BYTES):
            part = batch.slice(i, j - i)
            counts, s, e, at, hit, pairs = shard_hits(buf, offs, ph)
            listed = [[] for _ in range(j - i)]
            if earlier:
                old = part.column(spans).to_pylist()
                for k, x in enumerate(old):
                    for sp in x:
                        w = at[k] + sp["first_word"]
                        hit[w : w + sp["words"]] = True
                listed = [list(x) for x in part.column(items).to_pylist()]
            for k, it in pairs:
                if not ph.item_null[it]:
                    listed[k].append(int(ph.item_ids[it]))
            a, b, per = merge_spans(hit, at)
            doc = np.repeat(np.arange(j - i), per)
            rows = pa.StructArray.from_arrays(
                [pa.array(x, pa.int32()) for x in (s[a] - offs[doc], e[b] - offs[doc], a - at[doc], b - a + 1)],
                fields=[pa.field(n, pa.int32()) for n in ("start", "end", "first_word", "words")])
            yield {**{f.name: part.column(f.name) for f in keep}, n_words: counts, spans: list_array(rows, per),
                   items: [sorted(set(x)) for x in listed]}

    return map_arrow(df, fn, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (the text only if ``keep_text``) with ``n_words``,
    ``spans`` (merged removal spans: byte range in the text, first word and
    number of words) and ``items`` (sorted distinct ids of items with a window
    that occurs)."""
    names = {}
    for base in ("n_words", "spans", "items"):
        names[base] = free_name(docs.columns, base)
    df = docs.withColumn(text_col, F.col(text_col).cast("string"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        block = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        df = _one_pass(df, block, text_col, names, window, b > 0, b == blocks - 1 and not keep_text)
        if b < blocks - 1:
            df = saved(df, "contamination")
    return df


def hit_words(spans: str) -> F.Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, x: acc + x["words"])


def digest(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The contract's columns per document."""
    cols = docs.select("doc_id", "text")
    out = contamination(cols, benchmark, keep_text=False, **options)
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id", "n_words", hit_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Documents whose hit words aren't at least a twentieth of their words."""
    out = contamination(docs, benchmark, **options)
    words, spans, _ = out.columns[-3:]
    n = hit_words(spans)
    return out.where(~((n > 0) & (20 * n >= F.col(words)))).select(*docs.columns)
