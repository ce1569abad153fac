"""Suffix-array dedup (operator 2): removes every byte covered by a string of
``length`` bytes that also starts anywhere else in the corpus.

Texts are UTF-8 bytes; matches never cross texts; strings overlap freely and
are judged on the input. The result is exact.

1. Every window of ``length`` bytes is keyed by the smallest hash of the
   ``anchor``-byte strings inside it. Equal windows have equal keys, and
   neighbouring windows mostly share theirs, so a text becomes a few *regions*:
   runs of windows with one key. Only (key, region hash, text, place) is
   shuffled. Keys drop out if they have a single region that holds its anchor
   once.
2. Regions with equal bytes fold into one class with their number as weight. A
   class that holds several copies repeats from end to end. Where a key has
   different classes, their bytes are fetched and the classes of whole keys are
   gathered up to ``CHUNK_BYTES``; their suffix array and Burrows-Wheeler
   transform are built and expanded interval by interval up to ``length``
   (``bwt_repeats``), which marks the windows that start elsewhere as well.
3. A key whose classes exceed ``hot_bytes`` is dealt anew: its classes are cut by
   a longer anchor into finer regions, up to the whole window, where all classes
   of a key are equal. No task gathers more than one such key.
4. The marked windows become merged spans per text.

Edge cases: a null text is empty; empty and short texts lose nothing. Repeated
rows count as copies, so both lose what they share. Equal texts share one
result, found by a 64-bit hash and their length. An empty table gives no rows.
Other columns are kept as they are; a clashing column keeps its name and the
result gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import scan
from tessera.llm.bwt_repeats import repeated_starts
from tessera.llm.common import free_name, list_array, map_arrow, saved
from tessera.session import ship_library

LENGTH = 200
ANCHORS = (64, 160, 200)
MAX_RUN = 4096
CHUNK_BYTES = 1 << 20
HOT_BYTES = 8 << 20


def regions(buf: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start in the buffer, number of windows, key, hash of the bytes,
    whether the key's anchor stands in it twice) of all regions."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none, none
    p = scan.prefix_hash(buf)
    at = np.arange(len(buf) - anchor + 1)
    hashes = scan.span_hash(p, at, at + anchor)
    wide = length - anchor + 1
    low = scan.sliding_min(hashes, wide)
    sizes = np.diff(offs)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    m = len(low)  # window starts
    ok = text[:m] == text[length - 1 :]
    first = ok.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    s = np.flatnonzero(first)
    stop = np.append(s[1:], m)
    valid = np.concatenate([[0], np.cumsum(ok)])
    n = valid[stop] - valid[s]
    if (n > MAX_RUN).any():  # any cut will do: a window keeps its key
        k = -(-n // MAX_RUN)
        piece = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        s, n = np.repeat(s, k) + piece * MAX_RUN, np.minimum(np.repeat(n, k) - piece * MAX_RUN, MAX_RUN)
    key = low[s]
    # anchors: strings that are the smallest of some window (the largest of the minima around them)
    edge = np.full(wide - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    anchors = np.flatnonzero(~scan.sliding_min(np.concatenate([edge, ~low, edge]), wide) == hashes)
    a, b = np.searchsorted(anchors, s), np.searchsorted(anchors, s + n + wide - 1)
    k = b - a
    of = np.repeat(np.arange(len(s)), k)
    which = anchors[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(a, k)]
    twice = np.bincount(of[hashes[which] == key[of]], minlength=len(s)) >= 2
    return text[s].astype(np.int64), s, n, key.view(np.int64), scan.span_hash(p, s, s + n + length - 1).view(np.int64), twice


REGION = T.StructType([T.StructField("key", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("fp", T.LongType()),
                       T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("weight", T.IntegerType())])


def _text_regions(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Regions of every text (fp); a text that repeats in a batch is scanned
    once and weighs as often. ``weight`` is twice that number, plus one if the
    region may repeat inside itself."""
    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        fps, first, back, weight = _firsts(batch.column("fp").to_numpy())
        col = batch.column("text").take(pa.array(first))
        for i, j, buf, offs in scan.text_slices(col):
            t, s, n, key, h, twice = regions(buf, offs, length, anchor)
            yield {"key": key, "hash": h, "fp": fps[i + t], "start": s - offs[t], "windows": n, "weight": 2 * weight[i + t] + twice}

    return map_arrow(docs.select("text", "fp"), fn, REGION)


def _firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(values, return_index=True, return_inverse=True, return_counts=True)


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """Rows whose key has two regions or one that may repeat inside itself.
    Streams through sorted keys with one row of state."""
    names = to_arrow_schema(rows.schema)
    key_at, weight_at = rows.columns.index("key"), rows.columns.index("weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, if its fate is open
        last: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, weight = batch.column(key_at).to_numpy(), batch.column(weight_at).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(weight, starts)
            live = total >= 3
            if last is not None and key[0] == last:
                live[0] = True
                if held is not None:
                    yield held
            held = None
            keep = np.repeat(live, np.diff(np.append(starts, len(key))))
            last = int(key[-1])
            if not live[-1]:
                held = batch.slice(len(key) - 1, 1)
            yield batch.filter(pa.array(keep))

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, schema=names) for b in run(it)), rows.schema)


# -- repeated windows of classes ---------------------------------------------

CLASS = T.StructType([T.StructField("key", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("data", T.BinaryType())])
SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
MARKS = T.StructType([T.StructField("key", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("spans", SPANS)])


def _covered(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged byte spans under the marked starts."""
    s = np.flatnonzero(mask)
    if not len(s):
        return []
    gap = np.flatnonzero(np.diff(s) > length)
    return list(zip(s[np.append(0, gap + 1)].tolist(), (s[np.append(gap, len(s) - 1)] + length).tolist()))


def _expand_classes(classes: DataFrame, length: int) -> DataFrame:
    """Marks of the windows that repeat among the classes of each key."""
    names = to_arrow_schema(MARKS)

    def marks(keys: list[np.ndarray], hashes: list[np.ndarray], weights: list[np.ndarray], data: list[np.ndarray]) -> pa.RecordBatch:
        found = repeated_starts(data, np.concatenate(weights), length)
        spans = [_covered(m, length) for m in found]
        return pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "hash": np.concatenate(hashes), "spans": spans}, schema=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, weights, data = [], [], [], []
        size, last = 0, None
        for batch in batches:
            k, h, w = (batch.column(c).to_numpy() for c in range(3))
            strings = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(3)]
            lengths = np.array([len(x) for x in strings], np.int64)
            a = 0
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[:1] = last is not None and k[:1] != last
            before = np.cumsum(lengths) - lengths
            for i in np.flatnonzero(new):
                if size + before[i] - before[a] >= CHUNK_BYTES:
                    keys.append(k[a:i]), hashes.append(h[a:i]), weights.append(w[a:i]), data.extend(strings[a:i])
                    yield marks(keys, hashes, weights, data)
                    keys, hashes, weights, data = [], [], [], []
                    size, a = 0, i
            if len(k):
                keys.append(k[a:]), hashes.append(h[a:]), weights.append(w[a:]), data.extend(x.copy() for x in strings[a:])
                size += int(lengths[a:].sum())
                last = k[-1]
        if data:
            yield marks(keys, hashes, weights, data)

    ordered = classes.repartition("key").sortWithinPartitions("key", "hash").select(*CLASS.names)
    return ordered.mapInArrow(run, MARKS)


def _cut_finer(classes: DataFrame, length: int, anchor: int) -> DataFrame:
    """Finer regions of the classes: (key, hash, weight, data) with their place (up_key, up_hash, start)."""
    schema = T.StructType([*CLASS.fields, T.StructField("up_key", T.LongType()), T.StructField("up_hash", T.LongType()), T.StructField("start", T.IntegerType())])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        up_key, up_hash, weight = (batch.column(c).to_numpy() for c in range(3))
        col = batch.column("data")
        sizes = np.array([x.as_buffer().size for x in col], np.int64)
        buf = np.frombuffer(b"".join(x.as_py() for x in col), np.uint8)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        t, s, n, key, h, _ = regions(buf, offs, length, anchor)
        # the finer key only divides the old one
        key = scan.mix(key.view(np.uint64) ^ scan.mix(up_key[t].view(np.uint64))).view(np.int64)
        for a in range(0, len(t), 1 << 14):
            c = slice(a, a + (1 << 14))
            yield {"key": key[c], "hash": h[c], "weight": weight[t[c]], "up_key": up_key[t[c]], "up_hash": up_hash[t[c]], "start": s[c] - offs[t[c]],
                   "data": pa.array([buf[x : x + k + length - 1].tobytes() for x, k in zip(s[c].tolist(), n[c].tolist())], pa.binary())}

    return map_arrow(classes.select(*CLASS.names), fn, schema)


def repeated_in_classes(classes: DataFrame, length: int, anchors: tuple[int, ...], hot_bytes: int) -> DataFrame:
    """(key, hash, spans) of the classes (key, hash, weight, data); keys over
    ``hot_bytes`` are dealt anew by the next anchor."""
    if not anchors:
        return _expand_classes(classes, length)
    sizes = classes.groupBy("key").agg(F.sum(F.octet_length("data")).alias("bytes"))
    hot = saved(sizes.where(F.col("bytes") > hot_bytes).select("key"), "hot-keys")
    if hot.isEmpty():
        return _expand_classes(classes, length)
    cold = _expand_classes(classes.join(hot, "key", "left_anti"), length)
    finer = saved(_cut_finer(classes.join(hot, "key", "left_semi"), length, anchors[0]), "finer-regions")
    sub = finer.groupBy("key", "hash").agg(F.sum("weight").alias("weight"), F.first("data").alias("data"))
    found = repeated_in_classes(saved(sub.select(*CLASS.names), "finer-classes"), length, anchors[1:], hot_bytes)
    found = found.select("key", "hash", F.explode("spans").alias("s"))
    up = finer.select("key", "hash", "up_key", "up_hash", "start").join(found, ["key", "hash"])
    up = up.groupBy(F.col("up_key").alias("key"), F.col("up_hash").alias("hash")).agg(
        F.collect_list(F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))).alias("spans"))
    return cold.unionAll(up)


# -- texts -------------------------------------------------------------------

def text_spans(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(fp, spans): covered byte ranges, not yet merged, of every text (text, fp) that has any."""
    found = saved(_repeated_keys(_text_regions(docs, length, anchors[0])), "regions")
    classes = saved(found.groupBy("key", "hash").agg(
        F.sum(F.expr("weight div 2")).alias("weight"), F.max(F.expr("weight % 2")).alias("inner"),
        F.first("windows").alias("windows"), F.min(F.struct("fp", "start")).alias("at")), "classes")
    whole = classes.where("weight >= 2").select(
        "key", "hash", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + length - 1).cast("int").alias("b"))).alias("spans"))
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.max("weight").alias("most"))
    mixed = mixed.where("n > 1 OR (inner = 1 AND most = 1)").select("key")
    places = classes.join(mixed, "key", "left_semi").select("at.fp", F.struct("key", "hash", "weight", F.col("at.start").alias("start"), "windows").alias("place"))
    places = places.groupBy("fp").agg(F.collect_list("place").alias("places"))  # regions of one text
    rows = docs.groupBy("fp").agg(F.min("row_key").alias("row_key"))  # one row that holds the text
    wanted = places.join(rows, "fp").select("row_key", "places")

    def cut(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        places = batch.column("places")
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            part = places.slice(i, j - i)
            of = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            s = flat.field("start").to_numpy() + offs[of]
            e = s + flat.field("windows").to_numpy() + length - 1
            yield {**{c: flat.field(c) for c in ("key", "hash", "weight")},
                   "data": pa.array([buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())], pa.binary())}

    fetched = map_arrow(docs.join(wanted, "row_key").select("text", "places"), cut, CLASS)
    # a repeated row may bring its text twice
    fetched = fetched.dropDuplicates(["key", "hash"]) if anchors[1:] else fetched
    inside = repeated_in_classes(saved(fetched, "class-bytes"), length, anchors[1:], hot_bytes)
    marks = saved(whole.unionAll(inside.where(F.size("spans") > 0)), "marks")
    marks = marks.select("key", "hash", F.explode("spans").alias("s"))
    spans = found.join(marks, ["key", "hash"]).select(
        "fp", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")).alias("s"))
    return spans.groupBy("fp").agg(F.collect_set("s").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH,
            anchors: tuple[int, ...] = ANCHORS, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and the covered spans of each text (null if none); also that column's name."""
    ship_library(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    fp = F.xxhash64(text, F.octet_length(text))
    keyed = docs.select(text.alias("text"), fp.alias("fp"), F.xxhash64(docs[id_col], text).alias("row_key"))
    spans = saved(text_spans(keyed, length, anchors, hot_bytes), "spans")
    name = free_name(docs.columns, "spans")
    key = free_name(docs.columns, "fp")
    spans = spans.select(F.col("fp").alias(key), F.col("spans").alias(name))
    return docs.withColumn(key, fp).join(spans, key, "left").drop(key), name


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """The contract's columns per document."""
    found, name = repeats(docs.select("doc_id", "text"), **options)
    schema = T.StructType([found.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        out: dict[str, list] = {n: [] for n in schema.names[1:]}
        spans = batch.column(name)
        for text, own in zip(batch.column("text"), spans):
            data = (text.as_buffer() if text.is_valid else None) or b""
            data = memoryview(data)
            cut = merged([(x["a"], x["b"]) for x in own.as_py()]) if own.is_valid else []
            h, at = hashlib.sha256(), 0
            for a, b in cut:
                h.update(data[at:a])
                at = b
            h.update(data[at:])
            for k, v in zip(out, (len(data), sum(b - a for a, b in cut), len(cut), h.hexdigest())):
                out[k].append(v)
        yield {"doc_id": batch.column("doc_id"), **out}

    return map_arrow(found, fn, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with the covered bytes cut from the text. A character of which
    only some bytes are covered stays. Null texts stay null."""
    found, name = repeats(docs, text_col, **options)
    fields = docs.schema.fields

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        texts = []
        for text, own in zip(batch.column(text_col), batch.column(name)):
            if not own.is_valid or not text.is_valid:
                texts.append(text.as_py())
                continue
            data, at, kept = text.as_py().encode(), 0, []
            for a, b in merged([(x["a"], x["b"]) for x in own.as_py()]):
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(data[at:a])
                at = max(at, b)
            texts.append((b"".join(kept) + data[at:]).decode())
        yield {f.name: (pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name)) for f in fields}

    return map_arrow(found, fn, docs.schema)
