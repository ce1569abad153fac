"""Language ID (operator 9): string-kernel classification.

Kernel: the blended-spectrum presence kernel, the number of byte n-grams
(n = 1 to 4) that two texts share, divided by the geometric mean of their own
numbers. A-Z is lower-cased and other ASCII bytes that aren't letters count as
a space. n-grams are hashed to ``SLOTS`` slots, so a text is a bit set.

Nyström: ``landmarks`` training texts span the feature space; with K the kernel
among them and C the kernel of training texts against them, features are
C K^(-1/2). One-versus-rest kernel ridge regression is solved there, once, on
the driver. Texts are scored in batches: bit rows times the landmark matrix
times the class weights.

Training reads only text and language of documents that aren't held out: the
texts with the smallest seeded hashes of each language, at most ``PER_LANGUAGE``
of each of the ``MAX_LANGUAGES`` most frequent languages (the documented bound
of the sample); every document is scored, over its whole text.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if there is nothing to learn from. With one language all texts with
letters get it with score 1. Ties go to the first language in sort order. Null
languages are never learned; a null id isn't held out. Repeated rows get equal
results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm import scan
from tessera.llm.common import map_arrow

BITS = 15
SLOTS = 1 << BITS
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 400
MAX_LANGUAGES = 256
LANDMARKS = 128
RIDGE = 1e-2
SHARPNESS = 4.0
BATCH = 64
SEED = 9

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _slots(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of all n-grams of each length."""
    low = _FOLD[buf].astype(np.uint32)
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    code = low
    for n in GRAMS:
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | low[n - 1 :]
        if not len(code):
            return
        slot = ((code + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = text[: len(code)] == text[n - 1 :]
        yield text[: len(code)][inside], slot[inside]


def presence(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of SLOTS zeros and ones for each text."""
    x = np.zeros((len(offs) - 1, SLOTS), np.float32)
    for text, slot in _slots(buf, offs):
        x[text, slot] = 1
    return x


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = np.diff(count[offs]) > 0
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Landmark bits, their sizes, and class weights."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages = languages
        self.packed = np.packbits(landmarks.astype(bool), axis=1)
        self.weights = weights
        self._matrix: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_matrix": None}

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised kernel of rows against the landmarks, as one matrix product."""
        if self._matrix is None:
            m = np.unpackbits(self.packed, axis=1).astype(np.float32)
            self._matrix = (m / np.sqrt(np.maximum(m.sum(axis=1), 1))[:, None]).T.copy()
        return (x @ self._matrix) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self.kernel(x).astype(np.float64) @ self.weights
        p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)


def fit(packed: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features and one-versus-rest ridge regression. Landmarks are taken
    in turn from each language's rows, which come in random order."""
    languages = sorted(set(langs))
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    own = {g: [i for i, x in enumerate(langs) if x == g] for g in languages}
    turn = [own[g][k] for k in range(max(map(len, own.values()))) for g in languages if k < len(own[g])]
    marks = np.unpackbits(rows[turn[:landmarks]], axis=1)
    model = Model(languages, marks, np.zeros((len(marks), 1)))
    blocks = [model.kernel(np.unpackbits(rows[i : i + 128], axis=1).astype(np.float32)) for i in range(0, len(rows), 128)]
    c = np.concatenate(blocks).astype(np.float64)
    k = model.kernel(marks.astype(np.float32)).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = c @ root
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # each language weighs alike, however many rows it has
    weight = 1.0 / np.array([len(own[g]) for g in langs])
    a = (phi * weight[:, None]).T @ phi + ridge * len(languages) / phi.shape[1] * np.eye(phi.shape[1])
    model.weights = root @ np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, seed: int = SEED) -> Model | None:
    """``docs`` has doc_id, text and lang."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    # a hash cut leaves about twice the rows needed, so that the exact choice sorts few rows
    cut = F.lit(None)
    for r in sizes:
        share = min(1.0, (2 * per_language + 100) / r["n"])
        cut = F.when(F.col("lang") == r["lang"], F.lit(share)).otherwise(cut)
    unit = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    few = rows.withColumn("cut", cut).where(unit < F.col("cut")).withColumn("order", order)
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order", "doc_id")))
    few = few.where(F.col("rank") <= per_language).select("lang", "rank", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("bits", T.BinaryType())])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        for i, j, buf, offs in scan.text_slices(batch.column("text"), 1 << 18):
            bits = np.packbits(presence(buf, offs).astype(bool), axis=1)
            yield {"lang": batch.column("lang").slice(i, j - i), "rank": batch.column("rank").slice(i, j - i),
                   "bits": pa.array([b.tobytes() for b in bits], pa.binary())}

    got = map_arrow(few, fn, schema).orderBy("rank", "lang").collect()  # the bounded sample: SLOTS / 8 bytes a row
    return fit([bytes(r["bits"]) for r in got], [r["lang"] for r in got], landmarks) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score from doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        m: Model | None = shared.value
        col = batch.column("text")
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            for i, j, buf, offs in scan.text_slices(part.column("text")):
                letters = _has_letter(buf, offs)
                best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                if m is not None and letters.any():
                    p = m.scores(presence(buf, offs))
                    best = p.argmax(axis=1)
                    score = p[np.arange(j - i), best]
                known = letters & (m is not None)
                names = m.languages if m is not None else ["und"]
                yield {"doc_id": part.column("doc_id").slice(i, j - i), "lang_pred": [names[b] if k else "und" for b, k in zip(best, known)],
                       "score": np.where(known, np.clip(score, 0, 1), 0.0)}

    return map_arrow(docs.select("doc_id", "text"), fn, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score per document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = predict(d, train(d, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
