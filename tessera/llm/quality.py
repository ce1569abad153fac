"""Quality classifier (operator 5): hierarchical empirical Bayes.

Document evidence. The features of a text are its words and word beginnings (4
and 5 bytes), each also at the rates it reaches (``RATES``: a word that makes up
one in 64 words of a text says more than one that turns up once), and its shape
levels (size, punctuation, upper case, digits, distinct words, ...). For each
target (good quality, toxic) the features most associated with it in a labelled
sample feed a logistic regression; the evidence of a document is the log-odds of
the model minus those of the sample.

Sites. Every document also stands on a path of a host. Grouped aggregation over
all documents counts positives per path and host (the label where there is one,
else the model's probability). The rate of a host is its counts shrunk toward
the global rate, the rate of a path its counts shrunk toward its host's; both
strengths are estimated from the spread of the rates (method of moments), so
sparse sites follow their prior and rich ones their own counts. A document's
own share is taken out of its site's counts.

Posterior log-odds = log-odds of the path's rate + document evidence. A document
is rejected if it is more likely toxic than not, or more likely bad than good.

The classifier is fitted on at most ``SAMPLE`` labelled documents, those with
the smallest hashes (the documented bound), one text an id (the one with the
smallest hash); scores and site counts cover all documents and whole texts.
Rows with equal id, text, host and path count once in the site counts, so a
table loaded twice gives every document the verdict it gets when loaded once.

Edge cases: a null or empty text has no words; null hosts and paths are sites
of their own; labels with a null id or value are ignored, repeated labels of an
id count once (the largest); without labels for a target its evidence is 0, its
prior one half, and it rejects nothing. Repeated rows get equal results, one row
each. An empty table gives no rows. ``keep_good`` keeps all columns of its input,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.common import free_name, hash_id, list_array, map_arrow, saved

SAMPLE = 20_000
FEATURES = 512
LEAST_DOCS = 4
BINS = 32
TARGETS = ("quality", "toxic")
STEPS = 200
#: Weights have a normal prior of this precision, so the penalty a document falls as the sample grows.
PRECISION = 1.0
#: Features must be associated with a target by so many standard deviations.
LEAST_Z = 3.0
FILTER_BITS = 18
SEED = 5
SITE_PRIOR = 0.5
#: Beyond presence: a feature that occurs at least twice and makes up so much of a text's words.
RATES = (1 / 256, 1 / 128, 1 / 64, 1 / 32)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
#: The site table is broadcast up to this measured size; beyond it the join sorts, and Spark splits its hot sites.
SITES_BYTES = 16 << 20


def word_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of all words and word beginnings, each text's number of words and its shape."""
    low = scan.LOWER[buf]
    s, e, at = scan.words(low, offs, scan.ALNUM)
    p = scan.prefix_hash(low)
    words = scan.span_hash(p, s, e)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    parts, owners = [words], [text]
    for k in (4, 5):
        on = e - s > k
        parts.append(scan.span_hash(p, s[on], s[on] + k))
        owners.append(text[on])
    return np.concatenate(owners), np.concatenate(parts), n, _shape(buf, offs, words, text, n, e - s)


def rate_features(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash, level) from occurrences: level 0 for presence, level
    i for a repeated feature that reaches the i-th rate among ``n`` words."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    owner, h = owner[at], h[at]
    some = np.flatnonzero(count > 1)
    share = count[some] / np.maximum(n[owner[some]], 1)
    hits = [some[share >= r] for r in RATES]
    rows = np.concatenate([np.arange(len(h)), *hits])
    level = np.repeat(np.arange(len(RATES) + 1), [len(h), *map(len, hits)])
    return owner[rows], h[rows], level


def level_key(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One hash for a feature at a level; the feature's own at level 0."""
    return h ^ level.astype(np.uint64) * _LEVEL


def _shape(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, text: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(c[offs]) / np.maximum(np.diff(offs), 1)

    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    space = ~scan.NON_SPACE[buf]
    mark = ~scan.ALNUM[scan.LOWER[buf]] & ~space
    order = np.lexsort((words, text))
    w, t = words[order], text[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(w)))
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, t[starts], runs)
    some = np.maximum(n, 1)
    mean = np.bincount(text, lengths, len(n)) / some
    return np.stack([np.log1p(n), share(mark), share(upper), share(digit), share(space), np.bincount(t[starts], minlength=len(n)) / some, most / some, mean], axis=1)


def shape_bins(shape: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin (0 to BINS - 1) of every shape value: a row a text, a column a value."""
    out = np.empty(shape.shape, np.uint8)
    for c, b in enumerate(edges):
        out[:, c] = np.searchsorted(b, shape[:, c], "right")
    return out


def _reached(steps: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Sum over the shape values of the weights of all bin borders a text's value
    has reached, so that neighbouring bins share most of their weights. ``steps`` has a row of
    BINS weights for each value, the first one 0."""
    total = np.cumsum(steps, axis=1)
    return sum((total[c, bins[:, c]] for c in range(len(steps))), np.zeros(len(bins)))


class Evidence:
    """Features and weights of the two regressions."""

    def __init__(self, keys: np.ndarray, bases: np.ndarray, edges: np.ndarray):
        self.keys = keys  # sorted hashes of features at their levels
        self.edges = edges  # a row of BINS - 1 borders for each shape value
        self.bases = bases  # sorted hashes of the features of these keys
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(bases >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.weights: dict[str, tuple[np.ndarray, np.ndarray, float, float]] = {}  # words, shape steps, bias, base log-odds

    def active(self, owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) of a slice's occurrences."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        on = self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        owner, h = owner[on], h[on]
        on = self.bases[np.minimum(np.searchsorted(self.bases, h), len(self.bases) - 1)] == h
        owner, h, level = rate_features(owner[on], h[on], n)
        key = level_key(h, level)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        return owner[hit], k[hit]

    def log_odds(self, target: str, owner: np.ndarray, feature: np.ndarray, bins: np.ndarray) -> np.ndarray:
        w, steps, bias, _ = self.weights[target]
        return np.bincount(owner, w[feature], len(bins)) + _reached(steps, bins) + bias


def fit_logistic(owner: np.ndarray, feature: np.ndarray, width: int, bins: np.ndarray, y: np.ndarray, steps: int = STEPS,
                 precision: float = PRECISION) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L2 penalty (Adam) on sparse 0/1 features and
    on the shape bins; weights of the features, of the bin borders, and the bias."""
    n, values = len(y), bins.shape[1]
    w = np.zeros(width + values * BINS + 1)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(base / (1 - base))
    m, v = np.zeros_like(w), np.zeros_like(w)
    g = np.empty_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[feature], n) + _reached(w[width:-1].reshape(values, BINS), bins) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g[:width] = np.bincount(feature, r[owner], width)
        for c in range(values):
            at = np.bincount(bins[:, c], r, BINS)
            at = np.cumsum(at[::-1])[::-1]
            at[0] = 0.0
            g[width + c * BINS : width + (c + 1) * BINS] = at
        g[:-1] += precision / n * w[:-1]
        g[-1] = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:width], w[width:-1].reshape(values, BINS), float(w[-1])


def _label_rows(labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic: one row per id."""
    rows = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    one = [F.max(F.when(F.col(t) > 0, 1).when(F.col(t).isNotNull(), 0)).cast("int").alias(t) for t in TARGETS]
    return rows.groupBy("doc_id").agg(*one)


def train(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Evidence | None:
    """``texts`` has doc_id and text; ``labels`` one row per id."""
    spark = texts.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = labels.orderBy(order, "doc_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "doc_id")  # chosen: sample rows at most
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(t).alias(t) for t in TARGETS))
    rows = saved(rows.drop("doc_id"), "labelled")
    assoc = T.StructType([T.StructField("feature", T.LongType()), T.StructField("level", T.LongType()), *(T.StructField(f"{t}{v}", T.LongType()) for t in TARGETS for v in (0, 1))])

    def labels_of(batch: pa.RecordBatch, i: int, j: int) -> dict[str, np.ndarray]:
        return {t: batch.column(t).slice(i, j - i).fill_null(-1).to_numpy(zero_copy_only=False) for t in TARGETS}

    def count(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            owner, h, n, _ = word_features(buf, offs)
            if not len(h):
                continue
            owner, h, level = rate_features(owner, h, n)
            keys, first, which = np.unique(level_key(h, level), return_index=True, return_inverse=True)
            y = labels_of(batch, i, j)
            out = {f"{t}{v}": np.bincount(which, (y[t] == v)[owner], len(keys)).astype(np.int64) for t in TARGETS for v in (0, 1)}
            yield {"feature": h[first].view(np.int64), "level": level[first], **out}

    names = assoc.names[2:]
    sums = map_arrow(rows, count, assoc).groupBy("feature", "level").agg(*(F.sum(c).alias(c) for c in names))
    sums = saved(sums.where(" + ".join(names[:2]) + f" >= {LEAST_DOCS} OR " + " + ".join(names[2:]) + f" >= {LEAST_DOCS}"), "associations")
    totals = rows.groupBy(*TARGETS).agg(F.count(F.lit(1)).alias("n")).collect()
    size = {(t, v): sum(r["n"] for r in totals if r[t] == v) for t in TARGETS for v in (0, 1)}
    usable = [t for t in TARGETS if size[t, 0] and size[t, 1]]
    if not usable:
        return None
    keys: set[tuple[int, int]] = set()
    for t in usable:
        a, b = F.col(f"{t}1") / size[t, 1], F.col(f"{t}0") / size[t, 0]
        score = F.abs(a - b) / F.sqrt(a / size[t, 1] + b / size[t, 0] + 1.0 / (size[t, 1] * size[t, 0]))
        best = sums.select("feature", "level", score.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature", "level").limit(FEATURES)
        keys |= {(r[0], r[1]) for r in best.collect()}
    chosen_at = np.array(sorted(keys), np.int64).reshape(-1, 2)
    bases = chosen_at[:, 0].copy().view(np.uint64)
    model = Evidence(np.unique(level_key(bases, chosen_at[:, 1])), np.unique(bases), np.zeros((0, BINS - 1)))

    shaped = T.StructType([T.StructField("shape", T.ArrayType(T.DoubleType())), T.StructField("features", T.ArrayType(T.IntegerType())),
                           *(T.StructField(t, T.IntegerType()) for t in TARGETS)])

    def sparse(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            owner, h, n, shape = word_features(buf, offs)
            owner, k = model.active(owner, h, n)
            k = k[np.argsort(owner, kind="stable")]
            y = labels_of(batch, i, j)
            yield {"shape": list_array(pa.array(shape.ravel()), np.full(j - i, shape.shape[1])),
                   "features": list_array(pa.array(k, pa.int32()), np.bincount(owner, minlength=j - i)), **y}

    got = map_arrow(rows, sparse, shaped).toArrow().combine_chunks()  # the bounded sample, reduced to the chosen features
    shape = got.column("shape").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    model.edges = np.quantile(shape, np.arange(1, BINS) / BINS, axis=0).T
    bins = shape_bins(shape, model.edges)
    lists = got.column("features").combine_chunks()
    owner = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    feature = lists.flatten().to_numpy()
    for t in usable:
        y = got.column(t).to_numpy()
        on = y >= 0
        row = (np.cumsum(on) - 1).astype(np.int32)
        use = on[owner]
        fitted = fit_logistic(row[owner[use]], feature[use], len(model.keys), bins[on], y[on].astype(float))
        base = np.clip(y[on].mean(), 1e-6, 1 - 1e-6)
        model.weights[t] = (*fitted, float(np.log(base / (1 - base))))
    return model


def evidence(texts: DataFrame, model: Evidence | None) -> DataFrame:
    """The rows of ``texts`` without the text, with log-odds (``quality_odds``, ``toxic_odds``) and base log-odds taken off (``quality_llr``, ``toxic_llr``)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*keep, *(T.StructField(f"{t}_{x}", T.DoubleType()) for t in TARGETS for x in ("odds", "llr"))])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        m: Evidence | None = shared.value
        for i, j, buf, offs in scan.text_slices(batch.column("text")):
            out = {f.name: batch.column(f.name).slice(i, j - i) for f in keep}
            if m:
                owner, h, n, shape = word_features(buf, offs)
                owner, feature = m.active(owner, h, n)
                bins = shape_bins(shape, m.edges)
            for t in TARGETS:
                odds = m.log_odds(t, owner, feature, bins) if m and t in m.weights else np.zeros(j - i)
                out[f"{t}_odds"] = odds
                out[f"{t}_llr"] = odds - (m.weights[t][-1] if m and t in m.weights else 0.0)
            yield out

    return map_arrow(texts, fn, schema)


# -- sites -------------------------------------------------------------------

def _strength(between: Column, n: Column, n2_over: Column, groups: Column, rate: Column) -> Column:
    """Prior counts of a beta distribution from the weighted spread of group rates."""
    noise = rate * (1 - rate)
    spread = (between - (groups - 1) * noise) / F.greatest(n - n2_over, F.lit(1e-9))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), noise / F.greatest(spread, noise * 1e-6 + 1e-12) - 1))


def site_rates(rows: DataFrame, target: str) -> DataFrame:
    """(host, path) sums n, k, host sums, global rate and both strengths, from rows (host, path, ``target``_mark)."""
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(f"{target}_mark").alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"), F.count(F.lit(1)).alias("m"),
                                      F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    hosts = hosts.withColumn("within", F.col("kk") - F.col("host_k") * F.col("host_k") / F.col("host_n"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_k").alias("k"), F.count(F.lit(1)).alias("h"), F.sum("m").alias("m"),
                      F.sum(F.col("host_k") * F.col("host_k") / F.col("host_n")).alias("kk"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn"),
                      F.sum("within").alias("within"), F.sum(F.col("nn") / F.col("host_n")).alias("nn_in"))
    rate = (F.col("k") + SITE_PRIOR) / (F.col("n") + 2 * SITE_PRIOR)
    total = total.select(
        rate.alias("rate"),
        _strength(F.col("kk") - F.col("k") * F.col("k") / F.col("n"), F.col("n"), F.col("nn") / F.col("n"), F.col("h"), rate).alias("host_strength"),
        _strength(F.col("within"), F.col("n"), F.col("nn_in"), F.col("m") - F.col("h") + 1, rate).alias("path_strength")).first()
    values = [float(v) if v is not None else 1.0 for v in total]
    out = paths.join(hosts.select("host", "host_n", "host_k"), "host")
    return out.select("host", "path", F.struct("n", "k", "host_n", "host_k", F.lit(values[0]).alias("rate"), F.lit(values[1]).alias("host_strength"),
                                               F.lit(values[2]).alias("path_strength")).alias(f"{target}_site"))


def posterior(target: str) -> Column:
    """Probability of the target from its site (own share taken out) and evidence."""
    s, own = F.col(f"{target}_site"), F.col(f"{target}_mark")
    host = (s["host_k"] - own + s["host_strength"] * s["rate"]) / (s["host_n"] - 1 + s["host_strength"])
    path = (s["k"] - own + s["path_strength"] * host) / (s["n"] - 1 + s["path_strength"])
    path = F.least(F.greatest(path, F.lit(1e-9)), F.lit(1 - 1e-9))
    return 1 / (1 + F.exp(-(F.log(path / (1 - path)) + F.col(f"{target}_llr"))))


def _site(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def _rows(docs: DataFrame, host: Column | None, path: Column | None, id_col: str, text_col: str) -> tuple[list[Column], Column]:
    """doc_id, text, host and path of ``docs``, and a 128-bit key over them."""
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    cols = [docs[id_col].cast("long"), docs[text_col].cast("string"), _site(host), _site(path)]
    return [c.alias(n) for c, n in zip(cols, ("doc_id", "text", "host", "path"))], hash_id(*cols)


def _with_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    size = sites.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 200)).first()[0] or 0
    return rows.join(F.broadcast(sites) if size <= SITES_BYTES else sites, ["host", "path"])


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, row_key, host, path, and per target the model's probability and
    the posterior; ``rejected``. Host and path default to source and language."""
    cols, key = _rows(docs, host, path, id_col, text_col)
    texts = docs.select(*cols, key.alias("row_key"))
    marks = _label_rows(labels.select("doc_id", *TARGETS))
    model = train(texts.select("doc_id", "text"), marks, sample)
    rows = evidence(texts, model).join(marks, "doc_id", "left")
    for t in TARGETS:
        p = 1 / (1 + F.exp(-F.col(f"{t}_odds")))
        rows = rows.withColumn(f"{t}_model", p).withColumn(f"{t}_mark", F.coalesce(F.col(t).cast("double"), p))
    rows = saved(rows.drop(*TARGETS), "evidence")
    once = rows.select("row_key", "host", "path", *(f"{t}_mark" for t in TARGETS)).dropDuplicates(["row_key"])
    sites = None
    for t in TARGETS:
        own = site_rates(once, t)
        sites = own if sites is None else sites.join(own, ["host", "path"])
    out = _with_sites(rows, saved(sites, "sites"))
    for t in TARGETS:
        learned = model is not None and t in model.weights
        out = out.withColumn(f"{t}_posterior", posterior(t) if learned else F.lit(0.5))
    learned = [t for t in TARGETS if model is not None and t in model.weights]
    bad = F.lit(False)
    if "toxic" in learned:
        bad = bad | (F.col("toxic_posterior") > 0.5)
    if "quality" in learned:
        bad = bad | (F.col("quality_posterior") < 0.5)
    return out.select("doc_id", "row_key", F.substring("host", 2, 1 << 30).alias("host"), F.substring("path", 2, 1 << 30).alias("path"),
                      "quality_model", "quality_posterior", "toxic_model", "toxic_posterior", bad.alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all columns."""
    out = classify(docs, labels, id_col=id_col, text_col=text_col, **options)
    name = free_name(docs.columns, "dropped_key")
    drop = out.where("rejected").select(F.col("row_key").alias(name)).distinct()
    key = _rows(docs, options.get("host"), options.get("path"), id_col, text_col)[1]
    return docs.join(drop, key == drop[name], "left_anti")
