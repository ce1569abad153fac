"""The quality classifier as a whole against plain Python, on repeated rows and clashing names."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tests.llm.test_operators import labelled


def plain_features(text):
    """Features at their rates and the shape of a text, by dictionaries of strings."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[a-z0-9\x80-\xff]+", low)
    counts = Counter(words)
    counts.update(Counter((k, w[:k]) for w in words for k in (4, 5) if len(w) > k))
    merged = Counter()
    for f, c in counts.items():  # a word of four letters and a beginning of four letters are one feature
        merged[f[1] if isinstance(f, tuple) else f] += c
    out = {(f, 0) for f in merged}
    out |= {(f, i) for f, c in merged.items() if c > 1 for i, r in enumerate(quality.RATES, 1) if c / len(words) >= r}
    raw = (text or "").encode()
    size = max(len(raw), 1)
    space = sum(b in b" \t\n\v\f\r" for b in raw)
    alnum = sum(len(w) for w in words)
    n = max(len(words), 1)
    counts = Counter(words)
    shape = [math.log1p(len(words)), (len(raw) - alnum - space) / size, sum(65 <= b <= 90 for b in raw) / size, sum(48 <= b <= 57 for b in raw) / size, space / size,
             len(counts) / n, max(counts.values(), default=0) / n, alnum / n]
    return out, shape


def plain_classify(rows, labels):
    """(doc_id, text, host, path), {doc_id: (quality, toxic)} -> doc_id: posteriors."""
    known = [i for i, (r, *_) in enumerate(rows) if r in labels]
    feats, shapes = zip(*(plain_features(r[1]) for r in rows))
    y = {t: np.array([labels[rows[i][0]][k] for i in known]) for k, t in enumerate(quality.TARGETS)}
    chosen = set()
    for t in quality.TARGETS:
        one, zero = Counter(), Counter()
        for i, v in zip(known, y[t]):
            (one if v else zero).update(feats[i])
        a1, a0 = int(y[t].sum()), int((1 - y[t]).sum())
        z = {}
        for f in one | zero:
            if one[f] + zero[f] >= quality.LEAST_DOCS:
                a, b = one[f] / a1, zero[f] / a0
                z[f] = abs(a - b) / math.sqrt(a / a1 + b / a0 + 1 / (a1 * a0))
        best = sorted((f for f in z if z[f] >= quality.LEAST_Z), key=lambda f: -z[f])
        assert len(best) <= quality.FEATURES  # no tie is cut
        chosen |= set(best)
    chosen = sorted(chosen)
    edges = np.quantile(np.array([shapes[i] for i in known]), np.arange(1, quality.BINS) / quality.BINS, axis=0)
    x = np.array([[f in feats[i] for f in chosen] + [s >= e for s, col in zip(shapes[i], edges.T) for e in col] + [True] for i in range(len(rows))], float)
    out = {}
    for t in quality.TARGETS:
        w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        base = y[t].mean()
        w[-1] = math.log(base / (1 - base))
        for step in range(1, quality.STEPS + 1):
            r = (1 / (1 + np.exp(-np.clip(x[known] @ w, -30, 30))) - y[t]) / len(known)
            g = x[known].T @ r
            g[:-1] += quality.PRECISION / len(known) * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (1 - step / (quality.STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        odds = x @ w
        mark = 1 / (1 + np.exp(-odds))
        mark[known] = y[t]
        n, k, hn, hk = Counter(), Counter(), Counter(), Counter()
        for (_, _, h, p), own in zip(rows, mark):
            n[h, p] += 1
            k[h, p] += own
            hn[h] += 1
            hk[h] += own
        total, pos = sum(hn.values()), sum(hk.values())
        rate = (pos + 0.5) / (total + 1)
        noise = rate * (1 - rate)

        def strength(between, size, over, groups):
            spread = (between - (groups - 1) * noise) / max(size - over, 1e-9)
            return max(1.0, min(1e6, noise / max(spread, noise * 1e-6 + 1e-12) - 1))

        sh = strength(sum(hk[h] ** 2 / hn[h] for h in hn) - pos**2 / total, total, sum(c * c for c in hn.values()) / total, len(hn))
        within = sum(k[s] ** 2 / n[s] for s in n) - sum(hk[h] ** 2 / hn[h] for h in hn)
        sp = strength(within, total, sum(c * c / hn[s[0]] for s, c in n.items()), len(n) - len(hn) + 1)
        for i, (d, _, h, p) in enumerate(rows):
            host = (hk[h] - mark[i] + sh * rate) / (hn[h] - 1 + sh)
            path = (k[h, p] - mark[i] + sp * host) / (n[h, p] - 1 + sp)
            path = min(max(path, 1e-9), 1 - 1e-9)
            out[d, t] = 1 / (1 + math.exp(-(math.log(path / (1 - path)) + odds[i] - math.log(base / (1 - base)))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    docs, labels = labelled(spark, 160)
    rows = [tuple(r) for r in docs.collect()]
    odd = [None, "", "ÀÉ été été été " * 40, "word " * 3000]
    rows += [(1000 + i, t, None if i % 2 else "fr", "h1" if i else None, 0) for i, t in enumerate(odd)]
    return spark.createDataFrame(rows, docs.schema), labels


def test_whole_equals_plain_python(spark, table):
    docs, labels = table
    fit = [x for x in labels if x[0] % 3]
    got = quality.classify(docs, spark.createDataFrame(fit, "doc_id long, quality int, toxic int")).collect()
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    want = plain_classify(rows, {i: (q, t) for i, q, t in fit})
    assert len(got) == len(rows)
    for r in got:
        for t in quality.TARGETS:
            assert abs(r[f"{t}_posterior"] - want[r["doc_id"], t]) < 1e-6
        assert r["rejected"] == (want[r["doc_id"], "toxic"] > 0.5 or want[r["doc_id"], "quality"] < 0.5)


def test_a_table_loaded_twice_gives_the_same_verdicts(spark, table):
    docs, labels = table
    marks = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    once = {r["doc_id"]: r for r in quality.classify(docs, marks).collect()}
    twice = quality.classify(docs.unionAll(docs).repartition(3), marks.unionAll(marks)).collect()
    assert len(twice) == 2 * len(once)
    for r in twice:
        assert r["rejected"] == once[r["doc_id"]]["rejected"]
        assert abs(r["toxic_posterior"] - once[r["doc_id"]]["toxic_posterior"]) < 1e-9


def test_keep_good_with_clashing_names_and_on_an_empty_table(spark, table):
    docs, labels = table
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["dropped_key", "__dropped", "row_key", "host", "path", "rejected", "toxic", "quality", "features", "n", "k", "rate"]
    wide = docs.select("*", *(F.lit(1).alias(c) for c in names))
    kept = quality.keep_good(wide, marks)
    assert kept.columns == wide.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.keep_good(docs, marks).collect()}
    assert quality.keep_good(wide.limit(0), marks).count() == 0


def test_a_word_that_keeps_coming_back_is_seen(spark):
    """Every text holds the word; in toxic ones it makes up more than one in 64 words."""
    rng = np.random.default_rng(7)
    filler = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(filler, 200))
        for at in rng.choice(200, 8 if i % 5 == 0 else 1, replace=False):
            words[at] = "vexatious"
        rows.append((i, " ".join(words), "en", f"h{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fit = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["rejected"] for r in quality.classify(docs, fit).collect()}
    assert all(out[i] == bool(t) for i, _, t in labels)
