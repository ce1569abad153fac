"""The corpus operators on small tables, against plain Python, and their edge
cases: nulls in any column, empty and very long texts, ties and repeated rows,
empty tables, extra columns with clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import (decontamination, embedding_dedup, language_id, ngram_jaccard, packing, quality, sharding, suffix_dedup,
                         token_counts, token_files)
from tessera.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and que der ist une ciónarr éaux wh thnd oner blend anou atre keit heit pfer dos las".split()


def corpus(seed: int = 0, n: int = 120) -> list[tuple]:
    """Texts with exact and near copies, shared passages, periodic and long texts, nulls and blanks."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(k))
    passage, base = say(60), say(80).split(" ")
    texts: list[str | None] = [None, "", " \n\t ", "One", "one two", "a " * 300, "abc" * 400, say(3000), "Ωmega, straße 1 23 <|endoftext|> x"]
    for _ in range(n - len(texts)):
        kind = rng.random()
        if kind < 0.2:
            texts.append(rng.choice(texts))
        elif kind < 0.45:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(say(rng.randint(0, 40)) + "\n" + passage + "\n" + say(rng.randint(0, 40)))
        else:
            texts.append(say(rng.randint(1, 120)))
    langs = ["en", "fr", None]
    return [(i, t, rng.choice(langs), rng.choice(["s0", "s0", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}


# -- components ----------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, None), (None, 8), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    nodes = sorted({x for link in real for x in link})
    want = brute.roots(nodes, real)
    assert {frozenset(n for n in nodes if got[n] == got[m]) for m in nodes} == {frozenset(n for n in nodes if want[n] == want[m]) for m in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 n-gram Jaccard join -------------------------------------------------------

@pytest.mark.parametrize("chunk", [2048, 4])
def test_jaccard_components(docs, chunk):
    got = rows_of(ngram_jaccard.near_duplicates(docs, chunk=chunk), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_jaccard_chain_of_near_copies(spark):
    """Ends of a chain that don't link with each other still share a component."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[k * 8 : k * 8 + 100])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows)
    assert len({c for _, c in want.values()}) == 1
    for chunk in (2048, 3):
        assert rows_of(ngram_jaccard.near_duplicates(df, chunk=chunk), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_edges(spark, docs, empty):
    assert ngram_jaccard.near_duplicates(empty).count() == 0
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 2), (None, "alone here is a text", 3), (6, None, 4), (6, None, 4)], "doc_id long, text string, component_id int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_jaccard.near_duplicates(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("6", "6"), ("6", "6"), ("None", "5"), ("None", "None")]
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["component_id"] for r in kept.collect()) == [2, 2, 3, 4, 4]
    want = brute.jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in ngram_jaccard.keep_one(docs).collect()} == {i for i, (_, c) in want.items() if c == i}


# -- 2 suffix-array dedup --------------------------------------------------------

@pytest.mark.parametrize("hot", [1 << 30, 400])
def test_repeated_bytes(docs, hot):
    rows = docs.collect()
    want = dict(zip((r["doc_id"] for r in rows), brute.repeats([r["text"] for r in rows], 50)))
    assert sum(w[1] > 0 for w in want.values()) > 20
    got = rows_of(suffix_dedup.digest(docs, length=50, anchors=(20, 40, 50), hot_bytes=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want


def test_repeats_edges(spark, empty):
    assert suffix_dedup.digest(empty).count() == 0
    t = "é" * 10 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (None, "x" + t[5:], "b"), (2, None, "c"), (3, "", "d"), (4, "short", "e")], "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.digest(df).collect())
    n = len(t.encode())
    assert got == [("1", n), ("1", n), ("2", 0), ("3", 0), ("4", 0), ("None", n - 10)]
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r["spans"], r["text"]) for r in cut.collect() if r["spans"] != "c") == [("a", ""), ("a", ""), ("b", "x"), ("d", ""), ("e", "short")]


def test_cut_keeps_whole_characters(spark):
    """A character of which only one byte repeats stays."""
    common = "".join(chr(97 + i * 5 % 26) for i in range(220))
    df = spark.createDataFrame([(1, "aé" + common), (2, "bĩ" + common)], "doc_id long, text string")  # C3 A9 and C4 A9 end alike
    assert [n for _, (n,) in sorted(rows_of(suffix_dedup.digest(df), "doc_id", "n_removed").items())] == [221, 221]
    assert sorted(r["text"] for r in suffix_dedup.remove_repeats(df).collect()) == ["aé", "bĩ"]


# -- 3 best-fit packing ----------------------------------------------------------

def test_packing(docs):
    tok = brute.tokenizer("byte_bpe_50k.json")
    out = packing.pack(docs, capacity=64, with_ids=True).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    lengths = []
    for d in docs.collect():
        ids, own = brute.ids(tok, d["text"]) + [0], sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(math.ceil(len(ids) / 64)))
        assert sum((r["ids"] for r in own), []) == ids
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == 64 for r in own[1:]) and all(r["ids_crc32"] == brute.crc_ids(r["ids"]) for r in own)
        lengths += [r["length"] for r in own]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(places) == brute.best_fit_sequences(lengths, 64)
    for own in places.values():
        end = 0
        for off, n in sorted(own):
            assert off == end
            end += n
        assert end <= 64


def test_packing_edges(spark, empty):
    assert packing.pack(empty).count() == 0
    df = spark.createDataFrame([(None, None, 1), (None, "", 1), (1, "a", 1), (1, "a", 1)], "doc_id long, text string, length int")
    assert sorted(r["length"] for r in packing.pack(df).collect()) == [1, 1, 2, 2]


# -- 4 sharding --------------------------------------------------------------------

def test_sharding(docs):
    out = sharding.shard(docs, 7).collect()
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(out) == len(rows) and {r["law"] for r in out} == {"rows"}
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(7))
    for r in out:
        text = rows[r["doc_id"]]["text"]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode()) and r["grown_shard"] is None
    for k in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))
    mix = Counter((rows[r["doc_id"]]["source"], r["shard"]) for r in out)
    for s, n in Counter(r["source"] for r in rows.values()).items():
        assert all(abs(mix[s, k] - n / 7) <= 2 for k in range(7))


def test_sharding_edges(spark, empty):
    assert sharding.shard(empty).count() == 0
    df = spark.createDataFrame([(None, None, None, 1)] * 5 + [(1, "a", f"s{i}", 2) for i in range(12)], "doc_id long, text string, source string, shard int")
    out = sharding.shard(df, 4).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [4, 4, 4, 5]
    few = sharding.shard(df.limit(2), 16).collect()
    assert sorted(r["slot"] for r in few) == [0, 0]


# -- 5 quality classifier ------------------------------------------------------------

def labelled(spark, n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        toxic, good = rng.random() < 0.2, rng.random() > 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "vilesome", "vileness"])
        if not good:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "fr"]), f"h{i % 30}", 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), labels


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    known = spark.createDataFrame([r for r in labels if r[0] % 2], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    test = [r for r in labels if r[0] % 2 == 0]
    assert np.mean([(out[i]["toxic_posterior"] > 0.5) == bool(t) for i, _, t in test]) > 0.97
    assert np.mean([(out[i]["quality_posterior"] > 0.5) == bool(q) for i, q, _ in test]) > 0.97
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["rejected"]}


def test_quality_site_posteriors_equal_plain_python(spark):
    rng = random.Random(1)
    rows = [(f"h{rng.randrange(4)}", f"p{rng.randrange(3)}", rng.random() ** 2, rng.uniform(-3, 3)) for _ in range(200)] + [("lone", "p", 0.9, 0.5)]
    df = spark.createDataFrame(rows, "host string, path string, toxic_mark double, toxic_llr double")
    got = sorted(tuple(r) for r in df.join(quality.site_rates(df, "toxic"), ["host", "path"]).select("host", "path", "toxic_mark", quality.posterior("toxic")).collect())
    paths, hosts = {}, {}
    for h, p, m, _ in rows:
        paths.setdefault((h, p), []).append(m)
        hosts.setdefault(h, []).append(m)
    n, k = len(rows), sum(r[2] for r in rows)
    rate = (k + 0.5) / (n + 1)

    def strength(between, n2, groups):
        noise = rate * (1 - rate)
        spread = (between - (groups - 1) * noise) / max(n - n2, 1e-9)
        return max(1.0, min(1e6, noise / max(spread, noise * 1e-6 + 1e-12) - 1))

    of_hosts = strength(sum(sum(v) ** 2 / len(v) for v in hosts.values()) - k * k / n, sum(len(v) ** 2 for v in hosts.values()) / n, len(hosts))
    within = sum(sum(v) ** 2 / len(v) for v in paths.values()) - sum(sum(v) ** 2 / len(v) for v in hosts.values())
    n2 = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    of_paths = strength(within, n2, len(paths) - len(hosts) + 1)
    want = []
    for h, p, m, llr in rows:
        up = (sum(hosts[h]) - m + of_hosts * rate) / (len(hosts[h]) - 1 + of_hosts)
        r = (sum(paths[h, p]) - m + of_paths * up) / (len(paths[h, p]) - 1 + of_paths)
        want.append((h, p, m, 1 / (1 + math.exp(-(math.log(r / (1 - r)) + llr)))))
    for a, b in zip(got, sorted(want)):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, none)
    assert out.count() == docs.count() and out.where("rejected").count() == 0
    assert quality.keep_good(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, 1, None), (3, 1, None), (None, 0, 1), (9, None, None), (9, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, one).where("rejected").count() == 0
    both = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    assert quality.classify(docs, both).count() == docs.count()
    assert quality.classify(empty, both).count() == 0


# -- 6 embedding near-dedup ----------------------------------------------------------

def vectors(seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=(8, 16))
    for i in range(n):
        v = centre[rng.integers(8)] + rng.normal(scale=rng.choice([0.05, 0.3, 0.6]), size=16)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, [0.0] * 16, 1), (n + 3, None, 1), (n + 4, [1.0, None] + [0.0] * 14, 1),
             (n + 5, [float("nan")] * 16, 1), (n + 6, rows[3][1], None), (n + 7, [], 1), (n + 8, rows[5][1][:8], rows[5][2]), (n + 9, [float("inf")] + [1.0] * 15, 1),
             (n + 10, [-0.0, 2.0], 2), (n + 11, [0.0, 1.0], 2)]
    return rows


@pytest.mark.parametrize("tile", [1024, 9])
def test_embeddings(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = rows_of(embedding_dedup.near_duplicates(df, tile=tile), "vec_id", "n_links", "component_id", "kept")
    want = brute.near_vectors(rows, 0.93)
    assert sum(n for n, _ in want.values()) > 50
    assert out == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "y"), (4, [1.0, 0.0], 1, "y"), (None, None, 1, "z")], schema)
    got = sorted(map(str, (tuple(r) for r in embedding_dedup.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 0, None, False)]))


# -- 7 token files -------------------------------------------------------------------

def test_token_files_round_trip(docs):
    tok = brute.tokenizer("word_bpe_49k.json")
    got = rows_of(token_files.round_trip(docs), "doc_id", "start", "n_tokens", "ids_crc32")
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = brute.ids(tok, r["text"]) + [2]
        want[r["doc_id"]] = (start, len(ids), brute.crc_ids(ids))
        start += len(ids)
    assert got == want


def test_token_files_edges(spark, empty, tmp_path):
    assert token_files.round_trip(empty).count() == 0
    df = spark.createDataFrame([(2, "b a", 1), (None, None, 1), (1, "a", 1), (1, "a", 1), (None, "", 1)], "doc_id long, text string, start int")
    path = f"file://{tmp_path}/files"
    token_files.write_tokens(df, path)
    got = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2] and [r["start"] for r in got] == [0, 1, 2, 4, 6]
    tok = brute.tokenizer("word_bpe_49k.json")
    assert got[-1]["ids"] == brute.ids(tok, "b a") + [2]


# -- 8 token counts --------------------------------------------------------------------

@pytest.mark.parametrize("common", [1 << 19, 40, 0])
def test_token_counts(docs, common):
    tok = brute.tokenizer("byte_bpe_50k.json")
    got = rows_of(token_counts.token_counts(docs, common=common), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = {}
    for r in docs.collect():
        n = len(brute.ids(tok, r["text"]))
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 1024)
    assert got == want


def test_token_counts_edges(spark, empty):
    assert token_counts.token_counts(empty).count() == 0
    df = spark.createDataFrame([(None, None, 1), (1, "a b", 1), (1, "a b", 1)], "doc_id long, text string, n_tokens int")
    for common in (0, 10):
        assert sorted(r["n_tokens"] for r in token_counts.token_counts(df, common=common).collect()) == [0, 2, 2]


# -- 9 language ID ---------------------------------------------------------------------

def spoken(n=400, seed=4):
    rng = random.Random(seed)
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "en er ch ei un ie sch ge lich ver".split(), "fr": "le ou eau que ai tre on en é è".split()}
    return [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60))), g)
            for i, g in enumerate(rng.choice(list(parts)) for _ in range(n))]


def test_language_held_out_accuracy(spark):
    rows = spoken()
    out = rows_of(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "doc_id", "held_out", "lang_pred", "score")
    assert all(out[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(out[i][1], g) for i, _, g in rows if out[i][0]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= s <= 1 for _, _, s in out.values())


def test_language_of_held_out_rows_is_never_read(spark):
    rows = spoken(150)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hidden = df.withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")).otherwise(F.lit("zz")))
    assert rows_of(language_id.identify(df), "doc_id", "lang_pred", "score") == rows_of(language_id.identify(hidden), "doc_id", "lang_pred", "score")


def test_language_edges(spark, empty):
    assert language_id.identify(empty).count() == 0
    known = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(0, None, "en"), (1, "", "en"), (2, "123 !?", "de"), (known, "only words", "en"), (None, "é", None), (known, "only words", "en")]
    got = sorted(map(str, (tuple(r) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "lang_pred").collect())))
    assert got[:3] == ["(0, 'und')", "(1, 'und')", "(2, 'und')"] and len(got) == 6 and "und" not in "".join(got[3:])
    unknown = spark.createDataFrame([(0, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(unknown).first()["lang_pred"] == "und"


# -- 10 benchmark decontamination ---------------------------------------------------------

def items(docs):
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) > 70]
    return [(0, " ".join(texts[0].split()[10:40])), (1, texts[1].upper()), (2, "one Two"), (3, "never found in any of these texts at all, not once, I should think"), (4, None),
            (5, ""), (6, " ".join(texts[2].split()[3:16])), (7, " ".join(texts[0].split()[20:60])), (None, " ".join(texts[3].split()[:20])), (8, "the")]


def test_contamination(spark, docs):
    bench = items(docs)
    df = spark.createDataFrame(bench, "item_id long, text string")
    want = brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], bench)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sum(w[-1] for w in want.values()) > 5
    assert rows_of(decontamination.digest(docs, df), *cols) == want
    kept = decontamination.remove_contaminated(docs, df)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[-1]}


def test_contamination_in_blocks(spark, docs, monkeypatch):
    """Several bounded passes over the benchmark give the result of one."""
    df = spark.createDataFrame(items(docs), "item_id long, text string")
    one = rows_of(decontamination.digest(docs, df), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    assert rows_of(decontamination.digest(docs, df), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == one


def test_contamination_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.digest(docs, none).where("contaminated").count() == 0
    assert decontamination.digest(empty, none).count() == 0
    df = spark.createDataFrame([(1, "alpha beta", "x"), (1, "alpha beta", "x"), (None, None, "y")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, "beta")], "item_id long, text string")
    out = decontamination.contamination(df, bench)
    assert out.columns == ["doc_id", "text", "spans", "n_words", "spans_", "items"]
    assert [[(x["start"], x["end"]) for x in r["spans_"]] for r in out.where("doc_id = 1").collect()] == [[(6, 10)]] * 2
    assert decontamination.remove_contaminated(df, bench).columns == df.columns
