"""Model training, evaluation and scoring with ``pyspark.ml``
(J-1 .. J-10, C-11).

All estimators are distributed Spark ML; preprocessing is one ``Pipeline``
fitted on the training split only (no leakage into the test split). Seeds
are fixed. Metrics are recomputed from confusion counts with one
conditional aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship_library
from tessera.sources.stage import garbage_freed, shuffles_freed, staged

SEED = 42


def feature_pipeline(categorical: Sequence[str], numeric: Sequence[str], out: str = "features") -> Pipeline:
    """One-hot categoricals and standardised numerics in one pipeline (J-1).
    Unseen categories get their own slot (``handleInvalid='keep'``)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_ohe" for c in categorical],
                        handleInvalid="keep")
    num = VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep")
    scale = StandardScaler(inputCol="_num", outputCol="_num_std", withMean=True, withStd=True)
    full = VectorAssembler(inputCols=[f"{c}_ohe" for c in categorical] + ["_num_std"], outputCol=out)
    return Pipeline(stages=[*idx, ohe, num, scale, full])


def classifiers(label: str = "label", features: str = "features") -> dict:
    """The four model families compared on identical preprocessing (J-2);
    gradient-boosted trees stand in for XGBoost."""
    return {
        "logistic_regression": LogisticRegression(labelCol=label, featuresCol=features, maxIter=50),
        "decision_tree": DecisionTreeClassifier(labelCol=label, featuresCol=features, seed=SEED, maxDepth=5),
        "random_forest": RandomForestClassifier(labelCol=label, featuresCol=features, seed=SEED, numTrees=30,
                                                maxDepth=6),
        "boosted_trees": GBTClassifier(labelCol=label, featuresCol=features, seed=SEED, maxIter=20, maxDepth=4),
    }


def positive_probability(pred: DataFrame, name: str = "p_pos") -> DataFrame:
    return pred.withColumn(name, vector_to_array("probability")[1])


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             score: str = "p_pos") -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class and ROC-AUC
    (J-4). Confusion counts come from one aggregate; AUC is computed with
    the rank-sum formula over the scores (exact, ties averaged)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * prec * rec, prec + rec)
    auc = roc_auc(pred, label, score)
    return c.select("tp", "fp", "fn", "tn", acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), auc.alias("auc"))


def ranged(df: DataFrame, order: Sequence[str], name: str, folder: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order`` with like numbers of rows, the range's
    number as ``name``: it never falls along the order. As many ranges as shuffle
    partitions by default, so they grow with what the session is set up for."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), folder)


def roc_auc(pred: DataFrame, label: str, score: str, buckets: int | None = None) -> Column:
    """Exact ROC-AUC via the Mann-Whitney statistic with average ranks for
    ties, as a scalar subquery. Rows without a label or score don't count.

    Ranks need "rows with a smaller score": the distinct scores are written in
    ranges; range totals (one row each) give each range's offset, and a running sum
    inside the range gives the rest. No window ever spans all rows.
    """
    known = pred.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    g = ranged(known.groupBy(F.col(score).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("npos")), ["s"], "b", "scores", buckets)
    tot = g.groupBy("b").agg(F.sum("n").alias("bn"))
    tot = tot.withColumn("offset", F.coalesce(
        F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("within", within).join(tot.select("b", "offset"), "b")
    r = r.withColumn("avg_rank", F.col("offset") + F.col("within") + (F.col("n") + 1) / 2)
    stats = r.agg(F.sum(F.col("avg_rank") * F.col("npos")).alias("rsum"), F.sum("npos").alias("P"),
                  (F.sum("n") - F.sum("npos")).alias("N"))
    return stats.select(F.try_divide(F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2,
                                     F.col("P") * F.col("N"))).scalar()


def auc_evaluator(label: str = "label") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")


def tune(pipeline_stages: list, model, grid: dict, label: str = "label", train_ratio: float = 0.8):
    """Hyper-parameter search (J-3): ``TrainValidationSplit`` over a grid
    ``{param_name: [values]}`` of ``model``, scored by ROC-AUC."""
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(model.getParam(name), values)
    est = Pipeline(stages=[*pipeline_stages, model])
    return TrainValidationSplit(estimator=est, estimatorParamMaps=b.build(), evaluator=auc_evaluator(label),
                                trainRatio=train_ratio, seed=SEED)


def coefficients(model: PipelineModel, features: str = "features", data: DataFrame | None = None) -> DataFrame:
    """Feature names with coefficients or importances, ranked by absolute
    size (J-5). Names come from the ML attribute metadata of the feature
    vector. The result is tiny (one row per feature)."""
    last = model.stages[-1]
    spark = (data.sparkSession if data is not None else None)
    meta = data.schema[features].metadata if data is not None else {}
    attrs = []
    for group in meta.get("ml_attr", {}).get("attrs", {}).values():
        attrs.extend(group)
    names = {a["idx"]: a["name"] for a in attrs}
    if hasattr(last, "coefficients"):
        vals = last.coefficients.toArray().tolist()
        kind = "coefficient"
    else:
        vals = last.featureImportances.toArray().tolist()
        kind = "importance"
    rows = [(i, names.get(i, f"f{i}"), float(v), kind) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "idx int, feature string, value double, kind string")
    return df.withColumn("abs_value", F.abs("value")).orderBy(F.desc("abs_value"), "idx")


def cluster_behaviour(df: DataFrame, cols: Sequence[str], k: int, seed: int = SEED) -> tuple[DataFrame, object]:
    """K-Means on standardised features (J-6); returns rows with their
    cluster and the fitted model. Rows with a missing value keep a null cluster."""
    va = VectorAssembler(inputCols=list(cols), outputCol="_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")
    ok = complete_rows(df, cols)
    full = df.filter(ok)
    model = Pipeline(stages=[va, sc, km]).fit(full)
    rows = model.transform(full).drop("_raw", "features")
    return rows.unionByName(df.filter(~ok).withColumn("cluster", F.lit(None).cast("int"))), model


# Churn-risk bands on the positive probability and the
# recommendation for each band.
RISK_CUTS = (0.3, 0.6)
RISK_LABELS = ("low", "medium", "high")
RISK_ACTIONS = {"low": "no action", "medium": "retention offer", "high": "personal call"}


def risk_bands(df: DataFrame, p: str = "p_pos") -> DataFrame:
    """``risk``, the band of a probability, and its ``action`` from the rule table (J-7)."""
    band = F.when(F.col(p) < RISK_CUTS[0], RISK_LABELS[0]).when(F.col(p) < RISK_CUTS[1], RISK_LABELS[1]) \
        .when(F.col(p).isNotNull(), RISK_LABELS[2])
    act = F.create_map(*[F.lit(x) for kv in RISK_ACTIONS.items() for x in kv])
    return df.withColumn("risk", band).withColumn("action", F.element_at(act, F.col("risk")))


def score_batch(df: DataFrame, model: PipelineModel, id_cols: Sequence[str]) -> DataFrame:
    """Batch prediction (J-7): probability of the positive class, predicted
    class, risk band and the recommended action."""
    p = model.transform(df).withColumn("p_pos", vector_to_array("probability")[1])
    return risk_bands(p).select(*id_cols, "p_pos", F.col("prediction").cast("int").alias("prediction"), "risk", "action")


def argmax_class(df: DataFrame, probs: str, name: str = "class_idx") -> DataFrame:
    """Class index (0-based) of the largest probability and its value (J-8)."""
    return df.withColumn(name, F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1) \
        .withColumn("confidence", F.array_max(F.col(probs)))


def poisson1_cdf() -> list[float]:
    """P(X <= k) of a Poisson(1) draw, up to where a double is 1."""
    cdf, pmf, k, out = 0.0, math.exp(-1), 0, []
    while cdf + pmf > cdf:
        cdf += pmf
        out.append(cdf)
        k += 1
        pmf /= k
    return out


def poisson1_weight(u: Column) -> Column:
    """A Poisson(1) draw from a uniform in [0, 1): how many steps of the
    distribution function lie at or below it."""
    return sum((F.when(u >= c, 1).otherwise(0) for c in poisson1_cdf()), F.lit(0))


def stability(pred: DataFrame, slice_col: str, label: str, prediction: str, key: str, replicates: int = 20,
              seed: int = SEED) -> DataFrame:
    """Accuracy per slice with a Poisson-bootstrap interval (J-9): every row
    gets ``replicates`` independent Poisson(1) weights (rows are replicated
    ``replicates`` times by an explode of a fixed-size sequence, never
    pairs), weighted accuracy per (slice, replicate), then the 2.5/97.5
    percentiles. A row's weights hang on its ``key`` and the seed alone (52 bits of
    an MD5 hash), so partitioning can't change them."""
    ok = (F.col(label).cast("int") == F.col(prediction).cast("int")).cast("double")
    rows = pred.select(slice_col, ok.alias("_ok"), F.col(key).cast("string").alias("_key"))
    rep = rows.select(slice_col, "_ok", "_key", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b"))
    draw = F.md5(F.concat_ws(":", "_key", F.col("_b").cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rep = rep.withColumn("_w", poisson1_weight(u))
    per = rep.groupBy(slice_col, "_b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_ok")), F.sum("_w")).alias("acc"))
    point = rows.groupBy(slice_col).agg(F.avg("_ok").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    ci = per.groupBy(slice_col).agg(F.percentile("acc", 0.025).alias("acc_low"),
                                    F.percentile("acc", 0.975).alias("acc_high"))
    return point.join(ci, slice_col)


def split_by_key(df: DataFrame, key: str, test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows on any partitioning, and rows of one key stay together."""
    held = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000)
    return df.filter(~held), df.filter(held)


def recommend(interactions: DataFrame, user: str, item: str, rating: str, k: int, rank: int = 8,
              max_iter: int = 10, block_ratings: int = 4_000_000) -> DataFrame:
    """Top-k item recommendations per user from implicit feedback (J-10)
    with ALS; the fit checkpoints into the session's checkpoint folder in every
    iteration, cutting lineage. The scores of all users and items are taken by
    :func:`best_products`.

    A task of the fit holds the ratings of a block several times over, so there are as many blocks
    as keep about ``block_ratings`` in one, and ALS's own 10 at least."""
    spark = interactions.sparkSession
    with shuffles_freed(spark):
        ratings = staged(interactions.select(user, item, rating), "ratings")
    blocks = max(10, -(-ratings.count() // block_ratings))
    als = ALS(userCol=user, itemCol=item, ratingCol=rating, implicitPrefs=True, rank=rank, maxIter=max_iter,
              seed=SEED, coldStartStrategy="drop", checkpointInterval=1, nonnegative=True,
              numUserBlocks=blocks, numItemBlocks=blocks)
    with garbage_freed(spark):
        model = als.fit(ratings)
    best = best_products(model.userFactors, model.itemFactors, k)
    return best.select(F.col("u").alias(user), "rank", F.col("i").alias(item), "score")


def best_products(users: DataFrame, items: DataFrame, k: int, tile_rows: int = 8192, part_rows: int = 200_000) -> DataFrame:
    """``(u, rank, i, score)``: the ``k`` items with the largest inner product for each
    user, both given as ``(id int, features array<float>)``; equal scores go by the smaller item.

    Exact over all pairs, in matrix products of tiles. Without negative parts, an item that ``k`` others
    exceed in every part is no user's best and takes no part; the rest goes in partitions of about
    ``part_rows``. The items of a partition come in
    falling order of their norm, and a user whose best ``k`` lie above what a tile can
    reach at most skips it. A user leaves a task with k items at most."""
    ship_library(users.sparkSession)
    least = [df.select(F.min(F.array_min("features"))).first()[0] for df in (users, items)]
    if all(x is not None and x >= 0 for x in least):
        # where fewer than k scores are above 0, the smallest of the other items follow
        first = [r["id"] for r in items.select("id").orderBy("id").limit(2 * k).collect()]

        def fewer(df: DataFrame) -> DataFrame:
            return df.mapInArrow(lambda batches: _not_exceeded(batches, k, first), "id int, features array<float>")

        # once where they lie, and once more among what is left of all
        left = staged(fewer(items.select("id", "features")), "items")
        items = fewer(left.repartition(max(1, -(-left.count() // part_rows))))
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))

    def tiles(df: DataFrame, name: str, *order: Column) -> DataFrame:
        packed = df.sortWithinPartitions(*order).mapInArrow(lambda batches: _tiles(batches, tile_rows), "ids binary, data binary")
        return staged(packed, name).select(F.col("ids").alias(f"{name}_ids"), F.col("data").alias(f"{name}_data"))

    pairs = tiles(users, "user", F.col("id")).crossJoin(tiles(items, "item", length.desc(), F.col("id")))
    found = pairs.mapInArrow(lambda batches: _best_of_tiles(batches, k), "u int, i int, score float")
    w = Window.partitionBy("u").orderBy(F.col("score").desc(), "i")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _not_exceeded(batches: Iterator[pa.RecordBatch], k: int, keep: Sequence[int], rows: int = 1024, most: int = 8192,
                  held: int = 262_144) -> Iterator[pa.RecordBatch]:
    """The items that fewer than ``k`` others are found to exceed in every part, and those in ``keep``.
    Each is compared with ``most`` large ones before it at most, so no item is lost by the limit."""
    # by more than products of floats can be off; 0 is exceeded by all
    margin = np.float32(1.0001)
    large = np.zeros((0, 0), np.float32)

    def left(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        nonlocal large
        if large.shape[1] != v.shape[1]:
            large = np.zeros((0, v.shape[1]), np.float32)
        out, order = [np.flatnonzero(np.isin(ids, keep))], np.argsort(-v.sum(axis=1), kind="stable")
        for at in range(0, len(order), rows):
            who = order[at:at + rows]
            limit, above = v[who] * margin, np.zeros(len(who), np.int64)
            for lo, hi in ((lo, min(lo + 256, len(large))) for lo in range(0, len(large), 256)):
                open_ = np.flatnonzero(above < k)
                if not len(open_):
                    break
                over = np.ones((len(open_), hi - lo), bool)
                for j in range(v.shape[1]):
                    over &= large[lo:hi, j] >= limit[open_, j, None]
                above[open_] += over.sum(axis=1)
            who = who[above < k]
            out.append(who)
            large = np.concatenate([large, v[who]])[:most]
        return np.unique(np.concatenate(out))

    def chunk(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting).combine_chunks()
        ids, features = t.column("id").to_numpy(), t.column("features").combine_chunks()
        kept = left(ids, features.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1))
        return t.take(pa.array(kept)).combine_chunks().to_batches()[0]

    waiting, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n += batch.num_rows
        if n >= held:
            out, waiting, n = chunk(waiting), [], 0
            if out.num_rows:
                yield out
    if waiting and (out := chunk(waiting)).num_rows:
        yield out


def _tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Ids and vectors packed, at most ``rows`` in one record."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            data = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                                              pa.array([data.tobytes()], pa.binary())], names=["ids", "data"])


def _best_of_tiles(batches: Iterator[pa.RecordBatch], k: int, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each user over the item tiles that follow each other with the user's tile."""
    at = users = u = best = ids = None

    def result():
        if at is not None:
            full = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(users, full.sum(axis=1))), pa.array(ids[full]), pa.array(best[full])], names=["u", "i", "score"])

    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)  # noqa: E731, B023
            if (key := batch.column("user_ids")[r].as_py()) != at:
                yield from result()
                at, users = key, np.frombuffer(key, np.int32)
                u = get("user_data", np.float32).reshape(len(users), -1)
                best, ids = np.full((len(users), k), -np.inf, np.float32), np.zeros((len(users), k), np.int32)
            items = get("item_ids", np.int32)
            v = get("item_data", np.float32).reshape(len(items), -1)
            # no product exceeds the sum of the larger parts, nor that of the lengths; a little more for rounding
            most = np.minimum(np.maximum(u, 0) @ np.maximum(v.max(axis=0), 0) + np.maximum(-u, 0) @ np.maximum(-v.min(axis=0), 0),
                              np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1).max())
            open_ = np.flatnonzero(most * 1.0001 + 1e-30 >= best.min(axis=1))
            # a user's first items are taken in growing steps, so that most of a tile only meets a limit
            steps = [0, 64, 512, len(items)] if len(open_) and best[open_].min() == -np.inf else [0, len(items)]
            for lo in range(0, len(open_), rows):
                for c0, c1 in zip(steps[:-1], steps[1:]):
                    who = open_[lo:lo + rows]
                    scores = u[who] @ v[c0:c1].T
                    if not scores.size:
                        continue
                    least = best[who].min(axis=1)
                    better = scores.max(axis=1) >= least
                    who, scores, least = who[better], scores[better], least[better]
                    row, col = np.nonzero(scores >= least[:, None])
                    row = np.r_[np.repeat(np.arange(len(who)), k), row]
                    s, i = np.r_[best[who].ravel(), scores[row[len(who) * k:], col]], np.r_[ids[who].ravel(), items[c0:c1][col]]
                    order = np.lexsort((i, -s, row))
                    row, s, i = row[order], s[order], i[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    top = place < k
                    best[who[row[top]], place[top]], ids[who[row[top]], place[top]] = s[top], i[top]
    yield from result()


def recommend_popular(purchases: DataFrame, users: DataFrame, user: str, item: str, weight: str,
                      group: str, k: int) -> DataFrame:
    """Top-k items per user that the user has not bought yet, taken from the
    popularity ranking of the user's group (J-10, pair-free variant).

    Exact without enumerating user x item pairs: a group keeps the first
    ``k + max owned`` ranks (salted two-stage top-k). A user misses those of them
    that it owns, so its k best are the first k ranks without these; only they
    are listed. The purchases are added up once per user and item, and written.
    ``purchases(user, item, weight)``, ``users(user, group)``.
    """
    from tessera.operators.ranking import top_k_per_group
    bought = staged(purchases.groupBy(user, item).agg(F.sum(weight).alias("_w")), "bought")
    depth = bought.groupBy(user).agg(F.count(F.lit(1)).alias("_m")).select(F.max("_m")).scalar()
    pop = bought.join(users, user).groupBy(group, item).agg(F.sum("_w").alias("score"))
    ranked = staged(top_k_per_group(pop, [group], "score", F.lit(k) + F.coalesce(depth, F.lit(0)), tiebreak=[item],
                                    rank_name="_r"), "ranked")
    owned = (bought.select(user, item).join(users.distinct(), user).join(ranked, [group, item])
             .groupBy(user, group).agg(F.collect_set("_r").alias("_own")))
    # the first k ranks that are free lie among the first k + size(_own)
    none = F.array().cast(owned.schema["_own"].dataType)
    free = F.array_except(F.sequence(F.lit(1), F.lit(k) + F.size(F.coalesce("_own", none))), F.coalesce("_own", none))
    picks = (users.join(owned, [user, group], "left")
             .select(user, group, F.explode(F.slice(free, 1, k)).alias("_r")).join(ranked, [group, "_r"]))
    best = top_k_per_group(picks, [user], "_r", k, desc=False, tiebreak=[item], rank_name="rank")
    return best.select(user, "rank", item, "score")


def complete_rows(df: DataFrame, cols: Sequence[str]) -> Column:
    """True where no given column is null or NaN."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def match_on_score(df: DataFrame, score: str, treated: str, outcome: str, id_col: str, caliper: float | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Nearest-neighbour matching with replacement on a given score (C-11).

    Every treated row gets the control with the nearest score over the whole
    order by score and id (at equal distance the one before it); beyond the
    ``caliper`` distance, or without any control or score, it stays with a null
    control. The order is written in ranges that hold a like share of the rows
    (:func:`ranged`), and the nearest control below and above cross range edges
    through one row per range; pairs are never enumerated."""
    from tessera.operators import windows as WB
    df = ranged(df, [score, id_col], "_range", "score-ranges", buckets)
    bucket = F.col("_range")
    known = F.col(score).isNotNull()
    # one struct per control row, so the score, id and outcome always come from the same control
    control = F.when((F.col(treated) == 0) & known, F.struct(F.col(score).cast("double").alias("s"), F.col(id_col).alias("i"), F.col(outcome).alias("y")))
    s = df.withColumn("_c", control)
    s = WB.last_non_null(s, [], [score, id_col], "_c", bucket, "_lo")
    s = WB.next_non_null(s, [], [score, id_col], "_c", bucket, "_hi")
    t = s.filter(F.col(treated) == 1).drop("_range")
    lo = F.col(score) - F.col("_lo.s")
    hi = F.col("_hi.s") - F.col(score)
    best = F.when(F.col("_hi").isNull() | (lo <= hi), F.col("_lo")).otherwise(F.col("_hi"))
    far = F.least(lo, hi)
    best = F.when(known & (F.lit(True) if caliper is None else far <= caliper), best)
    return t.withColumn("_m", best).select(id_col, score, F.col(outcome).alias("y_treated"), F.col("_m.i").alias("control_id"),
                                           F.col("_m.y").alias("y_control"))


def match_psm(df: DataFrame, treated: str, covariates: Sequence[str], outcome: str, id_col: str,
              caliper: float | None = 0.05) -> DataFrame:
    """Propensity-score matching with replacement (C-11): a logistic regression
    gives each row a propensity score, and :func:`match_on_score` finds the
    nearest control within the caliper. Rows with a missing covariate have no
    score; a treated one stays with a null control."""
    ok = complete_rows(df, covariates)
    va = VectorAssembler(inputCols=list(covariates), outputCol="_x")
    lr = LogisticRegression(labelCol="_t", featuresCol="_x", maxIter=50)
    full = df.filter(ok).withColumn("_t", F.col(treated).cast("double"))
    scored = Pipeline(stages=[va, lr]).fit(full).transform(full).withColumn("pscore", vector_to_array("probability")[1])
    rows = scored.select(*df.columns, "pscore").unionByName(df.filter(~ok).withColumn("pscore", F.lit(None).cast("double")))
    return match_on_score(rows, "pscore", treated, outcome, id_col, caliper)
