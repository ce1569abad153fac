"""Models and causal estimates over customers and orders.

Churn binding (chosen here): the cutoff is one year before the last order
date in the data; features use only orders before the cutoff (order count,
mean and total price, days since the last order at the cutoff), the
customer's balance and segment, and the number of events of the customer;
label = 1 when the customer has no order on or after the cutoff.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import cooccurrence, kpi as K, ml, stats
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources.stage import staged

W = B.with_ctes
NUMERIC = ["n_orders", "mean_price", "recency_days", "c_acctbal", "n_events"]
CATEGORICAL = ["c_mktsegment"]


def churn_frame(spark, sf_dir):
    t = tables(spark, sf_dir)
    o = t.orders
    cutoff = o.select(F.max("o_orderdate") - F.make_dt_interval(F.lit(365))).scalar()
    before = o.filter(F.col("o_orderdate") < cutoff).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
        F.datediff(cutoff, F.max("o_orderdate")).alias("recency_days"))
    after = o.filter(F.col("o_orderdate") >= cutoff).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n_after"))
    ev = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    j = (c.join(before, c.c_custkey == before.o_custkey, "left").drop("o_custkey")
         .join(after, c.c_custkey == after.o_custkey, "left").drop("o_custkey")
         .join(ev, c.c_custkey == ev.user_id, "left").drop("user_id"))
    return j.select(
        "c_custkey", "c_mktsegment", "c_acctbal",
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        F.coalesce("mean_price", F.lit(0.0)).alias("mean_price"),
        F.coalesce(F.col("recency_days"), F.lit(3650)).cast("double").alias("recency_days"),
        F.coalesce("n_events", F.lit(0)).cast("double").alias("n_events"),
        F.when(F.col("_n_after").isNull(), 1.0).otherwise(0.0).alias("label"))


CHURN_CTE = """cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS c FROM orders),
bf AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price,
              datediff('day', max(o_orderdate), (SELECT c FROM cut)) AS recency_days
       FROM orders WHERE o_orderdate < (SELECT c FROM cut) GROUP BY o_custkey),
af AS (SELECT o_custkey, count(*) AS n_after FROM orders WHERE o_orderdate >= (SELECT c FROM cut) GROUP BY o_custkey),
ev AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id),
churn AS (SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, CAST(coalesce(bf.n_orders, 0) AS DOUBLE) AS n_orders,
                 coalesce(bf.mean_price, 0.0) AS mean_price, CAST(coalesce(bf.recency_days, 3650) AS DOUBLE) AS recency_days,
                 CAST(coalesce(ev.n_events, 0) AS DOUBLE) AS n_events,
                 CASE WHEN af.n_after IS NULL THEN 1.0 ELSE 0.0 END AS label
          FROM customer c LEFT JOIN bf ON c.c_custkey = bf.o_custkey LEFT JOIN af ON c.c_custkey = af.o_custkey
          LEFT JOIN ev ON c.c_custkey = ev.user_id)"""


@register("churn_features", ops=("J-1",), sql=W(CHURN_CTE) + """
SELECT c_custkey, c_mktsegment, c_acctbal, n_orders, round(mean_price, 6) AS mean_price, recency_days, n_events, label FROM churn""")
def churn_features(spark, sf_dir):
    return rounded(churn_frame(spark, sf_dir))


def _split(spark, sf_dir):
    return ml.split_by_key(staged(churn_frame(spark, sf_dir), "churn"), "c_custkey")


@register("train_compare", ops=("J-1", "J-2", "J-4"))
def train_compare(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    prep = ml.feature_pipeline(CATEGORICAL, NUMERIC).fit(train)
    tr, te = staged(prep.transform(train), "churn-train"), staged(prep.transform(test), "churn-test")
    out = None
    for name, est in ml.classifiers().items():
        model = est.fit(tr)
        pred = ml.positive_probability(model.transform(te))
        m = ml.evaluate(pred).select(F.lit(name).alias("model"), "*")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


@register("tune", ops=("J-3",))
def tune(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    lr = ml.classifiers()["logistic_regression"]
    tvs = ml.tune(ml.feature_pipeline(CATEGORICAL, NUMERIC).getStages(), lr, {"regParam": [0.0, 0.01, 0.1]})
    m = tvs.fit(train)
    rows = [(float(p[lr.getParam("regParam")]), float(v)) for p, v in zip(tvs.getEstimatorParamMaps(), m.validationMetrics)]
    return spark.createDataFrame(rows, "reg_param double, validation_auc double")


@register("coefficients", ops=("J-5",))
def coefficients(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    pipe = ml.feature_pipeline(CATEGORICAL, NUMERIC)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[*pipe.getStages(), ml.classifiers()["logistic_regression"]]).fit(train)
    return ml.coefficients(model, data=model.transform(train.limit(1)))


@register("cluster_behaviour", ops=("J-6",))
def cluster_behaviour(spark, sf_dir):
    d = churn_frame(spark, sf_dir)
    rows, _ = ml.cluster_behaviour(d, NUMERIC, k=4)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("churn_rate"))


@register("score_batch", ops=("J-7",))
def score_batch(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[*ml.feature_pipeline(CATEGORICAL, NUMERIC).getStages(),
                             ml.classifiers()["logistic_regression"]]).fit(train)
    return ml.score_batch(churn_frame(spark, sf_dir), model, ["c_custkey"])


@register("argmax_class", ops=("J-8",), sql="""
WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings)
SELECT vec_id, list_position(a, list_max(a)) - 1 AS class_idx, round(list_max(a) / list_sum(a), 6) AS confidence FROM p""")
def argmax_class(spark, sf_dir):
    # class probabilities of a vector: |x_i| / sum |x|  (argmax taken on |x|, which has the same order)
    e = tables(spark, sf_dir).embeddings
    a = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)
    r = ml.argmax_class(a, "a")
    return rounded(r.select("vec_id", "class_idx", (F.col("confidence") / total).alias("confidence")))


@register("stability", ops=("J-9",))
def stability(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[*ml.feature_pipeline(CATEGORICAL, NUMERIC).getStages(),
                             ml.classifiers()["logistic_regression"]]).fit(train)
    return rounded(ml.stability(model.transform(test), "c_mktsegment", "label", "prediction", "c_custkey"))


def rule_frame(spark, sf_dir):
    # a rule as the model: the share of the last year without an order, and a negative balance as the prediction
    return churn_frame(spark, sf_dir).select(
        "c_custkey", "c_mktsegment", "label", F.round(F.least(F.col("recency_days") / 365, F.lit(1.0)), 2).alias("p_pos"),
        (F.col("c_acctbal") < 0).cast("int").alias("prediction"))


RULE_CTE = CHURN_CTE + """,
ruled AS (SELECT c_custkey, c_mktsegment, label, round(least(recency_days / 365, 1.0), 2) AS p_pos,
                 CAST(c_acctbal < 0 AS INTEGER) AS prediction FROM churn)"""


@register("evaluate_rule", ops=("J-4",), sql=W(RULE_CTE) + """,
c AS (SELECT CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp, CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
             CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn, CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn FROM ruled),
g AS (SELECT p_pos, count(*) AS n, count_if(label = 1) AS npos FROM ruled WHERE p_pos IS NOT NULL GROUP BY p_pos),
r AS (SELECT npos, n, coalesce(sum(n) OVER (ORDER BY p_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS avg_rank FROM g),
a AS (SELECT (sum(avg_rank * npos) - sum(npos) * (sum(npos) + 1) / 2) / nullif(sum(npos) * sum(n - npos), 0) AS auc FROM r)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
       round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
       / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1, round(CAST(auc AS DOUBLE), 6) AS auc FROM c, a""")
def evaluate_rule(spark, sf_dir):
    """Metrics of a rule's predictions and scores, many of them tied."""
    return rounded(ml.evaluate(rule_frame(spark, sf_dir)))


@register("risk_bands", ops=("J-7",), sql=W(RULE_CTE) + """
SELECT c_custkey, p_pos, CASE WHEN p_pos < 0.3 THEN 'low' WHEN p_pos < 0.6 THEN 'medium' ELSE 'high' END AS risk,
       CASE WHEN p_pos < 0.3 THEN 'no action' WHEN p_pos < 0.6 THEN 'retention offer' ELSE 'personal call' END AS action FROM ruled""")
def risk_bands(spark, sf_dir):
    """Risk bands and actions of the rule's scores."""
    return ml.risk_bands(rule_frame(spark, sf_dir)).select("c_custkey", "p_pos", "risk", "action")


@register("stability_rule", ops=("J-9",), sql=W(RULE_CTE) + f""",
d AS (SELECT c_mktsegment, CAST(label = prediction AS INTEGER) AS ok, b, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':'
             || CAST(b AS VARCHAR) || ':{ml.SEED}'), 1, 13) AS BIGINT) / {float(1 << 52)!r} AS u FROM ruled, range(20) AS r(b)),
w AS (SELECT *, len(list_filter({ml.poisson1_cdf()!r}::DOUBLE[], lambda c: u >= c)) AS w FROM d),
p AS (SELECT c_mktsegment, b, CAST(sum(w * ok) AS DOUBLE) / nullif(sum(w), 0) AS acc FROM w GROUP BY c_mktsegment, b),
i AS (SELECT c_mktsegment, quantile_cont(acc, 0.025) AS acc_low, quantile_cont(acc, 0.975) AS acc_high FROM p GROUP BY c_mktsegment)
SELECT c_mktsegment, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy, count(*) AS n,
       round(any_value(acc_low), 6) AS acc_low, round(any_value(acc_high), 6) AS acc_high
FROM ruled JOIN i USING (c_mktsegment) GROUP BY c_mktsegment""")
def stability_rule(spark, sf_dir):
    """Accuracy of the rule per segment with its bootstrap interval."""
    return rounded(ml.stability(rule_frame(spark, sf_dir), "c_mktsegment", "label", "prediction", "c_custkey"))


@register("feature_vectors", ops=("J-1",), sql=W(CHURN_CTE) + """,
s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS slot FROM churn GROUP BY c_mktsegment)
SELECT c_custkey, CAST(slot AS INTEGER) AS segment_slot,
       """ + ",\n       ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS z_{c}" for c in NUMERIC) + """
FROM churn JOIN s USING (c_mktsegment)""")
def feature_vectors(spark, sf_dir):
    """The vectors that the models are given: the slot of the segment and standardised measures."""
    d = staged(churn_frame(spark, sf_dir), "churn")
    rows = ml.feature_pipeline(CATEGORICAL, NUMERIC).fit(d).transform(d)
    x = rows.select("c_custkey", vector_to_array("features").alias("x")).withColumn("slots", F.size("x") - len(NUMERIC))
    return rounded(x.select(
        "c_custkey", (F.array_position(F.slice("x", F.lit(1), F.col("slots")), 1.0) - 1).cast("int").alias("segment_slot"),
        *[F.get("x", F.col("slots") + j).alias(f"z_{c}") for j, c in enumerate(NUMERIC)]))


@register("recommend", ops=("J-10",))
def recommend(spark, sf_dir):
    t = tables(spark, sf_dir)
    inter = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"))
             .agg(F.sum("l_quantity").cast("float").alias("rating")))
    return ml.recommend(inter, "user", "item", "rating", k=5)


@register("recommend_popular", ops=("J-10",), sql="""
WITH p AS (SELECT o.o_custkey AS c_custkey, l.l_partkey AS p_partkey, l.l_quantity AS w
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
owned AS (SELECT DISTINCT c_custkey, p_partkey FROM p),
pop AS (SELECT c.c_mktsegment, p.p_partkey, sum(p.w) AS score FROM p JOIN customer c ON c.c_custkey = p.c_custkey
        GROUP BY c.c_mktsegment, p.p_partkey),
rk AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, p_partkey) AS r FROM pop),
cand AS (SELECT c.c_custkey, rk.p_partkey, rk.score, rk.r FROM customer c JOIN rk ON c.c_mktsegment = rk.c_mktsegment
         WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.c_custkey = c.c_custkey AND o.p_partkey = rk.p_partkey))
SELECT c_custkey, rank, p_partkey, score FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY r, p_partkey) AS rank FROM cand) WHERE rank <= 5""")
def recommend_popular(spark, sf_dir):
    t = tables(spark, sf_dir)
    purchases = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
                 .select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey"),
                         F.col("l_quantity").alias("w")))
    users = t.customer.select("c_custkey", "c_mktsegment")
    return ml.recommend_popular(purchases, users, "c_custkey", "p_partkey", "w", "c_mktsegment", 5)


@register("related_items", ops=("J-10",), sql="""
WITH p AS (SELECT DISTINCT o.o_custkey AS b, l.l_partkey AS i FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           WHERE o.o_custkey IS NOT NULL AND l.l_partkey IS NOT NULL),
n AS (SELECT i, count(*) AS n FROM p GROUP BY i),
s AS (SELECT x.i AS a, y.i AS i, count(*) AS shared FROM p x JOIN p y ON x.b = y.b AND x.i <> y.i GROUP BY x.i, y.i HAVING count(*) >= 2),
r AS (SELECT s.a AS item, s.i AS related, s.shared, s.shared / sqrt(CAST(na.n * nb.n AS DOUBLE)) AS score
      FROM s JOIN n na ON s.a = na.i JOIN n nb ON s.i = nb.i),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, related) AS INTEGER) AS rank FROM r)
SELECT item, rank, related, shared, round(score, 6) AS score FROM k WHERE rank <= 5""")
def related_items(spark, sf_dir):
    """Parts bought by the same customers; a basket is all a customer bought."""
    t = tables(spark, sf_dir)
    bought = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(cooccurrence.related_items(bought, "o_custkey", "l_partkey", 5))


@register("match_psm", ops=("C-11",))
def match_psm(spark, sf_dir):
    d = churn_frame(spark, sf_dir).withColumn("treated", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    m = ml.match_psm(d, "treated", ["c_acctbal", "n_orders", "recency_days"], "mean_price", "c_custkey")
    return rounded(m)


@register("match_on_score", ops=("C-11",), sql="""
WITH x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS s, c_mktsegment = 'BUILDING' AS t, c_nationkey AS y FROM customer),
w AS (SELECT *, last_value(CASE WHEN NOT t AND s IS NOT NULL THEN {'s': s, 'i': id, 'y': y} END IGNORE NULLS)
                  OVER (ORDER BY s NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
                first_value(CASE WHEN NOT t AND s IS NOT NULL THEN {'s': s, 'i': id, 'y': y} END IGNORE NULLS)
                  OVER (ORDER BY s NULLS FIRST, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM x),
m AS (SELECT *, CASE WHEN s IS NULL OR least(s - lo.s, hi.s - s) > 2 THEN NULL WHEN hi IS NULL OR s - lo.s <= hi.s - s THEN lo ELSE hi END AS best FROM w WHERE t)
SELECT id, round(s, 6) AS score, y AS y_treated, best.i AS control_id, best.y AS y_control FROM m""")
def match_on_score(spark, sf_dir):
    """Customers of one segment against the others on their balance, some withheld, within a distance of 2."""
    c = tables(spark, sf_dir).customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("score"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"), F.col("c_nationkey").alias("y"))
    return rounded(ml.match_on_score(c, "score", "treated", "y", "id", caliper=2.0))


@register("diff_in_diff", ops=("D-28",), sql="""
WITH x AS (SELECT o_totalprice AS y, c_mktsegment = 'BUILDING' AS t, o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AS p
           FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT avg(CASE WHEN t AND p THEN y END) AS treated_post, avg(CASE WHEN t AND NOT p THEN y END) AS treated_pre,
             avg(CASE WHEN NOT t AND p THEN y END) AS control_post, avg(CASE WHEN NOT t AND NOT p THEN y END) AS control_pre FROM x)
SELECT round(treated_post, 6) AS treated_post, round(treated_pre, 6) AS treated_pre, round(control_post, 6) AS control_post,
       round(control_pre, 6) AS control_pre, round((treated_post - treated_pre) - (control_post - control_pre), 6) AS did FROM m""")
def diff_in_diff(spark, sf_dir):
    t = tables(spark, sf_dir)
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_totalprice", (F.col("c_mktsegment") == "BUILDING").alias("treated"),
        (F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("post"))
    return rounded(stats.diff_in_diff(x, "o_totalprice", "treated", "post"))


@register("rdd_estimate", ops=("D-29",), sql="""
WITH x AS (SELECT o_totalprice AS y, c_acctbal - 0.0 AS r FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE abs(c_acctbal - 0.0) <= 1000)
SELECT round(regr_intercept(CASE WHEN r < 0 THEN y END, CASE WHEN r < 0 THEN r END), 6) AS intercept_left,
       round(regr_slope(CASE WHEN r < 0 THEN y END, CASE WHEN r < 0 THEN r END), 6) AS slope_left,
       round(regr_intercept(CASE WHEN r >= 0 THEN y END, CASE WHEN r >= 0 THEN r END), 6) AS intercept_right,
       round(regr_slope(CASE WHEN r >= 0 THEN y END, CASE WHEN r >= 0 THEN r END), 6) AS slope_right,
       count_if(r < 0) AS n_left, count_if(r >= 0) AS n_right,
       round(regr_intercept(CASE WHEN r >= 0 THEN y END, CASE WHEN r >= 0 THEN r END)
             - regr_intercept(CASE WHEN r < 0 THEN y END, CASE WHEN r < 0 THEN r END), 6) AS jump
FROM x""")
def rdd_estimate(spark, sf_dir):
    t = tables(spark, sf_dir)
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.rdd_estimate(x, "o_totalprice", "c_acctbal", 0.0, 1000.0))


@register("shrunk_means", ops=("D-31",), sql="""
WITH g AS (SELECT c_nationkey, count(c_acctbal) AS n, avg(c_acctbal) AS mean, var_samp(c_acctbal) AS var
           FROM customer GROUP BY c_nationkey),
s AS (SELECT (SELECT avg(c_acctbal) FROM customer) AS grand,
             sum((n - 1) * var) / sum(n - 1) AS within, var_samp(mean) AS between, avg(1 / n) AS avg_inv_n FROM g),
w AS (SELECT g.*, greatest(s.between - s.within * s.avg_inv_n, 0.0) AS tau2, s.within, s.grand FROM g, s)
SELECT c_nationkey, n, round(mean, 6) AS mean, round(coalesce(tau2 / (tau2 + within / n), 0.0), 6) AS weight,
       round(coalesce(tau2 / (tau2 + within / n), 0.0) * mean + (1 - coalesce(tau2 / (tau2 + within / n), 0.0)) * grand, 6) AS shrunk_mean
FROM w""")
def shrunk_means(spark, sf_dir):
    return rounded(stats.shrunk_means(tables(spark, sf_dir).customer, "c_nationkey", "c_acctbal"))


@register("incidence_rates", ops=("D-27",), sql="""
WITH g AS (SELECT r_name, count_if(l_returnflag = 'R') AS cases, sum(l_quantity) AS person_time
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT r_name, cases, person_time, round(cases / person_time, 9) AS rate,
       round(cases / person_time * exp(-1.96 * (1 / sqrt(cases))), 9) AS rate_low,
       round(cases / person_time * exp(1.96 * (1 / sqrt(cases))), 9) AS rate_high FROM g""")
def incidence_rates(spark, sf_dir):
    t = tables(spark, sf_dir)
    x = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
         .select("r_name", (F.col("l_returnflag") == "R").cast("long").alias("case"), "l_quantity"))
    return rounded(stats.incidence_rates(x, ["r_name"], "case", "l_quantity"), 9)


@register("rate_ratio", ops=("D-27",), sql="""
WITH g AS (SELECT l_shipmode AS mode, count_if(l_returnflag = 'R') / sum(l_quantity) AS rate FROM (
             SELECT CASE WHEN l_discount > 0.05 THEN 'exposed' ELSE 'reference' END AS l_shipmode, l_returnflag, l_quantity FROM lineitem) GROUP BY 1)
SELECT round(max(CASE WHEN mode = 'exposed' THEN rate END), 9) AS rate_exposed,
       round(max(CASE WHEN mode = 'reference' THEN rate END), 9) AS rate_reference,
       round(max(CASE WHEN mode = 'exposed' THEN rate END) / max(CASE WHEN mode = 'reference' THEN rate END), 9) AS rate_ratio FROM g""")
def rate_ratio(spark, sf_dir):
    """Returns per unit sold with a discount over 5 percent against the rest."""
    li = tables(spark, sf_dir).lineitem
    x = li.select(F.when(F.col("l_discount") > 0.05, "exposed").otherwise("reference").alias("arm"),
                  (F.col("l_returnflag") == "R").cast("long").alias("case"), "l_quantity")
    return rounded(stats.rate_ratio(stats.incidence_rates(x, ["arm"], "case", "l_quantity"), "arm", "exposed", "reference"), 9)


@register("group_fairness", ops=("D-30",), sql=W(CHURN_CTE) + """,
g AS (SELECT c_mktsegment, count(*) AS n, avg((c_acctbal < 0)::INT::DOUBLE) AS positive_rate,
             CASE WHEN count_if(label = 1) > 0 THEN count_if(c_acctbal < 0 AND label = 1) / count_if(label = 1) END AS tpr
      FROM churn GROUP BY c_mktsegment)
SELECT c_mktsegment, n, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr,
       round((SELECT max(positive_rate) - min(positive_rate) FROM g), 6) AS parity_gap FROM g""")
def group_fairness(spark, sf_dir):
    # a rule "prediction" (negative balance flags churn risk) audited per segment
    d = churn_frame(spark, sf_dir).withColumn("pred", (F.col("c_acctbal") < 0).cast("int"))
    return rounded(K.group_fairness(d, "c_mktsegment", "pred", "label"))
