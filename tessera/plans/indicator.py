"""The indicator report: read, cast, missing check, left join, statistics,
outliers, ranking, banding, map layer (SURVEY 3.1) over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import classify_bands, clean_names, rag_status
from tessera.operators import joins, ranking, stats, quality
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources import files

W = B.with_ctes


def _indicator(spark, sf_dir):
    """A-1: the indicator with its measure cast from text."""
    return files.cast_measures(B.indicator(tables(spark, sf_dir)), {"prevalence": "double"})


IND_NUM_CTE = """ind AS (
  SELECT iso_code, country,
         CASE WHEN isnan(TRY_CAST(prevalence AS DOUBLE)) THEN NULL ELSE TRY_CAST(prevalence AS DOUBLE) END AS prevalence
  FROM indicator)"""

BANDS_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 10 THEN 'Very Low' WHEN {x} < 20 THEN 'Low'
  WHEN {x} < 30 THEN 'Moderate' WHEN {x} < 40 THEN 'High' ELSE 'Very High' END"""

# Display colour of each band, and of a missing value.
BAND_COLOURS = {
    "Very Low": "#2C7BB6",
    "Low": "#ABD9E9",
    "Moderate": "#FFFFBF",
    "High": "#FDAE61",
    "Very High": "#D7191C",
}
MISSING_COLOUR = "grey90"


def colour_of(band):
    expr = F.when(band.isNull(), F.lit(MISSING_COLOUR))
    for k, v in BAND_COLOURS.items():
        expr = expr.when(band == k, F.lit(v))
    return expr


COLOUR_SQL = ("CASE WHEN {b} IS NULL THEN '" + MISSING_COLOUR + "' "
              + " ".join(f"WHEN {{b}} = '{k}' THEN '{v}'" for k, v in BAND_COLOURS.items()) + " END")


def _joined(spark, sf_dir):
    t = tables(spark, sf_dir)
    return joins.attach_indicator(B.boundaries(t), _indicator(spark, sf_dir), "ADM0_A3", "iso_code")


JOINED_CTE = """joined AS (
  SELECT b.ADM0_A3, b.NAME, i.country, i.prevalence FROM boundaries b LEFT JOIN ind i ON b.ADM0_A3 = i.iso_code)"""

CTES = (B.INDICATOR_CTE, B.BOUNDARIES_CTE, IND_NUM_CTE, JOINED_CTE)


@register("map_layer", ops=("L-4", "C-1", "B-1", "A-1"), sql=W(*CTES) + f"""
SELECT ADM0_A3 AS key, NAME AS name, prevalence AS value,
       {BANDS_SQL.format(x='prevalence')} AS band,
       {COLOUR_SQL.format(b='(' + BANDS_SQL.format(x='prevalence') + ')')} AS colour,
       prevalence IS NULL AS is_missing
FROM joined""")
def map_layer(spark, sf_dir):
    j = _joined(spark, sf_dir)
    band = classify_bands(F.col("prevalence"))
    return j.select(F.col("ADM0_A3").alias("key"), F.col("NAME").alias("name"),
                    F.col("prevalence").alias("value"), band.alias("band"),
                    colour_of(band).alias("colour"), F.col("prevalence").isNull().alias("is_missing"))


@register("read_table", ops=("A-1",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE) + "SELECT * FROM ind")
def read_table(spark, sf_dir):
    return _indicator(spark, sf_dir)


@register("clean_names", ops=("A-2",), sql="""
SELECT c_custkey AS cust_key, c_name AS customer_name, CAST(c_nationkey AS VARCHAR) AS iso_code,
       c_acctbal AS acct_bal_usd, c_mktsegment AS mkt_segment, c_mktsegment AS mkt_segment_2
FROM customer""")
def clean_names_q(spark, sf_dir):
    c = tables(spark, sf_dir).customer
    sheet = c.select(F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Customer Name"),
                     F.col("c_nationkey").cast("string").alias("ISOCode"),
                     F.col("c_acctbal").alias("AcctBal (USD)"), F.col("c_mktsegment").alias("mkt-segment"),
                     F.col("c_mktsegment").alias("Mkt Segment"))
    return clean_names(sheet)


@register("missing_by_column", ops=("D-3",), sql=W(*CTES) + """
SELECT column_name, n_missing FROM (
  SELECT 'ADM0_A3' AS column_name, count_if(ADM0_A3 IS NULL) AS n_missing FROM joined
  UNION ALL SELECT 'NAME', count_if(NAME IS NULL) FROM joined
  UNION ALL SELECT 'country', count_if(country IS NULL) FROM joined
  UNION ALL SELECT 'prevalence', count_if(prevalence IS NULL OR isnan(prevalence)) FROM joined)""")
def missing_by_column(spark, sf_dir):
    return stats.missing_by_column(_joined(spark, sf_dir))


@register("missing_by_column_lineitem", ops=("D-3",), sql="""
SELECT column_name, n_missing FROM (
  SELECT 'l_orderkey' AS column_name, count_if(l_orderkey IS NULL) AS n_missing FROM lineitem
  UNION ALL SELECT 'l_quantity', count_if(l_quantity IS NULL OR isnan(l_quantity)) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', count_if(l_extendedprice IS NULL OR isnan(l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_discount', count_if(l_discount IS NULL OR isnan(l_discount)) FROM lineitem
  UNION ALL SELECT 'l_tax', count_if(l_tax IS NULL OR isnan(l_tax)) FROM lineitem
  UNION ALL SELECT 'l_partkey', count_if(l_partkey IS NULL) FROM lineitem
  UNION ALL SELECT 'l_suppkey', count_if(l_suppkey IS NULL) FROM lineitem
  UNION ALL SELECT 'l_linenumber', count_if(l_linenumber IS NULL) FROM lineitem
  UNION ALL SELECT 'l_returnflag', count_if(l_returnflag IS NULL) FROM lineitem
  UNION ALL SELECT 'l_linestatus', count_if(l_linestatus IS NULL) FROM lineitem
  UNION ALL SELECT 'l_shipdate', count_if(l_shipdate IS NULL) FROM lineitem)""")
def missing_by_column_lineitem(spark, sf_dir):
    return stats.missing_by_column(tables(spark, sf_dir).lineitem)


@register("attach_indicator", ops=("C-1",), sql=W(*CTES) + "SELECT * FROM joined")
def attach_indicator(spark, sf_dir):
    return _joined(spark, sf_dir)


@register("join_coverage", ops=("C-2",), sql=W(*CTES) + """
SELECT (SELECT count(*) FROM joined)::BIGINT AS result_rows,
       (SELECT count(*) FROM boundaries b WHERE NOT EXISTS (SELECT 1 FROM ind i WHERE i.iso_code = b.ADM0_A3))::BIGINT AS left_unmatched,
       (SELECT count(*) FROM ind i WHERE NOT EXISTS (SELECT 1 FROM boundaries b WHERE i.iso_code = b.ADM0_A3))::BIGINT AS right_unmatched,
       (SELECT count(DISTINCT b.ADM0_A3) FROM boundaries b JOIN ind i ON i.iso_code = b.ADM0_A3)::BIGINT AS matched_keys""")
def join_coverage(spark, sf_dir):
    t = tables(spark, sf_dir)
    return joins.join_coverage(B.boundaries(t), _indicator(spark, sf_dir), "ADM0_A3", "iso_code")


DESCRIBE_SQL = """
SELECT {by}count(*) AS n, count_if({x} IS NULL) AS n_missing, round(avg({x}), 6) AS mean,
       round(quantile_cont({x}, 0.5), 6) AS median, round(min({x}), 6) AS min, round(max({x}), 6) AS max,
       round(stddev_samp({x}), 6) AS sd, round(var_samp({x}), 6) AS variance,
       round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.75), 6) AS q3,
       round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) AS iqr
FROM {src} {group}"""


@register("describe_numeric", ops=("D-1",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE)
          + DESCRIBE_SQL.format(by="", x="prevalence", src="ind", group=""))
def describe_numeric(spark, sf_dir):
    return rounded(stats.describe_numeric(_indicator(spark, sf_dir), "prevalence"))


@register("describe_quantity_by_flag", ops=("D-1",),
          sql=DESCRIBE_SQL.format(by="l_returnflag, ", x="l_quantity", src="lineitem",
                                  group="GROUP BY l_returnflag"))
def describe_quantity_by_flag(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return rounded(stats.describe_numeric(li, "l_quantity", by=["l_returnflag"]))


@register("summary_overview", ops=("D-2",), sql="""
SELECT * FROM (
  SELECT 0 AS position, 'c_custkey' AS column_name, 'bigint' AS data_type, count(*) AS n_rows,
         count_if(c_custkey IS NULL) AS n_missing, count(DISTINCT c_custkey) AS n_distinct,
         CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value FROM customer
  UNION ALL SELECT 1, 'c_name', 'string', count(*), count_if(c_name IS NULL), count(DISTINCT c_name),
         min(c_name), max(c_name) FROM customer
  UNION ALL SELECT 2, 'c_nationkey', 'int', count(*), count_if(c_nationkey IS NULL), count(DISTINCT c_nationkey),
         CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer
  UNION ALL SELECT 3, 'c_mktsegment', 'string', count(*), count_if(c_mktsegment IS NULL), count(DISTINCT c_mktsegment),
         min(c_mktsegment), max(c_mktsegment) FROM customer
  UNION ALL SELECT 4, 'c_acctcents', 'bigint', count(*), count_if(c_acctbal IS NULL), count(DISTINCT CAST(round(c_acctbal * 100) AS BIGINT)),
         CAST(min(CAST(round(c_acctbal * 100) AS BIGINT)) AS VARCHAR), CAST(max(CAST(round(c_acctbal * 100) AS BIGINT)) AS VARCHAR) FROM customer)""")
def summary_overview(spark, sf_dir):
    # the balance in whole cents, so that its extremes read alike in every engine
    c = tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                                              F.round(F.col("c_acctbal") * 100).cast("bigint").alias("c_acctcents"))
    return stats.summary_overview(c, exact_distinct=True)


@register("first_rows", ops=("D-2",), sql="SELECT * FROM customer ORDER BY c_custkey LIMIT 6")
def first_rows(spark, sf_dir):
    return stats.first_rows(tables(spark, sf_dir).customer, ["c_custkey"], 6)


@register("read_any", ops=("A-7",), sql="SELECT * FROM supplier")
def read_any(spark, sf_dir):
    """A given table through the format dispatch."""
    return files.read_any(spark, f"{sf_dir.rstrip('/')}/supplier.parquet")


@register("rag_status", ops=("B-21",), sql="""
SELECT n_nationkey, round(m, 6) AS mean_balance,
       CASE WHEN m IS NULL THEN 'Grey' WHEN m >= 4600 THEN 'Green' WHEN m >= 4300 THEN 'Amber' ELSE 'Red' END AS higher_better,
       CASE WHEN m IS NULL THEN 'Grey' WHEN m <= 4300 THEN 'Green' WHEN m <= 4600 THEN 'Amber' ELSE 'Red' END AS lower_better
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE avg(c_acctbal) END AS m
      FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)""")
def rag_status_q(spark, sf_dir):
    """Traffic light of every nation's mean balance, some of them withheld."""
    t = tables(spark, sf_dir)
    g = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    g = t.nation.join(g, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("m", F.when(F.col("n_nationkey") % 7 != 0, F.col("m")))
    return rounded(g.select("n_nationkey", F.col("m").alias("mean_balance"), rag_status("m", 4300, 4600).alias("higher_better"),
                            rag_status("m", 4600, 4300, higher_is_better=False).alias("lower_better")))


HIST_SQL = """, v AS (SELECT {x} AS x FROM {src} WHERE {x} IS NOT NULL AND NOT isnan({x})),
s AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM v),
b AS (SELECT CAST(CASE WHEN (s.hi - s.lo) / {bins} = 0 THEN 0
                  ELSE least(floor((v.x - s.lo) / ((s.hi - s.lo) / {bins})), {bins} - 1) END AS INTEGER) AS bin
      FROM v, s),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT d.bin, round(s.lo + d.bin * ((s.hi - s.lo) / {bins}), 6) AS bin_lo,
       round(s.lo + (d.bin + 1) * ((s.hi - s.lo) / {bins}), 6) AS bin_hi,
       coalesce(c.n, 0) AS n, round(s.mean, 6) AS mean, round(s.median, 6) AS median
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) d CROSS JOIN s LEFT JOIN c ON c.bin = d.bin"""


@register("histogram", ops=("D-4",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE).rstrip()
          + HIST_SQL.format(x="prevalence", src="ind", bins=20))
def histogram(spark, sf_dir):
    return rounded(stats.histogram(_indicator(spark, sf_dir), "prevalence", bins=20))


@register("histogram_extendedprice", ops=("D-4",),
          sql="WITH x AS (SELECT 1)" + HIST_SQL.format(x="l_extendedprice", src="lineitem", bins=20))
def histogram_extendedprice(spark, sf_dir):
    return rounded(stats.histogram(tables(spark, sf_dir).lineitem, "l_extendedprice", bins=20))


@register("boxplot_stats", ops=("D-5",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE).rstrip() + """,
q AS (SELECT quantile_cont(prevalence, 0.25) AS q1, quantile_cont(prevalence, 0.75) AS q3 FROM ind),
f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
SELECT count(*) AS n, round(min(prevalence), 6) AS min, round(any_value(f.q1), 6) AS q1,
       round(quantile_cont(prevalence, 0.5), 6) AS median, round(any_value(f.q3), 6) AS q3,
       round(any_value(f.lf), 6) AS lower_fence, round(any_value(f.hf), 6) AS upper_fence,
       round(min(CASE WHEN prevalence >= f.lf THEN prevalence END), 6) AS whisker_low,
       round(max(CASE WHEN prevalence <= f.hf THEN prevalence END), 6) AS whisker_high,
       round(max(prevalence), 6) AS max,
       count_if(prevalence < f.lf) AS n_out_low, count_if(prevalence > f.hf) AS n_out_high
FROM ind, f WHERE prevalence IS NOT NULL""")
def boxplot_stats(spark, sf_dir):
    return rounded(stats.boxplot_stats(_indicator(spark, sf_dir), "prevalence"))


@register("outliers_iqr", ops=("E-4",), sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, user_id, value FROM events, q WHERE value > q3 + 1.5 * (q3 - q1)""")
def outliers_iqr(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "user_id", "value")
    return quality.outliers_iqr(e, "value", side="upper", tiebreak=["event_id"])


@register("distribution_label", ops=("E-5",), sql="""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem),
m AS (SELECT avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM v),
k AS (SELECT avg(power(x - m.mean, 3)) / power(avg(power(x - m.mean, 2)), 1.5) AS skewness FROM v, m)
SELECT round(mean, 6) AS mean, round(median, 6) AS median, round(skewness, 6) AS skewness,
       CASE WHEN mean - median > 0 THEN 'positive skew' WHEN mean - median < 0 THEN 'negative skew'
            ELSE 'symmetric' END AS label
FROM m, k""")
def distribution_label(spark, sf_dir):
    return rounded(stats.distribution_label(tables(spark, sf_dir).lineitem, "l_extendedprice"))


@register("sort_by", ops=("F-1",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE) + "SELECT * FROM ind")
def sort_by(spark, sf_dir):
    return ranking.sort_by(_indicator(spark, sf_dir), "prevalence", desc=True, tiebreak=["iso_code"])


@register("top_k", ops=("F-2",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE)
          + "SELECT * FROM ind ORDER BY prevalence DESC NULLS LAST, iso_code LIMIT 10")
def top_k(spark, sf_dir):
    return ranking.top_k(_indicator(spark, sf_dir), "prevalence", 10, tiebreak=["iso_code"])


@register("bottom_k", ops=("F-2",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE)
          + "SELECT * FROM ind ORDER BY prevalence ASC NULLS LAST, iso_code LIMIT 10")
def bottom_k(spark, sf_dir):
    return ranking.bottom_k(_indicator(spark, sf_dir), "prevalence", 10, tiebreak=["iso_code"])


@register("bar_order", ops=("F-3",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE) + """
SELECT *, row_number() OVER (ORDER BY prevalence DESC NULLS LAST, iso_code) AS bar_pos
FROM (SELECT * FROM ind ORDER BY prevalence DESC NULLS LAST, iso_code LIMIT 15)""")
def bar_order(spark, sf_dir):
    top = ranking.top_k(_indicator(spark, sf_dir), "prevalence", 15, tiebreak=["iso_code"])
    return ranking.bar_order(top, "prevalence", tiebreak=["iso_code"])


@register("top_customers_per_nation", ops=("F-4",), sql="""
SELECT * FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank
  FROM customer) WHERE rank <= 3""")
def top_customers_per_nation(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.top_k_per_group(c, ["c_nationkey"], "c_acctbal", 3, tiebreak=["c_custkey"])


@register("classify_bands", ops=("B-1",), sql=W(B.INDICATOR_CTE, IND_NUM_CTE)
          + f"SELECT iso_code, prevalence, {BANDS_SQL.format(x='prevalence')} AS band FROM ind")
def classify_bands_q(spark, sf_dir):
    i = _indicator(spark, sf_dir)
    return i.select("iso_code", "prevalence", classify_bands(F.col("prevalence")).alias("band"))


@register("band_counts", ops=("B-1", "D-7"), sql=W(B.INDICATOR_CTE, IND_NUM_CTE) + f"""
SELECT d.band, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM
 (SELECT * FROM (VALUES ('Very Low'), ('Low'), ('Moderate'), ('High'), ('Very High')) t(band)) d
 LEFT JOIN (SELECT {BANDS_SQL.format(x='prevalence')} AS band, count(*) AS n FROM ind GROUP BY 1) c ON c.band = d.band""")
def band_counts(spark, sf_dir):
    from tessera.operators.tasks import count_by_domain
    from tessera.functions.columns import DEFAULT_LABELS
    i = _indicator(spark, sf_dir).withColumn("band", classify_bands(F.col("prevalence")))
    return count_by_domain(i, "band", DEFAULT_LABELS)

