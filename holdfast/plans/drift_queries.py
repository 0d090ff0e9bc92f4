"""Data quality, drift and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import jobs
from holdfast.config import DriftSettings
from holdfast.operators import drift, features, quality, wide
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded
from holdfast.session import work_dir
from holdfast.sources.tables import read_history

CUT = "1998-07-01"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _halves(spark, sf):
    rows = B.table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    # A shifted price and an irregular gap, so that drift and missing categories have something to find.
    rows = rows.withColumns(
        {
            "l_discount": F.when(before, F.col("l_discount")).otherwise(F.col("l_discount") + 0.02),
            "l_linestatus": F.when(F.col("l_partkey") % 20 != 0, F.col("l_linestatus")),
        }
    )
    return rows.where(before), rows.where(~before)


_HALVES = f"""li AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN l_discount ELSE l_discount + 0.02::DOUBLE END AS l_discount,
l_returnflag, CASE WHEN l_partkey % 20 <> 0 THEN l_linestatus END AS l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey,
CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN 1 ELSE 0 END AS r FROM lineitem)"""
_KS_OF = (
    """long AS ({long}), cum AS (SELECT feature, sum(r) OVER w AS cr, sum(1 - r) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS n, sum(1 - r) OVER (PARTITION BY feature) AS m
FROM long WINDOW w AS (PARTITION BY feature ORDER BY value)),
stat AS (SELECT feature, max(abs(cr::DOUBLE / n - cc::DOUBLE / m)) AS d, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM cum GROUP BY feature),
z AS (SELECT *, sqrt(n::DOUBLE * m / (n + m)) * d AS z FROM stat),
ks AS (SELECT feature, d, n, m, CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(list_sum([(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * z * z) for k in range(1, 101)]), 0.0), 1.0) END AS p FROM z)"""
)


def _ks_of(columns):
    return _KS_OF.replace("{long}", " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, r FROM li" for c in columns))


_KS = _ks_of(NUMERIC)


def _chi_of(columns):
    return _CHI_OF.replace("{tail}", CHI_TAIL).replace("{cat}", " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce({c}, 'MISSING') AS value, r FROM li" for c in columns))


# In the logarithm, term by term. From d = 80 on, erfc(sqrt(d / 2)) is below 1e-17; before that its series needs fewer than 200 terms.
_CHI_OF = """cat AS ({cat}), cnt AS (SELECT feature, value, sum(r) AS o, count(*) - sum(r) AS c FROM cat GROUP BY feature, value),
tot AS (SELECT *, sum(o) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m FROM cnt),
chi AS (SELECT feature, sum((c - e) * (c - e) / e) AS d, count(*) - 1 AS dof, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m
FROM (SELECT *, greatest(o::DOUBLE / n * m, 1e-9) AS e FROM tot) GROUP BY feature),
chip AS (SELECT *, {tail} AS p FROM chi)"""
#: Upper tail of a chi-square with ``dof`` degrees at ``d``.
CHI_TAIL = """CASE WHEN dof % 2 = 0 THEN list_sum([exp(-d / 2 + i * ln(d / 2) - lgamma(i + 1)) for i in range(0, CAST(dof // 2 AS BIGINT))])
ELSE CASE WHEN d > 80 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-d / 2) * list_sum([exp((2 * i + 1) * ln(sqrt(d / 2)) + 2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) for i in range(0, 200)]) END
 + coalesce(list_sum([exp(-d / 2 + (i - 0.5) * ln(d / 2) - lgamma(i + 0.5)) for i in range(1, CAST((dof - 1) // 2 AS BIGINT) + 1)]), 0) END"""
_CHI = _chi_of(CATEGORICAL)
_KS_ROWS = """SELECT feature, 'numeric' AS feature_type, 'ks' AS metric_type, round(d, 6) AS score, round(p, 6) AS p_value, CASE WHEN n * m <= 1000000 THEN 'exact' ELSE 'large_sample' END AS p_method, 0.1::DOUBLE AS threshold, p < 0.01 AND d > 0.1 AS drift_detected, n AS reference_n, m AS current_n, '' AS reason FROM ks"""
_CHI_ROWS = """SELECT feature, 'categorical' AS feature_type, 'chisquare' AS metric_type, round(d, 6) AS score, round(p, 6) AS p_value, 'large_sample' AS p_method, 0.01::DOUBLE AS threshold, p < 0.01 AS drift_detected, n AS reference_n, m AS current_n, '' AS reason FROM chip"""


@query("ks_drift", f"WITH {_HALVES}, {_KS} {_KS_ROWS}")
def ks_drift(spark, sf):
    return rounded(drift.numeric_drift(drift.both_sides(*_halves(spark, sf), NUMERIC), NUMERIC))


# The whole lattice, place by place: what is left inside at its end. Beyond a million places the large-sample series of ``ks``.
_KS_SMALL = f"""WITH RECURSIVE li AS (SELECT s_acctbal, CASE WHEN s_nationkey < 12 THEN s_acctbal ELSE s_acctbal + 900 END AS shifted, CASE WHEN s_nationkey < 12 THEN 1 ELSE 0 END AS r FROM supplier),
{_ks_of(['s_acctbal', 'shifted'])},
lat AS (SELECT feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(round(d * n * m) AS BIGINT) AS gap FROM stat WHERE n * m <= 1000000 AND d > 0),
walk AS (SELECT feature, n, m, gap, 0::BIGINT AS t, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for i in range(0, n + 1)] AS p FROM lat
UNION ALL SELECT feature, n, m, gap, t + 1, [CASE WHEN t + 1 < i OR t + 1 - i > m OR abs(i * m - (t + 1 - i) * n) >= gap THEN 0.0::DOUBLE
ELSE (CASE WHEN i > 0 THEN p[i] * (n - i + 1) ELSE 0.0::DOUBLE END + p[i + 1] * (m - t + i)) / (n + m - t) END for i in range(0, n + 1)] FROM walk WHERE t < n + m),
walked AS (SELECT feature, 1 - p[n + 1] AS exact_p FROM walk WHERE t = n + m)
SELECT feature, round(d, 6) AS score, round(CASE WHEN n * m <= 1000000 THEN coalesce(exact_p, 1) ELSE p END, 6) AS p_value, CASE WHEN n * m <= 1000000 THEN 'exact' ELSE 'large_sample' END AS p_method,
n AS reference_n, m AS current_n FROM ks LEFT JOIN walked USING (feature)"""


@query("ks_small_samples", _KS_SMALL)
def ks_small_samples(spark, sf):
    """Balances of suppliers in two groups of nations, as they are and shifted: samples small enough for an exact p-value."""
    rows = B.table(spark, sf, "supplier")
    first = F.col("s_nationkey") < 12
    rows = rows.select("s_nationkey", "s_acctbal", F.when(first, F.col("s_acctbal")).otherwise(F.col("s_acctbal") + 900).alias("shifted"))
    names = ["s_acctbal", "shifted"]
    report = drift.numeric_drift(drift.both_sides(rows.where(first), rows.where(~first), names), names, DriftSettings(min_samples=1))
    return rounded(report.select("feature", "score", "p_value", "p_method", "reference_n", "current_n"))


@query("chi2_drift", f"WITH {_HALVES}, {_CHI} {_CHI_ROWS}")
def chi2_drift(spark, sf):
    return rounded(drift.categorical_drift(drift.both_sides(*_halves(spark, sf), CATEGORICAL), CATEGORICAL))


@query("chi2_many_categories", f"WITH {_HALVES}, {_chi_of(['l_partkey'])} {_CHI_ROWS}")
def chi2_many_categories(spark, sf):
    """A category with about as many values as the table has parts."""
    return rounded(drift.categorical_drift(drift.both_sides(*_halves(spark, sf), ["l_partkey"]), ["l_partkey"]))


@query(
    "drift_history",
    f"""WITH {_HALVES}, {_KS}, {_CHI}, report AS (SELECT feature, p < 0.01 AND d > 0.1 AS drifted FROM ks UNION ALL SELECT feature, p < 0.01 FROM chip)
    SELECT feature, check_day, drifted AS drift_detected FROM report, (SELECT unnest(['2002-01-01', '2002-01-02']) AS check_day)""",
)
def drift_history(spark, sf):
    """The drift job, run on two days: what it has appended to its history."""
    history = work_dir(spark, "drift-history")
    for day in ("2002-01-01", "2002-01-02"):
        jobs.drift_job(*_halves(spark, sf), NUMERIC, CATEGORICAL, history, F.lit(day).cast("timestamp"))
    return read_history(spark, history).select("feature", F.date_format("timestamp", "yyyy-MM-dd").alias("check_day"), "drift_detected")


@query(
    "drift_report",
    f"""WITH {_HALVES}, {_KS}, {_CHI}, report AS (SELECT feature, p < 0.01 AND d > 0.1 AS drifted FROM ks UNION ALL SELECT feature, p < 0.01 FROM chip)
    SELECT count(*) AS checked_features, count(*) FILTER (drifted) AS drifted_features, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drifted), '') AS drifted_feature_names, bool_or(drifted) AS drift_detected FROM report""",
)
def drift_report(spark, sf):
    summary = drift.drift_summary(drift.drift_report(*_halves(spark, sf), NUMERIC, CATEGORICAL))
    return summary.withColumn("drifted_feature_names", F.array_join("drifted_feature_names", ","))


# --- quality -----------------------------------------------------------------------------------------------

_CHECKED = ["customerID", "gender", "tenure", "Churn", "TotalCharges"]


@query(
    "missing_rates",
    sql_over(
        "contract_rows",
        " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(CASE WHEN "{c}" IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_rate FROM contract_rows""" for c in _CHECKED),
    ),
)
def missing_rates(spark, sf):
    return rounded(quality.missing_rates(B.contract_rows(spark, sf), _CHECKED))


_FEATURES = ["lang", "source"]
_UNSEEN = """vals AS (SELECT DISTINCT 'lang' AS feature, lang AS value, lang = 'en' AS known FROM documents WHERE lang IS NOT NULL
UNION SELECT DISTINCT 'source', source || CASE WHEN lang <> 'en' AND doc_id % 50 = 0 THEN '-' || doc_id ELSE '' END, lang = 'en' FROM documents WHERE source IS NOT NULL),
unseen AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn FROM (SELECT DISTINCT feature, value FROM vals WHERE NOT known AND (feature, value) NOT IN (SELECT (feature, value) FROM vals WHERE known))),
summary AS (SELECT f.feature, count(value) AS unseen_category_count, coalesce(string_agg(value, ',' ORDER BY value) FILTER (rn <= 20), '') AS unseen_categories
FROM (SELECT unnest(['lang', 'source']) AS feature) f LEFT JOIN unseen USING (feature) GROUP BY f.feature)"""


def _documents(spark, sf):
    """English documents are the reference; some of the others carry a source of their own."""
    docs = B.table(spark, sf, "documents").select("doc_id", "lang", "source")
    current = docs.where("lang <> 'en'")
    own = F.when(F.col("doc_id") % 50 == 0, F.concat(F.col("source"), F.lit("-"), F.col("doc_id"))).otherwise(F.col("source"))
    return docs.where("lang = 'en'"), current.withColumn("source", own)


@query("unseen_categories", f"WITH {_UNSEEN} SELECT * FROM summary")
def unseen_categories(spark, sf):
    reference, current = _documents(spark, sf)
    return quality.unseen_categories(current, quality.category_reference(reference, _FEATURES), _FEATURES)


@query(
    "quality_status",
    f"""WITH {_UNSEEN}, counted AS (SELECT count(*) AS row_count, (max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END)
    + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END))::BIGINT AS columns_with_gaps FROM documents WHERE lang <> 'en'),
    found AS (SELECT counted.*, CAST((SELECT sum(unseen_category_count) FROM summary) AS BIGINT) AS unseen_values FROM counted)
    SELECT *, CASE WHEN row_count = 0 THEN 'empty' WHEN columns_with_gaps > 0 OR unseen_values > 0 THEN 'warning' ELSE 'ok' END AS quality_status FROM found""",
)
def quality_status(spark, sf):
    reference, current = _documents(spark, sf)
    return quality.quality_status(current, quality.category_reference(reference, _FEATURES), _FEATURES)


@query(
    "runtime_quality",
    sql_over(
        "customers contract_rows",
        """SELECT batch_id, count(*) AS row_count, CAST(max(CASE WHEN "customerID" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS columns_with_gaps,
        count(DISTINCT CASE WHEN gender NOT IN (SELECT gender FROM customers) THEN gender END) + count(DISTINCT CASE WHEN "Contract" NOT IN (SELECT "Contract" FROM customers) THEN "Contract" END) AS unseen_values,
        CASE WHEN max(CASE WHEN "customerID" IS NULL THEN 1 ELSE 0 END) > 0 OR max(CASE WHEN gender NOT IN (SELECT gender FROM customers) OR "Contract" NOT IN (SELECT "Contract" FROM customers) THEN 1 ELSE 0 END) > 0 THEN 'warning' ELSE 'ok' END AS quality_status
        FROM contract_rows GROUP BY batch_id""",
    ),
)
def runtime_quality(spark, sf):
    """Quality of each request batch against the reference categories."""
    names = ["gender", "Contract"]
    known = quality.category_reference(B.customers(spark, sf), names)
    return quality.quality_by_batch(B.contract_rows(spark, sf), known, names, "batch_id", ["customerID", "gender", "tenure", "Contract"])


# --- features ----------------------------------------------------------------------------------------------



@query(
    "one_hot",
    sql_over(
        "customers",
        """SELECT tenure, round(coalesce(TRY_CAST("TotalCharges" AS DOUBLE), 0), 2) AS totalcharges, "Contract" = 'One year' AS "contract_One year", "Contract" = 'Two year' AS "contract_Two year",
        "InternetService" = 'Fiber optic' AS "internetservice_Fiber optic", "InternetService" = 'No' AS internetservice_No, gender = 'Male' AS gender_Male FROM customers""",
    ),
)
def one_hot(spark, sf):
    from holdfast.config import FeatureSettings

    settings = FeatureSettings(categorical_columns=("contract", "internetservice", "gender"), drop_columns=("customerid",))
    raw = B.customers(spark, sf).select("customerID", "tenure", "TotalCharges", "Contract", "InternetService", "gender")
    return rounded(features.build_features(raw, settings), totalcharges=2)


_WIDE = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "wide_one_hot",
    f"""WITH long AS ({" UNION ALL ".join(f"SELECT o_orderkey, {k} AS k, CAST({c} AS VARCHAR) AS v, o_orderdate < TIMESTAMP '{CUT}' AS fitted FROM orders" for k, c in enumerate(_WIDE))}),
codes AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS code FROM (SELECT DISTINCT k, v FROM long WHERE fitted AND v IS NOT NULL)),
widths AS (SELECT k, max(code) AS w FROM codes GROUP BY k), starts AS (SELECT k, sum(w) OVER (ORDER BY k) - w AS start FROM widths)
SELECT o_orderkey, coalesce(string_agg(CAST(CAST(start + code - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (code > 0), '') AS slots, (SELECT CAST(sum(w) AS BIGINT) FROM widths) AS n_columns
FROM long LEFT JOIN codes USING (k, v) LEFT JOIN starts USING (k) GROUP BY o_orderkey""",
)
def wide_one_hot(spark, sf):
    """A level for each customer, fitted on earlier orders: later orders may hold customers without a slot."""
    orders = B.table(spark, sf, "orders")
    model = wide.fit_wide(orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")), _WIDE)
    coded = wide.encode_slots(orders.select("o_orderkey", *_WIDE), model)
    return coded.select("o_orderkey", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), F.lit(model.size()).cast("bigint").alias("n_columns"))


@query(
    "standardize",
    """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 5) AS o_totalprice FROM orders""",
)
def standardize(spark, sf):
    (scaled,) = features.standardize(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return rounded(scaled, 5)


@query(
    "mean_fill",
    sql_over(
        "customers",
        """SELECT "customerID", round(coalesce(t, avg(t) OVER ()), 3) AS "TotalCharges", CAST(count(*) FILTER (t IS NULL) OVER () AS BIGINT) AS blanks FROM (
        SELECT "customerID", TRY_CAST("TotalCharges" AS DOUBLE) AS t FROM customers WHERE tenure <> 0)""",
    ),
)
def mean_fill(spark, sf):
    from holdfast.functions.scalars import to_number

    rows = B.customers(spark, sf).where("tenure <> 0").select("customerID", to_number(F.col("TotalCharges")).alias("TotalCharges"))
    blanks = rows.agg(F.count_if(F.col("TotalCharges").isNull()).alias("blanks"))
    return rounded(features.fill_with_mean(rows, ["TotalCharges"]).join(F.broadcast(blanks)), 3)
