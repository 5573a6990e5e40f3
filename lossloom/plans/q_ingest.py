"""Queries over delimited text, Bronze, Silver and the data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossloom.operators import features, quality, silver, targets
from lossloom.plans.registry import query
from lossloom.plans.sqlchain import cte, mdiff
from lossloom.sources import sinks, text
from lossloom.sources.rawdemo import HAS_PERFORMANCE, line_sql
from lossloom.sources.schemas import layout_for
from lossloom.sources.store import cut_lineage, shared_root

ORIG, PERF = layout_for("origination", 1995), layout_for("performance", 1995)

cte("x_raw_orig", f"SELECT {line_sql('origination')} AS value, l.vintage_year FROM x_loans l")
cte("x_raw_perf", f"""
SELECT {line_sql('performance')} AS value, l.vintage_year FROM x_perf p JOIN x_loans l ON l.loan_id = p.loan_id WHERE {HAS_PERFORMANCE}""")
for _name, _lay, _raw in (("x_bronze_orig", ORIG, "x_raw_orig"), ("x_bronze_perf", PERF, "x_raw_perf")):
    _cols = ", ".join(f"f[{i + 1}] AS {n}" if ty == "string" else
                      f"try_cast(f[{i + 1}] AS {ty.upper()}) AS {n}" for i, (n, ty) in enumerate(_lay.columns))
    cte(_name, f"SELECT {_cols}, vintage_year AS _source_year FROM (SELECT string_split(value, '|') AS f, vintage_year "
               f"FROM {_raw}) WHERE len(f) = {len(_lay.columns)}")


def status_sql(f: str) -> str:
    rule = silver.RULES[f]
    arms = ""
    for code, meaning in rule.codes:
        if rule.structural_before:
            arms += f" WHEN {f}::VARCHAR = '{code}' AND _source_year < {rule.structural_before} THEN 'STRUCTURAL_NOT_AVAILABLE'"
        arms += f" WHEN {f}::VARCHAR = '{code}' THEN '{meaning}'"
    return f"CASE WHEN {f} IS NULL THEN 'NOT_APPLICABLE'{arms} ELSE 'VALID_VALUE' END"


def clean_sql(f: str) -> str:
    codes = ", ".join(f"'{c}'" for c, _ in silver.RULES[f].codes)
    return f"CASE WHEN {f}::VARCHAR NOT IN ({codes}) THEN {f} END"


def month_sql(f: str) -> str:
    return f"CASE WHEN length({f}) = 6 THEN try_strptime({f} || '01', '%Y%m%d')::DATE END"


_ofields, _pfields = silver.ORIGINATION_FIELDS, silver.PERFORMANCE_FIELDS
ORIGIN_MONTH = """CASE WHEN regexp_matches(loan_id, '^[A-Z][0-9]{2}Q[1-4]') THEN
    make_date(2000 + substr(loan_id, 2, 2)::INT, substr(loan_id, 5, 1)::INT * 3 - 2, 1) END"""
DQ_MONTHS = "CASE WHEN regexp_full_match(current_loan_delinquency_status, '[0-9]+') THEN current_loan_delinquency_status::BIGINT END"
DQ_TYPE = """CASE WHEN regexp_full_match(current_loan_delinquency_status, '[0-9]+') THEN 'NUMERIC_DELINQUENCY_STATUS'
    WHEN current_loan_delinquency_status = 'RA' THEN 'REO_ACQUISITION'
    WHEN current_loan_delinquency_status = 'XX' THEN 'INITIAL_OR_UNKNOWN_STATUS'
    WHEN coalesce(current_loan_delinquency_status, '') = '' THEN 'MISSING_STATUS' ELSE 'UNKNOWN_SPECIAL_STATUS' END"""
cte("x_silver_orig", "SELECT * REPLACE (" + ", ".join(f"{clean_sql(f)} AS {f}" for f in _ofields)
    + f", {month_sql('first_payment_date')} AS first_payment_date, {month_sql('maturity_date')} AS maturity_date), "
    + ", ".join(f"{status_sql(f)} AS {f}_status" for f in _ofields) + f", {ORIGIN_MONTH} AS origination_month FROM x_bronze_orig")
_pdates = ("period", "defect_settlement_date", "zero_balance_effective_date", "due_date_of_last_paid_installment")
cte("x_silver_perf", "SELECT * REPLACE (" + ", ".join(f"{clean_sql(f)} AS {f}" for f in _pfields) + ", "
    + ", ".join(f"{month_sql(d)} AS {d}" for d in _pdates) + "), "
    + ", ".join(f"{status_sql(f)} AS {f}_status" for f in _pfields)
    + f", {DQ_MONTHS} AS delinquency_months, {DQ_TYPE} AS delinquency_status_type FROM x_bronze_perf")


def sink_path(t, name: str) -> str:
    import hashlib
    key = hashlib.md5(t.sf_dir.encode()).hexdigest()[:10]
    return f"{shared_root(t.spark)}/lossloom/{t.spark.sparkContext.applicationId}/{key}/sink_{name}"


@query("io01_positional_read", "SELECT vintage_year, " + ", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(PERF.names)) +
       f" FROM (SELECT string_split(value, '|') AS f, vintage_year FROM x_raw_perf) WHERE len(f) = {len(PERF.names)}",
       ints="vintage_year")
def _(t):
    return text.positional(t("raw_perf"), PERF, ("vintage_year",))


@query("io02_width_validation", f"""
SELECT vintage_year AS year, count(*) AS rows, count(*) FILTER (len(string_split(value, '|')) <> {len(PERF.names)}) AS bad_rows
FROM x_raw_perf GROUP BY ALL""", ints="year")
def _(t):
    return text.width_report(t("raw_perf"), PERF)


@query("io02_quarantine", f"""
SELECT 'origination' AS dataset, count(*) AS lines, count(*) FILTER (n = {len(ORIG.names)}) AS bronze_rows,
       count(*) FILTER (n <> {len(ORIG.names)}) AS quarantined_rows, 0 AS unaccounted_rows FROM (SELECT len(string_split(value, '|')) AS n FROM x_raw_orig)
UNION ALL SELECT 'performance', count(*), count(*) FILTER (n = {len(PERF.names)}), count(*) FILTER (n <> {len(PERF.names)}), 0
FROM (SELECT len(string_split(value, '|')) AS n FROM x_raw_perf)""", ints="lines bronze_rows quarantined_rows unaccounted_rows")
def _(t):
    """Every line is either a Bronze row or in quarantine."""
    parts = [text.reconciliation(t(f"raw_{k}"), t(f"bronze_{k}"), t(f"quarantine_{k}")).select(F.lit(d).alias("dataset"), "*")
             for k, d in (("orig", "origination"), ("perf", "performance"))]
    return parts[0].unionByName(parts[1])


@query("io03_layout_by_year", """
SELECT vintage_year AS year, 'origination' AS dataset, 'v1' AS version, 31 AS columns, count(*) AS rows FROM x_raw_orig GROUP BY ALL
UNION ALL SELECT vintage_year, 'performance', 'v1', 35, count(*) FROM x_raw_perf GROUP BY ALL""", ints="year columns")
def _(t):
    """Rows per vintage with the layout chosen for it; years are the partition folders, a handful of values."""
    out = None
    for name, dataset in (("raw_orig", "origination"), ("raw_perf", "performance")):
        per_year = t(name).groupBy(F.col("vintage_year").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
        years = [r[0] for r in per_year.select("year").collect()]
        chosen = t.spark.createDataFrame(
            [(y, dataset, layout_for(dataset, y).version, len(layout_for(dataset, y).columns)) for y in years],
            "year int, dataset string, version string, columns int")
        part = per_year.join(chosen, "year")
        out = part if out is None else out.unionByName(part)
    return out


@query("io04_safe_types", """
SELECT loan_id, period, current_actual_upb, loan_age, current_interest_rate, estimated_loan_to_value, actual_loss,
       zero_balance_removal_upb FROM x_bronze_perf""", r6="current_actual_upb current_interest_rate actual_loss zero_balance_removal_upb")
def _(t):
    return t("bronze_perf").select("loan_id", "period", "current_actual_upb", "loan_age", "current_interest_rate",
                                   "estimated_loan_to_value", "actual_loss", "zero_balance_removal_upb")


@query("io05_lineage", """
SELECT vintage_year AS _source_year, 'vintage_year=' || vintage_year AS _source_zip, 'v1' AS _schema_version,
       count(*) AS rows, count(*) AS numbered_rows
FROM x_raw_perf GROUP BY ALL""", ints="_source_year numbered_rows")
def _(t):
    """Row numbers run 1..n in every file, so the file maxima add up to the rows."""
    per_file = text.with_row_numbers(t("lines_perf")).groupBy("vintage_year", "_source_member").agg(
        F.count(F.lit(1)).alias("n"), F.max("_source_row_number").alias("top"))
    return per_file.groupBy(F.col("vintage_year").alias("_source_year"),
                            F.regexp_extract("_source_member", r"([^/]+)/[^/]+$", 1).alias("_source_zip"),
                            F.lit(PERF.version).alias("_schema_version")).agg(
        F.sum("n").alias("rows"), F.sum("top").alias("numbered_rows"))


@query("io06_partitioned_sink", "SELECT vintage_year, count(*) AS rows, sum(current_actual_upb) AS upb FROM x_mart GROUP BY ALL",
       ints="vintage_year", r2="upb")
def _(t):
    path = sink_path(t, "mart")
    df = t("mart").select("loan_id", "as_of_date", "current_actual_upb", "vintage_year")
    sinks.write_partitions(df, path, force=True)
    sinks.write_partitions(df, path)  # every partition is present now, so this adds nothing
    return t.spark.read.parquet(path).groupBy("vintage_year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("current_actual_upb").alias("upb"))


@query("io07_parquet_scan", "SELECT year(o_orderdate) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS loans FROM orders GROUP BY ALL", ints="year")
def _(t):
    t.raw("orders").createOrReplaceTempView("lossloom_orders")
    return t.spark.sql("SELECT year(o_orderdate) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS loans "
                       "FROM lossloom_orders GROUP BY year(o_orderdate)")


@query("io08_csv_report", """
SELECT year(as_of_date) AS observation_year, count(*) AS observations,
       count(*) FILTER (eligible_for_12m_pd) AS eligible_observations
FROM x_targets GROUP BY ALL""", ints="observation_year")
def _(t):
    report = targets.observability(t("targets"))
    path = sink_path(t, "observability_csv")
    sinks.write_report(report, path)
    return sinks.read_report(t.spark, path, report.schema).select("observation_year", "observations", "eligible_observations")


@query("io09_year_discovery", "SELECT DISTINCT vintage_year, true AS present FROM x_mart", ints="vintage_year")
def _(t):
    path = sink_path(t, "years")
    df = t("mart").select("loan_id", "as_of_date", "vintage_year")
    sinks.write_partitions(df, path, force=True)
    gone = sinks.missing_years(t.spark, path, df).select("vintage_year", F.lit(False).alias("present"))
    return sinks.existing_years(t.spark, path).select("vintage_year", F.lit(True).alias("present")).unionByName(gone)


@query("io10_round_trip", "SELECT vintage_year, count(*) AS written_rows, count(*) AS stored_rows FROM x_targets GROUP BY ALL",
       ints="vintage_year")
def _(t):
    path = sink_path(t, "targets")
    df = t("targets").select("loan_id", "as_of_date", "event_type", "vintage_year")
    sinks.write_partitions(df, path, force=True)
    return sinks.round_trip(df, path)


STATUS_COLS = [f"{f}_status" for f in silver.RULES]


@query("sv01_missing_status", "SELECT loan_id, " + ", ".join(f"{f}_status" for f in _ofields) + " FROM x_silver_orig")
def _(t):
    return t("silver_orig").select("loan_id", *[f"{f}_status" for f in _ofields])


@query("sv02_nullify_sentinels", "SELECT loan_id, " + ", ".join(_ofields) + " FROM x_silver_orig",
       ints="credit_score vantagescore_4 original_debt_to_income_ratio original_loan_to_value original_combined_loan_to_value")
def _(t):
    return t("silver_orig").select("loan_id", *_ofields)


@query("sv03_month_dates", "SELECT loan_id, period, zero_balance_effective_date, due_date_of_last_paid_installment FROM x_silver_perf")
def _(t):
    return t("silver_perf").select("loan_id", "period", "zero_balance_effective_date", "due_date_of_last_paid_installment")


@query("sv04_delinquency_months", "SELECT loan_id, period, delinquency_months FROM x_silver_perf", ints="delinquency_months")
def _(t):
    return t("silver_perf").select("loan_id", "period", "delinquency_months")


@query("sv05_delinquency_type", "SELECT loan_id, period, delinquency_status_type FROM x_silver_perf")
def _(t):
    return t("silver_perf").select("loan_id", "period", "delinquency_status_type")


@query("sv06_origination_month", "SELECT loan_id, origination_month FROM x_silver_orig")
def _(t):
    return t("silver_orig").select("loan_id", "origination_month")


SV7 = ["loan_id", *_ofields, *[f"{f}_status" for f in _ofields], "first_payment_date", "maturity_date", "origination_month",
       "original_upb", "original_interest_rate"]
SV8 = ["loan_id", *_pfields, *[f"{f}_status" for f in _pfields], *_pdates, "delinquency_months", "delinquency_status_type",
       "current_actual_upb", "current_interest_rate"]


@query("sv07_silver_origination", f"SELECT {', '.join(SV7)} FROM x_silver_orig", r6="original_upb original_interest_rate")
def _(t):
    return t("silver_orig").select(*SV7)


@query("sv08_silver_performance", f"SELECT {', '.join(SV8)} FROM x_silver_perf", r6="current_actual_upb current_interest_rate")
def _(t):
    return t("silver_perf").select(*SV8)


@query("dq01_bronze_metrics", """
SELECT _source_year AS year, 'origination' AS dataset, count(*) AS row_count,
       count(DISTINCT loan_id) + max((loan_id IS NULL)::INT) AS unique_loan_count,
       count(*) - count(DISTINCT loan_id) - max((loan_id IS NULL)::INT) AS duplicate_loan_ids,
       NULL::BIGINT AS unique_loan_period_count, NULL::BIGINT AS duplicate_loan_periods,
       count(*) FILTER (coalesce(loan_id, '') = '') AS null_loan_ids, NULL::BIGINT AS null_periods,
       NULL::VARCHAR AS min_period, NULL::VARCHAR AS max_period
FROM x_bronze_orig GROUP BY ALL
UNION ALL
SELECT _source_year, 'performance', count(*), count(DISTINCT loan_id) + max((loan_id IS NULL)::INT), NULL,
       count(DISTINCT (loan_id, period)), count(*) - count(DISTINCT (loan_id, period)),
       count(*) FILTER (coalesce(loan_id, '') = ''), count(*) FILTER (coalesce(period, '') = ''), min(period), max(period)
FROM x_bronze_perf GROUP BY ALL""",
       ints="year unique_loan_count duplicate_loan_ids unique_loan_period_count duplicate_loan_periods null_periods")
def _(t):
    return quality.bronze_metrics(t("bronze_orig"), t("bronze_perf"))


@query("dq02_referential", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT loan_id FROM x_bronze_perf) p
        WHERE NOT EXISTS (SELECT 1 FROM x_bronze_orig o WHERE o.loan_id = p.loan_id)) AS performance_unmatched,
       (SELECT count(*) FROM (SELECT DISTINCT loan_id FROM x_bronze_orig) o
        WHERE NOT EXISTS (SELECT 1 FROM x_bronze_perf p WHERE p.loan_id = o.loan_id)) AS origination_unmatched""")
def _(t):
    return quality.referential(t("bronze_orig"), t("bronze_perf"))


def checks_sql(dataset: str, table: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT _source_year AS year, '{dataset}' AS dataset, '{s}' AS severity, '{c}' AS check, ({x})::BIGINT AS value "
        f"FROM {table} GROUP BY _source_year" for s, c, x in rows)


def filt(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


@query("dq03_origination_checks", checks_sql("origination", "x_silver_orig", [
    ("INFO", "row_count", "count(*)"), ("INFO", "unique_loan_count", "count(DISTINCT loan_id)"),
    ("ERROR", "duplicate_loan_ids", "count(*) - count(DISTINCT loan_id)"),
    ("ERROR", "null_loan_ids", filt("coalesce(loan_id, '') = ''")),
    ("WARNING", "invalid_original_upb", filt("original_upb <= 0")),
    ("WARNING", "invalid_credit_score", filt("credit_score NOT BETWEEN 300 AND 850")),
    ("WARNING", "invalid_dti", filt("original_debt_to_income_ratio NOT BETWEEN 1 AND 65")),
    ("WARNING", "invalid_ltv", filt("original_loan_to_value NOT BETWEEN 1 AND 998")),
    ("WARNING", "invalid_cltv", filt("original_combined_loan_to_value NOT BETWEEN 1 AND 998")),
    ("WARNING", "invalid_first_payment_date", filt("first_payment_date IS NULL")),
    ("WARNING", "first_payment_before_origination", filt("first_payment_date < origination_month")),
    ("WARNING", "maturity_before_first_payment", filt("maturity_date < first_payment_date"))]), ints="year")
def _(t):
    return quality.origination_checks(t("silver_orig"))


@query("dq04_performance_checks", checks_sql("performance", "x_silver_perf", [
    ("INFO", "row_count", "count(*)"), ("INFO", "unique_loan_count", "count(DISTINCT loan_id)"),
    ("ERROR", "duplicate_loan_periods", "count(*) - count(DISTINCT (loan_id, period))"),
    ("ERROR", "null_loan_ids", filt("coalesce(loan_id, '') = ''")), ("ERROR", "null_period", filt("period IS NULL")),
    ("WARNING", "negative_current_upb", filt("current_actual_upb < 0")),
    ("WARNING", "invalid_current_interest_rate", filt("current_interest_rate NOT BETWEEN 0 AND 30")),
    ("WARNING", "invalid_remaining_maturity", filt("remaining_months_to_legal_maturity < 0")),
    ("WARNING", "unknown_delinquency_status", filt("delinquency_status_type = 'UNKNOWN_SPECIAL_STATUS'"))]), ints="year")
def _(t):
    return quality.performance_checks(t("silver_perf"))


def norm_sql(dataset: str, table: str, fields) -> str:
    return " UNION ALL ".join(f"""
SELECT _source_year AS year, '{dataset}' AS dataset, '{f}' AS field, count(*) AS source_rows,
       count(*) FILTER ({f}_status = 'VALID_VALUE') AS valid_values,
       count(*) FILTER ({f}_status <> 'VALID_VALUE') AS normalized_nulls,
       count(*) FILTER ({f}_status <> 'VALID_VALUE') AS sentinel_values,
       count(*) FILTER ({f}_status = 'INVALID') AS invalid_values, 0::BIGINT AS conversion_failures,
       count(*) FILTER ({f}_status = 'STRUCTURAL_NOT_AVAILABLE') AS structural_missing
FROM {table} GROUP BY _source_year""" for f in fields)


@query("dq05_normalization_summary", norm_sql("origination", "x_silver_orig", _ofields) + " UNION ALL "
       + norm_sql("performance", "x_silver_perf", _pfields), ints="year")
def _(t):
    return quality.normalization_summary(t("silver_orig"), "origination").unionByName(
        quality.normalization_summary(t("silver_perf"), "performance"))


def avail_sql(dataset: str, table: str, fields) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, _source_year AS year, '{f}' AS field, count(*) AS row_count, count({f}) AS non_null_count, "
        f"count({f}) / count(*) AS non_null_pct, count(DISTINCT {f}) AS distinct_count FROM {table} GROUP BY _source_year"
        for f in fields if not f.endswith("_status"))


@query("dq06_availability", avail_sql("origination", "x_silver_orig", [*ORIG.names, "origination_month"]) + " UNION ALL "
       + avail_sql("performance", "x_silver_perf", [*PERF.names, "delinquency_months", "delinquency_status_type"]),
       ints="year row_count non_null_count", r6="non_null_pct")
def _(t):
    return quality.availability(t("silver_orig"), "origination", exact=True).unionByName(
        quality.availability(t("silver_perf"), "performance", exact=True))


def sketched_sql(dataset: str, table: str, fields) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, _source_year AS year, '{f}' AS field, count(*) AS row_count, count({f}) AS non_null_count, "
        f"count({f}) / count(*) AS non_null_pct, TRUE AS distinct_within_bound FROM {table} GROUP BY GROUPING SETS ((_source_year), ())"
        for f in fields if not f.endswith("_status"))


@query("dq06_availability_sketched", sketched_sql("origination", "x_silver_orig", [*ORIG.names, "origination_month"]) + " UNION ALL "
       + sketched_sql("performance", "x_silver_perf", [*PERF.names, "delinquency_months", "delinquency_status_type"]),
       ints="year row_count non_null_count", r6="non_null_pct")
def _(t):
    """Availability by year and, from the same stored sketches merged, over all years; its distinct counts lie within 5% of the exact ones."""
    out = None
    for k, dataset in (("orig", "origination"), ("perf", "performance")):
        # Both levels count from one table of the values; most fields of a row are empty and have none.
        values = cut_lineage(quality.field_values(t(f"silver_{k}")).where("v IS NOT NULL"), "field-values")
        for by_year in (True, False):
            near = quality.merged_availability(t(f"sketch_{k}"), dataset, by_year)
            exact = quality.distinct_counts(values, by_year).select(
                F.col("year").alias("_y"), F.col("field").alias("_f"), F.col("distinct_count").alias("_d"))
            d = F.coalesce("_d", F.lit(0))
            part = near.join(exact, F.col("year").eqNullSafe(F.col("_y")) & (F.col("field") == F.col("_f")), "left").select(
                *[c for c in near.columns if c != "distinct_count"], (F.abs(F.col("distinct_count") - d) <= 0.05 * d).alias("distinct_within_bound"))
            out = part if out is None else out.unionByName(part)
    return out


@query("dq07_temporal_gaps", f"""
WITH g AS (SELECT loan_id, {mdiff('lag(period) OVER (PARTITION BY loan_id ORDER BY period)', 'period')} AS gap FROM x_silver_perf)
SELECT 'loans_with_month_gaps' AS metric, count(DISTINCT loan_id) AS value FROM g WHERE gap > 1
UNION ALL SELECT 'total_missing_months', coalesce(sum(gap - 1), 0) FROM g WHERE gap > 1
UNION ALL SELECT 'max_gap_months', coalesce(max(gap - 1), 0) FROM g WHERE gap > 1""", ints="value")
def _(t):
    return quality.temporal_gaps(t("silver_perf"))


@query("dq08_without_performance", """
SELECT _source_year, loan_id, first_payment_date, maturity_date, origination_month, original_upb, seller_name, property_state,
       loan_purpose
FROM x_silver_orig o
WHERE NOT EXISTS (SELECT 1 FROM x_silver_perf p WHERE p._source_year = o._source_year AND p.loan_id = o.loan_id)""", ints="_source_year", r6="original_upb")
def _(t):
    return quality.without_performance(t("silver_orig"), t("silver_perf"))


@query("dq09_silver_summary", """
SELECT (SELECT count(*) FROM x_silver_orig) AS origination_rows,
       (SELECT count(DISTINCT loan_id) FROM x_silver_orig) AS origination_unique_loans, count(*) AS performance_rows,
       count(DISTINCT loan_id) AS performance_unique_loans, count(DISTINCT (loan_id, period)) AS performance_unique_loan_periods,
       min(period) AS min_period, max(period) AS max_period
FROM x_silver_perf""", ints="origination_rows performance_rows performance_unique_loan_periods")
def _(t):
    return quality.silver_summary(t("silver_orig"), t("silver_perf"))


_beh = features.features_for("behavioural_scoring")
_known = {f.name: f for f in features.REGISTRY}


@query("mt18_feature_registry", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{_known[n].availability}' AS availability, '{_known[n].leakage}' AS leakage_risk, "
    f"count({n}) AS non_null_count FROM x_analytical" for n in _beh))
def _(t):
    return features.usable_population(t("analytical"), "behavioural_scoring")


@query("mt18_feature_availability", """
SELECT 'ORIGINATION' AS availability, 6 AS n_features, count(original_credit_score) + count(original_dti) + count(original_ltv) + count(original_cltv)
       + count(original_upb) + count(original_interest_rate) AS non_null_count FROM x_analytical
UNION ALL SELECT 'CURRENT_PERIOD', 3, count(current_actual_upb) + count(delinquency_months) + count(current_upb_to_original_upb) FROM x_analytical
UNION ALL SELECT 'HISTORICAL_TO_DATE', 2, count(max_delinquency_months_to_date) + count(months_since_last_delinquency) FROM x_analytical
UNION ALL SELECT 'TERMINAL_EVENT', 3, count(actual_loss) + count(net_sale_proceeds) + count(total_expenses) FROM x_analytical
UNION ALL SELECT 'TECHNICAL', 1, 0""")
def _(t):
    return features.availability_summary(t("analytical"))
