"""Default states, forward-looking labels and default episodes.

History frames end at the current row, label frames start at the next one; nothing else crosses that line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.config import DefaultDefinition
from lossloom.functions.exprs import code_map, count_if, flag, month_diff, safe_div
from lossloom.operators.mart import by_loan, to_date

STATE_COLUMNS = ("loan_id", "vintage_year", "as_of_date", "month_index", "delinquency_months", "delinquency_status_raw",
                 "zero_balance_code", "zero_balance_effective_date", "has_reporting_gap_to_date")


def ahead() -> Window:
    return by_loan().rowsBetween(1, Window.unboundedFollowing)


def entry_exposure(upb: Column, prior_upb: Column) -> Column:
    """Balance at default entry; a closed row has zero balance, so the prior month stands in."""
    return F.coalesce(F.nullif(upb, F.lit(0.0)), prior_upb)


def entry_exposure_source(upb: Column, prior_upb: Column) -> Column:
    return (F.when(upb > 0, "current_actual_upb").when(prior_upb > 0, "prior_month_current_upb")
            .otherwise("unavailable"))


def row_state(month: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    """Observable default and exit state of each row, from that row alone."""
    raw = F.nullif(F.col("delinquency_status_raw"), F.lit(""))
    code = F.nullif(F.col("zero_balance_code"), F.lit(""))
    dq = F.col("delinquency_months")
    df = month.select(*STATE_COLUMNS).withColumns({"delinquency_status_raw": raw, "zero_balance_code": code})
    late = flag(dq >= cfg.delinquency_threshold_months)
    seized = flag(F.col("delinquency_status_raw").isin(*cfg.credit_event_statuses))
    loss_exit = flag(F.col("zero_balance_code").isin(*cfg.default_exits))
    reason = reduce(lambda acc, kv: acc.when(F.col("zero_balance_code") == kv[0], kv[1]), cfg.default_exits.items(),
                    F.when(seized, "REO_ACQUISITION"))
    reason = reason.when(late, f"DELINQUENCY_{cfg.delinquency_threshold_months}_PLUS")
    return df.withColumns({
        "default_due_to_delinquency": late,
        "default_due_to_credit_event": seized | loss_exit,
        "default_flag": late | seized | loss_exit,
        "default_reason": reason,
        "non_default_exit_flag": flag(F.col("zero_balance_code").isin(*cfg.other_exits)),
        "non_default_exit_reason": code_map("zero_balance_code", cfg.other_exits),
        "terminal_exit_flag": F.col("zero_balance_code").isNotNull(),
    })


def past_flags(state: DataFrame) -> DataFrame:
    return state.withColumns({
        "ever_default_to_date": F.max("default_flag").over(to_date()),
        "terminal_exit_to_date": F.max("terminal_exit_flag").over(to_date()),
    })


def future_events(state: DataFrame) -> DataFrame:
    """First default of the loan, next default, and next exit with its reason (one min over a struct, no self-join)."""
    whole = Window.partitionBy("loan_id")
    default_at = F.when(F.col("default_flag"), F.col("as_of_date"))
    exit_at = F.when(F.col("non_default_exit_flag"), F.struct("as_of_date", "non_default_exit_reason"))
    df = state.withColumns({
        "first_default_date": F.min(default_at).over(whole),
        "future_first_default_date": F.min(default_at).over(ahead()),
        "_exit": F.min(exit_at).over(ahead()),
    })
    return df.withColumns({
        "future_first_non_default_exit_date": F.col("_exit.as_of_date"),
        "future_first_non_default_exit_reason": F.col("_exit.non_default_exit_reason"),
    }).drop("_exit")


def competing_event(df: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    """First of default and exit; default wins a tie, neither means censored at the cutoff."""
    dflt, ext = F.col("future_first_default_date"), F.col("future_first_non_default_exit_date")
    default_first = dflt.isNotNull() & (ext.isNull() | (dflt <= ext))
    df = df.withColumn("_default_first", default_first)
    kind = (F.when(F.col("_default_first"), "DEFAULT")
            .when(ext.isNotNull(), F.col("future_first_non_default_exit_reason")).otherwise("CENSORED"))
    when = F.when(F.col("_default_first"), dflt).otherwise(ext)
    return df.withColumns({
        "event_type": kind,
        "months_until_event": month_diff("as_of_date", F.coalesce(when, F.lit(cfg.reporting_cutoff))),
    }).withColumns({
        "event_default": F.col("event_type") == "DEFAULT",
        "event_prepayment_or_exit": ~F.col("event_type").isin("DEFAULT", "CENSORED"),
        "event_censored": F.col("event_type") == "CENSORED",
    })


def twelve_month_label(df: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    """1 / 0 / null label; null for ineligible rows and for windows that end after the cutoff with no event inside."""
    eligible = ~F.col("ever_default_to_date") & ~F.col("terminal_exit_to_date")
    horizon = F.add_months("as_of_date", cfg.target_horizon_months)
    label = (F.when(~eligible, F.lit(None).cast("long"))
             .when(F.col("_default_first") & (F.col("future_first_default_date") <= horizon), F.lit(1))
             .when(horizon <= F.lit(cfg.reporting_cutoff), F.lit(0))
             .when(F.col("future_first_non_default_exit_date") <= horizon, F.lit(0)))
    return df.withColumns({
        "eligible_for_12m_pd": eligible, "eligible_for_lifetime_pd": eligible,
        "default_next_12m": label.cast("long"),
    }).withColumn("target_12m_observable", F.col("default_next_12m").isNotNull())


def lifetime_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "months_to_first_default": month_diff("as_of_date", "first_default_date"),
        "ever_default": F.col("first_default_date").isNotNull(),
        "months_to_default_from_observation": month_diff("as_of_date", "future_first_default_date"),
    })


TARGET_COLUMNS = (
    "loan_id", "vintage_year", "as_of_date", "month_index", "default_due_to_delinquency", "default_due_to_credit_event",
    "default_flag", "default_reason", "first_default_date", "months_to_first_default", "ever_default",
    "eligible_for_12m_pd", "eligible_for_lifetime_pd", "default_next_12m", "months_to_default_from_observation",
    "target_12m_observable", "event_default", "event_prepayment_or_exit", "event_censored", "months_until_event",
    "event_type", "future_first_non_default_exit_date", "future_first_non_default_exit_reason",
    "has_reporting_gap_to_date")


def targets(state: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    df = future_events(past_flags(state))
    df = lifetime_fields(twelve_month_label(competing_event(df, cfg), cfg))
    return df.select(*TARGET_COLUMNS)


def clean_streaks(state: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    """Length of the running month-by-month spell without default.

    A default, the first row and a reporting gap each start a new spell. Under "reference" counting the default row is
    the first member of the spell it starts, so the first clean month after it already counts as 2.
    """
    gap = F.col("month_index") - F.lag("month_index").over(by_loan())
    df = state.withColumn("streak_break", F.when(F.col("default_flag") | gap.isNull() | (gap != 1), 1).otherwise(0))
    df = df.withColumn("streak_group", F.sum("streak_break").over(to_date()))
    inside = Window.partitionBy("loan_id", "streak_group").orderBy("month_index")
    if cfg.cure_counting == "reference":
        length = F.row_number().over(inside)
    elif cfg.cure_counting == "strict":
        clean = F.when(F.col("default_flag"), 0).otherwise(1)
        length = F.sum(clean).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown cure counting: {cfg.cure_counting}")
    return df.withColumn("consecutive_non_default_months",
                         F.when(F.col("default_flag"), 0).otherwise(length).cast("long"))


def cure_candidates(streaks: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    ok = F.col("consecutive_non_default_months") >= cfg.probation_months
    return streaks.withColumn("cure_date_candidate", F.min(F.when(ok, F.col("as_of_date"))).over(ahead()))


def default_rows(candidates: DataFrame) -> DataFrame:
    """Default rows with the entry marker: the first one, or one preceded by a completed cure.

    Cure candidates never decrease over time, so the previous default row's candidate decides.
    """
    prev = F.lag("cure_date_candidate").over(by_loan())
    first = F.row_number().over(by_loan()) == 1
    return candidates.where("default_flag").withColumn("is_episode_entry", first | flag(prev < F.col("as_of_date")))


def default_events(state: DataFrame, cfg: DefaultDefinition) -> DataFrame:
    entries = default_rows(cure_candidates(clean_streaks(state, cfg), cfg)).where("is_episode_entry")
    number = F.row_number().over(by_loan()).cast("long")
    return entries.withColumn("default_episode_id", number).select(
        "loan_id", "vintage_year", "default_episode_id", F.col("as_of_date").alias("default_entry_date"),
        F.col("cure_date_candidate").alias("cure_date"), "default_reason", "default_due_to_delinquency",
        "default_due_to_credit_event", (F.col("default_episode_id") > 1).alias("redefault_flag"),
        F.when(F.col("default_episode_id") > 1, F.col("as_of_date")).alias("redefault_date"))


def default_summary(tg: DataFrame, events: DataFrame) -> DataFrame:
    """Counts by metric, year, reason and event: one pass over targets and one over events.

    Each row is tagged with the metrics it belongs to; loan-distinct metrics are reduced to one row per loan first,
    which also keeps a popular year from collecting a distinct set in one task.
    """
    none = F.lit(None).cast("string")

    def tag(cond: Column, metric: str, on, reason: Column, event: Column) -> Column:
        return F.when(cond, F.struct(F.lit(metric).alias("metric"), F.year(on).cast("string").alias("year"),
                                     reason.alias("reason"), event.alias("event_type")))

    def spread(df: DataFrame, tags: list[Column], *keys: str) -> DataFrame:
        return (df.select(*keys, F.explode(F.array(*tags)).alias("t")).where("t is not null")
                .select(*keys, "t.*"))

    rows = spread(tg, [
        tag(F.lit(True), "observations", "as_of_date", none, none),
        tag(F.col("eligible_for_12m_pd"), "eligible_12m_observations", "as_of_date", none, none),
        tag(F.col("target_12m_observable"), "observable_12m_targets", "as_of_date", none, none),
        tag(F.col("eligible_for_12m_pd") & ~F.col("target_12m_observable"), "censored_12m_targets", "as_of_date", none, none),
    ])
    per_loan = spread(tg, [
        tag(F.col("as_of_date") == F.col("first_default_date"), "defaults", "first_default_date",
            F.col("default_reason"), none),
        tag(F.col("event_prepayment_or_exit"), "non_default_exits", "future_first_non_default_exit_date",
            F.col("future_first_non_default_exit_reason"), F.col("event_type")),
    ], "loan_id").distinct().drop("loan_id")
    ep = spread(events, [
        tag(F.col("cure_date").isNotNull(), "cures", "cure_date", F.col("default_reason"), none),
        tag(F.col("redefault_flag"), "redefaults", "redefault_date", F.col("default_reason"), none),
    ])
    keys = ["metric", "year", "reason", "event_type"]
    return rows.unionByName(per_loan).unionByName(ep).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def observability(tg: DataFrame) -> DataFrame:
    y = F.col("default_next_12m")
    return tg.groupBy(F.year("as_of_date").alias("observation_year")).agg(
        F.count(F.lit(1)).alias("observations"),
        count_if(F.col("eligible_for_12m_pd")).alias("eligible_observations"),
        count_if(F.col("target_12m_observable")).alias("observable_12m_targets"),
        count_if(F.col("eligible_for_12m_pd") & ~F.col("target_12m_observable")).alias("censored_12m_targets"),
        count_if(y == 1).alias("positive_12m_targets"), count_if(y == 0).alias("negative_12m_targets"),
        safe_div(count_if(y == 1), count_if(F.col("target_12m_observable"))).alias("observable_12m_bad_rate"))


def validation(tg: DataFrame, events: DataFrame) -> DataFrame:
    y = F.col("default_next_12m")
    keyed = tg.groupBy("loan_id", "as_of_date").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("eligible_for_12m_pd")).alias("e"), count_if(y == 1).alias("p"),
        count_if(y == 0).alias("g"), count_if(F.col("eligible_for_12m_pd") & ~F.col("target_12m_observable")).alias("c"))
    t = keyed.agg(F.sum("n").alias("pd_12m_rows"), F.count(F.lit(1)).alias("pd_12m_unique_keys"),
                  F.sum("e").alias("eligible_12m_observations"), F.sum("p").alias("positive_12m_targets"),
                  F.sum("g").alias("negative_12m_targets"), F.sum("c").alias("censored_12m_targets"))
    e = (events.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("cure_date").isNotNull()).alias("c"),
                                       count_if(F.col("redefault_flag")).alias("r"))
         .agg(F.sum("n").alias("default_event_rows"), F.count(F.lit(1)).alias("loans_with_default_events"),
              F.sum("c").alias("cures"), F.sum("r").alias("redefaults")))
    return t.crossJoin(e)  # two single-row aggregates
