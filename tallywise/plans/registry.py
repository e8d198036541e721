"""Named queries: one per operator, each over the whole input tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import round_even
from ..operators import (
    customers,
    exports,
    lifetime,
    orders,
    profile,
    repeat_model,
    retention,
    scoring,
    weights,
)
from ..params import ILLUSTRATIVE_MODEL, PUBLISHED_EXPORTS, PUBLISHED_STAGES, QUICK_MODEL, TIGHT_BUDGET
from ..sources.catalog import run_sql, table_row_counts
from .base_sql import CUSTOMER_BASE
from .engine import Engine, engine_for

Query = Callable[[Engine], DataFrame]
PERSON = "customer_unique_id"

# Parameter cells of the likelihood query: two values each.
GRID = [
    {"r": r, "alpha": alpha, "a": a, "b": b}
    for r in (0.5, 1.5) for alpha in (60.0, 240.0) for a in (0.4, 1.2) for b in (1.5, 4.0)
]


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _categorised(e: Engine) -> DataFrame:
    t = e.tables
    return orders.categorised_items(t["order_items"], t["products"], t["category_translation"])


def _scored(e: Engine, *columns: str) -> DataFrame:
    return e.rfm().select(PERSON, *columns)


def _customer_base_sql(e: Engine) -> DataFrame:
    """The base table asked for in SQL over the eight input tables."""
    return run_sql(e.stages.spark, CUSTOMER_BASE, e.tables)


def _monetary_score_ranked(e: Engine) -> DataFrame:
    base = e.base()
    by_rank = scoring.ranked_monetary_score(base, base.count())
    return base.select(
        PERSON, "total_spend", by_rank(F.col("total_spend"), F.col(PERSON)).alias("M_score")
    )


def _spend_quintile_edges(e: Engine) -> DataFrame:
    return scoring.spend_edges(e.base()).select(
        "persons", *[round_even(F.col(f"edge_{i}"), 4).alias(f"edge_{i}") for i in range(6)]
    )


def _standardized_scores(e: Engine) -> DataFrame:
    wide = weights.standardized_scores(e.rfm())
    return wide.select(PERSON, *[round_even(F.col(f"{d}_std"), 6).alias(f"{d}_std") for d in "RFM"])


def _weight_fit(e: Engine) -> DataFrame:
    coefficients = weights.fit_coefficients(weights.value_target(e.rfm()))
    policy = weights.weight_policy(coefficients)
    return coefficients.select(
        *[round_even(F.col(d), 4).alias(f"coefficient_{d}") for d in weights.DIMENSIONS]
    ).crossJoin(F.broadcast(policy))


def _weight_policy(e: Engine) -> DataFrame:
    return weights.weight_policy(weights.fit_coefficients(weights.value_target(e.rfm())))


def _weight_policy_correlation(e: Engine) -> DataFrame:
    target = weights.value_target(e.rfm())
    return weights.weight_policy(weights.score_target_correlation(target))


def _weight_policy_cases(e: Engine) -> DataFrame:
    """The policy on each person's own scores as coefficients: every branch, many times."""
    cells = e.rfm().groupBy(*scoring.SCORES).agg(F.count(F.lit(1)).alias("customers"))
    given = cells.select(
        *scoring.SCORES, "customers",
        (F.col("R_score") - 1).cast("double").alias("R"), (1 - F.col("F_score")).cast("double").alias("F"),
        (F.col("M_score") - 1).cast("double").alias("M"),
    )
    return weights.weight_policy(given, keep=(*scoring.SCORES, "customers"))


def _annualized_frequency(e: Engine) -> DataFrame:
    return e.inputs().select(
        PERSON, "total_orders", "R_score",
        round_even(F.col("yearly_orders"), 4).alias("annualized_frequency"),
    )


def _empirical_lifespan(e: Engine) -> DataFrame:
    return e.inputs().select(
        PERSON, "rfm_segment", round_even(F.col("lifespan_years"), 4).alias("lifespan_years")
    )


def _grid(e: Engine) -> DataFrame:
    cells = repeat_model.grid_log_likelihood(e.histories(), GRID)
    # A sum over all persons: the mean keeps six places meaningful at any size.
    mean = F.col("log_likelihood") / F.col("customers")
    return cells.select(
        *repeat_model.PARAMETERS, "customers", round_even(mean, 6).alias("mean_log_likelihood")
    )


def _fit(e: Engine) -> DataFrame:
    """How the fit ended: as flat as rounding tells, and how likely the data are there."""
    persons = e.histories().agg(F.sum("customers").alias("customers"))
    fitted = e.repeat_fit().select(
        "converged", round_even(F.col("objective"), 6).alias("objective"),
        *[F.abs(round_even(F.col(f"slope_{p}"), 6)).alias(f"slope_{p}") for p in repeat_model.PARAMETERS],
    )
    return persons.crossJoin(F.broadcast(fitted))


def _scores_auto(e: Engine) -> DataFrame:
    """Values with the lifespan method that the fit decides on."""
    return e.with_options(lifespan="auto").scores()


def _read_back(name: str) -> Query:
    return lambda e: e.published()[name]


def _prob_alive(e: Engine) -> DataFrame:
    alive = repeat_model.add_prob_alive(e.rfm(), ILLUSTRATIVE_MODEL)
    return alive.select(PERSON, round_even(F.col("prob_alive"), 6).alias("prob_alive"))


def _forecast(params: Mapping[str, float]) -> Query:
    def run(e: Engine) -> DataFrame:
        return e.forecast(params).select(PERSON, *repeat_model.HISTORY, "prob_alive", "expected_purchases")

    return run


def _forecast_histories(e: Engine) -> DataFrame:
    return repeat_model.forecast_histories(e.histories(), ILLUSTRATIVE_MODEL)


def _forecast_stats(e: Engine) -> DataFrame:
    return repeat_model.forecast_stats(e.forecast(ILLUSTRATIVE_MODEL))


def _model_inputs(e: Engine) -> DataFrame:
    return e.stages.table(
        "illustrative_inputs", lambda: e.inputs_from_model(ILLUSTRATIVE_MODEL)
    )


def _model_lifespan(e: Engine) -> DataFrame:
    return _model_inputs(e).select(
        PERSON, "rfm_segment", round_even(F.col("lifespan_years"), 6).alias("lifespan_years")
    )


def _export_roundtrip(e: Engine) -> DataFrame:
    """Write the small exports as CSV with header and read them back."""
    name = "02_segment_summary"
    folder = f"{e.stages.path}/exports"
    df = exports.segment_summary(e.scores())
    written = exports.write_exports({name: df}, folder)
    return e.stages.spark.read.schema(df.schema).option("header", True).csv(written[name])


def _rounding(e: Engine) -> DataFrame:
    """Half-to-even rounding over order prices at 1, 2 and 4 places."""
    value = F.col("avg_order_value") / 8
    return e.base().select(
        PERSON,
        *[round_even(value, places).alias(f"rounded_{places}") for places in (1, 2, 4)],
    )


def _dashboard_fields(e: Engine) -> DataFrame:
    return exports.dashboard_fields(
        exports.segment_summary(e.scores()), exports.retention_comparison(e.roi())
    )


def _targeted(budget: float | None = None) -> Query:
    def run(e: Engine) -> DataFrame:
        rows = e.targeted() if budget is None else e.targeted(budget)
        return rows.select(PERSON, "rfm_segment", "clv_estimate")

    return run


QUERIES: dict[str, Query] = {
    # sources
    "table_row_counts": lambda e: table_row_counts(e.tables),
    "category_translated_items": lambda e: _categorised(e).select("order_id", "product_id", "category"),
    "export_roundtrip": _export_roundtrip,
    **{f"published_{name}": _read_back(name) for name in (*PUBLISHED_STAGES, *PUBLISHED_EXPORTS)},
    # orders
    "filtered_orders": lambda e: e.delivered(),
    "identity_resolution": lambda e: orders.identity_resolution(e.delivered(), e.tables["customers"]),
    "payments_aggregated": lambda e: _money(
        orders.payments_by_order(e.tables["order_payments"]), "total_payment_value"
    ),
    "order_item_counts": lambda e: orders.order_item_counts(e.tables["order_items"]),
    "order_modal_category": lambda e: orders.order_modal_category(_categorised(e)),
    "order_modal_seller": lambda e: orders.order_modal_seller(
        e.tables["order_items"], e.tables["sellers"]
    ),
    "reviews_latest": lambda e: orders.latest_reviews(e.tables["order_reviews"]),
    "customer_orders": lambda e: _money(e.customer_orders(), "total_payment_value"),
    # persons
    "reference_date": lambda e: customers.reference_date(e.rollup()),
    "recency_days": lambda e: e.base().select(PERSON, "recency_days"),
    "tenure_days": lambda e: e.base().select(PERSON, "customer_tenure_days"),
    "customer_modal_category": lambda e: e.rollup().select(PERSON, "primary_category"),
    "customer_modal_seller_state": lambda e: e.rollup()
    .filter(F.col("primary_seller_state").isNotNull())
    .select(PERSON, "primary_seller_state"),
    "customer_latest_state": lambda e: e.rollup().select(PERSON, "customer_state"),
    "customer_base": lambda e: e.base().orderBy(F.desc("total_spend"), PERSON),
    "customer_base_sql": _customer_base_sql,
    "top_spenders": lambda e: profile.top_spenders(e.base()),
    "null_profile": lambda e: profile.null_profile(e.base()),
    "numeric_profile": lambda e: profile.numeric_profile(e.base()),
    "repeat_rate": lambda e: profile.repeat_rate(e.base()),
    "frequency_histogram": lambda e: profile.frequency_histogram(e.base()),
    "top_states_by_customers": lambda e: profile.top_states_by_customers(e.base()),
    "base_overview": lambda e: profile.base_overview(e.base()),
    "rounding_half_even": _rounding,
    # scores and segments
    "recency_score": lambda e: _scored(e, "recency_days", "R_score"),
    "frequency_score": lambda e: _scored(e, "total_orders", "F_score"),
    "monetary_score": lambda e: _scored(e, "total_spend", "M_score"),
    "monetary_score_ranked": _monetary_score_ranked,
    "spend_quintile_edges": _spend_quintile_edges,
    "rfm_composite": lambda e: _scored(e, *scoring.SCORES, "rfm_composite"),
    "rfm_segments": lambda e: e.rfm(),
    "segment_catch_all": lambda e: scoring.segment_catch_all(e.rfm()),
    "rfm_segment_breakdown": lambda e: profile.rfm_segment_breakdown(e.rfm()),
    "score_distribution": lambda e: profile.score_distribution(e.rfm()),
    "composite_stats": lambda e: profile.composite_stats(e.rfm()),
    "formatted_segment_table": lambda e: profile.formatted_segment_table(e.rfm()),
    "rf_crosstab": lambda e: exports.rf_crosstab(e.rfm()),
    # weights
    "standardized_scores": _standardized_scores,
    "value_target": lambda e: weights.value_target(e.rfm()).select(PERSON, "high_value"),
    "rfm_weight_fit": _weight_fit,
    "rfm_weight_policy": _weight_policy,
    "rfm_weight_policy_correlation": _weight_policy_correlation,
    "rfm_weight_policy_cases": _weight_policy_cases,
    "rfm_segments_derived": lambda e: e.with_options(score_weights=None).rfm(),
    # value
    "annualized_frequency": _annualized_frequency,
    "frequency_stats": lambda e: lifetime.frequency_stats(e.inputs()),
    "imputed_frequency_by_r": lambda e: lifetime.imputed_frequency_by_recency(e.inputs()),
    "cohort_tenure": lambda e: lifetime.cohort_tenure(e.rfm()),
    "empirical_lifespan": _empirical_lifespan,
    "lifespan_stats": lambda e: lifetime.lifespan_stats(e.inputs()),
    "clv_scores": lambda e: e.scores(),
    "clv_summary": lambda e: lifetime.clv_summary(e.scores()),
    "formatted_clv_table": lambda e: lifetime.formatted_clv_table(e.scores()),
    "clv_sensitivity": lambda e: e.sensitivity(),
    "clv_sensitivity_pivot": lambda e: lifetime.clv_sensitivity_pivot(e.sensitivity()),
    "quality_flags": lambda e: profile.quality_flags(e.scores()),
    # repeat-purchase model
    "bgnbd_summary": lambda e: repeat_model.repeat_histories(e.rfm()),
    "bgnbd_loglik_grid": _grid,
    "bgnbd_fit": _fit,
    "prob_alive": _prob_alive,
    "expected_purchases": _forecast(ILLUSTRATIVE_MODEL),
    "expected_purchases_quick": _forecast(QUICK_MODEL),
    "expected_purchases_histories": _forecast_histories,
    "expected_purchases_stats": _forecast_stats,
    "model_lifespan": _model_lifespan,
    "model_lifespan_stats": lambda e: lifetime.lifespan_stats(_model_inputs(e)),
    "clv_scores_auto": _scores_auto,
    "clv_scores_model": lambda e: lifetime.clv_scores(_model_inputs(e)),
    # retention
    "current_state": lambda e: e.current(),
    "segment_reach": lambda e: e.reach(),
    "targeted_customers": _targeted(),
    "proposed_state": lambda e: e.proposed(),
    "retention_roi": lambda e: e.roi(),
    "retention_headline": lambda e: retention.retention_headline(e.roi()),
    "retention_checks": lambda e: retention.retention_checks(e.roi()),
    "segment_reach_tight": lambda e: e.reach(TIGHT_BUDGET),
    "targeted_customers_tight": _targeted(TIGHT_BUDGET),
    "proposed_state_tight": lambda e: e.proposed(TIGHT_BUDGET),
    "retention_roi_tight": lambda e: e.roi(TIGHT_BUDGET),
    # dashboard tables and chart data
    "export_customer_detail": lambda e: exports.customer_detail(e.scores()),
    "segment_summary_export": lambda e: exports.segment_summary(e.scores()),
    "retention_comparison": lambda e: exports.retention_comparison(e.roi()),
    "retention_chart": lambda e: exports.retention_chart(exports.retention_comparison(e.roi())),
    "sensitivity_export": lambda e: exports.sensitivity_export(e.sensitivity()),
    "geographic_summary": lambda e: exports.geographic_summary(e.scores()),
    "dashboard_fields": _dashboard_fields,
    "segment_overview": lambda e: exports.segment_overview(e.scores()),
    "clv_box_stats": lambda e: exports.clv_box_stats(e.scores()),
    "top_states_by_clv": lambda e: exports.top_states_by_clv(e.scores()),
    "top3_state_share": lambda e: exports.top3_state_share(e.scores()),
}


def _event_tenure_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed days between a user's first and last event: times of day matter."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    spans = events.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return spans.select("user_id", customers.days_between("first_ts", "last_ts").alias("days"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(engine_for(spark, sf_dir))

    return {
        **{name: bind(query) for name, query in QUERIES.items()},
        "event_tenure_days": _event_tenure_days,
    }
