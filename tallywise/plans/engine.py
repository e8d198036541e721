"""The analysis as a graph of tables, from raw inputs to exports."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import customers, exports, lifetime, orders, repeat_model, retention, scoring, weights
from ..params import DEFAULT_WEIGHTS, PUBLISHED_EXPORTS, PUBLISHED_STAGES, RETENTION_BUDGET
from ..sources.catalog import fingerprint, require_tables
from ..sources.driver_tables import BASE_TABLES, load_tables
from ..sources.publish import publish, read_published
from ..sources.staging import Stages

LIFESPANS = ("empirical", "model", "auto")


class Engine:
    """Tables of one analysis over one set of inputs.

    Results that several later steps read are stage tables (see
    ``sources.staging``): the person rollup, the segmented persons, the value
    inputs, the margin scenarios, the targeted customers and the plan
    comparison. Everything else is a lazy plan on top of those. Stage names hold the
    options they depend on, so engines of other options can share what does not.

    ``score_weights``: weights per dimension, or None to derive them.
    ``lifespan``: "empirical"; "model" for the repeat-purchase model; "auto" for
    the model where its fit converges and the empirical estimate where not.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        stages: Stages,
        score_weights: Mapping[str, float] | None = DEFAULT_WEIGHTS,
        lifespan: str = "empirical",
    ):
        require_tables(tables)
        if lifespan not in LIFESPANS:
            raise ValueError(f"lifespan must be one of {LIFESPANS}")
        self.tables = dict(tables)
        self.stages = stages
        self.score_weights = score_weights
        self.lifespan = lifespan

    def with_options(
        self, score_weights: Mapping[str, float] | None = DEFAULT_WEIGHTS, lifespan: str = "empirical"
    ) -> Engine:
        """An engine over the same inputs and stages."""
        return Engine(self.tables, self.stages, score_weights, lifespan)

    def _stage(self, name: str, build: Callable[[], DataFrame], *options: object) -> DataFrame:
        chosen = "derived" if self.score_weights is None else "-".join(
            f"{d}{self.score_weights[d]!r}" for d in weights.DIMENSIONS)
        return self.stages.table("_".join([name, chosen, *map(str, options)]), build)

    # -- persons ---------------------------------------------------------------

    def delivered(self) -> DataFrame:
        return orders.filtered_orders(self.tables["orders"])

    def customer_orders(self) -> DataFrame:
        return orders.customer_orders(self.tables)

    def rollup(self) -> DataFrame:
        return self.stages.table(
            "customer_rollup", lambda: customers.customer_rollup(self.customer_orders())
        )

    def base(self) -> DataFrame:
        return customers.customer_base(self.rollup())

    # -- segments --------------------------------------------------------------

    def rfm(self) -> DataFrame:
        def build() -> DataFrame:
            scored = scoring.score(self.base())
            chosen = self.score_weights or weights.derive_weights(scored)
            return scoring.segment_scored(scored, chosen)

        return self._stage("rfm_segments", build)

    # -- value -----------------------------------------------------------------

    def histories(self) -> DataFrame:
        return self._stage(
            "repeat_histories",
            lambda: repeat_model.distinct_histories(repeat_model.repeat_histories(self.rfm())),
        )

    def repeat_fit(self) -> DataFrame:
        """Parameters of the repeat-purchase model and how the fit ended, as one row."""
        return self._stage("repeat_fit", lambda: repeat_model.fit(self.histories()).as_row(self.stages.spark))

    @cached_property
    def repeat_model(self) -> repeat_model.RepeatModel:
        return repeat_model.RepeatModel.from_row(self.repeat_fit().first())

    def forecast(self, params: Mapping[str, float] | None = None) -> DataFrame:
        """P(alive) and expected orders of every person, from the fit unless parameters are given."""
        return repeat_model.forecast(self.rfm(), params or self.repeat_model.params(), self.histories())

    def inputs(self) -> DataFrame:
        def build() -> DataFrame:
            rfm = self.rfm()
            if self.lifespan == "empirical":
                return lifetime.value_inputs(rfm)
            if self.lifespan == "model":
                if not self.repeat_model.converged:
                    raise RuntimeError("the repeat-purchase model did not converge")
                return self.inputs_from_model(self.repeat_model.params())
            # "auto": which lifespan counts is a scalar of the plan.
            fitted = self.repeat_fit()
            return lifetime.chosen_inputs(
                lifetime.value_inputs(rfm),
                self.inputs_from_model(self.repeat_model.params()),
                fitted.select("converged").scalar(),
            )

        return self._stage("value_inputs", build, self.lifespan)

    def inputs_from_model(self, params: Mapping[str, float]) -> DataFrame:
        alive = repeat_model.add_prob_alive(self.rfm(), params)
        return lifetime.value_inputs(self.rfm(), lifetime.model_lifespan(alive))

    def scores(self) -> DataFrame:
        return lifetime.clv_scores(self.inputs())

    def sensitivity(self) -> DataFrame:
        return self._stage(
            "clv_sensitivity", lambda: lifetime.clv_sensitivity(self.inputs()), self.lifespan
        )

    # -- retention -------------------------------------------------------------

    def current(self, budget: float = RETENTION_BUDGET) -> DataFrame:
        return retention.current_state(self.scores(), budget)

    def reach(self, budget: float = RETENTION_BUDGET) -> DataFrame:
        return retention.segment_reach(self.scores(), budget)

    def targeted(self, budget: float = RETENTION_BUDGET) -> DataFrame:
        return self._stage(
            "targeted", lambda: retention.targeted_customers(self.scores(), self.reach(budget)),
            self.lifespan, repr(budget),
        )

    def proposed(self, budget: float = RETENTION_BUDGET) -> DataFrame:
        return retention.proposed_state(self.reach(budget), self.targeted(budget))

    def roi(self, budget: float = RETENTION_BUDGET) -> DataFrame:
        return self._stage(
            "retention_roi", lambda: retention.retention_roi(self.current(budget), self.proposed(budget)),
            self.lifespan, repr(budget),
        )

    # -- published tables ------------------------------------------------------

    def exports(self) -> dict[str, DataFrame]:
        return dict(zip(PUBLISHED_EXPORTS, (
            exports.customer_detail(self.scores()),
            exports.segment_summary(self.scores()),
            exports.retention_comparison(self.roi()),
            exports.sensitivity_export(self.sensitivity()),
            exports.geographic_summary(self.scores()),
        ), strict=True))

    def results(self) -> dict[str, DataFrame]:
        return dict(zip(PUBLISHED_STAGES, (
            self.base().orderBy(F.desc("total_spend"), "customer_unique_id"),
            self.rfm(),
            self.scores(),
            self.sensitivity(),
            self.roi(),
        ), strict=True))

    def write(self, folder: str) -> dict[str, str]:
        """Publish stage results as parquet and the dashboard tables as CSV, as one version."""
        return publish(
            self.stages.spark, folder, {**self.results(), **self.exports()},
            flat=PUBLISHED_EXPORTS, single=exports.SINGLE_FILE,
        )

    def published(self) -> dict[str, DataFrame]:
        """The ten tables read back as they are published below the stage folder."""
        folder = f"{self.stages.path}/_published"
        with _creating:
            if folder not in _published:
                self.write(folder)
                _published.add(folder)
        return read_published(self.stages.spark, folder)


_published: set[str] = set()
_engines: dict[tuple, Engine] = {}
_creating = threading.RLock()


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the benchmark tables in ``sf_dir``.

    Queries over unchanged inputs share their stage tables, also across applications.
    """
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in BASE_TABLES]
    source = f"{sf_dir} {fingerprint(spark, paths)}"
    key = (spark.sparkContext.applicationId, source)
    with _creating:
        if key not in _engines:
            _engines[key] = Engine(load_tables(spark, sf_dir), Stages(spark, source=source))
        return _engines[key]
