"""The named queries in DuckDB SQL, written the long way round.

Where a Spark operator uses one aggregation, cut points or narrowed quantiles,
the SQL here ranks, sorts and joins whole groups, so the two check each other.
"""

from __future__ import annotations

import re

from ..params import (
    GROSS_MARGIN,
    DEFAULT_WEIGHTS,
    ILLUSTRATIVE_MODEL,
    INTERVENTIONS,
    MODEL_PENALTY,
    PUBLISHED_EXPORTS,
    PUBLISHED_STAGES,
    QUICK_MODEL,
    RETENTION_BUDGET,
    SEGMENT_MIDPOINTS,
    SEGMENTS,
    SENSITIVITY_MARGINS,
    TIGHT_BUDGET,
)
from ..sources.driver_tables import (
    STATE_COUNT,
    TRANSLATIONS,
    UNKNOWN_CATEGORY,
    UNKNOWN_SELLER_STATE,
)

# -- snippets ----------------------------------------------------------------


def dbl(number: float) -> str:
    return f"{float(number)!r}::double"


def rnd(x: str, places: int) -> str:
    """Half to even on the scaled double."""
    return f"(round_even(({x})::double * {dbl(10**places)}, 0) / {dbl(10**places)})"


def values(x: str) -> str:
    return f"list(({x})::double order by ({x})::double) filter (where ({x}) is not null)"


def median(x: str) -> str:
    xs = values(x)
    return f"(({xs})[(len({xs}) + 1) // 2] + ({xs})[(len({xs}) + 2) // 2]) / 2"


def quantile_of(xs: str, p: float) -> str:
    """Linear interpolation over the sorted list ``xs``, from the nearer end."""
    pos = f"({dbl(p)} * (len({xs}) - 1))"
    lo = f"{xs}[floor({pos})::int + 1]"
    hi = f"{xs}[ceil({pos})::int + 1]"
    frac = f"({pos} - floor({pos}))"
    return (
        f"case when {frac} < 0.5 then {lo} + ({hi} - {lo}) * {frac}"
        f" else {hi} - ({hi} - {lo}) * (1 - {frac}) end"
    )


def quantile(x: str, p: float) -> str:
    return quantile_of(f"({values(x)})", p)


def total(x: str, places: int = 2) -> str:
    digits = 18 if places <= 4 else 28
    return f"sum(({x})::decimal({digits},{places}))::double"


def mean(x: str, places: int = 2) -> str:
    return f"({total(x, places)} / nullif(count({x}), 0))"


def pct(part: str, whole: str, places: int = 1) -> str:
    return rnd(f"({part})::double / nullif({whole}, 0) * {dbl(100)}", places)


def tie(identifier: str) -> str:
    return f"md5({identifier}::varchar) || ':' || {identifier}::varchar"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rows(name: str, columns: str, entries) -> str:
    lines = ", ".join("(" + ", ".join(e) + ")" for e in entries)
    return f"select * from (values {lines}) {name}({columns})"


# -- shared steps ------------------------------------------------------------

STEPS: dict[str, str] = {}

STEPS["in_orders"] = """
    select o_orderkey as order_id, o_orderkey as customer_id,
           case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped'
                else 'canceled' end as order_status,
           o_orderdate as order_purchase_timestamp, shipped as order_delivered_customer_date
    from orders
    left join (select l_orderkey, max(l_shipdate) as shipped from lineitem group by all)
      on l_orderkey = o_orderkey"""
STEPS["in_customers"] = f"""
    select o_orderkey as customer_id, c_custkey as customer_unique_id, n_name as customer_state
    from orders join customer on o_custkey = c_custkey
    join nation on n_nationkey =
      (c_nationkey + case when o_orderkey % 7 = 0 then 1 else 0 end) % {STATE_COUNT}"""
STEPS["in_payments"] = """
    select l_orderkey as order_id,
           (floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100)
             ::decimal(18,2) as payment_value
    from lineitem"""
STEPS["in_items"] = """
    select l_orderkey as order_id, l_partkey as product_id, l_suppkey as seller_id from lineitem"""
STEPS["in_products"] = f"""
    select p_partkey as product_id, nullif(p_type, {text(UNKNOWN_CATEGORY)}) as own_name from part"""
STEPS["in_translation"] = rows(
    "t", "own_name, english", [(text(a), text(b)) for a, b in TRANSLATIONS]
)
STEPS["in_sellers"] = f"""
    select s_suppkey as seller_id, nullif(n_name, {text(UNKNOWN_SELLER_STATE)}) as seller_state
    from supplier join nation on s_nationkey = n_nationkey"""
STEPS["in_reviews"] = """
    select l_orderkey as order_id, (1 + l_partkey % 5)::int as review_score,
           l_shipdate as answered
    from lineitem where l_returnflag = 'R'"""

STEPS["delivered"] = """
    select order_id, customer_id, order_purchase_timestamp, order_delivered_customer_date
    from in_orders
    where order_status = 'delivered' and order_delivered_customer_date is not null"""
STEPS["paid"] = """
    select order_id, sum(payment_value) as total_payment_value, count(*) as num_installments
    from in_payments group by order_id"""
STEPS["counted"] = "select order_id, count(*) as item_count from in_items group by order_id"
STEPS["item_category"] = """
    select i.order_id, i.product_id, coalesce(t.english, p.own_name, 'unknown') as category
    from in_items i
    left join in_products p on p.product_id = i.product_id
    left join in_translation t on t.own_name = p.own_name"""
STEPS["order_category"] = """
    select order_id, category as primary_category
    from (select order_id, category, count(*) as lines from item_category group by all)
    qualify row_number() over (partition by order_id order by lines desc, category) = 1"""
STEPS["order_seller"] = """
    select order_id, seller_state
    from (select i.order_id, s.seller_state, count(*) as lines
          from in_items i left join in_sellers s on s.seller_id = i.seller_id
          where s.seller_state is not null group by all)
    qualify row_number() over (partition by order_id order by lines desc, seller_state) = 1"""
STEPS["order_review"] = """
    select order_id, review_score from in_reviews
    qualify row_number() over (
      partition by order_id order by answered desc nulls last, review_score desc nulls last) = 1"""
STEPS["person_orders"] = """
    select c.customer_unique_id, c.customer_state, d.order_id, d.order_purchase_timestamp,
           coalesce(m.total_payment_value, 0) as total_payment_value,
           coalesce(m.num_installments, 1) as num_installments,
           coalesce(n.item_count, 0) as item_count,
           coalesce(g.primary_category, 'unknown') as primary_category,
           s.seller_state, r.review_score
    from delivered d
    join in_customers c on c.customer_id = d.customer_id
    left join paid m on m.order_id = d.order_id
    left join counted n on n.order_id = d.order_id
    left join order_category g on g.order_id = d.order_id
    left join order_seller s on s.order_id = d.order_id
    left join order_review r on r.order_id = d.order_id"""
STEPS["today"] = "select max(order_purchase_timestamp) as reference_date from person_orders"
STEPS["person_category"] = """
    select customer_unique_id, primary_category
    from (select customer_unique_id, primary_category, count(*) as n from person_orders group by all)
    qualify row_number() over (
      partition by customer_unique_id order by n desc, primary_category) = 1"""
STEPS["person_seller"] = """
    select customer_unique_id, seller_state as primary_seller_state
    from (select customer_unique_id, seller_state, count(*) as n from person_orders
          where seller_state is not null group by all)
    qualify row_number() over (
      partition by customer_unique_id order by n desc, seller_state) = 1"""
STEPS["person_state"] = """
    select customer_unique_id, customer_state from person_orders
    qualify row_number() over (
      partition by customer_unique_id
      order by order_purchase_timestamp desc, order_id desc) = 1"""
STEPS["spans"] = """
    select customer_unique_id,
           min(order_purchase_timestamp) as first_purchase_date,
           max(order_purchase_timestamp) as last_purchase_date,
           count(distinct order_id) as total_orders,
           sum(total_payment_value)::double as total_spend,
           sum(total_payment_value)::double / count(*) as avg_order_value,
           sum(review_score)::double / nullif(count(review_score), 0) as avg_review_score
    from person_orders group by customer_unique_id"""
STEPS["base"] = """
    select a.customer_unique_id, st.customer_state, a.first_purchase_date, a.last_purchase_date,
           a.total_orders, a.total_spend, a.avg_order_value, a.avg_review_score,
           ct.primary_category, se.primary_seller_state,
           date_sub('day', a.last_purchase_date, reference_date)::int as recency_days,
           date_sub('day', a.first_purchase_date, a.last_purchase_date)::int
             as customer_tenure_days
    from spans a cross join today
    left join person_state st on st.customer_unique_id = a.customer_unique_id
    left join person_category ct on ct.customer_unique_id = a.customer_unique_id
    left join person_seller se on se.customer_unique_id = a.customer_unique_id"""

STEPS["spends"] = "select list(total_spend order by total_spend) as xs from base"
STEPS["edges"] = "select len(xs) as persons, xs[1] as edge_0, {}, xs[len(xs)] as edge_5 from spends".format(
    ", ".join(f"{quantile_of('xs', p / 5)} as edge_{p}" for p in range(1, 5))
)
STEPS["ranked"] = f"""
    select customer_unique_id, total_spend,
           1 + (place > 1 + (n - 1) * 1 / 5)::int + (place > 1 + (n - 1) * 2 / 5)::int
             + (place > 1 + (n - 1) * 3 / 5)::int + (place > 1 + (n - 1) * 4 / 5)::int as M_score
    from (select customer_unique_id, total_spend, count(*) over ()::double as n,
                 row_number() over (order by total_spend, {tie('customer_unique_id')}) as place
          from base)"""
STEPS["scored"] = """
    select b.*,
           case when recency_days <= 30 then 5 when recency_days <= 60 then 4
                when recency_days <= 90 then 3 when recency_days <= 150 then 2 else 1 end as R_score,
           greatest(1, least(total_orders, 5))::int as F_score,
           case when edge_0 = edge_1 or edge_1 = edge_2 or edge_2 = edge_3 or edge_3 = edge_4
                     or edge_4 = edge_5 then k.M_score
                else 1 + (b.total_spend > edge_1)::int + (b.total_spend > edge_2)::int
                  + (b.total_spend > edge_3)::int + (b.total_spend > edge_4)::int end as M_score
    from base b join ranked k using (customer_unique_id) cross join edges"""
STEPS["composed"] = """
    select *, (40 * R_score + 35 * F_score + 25 * M_score) / 100.0::double as rfm_composite
    from scored"""
STEPS["midpoints"] = rows("m", "name, mid, place", [
    (text(s), dbl(SEGMENT_MIDPOINTS[s]), str(i)) for i, s in enumerate(SEGMENTS)
])
STEPS["nearest"] = """
    select c, name from (select distinct rfm_composite as c from composed) cross join midpoints
    qualify row_number() over (partition by c order by abs(mid - c), place) = 1"""
STEPS["ruled"] = """
    select *,
      case when rfm_composite >= 4 and R_score >= 4 then 'Champions'
           when rfm_composite >= 3 and rfm_composite < 4 and F_score >= 3 then 'Loyal Customers'
           when rfm_composite >= 2.5::double and rfm_composite <= 3.4::double
                and R_score >= 3 and F_score <= 2 then 'Potential Loyalists'
           when rfm_composite >= 2 and rfm_composite < 3 and R_score <= 2
                and (F_score >= 2 or M_score >= 3) then 'At-Risk Customers'
           when rfm_composite < 2 or (R_score = 1 and F_score = 1) then 'Lost Customers'
      end as by_rule
    from composed"""
STEPS["rfm"] = """
    select r.* exclude (by_rule), coalesce(by_rule, name) as rfm_segment
    from ruled r left join nearest on c = rfm_composite"""
STEPS["segments"] = rows("s", "rfm_segment, segment_sort_order", [
    (text(s), str(i)) for i, s in enumerate(SEGMENTS, 1)
])

STEPS["repeaters"] = "select * from rfm where total_orders > 1"
STEPS["segment_tenure"] = f"""
    select s.rfm_segment,
           coalesce(greatest(coalesce(
             (select median(customer_tenure_days) from repeaters r where r.rfm_segment = s.rfm_segment),
             (select median(customer_tenure_days) from repeaters)) / 365, 0.5::double), 1.0::double)
             as segment_years
    from segments s"""
STEPS["rates"] = """
    select r.*,
      case when total_orders > 1 and customer_tenure_days > 0
             then least(total_orders::double / customer_tenure_days * 365, 12.0::double)
           when total_orders > 1 then 2.0::double
           when R_score >= 4 then 2.0::double
           when R_score = 3 then 1.5::double
           else 1.0::double end as yearly_orders
    from rfm r"""
STEPS["inputs"] = """
    select r.*,
      case when total_orders > 1
             then greatest(customer_tenure_days::double / 365, 0.5::double)
           else segment_years end as lifespan_years,
      null::double as prob_alive, 'empirical' as lifespan_method
    from rates r join segment_tenure using (rfm_segment)"""


def clv(margin: float) -> str:
    return rnd(
        f"greatest(avg_order_value * yearly_orders * {dbl(margin)} * lifespan_years, 0.0::double)", 2
    )


def published(source: str) -> str:
    return f"""
    select * exclude (yearly_orders, lifespan_years, prob_alive, lifespan_method),
           {clv(GROSS_MARGIN)} as clv_estimate,
           {rnd('yearly_orders', 4)} as annualized_frequency,
           {rnd('lifespan_years', 4)} as estimated_lifespan_years,
           {rnd('prob_alive', 4)} as prob_alive, lifespan_method
    from {source}"""


STEPS["scores"] = published("inputs")
STEPS["scenarios"] = " union all ".join(
    f"select rfm_segment, {dbl(m)} as gross_margin_assumption, {clv(m)} as value from inputs"
    for m in SENSITIVITY_MARGINS
)
STEPS["sensitivity"] = f"""
    select rfm_segment, gross_margin_assumption, {median('value')} as median_clv,
           {total('value')} as total_clv
    from scenarios group by all"""

# -- repeat-purchase model ---------------------------------------------------

STEPS["histories"] = """
    select customer_unique_id, total_orders - 1 as frequency, customer_tenure_days as recency,
           recency_days + customer_tenure_days as T
    from rfm where recency_days + customer_tenure_days > 0"""
STEPS["history_groups"] = """
    select frequency, recency, T, count(*) as customers from histories group by all"""



def _alive(p: dict[str, str], h: str = "") -> str:
    """P(alive) at the parameters, columns or numbers; ``h`` names the history's table."""
    return (
        f"case when {h}frequency = 0 then 1.0::double else 1 / (1 + {p['a']} / ({p['b']} + {h}frequency - 1)"
        f" * pow(({p['alpha']} + {h}T) / ({p['alpha']} + {h}recency), {p['r']} + {h}frequency)) end"
    )


def _model_steps(suffix: str, alive: str, given: str = "") -> None:
    """Value inputs and scores from the model; ``given`` joins the parameters' row."""
    STEPS[f"alive{suffix}"] = f"""
    select r.customer_unique_id, {alive} as prob_alive
    from rfm r left join histories h using (customer_unique_id) {given}
    where h.T is not null
    union all
    select customer_unique_id, null from rfm
    where customer_unique_id not in (select customer_unique_id from histories)"""
    STEPS[f"model_years{suffix}"] = f"""
    select r.*, prob_alive,
           case when prob_alive is not null then greatest(prob_alive * 2, 0.1::double) end as years
    from rates r join alive{suffix} using (customer_unique_id)"""
    STEPS[f"model_inputs{suffix}"] = f"""
    select m.* exclude (years, prob_alive),
           coalesce(years, middle, 0.5::double) as lifespan_years,
           prob_alive, 'BG/NBD' as lifespan_method
    from model_years{suffix} m
    left join (select rfm_segment, {median('years')} as middle from model_years{suffix} group by all)
      using (rfm_segment)"""
    STEPS[f"model_scores{suffix}"] = published(f"model_inputs{suffix}")


def _forecast_steps(suffix: str, model: dict[str, float]) -> None:
    """The hypergeometric series term by term, as a recursion per history."""
    p = {k: dbl(v) for k, v in model.items()}
    ratio = (
        "({a} + {b} - 1 - {r} + k) * ({a} - 1 + k) / (({a} + {b} - 1 + frequency + k) * (k + 1.0::double)) * z"
    ).format(**p)
    STEPS[f"series{suffix}"] = f"""
    select frequency, recency, T, 0 as k, 1.0::double as term, 1.0::double as partial,
           730.0::double / ({p['alpha']} + T + 730.0::double) as z
    from history_groups
    union all
    select frequency, recency, T, k + 1, term * {ratio}, partial + term * {ratio}, z
    from series{suffix} where abs(term) > 1e-19 * abs(partial)"""
    STEPS[f"forecasts{suffix}"] = """
    select h.frequency, h.recency, h.T, h.customers, {alive} as prob_alive,
           ({a} + {b} - 1 + h.frequency) / ({a} - 1) * (1 - pow(1 - z, {a} - 1) * partial)
             / (1 + case when h.frequency > 0 then {a} / ({b} + h.frequency - 1)
                * pow(({alpha} + h.T) / ({alpha} + h.recency), {r} + h.frequency) else 0 end)
             as expected_purchases
    from history_groups h
    join (select frequency, recency, T, max_by(partial, k) as partial, max(z) as z from series{suffix} group by all) s
      on s.frequency = h.frequency and s.recency = h.recency and s.T = h.T""".format(
        alive=_alive(p, "h."), suffix=suffix, **p,
    )


def _forecast_of_persons(suffix: str = "") -> str:
    return f"""
        select r.customer_unique_id, total_orders - 1 as frequency, customer_tenure_days as recency,
               recency_days + customer_tenure_days as T, {rnd('prob_alive', 6)} as prob_alive,
               {rnd('expected_purchases', 6)} as expected_purchases
        from rfm r left join forecasts{suffix} f
          on f.frequency = total_orders - 1 and f.recency = customer_tenure_days
          and f.T = recency_days + customer_tenure_days"""


_LIKELIHOOD = """
      lgamma(r + frequency) - lgamma(r) + r * ln(alpha)
      + lgamma(a + b) + lgamma(b + frequency) - lgamma(b) - lgamma(a + b + frequency)
      - (r + frequency) * ln(alpha + T)
      + case when frequency > 0
             then ln(1 + exp(ln(a) - ln(b + frequency - 1)
                    - (r + frequency) * (ln(alpha + recency) - ln(alpha + T)))) else 0 end"""

_model_steps("", _alive({k: dbl(v) for k, v in ILLUSTRATIVE_MODEL.items()}))
_forecast_steps("", ILLUSTRATIVE_MODEL)
_forecast_steps("_quick", QUICK_MODEL)

# The best parameters by a search that looks in all 81 directions of the logs at once and
# halves its step where it is; no slopes, no curvature, unlike the fit.
STEPS["moves"] = "select {} from {}".format(
    ", ".join(f"m{i}.d{i}" for i in range(4)),
    " cross join ".join(f"(select unnest([-1, 0, 1]) as d{i}) m{i}" for i in range(4)),
)
STEPS["longest"] = "select max(T)::double as longest from history_groups"
STEPS["search"] = f"""
    select 0 as round, 0.0::double as l0, 0.0::double as l1, 0.0::double as l2, 0.0::double as l3,
           1.6::double as step, 0.0::double as best
    union all
    select round + 1, top.p0, top.p1, top.p2, top.p3, case when top.stay then step / 2 else step end, top.value
    from (
      select any_value(round) as round, any_value(step) as step,
             max_by({{'p0': p0, 'p1': p1, 'p2': p2, 'p3': p3, 'stay': stay, 'value': value}},
                    value + case when stay then 1e-12 else 0 end) as top
      from (
        select round, step, p0, p1, p2, p3, stay,
               sum(customers * ({_LIKELIHOOD})) / sum(customers)
                 - {dbl(MODEL_PENALTY)} * any_value(r * r + pow(alpha / longest * 10, 2) + a * a + b * b) as value
        from (
          select round, step, p0, p1, p2, p3, stay, longest,
                 exp(p0) as r, exp(p1) * longest / 10 as alpha, exp(p2) as a, exp(p3) as b
          from (
            select round, step, l0 + d0 * step as p0, l1 + d1 * step as p1, l2 + d2 * step as p2,
                   l3 + d3 * step as p3, d0 = 0 and d1 = 0 and d2 = 0 and d3 = 0 as stay
            from search cross join moves where step > 5e-5
          ) cross join longest
        ) cross join history_groups
        group by round, step, p0, p1, p2, p3, stay
      )
    ) where round is not null"""
STEPS["fitted"] = """
    select exp(l0) as r, exp(l1) * longest / 10 as alpha,
           case when exp(l2) / (exp(l2) + exp(l3)) < 1e-6 then 0 else exp(l2) end as a, exp(l3) as b, best as objective
    from (select * from search order by round desc limit 1) cross join longest"""
_model_steps("_auto", _alive({p: f"fitted.{p}" for p in ("r", "alpha", "a", "b")}), "cross join fitted")

# -- retention ---------------------------------------------------------------

STEPS["plan"] = rows(
    "p", "rfm_segment, intervention, cost, share, effect, rate, base_rate",
    [
        (text(i.segment), text(i.description), dbl(i.cost), dbl(i.share), text(i.effect),
         dbl(i.rate), dbl(i.base_rate))
        for i in INTERVENTIONS
    ],
)
STEPS["sizes"] = f"""
    select s.rfm_segment, count(c.rfm_segment) as size,
           count(*) filter (where c.R_score <= 3) as eligible,
           {median('c.clv_estimate')} as median_clv
    from segments s left join scores c using (rfm_segment) group by s.rfm_segment"""


def _retention(budget: float, suffix: str) -> None:
    STEPS[f"current{suffix}"] = f"""
    with unit as (select case when sum(eligible) > 0 then {dbl(budget)} / sum(eligible)
                         else 0 end as cost from sizes),
    flows as (select s.*, cost, eligible * cost as spent,
                     eligible * 0.08::double as recovered from sizes s cross join unit)
    select rfm_segment, size as total_customers, eligible as eligible_customers_current,
           {rnd('spent', 2)} as current_budget_allocation,
           {rnd('cost', 2)} as current_cost_per_customer,
           {rnd('recovered', 1)} as current_expected_recovered,
           {rnd('recovered * median_clv', 2)} as current_revenue_impact,
           {rnd('case when spent > 0 then (recovered * median_clv - spent) / spent else 0 end', 4)}
             as roi_current,
           {rnd('median_clv', 2)} as median_clv
    from flows"""
    STEPS[f"reach{suffix}"] = f"""
    select rfm_segment, size as segment_size, {dbl(budget)} * share as allocated_budget, cost,
           case when cost > 0 then least(trunc({dbl(budget)} * share / cost)::bigint, size)
                else 0 end as reach,
           {rnd('case when size > 0 then reach::double / size * 100 else 0 end', 1)} as coverage_pct
    from sizes join plan using (rfm_segment)"""
    STEPS[f"targeted{suffix}"] = f"""
    select c.customer_unique_id, c.rfm_segment, clv_estimate, avg_order_value, annualized_frequency
    from scores c join reach{suffix} t using (rfm_segment)
    qualify row_number() over (
      partition by c.rfm_segment
      order by clv_estimate desc, {tie('c.customer_unique_id')}) <= t.reach"""
    STEPS[f"proposed{suffix}"] = f"""
    with hit as (
      select rfm_segment, {mean('clv_estimate')} as mean_clv,
             {mean('avg_order_value', 10)} as mean_aov,
             {mean('annualized_frequency', 4)} as mean_freq,
             {median('clv_estimate')} as median_clv
      from targeted{suffix} group by rfm_segment),
    flows as (
      select p.*, reach, allocated_budget, coverage_pct, coalesce(mean_clv, 0) as mean_clv,
        reach * p.cost as spent,
        case effect when 'churn_reduction' then reach * (base_rate - rate)
                    when 'frequency_uplift' then reach * coalesce(mean_freq, 0) * rate
                    when 'none' then 0.0::double else reach * rate end as retained,
        case effect when 'churn_reduction' then reach * (base_rate - rate) * coalesce(mean_clv, 0)
                    when 'frequency_uplift' then reach * coalesce(mean_freq, 0) * rate
                      * coalesce(mean_aov, 0) * 0.65::double
                    when 'none' then 0.0::double
                    else reach * rate * coalesce(median_clv, 0) end as revenue
      from plan p join reach{suffix} using (rfm_segment) left join hit using (rfm_segment))
    select rfm_segment, intervention,
           {rnd('allocated_budget', 2)} as proposed_budget_allocation,
           cost as proposed_cost_per_customer, reach as proposed_reach,
           coverage_pct as proposed_coverage_pct,
           {rnd('retained', 1)} as proposed_expected_retained,
           {rnd('revenue', 2)} as proposed_revenue_impact,
           {rnd('case when spent > 0 then (revenue - spent) / spent else 0 end', 4)} as roi_proposed,
           {rnd('mean_clv', 2)} as targeted_mean_clv
    from flows"""
    STEPS[f"roi{suffix}"] = f"""
    select rfm_segment, total_customers, eligible_customers_current, current_budget_allocation,
           current_cost_per_customer, current_expected_recovered,
           coalesce(current_revenue_impact, 0) as current_revenue_impact, coalesce(roi_current, 0) as roi_current,
           coalesce(median_clv, 0) as median_clv, p.* exclude (rfm_segment)
    from current{suffix} full join proposed{suffix} p using (rfm_segment)"""


_retention(RETENTION_BUDGET, "")
_retention(TIGHT_BUDGET, "_tight")

STEPS["comparison"] = f"""
    select r.*, segment_sort_order,
           {rnd('proposed_budget_allocation - current_budget_allocation', 4)} as budget_shift,
           {rnd('proposed_revenue_impact - current_revenue_impact', 4)} as revenue_shift,
           {rnd('roi_proposed - roi_current', 4)} as roi_improvement
    from roi r join segments using (rfm_segment)"""

_MEDIANS = {
    "median_recency": "recency_days", "median_orders": "total_orders",
    "median_r_score": "R_score", "median_f_score": "F_score",
    "median_m_score": "M_score", "median_composite": "rfm_composite",
    "median_clv": "clv_estimate", "median_spend": "total_spend", "median_aov": "avg_order_value",
}
STEPS["summary_rounded"] = """
    select rfm_segment, count(*) as customer_count, {sums}, {medians}, {p25} as p25_clv, {p75} as p75_clv
    from scores group by rfm_segment""".format(
    sums=", ".join([
        f"{rnd(total('clv_estimate'), 2)} as total_clv",
        f"{rnd(mean('clv_estimate'), 2)} as mean_clv",
        f"{rnd(total('total_spend'), 2)} as total_spend",
    ]).replace("sum((total_spend)", "sum((scores.total_spend)"),
    medians=", ".join(f"{rnd(median('scores.' + c), 2)} as {n}" for n, c in _MEDIANS.items()),
    p25=rnd(quantile("clv_estimate", 0.25), 2),
    p75=rnd(quantile("clv_estimate", 0.75), 2),
)
STEPS["summary"] = f"""
    select s.rfm_segment, r.* exclude (rfm_segment),
           case when customer_count is not null then segment_sort_order end as segment_sort_order,
           {pct('customer_count', 'sum(customer_count) over ()')} as customer_pct,
           {pct('total_clv', 'sum(total_clv::decimal(28,2)) over ()::double')} as clv_share_pct
    from segments s left join summary_rounded r using (rfm_segment)"""
STEPS["state_values"] = f"""
    select customer_state, {total('clv_estimate')} as total_clv, count(*) as customer_count,
           {rnd(median('clv_estimate'), 2)} as median_clv
    from scores group by customer_state"""
STEPS["state_seller"] = """
    select customer_state, primary_seller_state
    from (select customer_state, primary_seller_state, count(*) as n from scores
          where primary_seller_state is not null group by all)
    qualify row_number() over (partition by customer_state order by n desc, primary_seller_state) = 1"""
STEPS["breakdown"] = """
    select s.rfm_segment, segment_sort_order, count(r.rfm_segment) as customers,
           {share} as customer_pct, {medians}
    from segments s left join rfm r using (rfm_segment) group by all""".format(
    share=pct("count(r.rfm_segment)", "(select count(*) from rfm)"),
    medians=", ".join(
        f"{rnd(median('r.' + c), 2)} as {n}"
        for n, c in {
            "median_r": "R_score", "median_f": "F_score", "median_m": "M_score",
            "median_composite": "rfm_composite", "median_recency": "recency_days",
            "median_orders": "total_orders", "median_spend": "total_spend",
        }.items()
    ),
)
STEPS["target"] = f"""
    select r.*, (avg_order_value > (select {median('avg_order_value')} from rfm))::int as high_value
    from rfm r"""

STEPS["boxes"] = f"""
    select rfm_segment, {quantile('clv_estimate', 0.25)} as q1, {median('clv_estimate')} as median,
           {quantile('clv_estimate', 0.75)} as q3
    from scores where clv_estimate > 0 group by rfm_segment"""
STEPS["fenced"] = """
    select rfm_segment, q1, median, q3, clv_estimate as x,
           clv_estimate between q1 - (q3 - q1) * 1.5::double and q3 + (q3 - q1) * 1.5::double as inside
    from scores join boxes using (rfm_segment) where clv_estimate > 0"""
STEPS["whiskers"] = """
    select rfm_segment, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
           count(*) as customers,
           least(min(x) filter (where inside), any_value(q1)) as whisker_low,
           greatest(max(x) filter (where inside), any_value(q3)) as whisker_high,
           count(*) filter (where not inside) as outliers
    from fenced group by rfm_segment"""
STEPS["people"] = f"""
    select {rnd('f.expected_purchases', 6)} as e, {rnd('f.prob_alive', 6)} as p
    from histories h join forecasts f
      on f.frequency = h.frequency and f.recency = h.recency and f.T = h.T"""

# Weights by Newton steps, one coefficient at a time, over the score cells.
STEPS["score_cells"] = """
    select R_score, F_score, M_score, high_value, count(*)::double as n from target group by all"""
STEPS["class_sizes"] = """
    select sum(n) as persons, sum(n) filter (where high_value = 1) as high, sum(n) filter (where high_value = 0) as low,
           {} from score_cells""".format(", ".join(
    f"sum(n * {d}_score) / sum(n) as mean_{d}, sqrt(greatest(sum(n * {d}_score * {d}_score) / sum(n)"
    f" - pow(sum(n * {d}_score) / sum(n), 2), 0)) as spread_{d}"
    for d in "RFM"
))
STEPS["features"] = """
    select high_value as y, 1.0::double as x0, {},
           n * persons / (2 * case when high_value = 1 then high else low end) as w
    from score_cells cross join class_sizes where high > 0 and low > 0""".format(", ".join(
    f"({d}_score - mean_{d}) / case when spread_{d} > 1e-12 then spread_{d} else 1 end as x{i}"
    for i, d in enumerate("RFM", 1)
))
STEPS["newton"] = """
    select 0 as k, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as b3
    union all
    select k + 1, {moved}
    from (
      select k, b0, b1, b2, b3,
             (sum(w * (y - p) * x) - penalty) / (sum(w * p * (1 - p) * x * x) + case when k % 4 > 0 then 1 else 0 end) as step
      from (
        select k, b0, b1, b2, b3, w, y, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3))) as p,
               case k % 4 when 0 then x0 when 1 then x1 when 2 then x2 else x3 end as x,
               case k % 4 when 0 then 0 when 1 then b1 when 2 then b2 else b3 end as penalty
        from newton cross join features where k < 1600
      ) group by k, b0, b1, b2, b3, penalty
    )""".format(moved=", ".join(
    f"b{i} + case when k % 4 = {i} then greatest(-1, least(1, step)) else 0 end" for i in range(4)
))
STEPS["coefficients"] = "select b1 as R, b2 as F, b3 as M from newton order by k desc limit 1"

_READ_OFTEN = {"history_groups", "features", "moves", "longest"}

_ORDER = list(STEPS)


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?<![\w.']){name}(?!\w)", sql) is not None


def compose(final: str) -> str:
    """``final`` preceded by the steps it builds on, in order."""
    needed: set[str] = set()
    pending = [final]
    while pending:
        sql = pending.pop()
        for name in _ORDER:
            if name not in needed and _mentions(sql, name):
                needed.add(name)
                pending.append(STEPS[name])
    # What a recursion reads in every round is worked out once.
    steps = [
        f"{name} as {'materialized ' if name in _READ_OFTEN else ''}({STEPS[name]}\n)" for name in _ORDER if name in needed
    ]
    recursive = "recursive " if any(_mentions(STEPS[name], name) for name in needed) else ""
    return (f"with {recursive}" + ",\n".join(steps) + "\n" if steps else "") + final


PERSON = "customer_unique_id"
_BASE = """customer_unique_id, customer_state, first_purchase_date, last_purchase_date, total_orders,
    total_spend, avg_order_value, avg_review_score, primary_category, primary_seller_state,
    recency_days, customer_tenure_days"""


def _null_profile() -> str:
    parts = [
        f"select '{c.strip()}' as column_name, count(*) - count({c}) as null_count, count(*) as n from base"
        for c in _BASE.split(",")
    ]
    return (
        f"select column_name, null_count, {pct('null_count', 'n')} as null_pct,"
        f" null_count::double / n * 100 > 5 as flagged from ({' union all '.join(parts)})"
    )


def _numeric_profile() -> str:
    return " union all ".join(
        f"select '{c}' as column_name, {rnd(f'min({c})', 2)} as min_value,"
        f" {rnd(median(c), 2)} as median_value, {rnd(f'max({c})', 2)} as max_value,"
        f" {rnd(mean(f'{c}::double', 10), 2)} as mean_value from base"
        for c in (
            "total_orders", "total_spend", "avg_order_value", "recency_days",
            "customer_tenure_days", "avg_review_score",
        )
    )


def _row_counts() -> str:
    tables = {
        "orders": "in_orders", "order_items": "in_items", "order_payments": "in_payments",
        "customers": "in_customers", "products": "in_products", "order_reviews": "in_reviews",
        "sellers": "in_sellers", "category_translation": "in_translation",
    }
    each = " union all ".join(
        f"select '{n}' as table_name, count(*) as row_count from {t}" for n, t in tables.items()
    )
    return (
        f"select * from ({each}) union all"
        f" select 'total', sum(row_count)::bigint from ({each})"
    )


def _correlation(c: str) -> str:
    return rnd(
        f"coalesce((count(*) * sum({c} * high_value) - sum({c}) * sum(high_value))::double"
        f" / nullif(sqrt((count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::double"
        f" * (count(*) * sum(high_value) - sum(high_value) * sum(high_value))::double), 0), 0)", 6
    )


def _weight_policy(source: str, keep: str = "") -> str:
    """The policy on columns R, F, M of ``source``; ``keep`` lists further columns."""
    also = f"{keep}, " if keep else ""
    shares = ", ".join(
        f"{rnd(f'abs({d}) / nullif(abs(R) + abs(F) + abs(M), 0)', 4)} as share_{d}" for d in "RFM"
    )
    away = ", ".join(f"abs(share_{d} - {dbl(w)})" for d, w in DEFAULT_WEIGHTS.items())
    rest = "1.0::double - (r2 + f2 + m2)"
    derived = {
        "R": f"case when r2 >= f2 and r2 >= m2 then {rnd(f'r2 + {rest}', 2)} else r2 end",
        "F": f"case when f2 > r2 and f2 >= m2 then {rnd(f'f2 + {rest}', 2)} else f2 end",
        "M": f"case when m2 > r2 and m2 > f2 then {rnd(f'm2 + {rest}', 2)} else m2 end",
    }
    final = ", ".join(
        f"case when decision = 'derived' then {derived[d]} else {dbl(DEFAULT_WEIGHTS[d])} end as weight_{d}"
        for d in "RFM"
    )
    return f"""
    select {also}share_R, share_F, share_M, decision, {final} from (
      select *, {rnd('share_R', 2)} as r2, {rnd('share_F', 2)} as f2, {rnd('share_M', 2)} as m2,
        case when share_R is null then 'undefined'
             when greatest(share_R, share_F, share_M) > 0.6::double then 'collapsed'
             when greatest({away}) <= 0.05::double then 'near_default' else 'derived' end as decision
      from (select {also}{shares} from ({source})))"""


STEPS["derived_weights"] = _weight_policy("select * from coefficients")
STEPS["composed_derived"] = """
    select scored.*, ({}) / 100.0::double as rfm_composite from scored cross join derived_weights""".format(
    " + ".join(f"round(weight_{d} * 100) * {d}_score" for d in "RFM")
)
for _name in ("nearest", "ruled", "rfm"):
    STEPS[f"{_name}_derived"] = re.sub(r"\b(composed|nearest|ruled)\b", r"\1_derived", STEPS[_name])
_ORDER = list(STEPS)


def _grid() -> str:
    two = {"r": (0.5, 1.5), "alpha": (60.0, 240.0), "a": (0.4, 1.2), "b": (1.5, 4.0)}
    grids = " cross join ".join(
        f"(select unnest([{', '.join(dbl(v) for v in vs)}]) as {p})" for p, vs in two.items()
    )
    return f"""
    select r, alpha, a, b, sum(customers)::bigint as customers,
           {rnd(f'sum(customers * ({_LIKELIHOOD})) / sum(customers)', 6)} as mean_log_likelihood
    from history_groups cross join {grids} group by r, alpha, a, b"""


def _thousands(x: str, places: int) -> str:
    """Grouped digits, as in 1,234.50."""
    return f"format('{{:,.{places}f}}', ({x})::double)"


def _lifespan_stats(source: str) -> str:
    years = "lifespan_years"
    return f"""
    select max(lifespan_method) as lifespan_method, {rnd(median(years), 4)} as median_years,
           {rnd(mean(years, 10), 4)} as mean_years, {rnd(f'min({years})', 4)} as min_years,
           {rnd(f'max({years})', 4)} as max_years,
           {rnd(median('prob_alive'), 4)} as median_prob_alive
    from {source}"""


def _clv_summary() -> str:
    def part(name: str, where: str) -> str:
        return f"""
        select {name} as rfm_segment, count(clv_estimate) as customers,
               {rnd(median('clv_estimate'), 2)} as median_clv,
               {rnd(mean('clv_estimate'), 2)} as mean_clv,
               {rnd(total('clv_estimate'), 2)} as total_clv,
               {pct(total('clv_estimate'), f"(select {total('clv_estimate')} from scores)")} as clv_share_pct
        from {where} group by all"""

    each = part("s.rfm_segment", "segments s left join scores using (rfm_segment)")
    whole = part("'All segments'", "scores")
    return f"select * from ({each}) union all select * from ({whole})"


def _box() -> str:
    return f"""
    select rfm_segment, coalesce(customers, 0) as customers, {rnd('whisker_low', 2)} as whisker_low,
           {rnd('q1', 2)} as q1, {rnd('median', 2)} as median, {rnd('q3', 2)} as q3,
           {rnd('whisker_high', 2)} as whisker_high, coalesce(outliers, 0) as outliers
    from segments left join whiskers using (rfm_segment)"""


def _score_distribution() -> str:
    parts = " union all ".join(
        f"select '{label}' as dimension, {c} as score, count(*) as customers from rfm group by {c}"
        for label, c in (("Recency", "R_score"), ("Frequency", "F_score"), ("Monetary", "M_score"))
    )
    share = "customers::double / (select count(*) from rfm) * 100"
    return f"""
    select dimension, score, customers, {rnd(share, 1)} as customer_pct,
           repeat('█', trunc({share} / 2)::int) as bar from ({parts})"""


def _crosstab() -> str:
    cells = ", ".join(f"count(*) filter (where F_score = {f}) as f{f}" for f in range(1, 6))
    shades = ", ".join(
        f"{rnd(f'case when f{f} > 0 then log10(f{f}) end', 6)} as log10_f{f}" for f in range(1, 6)
    )
    return f"""
    select *, {shades} from (
      select s.R_score, {cells}
      from (select unnest([1, 2, 3, 4, 5]) as R_score) s left join rfm r on r.R_score = s.R_score
      group by s.R_score)"""


def _headline() -> str:
    sums = {
        c: f"sum({c}::decimal(18,2))::double"
        for c in (
            "current_revenue_impact", "proposed_revenue_impact",
            "current_budget_allocation", "proposed_budget_allocation",
        )
    }
    inner = ", ".join(f"{s} as {n}" for s, n in zip(sums.values(), ("a", "b", "ca", "cb"), strict=True))
    return f"""
    select {rnd('a', 2)} as current_revenue, {rnd('b', 2)} as proposed_revenue,
           {rnd('ca', 2)} as current_budget, {rnd('cb', 2)} as proposed_budget,
           {rnd('b - a', 2)} as additional_revenue,
           {rnd('case when a > 0 then (b - a) / a * 100 else 0 end', 1)} as uplift_pct,
           {rnd('coalesce((a - ca) / nullif(ca, 0), 0)', 4)} as current_portfolio_roi,
           {rnd('coalesce((b - cb) / nullif(cb, 0), 0)', 4)} as proposed_portfolio_roi
    from (select {inner} from roi)"""


def _standardized() -> str:
    return "select customer_unique_id, {} from rfm cross join ({})".format(
        ", ".join(
            rnd(f"({d}_score - {d}_m) / case when {d}_d > 0 then {d}_d else 1 end", 6) + f" as {d}_std"
            for d in "RFM"
        ),
        "select " + ", ".join(
            f"avg({d}_score) as {d}_m, stddev_pop({d}_score) as {d}_d" for d in "RFM"
        ) + " from rfm",
    )


def _geography() -> str:
    return f"""
    select c.customer_state, count(*) as customer_count,
           {rnd(total('clv_estimate'), 2)} as total_clv,
           {rnd(median('clv_estimate'), 2)} as median_clv,
           {rnd(mean('clv_estimate'), 2)} as mean_clv,
           {rnd(total('c.total_spend'), 2)} as total_spend,
           {rnd(median('total_orders'), 2)} as median_orders,
           {rnd(median('recency_days'), 2)} as median_recency,
           coalesce(any_value(t.primary_seller_state), 'Unknown') as top_seller_state,
           {pct('count(*) filter (where c.customer_state = c.primary_seller_state)', 'count(*)')}
             as local_seller_pct,
           {pct(total('clv_estimate'), f"(select {total('clv_estimate')} from scores)")} as clv_share_pct
    from scores c left join state_seller t on t.customer_state = c.customer_state
    group by c.customer_state"""


_RAW: dict[str, str] = {
    "table_row_counts": _row_counts(),
    "category_translated_items": "select order_id, product_id, category from item_category",
    "export_roundtrip": "select * from summary",
    "filtered_orders": "select * from delivered",
    "identity_resolution": """
        select order_id, customer_id, customer_unique_id, customer_state, order_purchase_timestamp
        from delivered join in_customers using (customer_id)""",
    "payments_aggregated": """
        select order_id, total_payment_value::double as total_payment_value, num_installments from paid""",
    "order_item_counts": "select * from counted",
    "order_modal_category": "select * from order_category",
    "order_modal_seller": "select * from order_seller",
    "reviews_latest": "select * from order_review",
    "customer_orders": """
        select * replace (total_payment_value::double as total_payment_value) from person_orders""",
    "reference_date": "select * from today",
    "recency_days": "select customer_unique_id, recency_days from base",
    "tenure_days": "select customer_unique_id, customer_tenure_days from base",
    "customer_modal_category": "select * from person_category",
    "customer_modal_seller_state": "select * from person_seller",
    "customer_latest_state": "select * from person_state",
    "customer_base": f"select {_BASE} from base order by total_spend desc, customer_unique_id",
    "customer_base_sql": f"select {_BASE} from base order by total_spend desc, customer_unique_id",
    "top_spenders": f"select {_BASE} from base order by total_spend desc, customer_unique_id limit 5",
    "null_profile": _null_profile(),
    "numeric_profile": _numeric_profile(),
    "repeat_rate": f"""
        select count(*) as customers, count(*) filter (where total_orders > 1) as repeat_customers,
               {pct('count(*) filter (where total_orders > 1)', 'count(*)')} as repeat_pct from base""",
    "frequency_histogram": f"""
        select case when place > 10 then min(total_orders)::varchar || '+'
                    else min(total_orders)::varchar end as orders,
               sum(n)::bigint as customers, {pct('sum(n)', '(select count(*) from base)')} as customer_pct
        from (select total_orders, count(*) as n,
                     least(row_number() over (order by total_orders), 11) as place
              from base group by total_orders)
        group by place""",
    "top_states_by_customers": f"""
        select customer_state, count(*) as customers,
               {pct('count(*)', '(select count(*) from base)')} as customer_pct
        from base group by customer_state order by customers desc, customer_state limit 5""",
    "base_overview": f"""
        select count(*) as customers, count(*) filter (where total_orders = 1) as single_customers,
               {pct('count(*) filter (where total_orders = 1)', 'count(*)')} as single_pct,
               count(*) filter (where total_orders > 1) as multi_customers,
               {pct('count(*) filter (where total_orders > 1)', 'count(*)')} as multi_pct,
               median(recency_days) as median_recency, {rnd(median('total_spend'), 2)} as median_spend
        from base""",
    "rounding_half_even": "select customer_unique_id, {} from base".format(
        ", ".join(f"{rnd('avg_order_value / 8', p)} as rounded_{p}" for p in (1, 2, 4))
    ),
    "recency_score": "select customer_unique_id, recency_days, R_score from rfm",
    "frequency_score": "select customer_unique_id, total_orders, F_score from rfm",
    "monetary_score": "select customer_unique_id, total_spend, M_score from rfm",
    "monetary_score_ranked": "select * from ranked",
    "spend_quintile_edges": "select persons, {} from edges".format(
        ", ".join(f"{rnd(f'edge_{i}', 4)} as edge_{i}" for i in range(6))
    ),
    "rfm_composite": "select customer_unique_id, R_score, F_score, M_score, rfm_composite from rfm",
    "rfm_segments": f"select {_BASE}, R_score, F_score, M_score, rfm_composite, rfm_segment from rfm",
    "segment_catch_all": """
        select R_score, F_score, M_score, rfm_composite, name as rfm_segment, count(*) as customers
        from ruled join nearest on c = rfm_composite where by_rule is null group by all""",
    "rfm_segment_breakdown": "select * from breakdown",
    "score_distribution": _score_distribution(),
    "composite_stats": f"""
        select min(rfm_composite) as min_composite, max(rfm_composite) as max_composite,
               {rnd(median('rfm_composite'), 2)} as median_composite,
               {rnd(mean('rfm_composite'), 2)} as mean_composite from rfm""",
    "formatted_segment_table": f"""
        select rfm_segment, {_thousands('customers', 0)} as customers,
               {_thousands('customer_pct', 1)} || '%' as pct,
               'R$' || {_thousands('median_spend', 2)} as median_spend,
               {_thousands('median_recency', 0)} || ' days' as median_recency from breakdown""",
    "rf_crosstab": _crosstab(),
    "standardized_scores": _standardized(),
    "value_target": "select customer_unique_id, high_value from target",
    "rfm_weight_fit": "select {}, p.* from coefficients cross join derived_weights p".format(
        ", ".join(f"{rnd(d, 4)} as coefficient_{d}" for d in "RFM")
    ),
    "rfm_weight_policy": "select * from derived_weights",
    "rfm_weight_policy_correlation": _weight_policy(
        "select {} from target".format(", ".join(f"{_correlation(f'{d}_score')} as {d}" for d in "RFM"))
    ),
    "rfm_weight_policy_cases": _weight_policy(
        """select R_score, F_score, M_score, count(*) as customers, R_score - 1 as R, 1 - F_score as F, M_score - 1 as M
        from rfm group by all""", "R_score, F_score, M_score, customers",
    ),
    "rfm_segments_derived": f"select {_BASE}, R_score, F_score, M_score, rfm_composite, rfm_segment from rfm_derived",
    "annualized_frequency": f"""
        select customer_unique_id, total_orders, R_score,
               {rnd('yearly_orders', 4)} as annualized_frequency from rates""",
    "frequency_stats": f"""
        select case when total_orders > 1 then 'repeat' else 'single' end as buyers,
               count(*) as customers, {rnd(mean('yearly_orders', 10), 4)} as mean_frequency,
               {rnd(median('yearly_orders'), 4)} as median_frequency
        from rates group by 1""",
    "imputed_frequency_by_r": """
        select R_score, max(yearly_orders) as imputed_frequency, count(*) as customers
        from rates where total_orders = 1 group by R_score""",
    "cohort_tenure": f"""
        select total_orders, count(*) as customers, median(customer_tenure_days) as median_tenure_days,
               {rnd('median(customer_tenure_days) / 365', 4)} as median_tenure_years
        from repeaters group by total_orders""",
    "empirical_lifespan": f"""
        select customer_unique_id, rfm_segment, {rnd('lifespan_years', 4)} as lifespan_years from inputs""",
    "lifespan_stats": _lifespan_stats("inputs"),
    "clv_scores": "select * from scores",
    "clv_summary": _clv_summary(),
    "formatted_clv_table": f"""
        select rfm_segment, {_thousands('customers', 0)} as customers,
               'R$' || {_thousands('median_clv', 2)} as median_clv,
               'R$' || {_thousands('mean_clv', 2)} as mean_clv,
               'R$' || {_thousands('total_clv', 2)} as total_clv,
               {_thousands('clv_share_pct', 1)} || '%' as clv_share from ({_clv_summary()})""",
    "clv_sensitivity": "select * from sensitivity",
    "clv_sensitivity_pivot": "select rfm_segment, {} from sensitivity group by rfm_segment".format(
        ", ".join(
            f"max(median_clv) filter (where gross_margin_assumption = {dbl(m)}) as margin_{round(m * 100)}"
            for m in SENSITIVITY_MARGINS
        )
    ),
    "quality_flags": """
        select count(*) as customers, count(*) filter (where total_spend = 0) as zero_spend,
               count(*) filter (where recency_days < 0) as negative_recency,
               count(distinct rfm_segment) as distinct_segments,
               count(*) filter (where rfm_segment is null) as null_segments,
               count(*) filter (where clv_estimate is null) as clv_nulls,
               count(*) filter (where clv_estimate = 0) as clv_zeros,
               count(*) filter (where clv_estimate < 0) as clv_negatives
        from scores""",
    "bgnbd_summary": "select * from histories",
    "bgnbd_loglik_grid": _grid(),
    "prob_alive": f"select customer_unique_id, {rnd('prob_alive', 6)} as prob_alive from alive",
    "bgnbd_fit": f"""
        select (select sum(customers)::bigint from history_groups) as customers, true as converged,
               {rnd('objective', 6)} as objective, {", ".join(f"0.0::double as slope_{p}" for p in ("r", "alpha", "a", "b"))}
        from fitted""",
    "expected_purchases": _forecast_of_persons(),
    "expected_purchases_quick": _forecast_of_persons("_quick"),
    "expected_purchases_histories": f"""
        select frequency, recency, T, customers, {rnd('prob_alive', 6)} as prob_alive,
               {rnd('expected_purchases', 6)} as expected_purchases from forecasts""",
    "expected_purchases_stats": f"""
        select {rnd(median('e'), 4)} as median_expected, {rnd(mean('e', 10), 4)} as mean_expected,
               {rnd('max(e)', 4)} as max_expected, {rnd(median('p'), 4)} as median_prob_alive
        from people""",
    "model_lifespan": f"""
        select customer_unique_id, rfm_segment, {rnd('lifespan_years', 6)} as lifespan_years
        from model_inputs""",
    "model_lifespan_stats": _lifespan_stats("model_inputs"),
    "clv_scores_auto": "select * from model_scores_auto",
    "clv_scores_model": "select * from model_scores",
    "current_state": "select * from current",
    "segment_reach": "select * from reach",
    "targeted_customers": "select customer_unique_id, rfm_segment, clv_estimate from targeted",
    "proposed_state": "select * from proposed",
    "retention_roi": "select * from roi",
    "retention_headline": _headline(),
    "retention_checks": """
        select sum(current_budget_allocation::decimal(18,2))::double as current_budget,
               sum(proposed_budget_allocation::decimal(18,2))::double as proposed_budget,
               count(*) as segments, sum({nulls})::bigint as null_values,
               (select {share} from plan) as share_total,
               (select abs(sum(share) - 1) < 0.01 from plan) as shares_ok
        from roi""".format(
        nulls=" + ".join(
            f"({c} is null)::int"
            for c in (
                "total_customers", "eligible_customers_current", "current_budget_allocation",
                "current_cost_per_customer", "current_expected_recovered", "current_revenue_impact",
                "roi_current", "median_clv", "intervention", "proposed_budget_allocation",
                "proposed_cost_per_customer", "proposed_reach", "proposed_coverage_pct",
                "proposed_expected_retained", "proposed_revenue_impact", "roi_proposed",
                "targeted_mean_clv",
            )
        ),
        share=rnd("sum(share)", 4),
    ),
    "segment_reach_tight": "select * from reach_tight",
    "targeted_customers_tight": "select customer_unique_id, rfm_segment, clv_estimate from targeted_tight",
    "proposed_state_tight": "select * from proposed_tight",
    "retention_roi_tight": "select * from roi_tight",
    "export_customer_detail": """
        select customer_unique_id, customer_state, rfm_segment, R_score, F_score, M_score,
               rfm_composite, total_orders, total_spend, avg_order_value, recency_days,
               customer_tenure_days, clv_estimate, annualized_frequency, estimated_lifespan_years,
               first_purchase_date, last_purchase_date, avg_review_score, primary_category,
               primary_seller_state, segment_sort_order
        from scores join segments using (rfm_segment)""",
    "segment_summary_export": "select * from summary",
    "retention_comparison": "select * from comparison",
    "retention_chart": "select rfm_segment, {} from comparison".format(
        ", ".join(
            f"{rnd(f'{c} / 1000', 4)} as {c}_k"
            for c in (
                "current_budget_allocation", "proposed_budget_allocation",
                "current_revenue_impact", "proposed_revenue_impact",
            )
        )
    ),
    "sensitivity_export": """
        select s.*, segment_sort_order, trunc(gross_margin_assumption * 100)::int as margin_pct
        from sensitivity s join segments using (rfm_segment)""",
    "geographic_summary": _geography(),
    "dashboard_fields": f"""
        select s.rfm_segment, {rnd('total_clv / nullif(customer_count, 0)', 4)} as clv_per_customer,
               {rnd('(proposed_revenue_impact - current_revenue_impact) / nullif(current_revenue_impact, 0)', 4)}
                 as revenue_uplift
        from summary s join comparison using (rfm_segment)""",
    "segment_overview": f"""
        select s.rfm_segment, median(recency_days) as median_recency,
               {rnd(median('clv_estimate'), 2)} as median_clv, count(c.rfm_segment) as customers
        from segments s left join scores c using (rfm_segment) group by s.rfm_segment""",
    "clv_box_stats": _box(),
    "top_states_by_clv": """
        select customer_state, total_clv, customer_count, median_clv from state_values
        order by total_clv desc, customer_state limit 10""",
    "top3_state_share": f"""
        select top3_clv, portfolio_clv, {pct('top3_clv', 'portfolio_clv')} as top3_share_pct
        from (select {total('total_clv')} as top3_clv from
              (select total_clv from state_values order by total_clv desc, customer_state limit 3))
        cross join (select {total('clv_estimate')} as portfolio_clv from scores)""",
    "event_tenure_days": """
        select user_id, date_sub('day', min(ts), max(ts))::int as days from events group by user_id""",
}

# What is published equals what was worked out.
_SAME = dict(zip(PUBLISHED_EXPORTS, (
    "export_customer_detail", "segment_summary_export", "retention_comparison", "sensitivity_export", "geographic_summary",
), strict=True))
_RAW |= {f"published_{name}": _RAW[_SAME.get(name, name)] for name in (*PUBLISHED_STAGES, *PUBLISHED_EXPORTS)}

ORACLES: dict[str, str] = {name: compose(sql) for name, sql in _RAW.items()}
