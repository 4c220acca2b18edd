"""The registered queries as plain SQL over the same files, for comparison.

Written for DuckDB.  The shop tables are common table expressions; each query states
the definition of its result directly (multi-way distinct counts, single windows, ...)
rather than the way the Spark operators compute it.
"""

from __future__ import annotations

from footfall.fixed_values import SEGMENT_ACTIONS, SRM_BROKEN, SRM_PASS

EVENTS = """
shop_events AS (
    SELECT event_id AS id,
           CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
           ts AS created_at,
           CASE WHEN event_type = 'signup' THEN 'home'
                WHEN event_type = 'view' AND value < 25 THEN 'department'
                WHEN event_type = 'view' THEN 'product'
                WHEN event_type = 'click' THEN 'cart'
                WHEN event_type = 'purchase' THEN 'purchase'
                ELSE 'cancel' END AS event_type,
           CASE WHEN event_type NOT IN ('view', 'error') THEN user_id END AS user_id,
           user_id AS visitor_id,
           'source-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS traffic_source,
           'browser-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) AS browser,
           value, props
    FROM events)"""

ORDERS = """
shop_orders AS (
    SELECT o_orderkey AS order_id, o_custkey AS user_id,
           o_orderstatus AS status,
           o_orderdate AS created_at, o_orderpriority AS priority
    FROM orders)"""

ITEMS = """
shop_items AS (
    SELECT l_orderkey AS order_id,
           CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sale_price
    FROM lineitem)"""

USERS = """
shop_users AS (
    SELECT c_custkey AS id, c_mktsegment AS market, first_order AS created_at
    FROM customer
    LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey)
      ON c_custkey = o_custkey)"""

def with_tables(*tables: str) -> str:
    return "WITH RECURSIVE " + ",".join(tables)


# Sessions


def visits(key: str, gap: str, carry: str = "id, event_type, created_at") -> str:
    """Sessions by inactivity, as table ``visits``."""
    return f"""
gaps AS (
    SELECT {carry}, {key},
           (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 60000000.0 AS mins_since_last_event
    FROM shop_events WHERE {key} IS NOT NULL
    WINDOW w AS (PARTITION BY {key} ORDER BY created_at, id)),
flagged AS (
    SELECT *, CASE WHEN mins_since_last_event <= {gap} THEN 0 ELSE 1 END AS is_new_session FROM gaps),
visits AS (
    SELECT *, CAST(sum(is_new_session) OVER (PARTITION BY {key} ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_sequence
    FROM flagged)"""


HALF_HOUR = "30"
HALF_DAY = "720"


def funnel_of(source: str, keys: str) -> str:
    """One row per session, as table ``funnel``."""
    return f"""
flags AS (
    SELECT {keys}, min(created_at) AS session_start, count(*) AS total_events,
           max(CASE WHEN event_type = 'home' THEN 1 ELSE 0 END) AS reached_home,
           max(CASE WHEN event_type = 'department' THEN 1 ELSE 0 END) AS reached_department,
           max(CASE WHEN event_type = 'product' THEN 1 ELSE 0 END) AS reached_product,
           max(CASE WHEN event_type = 'cart' THEN 1 ELSE 0 END) AS reached_cart,
           max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS reached_purchase
    FROM {source} GROUP BY {keys}),
funnel AS (
    SELECT *, CASE WHEN reached_purchase = 1 THEN 'Completed Purchase'
                   WHEN reached_cart = 1 THEN 'Abandoned at Checkout'
                   WHEN reached_product = 1 THEN 'Abandoned at Cart'
                   WHEN reached_department = 1 THEN 'Abandoned at Product'
                   WHEN reached_home = 1 THEN 'Abandoned at Department'
                   ELSE 'Bounced Immediately' END AS abandonment_stage
    FROM flags)"""


FUNNEL = with_tables(EVENTS, funnel_of("shop_events", "session_id"))

# Retention

COHORTS = """
joined AS (
    SELECT user_id, CAST(date_trunc('month', min(created_at)) AS DATE) AS cohort_month
    FROM shop_orders GROUP BY user_id),
placed AS (
    SELECT o.user_id, j.cohort_month,
           datediff('month', j.cohort_month, CAST(date_trunc('month', o.created_at) AS DATE)) AS k
    FROM shop_orders o JOIN joined j ON o.user_id = j.user_id
    WHERE o.status IN ('F', 'O')),
cohorts AS (
    SELECT cohort_month,
           count(DISTINCT CASE WHEN k = 0 THEN user_id END) AS m0,
           count(DISTINCT CASE WHEN k = 1 THEN user_id END) AS m1,
           count(DISTINCT CASE WHEN k = 2 THEN user_id END) AS m2,
           count(DISTINCT CASE WHEN k = 3 THEN user_id END) AS m3,
           count(DISTINCT CASE WHEN k = 6 THEN user_id END) AS m6
    FROM placed GROUP BY cohort_month)"""


def rates(digits: int) -> str:
    """The cohort table with rates, as table ``rates``."""
    columns = ", ".join(
        f"round_even(CAST(m{k} AS DOUBLE) / nullif(m0, 0) * 100, {digits}) AS m{k}_rate" for k in (1, 2, 3, 6)
    )
    return f"""
rates AS (
    SELECT *, {columns}, strftime(cohort_month, '%Y-%m') AS cohort_label FROM cohorts)"""


REVENUE = """
months AS (
    SELECT CAST(date_trunc('month', o.created_at) AS DATE) AS month,
           CAST(sum(i.sale_price) AS DOUBLE) AS revenue
    FROM shop_orders o JOIN shop_items i ON o.order_id = i.order_id
    WHERE o.status IN ('F', 'O')
    GROUP BY 1),
revenue AS (
    SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_month_revenue,
           round((revenue - lag(revenue) OVER (ORDER BY month))
                 / nullif(lag(revenue) OVER (ORDER BY month), 0) * 100, 2) AS mom_growth_pct
    FROM months WHERE month < DATE '2001-08-01')"""

# Customer scores

RFM = """
sold AS (
    SELECT o.user_id, o.created_at, i.sale_price
    FROM shop_orders o JOIN shop_items i ON o.order_id = i.order_id
    WHERE o.status IN ('F', 'O')),
rfm AS (
    SELECT user_id,
           datediff('day', CAST(max(created_at) AS DATE),
                    (SELECT CAST(max(created_at) AS DATE) FROM sold)) AS recency_days,
           count(DISTINCT CAST(created_at AS DATE)) AS frequency,
           CAST(round(sum(sale_price), 2) AS DOUBLE) AS monetary_value
    FROM sold GROUP BY user_id)"""

SCORES = """
scores AS (
    SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, user_id) AS r_score,
           ntile(5) OVER (ORDER BY frequency, user_id) AS f_score,
           ntile(5) OVER (ORDER BY monetary_value, user_id) AS m_score
    FROM rfm)"""

CUSTOMERS = with_tables(ORDERS, ITEMS, RFM, SCORES)

QUADRANTS = """
quadrants AS (
    SELECT *, CASE WHEN r_score > 3 THEN 2 ELSE 0 END + CASE WHEN m_score > 3 THEN 1 ELSE 0 END AS segment
    FROM scores),
profiles AS (
    SELECT segment, round_even(avg(recency_days), 1) AS recency, round_even(avg(frequency), 1) AS frequency,
           round_even(CAST(sum(CAST(monetary_value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 1) AS monetary,
           count(user_id) AS count
    FROM quadrants GROUP BY segment),
labelled AS (
    SELECT p.*, CASE WHEN recency < mr AND monetary >= mm THEN 'Champions'
                     WHEN recency < mr THEN 'Promising'
                     WHEN monetary >= mm THEN 'At Risk'
                     ELSE 'Lost' END AS label
    FROM profiles p,
         (SELECT median(recency) AS mr, median(monetary) AS mm FROM profiles)),
customers AS (
    SELECT q.*, l.label FROM quadrants q JOIN labelled l ON q.segment = l.segment)"""

SEGMENTS = CUSTOMERS + "," + QUADRANTS

QUARTILES = """
quartiles AS (
    SELECT 'recency_days' AS feature, quantile_cont(CAST(recency_days AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM rfm
    UNION ALL
    SELECT 'frequency', quantile_cont(CAST(frequency AS DOUBLE), [0.25, 0.5, 0.75]) FROM rfm
    UNION ALL
    SELECT 'monetary_value', quantile_cont(monetary_value, [0.25, 0.5, 0.75]) FROM rfm),
parameters AS (
    SELECT feature, q[2] AS center, CASE WHEN q[3] = q[1] THEN 1.0 ELSE q[3] - q[1] END AS scale
    FROM quartiles)"""

# Experiments

SUMMARY = """
assigned AS (
    SELECT id AS user_id, market,
           CASE WHEN CAST(created_at AS DATE) < DATE '1995-06-01' THEN 'control' ELSE 'treatment' END
               AS experiment_group
    FROM shop_users),
converted AS (
    SELECT a.user_id, a.market, a.experiment_group,
           max(CASE WHEN o.status IN ('F', 'O') THEN 1 ELSE 0 END) AS bought
    FROM assigned a
    LEFT JOIN (SELECT * FROM shop_orders WHERE priority = '1-URGENT') o ON a.user_id = o.user_id
    GROUP BY ALL),
arms AS (
    SELECT market,
           count(*) FILTER (experiment_group = 'control') AS n_c,
           coalesce(sum(bought) FILTER (experiment_group = 'control'), 0) AS x_c,
           count(*) FILTER (experiment_group = 'treatment') AS n_t,
           coalesce(sum(bought) FILTER (experiment_group = 'treatment'), 0) AS x_t
    FROM converted GROUP BY market)"""

EXPERIMENT = with_tables(ORDERS, USERS, SUMMARY)


def summary(keys: str) -> str:
    return f"""{EXPERIMENT}
SELECT {keys} experiment_group, count(*) AS total_users, CAST(sum(bought) AS BIGINT) AS conversions,
       round(avg(bought) * 100, 4) AS conversion_rate_pct
FROM converted GROUP BY {keys} experiment_group"""


def phi(z: str) -> str:
    """Normal distribution function: 1/2 + pdf(z) * sum of z^(2k+1) / (2k+1)!!."""
    log_term = f"(2*k + 1) * ln(abs({z})) - (lgamma(2*k + 2) - k * ln(2) - lgamma(k + 1))"
    series = f"list_sum(list_transform(range(0, 120), lambda k: exp({log_term})))"
    return f"""CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 WHEN {z} = 0 THEN 0.5
        ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series} END"""


Z_975 = "1.9599639845400545"
Z_80 = "0.8416212335729143"

SRM = f"""
srm_raw AS (
    SELECT market, n_c, n_t,
           ((n_c - (n_c + n_t) * 0.5e0) ^ 2 + (n_t - (n_c + n_t) * 0.5e0) ^ 2) / ((n_c + n_t) * 0.5e0) AS chi2
    FROM arms),
srm_p AS (SELECT *, 2 * (1 - ({phi("sqrt(chi2)")})) AS p FROM srm_raw),
srm AS (
    SELECT market, n_c AS n_control, n_t AS n_treatment, round_even(chi2, 4) AS chi2_stat,
           round_even(p, 6) AS p_value, p < 0.05 AS srm_detected,
           CASE WHEN p < 0.05 THEN '{SRM_BROKEN}' ELSE '{SRM_PASS}' END AS verdict
    FROM srm_p)"""

ZTEST = f"""
z_rates AS (
    SELECT *, x_c::DOUBLE / n_c AS pc, x_t::DOUBLE / n_t AS pt, (x_c + x_t)::DOUBLE / (n_c + n_t) AS pp FROM arms),
z_stats AS (
    SELECT *, pt - pc AS lift, (pt - pc) / sqrt(pp * (1 - pp) * (1.0e0 / n_c + 1.0e0 / n_t)) AS z,
           {Z_975} * sqrt(pc * (1 - pc) / n_c + pt * (1 - pt) / n_t) AS reach
    FROM z_rates),
z_p AS (SELECT *, 2 * (1 - ({phi("abs(z)")})) AS p, lift - reach AS low, lift + reach AS high FROM z_stats),
ztest AS (
    SELECT market, round_even(pc, 6) AS p_control, round_even(pt, 6) AS p_treatment,
           round_even(lift, 6) AS absolute_lift, round_even(lift / pc * 100, 2) AS relative_lift_pct,
           round_even(z, 4) AS z_stat, round_even(p, 6) AS p_value,
           round_even(low, 6) AS ci_lower, round_even(high, 6) AS ci_upper,
           p < 0.05 AND low > 0 AS significant, p < 0.05 AND high < 0 AS significant_negative
    FROM z_p)"""


def power(mdes: str, slices: str = "1") -> str:
    """Sample sizes by bisection, as table ``power``; alpha is divided by the number of ``slices``."""
    shift = "abs(h) * sqrt((low + high) / 4)"
    reached = f"({phi(f'({shift} - z)')}) + ({phi(f'(-({shift}) - z)')})"
    return f"""
level AS (SELECT 0.05::DOUBLE / {slices} AS alpha),
search AS (
    SELECT 0 AS step, 0.0::DOUBLE AS low, 8.0::DOUBLE AS high
    UNION ALL
    SELECT step + 1, CASE WHEN cdf < 1 - alpha / 2 THEN (low + high) / 2 ELSE low END,
           CASE WHEN cdf < 1 - alpha / 2 THEN high ELSE (low + high) / 2 END
    FROM (SELECT *, {phi("((low + high) / 2)")} AS cdf FROM search, level WHERE step < 60)),
critical AS (SELECT alpha, high AS z FROM search, level WHERE step = 60),
plans AS (
    SELECT market, x_c::DOUBLE / n_c AS p0, mde::DOUBLE AS mde, x_c::DOUBLE / n_c + mde::DOUBLE AS p1
    FROM arms, (SELECT unnest({mdes}) AS mde)),
effects AS (
    SELECT *, CASE WHEN p1 BETWEEN 0 AND 1 THEN 2 * asin(sqrt(p0)) - 2 * asin(sqrt(p1)) END AS h FROM plans, critical),
halving AS (
    SELECT *, 0 AS step, 0.0::DOUBLE AS low, 2 * (z + {Z_80}) ^ 2 / h ^ 2 AS high FROM effects
    UNION ALL
    SELECT market, p0, mde, p1, alpha, z, h, step + 1,
           CASE WHEN enough >= 0.8 THEN low ELSE (low + high) / 2 END,
           CASE WHEN enough >= 0.8 THEN (low + high) / 2 ELSE high END
    FROM (SELECT *, {reached} AS enough FROM halving WHERE step < 60)),
power AS (
    SELECT market, p0 AS baseline_rate, p1 AS treatment_rate, mde, round_even(h, 4) AS effect_size_h,
           CAST(round_even(high, 0) AS BIGINT) AS n_per_group,
           2 * CAST(round_even(high, 0) AS BIGINT) AS n_total,
           alpha, 0.8::DOUBLE AS power
    FROM halving WHERE step = 60)"""


def decision(keys: str) -> str:
    return f"""
SELECT {keys}
       CASE WHEN srm_detected THEN 'BLOCKED'
            WHEN coalesce(least(n_control, n_treatment) < n_per_group, TRUE) THEN 'INCONCLUSIVE'
            WHEN significant AND absolute_lift > 0 THEN 'SHIP'
            WHEN significant_negative AND absolute_lift < 0 THEN 'ABORT'
            ELSE 'INCONCLUSIVE' END AS decision,
       CASE WHEN srm_detected THEN 'arm sizes do not match the design'
            WHEN coalesce(least(n_control, n_treatment) < n_per_group, TRUE)
                THEN 'fewer users per arm than required'
            WHEN significant AND absolute_lift > 0 THEN 'significant gain over control'
            WHEN significant_negative AND absolute_lift < 0 THEN 'significant loss against control'
            ELSE 'no reliable difference between the arms' END AS reason,
       n_per_group AS required_users, CAST(least(n_control, n_treatment) AS BIGINT) AS smaller_arm,
       absolute_lift, ztest.p_value AS p_value, 0.05::DOUBLE AS alpha
FROM srm JOIN ztest USING (market) JOIN power USING (market)"""


# All markets as one experiment.
OVERALL = EXPERIMENT.replace("SELECT market,\n           count(*) FILTER", "SELECT '' AS market,\n           count(*) FILTER").replace(
    "FROM converted GROUP BY market)", "FROM converted)"
)

ORACLE_SQL: dict[str, str] = {
    # Profiles
    "table_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}"
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    ),
    "table_counts_from_footers": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}"
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    ),
    "order_ranges_from_footers": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(*) AS rows, CAST(min({name}) AS VARCHAR) AS smallest, "
        f"CAST(max({name}) AS VARCHAR) AS largest FROM orders"
        for name in ("o_orderkey", "o_custkey")
    ),
    "event_type_stats_from_sketches": f"""{with_tables(EVENTS)}
SELECT event_type, count(*) AS total_events, TRUE AS sessions_close, TRUE AS users_close
FROM shop_events GROUP BY event_type""",
    "monthly_revenue_bucketed": f"{with_tables(ORDERS, ITEMS, REVENUE)} SELECT * FROM revenue",
    "events_preview": f"""{with_tables(EVENTS)}
SELECT id, session_id, created_at, event_type, user_id, visitor_id, '/' || event_type AS uri,
       traffic_source, browser, value, props
FROM shop_events ORDER BY id LIMIT 5""",
    "event_type_counts": f"""{with_tables(EVENTS)}
SELECT event_type, count(*) AS count FROM shop_events GROUP BY event_type""",
    "order_status_counts": f"""{with_tables(ORDERS)}
SELECT status, count(*) AS count FROM shop_orders GROUP BY status""",
    "null_rates": f"""{with_tables(EVENTS)}
SELECT round(count(*) FILTER (user_id IS NULL) / count(*)::DOUBLE * 100, 2) AS user_id_null_pct,
       round(count(*) FILTER (session_id IS NULL) / count(*)::DOUBLE * 100, 2) AS session_id_null_pct,
       round(count(*) FILTER (created_at IS NULL) / count(*)::DOUBLE * 100, 2) AS created_at_null_pct,
       round(count(*) FILTER (event_type IS NULL) / count(*)::DOUBLE * 100, 2) AS event_type_null_pct,
       round(count(*) FILTER ('/' || event_type IS NULL) / count(*)::DOUBLE * 100, 2) AS uri_null_pct
FROM shop_events""",
    "order_time_range": f"""{with_tables(ORDERS)}
SELECT min(created_at) AS earliest_order, max(created_at) AS latest_order FROM shop_orders""",
    "event_type_stats": f"""{with_tables(EVENTS)}
SELECT event_type, count(*) AS total_events, count(DISTINCT session_id) AS sessions_with_this_event,
       count(DISTINCT user_id) AS unique_users
FROM shop_events GROUP BY event_type""",
    "user_type_share": f"""{with_tables(EVENTS)}
SELECT CASE WHEN user_id IS NULL THEN 'anonymous' ELSE 'authenticated' END AS user_type,
       count(*) AS event_count,
       round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct_of_total
FROM shop_events GROUP BY 1""",
    "top_users": f"""{with_tables(EVENTS)}
SELECT user_id, count(*) AS event_count, min(created_at) AS first_event, max(created_at) AS last_event
FROM shop_events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY event_count DESC, user_id LIMIT 10""",
    # Sessions and identity
    "sessionize": f"{with_tables(EVENTS, visits('visitor_id', HALF_HOUR))} SELECT * FROM visits",
    "sessionize_authenticated": f"{with_tables(EVENTS, visits('user_id', HALF_DAY))} SELECT * FROM visits",
    "sessionize_hot_users": f"{with_tables(EVENTS, visits('visitor_id', HALF_DAY))} SELECT * FROM visits",
    "session_summary": f"""{with_tables(EVENTS, visits('visitor_id', HALF_HOUR))}
SELECT visitor_id, max(session_sequence) AS sessions, CAST(sum(is_new_session) AS BIGINT) AS boundaries,
       count(*) AS events
FROM visits GROUP BY visitor_id""",
    "sessionize_streaming": f"""{with_tables(EVENTS, visits('visitor_id', HALF_DAY))}
SELECT visitor_id AS user_id, min(created_at) AS session_start, max(created_at) AS session_end, count(*) AS events
FROM visits GROUP BY visitor_id, session_sequence""",
    "resolve_identity": f"""{with_tables(EVENTS)}
SELECT raw_session_id, resolved_user_id, raw_user_id, event_type, created_at, traffic_source, browser, uri,
       CASE WHEN raw_user_id IS NOT NULL THEN 'authenticated'
            WHEN resolved_user_id IS NOT NULL THEN 'anonymous resolved'
            ELSE 'anonymous unresolved' END AS resolution_status
FROM (SELECT session_id AS raw_session_id, user_id AS raw_user_id, event_type, created_at,
             traffic_source, browser, '/' || event_type AS uri,
             first_value(user_id IGNORE NULLS) OVER (
                 PARTITION BY session_id ORDER BY created_at, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS resolved_user_id
      FROM shop_events)""",
    "mixed_sessions": f"""{with_tables(EVENTS)}
SELECT session_id, count(*) FILTER (user_id IS NULL) AS anonymous_events,
       count(*) FILTER (user_id IS NOT NULL) AS authenticated_events, max(user_id) AS authenticated_user_id
FROM shop_events GROUP BY session_id
HAVING anonymous_events > 0 AND authenticated_events > 0
ORDER BY anonymous_events DESC, session_id LIMIT 10""",
    "session_identity_audit": f"""{with_tables(EVENTS)}
SELECT session_id, count(DISTINCT user_id) AS distinct_user_ids,
       count(*) FILTER (user_id IS NULL) AS null_count, count(*) FILTER (user_id IS NOT NULL) AS not_null_count
FROM shop_events GROUP BY session_id
ORDER BY not_null_count DESC, null_count DESC, session_id LIMIT 20""",
    # Funnels
    "session_funnel": f"{FUNNEL} SELECT * FROM funnel",
    "funnel_of_visits": (
        with_tables(
            EVENTS, visits("visitor_id", HALF_DAY), funnel_of("visits", "visitor_id, session_sequence")
        )
        + " SELECT * FROM funnel"
    ),
    "funnel_kpis": f"""{FUNNEL}
SELECT count(*) AS total_sessions,
       sum(reached_cart)::DOUBLE / count(*) * 100 AS reached_cart_pct,
       sum(reached_purchase)::DOUBLE / count(*) * 100 AS purchase_pct,
       sum(reached_purchase)::DOUBLE / greatest(sum(reached_cart), 1) * 100 AS cart_to_purchase_pct,
       100 - sum(reached_purchase)::DOUBLE / greatest(sum(reached_cart), 1) * 100 AS lost_cart_pct
FROM funnel""",
    "funnel_steps": f"""{FUNNEL},
steps AS (
    SELECT 1 AS step, 'Total Sessions' AS label, count(*) AS count FROM funnel UNION ALL
    SELECT 2, 'Browsed Products', sum(greatest(reached_department, reached_product)) FROM funnel UNION ALL
    SELECT 3, 'Reached Cart', sum(reached_cart) FROM funnel UNION ALL
    SELECT 4, 'Completed Purchase', sum(reached_purchase) FROM funnel)
SELECT step, label, CAST(count AS BIGINT) AS count,
       count::DOUBLE / (SELECT count(*) FROM funnel) * 100 AS pct_of_initial
FROM steps""",
    "abandonment_distribution": f"""{FUNNEL}
SELECT abandonment_stage AS stage, count(*) AS count,
       round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS pct
FROM funnel GROUP BY abandonment_stage""",
    "stage_traffic": f"{FUNNEL} "
    + " UNION ALL ".join(
        f"SELECT 'reached_{s}' AS stage, CAST(sum(reached_{s}) AS BIGINT) AS sessions, "
        f"sum(reached_{s})::DOUBLE / count(*) * 100 AS pct FROM funnel"
        for s in ("home", "department", "product", "cart", "purchase")
    ),
    # Retention and revenue
    "cohort_retention": f"{with_tables(ORDERS, COHORTS)} SELECT * FROM cohorts",
    "retention_rates": f"{with_tables(ORDERS, COHORTS, rates(1))} SELECT * FROM rates",
    "retention_rates_cached": f"{with_tables(ORDERS, COHORTS, rates(1))} SELECT * FROM rates",
    "retention_rates_two_digits": f"{with_tables(ORDERS, COHORTS, rates(2))} SELECT * FROM rates",
    "monthly_revenue": f"{with_tables(ORDERS, ITEMS, REVENUE)} SELECT * FROM revenue",
    "retention_kpis": f"""{with_tables(ORDERS, ITEMS, COHORTS, rates(1), REVENUE)}
SELECT round(avg(m1_rate), 6) AS avg_m1, round(avg(m3_rate), 6) AS avg_m3,
       (SELECT mom_growth_pct FROM revenue WHERE mom_growth_pct IS NOT NULL ORDER BY month DESC LIMIT 1)
           AS latest_mom,
       count(*) AS n_cohorts
FROM rates""",
    # Customer scores
    "rfm_base": f"{with_tables(ORDERS, ITEMS, RFM)} SELECT * FROM rfm",
    "rfm_scores": f"{CUSTOMERS} SELECT * FROM scores",
    # Experiments
    "experiment_groups": f"{EXPERIMENT} SELECT user_id, experiment_group FROM assigned",
    "experiment_summary": summary(""),
    "experiment_summary_all_orders": summary("").replace("WHERE priority = '1-URGENT'", ""),
    "experiment_summary_by_market": summary("market,"),
    "srm_check": f"{EXPERIMENT}, {SRM} SELECT * FROM srm",
    # With four degrees of freedom the tail is exp(-x/2) (1 + x/2).
    "srm_check_arms": f"""{with_tables(ORDERS, USERS)},
dealt AS (
    SELECT market, id * 37 % 100 AS b FROM shop_users),
counted AS (
    SELECT market, count(*) AS total, count(*) FILTER (b < 40) AS a0, count(*) FILTER (b BETWEEN 40 AND 59) AS a1,
           count(*) FILTER (b BETWEEN 60 AND 79) AS a2, count(*) FILTER (b BETWEEN 80 AND 89) AS a3,
           count(*) FILTER (b >= 90) AS a4
    FROM dealt GROUP BY market),
compared AS (
    SELECT *, (a0 - total * 0.4e0) ^ 2 / (total * 0.4e0) + (a1 - total * 0.2e0) ^ 2 / (total * 0.2e0)
           + (a2 - total * 0.2e0) ^ 2 / (total * 0.2e0) + (a3 - total * 0.1e0) ^ 2 / (total * 0.1e0)
           + (a4 - total * 0.1e0) ^ 2 / (total * 0.1e0) AS x
    FROM counted)
SELECT market, 5 AS arms, total AS total_users, round_even(x, 4) AS chi2_stat, 4 AS degrees,
       round_even(exp(-x / 2) * (1 + x / 2), 6) AS p_value, exp(-x / 2) * (1 + x / 2) < 0.05 AS srm_detected,
       CASE WHEN exp(-x / 2) * (1 + x / 2) < 0.05 THEN '{SRM_BROKEN}' ELSE '{SRM_PASS}' END AS verdict
FROM compared""",
    "power_table_bonferroni": f"{EXPERIMENT}, {power('[0.01, 0.02, 0.05, 0.2]', '(SELECT count(*) FROM arms)')} SELECT * FROM power",
    "proportion_ztest": f"{EXPERIMENT}, {ZTEST} SELECT * FROM ztest",
    "power_table": f"{EXPERIMENT}, {power('[0.01, 0.02, 0.05, 0.2]')} SELECT * FROM power",
    "experiment_decision": f"{EXPERIMENT}, {SRM}, {ZTEST}, {power('[0.2]')} {decision('market,')}",
    "experiment_decision_overall": f"{OVERALL}, {SRM}, {ZTEST}, {power('[0.2]')} {decision('')}",
    # Segments
    "scale_parameters": f"{with_tables(ORDERS, ITEMS, RFM, QUARTILES)} SELECT * FROM parameters",
    "robust_scale": with_tables(ORDERS, ITEMS, RFM, QUARTILES)
    + " SELECT rfm.*, "
    + ", ".join(
        f"({f} - (SELECT center FROM parameters WHERE feature = '{f}')) "
        f"/ (SELECT scale FROM parameters WHERE feature = '{f}') AS {f}_scaled"
        for f in ("recency_days", "frequency", "monetary_value")
    )
    + " FROM rfm",
    "silhouette_of_quadrants": f"""{SEGMENTS}, {QUARTILES},
points AS (
    SELECT user_id, segment, """
    + ", ".join(
        f"({f} - (SELECT center FROM parameters WHERE feature = '{f}')) "
        f"/ (SELECT scale FROM parameters WHERE feature = '{f}') AS x{i}"
        for i, f in enumerate(("recency_days", "frequency", "monetary_value"))
    )
    + """ FROM quadrants),
sums AS (
    SELECT segment, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2,
           sum(x0 * x0 + x1 * x1 + x2 * x2) AS q FROM points GROUP BY segment),
distances AS (
    SELECT p.user_id, p.segment = s.segment AS own, s.n,
           p.x0 * p.x0 + p.x1 * p.x1 + p.x2 * p.x2 + (s.q - 2 * (p.x0 * s.s0 + p.x1 * s.s1 + p.x2 * s.s2)) / s.n AS d
    FROM points p, sums s),
compared AS (
    SELECT user_id, max(n) FILTER (own) AS n, max(d * n / nullif(n - 1, 0)) FILTER (own) AS a, min(d) FILTER (NOT own) AS b
    FROM distances GROUP BY user_id)
SELECT round_even(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette_squared FROM compared""",
    "segmentation_invariants": f"""{with_tables(ORDERS, ITEMS, RFM)}
SELECT count(*) AS customers, CAST(sum(CAST(monetary_value AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       4::BIGINT AS segments, 0::BIGINT AS misplaced FROM rfm""",
    "segment_profiles": f"{SEGMENTS} SELECT * FROM profiles",
    "label_segments": f"{SEGMENTS} SELECT * FROM labelled",
    "segment_actions": f"""{SEGMENTS}
SELECT *, CASE label {" ".join(f"WHEN '{label}' THEN '{action}'" for label, action in SEGMENT_ACTIONS.items())} END AS action
FROM labelled""",
    "attach_labels": f"{SEGMENTS} SELECT * FROM customers",
    "revenue_at_stake": f"""{SEGMENTS},
by_label AS (
    SELECT label AS segment, CAST(sum(CAST(monetary_value AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM customers GROUP BY label)
SELECT *, round_even(total_revenue / sum(total_revenue) OVER () * 100, 1) AS pct FROM by_label""",
    "segment_kpis": f"""{SEGMENTS}
SELECT count(*) AS customers, count(DISTINCT segment) AS segments,
       CAST(sum(CAST(monetary_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_spend,
       avg(recency_days) AS avg_recency
FROM customers""",
    "segment_sample": f"""{SEGMENTS}
SELECT * FROM customers ORDER BY md5(CAST(user_id AS VARCHAR) || '-42'), user_id LIMIT 500""",
    # Checks
    "quality_checks": f"""{with_tables(
        EVENTS, funnel_of("shop_events", "session_id"), visits("visitor_id", HALF_HOUR),
        ORDERS, ITEMS, COHORTS, REVENUE)},
found AS (
    SELECT 'session is unique' AS "check", count(*) - count(DISTINCT session_id) AS violations FROM funnel
    UNION ALL
    SELECT 'session reaches a stage', count(*) FILTER (abandonment_stage = 'Bounced Immediately') FROM funnel
    UNION ALL
    SELECT 'first event opens session 1', count(*) FILTER (session_sequence <> 1 OR is_new_session <> 1)
    FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY created_at, id) AS n FROM visits)
    WHERE n = 1
    UNION ALL
    SELECT 'long gap opens a session', count(*) FILTER (mins_since_last_event > 30 AND is_new_session <> 1)
    FROM visits
    UNION ALL
    SELECT 'short gap stays in session', count(*) FILTER (mins_since_last_event <= 30 AND is_new_session <> 0)
    FROM visits
    UNION ALL
    SELECT 'sessions equal boundaries', count(*) FILTER (s <> b)
    FROM (SELECT max(session_sequence) AS s, sum(is_new_session) AS b FROM visits GROUP BY visitor_id)
    UNION ALL
    SELECT 'cohort is unique', count(*) - count(DISTINCT cohort_month) FROM cohorts
    UNION ALL
    SELECT 'month 1 within month 0', count(*) FILTER (m1 > m0) FROM cohorts
    UNION ALL
    SELECT 'months increase', count(*) - count(DISTINCT month) FROM revenue
    UNION ALL
    SELECT 'first month has no growth', count(*) FILTER (mom_growth_pct IS NOT NULL)
    FROM (SELECT * FROM revenue ORDER BY month LIMIT 1))
SELECT "check", violations, violations = 0 AS passed FROM found""",
}

# Those of the checks that jobs take along.
ORACLE_SQL["quality_checks_observed"] = ORACLE_SQL["quality_checks"] + """
WHERE "check" IN ('session is unique', 'session reaches a stage', 'first event opens session 1', 'long gap opens a session',
                  'short gap stays in session', 'sessions equal boundaries')"""
ORACLE_SQL["sessionize_streaming_in_slices"] = ORACLE_SQL["sessionize_streaming"]
