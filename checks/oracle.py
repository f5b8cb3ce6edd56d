"""DuckDB twins of the registered queries, over the driver's test tables."""

from __future__ import annotations

from payrisk.functions.mcc import MCC_DESCRIPTIONS
from payrisk.plans.cube import GROUPINGS
from payrisk.plans.cube import KEYS as CUBE_KEYS
from payrisk.schemas import BEHAVIOR_COLUMNS, MODEL_FEATURES

PLAIN = "replace(format('{:,.2f}', value), ',', '')"


def bucket(expression: str) -> str:
    return f"(('0x' || substr(md5(cast({expression} AS VARCHAR)), 1, 8))::BIGINT % 100)"


def money(column: str) -> str:
    return f"try_cast(replace(replace({column}, '$', ''), ',', '') AS DOUBLE)"


RATE = "round(100.0 * sum(is_fraud) / count(*), 4)"
COUNTS = "count(*) AS transactions, cast(sum(is_fraud) AS BIGINT) AS {fraud}, " + RATE + " AS {rate}"


def counts(fraud: str = "fraud_transactions", rate: str = "fraud_rate_pct") -> str:
    return COUNTS.format(fraud=fraud, rate=rate)


RAW = f"""
raw_transactions AS (
  SELECT event_id AS id, ts AS date, user_id AS client_id,
    cast(json_extract_string(props, '$.k') AS BIGINT) AS card_id,
    CASE WHEN event_id % 97 = 0 THEN '$1,234.56'
         WHEN event_id % 20 = 0 THEN '$-' || {PLAIN}
         ELSE '$' || {PLAIN} END AS amount,
    CASE event_type WHEN 'click' THEN 'Online Transaction' WHEN 'view' THEN 'Chip Transaction'
         WHEN 'purchase' THEN 'Swipe Transaction' ELSE event_type END AS use_chip,
    event_id % 500 AS merchant_id,
    'CITY_' || cast(user_id % 25 AS VARCHAR) AS merchant_city,
    CASE WHEN event_type <> 'click' THEN 'S' || cast(user_id % 5 AS VARCHAR) END AS merchant_state,
    CASE WHEN event_type <> 'click' THEN user_id * 100 END AS zip,
    cast(CASE event_id % 7 WHEN 0 THEN 5812 WHEN 1 THEN 5541 WHEN 2 THEN 5411 WHEN 3 THEN 4829
         WHEN 4 THEN 5311 WHEN 5 THEN 3000 ELSE 9999 END AS INTEGER) AS mcc,
    CASE WHEN event_type = 'error' THEN
         CASE event_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN '' ELSE 'Bad PIN,Insufficient Balance' END END AS errors
  FROM events),
raw_labels AS (
  SELECT CASE WHEN event_id % 10 = 9 THEN event_id + 1000000000 ELSE event_id END AS transaction_id,
    CASE WHEN {bucket('event_id')} <
         CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' THEN 12
              WHEN event_type = 'view' AND ts >= TIMESTAMP '2024-01-20' THEN 15 ELSE 2 END
         THEN 'Yes' ELSE 'No' END AS label
  FROM events),
fraud_labels AS (
  SELECT transaction_id, cast(CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS BIGINT) AS is_fraud FROM raw_labels),
raw_cards AS (
  SELECT CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1000000000 ELSE p_partkey END AS id, p_brand AS card_brand, p_type AS card_type,
    CASE WHEN p_size > 10 THEN 'YES' ELSE 'NO' END AS has_chip,
    CASE WHEN p_partkey % 25 = 0 THEN 'Yes' ELSE 'No' END AS card_on_dark_web,
    CASE WHEN p_partkey % 50 = 7 THEN '$0'
         ELSE '$' || format('{{:,.2f}}', p_retailprice * 10) END AS credit_limit
  FROM part),
raw_users AS (
  SELECT CASE WHEN c_custkey % 50 = 49 THEN c_custkey + 1000000000 ELSE c_custkey END AS id, cast(300 + (c_custkey * 37) % 550 AS INTEGER) AS credit_score,
    '$' || format('{{:,.2f}}', abs(c_acctbal) * 100) AS yearly_income,
    '$' || format('{{:,.2f}}', abs(c_acctbal) * 10) AS total_debt,
    cast(1 + c_custkey % 7 AS INTEGER) AS num_credit_cards
  FROM customer)"""

CLEAN = RAW + """,
transactions_clean AS (
  SELECT t.id AS transaction_id, t.date AS transaction_time, t.client_id, t.card_id,
    try_cast(replace(t.amount, '$', '') AS DOUBLE) AS amount,
    t.use_chip, t.merchant_id, t.merchant_city, t.merchant_state, t.zip, t.mcc, t.errors,
    extract(hour FROM t.date) AS transaction_hour, extract(dow FROM t.date) AS day_of_week,
    CASE WHEN t.errors IS NULL OR trim(t.errors) = '' THEN 0 ELSE 1 END AS has_error,
    f.is_fraud
  FROM raw_transactions t JOIN fraud_labels f ON t.id = f.transaction_id)"""

# Rows of the delivery with wrong fields, and what the columns outside the schema hold.
GOOD = "(id % 41 <> 0 AND id % 43 <> 0)"
SNIFFED = f"""
SELECT column_name, column_type, n_values FROM (
  SELECT 'terminal' AS column_name, 'bigint' AS column_type, count(*) AS n_values FROM raw_transactions WHERE {GOOD}
  UNION ALL SELECT 'fee', 'double', count(*) FROM raw_transactions WHERE {GOOD}
  UNION ALL SELECT 'booked', 'date', count(date) FROM raw_transactions WHERE {GOOD}
  UNION ALL SELECT 'remote', 'boolean', count(use_chip) FROM raw_transactions WHERE {GOOD}
  UNION ALL SELECT 'batch', CASE WHEN count(*) FILTER (id % 100 = 3) > 0 THEN 'string' ELSE 'bigint' END, count(*)
    FROM raw_transactions WHERE {GOOD})"""
REJECTED = f"""
SELECT id, concat_ws('; ', CASE WHEN id % 43 = 0 THEN 'date is no timestamp_ntz' END,
    CASE WHEN id % 41 = 0 THEN 'client_id is no bigint' END) AS reason, true AS has_file
FROM raw_transactions WHERE NOT {GOOD}"""
ACCEPTED = f"""
SELECT id, client_id, date, amount, id % 1000 AS terminal, (id % 100) / 4 AS fee, use_chip = 'Online Transaction' AS remote,
  CASE WHEN id % 100 = 3 THEN 'A7' ELSE cast(id % 9 AS VARCHAR) END AS batch
FROM raw_transactions WHERE {GOOD}"""

BASIC = CLEAN + f""",
attributes AS (
  SELECT t.*, abs(t.amount) AS absolute_amount, cast(c.has_chip AS BOOLEAN) AS has_chip,
    CASE WHEN cast(c.card_on_dark_web AS BOOLEAN) THEN 1 ELSE 0 END AS card_on_dark_web,
    {money('c.credit_limit')} AS credit_limit, u.credit_score,
    {money('u.yearly_income')} AS yearly_income, {money('u.total_debt')} AS total_debt, u.num_credit_cards
  FROM transactions_clean t LEFT JOIN raw_cards c ON t.card_id = c.id LEFT JOIN raw_users u ON t.client_id = u.id),
model_features_basic AS (
  SELECT transaction_id, amount, CASE WHEN amount < 0 THEN 1 ELSE 0 END AS is_refund, absolute_amount,
    CASE WHEN use_chip = 'Online Transaction' THEN 1 ELSE 0 END AS is_online,
    CASE WHEN use_chip = 'Chip Transaction' THEN 1 ELSE 0 END AS is_chip,
    CASE WHEN use_chip = 'Swipe Transaction' THEN 1 ELSE 0 END AS is_swipe,
    transaction_hour, day_of_week, has_error, mcc, has_chip, card_on_dark_web, credit_limit,
    CASE WHEN credit_limit > 0 THEN absolute_amount / credit_limit END AS amount_to_credit_limit,
    credit_score, yearly_income, total_debt, num_credit_cards, is_fraud
  FROM attributes)"""


def history(source: str) -> str:
    """Averages of earlier amounts; summed in whole cents so that the order of adding cannot matter."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    averages = ", ".join(
        f"""CASE WHEN count(cents) OVER {w} > 0
        THEN cast(sum(cents) OVER {w} AS DOUBLE) / count(cents) OVER {w} / 100 END AS {name}"""
        for w, name in (("w_customer", "customer_previous_avg"), ("w_card", "card_previous_avg"))
    )
    return f"""
spending AS (
  SELECT *, abs(amount) AS size, cast(round(abs(amount) * 100) AS BIGINT) AS cents FROM {source}),
averages AS (
  SELECT transaction_id, size, {averages}
  FROM spending
  WINDOW w_customer AS (PARTITION BY client_id ORDER BY transaction_time, transaction_id {frame}),
         w_card AS (PARTITION BY card_id ORDER BY transaction_time, transaction_id {frame})),
behavior_features AS (
  SELECT transaction_id, customer_previous_avg, card_previous_avg,
    CASE WHEN customer_previous_avg > 0 THEN size / customer_previous_avg END AS amount_vs_customer_avg,
    CASE WHEN card_previous_avg > 0 THEN size / card_previous_avg END AS amount_vs_card_avg
  FROM averages)"""


BEHAVIOR = BASIC + "," + history("transactions_clean")

MATRIX_SELECT = ", ".join(
    "cast(b.has_chip AS INTEGER) AS card_has_chip"
    if f == "card_has_chip"
    else f"h.{f}" if f.endswith("_avg") else f"b.{f}"
    for f in MODEL_FEATURES
)
MATRIX = BEHAVIOR + f""",
model_matrix AS (
  SELECT b.transaction_id, t.transaction_time, {MATRIX_SELECT}, b.is_fraud
  FROM model_features_basic b JOIN behavior_features h ON b.transaction_id = h.transaction_id
  JOIN transactions_clean t ON b.transaction_id = t.transaction_id),
cut AS (
  SELECT quantile_cont(transaction_time, 0.60) AS recent_start, quantile_cont(transaction_time, 0.80) AS test_start
  FROM transactions_clean),
baseline_train AS (
  SELECT * FROM model_matrix
  WHERE transaction_time < (SELECT test_start FROM cut) AND {bucket('transaction_id')} < 15),
recent_train AS (
  SELECT * FROM model_matrix
  WHERE transaction_time >= (SELECT recent_start FROM cut) AND transaction_time < (SELECT test_start FROM cut)
    AND {bucket('transaction_id')} < 35),
future_test AS (
  SELECT * FROM model_matrix
  WHERE transaction_time >= (SELECT test_start FROM cut) AND {bucket('transaction_id')} < 25)"""

LONG = f"""
transactions_clean AS (
  SELECT o_orderkey AS transaction_id, o_orderdate AS transaction_time, o_custkey AS client_id,
    o_orderkey % 500 AS card_id, o_totalprice AS amount,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Online Transaction' WHEN '2-HIGH' THEN 'Chip Transaction'
         ELSE 'Swipe Transaction' END AS use_chip,
    cast(CASE WHEN {bucket('o_orderkey')} <
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 20
              WHEN o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1999-01-01' THEN 25
              ELSE 3 END THEN 1 ELSE 0 END AS BIGINT) AS is_fraud
  FROM orders),
dated AS (
  SELECT *, CASE WHEN transaction_time < (SELECT quantile_cont(transaction_time, 0.80) FROM transactions_clean)
                 THEN 'TRAIN - Past' ELSE 'TEST - Future' END AS dataset
  FROM transactions_clean)"""

FINE_FRAME = "ORDER BY transaction_time, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
FINE_HISTORY = f"""
fine_averages AS (
  SELECT transaction_id, abs(amount * 0.7310585786300049::DOUBLE) AS size,
    avg(abs(amount * 0.7310585786300049::DOUBLE)) OVER (PARTITION BY client_id {FINE_FRAME}) AS customer_previous_avg,
    avg(abs(amount * 0.7310585786300049::DOUBLE)) OVER (PARTITION BY card_id {FINE_FRAME}) AS card_previous_avg
  FROM transactions_clean),
fine_features AS (
  SELECT transaction_id, customer_previous_avg, card_previous_avg,
    CASE WHEN customer_previous_avg > 0 THEN size / customer_previous_avg END AS amount_vs_customer_avg,
    CASE WHEN card_previous_avg > 0 THEN size / card_previous_avg END AS amount_vs_card_avg
  FROM fine_averages)"""

SCORED = CLEAN + f""",
scored AS (
  SELECT transaction_id, is_fraud,
    cast({bucket('transaction_id * 7 + 1')} + 30 * is_fraud AS DOUBLE) / 130 AS score
  FROM transactions_clean),
decided AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored),
steps AS (SELECT score, count(*) AS n, sum(is_fraud) AS p FROM scored GROUP BY score),
curve AS (
  SELECT n, p, sum(n) OVER w AS above, sum(p) OVER w AS hits FROM steps
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ranking AS (
  SELECT sum(cast(p AS DOUBLE) * hits / above) / sum(p) AS average_precision,
    sum((n - p) * (hits - cast(p AS DOUBLE) / 2)) / (cast(sum(p) AS DOUBLE) * (sum(n) - sum(p))) AS roc_auc
  FROM curve)"""

REPORT = SCORED + """,
cells AS (
  SELECT count(*) FILTER (is_fraud = 0 AND predicted = 0) AS n00, count(*) FILTER (is_fraud = 0 AND predicted = 1) AS n01,
         count(*) FILTER (is_fraud = 1 AND predicted = 0) AS n10, count(*) FILTER (is_fraud = 1 AND predicted = 1) AS n11
  FROM decided),
per_class AS (
  SELECT '0' AS class, CASE WHEN n00 + n10 > 0 THEN n00 / (n00 + n10) ELSE 0 END AS p,
    CASE WHEN n00 + n01 > 0 THEN n00 / (n00 + n01) ELSE 0 END AS r,
    CASE WHEN 2 * n00 + n01 + n10 > 0 THEN 2 * n00 / (2 * n00 + n01 + n10) ELSE 0 END AS f, n00 + n01 AS s FROM cells
  UNION ALL
  SELECT '1', CASE WHEN n11 + n01 > 0 THEN n11 / (n11 + n01) ELSE 0 END,
    CASE WHEN n11 + n10 > 0 THEN n11 / (n11 + n10) ELSE 0 END,
    CASE WHEN 2 * n11 + n01 + n10 > 0 THEN 2 * n11 / (2 * n11 + n01 + n10) ELSE 0 END, n10 + n11 FROM cells)"""

CATEGORY_VALUES = ", ".join(
    "('{}', '{}')".format(code, text.replace("'", "''")) for code, text in MCC_DESCRIPTIONS.items()
)


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def skewed(sql: str) -> str:
    """The same query with one customer, one card and no card owning many transactions."""
    return sql.replace(
        "SELECT t.id AS transaction_id, t.date AS transaction_time, t.client_id, t.card_id,",
        """SELECT t.id AS transaction_id, t.date AS transaction_time,
    CASE WHEN t.use_chip = 'Online Transaction' THEN 1 ELSE t.client_id END AS client_id,
    CASE WHEN t.use_chip = 'Chip Transaction' THEN 7 WHEN t.use_chip <> 'Swipe Transaction' THEN t.card_id END AS card_id,""",
    )


def rates(key: str) -> str:
    return query(CLEAN, f"SELECT {key}, {counts()} FROM transactions_clean GROUP BY {key} ORDER BY {key}")


def medians(features: list[str], source: str) -> str:
    return ", ".join(f"(SELECT median(cast({f} AS DOUBLE)) FROM {source}) AS m_{f}" for f in features)


def filled(features: list[str]) -> str:
    return ", ".join(f"coalesce(cast({f} AS DOUBLE), m_{f}) AS {f}" for f in features)


AMOUNTS = """SELECT is_fraud, count(*) AS transactions, round(avg(amount), 2) AS average_amount,
  round(median(amount), 2) AS median_amount, round(min(amount), 2) AS minimum_amount, round(max(amount), 2) AS maximum_amount
FROM transactions_clean WHERE amount IS NOT NULL GROUP BY is_fraud ORDER BY is_fraud"""

CUTOFFS = """SELECT date_trunc('second', quantile_cont(transaction_time, 0.60)) AS recent_start,
  date_trunc('second', quantile_cont(transaction_time, 0.80)) AS test_start FROM transactions_clean"""

DRIFT_AMOUNT = """SELECT dataset, is_fraud, round(avg(abs(amount)), 2) AS avg_amount, round(median(abs(amount)), 2) AS median_amount
FROM dated GROUP BY dataset, is_fraud ORDER BY dataset, is_fraud"""


PERIODS = """SELECT *, cast(date_trunc('month', transaction_time) AS TIMESTAMP) AS month,
  CASE WHEN transaction_time < TIMESTAMP '2024-01-20' THEN 'TRAIN - Past' ELSE 'TEST - Future' END AS dataset FROM transactions_clean"""

DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP"}


def cube_sql() -> str:
    parts = []
    for name, keys in GROUPINGS.items():
        shown = ", ".join(f"cast({k if k in keys else 'NULL'} AS {DUCK_TYPES[t]}) AS {k}" for k, t in CUBE_KEYS.items())
        grouped = f" GROUP BY {', '.join(keys)}" if keys else ""
        parts.append(
            f"SELECT '{name}' AS grouping, {shown}, count(*) AS transactions, "
            f"cast(sum(is_fraud) AS BIGINT) AS fraud_transactions FROM periods{grouped}"
        )
    return query(CLEAN + f", periods AS ({PERIODS})", " UNION ALL ".join(parts))


def score_equations_sql() -> str:
    """What the labels say: the balanced mean of label times scaled feature. No model is needed."""
    stats = ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS d_{f}" for f in MODEL_FEATURES)
    scaled = ", ".join(f"coalesce((f.{f} - s.a_{f}) / nullif(s.d_{f}, 0), 0) AS {f}" for f in MODEL_FEATURES)
    ctes = (
        MATRIX
        + f""",
fills AS (SELECT {medians(MODEL_FEATURES, 'baseline_train')}),
filled AS (SELECT transaction_id, {filled(MODEL_FEATURES)}, is_fraud FROM baseline_train, fills),
stats AS (SELECT {stats} FROM filled),
sizes AS (SELECT count(*) AS n, sum(is_fraud) AS n1 FROM filled),
scaled AS MATERIALIZED (
  SELECT {scaled}, 1.0::DOUBLE AS intercept, f.is_fraud, CASE WHEN f.is_fraud = 1 THEN n / (2.0::DOUBLE * n1) ELSE n / (2.0::DOUBLE * (n - n1)) END AS weight
  FROM filled f, stats s, sizes)"""
    )
    return query(ctes, " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(sum(weight * is_fraud * {f}) / sum(weight), 6) AS moment FROM scaled"
        for f in [*MODEL_FEATURES, "intercept"]
    ))


def oracle_sql() -> dict[str, str]:
    everything = "SELECT * FROM "
    matrix = query(MATRIX, everything + "model_matrix")
    clean = query(CLEAN, everything + "transactions_clean")
    top = "HAVING count(*) >= 100 ORDER BY {rate} DESC, mcc LIMIT {n}"
    scaled = ", ".join(
        f"round((f.{f} - s.a_{f}) / nullif(s.d_{f}, 0), 6) AS {f}" for f in MODEL_FEATURES
    )
    stats = ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS d_{f}" for f in MODEL_FEATURES)
    return {
        "transactions_clean": clean,
        "transactions_clean_from_csv": query(
            CLEAN,
            # An empty CSV field is NULL, quoted or not, and zip codes are read as doubles.
            "SELECT * REPLACE (nullif(errors, '') AS errors, cast(zip AS DOUBLE) AS zip) FROM transactions_clean",
        ),
        "stored_table_rates": rates("use_chip"),
        "fraud_labels": query(RAW, everything + "fraud_labels"),
        "label_summary": query(
            RAW,
            """SELECT count(*) AS total, count(*) FILTER (label = 'No') AS legitimate,
  count(*) FILTER (label = 'Yes') AS fraud,
  round(100.0 * count(*) FILTER (label = 'Yes') / count(*), 4) AS fraud_rate_pct FROM raw_labels""",
        ),
        "fraud_ids": query(
            RAW, "SELECT transaction_id FROM raw_labels WHERE label = 'Yes' ORDER BY transaction_id LIMIT 10"
        ),
        "fraud_examples": query(
            RAW,
            """SELECT t.*, f.is_fraud FROM raw_transactions t JOIN fraud_labels f ON t.id = f.transaction_id
WHERE f.is_fraud = 1 ORDER BY t.id LIMIT 10""",
        ),
        "cards_preview": query(RAW, "SELECT * FROM raw_cards ORDER BY id LIMIT 5"),
        "users_preview": query(RAW, "SELECT * FROM raw_users ORDER BY id LIMIT 5"),
        "joined_label_check": query(
            RAW,
            """SELECT count(*) AS joined_transactions, cast(sum(f.is_fraud) AS BIGINT) AS fraudulent_transactions
FROM raw_transactions t JOIN fraud_labels f ON t.id = f.transaction_id""",
        ),
        "model_features_basic": query(BASIC, everything + "model_features_basic"),
        "model_features_basic_hot_keys": skewed(query(BASIC, everything + "model_features_basic")),
        "behavior_features": query(BEHAVIOR, everything + "behavior_features"),
        "behavior_features_hot_keys": skewed(query(BEHAVIOR, everything + "behavior_features")),
        "behavior_features_long_period": query(LONG + "," + history("transactions_clean"), everything + "behavior_features"),
        "model_matrix": matrix,
        "model_matrix_hot_keys": skewed(matrix),
        "model_matrix_from_tables": matrix,
        "model_matrix_bucketed": matrix,
        "behavior_features_incremental": query(BEHAVIOR, everything + "behavior_features"),
        "sniffed_types": query(RAW, SNIFFED),
        "rejected_rows": query(RAW, REJECTED),
        "accepted_rows": query(RAW, ACCEPTED),
        "feature_table_check": query(
            BASIC,
            "SELECT count(*) AS rows, cast(sum(is_fraud) AS BIGINT) AS fraud_transactions FROM model_features_basic",
        ),
        "behavior_row_count": query(BEHAVIOR, "SELECT count(*) AS rows FROM behavior_features"),
        "overall_summary": query(CLEAN, f"SELECT {counts()} FROM transactions_clean"),
        "dashboard_summary": query(
            CLEAN,
            f"""SELECT count(*) AS total_transactions, cast(sum(is_fraud) AS BIGINT) AS fraud_transactions,
  {RATE} AS fraud_rate FROM transactions_clean""",
        ),
        "rate_by_payment_method": rates("use_chip"),
        "payment_method_rate_label": query(
            CLEAN,
            f"""SELECT CASE use_chip WHEN 'Online Transaction' THEN 'Online' WHEN 'Chip Transaction' THEN 'Chip'
  WHEN 'Swipe Transaction' THEN 'Swipe' ELSE use_chip END AS payment_method, {RATE} AS fraud_rate_percent
FROM transactions_clean GROUP BY use_chip""",
        ),
        "rate_by_error": rates("has_error"),
        "rate_by_hour": rates("transaction_hour"),
        "rate_by_weekday": rates("day_of_week"),
        "rate_by_month": query(
            LONG,
            f"""SELECT cast(date_trunc('month', transaction_time) AS TIMESTAMP) AS month, {RATE} AS fraud_rate_percent
FROM transactions_clean GROUP BY month ORDER BY month""",
        ),
        "high_risk_mcc_top": query(
            CLEAN,
            f"SELECT mcc, {counts()} FROM transactions_clean GROUP BY mcc " + top.format(rate="fraud_rate_pct", n=15),
        ),
        "high_risk_mcc_described": query(
            CLEAN
            + f""",
categories(code, merchant_category) AS (VALUES {CATEGORY_VALUES}),
ranked AS (SELECT mcc, {counts(rate='fraud_rate_percent')} FROM transactions_clean GROUP BY mcc """
            + top.format(rate="fraud_rate_percent", n=10)
            + ")",
            """SELECT mcc, transactions, fraud_transactions, fraud_rate_percent, merchant_category
FROM ranked LEFT JOIN categories ON cast(mcc AS VARCHAR) = code""",
        ),
        "amount_stats_by_label": query(CLEAN, AMOUNTS),
        "amount_stats_narrowed": query(CLEAN, AMOUNTS),
        "behavior_median_by_label": query(
            BEHAVIOR,
            """SELECT b.is_fraud, round(median(h.amount_vs_customer_avg), 2) AS median_vs_customer_avg,
  round(median(h.amount_vs_card_avg), 2) AS median_vs_card_avg
FROM model_features_basic b JOIN behavior_features h ON b.transaction_id = h.transaction_id
WHERE h.amount_vs_customer_avg IS NOT NULL AND h.amount_vs_card_avg IS NOT NULL GROUP BY b.is_fraud""",
        ),
        "drift_overall": query(LONG, f"SELECT dataset, {counts(fraud='fraud')} FROM dated GROUP BY dataset"),
        "drift_payment_method": query(
            LONG, f"SELECT dataset, use_chip, {counts(fraud='fraud')} FROM dated GROUP BY dataset, use_chip"
        ),
        "drift_amount": query(LONG, DRIFT_AMOUNT),
        "drift_amount_narrowed": query(LONG, DRIFT_AMOUNT),
        "time_quantile_cutoffs": query(CLEAN, CUTOFFS),
        "time_quantile_cutoffs_narrowed": query(LONG, CUTOFFS),
        "join_coverage": query(CLEAN, COVERAGE),
        "join_coverage_bitmaps": query(CLEAN, COVERAGE),
        "connected_transactions": query(CLEAN, CONNECTED),
        "connected_transactions_hot_keys": skewed(query(CLEAN, CONNECTED)),
        "connected_preview": query(CLEAN, CONNECTED + " ORDER BY t.transaction_id LIMIT 10"),
        "clean_preview": query(
            CLEAN,
            """SELECT transaction_id, transaction_time, amount, use_chip, merchant_id, transaction_hour, day_of_week,
  has_error, is_fraud FROM transactions_clean ORDER BY transaction_id LIMIT 10""",
        ),
        "feature_preview": query(
            BASIC,
            """SELECT transaction_id, amount, is_online, is_chip, is_swipe, has_error, card_on_dark_web, credit_limit,
  round(amount_to_credit_limit, 3) AS amount_to_credit_limit, credit_score, yearly_income, is_fraud
FROM model_features_basic ORDER BY transaction_id LIMIT 10""",
        ),
        "behavior_preview": query(
            BEHAVIOR,
            """SELECT transaction_id, round(customer_previous_avg, 2) AS customer_previous_avg,
  round(card_previous_avg, 2) AS card_previous_avg, round(amount_vs_customer_avg, 2) AS amount_vs_customer_avg,
  round(amount_vs_card_avg, 2) AS amount_vs_card_avg
FROM behavior_features WHERE customer_previous_avg IS NOT NULL ORDER BY transaction_id LIMIT 10""",
        ),
        "labels_from_json": query(RAW, "SELECT * FROM fraud_labels"),
        "cards_from_csv": query(RAW, "SELECT * FROM raw_cards"),
        "users_from_csv": query(RAW, "SELECT * FROM raw_users"),
        "join_coverage_hot_keys": skewed(query(CLEAN, COVERAGE)),
        "median_by_many_groups": query(
            LONG, "SELECT client_id, round(quantile_cont(amount, 0.5), 6) AS median_amount FROM transactions_clean GROUP BY client_id"
        ),
        "behavior_features_any_decimals": query(
            CLEAN + "," + FINE_HISTORY,
            "SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in BEHAVIOR_COLUMNS[1:]) + " FROM fine_features",
        ),
        "baseline_model_balance": query(
            MATRIX,
            """SELECT count(*) AS rows, cast(sum(is_fraud) AS BIGINT) AS fraud_cases, round(sum(w * is_fraud) / sum(w), 4) AS mean_is_fraud,
  round(sum(w * is_fraud) / sum(w), 4) AS mean_score
FROM (SELECT is_fraud, 1.0 / count(*) OVER (PARTITION BY is_fraud) AS w FROM baseline_train)""",
        ),
        "recent_model_check": query(
            MATRIX,
            """SELECT count(*) AS rows, cast(sum(is_fraud) AS BIGINT) AS fraud_cases, true AS scores_in_range,
  true AS decisions_match, true AS better_than_constant FROM recent_train""",
        ),
        "saved_model_scores": query(
            MATRIX, "SELECT count(*) AS rows, cast(0 AS BIGINT) AS rows_that_differ FROM future_test"
        ),
        "transaction_investigation": query(
            BEHAVIOR,
            """SELECT t.transaction_id, t.transaction_time, t.amount, t.use_chip, t.merchant_id, t.mcc, t.has_error, t.is_fraud,
  round(h.customer_previous_avg, 2) AS customer_avg_spend, round(h.card_previous_avg, 2) AS card_avg_spend,
  round(h.amount_vs_customer_avg, 2) AS amount_vs_customer_avg, round(h.amount_vs_card_avg, 2) AS amount_vs_card_avg,
  CASE WHEN t.is_fraud = 1 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS outcome, t.has_error = 1 AS error_warning
FROM transactions_clean t LEFT JOIN behavior_features h ON t.transaction_id = h.transaction_id
WHERE t.transaction_id = 842 LIMIT 1""",
        ),
        "investigation_clustered": query(
            BEHAVIOR,
            """SELECT t.transaction_id, t.transaction_time, t.amount, t.use_chip, t.merchant_id, t.mcc, t.has_error, t.is_fraud,
  round(h.customer_previous_avg, 2) AS customer_avg_spend, round(h.card_previous_avg, 2) AS card_avg_spend,
  round(h.amount_vs_customer_avg, 2) AS amount_vs_customer_avg, round(h.amount_vs_card_avg, 2) AS amount_vs_card_avg,
  CASE WHEN t.is_fraud = 1 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS outcome, t.has_error = 1 AS error_warning
FROM transactions_clean t LEFT JOIN behavior_features h ON t.transaction_id = h.transaction_id
WHERE t.transaction_id = 842 LIMIT 1""",
        ),
        "rewritten_table_rates": query(
            CLEAN, f"SELECT use_chip, {counts()} FROM transactions_clean WHERE amount >= 0 GROUP BY use_chip"
        ),
        "fraud_rate_cube": cube_sql(),
        "rate_by_hour_from_cube": rates("transaction_hour"),
        "high_risk_mcc_from_cube": query(
            CLEAN,
            f"SELECT mcc, {counts()} FROM transactions_clean GROUP BY mcc " + top.format(rate="fraud_rate_pct", n=15),
        ),
        "drift_payment_method_from_cube": query(
            CLEAN + f", periods AS ({PERIODS})",
            f"SELECT dataset, use_chip, {counts(fraud='fraud')} FROM periods GROUP BY dataset, use_chip",
        ),
        "median_from_sketches": query(
            CLEAN, "SELECT is_fraud, round(median(amount), 2) AS median_amount FROM transactions_clean WHERE amount IS NOT NULL GROUP BY is_fraud"
        ),
        "baseline_score_equations": score_equations_sql(),
        "recent_trees_structure": query(
            MATRIX,
            """SELECT tree, true AS leaves_within_limit, count(*) AS leaf_rows, cast(sum(is_fraud) AS BIGINT) AS fraud_rows,
  true AS no_leaf_too_small, true AS rows_as_when_grown FROM recent_train, range(6) AS r(tree) GROUP BY tree""",
        ),
        "baseline_train_set": query(MATRIX, everything + "baseline_train"),
        "recent_train_set": query(MATRIX, everything + "recent_train"),
        "future_test_set": query(MATRIX, everything + "future_test"),
        "split_counts": query(
            MATRIX,
            " UNION ALL ".join(
                f"SELECT '{name}' AS split, count(*) AS rows, cast(sum(is_fraud) AS BIGINT) AS fraud_cases FROM {name}"
                for name in ("baseline_train", "recent_train", "future_test")
            ),
        ),
        "median_imputed_features": query(
            MATRIX + f", fills AS (SELECT {medians(MODEL_FEATURES, 'baseline_train')})",
            f"SELECT transaction_id, {filled(MODEL_FEATURES)}, is_fraud FROM future_test, fills",
        ),
        "standard_scaled_features": query(
            MATRIX
            + f""",
fills AS (SELECT {medians(MODEL_FEATURES, 'baseline_train')}),
filled AS (SELECT transaction_id, {filled(MODEL_FEATURES)}, is_fraud FROM baseline_train, fills),
stats AS (SELECT {stats} FROM filled)""",
            f"SELECT transaction_id, {scaled}, is_fraud FROM filled f, stats s",
        ),
        "balanced_class_weights": query(
            CLEAN,
            """SELECT is_fraud, cast((SELECT count(*) FROM transactions_clean) AS DOUBLE)
  / ((SELECT count(DISTINCT is_fraud) FROM transactions_clean) * count(*)) AS weight
FROM transactions_clean GROUP BY is_fraud""",
        ),
        "fraud_sample_weights": query(
            CLEAN,
            """SELECT transaction_id, is_fraud, cast(CASE WHEN is_fraud = 1 THEN 40 ELSE 1 END AS DOUBLE) AS weight
FROM transactions_clean""",
        ),
        "threshold_decision": query(SCORED, everything + "decided"),
        "confusion_matrix": query(
            SCORED,
            """SELECT a.actual, d.predicted, count(s.transaction_id) AS transactions
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) d(predicted)
LEFT JOIN decided s ON s.is_fraud = a.actual AND s.predicted = d.predicted GROUP BY ALL""",
        ),
        "classification_report": query(
            REPORT,
            """SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score, s AS support FROM per_class
UNION ALL SELECT 'accuracy', NULL, NULL, round((n00 + n11) / (n00 + n01 + n10 + n11), 4), n00 + n01 + n10 + n11 FROM cells
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), cast(sum(s) AS BIGINT) FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 4), round(sum(r * s) / sum(s), 4),
  round(sum(f * s) / sum(s), 4), cast(sum(s) AS BIGINT) FROM per_class""",
        ),
        "average_precision": query(SCORED, "SELECT round(average_precision, 9) AS average_precision FROM ranking"),
        "roc_auc": query(SCORED, "SELECT round(roc_auc, 9) AS roc_auc FROM ranking"),
        "ranking_scores_blocks": query(
            SCORED,
            "SELECT round(average_precision, 9) AS average_precision, round(roc_auc, 9) AS roc_auc FROM ranking",
        ),
    }


COVERAGE = """SELECT count(*) AS total_transactions, count(c.id) AS card_matches, count(u.id) AS customer_matches
FROM transactions_clean t LEFT JOIN raw_cards c ON t.card_id = c.id LEFT JOIN raw_users u ON t.client_id = u.id"""

CONNECTED = """SELECT t.transaction_id, t.amount, t.use_chip, t.client_id, c.id AS card_id, c.card_brand, c.card_type,
  c.credit_limit, c.has_chip, c.card_on_dark_web, u.credit_score, u.yearly_income
FROM transactions_clean t LEFT JOIN raw_cards c ON t.card_id = c.id LEFT JOIN raw_users u ON t.client_id = u.id"""
