"""The SQL each named query is checked against, over the base tables alone."""

from __future__ import annotations

from ledgerlake.plans.schema import SALES_COLUMNS, TABLE_ROLES
from ledgerlake.registry.queries import LOAD_DAY

NUMERIC = ["sales", "quantity", "discount", "profit"]


def _day(column: str = "order_date") -> str:
    """DATE of a well-formed, existing day, else NULL."""
    return f"CASE WHEN regexp_full_match({column}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({column} AS DATE) END"


def _any_day(column: str = "order_date") -> str:
    """The same, also accepting yyyy/MM/dd and dd-MM-yyyy."""
    flipped = f"concat_ws('-', substr({column}, 7, 4), substr({column}, 4, 2), substr({column}, 1, 2))"
    return f"""CASE
        WHEN regexp_full_match({column}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({column} AS DATE)
        WHEN regexp_full_match({column}, '\\d{{4}}/\\d{{2}}/\\d{{2}}') THEN TRY_CAST(replace({column}, '/', '-') AS DATE)
        WHEN regexp_full_match({column}, '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN TRY_CAST({flipped} AS DATE)
    END"""


def _key(day: str) -> str:
    return f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INTEGER)"


# Clean sales rows.
SALES = """base AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
           CAST(o_orderkey AS VARCHAR) AS order_id,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
           CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
           CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
           p_type AS category, p_brand AS sub_category,
           n_name AS city, n_name AS state, r_name AS region, 'World' AS country,
           CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))), 2) AS DOUBLE) AS sales,
           CAST(l_quantity AS INT) AS quantity,
           CAST(CAST(l_discount AS DECIMAL(5,2)) AS DOUBLE) AS discount,
           CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
               - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) * CAST(2.08 AS DECIMAL(3,2)), 2) AS DOUBLE) AS profit
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
)"""
CLEAN = f"{SALES}, raw AS (SELECT {', '.join(SALES_COLUMNS)} FROM base)"

# Sales rows with planted faults.
DIRTY = f"""{SALES}, faulty AS (
    SELECT * REPLACE (
        CASE WHEN l_orderkey % 41 <> 0 THEN segment END AS segment,
        CASE WHEN l_orderkey % 53 <> 4 THEN region END AS region,
        CASE WHEN l_orderkey % 97 = 5 THEN '2023-13-45'
             WHEN l_orderkey % 25 = 1 THEN replace(order_date, '-', '/')
             WHEN l_orderkey % 25 = 2 THEN concat_ws('-', substr(order_date, 9, 2), substr(order_date, 6, 2), substr(order_date, 1, 4))
             ELSE order_date END AS order_date,
        CASE WHEN l_orderkey % 33 <> 0 THEN CASE WHEN l_orderkey % 601 = 7 THEN sales * 15 ELSE sales END END AS sales,
        CASE WHEN l_orderkey % 50 <> 0 THEN CASE WHEN l_orderkey % 601 = 7 THEN profit * -12 ELSE profit END END AS profit
    ), 0 AS copy FROM base
), repeated AS (
    SELECT * FROM faulty
    UNION ALL SELECT * REPLACE (1 AS copy) FROM faulty WHERE l_orderkey % 100 = 3
), dirty AS (
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, copy) AS ingest_pos,
           {', '.join(SALES_COLUMNS)} FROM repeated
)"""

# The dirty rows after removing duplicates, filling nulls and standardising dates.
FILLED_DATES = """
    coalesce(last_value(day IGNORE NULLS) OVER (ORDER BY ingest_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(day IGNORE NULLS) OVER (ORDER BY ingest_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _mode(column: str, table: str) -> str:
    return f"""(SELECT {column} FROM {table} WHERE {column} IS NOT NULL
        GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


_data = ", ".join(SALES_COLUMNS)
CLEANED = f"""{DIRTY}, single AS (SELECT min(ingest_pos) AS ingest_pos, {_data} FROM dirty GROUP BY {_data}),
filled AS (
    SELECT * REPLACE (
        coalesce(segment, {_mode('segment', 'single')}) AS segment,
        coalesce(region, {_mode('region', 'single')}) AS region,
        coalesce(sales, (SELECT quantile_cont(sales, 0.5) FROM single)) AS sales,
        coalesce(profit, (SELECT quantile_cont(profit, 0.5) FROM single)) AS profit
    ), {_any_day()} AS day FROM single
), cleaned AS (
    SELECT * EXCLUDE (day) REPLACE (CAST({FILLED_DATES} AS VARCHAR) AS order_date) FROM filled
)"""


def _text_decimal(column: str, digits: str) -> str:
    """Rounded by the shown digits, halves away from zero."""
    return f"CAST(CAST({column} AS VARCHAR) AS DECIMAL({digits}))"


def _activity(raw: str) -> str:
    return f"""dated AS (SELECT *, {_day()} AS day FROM {raw}),
    activity AS (
        SELECT customer_id, date_diff('day', max(day), (SELECT max(day) FROM dated)) AS recency,
               count(DISTINCT order_id) AS frequency,
               round(sum(coalesce({_text_decimal('sales', '18,4')}, 0)), 2) AS monetary
        FROM dated WHERE day IS NOT NULL AND customer_id IS NOT NULL GROUP BY customer_id
    ), scores AS (
        SELECT *, r_score + f_score + m_score AS rfm_score FROM (
            SELECT *, CAST(ntile(5) OVER (ORDER BY recency DESC, customer_id) AS INTEGER) AS r_score,
                   CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INTEGER) AS f_score,
                   CAST(ntile(5) OVER (ORDER BY monetary, customer_id) AS INTEGER) AS m_score
            FROM activity)
    )"""


TIER = "CASE WHEN rfm_score >= 12 THEN 'Platinum' WHEN rfm_score >= 8 THEN 'Gold' ELSE 'Standard' END"


def _star(raw: str) -> str:
    return f"""{_activity(raw)}, dim_products AS (
        SELECT row_number() OVER (ORDER BY product_id) AS product_key, * FROM (
            SELECT product_id, max(product_name) AS product_name, max(category) AS category,
                   max(sub_category) AS sub_category
            FROM {raw} WHERE product_id IS NOT NULL GROUP BY product_id)
    ), dim_geography AS (
        SELECT row_number() OVER (ORDER BY city NULLS FIRST, state NULLS FIRST, region NULLS FIRST, country NULLS FIRST) AS geo_key, *
        FROM (SELECT DISTINCT city, state, region, country FROM {raw} WHERE city IS NOT NULL AND state IS NOT NULL)
    ), dim_time AS (
        SELECT {_key('day')} AS date_key, day AS full_date, CAST(year(day) AS INTEGER) AS year,
               CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day
        FROM (SELECT DISTINCT day FROM dated WHERE day IS NOT NULL)
    ), dim_customers AS (
        SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, customer_name, segment,
               CAST(coalesce(recency, 0) AS INTEGER) AS recency_days, CAST(coalesce(frequency, 0) AS BIGINT) AS frequency,
               CAST(coalesce(monetary, 0) AS DECIMAL(28,2)) AS monetary_value,
               CAST(coalesce(rfm_score, 0) AS INTEGER) AS rfm_score, {TIER} AS customer_tier
        FROM (SELECT customer_id, max(customer_name) AS customer_name, max(segment) AS segment
              FROM {raw} WHERE customer_id IS NOT NULL GROUP BY customer_id) LEFT JOIN scores USING (customer_id)
    ), fact_sales AS (
        SELECT r.order_id, c.customer_key, p.product_key, g.geo_key, {_key('r.day')} AS date_key,
               {_text_decimal('r.sales', '12,2')} AS sales, CAST(r.quantity AS INTEGER) AS quantity,
               CAST(r.discount AS DECIMAL(5,2)) AS discount, {_text_decimal('r.profit', '12,2')} AS profit
        FROM dated r JOIN dim_customers c USING (customer_id) JOIN dim_products p USING (product_id)
        JOIN dim_geography g ON r.city = g.city AND r.state = g.state AND r.region = g.region AND r.country = g.country
        WHERE r.day IS NOT NULL
    )"""


STAR = f"{CLEAN}, {_star('raw')}"
RUN = f"{CLEANED}, {_star('cleaned')}"
DIRTY_STAR = f"{DIRTY}, {_star('dirty')}"


def _double(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


_MEASURES = f"{_double('sum(sales)')} AS sales, {_double('sum(profit)')} AS profit"
_CUSTOMER_ROW = f"customer_key, customer_id, customer_name, segment, recency_days, frequency, {_double('monetary_value')} AS monetary_value, rfm_score, customer_tier"
_TIME_ROW = "date_key, CAST(full_date AS VARCHAR) AS full_date, year, quarter, month, day"


def _per_column(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


# Profile of the dirty rows.
_STATS = f"""{DIRTY}, bounds AS ({_per_column('''
    SELECT '$c' AS "column", quantile_cont(CAST($c AS DOUBLE), 0.25) AS q1, quantile_cont(CAST($c AS DOUBLE), 0.5) AS q2,
           quantile_cont(CAST($c AS DOUBLE), 0.75) AS q3, min(CAST($c AS DOUBLE)) AS low, max(CAST($c AS DOUBLE)) AS high
    FROM dirty''', NUMERIC)}),
cells AS ({_per_column('SELECT \'$c\' AS "column", CAST($c AS DOUBLE) AS value FROM dirty WHERE $c IS NOT NULL', NUMERIC)}),
nulls AS ({_per_column('''
    SELECT '$c' AS "column", count(*) - count($c) AS null_count,
           round((count(*) - count($c)) / count(*) * 100, 2) AS null_percentage, count(DISTINCT $c) AS unique_count
    FROM dirty''', SALES_COLUMNS)}),
summary AS (
    SELECT "column", min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(any_value(q2), 4) AS median,
           round(coalesce(stddev_samp(value), 0), 4) AS std_dev
    FROM cells JOIN bounds USING ("column") GROUP BY "column"
), outliers AS (
    SELECT "column", any_value(q1) AS q1, any_value(q3) AS q3, count(*) AS value_count,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count
    FROM cells JOIN bounds USING ("column") GROUP BY "column"
), copies AS (SELECT count(*) - 1 AS extra FROM dirty GROUP BY {_data})"""

_TYPES = ", ".join(
    f"('{c}', '{dict(sales='double', quantity='int', discount='double', profit='double').get(c, 'string')}')"
    for c in SALES_COLUMNS
)


_ROLES = ", ".join(f"('{name}', '{role}')" for name, role in TABLE_ROLES.items())
_KINDS = ", ".join(
    f"({i}, '{c}', '{dict(order_id='INTEGER', customer_id='INTEGER', product_id='INTEGER', sales='FLOAT', quantity='INTEGER', discount='FLOAT', profit='FLOAT').get(c, 'TEXT')}')"
    for i, c in enumerate(SALES_COLUMNS)
)


def _histogram(place: str) -> str:
    return f"""WITH {_STATS}, placed AS (
        SELECT "column", low, (high - low) / 10.0 AS width, {place} AS bin
        FROM cells JOIN bounds USING ("column") WHERE high > low)
    SELECT "column", CAST(bin AS BIGINT) AS bin, round(low + bin * width, 2) AS bin_start,
           round(low + (bin + 1) * width, 2) AS bin_end, count(*) AS count
    FROM placed WHERE bin BETWEEN 0 AND 9 GROUP BY "column", low, width, bin"""


def _consistency(day: str) -> str:
    return f"round(avg(({day}) IS NOT NULL) FILTER (order_date IS NOT NULL) * 100, 2)".replace(
        f"avg(({day}) IS NOT NULL)", f"avg(CAST(({day}) IS NOT NULL AS INTEGER))"
    )


_CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + ("1.0::DOUBLE" if a == b else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8)")
    + " AS correlation FROM dirty"
    for a in NUMERIC
    for b in NUMERIC
).replace("1.0::DOUBLE AS correlation FROM dirty", "1.0::DOUBLE AS correlation")

_SCORES = f"""{_STATS}, parts AS (
    SELECT (SELECT round((sum(total) - sum(null_count)) / sum(total) * 100, 2)
            FROM (SELECT null_count, (SELECT count(*) FROM dirty) AS total FROM nulls)) AS completeness,
           (SELECT {_consistency(_day())} FROM dirty) AS consistency,
           (SELECT round(avg(share) * 100, 2) FROM (
               SELECT count(*) FILTER (value >= 0) / count(*) AS share FROM cells
               WHERE "column" IN ('sales', 'quantity') GROUP BY "column")) AS validity,
           (SELECT round((count(*) - (SELECT sum(extra) FROM copies)) / count(*) * 100, 2) FROM dirty) AS uniqueness,
           (SELECT round(avg((value_count - outlier_count) / value_count) * 100, 2) FROM outliers) AS accuracy
), scores AS (
    SELECT 'completeness' AS dimension, completeness AS score, 95 AS floor FROM parts
    UNION ALL SELECT 'consistency', consistency, 90 FROM parts
    UNION ALL SELECT 'validity', validity, 95 FROM parts
    UNION ALL SELECT 'uniqueness', uniqueness, 95 FROM parts
    UNION ALL SELECT 'accuracy', accuracy, 90 FROM parts
    UNION ALL SELECT 'overall', round(completeness * 0.30::DOUBLE + consistency * 0.20::DOUBLE + validity * 0.20::DOUBLE
        + uniqueness * 0.15::DOUBLE + accuracy * 0.15::DOUBLE, 2), 92 FROM parts
)"""


def _rules() -> str:
    fills = _per_column(
        """SELECT $i AS ord, 'fill_nulls' AS type, '$c' AS "column",
        null_count || ' missing values in ''$c''. Fill with $m?' AS message, 'high' AS severity, '$m' AS method
        FROM nulls WHERE "column" = '$c' AND null_count > 0""",
        SALES_COLUMNS,
    )
    for i, c in enumerate(SALES_COLUMNS):
        method = "median" if c in NUMERIC else "mode"
        start = fills.index(f"SELECT $i AS ord, 'fill_nulls' AS type, '{c}'")
        end = fills.find("UNION ALL", start)
        end = len(fills) if end < 0 else end
        part = fills[start:end].replace("$i", str(i + 1)).replace("$m", method)
        fills = fills[:start] + part + fills[end:]
    return f"""WITH {_STATS}, rules AS (
        SELECT 0 AS ord, 'remove_duplicates' AS type, NULL AS "column",
               sum(extra) || ' duplicate rows detected. Remove them?' AS message, 'medium' AS severity, NULL AS method
        FROM copies HAVING sum(extra) > 0
        UNION ALL {fills}
        UNION ALL SELECT {len(SALES_COLUMNS) + 1}, 'standardize_dates', 'order_date',
            'Inconsistent date format found in ''order_date''. Standardize to YYYY-MM-DD?', 'high', NULL
        FROM dirty HAVING {_consistency(_day())} < 100)
    SELECT *, true AS default_value FROM rules"""


def _fill(column: str, value: str) -> str:
    shown = f"round(coalesce({column}, {value}), 4)" if column in NUMERIC else f"coalesce({column}, {value})"
    return f"WITH {DIRTY} SELECT ingest_pos, {shown} AS {column} FROM dirty"


def _standard_dates(day: str) -> str:
    return f"""WITH {DIRTY}, parsed AS (SELECT ingest_pos, {day} AS day FROM dirty)
    SELECT ingest_pos, CAST({FILLED_DATES} AS VARCHAR) AS order_date FROM parsed"""


_ROUNDED = f"* REPLACE (round(sales, 4) AS sales, round(profit, 4) AS profit)"

_MONTHS = f"""{STAR}, monthly AS (
    SELECT make_date(year, month, 1) AS month, {_double('sum(sales)')} AS sales
    FROM fact_sales JOIN dim_time USING (date_key) GROUP BY year, month
), series AS (
    SELECT CAST(m AS DATE) AS month, coalesce(sales, 0) AS sales
    FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m FROM monthly)
    LEFT JOIN monthly ON monthly.month = CAST(m AS DATE)
), lags AS (
    SELECT * FROM (
        SELECT month, sales, lag(sales, 1) OVER (ORDER BY month) AS lag_1, lag(sales, 2) OVER (ORDER BY month) AS lag_2,
               lag(sales, 3) OVER (ORDER BY month) AS lag_3, lag(sales, 12) OVER (ORDER BY month) AS lag_12,
               CAST(month(month) AS INTEGER) AS month_num FROM series)
    WHERE lag_12 IS NOT NULL
)"""


def _mean(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / count({column})"


_AVERAGES = f"""SELECT customer_key, {_mean('sales')} AS avg_order_sales, {_mean('discount')} AS avg_discount,
    {_mean('profit')} AS avg_profit FROM fact_sales GROUP BY customer_key"""


def _features(segments: list[str]) -> str:
    flags = ", ".join(f"CAST(segment = '{s}' AS INTEGER)::DOUBLE AS \"segment_{s}\"" for s in segments[1:])
    return f"""WITH {STAR}, averages AS ({_AVERAGES})
    SELECT customer_id, CAST(customer_tier IN ('Platinum', 'Gold') AS INTEGER) AS is_high_value,
           {_double('recency_days')} AS recency_days, {_double('frequency')} AS frequency,
           {_double('monetary_value')} AS monetary_value, avg_order_sales, avg_discount, avg_profit, {flags}
    FROM dim_customers JOIN averages USING (customer_key)"""


# Market segments of the customer table, in alphabetical order.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _shown_amount(amount: str) -> str:
    return f"regexp_replace(format('{{:,.2f}}', {amount}), '0$', '')"


_INSIGHTS = f"""WITH {STAR}, rate AS (SELECT {_mean('discount')} AS rate FROM fact_sales),
percent AS (SELECT rate, CAST(round(rate * 100, 1) AS VARCHAR) AS pct FROM rate),
segments AS (SELECT segment, {_double('sum(sales)')} AS revenue FROM fact_sales JOIN dim_customers USING (customer_key)
    GROUP BY segment ORDER BY sum(sales) DESC, segment LIMIT 1),
regions AS (SELECT region, {_double('sum(sales)')} AS revenue FROM fact_sales JOIN dim_geography USING (geo_key)
    GROUP BY region ORDER BY sum(sales) DESC, region LIMIT 1),
losses AS (SELECT coalesce(string_agg(category, ', ' ORDER BY category), '') AS names FROM (
    SELECT category FROM fact_sales JOIN dim_products USING (product_key) GROUP BY category HAVING sum(profit) < 0)),
lines AS (
    SELECT 'key_findings' AS section, 10 AS ord, 'Average transaction discount is high at ' || pct || '%. This decreases profit margins across product lines.' AS text FROM percent WHERE rate > 0.15
    UNION ALL SELECT 'business_risks', 11, 'Profit margins are heavily compressed by discounting. Several product lines could become net-loss items if discounts are not managed.' FROM percent WHERE rate > 0.15
    UNION ALL SELECT 'recommended_actions', 12, 'Implement discount controls to limit maximum transactional discount to 15% on high-demand categories.' FROM percent WHERE rate > 0.15
    UNION ALL SELECT 'key_findings', 13, 'Average discount rate remains healthy at ' || pct || '%, preserving category profit margins.' FROM percent WHERE rate <= 0.15
    UNION ALL SELECT 'key_findings', 20, 'The ''' || segment || ''' segment leads in total volume, generating $' || {_shown_amount('revenue')} || ' in revenue.' FROM segments
    UNION ALL SELECT 'key_findings', 30, 'Identified net-unprofitable categories: ' || names || '.' FROM losses WHERE names <> ''
    UNION ALL SELECT 'business_risks', 31, 'Negative profit trend in: ' || names || '. Shipping costs or markdown discounts are outweighing sale prices.' FROM losses WHERE names <> ''
    UNION ALL SELECT 'recommended_actions', 32, 'Audit supplier costs and shipping surcharges for ' || names || ' immediately.' FROM losses WHERE names <> ''
    UNION ALL SELECT 'key_findings', 33, 'All primary product categories are profitable.' FROM losses WHERE names = ''
    UNION ALL SELECT 'key_findings', 40, 'Regional sales concentration is highest in the ''' || region || ''' region with $' || {_shown_amount('revenue')} || ' in revenue.' FROM regions
    UNION ALL SELECT 'growth_opportunities', 41, 'Capitalize on high sales volume in ''' || region || ''' by introducing premium product packages and loyalty rewards.' FROM regions
)
SELECT * FROM lines
UNION ALL SELECT 'business_risks', 1000, 'No critical system risks identified. Maintain current operational discount limits.'
    WHERE NOT EXISTS (FROM lines WHERE section = 'business_risks')
UNION ALL SELECT 'growth_opportunities', 1000, 'Expand distribution channels in central region segments exhibiting rising frequency scores.'
    WHERE NOT EXISTS (FROM lines WHERE section = 'growth_opportunities')
UNION ALL SELECT 'recommended_actions', 1000, 'Maintain baseline discount limits and review sales logs monthly.'
    WHERE NOT EXISTS (FROM lines WHERE section = 'recommended_actions')"""


def _by(dimension: str, key: str, name: str) -> str:
    return f"SELECT {name}, {_MEASURES} FROM fact_sales JOIN {dimension} USING ({key}) GROUP BY {name}"


# Two loads: what the first leaves behind and what the second makes of it.
_EARLY = f"early AS (SELECT * FROM raw WHERE order_date < '{LOAD_DAY}')"
_LATE = f"late AS (SELECT * FROM raw WHERE order_date >= '{LOAD_DAY}')"


def _second_load_customers() -> str:
    def renamed(load: str) -> str:
        return _activity(load).replace("dated", f"{load}_dated").replace("activity", f"{load}_activity").replace(
            "scores AS", f"{load}_scores AS"
        )

    def members(load: str) -> str:
        return f"""SELECT customer_id, max(customer_name) AS customer_name, max(segment) AS segment
            FROM {load} GROUP BY customer_id"""

    return f"""WITH {CLEAN}, {_EARLY}, {_LATE}, {renamed('early')}, {renamed('late')},
    first_keys AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS customer_key FROM ({members('early')})),
    all_keys AS (
        SELECT * FROM first_keys UNION ALL
        SELECT customer_id, (SELECT max(customer_key) FROM first_keys) + row_number() OVER (ORDER BY customer_id)
        FROM ({members('late')}) WHERE customer_id NOT IN (SELECT customer_id FROM first_keys)
    ), known AS (SELECT customer_id, max(customer_name) AS customer_name, max(segment) AS segment FROM raw GROUP BY customer_id),
    latest AS (
        SELECT * FROM late_scores UNION ALL
        SELECT * FROM early_scores WHERE customer_id NOT IN (SELECT customer_id FROM late_scores)
    )
    SELECT customer_key, customer_id, customer_name, segment, CAST(recency AS INTEGER) AS recency_days,
           CAST(frequency AS BIGINT) AS frequency, {_double('monetary')} AS monetary_value, rfm_score, {TIER} AS customer_tier
    FROM all_keys JOIN known USING (customer_id) JOIN latest USING (customer_id)"""


FEATURES = ["lag_1", "lag_2", "lag_3", "lag_12", "month_num"]


def _eliminated() -> str:
    """Five ridge coefficients per category from the normal equations, by elimination without pivots."""
    n = len(FEATURES)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    a = {(i, j): f"covar_pop({FEATURES[i]}, {FEATURES[j]}) * count(*)" + (" + 1" if i == j else "") for i, j in pairs}
    b = {i: f"covar_pop({FEATURES[i]}, sales) * count(*)" for i in range(n)}
    means = ", ".join(f"avg({f}) AS x{i}" for i, f in enumerate(FEATURES))
    columns = ", ".join([f"{e} AS a{i}{j}" for (i, j), e in a.items()] + [f"{e} AS b{i}" for i, e in b.items()])
    steps = [f"e0 AS (SELECT category, avg(sales) AS y, {means}, {columns} FROM train GROUP BY category)"]
    for k in range(n - 1):
        new = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i, j in pairs if i > k]
        new += [f"b{i} - a{k}{i} * b{k} / a{k}{k} AS b{i}" for i in range(k + 1, n)]
        steps.append(f"e{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM e{k})")
    source = f"e{n - 1}"
    for i in reversed(range(n)):
        known = "".join(f" - a{i}{j} * c{j}" for j in range(i + 1, n))
        steps.append(f"s{i} AS (SELECT *, (b{i}{known}) / a{i}{i} AS c{i} FROM {source})")
        source = f"s{i}"
    fitted = ", ".join(f"c{i} AS b_{f}" for i, f in enumerate(FEATURES))
    steps.append(f"fitted AS (SELECT category, y{''.join(f' - c{i} * x{i}' for i in range(n))} AS intercept, {fitted} FROM {source})")
    return ", ".join(steps)


def _by_category() -> str:
    lags = ", ".join(f"lag(sales, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 12))
    predicted = "intercept" + "".join(f" + b_{f} * {f}" for f in FEATURES)
    return f"""{STAR}, monthly AS (
        SELECT category, make_date(year, month, 1) AS month, {_double('sum(sales)')} AS sales
        FROM fact_sales JOIN dim_time USING (date_key) JOIN dim_products USING (product_key) GROUP BY category, year, month
    ), spans AS (SELECT category, min(month) AS low, max(month) AS high FROM monthly GROUP BY category HAVING count(*) >= 12
    ), every_month AS (
        SELECT x.category, CAST(x.m AS DATE) AS month, coalesce(monthly.sales, 0) AS sales
        FROM (SELECT category, unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS m FROM spans) AS x
        LEFT JOIN monthly ON monthly.category = x.category AND monthly.month = CAST(x.m AS DATE)
    ), lags AS (
        SELECT * FROM (SELECT category, month, sales, {lags}, CAST(month(month) AS INTEGER) AS month_num
                       FROM every_month WINDOW w AS (PARTITION BY category ORDER BY month)) WHERE lag_12 IS NOT NULL
    ), split AS (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY month) > n - ceil(n * 0.2::DOUBLE) AS is_test
        FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n FROM lags) WHERE n >= 6
    ), train AS (SELECT * FROM split WHERE NOT is_test), {_eliminated()},
    scored AS (SELECT split.*, {predicted} AS prediction FROM split JOIN fitted USING (category))"""


def _forecast_by_category() -> str:
    known = [f"m{i}" for i in range(12)]
    steps, source = [], "tail"
    for step in range(6):
        values = {f"lag_{k}": known[-k] for k in (1, 2, 3, 12)} | {"month_num": f"month(last + INTERVAL {step + 1} MONTH)"}
        steps.append(f"f{step}_ AS (SELECT *, greatest(0, intercept{''.join(f' + b_{f} * {values[f]}' for f in FEATURES)}) AS f{step} FROM {source})")
        known.append(f"f{step}")
        source = f"f{step}_"
    rows = " UNION ALL ".join(
        f"""SELECT category, CAST(CAST(last + INTERVAL {i + 1} MONTH AS DATE) AS VARCHAR) AS month, round(f{i}, 2) AS sales,
        round(greatest(0, f{i} - 1.96 * spread), 2) AS lower_bound, round(f{i} + 1.96 * spread, 2) AS upper_bound FROM {source}"""
        for i in range(6)
    )
    history = ", ".join(f"max(sales) FILTER (back = {12 - i}) AS m{i}" for i in range(12))
    return f"""WITH {_by_category()}, tail AS (
        SELECT * FROM (SELECT category, max(month) AS last, {history} FROM (
            SELECT *, row_number() OVER (PARTITION BY category ORDER BY month DESC) AS back FROM every_month) WHERE back <= 12 GROUP BY category)
        JOIN fitted USING (category)
        JOIN (SELECT category, stddev_pop(sales - prediction) AS spread FROM scored WHERE NOT is_test GROUP BY category) USING (category)
    ), {', '.join(steps)} {rows}"""


_MIXED = f"""{DIRTY}, mixed AS (
    SELECT ingest_pos, CASE WHEN ingest_pos % 31 IN (7, 8) THEN NULL ELSE CAST({_day()} AS VARCHAR) END AS day, ingest_pos % 31 = 8 AS unread
    FROM dirty WHERE {_day()} IS NOT NULL
)"""


_PRODUCTS_TWICE = f"""WITH {CLEAN}, {_EARLY}, {_LATE},
    first_keys AS (SELECT product_id, category, sub_category, row_number() OVER (ORDER BY product_id) AS product_key
        FROM (SELECT DISTINCT product_id, category, sub_category FROM early)),
    second AS (SELECT DISTINCT product_id, product_name, category, sub_category FROM late)
    SELECT product_key, f.product_id, coalesce(s.product_name, 'old') AS product_name, f.category, f.sub_category
    FROM first_keys f LEFT JOIN second s USING (product_id)
    UNION ALL SELECT (SELECT max(product_key) FROM first_keys) + row_number() OVER (ORDER BY product_id),
        product_id, product_name, category, sub_category FROM second
    WHERE product_id NOT IN (SELECT product_id FROM first_keys)"""


def all_sql() -> dict[str, str]:
    return {
        "csv_import": f"""WITH {DIRTY} SELECT category, count(*) AS rows, count(DISTINCT order_id) AS orders,
            count(DISTINCT order_date) AS dates, count(region) AS regions,
            {_double(f"sum({_text_decimal('sales', '18,4')})")} AS sales,
            {_double(f"sum({_text_decimal('profit', '18,4')})")} AS profit,
            CAST(sum(quantity) AS BIGINT) AS quantity FROM dirty GROUP BY category""",
        "csv_export": f"""WITH {STAR} SELECT CAST(product_key AS VARCHAR) AS product_key, product_id, product_name,
            category, sub_category FROM dim_products""",
        "table_scan": f"""WITH {RUN} SELECT segment, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity
            FROM cleaned GROUP BY segment""",
        "warehouse_summary": f"""WITH {STAR} SELECT * FROM (SELECT 'dim_customers' AS table_name, true AS exists, count(*) AS row_count FROM dim_customers
            UNION ALL SELECT 'dim_products', true, count(*) FROM dim_products
            UNION ALL SELECT 'dim_geography', true, count(*) FROM dim_geography
            UNION ALL SELECT 'dim_time', true, count(*) FROM dim_time
            UNION ALL SELECT 'fact_sales', true, count(*) FROM fact_sales) JOIN (VALUES {_ROLES}) r(table_name, role) USING (table_name)""",
        "dirty_rows": f"WITH {DIRTY} SELECT * FROM dirty",
        "date_validity": f"WITH {DIRTY} SELECT ({_day()}) IS NOT NULL AS is_valid, count(*) AS rows FROM dirty GROUP BY 1",
        "dim_products": f"WITH {STAR} SELECT * FROM dim_products",
        "dim_geography": f"WITH {STAR} SELECT * FROM dim_geography",
        "dim_time": f"WITH {STAR} SELECT {_TIME_ROW} FROM dim_time",
        "dim_customers": f"WITH {STAR} SELECT {_CUSTOMER_ROW} FROM dim_customers",
        "fact_sales": f"""WITH {STAR} SELECT row_number() OVER (ORDER BY date_key, order_id, customer_key, product_key, geo_key,
                f.sales NULLS FIRST, f.quantity NULLS FIRST, f.discount NULLS FIRST, f.profit NULLS FIRST) AS fact_key,
            * REPLACE ({_double('sales')} AS sales, {_double('discount')} AS discount, {_double('profit')} AS profit) FROM fact_sales f""",
        "dataset_listing": f"WITH {DIRTY} SELECT count(*) AS rows, 0::BIGINT AS unlisted FROM dirty",
        "lowered_columns": f"""WITH {DIRTY} SELECT segment, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity,
            '{','.join(SALES_COLUMNS)}' AS columns FROM dirty GROUP BY segment""",
        "imported_files": f"""WITH {CLEAN} SELECT 'sales_' || lower(replace(region, ' ', '_')) || '_2024' AS "table", CAST(2 AS INTEGER) AS columns,
            count(*) AS rows, round(sum(sales), 2) AS sales FROM raw GROUP BY region""",
        "imported_workbook": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
        "data_guards": """SELECT * FROM (VALUES ('import', 'EmptyDataset'), ('profile', 'EmptyDataset'), ('forecast', 'NotEnoughData'),
            ('lags', 'NotEnoughData'), ('classifier', 'NotEnoughData'), ('one class', 'NotEnoughData'), ('anomalies', 'NotEnoughData')) AS v(guard, outcome)""",
        "csv_schema_report": f"""SELECT * FROM (VALUES {_KINDS}) k(ord, "column", type)""",
        "etl_run_steps": f"""WITH {_STATS} SELECT 'COMPLETED' AS run_status, step, 'COMPLETED' AS status,
            CASE WHEN step LIKE 'Run %' THEN 'Dropped ' || (SELECT CAST(sum(extra) AS BIGINT) FROM copies) || ' duplicate rows.' END AS first_line
            FROM (VALUES ('Validate Raw Schema'), ('Run Recommendations & Auto-Clean'), ('Generate Star Schema Dimensions'),
                  ('Populate Fact Sales')) s(step)""",
        "cleaning_history": f"SELECT * EXCLUDE (ord) FROM ({_rules()})",
        **dict.fromkeys(
            ("us_dates", "day_first_dates", "datetime_texts", "typed_dates"),
            f"WITH {STAR} SELECT date_key, count(*) AS rows, {_double('sum(sales)')} AS sales FROM fact_sales GROUP BY date_key",
        ),
        "sku_import": f"""WITH {STAR} SELECT 'string' AS sku_type, 'double' AS n_type, count(*) AS rows, max(product_id || 'D') AS last_sku,
            sum(CAST(product_id || '.5e1' AS DOUBLE)) AS total FROM dim_products""",
        "float_profile": """WITH v AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN CAST(CAST(l_discount AS FLOAT) AS DOUBLE) END AS v FROM lineitem)
            SELECT count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count, count(v) AS counted, round(max(v), 4) AS max,
            round(avg(v), 4) AS mean FROM v""",
        "anomaly_checks": f"WITH {STAR} SELECT count(*) AS total, count(*) AS facts, true AS labels_agree, true AS few_flagged FROM fact_sales",
        "customer_scores": f"""WITH {STAR} SELECT customer_key, customer_tier, CAST(customer_tier IN ('Platinum', 'Gold') AS INTEGER) AS is_high_value,
            true AS is_share, true AS agrees FROM dim_customers JOIN (SELECT DISTINCT customer_key FROM fact_sales) USING (customer_key)""",
        "products_after_second_load": _PRODUCTS_TWICE,
        "products_merged_by_range": _PRODUCTS_TWICE,
        "geography_after_second_load": f"""WITH {DIRTY}, places AS (SELECT DISTINCT city, state, region, country FROM dirty),
            first_keys AS (SELECT row_number() OVER (ORDER BY city, state, country) AS geo_key, * FROM places WHERE region IS NULL)
            SELECT * FROM first_keys
            UNION ALL SELECT (SELECT max(geo_key) FROM first_keys) + row_number() OVER (ORDER BY city, state, region, country), *
            FROM places WHERE region IS NOT NULL""",
        "calendar_after_second_load": f"WITH {STAR} SELECT {_TIME_ROW} FROM dim_time",
        "customers_after_second_load": _second_load_customers(),
        "facts_of_dirty_rows": f"""WITH {DIRTY_STAR} SELECT date_key, count(*) AS rows, {_double('sum(sales)')} AS sales,
            CAST(sum(quantity) AS BIGINT) AS quantity, {_double('sum(discount)')} AS discount,
            {_double('sum(profit)')} AS profit FROM fact_sales GROUP BY date_key""",
        "unplaced_rows": f"""WITH {DIRTY} SELECT count(*) AS dated_rows, count(*) FILTER (customer_id IS NULL) AS no_customer,
            count(*) FILTER (product_id IS NULL) AS no_product,
            count(*) FILTER (city IS NULL OR state IS NULL OR region IS NULL OR country IS NULL) AS no_place
            FROM dirty WHERE ({_day()}) IS NOT NULL""",
        "customer_activity": f"""WITH {CLEAN}, {_activity('raw')} SELECT customer_id, CAST(recency AS INTEGER) AS recency,
            frequency, {_double('monetary')} AS monetary FROM activity""",
        "rfm_scores": f"""WITH {CLEAN}, {_activity('raw')} SELECT customer_id, CAST(recency AS INTEGER) AS recency, frequency,
            {_double('monetary')} AS monetary, r_score, f_score, m_score, rfm_score, {TIER} AS customer_tier FROM scores""",
        "customers_after_run": f"WITH {RUN} SELECT {_CUSTOMER_ROW} FROM dim_customers",
        "sales_after_run": f"WITH {RUN} {_by('dim_products', 'product_key', 'category')}",
        "dashboard_kpis": f"""WITH {STAR}, sums AS (SELECT {_double('sum(sales)')} AS revenue, {_double('sum(profit)')} AS profit,
            {_mean('discount')} AS discount, CAST(sum(quantity) AS BIGINT) AS quantity FROM fact_sales)
            SELECT round(revenue, 2) AS total_revenue, round(profit, 2) AS total_profit, round(discount, 4) AS avg_discount,
            quantity AS total_orders, round(profit / revenue * 100, 2) AS profit_margin FROM sums""",
        "monthly_trend": f"""WITH {STAR} SELECT printf('%d-%02d', year, month) AS period, {_MEASURES}
            FROM fact_sales JOIN dim_time USING (date_key) GROUP BY year, month""",
        "category_performance": f"WITH {STAR} {_by('dim_products', 'product_key', 'category')}",
        "region_performance": f"WITH {STAR} {_by('dim_geography', 'geo_key', 'region')}",
        "region_share": f"""WITH {STAR}, totals AS (SELECT region, sum(sales) AS sales FROM fact_sales
            JOIN dim_geography USING (geo_key) GROUP BY region)
            SELECT region, {_double('sales')} AS sales,
            round({_double('sales')} / {_double('sum(sales) OVER ()')} * 100, 2) AS share_pct FROM totals""",
        "top_products": f"""WITH {STAR}, best AS (SELECT product_name, sum(sales) AS sales, sum(profit) AS profit FROM fact_sales
            JOIN dim_products USING (product_key) GROUP BY product_name ORDER BY sum(sales) DESC, product_name LIMIT 10)
            SELECT CASE WHEN length(product_name) > 40 THEN substr(product_name, 1, 40) || '...' ELSE product_name END AS product_name,
            {_double('sales')} AS sales, {_double('profit')} AS profit FROM best""",
        "top_cities": f"""WITH {STAR} SELECT city, state, {_double('sum(sales)')} AS city_sales FROM fact_sales
            JOIN dim_geography USING (geo_key) GROUP BY city, state ORDER BY sum(sales) DESC, city, state LIMIT 15""",
        "average_discount": f"WITH {STAR} SELECT {_mean('discount')} AS avg_discount FROM fact_sales",
        "top_segment": f"""WITH {STAR} SELECT segment, {_double('sum(sales)')} AS revenue FROM fact_sales
            JOIN dim_customers USING (customer_key) GROUP BY segment ORDER BY sum(sales) DESC, segment LIMIT 1""",
        "top_region": f"""WITH {STAR} SELECT region, {_double('sum(sales)')} AS revenue FROM fact_sales
            JOIN dim_geography USING (geo_key) GROUP BY region ORDER BY sum(sales) DESC, region LIMIT 1""",
        "unprofitable_categories": f"""WITH {STAR} SELECT category, {_double('sum(profit)')} AS profit FROM fact_sales
            JOIN dim_products USING (product_key) GROUP BY category HAVING sum(profit) < 0""",
        "high_value_customers": f"""WITH {STAR} SELECT customer_id, customer_name, {_double('monetary_value')} AS monetary_value,
            customer_tier FROM dim_customers WHERE customer_tier = 'Platinum'""",
        "recent_months": f"""WITH {STAR} SELECT printf('%d-%02d', year, month) AS period, {_double('sum(sales)')} AS sales
            FROM fact_sales JOIN dim_time USING (date_key) GROUP BY year, month ORDER BY year DESC, month DESC LIMIT 18""",
        "product_labels": f"""WITH {STAR} SELECT product_id,
            CASE WHEN length(product_name) > 40 THEN substr(product_name, 1, 40) || '...' ELSE product_name END AS label,
            CASE WHEN length(product_name) > 8 THEN substr(product_name, 1, 8) || '...' ELSE product_name END AS short
            FROM dim_products""",
        "table_shape": f"""WITH {_STATS} SELECT 'profile' AS section, 0 AS ord, 'row_count' AS metric,
            CAST(count(*) AS VARCHAR) AS value FROM dirty UNION ALL SELECT 'profile', 1, 'col_count', '{len(SALES_COLUMNS)}'
            UNION ALL SELECT 'profile', 2, 'missing_cells_pct', CAST(round((SELECT sum(null_count) FROM nulls) / (count(*) * {len(SALES_COLUMNS)}) * 100, 2) AS VARCHAR) FROM dirty""",
        "duplicate_count": f"WITH {_STATS} SELECT CAST(sum(extra) AS BIGINT) AS duplicate_rows FROM copies",
        "null_profile": f"WITH {_STATS} SELECT * FROM nulls",
        "numeric_profile": f"WITH {_STATS} SELECT * FROM summary",
        "outlier_profile": f"WITH {_STATS} SELECT * REPLACE (round(q1, 4) AS q1, round(q3, 4) AS q3) FROM outliers",
        "histograms": _histogram("floor((value - low) / ((high - low) / 10.0))"),
        "histograms_with_maximum": _histogram("least(floor((value - low) / ((high - low) / 10.0)), 9)"),
        "correlations": f"WITH {DIRTY} {_CORRELATIONS}",
        "column_profile": f"""WITH {_STATS} SELECT n."column", type, null_count, null_percentage, unique_count, min, max, mean,
            median, std_dev, outlier_count FROM nulls n JOIN (VALUES {_TYPES}) t("column", type) USING ("column")
            LEFT JOIN summary USING ("column") LEFT JOIN outliers USING ("column")""",
        "quality_scores": f"""WITH {_SCORES} SELECT dimension, score, CASE
            WHEN dimension = 'overall' THEN CASE WHEN score >= floor THEN 'Excellent' ELSE 'Needs Clean' END
            WHEN score >= floor THEN 'Satisfactory' ELSE 'Caution' END AS status FROM scores""",
        "recovered_consistency": f"WITH {DIRTY} SELECT {_consistency(_any_day())} AS score FROM dirty",
        "recommended_rules": _rules(),
        "rows_without_duplicates": f"WITH {CLEANED} SELECT * FROM single",
        "filled_with_mean": _fill("sales", "(SELECT avg(sales) FROM dirty)"),
        "filled_with_median": _fill("profit", "(SELECT quantile_cont(profit, 0.5) FROM dirty)"),
        "filled_with_mode": _fill("segment", _mode("segment", "dirty")),
        "standard_dates": _standard_dates(_any_day()),
        "standard_dates_strict": _standard_dates(_day()),
        "cleaned_rows": f"WITH {CLEANED} SELECT {_ROUNDED} FROM cleaned",
        "cleaning_preview": f"WITH {CLEANED} SELECT {_ROUNDED.replace('*', '* EXCLUDE (ingest_pos)', 1)} FROM cleaned ORDER BY ingest_pos LIMIT 50",
        "saved_high_value_customers": f"""WITH {STAR} SELECT customer_id, customer_name, {_double('monetary_value')} AS monetary_value,
            customer_tier FROM dim_customers WHERE customer_tier = 'Platinum' ORDER BY monetary_value DESC, customer_id LIMIT 1000""",
        "saved_revenue_by_category": f"""WITH {STAR} SELECT category, {_double('sum(sales)')} AS total_sales,
            {_double('sum(profit)')} AS total_profit FROM fact_sales JOIN dim_products USING (product_key) GROUP BY category""",
        "saved_top_cities": f"""WITH {STAR} SELECT city, state, {_double('sum(sales)')} AS city_sales FROM fact_sales
            JOIN dim_geography USING (geo_key) GROUP BY city, state ORDER BY sum(sales) DESC, city LIMIT 15""",
        "sql_capped_rows": f"""WITH {STAR} SELECT CAST(full_date AS VARCHAR) AS full_date, {_double('sum(sales)')} AS sales
            FROM fact_sales JOIN dim_time USING (date_key) GROUP BY full_date ORDER BY full_date LIMIT 1000""",
        "sql_in_subquery": f"""WITH {STAR} SELECT year, count(*) AS n_facts, {_double('sum(sales)')} AS sales
            FROM fact_sales JOIN dim_time USING (date_key) JOIN dim_customers USING (customer_key)
            WHERE customer_tier = 'Platinum' AND product_key % 2 <> 0 GROUP BY year""",
        "sql_exists": f"""WITH {STAR} SELECT region, count(DISTINCT geo_key) AS places
            FROM fact_sales JOIN dim_geography USING (geo_key) WHERE discount > 0.09 GROUP BY region""",
        "sql_scalar_subquery": f"""WITH {STAR}, most AS (
                SELECT *, max(quantity) OVER (PARTITION BY order_id) AS most, avg(sales) OVER () AS middle FROM fact_sales)
            SELECT category, count(*) AS above_average FROM most JOIN dim_products USING (product_key)
            WHERE sales > middle AND quantity = most GROUP BY category""",
        "sql_lateral": f"""WITH {STAR} SELECT year, month, count(*) AS n_facts, {_double('sum(sales)')} AS sales
            FROM fact_sales JOIN dim_time USING (date_key) GROUP BY year, month""",
        "month_series": f"WITH {_MONTHS} SELECT CAST(month AS VARCHAR) AS month, sales FROM series",
        "lag_features": f"WITH {_MONTHS} SELECT * REPLACE (CAST(month AS VARCHAR) AS month) FROM lags",
        "forecast_split": f"""WITH {_MONTHS} SELECT CAST(month AS VARCHAR) AS month, row_number() OVER (ORDER BY month)
            > (SELECT count(*) - ceil(count(*) * 0.2::DOUBLE) FROM lags) AS is_test FROM lags""",
        "category_coefficients": f"""WITH {_by_category()} SELECT category, round(intercept, 2) AS intercept, {', '.join(f'round(b_{f}, 6) AS b_{f}' for f in FEATURES[:4])},
            round(b_month_num, 2) AS b_month_num FROM fitted""",
        "category_metrics": f"""WITH {_by_category()} SELECT category, round(sqrt(mse), 2) AS rmse, round(1 - CASE WHEN spread <> 0 THEN mse / spread END, 6) AS r2 FROM (
            SELECT category, avg((sales - prediction) ** 2) AS mse, var_pop(sales) AS spread FROM scored WHERE is_test GROUP BY category)""",
        "category_forecast": _forecast_by_category(),
        "mixed_dates": f"""WITH {_MIXED} SELECT ingest_pos, CASE WHEN unread THEN 'unknown' ELSE {FILLED_DATES} END AS order_date FROM mixed""",
        "mixed_consistency": f"WITH {_MIXED} SELECT round(count(day) / count(*) * 100, 2) AS score FROM mixed WHERE unread OR day IS NOT NULL",
        "customer_averages": f"WITH {STAR} {_AVERAGES}",
        "customer_features": _features(SEGMENTS),
        "customer_split": f"""WITH {STAR}, sizes AS (SELECT CAST(customer_tier IN ('Platinum', 'Gold') AS INTEGER) AS is_high_value,
            count(*) AS n FROM dim_customers JOIN (SELECT DISTINCT customer_key FROM fact_sales) USING (customer_key) GROUP BY 1)
            SELECT is_high_value, CAST(floor(n * 0.7::DOUBLE + 0.5) AS BIGINT) AS train,
            n - CAST(floor(n * 0.7::DOUBLE + 0.5) AS BIGINT) AS test FROM sizes""",
        "sales_insights": _INSIGHTS,
        "numbered_lines": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS line_number FROM lineitem""",
    }
