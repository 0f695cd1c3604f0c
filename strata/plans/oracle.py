"""The same results as plain SQL over the given tables, to compare with."""

from __future__ import annotations

LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST,
                   l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST,
                   l_extendedprice DESC NULLS LAST, l_returnflag DESC NULLS LAST,
                   l_linestatus DESC NULLS LAST) AS rn FROM lineitem) t
  WHERE rn = 1)"""

SALES = """
sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id, CAST(l_partkey AS VARCHAR) AS stock_code,
         CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_suppkey AS VARCHAR) AS store_id,
         CAST(o_orderdate AS DATE) AS sale_date
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
          ORDER BY l_shipdate DESC NULLS LAST, l_suppkey DESC NULLS LAST,
                   l_linenumber DESC NULLS LAST, l_quantity DESC NULLS LAST,
                   l_extendedprice DESC NULLS LAST) AS rn FROM lineitem) t
  JOIN orders ON l_orderkey = o_orderkey
  WHERE rn = 1)"""

KEPT_SALES = """
kept_sales AS (
  SELECT s.* FROM sales s JOIN customer ON s.customer_id = CAST(c_custkey AS VARCHAR)
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name IN ('EUROPE', 'AMERICA', 'ASIA', 'AFRICA'))"""

CUSTOMER_FEED = """
customer_feed AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, n_name AS country,
         o_orderpriority AS segment, CAST(o_orderdate AS DATE) AS feed_date, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CUSTOMER_HISTORY = CUSTOMER_FEED + """,
customer_daily AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, feed_date
                   ORDER BY o_orderkey DESC) AS rn FROM customer_feed) t WHERE rn = 1),
customer_lagged AS (
  SELECT *, row_number() OVER w AS nth, lag(country) OVER w AS was_country,
         lag(segment) OVER w AS was_segment
  FROM customer_daily WINDOW w AS (PARTITION BY customer_id ORDER BY feed_date)),
customer_changes AS (
  SELECT customer_id, country, segment, feed_date AS effective_start_date,
         lead(feed_date) OVER (PARTITION BY customer_id ORDER BY feed_date) AS effective_end_date
  FROM customer_lagged
  WHERE nth = 1 OR country IS DISTINCT FROM was_country OR segment IS DISTINCT FROM was_segment),
customer_history AS (
  SELECT *, effective_end_date IS NULL AS is_current,
         CAST(row_number() OVER (ORDER BY effective_start_date, customer_id) - 1 AS BIGINT)
           AS customer_sk
  FROM customer_changes)"""

PRODUCT_HISTORY = """
product_feed AS (
  SELECT CAST(l_partkey AS VARCHAR) AS stock_code, l_extendedprice / l_quantity AS unit_price,
         CAST(l_suppkey AS VARCHAR) AS supplier_id, CAST(l_shipdate AS DATE) AS feed_date,
         l_orderkey, l_linenumber
  FROM lineitem),
product_daily AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, feed_date
                   ORDER BY l_orderkey DESC NULLS LAST, l_linenumber DESC NULLS LAST,
                            unit_price DESC NULLS LAST, supplier_id DESC NULLS LAST) AS rn
                 FROM product_feed) t WHERE rn = 1),
product_lagged AS (
  SELECT *, row_number() OVER w AS nth, lag(unit_price) OVER w AS was_price
  FROM product_daily WINDOW w AS (PARTITION BY stock_code ORDER BY feed_date)),
product_changes AS (
  SELECT stock_code, unit_price, supplier_id, feed_date AS effective_start_date,
         lead(feed_date) OVER (PARTITION BY stock_code ORDER BY feed_date) AS effective_end_date
  FROM product_lagged WHERE nth = 1 OR unit_price IS DISTINCT FROM was_price),
product_history AS (
  SELECT *, effective_end_date IS NULL AS is_current,
         CAST(row_number() OVER (ORDER BY effective_start_date, stock_code) - 1 AS BIGINT)
           AS product_sk
  FROM product_changes)"""

STORES = """
stores AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, r_name AS region, n_name AS country,
         s_name AS store_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
store_dim AS (
  SELECT *, CAST(row_number() OVER (ORDER BY store_id) - 1 AS BIGINT) AS store_sk FROM stores)"""

ORDERS = """
online_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(first_part AS VARCHAR) AS stock_code, o_orderstatus AS order_status,
         CAST(o_orderdate AS DATE) AS order_date
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem
                         GROUP BY l_orderkey) p ON o_orderkey = l_orderkey)"""

SHIPPING = LINES + """,
shipping AS (
  SELECT 'S' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS shipment_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, 'carrier ' || l_linestatus AS carrier,
         CAST(l_shipdate AS DATE) AS ship_date
  FROM lines)"""

RETURNS = LINES + """,
returns AS (
  SELECT 'R' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
           AS return_invoice_id,
         CAST(l_orderkey AS VARCHAR) AS original_invoice_id,
         CAST(l_partkey AS VARCHAR) AS stock_code, CAST(l_quantity AS INTEGER) AS quantity
  FROM lines WHERE l_returnflag = 'R')"""

INVENTORY = """
inventory AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS stock_code,
         CAST(l_shipdate AS DATE) AS snapshot_date, CAST(sum(l_quantity) AS INTEGER) AS stock_on_hand
  FROM lineitem GROUP BY 1, 2, 3)"""


def valid_on(version: str, day: str) -> str:
    return (
        f"{day} >= {version}.effective_start_date AND "
        f"({version}.effective_end_date IS NULL OR {day} < {version}.effective_end_date)"
    )


FACT_SALES = ",".join([SALES, CUSTOMER_HISTORY, PRODUCT_HISTORY, STORES]) + f""",
fact_sales AS (
  SELECT s.invoice_id, s.stock_code, c.customer_sk, p.product_sk, t.store_sk, s.store_id,
         CAST(strftime(s.sale_date, '%Y%m%d') AS INTEGER) AS date_sk, s.sale_date, s.quantity,
         s.unit_price, s.quantity * s.unit_price AS line_total
  FROM sales s
  LEFT JOIN customer_history c ON s.customer_id = c.customer_id AND {valid_on('c', 's.sale_date')}
  LEFT JOIN product_history p ON s.stock_code = p.stock_code AND {valid_on('p', 's.sale_date')}
  LEFT JOIN store_dim t ON s.store_id = t.store_id)"""

FACT_RETURNS = RETURNS + """,
fact_returns AS (
  SELECT r.return_invoice_id, r.original_invoice_id, s.customer_sk, s.product_sk, r.quantity
  FROM returns r LEFT JOIN fact_sales s
    ON r.original_invoice_id = s.invoice_id AND r.stock_code = s.stock_code)"""

FACT_ORDERS = ",".join([ORDERS, CUSTOMER_HISTORY, PRODUCT_HISTORY]) + f""",
fact_orders AS (
  SELECT o.order_id, c.customer_sk, p.product_sk, o.order_status, o.order_date
  FROM online_orders o
  LEFT JOIN customer_history c ON o.customer_id = c.customer_id AND {valid_on('c', 'o.order_date')}
  LEFT JOIN product_history p ON o.stock_code = p.stock_code AND {valid_on('p', 'o.order_date')})"""

FACT_INVENTORY = ",".join([INVENTORY, PRODUCT_HISTORY, STORES]) + f""",
fact_inventory AS (
  SELECT t.store_sk, p.product_sk, i.snapshot_date, i.stock_on_hand
  FROM inventory i
  LEFT JOIN product_history p ON i.stock_code = p.stock_code AND {valid_on('p', 'i.snapshot_date')}
  LEFT JOIN store_dim t ON i.store_id = t.store_id)"""

CHECKED_CUSTOMERS = """
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, nullif(c_mktsegment, 'FURNITURE') AS segment,
         c_acctbal AS balance FROM customer),
checked AS (
  SELECT *, segment IS NOT NULL AS has_segment, balance >= 0 AS good_balance,
         segment IS NULL OR segment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') AS known_segment
  FROM customers)"""

CHECKED_ORDERS = """
checked_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS order_status,
         CAST(o_orderdate AS DATE) AS order_date FROM orders),
checked AS (
  SELECT *, order_status IN ('F', 'O') AS known_status,
         order_date <= DATE '2000-06-30' AS not_future FROM checked_orders)"""


def within(day: str, since: str | None, before: str | None) -> str:
    if since is None:
        return f"coalesce({day} < DATE '{before}', TRUE)"
    return f"{day} >= DATE '{since}'"


def line_state(name: str, since: str | None, before: str | None) -> str:
    return f"""
{name} AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, ship_date
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY ship_date DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem) l
        WHERE {within('ship_date', since, before)}) t
  WHERE rn = 1)"""


def customer_state(name: str, since: str | None, before: str | None) -> str:
    return f"""
{name} AS (
  SELECT customer_id, country, segment
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
          ORDER BY feed_date DESC, o_orderkey DESC) AS rn FROM customer_feed
        WHERE {within('feed_date', since, before)}) t
  WHERE rn = 1)"""


EARLY_LINES = line_state("early", None, "1998-07-01")
LATE_LINES = line_state("late", "1998-07-01", None)
TWO_BATCHES = ",".join(
    [
        CUSTOMER_FEED,
        customer_state("first_batch", None, "1998-07-01"),
        customer_state("second_batch", "1998-07-01", None),
    ]
) + """,
first_load AS (
  SELECT customer_id, country, segment,
         CAST(row_number() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS customer_sk,
         DATE '1995-01-01' AS effective_start_date
  FROM first_batch),
changed AS (
  SELECT s.* FROM second_batch s LEFT JOIN first_load t ON s.customer_id = t.customer_id
  WHERE t.customer_id IS NULL OR s.country IS DISTINCT FROM t.country
     OR s.segment IS DISTINCT FROM t.segment)"""


THREE_DAYS = (
    CUSTOMER_FEED,
    """
reported AS (
  SELECT customer_id, country, segment, day FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, day
        ORDER BY feed_date DESC NULLS LAST, o_orderkey DESC) AS rn
    FROM (SELECT *, CASE WHEN feed_date >= DATE '2000-07-01' THEN DATE '2002-01-01'
                         WHEN feed_date >= DATE '1998-07-01' THEN DATE '2000-07-01'
                         ELSE DATE '1998-07-01' END AS day FROM customer_feed) f) t
  WHERE rn = 1)""",
)
CORRECTED = """
  SELECT customer_id, country, CASE WHEN day = DATE '2000-07-01' AND customer_id::BIGINT % 5 = 0
                                    THEN 'MOVED' ELSE segment END AS segment, day
  FROM reported WHERE NOT (day = DATE '2000-07-01' AND customer_id::BIGINT % 3 = 0)"""


def folded(rows: str) -> str:
    """The history that the daily rows make, one version per change."""
    return f"""
lagged AS (
  SELECT *, row_number() OVER w AS nth, lag(country) OVER w AS was_country,
         lag(segment) OVER w AS was_segment
  FROM ({rows}) r WINDOW w AS (PARTITION BY customer_id ORDER BY day)),
folded AS (
  SELECT customer_id, country, segment, day AS effective_start_date,
         lead(day) OVER (PARTITION BY customer_id ORDER BY day) AS effective_end_date,
         lead(day) OVER (PARTITION BY customer_id ORDER BY day) IS NULL AS is_current
  FROM lagged
  WHERE nth = 1 OR country IS DISTINCT FROM was_country OR segment IS DISTINCT FROM was_segment)"""


def merged(day: str) -> str:
    return f"""
merged AS (
  SELECT t.customer_id, t.country, t.segment, t.customer_sk, t.effective_start_date,
         CASE WHEN c.customer_id IS NOT NULL THEN DATE '{day}' END AS effective_end_date,
         c.customer_id IS NULL AS is_current
  FROM first_load t LEFT JOIN changed c ON t.customer_id = c.customer_id
  UNION ALL
  SELECT customer_id, country, segment,
         CAST((SELECT max(customer_sk) FROM first_load)
              + row_number() OVER (ORDER BY customer_id) AS BIGINT),
         DATE '{day}', CAST(NULL AS DATE), TRUE
  FROM changed)"""


def with_(*parts: str) -> str:
    return "WITH" + ",".join(parts) + "\n"


FAILED_CUSTOMER_RULES = """concat_ws('; ',
         CASE WHEN NOT has_segment THEN 'not_null(segment)' END,
         CASE WHEN NOT good_balance THEN 'non_negative(balance)' END,
         CASE WHEN NOT known_segment THEN 'allowed_values(segment)' END)"""
FAILED_ORDER_RULES = """concat_ws('; ',
         CASE WHEN NOT known_status THEN 'allowed_values(order_status)' END,
         CASE WHEN NOT not_future THEN 'no_future_date(order_date)' END)"""
GOOD_CUSTOMER = "has_segment AND good_balance AND known_segment"
GOOD_ORDER = "known_status AND not_future"
FACT_COLUMNS = (
    "invoice_id, stock_code, customer_sk, product_sk, {store}, date_sk, sale_date, quantity, "
    "unit_price, line_total"
)
HISTORY_COLUMNS = "effective_start_date, effective_end_date, is_current"

#: What all gold tables of the retail specifications are made of, after one batch.
GOLD_PARTS = (with_(SALES, CUSTOMER_FEED, customer_state("last_report", None, "9999-12-31"), STORES,
    ORDERS, SHIPPING, RETURNS.removeprefix(LINES + ","), INVENTORY, KEPT_SALES)
+ """, customers AS (
  SELECT customer_id, country, segment,
         CAST(row_number() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS customer_sk
  FROM last_report),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stock_code, p_size, p_name, p_retailprice, p_brand,
         CAST(row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS BIGINT) AS product_sk
  FROM part),
sold AS (
  SELECT s.*, c.customer_sk, p.product_sk, t.store_sk FROM kept_sales s
  LEFT JOIN customers c ON s.customer_id = c.customer_id AND s.sale_date >= DATE '1995-01-01'
  LEFT JOIN products p ON s.stock_code = p.stock_code AND s.sale_date >= DATE '1995-01-01'
  LEFT JOIN store_dim t ON s.store_id = t.store_id),
ordered AS (
  SELECT o.order_id, o.order_status, o.order_date, c.customer_sk, p.product_sk FROM online_orders o
  LEFT JOIN customers c ON o.customer_id = c.customer_id AND o.order_date >= DATE '1995-01-01'
  LEFT JOIN products p ON o.stock_code = p.stock_code AND o.order_date >= DATE '1995-01-01'),
stock AS (
  SELECT i.*, p.product_sk, t.store_sk FROM inventory i
  LEFT JOIN products p ON i.stock_code = p.stock_code AND i.snapshot_date >= DATE '1995-01-01'
  LEFT JOIN store_dim t ON i.store_id = t.store_id),
days AS (
  SELECT sale_date AS day FROM kept_sales UNION ALL SELECT order_date FROM online_orders
  UNION ALL SELECT snapshot_date FROM inventory UNION ALL SELECT ship_date FROM shipping)"""
)

DATED = {
    "effective_start_date": "DATE '1995-01-01'", "effective_end_date": "NULL", "is_current": "TRUE",
}
#: Every gold table with all its columns and where they come from. Prices are compared in thousandths.
GOLD_COLUMNS = {
    "dim_customer": (dict(customer_id="", country="", segment="", customer_sk="", **DATED), "customers"),
    "dim_product": (
        dict(stock_code="", description="p_name", unit_price="1000*p_retailprice", supplier_id="p_brand",
             product_sk="", **DATED),
        "products",
    ),
    "dim_store": (dict(store_id="", region="", country="", store_name="", store_sk=""), "store_dim"),
    "dim_supplier": (
        dict(supplier_id="", supplier_name="", supplier_sk="row_number() OVER (ORDER BY supplier_id) - 1"),
        "(SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name FROM supplier)",
    ),
    "dim_date": (
        dict(date_sk="strftime(full_date, '%Y%m%d')", full_date="", year="year(full_date)",
             month="month(full_date)", day="day(full_date)", quarter="quarter(full_date)",
             day_name="dayname(full_date)", month_name="monthname(full_date)",
             is_weekend="isodow(full_date) >= 6"),
        "(SELECT CAST(unnest(range(make_date(min(year(day)), 1, 1)::TIMESTAMP, "
        "make_date(max(year(day)) + 1, 1, 1)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS full_date FROM days)",
    ),
    "fact_sales": (
        dict(invoice_id="", stock_code="", customer_sk="", product_sk="", store_sk="",
             date_sk="strftime(sale_date, '%Y%m%d')", sale_date="", quantity="",
             unit_price="1000*unit_price", line_total="1000*(quantity * unit_price)"),
        "sold",
    ),
    "fact_returns": (
        dict(return_invoice_id="", original_invoice_id="", customer_sk="", product_sk="",
             quantity="r.quantity"),
        "returns r LEFT JOIN sold s ON r.original_invoice_id = s.invoice_id AND r.stock_code = s.stock_code",
    ),
    "fact_online_orders": (
        dict(order_id="", customer_sk="", product_sk="", order_status="", order_date=""), "ordered",
    ),
    "fact_shipping": (
        dict(shipment_id="", order_id="", customer_sk="", carrier="", ship_date=""),
        "shipping LEFT JOIN ordered USING (order_id)",
    ),
    "fact_inventory_snapshot": (
        dict(store_sk="", product_sk="", snapshot_date="", stock_on_hand=""), "stock",
    ),
    "bridge_promotions": (
        dict(promo_id="'P' || stock_code", product_sk="", start_date="starts",
             end_date="starts + CAST(p_size AS INTEGER)", discount_pct="1000*(p_size / 100.0::DOUBLE)"),
        "(SELECT *, CAST(DATE '1995-01-01' + to_months(CAST(p_size AS INTEGER)) AS DATE) AS starts FROM products)",
    ),
}


def checksum(name: str, columns: dict[str, str], source: str) -> str:
    """Rows of a table and the sum of a 60-bit hash of each, over all columns in order of their names."""
    texts = []
    for column, found in sorted(columns.items()):
        value = found or column
        if value.startswith("1000*"):
            value = f"CAST(floor({value[5:]} * 1000) AS BIGINT)"
        texts.append(f"coalesce(CAST({value} AS VARCHAR), '~') AS t_{column}")
    row = " || '|' || ".join(f"t_{column}" for column in sorted(columns))
    return f"""SELECT '{name}' AS table_name, '{",".join(sorted(columns))}' AS columns, count(*) AS n_rows,
      CAST(sum(('0x' || substr(md5({row}), 1, 15))::BIGINT) AS VARCHAR) AS checksum
      FROM (SELECT {", ".join(texts)} FROM {source})"""


ORACLE: dict[str, str] = {
    "read_landing_csv": with_(CHECKED_ORDERS)
    + "SELECT order_id, order_status, order_date FROM checked",
    "tag_audit_columns": with_(CHECKED_ORDERS)
    + """SELECT order_id, order_status, order_date, 'orders' AS _source_file,
         '2026-01-02T03:04:05+00:00' AS _ingest_ts, 'batch-1' AS _batch_id,
         DATE '2026-01-02' AS _ingest_date FROM checked""",
    "dq_valid": with_(CHECKED_CUSTOMERS)
    + f"SELECT customer_id, segment, balance FROM checked WHERE {GOOD_CUSTOMER}",
    "dq_invalid": with_(CHECKED_CUSTOMERS)
    + f"""SELECT customer_id, segment, balance, {FAILED_CUSTOMER_RULES} AS failed_rules
          FROM checked WHERE NOT ({GOOD_CUSTOMER})""",
    "dq_valid_orders": with_(CHECKED_ORDERS)
    + f"SELECT order_id, order_status, order_date FROM checked WHERE {GOOD_ORDER}",
    "dq_invalid_orders": with_(CHECKED_ORDERS)
    + f"""SELECT order_id, order_status, order_date, {FAILED_ORDER_RULES} AS failed_rules
          FROM checked WHERE NOT ({GOOD_ORDER})""",
    "dq_summary_customers": with_(CHECKED_CUSTOMERS)
    + f""", counted AS (SELECT count(*) AS total_count,
           count(*) FILTER (WHERE {GOOD_CUSTOMER}) AS valid_count FROM checked)
         SELECT 'customer' AS table_name, total_count, valid_count,
                total_count - valid_count AS invalid_count,
                valid_count * 100.0::DOUBLE / total_count AS pass_rate,
                CASE WHEN valid_count * 100.0::DOUBLE / total_count >= 95 THEN 'INFO'
                     ELSE 'WARNING' END AS level FROM counted""",
    "dq_violations_customers": with_(CHECKED_CUSTOMERS)
    + """SELECT * FROM (
           SELECT 'customer' AS table_name, 'not_null' AS rule_name, 'segment' AS column_name,
                  count(*) FILTER (WHERE NOT has_segment) AS failed_count FROM checked
           UNION ALL SELECT 'customer', 'non_negative', 'balance',
                  count(*) FILTER (WHERE NOT good_balance) FROM checked
           UNION ALL SELECT 'customer', 'allowed_values', 'segment',
                  count(*) FILTER (WHERE NOT known_segment) FROM checked) v
         WHERE failed_count > 0""",
    "dq_violations_orders": with_(CHECKED_ORDERS)
    + """SELECT * FROM (
           SELECT 'orders' AS table_name, 'allowed_values' AS rule_name,
                  'order_status' AS column_name,
                  count(*) FILTER (WHERE NOT known_status) AS failed_count FROM checked
           UNION ALL SELECT 'orders', 'no_future_date', 'order_date',
                  count(*) FILTER (WHERE NOT not_future) FROM checked) v
         WHERE failed_count > 0""",
    "null_profile_customers": with_(CHECKED_CUSTOMERS)
    + """SELECT column_name, nulls AS null_count,
                nulls * 100.0::DOUBLE / total AS null_percent,
                nulls * 100.0::DOUBLE / total <= 5 AS within_limit
         FROM (SELECT 'customer_id' AS column_name, count(*) - count(customer_id) AS nulls,
                      count(*) AS total FROM customers
               UNION ALL SELECT 'segment', count(*) - count(segment), count(*) FROM customers
               UNION ALL SELECT 'balance', count(*) - count(balance), count(*) FROM customers) p""",
    "quarantine_by_rule": with_(CHECKED_CUSTOMERS)
    + """SELECT 'customer' AS table_name, failed_rule, count(*) AS row_count
         FROM (SELECT 'not_null(segment)' AS failed_rule FROM checked WHERE NOT has_segment
               UNION ALL SELECT 'non_negative(balance)' FROM checked WHERE NOT good_balance
               UNION ALL SELECT 'allowed_values(segment)' FROM checked WHERE NOT known_segment) f
         GROUP BY failed_rule""",
    "dedup_lines": with_(LINES) + "SELECT * FROM lines",
    "incremental_by_date": """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS _ingest_date
        FROM orders WHERE CAST(o_orderdate AS DATE) >
          (SELECT max(CAST(o_orderdate AS DATE)) FROM orders
           WHERE CAST(o_orderdate AS DATE) < DATE '1998-07-01')""",
    "incremental_by_batch": """
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS _batch_id FROM orders
        WHERE year(o_orderdate) NOT IN
          (SELECT year(l_shipdate) FROM lineitem WHERE l_shipdate < DATE '1998-07-01')""",
    "upsert_lines": with_(EARLY_LINES, LATE_LINES)
    + """SELECT * FROM late UNION ALL
         SELECT e.* FROM early e WHERE NOT EXISTS (SELECT 1 FROM late l
           WHERE l.l_orderkey = e.l_orderkey AND l.l_linenumber = e.l_linenumber)""",
    "upsert_lines_replayed": with_(EARLY_LINES, LATE_LINES)
    + """SELECT * FROM late UNION ALL
         SELECT e.* FROM early e WHERE NOT EXISTS (SELECT 1 FROM late l
           WHERE l.l_orderkey = e.l_orderkey AND l.l_linenumber = e.l_linenumber)""",
    "history_first_load": with_(TWO_BATCHES)
    + """SELECT customer_id, country, segment, customer_sk, effective_start_date,
                CAST(NULL AS DATE) AS effective_end_date, TRUE AS is_current FROM first_load""",
    "history_changes": with_(TWO_BATCHES) + "SELECT * FROM changed",
    "history_merge": with_(TWO_BATCHES, merged("2002-01-01")) + "SELECT * FROM merged",
    "history_merge_repeated": with_(TWO_BATCHES, merged("2002-01-01")) + "SELECT * FROM merged",
    "history_rebuild_customers": with_(CUSTOMER_HISTORY)
    + f"SELECT customer_id, country, segment, {HISTORY_COLUMNS}, customer_sk FROM customer_history",
    "history_rebuild_dated_back": with_(CUSTOMER_HISTORY)
    + """SELECT customer_id, country, segment,
                CASE WHEN effective_start_date
                          = (SELECT min(effective_start_date) FROM customer_history)
                     THEN DATE '1900-01-01' ELSE effective_start_date END AS effective_start_date,
                effective_end_date, is_current, customer_sk FROM customer_history""",
    "history_rebuild_products": with_(PRODUCT_HISTORY)
    + f"SELECT stock_code, unit_price, supplier_id, {HISTORY_COLUMNS}, product_sk "
    "FROM product_history",
    "history_rebuild_events": """
WITH feed AS (
  SELECT user_id, event_type, CAST(ts AS DATE) AS feed_date, event_id FROM events),
daily AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, feed_date
                   ORDER BY event_id DESC) AS rn FROM feed) t WHERE rn = 1),
lagged AS (
  SELECT *, row_number() OVER w AS nth, lag(event_type) OVER w AS was FROM daily
  WINDOW w AS (PARTITION BY user_id ORDER BY feed_date)),
changes AS (
  SELECT user_id, event_type, feed_date AS effective_start_date,
         lead(feed_date) OVER (PARTITION BY user_id ORDER BY feed_date) AS effective_end_date
  FROM lagged WHERE nth = 1 OR event_type IS DISTINCT FROM was)
SELECT *, effective_end_date IS NULL AS is_current,
       CAST(row_number() OVER (ORDER BY effective_start_date, user_id) - 1 AS BIGINT) AS user_sk
FROM changes""",
    "current_customers": with_(CUSTOMER_HISTORY)
    + """SELECT customer_sk, customer_id, country, segment, effective_start_date
         FROM customer_history WHERE is_current""",
    "customer_versions": with_(CUSTOMER_HISTORY)
    + """SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id
                  ORDER BY effective_start_date) AS INTEGER) AS version,
                customer_sk, country, segment, effective_start_date, effective_end_date
         FROM customer_history""",
    "surrogate_keys": with_(LINES)
    + """SELECT l_orderkey, l_linenumber, l_shipdate, CAST(row_number() OVER
           (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS BIGINT) AS line_sk FROM lines""",
    "customer_row_hash": with_(CHECKED_CUSTOMERS)
    + """SELECT customer_id, segment, sha256(
           CAST(length(customer_id) AS VARCHAR) || ':' || customer_id || '|' ||
           coalesce(CAST(length(segment) AS VARCHAR) || ':' || segment, '~')) AS row_hash
         FROM customers""",
    "point_in_time": with_(ORDERS, CUSTOMER_HISTORY)
    + f"""SELECT o.order_id, o.customer_id, o.order_date, c.customer_sk FROM online_orders o
          LEFT JOIN customer_history c
            ON o.customer_id = c.customer_id AND {valid_on('c', 'o.order_date')}""",
    "point_in_time_asof": with_(SALES, PRODUCT_HISTORY)
    + f"""SELECT s.invoice_id, s.stock_code, s.sale_date, p.product_sk FROM sales s
          LEFT JOIN product_history p
            ON s.stock_code = p.stock_code AND {valid_on('p', 's.sale_date')}""",
    "point_in_time_overlap": with_(ORDERS, CUSTOMER_HISTORY)
    + f"""SELECT o.order_id, o.customer_id, o.order_date, c.customer_sk, s.strategy
          FROM (SELECT 'range' AS strategy UNION ALL SELECT 'asof') s, online_orders o
          LEFT JOIN customer_history c
            ON o.customer_id = c.customer_id AND {valid_on('c', 'o.order_date')}""",
    "point_in_time_last_day": with_(ORDERS, CUSTOMER_HISTORY)
    + """SELECT o.order_id, o.customer_id, o.order_date, c.customer_sk FROM online_orders o
         LEFT JOIN (SELECT customer_id, customer_sk, effective_start_date AS first_day,
                           coalesce(effective_end_date - 1, DATE '9999-12-31') AS last_day
                    FROM customer_history) c
           ON o.customer_id = c.customer_id AND o.order_date BETWEEN c.first_day AND c.last_day""",
    "store_lookup": with_(SALES, STORES)
    + """SELECT s.invoice_id, s.stock_code, s.store_id, t.region, t.country
         FROM sales s LEFT JOIN stores t ON s.store_id = t.store_id""",
    "inherited_keys": with_(SHIPPING, ORDERS)
    + """SELECT s.*, o.customer_id, o.order_date
         FROM shipping s LEFT JOIN online_orders o ON s.order_id = o.order_id""",
    "dim_date": """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, d AS full_date,
       CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       CAST(day(d) AS INTEGER) AS day, CAST(quarter(d) AS INTEGER) AS quarter,
       dayname(d) AS day_name, monthname(d) AS month_name, isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)),
        max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM orders) t""",
    "dim_customer": with_(CUSTOMER_HISTORY)
    + f"SELECT customer_id, country, segment, {HISTORY_COLUMNS}, customer_sk FROM customer_history",
    "dim_product": with_(PRODUCT_HISTORY)
    + f"""SELECT stock_code, unit_price, supplier_id, {HISTORY_COLUMNS}, product_sk,
                 p_name AS description
          FROM product_history LEFT JOIN part ON stock_code = CAST(p_partkey AS VARCHAR)""",
    "dim_store": with_(STORES) + "SELECT * FROM store_dim",
    "dim_supplier": """
SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name,
       CAST(row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS BIGINT) AS supplier_sk
FROM supplier""",
    "fact_sales": with_(FACT_SALES)
    + f"SELECT {FACT_COLUMNS.format(store='store_sk')} FROM fact_sales",
    "fact_sales_store_id": with_(FACT_SALES)
    + f"SELECT {FACT_COLUMNS.format(store='store_id')} FROM fact_sales",
    "fact_returns": with_(FACT_SALES, FACT_RETURNS) + "SELECT * FROM fact_returns",
    "fact_returns_invoice_only": with_(FACT_SALES, FACT_RETURNS)
    + """, firsts AS (
  SELECT invoice_id, customer_sk, product_sk FROM (
    SELECT *, row_number() OVER (PARTITION BY invoice_id
      ORDER BY customer_sk NULLS FIRST, product_sk NULLS FIRST) AS rn FROM fact_sales) t
  WHERE rn = 1)
SELECT r.return_invoice_id, r.original_invoice_id, f.customer_sk, f.product_sk, r.quantity
FROM returns r LEFT JOIN firsts f ON r.original_invoice_id = f.invoice_id""",
    "fact_online_orders": with_(FACT_ORDERS) + "SELECT * FROM fact_orders",
    "fact_shipping": with_(FACT_ORDERS, SHIPPING)
    + """SELECT s.shipment_id, s.order_id, o.customer_sk, s.carrier, s.ship_date
         FROM shipping s LEFT JOIN fact_orders o ON s.order_id = o.order_id""",
    "fact_inventory_snapshot": with_(FACT_INVENTORY) + "SELECT * FROM fact_inventory",
    "bridge_promotions": with_(PRODUCT_HISTORY)
    + f""", promotions AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS promo_id, CAST(p_partkey AS VARCHAR) AS stock_code,
         CAST(DATE '1995-01-01' + to_months(p_size) AS DATE) AS start_date,
         p_size, p_size / 100.0::DOUBLE AS discount_pct FROM part)
SELECT m.promo_id, p.product_sk, m.start_date, m.start_date + m.p_size AS end_date, m.discount_pct
FROM promotions m LEFT JOIN product_history p
  ON m.stock_code = p.stock_code AND {valid_on('p', 'm.start_date')}""",
    "promotions_at_sale": with_(SALES)
    + """, last_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST,
                   l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST,
                   l_extendedprice DESC NULLS LAST, l_returnflag DESC NULLS LAST,
                   l_linestatus DESC NULLS LAST, l_discount DESC NULLS LAST) AS rn FROM lineitem),
offers AS (
  SELECT 'O' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS promo_id,
         CAST(l_partkey AS VARCHAR) AS stock_code, CAST(l_shipdate AS DATE) AS start_date,
         CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_date,
         l_discount AS discount_pct
  FROM last_lines WHERE rn = 1),
ranked AS (
  SELECT s.invoice_id, s.stock_code, s.sale_date, o.promo_id, o.discount_pct,
         row_number() OVER (PARTITION BY s.invoice_id, s.stock_code
           ORDER BY o.discount_pct DESC NULLS LAST, o.promo_id NULLS LAST) AS best
  FROM sales s LEFT JOIN offers o
    ON s.stock_code = o.stock_code AND s.sale_date BETWEEN o.start_date AND o.end_date)
SELECT invoice_id, stock_code, sale_date, promo_id, discount_pct FROM ranked WHERE best = 1""",
    "foreign_keys": with_(FACT_SALES)
    + """SELECT 'fact_sales' AS fact_name, 'customer_sk' AS key_column,
                count(*) AS fact_rows, count(*) - count(customer_sk) AS unresolved_rows,
                count(*) FILTER (WHERE customer_sk NOT IN
                  (SELECT customer_sk FROM customer_history)) AS orphan_rows FROM fact_sales
         UNION ALL
         SELECT 'fact_sales', 'product_sk', count(*), count(*) - count(product_sk),
                count(*) FILTER (WHERE product_sk NOT IN
                  (SELECT product_sk FROM product_history)) FROM fact_sales
         UNION ALL
         SELECT 'fact_sales', 'store_sk', count(*), count(*) - count(store_sk),
                count(*) FILTER (WHERE store_sk NOT IN (SELECT store_sk FROM store_dim)) FROM fact_sales
         UNION ALL
         SELECT 'fact_sales', 'date_sk', count(*), count(*) - count(date_sk),
                count(*) FILTER (WHERE sale_date <
                    (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) OR sale_date >
                    (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) FROM fact_sales""",
    "revenue_by_country": with_(FACT_SALES)
    + """SELECT country, CAST(round(sum(CAST(line_total AS DECIMAL(28, 6))), 2) AS DOUBLE) AS revenue
         FROM fact_sales JOIN customer_history USING (customer_sk)
         GROUP BY country ORDER BY revenue DESC, country""",
    "top_customers": with_(FACT_SALES)
    + """SELECT customer_sk, CAST(round(sum(CAST(line_total AS DECIMAL(28, 6))), 2) AS DOUBLE) AS revenue
         FROM fact_sales
         GROUP BY customer_sk ORDER BY revenue DESC, customer_sk NULLS LAST LIMIT 10""",
    "return_rate": with_(FACT_SALES, FACT_RETURNS)
    + """, sold AS (
  SELECT product_sk, CAST(sum(quantity) AS BIGINT) AS sold_quantity FROM fact_sales GROUP BY product_sk),
back AS (
  SELECT product_sk, CAST(sum(quantity) AS BIGINT) AS quantity FROM fact_returns GROUP BY product_sk)
SELECT s.product_sk, s.sold_quantity, coalesce(b.quantity, 0) AS returned_quantity,
       CASE WHEN s.sold_quantity > 0
         THEN coalesce(b.quantity, 0) * 100.0::DOUBLE / s.sold_quantity END AS return_percent
FROM sold s LEFT JOIN back b ON s.product_sk IS NOT DISTINCT FROM b.product_sk""",
    "latest_stock": with_(FACT_INVENTORY)
    + """SELECT store_sk, stock_code, snapshot_date, stock_on_hand FROM (
           SELECT i.*, p.stock_code, row_number() OVER (PARTITION BY i.store_sk, p.stock_code
             ORDER BY i.snapshot_date DESC) AS rn
           FROM fact_inventory i JOIN product_history p ON i.product_sk = p.product_sk) t
         WHERE rn = 1""",
    "preview_orders": with_(CHECKED_ORDERS)
    + """SELECT order_id, order_status, order_date FROM checked
         ORDER BY order_date NULLS LAST, order_id NULLS LAST LIMIT 10""",
    "landing_to_star": with_(SALES, TWO_BATCHES, merged("1998-07-02"), STORES)
    + f""", parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stock_code,
         CAST(row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS BIGINT) AS product_sk
  FROM part)
SELECT s.invoice_id, s.stock_code, m.customer_sk, p.product_sk, t.store_sk,
       CAST(strftime(s.sale_date, '%Y%m%d') AS INTEGER) AS date_sk, s.sale_date, s.quantity,
       s.unit_price, s.quantity * s.unit_price AS line_total
FROM sales s
LEFT JOIN merged m ON s.customer_id = m.customer_id AND {valid_on('m', 's.sale_date')}
LEFT JOIN parts p ON s.stock_code = p.stock_code
LEFT JOIN store_dim t ON s.store_id = t.store_id""",
    "bronze_and_quarantine": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS order_status,
       CAST(o_orderdate AS DATE) AS order_date, DATE '2000-06-30' AS _ingest_date,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE 'allowed_values(order_status)' END
         AS failed_rules
FROM orders""",
    "run_metrics": """
WITH counted AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS good FROM orders)
SELECT 'online_orders' AS table_name, 'bronze' AS layer, CAST(NULL AS BIGINT) AS incremental_count,
       total AS total_count, good AS valid_count, total - good AS invalid_count,
       CAST(NULL AS BIGINT) AS row_count, good * 100.0::DOUBLE / total AS pass_rate,
       CASE WHEN good * 100.0::DOUBLE / total >= 95 THEN 'INFO' ELSE 'WARNING' END AS level,
       CAST(NULL AS VARCHAR) AS skipped
FROM counted
UNION ALL SELECT 'online_orders', 'silver', good, good, good, 0, NULL, 100.0::DOUBLE, 'INFO', NULL
FROM counted
UNION ALL SELECT 'online_orders', 'silver', 0, 0, 0, 0, NULL, 100.0::DOUBLE, 'INFO', NULL
UNION ALL SELECT 'dim_store', 'gold', NULL, NULL, NULL, NULL, 0, NULL, NULL,
  'not built yet: silver.store'
UNION ALL SELECT 'dim_date', 'gold', NULL, NULL, NULL, NULL,
  make_date(max(year(o_orderdate)), 12, 31) - make_date(min(year(o_orderdate)), 1, 1) + 1,
  NULL, NULL, NULL FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "silver_quarantine": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS order_status,
       CAST(o_orderdate AS DATE) AS order_date,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE 'allowed_values(order_status)' END
         AS failed_rules
FROM orders""",
    "deleted_day_then_new_day": with_(ORDERS)
    + """, good AS (SELECT * FROM online_orders WHERE order_status IN ('F', 'O'))
SELECT *, 'silver' AS layer FROM good
UNION ALL SELECT *, 'bronze' FROM good WHERE order_date < DATE '1998-07-01'
  OR order_date >= DATE '2000-07-01' OR order_date IS NULL""",
    "gold_star": GOLD_PARTS + """,
digest(table_name, n_rows, customer_keys, product_keys, store_keys, amount) AS (
  SELECT 'dim_customer', count(*), sum(customer_sk), 0, 0, 0 FROM customers
  UNION ALL SELECT 'dim_product', count(*), 0, sum(product_sk), 0, 0 FROM products
  UNION ALL SELECT 'dim_store', count(*), 0, 0, sum(store_sk), 0 FROM store_dim
  UNION ALL SELECT 'dim_supplier', count(*), 0, 0, 0, 0 FROM supplier
  UNION ALL SELECT 'dim_date', make_date(max(year(day)), 12, 31) - make_date(min(year(day)), 1, 1) + 1,
    0, 0, 0, 0 FROM days
  UNION ALL SELECT 'fact_sales', count(*), sum(customer_sk), sum(product_sk), sum(store_sk), sum(quantity)
    FROM sold
  UNION ALL SELECT 'fact_returns', count(*), sum(s.customer_sk), sum(s.product_sk), 0, sum(r.quantity)
    FROM returns r LEFT JOIN sold s ON r.original_invoice_id = s.invoice_id AND r.stock_code = s.stock_code
  UNION ALL SELECT 'fact_online_orders', count(*), sum(customer_sk), sum(product_sk), 0, 0 FROM ordered
  UNION ALL SELECT 'fact_shipping', count(*), sum(customer_sk), 0, 0, 0
    FROM shipping LEFT JOIN ordered USING (order_id)
  UNION ALL SELECT 'fact_inventory_snapshot', count(*), 0, sum(product_sk), sum(store_sk), sum(stock_on_hand)
    FROM stock
  UNION ALL SELECT 'bridge_promotions', count(*), 0, sum(product_sk), 0, 0 FROM products)
SELECT table_name, n_rows, coalesce(customer_keys, 0)::BIGINT AS customer_keys,
       coalesce(product_keys, 0)::BIGINT AS product_keys, coalesce(store_keys, 0)::BIGINT AS store_keys,
       coalesce(amount, 0)::BIGINT AS amount FROM digest""",
    "gold_incremental": with_(SALES, TWO_BATCHES, merged("1998-07-02"), STORES, KEPT_SALES)
    + f""", parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stock_code,
         CAST(row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS BIGINT) AS product_sk
  FROM part)
SELECT s.invoice_id, s.stock_code, m.customer_sk, p.product_sk, t.store_sk,
       CAST(strftime(s.sale_date, '%Y%m%d') AS INTEGER) AS date_sk, s.sale_date, s.quantity,
       s.unit_price, s.quantity * s.unit_price AS line_total
FROM kept_sales s
LEFT JOIN merged m ON s.customer_id = m.customer_id AND {valid_on('m', 's.sale_date')}
LEFT JOIN parts p ON s.stock_code = p.stock_code AND s.sale_date >= DATE '1995-01-01'
LEFT JOIN store_dim t ON s.store_id = t.store_id""",
    "clustered_skewed": "SELECT count(*) AS n_rows, TRUE AS tighter FROM orders",
    "silver_upsert": with_(EARLY_LINES, LATE_LINES)
    + """, merged AS (
  SELECT * FROM late UNION ALL
  SELECT e.* FROM early e WHERE NOT EXISTS (SELECT 1 FROM late l
    WHERE l.l_orderkey = e.l_orderkey AND l.l_linenumber = e.l_linenumber))
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
       CAST(l_partkey AS VARCHAR) AS l_partkey, l_quantity, l_extendedprice, ship_date
FROM merged""",
    "reprocessed_day": with_(ORDERS)
    + """, good AS (SELECT * FROM online_orders WHERE order_status IN ('F', 'O'))
SELECT *, 'silver' AS layer FROM good UNION ALL SELECT *, 'bronze' FROM good""",
    "reprocessed_history": with_(*THREE_DAYS, folded(CORRECTED)) + "SELECT * FROM folded",
    "gold_after_correction": with_(SALES, *THREE_DAYS, folded(CORRECTED), KEPT_SALES)
    + f"""SELECT s.invoice_id, s.stock_code, s.sale_date, f.customer_id, f.country, f.segment,
                f.effective_start_date
          FROM kept_sales s LEFT JOIN folded f
            ON s.customer_id = f.customer_id AND {valid_on('f', 's.sale_date')}""",
    "held_batch": with_(*THREE_DAYS)
    + """, gated AS (
  SELECT customer_id, country, nullif(segment, '1-URGENT') AS segment, day AS _ingest_date
  FROM reported WHERE day = DATE '2000-07-01')
SELECT customer_id, country, segment, day AS _ingest_date, 'bronze' AS layer, '' AS fault
FROM reported WHERE day = DATE '1998-07-01'
UNION ALL SELECT *, 'held', (SELECT 'segment: ' ||
  printf('%.2f', 100.0::DOUBLE * count(*) FILTER (WHERE segment IS NULL) / count(*))
  || ' % NULL, at most 5.00 %' FROM gated) FROM gated""",
    "replayed_quarantine": with_(ORDERS)
    + """, placed AS (
  SELECT order_id, order_status, order_date,
         order_status IN ('F', 'O') OR order_date <= DATE '2000-06-30' AS good FROM online_orders)
SELECT order_id, order_status, order_date, 'bronze' AS layer, '' AS failed_rules FROM placed WHERE good
UNION ALL SELECT order_id, order_status, order_date, 'silver', '' FROM placed WHERE good
UNION ALL SELECT order_id, order_status, order_date, 'quarantine', 'no_future_date(order_date)'
FROM placed WHERE NOT good""",
    "repaired_keys": with_(SALES, CUSTOMER_FEED, customer_state("last_report", None, "9999-12-31"), KEPT_SALES)
    + """, known AS (
  SELECT s.*, r.customer_id AS known_id, country, segment FROM kept_sales s
  LEFT JOIN last_report r ON s.customer_id = r.customer_id AND s.sale_date >= DATE '1995-01-01')
SELECT invoice_id, stock_code, sale_date, known_id AS customer_id, country, segment,
       CASE WHEN known_id IS NOT NULL THEN DATE '1995-01-01' END AS effective_start_date,
       coalesce(bool_or(known_id::BIGINT % 500 = 7) OVER (PARTITION BY date_trunc('month', sale_date)), FALSE)
         AS rewritten
FROM known""",
    "removed_version_then_new": with_(*THREE_DAYS, folded(CORRECTED))
    + "SELECT *, CAST(1 AS BIGINT) AS owners FROM folded",
    "relanded_then_next_day": with_(*THREE_DAYS)
    + f"SELECT customer_id, country, segment, day AS _ingest_date FROM ({CORRECTED}) c",
    "late_batches": with_(*THREE_DAYS, folded("SELECT * FROM reported")) + "SELECT * FROM folded",
    "silver_catch_up": with_(*THREE_DAYS, folded("SELECT * FROM reported")) + "SELECT * FROM folded",
    "clustered_sales": with_(SALES)
    + """SELECT CAST(customer_id AS BIGINT) AS customer_key, CAST(stock_code AS BIGINT) AS part_key,
                CAST(year(sale_date) AS INTEGER) AS sale_year,
                CAST(strftime(sale_date, '%Y%m%d') AS INTEGER) AS date_sk, invoice_id, quantity
         FROM sales""",
    "clustered_order": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "catalog_tables": with_(CHECKED_ORDERS)
    + """SELECT order_id, order_status, order_date FROM checked
         WHERE order_status <> 'F' AND order_date <> DATE '1998-07-01'""",
    "stream_bronze": with_(ORDERS)
    + "SELECT * FROM online_orders WHERE order_status IN ('F', 'O')",
    "stream_two_sources": with_(ORDERS)
    + "SELECT * FROM online_orders WHERE order_status IN ('F', 'O')",
}
ORACLE["catalog_pipeline"] = GOLD_PARTS + "\n" + " UNION ALL ".join(
    checksum(name, *found) for name, found in GOLD_COLUMNS.items()
)
#: A stream that brings the fact up to date gives what the batches give.
ORACLE["stream_gold"] = ORACLE["gold_incremental"]
