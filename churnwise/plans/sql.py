"""ANSI SQL twins of the bound tables and registered queries, for the DuckDB
oracle.  Each binding is a CTE; ``with_ctes`` prepends the ones a query needs
in dependency order.  Literals that feed double arithmetic are written as
DOUBLE so both engines add and compare the same binary values.
"""

from __future__ import annotations

# Binding CTEs (FIXTURES.md section 2) ---------------------------------------
_CTE = {
    "A": "SELECT max(o_orderdate) AS as_of FROM orders",
    "L": """SELECT l_orderkey, count(*) AS n_lines, min(l_suppkey) AS seller_id,
        sum(l_extendedprice * l_tax) AS payment, avg(l_discount) AS avg_discount,
        bool_and(l_returnflag = 'R') AS all_returned, max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY l_orderkey""",
    "tx": """SELECT o.o_orderkey AS transaction_id, o.o_custkey AS customer_id, L.seller_id,
        o.o_orderdate AS transaction_date, o.o_totalprice AS sales_amount,
        o.o_orderpriority AS service_category,
        CAST(least(coalesce(L.n_lines, 0), 10) AS INTEGER) AS modification_count,
        coalesce(L.payment, 0.0::DOUBLE) AS additional_payment,
        round(coalesce(5.0::DOUBLE - 40.0::DOUBLE * L.avg_discount, 5.0::DOUBLE), 6) AS service_rating,
        CAST(coalesce(L.all_returned, false) AS INTEGER) AS transaction_canceled,
        CASE WHEN coalesce(L.all_returned, false) THEN L.last_ship END AS cancellation_date
        FROM orders o LEFT JOIN L ON o.o_orderkey = L.l_orderkey""",
    "tx180": """SELECT tx.* FROM tx CROSS JOIN A
        WHERE tx.transaction_date > A.as_of - INTERVAL 180 DAY""",
    "O": """SELECT o_custkey, min(o_orderdate) AS join_date, max(o_orderdate) AS last_order,
        sum(o_totalprice) AS spent, count(*) AS orders, avg(o_totalprice) AS avg_order_value
        FROM orders GROUP BY o_custkey""",
    "E": """SELECT user_id, count(*) AS tickets FROM events WHERE event_type = 'error'
        GROUP BY user_id""",
    "cu0": """SELECT c.c_custkey AS customer_id, CAST(20 + c.c_custkey % 41 AS INTEGER) AS age,
        r.r_name AS region,
        CASE WHEN c.c_acctbal < 0 THEN 'company' ELSE 'person' END AS customer_type,
        CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Premium'
             WHEN c.c_mktsegment = 'MACHINERY' THEN 'Enterprise'
             WHEN c.c_mktsegment = 'FURNITURE' THEN NULL ELSE 'Basic' END AS subscription_type,
        O.join_date, coalesce(O.spent, 0.0::DOUBLE) AS total_spent,
        coalesce(O.orders, 0) AS total_orders, O.avg_order_value,
        datesub('day', O.last_order, A.as_of) AS last_order_days,
        coalesce(E.tickets, 0) AS support_tickets
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN O ON c.c_custkey = O.o_custkey
        LEFT JOIN E ON c.c_custkey = E.user_id
        CROSS JOIN A""",
    "cuq": "SELECT quantile_cont(CAST(avg_order_value AS DOUBLE), 0.25) AS q_low FROM cu0",
    "cus": """SELECT cu0.*,
        CAST(coalesce(last_order_days > 90, false) AS INTEGER) * 0.3::DOUBLE
        + CAST(coalesce(support_tickets > 5, false) AS INTEGER) * 0.2::DOUBLE
        + CAST(coalesce(total_orders < 5, false) AS INTEGER) * 0.2::DOUBLE
        + CAST(coalesce(avg_order_value < cuq.q_low, false) AS INTEGER) * 0.15::DOUBLE
          AS churn_probability
        FROM cu0 CROSS JOIN cuq""",
    "cu": """SELECT cus.*, CAST(coalesce(churn_probability > 0.4::DOUBLE, false) AS INTEGER) AS churn
        FROM cus""",
    "R": """SELECT customer_id, sum(sales_amount) AS total_purchase_amount,
        CAST(sum(modification_count) AS BIGINT) AS total_modification_count,
        sum(additional_payment) AS total_additional_payment,
        CAST(sum(transaction_canceled) AS BIGINT) AS total_cancellations,
        min(transaction_date) AS first_transaction_date, max(transaction_date) AS last_transaction_date,
        count(*) AS transaction_count
        FROM tx GROUP BY customer_id""",
    "RQ": """SELECT quantile_cont(CAST(total_purchase_amount AS DOUBLE), 0.7) AS q70,
        quantile_cont(CAST(total_purchase_amount AS DOUBLE), 0.9) AS q90 FROM R""",
    "RS": """SELECT R.*, CASE WHEN coalesce(total_purchase_amount >= q90, false) THEN 'VIP'
        WHEN coalesce(total_purchase_amount >= q70, false) THEN 'premium' ELSE 'regular' END
        AS customer_segment FROM R CROSS JOIN RQ""",
    "ct": """SELECT cu.customer_id, cu.age, cu.region,
        coalesce(CAST(RS.total_purchase_amount AS DOUBLE), 0.0::DOUBLE) AS total_purchase_amount,
        coalesce(RS.customer_segment, 'regular') AS customer_segment,
        cu.join_date AS registration_date,
        coalesce(CAST(RS.total_modification_count AS DOUBLE), 0.0::DOUBLE) AS total_modification_count,
        coalesce(CAST(RS.total_additional_payment AS DOUBLE), 0.0::DOUBLE) AS total_additional_payment
        FROM cu LEFT JOIN RS ON cu.customer_id = RS.customer_id""",
    "R180": """SELECT customer_id, sum(sales_amount) AS total_purchase_amount,
        sum(modification_count) AS total_modification_count, sum(additional_payment) AS total_additional_payment
        FROM tx180 GROUP BY customer_id""",
    "ct180": """SELECT cu0.customer_id, cu0.age, cu0.region,
        coalesce(CAST(R180.total_purchase_amount AS DOUBLE), 0.0::DOUBLE) AS total_purchase_amount,
        CASE WHEN coalesce(total_purchase_amount >= (SELECT quantile_cont(total_purchase_amount, 0.9) FROM R180), false)
               THEN 'VIP'
             WHEN coalesce(total_purchase_amount >= (SELECT quantile_cont(total_purchase_amount, 0.7) FROM R180), false)
               THEN 'premium' ELSE 'regular' END AS customer_segment,
        cu0.join_date AS registration_date,
        coalesce(CAST(R180.total_modification_count AS DOUBLE), 0.0::DOUBLE) AS total_modification_count,
        coalesce(CAST(R180.total_additional_payment AS DOUBLE), 0.0::DOUBLE) AS total_additional_payment
        FROM cu0 LEFT JOIN R180 ON cu0.customer_id = R180.customer_id""",
    "B": """SELECT customer_id, avg(modification_count) AS avg_modification_count,
        CAST(sum(modification_count) AS BIGINT) AS total_modification_count,
        avg(additional_payment) AS avg_additional_payment,
        sum(additional_payment) AS total_additional_payment,
        CAST(sum(CAST(round(service_rating * 1000000.0::DOUBLE) AS BIGINT)) AS DOUBLE)
          / count(CAST(round(service_rating * 1000000.0::DOUBLE) AS BIGINT)) / 1000000.0::DOUBLE AS avg_rating,
        CAST(sum(transaction_canceled) AS BIGINT) AS total_cancellations,
        min(transaction_date) AS first_transaction_date, max(transaction_date) AS last_transaction_date,
        count(*) AS transaction_count, sum(sales_amount) AS total_sales,
        datesub('day', min(transaction_date), max(transaction_date)) AS transaction_duration_days
        FROM tx GROUP BY customer_id""",
    "ps": """SELECT ct.customer_id, least(greatest(
          CASE WHEN coalesce(ct.customer_segment IN ('premium', 'VIP'), false)
               THEN (0.0::DOUBLE
                 + CASE WHEN coalesce(B.avg_modification_count >= 5.0, false) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(B.total_additional_payment = 0, false) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(B.transaction_duration_days < 30, false) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(round(B.avg_rating, 6) < 3.0, false) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)
                 * 0.2::DOUBLE
               ELSE (0.0::DOUBLE
                 + CASE WHEN coalesce(B.avg_modification_count >= 5.0, false) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(B.total_additional_payment = 0, false) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(B.transaction_duration_days < 30, false) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN coalesce(round(B.avg_rating, 6) < 3.0, false) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)
          END
          + CASE WHEN coalesce(B.total_cancellations > 0, false) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END,
          0.0::DOUBLE), 1.0::DOUBLE) AS p
        FROM ct LEFT JOIN B ON ct.customer_id = B.customer_id""",
    "preds": """SELECT customer_id, round_even(p, 4) AS churn_probability,
        CASE WHEN p > 0.0 AND p <= 0.3 THEN 'low' WHEN p > 0.3 AND p <= 0.7 THEN 'mid'
             WHEN p > 0.7 AND p <= 1.0 THEN 'high' END AS risk_level
        FROM ps""",
}

_DEPS = {
    "A": [], "L": [], "tx": ["L"], "tx180": ["tx", "A"], "O": [], "E": [],
    "cu0": ["O", "E", "A"], "cuq": ["cu0"], "cus": ["cuq"], "cu": ["cus"],
    "R": ["tx"], "RQ": ["R"], "RS": ["RQ"], "ct": ["cu", "RS"],
    "R180": ["tx180"], "ct180": ["cu0", "R180"], "B": ["tx"], "ps": ["ct", "B"], "preds": ["ps"],
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in _DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(uses, body: str) -> str:
    """``WITH <needed bindings> <body>``; ``body`` may start with more CTEs
    written as ``name AS (...), ...`` followed by the final SELECT."""
    names = _order(uses)
    head = ",\n".join(f"{n} AS ({_CTE[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {head}\n{body}"
    return f"WITH {head},\n{body}"
