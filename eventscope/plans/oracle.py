"""DuckDB SQL statements equivalent to the named queries of ``eventscope.plans.catalog``.

Every statement starts with the bridge (``x_events``, ``x_products``) written from
the rules in ``eventscope.sources.bridge`` and reads the driver's views ``events``
and ``part``.  Column names and types match the Spark side.
"""

from __future__ import annotations

from eventscope import schema as S
from eventscope.sources import bridge as B


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_TYPE_CASE = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in B.TYPE_MAP.items())

BRIDGE = f"""
WITH x_events AS (
  SELECT event_id AS row_id,
         'U' || CAST({B.USER_OFFSET} + user_id AS VARCHAR) AS event_id,
         CASE event_type {_TYPE_CASE} ELSE event_type END AS event_type,
         ts
  FROM events
),
x_products AS (
  SELECT e.row_id, e.event_id, e.event_type, e.ts, i.pos,
         'P' || CAST(p.p_partkey AS VARCHAR) AS product_id,
         CASE WHEN (e.row_id + i.pos) % {B.NULL_CATEGORY_EVERY} = 0 THEN NULL
              WHEN (e.row_id + i.pos) % {B.EMPTY_CATEGORY_EVERY} = 0 THEN ''
              ELSE p.p_type END AS product_category,
         '$' || CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS VARCHAR) AS price,
         CASE WHEN p.p_type IN ({", ".join(_q(t) for t in B.TYPED_PART_TYPES)}) THEN p.p_name END AS product_type,
         CASE WHEN p.p_type IN ({", ".join(_q(t) for t in B.TYPED_PART_TYPES)}) THEN p.p_brand END AS brand
  FROM x_events e
  JOIN (VALUES (1), (2), (3)) AS i(pos) ON i.pos <= 1 + e.row_id % 3
  JOIN part p ON p.p_partkey = (e.row_id * 3 + 7 * i.pos) % (SELECT count(*) FROM part)
  WHERE e.event_type NOT IN ('login', 'logout')
),
x_counts AS (
  SELECT e.row_id,
         CAST(count(p.pos) AS BIGINT) AS product_count,
         coalesce(string_agg(p.product_category, ', ' ORDER BY p.pos)
                  FILTER (WHERE p.product_category IS NOT NULL AND p.product_category <> ''), '')
           AS product_categories,
         max(CASE WHEN p.pos = 1 THEN p.product_category END) AS first_raw
  FROM x_events e LEFT JOIN x_products p ON p.row_id = e.row_id
  GROUP BY e.row_id
),
x_max AS (SELECT max(ts) AS as_of FROM x_events)"""


def _win(hours: str) -> str:
    return f"ts > (SELECT as_of FROM x_max) - INTERVAL {hours}"


W24 = _win("24 HOUR")


def _sql(body: str) -> str:
    return BRIDGE + body


def _journey(source: str, keys: str) -> str:
    return f"""
, u AS (
  SELECT {keys},
         coalesce(bool_or(event_type = 'login'), false) AS l,
         coalesce(bool_or(event_type = 'purchase'), false) AS p,
         coalesce(bool_or(event_type = 'add_to_cart'), false) AS c
  FROM {source} WHERE event_id IS NOT NULL GROUP BY {keys}
),
j AS (
  SELECT {keys},
         CASE WHEN l AND p THEN {_q(S.JOURNEY_COMPLETED)}
              WHEN l AND c THEN {_q(S.JOURNEY_ABANDONED)}
              WHEN l THEN {_q(S.JOURNEY_BROWSING)}
              ELSE {_q(S.JOURNEY_OTHER)} END AS journey_type
  FROM u
)"""


def _crosstab_ctes(src: str, row: str, col: str, name: str = "ct") -> str:
    """CTEs ending in ``name``: zero-filled long crosstab over present row × column keys."""
    return f"""
, ct_src AS (SELECT {row} AS r, {col} AS c FROM {src} WHERE {row} IS NOT NULL AND {col} IS NOT NULL),
ct_n AS (SELECT r, c, count(*) AS n FROM ct_src GROUP BY r, c),
{name} AS (
  SELECT rk.r AS {row}, ck.c AS {col}, CAST(coalesce(ct_n.n, 0) AS BIGINT) AS count
  FROM (SELECT DISTINCT r FROM ct_src) rk
  CROSS JOIN (SELECT DISTINCT c FROM ct_src) ck
  LEFT JOIN ct_n ON ct_n.r = rk.r AND ct_n.c = ck.c
)"""


def _crosstab(src: str, row: str, col: str) -> str:
    return _crosstab_ctes(src, row, col) + "\nSELECT * FROM ct"


def _dense(src: str, interval: str, value: str) -> str:
    return f"""
, b AS (SELECT time_bucket(INTERVAL '{interval}', ts) AS bk, {value} AS v FROM {src} WHERE ts IS NOT NULL),
g AS (SELECT unnest(generate_series(min(bk), max(bk), INTERVAL '{interval}')) AS bk FROM b)
SELECT g.bk AS timestamp, CAST(coalesce(sum(b.v), 0) AS BIGINT) AS event_count
FROM g LEFT JOIN b ON b.bk = g.bk GROUP BY g.bk"""


def _rule_counts(pairs: list[tuple[str, str]], source: str) -> str:
    parts = [f"SELECT {_q(name)} AS rule, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM {source}"
             for name, cond in pairs]
    return "\n" + "\nUNION ALL\n".join(parts)


def _taxonomy_values(pairs: dict[str, list[str]]) -> str:
    return ", ".join(f"({_q(c)}, {_q(v)})" for c, vs in pairs.items() for v in vs)


_EVENTS_WITH_COUNTS = "x_events e JOIN x_counts k ON k.row_id = e.row_id"


ORACLE: dict[str, str] = {
    # A1 over F1(24h)
    "kpis": _sql(f"""
SELECT count(*) AS total_events,
       count(DISTINCT event_type) AS unique_event_types,
       CAST((SELECT count(*) FROM x_products WHERE {W24}) AS BIGINT) AS total_products,
       count(DISTINCT event_id) AS unique_event_ids
FROM x_events WHERE {W24}"""),
    "kpis_all": _sql("""
SELECT count(*) AS total_events,
       count(DISTINCT event_type) AS unique_event_types,
       CAST((SELECT count(*) FROM x_products) AS BIGINT) AS total_products,
       count(DISTINCT event_id) AS unique_event_ids
FROM x_events"""),
    # A2
    "data_status": _sql(f"""
SELECT count(*) AS total_rows,
       CAST(count(*) FILTER (WHERE {W24}) AS BIGINT) AS rows_in_window,
       CAST(10 AS BIGINT) AS source_columns,
       '24h' AS time_window
FROM x_events"""),
    # A3, L3, L4
    "event_type_counts": _sql("""
SELECT event_type, count(*) AS count FROM x_events WHERE event_type IS NOT NULL GROUP BY event_type"""),
    "event_types_sorted": _sql("""
SELECT DISTINCT event_type FROM x_events WHERE event_type IS NOT NULL ORDER BY event_type"""),
    "event_types_distinct": _sql("""
SELECT DISTINCT event_type FROM x_events"""),
    # A4, A4b, A4c, A5
    "category_counts": _sql("""
SELECT product_category AS category, count(*) AS count FROM x_products
WHERE product_category IS NOT NULL AND product_category <> '' GROUP BY 1"""),
    "category_counts_unknown": _sql(f"""
SELECT coalesce(product_category, {_q(S.UNKNOWN_CATEGORY)}) AS category, count(*) AS count
FROM x_products GROUP BY 1"""),
    "scalar_category_counts": _sql("""
SELECT first_raw AS category, count(*) AS count FROM x_counts WHERE first_raw IS NOT NULL GROUP BY 1"""),
    "category_share": _sql("""
, n AS (SELECT first_raw AS category, count(*) AS count FROM x_counts WHERE first_raw IS NOT NULL GROUP BY 1),
t AS (SELECT sum(count) AS total FROM n)
SELECT category, count,
       CAST((2000 * count + total) // (2 * total) AS DOUBLE) / 10.0 AS pct
FROM n, t"""),
    # N6–N10, N12, K5
    "category_list_csv": _sql(f"""
SELECT e.row_id, e.event_id, e.event_type, e.ts, k.product_count, k.product_categories
FROM {_EVENTS_WITH_COUNTS}"""),
    "preview": _sql(f"""
SELECT e.event_id, e.event_type, e.ts, k.product_count, k.product_categories
FROM {_EVENTS_WITH_COUNTS}
ORDER BY e.ts, e.event_id, e.row_id LIMIT 100"""),
    "product_normalized": _sql("""
SELECT row_id, CAST(pos AS BIGINT) AS pos, product_id, product_category, price, product_type, brand
FROM x_products"""),
    # A9, A9b, A9c
    "category_matrix": _sql("""
, cm AS (SELECT product_category AS category, event_type FROM x_products
         WHERE product_category IS NOT NULL AND product_category <> '')""" + _crosstab("cm", "category", "event_type")),
    "first_category_matrix": _sql(f"""
, fm AS (SELECT e.event_type,
                CASE WHEN k.product_count = 0 THEN {_q(S.UNKNOWN_CATEGORY)}
                     ELSE coalesce(k.first_raw, {_q(S.UNKNOWN_CATEGORY)}) END AS category
         FROM {_EVENTS_WITH_COUNTS})""" + _crosstab("fm", "category", "event_type")),
    "category_matrix_wide": _sql("""
SELECT first_raw AS category,
       count(*) FILTER (WHERE e.event_type = 'add_to_cart') AS add_to_cart,
       count(*) FILTER (WHERE e.event_type = 'purchase') AS purchase,
       count(*) FILTER (WHERE e.event_type = 'view_product') AS view_product
FROM x_events e JOIN x_counts k ON k.row_id = e.row_id
WHERE first_raw IS NOT NULL AND e.event_type IS NOT NULL GROUP BY 1"""),
    # A6, A7, A8
    "user_paths": _sql("""
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ts NULLS FIRST, row_id NULLS FIRST) AS step,
       row_id, ts, event_type
FROM x_events WHERE event_id IS NOT NULL"""),
    "journey_by_user": _sql(f"""
, w AS (SELECT * FROM x_events WHERE {W24})""" + _journey("w", "event_id") + """
SELECT event_id, journey_type FROM j"""),
    "journey_funnel": _sql(f"""
, w AS (SELECT * FROM x_events WHERE {W24})""" + _journey("w", "event_id") + """
SELECT journey_type, count(*) AS count FROM j GROUP BY 1"""),
    "journey_funnel_daily": _sql("""
, w AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM x_events WHERE ts IS NOT NULL)"""
                                 + _journey("w", "event_id, day") + """
SELECT journey_type, count(*) AS count FROM j GROUP BY 1"""),
    "journey_funnel_folded": _sql(f"""
, w AS (SELECT event_id, lower(event_type) AS event_type FROM x_events
        WHERE {W24})""" + _journey("w", "event_id") + """
SELECT journey_type, count(*) AS count FROM j GROUP BY 1"""),
    # L1, L2
    "top_ids": _sql("""
SELECT event_id, count(*) AS count FROM x_events WHERE event_id IS NOT NULL
GROUP BY 1 ORDER BY count DESC, event_id LIMIT 5"""),
    "top_categories": _sql("""
SELECT product_category AS category, count(*) AS count FROM x_products
WHERE product_category IS NOT NULL AND product_category <> ''
GROUP BY 1 ORDER BY count DESC, category LIMIT 5"""),
    # T1, T2
    "events_over_time_dense": _sql(_dense("x_events", "1 hour", "1")),
    "user_events_dense": _sql(f"""
, w AS (SELECT * FROM x_events WHERE {_win("30 MINUTE")})""" + _dense("w", "500 milliseconds",
                                                                        "CASE WHEN event_id IS NOT NULL THEN 1 ELSE 0 END")),
    # T3–T7
    "top_categories_over_time": _sql("""
, c AS (SELECT ts, product_category AS category FROM x_products
        WHERE ts IS NOT NULL AND product_category IS NOT NULL AND product_category <> ''),
top AS (SELECT category FROM c GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 5)
SELECT time_bucket(INTERVAL '1 hour', ts) AS timestamp, category, count(*) AS count
FROM c WHERE category IN (SELECT category FROM top) GROUP BY 1, 2"""),
    "event_types_over_time": _sql("""
SELECT time_bucket(INTERVAL '15 minutes', ts) AS timestamp, event_type, count(*) AS count
FROM x_events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2"""),
    "event_types_over_time_filled": _sql("""
, tb AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS timestamp, event_type FROM x_events
         WHERE ts IS NOT NULL)""" + _crosstab("tb", "timestamp", "event_type")),
    "event_types_over_time_wide": _sql("""
SELECT time_bucket(INTERVAL '15 minutes', ts) AS timestamp,
       count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_cart,
       count(*) FILTER (WHERE event_type = 'login') AS login,
       count(*) FILTER (WHERE event_type = 'logout') AS logout,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       count(*) FILTER (WHERE event_type = 'view_product') AS view_product
FROM x_events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1"""),
    "categories_over_time_filled": _sql(f"""
, tc AS (SELECT time_bucket(INTERVAL '15 minutes', e.ts) AS timestamp, k.first_raw AS category
         FROM {_EVENTS_WITH_COUNTS} WHERE e.ts IS NOT NULL)""" + _crosstab("tc", "timestamp", "category")),
    "event_types_over_time_gated": _sql("""
, tb AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS timestamp, event_type FROM x_events
         WHERE ts IS NOT NULL)""" + _crosstab_ctes("tb", "timestamp", "event_type") + """
SELECT * FROM ct WHERE (SELECT count(DISTINCT timestamp) FROM ct) >= 2"""),
    # F1, F2, F3
    "window_filter": _sql(f"""
SELECT row_id, event_id, event_type, ts FROM x_events WHERE {W24}"""),
    "type_filter": _sql("""
SELECT row_id, event_id, event_type, ts FROM x_events WHERE event_type IN ('purchase', 'add_to_cart')"""),
    "recent_60s": _sql(f"""
SELECT row_id, event_id, event_type, ts FROM x_events WHERE {_win("60 SECOND")}"""),
}


def _in(values: list[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_NOT_LIKE = "({c} IS NULL OR NOT regexp_matches({c}, '{p}'))"
_EVENT_RULES = [
    ("event_type_domain", f"event_type IS NULL OR event_type NOT IN {_in(S.EVENT_TYPES)}"),
    ("event_id_format", _NOT_LIKE.format(c="event_id", p=S.EVENT_ID_PATTERN)),
    ("device_domain", f"device IS NOT NULL AND device NOT IN {_in(S.DEVICES)}"),
    ("user_type_domain", f"user_type IS NOT NULL AND user_type NOT IN {_in(S.USER_TYPES)}"),
]
_COUNT_RULES = [
    ("products_on_login_logout", f"event_type IN {_in(S.NO_PRODUCT_EVENT_TYPES)} AND product_count > 0"),
    ("product_count_range", f"event_type IS NOT NULL AND event_type NOT IN {_in(S.NO_PRODUCT_EVENT_TYPES)}"
                            " AND (product_count < 1 OR product_count > 3)"),
]
_FIELD_RULES = [
    ("product_id_format", _NOT_LIKE.format(c="product_id", p=S.PRODUCT_ID_PATTERN)),
    ("price_format", _NOT_LIKE.format(c="price", p=S.PRICE_PATTERN)),
]
_XE = """
, xe AS (SELECT e.*, k.product_count, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS device,
                CAST(NULL AS VARCHAR) AS user_type
         FROM x_events e JOIN x_counts k ON k.row_id = e.row_id)"""
_TAXONOMY = f"""
, tax_c AS (SELECT * FROM (VALUES {", ".join(f"({_q(c)})" for c in S.CATEGORIES)}) t(c)),
tax_t AS (SELECT * FROM (VALUES {_taxonomy_values(S.PRODUCT_TYPES)}) t(c, v)),
tax_b AS (SELECT * FROM (VALUES {_taxonomy_values(S.BRANDS)}) t(c, v))"""
_TAX_RULES = [
    ("category_domain", "product_category IS NULL OR product_category NOT IN (SELECT c FROM tax_c)"),
    ("product_type_for_category", "product_type IS NOT NULL AND NOT EXISTS "
                                  "(SELECT 1 FROM tax_t WHERE tax_t.c = product_category AND tax_t.v = product_type)"),
    ("brand_for_category", "brand IS NOT NULL AND NOT EXISTS "
                           "(SELECT 1 FROM tax_b WHERE tax_b.c = product_category AND tax_b.v = brand)"),
]


def _violation_rows(pairs, source, key="row_id") -> list[str]:
    return [f"SELECT {key}, {_q(n)} AS rule FROM {source} WHERE {c}" for n, c in pairs]


ORACLE.update({
    # U1/U2
    "union_shapes": _sql(f"""
SELECT 'v2' AS shape, e.row_id, e.event_id, e.event_type, e.ts, k.product_count, k.first_raw AS first_category
FROM {_EVENTS_WITH_COUNTS}
UNION ALL
SELECT 'v1', e.row_id, e.event_id, e.event_type, date_trunc('second', e.ts), k.product_count, k.first_raw
FROM {_EVENTS_WITH_COUNTS}
UNION ALL
SELECT 'v0', e.row_id, e.event_id, e.event_type, e.ts,
       CAST(CASE WHEN k.first_raw IS NULL THEN 0 ELSE 1 END AS BIGINT), lower(k.first_raw)
FROM {_EVENTS_WITH_COUNTS}"""),
    # N1–N3 + K6
    "json_roundtrip_parse": _sql(f"""
SELECT e.row_id, e.event_id, e.event_type, epoch_us(e.ts) / 1e6 AS timestamp,
       k.product_count, k.product_categories
FROM {_EVENTS_WITH_COUNTS}"""),
    # V1–V5
    "contract_event": _sql(_XE + _rule_counts(_EVENT_RULES, "xe")),
    "contract_products": _sql(_XE + _rule_counts(_COUNT_RULES, "xe") + "\nUNION ALL"
                              + _rule_counts(_FIELD_RULES, "x_products")),
    "contract_taxonomy": _sql(_TAXONOMY + _rule_counts(_TAX_RULES, "x_products")),
    "contract_taxonomy_table": _sql(_TAXONOMY + _rule_counts(_TAX_RULES, "x_products")),
    "contract_violations": _sql(_XE + "\n, v AS (\n"
                                + "\nUNION ALL\n".join(_violation_rows(_EVENT_RULES + _COUNT_RULES, "xe")
                                                       + _violation_rows(_FIELD_RULES, "x_products"))
                                + ")\nSELECT row_id, rule, count(*) AS count FROM v GROUP BY 1, 2"),
    "missing_fields": _sql(_XE + "\n" + "\nUNION ALL\n".join(
        f"SELECT {_q(f)} AS field, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS missing FROM xe"
        for f, c in [("event_id", "event_id IS NULL"), ("event_type", "event_type IS NULL"),
                     ("timestamp", "ts IS NULL"), ("ip", "ip IS NULL"), ("device", "device IS NULL"),
                     ("user_type", "user_type IS NULL"), ("products", "product_count = 0")])),
})


_PER_TYPE = f"""
SELECT e.event_type, count(*) AS events, CAST(sum(k.product_count) AS BIGINT) AS products
FROM {_EVENTS_WITH_COUNTS} GROUP BY 1"""

ORACLE.update({
    # R4
    "stream_tumbling": _sql(f"""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS count
FROM x_events WHERE ts IS NOT NULL AND event_type IS NOT NULL
GROUP BY 1, 2"""),
    # R5
    "stream_sliding": _sql("""
, s AS (SELECT time_bucket(INTERVAL '5 seconds', ts) - to_seconds(5 * r.k) AS window_start, event_type
        FROM x_events CROSS JOIN (SELECT range AS k FROM range(12)) r
        WHERE ts IS NOT NULL AND event_type IS NOT NULL)
SELECT window_start, event_type, count(*) AS count FROM s
GROUP BY 1, 2"""),
    # R6
    "stream_journey": _sql(f"""
, w AS (SELECT event_id, event_type, time_bucket(INTERVAL '1 day', ts) AS window_start FROM x_events
        WHERE ts IS NOT NULL)""" + _journey("w", "event_id, window_start") + """
SELECT window_start, journey_type, count(*) AS count FROM j GROUP BY 1, 2"""),
    # R7
    "stream_top_categories": _sql(f"""
, c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, product_category AS category,
               count(*) AS count
        FROM x_products
        WHERE ts IS NOT NULL AND product_category IS NOT NULL AND product_category <> ''
        GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY count DESC, category) AS rank FROM c)
SELECT window_start, category, count, rank FROM r WHERE rank <= 5"""),
    # R1–R3, K1, S4 / S5, K7, K2
    "stream_ingest": _sql(_PER_TYPE),
    "stream_log_ingest": _sql(_PER_TYPE),
    # By row_id % 10: 1 broken, 2 empty, 3 NULL, 4 '{}', the rest events
    "stream_malformed": _sql("""
SELECT CASE WHEN row_id % 10 = 1 THEN 'unparsed' WHEN row_id % 10 IN (2, 3, 4) THEN 'empty' ELSE 'event' END AS kind,
       count(*) AS count FROM x_events GROUP BY 1"""),
    # R8, K3, K4
    "stream_fanout": _sql("""
SELECT event_type, count(*) AS json_events, count(*) AS csv_events FROM x_events GROUP BY 1"""),
})

_EVENT_ROWS = f"""
SELECT e.event_id, e.event_type, e.ts, k.product_count FROM {_EVENTS_WITH_COUNTS}"""

ORACLE.update({
    # S5; K7, K8, S2, S3
    "stream_log_tail": _sql(_EVENT_ROWS),
    "log_replace": _sql(_EVENT_ROWS),
    # By row_id % 4: 1 v1, 2 v0, else v2; a flat event without category has the shape of v1
    "stream_mixed_topic": _sql(f"""
, s AS (
  SELECT e.row_id, e.event_id, e.event_type, e.ts, k.product_count, k.first_raw, e.row_id % 10 = 1 AS malformed,
         CASE WHEN e.row_id % 4 = 2 AND k.first_raw IS NOT NULL THEN 'v0' WHEN e.row_id % 4 IN (1, 2) THEN 'v1' ELSE 'v2' END AS shape
  FROM {_EVENTS_WITH_COUNTS})
SELECT row_id, CASE WHEN NOT malformed THEN shape END AS shape, CASE WHEN NOT malformed THEN event_id END AS event_id,
       CASE WHEN NOT malformed THEN event_type END AS event_type, CASE WHEN NOT malformed THEN ts END AS ts,
       CAST(CASE WHEN malformed THEN 0 WHEN shape = 'v0' THEN 1 WHEN row_id % 4 = 2 THEN 0 ELSE product_count END AS BIGINT) AS product_count,
       CASE WHEN NOT malformed THEN first_raw END AS first_category, malformed
FROM s"""),
    # By row_id % 10 as in stream_malformed
    "stream_one_pass": _sql(f"""
, s AS (SELECT e.row_id % 10 IN (1, 2, 3, 4) AS bad, e.event_id, e.event_type, e.ts, k.product_count FROM {_EVENTS_WITH_COUNTS})
SELECT CASE WHEN bad THEN 'malformed' ELSE 'event' END AS kind, CASE WHEN NOT bad THEN event_id END AS event_id,
       CASE WHEN NOT bad THEN event_type END AS event_type, CASE WHEN NOT bad THEN ts END AS ts,
       CASE WHEN NOT bad THEN product_count END AS product_count
FROM s"""),
    # F1, F2, S4 by file index
    "store_window": _sql(f"""
SELECT e.event_id, e.event_type, e.ts, k.product_count FROM {_EVENTS_WITH_COUNTS}
WHERE e.{W24} AND e.event_type IN ('purchase', 'add_to_cart')"""),
    # K5
    "csv_export": _sql(f"""
SELECT e.row_id, e.event_id, e.event_type, k.product_categories, k.product_count FROM {_EVENTS_WITH_COUNTS}"""),
    # U1, N4, N5b, N11, F7, N15
    "uneven_batches": _sql("""
SELECT row_id, CASE WHEN row_id % 3 <> 1 THEN event_id END AS event_id, event_type, date_trunc('second', ts) AS ts,
       CASE WHEN row_id % 3 = 2 THEN 'Mobile' END AS device, CAST(NULL AS VARCHAR) AS ip
FROM x_events WHERE row_id % 7 <> 0 AND row_id % 11 <> 0 AND NOT (row_id % 3 = 0 AND row_id % 5 = 0)"""),
})

ORACLE.update({
    # A6 whole paths
    "path_counts": _sql("""
, d AS (SELECT event_id, CAST(ts AS DATE) AS day, count(*) AS length, string_agg(event_type, '>' ORDER BY ts, row_id) AS path
        FROM x_events WHERE event_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT length, count(*) AS paths, min(event_id) AS least FROM d GROUP BY length, path"""),
    # A9 with many keys
    "user_category_matrix": _sql("""
, p AS (SELECT event_id, product_category AS category, count(*) AS n FROM x_products
        WHERE product_category IS NOT NULL AND product_category <> '' GROUP BY 1, 2)
SELECT r.event_id, c.category, coalesce(p.n, 0) AS count
FROM (SELECT DISTINCT event_id FROM p) AS r CROSS JOIN (SELECT DISTINCT category FROM p) AS c
LEFT JOIN p ON p.event_id = r.event_id AND p.category = c.category"""),
    # R5 page
    "stream_last_minute": _sql("""
, s AS (SELECT time_bucket(INTERVAL '5 seconds', ts) - to_seconds(5 * r.k) AS window_start, event_id, count(*) AS n,
               bool_or(event_type = 'login') AS l, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'add_to_cart') AS c
        FROM x_events, range(12) AS r(k) WHERE ts IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2)
SELECT window_start, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (l AND p) AS completed,
       count(*) FILTER (l AND c AND NOT p) AS abandoned, count(*) FILTER (l AND NOT c AND NOT p) AS browsing,
       count(*) FILTER (NOT l) AS other
FROM s GROUP BY 1"""),
})
