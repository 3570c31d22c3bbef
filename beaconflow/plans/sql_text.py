"""DuckDB-runnable SQL equal in meaning to each registered query (the oracle side).

The ``messages`` CTE is the same derivation as ``sources.messages.messages_from_events``.
"""

from __future__ import annotations

MESSAGES_CTE = """messages AS (
  SELECT event_id AS row_id, CAST(4 AS INTEGER) AS type,
    epoch_us(ts) / CAST(1000000 AS DOUBLE) AS sendtime,
    user_id AS sender, user_id * 10 + 1 AS senderpseudo, event_id AS messageid,
    value AS posx, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS posy, CAST(0 AS DOUBLE) AS posz,
    value / CAST(10 AS DOUBLE) AS posx_n, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / CAST(10 AS DOUBLE) AS posy_n,
    CAST(0 AS DOUBLE) AS posz_n,
    (TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) - CAST(50 AS DOUBLE)) / CAST(5 AS DOUBLE) AS spdx,
    (value - CAST(20 AS DOUBLE)) / CAST(8 AS DOUBLE) AS spdy, CAST(0 AS DOUBLE) AS spdz,
    TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS spdx_n,
    value / CAST(100 AS DOUBLE) AS spdy_n, CAST(0 AS DOUBLE) AS spdz_n,
    (TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) - CAST(49 AS DOUBLE)) / CAST(20 AS DOUBLE) AS aclx,
    (value - CAST(19 AS DOUBLE)) / CAST(40 AS DOUBLE) AS acly, CAST(0 AS DOUBLE) AS aclz,
    CAST(0 AS DOUBLE) AS aclx_n, CAST(0 AS DOUBLE) AS acly_n, CAST(0 AS DOUBLE) AS aclz_n,
    cos(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)) AS hedx,
    sin(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)) AS hedy, CAST(0 AS DOUBLE) AS hedz,
    TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / CAST(5 AS DOUBLE) AS hedx_n,
    value / CAST(25 AS DOUBLE) AS hedy_n, CAST(0 AS DOUBLE) AS hedz_n,
    CAST((event_id * 7 + user_id) % 20 AS INTEGER) AS class
  FROM events
)"""

# Sequence features by plain whole-sender windows (the reference's definition).
FEATURES_CTE = """feat_base AS (
  SELECT *,
    row_number() OVER w - 1 AS seq0,
    sqrt(spdx * spdx + spdy * spdy) AS speed_magnitude,
    coalesce(spdx - lag(spdx) OVER w, 0) AS acceleration_x,
    coalesce(spdy - lag(spdy) OVER w, 0) AS acceleration_y,
    coalesce(posx - lag(posx) OVER w, 0) AS position_change_x,
    coalesce(posy - lag(posy) OVER w, 0) AS position_change_y,
    coalesce(hedy - lag(hedy) OVER w, 0) AS heading_change
  FROM messages
  WINDOW w AS (PARTITION BY senderpseudo ORDER BY row_id)
), features AS (
  SELECT *,
    CAST(seq0 AS BIGINT) AS sender_sequence,
    CAST(1.0 AS DOUBLE) AS inter_arrival_time,
    sqrt(acceleration_x * acceleration_x + acceleration_y * acceleration_y) AS acceleration_magnitude,
    sqrt(position_change_x * position_change_x + position_change_y * position_change_y) AS position_change_magnitude,
    sqrt(hedx_n * hedx_n + hedy * hedy) AS heading_magnitude,
    coalesce(stddev_samp(speed_magnitude) OVER (PARTITION BY senderpseudo), 0) AS speed_consistency,
    coalesce(stddev_samp(sqrt(position_change_x * position_change_x + position_change_y * position_change_y))
             OVER (PARTITION BY senderpseudo), 0) AS position_consistency,
    CAST(seq0 % 24 AS BIGINT) AS hour,
    CAST(0 AS INTEGER) AS night_hours,
    speed_magnitude * sqrt(position_change_x * position_change_x + position_change_y * position_change_y)
      AS speed_position_interaction,
    CAST(1.0 AS DOUBLE) / (speed_magnitude + 1e-6) AS inter_arrival_speed_ratio
  FROM feat_base
)"""


def with_messages(body: str, *ctes: str) -> str:
    parts = [MESSAGES_CTE] + list(ctes)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def r6(expr: str, alias: str) -> str:
    """Same normalisation as ``functions.columns.r6``."""
    x = f"({expr})"
    return (f"(CASE WHEN isnan({x}) OR isinf({x}) THEN {x} WHEN abs({x}) < 1e4 THEN round({x}, 6) "
            f"ELSE round({x} / pow(CAST(10 AS DOUBLE), floor(log10(abs({x})))), 9) "
            f"* pow(CAST(10 AS DOUBLE), floor(log10(abs({x})))) END) + CAST(0 AS DOUBLE) AS {alias}")


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def holdout_cte(ratio: float = 0.8, seed: int = 42, name: str = "holdout", src: str = "messages",
                first: str = "train_val", second: str = "test") -> str:
    return f"""{name}_rank AS (
  SELECT senderpseudo,
    row_number() OVER (ORDER BY md5(concat('{seed}', ':', CAST(senderpseudo AS VARCHAR)))) - 1 AS rk,
    count(*) OVER () AS n_senders
  FROM (SELECT DISTINCT senderpseudo FROM {src} WHERE senderpseudo IS NOT NULL) s
), {name} AS (
  SELECT senderpseudo,
    CASE WHEN rk < floor(CAST({ratio} AS DOUBLE) * n_senders) THEN '{first}' ELSE '{second}' END AS split
  FROM {name}_rank
)"""


def kfold_cte(k: int = 5, name: str = "kfold", src: str = "messages") -> str:
    """Senders, the largest first, one after another to the fold with the fewest rows."""
    return f"""{name}_rank AS (
  SELECT senderpseudo, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, senderpseudo ASC) AS rk
  FROM {src} WHERE senderpseudo IS NOT NULL GROUP BY senderpseudo
), {name}_greedy AS (
  SELECT CAST(0 AS BIGINT) AS rk, CAST([{", ".join("0" * k)}] AS BIGINT[]) AS loads, CAST(NULL AS INTEGER) AS fold
  UNION ALL
  SELECT n.rk, list_transform(g.loads, lambda x, i: CASE WHEN i = g.at THEN x + n.n_rows ELSE x END), CAST(g.at - 1 AS INTEGER)
  FROM (SELECT *, list_position(loads, list_min(loads)) AS at FROM {name}_greedy) g JOIN {name}_rank n ON n.rk = g.rk + 1
), {name} AS (
  SELECT r.senderpseudo, r.n_rows, g.fold FROM {name}_rank r JOIN {name}_greedy g ON g.rk = r.rk
)"""


def class_group_case(col: str, mapping: dict) -> str:
    inv: dict = {}
    for k, v in mapping.items():
        inv.setdefault(v, []).append(k)
    whens = " ".join(f"WHEN {col} IN ({', '.join(str(x) for x in sorted(ks))}) THEN {v}" for v, ks in sorted(inv.items()))
    return f"CAST(CASE {whens} ELSE NULL END AS INTEGER)"


def name_case(col: str, names: dict) -> str:
    whens = " ".join(f"WHEN {col} = {k} THEN '{v}'" for k, v in names.items())
    return f"CASE {whens} ELSE concat('Class ', CAST({col} AS VARCHAR)) END"


def per_class_cte(src: str, label: str, pred: str, by: list[str] | None = None, name: str = "pc") -> str:
    """SQL form of ``operators.evaluate.per_class`` over ``src``."""
    by = by or []
    b = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"t.{c} = p.{c}" for c in by] + ["t.cls = p.cls"])
    sel_by = "".join(f"coalesce(t.{c}, p.{c}) AS {c}, " for c in by)
    return f"""{name}_c AS (
  SELECT {b}CAST({label} AS INTEGER) AS label, CAST({pred} AS INTEGER) AS prediction, count(*) AS n
  FROM {src} GROUP BY {b}CAST({label} AS INTEGER), CAST({pred} AS INTEGER)
), {name}_t AS (
  SELECT {b}label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n END) AS tp FROM {name}_c GROUP BY {b}label
), {name}_p AS (
  SELECT {b}prediction AS cls, sum(n) AS predicted FROM {name}_c GROUP BY {b}prediction
), {name}_j AS (
  SELECT {sel_by}coalesce(t.cls, p.cls) AS label, CAST(coalesce(t.tp, 0) AS BIGINT) AS tp,
    CAST(coalesce(t.support, 0) AS BIGINT) AS support, CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted
  FROM {name}_t t FULL OUTER JOIN {name}_p p ON {on}
), {name}_pr AS (
  SELECT *, CASE WHEN predicted = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
    CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / support END AS recall
  FROM {name}_j
), {name} AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN CAST(0 AS DOUBLE)
    ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM {name}_pr
), {name}_scores AS (
  SELECT {b}CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(f1) AS macro_f1,
    sum(f1 * support) / sum(support) AS weighted_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall
  FROM {name} {'GROUP BY ' + ', '.join(by) if by else ''}
)"""


def pct(n: str, total: str, digits: int = 2) -> str:
    """Same exact half-up percentage as ``functions.columns.pct``."""
    scale = 10 ** (digits + 2)
    return (f"CAST((CAST({n} AS BIGINT) * {2 * scale} + CAST({total} AS BIGINT)) // (CAST({total} AS BIGINT) * 2) "
            f"AS BIGINT) / CAST({10 ** digits} AS DOUBLE)")
