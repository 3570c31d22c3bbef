"""A small forest as a committed node table: the model that scoring is checked with, in Spark and in SQL.

Four trees of three levels, fitted once on the smallest tables' rule classes; thresholds are rounded to three decimals and
leaf votes to sixty-fourths, so that the mean of four votes and its percentages are exact.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import ENGINEERED_25
from .node_table import NodeModel, node_table

#: (tree, node, feature, threshold, left, right) and (tree, leaf, votes in sixty-fourths) (fixed values).
SERVED = [
    (0, 0, "heading_magnitude", 10.113, 1, 6),
    (0, 1, "spdx", -3.1, 2, 5),
    (0, 2, "hedx_n", 3.1, 3, 4),
    (0, 3, (64, 0, 0, 0, 0, 0)),
    (0, 4, (4, 58, 2, 0, 0, 0)),
    (0, 5, (0, 0, 64, 0, 0, 0)),
    (0, 6, "speed_position_interaction", 211.152, 7, 10),
    (0, 7, "position_change_magnitude", 23.488, 8, 9),
    (0, 8, (0, 0, 0, 23, 24, 17)),
    (0, 9, (0, 0, 0, 56, 8, 0)),
    (0, 10, "posy", 85.5, 11, 12),
    (0, 11, (0, 0, 0, 20, 41, 3)),
    (0, 12, (0, 0, 0, 0, 0, 64)),
    (1, 0, "speed_magnitude", 6.719, 1, 8),
    (1, 1, "posy", 50.5, 2, 5),
    (1, 2, "hedx_n", 6.1, 3, 4),
    (1, 3, (0, 64, 0, 0, 0, 0)),
    (1, 4, (0, 4, 60, 0, 0, 0)),
    (1, 5, "hedx_n", 13.3, 6, 7),
    (1, 6, (0, 0, 0, 64, 0, 0)),
    (1, 7, (0, 0, 0, 5, 59, 0)),
    (1, 8, "heading_magnitude", 16.516, 9, 12),
    (1, 9, "position_change_y", 8.5, 10, 11),
    (1, 10, (37, 12, 6, 5, 4, 0)),
    (1, 11, (1, 7, 10, 13, 33, 0)),
    (1, 12, (0, 0, 0, 0, 3, 61)),
    (2, 0, "inter_arrival_speed_ratio", 0.141, 1, 8),
    (2, 1, "posx", 68.95, 2, 5),
    (2, 2, "heading_magnitude", 3.74, 3, 4),
    (2, 3, (64, 0, 0, 0, 0, 0)),
    (2, 4, (0, 3, 0, 0, 5, 56)),
    (2, 5, "hedx_n", 6.9, 6, 7),
    (2, 6, (33, 31, 0, 0, 0, 0)),
    (2, 7, (0, 0, 16, 17, 16, 15)),
    (2, 8, "inter_arrival_speed_ratio", 0.277, 9, 12),
    (2, 9, "speed_position_interaction", 60.298, 10, 11),
    (2, 10, (0, 2, 8, 8, 46, 0)),
    (2, 11, (1, 25, 10, 5, 22, 1)),
    (2, 12, "posy", 50.5, 13, 14),
    (2, 13, (0, 6, 58, 0, 0, 0)),
    (2, 14, (0, 0, 0, 64, 0, 0)),
    (3, 0, "posy", 66.5, 1, 6),
    (3, 1, "hedx_n", 10.1, 2, 5),
    (3, 2, "speed_magnitude", 6.719, 3, 4),
    (3, 3, (0, 32, 32, 0, 0, 0)),
    (3, 4, (42, 11, 11, 0, 0, 0)),
    (3, 5, (0, 0, 0, 64, 0, 0)),
    (3, 6, "position_change_y", -5.5, 7, 10),
    (3, 7, "hedx_n", 16.5, 8, 9),
    (3, 8, (0, 0, 0, 0, 64, 0)),
    (3, 9, (0, 0, 0, 0, 28, 36)),
    (3, 10, (0, 0, 0, 1, 28, 35)),
]
VOTES = 64


def served_model(spark: SparkSession) -> NodeModel:
    rows = [(r[0], r[1], ENGINEERED_25.index(r[2]), float(r[3]), r[4], r[5], None) if len(r) == 6 else
            (r[0], r[1], None, None, None, None, [v / VOTES for v in r[2]]) for r in SERVED]
    return node_table(spark, rows, list(ENGINEERED_25), 6)


def served_sql(source: str, levels: int = 3) -> str:
    """CTEs ``nodes``, one walk for each level, and ``served (row_id, p, prediction)`` over the features of ``source``."""
    values = ", ".join(
        f"({r[0]}, {r[1]}, {ENGINEERED_25.index(r[2]) + 1}, CAST({r[3]} AS DOUBLE), {r[4]}, {r[5]}, NULL)" if len(r) == 6 else
        f"({r[0]}, {r[1]}, NULL, NULL, {r[1]}, {r[1]}, {list(r[2])})" for r in SERVED)
    x = ", ".join(f"CAST({c} AS DOUBLE)" for c in ENGINEERED_25)
    walks = [f"walk0 AS (SELECT row_id, [{x}] AS x, tree, 0 AS node FROM {source} CROSS JOIN (SELECT DISTINCT tree FROM nodes) t)"]
    for i in range(levels):
        walks.append(f"walk{i + 1} AS (SELECT w.row_id, w.x, w.tree, CASE WHEN w.x[n.feature] <= n.threshold THEN n.l ELSE n.r END AS node "
                     f"FROM walk{i} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)")
    votes = ", ".join(f"sum(n.leaf[{k}]) / CAST({VOTES * len({r[0] for r in SERVED})} AS DOUBLE)" for k in range(1, 7))
    return (f"nodes(tree, node, feature, threshold, l, r, leaf) AS (VALUES {values}), " + ", ".join(walks)
            + f", summed AS (SELECT w.row_id, [{votes}] AS p FROM walk{levels} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY w.row_id)"
            + ", served AS (SELECT row_id, p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS prediction FROM summed)")
