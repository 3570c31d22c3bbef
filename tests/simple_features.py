"""The sequence features by plain whole-sender windows, to compare with."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconflow.functions.columns import d
from beaconflow.operators.features import _DIFFS, _hyp


def engineer_features_simple(df: DataFrame, group: str = "senderpseudo", order: str = "row_id") -> DataFrame:
    """Direct whole-sender window form of the same features (tests only: one task per sender)."""
    w = Window.partitionBy(group).orderBy(order)
    wall = Window.partitionBy(group)
    no_sender = F.col(group).isNull()
    out = df.withColumn("sender_sequence", F.when(no_sender, 0).otherwise(F.row_number().over(w) - 1).cast("long"))
    out = out.withColumn("inter_arrival_time", d(1)).withColumn("speed_magnitude", _hyp(F.col("spdx"), F.col("spdy")))
    for c, name in _DIFFS:
        out = out.withColumn(name, F.when(no_sender, d(0)).otherwise(F.coalesce(F.col(c) - F.lag(c).over(w), d(0))))
    out = (out.withColumn("acceleration_magnitude", _hyp(F.col("acceleration_x"), F.col("acceleration_y")))
           .withColumn("position_change_magnitude", _hyp(F.col("position_change_x"), F.col("position_change_y")))
           .withColumn("heading_magnitude", _hyp(F.col("hedx_n"), F.col("hedy")))
           .withColumn("speed_consistency", F.when(no_sender, d(0)).otherwise(
               F.coalesce(F.stddev_samp("speed_magnitude").over(wall), d(0))))
           .withColumn("position_consistency", F.when(no_sender, d(0)).otherwise(
               F.coalesce(F.stddev_samp("position_change_magnitude").over(wall), d(0))))
           .withColumn("hour", F.pmod("sender_sequence", F.lit(24)).cast("long"))
           .withColumn("night_hours", F.lit(0).cast("int"))
           .withColumn("speed_position_interaction", F.col("speed_magnitude") * F.col("position_change_magnitude"))
           .withColumn("inter_arrival_speed_ratio", F.col("inter_arrival_time") / (F.col("speed_magnitude") + d(1e-6))))
    return out.fillna(0.0, subset=["speed_magnitude", "heading_magnitude", "speed_position_interaction",
                                   "inter_arrival_speed_ratio", "acceleration_magnitude"])
