"""Message sources (S1-S6): scans, contracts, projections, record parsing.

``messages_from_events`` derives the 29-column message record (+ ``row_id``,
``class``) from the driver's ``events`` table; it is a pure projection, so
column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import d, nan_to_null
from ..schema import LABELLED_SCHEMA, MESSAGE_29, MESSAGE_DDL, MESSAGE_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_seconds(ts: Column) -> Column:
    # Works for timestamp_ntz without consulting the session time zone.
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("double") / d(1_000_000)


def messages_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, value, props) -> messages(row_id, 29 columns, class)."""
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("double")
    v = nan_to_null("value")
    zero = d(0)
    cols = [
        F.col("event_id").alias("row_id"),
        F.lit(4).cast("int").alias("type"),
        _epoch_seconds(F.col("ts")).alias("sendtime"),
        F.col("user_id").alias("sender"),
        (F.col("user_id") * 10 + 1).alias("senderpseudo"),
        F.col("event_id").alias("messageid"),
        v.alias("posx"), k.alias("posy"), zero.alias("posz"),
        (v / d(10)).alias("posx_n"), (k / d(10)).alias("posy_n"), zero.alias("posz_n"),
        ((k - d(50)) / d(5)).alias("spdx"), ((v - d(20)) / d(8)).alias("spdy"), zero.alias("spdz"),
        (k / d(100)).alias("spdx_n"), (v / d(100)).alias("spdy_n"), zero.alias("spdz_n"),
        ((k - d(49)) / d(20)).alias("aclx"), ((v - d(19)) / d(40)).alias("acly"), zero.alias("aclz"),
        zero.alias("aclx_n"), zero.alias("acly_n"), zero.alias("aclz_n"),
        F.cos(k).alias("hedx"), F.sin(k).alias("hedy"), zero.alias("hedz"),
        (k / d(5)).alias("hedx_n"), (v / d(25)).alias("hedy_n"), zero.alias("hedz_n"),
        ((F.col("event_id") * 7 + F.col("user_id")) % 20).cast("int").alias("class"),
    ]
    return events.select(*cols)


def load_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_events(read_table(spark, sf_dir, "events"))


def with_rule_class(df: DataFrame) -> DataFrame:
    """Learnable 6-class label derived from ``posy`` (for ML tests)."""
    return df.withColumn("rule_class", F.least(F.floor(F.col("posy") / d(17)), F.lit(5)).cast("int"))


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float/double column, once, at ingest."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(nan_to_null(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", labelled: bool = True,
                  header: bool = True) -> DataFrame:
    """Scan with declared types (never inferred); NaN -> NULL.

    CSV with a header may name the columns in any letter case and any order:
    names are lower-cased (S5), checked against the contract (S3, as a set) and
    cast by name, bad values becoming NULL.  Without a header the columns are
    taken positionally in the record order.
    """
    schema = LABELLED_SCHEMA if labelled else MESSAGE_SCHEMA
    if fmt == "csv" and header:
        raw = lower_columns(spark.read.option("header", True).csv(path))
        want = [f.name for f in schema.fields]
        check_contract(raw.drop(*[c for c in ("class",) if c in raw.columns and not labelled]),
                       want if labelled else MESSAGE_29)
        df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    elif fmt == "csv":
        df = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)
    else:
        df = spark.read.schema(schema).parquet(path)
    return nan_to_null_all(df)


def check_contract(df: DataFrame, columns: list[str] = MESSAGE_29) -> DataFrame:
    """S3: exactly these columns, each once, in any order; raises ValueError otherwise."""
    have, want = Counter(df.columns), Counter(columns)
    if have != want:
        raise ValueError(f"expected {len(columns)} columns; missing={sorted((want - have).elements())} "
                         f"extra={sorted((have - want).elements())}")
    return df


def select_features(df: DataFrame, names: list[str], label: str | None = None) -> DataFrame:
    """Fail listing every missing column, else project (pruning reaches the scan)."""
    wanted = list(names) + ([label] if label else [])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*wanted)


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case all column names."""
    return df.toDF(*[c.lower() for c in df.columns])


def parse_records(df: DataFrame, col: str = "record", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Text records of 29 comma-separated numbers -> (typed rows, rejects).

    A record is accepted only when it has exactly 29 fields that all parse as
    numbers; short, long and non-numeric records go to the rejects frame with
    a reason.  Pure column expressions, so it runs inside whole-stage codegen.
    """
    keep = keep or []
    # A generated column is never inlined into the expressions that use it, so every record is split once and every field
    # read once, whatever filters are pushed down later.
    step = df.select(*keep, F.col(col), F.inline(F.array(F.struct(F.split(F.trim(F.col(col)), ",").alias("_parts")))))
    values = []
    for i, f in enumerate(MESSAGE_SCHEMA.fields):
        text = F.trim(F.get(F.col("_parts"), i))
        value = text.try_cast("double")
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            kind = f.dataType.simpleString()
            # digits are read as an integer (a double has no room for ids above 2**53); integral
            # numbers written as floats ("4.0") come through the double
            value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind)).when(value == F.floor(value), value.try_cast(kind))
        values.append(value.alias(f.name))
    read = step.select(*keep, F.col(col), F.inline(F.array(F.struct(F.size("_parts").alias("_n"), *values))))
    missing = F.array_contains(F.array(*[F.col(c).isNull() for c in MESSAGE_29]), True)
    reason = (F.when(F.col("_n") < 29, F.lit("too few values"))
              .when(F.col("_n") > 29, F.lit("too many values"))
              .when(missing, F.lit("non-numeric value")))
    tagged = read.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).select(*keep, *MESSAGE_29)
    rejects = tagged.where(F.col("_reason").isNotNull()).select(*keep, F.col(col), F.col("_reason").alias("reason"))
    return good, rejects


__all__ = [
    "read_table", "messages_from_events", "load_messages", "with_rule_class", "read_messages",
    "nan_to_null_all", "check_contract", "select_features", "lower_columns", "parse_records", "MESSAGE_DDL",
]


def read_xy(spark: SparkSession, x_path: str, y_path: str, fmt: str = "csv", label: str = "class") -> DataFrame:
    """Pair a feature file and a label file row by row (file order); the label is y's first column.

    Each side gets a dense file-order index (no sort) and the two are joined on it;
    files of different lengths raise ``ValueError``.  CSV values are coerced to
    numbers (bad values -> NULL), the label to int.
    """
    from ..functions.ranking import file_order_index

    def read(p):
        r = spark.read.option("header", True)
        return r.csv(p) if fmt == "csv" else r.parquet(p)
    xr, yr = read(x_path), read(y_path)
    x = file_order_index(xr, "_row").select("_row", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in xr.columns])
    y = file_order_index(yr, "_row").select("_row", F.col(f"`{yr.columns[0]}`").try_cast("double").try_cast("int").alias(label))
    n_x, n_y = x.count(), y.count()
    if n_x != n_y:
        raise ValueError(f"X has {n_x} rows but y has {n_y}")
    return x.join(y, "_row", "inner").withColumnRenamed("_row", "row_index")
