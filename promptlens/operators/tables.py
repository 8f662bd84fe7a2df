"""Policy-rule and settings tables maintained from change logs.

The reference mutates SQLite rows in place. Here a table is the result of
replaying its change log: every step is a partial (map-side) aggregation per
key, so a hot key costs one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.schemas import DEFAULT_SETTINGS

RULE_FIELDS = ["name", "pattern", "severity", "enabled"]


def policy_rules_apply(changes: DataFrame) -> DataFrame:
    """Rule table after replaying (seq, op, id, name, pattern, severity, enabled, ts).

    Per id, in seq order: insert creates the row when absent (created_at = ts,
    enabled defaults to true) and is ignored when the id is live (primary
    key); update overwrites name/pattern/severity/enabled of a live row and is
    a no-op otherwise; delete removes the row. Closed form: after the last
    delete D, the first insert I > D creates the row, and the latest update
    U > I (if any) holds the final values.
    """
    ops = changes.withColumn("enabled", F.coalesce(F.col("enabled"), F.lit(True)))
    last_delete = (ops.filter(F.col("op") == "delete").groupBy("id")
                   .agg(F.max("seq").alias("__d")))
    live = (ops.filter(F.col("op") != "delete").join(last_delete, "id", "left")
            .filter(F.col("__d").isNull() | (F.col("seq") > F.col("__d"))))
    is_ins, is_upd = F.col("op") == "insert", F.col("op") == "update"
    vals = F.struct(*RULE_FIELDS)
    per_id = live.groupBy("id").agg(
        F.min(F.when(is_ins, F.col("seq"))).alias("__i"),
        F.min_by(F.struct(vals.alias("v"), F.col("ts").alias("ts")), F.when(is_ins, F.col("seq"))).alias("__ins"),
        F.max(F.when(is_upd, F.col("seq"))).alias("__u"),
        F.max_by(vals, F.when(is_upd, F.col("seq"))).alias("__upd"))
    final = F.when(F.col("__u") > F.col("__i"), F.col("__upd")).otherwise(F.col("__ins.v"))
    return (per_id.filter(F.col("__i").isNotNull())
            .select("id", *[final[f].alias(f) for f in RULE_FIELDS], F.col("__ins.ts").alias("created_at"))
            .select("id", "name", "pattern", "severity", "enabled", "created_at"))


def settings_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """INSERT OR REPLACE per key: the change with the highest seq wins over the stored value."""
    base = current.select(F.lit(-1).cast("long").alias("seq"), "key", "value")
    return (base.unionByName(changes.select(F.col("seq").cast("long"), "key", F.col("value").cast("string")))
            .groupBy("key").agg(F.max_by("value", "seq").alias("value")))


def settings_defaults(current: DataFrame) -> DataFrame:
    """Add each default setting whose key is missing; existing values are kept."""
    spark = current.sparkSession
    defaults = spark.createDataFrame(DEFAULT_SETTINGS, "key string, value string")
    return defaults.join(current.select("key"), "key", "left_anti").unionByName(current.select("key", "value"))


def settings_map(settings: DataFrame) -> DataFrame:
    """One row holding the key -> value map (the settings endpoint)."""
    return settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def settings_versions(changes: DataFrame) -> DataFrame:
    """(at, in_force): from each time of change on, the value of every setting, as a struct of texts.

    ``changes`` are (unix_ts, seq, key, value); at one time the highest seq wins. Unset keys
    have their defaults. The log is an administrator's: as many rows as settings were
    changed, ordered in one window.
    """
    keys = [k for k, _ in DEFAULT_SETTINGS]
    at = changes.groupBy(F.col("unix_ts").cast("double").alias("at")).agg(
        *[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("seq"))).alias(k) for k in keys])
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return at.select("at", F.struct(*[F.coalesce(F.last(k, ignorenulls=True).over(so_far), F.lit(v)).alias(k) for k, v in DEFAULT_SETTINGS]).alias("in_force"))


def settings_as_of(rows: DataFrame, changes: DataFrame, ts_col: str = "unix_ts") -> DataFrame:
    """Adds ``settings``: the settings in force at each row's time, a struct of texts.

    A change holds from its own time on; rows before the first one, or without a time, have
    the defaults. Versions are cut at the starts of the days that have rows, so rows meet
    them by an equi-join on the day and a comparison within it; only the days and the
    changes are ordered together.
    """
    day = lambda c: F.floor(c / 86400).cast("long")
    versions = settings_versions(changes)
    days = rows.select(day(F.col(ts_col)).alias("d")).where("d is not null").distinct().select((F.col("d") * 86400).cast("double").alias("at"))
    marks = versions.withColumn("changed", F.lit(1)).unionByName(days.withColumn("changed", F.lit(0)), allowMissingColumns=True)
    # A day's start comes before a change at that time: its stretch is then empty.
    so_far = Window.orderBy("at", "changed").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("in_force", F.last("in_force", ignorenulls=True).over(so_far)).withColumn("__day", day(F.col("at")))
    stretches = filled.select("__day", F.col("at").alias("__from"), "in_force",
                              F.lead("at").over(Window.partitionBy("__day").orderBy("at", "changed")).alias("__to"))
    base = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_SETTINGS])
    ts = F.col(ts_col).cast("double")
    joined = rows.withColumn("__at", ts).withColumn("__d", day(F.col(ts_col))).join(
        stretches, (F.col("__d") == F.col("__day")) & (F.col("__at") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("__at") < F.col("__to"))), "left")
    return joined.withColumn("settings", F.coalesce("in_force", base)).drop("__at", "__d", "__day", "__from", "__to", "in_force")


def switched_on(setting: str) -> "F.Column":
    """A switch among ``settings``; Python's ``True`` and JSON's ``true`` are one."""
    return F.lower(F.col(f"settings.{setting}")) == F.lit("true")


def number_of(setting: str) -> "F.Column":
    """A number among ``settings``; the default where the text is none."""
    return F.coalesce(F.expr(f"try_cast(settings.{setting} as bigint)"), F.lit(int(dict(DEFAULT_SETTINGS)[setting])))


def python_str(c, kind: str) -> "F.Column":
    """``str(value)`` of a JSON scalar as the reference stores settings values."""
    if kind == "boolean":
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return c.cast("string")
