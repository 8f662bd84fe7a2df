"""Dashboard exports of the newest ledger rows (CSV and JSON).

The export is a top-k (at most 500 rows), so ordering it and writing it as
one file is bounded work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions.text import js_number, json_cell
from promptlens.operators.ledger import ledger_recent
from promptlens.schemas import LEDGER_COLUMNS

# FIXED VALUES — export layout.
EXPORT_ROWS = 500
CSV_COLUMNS = ["id", "timestamp", "status", "severity", "latency_ms", "tokens_masked", "payload_bytes",
               "matched_rule", "snippet"]
NUMERIC = {"unix_ts", "latency_ms", "tokens_masked", "payload_bytes"}


def _ranked(ledger: DataFrame, n: int) -> DataFrame:
    top = ledger_recent(ledger, n)
    return top.withColumn("row_no", F.row_number().over(
        Window.orderBy(F.col("unix_ts").desc(), F.col("id").asc())).cast("int"))


def export_csv(ledger: DataFrame, n: int = EXPORT_ROWS) -> DataFrame:
    """(row_no, line): row 0 is the unquoted header; each cell is JSON.stringify(value ?? '')."""
    spark = ledger.sparkSession
    header = spark.createDataFrame([(0, ",".join(CSV_COLUMNS))], "row_no int, line string")
    cells = [json_cell(F.col(c), "number" if c in NUMERIC else "string") for c in CSV_COLUMNS]
    rows = _ranked(ledger, n).select("row_no", F.concat_ws(",", *cells).alias("line"))
    return header.unionByName(rows)


def _json_value(c: str) -> Column:
    if c in NUMERIC:
        return F.coalesce(js_number(F.col(c)), F.lit("null"))
    text = F.to_json(F.array(F.col(c)))
    return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def export_json_rows(ledger: DataFrame, n: int = EXPORT_ROWS) -> DataFrame:
    """(row_no, json): one JSON object per exported event, 13 fields in ledger order."""
    obj = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), _json_value(c)) for c in LEDGER_COLUMNS]), F.lit("}"))
    return _ranked(ledger, n).select("row_no", obj.alias("json"))


def export_json(ledger: DataFrame, n: int = EXPORT_ROWS) -> DataFrame:
    """(row_no, line): the JSON array of the exported events, indented by two spaces, as the dashboard saves it.

    A line of the result holds the whole of one event (its own text has line ends), or one
    of the array's brackets; an empty ledger gives ``[]``.
    """
    fields = F.concat_ws(",\n", *[F.concat(F.lit(f'    "{c}": '), _json_value(c)) for c in LEDGER_COLUMNS])
    rows = _ranked(ledger, n).withColumn("last", F.lead("row_no").over(Window.orderBy("row_no")).isNull())
    events = rows.select("row_no", "last", F.concat(F.lit("  {\n"), fields, F.lit("\n  }"), F.when(F.col("last"), "").otherwise(",")).alias("line"))
    # One row more than n at most: the brackets stand before the first event and after the last one.
    ends = events.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("k")).select(F.explode(F.when(F.col("k") == 0, F.array(F.struct(F.lit(0).alias("row_no"), F.lit("[]").alias("line"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("row_no"), F.lit("[").alias("line")), F.struct((F.col("k") + 1).alias("row_no"), F.lit("]").alias("line"))))).alias("e")).select("e.*")
    return events.select("row_no", "line").unionByName(ends)


def write_single_file(df: DataFrame, path: str, col: str) -> None:
    """Write a bounded export as one text file in row order."""
    df.orderBy("row_no").select(col).coalesce(1).write.mode("overwrite").text(path)
