"""Reading and writing the churn tables, reports and models.

CSV is read with an explicit schema (no inference pass over the data); the
timestamp columns are read as text and converted afterwards so that the one
lenient column (``cancellation_date``) turns bad values into nulls while the
others fail loudly.  Spark's CSV reader drops a UTF-8 byte-order mark.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.schemas import CSV_SCHEMAS

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # as written: nothing of a timestamp is cut
# (column, lenient) per table: which text columns become timestamps
TIMESTAMP_COLUMNS = {
    "transactions": (("transaction_date", False), ("cancellation_date", True)),
    "customers": (("registration_date", False),),
    "predictions": (),
}


def _as_text(schema: T.StructType, names) -> T.StructType:
    names = set(names)
    return T.StructType([T.StructField(f.name, T.StringType(), True) if f.name in names else f
                         for f in schema.fields])


# A2 / A3 ----------------------------------------------------------------------
def parse_ts(df: DataFrame, col: str, lenient: bool = False, fmt: str | None = None) -> DataFrame:
    """Text to timestamp (no zone).  Without ``fmt`` a date alone, whole seconds and any
    fraction of up to six digits are read; ``fmt`` fixes one form.  Strict raises on a bad
    value; lenient turns it into null."""
    c = F.trim(F.col(col))
    if fmt is not None:
        parsed = (F.try_to_timestamp if lenient else F.to_timestamp)(c, F.lit(fmt) if lenient else fmt)
    else:
        parsed = c.try_cast(T.TimestampNTZType()) if lenient else c.cast(T.TimestampNTZType())
    return df.withColumn(col, parsed.cast(T.TimestampNTZType()))


# A1 ---------------------------------------------------------------------------
def read_tables(spark: SparkSession, directory: str,
                schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The three CSV tables (header, UTF-8, optional byte-order mark).

    ``schemas`` replaces the declared schemas (for tables bound to other data);
    their timestamp columns are then parsed strictly."""
    out = {}
    for name, schema in (schemas or CSV_SCHEMAS).items():
        ts = TIMESTAMP_COLUMNS.get(name, ()) if schemas is None else tuple(
            (f.name, f.name == "cancellation_date") for f in schema.fields
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)))
        df = (spark.read.schema(_as_text(schema, [c for c, _ in ts]))
              .option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST")
              .csv(f"{directory.rstrip('/')}/{name}.csv"))
        for col, lenient in ts:
            df = parse_ts(df, col, lenient=lenient)
        out[name] = df
    return out


class Checked(NamedTuple):
    """A table read row by row: what could be read, what could not, and what was read as null."""

    rows: DataFrame  # the typed columns
    rejected: DataFrame  # table_name, reason, reasons, record
    nulled: DataFrame  # table_name, reason, record


MALFORMED = "malformed row"
_LINE = "_malformed"


def read_checked(spark: SparkSession, directory: str, schemas: dict[str, T.StructType] | None = None,
                 header: bool = True) -> dict[str, Checked]:
    """The CSV tables as ``read_tables`` types them, with a quarantine instead of an error.

    A row with too few or too many fields (``malformed row``) or with a value that its column's type does not
    take (``bad <column>``) goes to ``rejected`` with its text: ``reasons`` has them all, ``reason`` the first in
    column order, so rows read and rows rejected by ``reason`` add up to the rows of the files (blank lines are
    none).  An unreadable value of a lenient column becomes null; its row is read, and listed in ``nulled`` too.
    Empty fields are null and never bad.  All three are filters over the same scan and hold no state.
    """
    out = {}
    for name, schema in (schemas or CSV_SCHEMAS).items():
        lenient = {c for c, soft in TIMESTAMP_COLUMNS.get(name, ()) if soft} | ({"cancellation_date"} & set(schema.names))
        text = T.StructType([T.StructField(f"_t{i}", T.StringType()) for i in range(len(schema))]
                            + [T.StructField(_LINE, T.StringType())])
        raw = (spark.read.schema(text).option("header", header).option("enforceSchema", True)
               .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
               # a pruned scan would not see how many fields a row has
               .option("columnPruning", False).csv(f"{directory.rstrip('/')}/{name}.csv"))
        typed, hard, soft = [], [F.when(F.col(_LINE).isNotNull(), F.lit(MALFORMED))], []
        for i, f in enumerate(schema.fields):
            written = F.col(f"_t{i}")
            if isinstance(f.dataType, T.StringType):
                typed.append(written.alias(f.name))
                continue
            stamp = isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) or f.name in dict(
                TIMESTAMP_COLUMNS.get(name, ()))
            value = F.trim(written).try_cast(T.TimestampNTZType() if stamp else f.dataType)
            typed.append(value.alias(f.name))
            (soft if f.name in lenient else hard).append(
                F.when(written.isNotNull() & value.isNull(), F.lit(f"bad {f.name}")))
        record = F.coalesce(F.col(_LINE), F.to_csv(F.struct(*[F.col(f"_t{i}") for i in range(len(schema))])))
        held = raw.select(*typed, F.array_compact(F.array(*hard)).alias("_reasons"),
                          F.array_compact(F.array(*soft, F.lit(None).cast("string"))).alias("_nulled"),
                          record.alias("_record"))
        good, label = F.size("_reasons") == 0, F.lit(name).alias("table_name")
        out[name] = Checked(
            held.where(good).select(*schema.names),
            held.where(~good).select(label, F.get("_reasons", F.lit(0)).alias("reason"),
                                     F.col("_reasons").alias("reasons"), F.col("_record").alias("record")),
            held.where(good).select(label, F.explode("_nulled").alias("reason"), F.col("_record").alias("record")))
    return out


def check_summary(name: str, checked: Checked) -> DataFrame:
    """(table_name, outcome, reason, rows): rows read, rejected by first reason, values read as null by column."""
    def counted(df: DataFrame, outcome: str) -> DataFrame:
        return df.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(outcome).alias("outcome"), "reason", "rows")
    read = checked.rows.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("reason"),
        "rows")
    return read.unionByName(counted(checked.rejected, "rejected")).unionByName(counted(checked.nulled, "nulled"))


# A4 ---------------------------------------------------------------------------
def write_tables(tables: dict[str, DataFrame], directory: str, mode: str = "overwrite", bom: bool = True) -> None:
    """Each table as a CSV folder with a header row and no index column; every file begins with a UTF-8
    byte-order mark (``bom``), by which spreadsheets know the encoding."""
    for name, df in tables.items():
        if bom:
            df = df.withColumnsRenamed({df.columns[0]: "\ufeff" + df.columns[0]})
        (df.write.mode(mode).option("header", True).option("timestampNTZFormat", TS_FORMAT)
         .csv(f"{directory.rstrip('/')}/{name}.csv"))


# A5 ---------------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A chart dataset or metric table as JSON lines (one object per row)."""
    df.write.mode(mode).json(path)


# A6 ---------------------------------------------------------------------------
def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    from churnwise.operators.stats import report_text
    report_text(report).write.mode(mode).text(path)


# A7 / A8 ----------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    """The fitted pipeline; the assembler stage keeps the feature order."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
