"""File import, catalog listing, views and Parquet output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.sources.schemas import TABLES

CORRUPT = "_corrupt_record"


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """Import delimited text under a declared schema, one pass, no inference.

    Lines that do not fit keep their NULLs and carry the raw line in
    ``_corrupt_record``, so that nothing is lost at import. A quote inside quotes
    is doubled. With ``multi_line`` a quoted value may hold line breaks; a file is
    then read by one task, so large ones should come in pieces. Without it such a
    record arrives as several corrupt ones.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (
        spark.read.schema(with_corrupt)
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    """Delimited text that ``read_csv`` reads back with ``multi_line``: blanks stay, a quote inside quotes is doubled."""
    writer = df.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read one of the model's tables under its schema, from 'parquet' or 'csv'."""
    schema = TABLES[name]
    if fmt == "parquet":
        return read_parquet(spark, path, schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    raise ValueError(f"unknown format {fmt!r}")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def register_views(views: dict[str, DataFrame]) -> None:
    """Name DataFrames for SQL. A view is inlined, so later filters still reach the scan."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views the session knows (metadata only)."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def catalog_columns(spark: SparkSession, table: str | None = None, database: str | None = None) -> DataFrame:
    """Columns of every known table, or of one (metadata only)."""
    names = [table] if table is not None else [t.name for t in spark.catalog.listTables(database)]
    rows = [
        (name, position, field.name, field.dataType.simpleString(), field.nullable)
        for name in names
        for position, field in enumerate(spark.table(name).schema.fields, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal_position int, column_name string, data_type string, is_nullable boolean"
    ).orderBy(F.col("table_name"), F.col("ordinal_position"))
