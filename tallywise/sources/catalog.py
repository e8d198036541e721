"""Reading, checking and registering the input tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .schemas import INPUT_SCHEMAS, TABLES

# Free-text columns of these files may hold line breaks inside quotes.
MULTILINE_TABLES = ("order_reviews",)


class MissingInput(ValueError):
    """An input file, table or column is not there."""


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """Changes when an input file does; lists files, reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    row = files.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))
    ).first()
    return f"{row[0]}:{row[1]}"


def default_files(suffix: str = ".csv", prefix: str = "") -> dict[str, str]:
    return {table: f"{prefix}{table}{suffix}" for table in TABLES}


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path)
    except AnalysisException:
        return False
    return True


def require_files(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Fail once, naming every path that cannot be found."""
    missing = [path for path in paths.values() if not path_exists(spark, path)]
    if missing:
        raise MissingInput("missing input files: " + ", ".join(missing))


def require_tables(tables: Mapping[str, DataFrame], names: Iterable[str] = TABLES) -> None:
    missing = [name for name in names if name not in tables]
    if missing:
        raise MissingInput("missing input tables: " + ", ".join(missing))


def require_columns(df: DataFrame, names: Iterable[str], label: str = "input") -> DataFrame:
    """Return ``df`` unchanged when it has all ``names``; no job is run."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingInput(f"{label} lacks required columns: " + ", ".join(missing))
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the declared columns of ``table``, cast to their declared types."""
    schema = INPUT_SCHEMAS[table]
    require_columns(df, schema.names, table)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_csv_tables(
    spark: SparkSession,
    raw_dir: str,
    files: Mapping[str, str] | None = None,
    multiline: Iterable[str] = MULTILINE_TABLES,
) -> dict[str, DataFrame]:
    """Scan the CSV inputs by header name.

    No schema inference: every column is read as text and only the declared
    ones are parsed and cast, so unknown extra columns are pruned by the parser.
    A ``multiline`` file is read by one task; large tables come as folders of
    many files, or without line breaks inside values.
    """
    paths = {t: f"{raw_dir.rstrip('/')}/{f}" for t, f in (files or default_files()).items()}
    require_files(spark, paths)
    tables = {}
    for table, path in paths.items():
        reader = spark.read.option("header", True).option("escape", '"')
        tables[table] = conform(reader.csv(path, multiLine=table in multiline), table)
    require_tables(tables)
    return tables


def read_parquet_tables(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    paths = {t: f"{raw_dir.rstrip('/')}/{t}.parquet" for t in TABLES}
    require_files(spark, paths)
    return {table: conform(spark.read.parquet(path), table) for table, path in paths.items()}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make each table reachable from ``spark.sql`` under its name, in the whole session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run an SQL query against ``tables`` under their names.

    The names hold inside this query only: they are put in front of it as its own
    expressions, so analyses over other inputs in the same session never see them.
    """
    bound = ", ".join(f"{name} AS (SELECT * FROM {{_table_{name}}})" for name in tables)
    escaped = text.replace("{", "{{").replace("}", "}}")
    query = f"WITH {bound} SELECT * FROM ({escaped})" if tables else escaped
    return spark.sql(query, **{f"_table_{name}": df for name, df in tables.items()})


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and in total."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    per_table = reduce(DataFrame.unionByName, counts)
    return (
        per_table.rollup("table_name")
        .agg(F.sum("row_count").alias("row_count"))
        .select(F.coalesce("table_name", F.lit("total")).alias("table_name"), "row_count")
    )
