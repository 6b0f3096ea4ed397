"""Scans and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with header, every column as text: quotes doubled inside quotes, line breaks allowed there, a byte order
    mark ignored. With `columns` only those, by name."""
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, inferSchema=False).csv(path)
    return df.select(*columns) if columns else df


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The same, or no rows if there is no such file."""
    try:
        return read_csv(spark, path, columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], text_schema(columns))


def read_years(spark: SparkSession, pattern: str, years: list[str], columns: list[str] | None = None) -> DataFrame:
    """Yearly files by a pattern with {year}, with the column year."""
    out = None
    for y in years:
        df = read_csv(spark, pattern.format(year=y), columns).withColumn("year", F.lit(y))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def line_count(spark: SparkSession, path: str) -> int:
    """Lines without the header; a record with line breaks counts as several."""
    return max(spark.read.text(path).count() - 1, 0)


def read_json_rows(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """The rows of a JSON object of objects: its values."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.explode(F.map_values(F.from_json("value", f"map<string,{row_schema}>"))).alias("row")).select("row.*")


def read_registrants(spark: SparkSession, path: str) -> DataFrame:
    """Registrants of a JSON object of objects: cik_str, ticker, title."""
    return read_json_rows(spark, path, "struct<cik_str:bigint,ticker:string,title:string>")


def read_registrant_details(spark: SparkSession, path: str) -> DataFrame:
    """Details, one JSON document a line: name, sic, its description and the state of business, or of incorporation."""
    schema = "name string, sic string, sicDescription string, stateOfIncorporation string, addresses struct<business:struct<stateOrCountry:string>>"
    df = spark.read.schema(schema).json(path)
    state = F.coalesce("addresses.business.stateOrCountry", "stateOfIncorporation")
    return df.select("name", F.lpad("sic", 4, "0").alias("sic"), "sicDescription", state.alias("state"))


def contractors(extract: DataFrame) -> DataFrame:
    """Contractors with a name that is left after normalising, by state."""
    from gatework.functions.text import contractor_name

    df = extract.withColumns({"name_norm": contractor_name(F.col("name")), "state": F.upper(F.trim("phys_state"))})
    return df.where("coalesce(name, '') <> '' and name_norm <> ''")


def workbook_rows(df: DataFrame, skip: int, names: dict[str, str], needed: list[str], order: str) -> DataFrame:
    """An exported sheet's rows behind the first `skip` by an order, with columns renamed and the others left out, without
    rows that lack one of the needed."""
    first = df.select(order).orderBy(order).limit(skip)  # as many rows as the sheet has headings
    rows = df.join(F.broadcast(first), order, "left_anti") if skip else df
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()]).dropna(subset=needed)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Overwrites with the columns in that order; others are left out, missing ones are empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").options(header=True, escape='"').csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, base: str, version: str) -> str:
    """A new version beside the others; inputs are never overwritten."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_split(df: DataFrame, full: str, part: str, condition: str) -> None:
    """All rows, and those of the condition, from one computation."""
    df.write.mode("overwrite").parquet(full)
    df.sparkSession.read.parquet(full).where(condition).write.mode("overwrite").parquet(part)


def write_tabs(df: DataFrame, path: str, column: str = "stratum") -> None:
    """A folder for each value of the column, as the tabs of a workbook."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def formatted(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Doubles as text for people."""
    return df.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def shared(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp()}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame, what: str) -> DataFrame:
    """df, computed once into a table in the shared folder, where its lineage ends."""
    path = shared(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
