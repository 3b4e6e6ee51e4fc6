"""Text formats: CSV in and out, JSON table documents, COPY lines, array-notation literals."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import gear
from larkspur.plans.catalog import sql_type
from larkspur.plans.ship import ship

#: Array elements in a CSV field.
LIST_SEP = ";"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, null_value: str = "") -> DataFrame:
    """A CSV file or folder with a header; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", null_value)
    if schema is None:
        return reader.csv(path)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema.fields])
    df = reader.schema(flat).csv(path)
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            df = df.withColumn(f.name, F.split(f.name, LIST_SEP).cast(f.dataType))
    return df


def flat_arrays(df: DataFrame) -> DataFrame:
    """Arrays as text joined by ``;`` (null elements drop out)."""
    return df.select(*[F.array_join(F.col(f"`{f.name}`").cast("array<string>"), LIST_SEP).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, null_value: str = "") -> None:
    flat_arrays(df).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", null_value).option("emptyValue", '""').csv(path)


def read_lines(spark: SparkSession, lines: Iterable[str], schema: T.StructType, separator: str = ",") -> DataFrame:
    """COPY input: one row per line, typed by ``schema``; ``#`` lines are comments, ``NULL`` is null."""
    rows = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema.fields])
    raw = spark.createDataFrame([(x,) for x in rows], "value string")
    parsed = raw.select(F.from_csv("value", flat.simpleString()[7:-1].replace(":", " "), {"sep": separator, "nullValue": "NULL", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"}).alias("r"))
    df = parsed.select("r.*")
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            df = df.withColumn(f.name, F.split(f.name, LIST_SEP).cast(f.dataType))
    return df


def json_document(name: str, df: DataFrame, primary: Iterable[str] = (), not_null: Iterable[str] = ()) -> dict:
    """``{name, columns, rows}`` of a small table."""
    primary, not_null = set(primary), set(not_null)
    columns = [{"name": f.name, "type": f.dataType.simpleString(), "primary_key": f.name in primary, "not_null": f.name in not_null} for f in df.schema.fields]
    return {"name": name, "columns": columns, "rows": [json.loads(r[0]) for r in df.select(F.to_json(F.array(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) for c in df.columns]))).toLocalIterator()]}


def from_json_document(spark: SparkSession, doc: dict | str) -> tuple[str, DataFrame]:
    """Table of a ``{name, columns, rows}`` document; cells may be plain values or ``{"v": value}`` texts."""
    doc = json.loads(doc) if isinstance(doc, str) else doc

    def kind(name: str) -> T.DataType:
        try:
            return sql_type(name)
        except KeyError:
            return T._parse_datatype_string(name)

    schema = T.StructType([T.StructField(c["name"], kind(c["type"])) for c in doc["columns"]])

    def cell(v: object, t: T.DataType) -> object:
        if isinstance(v, str) and v.startswith('{"v":'):
            v = json.loads(v)["v"]
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        if isinstance(t, T.LongType):
            return int(v)
        return v

    rows = [tuple(cell(v, f.dataType) for v, f in zip(r, schema.fields)) for r in doc["rows"]]
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)) else f.dataType) for f in schema.fields])
    df = spark.createDataFrame(rows, text)
    return doc["name"], df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def array_literal(text: str) -> object:
    """Python value of an array-notation literal such as ``[1,"a",nil]``."""
    return gear.read_sqf(text)


def literal_to_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Append ``out``: a column of array-notation literals as JSON text; null where it cannot be read."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        def one(t: object) -> str | None:
            try:
                return None if t is None else json.dumps(gear.read_sqf(t), ensure_ascii=False)
            except gear.Unreadable:
                return None

        return s.map(one)

    return df.withColumn(out, convert(F.col(column)))
