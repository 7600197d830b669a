"""Tables and documents in and out: Parquet, CSV, JSON lines, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """df as parquet, csv (with a header; arrays as JSON) or json, replacing what is there."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df = df.selectExpr(*(f"to_json(`{c}`) as `{c}`" if c in nested else f"`{c}`" for c in df.columns))
    df.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table again. CSV has strings only, unless a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.options(**({"header": True} if kind == "csv" else {})).format(kind).load(path)


def read_by_id(spark: SparkSession, path: str, column: str, value: str, kind: str = "parquet") -> DataFrame:
    """The rows of one id; Parquet skips the row groups without it."""
    t = read_table(spark, path, kind)
    return t.where(t[column] == value)


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Overrides (original_group_id, decision, confidence, reason) as JSON lines; an empty table where there is no file."""
    schema = "original_group_id string, decision string, confidence string, reason string"
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
