"""JSON sources and sinks with declared schemas."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relations import ranked


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One object a line. Tolerant: blank and corrupt lines are skipped and a missing path is an empty table. Strict:
    both raise. Missing fields are null."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def corrupt_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row (lines, corrupt) of a JSONL path; blank lines don't count."""
    text = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    return text.agg(F.count("*").alias("lines"), F.count_if(bad).alias("corrupt"))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, under: str | None = None) -> DataFrame:
    """A file with one top-level array, or with an array ``under`` a key; ``schema`` is of an element."""
    if under is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    element = schema if isinstance(schema, str) else schema.simpleString()[len("struct<") : -1]
    wrapped = spark.read.schema(f"`{under}` array<struct<{_colons(element)}>>").option("multiLine", True).json(path)
    return wrapped.select(F.explode(F.col(under)).alias("x")).select("x.*")


def _colons(ddl: str) -> str:
    if ":" in ddl.split(",")[0]:
        return ddl
    return ", ".join(f"{p.strip().split(' ', 1)[0]}: {p.strip().split(' ', 1)[1]}" for p in _top_level(ddl))


def _top_level(ddl: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(ddl[at:i])
            at = i + 1
    return [*parts, ddl[at:]]


def write_jsonl(df: DataFrame, path: str, append: bool = False, nulls: bool = True) -> None:
    """One object a line; with ``nulls``, null fields are written too."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def write_json_array(df: DataFrame, path: str, order: list[str], most: int = 100_000) -> None:
    """One file with an indented array, for small results: more than ``most`` rows raise instead of filling the driver."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write JSON lines instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r["j"]) for r in rows], f, ensure_ascii=False, indent=2)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table as one indented object."""
    row = stats.select(F.to_json(F.struct(*stats.columns), {"ignoreNullFields": "false"}).alias("j")).first()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row["j"]), f, ensure_ascii=False, indent=2)


def cached(df_of, spark: SparkSession, path: str, overwrite: bool = False) -> DataFrame:
    """Builds a Parquet table once and reads it from then on; ``df_of`` is only called when it must be built."""
    if overwrite or not exists(spark, os.path.join(path, "_SUCCESS")):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merge_parts(spark: SparkSession, paths: list[str], schema: StructType | str, order: str) -> DataFrame:
    """Partial JSONL outputs of several writers as one table in the order of a column, which is dropped. Writers count
    for themselves, so the same index in several parts is as many rows: all stay, those of the earlier path first.
    Corrupt lines and missing paths are left out; rows without the index come first."""
    have = [p for p in paths if exists(spark, p)]
    if not have:
        return spark.createDataFrame([], schema).drop(order)
    parts = None
    for k, p in enumerate(have):
        part = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(p).withColumn("_part", F.lit(k))
        parts = part if parts is None else parts.unionByName(part)
    return parts.orderBy(order, "_part").drop(order, "_part")


def append_scalars(df: DataFrame, path: str, step: str, values: list[str]) -> None:
    """A metric log: one row (step, tag, value) for each of the named columns of each row, appended as JSON lines; null
    values are left out."""
    long = df.select(F.col(step).cast("long").alias("step"), F.explode(F.array(*[F.struct(F.lit(v).alias("tag"), F.col(v).cast("double").alias("value")) for v in values])).alias("x"))
    write_jsonl(long.select("step", "x.tag", "x.value").where("value is not null"), path, append=True)


def write_records(df: DataFrame, path: str, prefix: str, order: list[str]) -> None:
    """The projection (id, context, conversations) of a corpus as JSON lines; ids count in the given order."""
    numbered = ranked(df.select("context", "conversations", F.struct(*order).alias("_o")), F.col("_o"), "_n")
    write_jsonl(numbered.select(F.format_string(f"{prefix}.%04d", "_n").alias("id"), "context", "conversations"), path)


def read_template(spark: SparkSession, path: str) -> str:
    """A text file as one string, for templates."""
    return spark.read.text(path, wholetext=True).first()["value"]
