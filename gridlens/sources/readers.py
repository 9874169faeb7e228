"""Scans. Record files are read with an explicit schema, so unused columns are pruned while parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METADATA, OBSERVATION, RULE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = OBSERVATION) -> DataFrame:
    """One record a line; a line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType = OBSERVATION) -> DataFrame:
    """Whole files that hold one array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType = RULE) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and the lines that did not parse (``line``) so that they can be counted; blank lines are neither."""
    lines = spark.read.text(path).where("trim(value) != ''").withColumnRenamed("value", "line")
    rows = parse_tolerant(lines, "line", schema)
    return rows.where("record IS NOT NULL").select("record.*"), rows.where("record IS NULL").select("line")


def parse_tolerant(rows: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """As above for a column of lines: ``record`` is null where the line doesn't parse."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = rows.withColumn("__p", F.from_json(text_col, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    record = F.struct(*[F.col(f"__p.{f.name}").alias(f.name) for f in schema.fields])
    return parsed.withColumn("record", F.when(F.col("__p._corrupt_record").isNull() & F.col("__p").isNotNull(), record)).drop("__p")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row; a missing file is an error rather than a reason to ask a simulator."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def topology_tables(metadata: DataFrame) -> dict[str, DataFrame]:
    """Metadata's index arrays as tables (element, bus), small enough by nature to be broadcast."""
    return {name: metadata.select(F.posexplode(f"topology.{name}").alias("element", "bus")) for name in ("line_or_bus", "line_ex_bus", "load_to_sub", "gen_to_sub")}


def read_glob(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files that match, each row with ``file`` to order by; parsed line by line."""
    return spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_name").alias("file"))


def with_sample_id(rows: DataFrame, episode: str = "chronic_id", step: str = "timestep") -> DataFrame:
    """A stable key in place of the line number: (episode, step) is unique in a record file."""
    return rows.withColumn("sample_id", F.struct(F.col(episode).alias("episode"), F.col(step).alias("step")))


def labels_only(rows: DataFrame) -> DataFrame:
    return rows.select("label")


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Random access by key, as a semi-join."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def pages_to_document(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """Numbered pages with text joined to one document: ``[Page n]``, the stripped text, blank lines between."""
    from ..functions.text import strip

    body = pages.select(F.col(doc_col), F.col(page_col).alias("page"), strip(F.coalesce(text_col, F.lit(""))).alias("said")).where("said != ''")
    line = F.struct("page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("said")).alias("text"))
    return body.groupBy(doc_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n\n").alias("text"))
