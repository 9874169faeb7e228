"""Queries on readers and writers: given tables go out to files in the shared folder and come back through the readers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit as D
from ..operators import splits as P
from ..operators import stats as S
from ..schemas import METADATA
from ..sources import readers as R
from ..sources import writers as W
from ..sources.pdf import pdf_pages, write_pdf
from ..sources.scratch import shared_path
from .labels import CLASSES, events

_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
_COLUMNS = [f.name for f in _EVENT.fields]


def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "lines")
    W.write_jsonl(events(spark, d).select(*_COLUMNS), path)
    return R.read_jsonl(spark, path, _EVENT)


def json_array_scan(spark, d):
    """A file for each thousand events, which holds one array."""
    path = shared_path(spark, "arrays")
    record = F.struct(*_COLUMNS)
    arrays = events(spark, d).groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return R.read_json_array(spark, f"{path}/part=*", _EVENT).select(*_COLUMNS)


def tolerant_files(spark, d):
    """Lines of which some are cut and some blank."""
    path = shared_path(spark, "tolerant")
    line = F.to_json(F.struct(*_COLUMNS))
    cut = F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 25)).when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(line)
    events(spark, d).select(cut.alias("value")).write.text(path)
    rows, bad = R.read_jsonl_tolerant(spark, path, _EVENT)
    parsed = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    return parsed.unionByName(bad.select(F.lit("malformed").alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("users")))


def metadata_scan(spark, d):
    """Suppliers as generators and nations as substations: metadata written, read, and its index arrays as tables."""
    path = shared_path(spark, "metadata")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_nationkey"))), lambda x: x["s_nationkey"].cast("int"))
    one = R.table(spark, d, "supplier").agg(F.count(F.lit(1)).cast("int").alias("n_gen"), listed.alias("gen_to_sub"))
    whole = one.select(F.lit("grid").alias("env_name"), "n_gen", F.struct("gen_to_sub").alias("topology"), F.lit(2.0).alias("rho_clip"))
    W.write_summary(whole, path)
    meta = R.read_metadata(spark, path)
    assert meta.schema == METADATA
    return R.topology_tables(meta)["gen_to_sub"].select(F.col("element").cast("long").alias("element"), F.col("bus").cast("long").alias("bus"))


def glob_scan(spark, d):
    """One folder of lines for each class, read by a pattern; every row knows its file."""
    path = shared_path(spark, "glob")
    events(spark, d).select(*_COLUMNS, F.col("event_type").alias("class")).write.partitionBy("class").json(path)
    rows = R.read_glob(spark, f"{path}/class=[cv]*/*.json", _EVENT)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.col("file").endswith(".json")).alias("with_file"))


def split_files(spark, d):
    """Parquet by split, of which one is read."""
    path = shared_path(spark, "split")
    W.write_split(P.ordered_split(events(spark, d).select("event_id", "event_type"), "event_id"), path)
    return spark.read.parquet(path).where("split = 'val'").select("event_id", "event_type")


def summary_file(spark, d):
    path = shared_path(spark, "summary")
    one = S.episode_lengths(events(spark, d), F.col("user_id"))
    W.write_summary(one, path)
    return spark.read.schema(one.schema).option("multiLine", True).json(path)


def audit_report(spark, d):
    """The page of the audit: figures and issues are a few collected rows."""
    e = events(spark, d)
    stats = {r["label"]: r["n"] for r in S.full_histogram(e, "event_type", CLASSES).orderBy("label_id").collect()}
    issues = D.issues(e, "event_type", CLASSES, ("maintenance",), {}).orderBy("id").collect()
    return spark.createDataFrame([(W.render_report(stats, issues),)], "page string")


def pdf_documents(spark, d):
    """Conversations as PDF files of one turn a page, plain and compressed ones by turns, read back into documents."""

    def bound(batches):
        for b in batches:
            yield pd.DataFrame({"conv_id": b["conv_id"], "content": [write_pdf(list(p), i % 2 == 0) for i, p in zip(b["conv_id"], b["pages"], strict=True)]})

    turns = R.table(spark, d, "conversations")
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("pages"))
    files = pages.mapInPandas(bound, "conv_id long, content binary")
    return R.pages_to_document(pdf_pages(files, "conv_id"), "conv_id", "page", "text").select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


_ROWS = "SELECT event_id, user_id, event_type, value, props FROM events"

PLANS = {
    "jsonl_scan": (jsonl_scan, _ROWS),
    "json_array_scan": (json_array_scan, _ROWS),
    "tolerant_files": (
        tolerant_files,
        """SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1
UNION ALL SELECT 'malformed', count(*), NULL FROM events WHERE event_id % 11 = 0""",
    ),
    "metadata_scan": (metadata_scan, "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS element, CAST(s_nationkey AS BIGINT) AS bus FROM supplier"),
    "glob_scan": (glob_scan, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value, count(*) AS with_file FROM events WHERE event_type[1] IN ('c', 'v') GROUP BY 1"),
    "split_files": (
        split_files,
        """WITH s AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS o, count(*) OVER () AS n FROM events)
SELECT event_id, event_type FROM s WHERE o >= floor(n * 0.7::DOUBLE) AND o < floor(n * 0.85::DOUBLE)""",
    ),
    "pdf_documents": (
        pdf_documents,
        """WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page, text FROM conversations),
p AS (SELECT conv_id, page, trim(text, ' ' || chr(10)) AS t FROM n WHERE trim(coalesce(text, ''), ' ' || chr(10)) <> ''),
g AS (SELECT conv_id, string_agg('[Page ' || page || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY 1) SELECT conv_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM g""",
    ),
    "summary_file": (summary_file, "SELECT count(*) AS episodes, min(n) AS shortest, max(n) AS longest FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"),
    "audit_report": (
        audit_report,
        """WITH d AS (SELECT unnest(['view','click','purchase','signup','error','maintenance']) AS label, unnest(range(6)) AS i), h AS (SELECT label, i, count(e.event_id) AS n FROM d LEFT JOIN events e ON e.event_type = d.label GROUP BY 1, 2),
r AS (SELECT round(max(n) / (min(n) + 1e-9::DOUBLE), 2) AS ratio FROM h WHERE n > 0), absent AS (SELECT list(label ORDER BY label) AS l FROM h WHERE n = 0),
i AS (SELECT 'imbalance' AS id, 'medium' AS severity, 'Classes are uneven' AS title, printf('%.2f', ratio) AS detail, 'Weigh or undersample classes' AS fix FROM r WHERE ratio > 10
  UNION ALL SELECT 'missing_labels', CASE WHEN l = ['maintenance'] THEN 'medium' ELSE 'high' END, 'Expected classes don&#x27;t occur', array_to_string(l, ','), 'Collect more episodes' FROM absent WHERE len(l) > 0
  UNION ALL SELECT 'empty', 'high', 'The data set is empty', NULL, NULL FROM (SELECT count(*) AS n FROM events) WHERE n = 0)
SELECT '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Data audit</title></head><body><h1>Data audit</h1>' || (SELECT string_agg('<div class="card"><b>' || n || '</b><span>' || label || '</span></div>', '' ORDER BY i) FROM h) || '<ul>'
  || coalesce((SELECT string_agg('<li class="' || severity || '"><em>' || severity || '</em> ' || title || coalesce('<p>' || detail || '</p>', '') || coalesce('<p>Fix: ' || fix || '</p>', '') || '</li>', '' ORDER BY id) FROM i), '<li>No issues</li>') || '</ul></body></html>' AS page""",
    ),
}
