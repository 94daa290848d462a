"""Queries over what a user plugs in: an embedder, decoders of files, an observer, a file of labelled cases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.operators import plug
from attest.plans import fixtures as fx
from attest.plans.registry import query
from attest.sources import records
from attest.sources.shared import shared_dir

BLOCK = 200  # documents a file


def _files(spark: SparkSession, blocks: DataFrame, compression: str = "none") -> str:
    """Folder with one text file for each row of ``value``."""
    path = f"{shared_dir(spark)}/attest-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    blocks.select("value").write.option("maxRecordsPerFile", 1).text(path, compression=compression)
    return path


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_letters, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n_e FROM documents")
def plug_embed(spark, d):
    """An embedder of two numbers, called once a batch of distinct texts."""
    found = plug.embed(fx.table(spark, d, "documents").select("doc_id", "text"), _lengths)
    return found.select("doc_id", *[F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("n_letters", "n_e"))])


@query("SELECT count(*) AS rows, count(*) FILTER (text LIKE '%e%') AS with_e, count(*) FILTER (lang IS NULL) AS unnamed FROM documents")
def plug_observed(spark, d):
    """What an observer sees go by while the documents are read."""
    rows, seen = plug.observed(fx.table(spark, d, "documents"), "documents", with_e=F.col("text").contains("e"), unnamed=F.col("lang").isNull())
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "with_e", "unnamed"))], "rows long, with_e long, unnamed long")


@query("SELECT 'text' AS reader, line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY line")
def plug_files(spark, d):
    """Files of documents, read by the decoder of their extension."""
    docs = fx.table(spark, d, "documents").filter("text is not null")
    blocks = docs.groupBy(F.floor(F.col("doc_id") / BLOCK)).agg(F.array_join(F.collect_list("text"), "\n").alias("value"))
    read = plug.read_files(spark, _files(spark, blocks), {"text": lambda b: b.decode().removesuffix("\n").split("\n")})
    return read.filter("warning is null").groupBy("reader", "line").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.PAIRS} SELECT doc_id || ':' || unit_no AS id, original, rewritten, unit_no % 2 = 0 AS invented_metric, unit_no % 3 = 0 AS role_escalation FROM pairs""")
def src_cases(spark, d):
    """Labelled cases, written as JSON objects that hold a list each, packed, and read again."""
    labels = F.struct((F.col("unit_no") % 2 == 0).alias("invented_metric"), (F.col("unit_no") % 3 == 0).alias("role_escalation"))
    case = F.struct(F.concat_ws(":", "doc_id", "unit_no").alias("id"), "original", "rewritten", labels.alias("labels"), F.lit("").alias("note"))
    blocks = fx.pairs(spark, d).groupBy(F.floor(F.col("doc_id") / BLOCK)).agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value"))
    return records.read_cases(spark, _files(spark, blocks, "snappy")).select("id", "original", "rewritten", "labels.*")
