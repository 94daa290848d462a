"""What a user plugs in: an embedder, decoders of file formats, an observer of progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attest.sources.pages import route


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None, text_col: str = "text", into: str = "embedding") -> DataFrame:
    """The rows with the embedder's vector of each text, called once a batch of distinct texts; null for a null text,
    and for all without an embedder, so that only exact keys match."""
    if embedder is None:
        return texts.withColumn(into, F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        distinct = column.dropna().unique().tolist()
        vectors = dict(zip(distinct, embedder(distinct), strict=True)) if distinct else {}
        return column.map(lambda t: vectors.get(t))

    return texts.withColumn(into, run(F.col(text_col)))


def read_files(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """(path, reader, line_no, line, warning) of files, each decoded by its extension's reader into lines. A file that
    no decoder is for, or that its decoder fails on, is one row with a warning."""
    _, reader = route(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", reader.alias("reader"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, kind, content in part.itertuples(index=False):
                try:
                    if kind not in decoders:
                        raise ValueError("no reader")
                    rows += [(name, kind, i, line, None) for i, line in enumerate(decoders[kind](bytes(content)))]
                except Exception as e:  # a file that can't be read is a row of the result
                    rows.append((name, kind, None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["path", "reader", "line_no", "line", "warning"]).astype({"line_no": "Int64"})

    return files.mapInPandas(run, "path string, reader string, line_no long, line string, warning string")


def observed(rows: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds their number and the given conditions' counts once an action has run:
    progress for a caller who watches."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen
