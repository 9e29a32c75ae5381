"""Small helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a one-process session may make its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared folder, read back.

    The files survive a lost executor and hold only the columns given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(column: str = "doc_id"):
    """CRC-32 of the id's decimal text, the key of the fixed folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def barrier(df: DataFrame, *columns) -> DataFrame:
    """Compute the columns once: a Generate node that projections aren't folded into."""
    packed = F.explode(F.array(F.struct(*columns))).alias("_once")
    return df.select("*", packed).select(*[F.col(f"`{c}`") for c in df.columns], "_once.*")


def text_slices(batches, names: tuple[str, ...], text: str = "text", most: int = 1 << 20):
    """Cut Arrow batches into runs of rows with at most ``most`` characters of text, one row at least.

    Yields (lists of the named columns, texts). A null text is None.
    """
    for batch in batches:
        texts = batch.column(text)
        plain = [batch.column(n) for n in names]
        start, size = 0, 0
        lengths = [0 if not s.is_valid else len(s.as_buffer()) for s in texts]
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield [c.slice(start, i - start) for c in plain], texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield [c.slice(start) for c in plain], texts.slice(start).to_pylist()


def whole_runs(batches, keys: tuple[str, ...], least: int = 1 << 16):
    """Join Arrow batches of rows sorted by ``keys`` into tables that never cut a run of equal keys."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.logical_and.reduce([(c := table.column(k).to_numpy()) == c[-1] for k in keys])
        turn = int(np.argmax(last))
        if turn:
            yield table.slice(0, turn)
            held, rows = table.slice(turn).to_batches(), rows - turn
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
