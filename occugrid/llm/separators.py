"""Token counts of documents in flat token files, by scanning for separators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occugrid.llm import tokens
from occugrid.llm.shared import text_of
from occugrid.storage import new_table_path, written_table

#: End of a document; no ordinary text has this id.
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20
#: Greatest id that a file holds.
_GREATEST = 0xFFFF
#: Blocks that one task reads, about.
BLOCKS_IN_TASK = 16

_BLOCKS = "path string, block long, n_tokens long, ends array<long>"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: one without lies on the default file system, as for Spark."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = hadoop.Path(folder)
    whole = path.makeQualified(hadoop.FileSystem.getDefaultUri(conf), hadoop.Path("/")).toString()
    return _as_uri(whole)


def _as_uri(path: str) -> str:
    """Hadoop writes local files as file:/path."""
    return re.sub("^file:/(?!/)", "file:///", path)


def write_token_files(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    separator: int = SEPARATOR,
    name: str = "token-files",
) -> tuple[str, DataFrame]:
    """Write all documents as flat files of unsigned 16-bit ids, each followed by ``separator``.

    Returns the folder, in the shared folder of the session, and ``(path, ordinal, id)``: which
    document is the how-manieth of a file; the files themselves say nothing of it. There is a
    file for each partition of the input. A task that runs twice writes the same file again,
    under another name first, so that nobody reads half of one. A null text is empty. An id that
    16 bits do not hold, as larger vocabularies have, is refused.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    if not 0 <= separator <= _GREATEST:
        raise ValueError(f"the separator {separator} does not fit in 16 bits")
    folder = qualified(spark, new_table_path(spark, name))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        target = f"{root}/part-{context.partitionId():06d}.bin"
        draft = f"{root}/_draft-{context.partitionId()}-{context.taskAttemptId()}"
        ordinal = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                for text in texts:
                    encoded = np.append(tokens.encode(text, vocabulary), np.uint32(separator))
                    if encoded.max() > _GREATEST:
                        raise ValueError(f"the id {encoded.max()} does not fit in 16 bits")
                    out.write(encoded.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"part-{context.partitionId():06d}.bin"] * len(ids)),
                        pa.array(range(ordinal, ordinal + len(ids)), pa.int64()),
                        pa.array(ids, pa.int64()),
                    ],
                    names=["path", "ordinal", "id"],
                )
                ordinal += len(ids)
        store.move(draft, target)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    order = rows.mapInArrow(written, "path string, ordinal long, id long")
    return folder, written_table(order, f"{name}-order")


def scan(
    spark: SparkSession,
    folder: str,
    separator: int = SEPARATOR,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``(path, ordinal, first_token, n_tokens, closed)`` of every document in flat token files.

    Files hold little-endian unsigned 16-bit ids and nothing else. They are read in blocks,
    many at a time; a block gives the places of its separators, found by one vectorised
    comparison. Where a document begins follows from the last separator of all earlier blocks
    of the file, and its number from how many there were: a prefix scan over a row per block.
    ``n_tokens`` counts the separator. What follows the last one is a document that is not
    ``closed``. Empty files have no documents, an empty folder gives no rows.
    """
    width = 2
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(folder)
        .select(F.col("path").alias("uri"), F.col("length"))
        .where(F.col("length") >= width)
    )
    n_blocks = F.ceil(F.col("length") / (block_tokens * width)).cast("long")
    total = files.agg(F.coalesce(F.sum(n_blocks), F.lit(0))).first()[0]
    blocks = files.select("uri", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, numbers = batch.column("uri").to_pylist(), batch.column("block").to_pylist()
            for uri, block in zip(uris, numbers, strict=True):
                store, path = fs.FileSystem.from_uri(_as_uri(uri))
                with store.open_input_file(path) as file:
                    first = block * block_tokens
                    raw = file.read_at(block_tokens * width, first * width)
                ids = np.frombuffer(raw, "<u2", count=len(raw) // width)
                ends = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rsplit("/", 1)[-1]]),
                        pa.array([block], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([ends.astype(np.int64)], pa.list_(pa.int64())),
                    ],
                    names=["path", "block", "n_tokens", "ends"],
                )

    found = written_table(
        blocks.repartition(max(1, total // BLOCKS_IN_TASK), "uri", "block").mapInArrow(
            scanned, _BLOCKS
        ),
        "separators",
    )
    return _stitched(found)


def _stitched(found: DataFrame) -> DataFrame:
    """Documents from the separators of blocks: ``(path, block, n_tokens, ends)``."""
    earlier = (
        Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = found.select(
        "path",
        "block",
        "n_tokens",
        F.size("ends").alias("n_ends"),
        F.array_max("ends").alias("last_end"),
    )
    before = totals.select(
        "path",
        "block",
        F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("end_before"),
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("n_before"),
    )
    documents = (
        found.join(before, ["path", "block"])
        .select(
            "path",
            "n_before",
            F.posexplode(
                F.transform(
                    F.col("ends"),
                    lambda end, i: F.struct(
                        end.alias("end"),
                        F.when(i == 0, F.col("end_before"))
                        .otherwise(F.get(F.col("ends"), i - 1))
                        .alias("before"),
                    ),
                )
            ).alias("k", "one"),
        )
        .select(
            "path",
            (F.col("n_before") + F.col("k")).alias("ordinal"),
            (F.col("one.before") + 1).alias("first_token"),
            (F.col("one.end") - F.col("one.before")).alias("n_tokens"),
            F.lit(True).alias("closed"),
        )
    )
    tails = (
        totals.groupBy("path")
        .agg(
            F.sum("n_ends").cast("long").alias("ordinal"),
            (F.coalesce(F.max("last_end"), F.lit(-1)) + 1).alias("first_token"),
            F.sum("n_tokens").alias("total"),
        )
        .where(F.col("first_token") < F.col("total"))
        .select(
            "path",
            "ordinal",
            "first_token",
            (F.col("total") - F.col("first_token")).alias("n_tokens"),
            F.lit(False).alias("closed"),
        )
    )
    return documents.unionByName(tails)


def count_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``(id, path, ordinal, first_token, n_tokens)`` of all documents, by way of flat files.

    Repeated rows are documents of their own, null ids stay null.
    """
    folder, order = write_token_files(docs, id_col, text_col, **options)
    counted = scan(docs.sparkSession, folder).where("closed")
    return order.join(counted, ["path", "ordinal"]).select(
        F.col("id").alias(id_col), "path", "ordinal", "first_token", "n_tokens"
    )
