"""Token ids in ORC: run-length encoded stripes, row indexes, Bloom filters on documents.

One ORC row is one document: its ids, their number, and where they begin within the
block (the task that wrote them). Documents ascend by id over all files. Readers split
files by stripe; a filter on ``doc_id`` skips files and stripes by statistics and row
groups by index and Bloom filter.

* Null text: only the end id. Empty text likewise. Very long texts: one row each.
* Repeated documents ids: all rows stay; equal ids are ordered by their text's hash.
* Empty table: no rows. Columns other than ``doc_id`` and ``text`` are ignored.
* Null document id: sorted before all others.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm.common import block_offsets, text_or_empty, within_arrow
from placebook.llm.tokens import default_tokenizer, encoder
from placebook.session import fresh_path

END_ID = 0
BATCH_BYTES = 2_000_000
WRITE_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, block int, local_start long, n_tokens long, ids array<int>"


def id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow lists of 32-bit integers, so many of the ids in each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.view("<i4")))


def crc32(lists: pa.Array) -> pa.Array:
    data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
    ends = (4 * lists.offsets.to_numpy()).tolist()
    return pa.array([zlib.crc32(data[i:j]) for i, j in itertools.pairwise(ends)], pa.int64())


def crc32_of(column: str) -> Column:
    """Unsigned CRC32 of an id list as little-endian 32-bit integers."""
    return F.arrow_udf(crc32, "long")(F.col(column))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document in the order and partitions they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, start = encoder(tokenizer).encode_all, TaskContext.get().partitionId(), 0

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal start
            ids, sizes = encode(batch.column("text"), end_id)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            columns = [batch.column("doc_id"), pa.array(np.full(len(sizes), block, np.int32)), pa.array(starts), pa.array(sizes), id_lists(ids, sizes)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "block", "local_start", "n_tokens", "ids"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode whole texts and write them, ascending by document id, to ``path``.

    The texts are ranged and sorted before encoding, so each is encoded once.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    encode_documents(ranged, tokenizer or default_tokenizer(), end_id).write.options(**WRITE_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` and column choice reach the files."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: where each document begins in the whole corpus."""
    rows = read_tokens(spark, path)
    totals = rows.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    offsets = block_offsets(totals, "block", "total", "block_start")
    return rows.join(F.broadcast(offsets), "block").select(
        "doc_id", (F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def stored_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the corpus, read it back, and describe each document by its stored ids."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_index(docs.sparkSession, path).select("doc_id", "start", "n_tokens", crc32_of("ids").alias("ids_crc32"))
