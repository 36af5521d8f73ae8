"""Quality classifier (operator 11): a network over bytes (`convolution`) scores every whole text.

The network is learned from a sample of the labelled documents: of `most_documents` ids, those of the smallest hashes,
`most_chunks` chunks at most, chosen by a hash of the id as well, so the sample is bounded and always the same. One task
fits the network to it; the network, some 30 kB, is all that is sent to the executors, which score all chunks of every
text.

Defined results: a null text is empty, and an empty text has the score of an empty text; labels without an id or a value
are left out, and so are ids with both labels; of documents that share a sampled id the one of the smallest chunks in
order of bytes counts; a null id counts as an empty one for the split; every row is scored by itself, so repeated rows
and equal ids need no care; without a label to learn from every score is 0.5; other columns are not read, so their names
do not matter. The chunks of a very long text go through the filters in bounded parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm import convolution
from sedge.llm.common import ship

#: Texts and bytes that a task holds at once, but for single longer texts.
MOST_TEXTS, MOST_BYTES = 512, 1 << 21


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by their ids alone."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = sizes[a - 1] if a else 0
            b = min(a + MOST_TEXTS, max(a + 1, int(np.searchsorted(sizes, before + MOST_BYTES, side="right"))))
            yield batch.slice(a, b - a)
            a = b


def train(
    documents: DataFrame, labels: DataFrame, most_documents: int = 4096, most_chunks: int = 8, steps: int = 1000
) -> convolution.Network | None:
    """documents: doc_id and text; labels: doc_id and label, 0 or 1. None: there is nothing to learn from."""
    own = labels.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int")).dropna()
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    own = own.where(F.col("label") == F.col("most")).drop("most")
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, 1):
            found = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or b""
                starts = convolution.chunk_starts(len(text))
                if len(starts) > most_chunks:
                    starts = np.random.default_rng(abs(i)).choice(starts, most_chunks, replace=False)
                found.append(b"".join(text[a : a + convolution.CHUNK] for a in starts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "cut"]
            )

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        held = [convolution.symbols_of(x).reshape(-1, convolution.CHUNK) for x in table["cut"].to_pylist()]
        net = convolution.fit(held, table["label"].to_numpy().astype(np.float32), steps)
        return pa.table({"net": pa.array([pickle.dumps(net)], pa.binary())})

    ship(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text"))
    found = (
        texts.join(F.broadcast(sample), "doc_id")  # most_documents rows at most
        .mapInArrow(cut, "doc_id bigint, label int, cut binary")
        .groupBy("doc_id", "label")
        .agg(F.min("cut").alias("cut"))
        .withColumn("all", F.lit(0))
        .groupBy("all")
        .applyInArrow(fit, "net binary")
        .first()
    )
    return pickle.loads(found.net) if found else None


def score(documents: DataFrame, net: convolution.Network | None) -> DataFrame:
    """doc_id and score of every row: the probability that its label is 1."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    held = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, 1):
            scores = held.value.score([t or b"" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    ship(documents.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, score double")
