"""Token counts of documents in flat token files that have no index.

A file is a run of token ids; an end-of-document id follows each document. Blocks of a file are searched
on their own, and what lies before a block's first and after its last separator is stitched together by
a prefix scan over the blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathomline.llm.storage import new_file, opened, reading_tasks, shared_folder
from fathomline.llm.words import slices
from fathomline.session import settle

# Bytes of a file that one search covers, and of one file.
BLOCK_BYTES, FILE_BYTES = 4 << 20, 1 << 30
# Ids are 16-bit, little-endian; the free id of the vocabulary ends a document.
DTYPE, SEPARATOR = "<u2", 50256
# Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_flat(docs: DataFrame, folder: str, ranks_path: str, *, separator: int = SEPARATOR, dtype: str = DTYPE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """path, ordinal and doc_id of every document written to flat files under ``folder``, with the file's bytes.

    A null or empty text is a document without tokens. The separator is never an id of a text. Each task
    writes its own files and begins another one after ``file_bytes``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _encoder(ranks_path), np.dtype(dtype)
        path, stream, size, ordinal = "", None, 0, 0
        for b in batches:
            for low, high in slices(b.column("text")):
                if stream is None or size >= file_bytes:
                    if stream:
                        stream.close()
                    path, stream = new_file(folder, ".tokens")
                    size = ordinal = 0
                part = b.slice(low, high - low)
                for text in part.column("text").to_pylist():
                    ids = encoder.encode_ordinary(text or "")
                    ids.append(separator)
                    size += stream.write(np.array(ids, kind).tobytes())
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), part.column("doc_id"), pa.array(np.full(n, size))],
                    names=["path", "ordinal", "doc_id", "upto"],
                )
                ordinal += n
        if stream:
            stream.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(rows.mapInArrow(run, "path string, ordinal long, doc_id long, upto long"))


def scan_blocks(files: DataFrame, *, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, block, n (ids of the block) and ends (places right behind its separators, from the block's start).

    ``files`` has path and bytes. Only the byte range of a block is read.
    """
    width = np.dtype(dtype).itemsize
    step = block_bytes // width * width
    blocks = files.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block")
    ).where("bytes > 0")
    # Each row stands for a block of bytes; the number of tasks is given, as sizes of rows would put all into one.
    blocks = blocks.repartition(reading_tasks(blocks), "path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, inner = opened(r["path"])
                start = r["block"] * step
                with system.open_input_file(inner) as file:
                    ids = np.frombuffer(file.read_at(min(step, r["bytes"] - start), start), dtype)
                ends = np.flatnonzero(ids == separator) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["path"]]), pa.array([r["block"]], pa.int64()), pa.array([len(ids)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int32())),
                    ],
                    names=["path", "block", "n", "ends"],
                )

    return blocks.mapInArrow(run, "path string, block long, n long, ends array<int>")


def count_tokens(files: DataFrame, *, separator: int = SEPARATOR, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, ordinal, start and n_tokens of every document of the files (start in ids from the file's beginning).

    Ids behind a file's last separator are one more document; a separator right behind another ends a document
    without tokens; an empty file has none. The scan over blocks carries three numbers a block: its ids, its
    separators, and where its last one ends.
    """
    found = settle(scan_blocks(files, separator=separator, dtype=dtype, block_bytes=block_bytes))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("path")
    slim = found.select("path", "block", "n", F.size("ends").alias("own"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    scanned = slim.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = scanned.select(
        "path", "block", "base", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(0)).alias("open"),
        F.max("block").over(every).alias("final"),
    )
    whole = found.join(carried, ["path", "block"]).select(
        "path", "ordinal",
        F.concat(F.array("open"), F.transform("ends", lambda e: e + F.col("base"))).alias("cuts"),
        F.when((F.col("block") == F.col("final")) & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) < F.col("n")), F.col("base") + F.col("n")).alias("rest"),
    )
    closed = whole.select("path", "ordinal", "cuts", F.posexplode(F.slice("cuts", F.lit(2), F.size("cuts"))).alias("k", "cut")).select(
        "path", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.get("cuts", F.col("k")).alias("start"),
        (F.col("cut") - 1 - F.get("cuts", F.col("k"))).alias("n_tokens"),
    )
    tail = whole.where("rest is not null").select(
        "path", (F.col("ordinal") + F.size("cuts") - 1).alias("ordinal"), F.element_at("cuts", -1).alias("start"),
        (F.col("rest") - F.element_at("cuts", -1)).alias("n_tokens"),
    )
    return closed.unionByName(tail)


def count_documents(spark: SparkSession, docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and n_tokens of every document, by writing all to flat files and scanning those for separators.

    Rows are counted one by one, so repeated rows stay; an empty table gives none; extra columns are ignored.
    """
    written = write_flat(docs, shared_folder(spark, "tokens"), ranks_path)
    files = written.groupBy("path").agg(F.max("upto").alias("bytes"))
    counted = count_tokens(files)
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
