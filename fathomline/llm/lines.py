"""Lines that an earlier document already has, as compressed keep bitmaps of the documents that lose some.

Hashes of lines are laid out by range of (hash, document, position) and sorted so within each partition; one
stream over a partition sees the first document of every hash before the others. The partitions' bounds
cut a frequent line's rows like any others, so its rows are spread; what a partition can't know, the first
document of the hash it begins with, comes from two rows of every partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.columns import batch, disguised, undisguised
from fathomline.llm.words import slices
from fathomline.session import settle

# White space stripped at both ends, and the fewest code points of a line that counts.
SPACES = b" \t\n\x0b\x0c\r"
LEAST = 10
# Documents whose ids a task remembers, so that a row repeated within it is emitted once.
REMEMBERED = 200_000

KEYED = "h1 long, h2 long, doc long, row long, at int, of int"
MARKED = f"{KEYED}, kind int"
BITMAPS = "doc long, row long, n_lines long, n_dropped long, keep binary"
DROP, OPEN, FIRST = 0, 1, 2


def _identity() -> list[Column]:
    """What tells a row's text: its id, and a hash for rows that share the id."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row")]


def keyed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A 128-bit hash of every line of at least so many code points, with its document and place.

    Lines are compared stripped and with A-Z lower-cased. Rows without an id and equal rows within a task are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for low, high in slices(b.column("text")):
                part = b.slice(low, high - low)
                hashes, owner, places, of = [], [], [], []
                docs_of, rows_of = [], []
                for doc, row, text in zip(part.column("doc").to_pylist(), part.column("row").to_pylist(), part.column("text")):
                    if (doc, row) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((doc, row))
                    lines = text.as_buffer().to_pybytes().split(b"\n")
                    k = len(docs_of)
                    docs_of.append(doc)
                    rows_of.append(row)
                    of.append(len(lines))
                    for at, line in enumerate(lines):
                        key = line.strip(SPACES)
                        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                            hashes.append(xxhash.xxh3_128_digest(key.lower()))
                            owner.append(k)
                            places.append(at)
                if hashes:
                    lanes = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    owner = np.array(owner)
                    yield batch([
                        lanes[:, 0], lanes[:, 1], np.array(docs_of, np.int64)[owner], np.array(rows_of, np.int64)[owner],
                        np.array(places, np.int32), np.array(of, np.int32)[owner],
                    ], KEYED)

    return docs.select(*_identity(), "text").where("doc is not null and text is not null").mapInArrow(run, KEYED)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of one sorted partition: lines to drop, lines of its first hash (open), and the first documents of its two end hashes."""
    last = None  # the hash and first document that the previous row belongs to
    leading = True
    for b in batches:
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        h1, h2, doc = columns[:3]
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is None:
            yield batch([[h1[0]], [h2[0]], [doc[0]], [0], [0], [0], [FIRST]], MARKED)
        else:
            new[0] = (h1[0], h2[0]) != last[:2]
        begun = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        first = np.where(begun >= 0, doc[begun], last[2] if last else 0)
        cut = 0
        if leading:
            later = np.flatnonzero(new[1:] if last is None else new)
            cut = int(later[0]) + (last is None) if len(later) else len(doc)
            leading = not len(later)
        last = h1[-1], h2[-1], first[-1]
        found = doc != first
        found[:cut] = True
        at = np.flatnonzero(found)
        if len(at):
            yield batch([*(c[at] for c in columns), np.where(at < cut, OPEN, DROP)], MARKED)
    if last is not None:
        yield batch([[last[0]], [last[1]], [last[2]], [0], [0], [0], [FIRST]], MARKED)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, dropped = [], []
        for n, places in zip(b.column("n_lines").to_pylist(), b.column("places")):
            bits = np.ones(n, bool)
            bits[places.values.to_numpy(zero_copy_only=False)] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            dropped.append(len(places))
        yield batch([b.column("doc"), b.column("row"), b.column("n_lines"), dropped, keep], BITMAPS)


def kept_bits(keep: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as booleans, one for each line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Of every distinct (doc_id, text) that loses lines: doc, row (hash of the text), n_lines, n_dropped and keep.

    keep holds one bit for each line, packed and deflated (``kept_bits``); a document that is not listed keeps all
    its lines. A line goes where a document of smaller id has it; documents of one id never take lines from each
    other; those without an id neither lose nor take any, null and empty texts have no line that counts, repeated rows share
    one bitmap, an empty table gives none and extra columns are ignored.
    """
    keys = ["h1", "h2", "doc", "row", "at"]
    laid = keyed_lines(docs, least).repartitionByRange(*keys).sortWithinPartitions(*keys)
    marks = settle(laid.mapInArrow(_stream, MARKED))
    # Two rows of every partition at most.
    firsts = marks.where(F.col("kind") == FIRST).groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    opened = marks.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["h1", "h2"]).where("least < doc")
    found = ["doc", "row", "at", "of"]
    drops = marks.where(F.col("kind") == DROP).select(*found).unionByName(opened.select(*found))
    return (
        drops.groupBy("doc", "row").agg(F.max("of").cast("long").alias("n_lines"), F.collect_set("at").alias("places"))
        .mapInArrow(_bitmaps, BITMAPS)
    )


def _with_bitmaps(own: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    doc, row = _identity()
    found = settle(keep_bitmaps(docs, least)).select("doc", "row", "keep")
    return own.withColumns({"doc": doc, "row": row}).join(found, ["doc", "row"], "left").drop("doc", "row")


def _kept(text: pa.Scalar, keep: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, its number of lines, and how many of them went."""
    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
    n = raw.count(b"\n") + 1
    if keep is None:
        return raw, n, 0
    bits = kept_bits(keep, n)
    return b"\n".join(line for line, stays in zip(raw.split(b"\n"), bits) if stays), n, n - int(bits.sum())


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row, repeated ones included; see ``keep_bitmaps``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [], [], []
            for text, keep in zip(b.column("text"), b.column("keep").to_pylist()):
                left, n, gone = _kept(text, keep)
                for column, value in zip(out, (n, gone, hashlib.sha256(left).hexdigest())):
                    column.append(value)
            yield batch([b.column("doc_id"), *out], DIGEST)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_bitmaps(own, docs, least).select("doc_id", "text", "keep").mapInArrow(run, DIGEST)


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents, in their own columns, without the lines that an earlier one has; other texts, null too, stay as they are."""
    own = disguised(docs, "doc_id", "text")
    carried = [c for c in own.columns if c.startswith("own_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column("text"), b.column("keep").to_pylist()
            if any(keep):
                texts = pa.array([t.as_py() if k is None else _kept(t, k)[0].decode() for t, k in zip(texts, keep)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), texts], names=[*carried, "text"])

    done = _with_bitmaps(own, docs, least).select(*carried, "text", "keep").mapInArrow(run, own.drop("doc_id").schema)
    place = docs.columns.index("text")
    return done.select(*(c if k != place else F.col("text") for k, c in enumerate(undisguised(docs.columns))))
