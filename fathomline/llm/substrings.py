"""Removal of word windows that repeat across documents, by level-wise doubling.

Level one looks at windows of half the width, and of those only at anchors: in every full window the
half window with the least hash. Two equal full windows have equal anchors at equal places, so a full
window whose anchor is in one document alone repeats nowhere. The anchors that do repeat are extended to
twice the length. First all neighbouring full windows of one anchor are compared as a whole; where that
does not settle them, each is compared on its own. Nothing survives beyond the asked width.

Hashes of whole runs and of full windows have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.columns import disguised, undisguised
from fathomline.llm.storage import releasing
from fathomline.llm.words import BLOCK, NOT_SPACE, Words, prefix_hash, slices, windows
from fathomline.session import settle

WIDTH = 50
# Documents whose ids may be sent to every task, to pick their texts before a shuffle.
MOST_SENT = 1_000_000

_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> list[Column]:
    """doc orders the documents (without an id: after all others); fp tells rows of one id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp")]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first of equals) of each run of ``width`` values."""
    place = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = place[:len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def anchor_runs(w: Words, width: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring full windows with one anchor: text, first window, number of windows, anchor and run hash."""
    half = width // 2
    halves = windows(w.hashes, half)
    none = {k: np.zeros(0, np.int64) for k in ("text", "start", "count")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "run")}
    if len(w.hashes) < width:
        return none
    place = least_places(halves, width - half + 1)
    owner = w.owner()
    at = np.flatnonzero(owner[:len(owner) - width + 1] == owner[width - 1:])
    if not len(at):
        return none
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return {
        "text": owner[start], "start": start - w.first[owner[start]], "count": count, "anchor": halves[place[first]],
        "run": prefix_hash(w.hashes, start, start + count + width - 1, lane=1),
    }


def _scan_runs(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, fp = (b.column(c).to_numpy() for c in ("doc", "fp"))
            texts = b.column("text")
            for low, high in slices(texts, BLOCK):
                r = anchor_runs(Words(texts.slice(low, high - low), NOT_SPACE), width)
                own = r["text"] + low
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["anchor"].view(np.int64)), pa.array(r["run"].view(np.int64)), pa.array(doc[own]), pa.array(fp[own]),
                        pa.array(r["start"].astype(np.int32)), pa.array(r["count"].astype(np.int32)),
                    ],
                    names=["anchor", "run", "doc", "fp", "start", "count"],
                )

    texts = docs.select(*_keyed(docs), "text").where("text is not null")
    return texts.mapInArrow(releasing(run), "anchor long, run long, doc long, fp long, start int, count int")


def _scan_windows(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Every full window of the asked runs: two hashes, document and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, fp = (b.column(c).to_numpy() for c in ("doc", "fp"))
            texts, runs = b.column("text"), b.column("runs")
            for low, high in slices(texts, BLOCK):
                w = Words(texts.slice(low, high - low), NOT_SPACE)
                part = runs.slice(low, high - low)
                sizes = part.value_lengths().to_numpy()
                own = np.repeat(np.arange(len(w)), sizes)
                flat = part.flatten()
                start, count = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
                at = np.repeat(start + w.first[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text = np.repeat(own, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix_hash(w.hashes, at, at + width).view(np.int64)), pa.array(prefix_hash(w.hashes, at, at + width, lane=1).view(np.int64)),
                        pa.array(doc[text + low]), pa.array(fp[text + low]), pa.array((at - w.first[text]).astype(np.int32)),
                    ],
                    names=["one", "two", "doc", "fp", "start"],
                )

    keys = ["doc", "fp"]
    texts = docs.select(*_keyed(docs), "text").where("text is not null")
    ids = asked.select(*keys)
    if ids.count() <= MOST_SENT:
        texts = texts.join(F.broadcast(ids), keys, "left_semi")
    # Equal rows have equal windows; one of them is enough.
    texts = texts.join(asked, keys)
    return texts.mapInArrow(releasing(run), "one long, two long, doc long, fp long, start int")


def find_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, fp and spans (word places) covered by windows that also start in a document with a smaller id.

    Each table that a later step reads more than once is written to the shared folder, so that joins
    meet plain shuffles, which adaptive execution splits where a key is hot.
    """
    runs = _scan_runs(docs, width)
    # Anchors in one document alone die here.
    shared = settle(
        runs.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("anchor", "low")
    )
    alive = settle(runs.join(shared, "anchor").drop("low"))
    equal = alive.groupBy("anchor", "run").agg(F.min("doc").alias("least"))
    several = equal.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("several"))
    told = settle(equal.join(several, "anchor", "left"))
    judged = settle(
        alive.join(told, ["anchor", "run"]).where("least < doc or several")
        .select("doc", "fp", "start", "count", (F.col("least") < F.col("doc")).alias("whole"))
    )
    # Of equal runs the one in the first document answers for all; it also asks for itself.
    asked = settle(
        judged.where("not whole").groupBy("doc", "fp").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    )
    each = settle(_scan_windows(docs, asked, width))
    first = settle(
        each.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").drop("high")
    )
    single = each.join(first, ["one", "two"]).where("low < doc").select("doc", "fp", "start", F.lit(1).alias("count"))
    whole = judged.where("whole").select("doc", "fp", "start", "count").unionByName(single)
    return whole.groupBy("doc", "fp").agg(
        F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("count") + width - 1).alias("end"))).alias("spans")
    )


def joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _with_spans(docs: DataFrame, own: DataFrame, width: int) -> DataFrame:
    keys = ["doc", "fp"]
    return own.withColumns(dict(zip(keys, _keyed(docs)))).join(settle(find_repeats(docs, width)), keys, "left").drop(*keys)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removal_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of every document.

    Of equal ids neither is smaller, so rows of one id never remove each other's words; a missing id comes after
    all others; a null text has no words; repeated rows stay, each with its own answer; an empty table
    gives none; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                out: list[list] = [[], [], []]
                for text, spans in zip(part.column("text"), part.column("spans").to_pylist()):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    kept, last, gone = [], 0, 0
                    for low, high in joined(spans):
                        kept += words[last:low]
                        last, gone = high, gone + high - low
                    kept += words[last:]
                    for column, value in zip(out, (len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                    names=[x.split()[0] for x in DIGEST.split(", ")],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(docs, own, width).select("doc_id", "text", "spans").mapInArrow(releasing(run), DIGEST)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents, in their own columns, without the repeated words and the white space behind them."""
    own = disguised(docs, "doc_id", "text")
    carried = [c for c in own.columns if c.startswith("own_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = b.column("spans").to_pylist(), b.column("text")
            if any(spans):
                new = texts.to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        w = Words(texts.slice(i, 1), NOT_SPACE)
                        raw, last, parts = new[i].encode(), 0, []
                        for low, high in joined(found):
                            parts.append(raw[last:w.starts[low]])
                            last = w.starts[high] if high < len(w.starts) else len(raw)
                        new[i] = b"".join([*parts, raw[last:]]).decode()
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), texts], names=[*carried, "text"])

    out = own.drop("doc_id")
    done = _with_spans(docs, own, width).select(*carried, "text", "spans").mapInArrow(releasing(run), out.schema)
    place = docs.columns.index("text")
    return done.select(*(c if k != place else F.col("text") for k, c in enumerate(undisguised(docs.columns))))
