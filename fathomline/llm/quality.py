"""Quality rules: counts of words, symbols and repetitions, and a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into a fixed number of buckets. Their counts over trusted documents and
over the whole corpus are two multinomials. A document's score is the mean of log p(trusted)/p(corpus)
over its n-grams, in millionths and whole numbers, so that every run decides alike.

A few bad words hardly move a mean, so every whole text is also judged by its worst window of a few words,
with weights that contrast trusted documents with those that a label calls bad or toxic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.columns import disguised, schema_of, undisguised
from fathomline.llm.storage import releasing
from fathomline.llm.words import BLOCK, LETTERS, NOT_SPACE, Words, byte_class, mix, slices, windows

BUCKETS = 1 << 14
# Trusted documents that the target multinomial is fitted on, at most.
TRUSTED = 20_000
# Share of the trusted documents that the threshold lets pass when they are scored without themselves.
PASSING = 0.999
MICRO = 1_000_000
# Contrast of labelled documents: buckets of lower-cased words, words in a window, smoothing in documents.
CONTRAST_BUCKETS, WINDOW, PRIOR = 1 << 20, 2, 5.0

# The symbols counted, and the bounds of the basic rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = byte_class(lambda b: chr(b) in SYMBOLS)
_NOT_LINE_END = byte_class(lambda b: b != 0x0A)
_BEGINS = byte_class(lambda b: b & 0xC0 != 0x80)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    places = np.flatnonzero(flags)
    return np.diff(np.searchsorted(places, offsets))


def base_counts(column: pa.Array, w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    texts = len(w)
    n_words = np.diff(w.first)
    starts_char = _BEGINS[w.data]
    chars = np.searchsorted(at := np.flatnonzero(starts_char), w.ends) - np.searchsorted(at, w.starts)
    word_chars = np.bincount(w.owner(), weights=chars, minlength=texts).astype(np.int64)

    lines = Words(column, _NOT_LINE_END)
    worded = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    owner = lines.owner()[worded]
    keys = np.unique(mix(lines.hashes[worded] ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    dup_lines = np.bincount(owner, minlength=texts) - np.bincount(owner[keys], minlength=texts)

    repeated = np.zeros(len(w.hashes), bool)
    if len(w.hashes) >= 3:
        owner = w.owner()
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        keys = mix(windows(w.hashes, 3)[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1)))
        _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = whole[times[back] >= 2]
        for k in range(3):
            repeated[again + k] = True
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": np.diff(np.searchsorted(np.flatnonzero(repeated), w.first)),
    }


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word: the first 8 bytes of its MD5, little-endian."""
    _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    md5 = hashlib.md5
    raw = w.data.tobytes()
    numbers = b"".join(md5(raw[s:e]).digest()[:8] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist()))
    return np.frombuffer(numbers, "<u8")[back]


def gram_buckets(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word pair."""
    owner, numbers = w.owner(), word_numbers(w) % np.uint64(1 << 31) if len(w.hashes) else np.zeros(0, np.uint64)
    same = owner[1:] == owner[:-1]
    pairs = (numbers[:-1] * np.uint64(31) + numbers[1:])[same] + np.uint64(1)
    both = np.concatenate([numbers, pairs]) % np.uint64(buckets)
    return np.concatenate([owner, owner[:-1][same]]), both.astype(np.int64)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> list[int]:
    """Documents that every label calls good and none toxic; of too many those with the least MD5 of the id."""
    rows = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("worst"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("worst = 1 and toxic = 0").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    )
    return [r["doc_id"] for r in rows.select("doc_id").collect()]


def rejected_ids(labels: DataFrame, most: int = TRUSTED) -> list[int]:
    """Documents that some label calls bad or toxic; of too many those with the least MD5 of the id."""
    rows = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("worst"), F.max("toxic").alias("toxic"))
        .where("worst = 0 or toxic = 1").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    )
    return [r["doc_id"] for r in rows.select("doc_id").collect()]


def count_grams(docs: DataFrame, trusted: list[int], buckets: int = BUCKETS) -> DataFrame:
    """bucket, counts over all documents (corpus) and over either half of the trusted ones (even, odd).

    A task adds up all its documents and sends each bucket once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(np.array(trusted[k::2], np.int64) for k in range(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, buckets), np.int64)
        for b in batches:
            ids, texts = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("text")
            there = ~np.asarray(b.column("doc_id").is_null())
            halves = [np.isin(ids, half) & there for half in sent.value]
            for low, high in slices(texts, BLOCK):
                owner, bucket = gram_buckets(Words(texts.slice(low, high - low)), buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                for k, half in enumerate(halves):
                    total[k + 1] += np.bincount(bucket[half[low:high][owner]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), *(pa.array(x[some]) for x in total)], names=["bucket", "corpus", "even", "odd"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "bucket int, corpus long, even long, odd long")
    return rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("corpus", "even", "odd")))


def log_ratio(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket in millionths; zeros where nothing is trusted. Counts are smoothed by one."""
    if not target.sum():
        return np.zeros(len(target), np.int64)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((corpus + 1) / (corpus.sum() + len(target)))
    return np.rint(ratio * MICRO).astype(np.int64)


def _labelled(docs: DataFrame, trusted: list[int], rejected: list[int]) -> DataFrame:
    """(part, text) of the labelled documents; parts 0 and 1 are the halves of the trusted, 2 and 3 of the rejected."""
    part = [2 * kind + k % 2 for kind, ids in enumerate((trusted, rejected)) for k in range(len(ids))]
    parts = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([*trusted, *rejected], pa.int64()), "part": pa.array(part, pa.int32())}))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(parts), "doc_id").select("part", "text")


def _letters(column: pa.Array, buckets: int) -> tuple[Words, np.ndarray]:
    """Lower-cased words of letters and digits, and the bucket of each."""
    w = Words(column, LETTERS, lower=True)
    return w, (w.hashes % np.uint64(buckets)).astype(np.int64)


def count_words(labelled: DataFrame, buckets: int) -> np.ndarray:
    """Rows of each part (in the last column) and those of them that hold a word of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, buckets + 1), np.int32)
        for b in batches:
            parts, texts = b.column("part").to_numpy(), b.column("text")
            for low, high in slices(texts, BLOCK):
                w, bucket = _letters(texts.slice(low, high - low), buckets)
                own = parts[low:high]
                once = np.unique(w.owner() * buckets + bucket)
                for k in range(4):
                    total[k, :buckets] += np.bincount(once[own[once // buckets] == k] % buckets, minlength=buckets).astype(np.int32)
                    total[k, buckets] += (own == k).sum()
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x[some]) for x in total)], names=["bucket", *"abcd"])

    rows = labelled.mapInArrow(releasing(run), "bucket int, a int, b int, c int, d int")
    # At most ``buckets`` + 1 rows.
    told = rows.groupBy("bucket").agg(*(F.sum(c).cast("int").alias(c) for c in "abcd")).toArrow()
    counts = np.zeros((4, buckets + 1), np.int64)
    for k, c in enumerate("abcd"):
        counts[k, told.column("bucket").to_numpy()] = told.column(c).to_numpy()
    return counts


def contrast(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratio, in millionths, of the shares of good and of bad documents that hold a word of each bucket."""
    n, m = good[-1], bad[-1]
    ratio = np.log(good[:-1] / n + PRIOR / (n + m)) - np.log(bad[:-1] / m + PRIOR / (n + m))
    return np.rint(ratio * MICRO).astype(np.int32)


def worst_windows(w: Words, values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Least sum over ``window`` words in a row of each text; of all words in shorter texts, 0 without words."""
    out = np.zeros(len(w), np.int64)
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    owner, start = w.owner(), np.arange(len(values))
    ends = w.first[owner + 1]
    use = (start + window <= ends) | (start == w.first[owner])
    start, owner = start[use], owner[use]
    if len(start):
        sums = total[np.minimum(start + window, ends[use])] - total[start]
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[begins]] = np.minimum.reduceat(sums, begins)
    return out


def fewest_wrong(good: dict[int, int], bad: dict[int, int], passing: float) -> int | None:
    """The least score to pass that misjudges the fewest documents, given as counts by score.

    Of the good ones the share ``passing`` must pass. None where no bound rejects more bad than good ones.
    """
    most = int((1 - passing) * sum(good.values()))
    lost = gained = best = 0
    bound = None
    for score in sorted(good.keys() | bad.keys()):
        lost += good.get(score, 0)
        gained += bad.get(score, 0)
        if lost > most:
            break
        if gained - lost > best:
            best, bound = gained - lost, score + 1
    return bound


def fit_contrast(docs: DataFrame, labels: DataFrame, *, trusted: int = TRUSTED, passing: float = PASSING, buckets: int = CONTRAST_BUCKETS) -> tuple[np.ndarray, int] | None:
    """(weights of lower-cased words, least sum of a window), both in millionths; None where labels tell nothing.

    The labelled documents of either kind are halved and each half is scored with the other half's weights;
    the bound is that of ``fewest_wrong``. At most ``trusted`` documents of a kind are used.
    """
    kinds = trusted_ids(labels, trusted), rejected_ids(labels, trusted)
    if not all(kinds):
        return None
    labelled = _labelled(docs, *kinds)
    counts = count_words(labelled, buckets)
    if not counts[:, -1].all():
        return None
    sent = docs.sparkSession.sparkContext.broadcast([contrast(counts[1 - k], counts[3 - k]) for k in range(2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, texts = b.column("part").to_numpy(), b.column("text")
            for low, high in slices(texts, BLOCK):
                part, own = texts.slice(low, high - low), parts[low:high]
                plain = Words(part, NOT_SPACE)
                passed = ~_base_failed(base_counts(part, plain))
                w, bucket = _letters(part, buckets)
                worst = [worst_windows(w, x[bucket]) for x in sent.value]
                score = np.where(own % 2 == 0, worst[0], worst[1])
                yield pa.RecordBatch.from_arrays([pa.array(own[passed] // 2, pa.int32()), pa.array(score[passed])], names=["kind", "score"])

    found: tuple[dict, dict] = {}, {}
    for r in labelled.mapInArrow(releasing(run), "kind int, score long").groupBy("kind", "score").agg(F.count("*").alias("rows")).collect():
        found[r["kind"]][r["score"]] = r["rows"]
    bound = fewest_wrong(*found, passing)
    return None if bound is None else (contrast(counts[0] + counts[1], counts[2] + counts[3]), bound)


def _base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


RULES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio_sum long, n_grams long, worst long"
)


def _measure(docs: DataFrame, weights: np.ndarray, columns: tuple[str, ...], words: np.ndarray | None = None) -> DataFrame:
    """The given columns with the counts, base_failed, the ratios of all n-grams added up, and the worst window.

    ``words`` are the weights of the windows' words; without them the worst window is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    contrasted = words is not None and docs.sparkSession.sparkContext.broadcast(words)
    names = [*columns, *(x.split()[0] for x in RULES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(columns))
            for low, high in slices(texts, BLOCK):
                part = texts.slice(low, high - low)
                w = Words(part, NOT_SPACE)
                c = base_counts(part, w)
                owner, bucket = gram_buckets(w, len(sent.value))
                order = np.argsort(owner, kind="stable")
                total = np.concatenate(([0], np.cumsum(sent.value[bucket[order]])))
                grams = np.bincount(owner, minlength=len(w))
                ends = np.cumsum(grams)
                worst = np.zeros(len(w), np.int64)
                if contrasted:
                    letters, bucket = _letters(part, len(contrasted.value))
                    worst = worst_windows(letters, contrasted.value[bucket])
                found = [*c.values(), _base_failed(c), total[ends] - total[ends - grams], grams, worst]
                kept = [b.column(k).slice(low, high - low) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=names)

    return docs.select(*columns, F.col("text").alias("measured_text")).mapInArrow(releasing(run), schema_of(docs, columns, RULES))


def fit_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, trusted: int = TRUSTED, passing: float = PASSING) -> tuple[np.ndarray, int]:
    """(weights, least mean ratio), both in millionths.

    The trusted documents are halved; each half is scored with the other half's multinomial, as new documents
    would be, and the threshold is the score that the share ``passing`` of them reaches, zero at most.
    """
    ids = trusted_ids(labels, trusted)
    counts = np.zeros((3, buckets))
    for r in count_grams(docs, ids, buckets).collect():  # at most ``buckets`` rows
        counts[:, r["bucket"]] = r["corpus"], r["even"], r["odd"]
    weights = log_ratio(counts[1] + counts[2], counts[0])
    scores: list[int] = []
    for k in range(2):
        if ids[k::2] and counts[2 - k].sum():
            half = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids[k::2], pa.int64())}))
            own = docs.join(F.broadcast(half), "doc_id", "left_semi")  # at most ``trusted`` ids
            rows = _measure(own, log_ratio(counts[2 - k], counts[0]), ("doc_id",)).where("not base_failed")
            scores += [r["ratio_sum"] // r["n_grams"] for r in rows.select("ratio_sum", "n_grams").collect()]
    least = sorted(scores)[int((1 - passing) * len(scores))] if scores else 0
    return weights, min(0, least)


def _judged(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], options: dict) -> DataFrame:
    """The given columns with those of RULES and kept. ``docs`` has doc_id and text besides."""
    weights, least = fit_rules(docs, labels, **options)
    words, bound = fit_contrast(docs, labels, **{k: v for k, v in options.items() if k in ("trusted", "passing")}) or (None, 0)
    measured = _measure(docs, weights, columns, words)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("ratio_sum") >= least * F.col("n_grams")) & (F.col("worst") >= bound))


def score_quality(docs: DataFrame, labels: DataFrame, *, columns: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The given columns of every document with its counts, base_failed, kept, ratio_sum and n_grams.

    kept: the basic rules pass, the mean log ratio reaches the threshold of ``fit_rules``, whose options may
    be given, and the worst window reaches the bound of ``fit_contrast``. Corpus counts cover every document;
    target, contrast and both bounds are fitted on at most ``trusted`` labelled ones of a kind. A null text has no words and fails; rows are judged one by one, so repeated rows stay
    (each counts in the corpus); without trusted labels every document that passes the basic rules is
    kept; extra columns are ignored.
    """
    judged = _judged(docs, labels, columns, options)
    return judged.select(*columns, *(x.split()[0] for x in RULES.split(", ")[:6]), "kept", "ratio_sum", "n_grams")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, in their own columns."""
    own = disguised(docs, "doc_id", "text")
    judged = _judged(own, labels, tuple(own.columns[:-2]), options)
    return judged.where("kept").select(*undisguised(docs.columns))
