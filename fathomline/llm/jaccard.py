"""Near-duplicate documents by an exact Jaccard join on word shingles with token-combination prefixes.

Equal sets are one class. The tokens of a class are ordered by how many classes hold them, rare first. A
class that is similar enough to another misses at most ``slack`` of its tokens there, so both share a
token among the first slack + 1, or, where frequent tokens are indexed only in pairs or triples, a
combination among the first slack + 1 + (what combining wastes). Single tokens are indexed where they are
rare, combinations where they are frequent; classes that meet are compared exactly.

Tokens that one class alone holds are dropped as soon as they are counted. To count fewer, the order
puts tokens of a fixed part of all hashes first and the others behind; the prefixes lie in that part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.storage import releasing
from fathomline.llm.words import BLOCK, NOT_SPACE, Words, prefix_hash, slices, windows
from fathomline.session import settle

SHINGLE, PERCENT = 4, 85
# Tokens in at least so many classes are indexed in pairs, and in triples.
PAIRS, TRIPLES = 256, 4096
# Rounds that compare the classes of a signature with one of them (the first by document, then by hash), before the rest is compared in pairs.
STARS = 1
# Classes of a signature from which on it is replaced by finer ones, before its classes are compared in pairs.
CROWDED = 32
# Signatures that a task holds before it hands them on.
HELD = 50_000
# Ids that may be sent to every task, to pick texts before a shuffle.
MOST_SENT = 1_000_000

_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to below ``high`` find their partners here: one of ``every`` tokens first, combinations up to ``most``."""

    number: int
    low: int
    high: int
    every: int
    most: int

    @property
    def waste(self) -> int:
        return self.most * (self.most - 1) // 2

    def takes(self, n: np.ndarray, percent: int) -> np.ndarray:
        return (n >= self.low) & (n * percent <= (self.high - 1) * 100)


# Larger sets have longer prefixes, so they get smaller combinations: a set has about a thousand signatures at most.
BANDS = (Band(0, 1, 64, 1, 3), Band(1, 64, 256, 4, 2), Band(2, 256, 1 << 40, 4, 1))


def slack(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar one may lack."""
    return n - -(-n * percent // 100)


def _keyed() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp")]


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the ordered distinct shingles of every text, and where each text's begin."""
    owner, texts = w.owner(), len(w)
    at = np.flatnonzero(owner[:len(owner) - size + 1] == owner[size - 1:]) if len(owner) >= size else np.zeros(0, np.int64)
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    values = np.concatenate([windows(w.hashes, size)[at], prefix_hash(w.hashes, w.first[short], w.first[short + 1], lane=2)])
    own = np.concatenate([owner[at], short])
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    values, own = values[new], own[new]
    return values, np.searchsorted(own, np.arange(texts + 1))


def _sets(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: rows from, to; hashes and first of their sets; two hashes of each set."""
    texts = b.column("text")
    for low, high in slices(texts, BLOCK):
        values, first = shingle_sets(Words(texts.slice(low, high - low), NOT_SPACE, lower=True), size)
        yield low, high, values, first, prefix_hash(values, first[:-1], first[1:]), prefix_hash(values, first[:-1], first[1:], lane=1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scan_members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, doc, fp, n and the two hashes of the shingle set of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, _, first, one, two in _sets(b, size):
                part = b.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "doc", "fp")), pa.array(np.diff(first)), _signed(one), _signed(two)],
                    names=["doc_id", "doc", "fp", "n", "one", "two"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed(), "text")
    return rows.mapInArrow(releasing(run), "doc_id long, doc long, fp long, n long, one long, two long")


def _scan_tokens(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """band, token, c, n and m of the tokens that may be in a prefix; m counts those of the first part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, values, first, one, _ in _sets(b, size):
                n = np.diff(first)
                for band in BANDS:
                    taken = band.takes(n, percent) & (100 * n >= percent * (n + 1))
                    if not taken.any():
                        continue
                    own = np.repeat(np.arange(len(n)), n)
                    part = values % np.uint64(band.every) == 0
                    m = np.bincount(own[part], minlength=len(n))
                    needed = n + band.waste + 1 + (-n * percent // 100) - m  # behind the first part
                    rest = np.flatnonzero(~part)
                    owner = own[rest]
                    rank = np.arange(len(rest)) - np.searchsorted(owner, np.arange(len(n)))[owner]
                    part[rest[rank < needed[owner]]] = True
                    at = np.flatnonzero(part & taken[own])
                    owner = own[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), band.number, np.int8)), _signed(values[at]), _signed(one[owner]),
                            pa.array(n[owner].astype(np.int32)), pa.array(m[owner].astype(np.int32)),
                        ],
                        names=["band", "token", "c", "n", "m"],
                    )

    return texts.select("text").mapInArrow(releasing(run), "band byte, token long, c long, n int, m int")


def prefix_signatures(
    band: Band, n: int, m: int, tokens: np.ndarray, times: np.ndarray, percent: int
) -> tuple[list[int], list[int], list[int | None]]:
    """(signatures, places, signatures before) of one class from its tokens that other classes hold too.

    A place is a lower bound for the number of the class's tokens that come before the signature's in the
    common order, less what combining wastes. Before a signature comes another of its kind, at a place no greater.
    """
    first = tokens % np.uint64(band.every) == 0
    order = np.lexsort((tokens, times, ~first))
    tokens, times, first = tokens[order], times[order], first[order]
    alone = m - int(first.sum())
    missing = slack(n, percent) + 1 - alone
    if missing <= 0:
        return [], [], []
    kinds = np.where(~first | (times < PAIRS), 1, np.where(times < TRIPLES, 2, 3)).clip(max=band.most)
    # Tokens of the first part that only meet in combinations may be common without being met there.
    places = np.where(first, alone + np.arange(len(tokens)), np.maximum(0, m + np.arange(len(tokens)) - int(first.sum()) - band.waste))
    found: dict[int, list[tuple[int, int]]] = {1: [], 2: [], 3: []}
    for token, kind, place, is_first in zip(tokens.tolist(), kinds.tolist(), places.tolist(), first.tolist()):
        if missing <= 0:
            break
        found[kind].append((token, place))
        if len(found[kind]) >= kind and is_first:  # how many of those behind the first part were dropped is not known
            missing -= 1
    sigs, at, before = [], [], []
    for kind, own in found.items():
        last = None
        for group in combinations(own, kind):
            before.append(last)
            last = hash((band.number, kind, *sorted(t for t, _ in group)))
            sigs.append(last)
            at.append(max(0, group[0][1] - (band.waste if kind > 1 else 0)))
    return sigs, at, before


def _signatures(tokens: DataFrame, percent: int, bands: tuple[Band, ...] = BANDS, chained: bool = False) -> DataFrame:
    """sig, c, n and place of the classes, from the tokens that at least two of them hold; where ``chained`` also the signature before."""
    shared = settle(tokens.groupBy("band", "token").agg(F.count("*").cast("int").alias("times")).where("times > 1"))
    held = F.collect_list(F.struct("times", "token")).alias("held")
    grouped = tokens.join(shared, ["band", "token"]).groupBy("c", "band", "n", "m").agg(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("held")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            flat = lists.flatten()
            times, tokens = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(np.uint64)
            sigs, owner, places, earlier, low = [], [], [], [], 0
            keys = [b.column(c).to_pylist() for c in ("band", "n", "m")]
            for k, (band, n, m, high) in enumerate(zip(*keys, ends.tolist())):
                own, at, before = prefix_signatures(bands[band], n, m, tokens[low:high], times[low:high], percent)
                sigs += own
                places += at
                earlier += before
                owner += [k] * len(own)
                low = high
                if len(sigs) >= HELD:
                    yield told(b, sigs, owner, places, earlier)
                    sigs, owner, places, earlier = [], [], [], []
            yield told(b, sigs, owner, places, earlier)

    def told(b: pa.RecordBatch, sigs: list, owner: list, places: list, earlier: list) -> pa.RecordBatch:
        owner = pa.array(owner, pa.int64())
        columns = [pa.array(sigs, pa.int64()), b.column("c").take(owner), b.column("n").take(owner), pa.array(places, pa.int32())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(earlier, pa.int64())] * chained, names=["sig", "c", "n", "place"] + ["before"] * chained)

    return settle(grouped.mapInArrow(releasing(run), "sig long, c long, n int, place int" + ", before long" * chained))


def _finer_signatures(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Signatures of some classes (c, n) from all their tokens, counted among these classes alone.

    Similar classes among them still share one. Tokens that none of the others holds come first now, whichever
    part of the hashes they lie in, so a class with too many of its own has no signature left.
    """
    bands = tuple(replace(b, every=1) for b in BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy().astype(np.int64)
            values = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in b.column("held")), np.int64)
            own = np.repeat(np.arange(len(n)), n)
            c = b.column("c").to_numpy()
            for band in bands:
                at = np.flatnonzero(band.takes(n, percent)[own])
                owner = own[at]
                size = pa.array(n[owner].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), band.number, np.int8)), pa.array(values[at]), pa.array(c[owner]), size, size],
                    names=["band", "token", "c", "n", "m"],
                )

    tokens = classes.join(sets, "c").select("c", "n", "held").mapInArrow(releasing(run), "band byte, token long, c long, n int, m int")
    return _signatures(tokens, percent, bands, chained=True)


def components(links: DataFrame) -> DataFrame:
    """c and label (the least c that links lead to) of every linked class, by alternating large and small stars.

    Every round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("label"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def _close(left_n: str, right_n: str, left_place: str, right_place: str, percent: int) -> Column:
    """Whether sizes and places leave room for enough common tokens."""
    both = f"ceil({percent} * ({left_n} + {right_n}) / {100 + percent})"
    return F.expr(f"{left_n} - {left_place} >= {both} and {right_n} - {right_place} >= {both}")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("left_set"), b.column("right_set")):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(two, one)
                common = int((two[np.minimum(at, len(two) - 1)] == one).sum())
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("held").alias("left_set")), "a")
    joined = joined.join(sets.select(F.col("c").alias("b"), F.col("held").alias("right_set")), "b")
    return settle(joined.select("a", "b", "left_set", "right_set").mapInArrow(releasing(run), "a long, b long"))


def _pick(texts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Texts whose (doc, fp) is (left_semi) or is not (left_anti) among the keys; few keys are sent to the tasks."""
    keys = settle(keys.select("doc", "fp").distinct())
    return texts.join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, ["doc", "fp"], how)


def _class_texts(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """doc, fp and text of one document of each class."""
    texts = docs.select(*_keyed(), "text").where("text is not null")
    own = members.where("n > 0").join(classes.select("one", "two", "rep"), ["one", "two"])
    texts = _pick(texts, own.where("doc <> rep.doc or fp <> rep.fp"), "left_anti")
    again = settle(members.groupBy("doc", "fp").count().where("count > 1"))
    if again.isEmpty():
        return texts
    return _pick(texts, again, "left_anti").unionByName(_pick(texts, again, "left_semi").dropDuplicates(["doc", "fp"]))


def _class_sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, values, first, one, _ in _sets(b, size):
                held = pa.array([values[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(one), held], names=["c", "held"])

    return texts.select("text").mapInArrow(releasing(run), "c long, held binary")


def link_classes(docs: DataFrame, members: DataFrame, classes: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that connect all classes that similarity connects.

    First the classes of a signature are compared with one of them, the first by document (by hash in
    any further round). Classes that those links do not connect are then compared in pairs; where many share a
    signature, finer signatures of these classes take its place first. Pairs within a connected group add
    nothing and are left out.
    """
    texts = _class_texts(docs, members, classes)
    sigs = _signatures(_scan_tokens(texts, size, percent), percent)
    busy = settle(sigs.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig"))
    posted = settle(
        sigs.join(busy, "sig").join(classes.select(F.col("one").alias("c"), F.col("rep.doc").alias("doc")), "c").select("sig", "c", "n", "place", "doc")
    )
    active = classes.join(posted.select(F.col("c").alias("one")).distinct(), "one", "left_semi").select("rep.doc", "rep.fp")
    sets = settle(_class_sets(_pick(texts, active, "left_semi"), size))
    links = None
    for turn in range(STARS + 1):
        own = posted.withColumn("label", F.col("c"))
        if links is not None:
            own = posted.join(components(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
        if turn < STARS:
            key = F.col("doc") if turn == 0 else F.xxhash64("sig", "c")
            tops = own.groupBy("sig").agg(
                F.min(F.struct(key.alias("key"), "c", "n", "place", "label")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high")
            ).where("low <> high").select("sig", "top")
            met = own.join(tops, "sig").where("label <> top.label")
            pairs = met.where(_close("n", "top.n", "place", "top.place", percent)).select(
                F.least("c", "top.c").alias("a"), F.greatest("c", "top.c").alias("b")
            )
        else:
            mixed = own.groupBy("sig").agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("crowd")
            ).where("low <> high").select("sig", "crowd")
            left = settle(own.join(mixed, "sig").select("sig", "c", "n", "place", "label", "crowd"))
            crowded = settle(left.where(F.col("crowd") >= CROWDED).select("c", "n", "label").distinct())
            finer = _finer_signatures(crowded.select("c", "n"), sets, percent).join(crowded.select("c", "label"), "c")
            # Two crowded classes that are similar share a finer signature, so they need not meet elsewhere.
            flags = crowded.select("c", F.lit(True).alias("settled"))
            others = left.where(F.col("crowd") < CROWDED).drop("crowd").join(flags, "c", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
            left = settle(others.withColumn("before", F.lit(None).cast("long")).unionByName(finer.withColumn("settled", F.lit(False))))
            right = left.select("sig", *(F.col(x).alias(f"other_{x}") for x in ("c", "n", "place", "label", "settled", "before")))
            # Classes with the same signature before this one have met there, at places no greater.
            new = "not (settled and other_settled) and coalesce(before <> other_before, true)"
            pairs = left.join(right, "sig").where(f"c < other_c and label <> other_label and {new}").where(
                _close("n", "other_n", "place", "other_place", percent)
            ).select(F.col("c").alias("a"), F.col("other_c").alias("b"))
        found = _verified(pairs.distinct(), sets, percent)
        links = found if links is None else links.unionByName(found)
    return links


def group_members(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, doc, fp, n and g of every document; g is the same for documents that links connect, null without words."""
    members = settle(scan_members(docs, size))
    classes = settle(members.where("n > 0").groupBy("one", "two").agg(F.min(F.struct("doc", "fp")).alias("rep")))
    labels = components(link_classes(docs, members, classes, size, percent))
    joined = members.join(labels.withColumnRenamed("c", "one"), "one", "left")
    return joined.select("doc_id", "doc", "fp", "n", F.when(F.col("n") > 0, F.coalesce("label", "one")).alias("g"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to, itself included).

    A document without words has an empty set and links with nothing. Repeated rows are documents of their own
    with the same set, so they share a component; documents without an id count as members but never
    name a component, unless no member has an id: then it is null. An empty table gives none; extra
    columns are ignored.
    """
    own = settle(group_members(docs, size, percent))
    least = own.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("least"))
    found = own.join(least, "g", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, in its own columns: that with the least doc_id (of equals the least text hash).

    Documents without words all stay.
    """
    own = settle(group_members(docs, size, percent))
    firsts = own.where("g is not null").groupBy("g").agg(F.min(F.struct("doc", "fp")).alias("first"))
    gone = own.join(firsts, "g").where("doc <> first.doc or fp <> first.fp")
    again = settle(own.where("g is not null").groupBy("doc", "fp").count().where("count > 1"))
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"), *_keyed())
    kept = _pick(keyed, gone, "left_anti")
    if not again.isEmpty():
        kept = _pick(kept, again, "left_anti").unionByName(_pick(kept, again, "left_semi").dropDuplicates(["doc", "fp"]))
    return kept.select("own.*")
