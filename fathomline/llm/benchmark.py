"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of words of every item. Streaming a document through it gives, at each
word, the longest run ending there that some item contains. Stretches in which no two neighbouring words
follow each other in any item reset the automaton, so only the other stretches are walked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.columns import disguised, schema_of, undisguised
from fathomline.llm.storage import releasing
from fathomline.llm.words import BLOCK, LETTERS, Words, slices
from fathomline.session import settle

# Words of items in one automaton; more items make more automata, each with its own pass.
BLOCK_WORDS = 1_000_000
WINDOW = 10


class Automaton:
    """Suffix automaton over word numbers, with the items whose windows each state stands for."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.owners: list[set[str]] = [set() for _ in self.next]
        self.whole: dict[int, list[tuple[int, str]]] = {}  # state -> (length, item) of items under a window
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                up = state
                while up > 0 and self.length[up] >= window and name not in self.owners[up]:
                    self.owners[up].add(name)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.whole.setdefault(state, []).append((len(words), name))
        self._chains: dict[int, list[tuple[int, str]]] = {}
        self._bases: dict[int, int] = {}

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int) -> int:
        """State for the longest run of ``at`` followed by the word, cloned where it must be."""
        q = self.next[at][word]
        if self.length[q] == self.length[at] + 1:
            return q
        clone = self._new(self.length[at] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while at >= 0 and self.next[at].get(word) == q:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word)
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        after = self.next[state].get(word)
        return (0, 0) if after is None else (after, length + 1)

    def found(self, state: int) -> set[str]:
        """Items that hold the last ``window`` words of a match at this state."""
        base = self._bases.get(state)
        if base is None:
            base = state
            while self.length[self.link[base]] >= self.window:
                base = self.link[base]
            self._bases[state] = base
        return self.owners[base]

    def endings(self, state: int) -> list[tuple[int, str]]:
        """Short items that a match at this state may end with: (length, item)."""
        chain = self._chains.get(state)
        if chain is None:
            chain, up = [], state
            while up > 0:
                chain += self.whole.get(up, [])
                up = self.link[up]
            self._chains[state] = chain
        return chain


class Matcher:
    """Word vocabulary, neighbour pairs and automaton of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        w = Words(pa.array([t for _, t in items], pa.string()), LETTERS, lower=True)
        self.known, codes = np.unique(w.hashes, return_inverse=True)
        own = [codes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        size = len(self.known)
        pairs = [x[:-1].astype(np.int64) * size + x[1:] for x in own]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.window = window
        self.shortest = min((min(len(x), window) for x in own if len(x)), default=0)
        self.automaton = Automaton([(n, x.tolist()) for (n, _), x in zip(items, own)], window)
        self.first_bits = np.zeros(1 << 16, bool)
        self.first_bits[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.first_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.known, hashes[maybe])
        at[at == len(self.known)] = 0
        right = self.known[at] == hashes[maybe]
        out[maybe[right]] = at[right]
        return out

    def matches(self, w: Words, wholes: dict[int, list[tuple[int, int]]] | None = None) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(text, hit spans of its words, items) of the texts with a hit.

        ``wholes``, where given, receives the spans of whole items under a window by text.
        """
        if not self.shortest or not len(w.hashes):
            return
        codes = self.codes(w.hashes)
        joined = np.zeros(len(codes), bool)  # this word and the next follow each other in some item
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        if len(both) and len(self.pairs):
            pair = codes[both] * len(self.known) + codes[both + 1]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined[both] = self.pairs[at] == pair
        firsts = w.first[1:-1]
        joined[firsts[firsts > 0] - 1] = False
        alone = codes >= 0
        begins = np.flatnonzero(alone & ~np.concatenate(([False], joined[:-1])))
        ends = np.flatnonzero(alone & ~joined) + 1
        long_enough = ends - begins >= self.shortest
        begins, ends = begins[long_enough], ends[long_enough]
        texts = np.searchsorted(w.first, begins, "right") - 1
        current, spans, items = -1, [], set()
        for text, low, high in zip(texts.tolist(), begins.tolist(), ends.tolist()):
            if text != current:
                if spans:
                    yield current, spans, items
                current, spans, items = text, [], set()
            whole = None if wholes is None else wholes.setdefault(text, [])
            self._walk(codes[low:high].tolist(), low - int(w.first[text]), spans, items, whole)
        if spans:
            yield current, spans, items

    def _walk(self, codes: list[int], base: int, spans: list[tuple[int, int]], items: set[str], whole: list[tuple[int, int]] | None = None) -> None:
        a, state, length = self.automaton, 0, 0
        for k, word in enumerate(codes):
            state, length = a.step(state, length, word)
            span = 0
            if length >= self.window:
                span = self.window
                items |= a.found(state)
            if a.whole:
                for n, name in a.endings(state):
                    if n <= length:
                        items.add(name)
                        span = max(span, n)
                        if whole is not None:
                            whole.append((base + k + 1 - n, base + k + 1))
            if span:
                low, high = base + k + 1 - span, base + k + 1
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, high))


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size. A null item_id is named "null"; items without words match nothing."""
    block, size = [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text").where("text is not null").toLocalIterator():
        block.append((row["name"], row["text"]))
        size += len(row["text"]) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


# whole: the span holds a whole item that is shorter than a window.
SPANS = "array<struct<start:long,end:long,whole:boolean>>"
HITS = f"n_words long, spans {SPANS}, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())]))


def _marked(spans: list[tuple[int, int]], wholes: list[tuple[int, int]]) -> list[dict]:
    """The spans of a text, told whether one of ``wholes``, in order of their ends, lies inside."""
    out, at = [], 0
    for start, end in spans:
        before = at
        while at < len(wholes) and wholes[at][1] <= end:
            at += 1
        out.append({"start": start, "end": end, "whole": at > before})
    return out


def _scan(docs: DataFrame, columns: list[str], block: list[tuple[str, str]], window: int, text: str = "text") -> DataFrame:
    """The given columns of every document with n_words, hit spans and items for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    matchers: dict[int, Matcher] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if window not in matchers:
            matchers[window] = Matcher(sent.value, window)
        matcher = matchers[window]
        for b in batches:
            texts = b.column(b.schema.get_field_index("scanned_text"))
            kept = b.select(columns)
            for low, high in slices(texts, BLOCK):
                w = Words(texts.slice(low, high - low), LETTERS, lower=True)
                spans: list = [[] for _ in range(high - low)]
                items: list = [[] for _ in range(high - low)]
                wholes: dict[int, list[tuple[int, int]]] = {}
                for text, found, names in matcher.matches(w, wholes):
                    spans[text] = _marked(found, wholes[text])
                    items[text] = sorted(names)
                part = kept.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(w.first), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=[*columns, "n_words", "spans", "items"],
                )

    return docs.select(*columns, F.col(text).alias("scanned_text")).mapInArrow(releasing(run), schema_of(docs, columns, HITS))


def _merged(spans: list) -> list[dict]:
    out: list[dict] = []
    for s in sorted((s for part in spans for s in part), key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
            out[-1]["whole"] |= s["whole"]
        else:
            out.append({"start": s["start"], "end": s["end"], "whole": s["whole"]})
    return out


def find_hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The given columns of every document with n_words, spans (hit words, joined where they touch) and items.

    Words are runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or a whole shorter item. A null text has no words; rows are judged one
    by one, so repeated rows stay; without items nothing is hit; extra columns are ignored. Items are
    sent to the tasks in blocks of ``block_words``; a further block reads the documents once more and
    the answers of a row are joined on its place in the table, given by its columns and text hash.
    """
    hits = _marked_hits(docs, items, window, columns, block_words)
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return hits.select(*columns, "n_words", plain.alias("spans"), "items")


def _marked_hits(docs: DataFrame, items: DataFrame, window: int, columns: tuple[str, ...], block_words: int = BLOCK_WORDS) -> DataFrame:
    """As ``find_hits``, each span with ``whole`` besides."""
    blocks = item_blocks(items, block_words)
    first = next(blocks, [])
    out = _scan(docs, list(columns), first, window)
    second = next(blocks, None)
    if second is None:
        return out
    numbered = docs.select(*columns, F.col("text").alias("__scanned"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("__text"))
    keys = [*columns, "__text"]
    one = numbered.groupBy(*keys).agg(F.first("__scanned").alias("__scanned"), F.count("*").alias("__copies"))
    keep = [*keys, "__copies"]
    parts = _scan(one, keep, first, window, "__scanned")
    while second is not None:
        parts = parts.unionByName(_scan(one, keep, second, window, "__scanned"))
        second = next(blocks, None)
    join_spans = F.udf(_merged, SPANS)
    whole = parts.groupBy(*keep).agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return whole.select(
        *columns, "n_words", join_spans("spans").alias("spans"), "items",
        F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"),
    ).drop("__copy")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, least_span: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """Documents, in their own columns, without the spans that benchmark items occupy.

    Hit spans of at least ``least_span`` words, and those that hold a whole item shorter than a window, are cut
    from the text, from the first byte of their first word to the last byte of their last one. A document more than
    ``most_coverage`` of whose words are hit is dropped. Documents without a hit are returned as they are.
    """
    own = disguised(docs, "text")
    found = _marked_hits(own, items, window, tuple(own.columns))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = found.where((F.size("spans") == 0) | (covered <= most_coverage * F.col("n_words")))
    carried = own.columns[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = b.column("spans").to_pylist(), b.column("text")
            if any(spans):
                new = texts.to_pylist()
                for i, found_in in enumerate(spans):
                    if found_in:
                        w = Words(texts.slice(i, 1), LETTERS, lower=True)
                        raw, last, parts = new[i].encode(), 0, []
                        for s in found_in:
                            if s["whole"] or s["end"] - s["start"] >= least_span:
                                parts.append(raw[last:w.starts[s["start"]]])
                                last = w.ends[s["end"] - 1]
                        new[i] = b"".join([*parts, raw[last:]]).decode()
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), texts], names=[*carried, "text"])

    # Written first: two functions of batches in one stage would keep two worker processes a core.
    done = settle(kept.select(*own.columns, "spans")).mapInArrow(releasing(cut), own.schema)
    place = docs.columns.index("text")
    return done.select(*(c if k != place else F.col("text") for k, c in enumerate(undisguised(docs.columns))))


def digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, str]:
    """(n_words, n_hit, items_sha256) of one text by trying every window of every item."""
    import re

    def cut(t: str | None) -> list[str]:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    words, hit, names = cut(text), set(), set()
    for name, item in items:
        own = cut(item)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[k:k + n]:
                    hit.update(range(at, at + n))
                    names.add(name)
    return len(words), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
