"""Tokens of two tokenizers aligned over the same bytes, and how often their ids meet in the corpus.

Both tokenizers encode whole texts. A slice of texts is aligned as one run of bytes: the bytes at which tokens of
either end tell its groups and links, in a few steps over whole arrays.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathomline.llm.columns import batch
from fathomline.llm.storage import opened
from fathomline.llm.words import slices
from fathomline.session import scratch_folder, settle

# Bytes of text whose tokens a task holds at a time, a longer text alone.
SLICE = 1 << 20
# Id pairs that a task counts before it hands them on, and those of one block of the counted table.
HELD, BLOCK = 1_000_000, 4_000_000
# A longer run of white space is more than the quick encoder's pattern can take.
_LONG_SPACE = re.compile(r"\s{10000}")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level vocabulary; special tokens in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        split = data["pre_tokenizer"] or {}
        if data["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters, special = byte_alphabet(), {t["id"]: t["content"] for t in data["added_tokens"]}
        vocab = {i: p for p, i in data["model"]["vocab"].items()} | special
        self.bytes = [b""] * (max(vocab) + 1)
        for i, p in vocab.items():
            self.bytes[i] = p.encode() if i in special else bytes(letters[c] for c in p)
        self.quick = self._ranked(data, {self.bytes[i]: i for i in vocab if i not in special})

    def _ranked(self, data: dict, ranks: dict[bytes, int]):
        """The same vocabulary by ranks, which is much quicker; None where ids don't follow the merges."""
        model = data["model"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = not model.get("ignore_merges") and model.get("dropout") is None and data["pre_tokenizer"].get("use_regex", True)
        if not plain or any(model["vocab"].get(p) != 256 + k for k, p in enumerate(made)):
            return None
        import tiktoken

        # Fixed value: the pattern that byte-level splitting stands for.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a text behind one space."""
        if self.quick is None or len(text) >= 10_000 and _LONG_SPACE.search(text):
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(" " + text)


class Pieces:
    """A SentencePiece vocabulary that puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Two tokenizers in this worker process."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.width = len(self.b.bytes)
        # Ids as text with what follows them: A's inside and at the end of a group, then B's.
        self.shown = [b"%d%s" % (i, mark) for t, marks in ((self.a, b",|"), (self.b, b",;")) for mark in (marks[:1], marks[1:]) for i in range(len(t.bytes))]

    def _tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Ids by both, and how many bytes they stand for; None where the bytes differ or there are none."""
        if not text:
            return None
        a, b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        for ids, t in ((a, self.a), (b, self.b)):
            if b"".join(map(t.bytes.__getitem__, ids)) != whole:
                return None
        return np.array(a, np.int64), np.array(b, np.int64), len(whole)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of every text; all are aligned as one run of bytes.

        Tokens of both end where a text ends, so neither groups nor links reach over two texts. Between one end of a token and
        the next lies one link, that of the two tokens there.
        """
        found = [self._tokens(t) for t in texts]
        own = [f for f in found if f]
        empty = 0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not own:
            return [empty] * len(texts)
        a, b = (np.concatenate([f[k] for f in own]) for k in (0, 1))
        finish = np.cumsum([f[2] for f in own])
        a_ends, b_ends = np.zeros(finish[-1] + 1, bool), np.zeros(finish[-1] + 1, bool)
        a_ends[np.cumsum(self.a_size[a])] = True
        b_ends[np.cumsum(self.b_size[b])] = True
        ends = np.flatnonzero(a_ends | b_ends)
        in_a, in_b = a_ends[ends], b_ends[ends]
        shared = in_a & in_b
        a_until, b_until, groups_until = np.cumsum(in_a), np.cumsum(in_b), np.cumsum(shared)
        links = a[a_until - in_a] * self.width + b[b_until - in_b]
        # A group shows its tokens of A, then those of B; B's of the groups before it and A's up to its end come first.
        group = groups_until - shared
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.append(0, b_until[shared])[group[in_a]]] = a + len(self.a.bytes) * shared[in_a]
        shown[np.arange(len(b)) + a_until[shared][group[in_b]]] = b + self.width * shared[in_b] + 2 * len(self.a.bytes)
        ids = list(map(self.shown.__getitem__, shown.tolist()))
        last = np.searchsorted(ends, finish)
        out, link, token, done = [], 0, 0, 0
        at = iter(zip((last + 1).tolist(), (a_until + b_until)[last].tolist(), groups_until[last].tolist()))
        for f in found:
            if f is None:
                out.append(empty)
                continue
            to_link, to_token, to_group = next(at)
            pairs, times = np.unique(links[link:to_link], return_counts=True)
            groups = b"".join(ids[token:to_token])[:-1]
            out.append((len(f[0]), len(f[1]), to_group - done, to_link - link, groups, pairs, times))
            link, token, done = to_link, to_token, to_group
        return out


_READY: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """Both tokenizers, once for each worker process."""
    if (a_path, b_path) not in _READY:
        _READY[a_path, b_path] = Aligner(a_path, b_path)
    return _READY[a_path, b_path]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a: int, b: int, times: int>>"
_COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
_PACKED = f"{_COUNTS}, groups_sha256 string, pairs binary, times binary"


def _parts(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.Array, list[tuple]]]:
    own = aligner(a_path, b_path)
    for b in batches:
        for low, high in slices(b.column("text"), SLICE):
            yield b.column("doc_id").slice(low, high - low), own.align(b.column("text").slice(low, high - low).to_pylist())


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Of every row: numbers of tokens, groups and links, the groups as text, and the linked id pairs with how often.

    Tokenizer A, a byte-level JSON file, encodes a space and the text, tokenizer B, a SentencePiece model, the text. Groups are
    cut where tokens of both end; a pair is linked where the bytes of two tokens overlap. A null or empty
    text, and one whose tokens don't give its bytes back, has no tokens, so zeros and an empty text. Rows are aligned
    one by one, so repeated rows stay and a missing id is kept; an empty table gives none; extra columns are
    ignored. Both files are such that every executor has them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
        for ids, found in _parts(batches, a_path, b_path):
            width = aligner(a_path, b_path).width
            keys, times = (np.concatenate([f[k] for f in found]) for k in (5, 6))
            inner = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (keys // width, keys % width, times)], fields=list(pair))
            offsets = pa.array(np.cumsum([0, *(len(f[5]) for f in found)]), pa.int32())
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            groups = pa.array([f[4].decode() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, *counts, groups, pa.ListArray.from_arrays(offsets, inner)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
            )

    return _documents(docs).mapInArrow(run, ALIGNED)


def _packed(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """As ``align_tokens``, with the digest of the groups, and the pairs as packed numbers (A id times B's vocabulary plus B id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _parts(batches, a_path, b_path):
            digests = [hashlib.sha256(f[4]).hexdigest() if f[4] else "" for f in found]
            packed = [f[5].astype("<u8").tobytes() for f in found], [f[6].astype("<u4").tobytes() for f in found]
            yield batch([ids, *([f[k] for f in found] for k in range(4)), digests, *packed], _PACKED)

    return _documents(docs).mapInArrow(run, _PACKED)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, offsets of each row's) of a column of packed numbers."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *rows]), np.cumsum([0, *map(len, rows)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, summed within the task until it holds too many pairs."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        more, n = np.unique(_flat(b.column("pairs"), "<u8")[0], return_counts=True)
        merged, back = np.unique(np.concatenate((keys, more)), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate((counts, n)), minlength=len(merged)).astype(np.int64)
        keys = merged
        if len(keys) > HELD:
            yield batch([keys.astype(np.int64), counts], "pair long, count long")
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield batch([keys.astype(np.int64), counts], "pair long, count long")


def count_pairs(packed: DataFrame, width: int) -> DataFrame:
    """pair, a, count (documents that hold the pair linked) and best (no pair of this A id is held by more).

    Pairs of one A id are as many as B has ids at most, so a window over them is bounded by the vocabulary.
    """
    counts = packed.select("pairs").mapInArrow(_count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


class Counts:
    """The counted pairs in blocks by A id, read one block at a time from the shared folder."""

    def __init__(self, folder: str, blocks: int, width: int) -> None:
        self.folder, self.blocks, self.width = folder, blocks, width

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow.dataset as ds

        system, inner = opened(self.folder)
        rows = ds.dataset(f"{inner}/block={k}", filesystem=system, format="parquet").to_table(columns=["pair", "count", "best"])
        pair, count, best = (rows.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        return pair[order].astype(np.uint64), count[order], best[order]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, best) of keys that all are in the table."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        where = (keys // np.uint64(self.width)) % np.uint64(self.blocks)
        for k in np.unique(where).tolist():
            own = where == k
            if _HELD.get("block") != (self.folder, k):
                _HELD.clear()
                _HELD.update(block=(self.folder, k), rows=self._block(k))
            pair, counts, bests = _HELD["rows"]
            at = np.searchsorted(pair, keys[own])
            count[own], best[own] = counts[at], bests[at]
        return count, best


_HELD: dict = {}
DIGEST = f"{_COUNTS}, n_best long, count_sum long, groups_sha256 string"


def alignment_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts of every row's alignment, how its links fare in the whole corpus, and the digest of its groups.

    n_best: links whose pair is held by as many documents as any pair of the same A id; count_sum: documents that hold
    the pair, summed over the links. Every row is a document of its own, repeated ones too; the rest is as in ``align_tokens``.
    """
    spark = docs.sparkSession
    packed = settle(_packed(docs, a_path, b_path))
    width = len(Pieces(b_path).bytes)
    counts = settle(count_pairs(packed, width))
    blocks = max(1, -(-counts.count() // BLOCK))
    folder = f"{scratch_folder(spark)}/pairs-{uuid.uuid4().hex}"
    counts.withColumn("block", F.expr(f"a % {blocks}")).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    table = Counts(folder, blocks, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, offsets = _flat(b.column("pairs"), "<u8")
            times = _flat(b.column("times"), "<u4")[0].astype(np.int64)
            count, best = table.look_up(keys)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[offsets]) for x in (times * best, times * count)]
            yield batch([*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, b.column("groups_sha256")], DIGEST)

    return packed.mapInArrow(run, DIGEST)
