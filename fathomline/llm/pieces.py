"""SentencePiece models on the tokenizers library: the protobuf read, the pipeline rebuilt, parity checked.

The model file is parsed field by field. From it come the normaliser, the space marker, the pieces with
their scores and byte fallback. A unigram model keeps its scores; in a BPE model they order the merges.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.columns import schema_of
from fathomline.llm.storage import kept_by, releasing
from fathomline.llm.words import Words, byte_class, mix, slices

SPACE = "▁"
THREADS = 2
# Bytes of text encoded at a time, a longer text alone; segments learnt at a time, and those a worker process keeps.
SLICE, LEARNT, MOST_KEPT = 1 << 19, 5_000, 800_000

# Kinds of pieces and of models in the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_marker: bool = False

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers as int, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = number() if wire == 2 else {1: 8, 5: 4}.get(wire, -1)
        if size < 0 or at + size > len(data):
            raise ValueError("not a SentencePiece model: a field is cut off or of unknown kind")
        yield key >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a model file; settings left out have the format's defaults."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 24:
                    out.suffix_marker = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra_spaces = bool(v)
                elif n == 5:
                    out.escape_spaces = bool(v)
    if not out.pieces or out.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if not out.escape_spaces or out.suffix_marker:
        raise ValueError("models without the space marker before words are not rebuilt")
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, best score first, then by the parts' places."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, UNUSED):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in rank and right in rank:
                    found.append((-score, rank[left], rank[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def cuts_at_spaces(model: Model) -> bool:
    """Whether no piece has a marker behind another character: then cutting before each run of markers changes nothing."""
    return not any(SPACE in p.lstrip(SPACE) for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED))


def build_tokenizer(model: Model):
    """A tokenizers pipeline that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if cuts_at_spaces(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    own = [p for p, _, kind in model.pieces if kind == USER]
    if own:
        out.add_tokens([AddedToken(p, normalized=False) for p in own])
    first = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *first])
    return out


class Codec:
    """A model in this worker process: its tokenizer, and the library it came from."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece
        from tokenizers import decoders, normalizers

        model = parse_model(data)
        self.data, self._tokenizer = data, None
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.prefix = model.dummy_prefix
        self._forget()
        # Texts may be cut at spaces, and each distinct segment encoded once, where nothing but spaces is normalised.
        self.segments = None
        if cuts_at_spaces(model) and not model.charsmap and not model.remove_extra_spaces and not any(k == USER for *_, k in model.pieces):
            self.segments = build_tokenizer(model)
            self.segments.normalizer = normalizers.Replace(" ", SPACE)
            self.segments.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])

    @property
    def tokenizer(self):
        """The tokenizer of whole texts, built when it is first asked for."""
        if self._tokenizer is None:
            self._tokenizer = build_tokenizer(parse_model(self.data))
        return self._tokenizer

    def _forget(self) -> None:
        """Drop the segments encoded so far: their hashes (ordered), places and numbers of ids, whether they decode, and the ids."""
        self.known, self.base, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.fine = np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        flat, sizes, fine = [self.flat], [], []
        # The library's encodings are far larger than their ids, so only a few are held.
        for low in range(0, len(texts), LEARNT):
            part = texts[low:low + LEARNT]
            found = [e.ids for e in self.segments.encode_batch_fast(part, add_special_tokens=False)]
            back = self.segments.decode_batch(found, skip_special_tokens=False)
            fine.append(np.fromiter((x == y for x, y in zip(back, part)), bool, len(part)))
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            flat.append(np.fromiter((i for own in found for i in own), np.int32, int(sizes[-1].sum())))
        sizes, fine = np.concatenate(sizes), np.concatenate(fine)
        base = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.flat)
        self.flat = np.concatenate(flat)
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.base = np.insert(self.known, at, hashes[order]), np.insert(self.base, at, base[order])
        self.sizes, self.fine = np.insert(self.sizes, at, sizes[order]), np.insert(self.fine, at, fine[order])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids, whether each decodes to its text)."""
        if self.segments is None:
            own = [t or "" for t in texts.to_pylist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            fine = np.array([x == y for x, y in zip(back, own)], bool)
            return np.fromiter((i for one in found for i in one), np.int32), np.cumsum([0, *map(len, found)]), fine
        w = Words(texts, _NOT_SPACE)
        empty = np.diff(w.offsets) == 0
        # A segment is a word with the spaces before it; spaces at a text's end are a segment without a word.
        total = len(w) + len(w.ends)
        begins, owner, word_of = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, -1)
        own = w.owner()
        at = w.first[:-1] + np.arange(len(w))
        begins[at], owner[at] = w.offsets[:-1], np.arange(len(w))
        at = np.arange(len(own)) + own + 1
        begins[at], owner[at], word_of[at] = w.ends, own, np.arange(len(own))
        following = np.append(owner[1:], -1) == owner
        next_word = np.where(following, np.append(word_of[1:], 0), -1)
        ends = np.where(following, w.ends[np.maximum(next_word, 0)] if len(w.ends) else 0, w.offsets[1:][owner])
        leads = np.where(word_of < 0, int(self.prefix), 0)
        real = (ends - begins + leads > 0) & ~empty[owner]
        real &= (ends > begins) | (leads > 0) & following
        begins, ends, owner, next_word, leads = (x[real] for x in (begins, ends, owner, next_word, leads))
        starts = np.where(next_word >= 0, w.starts[np.maximum(next_word, 0)] if len(w.starts) else 0, ends)
        spaces = (starts - begins + leads).astype(np.uint64)
        hashed = np.where(next_word >= 0, w.hashes[np.maximum(next_word, 0)], np.uint64(0)) if len(w.hashes) else np.zeros(len(ends), np.uint64)
        distinct, first, back = np.unique(mix(hashed ^ mix(spaces)), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = first[self.known[at] != distinct] if len(self.known) else first
        if len(new):
            raw = w.data.tobytes()
            texts_of = [" " * n + raw[a:b].decode() for a, b, n in zip(starts[new].tolist(), ends[new].tolist(), spaces[new].tolist())]
            self._learn(mix(hashed[new] ^ mix(spaces[new])), texts_of)
        at = np.searchsorted(self.known, distinct)
        sizes, base, fine, flat = self.sizes[at], self.base[at], self.fine[at], self.flat
        if len(self.known) > MOST_KEPT:
            self._forget()
        count = sizes[back].astype(np.int64)
        to = np.cumsum(count)
        ids = flat[np.repeat(base[back] - (to - count), count) + np.arange(to[-1] if len(to) else 0)]
        per_text = np.bincount(owner, weights=count, minlength=len(w)).astype(np.int64)
        wrong = np.bincount(owner[~fine[back]], minlength=len(w))
        return ids, np.concatenate(([0], np.cumsum(per_text))), wrong == 0


_NOT_SPACE = byte_class(lambda b: b != 0x20)
_READY: dict[tuple[str, int], Codec] = kept_by(__name__)


def codec(path: str, threads: int = THREADS) -> Codec:
    """The model of a file, once for each worker process."""
    if (path, threads) not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            _READY[path, threads] = Codec(f.read())
    return _READY[path, threads]


CODES = "ids array<int>, n_tokens long, round_trip boolean, parity boolean"


def encode_pieces(docs: DataFrame, model_path: str, *, columns: tuple[str, ...] = ("doc_id",), threads: int = THREADS, parity: bool = True) -> DataFrame:
    """The given columns of every document with its token ids, their number, round_trip and parity.

    Whole texts are encoded, a batch at a time on ``threads`` threads. round_trip: decoding gives the text
    back (each distinct run of spaces and a word is decoded once). parity: the model's own library gives the same ids (null where ``parity`` is off). A null or empty
    text has no ids; a text with the marker character itself decodes to a space there; rows are encoded one
    by one, so repeated rows stay; an empty table gives none; extra columns are ignored. ``model_path`` is a
    file that every executor has.
    """
    names = [*columns, *(x.split()[0] for x in CODES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, threads)
        for b in batches:
            whole = b.column(len(columns))
            for low, high in slices(whole, SLICE):
                column = whole.slice(low, high - low).fill_null("")
                texts = column.to_pylist()
                ids, offsets, fine = own.encode(column)
                same = [None] * len(texts)
                if parity:
                    same = [x == ids[a:z].tolist() for x, a, z in zip(own.reference.encode(texts, num_threads=1), offsets[:-1], offsets[1:])]
                found = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offsets), pa.int64()),
                    pa.array(fine), pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(low, high - low) for k in range(len(columns))), *found], names=names)
            pa.default_memory_pool().release_unused()

    return docs.select(*columns, F.col("text").alias("encoded_text")).mapInArrow(releasing(run), schema_of(docs, columns, CODES))


def decode_pieces(codes: DataFrame, model_path: str, *, threads: int = THREADS) -> DataFrame:
    """doc_id and the text of its ids; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(model_path, threads).tokenizer
        for b in batches:
            ids = b.column("ids").to_pylist()
            texts = tokenizer.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], names=["doc_id", "text"]
            )

    return codes.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(releasing(run), "doc_id long, text string")
