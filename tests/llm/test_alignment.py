"""Alignment of two tokenizers against a brute-force version over token bytes."""

import collections
import hashlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from fathomline.llm import alignment
from fathomline.llm.queries import BYTE_LEVEL, PIECES

ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n\n  x", "naïve café 漢字 😀😀 שלום", "a▁b marker", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "x" * 3000, " " * 12_000 + "end", "\n" * 400, "don't we'll 12345 3.14 ... !!!", "\x00\x01 control", "supercalifragilistic unbelievability",
    "same text", "same text", "é combining ‍ joiner", "word " * 2000,
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    letters = "abcdeé漢 \n\t.,'😀"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(60)]


def reference(texts):
    """Tokens from the libraries as they are, groups and links from byte ranges compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = alignment.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        e = tokenizer.encode(" " + text, add_special_tokens=False)
        a = list(zip(e.ids, (bytes(letters[c] for c in t) for t in e.tokens)))
        b = [(i, bytes([i - 3]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
        if {b"".join(x for _, x in a), b"".join(x for _, x in b)} != {(" " + text).encode()}:
            out.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in own if low <= s and e <= high) for own in spans))
            low = high
        links = []
        for i, s, e in spans[0]:
            for j, t, f in spans[1]:
                if t >= e:
                    break
                if f > s:
                    links.append((i, j))
        out.append((len(a), len(b), groups, links))
    return out


def test_digest(spark, texts):
    found = reference(texts)
    counts = collections.Counter(p for f in found if f for p in set(f[3]))
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    expected = []
    for k, f in enumerate(found):
        if f is None:
            expected.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            expected.append((k, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"pairs": F.lit(1), "n_a": F.lit("x")}).repartition(5)
    assert sorted(tuple(r) for r in alignment.alignment_digest(docs, BYTE_LEVEL, PIECES).collect()) == expected
    assert [k for k, f in enumerate(found[:len(ODD)]) if f is None] == [0, 1, 7]
    rows = {r["doc_id"]: r for r in alignment.align_tokens(docs, BYTE_LEVEL, PIECES).collect()}
    for k, f in enumerate(found):
        assert rows[k]["groups"] == (";".join(f[2]) if f else "")
        assert {(p["a"], p["b"]): p["times"] for p in rows[k]["pairs"]} == (collections.Counter(f[3]) if f else {})


def test_blocks_of_pairs(spark, texts, monkeypatch):
    """The counted table in one block and in many gives the same; rows of one id or none are documents of their own."""
    docs = spark.createDataFrame([(None if k % 9 == 0 else k % 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(alignment.alignment_digest(docs, BYTE_LEVEL, PIECES).collect(), key=str)
    monkeypatch.setattr(alignment, "BLOCK", 50)
    assert sorted(alignment.alignment_digest(docs, BYTE_LEVEL, PIECES).collect(), key=str) == whole and len(whole) == len(texts)
    assert alignment.alignment_digest(docs.limit(0), BYTE_LEVEL, PIECES).count() == 0
    nothing = docs.where("text is null")
    assert [tuple(r)[1:] for r in alignment.alignment_digest(nothing, BYTE_LEVEL, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_quick_encoder_agrees(texts):
    own = alignment.ByteLevel(BYTE_LEVEL)
    assert own.quick is not None
    for t in texts:
        if t:
            quick = own.encode(t)
            assert quick == own.slow.encode(" " + t, add_special_tokens=False).ids
            assert b"".join(own.bytes[i] for i in quick) == (" " + t).encode()


def test_words_cost_no_calls():
    """A slice is aligned by steps over arrays: no Python call for each of its distinct words."""
    own, calls = alignment.aligner(BYTE_LEVEL, PIECES), 0
    text = " ".join(f"w{k:x}q{k * 7919 % 10007}" for k in range(5000))

    def count(frame, event, argument):
        nonlocal calls
        calls += event == "call"

    own.align([text[:100]])
    sys.setprofile(count)
    try:
        found = own.align([text, None, text])
    finally:
        sys.setprofile(None)
    assert calls < 500 and found[0][:4] == found[2][:4] and found[1][:4] == (0, 0, 0, 0) and found[0][2] >= 5000
