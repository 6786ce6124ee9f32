"""The operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import benchmark, chats, jaccard, pages, pieces, quality, separators, substrings, url_filters, warc
from fathomline.llm.queries import LISTED, PIECES, RANKS, RULES
from fathomline.llm.storage import new_file, opened, shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, ids int"
WORD = "[^\x20\x09-\x0d]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(WORD, t or "")


def docs(spark, texts, ids=None):
    rows = [(i, t, None, "s", None, "x", 7) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    """Prose with copies, near copies, shared passages, odd white space, empty, null and long texts."""
    r = random.Random(5)
    say = lambda n: [r.choice("abcdefghijklmnopqrstuvw") + str(r.randrange(40)) for _ in range(n)]
    passage, base = say(70), say(300)
    out = [None, "", " \n\t ", "one", "one two three", "One two  three", "x " * 60, "é ü\u00a0ß 漢字 word"]
    out += [" ".join(say(n)) for n in (5, 49, 50, 51, 120, 120, 5000)]
    out += [" ".join(say(30) + passage + say(40)) for _ in range(6)]
    out += [" ".join(base)] * 3 + ["\n".join(base)]
    for k in range(6):
        near = list(base)
        for _ in range(k + 1):
            near[r.randrange(len(near))] = f"new{k}"
        out.append(" ".join(near))
    out += [" ".join(passage[:50]), " ".join(passage[:49]), " ".join(passage + passage), " ".join(say(20)) + "\n" + "same line here\n" * 9]
    return out


@pytest.fixture(scope="module")
def ids(texts):
    own = list(range(100, 100 + len(texts)))
    random.Random(2).shuffle(own)
    own[9] = own[10]  # two documents with one id
    return own


# Quality rules


def test_base_counts(spark, texts, ids):
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[8:]] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs(spark, texts, ids), labels).collect()
    expected = []
    for i, t in zip(ids, texts):
        w = words(t)
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = {}
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k:k + 3]), []).append(k)
        again = {k + j for places in grams.values() if len(places) > 1 for k in places for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again), failed))
    assert sorted(tuple(r)[:7] for r in rows) == sorted(expected)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_ratio(spark, texts):
    own = docs(spark, texts[8:])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 16, 2)], "doc_id long, quality int, toxic int")
    weights, least = quality.fit_rules(own, labels, buckets=64)
    counts = {r["bucket"]: r for r in quality.count_grams(own, list(range(0, 16, 2)), 64).collect()}

    def grams(t):
        n = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") % (1 << 31) for w in words(t)]
        return [x % 64 for x in n] + [(31 * a + b + 1) % 64 for a, b in zip(n, n[1:])]

    every = [g for t in texts[8:] for g in grams(t)]
    good = [g for t in texts[8:24:2] for g in grams(t)]
    assert all(counts[b]["corpus"] == every.count(b) and counts[b]["even"] + counts[b]["odd"] == good.count(b) for b in set(every))
    for r in quality.score_quality(own, labels, buckets=64).collect():
        g = grams(texts[8 + r["doc_id"]])
        assert (r["ratio_sum"], r["n_grams"]) == (sum(int(weights[x]) for x in g), len(g))
        assert r["kept"] == (not r["base_failed"] and r["ratio_sum"] >= least * len(g))


def test_quality_without_labels(spark, texts):
    own = docs(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality.score_quality(own, none).collect())
    kept = quality.keep_good(own, none)
    assert kept.schema == own.schema and kept.count() == sum(not r["base_failed"] for r in quality.score_quality(own, none).collect())
    assert quality.keep_good(own.limit(0), none).count() == 0


def test_few_toxic_words():
    import numpy as np
    import pyarrow as pa

    w = quality.Words(pa.array(["a b c d", "", None, "a", "c d"]), quality.LETTERS)
    assert quality.worst_windows(w, np.array([5, -3, 1, -9, -7, 2, -4]), 2).tolist() == [-8, 0, 0, -7, -2]
    assert quality.fewest_wrong({5: 990, -3: 1, 2: 9}, {-8: 3, -3: 2, 2: 99}, 0.999) == -2
    assert quality.fewest_wrong({1: 10}, {1: 3, 2: 9}, 0.999) is None


def test_toxic_documents(spark):
    """Texts alike but for three bad words in 150, judged by labels that name other documents."""
    r = random.Random(3)
    bad = ["idiot", "scum", "moron", "trash", "loser"]

    def text(toxic):
        said = [r.choice("abcdefghijklmnopqrst") + str(r.randrange(60)) for _ in range(150)]
        for _ in range(3 * toxic):
            said[r.randrange(150)] = r.choice((str, str.title, "{}.".format))(r.choice(bad))
        return " ".join(said)

    toxic = [k % 4 == 0 for k in range(400)]
    own = docs(spark, [text(t) for t in toxic])
    labels = spark.createDataFrame([(k, 1, int(toxic[k])) for k in range(300)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.score_quality(own, labels).collect()}
    assert not any(kept[k] for k in range(400) if toxic[k]) and sum(kept[k] for k in range(400) if not toxic[k]) >= 298
    assert {r["doc_id"] for r in quality.keep_good(own, labels).collect()} == {k for k in kept if kept[k]}


# SentencePiece


def test_pieces(spark, texts):
    import sentencepiece

    odd = ["  a  b ", "\n\n", "a▁b", "<s> x </s>", "\x00\x01", "😀 漢字", "<0x41>", "a" * 5000, "\tq", " ", "x ", " \n "]
    own = docs(spark, texts + odd)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode_pieces(own, PIECES)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for k, t in enumerate(texts + odd):
        assert rows[k]["ids"] == reference.encode(t or "") and rows[k]["parity"]
        assert rows[k]["round_trip"] == ("▁" not in (t or ""))
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded, PIECES).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(texts + odd))
    assert pieces.encode_pieces(own.limit(0), PIECES).count() == 0


def test_whole_text_path_agrees(texts):
    import pyarrow as pa

    codec = pieces.codec(PIECES)
    own = [t or "" for t in texts]
    ids, offsets, fine = codec.encode(pa.array(own))
    assert fine.all()
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in codec.tokenizer.encode_batch_fast(own, add_special_tokens=False)]


def test_unigram_model():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    import struct

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    model = b"".join([piece("<unk>", 0, 2), piece("▁", -3, 1), piece("▁ab", -1, 1), piece("a", -4, 1), piece("b", -4, 1)])
    model += field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")
    parsed = pieces.parse_model(model)
    assert parsed.kind == pieces.UNIGRAM and not parsed.byte_fallback and parsed.unknown == 0
    tokenizer = pieces.build_tokenizer(parsed)
    assert tokenizer.encode("ab ba", add_special_tokens=False).ids == [2, 1, 4, 3]
    with pytest.raises(ValueError):
        pieces.parse_model(model[:-3])


# Jaccard join


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = words(lower(t or ""))
        sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()})
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return sorted((i, len(s), min(ids[k] for k in range(len(ids)) if group[k] == g)) for i, s, g in zip(ids, sets, group))


def test_jaccard(spark, texts, ids):
    rows = jaccard.near_duplicates(docs(spark, texts, ids)).collect()
    assert sorted(map(tuple, rows)) == brute_components(texts, ids)


@pytest.mark.parametrize("pairs,triples", [(2, 4), (2, 2), (3, 1000)])
def test_combinations(spark, monkeypatch, pairs, triples):
    """Small sets over few words: nearly all tokens are frequent, so links hang on the combinations."""
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "TRIPLES", triples)
    monkeypatch.setattr(jaccard, "CROWDED", pairs)
    r = random.Random(pairs)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(6)}" for _ in range(r.choice([9, 14, 30, 70, 90, 150]))]
        for _ in range(6):
            texts.append(" ".join(base))
            base = list(base)
            base[r.choice([0, -1, r.randrange(len(base))])] = f"w{r.randrange(9)}"
    rows = jaccard.near_duplicates(docs(spark, texts)).collect()
    assert sorted(map(tuple, rows)) == brute_components(texts, list(range(len(texts))))


def test_keep_one(spark, texts):
    own = docs(spark, texts + texts[20:22], list(range(len(texts))) + [20, 21])
    kept = jaccard.keep_one(own)
    assert kept.schema == own.schema
    first = {c for *_, c in brute_components(texts, list(range(len(texts))))}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first)
    nameless = docs(spark, ["a b c d e"] * 3).withColumn("doc_id", F.lit(None).cast("long"))
    assert [tuple(r) for r in jaccard.near_duplicates(nameless).collect()] == [(None, 2, None)] * 3
    assert jaccard.keep_one(nameless).count() == 1
    assert jaccard.near_duplicates(own.limit(0)).count() == 0


# WARC


def test_warc(spark):
    big = "<p>ü" + "x" * 2000
    rows = [(1, "http://a/ ü", big, 1), (2, None, big, 1), (9, "u\r\nX: y", big, 1), (None, "u", big, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "s", 1), (6, "u", "s", 1), (9, "again", big, 1)]
    own = spark.createDataFrame(rows, "page_id long, url string, html string, winner int")
    got = sorted(map(tuple, warc.archive_and_read(spark, own).collect()), key=str)
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        visit = len(data) >= 1000 and i != 9
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", 9 if visit else None))
    assert got == sorted(expected, key=str)
    assert warc.archive_and_read(spark, own.limit(0)).count() == 0
    written = warc.write_packages(warc.assign_records(own), shared_folder(spark, "packages"), package_bytes=100)
    texts = [(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_packages(written, range_bytes=50).collect() if r["record_type"] == "response"]
    assert sorted(texts, key=str) == sorted(((i, h or "") for i, _, h, _ in rows if not h or len(h) < 1000 or i == 9), key=str)


def test_zip_directory(spark, tmp_path):
    import zipfile

    path = str(tmp_path / "one.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"abc" * 10)
        z.writestr(zipfile.ZipInfo("packed"), b"a" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK a comment"
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        found = warc.members(f)
        own = warc.stored(found, "stored")
        assert f.read_at(own.size, own.start) == b"abc" * 10
        with pytest.raises(ValueError):
            warc.stored(found, "packed")


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = str(tmp_path / "big.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"a" * 30)
        z.writestr("b", b"b" * 40)
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        for name, data in (("a", b"a" * 30), ("b", b"b" * 40)):
            own = warc.stored(warc.members(f), name)
            assert f.read_at(own.size, own.start) == data


# Token counts


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separators(spark, block):
    import numpy as np

    cases = [[], [9], [9, 9], [1, 2, 9], [1, 2], [1, 9, 2, 3], [*range(1, 8), 9, 9, *range(1, 30), 9], [1] * 50]
    folder, rows, expected = shared_folder(spark, "tokens"), [], []
    for ids in cases:
        path, stream = new_file(folder, ".tokens")
        stream.write(np.array(ids, "<u2").tobytes())
        stream.close()
        rows.append((path, 2 * len(ids)))
        start = ordinal = 0
        for k, x in enumerate([*ids, None]):
            if x == 9 or x is None and start < len(ids):
                expected.append((path, ordinal, start, k - start))
                start, ordinal = k + 1, ordinal + 1
    files = spark.createDataFrame(rows, "path string, bytes long")
    got = separators.count_tokens(files, separator=9, block_bytes=block).select("path", "ordinal", "start", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_document_tokens(spark, texts):
    encoder = separators._encoder(RANKS)
    own = docs(spark, [*texts, "<|endoftext|>"] * 2)
    got = sorted(map(tuple, separators.count_documents(spark, own, RANKS).collect()))
    assert got == sorted((k, len(encoder.encode_ordinary(t or ""))) for k, t in enumerate([*texts, "<|endoftext|>"] * 2))
    assert separators.count_documents(spark, own.limit(0), RANKS).count() == 0


# URL filters


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/es/a?q#f", "http://example.org", "http://example.org/en/1x", "https://notexample.org/es/", "a://b.com/de/?x", "a://b.com/de#/", "s://spam-farm.example.net/q", "s://x.spam-farm.example.com/fr/1", "s://É.com/fr/", "a://b/c://d"]
    own = spark.createDataFrame([(k, u, "h", 3) for k, u in enumerate(urls)] + [(4, urls[4], "h", 3)], "page_id long, url string, host string, verdict int")
    rows = url_filters.filter_urls(own.select("page_id", "url", F.col("verdict").alias("extra")), RULES, F.col("host").rlike(LISTED)).collect()
    got = {r["page_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(urls) + 1
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.org", "/es/a", "example.org/es/", "block")
    assert got[5] == ("example.org", "", None, "allow") and got[6][2:] == ("example.org/en/1", "block")
    assert got[7] == ("notexample.org", "/es/", "org/", "allow") and got[8][1:] == ("/de/", "com/de/", "block")
    assert got[9] == ("b.com", "/de", None, "allow") and got[10][3] == "block" and got[11][2:] == ("com/fr/", "allow")
    assert got[12][:1] == ("É.com",) and got[13] == ("b", "/c://d", None, "allow")


@pytest.mark.parametrize("share", [2, 7, 50])
def test_cascade(spark, share):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % share == 0).alias("inside"))
    levels = url_filters.build_cascade(keys, "key", "inside")
    assert len(levels) > 1
    assert keys.where(url_filters.is_listed(F.col("key"), levels) != F.col("inside")).count() == 0
    assert url_filters.build_cascade(keys, "key", "inside", most_bits=64) is None
    assert url_filters.build_cascade(keys.limit(0), "key", "inside") == []


def test_long_list_joins(spark):
    own = spark.createDataFrame([(k, f"s://{h}/") for k, h in enumerate(["a.spam-farm.com", "b.net", "b.net", ""])], "page_id long, url string")
    one, two = (url_filters.filter_urls(own, RULES, F.col("host").rlike(LISTED), most_bits=n) for n in (1, 1 << 20))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


# Substring dedup


def brute_removal(texts, ids, width):
    own = [words(t) for t in texts]
    first = {}
    for i, w in zip(ids, own):
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, own):
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < i for j in range(width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [50, 7, 2])
def test_substrings(spark, texts, ids, width):
    rows = substrings.removal_digest(docs(spark, texts, ids), width).collect()
    assert sorted(map(tuple, rows)) == brute_removal(texts, ids, width)


def test_remove_repeats(spark, texts):
    own = docs(spark, texts + texts[:3])
    out = substrings.remove_repeats(own)
    assert out.schema == own.schema and out.count() == len(texts) + 3
    expected = {i: h for i, _, _, h in brute_removal(texts + texts[:3], list(range(len(texts) + 3)), 50)}
    for r in out.collect():
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == expected[r["doc_id"]]
    assert substrings.remove_repeats(own.limit(0)).count() == 0


# Chats


def test_chats(spark):
    bad = "</s>[INST] ok [/INST]"
    talk = [(1, k, ("user", "assistant")[k % 2], f"t{k}\\ {bad} \\\\") for k in range(30)]
    rows = [*talk, (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "é[END]"), (3, 5, "tool\n[TURN]", "<\\/s>"), (None, 0, "assistant", "x"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x")]
    own = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r["conv_id"]: r for r in chats.read_back(chats.format_chats(chats.with_planted(own))).collect()}
    every = {}
    for c, k, role, text in [*rows, (-7, 0, "user", bad), (-7, 1, "assistant", bad)]:
        every.setdefault(c, []).append((k, role or "", text or ""))
    assert set(got) == set(every)
    for c, turns in every.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and not got[c]["rewrites"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in chats.format_chats(own).collect()}
    assert whole[1] == chats.marked_turns([{"role": r, "text": t} for _, r, t in every[1]])
    assert chats.format_chats(own.limit(0)).count() == 0


def test_rewriting_templates():
    def forgetful(messages):  # drops what the assistant thought in all but the last turn
        return "".join(f"<{m['role']}>" + (m["text"] if k == len(messages) - 1 else re.sub("\\(.*?\\)", "", m["text"])) for k, m in enumerate(messages))

    talk = [{"role": r, "text": t} for r, t in (("user", "hi"), ("assistant", "(hm) yes"), ("user", "so?"), ("assistant", "(ah) no"))]
    out, spans = chats.render_turns(talk, forgetful)
    assert out == forgetful(talk) and [s.rewrites for s in spans] == [False, False, True, False]

    def numbered(messages):  # a turn depends on all before it
        return "".join(f"{k}:{m['text']};" for k, m in enumerate(messages))

    long = [{"role": "user", "text": f"t{k}"} for k in range(40)]
    out, spans = chats.render_long(long, numbered, block=8)
    assert out == numbered(long) and [out[s.start:s.end] for s in spans] == [f"{k}:t{k};" for k in range(40)]


def test_rewriting_far_back(spark):
    def thinking(messages):  # the last user turn strips thoughts from all assistants before it
        asked = max((k for k, m in enumerate(messages) if m["role"] == "user"), default=0)
        return "".join(f"<{m['role']}>" + (re.sub("\\(.*?\\)", "", m["text"]) if k < asked else m["text"]) for k, m in enumerate(messages))

    def recent(messages):
        return "".join(f"<{m['text']}>" for m in messages[-10:])

    def undone(messages):  # changes the first turn at one inner turn only
        return "".join(f"<{'gone' if k == 0 and len(messages) == 13 else m['text']}>" for k, m in enumerate(messages))

    roles = ["user", "assistant", *["tool", "assistant"] * 5, "user", "assistant", "tool", "assistant"]
    talk = [{"role": r, "text": f"(hm {k}) t{k}" if k == 1 else f"t{k}"} for k, r in enumerate(roles)]
    rows = spark.createDataFrame([(1, k, m["role"], m["text"]) for k, m in enumerate(talk)], "conv_id long, turn long, role string, text string")
    for template in (thinking, recent, undone, chats.appending(lambda messages: thinking(messages))):
        got = chats.format_chats(rows, template).first()
        spans = chats.render_turns(talk, template)[1]
        loss = [(s.text_start, s.text_end) for m, s in zip(talk, spans) if m["role"] == "assistant"]
        assert got["formatted"] == template(talk) and got["rewrites"] and [tuple(x) for x in got["loss"]] == loss


# Pages


def test_pages(spark):
    article = "<article class=main><h1>The &amp; title</h1><p><b>First\n  words<br>here<p>Then <i>mo</i>re &lt;b&gt;&nbsp;text &#233;</p><div class='ad banner'>buy</div><form>name <input></form><script>x='</p>'</script><p>End.</p><section id=comments><p>reader says</p></section></article>"
    page = f"<html><head><title>The title</title></head><body><nav><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></nav><aside>side words</aside><div class=cookie-notice>we use</div>{article}<footer>&copy; all rights reserved by us</footer>"
    plain = "<p>Short article without any label.</p><p>And more of it.</p>"
    rows = [(k, "u", page, 1) for k in range(4)] + [(4, None, None, 1), (5, "u", "", 1), (6, "u", "<nav><a>only</a></nav>", 1), (None, "u", plain, 1), (7, "u", "just text", 1), (8, "u", "<article></article>", 1)]
    own = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in pages.extract_pages(own).collect()}
    expected = "The & title\n\nFirst words here\n\nThen more <b> text é\n\nEnd."
    assert all(got[k]["text"] == expected and got[k]["n_chars"] == len(expected) for k in range(4))
    assert got[4]["text"] == got[5]["text"] == got[6]["text"] == got[8]["text"] == ""
    assert got[None]["text"] == "Short article without any label.\n\nAnd more of it." and got[7]["text"] == "just text"
    assert pages.extract_pages(own.limit(0)).count() == 0


def test_teasers_and_parts(spark):
    """Weights from ordinary pages; then a teaser beside the text, two articles apart, and no article."""
    say = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    menu = "<nav><ul>" + "<li><a href=x>go</a></li>" * 30 + "</ul></nav>"
    wrap = lambda body: f"<html><body>{menu}<div class=ad>buy now</div>{body}<footer>by us</footer></body></html>"
    plain = wrap(f"<article><h1>t</h1><p>{say(100, 'a')}</p></article>")
    long = "".join(f"<p>{say(100, c)}</p>" for c in "bcdefghijklmnopqrstu")
    bare = "<br>".join(say(100, c) for c in "bcdefghijklmnopqrstu")
    texts = {
        1: wrap(f"<article class=card><h2>{say(4, 'x')}</h2><p>{say(16, 'y')}</p></article>{menu}<div>{long}</div>"),
        2: wrap(f"<article><p>{say(20, 'y')}</p></article><div>{bare}</div>"),
        3: wrap(f"<article><p>{say(300, 'm')}</p></article>{menu}<div class=ad>buy</div>{menu}<article><p>{say(200, 'n')}</p></article>"),
        4: wrap(f"<div>{long}</div>"),
        5: wrap(f"<div>a tagline</div><article><p>{say(300, 'm')}</p><div class=ad>buy</div><p>end</p></article>"),
    }
    own = spark.createDataFrame([(k, "u", plain) for k in range(10, 60)] + [(k, "u", t) for k, t in texts.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split() for r in pages.extract_pages(own).collect()}
    article = [w for c in "bcdefghijklmnopqrstu" for w in say(100, c).split()]
    assert all(set(article) <= set(got[k]) for k in (1, 2)) and got[4] == article
    assert got[3] == say(300, "m").split() + say(200, "n").split()
    assert got[5] == say(300, "m").split() + ["end"]
    assert all(got[k] == ["t", *say(100, "a").split()] for k in range(10, 60))


def test_given_pages(spark, folder):
    """Against the articles that the markup of the given pages names."""
    import html as entities

    for r in pages.extract_pages(spark.read.parquet(f"{folder}/pages.parquet")).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split("</?(?:p|h1|article)>", inner)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_best_run():
    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        scores = np.array([r.randint(-4, 4) for _ in range(r.randint(0, 12))], float)
        a, b = pages.best_run(scores)
        best = max((scores[i:j].sum() for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert scores[a:b].sum() == max(best, 0)


# Benchmark


ITEMS = [("0", "Alpha beta gamma delta eps zeta eta theta iota kappa lambda mu"), ("1", "gamma delta eps"), ("2", None), ("3", ""), ("10", "solo"), ("4", "alpha beta gamma delta eps zeta eta theta iota kappa xx yy"), ("5", "a a a a a a a a a a a a")]


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_benchmark(spark, texts, block):
    items = spark.createDataFrame([(int(i), t, 1) for i, t in ITEMS], "item_id long, text string, extra int")
    long = "z q alpha BETA gamma-delta eps zeta, eta theta iota kappa lambda end"
    own = [long, long, "gamma delta eps delta", "solo", "Solo solo x", "a " * 30, "beta gamma delta eps zeta eta theta iota kappa lambda mu nu", None, "", "漢字 solo é", *texts]
    got = benchmark.digest(benchmark.find_hits(docs(spark, own), items, block_words=block)).collect()
    known = [(i, t) for i, t in ITEMS if t]
    assert len(got) == len(own)
    for r in got:
        n, hit, digest = benchmark.brute_force(own[r["doc_id"]], known)
        assert (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) == (n, hit, digest, hit > 0)


def test_random_automaton(spark):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("ab c") for _ in range(n))
    known = [(str(k), say(r.randint(1, 30))) for k in range(12)]
    matcher = benchmark.Matcher(known, 4)
    import pyarrow as pa

    own = [say(r.randint(0, 60)) for _ in range(60)]
    w = benchmark.Words(pa.array(own), benchmark.LETTERS, lower=True)
    found = {k: (sum(b - a for a, b in spans), sorted(items)) for k, spans, items in matcher.matches(w)}
    for k, t in enumerate(own):
        _, hit, digest = benchmark.brute_force(t, known, 4)
        n, items = found.get(k, (0, []))
        assert (n, hashlib.sha256(",".join(items).encode()).hexdigest()) == (hit, digest)


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, ITEMS[0][1])], "item_id long, text string")
    rest = " ".join(f"w{k}" for k in range(30))
    own = docs(spark, [f"{rest}, {ITEMS[0][1].upper()}! tail", ITEMS[0][1], "clean é text", None, rest])
    out = benchmark.decontaminate(own, items)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.schema == own.schema and got == {0: f"{rest}, ! tail", 2: "clean é text", 3: None, 4: rest}
    assert benchmark.decontaminate(own, items.limit(0)).count() == 5 and benchmark.decontaminate(own.limit(0), items).count() == 0


def test_decontaminate_short_items(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Gamma delta eps"), (2, ITEMS[0][1])], "item_id long, text string")
    rest = " ".join(f"w{k}" for k in range(40))
    long = ITEMS[0][1].replace("gamma", "g")  # nine of its words in a row stay
    own = docs(spark, [f"{rest} gamma DELTA, eps! tail", f"gamma delta eps {rest}", f"{rest} {long}", f"{rest} {ITEMS[0][1]} x"])
    for most, block in ((10, 1_000_000), (30, 1_000_000), (10, 3)):
        monkeypatch.setattr(benchmark._marked_hits, "__defaults__", (block,))
        out = benchmark.decontaminate(own, items, least_span=most)
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got == {0: f"{rest} ! tail", 1: f" {rest}", 2: f"{rest} {long}", 3: f"{rest}  x"}
        assert not any(r["contaminated"] for r in benchmark.digest(benchmark.find_hits(out, items)).collect())
    alone = benchmark.decontaminate(own, items.where("item_id = 2"), least_span=30)
    assert {r["doc_id"]: r["text"] for r in alone.collect()}[3] == f"{rest} {ITEMS[0][1]} x"


# Pipeline


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        kept = kept.cache()
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert all(r["parity"] and r["round_trip"] for r in kept.collect())
    left = before.collect()
    found = benchmark.digest(benchmark.find_hits(before, spark.read.parquet(f"{folder}/benchmark.parquet")))
    assert found.where("contaminated").count() == 0
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    groups = brute_components([r["text"] for r in docs.collect()], [r["doc_id"] for r in docs.collect()])
    by = {i: c for i, _, c in groups}
    assert len({by[r["doc_id"]] for r in left}) == len(left)


def test_pipeline_on_nothing(spark, folder, texts):
    none = docs(spark, texts).limit(0)
    odd = docs(spark, [*texts, *texts[:4]], [None, *range(len(texts) + 3)])
    for start in (none, odd):
        own = start
        for _, stage in corpus_pipeline.STAGES:
            own = stage(spark, own, folder).cache()
            own.count()


def test_a_pair_that_meets_behind_the_first_part_alone():
    """59 of 64 tokens in common, one of them in the first part and indexed in pairs only; all others there are each set's own."""
    import numpy as np

    band, both = jaccard.BANDS[1], -(-85 * 128 // 185)
    common = np.array([400, *(4 * k + 1 for k in range(1000, 1058))], np.uint64)
    found = []
    for own in (range(4000, 4020, 4), range(8000, 8020, 4)):
        tokens = np.concatenate([common, np.array(own, np.uint64)])
        times = np.array([300, *[2] * 58, *[2] * 5])
        sigs, places, before = jaccard.prefix_signatures(band, 64, 6, tokens, times, 85)
        assert len(sigs) == len(places) == len(before) and all(b is None or b in sigs for b in before)
        found.append({s for s, p in zip(sigs, places) if 64 - p >= both})
    assert found[0] & found[1]


def test_near_copies_around_the_threshold(spark):
    """Many texts that share most words: more crowded signatures than the limit, and no link lost."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for at in r.sample(range(120), r.choice((2, 3, 4, 5, 6))):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[k:k + 4]) for k in range(117)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """Blocks of files are dealt to a given number of tasks, which adaptive execution leaves alone."""
    import numpy as np

    path = str(tmp_path / "flat.bin")
    np.zeros(100_000, np.uint16).tofile(path)
    files = spark.createDataFrame([(path, 200_000)], "path string, bytes long")
    blocks = separators.scan_blocks(files, block_bytes=1000)
    assert blocks.count() == 200 and blocks.rdd.getNumPartitions() >= 50
    assert "REPARTITION_BY_NUM" in blocks._jdf.queryExecution().toString()
