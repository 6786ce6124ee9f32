"""Line dedup against a brute-force version."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fathomline.llm import lines


def expected(rows):
    """(n_lines, n_dropped, digest) of every (doc_id, text)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or key(x) not in holders or i == min(holders[key(x)])]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


LONG = "\n".join(f"line number {k % 700} of a long text" for k in range(30_000))
ROWS = [
    (5, "The same line here\nown line of five\n\n short"), (3, "  the SAME line here\t\nshort\nThe same line here"), (9, "THE SAME LINE HERE"),
    (9, "the same line here\nanother text of nine"), (9, "the same line here\nanother text of nine"), (None, "The same line here\nno id at all"),
    (None, None), (1, None), (2, ""), (4, "\n\n"), (7, "ninechars\n" * 3 + "ÄÖÜäöüß漢字x"), (8, "ninechars\nÄÖÜäöüß漢字X\nÄÖÜäöüß漢字x\r\n the same line here"),
    (11, LONG), (12, LONG + "\nline number 3 of a long text"), (10, "line number 3 of a long text"),
    *((100 + k, f"a very frequent line\nunique line {k} as it is\na very frequent line") for k in range(300)),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_digest(spark, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"doc": F.lit(1), "keep": F.lit("x"), "h1": F.lit(2)}).repartition(parts)
    own = [tuple(r) for r in lines.line_digest(docs).collect()]
    assert sorted(own, key=str) == sorted((x[:4] for x in expected(ROWS)), key=str)


def test_bitmaps_and_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("own_0", F.lit(3))
    found = {(r["doc"], r["n_lines"], r["n_dropped"]): lines.kept_bits(r["keep"], r["n_lines"]) for r in lines.keep_bitmaps(docs).collect()}
    assert found[(5, 4, 1)].tolist() == [False, True, True, True]
    assert all(n - bits.sum() == gone for (_, n, gone), bits in found.items())
    assert {k[:3] for k in found} == {x[:3] for x in expected(ROWS) if x[2]}
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted(((x[0], x[4]) for x in expected(ROWS)), key=str)
    assert lines.line_digest(docs.limit(0)).count() == 0 and lines.drop_lines(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")
    assert lines.drop_lines(one).collect()[0]["text"] == "alone in the table"


def test_a_hash_over_many_partitions():
    """A partition that holds one hash only leaves all to the rows of first documents."""
    import pyarrow as pa

    def part(rows):
        return [lines.batch(list(zip(*rows[at:at + 2])), lines.KEYED) for at in range(0, len(rows), 2)]

    def marks(rows):
        return [tuple(r.values()) for b in lines._stream(iter(part(rows))) for r in pa.Table.from_batches([b]).to_pylist()]

    own = [(1, 1, 4, 0, 0, 1), (1, 1, 6, 0, 0, 1), (1, 1, 6, 0, 1, 2)]
    assert [m for m in marks(own) if m[6] == lines.OPEN] == [(*r, lines.OPEN) for r in own]
    assert [m[:3] for m in marks(own) if m[6] == lines.FIRST] == [(1, 1, 4)] * 2
    more = [*own, (2, 0, 1, 0, 0, 1), (2, 0, 3, 0, 0, 1), (2, 0, 3, 0, 5, 9), (2, 5, 3, 0, 0, 1)]
    assert [m[:3] for m in marks(more) if m[6] == lines.FIRST] == [(1, 1, 4), (2, 5, 3)]
    assert [m[:6] for m in marks(more) if m[6] == lines.DROP] == more[4:6]
