"""Main text of HTML pages: the contiguous run of tokens with the greatest sum.

A page is a line of words and tags. Words score positive, tags negative; both weights come from pages
whose markup names the article. One scan finds the run with the greatest sum, and its words, without
those inside elements that never hold the article's own text, are the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Labelled pages that the weights are fitted on.
LABELLED = 2000
# Score of a tag that is only seen outside articles, in words.
HARD_TAG = 20.0
# Least score of a word.
SOFT_WORD = 0.001

# Words outside a named article that one inside it outweighs.
OUTSIDE = 4.0

# Names of HTML elements and class words, by what they mean here.
NEVER = frozenset("head title script style noscript template svg math nav header footer aside form button select option textarea iframe object video audio canvas dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul nav header footer aside form".split())
LABEL = frozenset(("article", "main"))
JUNK_WORDS = frozenset("ad ads advert adverts advertisement advertisements banner promo promoted sponsor sponsored sidebar cookie cookies consent notice notices comment comments menu navigation navbar breadcrumb breadcrumbs newsletter subscribe popup related share social widget masthead".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Weights:
    """Scores of words by the element and the length of the run they stand in, and of tags by name."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, element: str) -> float:
        return self.words.get(element, 0.5)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)


def _junk(attributes: str) -> bool:
    return any(JUNK_WORDS.intersection(_SPLIT.split((a or b or c).lower())) for a, b, c in _CLASS.findall(attributes))


@dataclass
class Tokens:
    """A page as parallel lists: a text run or a tag at each place."""

    texts: list[str | None] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    labelled: bool = False


def tokens(page: str) -> Tokens:
    """Text runs and tags in page order. Unclosed, stray and cut-off tags are taken as browsers do, roughly."""
    out = Tokens()
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, inside the label
    at = 0

    def put(text: str | None, name: str) -> None:
        _, dropped, inside = stack[-1] if stack else ("", False, False)
        out.texts.append(text)
        out.names.append(name)
        out.dropped.append(dropped)
        out.inside.append(inside)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            put(page[at:stop], stack[-1][0] if stack else "")
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                put(entities.escape(m[0][9:].removesuffix("]]>")), stack[-1][0] if stack else "")
            continue
        if m[1]:
            if name not in VOID and any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    stack.pop()
                put(None, "/" + name)
                stack.pop()
            else:
                put(None, "/" + name)
            continue
        if name == "p" or name in BLOCKS:  # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name == "li" and any(x[0] == "li" for x in stack):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol"):
                    break
                if stack[k][0] == "li":
                    del stack[k:]
                    break
        _, dropped, inside = stack[-1] if stack else ("", False, False)
        label = name in LABEL
        out.labelled |= label
        if name not in VOID and not m[3].rstrip().endswith("/"):
            whole = name in ("html", "body", "article", "main")
            kept = name not in NEVER and (whole or not _junk(m[3]))
            stack.append((name, dropped or not kept, inside or label))
        put(None, name)
        if name in RAW and stack and stack[-1][0] == name:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            stack.pop()
    return out


def _kinds(t: Tokens) -> list[str | None]:
    """The name that scores each place: of words their element and the binary digits of their number, of a tag its own name.

    An element whose words are dropped is one tag, with "!" after its name, however many it holds; the
    others of its tags and its words have None.
    """
    before = [False, *t.dropped[:-1]]
    return [
        (None if b or x is not None else n + "!") if d else n if x is None else f"{n}#{len(x.split()).bit_length()}"
        for x, n, d, b in zip(t.texts, t.names, t.dropped, before)
    ]


def _trust(t: Tokens, sizes: list[int]) -> float:
    """How far the page's own label can be trusted, 0.5 without one.

    It is the share of the page's words inside it, where one of them counts as ``OUTSIDE`` others: a page that
    is nearly all article outweighs what stands around it, a teaser card does not.
    """
    within = OUTSIDE * sum(n for n, i in zip(sizes, t.inside) if i)
    outside = sum(n for n, i in zip(sizes, t.inside) if not i)
    return within / (within + outside) if t.labelled and within + outside else 0.5


def _sizes(t: Tokens) -> list[int]:
    """Words of each text run that is not dropped."""
    return [0 if x is None or d else len(x.split()) for x, d in zip(t.texts, t.dropped)]


def _scores(t: Tokens, weights: Weights) -> np.ndarray:
    """Score of each place by the learnt weights and the trust in the page's own label."""
    kinds, sizes = _kinds(t), _sizes(t)
    trust = _trust(t, sizes)
    more = max(trust, 1 - trust)
    out = np.zeros(len(kinds))
    for k, (kind, text, size, inside) in enumerate(zip(kinds, t.texts, sizes, t.inside)):
        if kind is None:
            continue
        if text is None:
            out[k] = min(-SOFT_WORD, weights.tag(kind) * (1 - trust if inside else 1.0))
        elif size:
            out[k] = max(SOFT_WORD, weights.word(kind) * (trust if inside or not t.labelled else 1 - trust) / more) * size
    return out


def count_labels(page: str) -> dict[tuple[str, str], list[int]]:
    """Words by element and tags by name, inside and outside the labelled article of one page.

    Labels that are not trusted, as those of teaser cards, teach nothing.
    """
    t = tokens(page)
    seen: dict[tuple[str, str], list[int]] = {}
    if not t.labelled or _trust(t, _sizes(t)) < 0.5:
        return seen
    for text, name, inside in zip(t.texts, _kinds(t), t.inside):
        if name is None:
            continue
        kind, n = ("tag", 1) if text is None else ("word", len(text.split()))
        seen.setdefault((kind, name), [0, 0])[0 if inside else 1] += n
    return seen


def learn_weights(pages: DataFrame, labelled: int = LABELLED) -> Weights:
    """Weights from at most ``labelled`` pages with an <article> or <main>, those with the least hash of page_id.

    A word's score is the share of such words that lie inside articles; a tag's is minus its share outside,
    times ``HARD_TAG``.
    """
    # Ids are drawn first, so that no page travels to be drawn.
    ids = (
        pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & F.col("page_id").isNotNull())
        .select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(labelled)
    )
    drawn = pages.sparkSession.createDataFrame([tuple(r) for r in ids.collect()], ids.schema)
    sample = pages.select("page_id", "html").join(F.broadcast(drawn), "page_id", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            for page in b.column("html").to_pylist():
                for key, (x, y) in count_labels(page).items():
                    have = total.setdefault(key, [0, 0])
                    have[0] += x
                    have[1] += y
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([k for k, _ in total], pa.string()), "name": pa.array([n for _, n in total], pa.string()),
            "inside": pa.array([v[0] for v in total.values()], pa.int64()), "outside": pa.array([v[1] for v in total.values()], pa.int64()),
        })

    found = sample.mapInArrow(run, "kind string, name string, inside long, outside long").groupBy("kind", "name").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")
    ).collect()
    out = Weights()
    for r in found:
        share = (r["outside"] + 0.01) / (r["inside"] + r["outside"] + 0.02)
        if r["kind"] == "word":
            out.words[r["name"]] = max(SOFT_WORD, 1 - share)
        else:
            out.tags[r["name"]] = -max(SOFT_WORD, HARD_TAG * share)
    return out


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum; of equals the earliest, then the longest."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    total = np.concatenate(([0.0], np.cumsum(scores)))
    least = np.minimum.accumulate(total)[:-1]
    gain = total[1:] - least
    end = int(np.argmax(gain)) + 1
    start = int(np.argmin(total[:end]))
    return start, end


def extract(page: str | None, weights: Weights) -> str:
    """Main text of one page: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    t = tokens(page)
    start, end = best_run(_scores(t, weights))
    blocks: list[str] = []
    piece: list[str] = []

    def close() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            blocks.append(text)

    for text, name, dropped in zip(t.texts[start:end], t.names[start:end], t.dropped[start:end]):
        if text is not None:
            if not dropped:
                piece.append(entities.unescape(text))
        elif name.lstrip("/") in BLOCKS:
            close()
        elif name == "br":
            piece.append(" ")
    close()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Weights are learnt from the pages themselves unless given. A null or empty page has an empty text;
    rows are judged one by one, so repeated rows stay; an empty table gives none; extra columns are
    ignored.
    """
    known = weights or learn_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = [extract(page.as_py(), known) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
