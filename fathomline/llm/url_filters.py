"""URL rules and an exact block list held as a cascade of Bloom filters. DataFrame functions only.

Level 0 holds the listed keys. The keys of the corpus that it takes for listed by mistake go into
level 1, the listed keys that level 1 takes for mistakes go into level 2, and so on until a level
makes no mistake. As every key of the corpus was tried while building, each gets its true answer:
the first level that lacks a key decides, an even one says "not listed", an odd one "listed".
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.session import settle

# Bits of all levels together that may be sent to every task.
MOST_BITS = 1 << 25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits.

    A rule is (verdict, ``host/path``). It fits its host and all subdomains where the path starts
    with the rule's. Of rules equally long the first one given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(i), key), F.lit(bits).cast("long")) for i in range(hashes)]


def _holds(key: Column, number: int, level: Level) -> Column:
    """Whether a level takes the key for one of its own."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    held = F.lit(True)
    for place in _places(key, number, level.bits, level.hashes):
        word = F.get(words, F.floor(place / 64).cast("int"))
        held = held & (F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return held


def _size(inside: int, outside: int, first: bool) -> tuple[int, int]:
    """Bits and hashes of a level: the first one trades its size against its mistakes, others let half pass."""
    rate = min(0.5, max(1e-9, inside * math.sqrt(0.5) / max(outside, 1))) if first else 0.5
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(inside * hashes / math.log(2) / 64) * 64), hashes


def build_cascade(keys: DataFrame, key: str, listed: str, most_bits: int = MOST_BITS) -> list[Level] | None:
    """Levels for a table of keys with a boolean column ``listed``; None where they would exceed ``most_bits``.

    A key that is listed in any row is listed. Null keys are in no list. The driver holds the bits of
    the levels, at most ``most_bits`` of them, never keys.
    """
    known = settle(
        keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
        .agg(F.coalesce(F.max(listed), F.lit(False)).alias("inside"))
    )
    levels: list[Level] = []
    inside, outside = known.where("inside").select("key"), known.where("not inside").select("key")
    n, others = inside.count(), outside.count()
    used = 0
    while n:
        bits, hashes = _size(n, others, not levels)
        used += bits
        if used > most_bits:
            return None
        number = len(levels)
        places = F.explode(F.array(*_places(F.col("key"), number, bits, hashes)))
        rows = (
            inside.select(places.alias("place"))
            .groupBy(F.floor(F.col("place") / 64).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("mask")).collect()
        )
        words = [0] * (bits // 64)
        for row in rows:
            words[row["word"]] = row["mask"]
        levels.append(Level(bits, hashes, tuple(words)))
        mistakes = outside.where(_holds(F.col("key"), number, levels[-1]))
        inside, outside = mistakes, inside
        n, others = inside.count(), n
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Membership of a key of the corpus; false for null. Keys never seen while building may get either answer."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        answer = F.when(_holds(key, number, levels[number]), answer).otherwise(F.lit(number % 2 == 1))
    return F.coalesce(answer, F.lit(False))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], listed: Column, *, key: str = "host",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed`` is a condition over ``host`` and ``path`` that tells which keys the list names; it is
    asked once for each distinct key, while the cascade is built. ``key`` is ``host`` or ``path``. A
    fitting rule decides; without one a listed key is blocked and all else allowed. Rows are judged one
    by one: repeated rows stay, a null URL has an empty host and is allowed, an empty table gives an
    empty one. Extra columns are ignored. A list beyond ``most_bits`` is looked up by a join instead.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = parsed.where(F.col(key) != "").select("host", "path").distinct().select(key, listed.alias("listed"))
    levels = build_cascade(keys, key, "listed", most_bits)
    if levels is None:
        marked = keys.groupBy(key).agg(F.max("listed").alias("on_list")).where("on_list")
        parsed = parsed.join(marked, key, "left")
        blocked = F.coalesce(F.col("on_list"), F.lit(False))
    else:
        blocked = is_listed(F.col(key), levels)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(blocked, "block").otherwise("allow")
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
