"""Exact host lists as cascades of Bloom filters, with rules for hosts and paths on top."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import saved

# The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Words between dots or hyphens of a host that put it on the block list.
BLOCK_WORDS = ("ads", "adult", "bets", "casino", "cheap", "pills", "poker", "porn", "spam", "xxx")
HASHES = 4
BITS_A_KEY = 8
# Keys of one level; where the list, or what it lets through of the other keys, is longer, the keys are cut by
# hash into several cascades, used one after the other.
KEYS_A_CASCADE = 4_000_000
# Share of the other keys that a level of these sizes lets through, at most.
LET_THROUGH = 0.05
BLOCK_BITS = 32768


def _letters_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: on up to ``? #``. Without ``://`` both are empty."""
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.coalesce(F.instr(F.col(f"`{url}`"), "://") > 0, F.lit(False))
    host = F.when(has, _letters_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")
    return host, F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _positions(key: str, level: int, blocks: int) -> list[tuple[Column, Column]]:
    """(block, bit) of every hash; the bits of one key all lie in one block."""
    block = F.pmod(F.xxhash64(F.lit(f"block {level}"), key), F.lit(blocks))
    return [(block, F.pmod(F.xxhash64(F.lit(f"bit {level} {k}"), key), F.lit(BLOCK_BITS))) for k in range(HASHES)]


class Bloom:
    """One level: ``blocks`` bitmaps of 4 KB, kept as one byte string."""

    def __init__(self, level: int, bits: bytes):
        self.level, self.bits = level, bits

    @classmethod
    def of(cls, keys: DataFrame, level: int, count: int, bits_a_key: int) -> Bloom:
        blocks = -(-count * bits_a_key // BLOCK_BITS)
        # A key's positions as one array, so that its hashes stay in one expression.
        at = F.array(*[F.struct(b.alias("block"), p.alias("bit")) for b, p in _positions("key", level, blocks)])
        made = (keys.select(F.explode(at).alias("at")).groupBy("at.block")
                .agg(F.bitmap_construct_agg(F.col("at.bit")).alias("bitmap")).collect())
        bits = bytearray(blocks * BLOCK_BITS // 8)
        for block, bitmap in made:
            bits[block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8] = bitmap
        return cls(level, bytes(bits))

    def has(self, key: str) -> Column:
        size = len(self.bits) * 8
        found = F.lit(True)
        for block, bit in _positions(key, self.level, size // BLOCK_BITS):
            at = block * (BLOCK_BITS // 8) + F.shiftright(bit, 3)
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (F.bit_get(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
        return found


def cascade(universe: DataFrame, bits_a_key: int | None = None) -> list[Bloom]:
    """Filters that tell the listed from the other keys of ``universe(key, listed)``, of distinct keys.

    The first holds the listed keys, the second the other keys that the first
    lets through, the third the listed keys that the second lets through, and
    so on until nothing wrong is left.
    """
    levels: list[Bloom] = []
    inside = F.lit(True)
    while True:
        encoded = universe.where(inside & (F.col("listed") == F.lit(len(levels) % 2 == 0)))
        count = encoded.count()
        if count == 0:
            return levels
        levels.append(Bloom.of(encoded, len(levels), count, bits_a_key or BITS_A_KEY))
        # Keys of the other side that the new filter lets through go to the next one; every set encoded before passes it too.
        inside = F.lit(True)
        for level in levels:
            inside = inside & level.has("key")


def is_listed(levels: Sequence[Bloom], key: str) -> Column:
    """Exact membership of a key of the universe, by the depth of the first filter that rejects it."""
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        found = F.when(~level.has(key), F.lit(level.level % 2 == 1)).otherwise(found)
    return found


def listed_rows(rows: DataFrame, key: str, listed: Column, keys_a_cascade: int = KEYS_A_CASCADE) -> DataFrame:
    """``rows`` with ``listed``: whether ``listed`` holds for the row's ``key``, decided by cascades alone.

    ``listed`` is an expression over the column ``key`` of the distinct keys of
    ``rows``, which are the complete universe. The rows are not joined with
    anything: each row asks the filters, whose bytes are part of the plan. The
    first level of a cascade holds its listed keys, the second the few per cent
    of all other keys that the first lets through; both are bounded by
    ``keys_a_cascade``, as the keys are cut by hash into as many cascades as the
    longer of them needs. The rows of each part are then taken in turn.
    """
    universe = saved(rows.select(F.col(f"`{key}`").alias("key")).distinct().withColumn("listed", F.coalesce(listed, F.lit(False))),
                     "key-universe")
    inside, every = universe.agg(F.count_if("listed"), F.count(F.lit(1))).first()
    longest = max(inside, math.ceil(LET_THROUGH * (every - inside)))
    parts = max(1, -(-longest // keys_a_cascade))
    out = None
    for part in range(parts):
        def mine(name):
            return F.pmod(F.xxhash64(F.lit("part"), name), F.lit(parts)) == part
        levels = cascade(universe.where(mine("key")) if parts > 1 else universe)
        some = (rows.where(mine(key)) if parts > 1 else rows).withColumn("listed", is_listed(levels, key))
        out = some if out is None else out.unionByName(some)
    return out


def block_words(key: str = "key", words: Sequence[str] = BLOCK_WORDS) -> Column:
    return F.arrays_overlap(F.split(key, "[.-]"), F.array(*map(F.lit, words)))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Column | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    The longest rule that fits decides; without one the host is blocked if the
    list has it. ``listed`` says over the column ``key`` which hosts are on the
    list. A null url or one without ``://`` has an empty host and path, which
    no rule fits. Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = listed_rows(parsed, "host", block_words() if listed is None else listed)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for says, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == at) | F.endswith("host", F.lit("." + at))) & F.startswith("path", F.lit(below))
        rule = F.when(fits, at + below).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
