"""URL rules by Bloom filter cascades: exact membership over all keys of the corpus, in plain column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Bits that all levels of one cascade may have together; they travel in the query plan.
MAX_BITS = 1 << 22


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = [F.getbit(F.get(words, F.shiftright(p, 5).cast("int")), p.bitwiseAND(F.lit(31)).cast("int")) == 1 for p in self.positions(key)]
        return reduce(lambda a, b: a & b, tests)


@dataclass
class Cascade:
    """Levels 0, 2, ... encode listed keys, levels 1, 3, ... the false positives of the level before."""

    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over; a null key is not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.holds(key), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False)) if self.levels else F.lit(False)


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    hashes = max(1, min(16, round(-math.log2(rate))))
    bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is over the bound of {MAX_BITS}")
    level = Level(bits, hashes, seed, [0] * (bits // 32 + 1))
    set_bits = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    by_word = set_bits.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    for row in by_word.collect():
        level.words[row["word"]] = row["bits"]
    return level


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade that tells the keys of ``listed(key)`` from all others of ``universe(key)``.

    Level 0 gets a false-positive rate of about sqrt(1/2) * listed / universe, later levels 1/2, so each has about half
    the keys of the one before. The universe is scanned for level 0 only; what that lets through is a small table. Nulls
    and repeats do not count; an empty list gives a cascade without levels.
    """
    listed = materialize(listed.filter("key is not null").select("key").distinct(), "listed")
    universe = universe.filter("key is not null").select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    others = max(1, universe.count() - n)
    rate = min(0.5, max(1e-4, math.sqrt(0.5) * n / others))
    levels = [_level(listed, n, rate, 0)]
    inside, outside = listed, materialize(universe.filter(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti"), "false-positives")
    while count := outside.count():
        if len(levels) > 60 or sum(x.bits for x in levels) > MAX_BITS:
            raise RuntimeError("the cascade does not end within its bounds")
        levels.append(_level(outside, count, 0.5, len(levels)))
        inside, outside = outside, materialize(inside.filter(levels[-1].holds(F.col("key"))), "false-positives")
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path from there up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_keys(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """All keys (host suffix + path prefix) of a url that a rule could equal: suffixes at dots of as many labels, and
    prefixes of as many characters, as some rule has."""
    split = [r.partition("/") for r, _ in rules]
    labels = sorted({h.count(".") + 1 for h, _, _ in split})
    lengths = sorted({len(s + p) for _, s, p in split})
    parts = F.split(host, r"\.")
    hosts = [F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels]
    paths = [F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths]
    return F.array_compact(F.array(*[F.concat(h, p) for h in hosts for p in paths]))


def _hits(cascade: Cascade, action: str) -> Column:
    """The row's keys that the cascade lists, with their lengths."""
    found = F.filter("keys", lambda key: cascade.contains(key))
    return F.transform(found, lambda key: F.struct(F.length(key).alias("size"), key.alias("rule"), F.lit(action).alias("verdict")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    ``rules`` are (host and path, action) with action allow or block, e.g. ("example.com/en/", "block"). A rule fits its
    host and all subdomains if the path starts with the rule's; the longest fitting one decides. A url in neither
    cascade, a null url and one without ``://`` (host and path empty) get ``otherwise``: they are not listed.

    Each action's rules make one cascade over the keys of all urls; a row then tests its own few keys with hashes and
    constant bit arrays, inside generated code and without a join or shuffle. Rows repeat as in the input.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", rule_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    hits = []
    for action in sorted({a for _, a in rules}):
        listed = pages.sparkSession.createDataFrame([(r,) for r, a in rules if a == action], "key string")
        hits.append(_hits(build_cascade(listed, universe), action))
    best = F.array_max(F.concat(*hits)) if hits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return keyed.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
