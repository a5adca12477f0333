"""URL filtering with a Bloom filter cascade (DataFrame functions only).

Two rule lists (block, allow) are each stored as a cascade over the corpus's
complete key universe. Level 1 encodes the listed keys. Level 2 encodes the
keys of the universe that level 1 lets through although they are not listed,
level 3 the listed keys that level 2 lets through, and so on until a level
lets nothing wrong through. A key of the universe is listed exactly if the
number of leading levels that contain it is odd, so applying the rules needs
no join and no look-up table, only a few bit tests per key.

A key is (host suffix, path prefix). Only suffixes of as many labels, and
prefixes of as many characters, as some rule has can match, so the universe
of a url is labels x prefix lengths; it does not grow with the url's length.

Sizes: a level's bits are ``BITS_PER_KEY`` times its keys. Level 1 grows with
the rule list only; the next ones with the false positives, a fixed share of
the distinct keys. All levels together are travelling literals, so their size
is checked (``MAX_BITS``); a larger list is split by the caller.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; repeated rows are judged alike; an empty table gives an empty
table; no rules at all means ``default`` everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, run_folder, written

BITS_PER_KEY, PROBES = 16, 5
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    words: list[int]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.char_length(host) + 1)


def candidates(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Array of the keys of a url that a rule of these shapes can have: struct(chars, labels, key)."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    found = []
    for labels, chars in shapes:
        suffix, prefix = F.substring_index(host, ".", -labels), F.substr(path, F.lit(1), F.lit(chars))
        fits = (F.size(F.split(host, r"\.")) >= labels) & (F.char_length(prefix) == chars)
        found.append(F.when(fits, F.struct(F.char_length(F.concat(suffix, prefix)).alias("chars"),
                                           F.lit(labels).alias("labels"), F.concat(suffix, prefix).alias("key"))))
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def bit_places(key: Column, salt: int, bits: int) -> list[Column]:
    """The bits of a key on one level, by double hashing."""
    h = F.xxhash64(F.lit(salt), key)
    a, b = h.bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1).cast("long"))
    return [(a + F.lit(i).cast("long") * b) % bits for i in range(PROBES)]


def build_level(keys: DataFrame, salt: int) -> Level | None:
    """Encode the column ``key`` of a table; None for an empty one."""
    n = keys.count()
    if n == 0:
        return None
    bits = max(64, BITS_PER_KEY * n)
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits; split the rule list")
    places = keys.select(F.explode(F.array(*bit_places(F.col("key"), salt, bits))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 63).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 63).cast("int"))).alias("v")).collect()
    out = [0] * (bits // 63 + 1)
    for r in words:  # at most MAX_BITS / 63 words
        out[r["w"]] = r["v"]
    return Level(salt, bits, out)


def passes(level: Level, key: Column) -> Column:
    # one text that the optimizer folds to an array literal
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    hits = [F.call_function("shiftright", F.get(words, F.floor(p / 63).cast("int")), (p % 63).cast("int")).bitwiseAND(1) == 1
            for p in bit_places(key, level.salt, level.bits)]
    return reduce(lambda x, y: x & y, hits)


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int) -> list[Level]:
    """``listed`` and ``universe`` have a column key. The universe must hold every key that will be asked for."""
    levels: list[Level] = []
    spark = universe.sparkSession
    inside = listed.join(universe, "key", "left_semi").distinct()
    outside: DataFrame | None = None
    own = inside
    while (level := build_level(own, salt + len(levels))) is not None:
        levels.append(level)
        if len(levels) % 2:  # what this level wrongly lets through
            if outside is None:
                through = universe.where(passes(level, F.col("key"))).distinct()
                outside = through.join(inside, "key", "left_anti")
            else:
                outside = outside.where(passes(level, F.col("key")))
            outside = own = written(outside, run_folder(spark, "cascade"))
        else:
            inside = own = written(inside.where(passes(level, F.col("key"))), run_folder(spark, "cascade"))
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe: an odd number of leading levels contain it."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(passes(level, key), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """Add host, path, rule (the longest that fits, else null) and verdict to (page_id, url)."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keyed = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), rules))
    universe = written(keyed.select(F.explode("keys.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")),
                       run_folder(spark, "cascade")).select("key")
    by = {}
    for i, verdict in enumerate(("block", "allow")):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.verdict == verdict], "key string")
        by[verdict] = build_cascade(listed, universe, 1000 * (i + 1))

    def verdict_of(k: Column) -> Column:
        return (F.when(contains(by["allow"], k["key"]), F.lit("allow"))
                .when(contains(by["block"], k["key"]), F.lit("block")))

    ruled = F.array_max(F.filter(F.transform("keys", lambda k: F.struct(
        k["chars"], k["labels"], k["key"].alias("key"), verdict_of(k).alias("verdict"))),
        lambda k: k["verdict"].isNotNull()))
    return keyed.withColumn("best", ruled).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages, RULES)


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM r),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM p),
rules(verdict, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT s.page_id, s.host, s.path, h || pre AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC NULLS LAST) AS i
      FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE i = 1
"""
