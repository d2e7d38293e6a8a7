"""URL filter: host and path rules, then a Bloom filter cascade over registered names.

The cascade holds a set of listed keys S within a universe U (every key of the corpus). Level 1 is a
Bloom filter of S, level 2 one of the keys of U - S that level 1 passes, level 3 one of the keys of S
that level 2 passes, and so on, until nothing passes wrongly. For a key of U, the number of levels it
passes before its first miss is odd exactly if it is listed: membership is exact, without a join.

Everything is SQL functions: keys are hashed with ``xxhash64``, bits are gathered with ``bit_or`` by
word, and a lookup reads one word of an array literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import apart, keep, scratch_dir, table

#: (action, host and path prefix) of the production rules.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Listed names of the production query: each is blocked with all its subdomains.
BLOCKLIST = [f"{name}.example.{tld}" for name in ("adult-x", "casino-win", "cheap-pills", "free-bets") for tld in ("com", "net", "org")]
#: Bits of all levels together that may be sent with the plan (16 MB); above it the lookup is a join.
MAX_BITS = 1 << 27
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls. Equal lengths: the first listed."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def suffix_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more: ``a.b.c`` has ``a.b.c`` and ``b.c``."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


@dataclass
class Cascade:
    """Levels of (bits, hashes, words); ``hit`` is the exact membership of a key of the universe."""

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)

    @staticmethod
    def bit(key: Column, level: int, k: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level * 16 + k)), F.lit(bits))

    def passes(self, key: Column, level: int) -> Column:
        bits, hashes, words = self.levels[level]
        array = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")
        out = F.lit(True)
        for k in range(hashes):
            b = self.bit(key, level, k, bits)
            word = F.get(array, F.shiftright(b, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    def hit(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # past the last level
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out

    @property
    def bits(self) -> int:
        return sum(b for b, _, _ in self.levels)


def _level(keys: DataFrame, level: int, bits: int, hashes: int) -> list[int]:
    """The words of a Bloom filter of ``keys``: one row for each word and task is shuffled."""
    b = F.explode(F.array(*[Cascade.bit(F.col("key"), level, k, bits) for k in range(hashes)])).alias("b")
    one = F.expr("shiftleft(1L, cast(b % 64 as int))")
    rows = keys.select(b).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("v")).collect()
    words = [0] * (bits // 64)
    for w, v in rows:
        words[w] = v
    return words


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """``universe``: distinct (key string, listed boolean), read once for each level.

    The first level's false-positive rate is |S| / |U - S|, so that every level's size is in
    proportion to |S| (times log |U| / |S|). None if that is over ``max_bits``; no keys: no levels.
    """
    listed, others = (universe.where(F.col("listed")).select("key"), universe.where(~F.col("listed")).select("key"))
    n, m = listed.count(), others.count()
    out, level = Cascade(), 0
    while n:
        rate = max(min(n / max(m, 1), 0.5), 1e-6) if level == 0 else 0.5
        bits = max(64, -(-int(n * -math.log(rate) / math.log(2) ** 2 + 1) // 64) * 64)
        if out.bits + bits > max_bits:
            return None
        hashes = max(1, min(8, round(bits / n * math.log(2))))
        out.levels.append((bits, hashes, _level(listed, level, bits, hashes)))
        others = others.where(out.passes(F.col("key"), level))
        if level >= 40:
            raise ValueError("the cascade does not end: are there equal keys on both sides?")
        listed, others, n, m, level = others, listed, others.count(), n, level + 1
    return out


@apart(["host", "path", "rule", "verdict"], fixed=("url",))
def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocklist: DataFrame | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` (with ``url``) and host, path, rule, verdict (allow or block).

    A url that no rule fits is blocked if its host or a parent domain is listed. Null urls and urls
    without ``://`` have an empty host and path, no rule, and are allowed. Rows are kept as they are,
    repeated or not; columns of these four names are replaced.
    """
    spark = pages.sparkSession
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    where = scratch_dir(spark)
    names = blocklist if blocklist is not None else default_blocklist(spark)
    names = keep(names.select(F.translate("key", _UPPER, _LOWER).alias("key")).where("key is not null").distinct(), where, "listed")
    corpus = pages.select(host.alias("host")).distinct().select(F.explode(suffix_keys(F.col("host"))).alias("key"))
    marked = corpus.select("key", F.lit(False).alias("listed")).unionByName(names.select("key", F.lit(True).alias("listed")))
    universe = keep(marked.groupBy("key").agg(F.max("listed").alias("listed")), where, "universe")
    cascade = build_cascade(universe, max_bits)
    out = pages.withColumns({"host": host, "path": path})
    if cascade is not None:
        out = out.withColumn("_listed", F.exists(suffix_keys(F.col("host")), cascade.hit))
    else:  # too large to send with the plan: the hosts that have a listed key, by join
        hosts = out.select("host").distinct().select("host", F.explode(suffix_keys(F.col("host"))).alias("key"))
        bad = keep(hosts.join(names, "key", "left_semi").select("host").distinct(), where, "bad")
        out = out.join(bad.withColumn("_found", F.lit(True)), "host", "left").withColumn("_listed", F.coalesce("_found", F.lit(False))).drop("_found")
    rule, action = first_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(action, method)}).drop("_listed")


def default_blocklist(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKLIST))).alias("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_LISTED = ", ".join(f"'{x}'" for x in BLOCKLIST)
SQL = f"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
names as (select unnest([{_LISTED}]) as name),
r as (
  select u.*, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from u)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when exists (select 1 from names where host = name or ends_with(host, '.' || name)) then 'block' else 'allow' end as verdict
from r
"""
