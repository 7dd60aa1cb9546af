"""URL rules held in Bloom filter cascades (operator 6).

A rule is a host and a start of the path; it fits its host and all subdomains.  The keys
of a url are the ends of its host joined with starts of its path, in the shapes (labels
of the host, characters of the path) that the lists have.  A cascade answers exactly for
every key of the corpus and the list: its first filter holds the listed keys, the second
the corpus keys that wrongly pass the first, the third the listed keys that wrongly pass
the second, and so on until nothing passes wrongly.  A page is then judged inside its
row, by hashes and bit tests on a few arrays; no list is joined.

Everything is built-in expressions.  Null urls and urls without ``://`` have an empty host
and path and fit no rule; repeated rows are judged alike; an empty table gives an empty
result; columns other than ``page_id`` and ``url`` are not read.
"""

from dataclasses import dataclass
from functools import reduce
from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorebase.sources.scratch import kept

#: The published rules, (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Hosts that are blocked where no rule fits, whatever the path.
LISTED_HOSTS = [
    f"{name}.example.{end}"
    for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
]

#: Largest array of one filter; a longer list is split by a hash into several cascades,
#: which pages go through one after the other.
MAX_FILTER_BYTES = 32 << 20
_BITS = 64
_FITS = "array<struct<n:int,key:string,verdict:string>>"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    empty = F.lit("")
    return F.coalesce(F.translate(host, upper, upper.lower()), empty), F.coalesce(path, empty)


def listed(spark: SparkSession, rules) -> DataFrame:
    """``verdict, host, path`` of a list given as rows."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels, path characters); as few as the list has kinds of keys."""
    rows = rules.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("m")).distinct().collect()
    return sorted((r["k"], r["m"]) for r in rows)


def keys(host: Column, path: Column, shapes) -> list[Column]:
    """The key of a url in each shape; null where it has too few labels or characters."""
    labels = F.size(F.split(host, r"\."))
    return [
        F.when((labels >= k) & (F.length(path) >= m) & (host != ""), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, m)))
        for k, m in shapes
    ]


@dataclass
class Level:
    bits: int
    hashes: int
    words: Column  # a subquery: one array of 64-bit words

    def passes(self, key: Column, number: int) -> Column:
        places = [F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]
        word = lambda p: F.get(self.words, (p / _BITS).cast("int"))
        return reduce(lambda a, b: a & b, [F.getbit(word(p), (p % _BITS).cast("int")) == 1 for p in places])


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the list and of the universe the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[number - 1].passes(key, number), answer).otherwise(F.lit(number % 2 == 0))
        return key.isNotNull() & F.coalesce(answer, F.lit(False))


def _level(inside: DataFrame, n: int, rate: float, number: int) -> Level:
    hashes = max(1, ceil(log2(1 / rate)))
    bits = _BITS * ceil(max(1, n) * hashes * 1.45 / _BITS)
    place = F.explode(F.array(*(F.pmod(F.xxhash64("key", F.lit(number), F.lit(j)), F.lit(bits)) for j in range(hashes))))
    one = inside.select(place.alias("p")).select((F.col("p") / _BITS).cast("long").alias("id"), F.expr(f"shiftleft(1L, cast(p % {_BITS} as int))").alias("word"))
    none = inside.sparkSession.range(bits // _BITS).select("id", F.lit(0).cast("long").alias("word"))
    words = one.unionByName(none).groupBy("id").agg(F.bit_or("word").alias("word"))
    whole = kept(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words")), "bloom")
    return Level(bits, hashes, whole.scalar())


def cascade(inside: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for the distinct keys of ``inside`` against those of ``universe``."""
    inside = kept(inside.filter("key is not null").select("key").distinct(), "listed")
    outside = kept(universe.filter("key is not null").select("key").distinct().join(inside, "key", "left_anti"), "unlisted")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    if not n_in:
        return Cascade(levels)
    rate = min(0.5, n_in / (sqrt(2) * max(1, n_out)))
    while n_in:
        number = len(levels) + 1
        level = _level(inside, n_in, rate, number)
        levels.append(level)
        wrong = kept(outside.filter(level.passes(F.col("key"), number)), "passing")
        inside, outside = wrong, inside
        n_in, rate = wrong.count(), 0.5
    return Cascade(levels)


def _split(inside: DataFrame, universe: DataFrame) -> list[tuple[Cascade, int, int]]:
    """Cascades of bounded size: (cascade, shard, shards)."""
    n, n_out = inside.count(), universe.count()
    per_key = 1.45 * max(1, ceil(log2(sqrt(2) * max(1, n_out) / max(1, n)))) / 8 if n else 0
    shards = max(1, ceil(n * per_key / MAX_FILTER_BYTES))
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards))
    return [(cascade(inside.filter(part == s), universe.filter(part == s)), s, shards) for s in range(shards)]


def judge(pages: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``rules`` and ``hosts`` have ``verdict, host, path``; the longest fitting rule decides,
    then whether a listed host fits (block), else allow.
    """
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = {"rule": _shapes(rules), "host": _shapes(hosts)}
    found = {name: keys(F.col("host"), F.col("path"), s) for name, s in shapes.items()}
    key = F.concat("host", "path").alias("key")
    lists = {"allow": rules.filter("verdict = 'allow'").select(key), "block": rules.filter("verdict = 'block'").select(key), "listed": hosts.select(key)}

    every = [k for ks in found.values() for k in ks]
    universe = kept(
        out.select(F.explode(F.array(*every) if every else F.array().cast("array<string>")).alias("key")).filter("key is not null").distinct(),
        "keys",
    )
    out = out.withColumn("fits", F.array().cast(_FITS))
    for name, inside in lists.items():
        passes = _split(inside, universe)
        for tree, shard, shards in passes:
            mine = lambda k: (F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(shards)) == shard) & tree.contains(k)  # noqa: B023, E731
            hits = [
                F.when(mine(k), F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(name).alias("verdict")))
                for k in found["host" if name == "listed" else "rule"]
            ]
            if hits:
                out = out.withColumn("fits", F.concat("fits", F.array_compact(F.array(*hits)).cast(_FITS)))
            if len(passes) > 1:
                out = kept(out, "pages")
    ruled = F.array_max(F.filter("fits", lambda x: x["verdict"] != "listed"))
    return out.select(
        "page_id", "host", "path", ruled["key"].alias("rule"),
        F.when(ruled.isNotNull(), ruled["verdict"]).when(F.size("fits") > 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )

