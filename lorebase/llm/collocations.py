"""Collocations of two to four words by direct-address tiles (operator 13).

1. Words are counted per language, and the frequent ones get ids by rank of frequency: each part of
   the dictionary ranks its own, and the ids of the parts interleave.
2. A phrase of two words is a pair of ids.  Pairs fall into tiles of ``TILE`` by ``TILE`` ids.  The
   pairs of a tile that many occurrences fall into are counted by address, with one dense
   ``bincount``; the rest is sorted and counted as coordinates.  Buckets of documents count their own
   first, and parts of the dictionary add up what the buckets send, tiles spread over parts.
3. Frequent pairs are ranked again and get ids themselves.  A phrase of three words is then a pair of such an
   id and a word's, one of four words a pair with the id of three.  Only phrases whose two shorter
   phrases are frequent are counted, so nothing frequent is missed.
4. Each phrase is reported once, by one of the buckets that have it, with the frequencies of its
   parts.  Scores, the test against longer phrases, and the ranks are made on Spark.

A-Z are read in lower case; texts fall into pieces at ``.,;:!?`` and at line ends, pieces into words at
spaces and tabs, and phrases stay within a piece.  Null and empty texts have no words; a null ``lang`` is
``und``; repeated rows count each; an empty table gives an empty result; columns other than ``doc_id``
(which only spreads the rows), ``text`` and ``lang`` are not read.  Words are compared as 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lorebase.llm.buckets import BYTE, ODD, ROW_SQL, Bucket, held, mixed, runs, table_of
from lorebase.sources.scratch import kept

LEAST, WORDS, TOP = 30, 4, 2000
#: A longer phrase replaces one of which it holds this share, in hundredths.
HELD = 80
#: Ids a side of a tile, in bits, and the occurrences a cell from which a tile is counted by address.
TILE_BITS, DENSE = 7, 0.125
#: Bits of the id of a word; ids of phrases have the rest of 64.
RIGHT_BITS = 28
#: Tiles with numbers below this on both sides may be counted by address.
HOT_TILES = 64
#: Rows that share the choice of the best phrases of a language, before the last choice.
SPREAD = 64
#: Bytes of text of a bucket, and those whose words are found at once.
BUCKET_BYTES, CHUNK = 8 << 20, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_END = np.zeros(256, bool)
_END[[10, 11, 12, 13, *b".,;:!?"]] = True
_BACK = np.uint64(pow(int(ODD[3]), -1, 1 << 64))
_ROUNDS = ["words", "pairs", "triples", "quadruples"]


# ---- tiles


def coded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a pair of ids; pairs of one tile are next to each other."""
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    if len(left) and (int(left.max()) >> (64 - RIGHT_BITS) or int(right.max()) >> RIGHT_BITS):
        raise OverflowError("more frequent phrases than ids")
    bits, low = np.uint64(TILE_BITS), np.uint64((1 << TILE_BITS) - 1)
    tile = ((left >> bits) << np.uint64(RIGHT_BITS - TILE_BITS)) | (right >> bits)
    return (tile << np.uint64(2 * TILE_BITS)) | ((left & low) << bits) | (right & low)


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and their sums."""
    tile = codes >> np.uint64(2 * TILE_BITS)
    row, column = tile >> np.uint64(RIGHT_BITS - TILE_BITS), tile & np.uint64((1 << (RIGHT_BITS - TILE_BITS)) - 1)
    near = np.flatnonzero((row < HOT_TILES) & (column < HOT_TILES))
    number = (row[near] * np.uint64(HOT_TILES) + column[near]).astype(np.int64)
    cells = 1 << (2 * TILE_BITS)
    hot = np.bincount(number, minlength=HOT_TILES * HOT_TILES) >= DENSE * cells
    slot = np.cumsum(hot) - 1
    in_hot = hot[number]
    at = near[in_hot]
    address = slot[number[in_hot]] * cells + (codes[at] & np.uint64(cells - 1)).astype(np.int64)
    dense = np.bincount(address, None if counts is None else counts[at], minlength=int(hot.sum()) * cells).astype(np.int64)
    found = np.flatnonzero(dense)
    numbers = np.flatnonzero(hot)[found // cells].astype(np.uint64)
    tiles = ((numbers // np.uint64(HOT_TILES)) << np.uint64(RIGHT_BITS - TILE_BITS)) | (numbers % np.uint64(HOT_TILES))
    hot_codes = (tiles << np.uint64(2 * TILE_BITS)) | (found % cells).astype(np.uint64)
    rest = np.ones(len(codes), bool)
    rest[at] = False
    cold, sums = _sorted_sums(codes[rest], None if counts is None else counts[rest])
    all_codes, all_sums = np.concatenate([hot_codes, cold]), np.concatenate([dense[found], sums])
    order = np.argsort(all_codes, kind="stable")
    return all_codes[order], all_sums[order]


def _sorted_sums(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates: sorted codes, the counts of equal ones added."""
    if counts is None:
        codes, sums = np.unique(codes, return_counts=True)
        return codes, sums.astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(runs(codes))
    return codes[at], np.add.reduceat(counts, at).astype(np.int64) if len(at) else np.empty(0, np.int64)


# ---- messages


def _packed(*arrays: np.ndarray) -> tuple[bytes, bytes]:
    """Arrays as compressed bytes, and what is needed to read them.

    The lowest bytes of all numbers stand first, then the next ones: high bytes are mostly
    zero and cost little.
    """
    data = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    head = ";".join([str(len(data)), *(f"{a.dtype.str},{len(a)}" for a in arrays)])
    return pa.Codec("zstd", compression_level=6).compress(pa.py_buffer(data), asbytes=True) if data else b"", head.encode()


def _unpacked(a: bytes, b: bytes) -> list[np.ndarray]:
    size, *kinds = b.decode().split(";")
    data, at, out = pa.decompress(a, decompressed_size=int(size), codec="zstd", asbytes=True) if int(size) else b"", 0, []
    for kind in kinds:
        dtype, n = kind.split(",")
        width = np.dtype(dtype).itemsize
        planes = np.frombuffer(data, np.uint8, width * int(n), at).reshape(width, int(n))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += planes.nbytes
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold the largest."""
    most = int(x.max()) if len(x) else 0
    return x.astype("<u1" if most < 256 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _falls(totals: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Totals in the order of the ids, as steps: ids are ranks of frequency, so most steps are none or small."""
    steps = np.diff(totals[np.argsort(ids, kind="stable")], prepend=0)
    return _small(np.where(steps < 0, -2 * steps - 1, 2 * steps))


def _risen(falls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    steps = falls.astype(np.int64)
    out = np.empty(len(steps), np.int64)
    out[np.argsort(ids, kind="stable")] = np.cumsum(np.where(steps % 2, -(steps + 1) // 2, steps // 2))
    return out


def _part_of(codes: np.ndarray, parts: int, level: int) -> np.ndarray:
    """Words by hash; pairs by blocks of cells, so that a tile of frequent words is spread too."""
    place = codes if level == 0 else mixed((codes >> np.uint64(6)) * ODD[1])
    return (((place >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _questions(codes: np.ndarray, counts: np.ndarray, me: int, parts: int, level: int):
    """One message to each part with the codes that it keeps, in order."""
    part = _part_of(codes, parts, level)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            mine = codes[order[a:b]]
            steps = np.diff(mine, prepend=np.uint64(0))
            yield (p, _ROUNDS[level], me, *_packed(_small(steps), _small(counts[order[a:b]])))


def _answered(part: pa.Table, parts: int) -> pa.Table:
    """One part of a dictionary: to each bucket the total, the id, and whether it reports the phrase.

    A reply has a bit for each code, whether it is frequent, and the rest for frequent ones only.
    """
    asked, out = sorted(part.to_pylist(), key=lambda r: r["sender"]), []
    if asked:
        me, level = asked[0]["to"], _ROUNDS.index(asked[0]["kind"])
        codes, counts = [], []
        for r in asked:
            steps, n = _unpacked(r["a"], r["b"])
            codes.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(n.astype(np.int64))
        add = _sorted_sums if level == 0 else tally
        distinct, sums = add(np.concatenate(codes), np.concatenate(counts))
        often = np.flatnonzero(sums >= LEAST)
        often = often[np.argsort(-sums[often], kind="stable")]
        ids, told = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        ids[often] = np.arange(len(often)) * parts + me
        for r, c in zip(asked, codes):
            k = np.searchsorted(distinct, c)
            often = sums[k] >= LEAST
            k = k[often]
            out.append((r["sender"], r["kind"], me, *_packed(np.packbits(often), _falls(sums[k], ids[k]), _small(ids[k]), np.packbits(~told[k]))))
            told[k] = True
    return table_of(out)


class Told:
    """What a bucket knows of its codes: totals (0: infrequent), ids, and which phrases it reports."""

    def __init__(self, n: int):
        self.total, self.id, self.own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)

    def take(self, at: np.ndarray, often, total, ids, own):
        """A reply about the codes at these places."""
        at = at[np.unpackbits(often, count=len(at)).astype(bool)]
        self.total[at], self.id[at], self.own[at] = _risen(total, ids), ids, np.unpackbits(own, count=len(at)).astype(bool)


def _told(answers: pa.Table, codes: np.ndarray, parts: int, level: int) -> Told:
    """What the replies of all parts say about the codes of a bucket."""
    part = _part_of(codes, parts, level)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    out = Told(len(codes))
    for r in answers.filter(pc.equal(answers["kind"], _ROUNDS[level])).to_pylist():
        out.take(order[edges[r["sender"]] : edges[r["sender"] + 1]], *_unpacked(r["a"], r["b"]))
    return out


# ---- buckets of documents


class Words:
    """The words of a bucket in order: where they are, a hash with their language, and which follow one another in a piece."""

    def __init__(self, bucket: Bucket):
        langs = bucket.rows["row_"].combine_chunks().field("lang").to_pylist()
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        of_row = np.array([number[x] for x in langs], np.int64)
        salt = np.array([_text_hash(x) for x in self.langs], np.uint64)
        self.data, ends = bucket.data, bucket.ends
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        found, row = [], 0
        while row < len(ends):  # some rows at a time: their numbers stay in the cache
            last = max(row + 1, int(np.searchsorted(ends, begins[row] + CHUNK, side="right")))
            found.append(self._rows(_LOWER[self.data[begins[row] : ends[last - 1]]], ends[row:last] - begins[row], begins[row], of_row[row:last], salt))
            row = last
        kinds = (np.int64, np.int64, np.int64, bool, np.uint64)
        self.start, self.end, self.lang, self.follows, self.hash = (
            np.concatenate(x) if found else np.empty(0, k) for x, k in zip(zip(*found) if found else [()] * len(kinds), kinds)
        )

    @staticmethod
    def _rows(data, ends, first, lang, salt):
        """For the words of some rows: start, end, language, whether the next word is in the same piece, and hash."""
        if not len(data):
            return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, bool, np.uint64))
        stop = _END[data]
        word = ~(_BLANK[data] | stop)
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        edge[0] = True
        start = np.flatnonzero(word & (np.append(True, ~word[:-1]) | edge[:-1]))
        end = np.flatnonzero(word & (np.append(~word[1:], True) | edge[1:])) + 1
        row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0))
        stops = np.zeros(len(data) + 1, np.int32)
        np.cumsum(stop, out=stops[1:])
        follows = np.zeros(len(start), bool)
        if len(start):
            follows[:-1] = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        # Hash of a slice as a difference of sums over powers, moved back to power 0.
        power = np.full(len(data), ODD[3])
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * power, out=total[1:])
        back = np.full(len(data), _BACK)
        back[0] = 1
        np.cumprod(back, out=back)
        words = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * ODD[4])
        return start + first, end + first, lang[row], follows, mixed(words * ODD[6] + salt[lang[row]])


def _text_hash(text: str) -> int:
    out = 0
    for b in text.encode():
        out = (out * int(ODD[10]) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return out


class Level:
    """Phrases of one length in a bucket: distinct codes, and per word the number of the phrase that starts there (-1: none)."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, n: int, count):
        self.codes, self.counts = count(codes)
        self.of = np.full(n, -1, np.int64)
        coded = pa.array(codes).dictionary_encode()  # only distinct codes are searched
        place = np.searchsorted(self.codes, coded.dictionary.to_numpy())
        self.of[at] = place[coded.indices.to_numpy()]
        self.told = None

    def frequent(self) -> np.ndarray:
        """Where a frequent phrase starts."""
        return (self.of >= 0) & (self.told.total[self.of] > 0) if len(self.codes) else np.zeros(len(self.of), bool)

    def totals(self, at: np.ndarray) -> np.ndarray:
        return self.told.total[self.of[at]]


def _next(words: Words, levels: list[Level]) -> Level:
    """Phrases of one word more: both shorter phrases are frequent, and the words stand in one piece."""
    n, size = len(words.start), len(levels)
    often = levels[-1].frequent()
    at = np.flatnonzero(often[:-1] & often[1:] & words.follows[:-1])
    codes = coded(levels[-1].told.id[levels[-1].of[at]], levels[0].told.id[levels[0].of[at + size]])
    return Level(codes, at, n, tally)


def _levels(words: Words, answers: pa.Table | None, parts: int, known: int) -> list[Level]:
    """The first ``known`` lengths with what was told of them, and the next one, if there is one, to be asked."""
    n = len(words.start)
    levels = [Level(words.hash, np.arange(n), n, lambda c: _sorted_sums(c, None))]
    for level in range(known):
        levels[-1].told = _told(answers, levels[-1].codes, parts, level)
        if level + 1 < WORDS:
            levels.append(_next(words, levels))
    return levels


def _ask(key, blobs: pa.Table, answers: pa.Table | None, parts: int, level: int) -> pa.Table:
    """Questions of a bucket about its phrases of ``level + 1`` words, after the replies about all shorter ones."""
    me, words = key[0].as_py(), Words(Bucket(blobs))
    last = _levels(words, answers, parts, level)[-1]
    return table_of(list(_questions(last.codes, last.counts, me, parts, level)))


_FOUND = pa.schema([
    ("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("first", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64())),
])
_FOUND_SQL = "lang string, words array<string>, a bigint, first array<bigint>, rest array<bigint>"


def _report(key, blobs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """The phrases that this bucket reports, with the totals of both sides of each cut; and its words a language (no phrase)."""
    words = Words(Bucket(blobs))
    levels = _levels(words, answers, parts, WORDS)
    n = np.bincount(words.lang, minlength=len(words.langs))
    found = [(x, None, int(k), None, None) for x, k in zip(words.langs, n)]
    for size in range(2, WORDS + 1):
        level = levels[size - 1]
        starts = np.full(len(level.codes), -1, np.int64)
        at = np.flatnonzero(level.of >= 0)
        starts[level.of[at]] = at
        own = np.flatnonzero(level.told.own)
        at = starts[own]
        first = np.stack([levels[k - 1].totals(at) for k in range(1, size)], axis=1)
        rest = np.stack([levels[size - k - 1].totals(at + k) for k in range(1, size)], axis=1)
        for i, a, l, r in zip(at, level.told.total[own], first.tolist(), rest.tolist()):
            text = [_LOWER[words.data[words.start[i + k] : words.end[i + k]]].tobytes().decode() for k in range(size)]
            found.append((words.langs[words.lang[i]], text, int(a), l, r))
    columns = list(zip(*found)) if found else [[]] * len(_FOUND)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


# ---- scores


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """``lang, words, a, first, rest`` of every phrase of 2 to 4 words that occurs at least ``LEAST`` times,
    and rows without words whose ``a`` add up to the words of a language."""
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("und")).alias("lang"))
    documents, _, parts = held(rows, ["lang"], BUCKET_BYTES)
    answers = None  # the replies of all rounds so far; the questions of a round are shuffled once and read again

    def ask(level):
        return lambda key, left, right: _ask(key, left, right, parts, level)

    for level in range(WORDS):
        if level:
            asked = documents.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(ask(level), ROW_SQL)
        else:
            asked = documents.groupBy("to").applyInArrow(lambda key, t: _ask(key, t, None, parts, 0), ROW_SQL)
        replies = asked.groupBy("to").applyInArrow(lambda t: _answered(t, parts), ROW_SQL)
        answers = answers.unionAll(replies) if level else replies
    found = documents.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(lambda key, left, right: _report(key, left, right, parts), _FOUND_SQL)
    return kept(found, "phrases")


def scored(found: DataFrame) -> DataFrame:
    """Phrases with the lowest score of their cuts: ``lang, words, a, l, r, score``."""
    cuts = F.transform(F.col("first"), lambda l, k: F.struct(
        F.expr("cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))").alias("top"), k.alias("k"), l.alias("l"), F.get("rest", k).alias("r")
    ))
    valued = F.expr("transform(cuts, c -> struct(c.top div cast(c.l + c.r as decimal(18, 0)) as score, c.k as k, c.l as l, c.r as r))")
    rows = found.filter("words is not null").withColumn("cuts", cuts).withColumn("best", F.array_min(valued))
    return rows.select("lang", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def unheld(phrases: DataFrame) -> DataFrame:
    """Phrases of which no longer phrase holds ``HELD`` hundredths of the occurrences."""
    n = F.size("words")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("words", i, m))))
    longer = phrases.filter(n > 2).select("lang", F.explode(parts).alias("words"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "words"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < HELD * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score, n_words``."""
    found = frequent_phrases(docs)
    sizes = found.filter("words is null").groupBy("lang").agg(F.sum("a").alias("n"))
    rows = unheld(scored(found)).withColumn("phrase", F.array_join("words", " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", spread).orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.size("words").alias("n_words"))
