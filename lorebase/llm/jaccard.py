"""Jaccard join of word n-grams with adaptive multi-match prefixes (operator 7).

1. Equal sets become one class, held by its smallest document id.
2. Every shingle's number of classes is counted.  A document's shingles are ordered by it,
   rarest first.  Two sets that link share at least T = 75 % of either's shingles,
   so of the first n - T + l shingles of both at least l are shared.  Shingles of one class
   come first and are never shared: a set with fewer than T others has no link.
3. For each set that is left, l is chosen by cost: a longer prefix meets more sets, but
   a pair must then share l shingles of it before it is verified (the smaller l of the pair).
4. Each set is first compared with a centre, the set with the smallest share of its own
   shingles among those it meets: a large group of near copies becomes one component by as
   many links as it has members.  Then all pairs in different components that share enough of
   their prefixes are verified, which leaves no link out; pairs within a component cannot
   change it.  Pairs that cannot link by their numbers of shared shingles, or by what both
   lack of a common centre, are not met; those of one centre meet by what they share besides it.

Words are runs of other characters than blanks, A-Z in lower case.  Texts without words have an
empty set and no links; fewer words than a shingle has count as one shingle.  A null ``doc_id``
is larger than every id and stays null where it is all that is reached; rows with one id are
one document, and rows without one are one only where their sets are equal.  An empty table gives an empty result; other columns are not read.  Shingles
are compared as 64-bit hashes and sets as 128-bit hashes.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lorebase.llm.buckets import (
    BYTE, LAST, ODD, ROW_SQL, Bucket, Owners, from_low_bytes, held, ids_from_bytes, least_anywhere, low_bytes, mixed, note, noted, part_of, runs, table_of,
)
from lorebase.llm.common import spread_join
from lorebase.llm.components import components
from lorebase.sources.scratch import kept

WORDS = 5
#: Similarity of links, in hundredths.
PERCENT = 75
#: Largest l considered, and what verifying a set costs against meeting it.
MOST_MATCHES, VERIFY = 4, 20.0
#: Rounds of links to one chosen set per shingle, after the centres, before all pairs are looked at.
STAR_ROUNDS = 1
#: Bytes of text whose shingles are made at once, and ranges in which a part adds up counts.
CHUNK, RANGES = 1 << 20, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BACK = np.uint64(pow(int(ODD[3]), -1, 1 << 64))


def needed(n):
    """Shingles that a set of n must share with any set it links to."""
    return -(-PERCENT * n // 100)


class Shingles:
    """Distinct shingle hashes of rows laid end to end: ``hash`` and ``row``, in order of both,
    and the number ``n`` of each row."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        found, row, a = [], 0, 0
        while row < len(ends):
            last = max(row + 1, int(np.searchsorted(ends, begins[row] + CHUNK, side="right")))
            found.append(self._rows(data[begins[row] : ends[last - 1]], ends[row:last] - begins[row], row))
            row = last
        self.hash = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
        self.row = np.concatenate([r for _, r in found]) if found else np.empty(0, np.int64)
        self.n = np.bincount(self.row, minlength=len(ends))

    @staticmethod
    def _rows(data, ends, first_row):
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        if not len(data):
            return none
        word = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        edge[0] = True
        start = np.flatnonzero(word & np.append(True, ~word[:-1] | edge[1:-1]))
        end = np.flatnonzero(word & np.append(~word[1:] | edge[1:-1], True)) + 1
        if not len(start):
            return none
        # Hash of a slice as a difference of sums over powers, moved back to power 0.
        power = np.full(len(data), ODD[3])
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[_LOWER[data]] * power, out=total[1:])
        back = np.full(len(data), _BACK)
        back[0] = 1
        np.cumprod(back, out=back)
        words = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * ODD[4])
        row = np.searchsorted(ends, start, side="right")
        count = np.bincount(row, minlength=len(ends))
        hashes, rows = [], []
        if len(words) >= WORDS:
            h = np.zeros(len(words) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                h = (h + words[k : len(h) + k]) * ODD[5 + k]
            one = row[: len(h)] == row[WORDS - 1 :]
            hashes.append(mixed(h[one]))
            rows.append(row[: len(h)][one])
        begin = np.cumsum(count) - count
        for r in np.flatnonzero((count > 0) & (count < WORDS)):
            h = np.uint64(count[r])
            for w in words[begin[r] : begin[r] + count[r]]:
                h = np.uint64((int(h) * int(ODD[10]) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            hashes.append(mixed(np.array([h])))
            rows.append(np.array([r]))
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = runs(r, h)
        return h[new], r[new] + first_row

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums per row that do not depend on order: together the hash of its set."""
        out = []
        for k in (11, 12):
            total = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(mixed(self.hash * ODD[k]), out=total[1:])
            end = np.cumsum(self.n)
            out.append(mixed(total[end] - total[end - self.n]))
        return out[0], out[1]


def _written_counts(n: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.minimum(n, 2**32 - 1).astype("<u4").tobytes()), codec="zstd", asbytes=True)


def _read_counts(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For lists of sorted keys with counts, the sum over all lists of each entry's key.

    Keys are added up in ``RANGES`` ranges, one after the other: only one is sorted at a time.
    """
    out = [np.zeros(len(k), np.uint32) for k in keys]
    some = [k for k in keys if len(k)]
    if not some:
        return out
    low, high = min(int(k[0]) for k in some), max(int(k[-1]) for k in some) + 1
    edges = np.array([low + (high - low) * i // RANGES for i in range(RANGES + 1)], np.uint64)
    at = [np.searchsorted(k, edges) for k in keys]
    for i in range(RANGES):
        key = np.concatenate([k[e[i] : e[i + 1]] for k, e in zip(keys, at)])
        if not len(key):
            continue
        n = np.concatenate([c[e[i] : e[i + 1]] for c, e in zip(counts, at)])
        order = np.argsort(key, kind="stable")
        new = runs(key[order])
        total = np.minimum(np.add.reduceat(n[order], np.flatnonzero(new), dtype=np.int64), 2**32 - 1)
        sums = np.empty(len(key), np.uint32)
        sums[order] = total[np.cumsum(new) - 1]
        first = 0
        for o, e in zip(out, at):
            o[e[i] : e[i + 1]] = sums[first : first + e[i + 1] - e[i]]
            first += e[i + 1] - e[i]
    return out


def _answered(part: pa.Table) -> pa.Table:
    """One part of the dictionaries of sets and of shingles."""
    rows = part.to_pylist()
    out = [(r["sender"], r["kind"], r["to"], r["a"], r["b"]) for r in rows if r["kind"] == "note"]
    sets = [r for r in rows if r["kind"] == "sets"]
    if sets:
        out += [(r["sender"], "sets", r["to"], ids, None) for r, ids in zip(sets, least_anywhere([(r["a"], r["b"]) for r in sets], 8))]
    counted = [r for r in rows if r["kind"] == "counts"]
    if counted:
        keys = [from_low_bytes(r["a"], 6) for r in counted]
        sums = _sums(keys, [_read_counts(r["b"], len(k)) for r, k in zip(counted, keys)])
        out += [(r["sender"], "counts", r["to"], _written_counts(x), None) for r, x in zip(counted, sums)]
    return table_of(out)


def _ask_sets(key, blobs: pa.Table, parts: int) -> pa.Table:
    bucket = Bucket(blobs)
    s = Shingles(bucket.data, bucket.ends)
    a, b = s.sets()
    some = s.n > 0
    return table_of([(p, "sets", key[0].as_py(), x, y) for p, x, y in Owners(a[some], b[some], bucket.id[some], 8).packs(parts)])


def _holders(bucket: Bucket, s: Shingles, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest id with its set, and whether the row stands for the set."""
    a, b = s.sets()
    some = np.flatnonzero(s.n > 0)
    owners = Owners(a[some], b[some], bucket.id[some], 8)
    least = np.empty(len(owners.key), np.int64)
    edges = np.searchsorted(part_of(owners.key, parts), np.arange(parts + 1))
    for r in answers.filter(pc.equal(answers["kind"], "sets")).to_pylist():
        least[edges[r["sender"]] : edges[r["sender"] + 1]] = ids_from_bytes(r["a"])
    holder = bucket.id.copy()
    holder[some] = least[owners.of]
    stands = np.zeros(len(s.n), bool)
    mine = some[holder[some] == bucket.id[some]]
    _, first = np.unique(owners.of[np.searchsorted(some, mine)], return_index=True)
    stands[mine[first]] = True
    return holder, stands


def _counted(s: Shingles, stands: np.ndarray):
    """The shingles of the rows that stand for sets, their 48-bit keys and numbers of rows."""
    keep = stands[s.row]
    keys, of, n = np.unique(s.hash[keep] >> np.uint64(16), return_inverse=True, return_counts=True)
    return keep, keys, of, n


def _ask_counts(key, blobs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    bucket, me = Bucket(blobs), key[0].as_py()
    s = Shingles(bucket.data, bucket.ends)
    holder, stands = _holders(bucket, s, answers, parts)
    _, keys, _, n = _counted(s, stands)
    edges = np.searchsorted(part_of(keys << np.uint64(16), parts), np.arange(parts + 1))
    out = [
        (p, "counts", me, low_bytes(keys[a:b], 6), _written_counts(n[a:b]))
        for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
    ]
    out.append(note(me, parts, holder, stands))
    return table_of(out)


def matches_wanted(n: int, counts: np.ndarray) -> tuple[int, int]:
    """l, and how many of a set's shared shingles (``counts`` of them, rarest first) its prefix holds."""
    base = n - needed(n) - (n - len(counts))
    best = None
    for wanted in range(1, MOST_MATCHES + 1):
        held_ = min(base + wanted, len(counts))
        meets = float(counts[:held_].sum())
        cost = meets + VERIFY * meets / wanted
        if held_ >= wanted and (best is None or cost < best[0]):
            best = (cost, wanted, held_)
    return best[1:] if best else (1, min(max(base + 1, 0), len(counts)))


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("holder", pa.int64()), ("wanted", pa.int32()), ("prefix", pa.int32()), ("shared", pa.list_(pa.int64())),
])
_FOUND_SQL = "doc_id bigint, n bigint, holder bigint, wanted int, prefix int, shared array<bigint>"


def _find(key, blobs: pa.Table, answers: pa.Table, parts: int, free: int) -> pa.Table:
    """A row per document; sets that may have links carry their shared shingles, rarest first.

    A set that only rows without an id have is held by a number of its own, from ``free`` on.
    """
    bucket = Bucket(blobs)
    s = Shingles(bucket.data, bucket.ends)
    holder, stands = noted(answers)
    a, b = s.sets()
    own = np.uint64(free) + mixed(a ^ b * ODD[13]) % np.uint64(max(1, int(LAST) - free))
    holder = np.where((holder == LAST) & (s.n > 0), own.astype(np.int64), holder)
    keep, keys, of, _ = _counted(s, stands)
    count = np.zeros(len(keys), np.uint32)
    edges = np.searchsorted(part_of(keys << np.uint64(16), parts), np.arange(parts + 1))
    for r in answers.filter(pc.equal(answers["kind"], "counts")).to_pylist():
        a, b = edges[r["sender"]], edges[r["sender"] + 1]
        count[a:b] = _read_counts(r["a"], int(b - a))
    hashes, rows, times = s.hash[keep], s.row[keep], count[of]
    shared = times > 1
    hashes, rows, times = hashes[shared], rows[shared], times[shared]
    order = np.lexsort((hashes, times, rows))
    hashes, times = hashes[order], times[order]
    n_shared = np.bincount(rows, minlength=len(s.n))
    end = np.cumsum(n_shared)
    wanted, prefix, lists = [], [], []
    for r, (n, k, e) in enumerate(zip(s.n, n_shared, end)):
        if stands[r] and n and k >= needed(int(n)):
            l, p = matches_wanted(int(n), times[e - k : e])
            wanted.append(l)
            prefix.append(p)
            lists.append(hashes[e - k : e].view(np.int64))
        else:
            wanted.append(None)
            prefix.append(None)
            lists.append(None)
    return pa.table([pa.array(c, f.type) for c, f in zip((bucket.id, s.n, holder, wanted, prefix, lists), _FOUND)], schema=_FOUND)


def _near(a, b):
    """Sizes that a link allows."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _links(both, n_a, n_b):
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a written table with the sizes and shared shingles of both; ``b`` may be one set in many pairs."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    return spread_join(pairs, side("b"), "b").join(side("a"), "a")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    both = F.size(F.array_intersect("s_a", "s_b"))
    return _sides(pairs, sets).filter(_links(both, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _most_met(met: DataFrame, other) -> DataFrame:
    """For each set the one of the others that it meets most often: (doc, other)."""
    times = met.groupBy("doc", other.alias("other")).agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("doc").agg(F.max(F.struct("times", "other")).alias("best")).select("doc", F.col("best.other").alias("other"))


def _centred(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Each set with a centre, what it has of it, its other shared shingles (``rest``), and whether they link.

    A shingle's centre is the set with it that has the smallest share of shingles of its own:
    among near copies, the text that was copied.  ``low`` and ``high`` are 128 bits, those of the
    hashes of the centre's shared shingles that the set lacks.
    """
    one = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), (-F.col("n")).alias("m"), "doc")).alias("one")
    tokens = rows.groupBy("token").agg(one, F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    met = rows.join(tokens.select("token", F.col("one.doc").alias("centre")), "token").filter("doc <> centre")
    both = F.size(F.array_intersect("s_a", "s_b"))

    def bits(lost, first):
        place = lambda t: F.pmod(F.shiftrightunsigned(t, 20), F.lit(128)).cast("int") - first
        one_bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), place(t))
        none = F.lit(0).cast("long")
        return F.aggregate(lost, none, lambda m, t: m.bitwiseOR(F.when(place(t).between(0, 63), one_bit(t)).otherwise(none)))

    pairs = kept(_most_met(met, F.col("centre")).select(F.col("doc").alias("a"), F.col("other").alias("b")), "centres")
    found = _sides(pairs, sets).withColumns({"lost": F.array_except("s_b", "s_a"), "inter": both})
    return found.select(
        F.col("a").alias("doc"), F.col("b").alias("centre"), "inter", F.size("s_b").alias("centre_s"), F.array_except("s_a", "s_b").alias("rest"),
        bits(F.col("lost"), 0).alias("low"), bits(F.col("lost"), 64).alias("high"), _links(F.col("inter"), F.col("n_a"), F.col("n_b")).alias("link"),
    )


def _possible(x: str, y: str):
    """Whether two sets can link by what is known of them; ``x`` and ``y`` end their columns' names.

    They share at most the smaller number of shared shingles.  With one centre, they also
    share at most those of the centre that neither lacks and the smaller rest of theirs.
    A set and its centre have been compared already.
    """
    c = lambda name, end: F.col(name + end)
    most = F.least(c("s", x), c("s", y))
    lacked = F.bit_count(c("low", x).bitwiseOR(c("low", y))) + F.bit_count(c("high", x).bitwiseOR(c("high", y)))
    rest = F.least(c("s", x) - c("inter", x), c("s", y) - c("inter", y))
    same = F.coalesce(c("centre", x) == c("centre", y), F.lit(False))
    most = F.when(same, F.least(most, c("centre_s", x) - lacked + rest)).otherwise(most)
    known = F.coalesce(c("centre", x) == c("doc", y), F.lit(False)) | F.coalesce(c("centre", y) == c("doc", x), F.lit(False))
    return _near(c("n", x), c("n", y)) & ~known & _links(most, c("n", x), c("n", y))


_CARRIED = ["doc", "n", "s", "wanted", "component", "centre", "inter", "centre_s", "low", "high"]


def _labelled(prefixes: DataFrame, found: DataFrame) -> DataFrame:
    """Prefix rows with the component of their set."""
    return prefixes.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each set with the set of another component, among one per shingle, that it meets most often."""
    one = F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("h"), F.xxhash64("doc", F.lit(turn)).alias("k"), *_CARRIED)).alias("one")
    tokens = rows.groupBy("token").agg(one, F.min("component").alias("lowest"), F.max("component").alias("highest")).filter("lowest <> highest")
    met = rows.join(tokens.select("token", *(F.col(f"one.{c}").alias(f"{c}_1") for c in _CARRIED)), "token")
    met = met.filter(F.col("component") != F.col("component_1")).filter(_possible("", "_1"))
    return _most_met(met, F.col("doc_1")).select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b")).distinct()


def _unlike(rows: DataFrame, by: list[str], group: str) -> tuple[DataFrame, DataFrame]:
    """Rows to be met, and rows to meet them with, for pairs of one ``by`` in different groups.

    The group with most rows of a ``by`` is only met by the others; columns of the first end in ``_l``.
    """
    per = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("sets"))
    main = per.groupBy(*by).agg(F.max(F.struct("sets", group)).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    open_ = rows.join(main.select(*by, F.col(f"main.{group}").alias("main")), by)
    left = open_.filter(F.col(group) != F.col("main"))
    return left.select(*by, *(F.col(c).alias(f"{c}_l") for c in rows.columns if c not in by)), open_


def _once(group: str):
    """Each pair once: the main group is only on the second side, and others meet in order."""
    return (F.col(group) != F.col(f"{group}_l")) & ((F.col(group) == F.col("main")) | (F.col("doc_l") < F.col("doc")))


def _pair(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.greatest("doc", "doc_l").alias("a"), F.least("doc", "doc_l").alias("b"))


def _enough(prefix_rows: DataFrame) -> DataFrame:
    """Pairs that share as much of their prefixes as the smaller l asks for."""
    times = _pair(prefix_rows).agg(F.count(F.lit(1)).alias("times"), F.min(F.least("wanted", "wanted_l")).alias("least_wanted"))
    return times.filter("times >= least_wanted").select("a", "b")


def _partners(inter: str, n: str):
    """The largest size of a set that can link to a set of size ``n`` by no more than ``inter`` shared shingles."""
    return F.floor((100 + PERCENT) * F.col(inter) / PERCENT) - F.col(n)


def _band(n):
    """Sizes in steps of a sixteenth."""
    return F.floor(F.log(n.cast("double")) / math.log(1 + 1 / 16)).cast("int")


def _by_centre(rows: DataFrame) -> DataFrame:
    """Pairs of one centre that may link by what both have of the centre alone.

    Each must have enough of the centre for the other's size.  The smaller one then has enough for
    its own size too, and meets larger ones by bands of sizes: most sets that do not
    link to their centre have too little of it for any set of the centre's size, and meet nothing here.
    """
    open_ = rows.groupBy("token", "centre").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.max(_partners("inter", "n") >= F.col("n")).alias("any"))
    rows = rows.join(open_.filter("lowest <> highest and any").select("token", "centre"), ["token", "centre"], "left_semi").withColumn("most", _partners("inter", "n"))
    small = rows.filter("most >= n").withColumn("band", _band(F.col("n")))
    low, high = F.ceil(PERCENT * F.col("n") / 100), F.least("n", "most")
    large = rows.filter(high >= low).withColumn("band", F.explode(F.sequence(_band(low), _band(high))))
    by = ["token", "centre", "band"]
    fits = (F.col("n_l") <= F.col("n")) & (F.col("n_l") <= F.col("most")) & (F.col("n") <= F.col("most_l")) & (F.col("component") != F.col("component_l")) & (F.col("doc") != F.col("doc_l"))
    fits = fits & ((F.col("n_l") < F.col("n")) | ~F.col("wide") | (F.col("doc_l") < F.col("doc")))  # of two that are both, one order
    large = large.withColumn("wide", F.col("most") >= F.col("n"))
    # The component with most rows of a key meets itself on neither side.
    per = small.select(*by, "component").unionByName(large.select(*by, "component")).groupBy(*by, "component").agg(F.count(F.lit(1)).alias("sets"))
    main = per.groupBy(*by).agg(F.max(F.struct("sets", "component")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    main = main.select(*by, F.col("main.component").alias("main"))
    left = small.join(main, by).select(*by, "main", *(F.col(c).alias(f"{c}_l") for c in [*_CARRIED, "most"]))
    right = large.join(main, by)
    others = left.filter("component_l <> main").drop("main").join(right.drop("main"), by).filter(fits & _possible("", "_l"))
    mains = left.filter("component_l = main").drop("main").join(right.filter("component <> main").drop("main"), by).filter(fits & _possible("", "_l"))
    return _enough(others.unionByName(mains))


def _by_rest(sets: DataFrame) -> DataFrame:
    """Pairs of one centre that share shingles besides the centre's, enough to link with what both have of it."""
    left, right = _unlike(sets.select("doc", "n", "inter", "component", "centre", F.explode("rest").alias("token")), ["token", "centre"], "component")
    meet = left.join(right, ["token", "centre"]).filter(_once("component")).filter(_near(F.col("n"), F.col("n_l")))
    most = F.least("inter", "inter_l")
    times = _pair(meet).agg(F.count(F.lit(1)).alias("times"), F.first(most).alias("most"), F.first(F.col("n")).alias("n_a"), F.first(F.col("n_l")).alias("n_b"))
    return times.filter(_links(F.col("most") + F.col("times"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _open_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of sets in different components that share enough of their prefixes and can link.

    Pairs of different centres meet by prefix tokens.  Pairs of one centre share at most the smaller
    part that either has of it, and shingles besides: a pair that needs some of the latter meets by these,
    the others by prefix tokens among the few that need none.  So a large group of texts that are all
    alike, but less than linked, does not meet itself.
    """
    # A set of the main component of a token is in no pair of that token with its own component.
    left, right = _unlike(rows, ["token"], "centre")
    apart = left.join(right, "token").filter(_once("centre") & (F.col("component") != F.col("component_l"))).filter(_possible("", "_l"))
    return _enough(apart).unionByName(_by_centre(rows)).unionByName(_by_rest(sets)).distinct()


def linked(sets: DataFrame) -> DataFrame:
    """``node, component`` of the sets that have links; ``sets`` has ``doc, n, wanted, prefix, shared``."""
    prefixes = kept(
        sets.select("doc", "n", F.size("shared").alias("s"), "wanted", F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("token")), "prefixes"
    )
    centred = kept(_centred(prefixes, sets), "centred")
    found = components(centred.filter("link").select(F.col("doc").alias("a"), F.col("centre").alias("b")))
    none = F.lit(0).cast("long")
    alone = {"centre": F.col("doc"), "inter": F.col("s"), "centre_s": F.col("s"), "low": none, "high": none}  # a set without a centre is its own
    placed = lambda df: df.join(centred.drop("link", "rest"), "doc", "left").withColumns({c: F.coalesce(c, v) for c, v in alone.items()})
    # Only tokens of more than one component are looked at any more.
    labelled = _labelled(prefixes, found)
    mixed_ = labelled.groupBy("token").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).filter("lowest <> highest")
    rows = kept(placed(labelled.drop("component").join(mixed_.select("token"), "token", "left_semi")), "open")
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            pairs = _star_pairs(_labelled(rows, found), turn)
        else:
            rest = placed(sets.select("doc", "n", F.size("shared").alias("s"), "wanted")).join(centred.select("doc", "rest"), "doc")
            pairs = _open_pairs(kept(_labelled(rows, found), "open"), _labelled(rest, found))
        new = kept(_verified(kept(pairs, "pairs"), sets), "links")
        if new.limit(1).count():
            found = components(new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return found


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    documents, _, parts = held(docs.select("doc_id", "text"), ["doc_id"])
    greatest = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    free = 0 if greatest is None else min(max(greatest + 1, 0), int(LAST))
    ask = lambda fn, *more: lambda key, left, right: fn(key, left, right, parts, *more)
    answered = lambda df: df.groupBy("to").applyInArrow(_answered, ROW_SQL).groupBy("to")
    asked = documents.groupBy("to").applyInArrow(lambda key, t: _ask_sets(key, t, parts), ROW_SQL)
    asked = documents.groupBy("to").cogroup(answered(asked)).applyInArrow(ask(_ask_counts), ROW_SQL)
    rows = kept(documents.groupBy("to").cogroup(answered(asked)).applyInArrow(ask(_find, free), _FOUND_SQL), "sets")
    sets = rows.filter("shared is not null").select(F.col("holder").alias("doc"), "n", "wanted", "prefix", "shared")
    found = linked(sets).select(F.col("node").alias("holder"), "component")
    # Documents without words stay by themselves, whatever their id shares.
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("holder")).alias("holder")).join(found, "holder", "left")
    component = F.coalesce("component", "holder", "doc_id")
    real = lambda c: F.when(c < F.lit(free).cast("long"), c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"))


def first_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with its id; all columns as they were.

    Rows without an id, and texts without words, stay.
    """
    ids = joined(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone_"], "left_anti")
