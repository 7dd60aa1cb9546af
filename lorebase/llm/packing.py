"""Best-fit packing of documents into sequences by exact complements (operator 1).

Texts are tokenized and cut into pieces of at most ``capacity`` ids.  What follows
needs only how many pieces there are of each length, at most ``capacity`` numbers: the
plan on the driver takes the longest length left, stacks further long pieces on it while
the gap is wide, and fills the gap exactly with one, two or three available lengths,
found by looking up the complement, as often as the counts allow.  Lengths without an
exact filling are placed best-fit decreasing, in multiples.  The plan says for each
length which ranks go to which sequences; pieces are ranked per length on Spark, in
groups of bounded size, and look up their place.

A null text counts as empty and gives one piece with the end id; repeated rows are
packed each by itself; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read; a null ``doc_id`` stays null.
"""

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lorebase.llm.common import per_process
from lorebase.sources.scratch import kept

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids one Python worker remembers.
REMEMBERED = 600_000
#: Characters of text that are split at once, about, and marks cut off words.
BATCH_CHARS, MARKS = 4_000_000, "!#$%&*+,-./:;=?@|~"
#: Words whose ids are gathered at once, about.
GATHERED = 1 << 17
#: Pieces of one length that are ranked together, about.
RANKED_TOGETHER = 50_000


class WordTokenizer:
    """Ids of whole texts, word by word, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and encodes what stands between separately, so
    the ids of a text are those of its words in order.  A run of marks after a letter or
    digit is encoded separately as well, and case does not count: words are encoded
    once without both.  Only ASCII letters are lowered and only ASCII marks cut off here.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = self._tokenizer.get_vocab_size()
        self._ends_word = np.array([self._tokenizer.id_to_token(i).endswith("</w>") for i in range(size)])
        self._known: dict[str, bytes] = {"": b""}
        self._remembered = remembered

    def encode_batch(self, texts) -> Iterator[bytes]:
        """The ids of each text; ``texts`` are strings or an Arrow column without nulls."""
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, side="right")))
            yield from self._encode_some(texts[at:end])
            at = end

    def _encode_some(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        ends_of = np.cumsum(split.value_lengths().to_numpy())
        coded = split.flatten().dictionary_encode()
        del split  # not held while its words are encoded
        word, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del coded
        own = self._encode_words(names)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, starts = np.frombuffer(b"".join(own), "<u4"), np.cumsum(lengths) - lengths
        del names, own
        at = first = 0
        while at < len(ends_of):  # some texts at a time: their numbers stay in the cache
            end = max(at + 1, int(np.searchsorted(ends_of, first + GATHERED, side="right")))
            some = word[first : ends_of[end - 1]]
            n = lengths[some]
            ends = np.cumsum(n)
            # Ids of a word follow one another: each place is the start of its word's ids and how far it is into them.
            data = memoryview(ids[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
            edges = 4 * np.append(0, ends)[np.append(0, ends_of[at:end] - first)]
            for a, b in pairwise(edges.tolist()):
                yield bytes(data[a:b])
            at, first = end, int(ends_of[end - 1])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self._known) > self._remembered:  # what is in use now is likely to come again
            self._known = {"": b""} | {w: self._known[w] for w in words if w in self._known}
        known = self._known
        cut = {w: _cut(w) for w in words if w not in known}
        # A word and its marks are words themselves: what is known of them serves both.
        new = set(chain.from_iterable(cut.values())).difference(known)
        plain = [x for x in new if _is_one_run(x)]
        found = self._encode_runs(plain)
        known.update(zip(plain, found))
        rest = list(new.difference(plain)) if found else list(new)
        for stem, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[stem] = np.array(e.ids, "<u4").tobytes()
        for w, (stem, tail) in cut.items():
            known[w] = known[stem] + known[tail]
        return list(map(known.__getitem__, words))

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of letters, all at once: each ends with a token that ends a word."""
        if not runs:
            return []
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self._ends_word[ids]) + 1
        if len(at) != len(runs):
            return []
        data, edges = ids.tobytes(), [0, *(4 * at).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:])]


def _is_one_run(stem: str) -> bool:
    """Letters only, none of which composing or lowering can change into something else."""
    return stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and len(stem.lower()) == len(stem)))


def _cut(word: str) -> tuple[str, str]:
    """A word without case and the marks at its end, and those marks."""
    stem = word.rstrip(MARKS)
    if stem.isascii():
        return (stem.lower(), word[len(stem) :]) if stem and stem[-1].isalnum() else (word, "")
    # The last character must be a letter or digit once composed and lowered, too.
    return (stem, word[len(stem) :]) if normalize("NFC", stem).lower()[-1].isalnum() else (word, "")


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process for one vocabulary file."""
    return per_process(("tokenizer", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and with ``with_ids`` the ids too."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this process left
        encode = tokenizer(path).encode_batch
        for b in batches:
            rows = []
            for doc_id, own in zip(b.column("doc_id").to_pylist(), encode(b.column("text").fill_null(""))):
                ids = memoryview(own + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<u4").astype("int32"),) if with_ids else row)
            columns = list(zip(*rows)) or [()] * (5 + with_ids)
            kinds = [b.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _filling(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths of ``left`` that sum to ``gap`` exactly, longest first."""
    if left[gap] > 0:
        return (gap,)

    def pair(total, left):
        some = np.flatnonzero(left[: total + 1])
        some = some[some >= (total + 1) // 2]
        other = total - some
        fine = (other > 0) & np.where(other == some, left[some] > 1, left[other] > 0)
        hits = some[fine]
        return (int(hits[-1]), total - int(hits[-1])) if len(hits) else None

    found = pair(gap, left)
    if found:
        return found
    for a in np.flatnonzero(left[:gap])[::-1]:
        left[a] -= 1
        found = pair(gap - int(a), left)
        left[a] += 1
        if found:
            return (int(a), *found)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination of lengths fills a sequence."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done, rest = [], []

    def take(lengths):
        uses = dict(zip(*np.unique(lengths, return_counts=True)))
        times = int(min(left[x] // n for x, n in uses.items()))
        for x, n in uses.items():
            left[x] -= times * n
        return times

    for top in range(capacity, 0, -1):
        while left[top] > 0:
            stack, gap = [top], capacity - top
            left[top] -= 1
            # Long pieces first, until three more can fill what is left.
            while gap and len(some := np.flatnonzero(left[: gap + 1])) and gap > 2 * some[-1]:
                stack.append(int(some[-1]))
                left[some[-1]] -= 1
                gap -= int(some[-1])
            more = _filling(left, gap) if gap else ()
            for x in stack:
                left[x] += 1
            if more is None:
                rest.append((top, int(left[top])))
                left[top] = 0
            else:
                done.append(((*stack, *more), take([*stack, *more])))

    gaps: list[int] = []
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths, times, gap):
        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append((lengths, times))

    for length, n in rest:
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = min(capacity // length, n)
                times = n // each
                put((length,) * each, times, capacity - each * length)
                n -= each * times
                continue
            gap = gaps[k]
            lengths, times = open_at[gap].pop()
            used = min(times, n)
            if times > used:
                open_at[gap].append((lengths, times - used))
            if not open_at[gap]:
                del open_at[gap], gaps[k]
            put((*lengths, length), used, gap - length)
            n -= used
    return done + [x for group in open_at.values() for x in group]


def _places(combinations) -> pd.DataFrame:
    """For every length, which of its ranks go where: a table of intervals."""
    rows, sequence, seen = [], 0, {}
    for lengths, times in combinations:
        offset = 0
        for x in lengths:
            rows.append((x, seen.get(x, 0), sequence, offset))
            seen[x] = seen.get(x, 0) + times
            offset += x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``; it must be cheap to read again.

    The histogram that reaches the driver and the intervals that reach the tasks are
    bounded by the capacity, whatever the number of pieces.
    """
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _places(plan(counts, capacity))
    first = (table["length"].to_numpy(np.int64) << 48) + table["first"].to_numpy(np.int64)
    start, sequence, offset = table["first"].to_numpy(np.int64), table["sequence"].to_numpy(np.int64), table["offset"].to_numpy(np.int64)

    groups = 64 + max(counts.values(), default=0) // RANKED_TOGETHER
    bucketed = found.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = (
        bucketed.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "length", "bucket_",
            (F.sum("n").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n")).alias("before_"),
        )
    )
    order = Window.partitionBy("length", "bucket_").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        bucketed.withColumn("rank_", F.row_number().over(order) - 1)
        .join(before, ["length", "bucket_"])
        .select(*found.columns, (F.col("before_") + F.col("rank_")).alias("rank_"))
    )

    def run(batches):
        for b in batches:
            rank = b.pop("rank_").to_numpy(np.int64)
            k = np.searchsorted(first, (b["length"].to_numpy(np.int64) << 48) + rank, side="right") - 1
            yield b.assign(sequence_id=sequence[k] + rank - start[k], offset=offset[k])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInPandas(run, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its place; texts are tokenized once."""
    return placed(kept(pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences themselves, from pieces ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
