"""Removal of repeated passages by prefix-free parsing (operator 3).

Every byte covered by a string of ``WINDOW`` bytes that also starts in a document with a
smaller id is removed; strings never cross documents and are judged on the input.

Parsing: the rolling hash of each GRAM bytes is a trigger where it is the least among the
grams of some window.  Every window has one trigger, fixed by its bytes alone, so equal
windows have equal triggers at equal places.  The windows of one trigger form a
phrase, which reaches over the next triggers far enough to hold them whole.

Order: instead of the suffixes of the corpus, three dictionaries are sorted by hash ranges,
each made from what the one before left open, and each entered once per bucket of documents.

1. Trigger grams.  Those of one document only end here; most do.
2. Phrases of shared grams.  A phrase that a smaller document has too goes as a whole.  Where
   all phrases of a gram are equal nothing else can match.
3. Windows, the starts of the suffixes of phrases that differ though their gram is the same.

Suffixes are ordered by fingerprints of their first WINDOW bytes and not by letters, because
only equal runs matter.  The first dictionary is a filter, where a chance equality costs time
only; the others compare 80 bits besides the gram.  Documents travel once, compressed, to
buckets by id; dictionary parts hold one entry per bucket and key, so a passage that
every document has is as light as any.  All sizes follow from the bytes of the table.

A null text counts as empty.  A null ``doc_id`` counts as larger than every id.  Rows with the same
id are documents of one id: they do not remove from each other.  An empty table gives an
empty result.  Other columns are carried along unread, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lorebase.llm.buckets import (
    BYTE, LAST, ODD, ROW_SQL, Bucket, Owners, from_low_bytes, held, low_bytes, mixed, note, noted, part_of, replies, runs, smaller_elsewhere, table_of,
)

WINDOW, GRAM = 50, 24
#: Window starts that are parsed at once.
CHUNK = 1 << 20

_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, width, at_8 = BYTE[data], 1, None
    while width < 16:
        h = h[:-width] * ODD[width.bit_length()] + h[width:]
        width *= 2
        if width == 8:
            at_8 = h
    n = len(data) - GRAM + 1
    return mixed(h[:n] * ODD[7] + at_8[16 : 16 + n])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


class Parse:
    """The phrases of some documents laid end to end: trigger place, gram, phrase hash,
    first window, number of windows and row of the document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        columns = [self._chunk(data, ends, a) for a in range(0, max(0, len(data) - WINDOW + 1), CHUNK)]
        empty = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.gram, self.phrase, self.first, self.count, self.row = (
            np.concatenate(c) for c in (zip(*columns) if columns else ([e] for e in empty))
        )

    @staticmethod
    def _chunk(data, ends, a):
        part = data[a : a + CHUNK + WINDOW - 1]
        g = gram_hashes(part)
        keyed = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        trigger = (_sliding_least(keyed, WINDOW - GRAM + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(trigger))
        row = np.searchsorted(ends, start + a, side="right")
        inside = start + a + WINDOW <= ends[row]
        start, row, trigger = start[inside], row[inside], trigger[inside]
        new = np.ones(len(start), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(start)))
        first, trigger = start[at], trigger[at]
        last = first + count - 1 + WINDOW - GRAM
        phrase = (
            g[first] * ODD[8] + g[first + GRAM] * ODD[9] + g[np.minimum(first + 2 * GRAM, last)] * ODD[10] + g[last] * ODD[11]
            + count.astype(np.uint64) * ODD[12] + (trigger - first).astype(np.uint64) * ODD[13]
        )
        # Triggers are small hashes: mixed again they are spread evenly.
        return mixed(g[trigger]), mixed(phrase), first + a, count, row[at]


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes from each of ``starts`` on."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), CHUNK // 8):
        some = data[starts[a : a + CHUNK // 8, None] + np.arange(WINDOW)]
        h = np.zeros(len(some), np.uint64)
        for k in range(WINDOW):
            h = h * ODD[14] + BYTE[some[:, k]]
        out[a : a + CHUNK // 8] = mixed(h)
    return out


def _seen_elsewhere(rows) -> list[bytes]:
    """For packs of distinct grams: a bit per entry, whether another bucket has it."""
    key = np.concatenate([from_low_bytes(a, 6) for a, _ in rows])
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    sizes = [len(a) // 6 for a, _ in rows]
    return [np.packbits(x).tobytes() for x in np.split((n > 1)[at], np.cumsum(sizes)[:-1])]


def _several_elsewhere(rows) -> list[bytes]:
    """For packs of grams, each with one of its phrases and a bit for having more: a bit
    per entry, whether the gram has different phrases anywhere."""
    sizes = [len(a) // 6 for a, _ in rows]
    key = np.concatenate([from_low_bytes(a, 6) for a, _ in rows])
    phrase = np.concatenate([np.frombuffer(b[: 8 * n], "<u8") for (_, b), n in zip(rows, sizes)])
    own = np.concatenate([np.unpackbits(np.frombuffer(b[8 * n :], np.uint8), count=n) for (_, b), n in zip(rows, sizes)]).astype(bool)
    order = np.lexsort((phrase, key))
    new = runs(key[order])
    group = np.cumsum(new) - 1
    differs = own[order] | (phrase[order] != phrase[order][new][group])
    bit = np.empty(len(key), bool)
    bit[order] = (np.bincount(group, weights=differs) > 0)[group] if len(key) else False
    return [np.packbits(x).tobytes() for x in np.split(bit, np.cumsum(sizes)[:-1])]


_ANSWERS = {"grams": _seen_elsewhere, "phrases": smaller_elsewhere, "several": _several_elsewhere, "windows": smaller_elsewhere}
def _answered(part: pa.Table) -> pa.Table:
    """One part of the dictionaries: replies to the buckets; notes of a bucket to itself pass."""
    rows = part.to_pylist()
    out = [(r["sender"], r["kind"], r["to"], r["a"], r["b"]) for r in rows if r["kind"] == "note"]
    for kind, answer in _ANSWERS.items():
        mine = [r for r in rows if r["kind"] == kind]
        if mine:
            bits = answer([(r["a"], r["b"]) for r in mine])
            out += [(r["sender"], kind, r["to"], bit, None) for r, bit in zip(mine, bits)]
    return table_of(out)


def _parsed(bucket: Bucket) -> Parse:
    return Parse(bucket.data, bucket.ends)


def _grams(p: Parse):
    """48 bits of the grams: as entries of the dictionary, and each phrase's entry."""
    return np.unique(p.gram & ~np.uint64(0xFFFF), return_inverse=True)


def _ask_grams(key, blobs: pa.Table, parts: int) -> pa.Table:
    grams, _ = _grams(_parsed(Bucket(blobs)))
    edges = np.searchsorted(part_of(grams, parts), np.arange(parts + 1))
    return table_of([
        (p, "grams", key[0].as_py(), low_bytes(grams[a:b] >> np.uint64(16), 6), None)
        for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
    ])


class Shared:
    """The phrases of a bucket whose gram several documents have, with their dictionary entries."""

    def __init__(self, bucket: Bucket, p: Parse, some: np.ndarray):
        self.gram, self.first, self.count, self.row = p.gram[some] & ~np.uint64(0xFFFF), p.first[some], p.count[some], p.row[some]
        self.phrase, self.id = p.phrase[some], bucket.id[p.row[some]]
        self.more = (self.gram >> np.uint64(16)) & np.uint64(0xFFFF)

    def owners(self) -> Owners:
        return Owners(self.phrase ^ mixed(self.gram), self.more, self.id)


def _ask_phrases(key, blobs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    bucket, me = Bucket(blobs), key[0].as_py()
    p = _parsed(bucket)
    grams, of = _grams(p)
    elsewhere = replies(answers, "grams", part_of(grams, parts), parts)
    # Grams of several documents of this bucket.
    ids = bucket.id[p.row]
    low, high = np.full(len(grams), LAST), np.full(len(grams), np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    some = (elsewhere | (low < high))[of]
    s = Shared(bucket, p, some)
    out = [(q, "phrases", me, a, b) for q, a, b in s.owners().packs(parts)]
    order = np.lexsort((s.phrase, s.gram))
    new = runs(s.gram[order])
    group = np.cumsum(new) - 1
    one, distinct = s.phrase[order][new], s.gram[order][new]
    many = np.bincount(group, weights=s.phrase[order] != one[group]) > 0 if len(order) else np.empty(0, bool)
    edges = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1))
    out += [
        (q, "several", me, low_bytes(distinct[a:b] >> np.uint64(16), 6), one[a:b].tobytes() + np.packbits(many[a:b]).tobytes())
        for q, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
    ]
    out.append(note(me, parts, some))
    return table_of(out)


def _window_starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All window starts of some phrases."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _windows(bucket: Bucket, s: Shared, open_: np.ndarray):
    """Starts of the windows of the phrases left open, their rows, and their dictionary entries."""
    count = s.count[open_]
    starts, row = _window_starts(s.first[open_], count), np.repeat(s.row[open_], count)
    return starts, row, Owners(window_hashes(bucket.data, starts), np.repeat(s.more[open_], count), bucket.id[row])


def _ask_windows(key, blobs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    bucket, me = Bucket(blobs), key[0].as_py()
    (some,) = noted(answers)
    s = Shared(bucket, _parsed(bucket), some)
    owners = s.owners()
    smaller = replies(answers, "phrases", part_of(owners.key, parts), parts)
    gone = smaller[owners.of] | (owners.id[owners.of] < s.id)
    distinct, of = np.unique(s.gram, return_inverse=True)
    open_ = ~gone & replies(answers, "several", part_of(distinct, parts), parts)[of]
    _, _, asked = _windows(bucket, s, open_)
    out = [(q, "windows", me, a, b) for q, a, b in asked.packs(parts)]
    out.append(note(me, parts, some, gone, open_))
    return table_of(out)


def _spans(bucket: Bucket, answers: pa.Table, parts: int):
    """Row, start and end of the maximal removed runs, within the bucket's bytes."""
    some, gone, open_ = noted(answers)
    s = Shared(bucket, _parsed(bucket), some)
    starts, row, asked = _windows(bucket, s, open_)
    least = asked.id[asked.of] < bucket.id[row]
    starts = starts[least | replies(answers, "windows", part_of(asked.key, parts), parts)[asked.of]]
    change = np.zeros(len(bucket.data) + 1, np.int32)
    for at, step in ((s.first[gone], 1), (s.first[gone] + s.count[gone] - 1 + WINDOW, -1), (starts, 1), (starts + WINDOW, -1)):
        np.add.at(change, at, step)
    covered = np.cumsum(change[:-1]) > 0
    # A run ends where its document does.
    edge = np.zeros(len(covered) + 1, bool)
    edge[np.append(0, bucket.ends)] = True
    begins = covered & np.append(True, ~covered[:-1] | edge[1:-1]) if len(covered) else covered
    ends = covered & np.append(~covered[1:] | edge[1:-1], True) if len(covered) else covered
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(bucket.ends, a, side="right"), a, b, covered


def _cut(blobs: pa.Table, answers: pa.Table, parts: int, finish) -> pa.Table:
    bucket = Bucket(blobs)
    row, a, b, covered = _spans(bucket, answers, parts)
    n = len(bucket.rows)
    begin = np.append(0, bucket.ends[:-1]) if n else bucket.ends
    runs = np.bincount(row, minlength=n)
    removed = np.bincount(row, weights=b - a, minlength=n).astype(np.int64)
    edges = np.append(0, np.cumsum(runs))
    spans = [list(zip(a[i:j] - s, b[i:j] - s)) for i, j, s in zip(edges, edges[1:], begin)]
    kept = [bucket.data[s:e][~covered[s:e]].tobytes() if r else bucket.data[s:e].tobytes() for s, e, r in zip(begin, bucket.ends, runs)]
    return finish(bucket, spans, removed, runs, kept)


def _deduplicated(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Run the three rounds; ``finish`` makes the rows of a bucket's documents."""
    documents, _, parts = held(docs, [c for c in docs.columns if c != "text"])
    ask = lambda fn: lambda key, left, right: fn(key, left, right, parts)
    answered = lambda df: df.groupBy("to").applyInArrow(_answered, ROW_SQL).groupBy("to")
    asked = documents.groupBy("to").applyInArrow(lambda key, t: _ask_grams(key, t, parts), ROW_SQL)
    asked = documents.groupBy("to").cogroup(answered(asked)).applyInArrow(ask(_ask_phrases), ROW_SQL)
    asked = documents.groupBy("to").cogroup(answered(asked)).applyInArrow(ask(_ask_windows), ROW_SQL)
    return documents.groupBy("to").cogroup(answered(asked)).applyInArrow(lambda key, t, r: _cut(t, r, parts, finish), schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the removed ``spans``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(bucket, spans, removed, runs, kept):
        return pa.table({
            "doc_id": pc.struct_field(bucket.rows["row_"], "doc_id"),
            "n_bytes": pa.array(np.diff(np.append(0, bucket.ends)), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(runs, pa.int64()),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "spans": pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return _deduplicated(
        docs.select("doc_id", "text"), finish,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>",
    )


def cut_documents(docs: DataFrame, length: str | None = None) -> DataFrame:
    """``docs`` with the passages cut out of ``text``; of a character that is cut in part nothing
    stays.  ``length`` names a column that holds the number of characters."""
    order = docs.columns

    def finish(bucket, spans, removed, runs, kept):
        texts = [k.decode("utf-8", "ignore") for k in kept]
        rows, null = bucket.rows["row_"].combine_chunks(), bucket.rows["null_"].to_pylist()
        out = {}
        for c in order:
            if c == "text":
                out[c] = pa.array([None if n else t for n, t in zip(null, texts)], pa.string())
            elif c == length:
                old = pc.struct_field(rows, c).to_pylist()
                out[c] = pa.array([len(t) if r else o for t, r, o in zip(texts, runs, old)], rows.type.field(c).type)
            else:
                out[c] = pc.struct_field(rows, c)
        return pa.table(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _deduplicated(docs, finish, schema)
