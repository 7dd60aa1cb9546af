"""Documents in buckets, and questions to dictionaries that are spread over parts.

Documents travel once, compressed, to the bucket of their id.  A bucket asks the parts of a
dictionary about its keys, each key once; a part sorts what all buckets sent and replies
in the order of the questions.  The parts are ranges of hashed keys.  A key costs each
part one entry per bucket, however many documents have it.
"""

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of text in a bucket of documents, and behind a part of a dictionary.
BUCKET_BYTES, PART_BYTES = 4 << 20, 32 << 20

# Fixed random numbers: they number bytes and mix hashes.
_RANDOM = np.random.default_rng(20)
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LAST = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * ODD[15]
    return h ^ (h >> np.uint64(32))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal width; sorted keys have sorted parts."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def ids_to_bytes(ids: np.ndarray) -> bytes:
    small = len(ids) == 0 or (ids.min() >= 0 and ids.max() < 2**32 - 1)
    return (b"4" + ids.astype("<u4").tobytes()) if small else (b"8" + ids.astype("<i8").tobytes())


def ids_from_bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(b[1:], "<u4" if b[:1] == b"4" else "<i8").astype(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


class Owners:
    """Distinct (key, more) of a bucket in order, each with its smallest document id.

    ``width`` is the number of bytes of ``more`` that count.
    """

    def __init__(self, key: np.ndarray, more: np.ndarray, ids: np.ndarray, width: int = 2):
        self.width = width
        order = np.lexsort((ids, more, key))
        new = runs(key[order], more[order])
        first = order[new]
        self.key, self.more, self.id = key[first], more[first], ids[first]
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def packs(self, parts: int):
        edges = np.searchsorted(part_of(self.key, parts), np.arange(parts + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                yield p, self.key[a:b].tobytes(), low_bytes(self.more[a:b], self.width) + ids_to_bytes(self.id[a:b])


def _least(rows, width: int):
    """For packs of ``Owners``: their sizes, ids, and the least id that any bucket has for each entry."""
    key = np.concatenate([np.frombuffer(a, "<u8") for a, _ in rows])
    sizes = [len(a) // 8 for a, _ in rows]
    more = np.concatenate([from_low_bytes(b[: width * n], width) for (_, b), n in zip(rows, sizes)])
    ids = np.concatenate([ids_from_bytes(b[width * n :]) for (_, b), n in zip(rows, sizes)])
    order = np.lexsort((ids, more, key))
    new = runs(key[order], more[order])
    least = np.empty(len(key), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    return np.cumsum(sizes)[:-1], ids, least


def smaller_elsewhere(rows) -> list[bytes]:
    """A bit per entry, whether another bucket has a smaller id."""
    at, ids, least = _least(rows, 2)
    return [np.packbits(x).tobytes() for x in np.split(least < ids, at)]


def least_anywhere(rows, width: int) -> list[bytes]:
    """The least id of each entry."""
    at, _, least = _least(rows, width)
    return [ids_to_bytes(x) for x in np.split(least, at)]


_ROW = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("sender", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
ROW_SQL = "to bigint, kind string, sender bigint, a binary, b binary"


def table_of(rows) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_ROW)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)


def replies(answers: pa.Table, kind: str, parts_of: np.ndarray, parts: int) -> np.ndarray:
    """The bits for all entries of a bucket, in their order; entries without one are False."""
    edges = np.searchsorted(parts_of, np.arange(parts + 1))
    out = np.zeros(len(parts_of), bool)
    for r in answers.filter(pc.equal(answers["kind"], kind)).to_pylist():
        a, b = edges[r["sender"]], edges[r["sender"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=b - a).astype(bool)
    return out


def note(bucket: int, parts: int, *arrays: np.ndarray):
    """A row by which a bucket tells arrays to itself in the next round; truth values as bits."""
    packed = [np.packbits(a) if a.dtype == bool else a for a in arrays]
    kinds = [("?" if a.dtype == bool else a.dtype.str, len(a)) for a in arrays]
    data = pa.py_buffer(b"".join(p.tobytes() for p in packed))
    return (bucket % parts, "note", bucket, pa.compress(data, codec="zstd", asbytes=True), json.dumps([data.size, kinds]).encode())


def noted(answers: pa.Table) -> list[np.ndarray]:
    r = answers.filter(pc.equal(answers["kind"], "note")).to_pylist()[0]
    size, kinds = json.loads(r["b"])
    data, at, out = pa.decompress(r["a"], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for kind, n in kinds:
        if kind == "?":
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        else:
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
    return out


class Bucket:
    """The documents of one bucket in a fixed order, their bytes laid end to end."""

    def __init__(self, blobs: pa.Table):
        tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs["blob"]]
        rows = pa.concat_tables(tables)
        if tables:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("id_", "ascending"), ("bytes_", "ascending")]))
        self.rows = rows
        self.id = rows["id_"].to_numpy()
        texts = rows["bytes_"].to_pylist()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])


def held(docs: DataFrame, carried, bucket_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """The documents as compressed tables keyed by bucket, and the numbers of buckets and parts.

    ``carried`` columns travel along as a struct.  All sizes follow from the bytes of text.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(1, -(-total // (bucket_bytes or BUCKET_BYTES))), max(1, -(-total // PART_BYTES))
    key = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(buckets))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row_"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id_"),
        F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("bytes_"),
        F.col("text").isNull().alias("null_"), key.alias("bucket_"),
    )

    def blobs(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.take(pc.sort_indices(t, sort_keys=[("bucket_", "ascending")]))
            of = t["bucket_"].to_numpy()
            t = t.drop_columns(["bucket_"])
            at = np.flatnonzero(runs(of))
            out = []
            for a, b in zip(at, np.append(at[1:], len(of))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                    w.write_table(t.slice(a, b - a).combine_chunks())
                out.append(sink.getvalue().to_pybytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(of[at], pa.int64()), pa.array(out, pa.binary())], ["to", "blob"])

    return rows.mapInArrow(blobs, "to bigint, blob binary"), buckets, parts
