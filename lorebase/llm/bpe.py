"""Byte-level BPE by prefix dynamic programming (operator 9).

For every prefix of a byte string exactly one token can be the last of its encoding.
``PrefixTable`` stores that token for each prefix.  A token ``t`` ends prefix ``i`` when it
matches there and stands validly after the last token of prefix ``i - len(t)``: merging
the bytes of the two alone gives the same two tokens.  The encoding is read off backwards;
appended bytes extend the table, and an edit recomputes it only until it agrees with
the old one over the length of the longest token.

Texts are split by the tokenizer's pattern and each match is encoded by itself.  A null
text counts as empty and has no tokens; very long texts take time in proportion to
their length; repeated rows are encoded alike; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are not read.
"""

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame

from lorebase.llm.common import per_process

#: Distinct matches whose ids one Python worker remembers.
REMEMBERED = 400_000
#: Characters of text that are split at once, about.
BATCH_CHARS = 2_000_000


class Vocabulary:
    """Ranks of byte strings, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._stands: dict[int, bool] = {}
        self._grown: dict[int, tuple[list, list]] = {}

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The definition: merge the pair of lowest rank until none, or ``until`` parts, are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stands(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self._stands:
            self._stands[token] = len(self.merged(self.bytes_of[token])) == 1
        return self._stands[token]

    def _edges(self, token: int):
        """The parts that form the left and the right edge of a token while its bytes
        are merged, each with the rank of the merge that ends it."""
        found = self._grown.get(token)
        if found is None:
            data = self.bytes_of[token]
            left, right = [], []
            if len(data) > 1:
                a, b = (self.ranks[x] for x in self.merged(data, until=2))
                left = [(x, min(end, token)) for x, end in self._edges(a)[0]]
                right = [(x, min(end, token)) for x, end in self._edges(b)[1]]
            never = len(self.ranks)
            found = self._grown[token] = ([*left, (data, never)], [*right, (data, never)])
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just the two.

        A merge makes a token of higher rank than its parts, so merges happen in the order
        of ranks, and the two stay apart unless parts at the border merge before either is
        taken into a larger part of its own token; of equal ranks the leftmost comes first.
        """
        fine = self._fits.get((left, right))
        if fine is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            fine = self.stands(left) and self.stands(right)
            if fine:
                rank_of, never = self.ranks.get, len(self.ranks)
                for a, a_ends in self._edges(left)[1]:
                    for b, b_ends in self._edges(right)[0]:
                        r = rank_of(a + b, never)
                        if r < a_ends and r <= b_ends and r < never:
                            fine = False
            self._fits[left, right] = fine
        return fine

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """``last[i]``: the last token of the encoding of the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, first: int, last_end: int) -> None:
        """Find the last tokens of the prefixes of ``first`` to ``last_end`` bytes."""
        v, data, last = self.vocabulary, self.data, self.last
        rank_of, known, longest = v.ranks.get, v._fits.get, v.longest
        for end in range(first, last_end + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank_of(data[start:end])
                if token is None:
                    continue
                if start:
                    fine = known((last[start - 1], token))
                    if fine is None:
                        fine = v.fits(last[start - 1], token)
                else:
                    fine = v.stands(token)
                if fine:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        self._extend(at + 1, len(self.data))

    def become(self, data: bytes) -> "PrefixTable":
        """Turn into the table of ``data``, keeping what it shares with the old bytes."""
        old, at = self.data, 0
        most = min(len(old), len(data))
        while at < most and old[at] == data[at]:
            at += 1
        self.data = data
        del self.last[at:]
        self._extend(at + 1, len(data))
        return self

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` in the place of bytes ``start:end``; the number of entries recomputed."""
        old, tail = self.last, self.data[end:]
        self.data = self.data[:start] + by + tail
        self.last = old[:start]
        shift, same = end - start - len(by), 0
        for i in range(start, len(self.data)):
            self._extend(i + 1, i + 1)
            if i >= start + len(by):
                same = same + 1 if self.last[i] == old[i + shift] else 0
                if same >= self.vocabulary.longest:
                    self.last += old[i + shift + 1 :]
                    return i + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts: split by ``pattern``, each match encoded by itself and remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.split, self.remembered = vocabulary, regex.compile(pattern).findall, remembered
        self._known: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, texts) -> Iterator[list[int]]:
        """The ids of each text.  New matches are encoded in sorted order, so that
        neighbours share the table of their common prefix."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)

    def _encode_some(self, texts):
        known, rank_of = self._known, self.vocabulary.ranks.get
        if len(known) > self.remembered:
            known.clear()
        split = [self.split(t) for t in texts]
        table = PrefixTable(self.vocabulary)
        for data, piece in sorted((p.encode(), p) for p in set(chain.from_iterable(split)).difference(known)):
            whole = rank_of(data)
            known[piece] = (whole,) if whole is not None else tuple(table.become(data).ids())
        for pieces in split:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self._encode_some([text]))


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python process for one vocabulary file."""
    return per_process(("encoder", path, pattern), lambda: Encoder(Vocabulary.read(path), pattern))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every text."""

    def run(batches):
        encode = encoder(path, pattern).encode_batch
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": list(encode(t or "" for t in b["text"]))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes of ``ids``."""

    def run(batches):
        decode = encoder(path, pattern).vocabulary.decode
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": [decode(ids) for ids in b["ids"]]})

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes decoded from them, in one pass."""

    def run(batches):
        enc = encoder(path, pattern)
        names = {i: str(i) for i in enc.vocabulary.bytes_of}
        for b in batches:
            rows = []
            for ids in enc.encode_batch(text or "" for text in b["text"]):
                said = " ".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(enc.vocabulary.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
