"""Which of many terms a text contains, by one pass over the text."""

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F, types as T


def automata(rows) -> dict:
    """One automaton per owner from ``(owner, term to look for, name)``; several names may share a term."""
    names = defaultdict(lambda: defaultdict(list))
    for owner, term, name in rows:
        names[owner][term].append(name)
    out = {}
    for owner, terms in names.items():
        out[owner] = ahocorasick.Automaton()
        for term, named in terms.items():
            out[owner].add_word(term, named)
        out[owner].make_automaton()
    return out


def contained(spark: SparkSession, rows, owner: str, texts: list[str]) -> Column:
    """Sorted names of the owner's terms that occur in any of the columns ``texts``, as a column.

    ``rows`` are sent to all tasks, so the caller bounds their bytes.  Each task builds the
    automata once; after that a text costs its own length and its hits, however many terms
    there are.  Terms must not be empty.  A null text contains nothing, a null owner has no terms.
    """
    sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        built = automata(sent.value)
        for owners, *columns in batches:
            hits = []
            for of, *values in zip(owners.to_pylist(), *(c.to_pylist() for c in columns)):
                machine = built.get(of)
                hits.append(sorted({n for v in values if v and machine is not None for _, named in machine.iter(v) for n in named}))
            yield pa.array(hits, pa.list_(pa.string()))

    return found(F.col(owner), *(F.col(t) for t in texts))
