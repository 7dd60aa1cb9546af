"""Secret scans by sliding-window entropy (operator 12), built-in functions only.

Base rules find assignments of secrets, access keys and long hexadecimal strings by their form.
The method adds strings that look random: a candidate is a run of key characters, it
belongs to one character class (hexadecimal digits, digits and letters of one case, of both, or with
symbols), and every window of ``WINDOW`` characters has a Shannon entropy.  The window moves
by one character at a time, so two counts change and the sum of n log n changes by
their four terms; nothing is counted anew.  A candidate is a secret if a window reaches the entropy
of its class, unless the allow list knows its form or it lies in a url or in a span of a base rule.

Spans are ``kind, start, end`` in code points, the end not included.  Null and empty texts have none;
repeated rows are scanned each by itself; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are not read.  Entropies are compared as whole numbers (millionths), so
ties fall the same way everywhere.  One projection: no shuffle, no user function.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lorebase.llm.common import let

#: The forms of the base rules.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 8
#: A run that is long enough is found whole either way, so the least length can stand in the form.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"


@dataclass(frozen=True)
class Class:
    """Strings made of ``form`` only, and the least entropy in bits of a window of a secret."""

    form: str
    bits: float

    def most(self) -> int:
        """The largest sum of n log n, in millionths, of a window that reaches ``bits``."""
        return round(1_000_000 * WINDOW * (math.log2(WINDOW) - self.bits))


#: The first class that fits counts.
CLASSES = [
    Class("^[0-9a-f]+$", 3.0), Class("^[0-9A-F]+$", 3.0), Class("^[0-9a-z]+$", 3.5), Class("^[0-9A-Z]+$", 3.5),
    Class("^[0-9A-Za-z]+$", 3.7), Class("^[0-9A-Za-z+/_-]+$", 3.9),
]

#: Forms of strings that are no secrets.
ALLOWED = {
    "no digit": "^[^0-9]+$",
    "no letter": "^[^A-Za-z]+$",
    "uuid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "placeholder": "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|0{8}|1234567|abcdefg",
    "long word": "[a-z]{14}|[A-Z]{14}",
    "path": "[a-z]{3}/[a-z]{3}",
}
#: What stands before a candidate inside a url.
IN_URL = r"://[^\x20\x09-\x0D]*\z"

#: n log2 n in millionths, for the counts of a window.
N_LOG_N = [0, *(round(1_000_000 * n * math.log2(n)) for n in range(1, WINDOW + 1))]

_BLOCK = 128


def running(lengths: Column) -> Column:
    """Sums of what stands before each element, in blocks so that no long array grows by single elements."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))

    def summed(values):
        return F.aggregate(values, zero, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")))

    blocks = F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")))
    sums = F.transform(blocks, lambda b: summed(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(sums, lambda s: let(
        summed(F.transform(s, lambda x: x["total"])),
        lambda offsets: F.flatten(F.transform(s, lambda x, b: F.transform(x["before"], lambda y: y + F.get(offsets["before"], b)))),
    ))


def matches(text: Column, form: str) -> Column:
    """Matches of ``form`` from the left, each with its start, its text and the text before it since the last."""
    none = F.array().cast("array<struct<start:int,match:string,gap:string>>")

    def placed(found, gaps):
        lengths = F.transform(found, lambda m, k: F.length(m) + F.length(F.get(gaps, k + 1)))
        first = F.length(F.get(gaps, F.lit(0)))
        return let(running(lengths), lambda at: F.transform(
            found, lambda m, k: F.struct((first + F.get(at, k)).alias("start"), m.alias("match"), F.get(gaps, k).alias("gap"))
        ))

    all_of = lambda: let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: let(F.split(text, form, -1), lambda g: placed(m, g)))
    return F.when(text.rlike(form), all_of()).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["match"])).alias("end"), F.lit(kind).alias("kind"),
    ))


def least_sum(candidate: Column) -> Column:
    """The least sum of n log n, in millionths, over the windows of a candidate: that of its highest entropy."""
    terms = F.array(*(F.lit(x) for x in N_LOG_N))
    term = lambda n: F.get(terms, n)
    one = lambda c: c.cast("int")
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def moved(codes, state, i):
        new, old = F.get(codes, i), F.coalesce(F.get(codes, i - WINDOW), F.lit(-1))
        held, had = F.get(state["counts"], new), F.get(state["counts"], old)
        left = F.when(old < 0, state["sum"]).otherwise(state["sum"] - term(had) + term(had - 1))
        held = held - one(new == old)
        total = left - term(held) + term(held + 1)
        return let(total, lambda s: F.struct(
            F.transform(state["counts"], lambda n, k: n + one(k == new) - one(k == old)).alias("counts"), s.alias("sum"),
            F.when(i >= WINDOW - 1, F.least(state["least"], s)).otherwise(state["least"]).alias("least"),
        ))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"))
    return let(codes, lambda cs: F.aggregate(
        F.sequence(F.lit(0), F.size(cs) - 1), start, lambda state, i: moved(cs, state, i), lambda state: state["least"]
    ))


def looks_random(candidate: Column, classes=None, allowed=None) -> Column:
    """Whether a window of the candidate reaches the entropy of its class and no form of the allow list fits."""
    most = F.lit(-1)
    for c in reversed(CLASSES if classes is None else classes):
        most = F.when(candidate.rlike(c.form), c.most()).otherwise(most)
    known = F.lit(False)
    for form in (ALLOWED if allowed is None else allowed).values():
        known = known | candidate.rlike(form)
    return F.when(known, False).otherwise(least_sum(candidate) <= most)


def base_spans(text: Column) -> Column:
    """Spans of the base rules; ``text`` is not null."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.concat(_spans(assigned, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex"))


def random_spans(text: Column, base: Column, classes=None, allowed=None) -> Column:
    """Spans of strings that look random and touch no span of ``base``."""
    def new(m):
        start, end = m["start"], m["start"] + F.length(m["match"])
        touched = F.exists(base, lambda b: (b["start"] < end) & (start < b["end"]))
        return F.when(m["gap"].rlike(IN_URL), False).when(touched, False).otherwise(looks_random(m["match"], classes, allowed))

    return _spans(F.filter(matches(text, CANDIDATE), new), "entropy")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, classes=None, allowed=None) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the digest of the base spans, and all spans."""
    text = F.coalesce("text", F.lit(""))
    found = let(base_spans(text), lambda base: F.struct(base.alias("base"), random_spans(text, base, classes, allowed).alias("more")))
    rows = docs.select("doc_id", found.alias("found"))
    n = lambda kind: F.size(F.filter(F.col("found.base"), lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(F.col("found.base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("found.base", "found.more")).alias("spans"), F.size("found.more").cast("long").alias("n_entropy"),
    )
