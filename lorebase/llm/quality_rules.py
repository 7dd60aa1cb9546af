"""Quality rules: a threshold table compiled into one projection (operator 8).

Every signal is a built-in expression over the text of one row: no shuffle, no user
function.  Null, empty and blank texts have no words and fail; repeated rows are judged
alike, each by itself; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are neither read nor needed, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lorebase.llm.common import let, words

#: Frequent short function words of the four languages.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "como", "con", "del", "el", "es", "las", "los", "más", "no", "para", "por", "se", "su", "una", "y",
]

#: They count in lower case and with a capital; words all in capitals are shouting.
STOP_FORMS = sorted({w for x in STOP_WORDS for w in (x, x.capitalize())})

#: Words of a window whose second occurrence counts as repetition.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: ``low <= top / bottom <= high``, judged from
    ``min_words`` words on; a bottom of None stands for 1."""

    name: str
    top: str
    bottom: str | None
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Applied to texts that pass the two base rules.
THRESHOLDS = [
    Rule("word length", "word_chars", "n_words", low=2.0, high=25.0),
    Rule("symbols a word", "n_symbols", "n_words", high=0.25),
    Rule("exclamation marks a word", "n_marks", "n_words", high=0.5),
    Rule("stop words", "n_stop_words", "n_words", low=0.02, min_words=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.4),
]


def repeat_words(ws: Column) -> Column:
    """Number of words inside windows of five words that occur at least twice.

    Equal windows have equal hashes: a text whose hashes are all different has none.
    Only the other texts compare the windows themselves, sorted with their places.
    """
    last = F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))
    starts = F.slice(ws, F.lit(1), last)
    hashes = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda one: F.transform(F.slice(one, F.lit(1), last), lambda h, i: F.xxhash64(h, *(F.get(one, i + k) for k in range(1, WINDOW)))),
    )
    places = F.transform(starts, lambda _, i: F.struct(F.array_join(F.slice(ws, i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))

    def covered(ordered):
        twice = F.filter(
            ordered,
            lambda x, k: F.coalesce(F.get(ordered, k - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["w"] == x["w"], F.lit(False)),
        )
        found = F.array_sort(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            found, none,
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(places), covered)))


def signals(text: Column) -> Column:
    """A struct of the counts that the rules compare."""
    text = F.coalesce(text, F.lit(""))

    def counts(ws, lines):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(ws, lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda ws: let(lines, lambda ls: counts(ws, ls)))


def verdicts(s: Column, rules=None) -> Column:
    """``signals`` with ``base_failed``, ``kept`` and the name of the first rule broken."""
    n = s["n_words"]
    base = (n < 10) | (100 * s["n_repeat_words"] > 20 * n)
    broken = F.when(base, F.lit("base"))
    for r in THRESHOLDS if rules is None else rules:
        bottom = F.lit(1.0) if r.bottom is None else F.greatest(s[r.bottom], F.lit(1)).cast("double")
        ratio = s[r.top] / bottom
        out = [c for c in ((ratio < r.low) if r.low is not None else None, (ratio > r.high) if r.high is not None else None) if c is not None]
        if out:
            broken = broken.when((n >= r.min_words) & (out[0] if len(out) == 1 else out[0] | out[1]), F.lit(r.name))
    return let(broken, lambda b: F.struct(s.alias("signals"), base.alias("base_failed"), b.isNull().alias("kept"), b.alias("broken")))


def judged(docs: DataFrame, column: str, rules=None) -> DataFrame:
    """``docs`` with the verdict struct of its ``text`` under a name of the caller's."""
    return docs.withColumn(column, let(signals(F.col("text")), lambda s: verdicts(s, rules)))


def quality_rules(docs: DataFrame, rules=None) -> DataFrame:
    """One row per row of ``docs``: its counts and the verdict."""
    v = judged(docs.select("doc_id", "text"), "v", rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_marks", "n_lines", "n_stop_words"]
    return v.select(
        "doc_id", *(F.col(f"v.signals.{c}").alias(c) for c in counts),
        F.col("v.base_failed").alias("base_failed"), F.col("v.kept").alias("kept"),
        *(F.col(f"v.signals.{c}").alias(c) for c in more), F.col("v.broken").alias("broken"),
    )


def kept_documents(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    name = "verdict_of_" + "_".join(docs.columns)
    return judged(docs, name, rules).filter(F.col(f"`{name}`.kept")).drop(name)
