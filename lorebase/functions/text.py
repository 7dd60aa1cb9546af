"""Text analysis: tokens, stop words and English stems as Spark columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Fixed value: a token is a run of letters and digits.
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"

# The English stop words of the source's text search configuration.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now""".split()
)

# Fixed values of the published English (Porter 2) stemming algorithm.
_VOWELS = frozenset("aeiouy")
_DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
_LI_ENDINGS = frozenset("cdeghkmnrt")
_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = frozenset(
    "inning outing canning herring earring proceed exceed succeed".split()
)
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
    ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"),
    ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
)


def _region(word: str, start: int) -> int:
    """Index after the first non-vowel that follows a vowel, from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return (
        len(word) > 2
        and word[-1] not in _VOWELS
        and word[-1] not in "wxY"
        and word[-2] in _VOWELS
        and word[-3] not in _VOWELS
    )


def stem(word: str) -> str:
    """English stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE_WORDS:
        return _WHOLE_WORDS[word]
    chars = list(word)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VOWELS):
            chars[i] = "Y"
    word = "".join(chars)

    r1 = next(
        (len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)),
        None,
    ) or _region(word, 0)
    r2 = _region(word, r1)

    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if any(c in _VOWELS for c in word[:-2]):
            word = word[:-1]
    if word in _AFTER_PLURAL:
        return word

    # past and continuous forms
    suffix = next(
        (s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(s)), ""
    )
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: len(word) - len(suffix)] + "ee"
    elif suffix:
        head = word[: len(word) - len(suffix)]
        if any(c in _VOWELS for c in head):
            word = head
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:] in _DOUBLES:
                word = word[:-1]
            elif _ends_short(word) and r1 >= len(word):
                word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    # derived endings, longest first
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: len(word) - len(end)] + new
            break
    else:
        if word.endswith("ogi"):
            if len(word) - 3 >= r1 and word[-4:-3] == "l":
                word = word[:-1]
        elif word.endswith("li"):
            if len(word) - 2 >= r1 and word[-3:-2] in _LI_ENDINGS:
                word = word[:-2]

    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: len(word) - len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]

    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: len(word) - len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]

    if word.endswith("e"):
        cut = len(word) - 1
        if cut >= r2 or (cut >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def english_lexeme(token: str) -> str | None:
    """Stem of a token, None for a stop word; tokens with digits stay as they are."""
    if token in STOP_WORDS:
        return None
    return stem(token) if token.isalpha() else token


@F.arrow_udf(T.ArrayType(T.StringType()))
def _english_lexemes(tokens: pa.Array) -> pa.Array:
    """Lexeme of every token; each distinct token of a batch is stemmed once."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([english_lexeme(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int32)
    offsets = pa.array(np.concatenate([np.zeros(1, dtype=np.int32), ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices))


def tokens(text: Column) -> Column:
    """Lower-case tokens of the whole text; NULL text gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(1))


def lexemes(text: Column, config: str = "english") -> Column:
    """One lexeme per token position; a stop word leaves a NULL in its place."""
    if config == "simple":
        return tokens(text)
    if config == "english":
        return _english_lexemes(tokens(text))
    raise ValueError(f"unknown text configuration {config!r}")
