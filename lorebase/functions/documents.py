"""JSON texts: the source's canonical form, and containment."""

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F, types as T


def canonical_text(value) -> str:
    """Keys by length then bytes, ``": "`` and ``", "`` between parts."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {canonical_text(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(canonical_text(v) for v in value) + "]"
    if isinstance(value, _Number):
        return str(value)
    return json.dumps(value, ensure_ascii=False)


class _Number(str):
    """A JSON number kept as written."""


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        return canonical_text(json.loads(t, parse_int=_Number, parse_float=_Number))

    return text.map(one)


def contains(have, want, top: bool = True) -> bool:
    """Whether parsed JSON ``have`` contains ``want``.

    An object contains one whose keys it has with contained values; an array one whose
    elements are each contained in one of its own; other values contain their equals, of
    the same JSON type.  At the top an array also contains the plain values in it.
    """
    if isinstance(want, dict):
        return isinstance(have, dict) and all(k in have and contains(have[k], v, False) for k, v in want.items())
    if isinstance(want, list):
        return isinstance(have, list) and all(any(contains(h, w, False) for h in have) for w in want)
    if top and isinstance(have, list):
        return any(contains(h, want, False) for h in have)
    return type(have) is type(want) and have == want


@F.pandas_udf(T.BooleanType())
def contains_any(have: pd.Series, wanted: pd.Series) -> pd.Series:
    """Whether a JSON text contains one of a list of JSON texts; broken or missing ones match nothing."""
    def parsed(text):
        return json.loads(text, parse_int=Decimal, parse_float=Decimal)

    def one(text, texts):
        if text is None or texts is None:
            return False
        try:
            value = parsed(text)
        except ValueError:
            return False
        for t in texts:
            try:
                if t is not None and contains(value, parsed(t)):
                    return True
            except ValueError:
                continue
        return False

    return pd.Series([one(h, w) for h, w in zip(have, wanted)], dtype=bool)
