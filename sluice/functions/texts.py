"""Functions that need exact text arithmetic, as Arrow-batched UDFs."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Number(str):
    """A JSON number kept as it was written."""


def _dump(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def normalized_json(text: str | None) -> str | None:
    """JSON without white space, keys in order, the last of repeated keys, numbers of any precision as written.

    An SQL null stays null and differs from the JSON value null.
    """
    return None if text is None else _dump(json.loads(text, parse_float=_Number, parse_int=_Number))


def normalized_number(text: str | None) -> str | None:
    """Plain text of a number of any precision; NaN and infinities pass."""
    if text is None or text in ("NaN", "Infinity", "-Infinity"):
        return text
    try:
        number = Decimal(text)
    except InvalidOperation:
        raise ValueError(f"not a number: {text!r}") from None
    plain = f"{number:f}"
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return "0" if not number else plain


@F.pandas_udf(T.StringType())
def json_normalize(text: pd.Series) -> pd.Series:
    return text.map(normalized_json, na_action="ignore")


@F.pandas_udf(T.StringType())
def number_normalize(text: pd.Series) -> pd.Series:
    return text.map(normalized_number, na_action="ignore")
