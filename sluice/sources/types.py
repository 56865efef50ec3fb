"""Source types by object id, and what they become."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Source type ids and their Spark types; json, uuid, time and unbounded numerics are text.
BASE = {
    16: T.BooleanType(), 21: T.IntegerType(), 23: T.IntegerType(), 20: T.LongType(), 700: T.DoubleType(), 701: T.DoubleType(),
    25: T.StringType(), 1042: T.StringType(), 1043: T.StringType(), 17: T.BinaryType(), 1082: T.DateType(), 1114: T.TimestampNTZType(), 1184: T.TimestampType(),
    2950: T.StringType(), 1083: T.StringType(), 114: T.StringType(), 3802: T.StringType(),
}
NUMERIC = 1700
#: Types that can't be part of a key.
NO_KEYS = frozenset({114, 3802})
DEPTH = 32


@dataclass(frozen=True)
class SourceType:
    """kind: base, domain, array, enum or vector; of: the type a domain or array is made of."""

    kind: str
    of: int | None = None
    modifier: int = -1


def resolve(oid: int, modifier: int = -1, registry: dict[int, SourceType] | None = None) -> T.DataType:
    """The Spark type of a source type; domains are followed, arrays, enums and vectors become text; others are refused."""
    for _ in range(DEPTH):
        own = (registry or {}).get(oid)
        if own is None or own.kind == "base":
            break
        if own.kind in ("enum", "vector"):
            return T.StringType()
        if own.kind == "array":
            resolve(own.of, -1, registry)
            return T.StringType()
        oid, modifier = own.of, own.modifier if modifier < 0 else modifier
    else:
        raise ValueError(f"type {oid} nests too deeply")
    if oid == NUMERIC:
        packed = modifier - 4
        precision, scale = packed >> 16 & 0xFFFF, (packed & 0x7FF ^ 1024) - 1024
        return T.DecimalType(precision, scale) if modifier >= 4 and 1 <= precision <= 38 and 0 <= scale <= precision else T.StringType()
    if oid not in BASE:
        raise ValueError(f"type {oid} isn't supported")
    return BASE[oid]


def may_be_key(oid: int, registry: dict[int, SourceType] | None = None) -> bool:
    """Whether a column of this type may be part of a key."""
    own = (registry or {}).get(oid)
    if own is not None and own.kind == "domain":
        return may_be_key(own.of, registry)
    kind = resolve(oid, -1, registry)
    return not (own is not None and own.kind in ("array", "vector")) and oid not in NO_KEYS and not isinstance(kind, T.DoubleType)
