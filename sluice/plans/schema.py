"""Table specifications, their validation and their append-only evolution."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.BinaryType, T.DateType, T.TimestampNTZType, T.TimestampType, T.DecimalType)


@dataclass(frozen=True)
class ColumnSpec:
    id: int
    name: str
    type: T.DataType
    nullable: bool = True


@dataclass(frozen=True)
class SortField:
    column: str
    ascending: bool = True
    nulls_first: bool = True


@dataclass(frozen=True)
class TableSpec:
    """A table: columns with ids, key (empty: rows without identity), sort order and format version (2: position deletes, 3: vectors)."""

    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()
    version: int = 1
    append_only: bool = False
    sort: tuple[SortField, ...] = ()
    format_version: int = 2
    properties: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        ids, names = [c.id for c in self.columns], [c.name for c in self.columns]
        if len(set(ids)) != len(ids) or min(ids, default=1) < 1 or len(set(names)) != len(names) or "" in names:
            raise ValueError("column ids must be unique and positive, names unique")
        for c in self.columns:
            if not isinstance(c.type, SCALARS):
                raise ValueError(f"column {c.name} has an unsupported type")
        by_name = {c.name: c for c in self.columns}
        for k in self.key:
            if k not in by_name or by_name[k].nullable or isinstance(by_name[k].type, T.DoubleType):
                raise ValueError(f"key column {k} must exist, be required and not be floating")
        if len(set(self.key)) != len(self.key):
            raise ValueError("key columns repeat")
        if not self.key and not self.append_only:
            raise ValueError("a table whose rows change needs a key")
        if self.format_version not in (2, 3):
            raise ValueError("format version is 2 or 3")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable, {"field_id": c.id}) for c in self.columns])

    def to_json(self) -> dict:
        return {
            "name": self.name, "key": list(self.key), "version": self.version, "append_only": self.append_only, "format_version": self.format_version, "properties": self.properties,
            "sort": [[s.column, s.ascending, s.nulls_first] for s in self.sort], "columns": [[c.id, c.name, c.type.jsonValue(), c.nullable] for c in self.columns],
        }

    @classmethod
    def from_json(cls, x: dict) -> TableSpec:
        columns = tuple(ColumnSpec(i, n, T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": b, "metadata": {}}]})[0].dataType, b) for i, n, t, b in x["columns"])
        return cls(x["name"], columns, tuple(x["key"]), x["version"], x["append_only"], tuple(SortField(*s) for s in x["sort"]), x["format_version"], x["properties"])


def infer_spec(df: DataFrame, name: str, key: tuple[str, ...] = (), **more) -> TableSpec:
    """A specification from a DataFrame's schema; key columns become required."""
    columns = tuple(ColumnSpec(i, f.name, f.dataType, f.nullable and f.name not in key) for i, f in enumerate(df.schema.fields, 1))
    return TableSpec(name, columns, tuple(key), append_only=not key, **more)


def discover(relations: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None, format_version: int = 2) -> dict:
    """A configuration for source relations: each with its columns, types, key and mode, and what keeps a column out."""
    tables = []
    for name, df in sorted(relations.items()):
        key = tuple((keys or {}).get(name, ()))
        legal = [f for f in df.schema.fields if isinstance(f.dataType, SCALARS)]
        spec = infer_spec(df.select(*[f"`{f.name}`" for f in legal]), name, key, format_version=format_version)
        tables.append(spec.to_json() | {"excluded": {f.name: f"unsupported type {f.dataType.simpleString()}" for f in df.schema.fields if f not in legal}})
    return {"tables": tables}


def configured(config: dict) -> list[TableSpec]:
    """The specifications of a configuration as :func:`discover` makes them."""
    return [TableSpec.from_json({k: v for k, v in t.items() if k != "excluded"}) for t in config["tables"]]


def preflight(relations: dict[str, DataFrame], specs: list[TableSpec]) -> DataFrame:
    """(table_name, check, ok, detail): whether each relation can be copied as its specification says, all rows looked at once."""
    out = []
    for spec in specs:
        df = relations.get(spec.name)
        add = lambda check, ok, detail="", spec=spec: out.append((spec.name, check, ok, detail))
        add("relation exists", df is not None)
        if df is None:
            continue
        missing = [c.name for c in spec.columns if c.name not in df.columns]
        add("columns exist", not missing, ", ".join(missing))
        if missing:
            continue
        required = [c.name for c in spec.columns if not c.nullable]
        fault = violations(df, spec)
        found = df.agg(F.count("*").alias("n"), F.count(fault).alias("bad"), F.min(fault).alias("first"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{i}") for i, c in enumerate(required)]).first()
        nulls = [c for i, c in enumerate(required) if found[f"null_{i}"]]
        add("required columns hold no nulls", not nulls, ", ".join(nulls))
        add("values fit their types", not found["bad"], found["first"] or "")
        if spec.key:
            repeated = df.groupBy(*spec.key).count().where("count > 1").limit(1).count()
            add("key is unique", not repeated)
    spark = next(iter(relations.values())).sparkSession
    return spark.createDataFrame(out, "table_name string, check string, ok boolean, detail string")


def check_successor(old: TableSpec, new: TableSpec) -> None:
    """Raise unless ``new`` only appends nullable columns and relaxes columns outside the key."""
    if new.name != old.name or new.version != old.version + 1 or new.key != old.key or new.append_only != old.append_only:
        raise ValueError("a successor keeps table, key and mode and raises the version by one")
    if len(new.columns) < len(old.columns):
        raise ValueError("a successor keeps all columns")
    for a, b in zip(old.columns, new.columns, strict=False):
        if (a.id, a.name, a.type) != (b.id, b.name, b.type) or b.nullable != a.nullable and (a.nullable or a.name in old.key):
            raise ValueError(f"column {a.name} changed")
    for c in new.columns[len(old.columns) :]:
        if not c.nullable:
            raise ValueError(f"added column {c.name} must be nullable")


def successor(old: TableSpec, source: T.StructType) -> TableSpec:
    """The next version after the source relation became ``source``: its new columns appended, nullable, with new ids."""
    have = {c.name: c for c in old.columns}
    named = {f.name: f for f in source.fields}
    if missing := [n for n in have if n not in named]:
        raise ValueError(f"columns were dropped: {missing}")
    kept = tuple(replace(c, nullable=c.nullable or named[c.name].nullable and c.name not in old.key) for c in old.columns)
    top = max((c.id for c in old.columns), default=0)
    added = tuple(ColumnSpec(top + i, f.name, f.dataType, True) for i, f in enumerate((f for f in source.fields if f.name not in have), 1))
    new = replace(old, columns=kept + added, version=old.version + 1)
    check_successor(old, new)
    return new


def relaxed(spec: TableSpec, df: DataFrame) -> TableSpec:
    """``spec`` or, if required columns outside the key hold nulls in ``df``, its successor where they don't have to."""
    required = [c.name for c in spec.columns if not c.nullable and c.name not in spec.key]
    if not required:
        return spec
    found = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in required]).first()
    with_null = {c for c in required if found[c]}
    if not with_null:
        return spec
    new = replace(spec, columns=tuple(replace(c, nullable=c.nullable or c.name in with_null) for c in spec.columns), version=spec.version + 1)
    check_successor(spec, new)
    return new


def project(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of an older version in the columns of ``spec``: what is missing is null."""
    return df.select(*[F.col(c.name).cast(c.type).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.type).alias(c.name) for c in spec.columns])


def violations(df: DataFrame, spec: TableSpec) -> F.Column:
    """The name of the first column whose value breaks the specification, else null."""
    found = F.lit(None).cast("string")
    for c in reversed(spec.columns):
        bad = F.lit(False)
        if not c.nullable:
            bad = F.col(c.name).isNull()
        if isinstance(c.type, T.DecimalType) and c.name in df.columns:
            bad = bad | (F.col(c.name).isNotNull() & F.expr(f"try_cast(`{c.name}` as {c.type.simpleString()})").isNull())
        found = F.when(bad, F.lit(c.name)).otherwise(found)
    return found
