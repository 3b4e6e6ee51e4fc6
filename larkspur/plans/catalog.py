"""Tables, their metadata, views and transactions of a session."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """A write would break a constraint; nothing was changed."""


class CatalogError(KeyError):
    """A table, view, savepoint or statement does not exist (or does already)."""


#: Declared SQL types and their Spark types.
SQL_TYPES = {
    "int": T.LongType(), "integer": T.LongType(), "bigint": T.LongType(), "smallint": T.LongType(), "tinyint": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "real": T.DoubleType(), "decimal": T.DoubleType(), "dec": T.DoubleType(), "numeric": T.DoubleType(),
    "string": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "uuid": T.StringType(), "json": T.StringType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(),
    "strings[]": T.ArrayType(T.StringType()), "string[]": T.ArrayType(T.StringType()), "floats[]": T.ArrayType(T.DoubleType()),
}


def sql_type(name: str) -> T.DataType:
    """Spark type of a declared type; a length or precision is accepted and ignored."""
    low = name.strip().lower()
    base = low if low.endswith("[]") else low.split("(")[0].strip()
    if base not in SQL_TYPES:
        raise CatalogError(f"unsupported data type: {name}")
    return SQL_TYPES[base]


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    not_null: bool = False
    default: str | None = None
    auto: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass(frozen=True)
class TableMeta:
    columns: tuple[Column, ...]
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    indexes: tuple[tuple[str, str, str], ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type) for c in self.columns])

    def describe(self) -> dict:
        """Plain values for a metadata file."""
        return {
            "columns": [
                {"name": c.name, "type": c.type.simpleString(), "primary_key": c.name in self.primary, "not_null": c.not_null, "default": c.default, "auto_increment": c.auto}
                for c in self.columns
            ],
            "primary": list(self.primary),
            "unique": [list(u) for u in self.unique],
            "checks": list(self.checks),
            "foreign": [vars(f) for f in self.foreign],
            "indexes": [list(i) for i in self.indexes],
        }

    @staticmethod
    def restore(spark: SparkSession, d: dict) -> TableMeta:
        def kind(s: str) -> T.DataType:
            return T._parse_datatype_string(s)

        return TableMeta(
            tuple(Column(c["name"], kind(c["type"]), c["not_null"], c.get("default"), c.get("auto_increment", False)) for c in d["columns"]),
            tuple(d["primary"]),
            tuple(tuple(u) for u in d["unique"]),
            tuple(d["checks"]),
            tuple(ForeignKey(**f) for f in d["foreign"]),
            tuple(tuple(i) for i in d.get("indexes", [])),
        )


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    body: str
    when: str | None = None


@dataclass
class State:
    """Everything a transaction can roll back; values are immutable, so a copy is shallow and cheap."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, TableMeta] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    sequences: dict[str, int] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)

    def copy(self) -> State:
        return replace(self, **{k: dict(v) for k, v in vars(self).items()})
