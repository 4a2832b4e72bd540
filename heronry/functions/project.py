"""Projection of nested records onto closed lists of paths, and visibility kept in the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERNAL = {"visibility": "internal"}


def tree_of(paths: list[str]) -> dict:
    """The paths (`a.b`, `c[].d`) as nested dictionaries; a leaf is empty."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})
    return tree


def rebuilt(value: Column, kind: T.DataType, tree: dict, where: str) -> Column:
    """`value` with only the paths of `tree`; a path that its type doesn't have is an error."""
    if not tree:
        return value
    if not isinstance(kind, T.StructType):
        raise ValueError(f"{where} has no fields")
    parts = []
    for step, below in tree.items():
        name = step.removesuffix("[]")
        if name not in kind.fieldNames():
            raise ValueError(f"unknown path {where}.{name}".replace("..", "."))
        inner = kind[name].dataType
        if step.endswith("[]"):
            if not isinstance(inner, T.ArrayType):
                raise ValueError(f"{where}.{name} is no list")
            out = F.transform(value[name], each_rebuilt(inner.elementType, below, f"{where}.{name}[]"))
        else:
            out = rebuilt(value[name], inner, below, f"{where}.{name}")
        parts.append(out.alias(name))
    return F.struct(*parts)


def each_rebuilt(kind: T.DataType, tree: dict, where: str):
    return lambda x: rebuilt(x, kind, tree, where)


def project(df: DataFrame, paths: list[str]) -> DataFrame:
    """Only the listed paths of each row; Spark reads no other column."""
    whole = F.struct(*df.columns)
    return df.select(rebuilt(whole, df.schema, tree_of(paths), "").alias("__r")).select("__r.*")


def mark_internal(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c, metadata=INTERNAL) if c in names else F.col(c) for c in df.columns))


def public_columns(df: DataFrame) -> list[str]:
    """Columns that the schema doesn't mark as internal."""
    return [f.name for f in df.schema.fields if f.metadata.get("visibility") != "internal"]
