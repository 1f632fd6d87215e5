"""Full-text projection of nested JSON records by a mapping compiled to Columns.

A mapping names a target, a dotted source path, a role and whether it is
required.  Records of a known type are walked with built-in functions: a path
fans out over every array on its way.  JSON text is read as VARIANT and walked
level by level, so no path needs a schema.
"""

from __future__ import annotations

import json as jsonlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from veristrata.functions import text as T

ROLES = ("full_text", "filter", "sort", "metadata")


@dataclass(frozen=True)
class Mapping:
    target: str
    path: str
    role: str
    required: bool = False

    def __post_init__(self):
        if not self.target.strip() or not self.path.strip():
            raise ValueError("a mapping needs a target and a path")
        if self.role not in ROLES:
            raise ValueError(f"unknown role {self.role}")


def typed_values(schema: t.StructType, path: str) -> Column | None:
    """Texts of all scalars at a dotted path of a record type, as an array; null if the type has no such path."""
    name, _, rest = path.partition(".")
    if name not in schema.names:
        return None
    return _descend(F.col(f"`{name}`"), schema[name].dataType, rest)


def _descend(value: Column, kind: t.DataType, rest: str) -> Column | None:
    if isinstance(kind, t.ArrayType):
        # The element's expression is built inside the lambda; its absence shows before.
        inner = kind.elementType
        if not _exists(inner, rest):
            return None
        return F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: F.coalesce(_descend(x, inner, rest), F.array().cast("array<string>"))))
    if isinstance(kind, t.StructType):
        name, _, more = rest.partition(".")
        return _descend(value[name], kind[name].dataType, more) if rest and name in kind.names else None
    return None if rest else F.filter(F.array(value.cast("string")), lambda x: x.isNotNull())


def _exists(kind: t.DataType, rest: str) -> bool:
    if isinstance(kind, t.ArrayType):
        return _exists(kind.elementType, rest)
    if isinstance(kind, t.StructType):
        name, _, more = rest.partition(".")
        return bool(rest) and name in kind.names and _exists(kind[name].dataType, more)
    return not rest


def project(records: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """``records`` with a map per role (keys in order) and ``error``, the first required target without a value."""
    values = {}
    for m in mappings:
        v = typed_values(records.schema, m.path)
        values[m.target] = F.array().cast("array<string>") if v is None else F.filter(v, lambda x: ~T.is_blank(x))
    joined = {m.target: F.array_join(values[m.target], " ") for m in mappings}
    error = F.coalesce(*[F.when(F.size(values[m.target]) == 0, m.target) for m in mappings if m.required], F.lit(None).cast("string"))
    out = {}
    for role in ROLES[:3]:
        own = sorted((m.target for m in mappings if m.role == role))
        out[role] = F.create_map(*[x for n in own for x in (F.lit(n), joined[n])]) if own else F.create_map().cast("map<string,string>")
    meta = sorted(m.target for m in mappings if m.role == "metadata")
    # A single value stands alone, several (or none) form an array.
    unwrapped = {n: F.when(F.size(values[n]) == 1, F.to_json(values[n]).substr(F.lit(2), F.length(F.to_json(values[n])) - 2)).otherwise(F.to_json(values[n])) for n in meta}
    out["metadata"] = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(jsonlib.dumps(n) + ":"), unwrapped[n]) for n in meta]), F.lit("}"))
    return records.withColumns({**out, "error": error})


def path_items(kind: t.DataType, value: Column, steps: list[str]) -> Column:
    """The objects at a dotted path, as an array: arrays on the way are fanned out, one at the end is spread by one level, scalars give nothing."""
    if not steps:
        if isinstance(kind, t.ArrayType):
            return F.coalesce(value, F.array().cast(kind))
        return F.filter(F.array(value), lambda x: x.isNotNull())
    if isinstance(kind, t.ArrayType):
        inner = kind.elementType
        return F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: path_items(inner, x, steps)))
    return path_items(kind[steps[0]].dataType, value[steps[0]], steps[1:])


def _leads_to_objects(kind: t.DataType, steps: list[str]) -> bool:
    if steps and isinstance(kind, t.ArrayType):
        return _leads_to_objects(kind.elementType, steps)
    if steps:
        return isinstance(kind, t.StructType) and steps[0] in kind.names and _leads_to_objects(kind[steps[0]].dataType, steps[1:])
    return isinstance(kind.elementType if isinstance(kind, t.ArrayType) else kind, t.StructType)


def project_items(records: DataFrame, object_id: str, item_path: str, mappings: list[Mapping]) -> DataFrame:
    """One projected record per object at a dotted item path; ids are ``base::%04d``; ValueError for a path that leads to none."""
    steps = [p for p in item_path.split(".") if p]
    if not steps or not _leads_to_objects(records.schema, steps):
        raise ValueError(f"no objects at {item_path}")
    found = path_items(records.schema[steps[0]].dataType, F.col(f"`{steps[0]}`"), steps[1:])
    items = records.select(F.col(object_id).alias("_base"), F.posexplode(found).alias("_i", "_item"))
    rows = items.select(F.format_string("%s::%04d", F.col("_base").cast("string"), F.col("_i").cast("long")).alias("object_id"), "_item.*")
    return project(rows, mappings)


def field_at(records: DataFrame, path: str) -> Column:
    """The column at a dotted path of records; ValueError names the first step that the type doesn't have."""
    kind, at = records.schema, []
    for step in path.split("."):
        if not isinstance(kind, t.StructType) or step not in kind.names:
            raise ValueError(f"unknown field {step} in {path}")
        kind = kind[step].dataType
        at.append(f"`{step}`")
    return F.col(".".join(at))


# ---- dynamic JSON ------------------------------------------------------------------


def path_values(value, path: list[str]) -> Iterator[str]:
    """Scalars at a path of parsed JSON, arrays fanned out on every level; objects and nulls give nothing."""
    if isinstance(value, list):
        for x in value:
            yield from path_values(x, path)
    elif path:
        if isinstance(value, dict) and path[0] in value:
            yield from path_values(value[path[0]], path[1:])
    elif value is not None and not isinstance(value, dict):
        yield value if isinstance(value, str) else jsonlib.dumps(value)


def json_values(json: Column, path: str) -> Column:
    """The same of a JSON text column, as an array of texts; text that doesn't parse gives an empty array."""
    steps = path.split(".")

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return list(path_values(jsonlib.loads(text), steps))
            except (TypeError, ValueError):
                return []

        return texts.map(one)

    return walk(json)


def leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """``(path, text)`` of every non-blank scalar: ``.name`` below objects, ``[i]`` below arrays."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    elif value is not None:
        text = value if isinstance(value, str) else jsonlib.dumps(value)
        if text.strip():
            yield path, text


def flatten_json(records: DataFrame, key: str, json: str) -> DataFrame:
    """``key, path, value, error`` of all leaves of JSON records, numbers by their JSON text; a record that doesn't parse is one row with ``error`` JSON_PARSE_FAILED."""
    schema = f"`{key}` {records.schema[key].dataType.simpleString()}, path string, value string, error string"

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[json], strict=True):
                try:
                    rows += [(k, p, v, None) for p, v in leaves(jsonlib.loads(text, parse_float=_Raw, parse_int=_Raw))]
                except (TypeError, ValueError):
                    rows.append((k, None, None, "JSON_PARSE_FAILED"))
            yield pd.DataFrame(rows, columns=[key, "path", "value", "error"], dtype=object)

    return records.select(key, json).mapInPandas(run, schema)


class _Raw(str):
    """A number by the text it had."""


def flatten_struct(records: DataFrame, key: str, value: str) -> DataFrame:
    """The same of a typed column, by built-in functions: the paths follow from the type."""
    found = []

    def items(c: Column, kind: t.DataType, path: Column, name: str | None) -> Column:
        tail = "]" if name is None else f"].{name}"
        leaf = lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit(tail)).alias("path"), (x if name is None else x[name]).cast("string").alias("value"))
        return F.transform(F.coalesce(c, F.array().cast(kind)), leaf)

    def walk(c: Column, kind: t.DataType, path: Column):
        if isinstance(kind, t.StructType):
            for f in kind.fields:
                walk(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")))
        elif isinstance(kind, t.ArrayType) and not isinstance(kind.elementType, (t.StructType, t.ArrayType)):
            found.append(items(c, kind, path, None))
        elif isinstance(kind, t.ArrayType) and isinstance(kind.elementType, t.StructType):
            found.extend(items(c, kind, path, f.name) for f in kind.elementType.fields)
        else:
            found.append(F.array(F.struct(path.alias("path"), c.cast("string").alias("value"))))

    for f in records.schema[value].dataType.fields:
        walk(F.col(value)[f.name], f.dataType, F.lit(f.name))
    flat = records.select(key, F.explode(F.concat(*found)).alias("leaf")).select(key, "leaf.path", "leaf.value")
    return flat.where(F.col("value").isNotNull() & ~T.is_blank(F.col("value")))
