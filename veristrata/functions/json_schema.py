"""JSON Schema validation of JSON text columns.

A schema without recursive references compiles to one Column: an array of
error texts, built from the parsed VARIANT by plain expressions.  A recursive
schema runs the same rules in an Arrow UDF.  Only local references count;
keywords beside one are ignored.  ``additionalProperties: false`` needs
``properties``; given as a schema it isn't enforced.  Numbers of schemas and
texts are compared as decimals.  Patterns are Java's: compiled in the JVM, or
read by a module of the same syntax in the UDF.  A text that repeats a key within one
object doesn't parse, in either form.  The wordings of violations are fixed values.
"""

from __future__ import annotations

import json as jsonlib
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

try:
    import regex
except ImportError:  # patterns with properties of characters are then invalid in the UDF
    regex = re


def errors_of(value, schema: dict, root: dict, path: str = "$") -> list[str]:
    """All violations of one parsed value, in rule order. Numbers are Decimal; integers are int."""
    if "$ref" in schema:
        ref = str(schema["$ref"])
        target = _resolve(root, ref)
        if target is None:
            return [f"{path} {'unresolved' if ref.startswith('#/') else 'unsupported'} $ref {ref}"]
        schema = target
    out = [e for branch in schema.get("allOf") or [] for e in errors_of(value, branch, root, path)] if isinstance(schema.get("allOf"), list) else []
    for word, accepts in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if isinstance(schema.get(word), list) and not accepts(sum(not errors_of(value, b, root, path) for b in schema[word])):
            return [*out, f"{path} did not match {word}"]
    wanted = schema.get("type")
    names = [wanted] if isinstance(wanted, str) else wanted if isinstance(wanted, list) else None
    if names is not None and not any(_is(value, n) for n in names):
        return [*out, f"{path} expected {' or '.join(map(str, names))} but got {type_name(value)}"]
    if "enum" in schema and not any(_equal(value, e) for e in schema["enum"]):
        out.append(f"{path} is not one of the allowed values")
    out += _scalar_errors(value, schema, path)
    if isinstance(value, dict):
        out += [f"{path}.{n} required field missing" for n in schema.get("required", ()) if n not in value]
        properties = schema.get("properties")
        if isinstance(properties, dict):
            for n, s in properties.items():
                if n in value:
                    out += errors_of(value[n], s, root, f"{path}.{n}")
            if schema.get("additionalProperties", True) is False:
                out += [f"{path}.{n} additional property is not allowed" for n in value if n not in properties]
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += errors_of(v, schema["items"], root, f"{path}[{i}]")
    return out


def _scalar_errors(value, schema: dict, path: str) -> list[str]:
    out = []
    count = lambda word, n, wrong: out.append(f"{path} violates {word} {schema[word]}") if isinstance(schema.get(word), int) and wrong(n, schema[word]) else None
    if isinstance(value, str):
        count("minLength", len(value), int.__lt__)
        count("maxLength", len(value), int.__gt__)
        if isinstance(schema.get("pattern"), str):
            try:
                if not regex.search(schema["pattern"], value):
                    out.append(f"{path} violates pattern {schema['pattern']}")
            except regex.error:
                out.append(f"{path} has invalid pattern {schema['pattern']}")
    elif isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        for word, wrong in _BOUNDS.items():
            if isinstance(schema.get(word), (int, Decimal)) and not isinstance(schema[word], bool) and wrong(Decimal(value), Decimal(schema[word])):
                out.append(f"{path} violates {word} {schema[word]}")
    elif isinstance(value, list):
        count("minItems", len(value), int.__lt__)
        count("maxItems", len(value), int.__gt__)
    return out


_BOUNDS = {"minimum": lambda v, b: v < b, "maximum": lambda v, b: v > b, "exclusiveMinimum": lambda v, b: v <= b, "exclusiveMaximum": lambda v, b: v >= b}


def _resolve(root: dict, ref: str):
    at = root
    if not ref.startswith("#/"):
        return None
    for step in ref[2:].split("/"):
        step = step.replace("~1", "/").replace("~0", "~")
        if not isinstance(at, dict) or step not in at:
            return None
        at = at[step]
    return at


def type_name(value) -> str:
    for name, kinds in (("null", type(None)), ("boolean", bool), ("integer", int), ("number", Decimal), ("string", str), ("array", list)):
        if isinstance(value, kinds):
            return name
    return "object"


def _is(value, name: str) -> bool:
    actual = type_name(value)
    return actual == name or (name == "number" and actual == "integer") or name not in ("object", "array", "string", "number", "integer", "boolean", "null")


def _equal(a, b) -> bool:
    return type(a) is type(b) and a == b


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def parse(text: str):
    return jsonlib.loads(text, parse_float=Decimal, object_pairs_hook=_once)


def load(source) -> dict:
    """A schema from its JSON text, or from a file given as a path; ValueError if blank, no JSON or no object."""
    text = source if isinstance(source, str) else source.read_text(encoding="utf-8")
    if not text.strip():
        raise ValueError("a schema must not be blank")
    try:
        found = jsonlib.loads(text)
    except jsonlib.JSONDecodeError as e:
        raise ValueError(f"not a JSON Schema: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("not a JSON Schema: an object is needed")
    return found


def exact(schema: dict) -> dict:
    """The schema with its numbers as decimals, integers aside."""
    return jsonlib.loads(jsonlib.dumps(schema, default=_number_text), parse_float=Decimal)


def _number_text(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    raise TypeError(type(value))


def validate(json: Column, schema: dict) -> Column:
    """Errors of each JSON text as an array; null for text that doesn't parse."""
    schema = exact(schema)
    return compiled(json, schema) if not _recursive(schema) else interpreted(json, schema)


def interpreted(json: Column, schema: dict) -> Column:
    schema = exact(schema)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return errors_of(parse(text), schema, schema)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(json)


def _recursive(schema: dict) -> bool:
    def walk(node, seen: tuple[str, ...]) -> bool:
        if isinstance(node, list):
            return any(walk(x, seen) for x in node)
        if not isinstance(node, dict):
            return False
        if isinstance(node.get("$ref"), str):
            ref = node["$ref"]
            target = _resolve(schema, ref)
            return ref in seen or (target is not None and walk(target, (*seen, ref)))
        return any(walk(v, seen) for k, v in node.items() if k not in ("$defs", "definitions", "enum", "const"))

    return walk(schema, ())


# ---- compiled form -----------------------------------------------------------------

_KINDS = {"object": "OBJECT%", "array": "ARRAY%", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def compiled(json: Column, schema: dict) -> Column:
    schema = exact(schema)
    v = F.try_parse_json(json)
    return F.when(v.isNotNull(), F.array_compact(_node(v, schema, schema, F.lit("$"))))


def _none() -> Column:
    return F.array().cast("array<string>")


def _kind(v: Column) -> Column:
    """Integers are whole numbers that a long holds, and longer ones; fractions, such as 2.0, are short decimals or doubles."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when((s == "BIGINT") | s.rlike("^DECIMAL\\((19|[23][0-9]),0\\)$"), "integer").otherwise("number")


def _compared(v: Column, other: Decimal, test) -> Column:
    """``test(v, other)`` exactly where either decimal type holds the number, else by doubles."""
    narrow, wide = F.try_variant_get(v, "$", "decimal(38,18)"), F.try_variant_get(v, "$", "decimal(38,0)")
    fits = len(other.as_tuple().digits) <= 38 and abs(other.adjusted()) < 38
    rough = test(F.try_variant_get(v, "$", "double"), F.lit(float(other)))
    if not fits:
        return rough
    # A whole number may be too large for the one type, a fraction never for the other.
    return F.when(narrow.isNotNull(), test(narrow, F.lit(other))).when(wide.isNotNull(), test(wide, F.lit(other))).otherwise(rough)


def _same(v: Column, kind: Column, e) -> Column:
    if e is None:
        return kind == "null"
    if isinstance(e, (int, Decimal)) and not isinstance(e, bool):
        return (kind == type_name(e)) & _compared(v, Decimal(e), lambda a, b: a == b)
    return (kind == type_name(e)) & (F.try_variant_get(v, "$", "string") == F.lit(e if isinstance(e, str) else jsonlib.dumps(e, default=str)))


def _java_pattern(pattern: str) -> bool:
    """Whether Java's expressions, by which columns are matched, know the pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("'", "\\'") + "']", "variant")


def _node(v: Column, schema: dict, root: dict, path: Column) -> Column:
    """An array with the errors of a node (nulls where a rule holds); the node and its kind are bound once, for all its rules."""
    bound = F.array(F.struct(v.alias("v"), _kind(v).alias("kind")))
    return F.flatten(F.transform(bound, lambda x: _rules(x["v"], x["kind"], schema, root, path)))


def _rules(v: Column, kind: Column, schema: dict, root: dict, path: Column) -> Column:
    if "$ref" in schema:
        ref = str(schema["$ref"])
        target = _resolve(root, ref)
        if target is None:
            return F.array(F.concat(path, F.lit(f" {'unresolved' if ref.startswith('#/') else 'unsupported'} $ref {ref}")))
        schema = target
    say = lambda bad, text: F.when(bad, F.concat(path, F.lit(text)))
    before = [_node(v, b, root, path) for b in schema.get("allOf", ()) if isinstance(schema.get("allOf"), list)]
    fails = F.lit(None).cast("string")
    for word in ("anyOf", "oneOf"):
        if isinstance(schema.get(word), list):
            hits = sum((F.size(F.array_compact(_node(v, b, root, path))) == 0).cast("int") for b in schema[word])
            fails = F.coalesce(fails, say((hits < 1) if word == "anyOf" else (hits != 1), f" did not match {word}"))
    wanted = schema.get("type")
    names = [wanted] if isinstance(wanted, str) else wanted if isinstance(wanted, list) else None
    if names is not None:
        fits = F.lit(False)
        for n in names:
            fits = fits | ((kind == n) | (kind == "integer") if n == "number" else (kind == n) if n in ("object", "array", "string", "integer", "boolean", "null") else F.lit(True))
        fails = F.coalesce(fails, F.when(~fits, F.concat(path, F.lit(f" expected {' or '.join(map(str, names))} but got "), kind)))
    rules = []
    if "enum" in schema:
        same = F.lit(False)
        for e in schema["enum"]:
            same = same | F.coalesce(_same(v, kind, e), F.lit(False))
        rules.append(say(~same, " is not one of the allowed values"))
    text = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
    for word, bad in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n)):
        if isinstance(schema.get(word), int):
            rules.append(say(bad(schema[word]), f" violates {word} {schema[word]}"))
    if isinstance(schema.get("pattern"), str):
        if _java_pattern(schema["pattern"]):
            rules.append(say(~text.rlike(schema["pattern"]), f" violates pattern {schema['pattern']}"))
        else:
            rules.append(say(text.isNotNull(), f" has invalid pattern {schema['pattern']}"))
    for word, bad in _COLUMN_BOUNDS.items():
        if isinstance(schema.get(word), (int, Decimal)) and not isinstance(schema[word], bool):
            rules.append(say(kind.isin("integer", "number") & _compared(v, Decimal(schema[word]), bad), f" violates {word} {schema[word]}"))
    items = F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>"))
    for word, bad in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
        if isinstance(schema.get(word), int):
            rules.append(F.when(items.isNotNull() & bad(schema[word]), F.concat(path, F.lit(f" violates {word} {schema[word]}"))))
    parts = [F.array(*rules)] if rules else []
    is_object = kind == "object"
    if schema.get("required"):
        parts.append(F.array(*[F.when(is_object & _get(v, n).isNull(), F.concat(path, F.lit(f".{n} required field missing"))) for n in schema["required"]]))
    properties = schema.get("properties")
    if isinstance(properties, dict):
        for n, s in properties.items():
            child = _get(v, n)
            parts.append(F.when(is_object & child.isNotNull(), _node(child, s, root, F.concat(path, F.lit(f".{n}")))).otherwise(_none()))
        if schema.get("additionalProperties", True) is False:
            extra = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*[F.lit(n) for n in properties]).cast("array<string>"))
            parts.append(F.when(is_object, F.transform(extra, lambda n: F.concat(path, F.lit("."), n, F.lit(" additional property is not allowed")))).otherwise(_none()))
    if isinstance(schema.get("items"), dict):
        each = F.flatten(F.transform(items, lambda x, i: _node(x, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        parts.append(F.when(items.isNotNull(), each).otherwise(_none()))
    rest = F.concat(*parts) if parts else _none()
    return F.concat(*before, F.when(fails.isNotNull(), F.array(fails)).otherwise(rest))


_COLUMN_BOUNDS = {"minimum": lambda v, b: v < b, "maximum": lambda v, b: v > b, "exclusiveMinimum": lambda v, b: v <= b, "exclusiveMaximum": lambda v, b: v >= b}


# ---- schemas as values -------------------------------------------------------------


def compatibility(schema: dict) -> list[str]:
    """References that can't be followed, wherever schemas may stand."""
    out = []

    def walk(node, path: str):
        if isinstance(node, list):
            for i, x in enumerate(node):
                walk(x, f"{path}[{i}]")
        elif isinstance(node, dict):
            if "$ref" in node:
                ref = str(node["$ref"])
                if _resolve(schema, ref) is None:
                    out.append(f"{path} {'unresolved' if ref.startswith('#/') else 'unsupported'} $ref {ref}")
            for word in ("$defs", "properties"):
                for n, s in (node.get(word) or {}).items() if isinstance(node.get(word), dict) else ():
                    walk(s, f"{path}.{word}.{n}")
            for word in ("anyOf", "oneOf", "allOf", "items"):
                if word in node:
                    walk(node[word], f"{path}.{word}")

    walk(schema, "$")
    return out


def from_struct(kind: t.DataType, nullable: bool = False) -> dict:
    """A schema for a Spark type; a nullable field may be null and isn't required."""
    if isinstance(kind, t.StructType):
        out = {"type": "object", "properties": {f.name: from_struct(f.dataType, f.nullable) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
    elif isinstance(kind, t.ArrayType):
        out = {"type": "array", "items": from_struct(kind.elementType)}
    elif isinstance(kind, t.MapType):
        out = {"type": "object", "additionalProperties": from_struct(kind.valueType)}
    elif isinstance(kind, t.DateType):
        out = {"type": "string", "format": "date"}
    elif isinstance(kind, (t.TimestampType, t.TimestampNTZType)):
        out = {"type": "string", "format": "date-time"}
    elif isinstance(kind, t.BooleanType):
        out = {"type": "boolean"}
    elif isinstance(kind, t.IntegralType):
        out = {"type": "integer"}
    elif isinstance(kind, t.NumericType):
        out = {"type": "number"}
    elif isinstance(kind, t.StringType):
        out = {"type": "string"}
    else:
        raise ValueError(f"no JSON type for {kind.simpleString()}")
    return out | {"type": [out["type"], "null"]} if nullable else out


#: Keywords that response schemas of the strictest provider keep.
PROVIDER_KEYWORDS = ("type", "description", "enum", "format", "items", "properties", "required", "nullable")


def for_provider(schema: dict) -> dict:
    """References inlined, ``allOf`` merged, unions with null as ``nullable``, other keywords dropped."""

    def walk(node: dict) -> dict:
        if "$ref" in node:
            node = _resolve(schema, str(node["$ref"])) or {}
        merged: dict = {}
        for part in [*(node.get("allOf") or []), {k: v for k, v in node.items() if k != "allOf"}]:
            part = _resolve(schema, str(part["$ref"])) or {} if "$ref" in part else part
            for k, v in part.items():
                if k == "properties":
                    merged[k] = merged.get(k, {}) | v
                elif k == "required":
                    merged[k] = [*merged.get(k, []), *(n for n in v if n not in merged.get(k, []))]
                else:
                    merged[k] = v
        for word in ("anyOf", "oneOf"):
            branches = merged.pop(word, None)
            if branches:
                real = [b for b in branches if b.get("type") != "null"]
                if len(real) == 1:
                    merged = walk(real[0]) | {k: v for k, v in merged.items() if k not in ("type",)}
                if len(real) < len(branches):
                    merged["nullable"] = True
        if isinstance(merged.get("type"), list):
            names = [n for n in merged["type"] if n != "null"]
            if len(names) < len(merged["type"]):
                merged["nullable"] = True
            merged["type"] = names[0] if names else "null"
        out = {k: v for k, v in merged.items() if k in PROVIDER_KEYWORDS}
        if isinstance(out.get("properties"), dict):
            out["properties"] = {n: walk(s) for n, s in out["properties"].items()}
        if isinstance(out.get("items"), dict):
            out["items"] = walk(out["items"])
        return out

    return walk(schema)


def summary(schema: dict) -> dict:
    return {"properties": len(schema.get("properties", {})), "required": len(schema.get("required", [])), "compatible": not compatibility(schema)}
