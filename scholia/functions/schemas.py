"""Strict schemas for a model's answers: a StructType as JSON schema, and as an expression that lists every problem.

A field's metadata may hold `choices` (the strings that it may be) and, for lists, `most` (items at most). A field that is
not nullable must not be null; every field must be there, and no other may.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.payloads import unfenced
from scholia.functions.variants import parsed, text_of

# What is said of a field that does not fit.
MISSING, EXTRA = "Field required", "Extra inputs are not permitted"
NAMES = {"string": "Input should be a valid string", "integer": "Input should be a valid integer", "number": "Input should be a valid number", "boolean": "Input should be a valid boolean",
         "array": "Input should be a valid list", "object": "Input should be a valid dictionary"}


def _kind(type_: T.DataType) -> str:
    if isinstance(type_, T.StructType):
        return "object"
    if isinstance(type_, T.ArrayType):
        return "array"
    if isinstance(type_, T.BooleanType):
        return "boolean"
    if isinstance(type_, T.IntegralType):
        return "integer"
    return "number" if isinstance(type_, T.NumericType) else "string"


def json_schema(type_: T.DataType, metadata: dict | None = None, nullable: bool = False) -> dict:
    """The strict JSON schema: objects close with additionalProperties false and require all of their fields; what may be
    null says so in its type."""
    kind, said = _kind(type_), metadata or {}
    out: dict = {"type": kind}
    if kind == "object":
        out |= {"properties": {f.name: json_schema(f.dataType, f.metadata, f.nullable) for f in type_.fields}, "required": type_.names, "additionalProperties": False}
    elif kind == "array":
        out["items"] = json_schema(type_.elementType, {k: v for k, v in said.items() if k != "most"}, type_.containsNull)
        if "most" in said:
            out["maxItems"] = said["most"]
    elif "choices" in said:
        out["enum"] = list(said["choices"])
    return {"anyOf": [out, {"type": "null"}]} if nullable else out


def _or(names: list[str]) -> str:
    quoted = [f"'{n}'" for n in names]
    return quoted[0] if len(quoted) == 1 else f"{', '.join(quoted[:-1])} or {quoted[-1]}"


def problems(v: Column, type_: T.DataType, path: Column | None = None, metadata: dict | None = None, nullable: bool = False) -> Column:
    """array of `path: problem` of a VARIANT, in the order of the schema's fields, then other keys; empty where it fits."""
    none = F.array().cast("array<string>")
    said, kind = metadata or {}, _kind(type_)
    at = lambda text: F.concat(F.lit("<root>") if path is None else path, F.lit(f": {text}"))
    inner = lambda name: name if path is None else F.concat(path, F.lit("."), name)
    one = lambda text: F.array(at(text))
    raw = F.to_json(v)
    if kind == "object":
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        each = [F.when(F.map_contains_key(fields, f.name), problems(F.element_at(fields, f.name), f.dataType, inner(F.lit(f.name)), f.metadata, f.nullable))
                .otherwise(F.array(F.concat(inner(F.lit(f.name)), F.lit(f": {MISSING}")))) for f in type_.fields]
        other = F.transform(F.filter(F.map_keys(fields), lambda k: ~k.isin(*type_.names)), lambda k: F.concat(inner(k), F.lit(f": {EXTRA}")))
        out = F.when(fields.isNull(), one(NAMES[kind])).otherwise(F.concat(*each, other))
    elif kind == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        below = {k: x for k, x in said.items() if k != "most"}
        out = F.flatten(F.transform(items, lambda x, n: problems(x, type_.elementType, inner(n.cast("string")), below, type_.containsNull)))
        if "most" in said:
            over = F.concat(at(f"List should have at most {said['most']} items after validation, not "), F.size(items).cast("string"))
            out = F.when(F.size(items) > said["most"], F.array(over)).otherwise(out)
        out = F.when(items.isNull(), one(NAMES[kind])).otherwise(out)
    elif "choices" in said:
        out = F.when(F.coalesce(text_of(v).isin(*said["choices"]), F.lit(False)), none).otherwise(one(f"Input should be {_or(list(said['choices']))}"))
    else:
        fits = {"string": text_of(v).isNotNull(), "boolean": raw.isin("true", "false"), "integer": raw.rlike(r"^-?[0-9]+$"), "number": raw.rlike(r"^-?[0-9]")}[kind]
        out = F.when(F.coalesce(fits, F.lit(False)), none).otherwise(one(NAMES[kind]))
    return F.when(raw == "null", none).otherwise(out) if nullable else out


def validated(answer: Column, schema: T.StructType, limit: int = 8) -> Column:
    """struct(value, problem, summary) of a model's text: value is the answer where it fits the schema, else problem is
    invalid_output_json or schema_violation and summary lists the first `limit` problems, with places but no values."""
    v = parsed(unfenced(answer))
    found = problems(v, schema)
    more = F.size(found) - limit
    text = F.concat(F.array_join(F.slice(found, 1, limit), "; "), F.when(more > 0, F.concat(F.lit("; ... and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return F.struct(
        F.when(F.size(found) == 0, F.from_json(F.to_json(v), schema)).alias("value"),
        F.when(v.isNull(), F.lit("invalid_output_json")).when(F.size(found) > 0, F.lit("schema_violation")).alias("problem"),
        F.when(v.isNotNull() & (F.size(found) > 0), text).alias("summary"),
    )
