"""JSON of any shape as VARIANT: canonical text, hashes, and walks over all levels, inside one expression.

A VARIANT keeps the keys of every object in order, so its text is canonical. Walks unfold one level per nesting of
the expression, for `depth` levels; a row's payload is walked where it lies, nothing is shuffled and no Python runs.
Containers below the last level are not cut off: a walk gets them whole, as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import identifier_kinds, key_form, without_identifiers

#: Levels that a walk takes apart.
DEPTH = 12


def parsed(json: Column) -> Column:
    """VARIANT of a JSON text; null where it is none, or where an object has a key twice."""
    return F.try_parse_json(json)


def canonical(json: Column) -> Column:
    """The same JSON with sorted keys at every level, without blanks, other letters than ASCII as they are."""
    return F.to_json(parsed(json))


def canonical_struct(value: Column) -> Column:
    """canonical() of a struct, its null fields included."""
    return F.to_json(F.to_variant_object(value))


def content_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def quoted(text: Column) -> Column:
    """A string as JSON; null stays null."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(inner, F.lit(2), F.length(inner) - 2))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_string(v: Column) -> Column:
    return F.to_json(v).startswith('"')


def text_of(v: Column) -> Column:
    """The value of a string; null for anything else."""
    return F.when(_is_string(v), F.try_variant_get(v, "$", "string"))


def children(v: Column) -> Column:
    """array of (key, value): an object's fields by key, an array's items under null keys; null for other values."""
    items = F.transform(_array(v), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    fields = F.transform(F.map_entries(_object(v)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.coalesce(fields, items)


def rewritten(v: Column, leaf: Callable[[Column], Column], field: Callable[[Column, Column], Column], rest: Callable[[Column], Column], depth: int = DEPTH) -> Column:
    """JSON text of v with every value that is no container replaced by leaf(value), a JSON text.

    field(key, text) says what stands for a field of an object, from its key and its value's new text. A container
    deeper than depth becomes rest(its text)."""
    if depth == 0:
        return F.when(children(v).isNull(), leaf(v)).otherwise(rest(F.to_json(v)))
    named = lambda e: F.coalesce(F.concat(quoted(e["key"]), F.lit(":")), F.lit(""))
    inner = F.array_join(F.transform(children(v), lambda e: F.concat(named(e), field(e["key"], rewritten(e["value"], leaf, field, rest, depth - 1)))), ",")
    ends = lambda obj, arr: F.when(_object(v).isNotNull(), F.lit(obj)).otherwise(F.lit(arr))
    return F.when(children(v).isNull(), leaf(v)).otherwise(F.concat(ends("{", "["), inner, ends("}", "]")))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), an array, with value evaluated once, however often body names it."""
    return F.flatten(F.transform(F.array(value), body))


def strings(v: Column, depth: int = DEPTH) -> Column:
    """Every string value at any level, fields by key, items in order; a container deeper than depth is one string."""
    return once(v, lambda x: _strings(x, depth))


def _strings(v: Column, depth: int) -> Column:
    one = lambda c: F.array_compact(F.array(c))
    if depth == 0:
        return one(F.when(children(v).isNull(), text_of(v)).otherwise(F.to_json(v)))
    inner = F.flatten(F.transform(children(v), lambda e: _strings(e["value"], depth - 1)))
    return F.when(children(v).isNull(), one(text_of(v))).otherwise(inner)


def key_paths(v: Column, path: Column | None = None, depth: int = DEPTH) -> Column:
    """array of (path, key) for every key at any level down to depth: items are [n] from 0, fields .key."""
    path = F.lit("$") if path is None else path
    none = F.array().cast("array<struct<path:string,key:string>>")
    if depth == 0:
        return none
    step = lambda e, n: F.concat(path, F.coalesce(F.concat(F.lit("."), e["key"]), F.concat(F.lit("["), n.cast("string"), F.lit("]"))))
    own = F.filter(F.transform(children(v), lambda e, n: F.struct(step(e, n).alias("path"), e["key"].alias("key"))), lambda x: x["key"].isNotNull())
    below = F.flatten(F.transform(children(v), lambda e, n: key_paths(e["value"], step(e, n), depth - 1)))
    return F.coalesce(F.concat(own, below), none)


# ---- what may be kept of a model's answer -------------------------------------------------------

BIBLIOGRAPHIC = "[redacted:bibliographic]"


def redacted_answer(json: Column, keys: tuple[str, ...], depth: int = DEPTH) -> Column:
    """An answer of a model without bibliography: the values of `keys` (in any case, blanks and hyphens as underscores)
    and identifiers in all strings are replaced, whatever the level; keys come out in order. A text that is no JSON
    is redacted as text. Null stays null."""
    v = parsed(json)
    leaf = lambda x: F.coalesce(quoted(without_identifiers(text_of(x))), F.to_json(x))
    field = lambda key, text: F.when(F.coalesce(key_form(key).isin(*keys), F.lit(False)), quoted(F.lit(BIBLIOGRAPHIC))).otherwise(text)
    as_text = lambda c: _redacted_pairs(c, keys)
    return F.when(v.isNull() & json.isNotNull(), as_text(json)).otherwise(rewritten(v, leaf, field, as_text, depth))


def _redacted_pairs(text: Column, keys: tuple[str, ...]) -> Column:
    """`"key": value` of the keys in running text, values being strings, flat lists or bare words; then identifiers."""
    value = r'(?:"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[-\w.]+)'
    name = "|".join(sorted(keys, key=lambda k: (-len(k), k)))
    return without_identifiers(F.regexp_replace(text, rf'(?i)("(?:{name})"\s*:\s*){value}', F.lit(f'$1"{BIBLIOGRAPHIC}"')))


def redacted_keys(json: Column, keys: tuple[str, ...], depth: int = DEPTH) -> Column:
    """(path, key) of the keys that redacted_answer() redacts, at any level."""
    return F.filter(key_paths(parsed(json), depth=depth), lambda x: key_form(x["key"]).isin(*keys))


def structure(text: Column) -> Column:
    """What may be told of an answer that failed: struct(parse_status, json_type, top_level_keys, item_count). Keys
    are told in their plain form or not at all; no content is."""
    v = parsed(text)
    obj = _object(v)
    kind = F.when(_array(v).isNotNull(), F.lit("list")).when(_is_string(v), F.lit("str")).when(F.to_json(v).isin("true", "false"), F.lit("bool"))
    kind = kind.when(F.to_json(v) == "null", F.lit("NoneType")).when(F.to_json(v).rlike(r"[.eE]"), F.lit("float")).otherwise(F.lit("int"))
    safe = lambda k: F.when(key_form(k).rlike(r"^[a-z][a-z0-9_]{0,39}$") & (F.size(identifier_kinds(k)) == 0), key_form(k)).otherwise(F.lit("[redacted]"))
    return F.struct(
        F.when(v.isNull(), F.lit("invalid_json")).when(obj.isNull(), F.lit("not_an_object")).otherwise(F.lit("object")).alias("parse_status"),
        F.when(v.isNotNull() & obj.isNull(), kind).alias("json_type"),
        F.array_sort(F.array_distinct(F.transform(F.map_keys(obj), safe))).alias("top_level_keys"),
        F.when(obj.isNotNull(), F.size(_array(F.element_at(obj, "items")))).alias("item_count"),
    )
