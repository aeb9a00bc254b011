"""Polymorphic JSON: fields that hold an object, a list, a text or nothing. All work on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NONE = "array<variant>"
#: Kinds that an object, a list, and a list of lists of lists can be read as, and nothing else can. They cost little: what is read as
#: variants is written anew, an object or a list read as a text is written as JSON, and a text that is no boolean is an exception.
_OBJECT, _LIST, _DEEP = "struct<x:boolean>", "array<struct<x:boolean>>", "array<array<array<struct<x:boolean>>>>"


def get(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path as a type, or null."""
    return F.try_variant_get(v, path, kind)


def key(v: Column, name: str, kind: str = "variant") -> Column:
    return get(v, f"$.{name}", kind)


def is_nothing(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def is_object(v: Column) -> Column:
    return get(v, "$", _OBJECT).isNotNull()  # one level; a schema is made of all that the value holds


def present(v: Column, path: str) -> Column:
    """Whether there is a value at a path, be it null. Only what is neither an object nor a list is read as a variant."""
    return F.coalesce(*(F.when(get(v, path, kind).isNotNull(), True) for kind in (_OBJECT, _LIST)), get(v, path).isNotNull())


def as_list(v: Column) -> Column:
    """Nothing and "" are no elements, a list is its elements, anything else is one element."""
    return F.coalesce(get(v, "$", _NONE), F.when(is_nothing(v) | F.coalesce(get(v, "$", "string") == "", F.lit(False)), F.array().cast(_NONE)).otherwise(F.array(v)))


def objects(v: Column) -> Column:
    """as_list() without what is not an object."""
    return F.filter(as_list(v), is_object)


def structs(v: Column, fields: str) -> Column:
    """objects() with these fields of theirs alone, each read as its kind, null where it cannot be: one pass over the value."""
    return F.filter(F.coalesce(get(v, "$", f"array<struct<{fields}>>"), F.array(get(v, "$", f"struct<{fields}>"))), lambda s: s.isNotNull())


#: The tokens of JSON as Spark writes it, without blanks: texts, brackets and marks, other values. What follows is a list's text.
TOKENS = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^{}\[\],:"]+'


def _leaves(tokens: Column) -> Column:
    """Texts of the leaves of a JSON list, from its tokens: texts, values but null, and objects, each as its own JSON.

    One step for each token, with the number of open objects and the text of the outermost one as the state."""
    value = lambda t: F.when(t.startswith('"'), get(F.parse_json(t), "$", "string")).otherwise(t)
    state = lambda depth, held, found: F.struct(depth.cast("int").alias("depth"), held.alias("held"), found.alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        held = F.when((s["depth"] > 0) | (t == "{"), F.concat(s["held"], t)).otherwise("")
        ends = (s["depth"] > 0) & (depth == 0)
        leaf = F.when(ends, held).when((s["depth"] == 0) & ~t.isin("{", "}", "[", "]", ",", ":", "null"), value(t))
        return state(depth, F.when(ends, "").otherwise(held), F.when(leaf.isNotNull() & (leaf != ""), F.array_append(s["found"], leaf)).otherwise(s["found"]))

    return F.aggregate(tokens, state(F.lit(0), F.lit(""), F.array().cast("array<string>")), step, lambda s: s["found"])


def flatten_text(v: Column) -> Column:
    """The text of a value: lists, however deeply nested, are joined by line ends without their empty parts; an object that a list
    holds is one text, its JSON."""
    join = lambda parts: F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    inner = F.zip_with(get(v, "$", "array<string>"), get(v, "$", "array<array<string>>"), lambda text, parts: F.when(parts.isNull(), text).otherwise(join(parts)))
    deep = F.exists(get(v, "$", _DEEP), lambda a: F.coalesce(F.exists(a, lambda b: b.isNotNull()), F.lit(False)))
    written = F.to_json(v)
    tokens = F.regexp_extract_all(written, F.lit(TOKENS), F.lit(0))
    plain = F.filter(tokens, lambda t: ~t.isin("[", "]", ",", "null", '""'))
    escaped = lambda t: get(F.parse_json(t), "$", "string")
    texts = F.transform(plain, lambda t: F.when(~t.startswith('"'), t).when(F.contains(t, F.lit("\\")), escaped(t)).otherwise(F.btrim(t, F.lit('"'))))
    joined = F.array_join(F.when(F.contains(written, F.lit("{")), _leaves(tokens)).otherwise(texts), "\n")
    return F.when(get(v, "$", _LIST).isNotNull(), F.when(deep, joined).otherwise(join(inner))).otherwise(F.coalesce(get(v, "$", "string"), F.lit("")))


def text(v: Column, name: str) -> Column:
    """The field as a text, "" where it is missing."""
    return F.coalesce(key(v, name, "string"), F.lit(""))
