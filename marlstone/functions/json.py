"""JSON metadata: filters, projections and merges. Keys are quoted in paths, so dots in them are plain."""

from __future__ import annotations

import json as _json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def path(key: str) -> str:
    return f"$['{key}']"


def text_of(value) -> str:
    """A filter value as JSON text, without quotes round strings."""
    return value if isinstance(value, str) else _json.dumps(value, ensure_ascii=False)


def equals(metadata: Column, key: str, value) -> Column:
    return F.coalesce(F.get_json_object(metadata, path(key)) == text_of(value), F.lit(False))


def matches(filters: dict | None, *columns: Column) -> Column:
    """Whether each key has its value in any of the JSON columns."""
    tests = [reduce(lambda a, b: a | b, [equals(F.coalesce(c, F.lit("{}")), k, v) for c in columns]) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def tag_like(data: Column, tag: str, key: str = "tags") -> Column:
    """Substring of the serialized value, as a loose tag search."""
    return F.coalesce(F.get_json_object(data, path(key)).contains(tag), F.lit(False))


def has_tag(data: Column, tag: str, key: str = "tags") -> Column:
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(data, path(key)), "array<string>"), tag), F.lit(False))


def without(data: Column, *keys: str) -> Column:
    """The object less some keys; values keep their JSON type through VARIANT."""
    kept = F.map_filter(_typed(data), lambda k, v: ~k.isin(*keys))
    return F.to_json(kept)


def _typed(data: Column) -> Column:
    return F.parse_json(F.coalesce(data, F.lit("{}"))).cast("map<string,variant>")


def merge(old: Column, new: Column) -> Column:
    """Shallow merge; the new object's keys win."""
    old_left = F.map_filter(_typed(old), lambda k, v: ~F.array_contains(F.map_keys(_typed(new)), k))
    return F.to_json(F.map_concat(old_left, _typed(new)))


def flatten(doc_id: Column, content: Column, metadata: Column) -> Column:
    """One object of id, content and metadata; metadata keys win."""
    own = F.to_json(F.struct(doc_id.alias("id"), content.alias("content")))
    return merge(own, metadata)


def envelope_text(content: Column) -> Column:
    """The text in a JSON envelope, or the content itself."""
    return F.coalesce(F.when(content.startswith("{"), F.get_json_object(content, "$.content")), content)


def first_text(ocr: Column, content: Column, image_path: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(ocr), blank(content), blank(image_path), F.lit(""))


def extract_text(data: Column) -> Column:
    """All values but ids, revisions and embeddings, in the order of keys: strings, items of string lists, other scalars."""
    fields = F.map_filter(F.from_json(data, MAP), lambda k, v: ~k.isin("id", "_rev", "embedding") & v.isNotNull())
    names = F.array_sort(F.map_keys(fields))
    value = lambda k: F.element_at(fields, k)
    text = lambda v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), " ")).otherwise(v)
    return F.coalesce(F.array_join(F.filter(F.transform(names, lambda k: text(value(k))), lambda x: x != ""), " "), F.lit(""))
