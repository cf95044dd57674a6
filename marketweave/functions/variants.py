"""Texts in JSON of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An object counts as a text where it has no other keys than these.
TEXT_KEYS = ["text", "attributes"]


def texts(payload: Column, depth: int = 6) -> Column:
    """The trimmed, non-blank strings of a JSON text, in order: of arrays and of the `text` of objects that have no keys but TEXT_KEYS.

    Arrays and objects are opened `depth` times; what lies deeper, numbers and other objects tell nothing. Null and malformed JSON has no texts.
    """

    def opened(x: Column) -> Column:
        as_ = lambda kind: F.try_variant_get(x, "$", kind)
        keys = F.map_keys(as_("map<string,variant>"))
        told = F.forall(keys, lambda k: k.isin(TEXT_KEYS))
        none = F.array().cast("array<variant>")
        inner = F.when(told, F.array_compact(F.array(F.try_variant_get(x, "$.text", "variant"))))
        return F.when(F.schema_of_variant(x) == "STRING", F.array(x)).otherwise(F.coalesce(as_("array<variant>"), inner, none))

    level = F.array(F.try_parse_json(payload))
    for _ in range(depth):
        level = F.flatten(F.transform(F.filter(level, lambda x: x.isNotNull()), opened))
    strings = F.transform(F.filter(level, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.regexp_replace(F.variant_get(x, "$", "string"), r"^\s+|\s+$", ""))
    return F.coalesce(F.filter(strings, lambda x: x != ""), F.array().cast("array<string>"))
