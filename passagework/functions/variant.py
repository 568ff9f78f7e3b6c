"""Reading JSON whose fields may be an object, a list or a scalar, by VARIANT expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order in which an object's text is looked for.
TEXT_KEYS = ("조문내용", "항내용", "호내용", "내용", "text", "#text", "value")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def listed(v: Column, path: str = "$") -> Column:
    """The members of the list at ``path``, null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def at(v: Column, key: str) -> Column:
    """The member ``key`` of an object, null if there is none."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def is_object(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("OBJECT"))


def is_array(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("ARRAY"))


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def members(v: Column) -> Column:
    """A list's members; a single value is a list of one, null an empty one."""
    none = F.array().cast("array<variant>")
    return let(v, lambda x: F.coalesce(listed(x), F.when(kind(x) == "VOID", none).otherwise(F.array(x))))


def members_at(v: Column, key: str) -> Column:
    """``members(at(v, key))``; a list, which each step would copy whole, is taken out at once."""
    return F.coalesce(listed(v, f"$['{key}']"), members(at(v, key)))


def truthy(v: Column) -> Column:
    def of(k: Column) -> Column:
        scalar = F.when(k == "STRING", string(v) != "").when(k == "BIGINT", string(v) != "0").when(k == "BOOLEAN", string(v) != "false")
        return scalar.otherwise(~k.isin("VOID", "OBJECT<>", "ARRAY<VOID>"))

    return let(kind(v), of)


def pick(v: Column, *keys: str) -> Column:
    """The first member of ``keys`` that is neither absent nor empty."""
    return let(v, lambda x: F.coalesce(*[let(at(x, k), lambda y: F.when(truthy(y), y)) for k in keys], F.lit(None).cast("variant")))


def members_picked(v: Column, *keys: str) -> Column:
    """``members(pick(v, *keys))``, as ``members_at`` where the first key has a list."""
    first = let(listed(v, f"$['{keys[0]}']"), lambda x: F.when(F.exists(x, lambda y: ~F.is_variant_null(y)), x))
    return F.coalesce(first, members(pick(v, *keys)))


def text_at(v: Column, *keys: str) -> Column:
    """``pick`` as text, '' if there is none."""
    return F.coalesce(string(pick(v, *keys)), F.lit(""))


def _strings(values: Column) -> Column:
    return F.array_join(F.filter(F.transform(values, lambda x: F.when(is_string(x), string(x))), lambda x: x.isNotNull()), " ")


def coerce_text(v: Column) -> Column:
    """A text of whatever comes: a string itself; of a list its strings; of an object the first of
    TEXT_KEYS that is a string, else all of its strings; otherwise ''."""

    def of(x: Column) -> Column:
        first = [let(at(x, k), lambda y: F.when(is_string(y), string(y))) for k in TEXT_KEYS]
        every = _strings(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")))
        return F.coalesce(F.when(is_string(x), string(x)).when(is_array(x), _strings(listed(x))).when(is_object(x), F.coalesce(*first, every)), F.lit(""))

    return let(v, of)
