"""Reading values out of delimited text fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLANKS = " \t\r\n\f\v"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_double(c: Column) -> Column:
    """Number or null.  The pattern keeps out forms only a cast accepts, such as ``5d``, and NaN."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_long(c: Column) -> Column:
    """Integer text or null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def info_value(info: Column, key: str) -> Column:
    """Value of ``key=`` in a ``;`` list; the last of several wins, null when absent."""
    padded = F.concat(F.lit(";"), info)
    mark = f";{key}="
    tail = F.substring_index(padded, mark, -1)
    return F.when(F.contains(padded, F.lit(mark)), F.substring_index(tail, ";", 1))


def info_map(info: Column) -> Column:
    """All ``key=value`` items as a map: split at the first ``=``, flags left out, last wins."""
    items = F.filter(F.split(info, ";"), lambda x: F.contains(x, F.lit("=")))
    last = F.filter(
        items,
        lambda x, i: ~F.exists(
            F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))),
            lambda y: F.substring_index(y, "=", 1) == F.substring_index(x, "=", 1),
        ),
    )
    keys = F.transform(last, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(last, lambda x: F.substr(x, F.locate("=", x) + 1))
    return F.map_from_arrays(keys, values)


def attribute_value(attributes: Column, key: str) -> Column:
    """Value of ``key "value"`` in a ``;`` list of gene-annotation attributes."""
    items = F.transform(F.split(attributes, ";"), strip)
    found = F.filter(items, lambda x: F.startswith(x, F.lit(f"{key} ")))
    value = F.substr(F.try_element_at(found, F.lit(-1)), F.lit(len(key) + 2))
    return F.btrim(value, F.lit('"'))


def genotype(format_field: Column, sample_field: Column) -> Column:
    """The sample's GT entry, null when FORMAT has none or the sample is too short."""
    place = F.array_position(F.split(format_field, ":"), "GT").cast("int")
    return F.get(F.split(sample_field, ":"), place - 1)


def parse_symptom_list(c: Column) -> Column:
    """JSON array, JSON string or comma list to an array of ids."""
    as_array = F.from_json(c, "array<string>")
    as_string = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    as_list = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    text = strip(c)
    return (
        F.when(F.startswith(text, F.lit("[")), F.coalesce(as_array, as_list))
        .when(F.startswith(text, F.lit('"')), F.coalesce(as_string, as_list))
        .otherwise(as_list)
    )


def split_symptoms(c: Column) -> Column:
    """``;`` list at rest to an array; null and blank give an empty array."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(
        F.filter(F.split(c, ";"), lambda x: x != "")
    )


def title_name(title: Column) -> Column:
    return strip(F.get(F.split(title, ";", 2), F.lit(0)))


def title_symbol(title: Column) -> Column:
    return strip(F.get(F.split(title, ";", 2), F.lit(1)))


def first_alias(symbols: Column) -> Column:
    return strip(F.substring_index(symbols, ",", 1))
