"""Unknown labels of detail pages as a VARIANT: any shape of value, read with a type when asked, null apart from missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(json: Column) -> Column:
    """A JSON object of labels as a variant; null for a text that is no JSON."""
    return F.try_parse_json(json)


def of_map(extras: Column) -> Column:
    """A map of labels, as detail records have, as a variant."""
    return F.to_variant_object(extras)


def _path(label: str) -> str:
    """The path of a label, whatever its characters; a variant's path has no escapes, so not both kinds of quotes."""
    quote = '"' if "'" in label else "'"
    if quote in label:
        raise ValueError(f"a label with both kinds of quotes has no path: {label}")
    return f"$[{quote}{label}{quote}]"


def typed(extras: Column, label: str, kind: str) -> Column:
    """A label's value as a type; null if it is missing, null, or not of the type."""
    return F.try_variant_get(extras, _path(label), kind)


def state(extras: Column, label: str) -> Column:
    """`missing`, `null` or `value`; null where there are no extras at all."""
    got = F.try_variant_get(extras, _path(label), "variant")
    return F.when(extras.isNull(), F.lit(None)).when(got.isNull(), "missing").when(F.is_variant_null(got), "null").otherwise("value")


def shape(df: DataFrame, extras: str) -> str:
    """The schema that holds all values of a column of extras, merged over all rows."""
    return df.agg(F.schema_of_variant_agg(extras)).first()[0]
