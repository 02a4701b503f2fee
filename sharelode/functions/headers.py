"""Message headers."""

from pyspark.sql import Column, functions as F


def headers_map(headers: Column) -> Column:
    """Map for a list of (key, value) headers; a repeated key keeps its last value.

    The work is per message and a message has a handful of headers.
    """
    filled = F.coalesce(headers, F.array().cast("array<struct<key:string,value:binary>>"))
    keys = F.array_distinct(F.transform(filled, lambda h: h["key"]))
    values = F.transform(
        keys,
        lambda k: F.coalesce(
            F.element_at(F.filter(filled, lambda h: h["key"] == k), -1)["value"].cast("string"),
            F.lit(""),
        ),
    )
    return F.map_from_arrays(keys, values)
