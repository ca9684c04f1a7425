"""API names from file names, and name expansions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def api_name(name: Column) -> Column:
    """Customer_Order_API from CustomerOrder.plsql: an underscore before each inner capital that has none, and _API."""
    base = F.regexp_replace(name, r"\.plsql$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", name).otherwise(F.concat(F.regexp_replace(base, r"(?<=[^_])(?=\p{Lu})", "_"), F.lit("_API")))


def api_key(name: Column) -> Column:
    """CUSTOMER_ORDER_API from CustomerOrderAPI: names in capitals with an underscore stay; others lose an API suffix,
    get an underscore before every inner capital (a second one where there is one already) and capitals throughout."""
    upper = F.upper(name)
    done = (name == upper) & (name != F.lower(name)) & name.contains("_")
    has_suffix = upper.endswith("API")
    base = F.regexp_replace(name, r"(?i)_?API$", "")
    spaced = F.upper(F.regexp_replace(base, r"(?<=.)(?=\p{Lu})", "_"))
    return F.when(F.coalesce(name, F.lit("")) == "", name).when(done, name).otherwise(F.concat(spaced, F.when(has_suffix, "_API").otherwise("")))


def base_name(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def camel_case(name: Column) -> Column:
    """CustomerOrder from CUSTOMER_ORDER."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), "")
