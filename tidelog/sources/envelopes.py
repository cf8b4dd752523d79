"""Raw answers: which are readable, and the errors among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, message, code): the error of each answer that has one, with or without data."""
    parsed = df.select(key, F.try_parse_json(F.col(body)).alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    return parsed.select(key, get("$.error.message").alias("message"), get("$.error.code").alias("code")).where("message is not null or code is not null")


def paging(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, next_cursor, has_more): where the next page of an answer begins, in either form of envelope."""
    parsed = df.select(key, F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    cursor = F.coalesce(F.try_variant_get("v", "$.pagination.nextCursor", "string"), F.try_variant_get("v", "$.meta.lifelogs.nextCursor", "string"))
    more = F.coalesce(F.try_variant_get("v", "$.pagination.hasMore", "boolean"), cursor.isNotNull())
    return parsed.select(key, cursor.alias("next_cursor"), more.alias("has_more"))


def readable(df: DataFrame, body: str = "body") -> DataFrame:
    """(state, n): answers by state: null, empty, invalid, data, error, and unknown for JSON that is none of these.

    Data is a list, or an object with ``data``, ``lifelogs`` or ``lifelog``, or with a recording's ``contents``.
    """
    v = F.try_parse_json(F.col(body))
    has = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names]).isNotNull()
    data = has("data", "lifelogs", "lifelog", "contents") | F.try_variant_get(v, "$", "array<variant>").isNotNull()
    state = F.when(F.col(body).isNull(), "null").when(F.trim(body) == "", "empty").when(v.isNull(), "invalid").when(data, "data").when(has("error"), "error").otherwise("unknown")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def unknown(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, found): answers of valid JSON in no known form, neither data nor an error, with the names at their top; null for a bare value."""
    v = F.try_parse_json(F.col(body))
    has = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in ("data", "lifelogs", "lifelog", "contents", "error")], F.try_variant_get(v, "$", "array<variant>").cast("variant"))
    names = F.array_join(F.array_sort(F.json_object_keys(body)), ",")
    return df.where(v.isNotNull() & has.isNull()).select(key, names.alias("found"))
