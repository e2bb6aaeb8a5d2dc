"""URLs taken apart once per row: what they are made of becomes a column, which every test of a URL then reads.

``functions.urls`` has the same tests as expressions, for use within an array or a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribeira.fixed import BLOCKED_HOSTS, OUTPUT_FORMATS
from ribeira.functions.urls import PARAMETER_SCHEMES, URL_PATTERN, ends_in_data_extension

PARTS = "url_parts"


def split_url(df: DataFrame, url: str = "url", parts: str = PARTS) -> DataFrame:
    """``df`` with a struct ``parts`` <scheme, authority, host, path, params, query, fragment, extension>; as it is if it has that column.

    A missing part is '' (a null URL has null parts); ``extension`` is what the ``outputFormat`` parameter promises, or null.
    The steps are projections, so they are compiled. The last one makes the struct by ``explode`` of one value: filters on it aren't moved
    below it, where the optimizer would write the steps out once per use.
    """
    if parts in df.columns:
        return df
    raw, group = F.col(url), lambda i: F.get("__groups", F.lit(i))
    clean = F.when(raw.rlike(r"[\x00-\x20]"), F.regexp_replace(raw, r"^[\x00-\x20]+|[\t\r\n]", "")).otherwise(raw)
    tail = ";[^/]*$"
    scheme, whole = F.lower(group(0)), group(2)
    tailed = F.contains(whole, F.lit(";")) & scheme.isin(PARAMETER_SCHEMES)
    bracketed = r"^(?:.*@)?\[[^@]*$"
    host = F.when(group(1).rlike(bracketed), F.regexp_extract(group(1), r"^(?:.*@)?\[([^\]]*)", 1)).otherwise(
        F.substring_index(F.regexp_replace(group(1), "^.*@", ""), ":", 1)
    )
    split = df.withColumn("__groups", F.split(F.regexp_replace(clean, URL_PATTERN, "$1\n$2\n$3\n$4\n$5"), "\n"))
    asked = split.withColumn("__pairs", _format_pairs(group(3))).withColumn("__asked", _asked_format(F.col("__pairs")))
    values = F.struct(
        scheme.alias("scheme"),
        group(1).alias("authority"),
        F.lower(host).alias("host"),
        F.when(tailed, F.regexp_replace(whole, tail, "")).otherwise(whole).alias("path"),
        F.when(tailed, F.nullif(F.regexp_extract(whole, tail, 0), F.lit(";"))).when(whole.isNotNull(), "").alias("params"),
        group(3).alias("query"),
        group(4).alias("fragment"),
        _promised_extension(F.col("__asked")).alias("extension"),
    )
    return asked.select("*", F.explode(F.array(values)).alias(parts)).drop("__groups", "__pairs", "__asked")


def _format_pairs(query: Column) -> Column:
    """The query's pairs that name an output format, decoded; null for the many queries that can't have one.

    A ``%`` that starts no escape stays as it is.
    """

    def decoded(pair: Column, group: int) -> Column:
        return F.try_url_decode(F.regexp_replace(F.regexp_extract(pair, "(?s)^([^=]*)=(.+)$", group), "%(?![0-9A-Fa-f]{2})", "%25"))

    possible = F.filter(F.split(query, "&"), lambda pair: pair.rlike("(?i)^(?:outputformat|[^=]*%[^=]*)=."))
    pairs = F.transform(possible, lambda pair: F.struct(decoded(pair, 1).alias("name"), decoded(pair, 2).alias("value")))
    named = F.filter(pairs, lambda pair: (F.lower(pair["name"]) == "outputformat") & (pair["value"] != ""))
    return F.when(query.rlike("(?i)outputformat|%"), named)


def _asked_format(pairs: Column) -> Column:
    """Of the spelling that appears last, the first value, in lower case."""
    last = F.try_element_at(F.array_distinct(F.transform(pairs, lambda pair: pair["name"])), F.lit(-1))
    return F.lower(F.get(F.filter(pairs, lambda pair: pair["name"] == last), F.lit(0))["value"])


def _promised_extension(asked: Column) -> Column:
    promised = F.lit(None).cast("string")
    for needle, extension in reversed(OUTPUT_FORMATS):
        promised = F.when(F.contains(asked, F.lit(needle)), extension).otherwise(promised)
    return promised


def promises_data(parts: str = PARTS) -> Column:
    """The path ends in an accepted extension, or the query asks for a known format."""
    return F.expr(ends_in_data_extension(f"lower({parts}.path)")) | F.col(f"{parts}.extension").isNotNull()


def is_candidate(parts: str = PARTS) -> Column:
    """Whether a link is worth fetching: no fragment, no blocked host, and it promises data."""
    wanted = (F.col(f"{parts}.fragment") == "") & ~F.col(f"{parts}.host").isin(BLOCKED_HOSTS) & promises_data(parts)
    return F.coalesce(wanted, F.lit(False))


def with_file_name(df: DataFrame, column: str, fallback: Column, url: str = "url", limit: int | None = None) -> DataFrame:
    """``df`` with ``column``, a portable file name for what the URL delivers; a null URL takes the fallback.

    Names over ``limit`` characters, if one is set, lose the end of their stem to a digest of the URL; the extension stays.
    """
    split = split_url(df.withColumn("__fallback", fallback), url, "__of_name")
    segments = F.filter(F.split("__of_name.path", "/"), lambda part: ~part.isin("", "."))
    named = split.withColumn("__name", F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")))
    extension = F.col("__of_name.extension")
    promised = extension.isNotNull() & ~F.expr(ends_in_data_extension("lower(__name)"))
    chosen = F.when(promised, F.concat("__fallback", extension)).when(F.col("__name") == "", F.col("__fallback")).otherwise(F.col("__name"))
    safe = named.withColumn(column, F.regexp_replace(chosen, "[^A-Za-z0-9._-]+", "_")).drop("__fallback", "__of_name", "__name")
    if limit is None:
        return safe
    digest = F.concat(F.lit("-"), F.substring(F.sha2(url, 256), 1, 8), F.regexp_extract(column, r"(\.[A-Za-z0-9]{1,10})?$", 0))
    ended = safe.withColumn("__ending", digest)
    cut = F.concat(F.substring(column, F.lit(1), F.lit(limit) - F.length("__ending")), F.col("__ending"))
    return ended.withColumn(column, F.when(F.length(column) > limit, cut).otherwise(F.col(column))).drop("__ending")
