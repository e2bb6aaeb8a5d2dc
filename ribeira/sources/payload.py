"""Statistical-API payloads: JSON arrays whose first element maps column codes to labels."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.functions.text import slug


class PayloadError(ValueError):
    """Raised for payloads that do not have the expected form."""


@dataclass(frozen=True)
class PayloadProfile:
    """What has to be known about payloads before their columns can be named."""

    header: dict[str, str]
    row_codes: set[str]
    fewest_rows: int
    most_rows: int


def _elements() -> Column:
    return F.from_json("value", "ARRAY<MAP<STRING, STRING>>", {"mode": "FAILFAST"})


def payload_profile(payloads: DataFrame, every_code: bool = False) -> PayloadProfile:
    """Header, codes in use and row counts, in one pass over the payloads (runs a job).

    The codes of a payload's rows are reduced to a set inside the row and then grouped, so that one
    line per distinct code reaches the driver: those of the header, or all with ``every_code``.
    Headers with the same entries in another order are the same; the least text gives the order.
    """
    e = F.col("e")
    head = F.get(e, F.lit(0))
    codes = F.array_distinct(F.flatten(F.transform(F.slice(e, 2, F.greatest(F.size(e), F.lit(0))), F.map_keys)))
    if not every_code:
        codes = F.array_intersect(codes, F.map_keys(head))
    parsed = payloads.select(_elements().alias("e"))
    seen = parsed.select(
        F.to_json(head).alias("header"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(head)))).alias("entries"),
        (F.coalesce(F.size(e), F.lit(0)) - 1).alias("rows"),
        F.posexplode_outer(codes).alias("pos", "code"),
    )
    # the header goes along with the first code only
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    seen = seen.select("rows", "code", F.when(first, F.col("header")).alias("header"), F.when(first, F.col("entries")).alias("entries"))
    found = (
        seen.groupBy("code")
        .agg(
            F.min("header").alias("header"), F.min("entries").alias("low"), F.max("entries").alias("high"),
            F.min("rows").alias("fewest"), F.max("rows").alias("most"),
        )
        .collect()
    )
    if len({text for r in found for text in (r["low"], r["high"]) if text is not None}) > 1:
        raise PayloadError("payloads have different headers")
    return PayloadProfile(
        header=json.loads(min((r["header"] for r in found if r["header"] is not None), default="{}")),
        row_codes={r["code"] for r in found if r["code"] is not None},
        fewest_rows=min((r["fewest"] for r in found), default=0),
        most_rows=max((r["most"] for r in found), default=0),
    )


def named_header(spark: SparkSession, header: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(code, label, safe label, safe code) in header order."""
    if not header:
        return []
    columns = spark.createDataFrame([(i, code, label) for i, (code, label) in enumerate(header.items())], "i INT, code STRING, label STRING")
    named = columns.select("i", "code", "label", slug(F.col("label")).alias("safe_label"), slug(F.col("code")).alias("safe_code"))
    return [tuple(r)[1:] for r in sorted(named.collect())]


def safe_names(header: list[tuple[str, str, str, str]]) -> dict[str, str]:
    """Code -> unique safe column name; a taken name gets _2, _3, ... until one is free."""
    names: dict[str, str] = {}
    taken: set[str] = set()
    last: dict[str, int] = {}
    for code, _, safe_label, safe_code in header:
        base = safe_label or safe_code
        name = base
        while name in taken:
            last[base] = last.get(base, 1) + 1
            name = f"{base}_{last[base]}"
        taken.add(name)
        names[code] = name
    return names


def _rows(payloads: DataFrame) -> DataFrame:
    """One row per payload element after the header, as a map from code to text."""
    return payloads.select(F.posexplode(_elements()).alias("pos", "row")).filter("pos > 0").select("row")


def payload_normalize(payloads: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Table with safe column names, and the map from those names to the labels.

    ``payloads`` has one JSON array per row in ``value``. One pass settles the columns, as a code that
    occurs in no row has no column (unless there are no rows at all); the table itself is lazy.
    """
    profile = payload_profile(payloads)
    names = safe_names(named_header(payloads.sparkSession, profile.header))
    labels = {names[code]: label for code, label in profile.header.items()}
    if not names:
        return payloads.sparkSession.createDataFrame([], "struct<>"), labels
    present = [code for code in names if profile.most_rows < 1 or code in profile.row_codes]
    return _rows(payloads).select(*[F.col("row")[code].alias(names[code]) for code in present]), labels


def payload_strict(payloads: DataFrame) -> DataFrame:
    """Table with the labels as column names, word for word; a payload without rows raises.

    Repeated labels would give columns that cannot be told apart, so they raise as well. One pass
    settles the columns; the table itself is lazy.
    """
    profile = payload_profile(payloads, every_code=True)
    if profile.fewest_rows < 1:
        raise PayloadError("a payload has no data rows")
    labels = profile.header
    if len({label.lower() for label in labels.values()}) < len(labels):
        raise PayloadError("a label occurs twice")
    ordered = [code for code in labels if code in profile.row_codes] + sorted(profile.row_codes - set(labels))
    return _rows(payloads).select(*[F.col("row")[code].alias(labels.get(code, code)) for code in ordered])
