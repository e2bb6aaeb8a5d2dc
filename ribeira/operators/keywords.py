"""Keyword tables that are too large for the plan: an index join on rare grams.

A term can only be part of a text that has all its grams (runs of three characters). Of each term, the gram that
is rarest among the texts of its source becomes its join key, and a text meets the terms of its own distinct grams. So the containment test is the
residual condition of an equi join, however many terms there are, and the choice of gram changes the cost, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
KEY = ["source_id", "__gram"]


def _runs(chars: str, size: int) -> Column:
    """All runs of ``size`` characters of an array of characters; what would reach beyond the end is null and goes."""
    return F.array_compact(F.transform(chars, lambda c, i: F.concat(c, *[F.get(F.col(chars), i + step) for step in range(1, size)])))


def _text_grams(df: DataFrame, low: Column) -> DataFrame:
    """One row per row and distinct run of at most ``GRAM`` characters of ``low``, the empty one included; none where it is null."""
    runs = [_runs("__chars", size) for size in range(1, GRAM + 1)]
    split = df.withColumn("__chars", F.split(low, ""))
    return split.withColumn("__gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *runs)))).drop("__chars")


def _term_grams(terms: DataFrame) -> DataFrame:
    """One row per term and gram that may stand for it; a term of under ``GRAM`` characters stands for itself."""
    split = terms.withColumn("__chars", F.split("__term", ""))
    grams = F.when(F.length("__term") < GRAM, F.array("__term")).otherwise(F.array_distinct(_runs("__chars", GRAM)))
    return split.withColumn("__gram", F.explode(grams)).drop("__chars")


def keyword_index(links: DataFrame, keywords: DataFrame, url: str = "url") -> DataFrame:
    """(source_id, __term, __times, __gram): each term of ``keywords`` with the gram that the fewest URLs of its source have.

    Terms with a gram that no URL of their source has can't be found and are left out. The grams are counted with partial sums, so a task sends at most
    one row per source and gram.
    """
    terms = keywords.filter("term IS NOT NULL").groupBy("source_id", F.col("term").alias("__term")).agg(F.count(F.lit(1)).alias("__times"))
    seen = _text_grams(links.select("source_id", url), F.lower(url)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__seen"))
    weighed = _term_grams(terms).join(seen, KEY, "left").withColumn("__seen", F.coalesce("__seen", F.lit(0)))
    rarest = weighed.groupBy("source_id", "__term", "__times").agg(F.min(F.struct("__seen", "__gram")).alias("__best"))
    return rarest.filter("__best.__seen > 0").select("source_id", "__term", "__times", F.col("__best.__gram").alias("__gram"))


def keyword_join(links: DataFrame, keywords: DataFrame, url: str = "url", term: str = "term", times: str = "times") -> DataFrame:
    """Each row of ``links`` with each ``term`` of its source that its lower-case URL contains, and how often the table lists that term.

    ``keywords`` has (source_id, term), any number of rows, and may repeat itself. Terms are compared as they stand, so one with a
    capital is never found; the empty term is part of every URL. Rows without source or URL, and null terms, match nothing; equal rows of
    ``links`` each give their own rows. Terms are looked for once per distinct URL of a source, and what was found is joined to the rows. ``links`` is
    read three times: for the counts of grams, for the search, and for the rows.
    """
    for name in (term, times):
        if name.lower() in (c.lower() for c in links.columns):
            raise ValueError(f"links already have a column {name}")
    known = links.filter(F.col("source_id").isNotNull() & F.col(url).isNotNull())
    found = _found(known.select("source_id", url).distinct(), keywords, url)
    rows = _matched(known.join(found, ["source_id", url], "left"))
    return rows.select(*links.columns, F.col("__term").alias(term), F.col("__times").alias(times))


def _found(urls: DataFrame, keywords: DataFrame, url: str = "url") -> DataFrame:
    """(source_id, url, __term, __times) of distinct URLs.

    The optimizer does not know that a URL becomes many rows here, and could broadcast them. So this is an outer join, in which only the index can be
    broadcast, if it is under the session's threshold, and unmatched rows are filtered right behind it by a condition that the optimizer does
    not look into. A gram of a large source may be a hot key: adaptive execution splits its side of URLs. What was found meets its rows likewise.
    """
    index = keyword_index(urls, keywords, url).withColumnsRenamed({"source_id": "__source", "__gram": "__key"})
    grams = _text_grams(urls, F.lower(url))
    part = F.contains(F.lower(url), F.col("__term"))
    met = grams.join(index, (F.col("source_id") == F.col("__source")) & (F.col("__gram") == F.col("__key")) & part, "left")
    return _matched(met).select("source_id", url, "__term", "__times")


def _matched(met: DataFrame) -> DataFrame:
    """The rows of an outer join that found a term."""
    return met.filter(F.when(F.spark_partition_id() >= 0, F.col("__term").isNotNull()))


def count_terms(links: DataFrame, keywords: DataFrame, name: str) -> DataFrame:
    """``links`` with the number of entries of ``keywords`` that each one's URL contains, 0 where there are none."""
    found = _found(links.select("source_id", "url").distinct(), keywords)
    counted = found.groupBy("source_id", "url").agg(F.sum("__times").cast("int").alias(name))
    return links.join(counted, ["source_id", "url"], "left").select(*links.columns, F.coalesce(name, F.lit(0)).alias(name))
