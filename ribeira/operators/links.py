"""Link discovery: extraction, union with registered links, scoring and top-k per source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribeira.fixed import (
    DATA_EXTENSIONS,
    MAX_CANDIDATES,
    MIN_SCORE,
    SCORE_EXTENSION,
    SCORE_FEATURE_REQUEST,
    SCORE_FORMAT,
    SCORE_GOVERNMENT,
    SCORE_TERM,
    SOURCE_KEYWORDS,
)
from ribeira.functions.sql import text, texts
from ribeira.functions.urls import (
    ends_in_data_extension,
    file_suffix,
    link_names,
    page_links,
    path_name,
)
from ribeira.operators.keywords import count_terms
from ribeira.operators.quality import unique_by
from ribeira.operators.url_parts import PARTS, is_candidate, split_url


def extract_links(pages: DataFrame, html: str = "html", base: str = "url", link: str = "link") -> DataFrame:
    """One row per page and distinct absolute link.

    The set is formed inside each row, so this needs no shuffle.
    """
    others = [name for name in pages.columns if name != html]
    return pages.select(*others, F.explode(page_links(F.col(html), F.col(base))).alias(link))


def links_union(found: DataFrame, registered: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (source_id, url) of discovered and registered links of the sources in ``catalog``.

    Links found on a page do not count for sources that are limited to their registered ones. This
    is an inner join on purpose: the optimizer would move a semi or anti join below the extraction
    of links, where whole page texts might have to be shuffled.
    """
    open_sources = catalog.filter(~F.coalesce(F.col("direct_urls_only"), F.lit(False))).select("source_id")
    open_found = found.select("source_id", "url").join(open_sources, "source_id")
    return open_found.unionByName(registered.select("source_id", "url")).distinct()


def registered_links(catalog: DataFrame) -> DataFrame:
    """(source_id, url) rows of the links listed in a catalog."""
    return catalog.select("source_id", F.explode("direct_urls").alias("url"))


def link_score(links: DataFrame, keywords: Mapping[str, Sequence[str]] | DataFrame = SOURCE_KEYWORDS) -> DataFrame:
    """Links with ``score``: keywords of their source, file extension, requested format, publisher.

    The keyword table is configuration, so it goes into the plan as a constant map. No join is
    needed: rows stay where they are, whatever share of them one source holds, and no link is
    multiplied by its terms. A table of keywords (source_id, term) that is too large for that is joined by rare grams instead. The
    extension is looked for at the end of the whole URL here, unlike in ``is_candidate``. Links that ``split_url`` has taken apart stay so.
    """
    if isinstance(keywords, DataFrame):
        counted = link_score(count_terms(links, keywords, "__found"), {})
        return counted.withColumn("score", F.col("score") + SCORE_TERM * F.col("__found")).drop("__found")
    table = ", ".join(f"{text(source)}, array({texts(terms)})" for source, terms in keywords.items())
    terms = f"coalesce(try_element_at(map({table}), source_id), array())" if table else "array()"
    points = (
        f"{SCORE_TERM} * size(filter({terms}, term -> contains(__low, term)))"
        f" + if({ends_in_data_extension('__low')}, {SCORE_EXTENSION}, 0)"
        f" + if(contains(__low, 'request=getfeature'), {SCORE_FEATURE_REQUEST}, 0)"
        f" + if(contains(__low, 'gov.br'), {SCORE_GOVERNMENT}, 0)"
    )
    requested = F.when(F.col(f"{PARTS}.extension").isNotNull(), SCORE_FORMAT).otherwise(0)
    scored = split_url(links).withColumn("__low", F.lower("url")).withColumn("score", F.expr(points) + requested).drop("__low")
    return scored if PARTS in links.columns else scored.drop(PARTS)


def topk_links(scored: DataFrame, k: int = MAX_CANDIDATES, min_score: int = MIN_SCORE) -> DataFrame:
    """The best ``k`` candidate links per source, by score and then by URL, with their ``rank``.

    Weak links are filtered first. The rank limit runs within each task before the shuffle
    (WindowGroupLimit), so at most ``k`` rows per source and task travel, however large a source is. What ``split_url`` made is dropped.
    """
    best = Window.partitionBy("source_id").orderBy(F.col("score").desc(), F.col("url"))
    wanted = split_url(scored.filter(F.col("score") >= min_score)).filter(is_candidate()).drop(PARTS)
    return wanted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def allowlist_semi(files: DataFrame, catalog: DataFrame, path: str = "path") -> DataFrame:
    """Cached files that count: an accepted extension, and a registered name where that is required.

    For a source limited to its registered links, the file name has to be the last path segment of one of them. Registered
    names are rows, joined by source and name, so that a source may register any number of them, and only those of limited sources are
    listed. Files stay on the side that adaptive execution can split, and are read once. A source that the catalog has twice fails the query.
    """
    rules = unique_by(catalog, "source_id", "catalog", nulls_repeat=False).select(
        "source_id", F.coalesce(F.col("direct_urls_only"), F.lit(False)).alias("__direct_only")
    )
    registered = catalog.filter("direct_urls_only").select("source_id", F.explode(link_names(F.col("direct_urls"))).alias("__name"))
    listed = registered.distinct().withColumn("__listed", F.lit(True))
    return (
        files.filter(file_suffix(F.col(path)).isin(DATA_EXTENSIONS))
        .withColumn("__name", path_name(F.col(path)))
        .join(rules, "source_id")
        .join(listed, ["source_id", "__name"], "left")
        .filter(~F.col("__direct_only") | F.col("__listed"))
        .drop("__direct_only", "__name", "__listed")
    )
