"""Keyword tables joined by rare grams, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ribeira.operators.keywords import keyword_index, keyword_join
from ribeira.operators.links import link_score

LINKS, TERMS = "source_id STRING, url STRING, n INT", "source_id STRING, term STRING"


def brute(links, terms):
    rows = [(s, u, n, t) for s, u, n in links for z, t in set(terms) if None not in (s, u, t) and s == z and t in u.lower()]
    return sorted((*row, terms.count((row[0], row[3]))) for row in rows)


def joined(spark, links, terms):
    got = keyword_join(spark.createDataFrame(links, LINKS), spark.createDataFrame(terms, TERMS))
    assert got.columns == ["source_id", "url", "n", "term", "times"]
    return sorted(tuple(r) for r in got.collect())


ODD_LINKS = [
    ("a", "https://h/Ação😀/x.zip", 1), ("a", "", 2), ("a", None, 3), (None, "https://h/x", 4), ("a", "ab", 5), ("b", "https://h/x.zip", 6),
    ("a", "https://h/x.zip", 7), ("a", "https://h/x.zip", 7), ("a", "aaaaaa", 8), ("a", "x" * 20_000 + "needle" + "x" * 20_000, 9),
]
ODD_TERMS = [
    ("a", "ção😀"), ("a", ""), ("a", "x"), ("a", ".z"), ("a", "zip"), ("a", "zip"), ("a", None), (None, "zip"), ("a", "ZIP"), ("a", "aaa"), ("a", "aaaaaaa"),
    ("a", "needle"), ("a", "😀"), ("a", "%"), ("b", "h/x.zip"), ("b", "needle"), ("c", "zip"), ("a", "\n"),
]


def test_odd_links_and_terms(spark):
    assert joined(spark, ODD_LINKS, ODD_TERMS) == brute(ODD_LINKS, ODD_TERMS)
    assert joined(spark, [], ODD_TERMS) == [] == joined(spark, ODD_LINKS, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    draw = random.Random(seed)
    links = [(draw.choice("aaab"), "".join(draw.choices("abcD", k=draw.randint(0, 12))), i) for i in range(200)]
    terms = [(draw.choice("aaab"), "".join(draw.choices("abcd", k=draw.randint(0, 6)))) for _ in range(300)]
    assert joined(spark, links, terms) == brute(links, terms)


def test_score_by_a_table_is_that_by_a_mapping(spark):
    rows = [(s, u) for s, u, _ in ODD_LINKS if s and u]
    links = spark.createDataFrame(rows, "source_id STRING, url STRING")
    terms = [(s, t) for s, t in ODD_TERMS if s and t is not None]
    table = {s: [t for z, t in terms if z == s] for s in "abc"}
    by_table = link_score(links, spark.createDataFrame(terms, TERMS))
    by_mapping = link_score(links, table)
    assert by_table.schema["score"].dataType == by_mapping.schema["score"].dataType
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, by_mapping.collect()))


def test_many_terms(spark):
    """A hot source with 10^5 terms: each URL meets few of them, and the side of URLs is never the one to be broadcast."""
    n = 100_000
    terms = spark.range(n).select(F.lit("hot").alias("source_id"), F.substring(F.sha1(F.col("id").cast("string")), 1, 9).alias("term"))
    links = spark.range(2000).select(
        F.lit("hot").alias("source_id"),
        F.concat(F.lit("https://h.example/"), F.substring(F.sha1((F.col("id") * 40).cast("string")), 1, 9), F.lit(".zip")).alias("url"),
    )
    got = keyword_join(links, terms)
    assert got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert keyword_index(links, terms).count() <= n


def test_copies_of_a_url_are_searched_once(spark):
    """Terms are looked for in distinct URLs, so the work does not grow with copies; each row still gets its own results."""
    rows = [("a", "https://h/x.zip", i) for i in range(300)] + [("b", "https://h/x.zip", 0), ("a", "https://h/y.zip", 0), ("a", None, 0)]
    terms = [("a", "zip"), ("a", "x.z"), ("a", ""), ("b", "zip"), (None, "zip")]
    assert joined(spark, rows, terms) == brute(rows, terms)
    got = keyword_join(spark.createDataFrame(rows, LINKS), spark.createDataFrame(terms, TERMS))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    searched = [i for i, line in enumerate(plan) if re.search(r"Generate explode\(array_distinct\(concat\(", line)]
    assert len(searched) == 2
    assert all(re.search(r"Aggregate \[source_id#\d+, url#\d+\], ", plan[i + 1]) for i in searched)


def test_clashing_names_raise(spark):
    links = spark.createDataFrame([("a", "u", 1)], "source_id STRING, url STRING, Term INT")
    with pytest.raises(ValueError, match="term"):
        keyword_join(links, spark.createDataFrame([], TERMS))
