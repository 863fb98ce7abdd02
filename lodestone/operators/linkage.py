"""Records matched to what they cite, tier by tier, and anchors that must be found exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a title keeps for comparison is its letters and digits.
TITLE = r"[^\p{L}\p{N}]+"


def plain_title(c: Column) -> Column:
    """Lower case, letters and digits only; null if none is left."""
    return F.nullif(F.regexp_replace(F.lower(c), TITLE, ""), F.lit(""))


def plain_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "^(https?://(dx[.])?doi[.]org/|doi:)", ""), F.lit(""))


def resolved(papers: DataFrame, works: DataFrame, paper: str, work: str, doi: str = "doi", title: str = "title", year: str = "year") -> DataFrame:
    """[J18] paper, work, tier, candidates, status: of each paper the work that it is.

    Tiers: 1 same DOI, title and year; 2 same DOI and title; 3 no work of the paper's DOI, but the same title and year. The best
    tier decides; where it holds several works the paper is ``ambiguous`` and has
    none, where no tier does it is ``unmatched``. A DOI whose titles all differ links nothing. Missing titles match none. Candidates
    are joined by block, DOI or title with year, and counted by tier before they meet the papers again, so a
    block of many works is added up and not listed.
    """
    p = papers.select(F.col(paper).alias("paper"), plain_doi(F.col(doi)).alias("doi"), plain_title(F.col(title)).alias("title"), F.col(year).alias("year"))
    w = works.select(F.col(work).alias("work"), plain_doi(F.col(doi)).alias("doi"), plain_title(F.col(title)).alias("title"), F.col(year).alias("year")).where("title is not null")
    one = (F.min("work").alias("work"), F.count_distinct("work").alias("candidates"))
    exact = w.where("doi is not null and year is not null").groupBy("doi", "title", "year").agg(*one).select("doi", "title", "year", F.struct("work", "candidates").alias("t1"))
    by_doi = w.where("doi is not null").groupBy("doi", "title").agg(*one).select("doi", "title", F.struct("work", "candidates").alias("t2"))
    known = works.select(plain_doi(F.col(doi)).alias("doi")).where("doi is not null").distinct().withColumn("known", F.lit(True))
    by_title = w.where("year is not null").groupBy("title", "year").agg(*one).select("title", "year", F.struct("work", "candidates").alias("t3"))
    x = p.join(exact, ["doi", "title", "year"], "left").join(by_doi, ["doi", "title"], "left").join(known, "doi", "left").join(by_title, ["title", "year"], "left")
    third = F.when(F.col("known").isNull(), F.col("t3"))
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(third.isNotNull(), 3)
    best = F.coalesce("t1", "t2", third)
    status = F.when(best.isNull(), "unmatched").when(best["candidates"] > 1, "ambiguous").otherwise("matched")
    return x.select(F.col("paper").alias(paper), F.when(best["candidates"] == 1, best["work"]).alias(work), tier.alias("tier"), F.coalesce(best["candidates"], F.lit(0)).cast("long").alias("candidates"), status.alias("status"))


def anchored(queries: DataFrame, anchors: DataFrame, query: str, anchor: str, keys: list[str], fail: bool = True) -> DataFrame:
    """[J28] query, anchor: the one anchor that agrees with the query in all keys. Where none or several do, the job fails, within
    the plan and with the query's name; without ``fail`` the anchor is null and ``matches`` says how many.

    Nulls agree with nothing. Anchors are counted by key before they are joined.
    """
    found = anchors.groupBy(*keys).agg(F.min(anchor).alias("__anchor"), F.count_distinct(anchor).alias("__n"))
    x = queries.select(query, *keys).join(found, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    one = F.col("__n") == 1
    if fail:
        message = F.concat(F.lit("query "), F.col(query).cast("string"), F.lit(" matches "), F.col("__n").cast("string"), F.lit(" anchors, not one"))
        return x.select(query, F.when(one, F.col("__anchor")).otherwise(F.raise_error(message)).alias(anchor))
    return x.select(query, F.when(one, F.col("__anchor")).alias(anchor), F.col("__n").cast("long").alias("matches"))
