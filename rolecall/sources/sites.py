"""Careers sites: providers, scores and candidates from links and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx


def provider(url: Column) -> Column:
    """The feed provider of a url's host; null for none."""
    host = tx.url_host(url)
    return F.coalesce(*[F.when(host.rlike(p), name) for name, p in lx.PROVIDERS])


def ats_provider(url: Column) -> Column:
    """struct<provider, board_path> of the first known ATS host; null for none."""
    path = F.regexp_extract(url, r"^(?i)[a-z]+://[^/?#]+([^?#]*)", 1)

    def first(host: Column) -> Column:
        made = [F.when(host.rlike(p), F.struct(F.lit(name).alias("provider"), (F.regexp_substr(path, F.lit(board)) if board else F.lit(None).cast("string")).alias("board_path"))) for p, name, board in lx.ATS_HOSTS]
        return F.coalesce(*made)

    return tx.let(tx.url_host(url), first)


def is_ats(host: Column) -> Column:
    """Whether a host is a known ATS's: one pattern, where the provider doesn't matter; null for null."""
    return host.rlike("|".join(f"(?:{p})" for p, _, _ in lx.ATS_HOSTS))


def careers_score(url: Column, title: Column, official: Column) -> Column:
    """How much a url looks like a careers page, 0 to 1."""
    add = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    of_host = lambda host: (
        F.lit(0.3) + add(host.rlike(lx.CAREERS_HOST), 0.25) + add(is_ats(host), 0.2) + add(title.rlike(lx.CAREERS_TEXT), 0.15)
        + add(host == official, 0.1) + add(url.rlike(lx.CAREERS_URL), 0.05) + add(url.rlike(lx.NOISE_URL), -0.3)
    )
    total = tx.let(F.coalesce(tx.url_host(url), F.lit("")), of_host)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 3)))


def official_domain(results: DataFrame) -> DataFrame:
    """The best host of each company's results (company_id, name, position, url): name words in the
    host twice, a usual TLD and few labels once each; ignored hosts and hosts without a word go."""
    host = F.regexp_replace(tx.url_host(F.col("url")), r"^www\.", "")
    words = F.filter(F.split(tx.company_key(F.col("name")), " "), lambda w: F.length(w) > 2)
    rows = results.select("company_id", "position", host.alias("host"), words.alias("words"))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("host"), w)))
    score = hits * 2 + F.when(F.col("host").rlike(r"\.(com|co\.in|com\.in|in|net|org)$"), 1).otherwise(0) + F.when(F.size(F.split("host", r"\.")) <= 3, 1).otherwise(0)
    known = rows.where((hits > 0) & ~F.substring_index("host", ".", 1).isin(*lx.NOT_OFFICIAL_HOSTS)).withColumn("score", score)
    return known.groupBy("company_id").agg(F.max_by(F.struct("host", "score"), F.struct("score", -F.col("position"))).alias("b")).select("company_id", "b.*")


def top_candidates(candidates: DataFrame, k: int = 8) -> DataFrame:
    """The best confidence of each url of a company, and of those the ``k`` best."""
    best = candidates.groupBy("company_id", "careers_url").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("confidence"), "careers_url"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def search_candidates(results: DataFrame, k: int = 10) -> DataFrame:
    """Search results as careers candidates: one per host, the ``k`` best of each company."""
    official = official_domain(results).select("company_id", F.col("host").alias("_official"))
    scored = results.join(official, "company_id", "left").withColumns({"host": tx.url_host(F.col("url")), "confidence": careers_score(F.col("url"), F.col("title"), F.col("_official")), "provider": ats_provider(F.col("url"))["provider"]})
    one = scored.groupBy("company_id", "host").agg(F.max_by(F.struct("url", "confidence", "provider"), F.struct("confidence", -F.col("position"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("b.confidence"), "host"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("company_id", "host", "b.*", "rank")


def homepage_links(found: DataFrame, k: int = 5) -> DataFrame:
    """Careers links of home pages (anchors with page_url): own links need a careers text, outside
    links a careers host; the ``k`` best of each page."""
    url = tx.absolute_url(F.col("href"), F.col("page_url"))
    rows = found.where((F.length("text") <= 90) & ~F.col("text").rlike(lx.NOISE_LINK)).select("page_id", "position", "text", url.alias("careers_url"), tx.url_host(F.col("page_url")).alias("_home"))
    rows = rows.withColumn("_host", tx.url_host(F.col("careers_url")))
    host = F.col("_host")
    own, says = host == F.col("_home"), F.col("text").rlike(lx.CAREERS_TEXT)
    kept = rows.where(F.when(own, says).otherwise(F.concat(host, F.lit("")).rlike(lx.CAREERS_HOST)))
    points = F.when(own, 0.6).otherwise(0.7) + F.when(is_ats(host), 0.15).otherwise(0.0) + F.when(says, 0.15).otherwise(0.0)
    best = kept.withColumn("confidence", F.round(points, 3)).groupBy("page_id", "careers_url").agg(F.min(F.struct("position", "confidence")).alias("b")).select("page_id", "careers_url", "b.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "position"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def careers_landing(pages: DataFrame, k: int = 8) -> DataFrame:
    """Pages that can serve as careers pages: an ATS host, a page that says it has no openings, or one
    with job words and "apply"; the ``k`` best of each host."""
    ats = ats_provider(F.col("url"))["provider"]
    empty = F.left("html", F.lit(6000)).rlike(lx.NO_OPENINGS)
    jobs = F.col("html").rlike(r"(?i)(job|vacanc|opening|position)") & F.col("html").rlike("(?i)apply")
    kind = F.when(ats.isNotNull(), "ATS").when(empty, "NO_OPENINGS").when(jobs, "JOBS")
    rows = pages.select("url", ats.alias("provider"), kind.alias("kind"), F.when(ats.isNotNull(), 0.9).otherwise(0.8).alias("confidence")).where("kind is not null").distinct()
    rank = F.row_number().over(Window.partitionBy(tx.url_host(F.col("url"))).orderBy(F.desc("confidence"), "url"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
