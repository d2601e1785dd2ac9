"""Duplicates, survivors, reconciliation of batches with snapshots, upserts and histories.

Tables are snapshots: an upsert gives the next snapshot, which the caller writes beside the old
one.  Groups are folded with aggregates that combine before the shuffle, so one hot fingerprint
or company doesn't gather its rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..storage import written


def fingerprint() -> Column:
    """Key of a vacancy: the external id if there is one, else title and location."""
    ext = F.coalesce(F.trim("external_job_id"), F.lit(""))
    place = tx.location_key(F.col("location"))
    by_title = F.concat_ws(":", F.lit("tl"), "company_id", tx.slug(F.col("title")), F.when(place == "", "noloc").otherwise(place))
    return F.when(ext != "", F.concat_ws(":", F.lit("eid"), "company_id", tx.comparable(ext))).otherwise(by_title)


def filled(c: str, kind: str) -> Column:
    """The value, or null if it is blank or an empty list."""
    col = F.col(c)
    if kind.startswith("array"):
        return F.when(F.size(col) > 0, col)
    return F.when(F.trim(col) != "", col) if kind == "string" else col


def completeness(jobs: DataFrame) -> Column:
    """How many of ten fields are there; fields that aren't columns count as missing."""
    kinds = dict(jobs.dtypes)
    parts = [filled(c, kinds[c]).isNotNull().cast("int") for c in lx.COMPLETENESS_FIELDS if c in kinds]
    return sum(parts, F.lit(0))


def survivor_rank(jobs: DataFrame) -> Column:
    verified = F.when(F.col("verification") == "VERIFIED_ACTIVE", 400).when(F.col("verification") == "UNVERIFIED", 50).otherwise(100)
    return F.when(F.col("is_official"), 1000).otherwise(0) + verified + completeness(jobs) * 10 - F.when(F.col("status") == "ACTIVE", 0).otherwise(20)


def merge_groups(jobs: DataFrame, keys: Sequence[str] = ("company_id", "fingerprint")) -> DataFrame:
    """One row per key: the best-ranked record (ties: least url, id), its gaps filled from the others
    in rank order, the earliest first_seen_on, and the others' urls in ``also_seen_at``."""
    kinds = dict(jobs.dtypes)
    ordered = jobs.withColumn("_order", F.struct((-survivor_rank(jobs)).alias("rank"), "source_url", "id"))
    best = lambda c: F.min(F.struct("_order", F.col(c).alias("v")))["v"].alias(c)

    def first_filled(c: str) -> Column:
        value = filled(c, kinds[c])
        found = F.min(F.when(value.isNotNull(), F.struct("_order", value.alias("v"))))["v"]
        return found.alias(c)

    others = [c for c in jobs.columns if c not in keys and c not in lx.COMPLETENESS_FIELDS and c != "first_seen_on"]
    out = ordered.groupBy(*keys).agg(
        *[best(c) for c in others],
        *[first_filled(c) for c in jobs.columns if c in lx.COMPLETENESS_FIELDS],
        F.min("first_seen_on").alias("first_seen_on"),
        F.count("*").alias("merged"),
        F.array_sort(F.collect_set("source_url")).alias("_urls"),
    )
    return out.withColumn("also_seen_at", F.array_remove("_urls", F.col("source_url"))).drop("_urls")


def _keyed(jobs: DataFrame) -> DataFrame:
    """Postings with the keys that duplicates share, written once for all the joins on them."""
    keyed = jobs.select(
        "id", "company_id", "posted_at", F.coalesce("is_official", F.lit(False)).alias("is_official"), F.nullif(tx.comparable(F.col("external_job_id")), F.lit("")).alias("ext"),
        tx.comparable(F.col("title")).alias("name"), tx.location_key(F.col("location")).alias("place"), F.array_distinct(tx.tokens(F.col("title"))).alias("words"),
    )
    return written(keyed, "keyed-titles")


def duplicate_links(jobs: DataFrame, threshold: float = 0.82, days: int = 21) -> DataFrame:
    """a, b, tier, confidence of postings of one company that are the same vacancy, a < b.

    No tier makes all pairs of a group.  Tier 1 (same external id) and tier 2 (same title and place)
    link each posting to the least id of its group.  Tier 3 (similar titles at one place, dates
    near, one official) is between groups: postings of one company, title, place, date and
    officialness are alike in all that decides, so the least ids of two such groups stand for all
    their pairs, and membership is tier 2 with equal date and officialness.
    """
    keyed = _keyed(jobs)

    def star(rows: DataFrame, *keys: str) -> DataFrame:
        heads = rows.groupBy("company_id", *keys).agg(F.min("id").alias("a"), F.count("*").alias("_n")).where("_n > 1")
        return rows.join(heads, ["company_id", *keys]).where("id <> a").select("a", F.col("id").alias("b"))

    one = star(keyed.where("ext is not null"), "ext").select("a", "b", F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"))
    placed = keyed.where("place <> ''")
    two = star(placed, "name", "place").select("a", "b", F.lit(2).alias("tier"), F.lit(0.97).alias("confidence"))
    titles = _titles(placed)
    groups = _groups(placed, titles)
    near = _near(groups, _similar_titles(titles, threshold), groups, days)
    three = near.where("x.low < y.low").select(F.col("x.low").alias("a"), F.col("y.low").alias("b"), F.lit(3).alias("tier"), "confidence")
    return one.unionAll(two).unionAll(three)


def _prefix(rows: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """One row for each of a title's rarest tokens; two titles of Jaccard ``threshold`` share one."""
    each = rows.select("id", F.explode("words").alias("token")).join(counts, "token")
    ranked = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("rare"))
    keep = F.size("rare") - F.ceil(F.lit(threshold) * F.size("rare")).cast("int") + 1
    return rows.join(ranked, "id").withColumn("token", F.explode(F.slice("rare", F.lit(1), keep))).drop("rare")


_TITLE = ("company_id", "place", "name")


def _titles(placed: DataFrame) -> DataFrame:
    """Distinct titles of a company and place, each known by the least of its postings' ids."""
    return written(placed.groupBy(*_TITLE).agg(F.min("id").alias("id"), F.first("words").alias("words")), "titles")


def _similar_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """x, y, confidence of different titles at one company and place, in both orders."""
    counts = titles.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = _prefix(titles, counts, threshold)
    x, y = rare.alias("x"), rare.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("company_id", "place", "token")]
    alike = tx.token_similarity(F.col("x.words"), F.col("y.words"))
    found = x.join(y, same[0] & same[1] & same[2] & (F.col("x.id") != F.col("y.id"))).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), alike.alias("confidence"))
    return written(found.where(F.col("confidence") >= threshold).distinct(), "similar-titles")


def _groups(placed: DataFrame, titles: DataFrame) -> DataFrame:
    """title, posted_at, is_official, and the least and greatest id of the postings alike in them."""
    named = placed.join(titles.select(*_TITLE, F.col("id").alias("title")), list(_TITLE))
    return written(named.groupBy("title", "posted_at", "is_official").agg(F.min("id").alias("low"), F.max("id").alias("high")), "title-days")


def _near(left: DataFrame, similar: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """x (of ``left``) joined with y (of ``right``) of similar titles, dates near or unknown, one
    official.  Days are met by periods of their length, so that the join is on equal keys only."""
    period = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1))
    x = left.join(similar, F.col("title") == F.col("x")).drop("x").withColumn("_at", F.explode(F.when(F.col("posted_at").isNotNull(), F.array(*[period(F.col("posted_at")) + k for k in (-1, 0, 1)])).otherwise(F.array(F.lit(None).cast("long")))))
    y = right.withColumn("_at", period(F.col("posted_at")))
    official = F.col("x.is_official") | F.col("y.is_official")
    title = F.col("x.y") == F.col("y.title")
    dated = x.where("posted_at is not null").alias("x").join(y.where("posted_at is not null").alias("y"), title & (F.col("x._at") == F.col("y._at")) & official & (F.abs(F.datediff("x.posted_at", "y.posted_at")) <= days))
    whole = x.where(F.col("posted_at").isNull()).alias("x").join(y.alias("y"), title & official)
    once = x.where(F.col("posted_at").isNotNull() & (F.col("_at") == period(F.col("posted_at"))))
    undated = once.alias("x").join(y.where("posted_at is null").alias("y"), title & official)
    return dated.unionAll(whole).unionAll(undated)


def already_tracked(upserts: DataFrame, existing: DataFrame, threshold: float = 0.82, days: int = 21) -> DataFrame:
    """Upserts that no other stored posting, of any status, duplicates.

    Each upsert meets stored groups of postings that are alike in all that decides, not each of
    them; of a group's ids the least and the greatest tell whether one is other than its own.
    """
    u, e = _keyed(upserts), _keyed(existing)

    def clash(*keys: str) -> DataFrame:
        stored = e.groupBy("company_id", *keys).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
        return u.join(stored, ["company_id", *keys]).where("id <> _low or id <> _high").select("id")

    placed, stored = u.where("place <> ''"), e.where("place <> ''")
    titles = _titles(placed.unionAll(stored))
    mine = placed.join(titles.select(*_TITLE, F.col("id").alias("title")), list(_TITLE)).select("id", "title", "posted_at", "is_official")
    near = _near(mine, _similar_titles(titles, threshold), _groups(stored, titles), days).where("x.id <> y.low or x.id <> y.high").select("x.id")
    hit = clash("ext").unionAll(clash("name", "place").join(placed.select("id"), "id", "left_semi")).unionAll(near).distinct()
    return upserts.join(hit, "id", "left_anti")


def title_sets(jobs: DataFrame) -> DataFrame:
    """id, company_id and title_set of each posting: the least id of the company's postings whose
    titles have the same tokens (their similarity is 1); null for a title without tokens (0 to all)."""
    words = F.array_sort(F.array_distinct(tx.tokens(F.col("title"))))
    worded = jobs.select("id", "company_id", F.when(F.size(words) > 0, words).alias("words"))
    sets = worded.where("words is not null").groupBy("company_id", "words").agg(F.min("id").alias("title_set"))
    return worded.join(sets, ["company_id", "words"], "left").select("id", "company_id", "title_set")


def title_pairs(jobs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """company_id, a, b, similarity of a company's different titles (as token sets) that are similar.

    Equal sets are one, known by the least of its postings' ids, as ``title_sets`` has it; pairs are
    proposed by the rare tokens that two titles this similar must share, never all of a company's.
    """
    words = F.array_sort(F.array_distinct(tx.tokens(F.col("title"))))
    sets = written(jobs.select("id", "company_id", words.alias("words")).where(F.size("words") > 0).groupBy("company_id", "words").agg(F.min("id").alias("id")), "title-sets")
    counts = sets.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = _prefix(sets, counts, threshold)
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.company_id") == F.col("y.company_id")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")))
    pairs = met.select("x.company_id", F.col("x.id").alias("a"), F.col("y.id").alias("b"), tx.token_similarity(F.col("x.words"), F.col("y.words")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).distinct()


def changed(old: str = "e", new: str = "c", fields: Sequence[str] = lx.WATCHED_FIELDS) -> Column:
    """Whether a watched field differs in its comparable form."""
    form = lambda c: tx.comparable(F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit("")))
    out = F.lit(False)
    for f in fields:
        out = out | (form(f"{old}.{f}") != form(f"{new}.{f}"))
    return out


def reconcile(existing: DataFrame, collected: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Stored and collected postings by (company_id, fingerprint), one row each: action, status,
    verification, changed, and the merged columns.

    New rows are ACTIVE or EXPIRED; rows seen again are refreshed; closed rows stay closed; open
    rows not seen are REMOVED only where ``sources`` (company_id, source_verified) says that the
    source was read.  ``existing`` and ``collected`` have the same columns.
    """
    key = ["company_id", "fingerprint"]
    e, c = existing.alias("e"), collected.alias("c")
    joined = e.join(c, [F.col(f"e.{k}") == F.col(f"c.{k}") for k in key], "full_outer")
    joined = joined.withColumn("_company", F.coalesce("e.company_id", "c.company_id")).join(sources.select(F.col("company_id").alias("_company"), "source_verified"), "_company", "left")
    stored, seen = F.col("e.fingerprint").isNotNull(), F.col("c.fingerprint").isNotNull()
    closed = F.col("e.status").isin("EXPIRED", "REMOVED")
    action = (
        F.when(~stored, "NEW").when(seen & closed, "KEPT_CLOSED").when(seen, "SEEN")
        .when(F.coalesce("source_verified", F.lit(False)) & ~closed, "REMOVED").otherwise("UNTOUCHED")
    )
    fresh = F.col("action").isin("NEW", "SEEN")
    closing = F.coalesce(F.col("c.closing_at"), F.col("e.closing_at"))
    expired = F.coalesce(F.col("c.closing_at") < as_of, F.lit(False))
    joined = joined.withColumn("action", action)
    status = F.when(fresh, F.when(expired, "EXPIRED").otherwise("ACTIVE")).when(F.col("action") == "REMOVED", "REMOVED").otherwise(F.col("e.status"))
    verification = F.when(fresh, "VERIFIED_ACTIVE").when(F.col("action") == "REMOVED", "LAST_VERIFIED_UNAVAILABLE").otherwise(F.col("e.verification"))
    different = F.when(F.col("action") == "NEW", True).when(F.col("action") == "SEEN", changed()).otherwise(False)
    rest = [c for c in existing.columns if c not in (*key, "id", "status", "verification", "closing_at", "first_seen_on")]
    return joined.select(
        *[F.coalesce(f"e.{k}", f"c.{k}").alias(k) for k in key],
        F.coalesce("e.id", "c.id").alias("id"), "action", status.alias("status"), verification.alias("verification"), different.alias("changed"),
        F.when(fresh, closing).otherwise(F.col("e.closing_at")).alias("closing_at"), F.coalesce("e.first_seen_on", as_of).alias("first_seen_on"),
        *[F.when(fresh, F.col(f"c.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in rest],
    )


def removals(existing: DataFrame, collected: DataFrame, sources: DataFrame) -> DataFrame:
    """Open stored postings of verified sources that the batch didn't hold, marked as removed."""
    open_ = existing.where(~F.col("status").isin("EXPIRED", "REMOVED")).join(sources.where("source_verified"), "company_id", "left_semi")
    gone = open_.join(collected.select("company_id", "fingerprint"), ["company_id", "fingerprint"], "left_anti")
    return gone.withColumns({"status": F.lit("REMOVED"), "verification": F.lit("LAST_VERIFIED_UNAVAILABLE")})


def apply_rows(snapshot: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next snapshot: ``rows`` in place of those with their key, the others as they were."""
    return snapshot.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_jobs(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full-row replace by (company_id, fingerprint), keeping id and first_seen_on; rows without a
    title are rejected."""
    key = ["company_id", "fingerprint"]
    titled = incoming.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    held = snapshot.select(*key, F.col("id").alias("_id"), F.col("first_seen_on").alias("_first"))
    rows = titled.join(held, key, "left").withColumns({"id": F.coalesce("_id", "id"), "first_seen_on": F.coalesce("_first", "first_seen_on")}).drop("_id", "_first")
    return apply_rows(snapshot, rows, key)


def sources_seen(sightings: DataFrame) -> DataFrame:
    """One row per (job_id, source_url): first and last sighting, and what the first one said."""
    return sightings.groupBy("job_id", "source_url").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.min_by("is_official", F.struct("seen_at", "is_official")).alias("is_official"))


def overlay(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key: each field's last value that isn't null, and when the key first came."""
    at = F.struct(*order)
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*last, F.min(at)[order[0]].alias("first_at"))


def overlapping_runs(runs: DataFrame, block: str = "day") -> DataFrame:
    """Runs that start while an earlier run of their user and company is unfinished.

    A run without an end blocks all later ones.  Starts at one time count in order of run_id.  The
    running maximum of ends has two levels, so that no task sorts all runs of one user and company:
    that of whole blocks of time (``block``, a unit of date_trunc) before a run's, and that inside
    its block.
    """
    key = ["user_id", "company_id", "_block"]
    end = F.coalesce("completed_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    rows = runs.withColumn("_block", F.date_trunc(block, "started_at")).withColumn("_end", end)
    inside = Window.partitionBy(*key).orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("user_id", "company_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.max("_end").alias("_most")).withColumn("_before", F.max("_most").over(ahead)).drop("_most")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = rows.withColumn("_inside", F.max("_end").over(inside)).alias("r").join(blocks.alias("b"), same).select("r.*", "b._before")
    return joined.where(F.greatest("_inside", "_before") > F.col("started_at")).drop("_block", "_end", "_inside", "_before")


def retry_wait(failures: Column) -> Column:
    """Ten minutes, six hours from the third failure on."""
    return F.when(failures >= 3, F.make_dt_interval(F.lit(0), F.lit(6))).otherwise(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10)))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Per company, the failed runs since its last success, and when it may be tried again after
    the last failure; no row without a streak."""
    at = F.struct("started_at", "run_id")
    good = runs.where("status = 'COMPLETED'").groupBy("company_id").agg(F.max(at).alias("_good"))
    since = runs.where("status = 'FAILED'").join(good, "company_id", "left").where(F.col("_good").isNull() | (at > F.col("_good")))
    streak = since.groupBy("company_id").agg(F.count("*").alias("failures"), F.max("started_at").alias("last_failure"))
    return streak.withColumn("retry_after", F.col("last_failure") + retry_wait(F.col("failures")))


def patch(rows: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the patched fields; ``patches`` has key, ``present`` (names of fields given) and the
    fields, so that an explicit null differs from an absent field.  New keys are added."""
    joined = rows.alias("r").join(patches.alias("p"), key, "full_outer")
    given = lambda f: F.coalesce(F.array_contains("p.present", f), F.lit(False))
    rest = [c for c in rows.columns if c != key and c not in fields]
    return joined.select(key, *[F.when(given(f), F.col(f"p.{f}")).otherwise(F.col(f"r.{f}")).alias(f) for f in fields], *[F.col(f"r.{c}") for c in rest])


def upsert_companies(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Companies by (user_id, normalized_name): new ones inserted, a stored one's careers_url only
    filled if it is empty.  Of incoming rows with one key the least company_id counts."""
    key = ["user_id", "normalized_name"]
    one = incoming.groupBy(*key).agg(F.min(F.struct("company_id", "name", "careers_url")).alias("n"))
    joined = stored.join(one, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"n.{c}")).alias(c)
    return joined.select(*key, pick("company_id"), pick("name"), F.coalesce(F.nullif("careers_url", F.lit("")), F.col("n.careers_url")).alias("careers_url"))


def cascade(tables: Mapping[str, tuple[DataFrame, str]], gone: DataFrame, jobs: str = "jobs") -> dict[str, DataFrame]:
    """All tables without the deleted companies: ``tables`` names each with its key column, which is
    company_id, or the posting's id for children of ``jobs``."""
    lost = tables[jobs][0].join(gone.select("company_id"), "company_id", "left_semi").select(F.col("id").alias("_job"))
    out = {}
    for name, (df, key) in tables.items():
        out[name] = df.join(gone.select(F.col("company_id").alias(key)), key, "left_anti") if key == "company_id" else df.join(lost.withColumnRenamed("_job", key), key, "left_anti")
    return out


def year_changes(history: DataFrame) -> DataFrame:
    """A notification for each change of a user's graduation year, from the profile's history."""
    w = Window.partitionBy("user_id").orderBy("updated_at", "seq")
    before = F.lag("graduation_year").over(w)
    return history.withColumn("_was", before).where("_was is not null and graduation_year is not null and _was <> graduation_year").select("user_id", "updated_at", "seq", F.lit("ELIGIBLE_JOB_CHANGED").alias("kind"))


def mark_read(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """Sets read_at where a mark exists and none was set; marking again changes nothing."""
    first = marks.groupBy("id").agg(F.min("marked_at").alias("_at"))
    return notifications.join(first, "id", "left").withColumn("read_at", F.coalesce("read_at", "_at")).drop("_at")


def merge_answers(requirements: DataFrame, answers: DataFrame) -> DataFrame:
    """Requirements with a model's answers, each kept only if its quote stands in the posting.

    ``requirements``: id, description, skills_required, degree_level, work_authorization.
    ``answers``: id, field (SKILL, DEGREE_LEVEL or WORK_AUTH), value, quote, position.  A quote has
    8 characters or more in its normal form.  Stored values win; at most 25 skills and 5
    authorizations are taken.
    """
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    text = requirements.select("id", form(F.col("description")).alias("_text"))
    quoted = answers.join(text, "id").where((F.length(form(F.col("quote"))) >= 8) & F.contains("_text", form(F.col("quote"))))
    listed = lambda field: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("position", "value")))), lambda x: x["value"])
    found = quoted.groupBy("id").agg(F.slice(listed("SKILL"), 1, 25).alias("_skills"), F.get(listed("DEGREE_LEVEL"), 0).alias("_level"), F.slice(listed("WORK_AUTH"), 1, 5).alias("_auth"))
    joined = requirements.join(found, "id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "skills_required": F.array_union("skills_required", F.coalesce("_skills", none)),
        "degree_level": F.when(F.col("degree_level") == "UNKNOWN", F.coalesce("_level", "degree_level")).otherwise(F.col("degree_level")),
        "work_authorization": F.coalesce("work_authorization", F.when(F.size("_auth") > 0, F.col("_auth"))),
        "merged": F.col("_skills").isNotNull(),
    }).drop("_skills", "_level", "_auth")


def _least_labels(edges: DataFrame) -> DataFrame:
    """page_id, url, root of each url on an edge (page_id, a, b): the least url of its component.

    Each round a url takes the least label next to it, then that label's own label, so chains
    shrink fast.  Labels only fall, so the rounds end by themselves, and only when none moves.
    """
    edges = written(edges, "clash-pairs")
    if edges.isEmpty():
        return edges.select("page_id", F.col("a").alias("url"), F.col("b").alias("root"))
    both = written(edges.unionAll(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "clash-edges")
    labels = written(both.groupBy("page_id", F.col("a").alias("url")).agg(F.least("url", F.min("b")).alias("root")), "clash-labels")
    while True:
        there = labels.select("page_id", F.col("url").alias("b"), F.col("root").alias("near"))
        least = both.join(there, ["page_id", "b"]).groupBy("page_id", F.col("a").alias("url")).agg(F.min("near").alias("near"))
        step = labels.join(least, ["page_id", "url"]).withColumn("next", F.least("root", "near"))
        jump = there.select("page_id", F.col("b").alias("next"), F.col("near").alias("far"))
        moved = step.join(jump, ["page_id", "next"]).withColumn("to", F.least("next", "far"))
        rounds = written(moved.select("page_id", "url", F.col("to").alias("root"), (F.col("to") < F.col("root")).alias("moved")), "clash-labels")
        labels = rounds.drop("moved")
        if rounds.where("moved").isEmpty():
            return labels


def clash_roots(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """page_id, url, root: the least url of all that clash with it, directly or through others.

    Two rows of a page clash if they have one url, or one location and titles of a similarity over
    ``threshold``.  The urls of one token set are a star to their least url, and a url goes by the
    least such head.  Only where a url has several heads, or two sets are similar (they join on the
    rare tokens that titles this similar must share), heads are joined in rounds.  Urls that are
    their own root are left out.
    """
    words = F.array_sort(F.array_distinct(tx.tokens(F.coalesce("title", F.lit("")))))
    keyed = rows.where("page_id is not null and url is not null").select("page_id", "url", F.coalesce("location", F.lit("")).alias("place"), words.alias("words")).where(F.size("words") > 0)
    # one shuffle for the distinct urls of a set and their least; the set is known by its tokens in a line, which hold no space
    named = keyed.select("page_id", "place", F.array_join("words", " ").alias("name"), "url").repartition("page_id", "place", "name").distinct()
    headed = named.withColumn("head", F.min("url").over(Window.partitionBy("page_id", "place", "name")))
    lows = headed.select("page_id", "url", "head", F.min("head").over(Window.partitionBy("page_id", "url")).alias("low"))
    lows = written(lows.where("low <> url or low <> head").distinct(), "clash-urls")
    several = lows.where("low <> head").select("page_id", F.col("low").alias("a"), F.col("head").alias("b"))
    # two sets that differ in a token are similar over t only if they share more than t / (1 - t)
    long = keyed.where(F.size("words") > threshold / (1 - threshold) - 1e-6).groupBy("page_id", "place", "words").agg(F.min("url").alias("head"))
    long = written(long, "clash-titles").withColumn("id", F.struct("page_id", "place", "words"))
    counts = long.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = _prefix(long, counts, threshold)
    x, y = rare.alias("x"), rare.alias("y")
    block = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("page_id", "place", "token")]
    alike = tx.token_similarity(F.col("x.words"), F.col("y.words")) > threshold
    near = x.join(y, block[0] & block[1] & block[2] & (F.col("x.words") < F.col("y.words")) & alike).where("x.head <> y.head")
    pairs = near.select("x.page_id", F.col("x.head").alias("a"), F.col("y.head").alias("b"))
    joined = _least_labels(several.unionAll(pairs)).withColumnRenamed("url", "low").where("low <> root")
    stars = lows.select("page_id", "url", "low").distinct()
    # a head that is joined to others may have no line of its own
    heads = joined.select("page_id", F.col("low").alias("url"), "low").join(stars.select("page_id", "url"), ["page_id", "url"], "left_anti")
    return stars.unionByName(heads).join(joined, ["page_id", "low"], "left").select("page_id", "url", F.coalesce("root", "low").alias("root")).where("url <> root")


def merge_extracted(rows: DataFrame) -> DataFrame:
    """One row per posting of a page's several extractors.

    Rows clash by url, or by similar titles at one location (``clash_roots``), and all that hang
    together are one posting, named by its least url.  The structured extraction wins, then the
    longer description; gaps of id and dates are filled.
    """
    roots = clash_roots(rows)
    order = F.struct((F.col("method") != "JSON_LD").alias("prose"), (-F.length(F.coalesce("description", F.lit("")))).alias("size"), "url", "title")
    ranked = rows.join(roots, ["page_id", "url"], "left").withColumns({"root": F.coalesce("root", "url"), "_order": order})
    fills = ("external_job_id", "posted_at", "closing_at")
    fill = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_order", F.col(c).alias("v"))))["v"].alias(c)
    best = F.min(F.struct("_order.*", "location", "description", "method")).alias("_best")
    found = ranked.groupBy("page_id", "root").agg(best, *[fill(c) for c in fills], F.count("*").alias("merged"))
    return found.select("page_id", "root", *[F.col(f"_best.{c}").alias(c) for c in ("url", "title", "location", "description", "method")], *fills, "merged")
