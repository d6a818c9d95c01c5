"""State of opportunities, proposals and runs as functions of one snapshot and new input; each result is a new snapshot.

Plain tables have no merge: a single writer replaces the snapshot folder. Keys are deterministic, so that a step applied
twice gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.numeric import half_up

#: States in which an opportunity is open, may still be refreshed, and has ended.
OPEN = ("DETECTED", "REVIEWED", "PROPOSED", "APPLYING")
REFRESHABLE = ("DETECTED", "REVIEWED")
TERMINAL = ("DISMISSED", "APPLIED", "REJECTED")
MEASURES = ("score", "clicks", "impressions", "ctr", "position", "date_start", "date_end")


def opportunity_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def upsert_detected(snapshot: DataFrame, detected: DataFrame, run_id: str, now, snooze_days: int = 28) -> DataFrame:
    """snapshot (id, page_id, type, status, measures, dismissed_by, dismissed_at, dismiss_reason, run_id, last_detected_at) after
    a run's detections (page_id, type, measures), with an action for each row.

    An open row of the page and type is refreshed in place if DETECTED or REVIEWED, else left alone. Without an open row a
    new one is inserted, unless a user dismissed the same within snooze_days. A null position is stored as 0."""
    now = F.lit(now).cast("timestamp")
    rows = snapshot.withColumn("is_open", ~F.col("status").isin(*TERMINAL))
    new = detected.select("page_id", "type", *[F.col(c).alias(f"new_{c}") for c in MEASURES]).withColumn("new_position", F.coalesce("new_position", F.lit(0.0)))
    old = rows.join(new, ["page_id", "type"], "left")
    hit = F.col("is_open") & F.col("new_score").isNotNull() & F.col("status").isin(*REFRESHABLE)
    updated = [F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in MEASURES]
    kept = old.select(
        "id", "page_id", "type", "status", *updated, "dismissed_by", "dismissed_at", "dismiss_reason", F.when(hit, F.lit(run_id)).otherwise(F.col("run_id")).alias("run_id"),
        F.when(hit, now).otherwise(F.col("last_detected_at")).alias("last_detected_at"),
        F.when(hit, "updated").when(F.col("is_open") & F.col("new_score").isNotNull(), "skipped").otherwise("kept").alias("action"),
    )
    snoozed = (F.col("status") == "DISMISSED") & F.col("dismissed_by").isNotNull() & (F.col("dismissed_at") >= now - F.make_interval(days=F.lit(snooze_days)))
    barred = rows.where(F.col("is_open") | F.coalesce(snoozed, F.lit(False))).select("page_id", "type").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    fresh = new.join(barred, ["page_id", "type"], "left_anti").select(
        opportunity_id("page_id", "type", F.lit(run_id)).alias("id"), "page_id", "type", F.lit("DETECTED").alias("status"), *[F.col(f"new_{c}").alias(c) for c in MEASURES],
        null("string").alias("dismissed_by"), null("timestamp").alias("dismissed_at"), null("string").alias("dismiss_reason"), F.lit(run_id).alias("run_id"), now.alias("last_detected_at"), F.lit("created").alias("action"),
    )
    return kept.unionByName(fresh)


def clear_stale(snapshot: DataFrame, run_id: str, now) -> DataFrame:
    """DETECTED rows that the run didn't detect again become DISMISSED with reason SIGNAL_CLEARED; others stay."""
    gone = (F.col("status") == "DETECTED") & ~F.col("run_id").eqNullSafe(F.lit(run_id))
    now = F.lit(now).cast("timestamp")
    return snapshot.withColumns({"dismiss_reason": F.when(gone, "SIGNAL_CLEARED").otherwise(F.col("dismiss_reason")), "dismissed_at": F.when(gone, now).otherwise(F.col("dismissed_at")), "status": F.when(gone, "DISMISSED").otherwise(F.col("status"))})


def dismissed(snapshot: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Rows that requests (id, user_id, reason) name, dismissed if they are DETECTED or REVIEWED."""
    rows = snapshot.join(requests.select("id", "user_id", "reason"), "id", "left")
    hit = F.col("user_id").isNotNull() & F.col("status").isin(*REFRESHABLE)
    now = F.lit(now).cast("timestamp")
    return rows.withColumns({"dismissed_by": F.when(hit, F.col("user_id")).otherwise(F.col("dismissed_by")), "dismiss_reason": F.when(hit, F.col("reason")).otherwise(F.col("dismiss_reason")), "dismissed_at": F.when(hit, now).otherwise(F.col("dismissed_at")), "status": F.when(hit, "DISMISSED").otherwise(F.col("status"))}).drop("user_id", "reason")


def run_totals(rows: DataFrame) -> DataFrame:
    """Counts of a run's actions, for its record."""
    return rows.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped", "cleared", "kept")])


def swept(runs: DataFrame, cutoff) -> DataFrame:
    """Runs still RUNNING that started before the cutoff are FAILED."""
    hit = (F.col("status") == "RUNNING") & (F.col("started_at") < F.lit(cutoff).cast("timestamp"))
    return runs.withColumns({"error": F.when(hit, "interrupted").otherwise(F.col("error")), "status": F.when(hit, "FAILED").otherwise(F.col("status"))})


def sync_days(last_synced: Column, as_of: Column, days: Column | None = None, overlap: int = 3, default: int = 90, lag: int = 3) -> Column:
    """The days to fetch, ascending: as many as asked for, else from overlap days before the last one stored, else default."""
    end = F.date_sub(as_of, lag)
    start = F.coalesce(*([F.date_sub(end, days - 1)] if days is not None else []), F.date_sub(last_synced, overlap), F.date_sub(end, default - 1))
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def stale_reason(cfg: ReviewConfig = ReviewConfig()) -> Column:
    """Why an analysis is out of date, or null, from analysis_version, current_version, s_* (its snapshot) and o_* (now)."""
    c = F.col

    def moved(name: str, least: float) -> Column:
        change = half_up(F.abs(c(f"o_{name}") - c(f"s_{name}")).cast("double") / F.nullif(c(f"s_{name}"), F.lit(0)), 6)
        return (c(f"s_{name}") >= least) & (change >= cfg.evidence_change_ratio)

    place = half_up(F.abs(c("o_position") - c("s_position")), 6) >= cfg.position_change
    return F.when(~c("analysis_version").eqNullSafe(c("current_version")), "PAGE_VERSION_CHANGED").when(c("s_impressions").isNull(), None).when(moved("impressions", cfg.min_impressions_baseline) | moved("clicks", cfg.min_clicks_baseline) | F.coalesce(place, F.lit(False)), "EVIDENCE_CHANGED")


def sticky(before: Column, now: Column) -> Column:
    return F.coalesce(before, now)


def latest(events: DataFrame, *keys: str, at: str = "at") -> DataFrame:
    """The newest row of each key, by at and then by all other columns."""
    rest = [c for c in events.columns if c not in keys and c != at]
    return events.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_x")).select(*keys, "_x.*")


def folded_reviews(recommendations: DataFrame, events: DataFrame) -> DataFrame:
    """Recommendations (analysis_id, idx, text) with the state of their events (status, edited_text, at): the newest status,
    and the newest edit; the original stays beside it. Without events: PENDING."""
    keys = ["analysis_id", "idx"]
    state = events.groupBy(*keys).agg(F.max_by("status", "at").alias("status"), F.max_by("edited_text", F.when(F.col("edited_text").isNotNull(), F.col("at"))).alias("edited_text"))
    return recommendations.join(state, keys, "left").withColumn("status", F.coalesce("status", F.lit("PENDING"))).withColumn("value_source", F.when(F.col("edited_text").isNotNull(), "HUMAN_EDITED").otherwise("AI_RECOMMENDATION"))


def superseded(proposals: DataFrame) -> DataFrame:
    """Only the newest revision of a review stays live; earlier live ones are SUPERSEDED."""
    order = Window.partitionBy("review_id").orderBy(F.desc("revision"))
    live = F.col("status").isin("AWAITING_APPROVAL", "APPROVED")
    return proposals.withColumn("_n", F.row_number().over(order)).withColumn("status", F.when((F.col("_n") > 1) & live, "SUPERSEDED").otherwise(F.col("status"))).drop("_n")


def next_revisions(proposals: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (review_id, value) as proposals with the next revision numbers, in order of value."""
    top = proposals.groupBy("review_id").agg(F.max("revision").alias("top"))
    number = F.row_number().over(Window.partitionBy("review_id").orderBy("value"))
    return requests.join(top, "review_id", "left").select("review_id", (F.coalesce("top", F.lit(0)) + number).cast("int").alias("revision"), "value", F.lit("AWAITING_APPROVAL").alias("status"))


def applied_runs(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """runs (run_id, attempt, status) after deliveries (run_id, attempt, result): only APPLYING runs and matching attempts count."""
    got = deliveries.groupBy("run_id", "attempt").agg(F.max("result").alias("result"))
    state = F.when(F.col("result") == "MATCH", "APPLIED").when(F.col("result") == "FAILED", "FAILED").otherwise("AWAITING_CHANGE")
    return runs.join(got, ["run_id", "attempt"], "left").withColumn("status", F.when((F.col("status") == "APPLYING") & F.col("result").isNotNull(), state).otherwise(F.col("status"))).drop("result")


def following_runs(opportunities: DataFrame, runs: DataFrame) -> DataFrame:
    """Opportunities follow their runs: any pending one: APPLYING, else any applied one: APPLIED, else as they are."""
    state = runs.groupBy("opportunity_id").agg(F.bool_or(F.col("status").isin("PENDING", "APPLYING", "AWAITING_CHANGE")).alias("pending"), F.bool_or(F.col("status") == "APPLIED").alias("applied"))
    rows = opportunities.join(state, opportunities["id"] == state["opportunity_id"], "left").drop("opportunity_id")
    return rows.withColumn("status", F.when(F.col("pending"), "APPLYING").when(F.col("applied"), "APPLIED").otherwise(F.col("status"))).drop("pending", "applied")


def closed(opportunities: DataFrame, proposals: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opportunities named by ids, closed: APPLIED if any of their proposals was applied, else REJECTED; live proposals go."""
    named = ids.select("id", F.lit(True).alias("_closing"))
    did = proposals.groupBy(F.col("opportunity_id").alias("id")).agg(F.bool_or(F.col("status") == "APPLIED").alias("_applied"))
    rows = opportunities.join(named, "id", "left").join(did, "id", "left")
    rows = rows.withColumn("status", F.when(F.col("_closing") & F.coalesce("_applied", F.lit(False)), "APPLIED").when(F.col("_closing"), "REJECTED").otherwise(F.col("status"))).drop("_closing", "_applied")
    live = proposals.join(named.withColumnRenamed("id", "opportunity_id"), "opportunity_id", "left")
    live = live.withColumn("status", F.when(F.col("_closing") & F.col("status").isin("AWAITING_APPROVAL", "APPROVED"), "SUPERSEDED").otherwise(F.col("status"))).drop("_closing")
    return rows, live


def appended(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """target with those rows whose keys it doesn't have yet."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def property_switched(facts: DataFrame, states: DataFrame, property_id: str) -> tuple[DataFrame, DataFrame]:
    """After another property was chosen for a website: facts without the old one's, and its sync state (property_id,
    last_synced, sync_status, sync_error) as before any sync."""
    hit = F.col("property_id") == property_id
    clear = {"last_synced": F.when(~hit, F.col("last_synced")), "sync_status": F.when(hit, "IDLE").otherwise(F.col("sync_status")), "sync_error": F.when(~hit, F.col("sync_error"))}
    return facts.where(~hit), states.withColumns(clear)


def value_sources(proposals: DataFrame, drafts: DataFrame) -> DataFrame:
    """proposals (review_id, change_type, target_section, value, edited) with value_source, draft_id and draft_revision.

    drafts (review_id, draft_id, revision, change_type, target_section, value): those that were offered and not edited. A
    value that one of them has (the newest, if several) is AI_DRAFT; other values are HUMAN_EDITED where the recommendation
    was edited or has drafts, else AI_RECOMMENDATION. Values are compared with white space folded."""
    fold = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    keys = ["review_id", "change_type", "_section", "_value"]
    keyed = lambda rows: rows.withColumns({"_section": F.coalesce("target_section", F.lit("")), "_value": fold("value")})
    newest = keyed(drafts).groupBy(*keys).agg(F.max(F.struct("revision", "draft_id")).alias("d"))
    some = drafts.groupBy("review_id").agg(F.count("*").alias("_n"))
    rows = keyed(proposals).join(newest, keys, "left").join(some, "review_id", "left")
    source = F.when(F.col("d").isNotNull(), "AI_DRAFT").when(F.col("edited") | F.col("_n").isNotNull(), "HUMAN_EDITED").otherwise("AI_RECOMMENDATION")
    return rows.withColumns({"value_source": source, "draft_id": F.col("d.draft_id"), "draft_revision": F.col("d.revision")}).drop("_section", "_value", "d", "_n")


def regenerated(drafts: DataFrame, requests: DataFrame, most: int = 5) -> DataFrame:
    """requests (review_id, value, issues, analysis_version, current_version) with revision and outcome.

    STALE where the page has another version than the analysis; CAPPED where the review has most drafts already; INVALID
    with issues; REPEATED where a draft of the review says the same; else STORED with the next revision. One request for
    each review at a time; nothing but STORED ones may be appended, and the text of others isn't kept."""
    fold = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    known = drafts.groupBy("review_id").agg(F.count("*").alias("_n"), F.max("revision").alias("_top"), F.collect_set(fold("value")).alias("_said"))
    rows = requests.join(known, "review_id", "left")
    outcome = (
        F.when(~F.col("analysis_version").eqNullSafe(F.col("current_version")), "STALE").when(F.coalesce("_n", F.lit(0)) >= most, "CAPPED").when(F.size("issues") > 0, "INVALID")
        .when(F.coalesce(F.array_contains("_said", fold("value")), F.lit(False)), "REPEATED").otherwise("STORED")
    )
    rows = rows.withColumn("outcome", outcome)
    stored = F.col("outcome") == "STORED"
    return rows.withColumns({"revision": F.when(stored, F.coalesce("_top", F.lit(0)) + 1).cast("int"), "value": F.when(stored, fold("value"))}).drop("_n", "_top", "_said")


def still_current(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """proposals (page_id, page_version_id) with current_version_id of their page and matches, whether that is the version
    that they were approved against; a page that is gone never matches."""
    now = pages.select("page_id", "current_version_id")
    return proposals.join(now, "page_id", "left").withColumn("matches", F.coalesce(F.col("current_version_id") == F.col("page_version_id"), F.lit(False)))


def run_advanced(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Detection runs (run_id, website_id, status) after events (run_id, kind: claim, complete, fail): a queued run is claimed,
    a running one ends; other events change nothing."""
    got = events.groupBy("run_id").agg(F.bool_or(F.col("kind") == "claim").alias("_claim"), F.bool_or(F.col("kind") == "complete").alias("_done"), F.bool_or(F.col("kind") == "fail").alias("_fail"))
    rows = runs.join(got, "run_id", "left")
    running = F.when((F.col("status") == "QUEUED") & F.col("_claim"), "RUNNING").otherwise(F.col("status"))
    ended = F.when((running == "RUNNING") & F.col("_fail"), "FAILED").when((running == "RUNNING") & F.col("_done"), "COMPLETED").otherwise(running)
    return rows.withColumn("status", ended).drop("_claim", "_done", "_fail")


def run_requested(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (website_id) with the run that serves each: the website's queued one absorbs it, else a new one is made."""
    queued = runs.where(F.col("status") == "QUEUED").groupBy("website_id").agg(F.min("run_id").alias("run_id"))
    rows = requests.select("website_id").distinct().join(queued, "website_id", "left")
    return rows.withColumns({"absorbed": F.col("run_id").isNotNull(), "run_id": F.coalesce(F.col("run_id").cast("string"), F.concat(F.lit("new-"), "website_id"))})


def accessible(projects: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Projects of organizations that the user is a member of."""
    mine = memberships.where(F.col("user_id") == user_id).select("org_id")
    return projects.join(mine, "org_id", "left_semi")
