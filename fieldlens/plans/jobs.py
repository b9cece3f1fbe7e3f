"""Jobs and deliveries as tables (JB1-JB17, AG25, TK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import global_rank

STATES = ("calibration_pending", "queued", "processing", "tagging_pending", "ready", "failed")
DELIVERABLES = ("coach_analytics", "event_highlights", "player_highlights")


def queue_head(jobs: DataFrame, n: int = 1) -> DataFrame:
    """TK6: the jobs that have waited longest."""
    return jobs.where("state = 'queued'").orderBy("created_at", "job_id").limit(n)


def dashboard(jobs: DataFrame) -> DataFrame:
    """AG25: jobs, finished ones and hours of video, by sport."""
    return jobs.groupBy("sport").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("state") == "ready").alias("n_ready"), (F.sum("duration_sec") / 3600).alias("hours"))


def deliverables(duration: Column, asked: Column, longest: float = 1200.0) -> Column:
    """JB5: long recordings get the analytics only."""
    return F.when(duration > longest, F.array(F.lit("coach_analytics"))).otherwise(F.split(asked, ","))


def cloud_state(state: Column) -> Column:
    """JB4: what the requester sees."""
    return F.when(state == "queued", "waiting").when(state.isin("processing", "calibration_pending", "tagging_pending"), "processing").when(state == "ready", "ready").otherwise("failed")


def violations(jobs: DataFrame, shortest: float = 1.0, longest: float = 4.0) -> DataFrame:
    """JB9: rows that break a rule, and which; durations in units of 3000 seconds."""
    units = F.col("duration_sec") / 3000
    found = F.array_compact(F.array(F.when(~F.col("state").isin(*STATES), "state"), F.when(~units.between(shortest, longest), "duration"), F.when(F.size(F.array_except(F.split("deliverables", ","), F.array(*map(F.lit, DELIVERABLES)))) > 0, "deliverables")))
    return jobs.withColumn("broken", F.array_join(found, ",")).where("broken <> ''")


def resolve_steps(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """JB2: of the ordered steps (step, no, needs) those of the foundation (no needs) or of something asked for, once each."""
    own = jobs.select("job_id", F.explode(F.concat(F.array(F.lit("")), F.split("deliverables", ","))).alias("needs"))
    named = steps.select("step", "no", F.explode(F.split(F.coalesce("needs", F.lit("")), ",")).alias("needs"))
    named = F.broadcast(named)  # a handful of steps, whose few needs would each bring a part of all jobs to one task
    return own.join(named, "needs").select("job_id", "step", "no").distinct()


def progress(steps: DataFrame) -> DataFrame:
    """JB3: percentage done after each step of a job."""
    w = Window.partitionBy("job_id")
    return steps.withColumn("pct", F.round(100.0 * F.row_number().over(w.orderBy("no")) / F.count(F.lit(1)).over(w)).cast("bigint"))


def delivery_folder(path: Column) -> Column:
    """JB6: folder of an output file by where it lies; null for internal files."""
    return F.when(path.contains("/reels/"), "player_highlights").when(path.contains("/clips/"), "event_highlights").when(path.endswith(".pdf") | path.contains("/coach/"), "coach_analytics")


def named_clips(clips: DataFrame, tags: DataFrame) -> DataFrame:
    """JN24, JB14: each clip's name, its own tag, else its track's, else the track's number; skipped clips go."""
    own = tags.groupBy("clip").agg(F.min("name").alias("own"))
    by_track = clips.join(tags, "clip").where(~F.col("name").startswith("__")).groupBy("track_id").agg(F.min("name").alias("of_track"))
    rows = clips.join(own, "clip", "left").join(by_track, "track_id", "left")
    name = F.coalesce("own", "of_track", F.format_string("track_%03d", F.col("track_id")))
    return rows.withColumn("name", name).where(~F.col("name").startswith("__")).drop("own", "of_track")


# fixed values: what people read when a step fails, for each step, and for others
STAGE_MESSAGES = {
    "decoding": "We couldn't read the video. Please try uploading it again.",
    "detecting": "Something went wrong while finding players. Please try again.",
    "tracking": "Something went wrong while following players. Please try again.",
    "teams": "Something went wrong while sorting the teams. Please try again.",
    "ball": "Something went wrong while tracking the ball. Please try again.",
    "analytics": "Something went wrong while building the analytics. Please try again.",
    "events": "Something went wrong while finding key moments. Please try again.",
    "player_highlights": "Something went wrong while building player reels. Please try again.",
    "tagging_pending": "We're waiting on player names. Please finish tagging.",
    "tagging_done": "Something went wrong after tagging. Please try again.",
}
OTHER_STAGE = "Something went wrong while processing this match. Please try again."
# fixed values: states of a request that may be approved, rejected, uploaded to
APPROVABLE = ("submitted", "quota_waiting")
REJECTABLE = ("submitted", "approved", "quota_waiting", "uploading", "uploaded")
UPLOADABLE = ("approved", "uploading", "quota_waiting")
#: What an update may change.
MUTABLE = ("state", "stage", "progress", "error")


def newest_first(jobs: DataFrame) -> DataFrame:
    """TK6, JB1: ``place`` of each job, the newest first, equals by id."""
    return global_rank(jobs.withColumn("__age", -F.unix_timestamp(F.col("created_at").cast("timestamp"))), ["__age", "job_id"], "place").drop("__age")


def get_job(jobs: DataFrame, job_id) -> DataFrame:
    """JB1: one job, or nothing."""
    return jobs.where(F.col("job_id") == job_id)


def updated(jobs: DataFrame, changes: DataFrame, fields: tuple[str, ...] = MUTABLE) -> DataFrame:
    """JB1, JB17: jobs with what the changes (one row for a job) give for the fields that may change; other fields of the changes are left out, nulls change nothing."""
    new = [f for f in fields if f in changes.columns and f in jobs.columns]
    rows = jobs.join(changes.select("job_id", *[F.col(f).alias(f"__{f}") for f in new]), "job_id", "left")
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in jobs.columns])


def resumed(steps: DataFrame, after: str = "tag") -> DataFrame:
    """JB3: the steps of a job that has been tagged that come after the pause, with progress counted over all of its steps."""
    rows = progress(steps)
    pause = rows.where(F.col("step") == after).select("job_id", F.col("no").alias("__pause"))
    return rows.join(pause, "job_id").where("no > __pause").drop("__pause")


def promoted(jobs: DataFrame, free_bytes: int, threshold: int) -> DataFrame:
    """JB7, ST7: with room to spare the job that has waited longest for it is approved; else nothing."""
    return jobs.where((F.col("state") == "quota_waiting") & F.lit(free_bytes > threshold)).orderBy("created_at", "job_id").limit(1).withColumn("state", F.lit("approved"))


def decided(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """JB7: jobs with the ``action`` asked for, the state it leads to, and whether the state allows it."""
    may = F.when(F.col("action") == "approve", F.col("state").isin(*APPROVABLE)).when(F.col("action") == "reject", F.col("state").isin(*REJECTABLE)).otherwise(F.lit(False))
    rows = jobs.join(decisions, "job_id").withColumn("allowed", may)
    return rows.withColumn("next_state", F.when(F.col("allowed"), F.when(F.col("action") == "approve", "approved").otherwise("rejected")).otherwise(F.col("state")))


def visible(jobs: DataFrame, caller, admins: DataFrame) -> DataFrame:
    """JB8: the caller's own jobs, or all if the caller is an admin."""
    is_admin = admins.where(F.col("user_id") == caller).select(F.lit(True).alias("__admin")).limit(1)
    rows = jobs.join(is_admin, F.lit(True), "left")  # one row at most
    return rows.where((F.col("user_id") == caller) | F.coalesce("__admin", F.lit(False))).drop("__admin")


def insertable(rows: DataFrame, caller) -> DataFrame:
    """JB8: the new jobs that their caller may create: own ones that are just submitted."""
    return rows.where((F.col("user_id") == caller) & (F.col("state") == "submitted"))


def friendly(stage: Column) -> Column:
    """JB10, JB16: what people read when a step fails."""
    out = F.lit(OTHER_STAGE)
    for k, text in STAGE_MESSAGES.items():
        out = F.when(stage == k, text).otherwise(out)
    return out


def failure_log(failures: DataFrame) -> DataFrame:
    """JB16: ``path, value`` of a log for each job and step that failed, and the ``message`` for people; the last report of a step wins."""
    last = failures.groupBy("job_id", "stage").agg(F.max_by("detail", "at").alias("value"))
    return last.select("job_id", "stage", F.concat(F.col("job_id").cast("string"), F.lit("/logs/"), F.col("stage"), F.lit(".log")).alias("path"), "value", friendly(F.col("stage")).alias("message"))


def detail_of(state: Column, note: Column, fallback: Column, reason: Column, error: Column) -> Column:
    """JB10: what a requester reads under a state: its note or the usual text; with a reason where it was rejected, the error where it failed."""
    return F.when((state == "failed") & (F.coalesce(error, F.lit("")) != ""), error).when((state == "rejected") & (F.coalesce(reason, F.lit("")) != ""), F.concat(fallback, F.lit(" Reason: "), reason)).otherwise(F.coalesce(F.nullif(note, F.lit("")), fallback))


def clip_ids(records: DataFrame) -> DataFrame:
    """JB11: ``clip_id`` of manifest records: their own, else their clip's; of a path the last part."""
    own = F.coalesce(F.nullif(F.col("clip_id"), F.lit("")), F.col("clip"), F.lit(""))
    return records.withColumn("clip_id", F.regexp_extract(own, r"([^/\\\\]*)$", 1))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JB11: the records of clip manifests, be they an object with ``clips`` or a bare list."""
    record = "array<struct<clip_id:string,clip:string,track_id:bigint,role:string,start_frame:bigint,end_frame:bigint>>"
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<clips:{record}>")["clips"]
    rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", record)).otherwise(whole)).alias("r")).select("r.*")
    return clip_ids(rows)


def safe_path(path: Column) -> Column:
    """JB12: whether a path stays below its folder: relative, without a step up or a drive."""
    return ~(path.startswith("/") | path.startswith("\\") | path.rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)") | path.rlike(r"^[A-Za-z]:"))


def mirrored(cloud: DataFrame, local: DataFrame) -> DataFrame:
    """JB13: cloud rows with the state of their local job, and whether it is to be queued now.

    A job whose court is set up is queued; a finished one stays as it is until it was delivered; a note that only analytics are made stays
    while the job is queued.
    """
    own = local.select(F.col("job_id").alias("local_job_id"), F.col("state").alias("__local"), F.col("detail").alias("__detail"))
    rows = cloud.join(own, "local_job_id", "left").withColumn("enqueue", F.coalesce(F.col("__local") == "calibrated", F.lit(False)))
    now = F.when(F.col("__local").isin("calibrated", "queued", "processing", "calibration_pending", "tagging_pending"), "processing").when(F.col("__local") == "failed", "failed").otherwise(F.col("state"))
    keeps = F.col("__local").isin("queued", "calibrated") & F.coalesce(F.col("state_detail").contains("analytics only"), F.lit(False))
    detail = F.when(F.col("__local").isNull() | (F.col("__local") == "ready") | keeps, F.col("state_detail")).otherwise(F.col("__detail"))
    return rows.withColumns({"state": now, "state_detail": detail}).drop("__local", "__detail")


def outputs(files: DataFrame, root: str = "outputs/") -> DataFrame:
    """JB15: files below a job's outputs by their relative path, with their place in order."""
    rows = files.where(F.col("path").startswith(root)).withColumn("path", F.substring("path", F.lit(len(root) + 1), F.length("path")))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("job_id").orderBy("path")).cast("bigint"))


def highlight(path: Column) -> Column:
    """AG25: whether a file is a highlight video: a ranked clip, a reel, or a draft of one."""
    of = (path.startswith("events/") & path.contains("/clips/")) | (path.startswith("player_highlights/") & path.contains("/reels/")) | path.startswith("event_highlights/")
    return path.endswith(".mp4") & of


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """ST7: finished jobs past their time, as they are marked: without results."""
    rows = jobs.where((F.col("state") == "ready") & (F.col("expires_at") <= now))
    return rows.withColumns({"state": F.lit("expired"), "state_detail": F.lit("These results have expired."), "results_url": F.lit(None).cast("string")})


def chunk_ranges(uploads: DataFrame, chunk: int) -> DataFrame:
    """ST8: the ranges in which what is left of each upload (total, done) is sent, with their headers."""
    at = F.explode(F.sequence(F.col("done"), F.col("total") - 1, F.lit(chunk).cast("bigint"))).alias("start")
    rows = uploads.where("done < total").select("*", at).withColumn("end", F.least(F.col("start") + chunk, F.col("total")) - 1)
    return rows.withColumn("header", F.format_string("bytes %d-%d/%d", "start", "end", "total"))
