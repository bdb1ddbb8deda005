"""Control-plane operators over tables: caches, ranking, failover, sessions, jobs, history, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BODY, MOST_FRAME, MOST_VIDEO = 100, 8_000_000, 60_000_000
HISTORY, PICKED = 30, 20


# ---- caches ----


def content_key(body: Column | str, *parts: Column) -> Column:
    """Digest of the body; further parts (resolved model, scale, natural to two decimals) follow by dashes."""
    digest = F.sha2((F.col(body) if isinstance(body, str) else body).cast("binary"), 256)
    return F.concat_ws("-", digest, *parts) if parts else digest


def cache_state(requests: DataFrame, key: str, order: str) -> DataFrame:
    """HIT if an earlier request had the key, else MISS; the smallest order of each key is found map-side."""
    first = requests.groupBy(key).agg(F.min(order).alias("first"))
    return requests.join(first, key).withColumn("state", F.when(F.col(order) == F.col("first"), "MISS").otherwise("HIT"))


def hits_and_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests with the cached object, and those without."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def merged_cache(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Keyed append; what is cached stays."""
    return cache.unionByName(fresh.dropDuplicates([key]).join(cache.select(key), key, "left_anti"))


def valid_bodies(requests: DataFrame, body: str = "body", video: Column | None = None) -> DataFrame:
    """Bodies within the limits of frames, or of videos."""
    most = F.lit(MOST_FRAME) if video is None else F.when(video, MOST_VIDEO).otherwise(MOST_FRAME)
    return requests.where((F.octet_length(body) >= LEAST_BODY) & (F.octet_length(body) <= most))


# ---- backends ----


def parsed_backends(configs: DataFrame, static: str, dynamic: str | None = None) -> DataFrame:
    """A10: rows (pos, host, fn_image, fn_video, args) of "host|image|video|args, ..." texts; a dynamic text goes first.

    Blank entries fall out before they are numbered; a trailing slash is dropped; a
    missing, zero or unreadable image function is 0 and video function 3; three
    arguments only if it says so.
    """
    text = F.coalesce(F.nullif(F.col(dynamic), F.lit("")), F.col(static)) if dynamic else F.col(static)
    entries = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    rows = configs.select("*", F.posexplode(entries).alias("pos", "entry"))
    part = lambda n: F.get(F.split("entry", r"\|"), F.lit(n))
    number = lambda n: F.coalesce(F.nullif(F.trim(part(n)).try_cast("int"), F.lit(0)))
    return rows.select(
        *configs.columns, "pos", F.regexp_replace(part(0), "/$", "").alias("host"), F.coalesce(number(1), F.lit(0)).alias("fn_image"),
        F.coalesce(number(2), F.lit(3)).alias("fn_video"), F.when(part(3) == "3", 3).otherwise(2).alias("args"),
    )


def zipped(lists: DataFrame, left: str, right: str) -> DataFrame:
    """The entries of two arrays that have the same place, with their place; what one lacks is null."""
    rest = [c for c in lists.columns if c not in (left, right)]
    return lists.select(*rest, F.posexplode(F.arrays_zip(left, right)).alias("pos", "_pair")).select(*rest, "pos", F.col(f"_pair.{left}").alias(left), F.col(f"_pair.{right}").alias(right))


def ranked(backends: DataFrame, keys: Sequence[str] = (), queue: str = "queue", up: str = "up", pos: str = "pos") -> DataFrame:
    """Those that are up, by queue in threes, then by place in the list."""
    by = Window.partitionBy(*keys).orderBy(F.floor(F.coalesce(F.col(queue), F.lit(0)) / 3), F.col(pos))
    return backends.where(up).withColumn("rank", F.row_number().over(by))


def health(backends: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """whether any is up, and the one that ranks first (one ranking for all uses)."""
    first = F.min(F.when(F.col("up"), F.struct(F.floor(F.coalesce("queue", F.lit(0)) / 3).alias("load"), "pos", "host")))
    return backends.groupBy(*keys).agg(F.bool_or("up").alias("ok"), first["host"].alias("primary"))


def resolved_model(want: Column, have: Column) -> Column:
    """The wanted model if known or nothing is known of the backend, else "general", else its first."""
    known = have.isNull() | (F.size(have) <= 0) | F.array_contains(have, want)
    return F.when(known, want).when(F.array_contains(have, F.lit("general")), "general").otherwise(F.get(have, F.lit(0)))


def routed_model(model: Column, natural: Column) -> Column:
    """From 0.35 on, general and natural use the blend; below, natural is general."""
    return F.when(model.isin("general", "natural") & (natural >= 0.35), "natural").when(model == "natural", "general").otherwise(model)


def failover(attempts: DataFrame, key: str = "request_id", result: str = "result") -> DataFrame:
    """The result of the best-ranked attempt that succeeded; else the last error."""
    return attempts.groupBy(key).agg(
        F.min_by(result, F.when(F.col("ok"), F.col("rank"))).alias(result), F.min(F.when(F.col("ok"), F.col("rank"))).alias("rank"),
        F.when(~F.bool_or("ok"), F.max_by("error", F.when(~F.col("ok"), F.col("rank")))).alias("error"),
    )


def with_fallback(jobs: DataFrame, attempts: DataFrame, key: str = "job_id", tries: int = 2) -> DataFrame:
    """Where each job runs in the end: a cloud job (but a fast one) stays there if one of its first tries succeeded, else it goes on as a hybrid one."""
    done = attempts.where(F.col("ok") & (F.col("rank") <= tries)).select(key).distinct().withColumn("_done", F.lit(True))
    runs = F.when(F.col("compute") != "CLOUD", F.col("compute")).when((F.col("preset") != "FAST") & F.col("_done").isNotNull(), "CLOUD").otherwise("HYBRID")
    return jobs.join(done, key, "left").withColumn("runs", runs).drop("_done")


def kicked(sessions: DataFrame, kick_before: Column | int) -> DataFrame:
    """Sessions that must exit."""
    return sessions.where(F.col("session_start") < kick_before)


def liveness(mine: DataFrame, live: DataFrame, limit_s: int = 42_000) -> DataFrame:
    """What each session does next: exit before a newer live one or after the limit, register if absent, else stay.

    mine: host, session_start, age_s; live: host, session_start.
    """
    newest = live.agg(F.max("session_start").alias("newest"))
    known = live.select("host").distinct().withColumn("present", F.lit(True))
    rows = mine.join(known, "host", "left").join(F.broadcast(newest))  # one row
    action = F.when((F.col("newest") > F.col("session_start")) | (F.col("age_s") >= limit_s), "EXIT").when(F.col("present").isNull(), "REGISTER").otherwise("STAY")
    return rows.select(*mine.columns, action.alias("action"))


def failure_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Consecutive failures up to each row; a success sets it to 0."""
    sofar = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_good", F.sum(F.when(failed, 0).otherwise(1)).over(sofar))
    inner = Window.partitionBy(*keys, "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("failures", F.sum(F.when(failed, 1).otherwise(0)).over(inner)).drop("_good")


# ---- jobs, history, sources ----

ACTIONS = {"ENQUEUE": "WAITING", "START": "RUNNING", "DONE": "DONE", "FAIL": "FAILED", "CANCEL": "CANCELLED"}


def queue_state(events: DataFrame) -> DataFrame:
    """Each job's status from its log (seq, job_id, action); removed jobs are gone.

    CANCEL_ALL (job_id null) cancels what was waiting or running before it; only
    waiting jobs can be removed.
    """
    all_at = events.where("action = 'CANCEL_ALL'").agg(F.max("seq").alias("all_at"))
    own = events.where("action <> 'CANCEL_ALL' and job_id is not null")
    last = own.where(F.col("action").isin(*ACTIONS)).groupBy("job_id").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    after = own.where("action = 'REMOVE'").select("job_id", F.col("seq").alias("at")).join(last.select("job_id", "seq"), "job_id").where("at > seq")
    removed = after.groupBy("job_id").agg(F.min("at").alias("removed_at"))
    pairs = [F.lit(x) for kv in ACTIONS.items() for x in kv]
    rows = last.join(removed, "job_id", "left").join(F.broadcast(all_at)).withColumn("status", F.create_map(*pairs)[F.col("action")])  # one row
    stopped_at = F.when(F.col("status").isin("WAITING", "RUNNING") & (F.col("all_at") > F.col("seq")), F.col("all_at"))
    gone = (F.col("status") == "WAITING") & F.col("removed_at").isNotNull() & (stopped_at.isNull() | (F.col("removed_at") < stopped_at))
    return rows.where(~gone).select("job_id", F.when(stopped_at.isNotNull(), "CANCELLED").otherwise(F.col("status")).alias("status"))


def paused(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether each queue stands still: the last command said so; a job's start or end takes it back."""
    last = events.where(F.col("action").isin("PAUSE", "RESUME", "START", "DONE", "FAIL", "CANCEL", "CANCEL_ALL"))
    return last.groupBy(*keys).agg((F.max_by("action", "seq") == "PAUSE").alias("paused"))


def with_status(state: DataFrame, *status: str) -> DataFrame:
    """D6."""
    return state.where(F.col("status").isin(*status))


def finished_cleared(state: DataFrame) -> DataFrame:
    """L2: what stays when finished jobs are cleared."""
    return with_status(state, "WAITING", "RUNNING")


def queue_counts(state: DataFrame) -> DataFrame:
    """F12."""
    return state.groupBy("status").agg(F.count("*").alias("n"))


def next_job(state: DataFrame) -> DataFrame:
    """H4: the first that waits."""
    return state.where("status = 'WAITING'").orderBy("job_id").limit(1)


def newest(history: DataFrame, order: Sequence[Column], n: int = HISTORY) -> DataFrame:
    """A top-n by a bounded heap in each task."""
    return history.orderBy(*order).limit(n)


#: The fields of a stored entry and the columns that they hold.
STORED = {"uri": "uri", "name": "name", "res": "res", "el": "elapsed_s", "size": "size_bytes", "ts": "ts_ms", "preset": "preset", "model": "model"}
STORED_TYPES = "uri string, name string, res string, el bigint, size bigint, ts bigint, preset string, model string"


def history_json(history: DataFrame) -> DataFrame:
    """One JSON text of the newest entries, newest first (ties by uri), as it is stored; nulls are left out."""
    rows = newest(history, [F.desc("ts_ms"), F.col("uri")])
    entry = F.struct(*[F.col(c).alias(k) for k, c in STORED.items() if c in history.columns])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("ts_ms")).alias("at"), "uri", entry.alias("entry"))))
    return rows.agg(F.to_json(F.transform(ordered, lambda e: e["entry"])).alias("json"))


def after_clear(history: DataFrame, clears: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The entries of each key newer than its last clear."""
    last = clears.groupBy(*keys).agg(F.max(at).alias("_cleared"))
    return history.join(last, list(keys), "left").where(F.col("_cleared").isNull() | (F.col(at) > F.col("_cleared"))).drop("_cleared")


def without_stale(history: DataFrame, there: DataFrame, key: str = "uri") -> DataFrame:
    """The entries whose file is still there."""
    return history.join(there.select(key).distinct(), key, "left_semi")


def history_rows(text: Column, schema: str) -> Column:
    """Entries of a JSON text; null or bad text gives none."""
    return F.coalesce(F.from_json(text, f"array<struct<{schema}>>"), F.array())


def added_sources(sources: DataFrame, fresh: DataFrame, key: str = "uri") -> DataFrame:
    """What is new is appended, once."""
    return sources.unionByName(fresh.dropDuplicates([key]).join(sources.select(key), key, "left_anti").select(sources.columns))


def picked_sources(sources: DataFrame, picked: DataFrame, order: Sequence[Column | str], failed: DataFrame, key: str = "uri", most: int = PICKED) -> DataFrame:
    """The first `most` of what was picked is appended, once; whatever failed its probe is taken out again."""
    return added_sources(sources, picked.orderBy(*order).limit(most), key).join(failed.select(key), key, "left_anti")


def upserted(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the updates' values where these are not null."""
    renamed = updates.select(key, *(F.col(c).alias(f"_{c}") for c in updates.columns if c != key))
    joined = rows.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c != key and c in updates.columns else F.col(c) for c in rows.columns))


def applied_analysis(settings: DataFrame, analysis: DataFrame, key: str = "video_id") -> DataFrame:
    """The recommended model unless the heavy one is chosen, and colour AUTO if suggested and off."""
    rows = settings.join(analysis.select(key, "recommended", "color_fix"), key, "left")
    model = F.when(F.col("model") == "ULTRA_PLUS", F.col("model")).otherwise(F.coalesce("recommended", "model"))
    colour = F.when(F.coalesce("color_fix", F.lit(False)) & (F.col("color") == "OFF"), "AUTO").otherwise(F.col("color"))
    return rows.withColumns({"model": model, "color": colour}).select(settings.columns)


def edited_settings(settings: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Settings (key, model, gpu, auto_model) after edits (key, model, gpu, deleted).

    A model picked by hand turns the automatic choice off; deleting the active model resets it; preview_stale
    says whether a preview made before no longer holds.
    """
    renamed = edits.select(key, F.col("model").alias("_model"), F.col("gpu").alias("_gpu"), F.col("deleted").alias("_deleted"))
    rows = settings.join(renamed, key, "left").withColumn("_before", F.struct("model", "gpu"))
    picked = F.coalesce("_model", "model")
    rows = rows.withColumns({"model": F.when(picked == F.col("_deleted"), "NATURAL").otherwise(picked), "gpu": F.coalesce("_gpu", "gpu"), "auto_model": F.col("auto_model") & F.col("_model").isNull()})
    rows = rows.withColumn("preview_stale", preview_stale(F.col("_before"), F.struct("model", "gpu")))
    return rows.drop("_model", "_gpu", "_deleted", "_before")


def preview_stale(before: Column, after: Column) -> Column:
    """A change of model or device invalidates a preview."""
    return ~(before["model"].eqNullSafe(after["model"]) & before["gpu"].eqNullSafe(after["gpu"]))


def availability(models: DataFrame, files: DataFrame) -> DataFrame:
    """One map of model to whether it is there: bundled, or a file of over a million bytes."""
    rows = models.join(files, "name", "left").withColumn("there", F.col("download_url").isNull() | (F.coalesce("size_bytes", F.lit(0)) > 1_000_000))
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "there")))).alias("available"))


def expanded_jobs(sources: DataFrame, trim: tuple[int, int], quick: bool = False) -> DataFrame:
    """A job per source; the trim holds for the first only, a quick test takes ten seconds from its start."""
    start, end = trim
    first = F.col("pos") == 0
    own_end = F.least(F.lit(start + 10_000), F.col("duration_ms")) if quick else F.lit(end)
    rows = sources.where(first) if quick else sources
    return rows.withColumns({"start_ms": F.when(first, F.lit(start)).otherwise(F.lit(0)).cast("long"), "end_ms": F.when(first, own_end).otherwise(F.lit(0)).cast("long")})


# ---- packets ----


def track_range(packets: DataFrame, start_us: int, end_us: int | None, prefix: str = "") -> DataFrame:
    """Packets of tracks with the prefix within a range, times from 0."""
    rows = packets.where(F.col("track").startswith(prefix) & (F.col("pts_us") >= start_us))
    rows = rows if end_us is None else rows.where(F.col("pts_us") <= end_us)
    return rows.withColumn("pts_us", F.col("pts_us") - start_us)


#: Tasks that the packets of one video are spread over where they meet its end.
SPREAD = 64


def interleaved(video: DataFrame, audio: DataFrame, shortest: bool = False) -> DataFrame:
    """Both tracks in order of time; with shortest, up to the end of the shorter one that has packets.

    A video's packets are spread by their times, so none of them is a single task's, however long it is.
    """
    rows = video.unionByName(audio)
    if shortest:
        ends = rows.groupBy("video_id", "track").agg(F.max("pts_us").alias("end")).groupBy("video_id").agg(F.min("end").alias("end"))
        spread = F.pmod(F.xxhash64("pts_us"), F.lit(SPREAD))
        copies = ends.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
        rows = rows.withColumn("_part", spread).join(copies, ["video_id", "_part"]).where("pts_us <= end").drop("end", "_part")
    return rows.orderBy("video_id", "pts_us", "track")


def mapped_tracks(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """Packets of the tracks that are taken over, with their number in the output; others fall out."""
    return packets.join(tracks.select("video_id", "track", "out_index"), ["video_id", "track"])


def round_robin(df: DataFrame, order: str, devices: int) -> DataFrame:
    """The stride that a row belongs to."""
    return df.withColumn("device", F.pmod(F.col(order), F.lit(devices)).cast("int"))
