"""Look-ups, work-lists, timelines and logs of the catalogue: filters, joins and aggregates, nothing collected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions import paths, scalars
from gritstone.functions.vectors import cosine
from gritstone.operators.dedup import live

# Image types that are compared by their hashes, and the order in which kinds are summarised.
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif")
STAGES = ("TEXT", "IMAGE", "VISUAL_DOC", "VIDEO", "AUDIO")


def file_by_path(files: DataFrame, path: str, drive: str | None = None) -> DataFrame:
    """The file at a path of a drive; without a drive any live one."""
    return files.where((F.col("path") == path) & (F.col("drive_id") == drive)) if drive else live(files).where(F.col("path") == path)


def image_files(files: DataFrame, drive: str | None = None) -> DataFrame:
    """Live files of an image type, written as it is there."""
    found = live(files).where(F.col("file_type").isin(*IMAGE_TYPES))
    return found.where(F.col("drive_id") == drive) if drive else found


def unassigned(rows: DataFrame, owner: str, least: float | None = None, confidence: str = "confidence") -> DataFrame:
    """Detections without an owner, with at least the given confidence."""
    found = rows.where(F.col(owner).isNull())
    return found if least is None else found.where(F.col(confidence) >= least)


def unassigned_under(faces: DataFrame, files: DataFrame, folder: str, least: float | None = None) -> DataFrame:
    """Unassigned faces of the files below a folder."""
    inside = files.where(paths.under("path", folder)).select(F.col("id").alias("file_id"))
    return unassigned(faces, "person_id", least).join(inside, "file_id", "left_semi")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key is among ids (a table with that key)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def protected(path: str | Column, folders: tuple[str, ...]) -> Column:
    """path begins with one of the folders, whatever the case."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F.lit(False)
    for f in folders:
        out = out | low.startswith(f.lower())
    return out


def tail_matches(path: str | Column, pattern: str) -> Column:
    """As many last segments of path as the pattern has match it one by one; * and ? stay within a segment."""
    c = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    segment = lambda s: "".join("[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in s)
    return c.rlike("(?s)(^|/)" + "/".join(segment(s) for s in pattern.replace("\\", "/").strip("/").split("/")) + "$")


def tracked(files: DataFrame, most_bytes: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files no larger than most_bytes that match some include pattern (if there are any) and no exclude pattern."""
    keep = F.col("size") <= most_bytes
    if include:
        keep = keep & F.greatest(F.lit(False), *[tail_matches("path", p) for p in include])
    for p in exclude:
        keep = keep & ~tail_matches("path", p)
    return files.where(keep)


def weak_links(links: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Links whose similarity lies below ratio times the threshold that made them, weakest first; those without a threshold are left out."""
    return links.where(F.col("threshold_used").isNotNull() & (F.col("similarity") < F.col("threshold_used") * ratio)).orderBy("similarity", "id")


def pending(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches that wait for a decision, surest first."""
    found = matches.where("status = 'pending'").orderBy(F.desc("confidence"), "id")
    return found if limit is None else found.limit(limit)


def timeline(detections: DataFrame, owner: str, key: str = "id", year: str = "year") -> DataFrame:
    """(owner, year, n, ids): an owner's detections by year, ids ascending; undated ones are left out.

    The list holds one year of one owner; counts alone need no list (see ``n``).
    """
    dated = detections.where(F.col(owner).isNotNull() & F.col(year).isNotNull())
    return dated.groupBy(owner, year).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def stage_counts(detections: DataFrame, owner: str, stage: str) -> DataFrame:
    """(owner, stage, n): detections of each life stage, `unknown` for none."""
    return detections.where(F.col(owner).isNotNull()).groupBy(owner, F.coalesce(F.col(stage), F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def summary_work(files: DataFrame, summaries: DataFrame, folder: str, types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(id, kind, stage): files below a folder without a summary, by stage (text first, audio last) and id; skipped kinds have stage 5.

    limit takes the first by id before they are put in order, as the work-list does.
    """
    rows = live(files).where(paths.under("path", folder))
    if types:
        rows = rows.where(F.lower("file_type").isin(*types))
    rows = rows.join(summaries.select("id"), "id", "left_anti")
    rows = rows.orderBy("id").limit(limit) if limit is not None else rows
    kind = scalars.summary_kind(F.lower("file_type"))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("kind"))
    return rows.select("id", kind.alias("kind")).withColumn("stage", F.when(place > 0, place - 1).otherwise(len(STAGES)).cast("int")).orderBy("stage", "id")


def kind_counts(work: DataFrame) -> DataFrame:
    """(kind, files) of a work-list."""
    return work.groupBy("kind").agg(F.count("*").alias("files"))


def gallery_order(rows: DataFrame, by: str) -> DataFrame:
    """rows(face_id, photo_date, filename, similarity) in a gallery's order: date_desc, date_asc, name, similarity_desc or
    similarity_asc. A missing date comes before all others, a missing name is empty; ties by face_id."""
    keys = {
        "date_desc": F.desc_nulls_last("photo_date"),
        "date_asc": F.asc_nulls_first("photo_date"),
        "name": F.lower(F.coalesce("filename", F.lit(""))).asc(),
        "similarity_desc": F.desc_nulls_last("similarity"),
        "similarity_asc": F.asc_nulls_first("similarity"),
    }
    return rows.orderBy(keys[by], "face_id")


def assign_map(persons: DataFrame, gallery: DataFrame, reference: list[float] | None) -> DataFrame:
    """(person_id, label, score): named visible persons by their best likeness to the reference, those without one last, then by label."""
    shown = persons.where("name is not null and name <> '' and not coalesce(is_hidden, false)").select(F.col("id").alias("person_id"), "name")
    if reference is None:
        scored = shown.withColumn("score", F.lit(None).cast("double"))
    else:
        asked = F.array(*[F.lit(float(x)) for x in reference])
        best = gallery.groupBy("person_id").agg(F.max(cosine("embedding", asked)).alias("score"))
        scored = shown.join(best, "person_id", "left")
    label = F.concat(F.col("name"), F.when(F.col("score").isNull(), " (n/a)").otherwise(F.concat(F.lit(" ("), F.format_string("%.2f", "score"), F.lit(")"))))
    return scored.select("person_id", label.alias("label"), "score").orderBy(F.desc_nulls_last("score"), F.lower("label"))


def with_object(rows: DataFrame, name: str, column: str = "objects") -> DataFrame:
    """rows whose JSON list holds the name, whatever the case; text that is no list holds nothing."""
    return rows.where(F.array_contains(F.transform(scalars.string_list(F.col(column)), lambda x: F.lower(x)), name.lower()))


def corpus_documents(files: DataFrame, texts: DataFrame, summaries: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, text) of live files with an extracted text, a summary or a document summary, joined by blanks; empty ones are left out.

    folder keeps paths that begin with it (a plain prefix, whatever the case).
    """
    rows = live(files)
    if folder:
        rows = rows.where(F.lower("path").startswith(re.sub(r"[/\\]+$", "", folder).lower()))
    rows = rows.select("id").join(texts.select("id", "extracted_text"), "id", "left").join(summaries.select("id", "summary", "document_summary"), "id", "left")
    parts = ("extracted_text", "summary", "document_summary")
    rows = rows.where(F.coalesce(*parts).isNotNull())
    text = F.regexp_replace(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]), r"(?U)^\s+|\s+$", "")
    return rows.select("id", text.alias("text")).where("text <> ''")


def family_files(faces: DataFrame, members: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """(file_id): files with a face of some member of the named family group."""
    own = groups.where(F.col("name") == name).select(F.col("id").alias("group_id"))
    persons = members.join(own, "group_id", "left_semi").select("person_id").distinct()
    return faces.join(persons, "person_id", "left_semi").select("file_id").distinct()


def quarantine_stats(listing: DataFrame, root: str) -> DataFrame:
    """(day, files, bytes) of each date folder below root, and of all (day null)."""
    inside = listing.where(paths.under("path", root)).withColumn("day", F.get(F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/"), 0))
    nested = inside.where(F.substr("path", F.lit(len(root.rstrip("/")) + 2)).contains("/"))
    return nested.rollup("day").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def drive_states(drives: DataFrame) -> DataFrame:
    """drives(id, known, scanning, present, last_scan) with their status."""
    return drives.withColumn("status", scalars.drive_status(~F.col("known"), F.col("scanning"), F.col("present"), F.col("last_scan")))


def commits(log: DataFrame, snapshot: DataFrame, message: str, at: Column) -> DataFrame:
    """log with one more version of each tracked file of snapshot(path, size, content_hash) whose content differs from its last one.

    log is (commit_id, committed_at, message, path, size, content_hash); a
    commit's id is the digest of its time and message, so a rerun adds nothing new
    to tell apart.  Nothing changed means nothing is added.
    """
    last = log.groupBy("path").agg(F.max_by("content_hash", F.struct("committed_at", "commit_id")).alias("before"))
    changed = snapshot.join(last, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("before")))
    stamped = changed.select(F.sha1(F.concat_ws("|", at.cast("string"), F.lit(message))).alias("commit_id"), at.alias("committed_at"), F.lit(message).alias("message"), "path", "size", "content_hash")
    return log.unionByName(stamped)


def history(log: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Versions of a path, newest first, each with the change in size against the one before."""
    before = F.lag("size").over(Window.partitionBy("path").orderBy("committed_at", "commit_id"))
    rows = log.where(F.col("path") == path).withColumn("delta", F.col("size") - F.coalesce(before, F.lit(0))).orderBy(F.desc("committed_at"), "commit_id")
    return rows if limit is None else rows.limit(limit)


def recent_changes(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest (path, committed_at, message) over all folders."""
    return log.select("path", "committed_at", "message").orderBy(F.desc("committed_at"), "path").limit(limit)


def restored(log: DataFrame, path: str, commit_id: str, message: str, at: Column) -> DataFrame:
    """log with the path's content of a former commit as its newest version; nothing is added where there is none."""
    old = log.where((F.col("path") == path) & (F.col("commit_id") == commit_id))
    again = old.select(F.sha1(F.concat_ws("|", at.cast("string"), F.lit(message))).alias("commit_id"), at.alias("committed_at"), F.lit(message).alias("message"), "path", "size", "content_hash")
    return log.unionByName(again)


def stable(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths whose size is the same in two looks and not 0: they are written."""
    return now.select("path", "size").join(before.select("path", "size"), ["path", "size"], "left_semi").where("size > 0")


def changed_paths(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): new, modified (time or size) and removed paths between two looks."""
    both = now.select("path", F.struct("modified_s", "size").alias("a")).join(before.select("path", F.struct("modified_s", "size").alias("b")), "path", "full")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def pending_counts(waiting: DataFrame) -> DataFrame:
    """(folder, n): files that wait in each watched folder."""
    return waiting.groupBy("folder").agg(F.count("*").alias("n"))


def backlog(files: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """(stage, missing): live files that each stage's table (with id) lacks, in one pass over the files."""
    rows = live(files).select("id")
    for stage, table in done.items():
        rows = rows.join(table.select("id", F.lit(True).alias(f"has_{stage}")).distinct(), "id", "left")
    sums = rows.agg(*[F.count_if(F.col(f"has_{s}").isNull()).alias(s) for s in done])
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("missing")) for s in done])
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def edited_labels(labels: DataFrame, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> DataFrame:
    """(position, label): a label dimension with labels added at its end (once each) and others taken out; positions from 0 without gaps.

    A dimension is small by its nature: it is what a user edits by hand.
    """
    spark = labels.sparkSession
    top = labels.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("top"))
    new = spark.createDataFrame([(i + 1, x) for i, x in enumerate(dict.fromkeys(add))], "nth int, label string").join(labels.select("label"), "label", "left_anti")
    grown = labels.select("position", "label").unionByName(new.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("nth")).cast(dict(labels.dtypes)["position"]).alias("position"), "label"))
    kept = grown.where(~F.col("label").isin(*remove)) if remove else grown
    return kept.select((F.row_number().over(Window.orderBy("position")) - 1).alias("position"), "label")
