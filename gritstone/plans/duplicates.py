"""Composed plans: every duplicate family of a catalogue, and the unified report's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators import analytics, dedup, redundancy, resolve, similar


def all_duplicates(files: DataFrame, hashes: DataFrame | None = None, most_bits: int = 6, frames: DataFrame | None = None, video_threshold: float = 0.70) -> DataFrame:
    """(match_type, group_id, id): exact groups by content, near groups of hashes (id, hash), of videos' frames (video, p, d), of documents (text)."""
    live = dedup.live(files)
    key = live.where("content_hash is not null")
    exact = key.groupBy("content_hash").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    out = key.join(exact, "content_hash").select(F.lit("exact").alias("match_type"), "group_id", "id")
    if hashes is not None:
        classes = similar.hash_classes(hashes, similar.hamming_links(hashes, most_bits))
        shared = classes.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        out = out.unionByName(classes.join(shared, "component").select(F.lit("near").alias("match_type"), F.col("component").alias("group_id"), "id"))
    from gritstone.operators.graph import connected_components

    if frames is not None:
        shown = frames.join(live.select(F.col("id").alias("video")), "video", "left_semi")
        videos = connected_components(similar.video_links(shown, video_threshold))
        out = out.unionByName(videos.select(F.lit("video").alias("match_type"), F.col("component").alias("group_id"), F.col("node").alias("id")))
    documents = similar.class_rows(*similar.document_links(live.select(F.col("id").alias("doc_id"), "text"))).where("n_links > 0")
    return out.unionByName(documents.select(F.lit("document").alias("match_type"), F.col("component").alias("group_id"), "id"))


def report(files: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Sections of the unified report."""
    return {
        "Storage by type": analytics.by_type(files).orderBy(F.desc("bytes"), "file_type").limit(20),
        "Storage by year": analytics.by_year(files).orderBy("year"),
        "Quick wins": analytics.quick_wins(files),
        "Redundancy": redundancy.totals(files),
        "Groups": analytics.status_counts(groups),
        "Largest groups": groups.orderBy(F.desc("wasted_size"), "group_id").limit(20),
    }


def clean_up(members: DataFrame, strategy: str) -> DataFrame:
    """Plan rows (kind, source_path, size) that quarantine what a strategy removes."""
    chosen = resolve.keepers(members, strategy)
    gone = chosen.where(~F.col("is_keeper") & ~F.coalesce(F.col("locked"), F.lit(False)))
    return gone.select(F.lit("quarantine").alias("kind"), F.col("path").alias("source_path"), "size")
