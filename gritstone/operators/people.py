"""Persons, pets and tags: relationships, suggestions, multi-signal matching, keyword payloads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.vectors import cosine, pearson_unit
from gritstone.operators.match import weighted_score
from gritstone.operators.timeline import year_gaps


def relationships(links: DataFrame, persons: DataFrame) -> DataFrame:
    """(person_id, other_id, other_name, kind) seen from either end; parent and child change places at the far end.

    A union of both directions: each is an equi-join, an OR would be none.
    """
    turned = F.when(F.col("kind") == "parent", "child").when(F.col("kind") == "child", "parent").otherwise(F.col("kind"))
    both = links.select(F.col("a").alias("person_id"), F.col("b").alias("other_id"), "kind").unionByName(links.select(F.col("b").alias("person_id"), F.col("a").alias("other_id"), turned.alias("kind")))
    return both.join(persons.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id").select("person_id", "other_id", "other_name", "kind")


def suggest(co: DataFrame, persons: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(person_id, other, kind) for pairs seen together at least ``least`` times and not related yet.

    Birth years within 5 suggest siblings, 18 to 45 apart parent (of the
    younger) or child, anything else other.
    """
    seen = co.where((F.col("files") >= least) & (F.col("person_id") != F.col("other")))
    either = known.select(F.col("a").alias("person_id"), F.col("b").alias("other")).unionByName(known.select(F.col("b").alias("person_id"), F.col("a").alias("other")))
    years = lambda n: persons.select(F.col("id").alias(n), F.col("birth_year").alias(f"_{n}"))
    rows = seen.join(either, ["person_id", "other"], "left_anti").join(years("person_id"), "person_id", "left").join(years("other"), "other", "left")
    gap = F.col("_other") - F.col("_person_id")
    kind = F.when(F.abs(gap) <= 5, "sibling").when(gap.between(18, 45), "parent").when(gap.between(-45, -18), "child").otherwise("other")
    return rows.select("person_id", "other", kind.alias("kind"))


def temporal_score(days: Column) -> Column:
    """How much a day distance to a pet's nearest photo counts: 1 within a day, falling piecewise to a tail."""
    return (
        F.when(days <= 1, 1.0)
        .when(days <= 7, 1.0 - 0.2 * (days - 1) / 6.0)
        .when(days <= 30, 0.8 - 0.4 * (days - 7) / 23.0)
        .when(days <= 365, 0.4 - 0.3 * (days - 30) / 335.0)
        .otherwise(F.greatest(F.lit(0.0), 0.1 - 0.1 * (days - 365) / 365.0))
    )


def pet_score(embedding: Column | None, colour: Column, breed: Column, temporal: Column) -> Column:
    """Weighted signals: with an embedding 0.5, 0.3, 0.1, 0.1; without one 0.7, 0.15, 0.15."""
    plain = 0.7 * colour + 0.15 * breed + 0.15 * temporal
    return plain if embedding is None else F.when(embedding.isNotNull(), 0.5 * embedding + 0.3 * colour + 0.1 * breed + 0.1 * temporal).otherwise(plain)


def pet_distance(embedding: Column, colour: Column, breed: Column) -> Column:
    """1 less the weighted mean of the signals that are there (0.6 or none, 0.3 or 0.8, 0.1); 1 without any."""
    colour_weight = F.when(embedding.isNotNull(), 0.3).otherwise(0.8)
    total = F.when(embedding.isNotNull(), 0.6).otherwise(0.0) + F.when(colour.isNotNull(), colour_weight).otherwise(0.0) + F.when(breed.isNotNull(), 0.1).otherwise(0.0)
    value = F.coalesce(0.6 * embedding, F.lit(0.0)) + F.coalesce(colour_weight * colour, F.lit(0.0)) + F.coalesce(0.1 * breed, F.lit(0.0))
    return 1 - F.coalesce(F.try_divide(value, total), F.lit(0.0))


def match_pets(detections: DataFrame, pets: DataFrame, above: float) -> DataFrame:
    """(id, pet_id, score): the best pet of the same species strictly above a score, ties to the smaller pet.

    detections (id, species, breed, embedding, histogram, taken_h) meet pets
    (pet_id, species, breed, embedding, histogram, taken_h) by species.
    """
    p = pets.select("species", "pet_id", F.col("breed").alias("_b"), F.col("embedding").alias("_e"), F.col("histogram").alias("_h"), F.col("taken_h").alias("_t"))
    pairs = detections.join(p, "species")
    days = F.abs(F.floor((F.col("taken_h") - F.col("_t")) / 24))
    score = pet_score(cosine("embedding", "_e"), pearson_unit("histogram", "_h"), F.when(F.col("breed") == F.col("_b"), 1.0).otherwise(0.0), temporal_score(days))
    best = pairs.withColumn("score", F.round(score, 9)).where(F.col("score") > above).groupBy("id").agg(F.max(F.struct("score", (-F.col("pet_id")).alias("_p"))).alias("x"))
    return best.select("id", (-F.col("x._p")).alias("pet_id"), F.col("x.score").alias("score"))


def bridge_gaps(assigned: DataFrame, unassigned: DataFrame, pets: DataFrame, max_gap: int = 3, above: float = 0.5) -> DataFrame:
    """(id, pet_id, score) of unassigned detections that a pet's gap takes in.

    A gap lies between two consecutive years of assigned (pet_id, year) that are
    2 to max_gap apart; a detection strictly inside one goes to the pet that is
    its best match of all pets, above the relaxed score.  unassigned has
    match_pets' columns and year, pets as there.
    """
    gaps = year_gaps(assigned, "pet_id").where(F.col("years") + 1 <= max_gap)
    inside = gaps.select(F.col("pet_id").alias("_pet"), F.explode(F.sequence("gap_start", "gap_end")).alias("year"))
    within = unassigned.join(inside.select("year").distinct(), "year", "left_semi")
    best = match_pets(within, pets, above).join(within.select("id", "year"), "id")
    return best.join(inside, (best["pet_id"] == inside["_pet"]) & (best["year"] == inside["year"])).select("id", "pet_id", "score")


def nearest_pets(detections: DataFrame, pets: DataFrame, above: float) -> DataFrame:
    """(id, pet_id): the best pet of the same species strictly above a score (to 6 places), ties to the smaller pet.

    detections (id, species, breed, taken_h, embedding) and pets (pet_id and the
    same) meet in blocks; the score is pet_score, with the cosine moved to
    0 to 1 as the colour signal.
    """
    import numpy as np
    import pandas as pd

    from gritstone.operators.match import meet, unit_rows

    def best_of(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f) and len(g):
            g = g.sort_values("pet_id", kind="stable")
            x, y = unit_rows(f["embedding"]), unit_rows(g["embedding"])
            a, b = ({c: df[c].to_numpy() for c in ("species", "breed", "taken_h")} for df in (f, g))
            ids, pet_ids = f["id"].to_numpy(), g["pet_id"].to_numpy()
            for at in range(0, len(f), 256):
                rows = slice(at, at + 256)
                days = np.abs((a["taken_h"][rows, None] - b["taken_h"][None, :]) // 24)
                near = np.interp(days, [1, 7, 30, 365, 730], [1.0, 0.8, 0.4, 0.1, 0.0])
                e = x[rows] @ y.T
                score = np.round(0.5 * e + 0.3 * (e + 1) / 2 + 0.1 * (a["breed"][rows, None] == b["breed"][None, :]) + 0.1 * near, 6)
                score[np.isnan(score) | (a["species"][rows, None] != b["species"][None, :])] = -np.inf
                best = score.argmax(axis=1)
                top = score[np.arange(len(best)), best]
                keep = top > above
                out.append(pd.DataFrame({"id": ids[rows][keep], "pet_id": pet_ids[best[keep]], "score": top[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "pet_id": [], "score": []})

    has = "embedding is not null and taken_h is not null and species is not null and breed is not null"
    found = meet(detections.select("id", "species", "breed", "taken_h", "embedding").where(has), pets.select("pet_id", "species", "breed", "taken_h", "embedding").where(has), best_of, "id long, pet_id long, score double")
    best = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("pet_id")).alias("_p"))).alias("x"))
    return best.select("id", (-F.col("x._p")).alias("pet_id"))


def payload(files: DataFrame, tags: DataFrame, faces: DataFrame, quality: DataFrame) -> DataFrame:
    """(id, keywords, rating): a file's tags and persons as keywords in order, each once; stars from the quality score."""
    tagged = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("_t"))
    seen = faces.where("person is not null").groupBy("id").agg(F.array_sort(F.collect_set("person")).alias("_p"))
    rows = files.join(tagged, "id", "left").join(seen, "id", "left").join(quality.select("id", "quality_score"), "id", "left")
    blank = F.array().cast("array<string>")
    stars = F.when(F.col("quality_score") >= 80, 5).when(F.col("quality_score") >= 60, 4).when(F.col("quality_score") >= 40, 3).when(F.col("quality_score") >= 20, 2).when(F.col("quality_score").isNotNull(), 1)
    return rows.select("id", F.array_distinct(F.concat(F.coalesce("_t", blank), F.coalesce("_p", blank))).alias("keywords"), stars.alias("rating"))


def annotations(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(face_id, file_id, name): names of faces, Unknown without one; hidden persons' faces are left out."""
    rows = faces.join(persons.select(F.col("id").alias("person_id"), "name", "is_hidden"), "person_id", "left")
    return rows.where(~F.coalesce(F.col("is_hidden"), F.lit(False))).select("face_id", "file_id", F.coalesce("name", F.lit("Unknown")).alias("name"))


def visible(persons: DataFrame, named_only: bool = False, hidden: bool = False) -> DataFrame:
    rows = persons if hidden else persons.where(~F.coalesce(F.col("is_hidden"), F.lit(False)))
    return (rows.where("name is not null and name <> ''") if named_only else rows).orderBy("name", "id")


def greedy_order(clusters: DataFrame, key: str = "cluster", column: str = "centre", most: int = 5_000) -> list:
    """Clusters from the smallest on, each followed by the nearest one left.  For a screen's worth: at most ``most`` of them."""
    import numpy as np

    rows = clusters.select(key, column).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a greedy order is for at most {most} clusters")
    if not rows:
        return []
    x = np.array([r[column] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    left, order = set(range(1, len(rows))), [0]
    while left:
        at = sorted(left)
        order.append(at[int((x[at] @ x[order[-1]]).argmax())])
        left.remove(order[-1])
    return [rows[i][key] for i in order]


def signals(embedding: Column, colour: Column, breed: Column) -> Column:
    """Weighted mean of the signals that are there."""
    return weighted_score([(embedding, 0.6), (colour, 0.3), (breed, 0.1)])


def gallery(faces: DataFrame) -> DataFrame:
    """(person_id, face_id, stage, embedding): a known face's age is the photo's year less the birth year if 0 to 120, else the estimate, else 25."""
    from gritstone.operators.match import age_stage

    by_year = F.col("year") - F.col("birth_year")
    age = F.coalesce(F.when(by_year.between(0, 120), by_year), F.nullif("age", F.lit(0)), F.lit(25))
    return faces.where("person_id is not null").select("person_id", "face_id", age_stage(age).alias("stage"), "embedding")


def year_links(links: DataFrame) -> DataFrame:
    """(person_id, year_a, year_b, link): of the links between two years the weakest (break before weak before auto before confirmed)."""
    rank = F.create_map(*[F.lit(x) for x in ("break", 0, "weak", 1, "auto", 2, "confirmed", 3)])
    return links.where("year_a <> year_b").groupBy("person_id", "year_a", "year_b").agg(F.min_by("link", rank[F.col("link")]).alias("link"))


def intermediate_clusters(clusters: DataFrame, person: DataFrame, auto: float = 0.95, suggest_from: float = 0.35) -> DataFrame:
    """(cluster, score, decision): a person's best cosine with each cluster's first ten faces, 0.02 more where the age is within 5 of the stage's middle.

    clusters (cluster, face_id, age, embedding); person (stage, embedding), one
    person's gallery.  They meet in blocks; a pair of blocks gives one row a cluster.
    """
    from gritstone.functions.scalars import mid_age
    from gritstone.operators.match import meet, unit_rows

    first = F.row_number().over(Window.partitionBy("cluster").orderBy("face_id"))
    some = clusters.withColumn("_n", first).where("_n <= 10 and embedding is not null").select("cluster", F.col("age").cast("double").alias("age"), "embedding")
    faces = person.where("embedding is not null").select(mid_age(F.col("stage")).cast("double").alias("middle"), "embedding")

    def best_of(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(g):
            return pd.DataFrame({"cluster": [], "score": []})
        age, middle = c["age"].to_numpy(float), g["middle"].to_numpy(float)
        x, y, top = unit_rows(c["embedding"]), unit_rows(g["embedding"]), np.empty(len(c))
        # Matrices of 256 rows are held at once.
        for at in range(0, len(c), 256):
            rows = slice(at, at + 256)
            score = x[rows] @ y.T
            score += 0.02 * (np.abs(age[rows, None] - middle[None]) < 5)
            np.copyto(score, -np.inf, where=np.isnan(score))
            top[rows] = score.max(axis=1)
        return pd.DataFrame({"cluster": c["cluster"], "score": top})

    best = meet(some, faces, best_of, f"cluster {dict(clusters.dtypes)['cluster']}, score double").groupBy("cluster").agg(F.round(F.max("score"), 9).alias("score"))
    return best.withColumn("decision", F.when(F.col("score") >= auto, "auto").when(F.col("score") >= suggest_from, "suggest")).where("decision is not null")


def merge_clusters(members: DataFrame, ids: list[int]) -> DataFrame:
    """Clusters in ids become the smallest of them."""
    return members.withColumn("cluster", F.when(F.col("cluster").isin(ids), F.lit(min(ids))).otherwise(F.col("cluster")))


def split_cluster(members: DataFrame, cluster: int, faces: list[int], new: int) -> DataFrame:
    """The named faces of a cluster become a new one."""
    return members.withColumn("cluster", F.when((F.col("cluster") == cluster) & F.col("face_id").isin(faces), F.lit(new)).otherwise(F.col("cluster")))
