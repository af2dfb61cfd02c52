"""The best person for each face, exactly, with whole balls of the gallery left out by the triangle inequality.

The gallery is dealt to pivots, some of its own faces; a ball is what is nearest
to one pivot, with the largest angle in it as its radius.  No face of a ball is
nearer to a face asked than the angle to the pivot less the radius, and the
pivots themselves are answers already: a ball whose best possible score is below
the threshold, or below that of some pivot, is never met.  What is left is joined
by ball and compared as matrix products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import cut

#: Faces of a ball that the number of pivots aims at, pivots at most (8 MB of them at 1,024 components), and rows of either side in a task.
BALL_ROWS, PIVOTS, LEFT_ROWS, RIGHT_ROWS = 512, 1_024, 4_096, 8_192


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directed(df: DataFrame) -> DataFrame:
    """Rows whose embedding has a direction: others are alike to none."""
    return df.where("embedding is not null").where(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)


def best_person(faces: DataFrame, gallery: DataFrame, threshold: float, boost: float, report: list | None = None) -> DataFrame:
    """(face_id, person_id, score) of faces(face_id, stage, embedding) in gallery(person_id, stage, embedding): the highest score strictly above threshold.

    A score is the cosine, plus boost where both are of one stage (null is none),
    rounded to nine digits; ties go to the smaller person.  report gets (pairs
    compared, all pairs).
    """
    spark = faces.sparkSession
    kinds = f"face_id {dict(faces.dtypes)['face_id']}, person_id {dict(gallery.dtypes)['person_id']}, score double"
    known = cut(_directed(gallery.select("person_id", "stage", "embedding")))
    n = known.count()
    if not n:
        return spark.createDataFrame([], kinds)
    first = known.orderBy(F.xxhash64("person_id", "embedding"), "person_id").limit(max(1, min(PIVOTS, -(-n // BALL_ROWS)))).select("embedding").collect()
    pivots = _unit(pd.Series([np.array(r.embedding) for r in first]))

    @F.pandas_udf("ball int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        angle = np.arccos(np.clip(_unit(v) @ pivots.T, -1, 1))
        ball = angle.argmin(1)
        return pd.DataFrame({"ball": ball.astype(np.int32), "angle": angle[np.arange(len(ball)), ball]})

    placed = cut(known.withColumn("p", place("embedding")).select("person_id", "stage", "embedding", "p.ball", "p.angle"))
    stats = {r.ball: (r.n, r.radius) for r in placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    radius = np.full(len(pivots), -1.0)
    for b, (_, r) in stats.items():
        radius[b] = r
    here = radius >= 0

    @F.pandas_udf("array<int>")
    def balls(v: pd.Series) -> pd.Series:
        cosine = np.clip(_unit(v) @ pivots.T, -1, 1)
        most = np.cos(np.maximum(0, np.arccos(cosine) - radius[None] - 1e-7)) + max(boost, 0)
        wanted = (most >= np.maximum(threshold, cosine.max(1) + min(boost, 0))[:, None] - 1e-7) & here[None]
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in wanted])

    asked = cut(_directed(faces.select("face_id", "stage", "embedding")).withColumn("ball", F.explode(balls("embedding"))))
    counts = {r.ball: r["count"] for r in asked.groupBy("ball").count().collect()}
    if report is not None:
        report.append((sum(c * stats[b][0] for b, c in counts.items()), n * faces.where("embedding is not null").count()))
    tasks = [(b, -(-c // LEFT_ROWS), -(-stats[b][0] // RIGHT_ROWS)) for b, c in sorted(counts.items())]
    tasks = F.broadcast(spark.createDataFrame(tasks, "ball int, lefts int, rights int"))

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        # Columns under new ids: both sides may come from one table.
        df = df.select(*[F.col(c).alias(c) for c in df.columns])
        return df.join(tasks, "ball").withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")).withColumn(other, every).drop("lefts", "rights")

    def best(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"face_id": [], "person_id": [], "score": []})]
        if len(f) and len(g):
            g = g.sort_values("person_id", kind="stable")
            x, y, ids, persons = _unit(f["embedding"]), _unit(g["embedding"]), f["face_id"].to_numpy(), g["person_id"].to_numpy()
            names = {s: i for i, s in enumerate(sorted({*f["stage"].dropna(), *g["stage"].dropna()}))}
            s, t = f["stage"].map(names).fillna(-1).to_numpy(), g["stage"].map(names).fillna(-2).to_numpy()
            for at in range(0, len(f), 512):
                score = np.round(x[at : at + 512] @ y.T + boost * (s[at : at + 512, None] == t[None]), 9)
                top = score.argmax(1)
                value = score[np.arange(len(top)), top]
                keep = value > threshold
                out.append(pd.DataFrame({"face_id": ids[at : at + 512][keep], "person_id": persons[top[keep]], "score": value[keep]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    one = dealt(asked, "i", "j", "lefts", "rights").groupBy("ball", "i", "j")
    two = dealt(placed.drop("angle"), "j", "i", "rights", "lefts").groupBy("ball", "i", "j")
    found = one.cogroup(two).applyInPandas(best, kinds)
    top = found.groupBy("face_id").agg(F.max(F.struct("score", (-F.col("person_id")).alias("_p"))).alias("b"))
    return top.select("face_id", (-F.col("b._p")).alias("person_id"), F.col("b.score").alias("score"))
