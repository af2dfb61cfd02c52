"""Vector search, gallery matching, density clustering, transitive matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.vectors import cosine, dot
from gritstone.operators.graph import connected_components
from gritstone.session import cut

#: Rows of a gallery side up to which it may be broadcast.
BROADCAST_ROWS = 20_000


def knn(vectors: DataFrame, query: list[float], at_least: float = 0.2, limit: int | None = None, key: str = "vec_id", column: str = "embedding", exclude=None) -> DataFrame:
    """(key, similarity) by inner product with one query vector, a literal of the plan; similarity to 9 places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, F.round(dot(column, q), 9).alias("similarity")).where(F.col("similarity") >= at_least)
    if exclude is not None:
        rows = rows.where(F.col(key) != exclude)
    return rows if limit is None else rows.orderBy(F.desc("similarity"), key).limit(limit)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def age_stage(age: Column) -> Column:
    return F.when(age < 2, "baby").when(age < 5, "toddler").when(age < 12, "child").when(age < 18, "teen").when(age.isNotNull(), "adult")


def meet(left: DataFrame, right: DataFrame, pairs, schema: str, left_rows: int = 4_096, right_rows: int = 8_192) -> DataFrame:
    """pairs(left block, right block) of every block pair, each in one task; blocks are pandas tables.

    Each side is dealt into blocks by hash of its row and sent once for each
    block of the other side, so work is even whatever the data; it is quadratic,
    as the question is.
    """
    counts = [max(1, -(-df.count() // rows)) for df, rows in ((left, left_rows), (right, right_rows))]

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
        # Columns under new ids: both sides may come from one table.
        df = df.withColumn(own, part).select(*[F.col(c).alias(c) for c in [*df.columns, own]])
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    one = dealt(left, "_i", counts[0], "_j", counts[1])
    two = dealt(right, "_j", counts[1], "_i", counts[0])
    return one.groupBy("_i", "_j").cogroup(two.groupBy("_i", "_j")).applyInPandas(pairs, schema)


def unit_rows(vectors):
    """The vectors of a pandas column as rows of unit length; rows without length are NaN, as their cosine is null."""
    import numpy as np

    x = np.stack(vectors.to_numpy()).astype(float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)


def gallery_match(faces: DataFrame, gallery: DataFrame, threshold: float = 0.85, boost: float = 0.05, report: list | None = None) -> DataFrame:
    """(face_id, person_id, score): the best person strictly above threshold.

    A pair's score is the cosine, plus ``boost`` where both are of one age stage;
    ties go to the smaller person.  See gritstone.operators.gallery for the way.
    """
    from gritstone.operators.gallery import best_person

    return best_person(faces, gallery, threshold, boost, report)


def route(matches: DataFrame, confirm: float = 0.95) -> DataFrame:
    """matches with status: confirmed from ``confirm``, pending below."""
    return matches.withColumn("status", F.when(F.col("score") >= confirm, "confirmed").otherwise("pending"))


def neighbour_pairs(rows: DataFrame, eps: float, key: str = "id", column: str = "embedding", block_rows: int = 2_048) -> DataFrame:
    """(src, dst) with src < dst whose cosine distance is at most eps, exactly.

    Rows are dealt into b blocks; a pair of blocks meets in one task, as matrix
    products.  Each row is sent to b tasks, so the work is spread evenly
    whatever the data; the number of pairs compared is quadratic, as the
    question is.
    """
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-rows.count() // block_rows))
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), part.alias("p"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("p", "k").alias("a"), F.greatest("p", "k").alias("b"), "p", "id", "v")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        out = []
        vectors = np.stack(pdf["v"].to_numpy())
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
        ids, p = pdf["id"].to_numpy(), pdf["p"].to_numpy()
        one, two = np.flatnonzero(p == a), np.flatnonzero(p == b)
        for start in range(0, len(one), 512):
            rows_ = one[start : start + 512]
            i, j = np.nonzero(1.0 - unit[rows_] @ unit[two].T <= eps + 1e-12)
            x, y = ids[rows_[i]], ids[two[j]]
            keep = x < y if a == b else x != y
            out.append(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["src", "dst"])

    return dealt.groupBy("a", "b").applyInPandas(meet, "src long, dst long")


def dbscan(rows: DataFrame, eps: float, min_samples: int, key: str = "id", column: str = "embedding", report: list | None = None) -> DataFrame:
    """(id, cluster) of core and border points; noise is left out.

    A core point has min_samples neighbours within eps (cosine distance), itself
    included.  Clusters are components of core-core links, named by their
    smallest core point; a border point joins the cluster of smallest name beside
    it.  Equal vectors are one point with a weight.  See gritstone.operators.density
    for the way; from eps 1 on, where a vector without direction has neighbours,
    all pairs are compared and stored.
    """
    from gritstone.operators import density

    return _dbscan_wide(rows, eps, min_samples, key, column) if eps >= 1 else density.clusters(rows, eps, min_samples, key, column, report)


def _dbscan_wide(rows: DataFrame, eps: float, min_samples: int, key: str, column: str) -> DataFrame:
    pairs = cut(neighbour_pairs(rows, eps, key, column))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("id")).agg((F.count("*") + 1).alias("n"))
    if min_samples <= 1:
        core = rows.select(F.col(key).cast("long").alias("id"))
    else:
        core = degree.where(F.col("n") >= min_samples).select("id")
    core = cut(core)
    linked = pairs.join(core.withColumnRenamed("id", "src"), "src").join(core.withColumnRenamed("id", "dst"), "dst").select("src", "dst")
    named = core.join(connected_components(linked).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(named.select(F.col("id").alias("src"), "cluster"), "src").join(core.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.min("cluster").alias("cluster"))
    return named.unionByName(border)


def cluster_samples(clustered: DataFrame, top: int = 5) -> DataFrame:
    """(cluster, id, rank): the top rows of each cluster by cosine to its mean, ties by id.  Rows are (cluster, id, embedding)."""
    dims = clustered.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    scored = clustered.join(centre, "cluster").withColumn("_s", F.round(cosine("embedding", "centre"), 9))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("_s"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "id", "rank")


def similar_faces(queries: DataFrame, faces: DataFrame, at_least: float = 0.4, limit: int = 10) -> DataFrame:
    """(query_id, face_id, similarity): each query's most similar other faces from at_least on, ties to the smaller id.

    queries and faces are (face_id, embedding); they meet in blocks, and each
    block pair gives at most limit rows a query.
    """
    import numpy as np
    import pandas as pd

    kind = f"query_id {dict(queries.dtypes)['face_id']}, face_id {dict(faces.dtypes)['face_id']}, similarity double"

    def near(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(f):
            f = f.sort_values("face_id", kind="stable")
            x, y, asked, ids = unit_rows(q["embedding"]), unit_rows(f["embedding"]), q["face_id"].to_numpy(), f["face_id"].to_numpy()
            for at in range(0, len(q), 256):
                score = np.round(x[at : at + 256] @ y.T, 9)
                score[(asked[at : at + 256, None] == ids[None, :]) | np.isnan(score)] = -2.0
                best = np.argsort(-score, axis=1, kind="stable")[:, :limit]
                found = np.take_along_axis(score, best, axis=1)
                keep = found >= at_least
                out.append(pd.DataFrame({"query_id": np.repeat(asked[at : at + 256], keep.sum(axis=1)), "face_id": ids[best[keep]], "similarity": found[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "face_id": [], "similarity": []})

    has = "embedding is not null and face_id is not null"
    met = meet(queries.select("face_id", "embedding").where(has), faces.select("face_id", "embedding").where(has), near, kind)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "face_id"))
    return met.withColumn("place", place).where(F.col("place") <= limit).drop("place")


# What the first, second and third hop is worth.
DECAY = {1: 1.0, 2: 0.85, 3: 0.7}


def transitive(seeds: DataFrame, links: DataFrame, persons: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, person_id, confidence, hop): best over walks from a query's similar faces along temporal links.

    seeds (query_id, face_id, similarity), links (person_id, face_a, face_b,
    similarity), persons (face_id, person_id).  The first hop is a similar face
    itself.  From a face of a person each of the person's links leads on: to its
    second face from the first one, to its first face from any other.  Every hop
    multiplies what was reached by the link's similarity and by the hop's decay, so
    a third hop has both decays.  Of each face the best walk of a length is kept;
    faces without a person lead nowhere.  Up to three hops a query meets a
    person's best links only (see _leading): all links of a person, met by every
    query that reaches it, would be the square of the tables.  That is so where
    similarities are above 0; with others all links are met.
    """
    known = persons.where("person_id is not null").distinct()
    links = cut(links)
    seeds = cut(seeds.select("query_id", "face_id", "similarity"))
    positive = links.where("not coalesce(similarity > 0, false)").isEmpty() and seeds.where("not coalesce(similarity > 0, false)").isEmpty()
    leading = cut(_leading(links, known)) if hops <= 3 and positive else links
    now = seeds.groupBy("query_id", "face_id").agg(F.max("similarity").alias("reached"))
    now = cut(now.withColumn("reached", F.col("reached") * DECAY[1]))
    found = None
    for hop in range(1, hops + 1):
        here = now.join(known, "face_id")
        scored = here.select("query_id", "person_id", F.round("reached", 9).alias("confidence"), F.lit(hop).alias("hop"))
        found = scored if found is None else found.unionByName(scored)
        if hop == hops:
            break
        # The two best faces of a person are enough: one of them is not the link's first face.
        best = here.groupBy("query_id", "person_id").agg(F.max(F.struct("reached", "face_id")).alias("one"))
        others = here.join(best, ["query_id", "person_id"]).where(F.col("face_id") != F.col("one.face_id")).groupBy("query_id", "person_id").agg(F.max("reached").alias("two"))
        at = best.join(others, ["query_id", "person_id"], "left")
        # The links back to the best face itself are met by that face: there the second best counts.
        own = at.withColumn("face_a", F.col("one.face_id")).join(links, ["person_id", "face_a"]).select(*at.columns, "face_a", "similarity")
        at = at.join(leading, "person_id").select(*at.columns, "face_a", "similarity").unionByName(own)
        step = (F.col("similarity") * DECAY.get(hop + 1, 0.5)).alias("step")
        back = at.select("query_id", F.col("face_a").alias("face_id"), F.when(F.col("one.face_id") != F.col("face_a"), F.col("one.reached")).otherwise(F.col("two")).alias("reached"), step)
        forth = here.join(links.withColumnRenamed("face_a", "face_id"), ["person_id", "face_id"]).select("query_id", F.col("face_b").alias("face_id"), "reached", step)
        moves = back.unionByName(forth).where("reached is not null")
        now = cut(moves.groupBy("query_id", "face_id").agg(F.max(F.col("reached") * F.col("step")).alias("reached")))
    best = found.groupBy("query_id", "person_id").agg(F.max(F.struct("confidence", (-F.col("hop")).alias("_h"))).alias("b"))
    return best.select("query_id", "person_id", F.col("b.confidence").alias("confidence"), (-F.col("b._h")).alias("hop"))


def _leading(links: DataFrame, known: DataFrame) -> DataFrame:
    """(person_id, face_a, similarity): the links that can lead back on a best walk of up to three hops, but for those to the face one comes from.

    What is reached from any face but face_a is one number for a query and person,
    so links differ in their similarity alone: for each person that face_a
    belongs to, the best one, the second face for the next hop, and a third, since
    one may be where the query stands.  Where the walk goes on over a link of
    face_a, the product of both similarities decides, for each person that it
    ends at: the best pairs on two faces.  Products that differ by no more than
    what rounding may turn are all kept.
    """
    back = links.groupBy("person_id", "face_a").agg(F.max("similarity").alias("similarity"))
    back = cut(back.join(known.select(F.col("face_id").alias("face_a"), F.col("person_id").alias("of")), "face_a"))
    place = F.row_number().over(Window.partitionBy("person_id", "of").orderBy(F.desc("similarity"), "face_a"))
    alone = back.withColumn("_n", place).where("_n <= 3").select("person_id", "face_a", "similarity")
    further = links.select(F.col("person_id").alias("of"), "face_a", "face_b", F.col("similarity").alias("then"))
    further = further.join(known.select(F.col("face_id").alias("face_b"), F.col("person_id").alias("to")), "face_b")
    walks = back.join(further, ["of", "face_a"]).groupBy("person_id", "of", "to", "face_a").agg(F.max("similarity").alias("similarity"), F.max("then").alias("then"))
    walks = walks.withColumn("product", F.col("similarity") * F.col("then"))
    by = ["person_id", "of", "to"]
    top = walks.groupBy(*by).agg(F.max(F.struct("product", "face_a")).alias("top"))
    second = walks.join(top, by).where(F.col("face_a") != F.col("top.face_a")).groupBy(*by).agg(F.max("product").alias("second"))
    near = walks.join(top.join(second, by, "left"), by).where(F.col("product") >= F.coalesce("second", "top.product") * (1 - 1e-12))
    # Of equal pairs of numbers two faces are enough.
    same = F.row_number().over(Window.partitionBy(*by, "similarity", "then").orderBy("face_a"))
    near = near.withColumn("_n", same).where("_n <= 2").select("person_id", "face_a", "similarity")
    return alone.unionByName(near).distinct()


def weighted_score(signals: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the signals that are there; null without any."""
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in signals), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    return F.try_divide(value, total)


def nearest_in_time(faces: DataFrame, gallery: DataFrame, thresholds) -> DataFrame:
    """(face_id, person_id, similarity, days): of each person the face nearest in time (ties: more similar), if similar enough for the gap.

    faces and gallery are (face_id, person_id, taken_h, embedding); a face meets
    every face of a stated gallery, in blocks as gallery_match does.
    """
    import numpy as np
    import pandas as pd

    kinds = f"face_id {dict(faces.dtypes)['face_id']}, person_id {dict(gallery.dtypes)['person_id']}, days long, similarity double"
    has = "embedding is not null and taken_h is not null"

    def nearest(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f) and len(g):
            g = g.sort_values("person_id", kind="stable")
            x, y = unit_rows(f["embedding"]), unit_rows(g["embedding"])
            ids, persons = f["face_id"].to_numpy(), g["person_id"].to_numpy()
            known, starts = np.unique(persons, return_index=True)
            of = np.searchsorted(known, persons)
            t, u = f["taken_h"].to_numpy(), g["taken_h"].to_numpy()
            for at in range(0, len(f), 256):
                rows = slice(at, at + 256)
                days = np.abs((t[rows, None] - u[None, :]) // 24).astype(np.int64)
                first = np.minimum.reduceat(days, starts, axis=1)
                # A cosine that is null counts below all others.
                similarity = np.nan_to_num(np.round(x[rows] @ y.T, 9), nan=-2.0)
                similarity = np.maximum.reduceat(np.where(days == first[:, of], similarity, -2.0), starts, axis=1)
                out.append(pd.DataFrame({"face_id": np.repeat(ids[rows], len(known)), "person_id": np.tile(known, len(first)), "days": first.ravel(), "similarity": similarity.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"face_id": [], "person_id": [], "days": [], "similarity": []})

    f, g = faces.select("face_id", "taken_h", "embedding").where(has), gallery.select("person_id", "taken_h", "embedding").where(has + " and person_id is not null")
    pairs = meet(f, g, nearest, kinds)
    best = pairs.groupBy("face_id", "person_id").agg(F.min(F.struct("days", (-F.col("similarity")).alias("_s"))).alias("b")).select("face_id", "person_id", (-F.col("b._s")).alias("similarity"), F.col("b.days").alias("days"))
    return best.where((F.col("similarity") >= -1.5) & (F.col("similarity") > thresholds(F.col("days"))))
