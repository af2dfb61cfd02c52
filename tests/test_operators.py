"""Small tables for what the synthetic data doesn't hold."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import dates, paths, scalars
from gritstone.operators import actions, corpus, dedup, graph, match, mutation, redundancy, resolve, search, similar, timeline
from gritstone.sources import listing, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (60, 40), (50, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 3)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                parent[max(find(a), find(b))] = min(find(a), find(b))
        got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in {v for a, b in edges if a is not None and a != b for v in (a, b)}}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hamming_links_equal_brute_force(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["src"], r["dst"], r["distance"]) for r in similar.hamming_links(spark.createDataFrame(list(enumerate(signed)), "id long, hash long"), 6).collect()}
    want = {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if 0 < (a ^ b).bit_count() <= 6}
    assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_jaccard_links_equal_brute_force(spark, threshold):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(0, 10))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, grams array<string>")
    got = {(r["src"], r["dst"]) for r in similar.jaccard_links(rows, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(tuple(s), i)
    want = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if len({*a} & {*b}) >= threshold * len({*a} | {*b}) - 1e-9}
    assert got == want


def test_paths(spark):
    assert one(spark, paths.under(F.lit("D:\\FooBar\\x"), "D:\\Foo")) is False
    assert one(spark, paths.under(F.lit("d:\\foo\\x"), "D:\\Foo\\")) is True
    assert one(spark, paths.extension(F.lit("/a/.hidden"))) is None
    assert one(spark, paths.extension(F.lit("/a/b.TAR.GZ"))) == ".gz"
    assert one(spark, paths.matches_any(F.lit("a_b%c/x.tmp"), ["*%c/*.tmp"])) is True
    assert one(spark, paths.ignored(F.lit("/a/node_modules/x.js"))) is True
    assert one(spark, paths.normalise(F.lit("\\\\srv\\share\\"))) == "//srv/share"
    assert tuple(one(spark, paths.share_parts(F.lit("\\\\srv\\share\\x")))) == ("srv", "share")


def test_scalars(spark):
    assert one(spark, scalars.format_size(F.lit(None).cast("long"))) == "N/A"
    assert one(spark, scalars.format_size(F.lit(3 << 30))) == "3.00 GB"
    assert one(spark, scalars.usage_percent(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, scalars.string_list(F.lit("not json"))) == []
    assert one(spark, scalars.orientation_code(F.lit("6 (rotated)"))) == 6
    assert one(spark, dates.parse(F.lit("2022:08:09 10:11:12"))).year == 2022
    assert one(spark, dates.parse(F.lit("yesterday"))) is None
    assert one(spark, dates.day_gap(F.lit(-12 * 3_600_000_000), F.lit(0))) == 1
    name = dates.filename("{date}_{location}_{seq}", F.lit("/a/IMG.JPG"), F.lit("2020-01-02 03:04:05").cast("timestamp"), F.lit(7), F.lit(None).cast("string"))
    assert one(spark, name) == "2020-01-02_007.jpg"


def test_islands_join_at_exactly_the_gap(spark):
    rows = spark.createDataFrame([(1, 0), (2, 2), (3, 4), (4, 7), (5, None)], "id long, t long").withColumn("k", F.lit(1))
    assert [(r["first"], r["n"]) for r in timeline.sessions(rows, ["k"], "t", 2, "id").orderBy("first").collect()] == [(0, 3), (7, 1)]


def test_keepers_with_nulls_ties_and_locks(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, None, "/a/b", "x", ".jpg", True), (1, 2, 5, 10, "/a", "y", ".cr2", False), (2, 3, 9, None, "/c", "x", None, False), (3, 4, 1, 1, "/d", "x", None, True), (3, 5, 2, 2, "/e", "y", None, True)],
        "group_id long, id long, size long, modified_s long, path string, drive_id string, file_type string, locked boolean",
    )
    keep = lambda s, **k: {r["group_id"]: r["id"] for r in resolve.keepers(rows, s, **k).where("is_keeper").collect()}
    assert keep("keep_newest")[1] == 2 and keep("keep_oldest")[1] == 2 and keep("keep_largest")[1] == 1
    assert keep("keep_best_format")[1] == 2 and keep("keep_on_drive", drive="y")[1] == 2 and keep("manual") == {}
    assert [(r["group_id"], r["removed"]) for r in resolve.resolutions(rows, "keep_first").collect()] == [(1, 1)]
    assert resolve.resolutions(rows, "keep_newest").count() == 0
    with pytest.raises(ValueError):
        resolve.keepers(rows, "keep_random")


def test_merge_drops_hashes_only_on_change(spark):
    kind = "drive_id string, path string, size long, modified_s long, content_hash string, is_deleted boolean"
    old = spark.createDataFrame([("d", "a", 1, None, "h1", True), ("d", "b", 1, 5, "h2", False), ("d", "c", 1, 5, "h3", False)], kind)
    new = spark.createDataFrame([("d", "a", 1, None), ("d", "b", 2, 5), ("d", "n", 3, 5)], "drive_id string, path string, size long, modified_s long")
    got = {r["path"]: (r["content_hash"], r["is_deleted"], r["change"]) for r in mutation.merge_scan(old, new).collect()}
    assert got == {"a": ("h1", False, "unchanged"), "b": (None, False, "modified"), "c": ("h3", False, "unseen"), "n": (None, False, "new")}


def test_longest_prefix_and_plan(spark):
    files = spark.createDataFrame([(1, "/a/bc/x"), (2, "/a/b/x"), (3, "/z")], "id long, path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r["id"]: r["root"] for r in redundancy.longest_prefix(files, roots).collect()} == {1: "/a", 2: "/a/b"}
    marks = spark.createDataFrame([(1, "/p/pyproject.toml"), (2, "/p/x.py")], "id long, path string")
    assert [r["project"] for r in redundancy.project_types(marks).collect()] == ["Python"]


def test_actions(spark):
    plan = spark.createDataFrame([("delete", "/a", 1), ("move", "/gone", 2)], "kind string, source_path string, size long")
    catalogue = spark.createDataFrame([("/a", False)], "path string, is_deleted boolean")
    assert {r["status"] for r in actions.execute(plan, catalogue).collect()} == {"refused"}
    assert {r["source_path"]: r["status"] for r in actions.execute(plan, catalogue, True).collect()} == {"/a": "done", "/gone": "failed"}
    assert {r["kind"]: r["actions"] for r in actions.pending_summary(plan).collect()}["trash"] == 0


def test_tokens_beside_accents(spark):
    assert one(spark, corpus.tokens(F.lit("éouré naïve über plain a1 Ok"))) == ["plain", "ok"]
    assert one(spark, corpus.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 3)) == ["a b c"]
    assert one(spark, corpus.ngrams(F.array(F.lit("a")), 2)) == []


def test_search_folds_and_phrases(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "lait au cafe"), (3, None)], "doc_id long, text string")
    ix = search.index(docs)
    assert {r["doc_id"] for r in search.match_all(ix, ["cafe", "lait"]).collect()} == {1, 2}
    assert {r["doc_id"] for r in search.match_phrase(ix, ["cafe", "au"]).collect()} == {1}


def test_dbscan_border_goes_to_the_smaller_cluster(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.02]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    assert {r["id"]: r["cluster"] for r in match.dbscan(rows, 0.05, 2).collect()} == {1: 1, 2: 1}


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("x.bin", b"1" * 4096), ("a/y.bin", b"1" * 4096), ("z.txt", "h\u00e9".encode()), (".hid", b"x")):
        (tmp_path / name).write_bytes(body)
    rows = listing.listing(spark, str(tmp_path), "D1")
    assert {r["filename"] for r in rows.collect()} == {"x.bin", "y.bin", "z.txt"}
    hashed = listing.hashed(listing.contents(spark, str(tmp_path)))
    assert dedup.exact_groups(hashed).collect()[0]["file_count"] == 2
    assert hashed.select("quick_hash").distinct().count() == 2  # Spark lists no hidden files
    bad = listing.extract(rows.select("filename"), lambda r: {"n": 1 // (r["filename"] == "z.txt")}, "filename string, n long")
    assert {r["filename"]: r["error"] is None for r in bad.collect()} == {"x.bin": False, "y.bin": False, "z.txt": True}
    sinks.export_csv(rows, str(tmp_path / "out"), ["filename"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    assert "<td>z.txt</td>" in sinks.html_report("t", {"files": rows})


def test_extractors(spark):
    from gritstone.functions import dates
    from gritstone.sources import extractors

    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan"
    assert extractors.jpeg_fault(head + b"\xff\xd9") is None
    assert extractors.jpeg_fault(head) == "truncated"
    assert extractors.jpeg_fault(head + b"\xff\xd9more") == "extraneous_data"
    assert extractors.jpeg_fault(b"\xff\xd8xx\x00\x00") == "invalid_markers"
    assert extractors.jpeg_fault(b"GIF89a") == "unreadable"
    uuid = "ABCDEF01-2345-6789-ABCD-EF0123456789"
    assert extractors.content_identifier(b"x" * 50 + b"ContentIdentifier=" + uuid.lower().encode()) == uuid
    assert extractors.motion_offset(b"\xff\xd8" + b"0" * 10 + b"\x00\x00\x00\x18ftypmp42") == 12
    rows = spark.createDataFrame([(bytearray(head),), (None,)], "content binary")
    fault = extractors.bytes_column(extractors.jpeg_fault, "string")
    assert [r[0] for r in rows.select(fault("content")).collect()] == ["truncated", None]
    assert one(spark, extractors.frame_times(F.lit(9.0), 2)) == [3.0, 6.0]
    assert one(spark, extractors.interval_times(F.lit(70.0))) == [0, 30, 60]
    assert one(spark, dates.daily_time(F.lit("07:30"))) == 450 and one(spark, dates.daily_time(F.lit("7h"))) == 0
    assert one(spark, dates.commit_message(F.array(F.lit("/a/b.txt")))) == "Update b.txt"
    import numpy as np

    image = np.kron(np.random.default_rng(1).random((8, 8)) * 255, np.ones((8, 8)))
    near = image.copy()
    near[3, 3] += 5
    assert sum((a ^ b).bit_count() for a, b in zip(extractors.perceptual_hashes(image), extractors.perceptual_hashes(near), strict=True)) <= 19
    assert extractors.image_scores(np.add.outer(np.arange(64), np.arange(64)))["laplacian"] < 1e-9


def test_fragments_of_photos(spark):
    import numpy as np

    from gritstone.sources import extractors

    rng = np.random.default_rng(3)
    dark, light = rng.integers(0, 60, (20, 30, 3)), rng.integers(200, 255, (30, 20, 3))
    f = [extractors.fragment_features(x) for x in (dark, light, dark[:18], light[:, :18], light[:, :, 0], np.full((4, 4, 3), 128))]
    assert abs(extractors.fragment_similarity(f[0], f[0]) - 1) < 1e-9 and f[5]["grey"] == 100.0 and f[0]["aspect"] == 1.5
    assert extractors.fragment_similarity(f[0], f[2]) > 0.9 > 0.6 > extractors.fragment_similarity(f[0], f[1])
    assert extractors.fragment_similarity(f[1], f[4]) < 0.8 and extractors.fragment_features(np.zeros((0, 4, 3)))["aspect"] == 0.0
    rows = [(file, i * 100, *x.values()) for file in (1, 2) for i, x in enumerate(f[: 4 if file == 1 else 2])]
    frame = spark.createDataFrame(rows, "file_id long, offset long, histogram array<double>, colour array<double>, brightness double, grey double, aspect double")
    got = {(r["file_id"], r["offset"]): r["photo"] for r in extractors.fragment_photos(frame, 0.85).collect()}
    assert got == {(1, 0): 0, (1, 100): 100, (1, 200): 0, (1, 300): 100, (2, 0): 0, (2, 100): 100}
    assert extractors.fragment_photos(frame.limit(0), 0.85).count() == 0


def test_people(spark):
    from gritstone.operators import people

    links = spark.createDataFrame([(1, 1990, 1991, "auto"), (1, 1990, 1991, "break")], "person_id long, year_a int, year_b int, link string")
    assert people.year_links(links).first()["link"] == "break"
    faces = spark.createDataFrame([(1, 7, 1995, 1990, 40, [1.0]), (2, 7, 1980, 1990, 0, [1.0]), (3, None, 1980, 1990, 0, [1.0])], "face_id long, person_id long, year int, birth_year int, age int, embedding array<double>")
    assert {r["face_id"]: r["stage"] for r in people.gallery(faces).collect()} == {1: "child", 2: "adult"}
    clusters = spark.createDataFrame([(1, 1, 8, [1.0, 0.0]), (2, 2, 60, [0.0, 1.0])], "cluster long, face_id long, age int, embedding array<double>")
    person = spark.createDataFrame([("child", [1.0, 0.0])], "stage string, embedding array<double>")
    assert [(r["cluster"], r["decision"], r["score"]) for r in people.intermediate_clusters(clusters, person).collect()] == [(1, "auto", 1.02)]
    assert people.greedy_order(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "cluster long, centre array<double>")) == [1, 3, 2]
    assert one(spark, people.temporal_score(F.lit(1))) == 1.0 and abs(one(spark, people.pet_distance(F.lit(None).cast("double"), F.lit(0.5), F.lit(None).cast("double"))) - 0.5) < 1e-12


def test_terms_are_counted_in_one_shuffle_and_repeated_ids_are_one_document(spark):
    from gritstone.operators import corpus

    rows = [(1, ["b", "a", "b"]), (2, ["b"]), (3, []), (4, None), (5, ["c", "c"])]
    found = corpus.term_counts(spark.createDataFrame(rows, "doc_id long, w array<string>"), F.col("w"))
    assert {tuple(r) for r in found.collect()} == {("a", 1, 1), ("b", 3, 2), ("c", 2, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 1
    again = spark.createDataFrame([*rows, (1, ["b", "d"]), (None, ["b"])], "doc_id long, w array<string>")
    assert {tuple(r) for r in corpus.term_counts(again, F.col("w")).collect()} == {("a", 1, 1), ("b", 5, 3), ("c", 2, 1), ("d", 1, 1)}


def test_cluster_suggestions_hold_few_rows_of_a_block_at_once(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from gritstone.operators import match, people

    kept = {}
    monkeypatch.setattr(match, "meet", lambda left, right, work, schema: kept.update(work=work) or spark.createDataFrame([], schema))
    clusters = spark.createDataFrame([], "cluster long, face_id long, age int, embedding array<float>")
    people.intermediate_clusters(clusters, spark.createDataFrame([], "stage string, embedding array<float>"))
    rng = np.random.default_rng(2)
    vectors = lambda n: list(rng.normal(size=(n, 4)).astype(np.float32))
    c = pd.DataFrame({"cluster": np.arange(2_000) // 10, "age": np.where(np.arange(2_000) % 7 == 0, np.nan, 25.0), "embedding": vectors(2_000)})
    g = pd.DataFrame({"middle": [25.0, 8.0] * 1_000, "embedding": vectors(2_000)})
    c.at[5, "embedding"] = np.zeros(4, np.float32)
    tracemalloc.start()
    found = kept["work"](c, g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x, y = match.unit_rows(c["embedding"]), match.unit_rows(g["embedding"])
    want = (x @ y.T + 0.02 * (np.abs(c["age"].to_numpy()[:, None] - g["middle"].to_numpy()) < 5)).max(1)
    assert np.allclose(np.where(np.isnan(want), -np.inf, want), found["score"]) and peak < 2_000 * 2_000 * 8


def test_composite_links_meet_by_pairs_of_masks(spark):
    rows = spark.range(70).selectExpr("id", "case when id % 7 <> 0 then id * 77777777777777 end as p", "case when id % 5 <> 0 then id * 55555555555555 end as d", "case when id % 3 <> 0 then id * 33333333333333 end as a")
    plan = similar.composite_links(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(pair#") >= 7
