"""Cross-location redundancy: groups by drive count, at-risk totals, backup plans, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.paths import glob_regex, matches_any
from gritstone.operators.dedup import live

# Ends of paths that mark a project, and what is left out of its backups.
PROJECTS = {
    "Unity": (["/Assets/", "/ProjectSettings/", "/Packages/"], ["*/Library/*", "*/Temp/*", "*/Obj/*", "*/Build/*", "*/Builds/*", "*/Logs/*"]),
    "Unreal Engine": (["/Content/", "/Config/", "/Source/", "/*.uproject"], ["*/Binaries/*", "*/Intermediate/*", "*/DerivedDataCache/*", "*/Saved/*"]),
    "Android/Gradle": (["/build.gradle", "/settings.gradle", "/gradlew", "/app/src/"], ["*/.gradle/*", "*/build/*", "*/.idea/*"]),
    "Node.js": (["/package.json", "/package-lock.json", "/yarn.lock", "/pnpm-lock.yaml"], ["*/node_modules/*", "*/dist/*", "*/build/*", "*/.next/*", "*/.cache/*"]),
    ".NET": (["/*.sln", "/*.csproj", "/*.fsproj", "/*.vbproj"], ["*/bin/*", "*/obj/*", "*/.vs/*"]),
    "Python": (["/pyproject.toml", "/requirements.txt", "/setup.py", "/Pipfile"], ["*/.venv/*", "*/venv/*", "*/__pycache__/*", "*/.pytest_cache/*"]),
    "CMake/C++": (["/CMakeLists.txt"], ["*/build/*", "*/CMakeFiles/*"]),
}


def hash_groups(files: DataFrame, min_drives: int = 1, max_drives: int | None = None) -> DataFrame:
    """(content_hash, size, file_count, drive_count) of live hashed rows, by how many drives hold them."""
    found = live(files).where("content_hash is not null").groupBy("content_hash").agg(
        F.max("size").alias("size"), F.count("*").alias("file_count"), F.countDistinct("drive_id").alias("drive_count")
    )
    found = found.where(F.col("drive_count") >= min_drives)
    return found if max_drives is None else found.where(F.col("drive_count") <= max_drives)


def totals(files: DataFrame) -> DataFrame:
    """One row: live files and bytes, and those whose content is on one drive only."""
    rows = live(files)
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.countDistinct("drive_id").alias("d"))
    risk = F.col("content_hash").isNotNull() & (F.col("d") == 1)
    return groups.agg(
        F.sum("n").alias("live_files"), F.sum("b").alias("live_bytes"), F.coalesce(F.sum(F.when(risk, F.col("n"))), F.lit(0)).alias("at_risk_files"), F.sum(F.when(risk, F.col("b"))).alias("at_risk_bytes")
    )


def report(files: DataFrame) -> DataFrame:
    """Every hash group with its state: at_risk on one drive, redundant on more."""
    return hash_groups(files).withColumn("state", F.when(F.col("drive_count") <= 1, "at_risk").otherwise("redundant"))


def backup_plan(files: DataFrame, source: str, targets: list[str], exclude: list[str] | None = None, skip_present: bool = True) -> DataFrame:
    """Copies to make of a drive's live files: a row for each file and target that lacks its content.

    A file without a hash is always copied.  The target list is a literal of
    the caller's, so each file is exploded over it instead of joined.
    """
    rows = live(files).where((F.col("drive_id") == source) & ~matches_any("path", exclude or []))
    wanted = rows.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    if skip_present:
        there = live(files).where(F.col("drive_id").isin(targets) & F.col("content_hash").isNotNull()).select(F.col("drive_id").alias("target"), "content_hash").distinct()
        wanted = wanted.join(there, ["target", "content_hash"], "left_anti")
    return wanted.withColumn("dest", F.concat(F.lit("/"), "target", F.expr(f"substring(path, {len(source) + 2})")))


def exclusion_candidates(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, files, bytes) of the patterns that some row matches: one pass, an array of hits for each row."""
    hits = F.filter(F.array(*[F.when(F.translate("path", "\\", "/").rlike(glob_regex(p)), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    return files.select("size", F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def project_types(files: DataFrame, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, project, markers, suggested): project types with some marker among the rows, the markers found (sorted), and
    what the type suggests leaving out.  A marker is the end of a path, whatever its case."""
    low = F.lower(F.translate(path, "\\", "/"))
    marks = [F.when(low.rlike(glob_regex("*" + m.lower())), F.struct(F.lit(kind).alias("project"), F.lit(m).alias("marker"))) for kind, (found, _) in PROJECTS.items() for m in found]
    hits = files.select(*by, F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("hit")).select(*by, "hit.*")
    found = hits.groupBy(*by, "project").agg(F.array_sort(F.collect_set("marker")).alias("markers"))
    suggested = F.create_map(*[x for kind, (_, out) in PROJECTS.items() for x in (F.lit(kind), F.array(*map(F.lit, out)))])
    return found.withColumn("suggested", suggested[F.col("project")])


def suggested_exclusions(files: DataFrame, path: str = "path") -> DataFrame:
    """(pattern): what the project types among the rows suggest leaving out, once each."""
    return project_types(files, path).select(F.explode("suggested").alias("pattern")).distinct()


def longest_prefix(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """files with the longest root that is the path or a folder above it; rows under no root are left out.

    Every folder above a path is an equality probe, so this is a hash join, not
    a comparison of each path with each root.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    probes = files.withColumn("_probe", F.explode(above)).withColumn("_depth", F.length("_probe"))
    hits = probes.join(roots.select(F.col(root).alias("_probe")).distinct(), "_probe")
    keep = [c for c in files.columns]
    return hits.groupBy("id").agg(F.max_by(F.struct(*keep), "_depth").alias("row"), F.max_by("_probe", "_depth").alias(root)).select("row.*", root)
