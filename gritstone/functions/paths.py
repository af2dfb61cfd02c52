"""Path expressions. Comparisons ignore ASCII case and separator kind, and a prefix ends at a separator."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(path: str | Column) -> Column:
    return F.col(path) if isinstance(path, str) else path


def normalise(path: str | Column) -> Column:
    """Forward slashes, no slash at the end; a leading double slash (network share) stays."""
    slashed = F.translate(_column(path), "\\", "/")
    share = slashed.startswith("//")
    single = F.regexp_replace(slashed, "/{2,}", "/")
    kept = F.when(share, F.concat(F.lit("/"), single)).otherwise(single)
    return F.when(F.length(kept) > 1, F.regexp_replace(kept, "/$", "")).otherwise(kept)


def is_share(path: str | Column) -> Column:
    p = _column(path)
    return p.startswith("\\\\") | p.startswith("//")


def share_parts(path: str | Column) -> Column:
    """Struct of server and share of a network path, null for others."""
    parts = F.split(F.regexp_replace(F.translate(_column(path), "\\", "/"), "^//", ""), "/")
    return F.when(is_share(path) & (F.size(parts) >= 2), F.struct(F.get(parts, 0).alias("server"), F.get(parts, 1).alias("share")))


def under(path: str | Column, root: str) -> Column:
    """path is root or lies below it."""
    p = F.lower(normalise(path))
    r = re.sub(r"/+$", "", root.replace("\\", "/").lower())
    return (p == r) | p.startswith(r + "/")


def relative(path: str | Column, root: str, fallback: str | Column) -> Column:
    """path below root, or the fallback where it lies elsewhere."""
    return F.when(under(path, root), F.expr(f"substring({path}, {len(root.rstrip('/')) + 2})")).otherwise(_column(fallback))


def direct_child(path: str | Column, folder: str) -> Column:
    return _column(path).rlike("^" + re.escape(folder.rstrip("/")) + "/[^/]*$")


def child_directories(rows: DataFrame, parent: str, path: str = "path") -> DataFrame:
    """Distinct names of the folders directly under parent."""
    name = F.regexp_extract(path, "^" + re.escape(parent.rstrip("/")) + "/([^/]+)/", 1)
    return rows.select(name.alias("name")).where("name <> ''").distinct()


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(F.translate(_column(path), "\\", "/"), "/"), -1)


def dirname(path: str | Column) -> Column:
    return F.regexp_replace(F.translate(_column(path), "\\", "/"), "/[^/]*$", "")


def extension(path: str | Column) -> Column:
    """Lower-case suffix with its dot; null without one. A leading dot starts no suffix."""
    found = F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob: * and ? cross separators, [..] are sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: str | Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    p = F.translate(_column(path), "\\", "/")
    return F.coalesce(F.greatest(F.lit(False), *[p.rlike(glob_regex(x.replace("\\", "/"))) for x in patterns]), F.lit(False))


# Names that a scan leaves out by default.
IGNORED = (
    "$RECYCLE.BIN", "System Volume Information", "Recovery", "$Recycle.Bin", "Windows", "ProgramData", "Program Files", "Program Files (x86)",
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".venv", "venv", ".env", "env", "dist", "build", "*.egg-info",
    ".idea", ".vscode", ".vs", "Thumbs.db", "desktop.ini", ".DS_Store", "*.tmp", "*.temp", "~*", "*.bak",
)


def ignored(path: str | Column, patterns: tuple[str, ...] = IGNORED) -> Column:
    """Some segment of path equals a pattern, or matches its * at either end."""
    segments = F.split(F.translate(_column(path), "\\", "/"), "/")

    def hit(s: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            if p.startswith("*"):
                found = found | s.endswith(p[1:])
            elif p.endswith("*"):
                found = found | s.startswith(p[:-1])
            else:
                found = found | (s == p)
        return found

    return F.exists(segments, hit)


def is_ignored(name: str, patterns: tuple[str, ...] = IGNORED) -> bool:
    """ignored for one name of a driver's or reader's listing."""
    return any(name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else name == p for p in patterns)


def hidden(path: str | Column) -> Column:
    return basename(path).startswith(".")
