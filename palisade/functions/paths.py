"""Path normalisation, ignore patterns and directory / extension pruning."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import SPACE_CHARS, forward_slashes, let, trim

# Directories never walked, by profile, and binary-like extensions.
CI_DIRS = (
    "node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", "vendor", ".venv",
    "venv", "__pycache__",
)
CLI_DIRS = (*CI_DIRS, "benchmark", "fixtures")
CLI_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf",
    ".zip", ".tar", ".gz", ".lock", ".map", ".exe", ".bin", ".wasm", ".node", ".dll", ".dylib",
    ".so", ".mp4", ".mp3", ".mov", ".avi", ".webm", ".pyc",
)


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(forward_slashes(path), r"^\./", "")


def clean_patterns(patterns: Iterable[str]) -> list[str]:
    cleaned = []
    for raw in patterns:
        text = raw.replace("\\", "/").removeprefix("./").strip(SPACE_CHARS)
        if text:
            cleaned.append(text)
    return cleaned


def _texts(values: Iterable[str]) -> Column:
    """A constant array as one literal, so that long lists do not grow the plan."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def is_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a (driver-side) pattern list covers the path; no join.

    ``*.ext`` tests the suffix; otherwise a trailing ``/**`` and ``/`` go and the
    rest must be the path, a leading, inner or last run of segments. Other globs
    and ``!`` are literal text.
    """
    cleaned = clean_patterns(patterns)
    suffixes = dict.fromkeys(p[1:] for p in cleaned if p.startswith("*."))
    folders = dict.fromkeys(p.removesuffix("/**").removesuffix("/") for p in cleaned)
    if not folders:
        return F.lit(False)

    def covered(norm: Column) -> Column:
        rooted = F.concat(F.lit("/"), norm, F.lit("/"))
        inner = _texts(f"/{folder}/" for folder in folders if folder)
        verdict = let(rooted, lambda r: F.exists(inner, lambda f: F.contains(r, f)))
        if suffixes:
            verdict = verdict | F.exists(_texts(suffixes), lambda s: F.endswith(norm, s))
        if "" in folders:  # a bare slash: only paths with an empty segment
            verdict = verdict | (norm == "") | F.contains(rooted, F.lit("//"))
        return verdict

    return let(normalise_path(path), covered)


FOLDER_KEY, SUFFIX_KEY = 0, 1


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(scan_id, kind, key, needle) of ``patterns(scan_id, pattern)``: what a covered path has.

    A pattern covers the paths that hold its folder as a run of segments, so they have each of
    its segments: the longest is the key and the run is the needle. ``*.ext`` covers the paths
    that end in ``.ext``, and the part of a path from a dot on is a key of the path.
    """
    clean = trim(F.regexp_replace(forward_slashes(F.col("pattern")), r"^\./", ""))
    folder = F.regexp_replace(F.regexp_replace("clean", r"/\*\*\z", ""), r"/\z", "")
    longest = F.array_max(
        F.transform(F.split("folder", "/", -1), lambda s: F.struct(F.length(s), s.alias("segment")))
    )["segment"]
    named = (
        patterns.select("scan_id", clean.alias("clean"))
        .where(F.col("clean") != "")
        .select("scan_id", "clean", folder.alias("folder"))
    )
    by_folder = F.struct(
        F.lit(FOLDER_KEY).alias("kind"), longest.alias("key"),
        F.concat(F.lit("/"), "folder", F.lit("/")).alias("needle"),
    )
    by_suffix = F.struct(
        F.lit(SUFFIX_KEY).alias("kind"), F.substr("clean", F.lit(2)).alias("key"),
        F.lit("").alias("needle"),
    )
    both = F.when(F.startswith("clean", F.lit("*.")), F.array(by_folder, by_suffix))
    return named.select("scan_id", F.inline(both.otherwise(F.array(by_folder)))).distinct()


def path_keys(files: DataFrame) -> DataFrame:
    """(scan_id, file_path, rooted, kind, key): each segment of a path, each part from a dot on."""
    parts = F.split("norm", r"\.", -1)
    dots = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(parts)),
            lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def keyed(kind: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    keys = F.concat(
        keyed(FOLDER_KEY, F.array_distinct(F.split("norm", "/", -1))), keyed(SUFFIX_KEY, dots)
    )
    named = files.select("scan_id", "file_path", normalise_path(F.col("file_path")).alias("norm"))
    return named.select(
        "scan_id", "file_path", F.concat(F.lit("/"), "norm", F.lit("/")).alias("rooted"),
        F.inline(keys),
    )


def ignored_paths(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (scan_id, file_path) that a pattern of the same scan covers.

    The test of ``is_ignored`` as an equi-join: paths meet only the patterns that share a key of
    theirs, and the rest of the test is made on those. A scan with very many files is spread by
    its keys; only paths are moved.
    """
    keys = pattern_keys(patterns)
    met = path_keys(files).join(
        keys.select(
            F.col("scan_id").alias("_scan"), F.col("kind").alias("_kind"), F.col("key").alias("_key"),
            "needle",
        ),
        (F.col("scan_id") == F.col("_scan")) & (F.col("kind") == F.col("_kind"))
        & (F.col("key") == F.col("_key")) & F.contains("rooted", F.col("needle")),
        "left_semi",
    )
    return met.select("scan_id", "file_path").distinct()


def is_pruned(path: Column, profile: str = "cli") -> Column:
    """Directory (and for ``cli`` extension) pruning done while walking a tree."""
    if profile not in ("cli", "ci"):
        raise ValueError(f"unknown profile: {profile}")
    parts = F.split(forward_slashes(path), "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named = CLI_DIRS if profile == "cli" else CI_DIRS
    pruned = F.exists(folders, lambda d: d.isin(*named) | F.startswith(d, F.lit(".")))
    if profile == "cli":
        extension = F.lower(F.regexp_extract(F.element_at(parts, -1), r"[^.](\.[^.]*)\z", 1))
        pruned = pruned | extension.isin(*CLI_EXTENSIONS)
    return pruned
