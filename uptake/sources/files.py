"""Source files: reading, root and glob selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import extension, file_name, glob_regex, has_wildcard_segment, root_regex

# File types per language and the default React ignores.
LANGUAGE_EXTENSIONS = {
    "compose": ["kt"],
    "swift": ["swift"],
    "react": ["js", "jsx", "ts", "tsx"],
}
REACT_DEFAULT_IGNORES = [
    "**/node_modules/**",
    "**/generated/**",
    "**/__generated__/**",
    "**/*.d.ts",
    "**/*.stories.{js,jsx,ts,tsx}",
    "**/*.{spec,test}.{js,jsx,ts,tsx}",
]
ROOT_NOT_FOUND = "root_not_found"
ROOT_GLOB_NOT_FOUND = "root_glob_not_found"


def spread(files: DataFrame, partitions: int) -> DataFrame:
    """Deal the rows of a text table to ``partitions`` tasks.

    A row group is read by one task and text work is heavy per row, so one
    shuffle of the raw rows pays off for tables of few, small row groups.
    """
    return files.repartition(partitions)


def is_language_file(path: Column, language: str) -> Column:
    """Does the extension belong to the language (``.d.ts`` does not)."""
    if language not in LANGUAGE_EXTENSIONS:
        return F.lit(True)
    return extension(path).isin(LANGUAGE_EXTENSIONS[language]) & ~F.endswith(path, F.lit(".d.ts"))


def select_language(files: DataFrame, language: str) -> DataFrame:
    return files.filter(is_language_file(F.col("path"), language)).withColumn("language", F.lit(language))


def read_source_files(spark: SparkSession, root: str, language: str, repo_id: str, snapshot_id: str) -> DataFrame:
    """One row per text file below ``root`` with its relative path.

    The file name filter runs while listing, before any content is read.
    """
    exts = LANGUAGE_EXTENSIONS.get(language)
    reader = spark.read.option("recursiveFileLookup", "true")
    if exts:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(exts) + "}")
    full = F.col("_metadata.file_path")
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), base, -1)
    files = reader.text(root, wholetext=True).select(rel.alias("path"), F.col("value").alias("content"))
    return select_language(files, language).select(
        F.lit(repo_id).alias("repo_id"), F.lit(snapshot_id).alias("snapshot_id"), "language", "path",
        extension(F.col("path")).alias("ext"), "content",
    )


def resolve_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Keep files below any configured root."""
    return files.filter(F.col("path").rlike("|".join(root_regex(r) for r in roots)))


def glob_filter(files: DataFrame, patterns: list[str], exclude: bool = True) -> DataFrame:
    """Keep or drop files whose whole path matches a glob."""
    if not patterns:
        return files if exclude else files.limit(0)
    hit = F.col("path").rlike("|".join(glob_regex(p) for p in patterns))
    return files.filter(~hit if exclude else hit)


def include_filter(files: DataFrame, extensions: list[str] = (), name_globs: list[str] = ()) -> DataFrame:
    """Extension (any case, optional dot) or ``*suffix`` name; none = all."""
    if not extensions and not name_globs:
        return files
    name = file_name(F.col("path"))
    hit = F.lower(extension(F.col("path"))).isin([e.removeprefix(".").lower() for e in extensions] or [None])
    hit = F.coalesce(hit & (extension(F.col("path")) != ""), F.lit(False))
    for g in name_globs:
        hit = hit | (F.endswith(name, F.lit(g[1:])) if g.startswith("*") else name == g)
    return files.filter(hit)


def default_ignores(files: DataFrame, extra: list[str] = ()) -> DataFrame:
    """React defaults, then the user's own ignores."""
    return glob_filter(files, [*REACT_DEFAULT_IGNORES, *extra])



def missing_roots(runs: DataFrame, files: DataFrame, roots: list[str], by=("repo_id", "snapshot_id", "language")) -> DataFrame:
    """A warning for each configured root that holds no file of a run.

    The roots are configuration literals; files are reduced map-side to the
    roots they belong to before the anti join.
    """
    wanted = F.array(*[
        F.struct(
            F.lit(r).alias("root"),
            F.lit(ROOT_GLOB_NOT_FOUND if has_wildcard_segment(r) else ROOT_NOT_FOUND).alias("code"),
        )
        for r in roots
    ])
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(root_regex(r)), F.lit(r)) for r in roots]))
    found = files.select(*by, F.explode(hits).alias("root")).distinct()
    return (
        runs.select(*by, F.inline(wanted)).join(found, [*by, "root"], "left_anti")
        .withColumn("severity", F.lit("warning"))
    )
