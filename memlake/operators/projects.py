"""Project folders: which project a path lies in, and what paths and memories say about their context.

What one machine would look up on its disk is a table here: projects (root, remote, package, ecosystem), a row a project folder;
`remote` is the address its repository is fetched from. Each function takes a table of paths of any size. A path is expanded into
its folders once, however many rows have it, and meets the projects by an equi-join; the deepest folder that is a root counts.

Edge cases: a null path, or one that doesn't begin with `/`, lies in no project. Of rows with one root that with the largest
values counts, nulls last. Trailing slashes don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import context as cx
from memlake.shared import sized_stash, small

SCHEMA = "root string, remote string, package string, ecosystem string"
#: Columns of a project.
KNOWN = ("root", "remote", "package", "ecosystem")


def bare(path: Column) -> Column:
    """A path without trailing slashes."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def folders(path: Column) -> Column:
    """The folder itself and those above it, from the top."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(path.startswith("/") & (F.size(parts) > 0), upto).otherwise(F.array().cast("array<string>"))


def remote_slug(remote: Column) -> Column:
    """`owner/name` of a repository's address, lower-case; null for other hosts."""
    found = r"^(?:git@github\.com:|https://github\.com/|ssh://git@github\.com/)([^/]+)/([^/]+)"
    short = F.regexp_replace(F.trim(remote), r"(\.git)+$", "")
    owner, name = F.regexp_extract(short, found, 1), F.regexp_extract(short, found, 2)
    return F.when(owner != "", F.lower(F.concat_ws("/", owner, name)))


def one_each(projects: DataFrame) -> DataFrame:
    """A row for each root."""
    return projects.where("root IS NOT NULL").groupBy(bare(F.col("root")).alias("root")).agg(F.max(F.struct(*KNOWN[1:])).alias("p")).select("root", "p.*")


def located(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, root, remote, package, ecosystem): each distinct path with the deepest project folder it lies in, or nulls."""
    known, size = sized_stash(one_each(projects), "projects")
    each = paths.select("path").distinct()
    met = each.select("path", F.posexplode(folders(F.col("path"))).alias("depth", "root")).join(small(known, size), "root")
    best = met.groupBy("path").agg(F.max(F.struct("depth", *KNOWN)).alias("b")).select("path", *[F.col(f"b.{c}") for c in KNOWN])
    return each.where("path IS NOT NULL").join(best, "path", "left")


def project_ids(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_id): the project that a worktree copies if its folder is known, else the project around the path, else the path."""
    known, size = sized_stash(one_each(projects).select("root"), "roots")
    copied = cx.worktree_project(F.col("path"))
    at = located(paths, projects).select("path", "root").withColumn("copied", F.nullif(copied, F.lit("")))
    met = at.join(small(known.withColumnRenamed("root", "copied").withColumn("there", F.lit(True)), size), "copied", "left")
    return met.select("path", F.coalesce(F.when(F.col("there"), F.col("copied")), "root", bare(F.col("path"))).alias("project_id"))


def path_contexts(paths: DataFrame, projects: DataFrame, broad: tuple[str, ...] = ()) -> DataFrame:
    """(path, context) of working folders; a path in no project is its own root. `broad` folders hold many projects, so they tell nothing."""
    at = located(paths, projects)
    p = bare(F.col("path"))
    known = cx.normalized(cx.from_path(p, F.coalesce("root", p), remote_slug(F.col("remote"))))
    if not broad:
        return at.select("path", known.alias("context"))
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in cx.FIELDS], F.array().cast("array<string>").alias("subject_tags"), F.lit("broad_path").alias("classification_source"), p.alias("classification_evidence"))
    return at.select("path", F.when(p.isin(*broad), none).otherwise(known).alias("context"))


def memory_contexts(memories: DataFrame, projects: DataFrame, broad: tuple[str, ...] = (), phrases=cx.PHRASES) -> DataFrame:
    """`memories` (title, body, project_id, project_descriptor) with `context`: that of the project's folder, filled up from the text."""
    folders_, size = sized_stash(path_contexts(memories.select(F.col("project_id").alias("path")), projects, broad), "folders")
    text = cx.from_text(F.concat_ws("\n", "title", "body", F.coalesce("project_descriptor", F.lit(""))), phrases)
    of = small(folders_.select(F.col("path").alias("_path"), F.col("context").alias("_folder")), size)
    both = memories.join(of, F.col("project_id") == F.col("_path"), "left").withColumn("_text", text)
    whole = both.withColumn("_all", cx.merged(F.col("_folder"), F.col("_text"))).drop("_path", "_folder", "_text")
    return whole.withColumn("context", cx.normalized(F.col("_all"))).drop("_all")


def descriptor(path: Column, package: Column, ecosystem: Column, phrase: Column) -> Column:
    """What a project is, from local facts alone: package, folder, ecosystem and a phrase, each once."""
    base = F.coalesce(F.nullif(F.regexp_extract(bare(path), "([^/]+)$", 1), F.lit("")), F.lit("unknown-project"))
    parts = F.array(F.nullif(package, F.lit("")), base, F.nullif(ecosystem, F.lit("")), F.nullif(F.trim(phrase), F.lit("")))
    return F.array_join(F.array_distinct(F.array_compact(parts)), ", ")


def descriptors(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_descriptor) of project folders (path, phrase): only a folder that is a root itself has a package and an ecosystem."""
    known, size = sized_stash(one_each(projects), "projects")
    each = paths.groupBy("path").agg(F.max("phrase").alias("phrase")).where("path IS NOT NULL")
    at = each.join(small(known.withColumnRenamed("root", "_root"), size), bare(F.col("path")) == F.col("_root"), "left")
    return at.select("path", descriptor(F.col("path"), F.col("package"), F.col("ecosystem"), F.col("phrase")).alias("project_descriptor"))
