"""Context metadata: inference from text and path, merging, and the context score.

A context is a struct (repo_id, repo_root, work_area, activity_domain, subject_tags, classification_source,
classification_evidence). Which phrases name which tags is data: pass a phrase table; the default one is neutral.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import normalize_tag
from memlake.shared import ascii_lower, let

#: Tags too common to tell contexts apart.
COMMON_TAGS = ("linear", "work-tracking", "github", "pr", "ci", "docs", "slack", "java", "codex", "claude-code")
#: A neutral phrase table: phrase and the tags it gives. Owners add their own projects.
PHRASES = (
    ("linear.app", ("linear", "work-tracking")),
    ("linear", ("linear", "work-tracking")),
    ("work tracking", ("work-tracking",)),
    ("slack", ("slack",)),
    ("github", ("github",)),
    ("pull request", ("github", "pr")),
    (" pr ", ("github", "pr")),
    (" ci ", ("ci",)),
    ("prefect", ("prefect",)),
    ("bigquery", ("bigquery",)),
    ("aws", ("aws",)),
    ("java", ("java",)),
    ("codex", ("codex",)),
    ("claude code", ("claude-code",)),
)
FIELDS = ("repo_id", "repo_root", "work_area", "activity_domain")
SCHEMA = "struct<repo_id:string,repo_root:string,work_area:string,activity_domain:string,subject_tags:array<string>,classification_source:string,classification_evidence:string>"
_NO_TAGS = "array<string>"


def high_signal(tags: Column, common=COMMON_TAGS) -> Column:
    return F.array_except(F.coalesce(tags, F.array().cast(_NO_TAGS)), F.array(*[F.lit(t) for t in common]))


def context_points(q: Column, m: Column, exclusions=()) -> Column:
    """The context score in hundredths, as an integer. exclusions: pairs of tag lists that speak against each other."""
    qt, mt = F.array_distinct(F.coalesce(q["subject_tags"], F.array().cast(_NO_TAGS))), F.array_distinct(F.coalesce(m["subject_tags"], F.array().cast(_NO_TAGS)))
    overlap = F.size(F.array_intersect(qt, mt))
    strong = F.size(F.array_intersect(high_signal(qt), mt)) > 0
    both = lambda f: q[f].isNotNull() & m[f].isNotNull()
    points = F.least(overlap * 9, F.lit(36))
    points += F.when(~both("repo_id"), 0).when(q["repo_id"] == m["repo_id"], 30).when(strong, -8).otherwise(-25)
    points += F.when(~both("work_area"), 0).when(q["work_area"] == m["work_area"], 18).when(overlap == 0, -8).otherwise(0)
    points += F.when((q["activity_domain"] == m["activity_domain"]) & (q["activity_domain"] != "code"), 6).otherwise(0)
    points += F.when((F.size(high_signal(qt)) > 0) & ~strong, -18).otherwise(0)
    for left, right in exclusions:
        against = F.arrays_overlap(qt, F.array(*map(F.lit, left))) & F.arrays_overlap(mt, F.array(*map(F.lit, right)))
        points += F.when(against, -22).otherwise(0)
    return points


def context_score(q: Column, m: Column, exclusions=()) -> Column:
    return context_points(q, m, exclusions) / 100


def normalized(c: Column) -> Column:
    """Scalars and tags normalised; empty ones are null or left out, tags each once."""
    scalar = lambda f: F.nullif(normalize_tag(c[f]), F.lit("")).alias(f)
    tags = F.array_distinct(F.filter(F.transform(F.coalesce(c["subject_tags"], F.array().cast(_NO_TAGS)), normalize_tag), lambda t: t != ""))
    keep = [c[f].alias(f) if f in ("repo_id", "repo_root") else scalar(f) for f in FIELDS]
    return F.struct(*keep, tags.alias("subject_tags"), c["classification_source"].alias("classification_source"), c["classification_evidence"].alias("classification_evidence"))


def merged(base: Column, new: Column) -> Column:
    """`new` merged into `base`: first known value of a field (a domain of `code` gives way), tags appended."""
    known = [F.coalesce(base[f], new[f]).alias(f) for f in FIELDS[:3]]
    domain = F.when(base["activity_domain"].isNull() | (base["activity_domain"] == "code"), F.coalesce(new["activity_domain"], base["activity_domain"])).otherwise(base["activity_domain"])
    tags = F.array_distinct(F.concat(F.coalesce(base["subject_tags"], F.array().cast(_NO_TAGS)), F.coalesce(new["subject_tags"], F.array().cast(_NO_TAGS))))
    joined = lambda f: F.when(base[f].eqNullSafe(new[f]), base[f]).otherwise(F.concat_ws(",", F.nullif(base[f], F.lit("")), F.nullif(new[f], F.lit(""))))
    return F.struct(*known, domain.alias("activity_domain"), tags.alias("subject_tags"), joined("classification_source").alias("classification_source"), joined("classification_evidence").alias("classification_evidence"))


def from_text(text: Column, phrases=PHRASES, repos=(), areas=()) -> Column:
    """The context that a text's phrases, GitHub addresses and development paths reveal. repos, areas: (tag, value) in order."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    slug = F.regexp_extract(low, r"github\.com/([a-z0-9._-]+)[^a-z0-9._-]([a-z0-9._-]+)", 0)
    owner = F.regexp_extract(slug, r"github\.com/([a-z0-9._-]+)", 1)
    name = F.regexp_extract(slug, r"github\.com/[a-z0-9._-]+[^a-z0-9._-]([a-z0-9._-]+)", 1)
    repo = F.when(slug != "", F.concat(owner, F.lit("/"), name))
    dev = F.regexp_extract_all(low, F.lit(r"(?:/users/[a-z0-9._-]+|~)/development/([a-z0-9._-]+)"), F.lit(1))
    none = F.array().cast(_NO_TAGS)
    found = F.concat(*[F.when(F.contains(low, F.lit(p)), F.array(*map(F.lit, tags))).otherwise(none) for p, tags in phrases], dev, F.when(repo.isNotNull(), F.array(name)).otherwise(none))

    def build(tags: Column) -> Column:
        has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
        domain = F.when(has("linear", "work-tracking") | F.contains(low, F.lit("ticket")) | F.contains(low, F.lit("milestone")), F.lit("work-tracking"))
        domain = domain.when(has("slack"), F.lit("communications")).when(has("docs") | F.contains(low, F.lit("decision doc")), F.lit("planning"))
        domain = domain.when(has("github", "ci") | F.contains(low, F.lit("repo")), F.lit("code"))
        by_tag = lambda pairs: F.coalesce(*[F.when(F.array_contains(tags, t), F.lit(v)) for t, v in pairs]) if pairs else F.lit(None).cast("string")
        evidence = F.array_join(F.slice(tags, 1, 8), ",")
        return F.struct(
            F.coalesce(repo, by_tag(repos)).alias("repo_id"), F.lit(None).cast("string").alias("repo_root"), by_tag(areas).alias("work_area"), domain.alias("activity_domain"),
            tags.alias("subject_tags"), F.lit("text").alias("classification_source"), evidence.alias("classification_evidence"),
        )

    tags = F.array_distinct(F.filter(F.transform(found, normalize_tag), lambda t: t != ""))
    return let(tags, build)


def from_path(path: Column, root: Column, repo: Column) -> Column:
    """The context of a working folder; root and repo come from a table of projects. No root, no context."""
    inside = F.when(path.startswith(root), F.regexp_replace(F.substr(path, F.length(root) + 1), "^/+", "")).otherwise(F.lit(""))
    part = F.get(F.filter(F.split(inside, "/"), lambda x: ~x.isin("", ".", "src", "lib", "crates")), F.lit(0))
    name = F.element_at(F.split(root, "/"), -1)
    tags = F.array_distinct(F.filter(F.transform(F.array_compact(F.array(name, part)), normalize_tag), lambda t: t != ""))
    none = F.lit(None).cast("string")
    known = root.isNotNull()
    return F.struct(
        F.coalesce(repo, name).alias("repo_id"), root.alias("repo_root"), F.when(known, F.nullif(normalize_tag(part), F.lit(""))).otherwise(none).alias("work_area"), F.when(known, F.lit("code")).alias("activity_domain"),
        F.when(known, tags).otherwise(F.array().cast(_NO_TAGS)).alias("subject_tags"), F.lit("path").alias("classification_source"), F.coalesce(path, F.lit("")).alias("classification_evidence"),
    )


def worktree_project(path: Column, mark: str = "-codex-worktrees") -> Column:
    """The project that an agent's worktree copies: `/a/.name-codex-worktrees/name-x/...` stands for `/a/name`; empty for other paths."""
    found = r"^(.*?)/\.([^/]+)" + mark + r"/\2-[^/]*(?:/.*)?$"
    name = F.regexp_extract(path, found, 2)
    return F.when(name == "", "").otherwise(F.concat(F.regexp_extract(path, found, 1), F.lit("/"), name))


def project_root(path: Column) -> Column:
    """A project folder from a working folder alone: the one that a worktree copies, else the folder itself."""
    return F.coalesce(F.nullif(worktree_project(path), F.lit("")), F.regexp_replace(path, "(?<=.)/+$", ""))
