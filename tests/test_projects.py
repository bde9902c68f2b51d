"""Project folders: where paths lie, contexts of paths and memories, descriptors, worktrees."""

from memlake.functions import context as cx
from memlake.operators import projects as pj
from pyspark.sql import functions as F


def _projects(spark):
    rows = [
        ("/a/kelp/", "git@github.com:Sea/Kelp.git", "kelp-core", "Rust"), ("/a/kelp/vendor/crab", None, None, "Node"), ("/a/kelp/", None, "aaa", None),
        ("/b/eel", "ssh://git@github.com/sea/eel", None, None), (None, "x", None, None),
    ]
    return spark.createDataFrame(rows, pj.SCHEMA)


def _paths(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_deepest_folder_counts(spark):
    paths = ("/a/kelp", "/a/kelp/src/tide", "/a/kelp/vendor/crab/x", "/a/kelpie", "/b/eel//lib/", "a/kelp", "/", "", None, "/a/kelp")
    got = {r["path"]: r["root"] for r in pj.located(_paths(spark, *paths), _projects(spark)).collect()}
    assert got == {"/a/kelp": "/a/kelp", "/a/kelp/src/tide": "/a/kelp", "/a/kelp/vendor/crab/x": "/a/kelp/vendor/crab", "/a/kelpie": None, "/b/eel//lib/": "/b/eel", "a/kelp": None, "/": None, "": None}
    none = spark.createDataFrame([], pj.SCHEMA)
    assert pj.located(_paths(spark, "/a"), none).first()["root"] is None and pj.located(_paths(spark), _projects(spark)).isEmpty()


def test_path_contexts(spark):
    got = {r["path"]: r["context"] for r in pj.path_contexts(_paths(spark, "/a/kelp/src/Tide_Pool/x", "/c/own", "/a", "/b/eel"), _projects(spark), ("/a",)).collect()}
    c = got["/a/kelp/src/Tide_Pool/x"]
    assert (c["repo_id"], c["repo_root"], c["work_area"], c["activity_domain"], c["subject_tags"]) == ("sea/kelp", "/a/kelp", "tide-pool", "code", ["kelp", "tide-pool"])
    assert (got["/c/own"]["repo_id"], got["/c/own"]["repo_root"], got["/c/own"]["subject_tags"]) == ("own", "/c/own", ["own"])
    assert (got["/a"]["repo_root"], got["/a"]["classification_source"], got["/a"]["subject_tags"]) == (None, "broad_path", [])
    assert got["/b/eel"]["repo_id"] == "sea/eel" and got["/b/eel"]["work_area"] is None


def test_memory_contexts(spark):
    m = spark.createDataFrame([(1, "Linear issue", "see the milestone", "/a/kelp/lib/net", "kelp"), (2, "On github", "a pr", None, None)], "id long, title string, body string, project_id string, project_descriptor string")
    got = {r["id"]: r["context"] for r in pj.memory_contexts(m, _projects(spark)).collect()}
    assert (got[1]["repo_id"], got[1]["work_area"], got[1]["activity_domain"]) == ("sea/kelp", "net", "work-tracking")
    assert got[1]["subject_tags"] == ["kelp", "net", "linear", "work-tracking"] and got[1]["classification_source"] == "path,text"
    assert got[2]["repo_root"] is None and got[2]["classification_source"] == "text" and "github" in got[2]["subject_tags"]


def test_worktrees_stand_for_their_project(spark):
    paths = ("/a/.kelp-codex-worktrees/kelp-fix/src", "/z/.eel-codex-worktrees/eel-1", "/a/.kelp-codex-worktrees/other", "/b/eel/lib", "/c/x/")
    got = {r["path"]: r["project_id"] for r in pj.project_ids(_paths(spark, *paths), _projects(spark)).collect()}
    assert [got[p] for p in paths] == ["/a/kelp", "/z/.eel-codex-worktrees/eel-1", "/a/.kelp-codex-worktrees/other", "/b/eel", "/c/x"]
    alone = _paths(spark, *paths).select(cx.project_root(F.col("path")).alias("p")).collect()
    assert [r["p"] for r in alone] == ["/a/kelp", "/z/eel", "/a/.kelp-codex-worktrees/other", "/b/eel/lib", "/c/x"]


def test_descriptors(spark):
    rows = spark.createDataFrame([("/a/kelp", " tides "), ("/a/kelp/vendor/crab", None), ("/n", "n"), ("/", None), (None, "x")], "path string, phrase string")
    got = {r["path"]: r["project_descriptor"] for r in pj.descriptors(rows, _projects(spark)).collect()}
    assert got == {"/a/kelp": "kelp-core, kelp, Rust, tides", "/a/kelp/vendor/crab": "crab, Node", "/n": "n", "/": "unknown-project"}


def test_remotes(spark):
    urls = ("git@github.com:A/b.git", "https://github.com/a/b/c", "https://github.com/a", "https://example.org/a/b", None)
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(pj.remote_slug(F.col("u")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["a/b", "a/b", None, None, None]
