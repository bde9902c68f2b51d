import pytest
from pyspark.sql import functions as F

from memlake.functions import context as cx
from memlake.functions import text as tx
from memlake.functions import vectors as vx


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_tokens_and_jaccard(spark):
    a, b = tx.similarity_tokens(F.lit("The Spark-engine uses SPARK a")), tx.similarity_tokens(F.lit("engine room"))
    r = one(spark, F.array_sort(a), tx.jaccard(a, b), tx.jaccard(a, F.array().cast("array<string>")), tx.similarity_tokens(F.lit(None).cast("string")))
    assert r[0] == ["engine", "spark"] and r[1] == pytest.approx(1 / 3) and r[2] == 0 and r[3] == []


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("Merged pull 9031 after Lake-7 stalled.", ["pr:9031"]),
        ("QX-12, then qx-13: only capitals name a ticket", ["ticket:QX-12"]),
        ("Look into lib/Ocean/Tide.PY (twice: lib/Ocean/Tide.PY)", ["path:lib/ocean/tide.py"]),
        ("First just check, afterwards on branch: Feature/Kelp", ["tool:just", "branch:feature/kelp"]),
        ("see https://github.com/a/b/pull/77 on branch fix-me", ["pr:77", "branch:fix-me"]),
        ("UTF-8 and AB- and 4a-5", ["ticket:UTF-8", "ticket:AB-"]),
        ("pr#12 pull/13 PR: x", ["pr:12", "pr:13"]),
        ("branch -x branch ab", []),
        (None, []),
    ],
)
def test_task_keys(text, keys):
    assert tx.task_keys(text) == keys


def test_kinds(spark):
    k = lambda t, b, s="project": tx.infer_kind(*lit(t, b, s))
    r = one(spark, k("I prefer tabs", ""), k("x", "run the skill"), k("x", "blocked now"), k("x", "y"), k("x", "y", "global"), tx.normalize_kind(*lit(" task-state ", "x", "y", "project")))
    assert list(r) == ["preference", "workflow", "task_state", "project_fact", "lesson", "task_state"]


def test_keys_match_in_any_case(spark):
    q, m = F.array(*lit("ticket:QX-1", "tool:gh")), F.array(*lit("ticket:qx-1"))
    assert one(spark, tx.matched_keys(q, m))[0] == ["ticket:QX-1"]
    assert list(one(spark, tx.is_strong_key(F.lit("PR:1")), tx.is_strong_key(F.lit("tool:x")), tx.is_strong_key(F.lit("pr")))) == [True, False, False]


def test_fnv(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    for s in ("", "a", "naïve – text", "x" * 300):
        assert one(spark, tx.fnv1a(F.lit(s)))[0] == plain(s)


def test_times(spark):
    t = lambda s: tx.epoch_seconds(F.lit(s))
    r = one(spark, t("unix:12"), t("1970-01-01T00:01:00.5Z"), t("1970-01-01T00:01:00+01:00"), t("x"), tx.human_time(F.lit("unix:0")), tx.human_time(F.lit("y")))
    assert list(r) == [12, 60, None, None, "1970-01-01 00:00:00 UTC", "y"]


def test_display_status_and_idle(spark):
    d = lambda s, n: tx.display_status(F.lit(s), F.lit(n).cast("string"), 100)
    assert list(one(spark, d("queued", "unix:200"), d("queued", "unix:99"), d("queued", None), d("running", "unix:200"))) == ["scheduled", "queued", "queued", "running"]
    f = lambda n, i: tx.idle_flush(F.lit(n), 10, F.lit(i), 600)
    assert list(one(spark, f(2, 600), f(2, 599), f(10, 0), f(0, 999))) == [True, False, True, False]


def test_small_ones(spark):
    r = one(
        spark, tx.safe_session_id(F.lit("a/b c")), tx.safe_session_id(F.lit("")), tx.memory_ids_of(F.lit("x\nmemory_ids: 3, x,4\nmemory_ids: 9")), tx.percent(F.lit(0.256)),
        tx.normalize_score(F.lit("Excellent")), tx.normalize_score(F.lit("??")), tx.normalize_score(F.lit(None).cast("string")), tx.normalize_tag(F.lit(" (My_Tag)! ")),
        tx.recall_query_text(F.array(F.lit("a\n  tool output:" + "z" * 30), F.lit("b")), 40, 20), tx.json_from_prose(F.lit('sure: {"a": [1]} ok')), tx.json_from_prose(F.lit("none")),
    )
    assert list(r) == ["a_b_c", "unknown", [3, 4], "25.6%", "5", "3", "neutral", "my-tag", "a\n  tool output:zzzzzz\nb", '{"a": [1]}', None]


def test_truncation(spark):
    t = F.lit("x" * 40)
    assert list(one(spark, tx.truncated(t, 30), tx.truncated(t, 30, "marked"), tx.truncated(t, 30, "dots"), tx.truncated(F.lit("ab"), 30, "dots"))) == ["x" * 30, "x" * 15 + "[truncated]", "x" * 30 + "...", "ab"]


def test_formulation_reply():
    got = tx.parse_formulation('{"memories": [{"title": " T ", "body": "see MLP-1", "scope": "global", "task_keys": ["Pr:1", "none"]}, {"title": "", "body": "x"}]}', "p")
    assert [(d["title"], d["scope"], d["task_keys"], d["project_descriptor"]) for d in got] == [("T", "global", ["pr:1", "ticket:MLP-1"], "p")]
    assert len(tx.parse_formulation('[{"title": "a", "body": "b"}]', "p")) == 1 and len(tx.parse_formulation('{"title": "a", "body": "b"}', "p")) == 1


def test_cosine_and_codec(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    r = one(spark, vx.cosine(v(1, 0), v(1, 1)), vx.cosine(v(0, 0), v(1, 1)), vx.cosine(v(1), v(1, 1)), vx.decode_f32(vx.encode_f32(v(1, 2.5))), vx.decode_f32(F.lit(b"abc")))
    assert r[0] == pytest.approx(0.5**0.5) and r[1] is None and r[2] is None and r[3] == [1.0, 2.5] and r[4] is None


def test_search_agrees_with_columns(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, v array<float>")
    got = [(r["id"], r["rank"]) for r in vx.search(d, q, "id", "v", 5, 0.3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def _ctx(tags, repo=None, area=None, domain=None):
    s = lambda x: F.lit(x).cast("string")
    return F.struct(s(repo).alias("repo_id"), s(area).alias("work_area"), s(domain).alias("activity_domain"), F.array(*map(F.lit, tags)).cast("array<string>").alias("subject_tags"))


def test_context_points(spark):
    p = lambda a, b, ex=(): cx.context_points(a, b, ex)
    r = one(
        spark, p(_ctx(["a", "b"], "r", "w", "planning"), _ctx(["a", "b"], "r", "w", "planning")), p(_ctx(["a"], "r"), _ctx(["a"], "s")), p(_ctx(["a"], "r"), _ctx(["b"], "s")), p(_ctx([]), _ctx([])),
        p(_ctx(["a"]), _ctx(["b"]), [(["a"], ["b"])]), p(_ctx(["github"]), _ctx(["github"])),
    )
    assert list(r) == [18 + 30 + 18 + 6, 9 - 8, -25 - 18, 0, -18 - 22, 9]


def test_context_from_text_and_merge(spark):
    c = one(spark, cx.from_text(F.lit("A pull request at github.com/Ann/Tools-x for a ticket in ~/development/mine")))[0]
    assert c.repo_id == "ann/tools-x" and c.activity_domain == "work-tracking" and {"github", "pr", "mine", "tools-x"} <= set(c.subject_tags)
    base, new = cx.from_text(F.lit("github")), cx.from_text(F.lit("slack"))
    m = one(spark, cx.merged(base, new))[0]
    assert m.activity_domain == "communications" and m.subject_tags == ["github", "slack"]
    p = one(spark, cx.from_path(F.lit("/a/proj/src/core"), F.lit("/a/proj"), F.lit(None).cast("string")))[0]
    assert (p.repo_id, p.work_area, p.subject_tags) == ("proj", "core", ["proj", "core"])
