"""Text features of memories, turns and tasks as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.shared import ascii_lower, let

#: Words left out of similarity tokens.
STOP_WORDS = ("and", "are", "but", "for", "from", "has", "have", "into", "not", "the", "this", "that", "use", "uses", "with")
#: Prefixes of task keys that identify one thing.
STRONG_PREFIXES = ("app", "branch", "metric", "path", "pr", "project", "sentry", "signal", "target", "ticket", "trigger")
#: Command words that make a tool key; pass more with the `tools` parameter.
TOOLS = ("gt", "bazel", "bin/bazel", "sq", "cargo", "just", "gh")
#: Directory names that make a two-part token a path.
PATH_PARTS = (
    "app", "apps", "bin", "build", "cmd", "config", "crates", "docs", "java", "js", "kotlin",
    "lib", "packages", "py", "python", "src", "store", "test", "tests", "ts",
)
#: Words that reveal a memory's kind, by kind in the order of trial.
KIND_WORDS = (
    ("preference", ("prefer", "preference", "user correction", "user redirected", "repeatedly prefers")),
    ("workflow", ("workflow", "command", "run ", "use ", "skill")),
    ("task_state", ("pr ", "pull/", "branch", "status", "blocked")),
)
KINDS = ("preference", "lesson", "workflow", "project_fact", "task_state")
MAX_TASK_KEYS = 48


def similarity_tokens(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits, longer than one, without stop words."""
    parts = F.array_distinct(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.array_except(parts, stops), lambda t: F.length(t) > 1)


def jaccard(left: Column, right: Column) -> Column:
    """Shared by all distinct tokens of two token arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / (F.size(left) + F.size(right) - both))


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of at least three ASCII letters and digits."""
    return F.filter(F.array_distinct(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")), lambda t: F.length(t) >= 3)


def lexical_score(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query's terms that the text has."""
    n = F.size(query_terms)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_terms, text_terms)) / n)


def infer_kind(title: Column, body: Column, scope: Column) -> Column:
    """The kind that the words of title and body reveal; by scope if none does."""
    text = ascii_lower(F.concat_ws(" ", title, body))
    out = F.when(F.lit(False), F.lit(""))
    for kind, needles in KIND_WORDS:
        found = F.contains(text, F.lit(needles[0]))
        for x in needles[1:]:
            found = found | F.contains(text, F.lit(x))
        out = out.when(found, F.lit(kind))
    return out.when(scope == "project", F.lit("project_fact")).otherwise(F.lit("lesson"))


def normalize_kind(kind: Column, title: Column, body: Column, scope: Column) -> Column:
    """A known kind as it is (with a hyphen too), any other inferred."""
    k = F.replace(F.trim(kind), F.lit("-"), F.lit("_"))
    plain = F.trim(kind).isin(*KINDS, "project-fact", "task-state")
    return F.when(plain, k).otherwise(infer_kind(title, body, scope))


def matched_keys(query_keys: Column, memory_keys: Column) -> Column:
    """The query's keys, in order and each once, that the memory has in any case."""
    lower = F.transform(memory_keys, ascii_lower)
    return F.array_distinct(F.filter(query_keys, lambda k: F.array_contains(lower, ascii_lower(k))))


def is_strong_key(key: Column) -> Column:
    k = ascii_lower(key)
    return F.contains(k, F.lit(":")) & F.substring_index(k, ":", 1).isin(*STRONG_PREFIXES)


def normalize_key(key: Column) -> Column:
    k = ascii_lower(F.trim(key))
    return F.when(F.contains(k, F.lit(":")), k)


def embedding_text(title, scope, kind, project, repo, work_area, domain, tags, keys, body) -> Column:
    """The text of a memory that is embedded."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    names = ("title", "scope", "kind", "project", "repo", "work_area", "activity_domain", "subject_tags", "task_keys")
    values = (title, scope, kind, known(project), known(repo), known(work_area), known(domain), F.array_join(tags, ", "), F.array_join(keys, ", "))
    lines = [F.concat(F.lit(f"{n}: "), v) for n, v in zip(names, values, strict=True)]
    return F.concat_ws("\n", *lines, F.lit("body:"), body)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, 16 hex digits, in two 32-bit limbs so that nothing overflows."""
    octets = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    start = F.struct(F.lit(3421674724).alias("hi"), F.lit(2216829733).alias("lo"))

    def step(a: Column, o: Column) -> Column:
        x = a["lo"].bitwiseXOR(F.conv(o, 16, 10).cast("long"))
        low = x * 435
        hi = (a["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(16777215)), 8)).bitwiseAND(F.lit(4294967295))
        return F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(4294967295)).alias("lo"))

    h = F.aggregate(octets, start, step)
    return let(h, lambda x: F.lower(F.concat(F.lpad(F.hex(x["hi"]), 8, "0"), F.lpad(F.hex(x["lo"]), 8, "0"))))


def truncated(text: Column, n: int, how: str = "plain") -> Column:
    """plain: the first n. marked: if longer, n - 15 and a mark. dots: if longer, n and three dots."""
    if how == "plain":
        return F.substring(text, 1, n)
    keep, mark = (max(n - 15, 0), "[truncated]") if how == "marked" else (n, "...")
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def epoch_seconds(stamp: Column) -> Column:
    """Seconds of `unix:n` or of an ISO time that ends in Z; null for anything else."""
    unix = F.when(stamp.startswith("unix:"), F.substring(stamp, 6, 40).try_cast("long"))
    iso = F.when(stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(stamp, 1, 19), F.lit("Z")))))
    return F.coalesce(unix, iso)


def human_time(stamp: Column) -> Column:
    """`unix:n` as date and time in the session's zone; others as they are."""
    n = F.when(stamp.startswith("unix:"), F.substring(stamp, 6, 40).try_cast("long"))
    return F.coalesce(F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd HH:mm:ss z"), stamp)


def normalize_tag(tag: Column) -> Column:
    return F.replace(ascii_lower(F.regexp_replace(F.trim(tag), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")), F.lit("_"), F.lit("-"))


def safe_session_id(session: Column) -> Column:
    safe = F.regexp_replace(session, "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(safe) == 0, F.lit("unknown")).otherwise(safe)


def recall_file(session: Column) -> Column:
    return F.concat(F.lit("session-"), safe_session_id(session), F.lit(".md"))


def memory_ids_of(markdown: Column) -> Column:
    """The ids on the first `memory_ids: ` line; parts that are no number are skipped."""
    line = F.regexp_extract(markdown, r"(?m)^memory_ids: (.*)$", 1)
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


def numeric_score(score: Column) -> Column:
    return F.when(score.isin("1", "2", "3", "4", "5"), score.cast("long"))


#: What judges say for each score.
SCORE_WORDS = (
    ("5", ("5", "excellent", "useful")),
    ("4", ("4", "good")),
    ("3", ("3", "partial", "neutral")),
    ("2", ("2", "weak")),
    ("1", ("1", "irrelevant", "distracting")),
)


def normalize_score(score: Column, words=SCORE_WORDS) -> Column:
    """A judge's word as 1 to 5; an unknown word is 3, a missing one `neutral`."""
    s = ascii_lower(F.trim(score))
    out = F.when(score.isNull(), F.lit("neutral"))
    for value, names in words:
        out = out.when(s.isin(*names), F.lit(value))
    return out.otherwise(F.lit("3"))


def citation(refs: Column, session: Column, ordinal: Column) -> Column:
    """How a memory's source turns relate to a replayed turn."""
    prior = F.exists(refs, lambda r: (r["session_id"] == session) & (r["ordinal"] < ordinal))
    return F.when(F.size(refs) == 0, F.lit("none")).when(prior, F.lit("same_session_prior")).otherwise(F.lit("different_context"))


def information_score(title: Column, body: Column) -> Column:
    tokens = similarity_tokens(F.concat_ws("\n", title, body))
    return (F.size(tokens) * 8 + F.length(body)).cast("long")


def display_status(status: Column, next_run: Column, now: int) -> Column:
    """`scheduled` for a queued task with a future run time."""
    due = F.when(F.ilike(next_run, F.lit("unix:%")), F.coalesce(F.regexp_extract(F.substring(next_run, 6, 40), r"^[+-]?\d+", 0).try_cast("long"), F.lit(0)))
    return F.when((status == "queued") & (due > now), F.lit("scheduled")).otherwise(status)


def idle_flush(n: Column, threshold, idle: Column, limit) -> Column:
    return (n > 0) & ((n >= threshold) | (idle >= limit))


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def recall_query_text(texts: Column, max_chars: int = 12000, tool_chars: int = 500) -> Column:
    """Lines of the turns' texts in order, tool output cut short, the whole cut to max_chars."""
    lines = F.flatten(F.transform(texts, lambda t: F.split(t, "\n")))
    short = F.transform(lines, lambda x: F.when(F.ltrim(x).startswith("tool output:"), F.substring(x, 1, tool_chars)).otherwise(x))
    return F.substring(F.array_join(short, "\n"), 1, max_chars)


def json_from_prose(text: Column) -> Column:
    """The text itself if it is JSON, else its part from the first bracket to the last; null if none is JSON."""
    t = F.trim(text)
    obj = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    arr = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    valid = lambda x: F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), x)
    first = F.when((F.instr(t, "[") > 0) & ((F.instr(t, "{") == 0) | (F.instr(t, "[") < F.instr(t, "{"))), arr).otherwise(obj)
    return F.coalesce(valid(t), valid(first), valid(obj), valid(arr))


def project_descriptor(package: Column, folder: Column, ecosystem: Column, phrase: Column) -> Column:
    """What is known of a project, each part once: package name, folder name, ecosystem, a phrase."""
    parts = F.array_compact(F.array(package, F.element_at(F.split(folder, "/"), -1), ecosystem, phrase))
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != "")), ", ")


_EDGE = ",;\"'()[]{}<>`"
_DIGITS_ENDS = re.compile(r"^[^0-9]+|[^0-9]+$")


def _number(text: str) -> str:
    return _DIGITS_ENDS.sub("", text)


def _pr(token: str) -> str | None:
    for found in (token.rpartition("/pull/")[2] if "/pull/" in token else None, *(token[len(p):] if token.startswith(p) else None for p in ("pull/", "pr#"))):
        if found is not None:
            return f"pr:{n}" if (n := _number(found)) else None
    return None


def _path(token: str) -> str | None:
    t = token.strip(",;:\"')]}")
    if re.match("https?://", t) or "/" not in t or len(t.encode()) < 6 or not re.search("[A-Za-z0-9]", t):
        return None
    parts = t.split("/")
    shaped = re.match(r"\.{1,2}/|~?/", t) or ":" in t or "." in parts[-1] or len(parts) > 2
    if not shaped and not any(p.lower() in PATH_PARTS for p in parts):
        return None
    while t.startswith("./"):
        t = t[2:]
    return "path:" + _ascii_lower(t.rstrip("/"))


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ascii_lower(text: str) -> str:
    return text.translate(_FOLD)


def task_keys(text: str | None, tools: tuple = TOOLS) -> list[str]:
    """Keys that name the task a text is about: pull requests, tickets, paths, branches, tools. For one text; task_keys_of() is for columns."""
    raw = (text or "").split()
    words = [w.strip(_EDGE) for w in raw]
    keys: dict[str, None] = {}
    for i, word in enumerate(words):
        low = _ascii_lower(word)
        following = words[i + 1] if i + 1 < len(words) else None
        found = [_pr(low)]
        if low in _PULL_WORDS and following is not None:
            found.append(f"pr:{n}" if (n := _number(following)) else None)
        core = re.sub(r"^[^A-Za-z0-9-]+|[^A-Za-z0-9-]+$", "", word)
        if m := re.fullmatch(r"([A-Z0-9]{2,})-([0-9]*)", core):
            found.append(f"ticket:{m[1]}-{m[2]}")
        found.append(_path(word))
        if low in ("branch", "branch:") and following is not None and len(following.encode()) >= 3 and not following.startswith("-"):
            found.append(f"branch:{_ascii_lower(following)}")
        if low in tools:
            found.append(f"tool:{low}")
        keys |= dict.fromkeys(k for k in found if k)
        if len(keys) >= MAX_TASK_KEYS:
            break
    return list(keys)


#: What parts tokens, as Python's split() has it.
_GAPS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


#: Words before the number of a pull request.
_PULL_WORDS = ("pr", "pull", "pull-request", "pull_request")


def _trimmed(token: Column, edge: str) -> Column:
    """`token` without the characters of a regex class at both ends."""
    return F.regexp_replace(token, f"^[{edge}]+|[{edge}]+$", "")


def _numbered(text: Column) -> Column:
    n = _trimmed(text, "^0-9")
    return F.when(n != "", F.concat(F.lit("pr:"), n))


def _path_key(word: Column) -> Column:
    def of(t: Column) -> Column:
        parts = F.split(t, "/")
        shaped = t.rlike(r"^(\.{1,2}/|~?/)") | t.contains(":") | F.element_at(parts, -1).contains(".") | (F.size(parts) > 2)
        named = F.exists(parts, lambda p: F.lower(p).isin(*PATH_PARTS))
        fits = ~t.rlike("^https?://") & t.contains("/") & (F.octet_length(t) >= 6) & t.rlike("[A-Za-z0-9]") & (shaped | named)
        return F.when(fits, F.concat(F.lit("path:"), ascii_lower(F.regexp_replace(F.regexp_replace(t, r"^(\./)+", ""), "/+$", ""))))

    return F.when(word.contains("/"), let(_trimmed(word, r""",;:"')\]}"""), of))


def _token_keys(word: Column, following: Column, tools: tuple) -> Column:
    """Keys of one token, which may take the next one in, in the order in which they are looked for."""

    def of(low: Column) -> Column:
        number = F.when(low.contains("/pull/"), _numbered(F.regexp_extract(low, "(?s)^.*/pull/(.*)$", 1)))
        number = number.when(low.startswith("pull/"), _numbered(F.substring(low, 6, 1 << 30))).when(low.startswith("pr#"), _numbered(F.substring(low, 4, 1 << 30)))
        after = F.when(low.isin(*_PULL_WORDS), _numbered(following))
        ticket = F.when(word.contains("-"), let(_trimmed(word, "^A-Za-z0-9-"), lambda t: F.when(t.rlike(r"^[A-Z0-9]{2,}-[0-9]*\z"), F.concat(F.lit("ticket:"), t))))
        named = low.isin("branch", "branch:") & (F.octet_length(following) >= 3) & ~following.startswith("-")
        branch = F.when(named, F.concat(F.lit("branch:"), ascii_lower(following)))
        return F.array_compact(F.array(number, after, ticket, _path_key(word), branch, F.when(low.isin(*tools), F.concat(F.lit("tool:"), low))))

    plain = (*_PULL_WORDS, "branch", "branch:", *tools)
    return F.when(word.rlike("[-/#]") | ascii_lower(word).isin(*plain), let(ascii_lower(word), of)).otherwise(F.array().cast("array<string>"))


def task_keys_of(text: Column, tools: tuple = TOOLS) -> Column:
    """task_keys() as a column: each token is read with the next one, by its index, and new keys are added until there are enough."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), _GAPS), lambda t: t != "")

    def of(words: Column) -> Column:
        found = F.transform(words, lambda w, i: _token_keys(w, F.get(words, i + 1), tools))
        return F.aggregate(found, F.array().cast("array<string>"), lambda keys, new: F.when((F.size(new) == 0) | (F.size(keys) >= MAX_TASK_KEYS), keys).otherwise(F.array_union(keys, new)))

    return let(F.transform(tokens, lambda t: _trimmed(t, r""",;"'()\[\]{}<>`""")), of)


def parse_formulation(reply: str, default_project: str, max_body: int = 12000) -> list[dict]:
    """Memory drafts of a formulation reply: a list, an object with `memories`, or one object."""
    value = json.loads(reply) if isinstance(reply, str) else reply
    rows = value if isinstance(value, list) else value.get("memories", [value]) if isinstance(value, dict) else []
    out = []
    for r in rows:
        title, body = str(r.get("title") or "").strip(), str(r.get("body") or "").strip()[:max_body]
        if not title or not body:
            continue
        given = [k for k in (_ascii_lower(str(x).strip()) for x in r.get("task_keys") or []) if ":" in k]
        keys = list(dict.fromkeys([*given, *task_keys(f"{title}\n{body}")]))
        scope = "global" if r.get("scope") == "global" else "project"
        kind = str(r.get("kind") or "").strip().replace("-", "_")
        out.append({"title": title, "body": body, "scope": scope, "kind": kind if kind in KINDS else None, "task_keys": keys, "project_descriptor": (r.get("project_descriptor") or "").strip() or default_project})
    return out
