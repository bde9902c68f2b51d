"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the grammar (s?(ua)+)?.

Turns are walked by their role initials through four states: begun, after a system turn, after a user turn, after an assistant
turn (the first and the last may end). Backward over the turns goes the cost to go from each state, inserts included; forward
goes a walk that takes, of the edits by which that cost is met, the ASCII-least (D, I, K, R), so the audit is the least of
all cheapest ones. An insert or a reroled turn has the role that its state asks for, so an audit fixes the repaired turns.

A conversation may hold a third of all rows, so it is never gathered: equal rows of a turn become one row with a count, rows are
dealt by ranges in conversation order and cut into chunks of bounded turns and bytes. A chunk of a conversation with several is a
4 by 4 min-plus matrix; from these come the costs at each chunk's end, then the state in which each chunk's walk leaves by
the state in which it begins, then every chunk's own walk. Only the hash over a conversation's text needs its chunks in
order; chunks stream by, and one is held at a time.

Edge cases: nulls of role, text, and of conv_id and turn within the key of the damage count as one space. Turns come nulls first,
rows of one turn by role and text. Empty texts are blank. Very long texts are cut off into chunks of their own. Repeated rows are
duplicates. A null conv_id is a conversation. Initials are code points; an empty role has none. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.words import SPACES
from memlake.shared import sized_stash, small, stash, table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
INF = 1 << 60
#: The state after a turn by state and initial; the role that a state asks of an insert.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ASKED = ("user", "user", "assistant", "user")
#: Cost to go behind the last turn: a state that may end costs nothing, the others what must be inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Turns, and characters of text, of one chunk at most (but for a single longer text).
CHUNK_TURNS, CHUNK_CHARS = 16_384, 2 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage, equal rows of a turn as one with their number, dropped ones with 0."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _place(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def judged(rows: DataFrame) -> DataFrame:
    """damaged() rows with `fault`, the place in FAULTS of the first of equal rows' fault; the others are duplicates unless blank."""
    rows, _ = sized_stash(rows.withColumn("h", F.sha2("text", 256)), "damaged")
    seen = rows.where("copies > 0").groupBy("conv_id", "role", "h").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    firsts = small(*sized_stash(seen.where("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "first"), "firsts"))
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", 1).when(F.coalesce(_place() > F.col("first"), F.lit(False)), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_CHUNK = "turns array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<int>"


def chunks(rows: DataFrame, most_turns: int = CHUNK_TURNS, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, chunk, and arrays of turns, roles, texts, copies and faults: pieces of conversations in order, stored."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, conv, held, chars, out = TaskContext.get().partitionId() << 33, 0, None, [], 0, []
        types = [None, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "chunk", "turns", "roles", "texts", "copies", "faults"])

        size = 0
        for b in batches:
            types[0] = b.column(0).type
            for c, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and (c != conv or len(held) >= most_turns or chars + len(row[2]) > most_chars):
                    out.append((conv, base + made, *map(list, zip(*held, strict=True))))
                    made, held, size, chars = made + 1, [], size + chars, 0
                    if len(out) >= 2000 or size > most_chars:
                        yield batch()
                        size = 0
                conv = c
                held.append(row)
                chars += len(row[2])
        if held:
            out.append((conv, base + made, *map(list, zip(*held, strict=True))))
        if out:
            yield batch()

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order, "copies", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(dealt.mapInArrow(run, f"conv_id {kind}, chunk long, {_CHUNK}"), "chunks")


def _steps(roles: list[str], copies: list[int], faults: list[int]) -> list[tuple[int, int, str, int]]:
    """(row, times, initial, extra) by decision: rows that must be deleted have no initial (None) and their times; others their extra cost."""
    out = []
    for i, (role, n, fault) in enumerate(zip(roles, copies, faults, strict=True)):
        forced = n if fault in (1, 2) else n - 1
        if n and fault not in (1, 2):
            out.append((i, 1, role[:1], CUT_OFF if fault == 3 else 0))
        if forced > 0:
            out.append((i, forced, None, 0))
    return out


def _with_inserts(v: list[int]) -> list[int]:
    """Costs by state if turns may be inserted first; from any state two inserts lead to all that inserts can reach."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[NEXT[q][ASKED[q][0]]]) for q in range(4)]
    return v


def _before(step: tuple, v: list[int]) -> list[int]:
    """Costs by state in front of a decision, given those behind it."""
    _, times, initial, extra = step
    if initial is None:
        return [min(x + DELETE * times, INF) for x in v]
    out = []
    for q in range(4):
        best = min(v[q] + DELETE, REROLE + extra + v[NEXT[q][ASKED[q][0]]])
        if initial in NEXT[q]:
            best = min(best, KEEP + extra + v[NEXT[q][initial]])
        out.append(min(best, INF))
    return _with_inserts(out)


def costs(steps: list[tuple], behind: list[int]) -> list[list[int]]:
    """Costs to go by state in front of each decision, and behind the last."""
    out = [list(behind)]
    for step in reversed(steps):
        out.append(_before(step, out[-1]))
    return out[::-1]


def walk(steps: list[tuple], to_go: list[list[int]], q: int, last: bool) -> tuple[list[tuple[str, int, int, str]], int]:
    """The ASCII-least cheapest edits (letter, times, row, role) from state `q`, and the state reached; inserts have row -1.

    Behind the last decision the walk goes on by inserts if the conversation ends there.
    """
    out, i = [], 0
    while i < len(steps) or last and to_go[i][q]:
        due = to_go[i][q]
        if i < len(steps):
            row, times, initial, extra = steps[i]
            if due == to_go[i + 1][q] + DELETE * times:
                out.append(("D", times, row, ""))
                i += 1
                continue
        to = NEXT[q][ASKED[q][0]]
        if due == INSERT + to_go[i][to]:
            out.append(("I", 1, -1, ASKED[q]))
        elif initial in NEXT[q] and due == KEEP + extra + to_go[i + 1][NEXT[q][initial]]:
            to = NEXT[q][initial]
            out.append(("K", 1, row, ""))
            i += 1
        else:
            out.append(("R", 1, row, ASKED[q]))
            i += 1
        q = to
    return out, q


#: Of a chunk: its part of the audit, the repaired turns, and what its neighbours must know to add up the counts.
_PIECE = "audit string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, cost long, turns long, first_turn long, last_turn long, head string, tail string"


def _faults(turns: list, roles: list[str], copies: list[int], faults: list[int]) -> tuple:
    """blank, duplicate, truncated, illegal, number of distinct turns, first and last turn, first and last initial of a chunk's rows."""
    n, illegal, last = [0] * 4, 0, None
    there = [(t, r[:1], c, f) for t, r, c, f in zip(turns, roles, copies, faults, strict=True) if c]
    for _, x, c, f in there:
        n[f] += 1 if f != 1 else c
        n[2] += c - 1 if f != 1 else 0
        illegal += c - 1 + (last is not None and last + x not in ("su", "ua", "au"))
        last = x
    known = [t for t, *_ in there if t is not None]
    ends = (known[0], known[-1]) if known else (None, None)
    return n[1], n[2], n[3], illegal, len(set(known)), *ends, there[0][1] if there else None, last


def piece(turns: list, roles: list[str], texts: list[str], copies: list[int], faults: list[int], q: int, behind: list[int], last: bool) -> tuple:
    """A row of _PIECE: a chunk walked from state `q` with the costs `behind` it."""
    steps = _steps(roles, copies, faults)
    to_go = costs(steps, behind)
    edits, to = walk(steps, to_go, q, last)
    kept = [(role or roles[row], texts[row] if row >= 0 else "") for letter, _, row, role in edits if letter != "D"]
    blank, duplicate, truncated, illegal, *rest = _faults(turns, roles, copies, faults)
    return "".join(e[0] * e[1] for e in edits), [r for r, _ in kept], [t for _, t in kept], blank, duplicate, truncated, illegal, to_go[0][q] - (0 if last else behind[to]), *rest


_WALKED = ["turns", "roles", "texts", "copies", "faults"]


def pieces(conversations: DataFrame, most_turns: int = CHUNK_TURNS, most_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, chunk, _PIECE) of conversations in one chunk, and of those in several. `conversations` is damaged() or like it."""
    kind = dict(conversations.dtypes)["conv_id"]
    found = chunks(judged(conversations), most_turns, most_chars)
    many, size = sized_stash(found.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("chunk").alias("last")).where("n > 1").select(F.col("conv_id").alias("_c"), "last"), "many")
    of = F.col("conv_id").eqNullSafe(F.col("_c"))
    schema = f"conv_id {kind}, chunk long, {_PIECE}"
    single = found.join(small(many, size), of, "left_anti").select("conv_id", "chunk", *_WALKED, F.lit(0).alias("q"), F.array(*map(F.lit, AT_END)).cast("array<long>").alias("behind"), F.lit(True).alias("ends"))
    spread, _ = sized_stash(found.join(small(many, size), of).drop("_c"), "spread")

    def to_matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            steps = [_steps(list(r), list(c), list(f)) for r, c, f in zip(b["roles"], b["copies"], b["faults"], strict=True)]
            yield b[["conv_id", "chunk"]].assign(m=[[x for q in range(4) for x in costs(s, [0 if i == q else INF for i in range(4)])[0]] for s in steps])

    def to_costs(g: pd.DataFrame) -> pd.DataFrame:
        g, behind, out = g.sort_values("chunk", ascending=False), list(AT_END), []
        for m in g["m"]:
            out.append(behind)
            behind = _with_inserts([min(m[4 * to + q] + behind[to] for to in range(4)) for q in range(4)])
        return g[["conv_id", "chunk"]].assign(behind=out)

    def to_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            exits = []
            for r, c, f, v in zip(b["roles"], b["copies"], b["faults"], b["behind"], strict=True):
                steps = _steps(list(r), list(c), list(f))
                to_go = costs(steps, [int(x) for x in v])
                exits.append([walk(steps, to_go, q, False)[1] if to_go[0][q] < INF else q for q in range(4)])
            yield b[["conv_id", "chunk", "behind"]].assign(exits=exits)

    def to_entries(g: pd.DataFrame) -> pd.DataFrame:
        g, q, out = g.sort_values("chunk"), 0, []
        for e in g["exits"]:
            out.append(q)
            q = int(e[q])
        return g[["conv_id", "chunk", "behind"]].assign(q=out)

    flags = spread.select("conv_id", "chunk", "roles", "copies", "faults")
    # A conversation's rows meet here as one short row a chunk.
    behind = stash(flags.mapInPandas(to_matrix, f"conv_id {kind}, chunk long, m array<long>").groupBy("conv_id").applyInPandas(to_costs, f"conv_id {kind}, chunk long, behind array<long>").drop("conv_id"), "behind")
    exits = flags.join(behind, "chunk").mapInPandas(to_exits, f"conv_id {kind}, chunk long, behind array<long>, exits array<int>")
    entries = stash(exits.groupBy("conv_id").applyInPandas(to_entries, f"conv_id {kind}, chunk long, behind array<long>, q int").drop("conv_id"), "entries")
    several = spread.join(entries, "chunk").select("conv_id", "chunk", *_WALKED, "q", "behind", (F.col("chunk") == F.col("last")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "chunk", *(x.split()[0] for x in _PIECE.split(", "))]
        types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
        for b in batches:
            ids = [b.column(0), b.column(1)]
            cols = [b.column(i).to_pylist() for i in range(2, 10)]
            for i in range(0, len(cols[0]), 500):
                out = [piece(*row) for row in zip(*(c[i : i + 500] for c in cols), strict=True)]
                made = [pa.array(c, types[t.split()[1]]) for c, t in zip(zip(*out, strict=True), _PIECE.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([x.slice(i, 500) for x in ids] + made, names=names)

    return single.mapInArrow(run, schema), several.mapInArrow(run, schema)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of pieces that come in its order."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    out: list[tuple] = []
    now: dict | None = None
    kind = None

    def done(x: dict) -> tuple:
        gaps = x["last_turn"] - x["first_turn"] + 1 - x["turns"] if x["turns"] else 0
        return x["conv_id"], gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], "".join(x["audit"]), x["hash"].hexdigest()

    def batch() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        kind = b.column(0).type
        for i in range(b.num_rows):
            x = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
            if now is None or x["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(done(now))
                now = x | {"audit": [x["audit"]], "hash": hashlib.sha256(), "begun": False}
            else:
                now["audit"].append(x["audit"])
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += x[c]
                now["illegal"] += now["tail"] is not None and x["head"] is not None and now["tail"] + x["head"] not in ("su", "ua", "au")
                now["turns"] += x["turns"] - (x["turns"] > 0 and now["last_turn"] == x["first_turn"])
                for c, v in (("first_turn", now["first_turn"] if now["first_turn"] is not None else x["first_turn"]), ("last_turn", x["last_turn"] if x["turns"] else now["last_turn"]), ("tail", x["tail"] if x["tail"] is not None else now["tail"])):
                    now[c] = v
            for role, text in zip(x["roles"], x["texts"], strict=True):
                now["hash"].update((("\n" if now["begun"] else "") + f"{role}:{text}").encode())
                now["begun"] = True
        if len(out) >= 1000:
            yield batch()
    if now is not None:
        out.append(done(now))
    if out:
        yield batch()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, most_turns: int = CHUNK_TURNS, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of damaged() rows."""
    single, several = pieces(conversations, most_turns, most_chars)
    schema = f"conv_id {dict(conversations.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    in_order = several.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return single.mapInArrow(_closed, schema).unionByName(in_order.mapInArrow(_closed, schema))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, place, role, text: the repaired turns of damaged() rows, in the order of chunk and place."""
    single, several = pieces(conversations)
    turns = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")
    return single.unionByName(several).select("conv_id", "chunk", turns).select("conv_id", "chunk", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """States' best ends as structs (c cost, a audit, t repaired turns), grown backward turn by turn in a recursive query.

    The least struct by cost, then audit, is the cheapest ASCII-least end, so no walk is needed.
    """
    trim = f"rtrim(text, '{SPACES}')"
    end = lambda cost, audit, turns: f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 't': {turns}}}"
    add = lambda cost, letter, turn, rest: end(f"{cost} + {rest}.c", f"'{letter}' || {rest}.a", f"{turn} || {rest}.t" if turn else f"{rest}.t")
    to = lambda q: NEXT[q][ASKED[q][0]]

    def row(q: int) -> str:
        open_ = "NOT forced"
        options = [add(DELETE, "D", "", f"v{q}"), f"CASE WHEN {open_} THEN " + add(f"{REROLE} + extra", "R", f"chr(10) || '{ASKED[q]}:' || text", f"v{to(q)}") + " END"]
        options += [f"CASE WHEN {open_} AND left(role, 1) = '{x}' THEN " + add("extra", "K", "chr(10) || role || ':' || text", f"v{n}") + " END" for x, n in NEXT[q].items()]
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS w{q}"

    def inserted(q: int) -> str:
        once, twice = f"w{to(q)}", f"w{to(to(q))}"
        roles = f"chr(10) || '{ASKED[q]}:' || chr(10) || '{ASKED[to(q)]}:'"
        return f"list_min([w{q}, {add(INSERT, 'I', f"chr(10) || '{ASKED[q]}:'", once)}, {add(2 * INSERT, 'II', roles, twice)}]) AS v{q}"

    last = [end(0, "''", "''"), end(10, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), end(5, "'I'", "chr(10) || 'assistant:'"), end(0, "''", "''")]
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, (SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda s, x: list_reduce(list_prepend(xor(s, x), [CAST(0 AS BIGINT) for i in range(8)]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS r FROM k),
c AS (SELECT *, xor(r, 4294967295) % 20 AS kind FROM h),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind > 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM o),
f AS (SELECT *, CASE WHEN {trim} = '' THEN 1 WHEN again THEN 2 WHEN right({trim}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n),
g AS (SELECT *, fault IN (1, 2) AS forced, CASE WHEN fault = 3 THEN {CUT_OFF} ELSE 0 END AS extra FROM f),
z AS (SELECT conv_id, max(i) AS n FROM g GROUP BY conv_id),
p AS (SELECT conv_id, n AS i, {", ".join(f"{x} AS v{q}" for q, x in enumerate(last))} FROM z
      UNION ALL SELECT conv_id, i - 1, {", ".join(inserted(q) for q in range(4))} FROM (SELECT p.conv_id, p.i, {", ".join(row(q) for q in range(4))} FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
      count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
e AS (SELECT conv_id, v0 FROM p WHERE i = 0)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(substr(coalesce(v0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


SQL = _sql()
