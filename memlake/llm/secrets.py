"""Secret scans with corpus-wide ownership frequency.

Base spans of three kinds are found by pattern in every whole text. The method looks at candidate values across the
corpus: it counts the distinct repositories (`source`) and owners (its part before the first "/") that hold a value.
A value of several owners is a widely copied example; a value of one owner is live-looking. Long mixed tokens that no
base pattern covers become spans of the kind `owned` only if they are live-looking. Base spans always stay.

Places come from running sums over the pieces between matches, made block by block, so time grows with a text's length and
matches, not with their squares.

Edge cases: null text is empty, so it has no spans. A very long text, or one of very many matches, is scanned whole, in one
task. A null source names no owner: a value that only such rows hold has none, so it counts as live-looking, as nothing shows
that it was copied. Ties: spans of one start are ordered by kind as listed. Repeated rows are scanned each for itself and count
once for a value's owners. An empty table gives an empty result. Extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.shared import let, sized_stash, small, stash, table

#: The patterns of the kinds, in the order of listing. Letters of the names in either case.
NAMES = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
    "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
)
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more
HEX = "[0-9a-f]{24,}"
#: Candidates of the method: long runs with a digit and both a letter of each case.
MIXED = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 1
#: Matches in a block of running sums, and code points in a block of a text that is cut.
BLOCK, CUT = 64, 4096

_NONE = "array<struct<s:int,k:int,e:int,v:string>>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints under `join`, block by block: an array that grows is copied within a block only."""

    def scan(x: Column, start: Column) -> Column:
        grown = F.aggregate(x, F.array(start), lambda a, v: F.array_append(a, join(F.element_at(a, -1), v)))
        return F.slice(grown, 2, F.size(x))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1), lambda i: F.slice(x, i * BLOCK + 1, BLOCK))

    total = lambda x: F.aggregate(x, F.lit(0), join)
    many = lambda x: let(
        blocks(x),
        lambda bs: let(
            F.concat(F.array(F.lit(0)), scan(F.transform(bs, total), F.lit(0))),
            lambda heads: F.flatten(F.transform(bs, lambda one, i: scan(one, F.get(heads, i)))),
        ),
    )
    return let(values, lambda x: F.when(F.size(x) == 0, x).when(F.size(x) <= BLOCK, scan(x, F.lit(0))).otherwise(many(x)))


def _found(text: Column, pattern: str, kind: int, value_group: int = 0, min_value: int = 0) -> Column:
    """Matches as structs (s, k, e, v): start, kind, end in code points, value. Pieces between matches give the places."""

    def spans(x: Column) -> Column:
        p, m, v = x["p"], x["m"], x["v"]
        ends = _running(F.transform(m, lambda y, i: F.length(F.get(p, i)) + F.length(y)), lambda a, b: a + b)
        one = lambda e, i: F.struct((e - F.length(F.get(m, i))).alias("s"), F.lit(kind).alias("k"), e.alias("e"), F.get(v, i).alias("v"))
        return F.transform(ends, one)

    pat = F.lit(pattern)
    matches = F.struct(
        F.split(text, pattern).alias("p"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pat, F.lit(value_group)).alias("v"),
    )
    hits = F.when(text.rlike(pattern), let(matches, spans)).otherwise(F.array().cast(_NONE))
    return F.filter(hits, lambda x: F.length(x["v"]) >= min_value) if min_value else hits


def _apart(base: Column, more: Column) -> Column:
    """Spans of `more`, which don't overlap each other, that no span of `base` overlaps.

    In order of places, such a span begins at or after the ends of all base spans before it and ends before the next one.
    """

    def pick(z: Column) -> Column:
        ends = _running(F.transform(z, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        clear = lambda x, i, far: (x["k"] == 3) & (F.coalesce(F.get(far, i - 1), F.lit(0)) <= x["s"]) & F.coalesce((F.get(z, i + 1)["k"] == 3) | (F.get(z, i + 1)["s"] >= x["e"]), F.lit(True))
        return let(ends, lambda far: F.filter(z, lambda x, i: clear(x, i, far)))

    return F.when(F.size(more) == 0, more).otherwise(let(F.array_sort(F.concat(base, more)), pick))


def _owned_like(x: Column) -> Column:
    v = x["v"]
    return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")


def with_spans(docs: DataFrame) -> DataFrame:
    """`docs` with _b, its base spans in order, and _c, the method's candidates that no base span overlaps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_found(text, ASSIGN, 0, 2, 6), _found(text, ACCESS, 1), _found(text, HEX, 2)))
    more = F.filter(_found(text, MIXED, 3), _owned_like)
    both = let(base, lambda b: F.struct(b.alias("b"), let(more, lambda c: _apart(b, c)).alias("c")))
    # Generated, so that the patterns are run once, whatever is done with the spans.
    out = docs.select("*", F.explode(F.array(both)).alias("_s"))
    return out.withColumn("_b", F.col("_s.b")).withColumn("_c", F.col("_s.c")).drop("_s")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, live for each candidate value of rows (source, vals array of digests).

    Distinct (value, repository) pairs are formed first, on the map side too, so a value in a third of all rows
    arrives as one row a repository and task.
    """
    pairs = found.select("source", F.explode("vals").alias("value")).distinct()
    owner = F.regexp_extract("source", "^[^/]*", 0)
    return pairs.groupBy("value").agg(F.count("source").alias("n_repos"), F.count_distinct(owner).alias("n_owners")).withColumn("live", F.col("n_owners") <= MAX_OWNERS)


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _digests(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha1(x["v"].cast("binary")).alias("v")))


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each row of `docs`: counts, base_sha256, spans, n_live and n_copied (of all spans' values)."""
    rows = with_spans(docs.select(F.col(key), "source", "text")).select(key, "source", _digests(F.concat("_b", "_c")).alias("x"))
    rows = rows.withColumn("vals", F.array_distinct(F.transform("x", lambda x: x["v"]))).withColumn("uid", F.monotonically_increasing_id())
    rows = stash(rows, "secrets")
    owners, size = sized_stash(ownership(rows).select("value", "live"), "owners")
    found = rows.select(F.col("uid").alias("_u"), F.explode("x").alias("x")).join(small(owners, size), F.col("x.v") == F.col("value"))
    spot = F.struct(F.col("x.s").alias("s"), F.col("x.k").alias("k"), F.col("x.e").alias("e"))
    base = F.col("x.k") < 3
    per = found.where(base | F.col("live")).groupBy("_u").agg(
        F.array_sort(F.collect_list(F.when(base, spot))).alias("b"),
        F.array_sort(F.collect_list(spot)).alias("all"),
        *[F.count_if(F.col("x.k") == k).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))],
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    joined = rows.select(key, "uid").join(per, rows["uid"] == per["_u"], "left")
    text = lambda c: F.coalesce(_text_of(F.col(c)), F.lit(""))
    return joined.select(key, count("n_assign"), count("n_access"), count("n_hex"), F.sha2(text("b").cast("binary"), 256).alias("base_sha256"), text("all").alias("spans"), count("n_live"), count("n_copied"))


MARK = "[SECRET]"


def _redacted(text: Column, spans: Column) -> Column:
    """`text` with each run of overlapping spans (s, e), in order, replaced by MARK.

    The text is cut into blocks once, so a piece of it costs a block or its own length, however far in it stands.
    """

    def piece(blocks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / CUT).cast("int")
        some = F.slice(blocks, first + 1, F.floor((end - 1) / CUT).cast("int") - first + 1)
        cut = lambda x, i: F.substr(x, F.greatest(begin - (first + i) * CUT, F.lit(0)) + 1, F.least(end - (first + i) * CUT, F.lit(CUT)) - F.greatest(begin - (first + i) * CUT, F.lit(0)))
        return F.when(end > begin, F.array_join(F.transform(some, cut), "")).otherwise("")

    def done(z: Column) -> Column:
        far, blocks, size, spans = z["far"], z["blocks"], z["size"], z["spans"]
        last = lambda i: F.coalesce(F.get(far, i - 1), F.lit(0))
        gaps = F.transform(spans, lambda x, i: F.when(x["s"] >= last(i), F.concat(piece(blocks, last(i), x["s"]), F.lit(MARK))).otherwise(""))
        return F.concat(F.array_join(gaps, ""), piece(blocks, F.element_at(far, -1), size))

    far = _running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0))
    return let(F.struct(far.alias("far"), blocks.alias("blocks"), F.length(text).alias("size"), spans.alias("spans")), done)


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, whose live-looking values are replaced by MARK in text; n_chars follows. All rows stay.

    Only values of one owner go; copied examples stay as they are. Spans depend on the text alone, so those that are live are
    kept by a hash of their text, and reach it by broadcast if their stored size allows, else by a join on that hash.
    """
    text_key = lambda t: F.md5(t.cast("binary"))
    found = with_spans(docs.select("source", "text")).where((F.size("_b") > 0) | (F.size("_c") > 0)).select("source", text_key(F.col("text")).alias("t"), _digests(F.concat("_b", "_c")).alias("x"))
    found = stash(found.withColumn("vals", F.array_distinct(F.transform("x", lambda x: x["v"]))), "secrets")
    owners, size = sized_stash(ownership(found).where("live").select("value"), "owners")
    one = found.select("t", F.explode("x").alias("x")).select("t", "x.s", "x.e", F.col("x.v").alias("value"))
    live = one.join(small(owners, size), "value", "left_semi").groupBy("t", "s", "e").agg(F.lit(1).alias("_")).groupBy(F.col("t").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_spans"))
    live, size = sized_stash(live, "live")
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")).join(small(live, size), text_key(F.col("_text")) == F.col("_t"), "left")
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_new").cast(dict(docs.dtypes)["n_chars"]))
    changed = rows.where("_spans IS NOT NULL").select("_row", _redacted(F.col("_text"), F.col("_spans")).alias("_new")).select(row.alias("_row"))
    return rows.where("_spans IS NULL").select("_row").unionByName(changed).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def kind(i: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT uid, {i} AS k, unnest(list_zip(regexp_split_to_array(text, '{p}')[:len(m)], m, v)) AS z, generate_subscripts(m, 1) AS i
  FROM (SELECT uid, text, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM d WHERE regexp_matches(text, '{p}'))"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kind(*x) for x in ((0, ASSIGN, 2, 6), (1, ACCESS, 0, 0), (2, HEX, 0, 0), (3, MIXED, 0, 0)))}),
p AS (SELECT uid, k, z[3] AS v, CAST(sum(length(z[1]) + length(z[2])) OVER (PARTITION BY uid, k ORDER BY i) AS BIGINT) AS e, length(z[2]) AS n FROM m),
s AS (SELECT uid, k, v, e - n AS s, e FROM p WHERE k <> 0 OR length(v) >= 6),
b AS (SELECT * FROM s WHERE k < 3),
c AS (SELECT * FROM s WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.uid = s.uid AND b.s < s.e AND s.s < b.e)),
a AS (SELECT a.*, d.source FROM (FROM b UNION ALL FROM c) a JOIN d ON d.uid = a.uid),
l AS (SELECT v, count(DISTINCT regexp_extract(source, '^[^/]*', 0)) <= {MAX_OWNERS} AS live FROM a GROUP BY v),
f AS (SELECT a.*, live, CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || s || ':' || e AS t FROM a JOIN l ON l.v = a.v WHERE k < 3 OR live),
g AS (SELECT uid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        string_agg(t, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(t, ',' ORDER BY s, k) AS spans,
        count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM f GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g ON g.uid = d.uid
"""


SQL = _sql()
