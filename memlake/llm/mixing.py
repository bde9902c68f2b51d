"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a share of all words by its weight, at most CAP times its own words. A target over the source's own
words takes certain whole copies of every document first; of the rest each document has an inclusion probability, and documents
are ranked by their random odds divided by their inclusion odds; the first so many are taken, so the sample's size is fixed.

That size is fixed by strata: documents of a source and of nearly one size (classes of 1/16 of an octave). From the
largest class down, a class is asked for its part of the target and for what the larger ones took too much or too little,
rounded to whole documents. Within it the inclusion probabilities are unequal: they are tilted to its larger or its smaller
documents, so that the expected words meet what the rounding leaves over. What a tilt can't carry goes down to the next class.
So a source's words miss its target by little more than its small documents.

Documents aren't gathered by source: classes are sums of partial sums, at most CLASSES rows a source go down in order, and ranks
are found by histograms of the ranking variable, again and again while the one cell that is cut holds over CELL rows.

Edge cases: null, empty and blank texts have size 0 and are taken 0 words. A null source is a source of its own, the last. A
source without words has target 0. Very long texts are single documents of their class. Ties and repeated rows are taken or left
one by one; which of equal rows is taken doesn't show. A null doc_id is a key like others. An empty table gives no rows. Extra columns
are ignored. The random numbers are hashes of doc_id and text, so reruns agree on any layout of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.words import words, words_sql
from memlake.shared import sized_stash, small, stash, table

#: Weights of the sources in order, repeating, and how many times its own words a source gives at most.
WEIGHTS, CAP = (5, 2, 1), 3
#: Classes of sizes in an octave; the share of the largest possible tilt that is used.
PER_OCTAVE, TILT = 16, 0.9
#: Rows ranked in one window at most, and cells of a histogram.
CELL, CELLS = 2_000, 8192
_BITS = 52


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` (source, ...) with their place `i` from 0 by code point, null last; ranges are sorted each for itself."""
    sorted_ = sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    rows, _ = sized_stash(sorted_.withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("_p", "_before")), part == F.col("_p")).withColumn("i", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_p", "_before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`sources` (source, source_size) with `target`. In rounds, sources above their cap are set to it and the others share the rest."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights)).cast("int") + 1)
    rows = stash(numbered(sources).select("source", "source_size", weight.cast("long").alias("w"), F.lit(False).alias("full")), "weighted")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * cap
    while True:
        taken, w = rows.agg(F.coalesce(F.sum(F.when(F.col("full"), most)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))), F.lit(1))).first()
        share = (F.lit(total - taken) * F.col("w")).cast("double") / w
        above = ~F.col("full") & (share > most)
        if not rows.where(above).limit(1).count():
            break
        rows = stash(rows.withColumn("full", F.col("full") | above), "weighted")
    return rows.select("source", "source_size", F.when(F.col("full"), most.cast("double")).otherwise(share).alias("target"))


def size_class(size: Column) -> Column:
    """The number of a size's class; sizes of one class differ by less than an octave's PER_OCTAVE-th part."""
    octave = F.length(F.bin(size)) - 1
    return (octave * PER_OCTAVE + F.floor(size * PER_OCTAVE / F.pow(F.lit(2.0), octave)) - PER_OCTAVE).cast("int")


def _plan(g: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each class of one source are taken, and the tilt of their probabilities."""
    carry, out = 0.0, []
    for r in g.sort_values("class", ascending=False).itertuples():
        mean = r.words / r.n
        want = r.share * r.words + carry
        take = min(max(int((want / mean + 0.5) // 1), 0), r.n) if r.share > 0 else 0
        p = take / r.n
        spread, reach = float(r.squares) / r.n - mean * mean, max(r.hi - mean, mean - r.lo)
        tilt = 0.0
        if r.lo < r.hi and 0 < take < r.n and spread > 0:
            most = TILT * min(p, 1 - p) / reach
            tilt = min(max((want - take * mean) / (r.n * spread), -most), most)
        carry = want - take * mean - tilt * r.n * spread if r.share > 0 else 0.0
        out.append((take, p, mean, tilt))
    chosen = g.sort_values("class", ascending=False)[["stratum", "n"]]
    return chosen.assign(take=[x[0] for x in out], p=[x[1] for x in out], mean=[x[2] for x in out], tilt=[x[3] for x in out])


def first_ranked(rows: DataFrame, need: DataFrame, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """uid of the `take` first rows of each stratum: `rows` (uid, stratum, k1, k2) by k1, then k2; `need` (stratum, n, take).

    A stratum of over `cell` rows is counted by the next digit of its keys; cells below the cut are taken whole, and the cut
    cell is a stratum again. Keys have _BITS bits and no two rows share both, so this ends.
    """
    digits, step = [], cells.bit_length() - 1
    for k in ("k1", "k2"):
        digits += [F.shiftright(F.col(k), max(_BITS - step * (j + 1), 0)).bitwiseAND(cells - 1 if _BITS - step * (j + 1) >= 0 else (1 << _BITS % step) - 1) for j in range(-(-_BITS // step))]
    left, wanted, taken = rows, need, []
    for digit in [*digits, None]:
        broad = F.col("n") > cell if digit is not None else F.lit(False)
        wide = small(*sized_stash(wanted.where(broad).select("stratum", "take"), "wide"))
        narrow = small(*sized_stash(wanted.where(~broad).select("stratum", "take"), "narrow"))
        place = F.row_number().over(Window.partitionBy("stratum").orderBy("k1", "k2"))
        taken.append(left.join(narrow, "stratum").withColumn("place", place).where(F.col("place") <= F.col("take")).select("uid"))
        if not wide.limit(1).count():
            break
        open_, _ = sized_stash(left.join(wide, "stratum").withColumn("cell", digit.cast("int")), "open")
        counts = open_.groupBy("stratum", "cell").agg(F.count("*").alias("n"), F.first("take").alias("take"))
        below = F.sum("n").over(Window.partitionBy("stratum").orderBy("cell")) - F.col("n")  # at most `cells` rows
        cut = counts.withColumn("below", below).where(F.col("below") < F.col("take"))
        cut = small(*sized_stash(cut.select("stratum", "cell", "n", (F.col("take") - F.col("below")).alias("need")), "cells"))
        found, _ = sized_stash(open_.drop("take").join(cut, ["stratum", "cell"]), "cut")
        taken.append(found.where(F.col("n") <= F.col("need")).select("uid"))
        part = F.xxhash64("stratum", "cell")
        left = found.where(F.col("n") > F.col("need")).select("uid", part.alias("stratum"), "k1", "k2")
        wanted = stash(cut.where(F.col("n") > F.col("need")).select(part.alias("stratum"), "n", F.col("need").alias("take")), "need")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of `docs` (doc_id, text, source)."""
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))), 1, 13), 16, 10).cast("long")
    size = F.size(words(F.col("text"))).cast("long")
    sized, _ = sized_stash(docs.select("doc_id", "source", size.alias("size"), chance.alias("chance")).withColumn("uid", F.monotonically_increasing_id()), "sizes")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    plan, plan_bytes = sized_stash(wanted.withColumn("whole", whole).withColumn("share", F.when(F.col("source_size") > 0, (F.col("target") - F.col("whole") * F.col("source_size")) / F.col("source_size")).otherwise(0.0)).withColumn("_s", F.monotonically_increasing_id()), "targets")
    of = F.col("source").eqNullSafe(F.col("_source"))
    rows = sized.join(small(plan.withColumnRenamed("source", "_source"), plan_bytes), of).drop("_source", "source")
    stratum = F.xxhash64("_s", size_class(F.col("size")))
    open_ = rows.where("size > 0 AND share > 0").select("uid", "size", "chance", "share", "_s", size_class(F.col("size")).alias("class"), stratum.alias("stratum"))
    classes = open_.groupBy("_s", "class", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("double").alias("squares"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.first("share").alias("share"))
    need, need_bytes = sized_stash(classes.groupBy("_s").applyInPandas(_plan, "stratum long, n long, take long, p double, mean double, tilt double"), "takes")
    drawn = open_.join(small(need.where("take > 0 AND take < n").select("stratum", "p", "mean", "tilt"), need_bytes), "stratum")
    u, p = (F.col("chance") + 0.5) / float(1 << _BITS), F.col("p") + F.col("tilt") * (F.col("size") - F.col("mean"))
    rank = (u / (1 - u)) / (p / (1 - p))  # random odds by inclusion odds
    keyed = drawn.select("uid", "stratum", (rank / (1 + rank) * float((1 << _BITS) - 1)).cast("long").alias("k1"), F.shiftrightunsigned(F.xxhash64("uid"), 64 - _BITS).alias("k2"))
    picked = first_ranked(stash(keyed, "ranked"), need.where("take > 0 AND take < n").select("stratum", "n", "take"), cell, cells)
    picked = small(*sized_stash(picked.select("uid", F.lit(1).alias("_one")), "picked"))
    full = small(need.where("take = n").select("stratum", F.lit(1).alias("_all")), need_bytes)
    marked = rows.withColumn("stratum", F.when((F.col("size") > 0) & (F.col("share") > 0), stratum)).join(full, "stratum", "left").join(picked, "uid", "left")
    copies = F.col("whole") + F.coalesce("_all", "_one", F.lit(0))
    return marked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, source, CAST(len({words_sql("text")}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS chance FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS w FROM s),
a AS (SELECT source, source_size, w, source_size * {CAP} AS most, coalesce(sum(source_size * {CAP}) OVER o, 0) AS low, coalesce(sum(w) OVER o, 0) AS low_w, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
      FROM w WINDOW o AS (ORDER BY source_size * {CAP} / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (total - low) * w / (all_w - low_w) > most AS capped FROM a),
r AS (SELECT CAST(any_value(total) - coalesce(sum(most) FILTER (WHERE capped), 0) AS BIGINT) AS rest, CAST(coalesce(sum(w) FILTER (WHERE NOT capped), 0) AS BIGINT) AS rest_w FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / rest_w END AS target FROM b, r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {CAP}) ELSE 0 END AS whole FROM t),
h AS (SELECT *, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS share FROM g),
x AS (SELECT uid, doc_id, size, chance, source_size, target, whole, share, h.source,
      CASE WHEN size > 0 AND share > 0 THEN CAST((length(bin(size)) - 1) * {PER_OCTAVE} + floor(size * {PER_OCTAVE} / pow(2.0, length(bin(size)) - 1)) - {PER_OCTAVE} AS INTEGER) END AS class
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
c AS (SELECT source, class, count(*) AS n, CAST(sum(size) AS DOUBLE) AS words, CAST(sum(size * size) AS DOUBLE) AS squares, min(size) AS lo, max(size) AS hi, any_value(share) AS share,
      row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i FROM x WHERE class IS NOT NULL GROUP BY source, class),
p AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS carry, CAST(0 AS BIGINT) AS take, CAST(0 AS DOUBLE) AS tilt FROM (SELECT DISTINCT source FROM c)
      UNION ALL SELECT source, i, want - take * mean - tilt * n * spread, take, tilt FROM (
        SELECT *, CASE WHEN lo < hi AND take > 0 AND take < n AND spread > 0 THEN least(greatest((want - take * mean) / (n * spread), -({TILT} * least(take / n, 1 - take / n) / greatest(hi - mean, mean - lo))),
            {TILT} * least(take / n, 1 - take / n) / greatest(hi - mean, mean - lo)) ELSE 0.0 END AS tilt FROM (
          SELECT *, least(greatest(CAST(floor(want / mean + 0.5) AS BIGINT), 0), n) AS take FROM (
            SELECT c.*, words / n AS mean, share * words + carry AS want, squares / n - (words / n) * (words / n) AS spread FROM p JOIN c ON c.source IS NOT DISTINCT FROM p.source AND c.i = p.i + 1)))),
q AS (SELECT c.source, c.class, c.n, c.words / c.n AS mean, take, take / c.n AS p, tilt FROM p JOIN c ON c.source IS NOT DISTINCT FROM p.source AND c.i = p.i),
y AS (SELECT x.*, take, q.p + tilt * (size - mean) AS p, (chance + 0.5) / {float(1 << _BITS)} AS u FROM x LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source AND x.class = q.class),
z AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0 END, uid) AS place FROM y)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN class IS NOT NULL AND place <= take THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CASE WHEN size > 0 THEN CAST(whole + CASE WHEN class IS NOT NULL AND place <= take THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS copies FROM z
"""
