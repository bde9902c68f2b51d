"""Density clusters and near-duplicates of memories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators.components import components
from memlake.operators.neighbours import near_links, near_pairs, sound
from memlake.operators.sweep import allowed, differ, met_pairs, overlap, overlap_fits, overlaps, prefix_rows, with_sketch
from memlake.operators.wordsets import word_sets
from memlake.shared import sized_stash, small, stash

EPSILON, MIN_SIZE, MAX_SIZE = 0.21125, 3, 5
#: 64-bit words of a sketch; lower overlaps need twice and four times as many.
SKETCH = 8
#: Overlaps above this have short prefixes, so that large sets can bring finer sketches under each of their keys.
HIGH = 0.7
#: Overlaps at which two memories of a cluster are alike in words, and duplicates.
ALIKE = {"title": 0.45, "body": 0.25, "text_with_title": 0.35, "text": 0.45}
DUPLICATE = {"title": 0.65, "body": 0.30, "text_with_title": 0.40, "text": 0.72}


def dbscan(nodes: DataFrame, pairs: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """(id, cluster, is_core) of clustered nodes (id) under links (a, b), a < b; a cluster is named by its smallest core.

    A core has min_size neighbours, itself included. Cores that are neighbours form components; a border point joins the
    component with the smallest name next to it. This is what the sequential algorithm gives in id order.
    """
    links = stash(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degree = links.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("n"))
    cores = stash(nodes.select("id").distinct().join(degree, "id", "left").where(F.coalesce("n", F.lit(1)) >= min_size).select("id"), "cores")
    among = links.join(cores.withColumnRenamed("id", "a"), "a").join(cores.withColumnRenamed("id", "b"), "b")
    named = cores.join(components(among).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    named = stash(named, "named")
    beside = links.join(cores.withColumnRenamed("id", "a"), "a", "left_anti").join(named.withColumnRenamed("id", "b"), "b")
    border = beside.groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    return named.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))


def _sums(members: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (cluster, id, u unit vector) of members that have a direction, and (cluster, n, s sum of their unit vectors)."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("id", F.when(norm > 0, F.transform(v, lambda x: x / norm)).alias("u"))
    rows = stash(members.select("cluster", "id").join(unit, "id").where("u IS NOT NULL"), "units")
    places = rows.select("cluster", F.posexplode("u").alias("k", "x")).groupBy("cluster", "k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = places.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("s"))
    return rows, sums


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def densest(members: DataFrame, vectors: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """(cluster, id, mean_distance, place): of each cluster the max_size members of least mean distance to the others, in that order.

    The mean distance of unit vector u to the n - 1 others is 1 - (u . s - 1) / (n - 1), with s the sum of all n; no pairs are made.
    """
    rows, sums = _sums(members, vectors)
    sums, size = sized_stash(sums, "sums")
    mean = F.when(F.col("n") > 1, 1 - (_dot(F.col("u"), F.col("s")) - 1) / (F.col("n") - 1))
    means = rows.join(small(sums, size), "cluster").select("cluster", "id", mean.alias("mean_distance")).where("mean_distance IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("mean_distance", 12), "id"))
    return means.withColumn("place", place).where(F.col("place") <= max_size)


def cluster_order(chosen: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, size, mean_distance): clusters by size, then by mean distance of their pairs, then by name.

    The n (n - 1) / 2 pairs' cosines sum to (s . s - n) / 2, with s the sum of the unit vectors.
    """
    _, sums = _sums(chosen, vectors)
    n, s = F.col("n"), F.col("s")
    pairs = sums.select("cluster", F.when(n > 1, 1 - (_dot(s, s) - n) / (n * (n - 1))).alias("mean_distance"))
    sizes = chosen.groupBy("cluster").agg(F.count("*").alias("size")).join(pairs, "cluster", "left").withColumn("mean_distance", F.coalesce("mean_distance", F.lit(0.0)))
    return sizes.orderBy(F.desc("size"), F.round("mean_distance", 12), "cluster")


def _enough(title: Column, body: Column, whole: Column, limits: dict) -> Column:
    """Overlaps at which two memories are alike."""
    by_title = (title >= limits["title"]) & ((body >= limits["body"]) | (whole >= limits["text_with_title"]))
    return by_title | (whole >= limits["text"])


def alike(lt: Column, lb: Column, lx: Column, rt: Column, rb: Column, rx: Column, limits: dict) -> Column:
    """Two memories' tokens of title, body and whole text overlap enough."""
    return _enough(tx.jaccard(lt, rt), tx.jaccard(lb, rb), tx.jaccard(lx, rx), limits)


def _hashed(tokens: Column) -> Column:
    """The sorted distinct hashes of an array of words."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x))))


def jaccard_pairs(docs: DataFrame, key: str, part: str, tokens: str, threshold: float, copies: bool = True) -> DataFrame:
    """(a, b, jaccard) of rows of one part whose token sets overlap by `threshold` or more; `tokens` are arrays, or texts for their similarity_tokens().

    Equal token sets form a class first; class representatives meet on the rare tokens of their prefixes, so common tokens
    never join, and sizes, places and sketches leave only pairs that are likely to overlap enough, before anything is written; these are
    checked on whole sets of hashes. Copies come as representative and member, not as all pairs; without `copies` only pairs of
    representatives are returned.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(part).alias("part"), F.col(tokens).alias("t"))
    rows = word_sets(rows, ("t",), "sets") if dict(rows.dtypes)["t"] == "string" else stash(rows.withColumn("t", _hashed(F.col("t"))), "sets")
    rows = rows.where(F.size("t") > 0)
    classes = stash(rows.groupBy("part", "t").agg(F.min("id").alias("rep")), "classes")
    met = met_pairs(prefix_rows(classes.select(F.col("rep").alias("id"), "part", "t"), "t", threshold, SKETCH, fine=threshold > HIGH), threshold, overlap_fits(threshold), sketched=True)
    found = overlaps(met, classes.select(F.col("rep").alias("id"), "part", "t"), ("t",))
    pairs = found.select("a", "b", overlap("t").alias("jaccard")).where(F.col("jaccard") >= threshold)
    if not copies:
        return pairs
    digest = [F.xxhash64("t").alias("h"), F.xxhash64(F.reverse("t")).alias("g")]  # 128 bits of a set, so that sets aren't shuffled again
    named = classes.select(F.col("part").alias("p"), *digest, "rep").withColumnsRenamed({"h": "ch", "g": "cg"})
    of = rows.select("id", "part", *digest)
    members = of.join(named, of["part"].eqNullSafe(named["p"]) & (of["h"] == named["ch"]) & (of["g"] == named["cg"])).where("id <> rep")
    return pairs.unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).distinct())


def _word_sets(rows: DataFrame, *others: str) -> DataFrame:
    """Stored rows (id, part, tt, tb hashed token sets, and others) of `rows` with arrays of words, texts or token sets; those of both are their union."""
    kinds = dict(rows.dtypes)
    if kinds["tt"] == kinds["tb"] == "string":
        return word_sets(rows.select("id", "part", "tt", "tb", *others), ("tt", "tb"), "texts")
    sets = [F.col(c) if kinds[c] == "array<bigint>" else _hashed(F.col(c)).alias(c) for c in ("tt", "tb")]
    return stash(rows.select("id", "part", *sets, *others), "texts")


def alike_pairs(sets: DataFrame, limits: dict) -> DataFrame:
    """(a, b), a < b: rows of _word_sets() of one part that are alike() by `limits`.

    Candidates share a rare token of the whole text, or overlap enough in their titles; sizes, places and sketches of the whole texts drop most
    of them where they meet, so common titles write no pairs of different bodies.
    """
    whole = F.array_union("tt", "tb")
    texts = sets.select("id", "part", whole.alias("tx")).where(F.size("tx") > 0)
    high = limits["text"] > HIGH
    met = met_pairs(prefix_rows(texts, "tx", limits["text"], SKETCH if high else 2 * SKETCH, fine=high), limits["text"], overlap_fits(limits["text"]), sketched=True)
    titled = sets.where(F.size("tt") > 0).select("id", "part", "tt", F.size("tb").cast("long").alias("nb"), F.size(whole).cast("long").alias("nx"), whole.alias("tx"))
    by_title = overlap_fits(limits["title"])

    def fits(cols: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = by_title(cols, i, j)
        place = np.flatnonzero(good)
        i, j = i[place], j[place]
        total = lambda x: cols[x][i].astype(np.int64) + cols[x][j]
        # Whole texts differ in no more than bodies and titles do together.
        body = allowed(total("nb"), limits["body"]) + allowed(total("n"), limits["title"])
        good[place[differ(cols["xs"], i, j) > np.maximum(body, allowed(total("nx"), limits["text_with_title"]))]] = False
        return good

    keyed = prefix_rows(with_sketch(titled, "tx", "xs", 4 * SKETCH), "tt", limits["title"], 2, ("nb", "nx", "xs"))
    met = met.unionByName(met_pairs(keyed, limits["title"], fits, sketched=True)).distinct()
    return overlaps(met, sets, ("tt", "tb"), "tx").where(_enough(*map(overlap, ("tt", "tb", "tx")), limits)).select("a", "b")


def greedy_losers(memories: DataFrame, limits: dict = DUPLICATE) -> DataFrame:
    """(id, kept_id): memories (id unique, scope, project_id, title, body) that lose to a duplicate, as a scan in id order finds them.

    The scan takes each memory that is still there in turn and holds it against the later alike ones of its scope and project that are
    still there, in order: the one with less information goes, the later one on a tie; when it goes itself, the scan goes on with the next.
    Here all memories whose smaller rivals are gone are taken at once, up to the first rival that still waits for another one, in
    rounds until no pair is left. A group of copies is over in a round; a chain of n memories, each like the next only, takes up to n.
    """
    part = F.struct("scope", "project_id")
    cols = memories.where("id IS NOT NULL").select("id", F.to_json(part).alias("part"), F.col("title").alias("tt"), F.col("body").alias("tb"), F.length("body").alias("long"))
    cols = _word_sets(cols, "long")
    score = cols.select("id", (F.size(F.array_union("tt", "tb")) * 8 + F.col("long")).cast("long").alias("info"))  # text.information_score()
    pairs = alike_pairs(cols, limits).join(score.withColumnsRenamed({"id": "a", "info": "ia"}), "a").join(score.withColumnsRenamed({"id": "b", "info": "ib"}), "b").select("a", "b", (F.col("ib") > F.col("ia")).alias("beats"))
    open_, out = stash(pairs, "rivals"), None
    while open_.limit(1).count():
        ready = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        blocked = open_.join(ready, "a", "left_anti").groupBy("b").agg(F.min("a").alias("other"))
        mine = open_.join(ready, "a").join(blocked, "b", "left").join(open_.join(ready, "a").groupBy("b").agg(F.min("a").alias("first")), "b")
        # A rival is settled before `a` meets it unless a smaller memory, ready or not, may still meet it first.
        waits = (F.col("other") < F.col("a")) | (F.col("first") < F.col("a"))
        stop = mine.groupBy("a").agg(F.min(F.when(F.coalesce(waits, F.lit(False)), F.col("b"))).alias("wait"), F.min(F.when(F.col("beats"), F.col("b"))).alias("lost"))
        met = mine.select("a", "b", "beats").join(stop, "a").where((F.col("wait").isNull() | (F.col("b") < F.col("wait"))) & (F.col("lost").isNull() | (F.col("b") <= F.col("lost"))))
        gone = stash(met.select(F.when(F.col("beats"), F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("beats"), F.col("b")).otherwise(F.col("a")).alias("kept_id")), "losers")
        out = gone if out is None else out.unionByName(gone)
        over = gone.select("id")
        open_ = stash(open_.join(over.withColumnRenamed("id", "a"), "a", "left_anti").join(over.withColumnRenamed("id", "b"), "b", "left_anti"), "rivals")
    return memories.select("id", F.col("id").alias("kept_id")).where(F.lit(False)) if out is None else out


def _firsts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, first): the n smallest distinct ids of each group of `rows` (keys, id); no more than n of a group leave a task."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("first"))


def _stars(groups: DataFrame, n: int) -> DataFrame:
    """(a, b), a < b: each row of `groups` (g, id) with the first n of its group."""
    links = groups.join(_firsts(groups, ["g"], n), "g").select("id", F.explode("first").alias("to")).where("id <> to")
    return links.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))


def cluster_links(rows: DataFrame, epsilon: float = EPSILON, min_size: int = MIN_SIZE, limits: dict | None = None) -> DataFrame:
    """(a, b), a < b: links from which dbscan() finds the clusters of `rows` (id, part, vector; with `limits` tt, tb and lin too).

    Rows of a part are neighbours if their vectors are at most epsilon apart; with `limits` also if they are alike in words or share a
    number of their lineage `lin`. Only rows with a direction, and of one length, can be. Rows that are equal in all of this form a class, and
    only classes are compared. A class, or the rows of one lineage number, isn't spelled out in pairs: each row is linked to the first
    min_size rows, which leaves the cores, their components and what borders on them as they are.
    """
    known = sound(rows, "id", "part", "vector").select("id", "v", "node")
    if limits:
        known = known.join(_word_sets(rows, "lin").select("id", "tt", "tb", "lin"), "id")
    named = stash(known, "rows")
    content = [c for c in named.columns if c not in ("id", "node")]
    same = ["node", "h", "g"]
    digests = stash(named.select("id", "node", F.xxhash64(*content).alias("h"), F.xxhash64(F.lit(1), *content).alias("g")), "digests")  # 128 bits a row
    classes, size = sized_stash(_firsts(digests, same, min_size).withColumn("rep", F.col("first")[0]), "classes")
    members = stash(digests.join(classes.select(*same, "rep"), same).select("id", "rep"), "members")
    reps = stash(named.join(small(classes.select(F.col("rep").alias("id")), size), "id", "left_semi").withColumnRenamed("node", "part"), "reps")
    pairs = near_links(reps.withColumnRenamed("v", "vector"), "id", "part", "vector", epsilon, min_size)
    if limits:
        pairs = pairs.unionByName(alike_pairs(_word_sets(reps), limits))
        of_line = reps.select("part", "id", F.explode(F.array_distinct("lin")).alias("line"))
        pairs = pairs.unionByName(_stars(of_line.select(F.xxhash64("part", "line").alias("g"), "id"), min_size))
    firsts = classes.select("rep", "first")
    pairs = stash(pairs.distinct(), "class-links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    links = both.join(members.select(F.col("rep").alias("a"), "id"), "a").join(firsts.withColumnRenamed("rep", "b"), "b").select("id", F.explode("first").alias("to")).where("id <> to")
    return links.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def sequential_dbscan(n: int, near: list[set[int]], min_size: int) -> dict[int, int]:
    """The textbook scan in index order; tests hold dbscan() against it."""
    seen: set[int] = set()
    owner: dict[int, int] = {}
    for i in range(n):
        if i in seen:
            continue
        seen.add(i)
        if len(near[i]) < min_size:
            continue
        owner[i] = i
        todo: Iterator | list = sorted(near[i])
        for k in todo:
            if k not in seen:
                seen.add(k)
                if len(near[k]) >= min_size:
                    todo += sorted(near[k] - set(todo))
            owner.setdefault(k, i)
    return owner
