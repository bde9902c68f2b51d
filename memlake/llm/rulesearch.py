"""Rules among token combinations too many to list: a search with bounds, whole for any width.

A rule is a set of tokens on at least `least` bad transactions, and with at least `min_confidence` of its transactions bad. Minimal
rules can be exponentially many, but a URL is blocked as soon as it holds one. So for each wanted set of tokens (a URL's) one
rule inside it is looked for, until there is one or until bounds rule out the rest: no set is given up. In the worst case time is
exponential (the question is that hard), but neither memory nor what is returned: at most one rule for each wanted set and prefix.

A node of the search has the transactions that hold all tokens taken so far, and the tokens still open. Three things cut it, none of
which can lose the last rule of a wanted set: tokens on too few bad transactions leave; tokens on all bad ones are taken at once, as
they can only rule out good ones; and a good transaction leaves only by a token it lacks, at the price of the bad ones that lack it too, so
each number of bad ones given up leaves at least so many good ones.

Transactions are distinct sets with counts. Where they are too many for one task, Spark deals them out by the first token, rarest first,
each with its more frequent tokens only, then by the second, and so on until each part is small enough: a part has ever fewer tokens
and so ever fewer distinct sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.shared import sized_stash, small, stash

#: A task's transactions times the tokens of its widest wanted set; and the tokens of wanted sets that a task goes through.
CELLS, PIECE = 1 << 23, 1 << 11


def _open_to(has: np.ndarray, bad: np.ndarray, good: np.ndarray, lost: np.ndarray, least: int, min_confidence: float) -> bool:
    """Whether a rule may be left, from transactions (rows) with their open tokens (columns) and the bad ones that each token loses."""
    h, g = bad.sum(), good.sum()
    if h and h / (h + g) >= min_confidence:
        return True
    if not has.shape[1]:
        return False
    price = np.where(has, np.inf, lost).min(axis=1)
    at = np.argsort(price)
    at = at[np.isfinite(price[at])]
    hits, rest = h - price[at], g - np.cumsum(good[at])
    ok = hits >= least
    return bool((hits[ok] / (hits[ok] + rest[ok]) >= min_confidence).any())


def _next(bad_of: np.ndarray, good_of: np.ndarray, h: float, g: float) -> int:
    """The token that rules out most good transactions for each bad one that it loses."""
    return int(np.argmax((g - good_of) / (h - bad_of + 1e-9)))


def _sets(has: np.ndarray, bad: np.ndarray, good: np.ndarray, least: int, min_confidence: float, every: bool) -> Iterator[list[int]]:
    """Columns of a rule, if there is one; with `every`, of all rules, and maybe of some that hold another."""
    todo = [(np.arange(len(bad)), [], np.arange(has.shape[1]))]
    while todo:
        rows, need, left = todo.pop()
        while True:
            h, g = bad[rows].sum(), good[rows].sum()
            if need and h / (h + g) >= min_confidence:
                yield need
                return
            m = has[np.ix_(rows, left)]
            bad_of, good_of = bad[rows] @ m, good[rows] @ m
            use = (bad_of >= least) & (bad_of + good_of < h + g)
            now = use & (bad_of == h) & (not every)
            if not now.any():
                break
            rows, need, left = rows[m[:, now].all(axis=1)], [*need, *left[now]], left[use & ~now]
        if every:
            sure = use.copy()
            sure[use] = bad_of[use] / (bad_of[use] + good_of[use]) >= min_confidence
            yield from ([*need, x] for x in left[sure])
            use &= ~sure
        m, left, bad_of, good_of = m[:, use], left[use], bad_of[use], good_of[use]
        if len(left) and h >= least and _open_to(m, bad[rows], good[rows], h - bad_of, least, min_confidence):
            x = _next(bad_of, good_of, h, g)
            rest = np.delete(left, x)
            todo += [(rows, need, rest), (rows[m[:, x]], [*need, left[x]], rest)]


def _short(need: list[int], has: np.ndarray, bad: np.ndarray, good: np.ndarray, min_confidence: float) -> list[int]:
    """A rule within the rule `need` of which no token can be left out."""

    def sure(cols: list[int]) -> bool:
        rows = has[:, cols].all(axis=1)
        h, g = bad[rows].sum(), good[rows].sum()
        return h / (h + g) >= min_confidence

    rows, left, out = np.arange(len(bad)), np.array(need), []
    while not out or not sure(out):
        m = has[np.ix_(rows, left)]
        x = _next(bad[rows] @ m, good[rows] @ m, bad[rows].sum(), good[rows].sum())
        rows, left, out = rows[m[:, x]], np.delete(left, x), [*out, left[x]]
    for x in list(out):
        fewer = [y for y in out if y != x]
        if fewer and sure(fewer):
            out = fewer
    return out


def _part(table: pa.Table, least: int, min_confidence: float, every: bool) -> pa.Table:
    """Rules (need, hits, freq) of one part: its transactions, all with the tokens of its prefix, and its wanted sets."""
    prefix = table.column("prefix")[0].as_py()
    wanted = table.column("wanted").to_numpy()
    items = table.column("items").combine_chunks()
    coded = pc.dictionary_encode(pc.list_flatten(items))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names, codes, row = coded.dictionary, coded.indices.to_numpy(), pc.list_parent_indices(items).to_numpy()
    bad = table.column("hits").to_numpy()[~wanted].astype(float)
    good = table.column("freq").to_numpy()[~wanted] - bad
    place = np.cumsum(~wanted) - 1  # a transaction's row
    own = ~wanted[row]
    t_row, t_code = place[row[own]], codes[own]
    w_row, w_code = row[~own], codes[~own]
    sets = np.split(w_code, np.flatnonzero(np.diff(w_row)) + 1) if len(w_code) else []
    found: list[frozenset[int]] = []
    barren: list[frozenset[int]] = []  # wanted sets without a rule
    out = []
    for u in sorted(sets, key=len, reverse=True):
        tokens = frozenset(u.tolist())
        if any(f <= tokens for f in found) or any(tokens <= f for f in barren):
            continue
        before = len(out)
        column = np.full(len(names), -1)
        column[u] = np.arange(len(u))
        at = column[t_code] >= 0
        has = np.zeros((len(bad), len(u)), bool)
        has[t_row[at], column[t_code[at]]] = True
        for cols in _sets(has, bad, good, least, min_confidence, every):
            cols = cols if every else _short(cols, has, bad, good, min_confidence)
            if not every:
                found.append(frozenset(u[cols].tolist()))
            rows = has[:, cols].all(axis=1)
            h = int(bad[rows].sum())
            out.append((sorted([*prefix, *(names[int(x)].as_py() for x in u[cols])]), h, h + int(good[rows].sum())))
        if len(out) == before:
            barren.append(tokens)
    kinds = pa.schema([("need", pa.list_(pa.string())), ("hits", pa.int64()), ("freq", pa.int64())])
    return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[], [], []], schema=kinds)


def searched(data: DataFrame, wanted: DataFrame | None, least: int, min_confidence: float) -> DataFrame:
    """(need, hits, freq): of each of the `wanted` sets (items) that holds a rule at least one; with None all minimal rules, and maybe wider
    ones. From transactions (items, bad); items are in the same order everywhere, best from rare to frequent, and none is a rule by itself."""
    none = F.array().cast("array<string>")
    kept = data.where(F.size("items") > 0).select("items", F.lit(1).alias("freq"), F.col("bad").cast("int").alias("hits"), F.lit(False).alias("wanted"))
    every = wanted is None
    if every:  # one set of all tokens; those with few transactions have left before, so they are few; their order in the set is that of the rows
        order = data.select(F.posexplode("items").alias("i", "x")).groupBy("x").count().select(F.struct("count", "x").alias("s"))
        wanted = order.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]).alias("items"))
    rows = kept.unionByName(wanted.select("items", F.lit(0).alias("freq"), F.lit(0).alias("hits"), F.lit(True).alias("wanted"))).withColumn("prefix", none)
    found = []
    while True:
        rows = stash(rows.groupBy("prefix", "items", "wanted").agg(F.sum("freq").alias("freq"), F.sum("hits").alias("hits")), "searched")
        size, is_wanted = F.size("items"), F.col("wanted")
        sums = {"freq": F.sum("freq"), "hits": F.sum("hits"), "sets": F.count_if(~is_wanted), "widest": F.max(F.when(is_wanted, size)), "looks": F.sum(F.when(is_wanted, size))}
        sums["tokens"] = F.sum(F.when(~is_wanted, size))
        nodes, nodes_size = sized_stash(rows.groupBy("prefix").agg(*[c.alias(n) for n, c in sums.items()]).where((F.col("hits") >= least) & F.col("widest").isNotNull()), "nodes")
        sure = (F.size("prefix") > 0) & (F.col("hits") / F.col("freq") >= min_confidence)
        found.append(nodes.where(sure).select(F.array_sort("prefix").alias("need"), "hits", "freq"))
        large = F.col("sets") * F.col("widest") > CELLS
        # a part's wanted sets go to several tasks, each with the part's transactions, but these to no more than hold 4 * CELLS tokens in all
        pieces = F.greatest(F.lit(1), F.least(F.ceil(F.col("looks") / PIECE), F.floor(4 * CELLS / F.greatest("tokens", F.lit(1))))).cast("int")
        ends = small(nodes.where(~sure & ~large & (F.col("widest") > 0)).select("prefix", pieces.alias("pieces")), nodes_size)
        at = F.when(is_wanted, F.array(F.pmod(F.xxhash64("items"), F.col("pieces")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
        tasks = min(nodes.where(~sure & ~large).agg(F.sum(pieces)).first()[0] or 1, 2000)  # by number, as pieces are small in bytes but long in work
        parts = rows.join(ends, "prefix").withColumn("piece", F.explode(at)).repartition(tasks, "prefix", "piece").groupBy("prefix", "piece")
        found.append(stash(parts.applyInArrow(lambda t: _part(t, least, min_confidence, every), "need array<string>, hits long, freq long"), "found"))
        rest = nodes.where(~sure & large).select("prefix")
        if rest.isEmpty():
            break
        on = rows.join(small(rest, nodes_size), "prefix").select("prefix", "items", "wanted", "freq", "hits", F.posexplode("items").alias("i", "x"))
        rows = on.select(F.array_append("prefix", F.col("x")).alias("prefix"), F.expr("slice(items, i + 2, size(items))").alias("items"), "wanted", "freq", "hits")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("need").agg(F.first("hits").alias("hits"), F.first("freq").alias("freq"))
