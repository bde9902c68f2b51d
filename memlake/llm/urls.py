"""URL filters: fixed host and path rules first, mined association rules for the rest.

The method: labelled URLs become transactions of URL tokens plus a mark for a bad label; Spark's FP-growth finds the
token combinations that go with the mark; rules are kept by support and confidence, and a rule is dropped when a part
of its tokens is itself a rule. Each rule is filed under its rarest token, so a URL meets only the rules filed
under one of its own tokens, and all the rule's tokens are then looked for in it.

Combinations double with each token of a transaction, so tokens are weeded out first, and no rule is lost by it: a token that
goes with the mark too rarely is in no rule; one that is a rule by itself is in no wider one; of tokens that are always together
one stands for all (`_classes`), in rules as in the URLs that are judged. Where no transaction has over OPEN_TOKENS tokens then,
FP-growth takes them whole. Otherwise combinations grow token by token, and only those that may still be part of a rule: often
enough with the mark, no rule themselves, in fewer transactions than each of their parts. Even those can be exponentially many: where a
step would take over LISTED combinations a transaction on average, a search with bounds (`rulesearch`) takes over. It lists no
combinations, but finds for each set of tokens among the URLs to be judged one rule that it holds, or that it holds none. All ways
judge alike, by rules of any length.

Edge cases: a null URL, or one without "://", has an empty host and path and no tokens, so the default verdict
(allow). A very long URL is taken whole. Ties: of fixed rules of one length the smaller text wins; of tokens equally rare the
smaller one files a rule. Repeated rows each come back. With no labelled URL, no rule is mined. Null labels count as not bad.
Columns of the input other than the key and the URL are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.rulesearch import searched
from memlake.shared import ascii_lower, sized_stash, small, stash, table

#: The fixed rules: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
BAD = "label=bad"
#: Bad pages that a rule must have been seen on, however few pages have labels.
LEAST_HITS = 5
#: FP-growth sees whole transactions of up to so many open tokens.
OPEN_TOKENS = 14
#: Combinations a transaction, on average, that a step lists; beyond that rules are searched for each set of tokens instead.
LISTED = 1 << 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits; ties go to the smaller text."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [(F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p), h + p, v) for h, p, v in ordered]
    return F.coalesce(*[F.when(c, F.lit(t)) for c, t, _ in fits]), F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in fits])


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: the labels of its host, and the parts of its path with a letter."""
    heads = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    tails = F.transform(F.filter(F.split(path, r"[/.]"), lambda x: x.rlike("[A-Za-z]")), lambda x: F.concat(F.lit("p="), x))
    return F.array_distinct(F.concat(heads, tails))


def _classes(data: DataFrame, open_tokens: DataFrame, size: int) -> DataFrame:
    """(token, rep): each open token with the smallest of those that occur in just the same transactions.

    Sets of transactions are known by their size and two sums of their numbers' hashes.
    """
    spots = data.select("id", F.explode("items").alias("token")).join(small(open_tokens, size), "token")
    hashed = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"x{i}") for i in range(2)]
    sets = spots.groupBy("token").agg(F.count("*").alias("c"), *hashed)
    reps = sets.groupBy("c", "x0", "x1").agg(F.min("token").alias("rep"))
    return sets.join(reps, ["c", "x0", "x1"]).select("token", "rep")


def _frequent(data: DataFrame, n: int, least: int, min_confidence: float) -> DataFrame:
    """(need, hits, freq) of combinations of open tokens that go with the mark often enough, from rows (items, bad) of few tokens."""
    items = F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(max(least - 0.5, 0.5) / n, 1.0), minConfidence=min_confidence).fit(data.select(items.alias("items")))
    sets, size = sized_stash(model.freqItemsets, "itemsets")
    marked = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("need"), F.col("freq").alias("hits"))
    plain = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("need"), "freq")
    return marked.join(small(plain, size), "need")


def _grown(data: DataFrame, n: int, least: int, min_confidence: float) -> tuple[DataFrame, bool]:
    """The same for transactions of any width, but only the combinations no part of which is a rule or in just the same transactions; and
    whether these are all, as they are but where a step would take over LISTED combinations a transaction on average."""
    rows = data.select("items", "bad", F.posexplode("items").alias("i", "x")).select("items", "bad", "i", F.array("x").alias("need"))
    parts, k, found = None, 1, []
    while True:
        counted = rows.groupBy("need").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits")).where(F.col("hits") >= least)
        if parts is not None:
            one_less = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.filter("need", lambda _, at: at != j))
            of_part = counted.select("need", "freq", "hits", F.explode(one_less).alias("part")).join(parts, "part")
            counted = of_part.groupBy("need").agg(F.first("freq").alias("freq"), F.first("hits").alias("hits"), F.count("*").alias("c"), F.min("part_freq").alias("least")).where((F.col("c") == k) & (F.col("freq") < F.col("least"))).drop("c", "least")
        kept, size = sized_stash(counted, "itemsets")
        found.append(kept)
        parts = small(kept.where(F.col("hits") / F.col("freq") < min_confidence).select(F.col("need").alias("part"), F.col("freq").alias("part_freq")), size)
        open_ = rows.join(parts.select(F.col("part").alias("need")), "need", "left_semi")
        more = open_.agg(F.sum(F.size("items") - F.col("i") - 1)).first()[0] or 0
        if not more or more > n * LISTED:
            break
        wider = open_.select("bad", "items", "need", "i", F.posexplode(F.expr("slice(items, i + 2, greatest(size(items) - i - 1, 0))")).alias("j", "y"))
        rows, _ = sized_stash(wider.select("items", "bad", (F.col("i") + F.col("j") + 1).alias("i"), F.array_append("need", F.col("y")).alias("need")), "grown")
        k += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.array_sort("need").alias("need"), "hits", "freq"), not more


def _undecided(wanted: DataFrame, rules: DataFrame, rules_bytes: int) -> DataFrame:
    """Those `wanted` sets (items) that hold none of the rules (need)."""
    keyed = small(rules.select("need", F.col("need")[0].alias("key")), rules_bytes)
    held = wanted.select("items", F.explode("items").alias("key")).join(keyed, "key").where(F.size(F.array_except("need", "items")) == 0).select("items").distinct()
    return wanted.join(held, "items", "left_anti")


def _wanted(targets: DataFrame, sure: DataFrame, of_class: DataFrame, stored_bytes: int) -> DataFrame:
    """The distinct sets (items) of classes that `targets` (tokens) hold, of those that no single token decides."""
    marks = of_class.select("token", "s").unionByName(sure.select("token", F.lit(None).cast(of_class.schema["s"].dataType).alias("s")))
    spots = targets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(small(marks, stored_bytes), "token")
    sets = spots.groupBy("tokens").agg(F.bool_or(F.col("s").isNull()).alias("decided"), F.sort_array(F.collect_set("s")).alias("s"))
    return sets.where(~F.col("decided") & (F.size("s") > 1)).select(F.transform("s", lambda x: x["rep"]).alias("items")).distinct()


def _spelled_out(rules: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Each rule over representatives once for every choice of tokens that they stand for."""
    members = classes.groupBy("rep").agg(F.sort_array(F.collect_list("token")).alias("members"))
    one = rules.select("need", "hits", "freq", F.explode("need").alias("rep")).join(small(members, size), "rep")
    per = one.groupBy("need").agg(F.first("hits").alias("hits"), F.first("freq").alias("freq"), F.sort_array(F.collect_list("members")).alias("choices"))
    empty = F.array(F.array().cast("array<string>"))
    product = F.aggregate("choices", empty, lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda t: F.array_append(d, t)))))
    return per.select(F.explode(product).alias("need"), "hits", "freq").withColumn("need", F.array_sort("need"))


def mined(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_hits: int = LEAST_HITS, targets: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rules (need array of classes, key its rarest class, hits, freq, support, confidence) from rows (tokens, bad boolean), and the
    classes (token, rep) that they speak of: a rule matches where each of its classes has a token. With `targets` (tokens), rules enough
    to judge these: each that holds a rule holds one that is returned. Without, all rules that hold no other, which can be exponentially many."""
    spark = labelled.sparkSession
    rows = labelled.where((F.size("tokens") > 0) | F.col("bad")).select(F.monotonically_increasing_id().alias("id"), F.col("tokens").alias("items"), "bad")
    data, _ = sized_stash(rows, "transactions")
    n = data.count()
    if n == 0:
        return spark.createDataFrame([], "need array<string>, key string, hits long, freq long, support double, confidence double"), spark.createDataFrame([], "token string, rep string")
    least = max(math.ceil(min_support * n), least_hits, 1)
    counts = data.select(F.explode("items").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits")).where((F.col("hits") >= least) & (F.col("hits") > 0))
    counts, counts_size = sized_stash(counts, "tokens")
    sure = F.col("hits") / F.col("freq") >= min_confidence
    single = counts.where(sure).select(F.array("token").alias("need"), "hits", "freq")
    classes, classes_size = sized_stash(_classes(data, counts.where(~sure).select("token"), counts_size), "classes")
    of_rep = classes.join(small(counts.select("token", "freq"), counts_size), "token").select("token", F.struct("freq", "rep").alias("s"))  # rare ones first
    reps = of_rep.where(F.col("token") == F.col("s")["rep"])
    kept = data.select("id", "bad", F.explode_outer("items").alias("token")).join(small(reps, classes_size), "token", "left")
    cut, _ = sized_stash(kept.groupBy("id", "bad").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["rep"]).alias("items")).select("items", "bad"), "cut")
    is_rule = (F.size("need") > 1) & sure
    narrow = (cut.agg(F.max(F.size("items"))).first()[0] or 0) <= OPEN_TOKENS
    found, whole = (_frequent(cut, n, least, min_confidence), True) if narrow else _grown(cut, n, least, min_confidence)
    found, found_size = sized_stash(found.where(is_rule), "wide")
    if not whole:
        wanted = None if targets is None else stash(_undecided(_wanted(targets, counts.where(sure), of_rep, classes_size + counts_size), found, found_size), "wanted")
        found, found_size = sized_stash(found.unionByName(searched(cut, wanted, least, min_confidence).where(is_rule)).dropDuplicates(["need"]), "wide")
    part = small(found, found_size)
    if whole or targets is None:
        inner = part.select(F.explode("need").alias("one"), F.col("need").alias("part"))
        implied = part.select("need", F.explode("need").alias("one")).join(inner, "one").where((F.size("part") < F.size("need")) & (F.size(F.array_except("part", "need")) == 0)).select("need").distinct()
        part = part.join(implied, "need", "left_anti")
    rules, rules_size = sized_stash(single.unionByName(part.select("need", "hits", "freq")), "rules")
    rarest = rules.select("need", "hits", "freq", F.explode("need").alias("one")).join(small(counts.select(F.col("token").alias("one"), F.col("freq").alias("one_freq")), counts_size), "one")
    keyed = rarest.groupBy("need").agg(F.min_by("one", F.struct("one_freq", "one")).alias("key"), F.first("hits").alias("hits"), F.first("freq").alias("freq")).withColumns({"support": F.col("hits") / n, "confidence": F.col("hits") / F.col("freq")})
    used = rules.select(F.explode("need").alias("rep")).distinct()
    of_class = classes.join(small(used, rules_size), "rep", "left_semi").select("token", "rep")
    return keyed, of_class.unionByName(single.select(F.col("need")[0].alias("token"), F.col("need")[0].alias("rep")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_hits: int = LEAST_HITS) -> DataFrame:
    """mined() for reading: each rule (need, support, confidence) spelled out for every choice of tokens of its classes, which can be many."""
    rules, classes = mined(labelled, min_support, min_confidence, least_hits)
    classes, size = sized_stash(classes, "rule-classes")
    spelled = _spelled_out(rules, classes, size)
    n = F.col("hits") / F.col("freq")
    return spelled.select("need", n.alias("confidence"), "hits", "freq")


def mined_hits(urls: DataFrame, rules: DataFrame, rules_bytes: int, classes: DataFrame, classes_bytes: int) -> DataFrame:
    """Of distinct `urls` (url, tokens), those that some rule matches. Only tokens that rules speak of are looked at."""
    seen = urls.select("url", F.explode("tokens").alias("token")).join(small(classes, classes_bytes), "token").groupBy("url").agg(F.collect_set("rep").alias("reps"))
    found = seen.select("url", "reps", F.explode("reps").alias("key")).join(small(rules.select("key", "need"), rules_bytes), "key")
    return found.where(F.size(F.array_except("need", "reps")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict for every row of `pages`; a page's label is that with the same id."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(key), "url").withColumns({"host": host, "path": path})
    bad = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("_k")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    labelled = rows.join(bad, rows[key] == bad["_k"]).select(tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
    urls = rows.where(F.col("url").isNotNull()).select("url", "host", "path").distinct().select("url", tokens(F.col("host"), F.col("path")).alias("tokens"))
    rules_found, classes = mined(labelled, targets=urls)
    filed = *sized_stash(rules_found, "url_rules"), *sized_stash(classes, "url_classes")
    hits, hits_bytes = sized_stash(mined_hits(urls, *filed).select(F.col("url").alias("_u"), F.lit(True).alias("_hit")), "url_hits")
    text, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    by_mining = F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(small(hits, hits_bytes), rows["url"] == hits["_u"], "left").select(key, "host", "path", text.alias("rule"), F.coalesce(verdict, by_mining).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    case = lambda i: "CASE " + " ".join(f"WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[i]}'" for h, p, v in ordered) + " END"
    toks = """list_distinct(list_concat(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h=' || x),
        list_transform(list_filter(regexp_split_to_array(path, '[/.]'), lambda x: regexp_matches(x, '[A-Za-z]')), lambda x: 'p=' || x)))"""
    return f"""
WITH RECURSIVE r AS (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
t AS (SELECT page_id, url, host, path, {toks} AS tokens FROM p),
l AS (SELECT doc_id, max(coalesce(toxic = 1 OR quality = 0, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT row_number() OVER () AS id, tokens, bad FROM t JOIN l ON l.doc_id = t.page_id WHERE len(tokens) > 0 OR bad),
n AS (SELECT greatest(ceil({MIN_SUPPORT} * count(*)), {LEAST_HITS}) AS least FROM x),
i AS (SELECT id, unnest(tokens) AS k, bad FROM x),
c AS (SELECT k, count(*) FILTER (WHERE bad) / count(*) >= {MIN_CONFIDENCE} AS sure FROM i, n GROUP BY k, least HAVING count(*) FILTER (WHERE bad) >= least),
o AS (SELECT id, bad, list_sort(list(k)) AS items FROM i JOIN c USING (k) WHERE NOT sure GROUP BY id, bad),
s AS (SELECT id, bad, items, CAST(0 AS BIGINT) AS last, CAST([] AS VARCHAR[]) AS need FROM o
      UNION ALL SELECT id, bad, items, j, list_append(need, items[j]) FROM (SELECT id, bad, items, need, unnest(range(last + 1, len(items) + 1)) AS j FROM s)),
g AS (SELECT need FROM s, n WHERE len(need) > 1 GROUP BY need, least HAVING count(*) FILTER (WHERE bad) >= least AND count(*) FILTER (WHERE bad) / count(*) >= {MIN_CONFIDENCE}
      UNION ALL SELECT [k] FROM c WHERE sure),
h AS (SELECT DISTINCT url FROM t WHERE EXISTS (SELECT 1 FROM g WHERE list_has_all(t.tokens, g.need)))
SELECT page_id, host, path, {case(0)} AS rule,
  coalesce({case(1)}, CASE WHEN url IN (SELECT url FROM h) THEN 'block' ELSE 'allow' END) AS verdict FROM t
"""


SQL = _sql()
