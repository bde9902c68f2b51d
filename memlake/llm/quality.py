"""Quality rules by document and by host.

Every document gets counted features and rule failures. Failures are added up by host (`source`) and each host's failure
rate is shrunk towards an empirical beta prior fitted to all hosts by moments. A host is rejected for a rule if the 95 percent
lower bound of its posterior rate is over HOST_RATIO times the hosts' mean rate, that limit kept within HOST_LIMITS: so a few
failures never cost a host its clean documents, however rare the rule. The verdict is joined back to its documents.

Edge cases: null or empty text has no words, so base_failed is true. A very long text is judged whole, in one task. A null host
has no evidence and is never rejected. Ties: a bound equal to the limit doesn't reject. Repeated rows each count and each
come back. An empty table gives an empty result. Other columns of the input are ignored by `features` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.words import SPACES, words, words_sql
from memlake.shared import let, sized_stash, small, stash, table

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: A host's limit: so many times the mean rate, but no less and no more than these.
HOST_RATIO, HOST_LIMITS = 3.0, (0.2, 0.5)
#: Standard deviations from the posterior mean to its lower bound of 95 percent.
BOUND = 1.645
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
RULES = ("fail_base", "fail_symbols", "fail_lines", "fail_length")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in `w`."""

    def covered(h: Column) -> Column:
        def at(s: Column) -> Column:
            n = F.size(s)
            again = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"]))
                | ((k + 1 < n) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])),
            )
            spots = F.sort_array(F.transform(again, lambda k: F.get(s, k)["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                spots,
                start,
                lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
                lambda a: a["n"],
            )

        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(tagged, at))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """`docs` with one more column _f, a struct of the counted features."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = (
        docs.withColumn("_t", F.coalesce("text", F.lit("")))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))))
    )
    # Generated, so that no filter on _f is pushed below and computed again inside lambdas.
    return counted.select(*docs.columns, F.explode(F.array(
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
            (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.col("_l.n").cast("long").alias("n_lines"),
            F.col("_l.d").cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("_w")).alias("n_repeat_words"),
        )
    )).alias("_f"))


def _base_failed(f: str) -> Column:
    return (F.col(f"{f}n_words") < MIN_WORDS) | (100 * F.col(f"{f}n_repeat_words") > 50 * F.col(f"{f}n_words"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counted features of every row, without its text."""
    return with_features(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_f.*").withColumn("base_failed", _base_failed(""))


def failures(feats: DataFrame) -> DataFrame:
    """Adds a 0/1 column for each rule."""
    return feats.withColumns(
        {
            "fail_base": F.col("base_failed").cast("int"),
            "fail_symbols": (10 * F.col("n_symbols") > F.col("word_chars")).cast("int"),
            "fail_lines": (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).cast("int"),
            "fail_length": ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))).cast("int"),
        }
    )


def host_verdicts(feats: DataFrame) -> DataFrame:
    """A row for each host: its documents, failures by rule, shrunk rates, and whether it is rejected.

    The prior of a rule is Beta(m * k, (1 - m) * k): m is the mean of the hosts' rates, k follows from their variance,
    within PRIOR_WEIGHT. Two numbers a rule reach the driver.
    """
    hosts = failures(feats).where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in RULES])
    rates = [F.col(r) / F.col("n") for r in RULES]
    row = hosts.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(rates)], *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(rates)]).first()
    shrunk, over = [], []
    for i, r in enumerate(RULES):
        m, v = row[f"m{i}"] or 0.0, row[f"v{i}"] or 0.0
        k = min(max(m * (1 - m) / v - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if v > 0 else PRIOR_WEIGHT[1]
        rate = (F.col(r) + m * k) / (F.col("n") + k)
        spread = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (F.col("n") + k + 1))
        shrunk.append(rate.alias(f"rate_{r}"))
        over.append(rate - BOUND * spread > min(max(HOST_RATIO * m, HOST_LIMITS[0]), HOST_LIMITS[1]))
    return hosts.select("*", *shrunk, F.greatest(*[x.cast("int") for x in over]).cast("boolean").alias("host_rejected"))


def judged(docs: DataFrame) -> DataFrame:
    """features() with host_rejected and kept. Features are stored once; host verdicts come from the stored rows."""
    feats, _ = sized_stash(features(docs), "quality")
    bad, size = sized_stash(host_verdicts(feats).where("host_rejected").select("source", "host_rejected"), "hosts")
    return (
        feats.join(small(bad, size), "source", "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that pass, with all their columns.

    One pass over the texts: rows that pass by themselves are stored whole, the others as their features alone. Host
    verdicts come from the features, and the stored rows of rejected hosts are left out.
    """
    rows = with_features(docs.select(F.struct("*").alias("_row"), "source", "text")).select("_row", "source", "_f.*").withColumn("base_failed", _base_failed(""))
    rows = stash(rows.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "source", "base_failed", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"), "judged")
    bad, size = sized_stash(host_verdicts(rows).where("host_rejected").select(F.col("source").alias("_s")), "hosts")
    return rows.where("NOT base_failed").join(small(bad, size), rows["source"] == bad["_s"], "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def _sql() -> str:
    prior = ", ".join(f"avg({r} / n) AS m_{r}, var_pop({r} / n) AS v_{r}" for r in RULES)
    lo, hi = PRIOR_WEIGHT
    weight = ", ".join(f"m_{r}, CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {lo}), {hi}) ELSE {hi} END AS k_{r}" for r in RULES)
    rate = ", ".join(f"(h.{r} + p.m_{r} * p.k_{r}) / (h.n + p.k_{r}) AS q_{r}, h.n + p.k_{r} + 1 AS w_{r}, least(greatest({HOST_RATIO} * m_{r}, {HOST_LIMITS[0]}), {HOST_LIMITS[1]}) AS l_{r}" for r in RULES)
    over = " OR ".join(f"q_{r} - {BOUND} * sqrt(greatest(q_{r} * (1 - q_{r}), 0) / w_{r}) > l_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, doc_id, source, text, {words_sql("text")} AS w FROM d),
t AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM t) WHERE c > 1),
rw AS (SELECT uid, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY uid),
f AS (SELECT w.doc_id, w.source, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(w.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w) w
      LEFT JOIN rw ON rw.uid = w.uid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
x AS (SELECT *, CAST(base_failed AS INT) AS fail_base, CAST(10 * n_symbols > word_chars AS INT) AS fail_symbols,
        CAST(10 * n_dup_lines > 3 * n_lines AS INT) AS fail_lines,
        CAST(word_chars < 2 * n_words OR word_chars > 12 * n_words AS INT) AS fail_length FROM b),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum({r}) AS {r}" for r in RULES)} FROM x WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT {weight} FROM (SELECT {prior} FROM h)),
v AS (SELECT source FROM (SELECT source, {rate} FROM h, p) WHERE {over})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  v.source IS NOT NULL AS host_rejected, NOT base_failed AND v.source IS NULL AS kept
FROM b LEFT JOIN v ON v.source = b.source
"""


SQL = _sql()
