"""Quality rules with risk-controlled cutoffs.  DataFrame functions only.

``features`` counts what the rules look at.  ``cutoffs`` learns, for each stratum
and rule, a cutoff from labelled holdout documents: a candidate is admissible if
the exact binomial test rejects "this rule takes more than its share of the good
documents" at a level divided by the number of all tests (Bonferroni), so with
probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents to all rules together.  Of the admissible candidates the one that takes
most of the bad documents is used, the mildest of equals; a rule without an
admissible candidate that takes any bad document stays out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import WORD_SEPARATORS, materialize

#: Words in a window, and the least number of words of a document.
WINDOW, LEAST_WORDS = 8, 20
#: Most per cent of words in repeated windows.
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"
#: rule: (counted column, candidate cutoffs per 1000 words); a document with more is rejected.
RULES = {
    "symbols": ("n_symbols", (5, 10, 20, 50, 100, 200, 300, 500)),
    "dup_lines": ("n_dup_lines", (2, 5, 10, 20, 30, 50, 100, 200)),
    "repeats": ("n_repeat_words", (10, 20, 50, 75, 100, 150, 200, 250)),
    "word_length": ("word_chars", (6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000)),
}
#: Most of a stratum's good documents that may be lost, and the risk that more are.
ALPHA, DELTA = 0.02, 0.05


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the array."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def at(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            # a start adds the words up to the next start, eight at most
            step = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + 1) - x))
            return F.aggregate(let(starts, step), F.lit(0), lambda a, x: a + x)

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, at))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n > WINDOW, let(hashes, covered)).otherwise(0)


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the columns ``keep``.

    A null or empty text has no words; all counts are 0 and base_failed is true.
    Repeated rows are counted each on its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("__text", WORD_SEPARATORS), "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", *keep, text.alias("__text")).withColumns({"__words": words, "__lines": lines})
    w, long = F.col("__words"), "long"
    rows = rows.select(
        "doc_id",
        *keep,
        F.size(w).cast(long).alias("n_words"),
        F.length(F.array_join(w, "")).cast(long).alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast(long).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast(long).alias("n_dup_lines"),
        repeated_words(w).cast(long).alias("n_repeat_words"),
    )
    n = F.col("n_words")
    return rows.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n))


def per_mille(column: str) -> Column:
    return F.floor(1000 * F.col(column) / F.greatest(F.col("n_words"), F.lit(1))).cast("long")


def at_most(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly term by term in logarithms; 1 where k is over the mean."""
    odds = math.log(p / (1 - p))

    def term(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + odds
        most = F.greatest(acc["s"], t)
        return F.struct(t.alias("t"), (most + F.log1p(F.exp(F.least(acc["s"], t) - most))).alias("s"))

    first = n * math.log(1 - p)
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), F.struct(first.alias("t"), first.alias("s")), term, lambda a: F.exp(a["s"]))
    return F.when(k > n * p, 1.0).otherwise(tail)


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, good, lost, taken from ``rows`` (features with a column stratum) and labels (doc_id, quality).

    Only labelled rows that pass the base rules count; a null label counts as none,
    of several labels of a document the least.  Without labels no row comes out.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.where(~F.col("base_failed")).join(marks, "doc_id")
    sums = [F.sum((per_mille(c) > x).cast("long")).alias(f"{rule}:{x}") for rule, (c, grid) in RULES.items() for x in grid]
    each = materialize(held.groupBy("stratum", (F.col("quality") == 1).alias("is_good")).agg(F.count(F.lit(1)).alias("n"), *sums), "quality-counts")
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).cast("long").alias("cutoff"), F.col(f"`{r}:{x}`").alias("k")) for r, (_, g) in RULES.items() for x in g])
    flat = each.select("stratum", "is_good", "n", F.explode(grid).alias("g")).select("stratum", "is_good", "n", "g.*")
    both = flat.groupBy("stratum", "rule", "cutoff").agg(
        F.coalesce(F.sum(F.when(F.col("is_good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("is_good"), F.col("k"))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.when(~F.col("is_good"), F.col("k"))), F.lit(0)).alias("taken"),
    )
    tests = each.select("stratum").distinct().count() * sum(len(g) for _, g in RULES.values())
    p = at_most(F.col("good"), F.col("lost"), alpha / len(RULES))
    fine = both.where((F.col("taken") > 0) & (p * tests <= delta))
    best = F.max_by(F.struct("cutoff", "good", "lost", "taken"), F.struct("taken", "cutoff")).alias("b")
    return fine.groupBy("stratum", "rule").agg(best).select("stratum", "rule", "b.*")


#: Rows of cutoffs that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def judge(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` with kept: false where base_failed or where a rule's count is over its stratum's cutoff."""
    chosen = materialize(chosen, "quality-cutoffs")
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])
    if chosen.count() <= BROADCAST_ROWS:
        wide = F.broadcast(wide)
    over = F.lit(False)
    for r, (c, _) in RULES.items():
        over = over | F.coalesce(per_mille(c) > F.col(f"max_{r}"), F.lit(False))
    return rows.join(wide, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over).drop(*[f"max_{r}" for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features and verdict of every row of ``docs`` with the columns ``keep``; strata are the values of lang (null: "")."""
    rows = docs.withColumn("stratum", F.coalesce(F.col("lang"), F.lit("")))
    rows = materialize(features(rows, ("stratum", *keep)), "quality-features")
    return judge(rows, cutoffs(rows, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    # under other names, so that no column of docs is taken for a feature
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c != "doc_id"}
    rows = judged(docs.withColumns({v: F.col(c) for c, v in names.items()}), labels, tuple(names.values()))
    return rows.where("kept").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def oracle() -> str:
    """The same rows as DuckDB SQL over documents and labels."""
    value = lambda c: f"CAST(floor(1000.0 * {c} / greatest(n_words, 1)) AS BIGINT)"
    a = ALPHA / len(RULES)
    grid = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {x} AS cutoff, count(*) AS n, sum(CAST({value(c)} > {x} AS BIGINT)) AS k FROM held GROUP BY ALL" for r, (c, g) in RULES.items() for x in g)
    over = " OR ".join(f"coalesce({value(c)} > max_{r}, false)" for r, (c, _) in RULES.items())
    wide = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS max_{r}" for r in RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT row_number() OVER () AS id, doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT id, i, w[i:i + 7] AS win FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM parts WHERE len(w) >= 8)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY id),
counted AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (id)),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT b.*, quality = 1 AS good FROM based b JOIN marks USING (doc_id) WHERE NOT base_failed),
grid AS ({grid}),
both_ AS (
  SELECT stratum, rule, cutoff, coalesce(sum(n) FILTER (good), 0) AS good, coalesce(sum(k) FILTER (good), 0) AS lost,
    coalesce(sum(k) FILTER (NOT good), 0) AS taken FROM grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN lost > good * {a} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(lost AS BIGINT) + 1),
    lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({a}) + (good - i) * ln(1 - {a})))) END
    * (SELECT count(DISTINCT stratum) * {sum(len(g) for _, g in RULES.values())} FROM held) AS p FROM both_),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (taken, cutoff)) AS cutoff FROM tested WHERE taken > 0 AND p <= {DELTA} GROUP BY ALL),
wide AS (SELECT stratum, {wide} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM based LEFT JOIN wide USING (stratum)"""
