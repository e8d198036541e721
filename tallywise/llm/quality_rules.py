"""Quality rules with risk-controlled cutoffs, in built-in Spark functions.

Every whole text gets counts (words, symbols, repeated lines, repeated word
triples). A document fails the base rule when it is short or mostly repetition.
Further rules compare a rate with a cutoff of the document's stratum (its
language). Cutoffs are chosen on labelled documents so that good ones are
seldom rejected:

* Half of the labelled documents (by crc32 of the id) propose candidates: upper
  quantiles of the rate among good documents.
* The other half certifies them. Per stratum and rule the candidates are tried
  from the loosest on. A candidate passes when the exact binomial probability of
  as few false rejections as were seen, were the true rate ``max_false_rejection
  / number of rules``, is at most ``error / (strata * rules)``; the first one that
  fails ends the sequence. Fixed-sequence testing needs no correction inside a
  sequence, Bonferroni corrects across them, and the union over rules keeps the
  false rejection of a stratum below ``max_false_rejection`` with probability
  ``1 - error``.

A stratum with too few labels has no certified cutoff and loses nothing beyond
the base rule. Nulls: a null text has no words, a null language is a stratum of
its own, a null id is never a labelled one. A labelled document that occurs
twice counts twice. Empty input gives an empty result. Very long texts are
handled in one row; windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Rates of which a high value is bad; integers, so that quantiles are exact.
RULES = {
    "symbol_rate": "n_symbols * 1000 div n_words",
    "dup_line_rate": "n_dup_lines * 1000 div n_lines",
    "repeat_rate": "n_repeat_words * 1000 div n_words",
    "capital_rate": "n_capitals * 1000 div word_chars",
    "shout_rate": "n_shouts * 1000 div n_words",
    "word_length": "word_chars * 100 div n_words",
}
QUANTILES = (1.0, 0.9995, 0.999, 0.998, 0.997, 0.996, 0.995, 0.994, 0.992, 0.99)
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05

#: Words of the 3-word windows that occur twice or more, each word once:
#: window hashes are sorted with their places, neighbours of equal hash give the
#: places, and each place adds the words that the one before has not covered.
_REPEATED = """
CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
  aggregate(
    sort_array(array_distinct(flatten(transform(
      array(sort_array(arrays_zip(windows, sequence(0, size(windows) - 1)))),
      s -> filter(
        flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1),
          (a, b) -> IF(a.windows = b.windows, array(a.`1`, b.`1`), array(-1)))),
        p -> p >= 0))))),
    struct(0L AS n, -3 AS last),
    (acc, p) -> struct(acc.n + least(3, p - acc.last) AS n, p AS last),
    acc -> acc.n)
END
"""


def counts(docs: DataFrame, carried: str | None = None) -> DataFrame:
    """One row per document: the counts, the rates and the base verdict; ``carried`` is handed on as it is."""
    also = {carried: docs.schema[carried].dataType} if carried else {}
    df = pick(docs, {"doc_id": "long", "text": "string", "lang": "string", **also})
    df = df.select(
        *also, "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce("lang", F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    df = df.select(
        *also, "doc_id", "text_hash", "stratum",
        F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("CAST(regexp_count(text, '[#*$%&|<>]') AS LONG)").alias("n_symbols"),
        F.expr("CAST(regexp_count(text, '[A-Z]') AS LONG)").alias("n_capitals"),
        F.expr("CAST(regexp_count(text, '!') AS LONG)").alias("n_shouts"),
    )
    df = df.select(
        *also, "doc_id", "text_hash", "stratum", "n_symbols", "n_capitals", "n_shouts",
        F.expr("CAST(size(words) AS LONG)").alias("n_words"),
        F.expr("CAST(length(array_join(words, '')) AS LONG)").alias("word_chars"),
        F.expr("CAST(size(lines) AS LONG)").alias("n_lines"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS LONG)").alias("n_dup_lines"),
        F.expr("""
            IF(size(words) < 3, CAST(array() AS ARRAY<LONG>),
               zip_with(zip_with(slice(words, 1, size(words) - 2), slice(words, 2, size(words) - 2),
                                 (a, b) -> struct(a, b)),
                        slice(words, 3, size(words) - 2), (p, c) -> xxhash64(p.a, p.b, c)))
        """).alias("windows"),
    )
    df = df.withColumn("n_repeat_words", F.expr(_REPEATED)).drop("windows")
    df = df.withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    )
    return df.select("*", *(F.expr(f"IF(n_words = 0, 0L, {v})").alias(k) for k, v in RULES.items()))


def binomial_tail(n: str, k: str, rate: float) -> str:
    """SQL for P(Bin(n, rate) <= k), summed exactly in logarithms."""
    odds = f"ln({rate!r}D / (1 - {rate!r}D))"
    first = f"{n} * ln(1 - {rate!r}D)"
    return f"""
    CASE WHEN {k} >= {n} * {rate!r}D THEN 1D
    WHEN {k} = 0 THEN exp({first})
    ELSE aggregate(
      sequence(1L, {k}),
      struct({first} AS term, {first} AS total),
      (acc, i) -> struct(
        acc.term + ln(({n} - i + 1) / i) + {odds} AS term,
        greatest(acc.total, acc.term + ln(({n} - i + 1) / i) + {odds})
          + log1p(exp(-abs(acc.total - acc.term - ln(({n} - i + 1) / i) - {odds}))) AS total),
      acc -> exp(acc.total))
    END
    """


def cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    max_false_rejection: float = MAX_FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """Certified cutoff per stratum and rule: ``stratum, rule, cutoff``."""
    good = pick(labels, {"doc_id": "long", "quality": "int"}).where("quality = 1 AND doc_id IS NOT NULL")
    rows = (
        counted.where("NOT base_failed").join(good.select("doc_id"), "doc_id")
        .select(
            "stratum",
            F.expr("pmod(crc32(CAST(doc_id AS STRING)), 2) = 1").alias("certifies"),
            F.expr("inline(array(" + ", ".join(
                f"named_struct('rule', '{k}', 'rate', {k})" for k in RULES) + "))"),
        )
        .groupBy("stratum", "certifies", "rule", "rate").agg(F.count("*").alias("n"))
    )
    quantiles = ", ".join(f"{q}D" for q in QUANTILES)
    proposed = (
        rows.where("NOT certifies").groupBy("stratum", "rule")
        .agg(F.expr(f"percentile(rate, array({quantiles}), n)").alias("q"))
        .select("stratum", "rule", F.explode(F.expr("transform(q, x -> CAST(ceil(x) AS LONG))")).alias("cutoff"))
        .distinct()
    )
    tried = (
        proposed.join(rows.where("certifies"), ["stratum", "rule"])
        .groupBy("stratum", "rule", "cutoff")
        .agg(F.sum("n").alias("n"), F.sum(F.expr("IF(rate > cutoff, n, 0L)")).alias("k"))
    )
    sequences = tried.select("stratum").distinct().agg((F.count("*") * len(RULES)).alias("sequences"))
    passed = (
        tried.join(F.broadcast(sequences))  # one row
        .withColumn("p", F.expr(binomial_tail("n", "k", max_false_rejection / len(RULES))))
        .withColumn("fails", F.expr(f"p > {error!r}D / sequences"))
    )
    # The sequence runs from the loosest cutoff down and ends at the first failure.
    first_failure = F.expr("max(IF(fails, cutoff, NULL)) OVER (PARTITION BY stratum, rule)")
    return (
        passed.withColumn("failed_at", first_failure)
        .where("failed_at IS NULL OR cutoff > failed_at")
        .groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    )


def judge(docs: DataFrame, labels: DataFrame, carried: str | None = None, **risk: float) -> DataFrame:
    """Per document the counts, ``base_failed``, the rules broken and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.save(counts(docs, carried), "counts")
    limits = cutoffs(counted, labels, **risk)
    wide = limits.groupBy("stratum").agg(*(
        F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"most_{k}") for k in RULES
    ))
    wide = scratch.save(wide, "cutoffs")
    broken = F.array_compact(F.array(*(
        F.when(F.col(k) > F.col(f"most_{k}"), F.lit(k)) for k in RULES
    )))
    return (
        counted.join(wide, "stratum", "left")
        .withColumn("broken", broken)
        .withColumn("kept", F.expr("NOT base_failed AND size(broken) = 0"))
        .drop(*(f"most_{k}" for k in RULES))
    )


def keep_good(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """``docs`` without the rows that are rejected, all columns unchanged.

    Rows go through the verdict whole, so texts are not joined or shuffled.
    """
    names = docs.columns
    row = "row" + "_" * max(map(len, names))  # a name that docs has not
    whole = docs.withColumn(row, F.struct(*(F.col(f"`{c}`") for c in names)))
    kept = judge(whole, labels, carried=row, **risk).where("kept")
    return kept.select(*(F.col(row)[c].alias(c) for c in names))
