"""Quality rules with risk-controlled thresholds (DataFrame code only).

``measure`` computes word, symbol, line and repetition counts of whole texts.
``certify`` turns labelled documents into cutoffs for each stratum (language). The
rules and cutoffs form one fixed path of ``STEPS`` settings: the first rule's cutoffs from
lax to strict, then, with these kept, the second rule's, and so on. Each setting rejects
what the ones before it reject, and the hypothesis "this setting rejects more than
``RISK`` of the good documents" is tested with the exact binomial tail of the false
rejections among the labelled good documents. Hypotheses on a path are tested in its
order, up to the first that stands, so they need no correction; strata share ``DELTA``
(Bonferroni). With probability 1 - ``DELTA`` every stratum loses at most ``RISK`` of its
good documents to all rules together.

The path is fixed before any label is seen, so all labelled rows are holdout.

Defined cases: a null or empty text has no words and fails the base rule; a very long
text is measured whole; a null language is a stratum of its own; null ids are measured
and have no label; a document with several labels is good if all of them say 1; unlabelled
and null-labelled rows take no part in the test; repeated ids are measured and judged row
by row; an empty label table certifies nothing, an empty document table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RISK = 0.03
DELTA = 0.05
#: Rule: (numerator, denominator); a document is rejected where
#: 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500)
#: The path: (rule, cutoff) of each step.
PATH = tuple((rule, cut) for rule in RULES for cut in sorted(CUTOFFS, reverse=True))
STEPS = len(PATH)
#: Thresholds of at most so many strata are broadcast.
BROADCAST_STRATA = 10_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(windows: Column) -> Column:
    """Number of words that lie in windows whose hash occurs more than once."""

    def starts(pairs: Column) -> Column:
        same = lambda k, own: F.coalesce(F.get(pairs, k)["hash"] == own, F.lit(False))
        twice = F.transform(pairs, lambda p, k: F.when(same(k - 1, p["hash"]) | same(k + 1, p["hash"]), p["at"]))
        return F.array_sort(F.filter(twice, lambda at: at.isNotNull()))

    def words(at: Column) -> Column:
        reach = F.transform(at, lambda a, k: F.least(F.coalesce(F.get(at, k + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)

    pairs = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("hash"), k.alias("at"))))
    return _let(_let(pairs, starts), words)


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)
    and base_failed to ``docs``. An 8-word window is compared by its 64-bit hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("_words", common.words(F.col("text")))
    split = split.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(common.SPACE_CHARS)) != ""))
    counted = split.withColumn("n_words", F.size("_words").cast("long"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(F.col("_words"), k, WINDOW)))
    counted = counted.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    counted = counted.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(F.lit(0).cast("long")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Always true, but not deterministic to the optimizer: else a filter on the verdict
    # would be pushed below and repeat the measuring inside its own lambdas.
    failed = failed & (F.monotonically_increasing_id() >= 0)
    return counted.withColumn("base_failed", failed).drop("_words", "_lines", "_windows")


def _log_gamma(x: Column) -> Column:
    """log Gamma for x > 0 (Stirling's series at x + 8; relative error below 1e-12)."""
    z = x + 8
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Binomial(n, alpha) <= k); 1 where k is not below the mean. From k down, the
    terms fall; they are added until they are far below double precision."""
    n, k = n.cast("double"), k.cast("double")
    at_k = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    odds = (1 - alpha) / alpha
    steps = F.sequence(F.lit(0), F.least(k, 40 * F.sqrt(k) + 40).cast("int"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, down: Column) -> Column:
        j = k - down
        return F.struct((acc["term"] * j / (n - j + 1) * odds).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    total = F.aggregate(steps, zero, step)["sum"]
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(F.exp(at_k) * total)


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def _over(rule: str, cutoff) -> Column:
    above, below = RULES[rule]
    return 1000 * F.col(above) > cutoff * F.col(below)


def first_step() -> Column:
    """Number, from 1, of the first step of the path that rejects the document; null where
    none does."""
    by_rule = []
    for rule in RULES:
        own = None
        for step, (of, cut) in enumerate(PATH, 1):
            if of == rule:
                own = F.when(_over(rule, cut), step) if own is None else own.when(_over(rule, cut), step)
        by_rule.append(own)
    return F.least(*by_rule)


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and ``steps``, how many steps of the path are certified in it, from doc_id,
    lang and the measures, and from labels (doc_id, quality)."""
    good = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held_out = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    counts = held_out.groupBy(_stratum().alias("stratum"), first_step().alias("step")).agg(F.count("*").alias("n"))
    counts = common.materialize(counts, "quality-counts")
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("all"))
    level = delta / max(1, sizes.count())
    # At most STEPS rows a stratum: what the path has rejected up to each step.
    lost = F.sum("n").over(Window.partitionBy("stratum").orderBy("step"))
    tested = counts.filter("step IS NOT NULL").withColumn("lost", lost).join(sizes, "stratum")
    stands = tested.filter(binomial_tail(F.col("all"), F.col("lost"), risk) > level).groupBy("stratum").agg(F.min("step").alias("stop"))
    enough = F.pow(F.lit(1 - risk), F.col("all")) <= level
    return sizes.join(stands, "stratum", "left").filter(enough).select("stratum", F.coalesce(F.col("stop") - 1, F.lit(STEPS)).alias("steps")).filter("steps > 0")


def judge(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``kept`` to measured documents."""
    cuts = common.materialize(thresholds, "quality-cutoffs").select(F.col("stratum").alias("_stratum"), F.col("steps").alias("_steps"))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    joined = measured.withColumn("_stratum", _stratum()).join(cuts, "_stratum", "left")
    rejected = F.coalesce(first_step() <= F.col("_steps"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "_steps")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``. The texts
    are measured twice, once for the thresholds and once for the verdict, so that no
    text is shuffled."""
    narrow = common.materialize(measure(common.bare(docs, "doc_id", "lang", "text")).drop("text"), "quality-measures")
    inner, names = common.set_aside(docs, "doc_id", "lang", "text")
    return judge(measure(inner), certify(narrow, labels)).filter("kept").select(*names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    measured = common.materialize(measure(docs).drop("text"), "quality-measures")
    verdict = judge(measured, certify(measured, common.table(spark, sf_dir, "labels")))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    over = lambda rule, cut: f"1000 * {RULES[rule][0]} > {cut} * {RULES[rule][1]}"
    by_rule = ["CASE " + " ".join(f"WHEN {over(rule, cut)} THEN {step}" for step, (of, cut) in enumerate(PATH, 1) if of == rule) + " END" for rule in RULES]
    return rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{common.WORD_PATTERN}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{common.WORD_PATTERN}')) AS lines
  FROM documents),
numbered AS (SELECT row_number() OVER () AS row_id, * FROM split),
windows AS (
  SELECT row_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT row_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM numbered)),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, h) AS n FROM windows) WHERE n > 1),
reach AS (SELECT row_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY row_id ORDER BY i) - i, {WINDOW})) AS r FROM twice),
covered AS (SELECT row_id, sum(r) AS n FROM reach GROUP BY row_id),
measured AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered LEFT JOIN covered c USING (row_id)),
based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         least({", ".join(by_rule)}) AS step FROM measured),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held_out AS (SELECT lang, step FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
sizes AS (SELECT lang, count(*) AS n FROM held_out GROUP BY lang),
level AS (SELECT {DELTA} / count(*) AS p FROM sizes),
lost AS (SELECT lang, step, sum(count(*)) OVER (PARTITION BY lang ORDER BY step) AS k FROM held_out WHERE step IS NOT NULL GROUP BY lang, step),
stands AS (
  SELECT l.lang, min(step) AS stop FROM lost l JOIN sizes s ON l.lang IS NOT DISTINCT FROM s.lang, level
  WHERE k >= n * {RISK} OR list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) > p
  GROUP BY l.lang),
certified AS (
  SELECT s.lang, coalesce(stop - 1, {STEPS}) AS steps FROM sizes s LEFT JOIN stands t ON s.lang IS NOT DISTINCT FROM t.lang, level
  WHERE pow(1 - {RISK}, n) <= p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM certified c WHERE c.lang IS NOT DISTINCT FROM b.lang AND b.step <= c.steps) AS kept
FROM based b
"""


OP4_SQL = _sql()
