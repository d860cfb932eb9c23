"""Mixing sources to target weights by weighted fair queueing (DataFrame code only).

Sources share the total number of words by weight; a target stops at
``max_epochs`` times its source's size and the excess is shared again by weight.
Every document, shuffled inside its source by a hash of its id, gets a virtual
finish time: the words of its source up to and including it, divided by the
source's target; the e-th repetition finishes one source size later. All
(document, repetition) items are put in the order of virtual finish time and cut
where the total budget ends.

No task ever holds a whole source. The running sums inside a source are taken
over hash buckets (``16 ** BUCKET_DIGITS`` a source) plus the sums of the earlier
buckets, and the cut is found in two histograms of virtual time and, at last, in
the few items of one histogram slot.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; a source without words has target 0; rows
that repeat an id with the same source and size finish together and are taken or
left together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
BUCKET_DIGITS = 3
#: Slots a unit of virtual time in the first histogram, and a slot in the second.
SLOTS = 1024
TOP_SLOT = 8 * SLOTS
SEED = "mix:"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document: the one pass over the texts."""
    return docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"))


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, repeating, over the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((at - 1) % WEIGHT_CYCLE + 1).cast("long"))


def targets(sizes: DataFrame, weigh=cycle_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source.

    Water filling in closed form: in the order of cap over weight, the level is
    what is left to share over the weights left; it rises while sources are capped
    and falls after, so its maximum is the level at which no source is above its cap.
    """
    own = weigh(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    cap = F.col("source_size") * max_epochs
    before = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    with_level = own.withColumn("left_share", left.cast("double") / weights_left.cast("double"))
    level = F.max("left_share").over(everything)
    return with_level.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).select("source", "source_size", "target")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def virtual_time(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds source_size, target, ``shuffle_key`` and ``finish_words`` (words of the
    source up to and including the document) to doc_id, source, size."""
    keyed = sizes.withColumn("source_key", _source_key(F.col("source"))).withColumn("shuffle_key", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("bucket", F.substring("shuffle_key", 1, BUCKET_DIGITS))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.join(shares.select(_source_key(F.col("source")).alias("source_key"), "source_size", "target"), "source_key").select("source_key", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("source_key", "bucket").orderBy("shuffle_key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.withColumn("running", F.sum("size").over(inside))
    return running.join(offsets, ["source_key", "bucket"]).withColumn("finish_words", F.col("offset") + F.col("running")).drop("bucket", "offset", "running")


def finish_time(epoch: Column) -> Column:
    """Virtual finish time of the given repetition (0 first)."""
    return (epoch.cast("long") * F.col("source_size") + F.col("finish_words")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))


def _items(timed: DataFrame, max_epochs: int) -> DataFrame:
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    return timed.filter("size > 0 and target > 0").select("*", epochs).withColumn("finish", finish_time(F.col("epoch")))


ORDER = ("finish", "shuffle_key", "doc_id", "size")


def cut(items: DataFrame, budget: int):
    """(finish, shuffle_key, doc_id, size) of the last item within the budget in the
    global order; None where every item fits."""
    used, slot = 0, None
    fine = [F.least(F.floor(F.col("finish") * SLOTS), F.lit(TOP_SLOT)), F.floor((F.col("finish") * SLOTS - F.floor(F.col("finish") * SLOTS)) * SLOTS)]
    for slot_of in fine:
        sums = items.groupBy(slot_of.alias("slot")).agg(F.sum("size").alias("words"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("slot")) + F.lit(used))
        crossing = upto.filter(F.col("upto") > budget).agg(F.min(F.struct("slot", "upto", "words")).alias("at")).first()["at"]
        if crossing is None:
            return None
        used, slot = crossing["upto"] - crossing["words"], crossing["slot"]
        items = items.filter(slot_of == slot)
    order = [F.col(c) for c in ORDER]
    upto = items.withColumn("upto", F.sum("size").over(Window.orderBy(*order)) + F.lit(used))
    first_left = upto.filter(F.col("upto") > budget).agg(F.min(F.struct(*order)).alias("at")).first()["at"]
    return first_left


def _is_before(first_left, finish: Column) -> Column:
    if first_left is None:
        return finish.isNotNull()
    own = F.struct(finish.alias("finish"), *[F.col(c) for c in ORDER[1:]])
    edge = F.struct(F.lit(first_left["finish"]).alias("finish"), F.lit(first_left["shuffle_key"]).alias("shuffle_key"), F.lit(first_left["doc_id"]).cast("long").alias("doc_id"), F.lit(first_left["size"]).cast("long").alias("size"))
    return finish.isNotNull() & (own < edge)


def mix(docs: DataFrame, weigh=cycle_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken, finish_words of every
    row of ``docs``; ``repeats`` is how often the mix takes the document."""
    sizes = common.materialize(sized(docs), "mix-sizes")
    timed = virtual_time(sizes, targets(sizes, weigh, max_epochs))
    budget = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    edge = cut(_items(timed, max_epochs), budget)
    repeats = F.lit(0)
    for epoch in range(max_epochs):
        repeats = repeats + ((F.col("size") > 0) & F.coalesce(_is_before(edge, finish_time(F.lit(epoch))), F.lit(False))).cast("int")
    return timed.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken", "finish_words")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken, range-sorted
    by virtual finish time; only the columns of ``docs``."""
    plan = mix(docs).filter("repeats > 0").select(F.col("doc_id").alias("_id"), _source_key(F.col("source")).alias("_source"), F.col("size").alias("_size"), "source_size", "target", "repeats", "finish_words").distinct()
    inner, names = common.set_aside(docs, "doc_id", "source", "text")
    keys = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (_source_key(F.col("source")) == F.col("_source")) & (common.n_words(F.col("text")) == F.col("_size"))
    taken = inner.join(plan.hint("shuffle_hash"), keys).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    return taken.orderBy(finish_time(F.col("_epoch")), "doc_id").select(*names)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{common.WORD_PATTERN}')), 0) AS BIGINT) AS size FROM documents),
own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {WEIGHT_CYCLE} + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS} * source_size) OVER earlier, 0) AS DOUBLE)
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS left_share
  FROM own
  WINDOW earlier AS (ORDER BY CAST({MAX_EPOCHS} * source_size AS DOUBLE) / weight, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, source_size, least(CAST({MAX_EPOCHS} * source_size AS DOUBLE), max(left_share) OVER () * weight) AS target FROM levels),
timed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, md5('{SEED}' || CAST(d.doc_id AS VARCHAR)) AS shuffle_key,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}' || CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size) AS BIGINT) AS finish_words
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
items AS (
  SELECT *, CAST(e * source_size + finish_words AS DOUBLE) / target AS finish
  FROM timed, (SELECT unnest(range({MAX_EPOCHS})) AS e) WHERE size > 0 AND target > 0),
ranked AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffle_key, doc_id, size) AS upto FROM items),
used AS (
  SELECT doc_id, size, source_size, finish_words, count(DISTINCT e) AS repeats FROM ranked
  WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(u.repeats, 0) * t.size AS BIGINT) AS taken
FROM timed t LEFT JOIN used u USING (doc_id, size, source_size, finish_words)
"""
