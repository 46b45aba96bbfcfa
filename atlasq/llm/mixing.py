"""Mixing sources to target weights with histograms of hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_name, keyed, materialize
from .target_draw import ranked

WEIGHTS = (5, 2, 1)
#: Targets add up to this many percent of all words, and none is above CAP times its source's words.
TOTAL_PERCENT = 150
CAP = 2
HASH_BITS = 60
#: Bits of the hash that a histogram resolves: a source has 2**12 buckets at most, however hot it is.
FIRST_BITS, STEP_BITS = 12, 12


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, a hash of the text and the part of the scan for each row, and what more asks for. A null text has size 0."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(text), F.lit("")).alias("t"),
        F.spark_partition_id().alias("part"),
        *more,
    )


def hashed(sizes: DataFrame) -> DataFrame:
    """sizes (written) with i, a number among rows of one doc_id, text and source, and h, a 60-bit hash of doc_id, text and i.

    Rows equal in all three take different hashes, so a part of them can be taken. They're numbered within each part of
    the scan and the parts' numbers are added up, so no task has all of a large group. Which of them gets which number makes no difference.
    """
    same = ["doc_id", "t", "source"]
    parts = sizes.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*same).orderBy("part")) - F.col("n")).alias("before")
    later = parts.select(*(F.col(c).alias(f"p_{c}") for c in (*same, "part")), before).where("before > 0")
    inner = F.row_number().over(Window.partitionBy(*same, "part").orderBy(F.lit(0)))
    joined = sizes.withColumn("i", inner).join(later, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*same, "part")], "left")
    numbered = joined.withColumn("i", F.col("i") + F.coalesce("before", F.lit(0))).drop("before", *(f"p_{c}" for c in (*same, "part")))
    return numbered.withColumn("h", row_hash(F.col("doc_id"), F.col("t"), F.col("i")))


def row_hash(doc_id: Column, t: Column, i: Column) -> Column:
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), t, i.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares of TOTAL_PERCENT of all words by weight, stopping at CAP times each source's words.

    The excess of a stopped source goes to the others by weight: those whose cap the common level reaches stop, the
    level of the rest rises, and so on until no more stop. Places of sources in their order, which tell their weights,
    are counted by ranges and a round is a sum over all sources, so they may be as many as hosts; rounds are few, as a stop changes the level of all the rest.
    """
    by_source = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = ranked(by_source, [F.col("source").asc_nulls_last()], "mix-places")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    w = materialize(placed.select("source", "source_size", weight.alias("weight")), "mix-weights")
    whole = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    budget, cap = whole["words"] * (TOTAL_PERCENT / 100.0), F.col("source_size") * float(CAP)
    level = budget / whole["weight"] if whole["weight"] else 0.0
    while True:
        stops = cap <= F.lit(level) * F.col("weight")
        spent = w.where(stops).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        rest = whole["weight"] - spent["weight"]
        higher = (budget - spent["words"] * float(CAP)) / rest if rest else level
        if higher <= level:
            break
        level = higher
    return w.select("source", "source_size", F.when(stops, cap).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """For each source the hash value below which rows are taken once more than the whole rounds.

    rounds = floor(target / source_size) takes of every row; what is left of the target is a budget.
    Words are summed by source and hash bucket; the running sums tell the bucket in which the budget
    ends, and only that bucket's rows are summed again by the next bits, until all bits are used.
    The rows below the threshold then hold at most the budget, and the next hash value would exceed it; its rows are taken
    too if the mix then ends nearer to the budget. So a source misses its target by half the words of one hash value at most.
    """
    todo = aims.where("source_size > 0").select("source", "source_size", "target", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP)).cast("long").alias("rounds"))
    state = todo.select("source", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("low"))
    done, rows = 0, sizes.where("size > 0").select("source", "h", "size")
    while done < HASH_BITS:
        bits = min(FIRST_BITS if not done else STEP_BITS, HASH_BITS - done)
        done += bits
        width = 1 << (HASH_BITS - done)
        histogram = rows.groupBy("source", F.shiftright("h", HASH_BITS - done).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        joined = histogram.join(state.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        summed = joined.withColumn("upto", F.sum("words").over(run))
        over = summed.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("words")).alias("budget"), "rounds", "words")).alias("x"))
        # a budget that no bucket exceeds takes every row: its source's threshold is past the last hash
        last = (F.col("x.words") < 2 * F.col("x.budget")).cast("long") if done == HASH_BITS else F.lit(0)
        new = over.select("source", F.col("x.rounds").alias("rounds"), F.col("x.budget").alias("budget"), (F.col("x.bucket") * F.lit(width) + last).alias("low"))
        kept = state.join(new.select(F.col("source").alias("again")), F.col("source").eqNullSafe(F.col("again")), "left_anti").where(f"low = {1 << HASH_BITS}" if done > FIRST_BITS else "true")
        full = kept.select("source", "rounds", "budget", F.lit(1 << HASH_BITS).alias("low")) if done == FIRST_BITS else kept
        state = materialize(new.unionByName(full), f"mix-state{done}")
        if done < HASH_BITS:
            inside = state.where(f"low < {1 << HASH_BITS}").select("source", F.shiftright("low", HASH_BITS - done).alias("bucket"))
            inside = inside.withColumnRenamed("source", "own")
            rows = materialize(rows.join(inside, F.col("source").eqNullSafe(F.col("own")) & (F.shiftright("h", HASH_BITS - done) == F.col("bucket")), "left_semi"), f"mix-rows{done}")
    return state.select("source", "rounds", "low")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Rows are taken by a hash of doc_id, text and, among rows of one doc_id, text and source, a number; so
    rows without a doc_id, or with one in common, are taken one by one, and a third of all rows being
    copies of each other doesn't move a source from its target. A null doc_id is a value like any other and a
    null source is a source of its own, the last one. Empty and null texts have size 0 and 0 words taken; very
    long ones count whole, so one that is larger than twice what is left of a budget is left out. An empty table
    gives an empty result. Whole rows are taken: never more than CAP times.
    """
    sizes = materialize(hashed(materialize(sized(docs), "mix-sizes")), "mix")
    aims = materialize(targets(sizes), "mix-targets")
    low = thresholds(sizes, aims).select(F.col("source").alias("own"), "rounds", "low")
    both = aims.withColumnRenamed("source", "of").join(low, F.col("of").eqNullSafe(F.col("own")), "left").drop("own")
    out = sizes.join(both, F.col("source").eqNullSafe(F.col("of")))
    takes = F.least(F.coalesce("rounds", F.lit(0)) + (F.col("h") < F.coalesce("low", F.lit(0))).cast("long"), F.lit(CAP))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * takes).alias("taken"), takes.alias("takes"), "source", "h")


#: Numbers of repeated rows are broadcast up to so many; more are joined by shuffling the documents.
BROADCAST_ROWS = 500_000


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix has them: each as often as it is taken. Nulls, repeated rows and the rest as in mix().

    Only rows that repeat a doc_id, text and source need their number, which is joined by the row's place in a
    written copy; without such rows the documents are read once more and not shuffled at all.
    """
    rid, own, h, rounds, low, copy, i = (free_name(docs, n) for n in ("_rid", "_own", "_h", "_rounds", "_low", "_copy", "_i"))
    raw = materialize(sized(docs), "mix-sizes")
    if raw.groupBy("doc_id", "t", "source").count().where("count > 1").limit(1).count():
        docs_read = keyed(docs, "mix-docs", rid)
        raw = materialize(sized(docs_read, F.col(rid)), "mix-sizes")
        sizes = materialize(hashed(raw), "mix")
        again = materialize(sizes.where("i > 1").select(F.col(rid), F.col("i").alias(i)), "mix-numbers")
        again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        marked = docs_read.join(again, rid, "left").withColumn(i, F.coalesce(i, F.lit(1)))
    else:
        sizes = materialize(raw.withColumn("i", F.lit(1)).withColumn("h", row_hash(F.col("doc_id"), F.col("t"), F.lit(1))), "mix")
        marked = docs.withColumn(i, F.lit(1))
    aims = materialize(targets(sizes), "mix-targets")
    cut = thresholds(sizes, aims).select(F.col("source").alias(own), F.col("rounds").alias(rounds), F.col("low").alias(low))
    marked = marked.withColumn(h, row_hash(F.col("doc_id").cast("long"), F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")), F.col(i)))
    out = marked.join(cut, F.col("source").cast("string").eqNullSafe(F.col(own)))
    takes = F.least(F.col(rounds) + (F.col(h) < F.col(low)).cast("long"), F.lit(CAP)).cast("int")
    copies = F.when(takes > 0, F.sequence(F.lit(1), takes)).otherwise(F.array().cast("array<int>"))
    return out.withColumn(copy, F.explode(copies)).select(*docs.columns)


SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''), (row_number() OVER (PARTITION BY doc_id, text, source))::VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM g),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5e0 - coalesce(sum(source_size) OVER r, 0)::DOUBLE * 2e0)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0e0)) AS level FROM w
    WINDOW r AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, source_size::DOUBLE * 2e0 <= level * weight AS stops FROM l),
t AS (SELECT source, source_size, CASE WHEN stops THEN source_size::DOUBLE * 2e0
    ELSE (SELECT min({'a': source_size::DOUBLE / weight, 'level': level}) FROM f WHERE NOT stops).level * weight END AS target FROM f),
p AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2)::BIGINT ELSE 0 END AS rounds
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, h) AS words,
    target - rounds * source_size AS budget FROM p)
SELECT doc_id, size, source_size, target,
    size * least(rounds + CASE WHEN upto <= budget OR upto - words <= budget AND words < 2 * (budget - (upto - words)) THEN 1 ELSE 0 END, 2)::BIGINT AS taken FROM c
"""
