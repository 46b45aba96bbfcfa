"""Importance resampling towards a target distribution: hashed n-gram gains and a seeded Gumbel draw, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Runs of this many words are features; their buckets are crc32 modulo BUCKETS.
SHORTEST, LONGEST = 1, 1
BUCKETS = 10_000
#: Documents with at least LEAST_WORDS words take part in the draw of PERCENT of their number.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a task fit into so many bits of monotonically_increasing_id.
_ROW_BITS = 33


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for a null one."""
    return F.coalesce(F.regexp_extract_all(F.translate(text.cast("string"), _UPPER, _LOWER), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def grams(own: Column, shortest: int, longest: int) -> Column:
    """All runs of shortest to longest consecutive words, joined by one space."""
    if shortest == longest == 1:
        return own

    def of(n: int) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " ")), F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(shortest, longest + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, name: str, shortest: int, longest: int, buckets: int) -> DataFrame:
    """bucket and the number of features in it: at most one row for each bucket leaves a task."""
    features = texts.select(F.explode(grams(words(F.col("text")), shortest, longest)).alias("feature"))
    return features.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a row for each bucket: floor(1000 ln) of its share of the target's features over its share of docs', both counted one more."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    for texts, name in ((docs, "s"), (target, "t")):
        every = every.join(bucket_counts(texts, name, shortest, longest, buckets), "bucket", "left")
    counts = materialize(every.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "gain-counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(`seed:doc_id`); a null doc_id is written as nothing."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gains: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """rid, doc_id, n_words, n_features, weight, score for each row of docs; rid is a number of this result alone.

    A row's features are summed within the task that reads it, so one row a document is shuffled; gains have a row for each bucket.
    """
    own = words(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("words"))
    rows = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), grams(F.col("words"), shortest, longest).alias("features"))
    each = rows.select("rid", "doc_id", "n_words", F.size("features").cast("long").alias("n_features"), F.explode_outer("features").alias("feature"))
    each = each.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(gains), "bucket", "left")
    summed = each.groupBy("rid", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    floored = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    out = summed.withColumn("weight", floored)
    return out.select("rid", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows with rank, their place (from 1) in a total order.

    Rows are dealt by ranges of the order, sorted within them and written with their places there; what
    stands before a range is a running sum over ranges, a row each, and joins by broadcast: there are as many as shuffle partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def draw(
    docs: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs: those drawn towards target's n-gram distribution are ranked 1, 2, 3, ..., the others have rank null.

    weight is the floored mean of the gains of a row's features, score adds a Gumbel variate of its
    doc_id. Of the N rows with at least least_words words the floor(percent * N / 100) highest scores are
    drawn; ties go to the smaller doc_id, a null one last, then to fewer features, then to the smaller
    weight; rows equal in all of these take the ranks in any order, which gives the same rows.

    Null, empty and blank texts have no words: weight 0, never drawn if least_words is above 0. Very long
    texts count whole. Repeated rows are rows of their own with one variate; a null doc_id draws that of an
    empty one. Columns besides doc_id and text play no part, whatever their names. An empty table gives an
    empty result, an empty target the same gains for buckets of one count.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = materialize(gain_table(slim, target.select(F.col("text").cast("string").alias("text")), shortest, longest, buckets), "gains")
    rows = materialize(scored(slim, gains, shortest, longest, buckets, seed), "draw-scores")
    able = F.col("n_words") >= least_words
    most = rows.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("rid").asc()]
    placed = ranked(rows.where(able), order, "draw-ranks").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT r, unnest(words) AS word FROM d),
v AS (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM b)),
x AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range((length(hex(word)) // 2)::BIGINT), lambda i: ('0x' || substr(hex(word), 2 * i::INT + 1, 2))::BIGINT),
    lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, steps),
s AS (SELECT bucket, count(*) AS n FROM w JOIN x USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN x USING (word) GROUP BY bucket),
g AS (SELECT x.bucket, floor(1000e0 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM x) x LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN x USING (word) JOIN g USING (bucket) GROUP BY r),
q AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000e0 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM o) * 10 // 100 THEN place END AS rank FROM q LEFT JOIN o USING (r)
"""
