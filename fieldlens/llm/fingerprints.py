"""Bottom-k sketches of five-word shingles, by DataFrame expressions alone.

A text's sketch is the ``k`` least of its different shingle hashes, in order; with at most ``k`` shingles it is the whole set and
every estimate is exact.  Sketches of parts merge into the sketch of the whole.  Words are what stands between ASCII white
space, in lower case; a text with one to four words has its word sequence as its only shingle.  Null counts as empty, and an
empty text has an empty sketch: two of them are alike (1), one and another aren't (0).  Equal texts have equal sketches,
whatever else differs.  Rows with equal ids follow each other by their text.  A null id comes before all others.
Very long texts are taken whole.  Other columns are left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 256
WORDS = 5
#: Hashes are cut to so many bits, which 12 hexadecimal digits show.
BITS = 48


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """An array with a hash for each shingle, repeated ones too."""
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at(h, i + j) for j in range(words)]), 64 - BITS))
        one = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(n >= words, runs).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return bind(hashed, of)


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit(""))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / (F.element_at(a, -1) + F.lit(1.0)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both texts."""

    def of(u: Column) -> Column:
        common = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1)))
        return F.when(F.size(u) == 0, 1.0).otherwise(common / F.size(u))

    return bind(merge(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as a string."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id``, ``fingerprint`` (the sketch) and ``n_shingles`` (estimated) of every document."""
    rows = docs.select("doc_id", sketch(F.col("text"), k).alias("fingerprint"))
    return rows.withColumn("n_shingles", distinct_count(F.col("fingerprint"), k))


def up_to(bounds: Column, n: int, key: Column) -> Column:
    """How many of ``n`` ascending bounds are at most the key, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document against its edited text and against the next document.

    Documents are dealt into id ranges whose bounds are ids that occur, so no range is empty and the document after a range's last
    is the first of the next.  The texts move once; a range is sorted and walked by one task, and only as many first documents
    as there are ranges are read a second time.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, least = rows.agg(F.count("*"), F.min("key")).first()
    ranges = min(20_000, max(256, n // 5000))
    bounds = sorted({least, *map(int, rows.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])}) if n else [0]
    cuts = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 1000 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    part = up_to(cuts, len(bounds), F.col("key"))
    order = Window.partitionBy("part").orderBy("key", "text")
    first = spark.createDataFrame([(b, (i or len(bounds))) for i, b in enumerate(bounds)], "key bigint, part int")  # part: the range before
    heads = rows.join(F.broadcast(first), "key").groupBy("part").agg(F.min("text").alias("head"))
    near = (
        rows.withColumn("part", part)
        .repartition("part")
        .withColumn("a", sketch(F.col("text"), k))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("next_a", F.lead("a").over(order))
    )
    heads = heads.withColumn("head_a", sketch(F.col("head"), k)).withColumnRenamed("part", "head_part")
    near = near.join(heads, (F.col("part") == F.col("head_part")) & F.col("next").isNull(), "left")
    size = F.length("text")
    near = near.select(
        "doc_id",
        size.cast("bigint").alias("n_chars"),
        "a",
        F.coalesce("next_a", "head_a").alias("next_a"),
        F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(coalesce(next, head), 1, int(length(text) div 4))")).alias("edited"),
    ).withColumn("e", sketch(F.col("edited"), k))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("a")).alias("fingerprint"),
        text_of(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("next_a"), k).alias("near_next"),
    )
