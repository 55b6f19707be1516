"""Document fingerprints (operator 7): canonical exact digest, by DataFrame and SQL functions only.

A text is normalised (NFKC), case-folded and its white space folded; two 64-bit xxhashes of that make a 128-bit
bucket, and inside equal buckets texts group by comparison of their bytes. A fingerprint is like another (1.0) only if
the canonical texts are equal byte for byte, else 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalspark.llm.common import keyed_text, read

#: Neighbours are found inside ranges of about so many bytes; fewest and most ranges (the driver holds a bound of each); bytes
#: for each task, small enough to be sorted in memory.
RANGE, LEAST, MOST, SHARE = 4 << 20, 32, 100_000, 16 << 20
#: Columns of the order of rows.
ORDER = ("none", "down", "h1", "h2")


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), white-space runs as one space, none at the ends."""

    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)  # normalisation leaves these as they are
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(nfkc(folded)), r"(?U)[\s\x1c-\x1f]+", " "))


def buckets(canon: Column) -> tuple[Column, Column]:
    """The two halves of the wide hash; the second has another seed."""
    return F.xxhash64(canon), F.xxhash64(F.lit(7), canon)


def hexed(halves: tuple[Column, Column]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2, digest, class_id (smallest key), n_copies: a row for each distinct canonical text.

    Equal texts meet in map-side aggregation first, so a text that a third of all rows hold moves once a task."""
    rows = keyed_text(docs, key, text).select(key, canonical(F.col("text")).alias("canon"))
    h1, h2 = buckets(F.col("canon"))
    grouped = rows.select(key, "canon", h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2", "canon").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return grouped.select("h1", "h2", F.sha2("canon", 256).alias("digest"), "class_id", "n_copies")


def bounds_of(rows: DataFrame, ranges: int) -> list[str]:
    """The first order of each of so many ranges (fewer if they are few) of about as many rows, as JSON, in order. Only
    orders move, and only these firsts reach the driver."""
    cut = rows.select("at.*").repartitionByRange(ranges, *ORDER).select(F.spark_partition_id().alias("part"), F.struct(*ORDER).alias("at"))
    return [r.at for r in cut.groupBy("part").agg(F.min("at").alias("least")).orderBy("least").select(F.to_json("least").alias("at")).collect()]


def range_of(at: str, bounds: Column, n: int) -> Column:
    """Number of the last of n bounds that isn't above `at`, by binary search."""

    def step(s: Column, _: Column) -> Column:
        half = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(bounds, half) <= F.col(at)
        return F.struct(F.when(up, half + 1).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(half).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), lambda s, x: F.when(s["low"] < s["high"], step(s, x)).otherwise(s))
    return found["low"] - 1


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, canon, next_text, next_canon: each row beside the next one in descending key order, after the last
    the first. Null keys come last; ties of the key, null ones too, go by hashes of the text.

    Rows are dealt into ranges of this order, cut by what is there, so sparse, repeated or null keys make no large
    range (only equal rows stay together); the head of each range also goes to the range before it, as its last row. No
    window is wider than a range."""
    rows = keyed_text(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("at", F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.bitwise_not(F.col(key)), F.lit(0)).alias("down"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2")))
    firsts = bounds_of(rows, min(MOST, max(LEAST, -(-size // RANGE))))
    n = max(1, len(firsts))
    bounds = F.from_json(F.lit("[" + ",".join(firsts) + "]"), "array<struct<none:boolean,down:bigint,h1:bigint,h2:bigint>>")
    own = rows.withColumn("range", range_of("at", bounds, len(firsts)))
    here = F.struct(F.col("range"), F.lit(0).alias("moved"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.lit(1).alias("moved"))
    heads = F.when(F.get(bounds, F.col("range")) == F.col("at"), F.array(here, before)).otherwise(F.array(here))
    both = own.select(key, "text", "at", F.explode(heads).alias("to")).select(key, "text", "at", "to.*").repartition(max(LEAST, -(-size // SHARE)), "range").withColumn("canon", canonical(F.col("text")))
    within = Window.partitionBy("range").orderBy("moved", "at")
    return both.select(key, "text", "canon", "moved", F.lead("text").over(within).alias("next_text"), F.lead("canon").over(within).alias("next_canon")).where("moved = 0").drop("moved")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_chars, fingerprint, class_id and n_copies of its exact class, and the same for its edited text.

    A null text is an empty one; an empty table gives no rows; a single document is its own next one; repeated rows
    stay. Other columns are not read."""
    rows = with_next(docs, key, text).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))")).withColumn("edited_canon", canonical(F.col("edited")))
    h1, h2 = buckets(F.col("canon"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    marked = edited.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        h1.alias("h1"),
        h2.alias("h2"),
        F.sha2("canon", 256).alias("digest"),
        hexed(buckets(F.col("edited_canon"))).alias("edited_fingerprint"),
        same("canon", "edited_canon").alias("near_edited"),
        same("canon", "next_canon").alias("near_next"),
    )
    joined = marked.join(exact_classes(docs, key, text), ["h1", "h2", "digest"])
    return joined.select(key, "n_chars", "edited_sha256", hexed((F.col("h1"), F.col("h2"))).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "class_id", "n_copies")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
