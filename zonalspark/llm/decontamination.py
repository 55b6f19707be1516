"""Benchmark decontamination (operator 9): winnowing, by DataFrame and SQL functions only.

Of each SELECT consecutive hashes of GRAM words the least is kept, so a shared span of GRAM + SELECT - 1 = 13 words or
more always keeps a hash that benchmark and document have in common. Such hits are extended to whole windows by
comparing words. Items of fewer words than a window are looked up by the hash of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import read, stored

WINDOW, GRAM = 13, 5
SELECT = WINDOW - GRAM + 1
#: Up to so many distinct benchmark hashes are held as a set in the plan; beyond, hashes meet in a shuffled join.
IN_PLAN = 50_000
#: Benchmark windows that may be broadcast (about 200 bytes each); beyond, the join is shuffled.
BROADCAST = 100_000


def words(text: Column) -> Column:
    """Lower-cased A-Z (no other letter), cut at ASCII characters that aren't letters or digits. Null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def up_to(last: Column) -> Column:
    """0 .. last, empty if last < 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def gram_hash(of: str, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(F.col(of), i + j) for j in range(k)))


def held_as(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once: a plain one is put in the place of each mention of it, and lambdas
    would work it out again for each element. A generator of one row isn't."""
    return rows.select(*rows.columns, F.explode(F.array(value)).alias(name))


def hashed(rows: DataFrame) -> DataFrame:
    """rows(words) with wh, a hash of each word, and grams, a hash of each run of GRAM words."""
    rows = held_as(rows, "wh", F.transform("words", lambda w: F.xxhash64(w)))
    return held_as(rows, "grams", F.transform(up_to(F.size("words") - GRAM), lambda i: gram_hash("wh", i, GRAM)))


def winnowed(grams: str) -> Column:
    """The least hash of each SELECT consecutive ones."""
    return F.array_distinct(F.transform(up_to(F.size(grams) - SELECT), lambda i: F.array_min(F.slice(grams, i + 1, SELECT))))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """window (words), w1 and w2 (a wide hash of it), n (their number), hash and offset: its least gram hash and where the
    gram begins (for fewer words than WINDOW: the hash of all of them, and 0); and w1, w2, item: who holds it."""
    rows = held_as(benchmark.select(F.col(item).cast("string").alias("item"), text), "words", words(F.col(text))).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    every = rows.select("item", F.explode(F.transform(up_to(F.size("words") - n), lambda i: F.slice("words", i + 1, n))).alias("words"))
    wide = (F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(9), "words").alias("w2"))
    held = every.select(*wide, "item").distinct()
    items = hashed(every.select("words").distinct()).withColumn("n", F.size("words"))
    least = F.array_min("grams")
    full = F.col("n") == WINDOW
    found = items.select(F.col("words").alias("window"), *wide, "n", F.when(full, least).otherwise(F.xxhash64("n", "words")).alias("hash"), F.when(full, F.array_position("grams", least).cast("int") - 1).otherwise(0).alias("offset"))
    return found, held


def found_positions(short: list[int], held: dict[int, list[int]] | None) -> Column:
    """struct(n, at, hash) of each gram of the document (and run of n words, for each n of short) that may begin a hit;
    held: the benchmark's hashes by n."""

    def structs(n: int, hashes: Column, keep) -> Column:
        every = F.transform(hashes, lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("at"), h.alias("hash")))
        return F.filter(every, lambda x: keep(x["hash"]))

    inside = lambda n: (lambda h: h.isin(held[n])) if held else (lambda h: F.lit(True))
    # Only grams whose hash winnowing kept somewhere in the document
    parts = [structs(WINDOW, F.col("grams"), lambda h: F.array_contains(F.col("kept"), h))]

    def run_hashes(n: int) -> Column:
        return F.transform(up_to(F.size("words") - n), lambda i: F.xxhash64(F.lit(n), F.slice("words", i + 1, n)))

    parts += [structs(n, run_hashes(n), inside(n)) for n in short]
    return F.concat(*parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A window is WINDOW consecutive words of an item, or all of an item of fewer words. Null and empty texts have no
    words, so no hits (items_sha256 is then the digest of the empty string); empty tables give no rows or no hits;
    repeated rows of docs stay; repeated items count once for each item id. Other columns are not read.

    One pass over the texts; of its rows those with a benchmark hash carry their words on (written to the shared
    folder), all others only their counts. Hits of a document meet in one group, bounded by its length, its items in another,
    bounded by their number; what windows occur and who holds a window are kept as pairs."""
    bench, holders = (stored(x, name) for x, name in zip(windows(benchmark, item, item_text), ("windows", "holders"), strict=True))
    short = sorted(r.n for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect())  # 12 at most
    n_hashes = bench.select("n", "hash").distinct().count()
    held: dict[int, list[int]] | None = None
    if n_hashes <= IN_PLAN:
        held = {n: [] for n in [*short, WINDOW]}
        for r in bench.select("n", "hash").distinct().collect():
            held[r.n].append(r.hash)
    rows = hashed(held_as(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), text), "words", words(F.col(text))).drop(text))
    if held is not None:
        rows = held_as(rows, "kept", F.filter(winnowed("grams"), lambda h: h.isin(held[WINDOW])))
        rows = held_as(rows, "hits", found_positions(short, held))
        rows = stored(rows.select("row", key, F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, F.col("words")).alias("words"), "hits"), "hits")
        spans = rows.where(F.size("hits") > 0).select("row", "words", F.explode("hits").alias("hit")).select("row", "words", "hit.*")
    else:
        rows = held_as(rows, "kept", winnowed("grams"))
        rows = stored(rows.select("row", key, F.size("words").cast("long").alias("n_words"), "words", found_positions(short, None).alias("hits")), "hits")
        seen = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(bench.select("n", "hash").distinct(), ["n", "hash"])
        spans = seen.join(rows.select("row", "words"), "row")
    small = bench.count() <= BROADCAST
    every = F.broadcast(bench) if small else bench
    at = F.col("at") - F.col("offset")
    same = spans.join(every, ["n", "hash"]).where((at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.col("n")) == F.col("window")))
    same = stored(same.select("row", at.alias("a"), (at + F.col("n")).alias("b"), "w1", "w2"), "same")
    covered = same.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    who = F.broadcast(holders) if holders.count() <= BROADCAST else holders
    named = same.select("row", "w1", "w2").distinct().join(who, ["w1", "w2"]).select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    counts = covered.select("row", F.aggregate("spans", start, step, lambda s: s["n"]).cast("long").alias("n_hit")).join(named, "row")
    out = rows.select("row", key, "n_words").join(counts, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(key, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
