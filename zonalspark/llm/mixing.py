"""Mixing sources to target weights (operator 12): weighted fair queueing.

Each source's documents are shuffled by a hash and get a virtual finish time: the words of the source up to their end,
over the source's target; a second and a third pass over a source follow the first. All copies are then put in one order
of finish times through range partitions, and the order is cut where the whole budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import read, stored
from zonalspark.llm.running import offsets, placed, ranges, running

WEIGHTS, PASSES = (1, 2, 3), 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES, budget: int | None = None) -> DataFrame:
    """grp, source_size, target of each source of sizes(grp, source_size), written.

    Sources in order of grp take weights in turn and share budget (None: the sum of all sizes, never more than passes times
    that) by them; no target passes `passes` times its source's size, and what is over is shared again by weight. Shares are
    a level times the weight; the level rises as sources are capped, and each round sums up two numbers."""
    ordered = running(sizes.withColumn("all", F.lit("")).withColumn("one", F.lit(1).cast("long")), "all", ["grp"], "one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    own = stored(ordered.select("grp", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * passes).alias("cap")), "mix-sources")
    total, most = own.agg(F.sum("source_size"), F.sum("cap")).first()
    budget = min(most or 0, total if budget is None else budget) if total else 0
    level, before = 0.0, -1.0
    while level != before:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        capped, left = own.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (budget - (capped or 0)) / left if left else level
    share = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    return own.select("grp", "source_size", share.alias("target"))


def queue(rows: DataFrame, goals: DataFrame, passes: int = PASSES) -> DataFrame:
    """rows(grp, mark, row_key, size, ...) of size over 0, a copy for each pass, with source_size, target, first (the words
    of the source before the document), pass_no and finish. Rows of a source are in order of mark."""
    ranged = ranges(rows, "grp", ["mark", "row_key", "size"], "size")
    held = stored(offsets(ranged, "grp", "size").join(goals, "grp").drop("total"), "mix-offsets")
    out = placed(ranged, held, "grp").withColumnRenamed("before", "first").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return out.withColumn("finish", F.try_divide((F.col("pass_no") * F.col("source_size") + F.col("first") + F.col("size")).cast("double"), F.col("target")))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", group: str = "source", weights: Sequence[int] = WEIGHTS, passes: int = PASSES, budget: int | None = None) -> DataFrame:
    """row_key, grp, size, source_size, target, first, pass_no, finish, start and taken of every copy that may be in the mix:
    start counts the words before it in the order of finish times, and it is taken if it ends within the budget.

    By then every source has had at least what a target without its last document holds, so it is short of its target by
    less than one document, and what all are short of goes on by weight. grp is the source with a 0 before it, or 1 for
    null; documents without words have one row, with a null finish, that isn't taken. Null and repeated keys stay as they
    are, rows with the same key and size are alike; an empty table gives no rows; other columns are not read."""
    size, name = words(F.col(text)), F.coalesce(F.concat(F.lit("0"), F.col(group).cast("string")), F.lit("1"))
    rows = stored(docs.select(name.alias("grp"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("-"))).alias("mark"), F.col(key).alias("row_key"), size.alias("size")), "mix-rows")
    goals = targets(rows.groupBy("grp").agg(F.sum("size").alias("source_size")), weights, passes, budget)
    most = int(round(goals.agg(F.sum("target")).first()[0] or 0))
    copies = queue(rows.where("size > 0"), goals, passes).withColumn("all", F.lit(""))
    line = running(copies, "all", ["finish", "grp", "mark", "row_key", "pass_no"], "size").drop("all", "mark", "total")
    line = line.withColumnRenamed("before", "start").withColumn("taken", (F.col("start") + F.col("size") <= most) & F.col("finish").isNotNull())
    small = goals.limit(100_001).count() <= 100_000
    blank = rows.where("size = 0").drop("mark").join(F.broadcast(goals) if small else goals, "grp")
    return line.unionByName(blank.withColumn("taken", F.lit(False)), allowMissingColumns=True)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = mixed(read(spark, sf_dir, "documents"))
    own = line.where("finish is not null").groupBy("grp", "first", F.col("row_key").alias("doc_id"), "size", "source_size", "target").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).cast("long").alias("taken"))
    blank = line.where("finish is null").select("grp", "first", F.col("row_key").alias("doc_id"), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return own.unionByName(blank).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '-')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER r AS k, (SELECT sum(n) FROM s)::BIGINT - coalesce(sum(3 * n) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over, sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_w FROM s WINDOW r AS (ORDER BY 3 * n / w, source NULLS LAST)),
t AS (SELECT arg_min(left_over::DOUBLE / left_w, k) FILTER (w * (left_over::DOUBLE / left_w) <= 3 * n) AS level FROM o),
g AS (SELECT source, n AS source_size, least(w * level, (3 * n)::DOUBLE) AS target FROM s, t),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id)::BIGINT AS ends FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE size > 0),
c AS (SELECT *, (p * source_size + ends)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE target > 0),
m AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, mark, doc_id, p ROWS UNBOUNDED PRECEDING) <= (SELECT round(sum(target)) FROM g) AS kept FROM c)
SELECT d.doc_id, d.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM m WHERE kept GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
