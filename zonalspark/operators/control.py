"""Task generation, queueing, requests and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalspark.sources.shared import written


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """current with changes written over it: of each key the last row by `order`, changes over what is there."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_rows(both, keys, [F.desc("_new"), *order]).drop("_new")


def missing(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys aren't known yet."""
    return candidates.join(known.select(*keys).distinct(), keys, "left_anti")


def unmet(rows: DataFrame, keys: list[str], met: Column, held: int = 500_000) -> DataFrame:
    """Distinct keys of which no row is met; as in SQL, keys with a null equal no others and stay. Rows are dealt by key into as
    many partitions as have about `held` of them each, and one pass over each tells, so a task's memory doesn't grow."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // held))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.coalesce(met, F.lit(False)))
    dealt = rows.select(*keys, known.alias("_met")).repartition(n, *keys)
    return dealt.groupBy(*keys).agg(F.max("_met").alias("_met")).where("not _met").drop("_met")


def queue(tasks: DataFrame, n: int, order: list[Column], available: Column) -> DataFrame:
    """The first n available tasks. A top-k: partitions keep n rows each, no whole sort."""
    return tasks.where(available).orderBy(*order).limit(n)


def places(rows: DataFrame, by: str, order: list[tuple[str, bool]]) -> DataFrame:
    """by, the columns of order (name, whether descending; a total order) and place from 1 within by. Rows are put in order
    range by range, and places follow from the counts of the ranges before, so no value of by is sorted in one task. Ranges
    are written, since they are read twice and must be the same both times."""
    names = list(dict.fromkeys([by, *(c for c, _ in order)]))
    sorting = [F.desc(c) if down else F.asc(c) for c, down in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, _ = written(rows.select(*names).repartitionByRange(n, F.asc(by), *sorting).withColumn("_part", F.spark_partition_id()), "places")
    held = parts.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_held"))
    before = held.withColumn("_before", F.sum("_held").over(Window.partitionBy(by).orderBy("_part")) - F.col("_held")).select(F.col(by).alias("_by"), F.col("_part").alias("_at"), "_before")
    placed = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part", by).orderBy(*sorting)))
    both = placed.join(F.broadcast(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return both.select(*names, (F.col("_before") + F.col("_n")).cast("long").alias("place"))


def release_stale(tasks: DataFrame, now: Column, minutes: int = 30, running: int = 2, waiting: int = 0) -> DataFrame:
    """Tasks that run for longer than `minutes` wait again."""
    stale = (F.col("status") == running) & (F.col("update_time") < now - F.expr(f"interval {minutes} minutes"))
    return tasks.withColumn("status", F.when(stale, waiting).otherwise(F.col("status")))


def retried(tasks: DataFrame, now: Column, failed: int = -1, waiting: int = 0) -> DataFrame:
    """Failed tasks wait again, with one attempt more and a new update_time; others stay as they are."""
    again = F.col("status") == failed
    changed = {"status": F.lit(waiting), "attempts": F.col("attempts") + 1, "update_time": now}
    return tasks.withColumns({k: F.when(again, v).otherwise(F.col(k)) for k, v in changed.items()})


def requeued(requests: DataFrame, failed: int = -2, queued: int = -1) -> DataFrame:
    """Failed requests are queued again."""
    return requests.withColumn("status", F.when(F.col("status") == failed, queued).otherwise(F.col("status")))


def preset_matches(rows: DataFrame, presets: list[dict], names: list[str], tags: str) -> DataFrame:
    """rows with each preset they match: all that a preset says of `names` is equal and all its tags are there; what it
    doesn't say matches anything. One pass: the list of matching presets is worked out in each row."""
    found = []
    for p in presets:
        parts = [F.col(n).eqNullSafe(F.lit(p[n])) for n in names if p.get(n) is not None]
        if p.get("tags"):
            parts.append(F.forall(F.array(*map(F.lit, p["tags"])), lambda t: F.array_contains(F.col(tags), t)))
        found.append(F.when(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(p["name"])))
    return rows.withColumn("preset", F.explode(F.array_compact(F.array(*found))))


def complete(tasks: DataFrame, by: str = "req_id", done: int = 1) -> DataFrame:
    """Requests all of whose tasks are done."""
    counted = tasks.groupBy(by).agg(F.count("status").alias("n_tasks"), F.count_if(F.col("status") == done).alias("n_done"))
    return counted.where("n_tasks = n_done")


def pivoted(results: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row a key, one column a name; the list of names saves a job that would find them."""
    return results.groupBy(*keys).pivot(name, names).agg(F.sum(value))


def decoded(rows: DataFrame) -> DataFrame:
    """text: the value of a tagged union (data_column says which of int_value, float_value, str_value holds)."""
    kind = F.col("data_column")
    return rows.withColumn("text", F.when(kind == "int", F.col("int_value").cast("string")).when(kind == "float", F.col("float_value").cast("string")).when(kind == "str", F.col("str_value")))


def bucket_counts(rows: DataFrame, at: str, unit: str) -> DataFrame:
    """Rows by day, month or year, as text; rows without a time aren't counted."""
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return rows.where(F.col(at).isNotNull()).groupBy(F.date_format(at, form).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def runs_of_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """text: sorted distinct whole numbers, runs of more than two as a-b, others listed."""
    distinct = rows.select(*keys, number).distinct()
    within = Window.partitionBy(*keys).orderBy(number)
    marked = distinct.withColumn("_run", F.col(number) - F.row_number().over(within))
    runs = marked.groupBy(*keys, "_run").agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    one = F.when(F.col("_b") - F.col("_a") >= 2, F.concat_ws("-", "_a", "_b")).when(F.col("_b") > F.col("_a"), F.concat_ws(", ", "_a", "_b")).otherwise(F.col("_a").cast("string"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_a", one.alias("_t")))).alias("_l"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda x: x["_t"]), ", ").alias("text"))


def runs_of_labels(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """text: if all labels of a group are whole numbers, their runs as runs_of_numbers has them, else all labels in order."""
    whole = F.col(label).try_cast("long")
    marked = rows.select(*keys, label).distinct().withColumn("_whole", F.when(whole.cast("string") == F.trim(label), whole))
    numbers = marked.groupBy(*keys).agg(F.bool_and(F.col("_whole").isNotNull()).alias("_all"), F.array_sort(F.collect_list(label)).alias("_l"))
    runs = runs_of_numbers(marked.join(numbers.where("_all").select(*keys), keys, "left_semi"), keys, "_whole")
    return numbers.join(runs, keys, "left").select(*keys, F.coalesce("text", F.array_join("_l", ", ")).alias("text"))


def candidates(coverage: DataFrame, features: DataFrame, collections: DataFrame, resources: DataFrame, options: DataFrame, datasets: DataFrame) -> DataFrame:
    """resource_id, geom_id, po_id of all work that can be done: covered features of active collections that nobody
    uploaded (coverage: geom_id and dataset_id of covered pairs), with each resource and active option of an active dataset. Catalogue sides are filtered and joined with each
    other first, so coverage is joined twice only."""
    from zonalspark.operators.spatial import bounded

    of_set = resources.select("dataset_id", "resource_id").join(options.where("active").select("dataset_id", "po_id"), "dataset_id").join(datasets.where("active").select("dataset_id"), "dataset_id", "left_semi")
    held = features.select("geom_id", "fc_id").join(bounded(collections.where("active and not is_user_upload").select("fc_id")), "fc_id", "left_semi")
    covered = coverage.select("geom_id", "dataset_id").join(bounded(held.select("geom_id")), "geom_id")
    return covered.join(bounded(of_set), "dataset_id").select("resource_id", "geom_id", "po_id")


def in_phases(requests: DataFrame, queued: int = -1, processing: int = 0) -> DataFrame:
    """req_id and place of all open requests: queued ones first, then those in process, each by priority and time."""
    phased = requests.where(F.col("status").isin(queued, processing)).withColumn("phase", F.when(F.col("status") == queued, 0).otherwise(1))
    placed = places(phased, "phase", [("priority", True), ("submit_time", False), ("req_id", False)])
    first = phased.where("phase = 0").agg(F.count(F.lit(1)).alias("_n"))
    return placed.crossJoin(F.broadcast(first)).select("req_id", (F.col("place") + F.when(F.col("phase") == 1, F.col("_n")).otherwise(0)).alias("place"))


def merged_selection(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """key, part, order: first as it is, then what second has more, each in its own order."""
    more = second.join(first.select(key), key, "left_anti")
    return first.select(key, F.lit(0).alias("part"), order).unionByName(more.select(key, F.lit(1).alias("part"), order))
