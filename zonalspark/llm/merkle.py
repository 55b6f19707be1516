"""Merkle dataset manifest (operator 11): bottom-up build, top-down proof push.

Leaves are digests of rows, put in order within their group through range partitions. Every level is written; a level's
runs of ARITY nodes make the next, until a group has one node left, its subroot; the subroots make a tree of their own.
Proofs go back down: a level's nodes are joined to their parents, and each prepends its siblings to what it inherits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import read, stored
from zonalspark.llm.running import running

COLUMNS, ARITY = ("doc_id", "source", "lang", "n_chars", "text"), 3
PROOF = "array<struct<before:binary,after:binary>>"
#: Levels that are pushed down in one job before what has been reached is written.
DEEP = 6


def field(value: Column) -> Column:
    """UTF-8 byte count, colon and value; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex digest of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """Digests of an array as hex text, side by side."""
    return F.array_join(F.transform(digests, hexed), "")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """All levels from nodes(grp, idx, n, digest, ...) up. Above the first a level has grp, idx, n (nodes that its group has
    there), run (digests of its children) and digest. A group ends where n is 1."""
    levels, n = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = levels[-1].where("n > 1").groupBy("grp", F.expr(f"idx div {ARITY}").alias("parent"), "n").agg(run.alias("run"))
        up = up.select("grp", F.col("parent").alias("idx"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"), "run", F.unhex(F.sha2(joined(F.col("run")), 256)).alias("digest"))
        levels.append(stored(up, "merkle-level"))
        n = -(-n // ARITY)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """grp, digest: the node that each group ends in."""
    ends = [x.where("n = 1").select("grp", "digest") for x in levels]
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out


def pushed(levels: list[DataFrame], seeds: DataFrame, inherit: Sequence[str]) -> DataFrame:
    """Rows of the first level with proof and the columns inherit. seeds(grp, proof, inherit) has what each group's last node
    starts with; a proof has an entry a level, from the leaf up: siblings before and after the node."""
    reached = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].drop("run") if k else levels[k]
        ends = here.where("n = 1").join(seeds, "grp")
        if reached is None:
            out = ends
        else:
            parents = reached.select("grp", F.col("idx").alias("parent"), "run", "proof", *inherit)
            both = here.where("n > 1").withColumn("parent", F.expr(f"idx div {ARITY}")).join(parents, ["grp", "parent"])
            at = F.col("idx") % ARITY
            side = lambda first, count: F.unhex(joined(F.slice("run", first, count)))
            entry = F.struct(side(F.lit(1), at.cast("int")).alias("before"), side(at.cast("int") + 2, F.lit(ARITY)).alias("after"))
            both = both.withColumn("proof", F.concat(F.array(entry), "proof").cast(PROOF)).drop("parent", "run")
            out = ends.unionByName(both)
        if k:
            # of a level only the nodes that have children below are needed again
            reached = levels[k].select("grp", "idx", "run").join(out.select("grp", "idx", "proof", *inherit), ["grp", "idx"])
            if (len(levels) - k) % DEEP == 0:
                reached = stored(reached, "merkle-proofs")
    return out


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root (lowercase hex), proof (PROOF, as binary) of every row, and the expressions of carry.

    Within a group leaves are in order of key, null keys first, rows of one key by their digests, so equal rows may change
    places. Null groups are a group of their own, the first. Of a last run of one node, before and after are empty and the
    node is hashed alone. A table of one row has its leaf as root and an empty proof; an empty table gives no rows. Columns
    other than columns, key and group are not read; carry may not use the names of results."""
    own = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(key).alias("row_key"), leaf(*(F.col(c) for c in columns)).alias("leaf"), F.lit(1).cast("long").alias("one"), *(v.alias(f"carry_{k}") for k, v in (carry or {}).items()))
    rows = running(own, "grp", ["row_key", "leaf"], "one").withColumnsRenamed({"before": "idx", "total": "n"}).withColumn("digest", F.unhex("leaf")).drop("one")
    levels = grown(stored(rows, "merkle-leaves"))
    subroots = tops(levels).select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest", F.lit(1).cast("long").alias("one"))
    high = stored(running(subroots, "all", ["name"], "one").withColumnsRenamed({"all": "grp", "before": "idx", "total": "n"}).drop("one"), "merkle-subroots")
    upper = grown(high)
    start = tops(upper).select("grp", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    seeds = stored(pushed(upper, start, ["root"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "proof"), "merkle-seeds")
    out = pushed(levels, seeds, ["subroot", "root"])
    return out.select(F.col("row_key").alias(key), "leaf", hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "proof", *(F.col(f"carry_{k}").alias(k) for k in carry or {}))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give, lowercase hex."""
    return F.aggregate(proof, start, lambda node, x: F.sha2(F.concat(hexed(x["before"]), node, hexed(x["after"])), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as hex text, from the leaf up and from left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(hexed(x["before"]), hexed(x["after"]))), "")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where crc32 of the id is even, line feeds are deleted from the text and the root is folded anew."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = leaf(*(text if c == "text" else F.col(c) for c in COLUMNS))
    made = manifest(read(spark, sf_dir, "documents"), carry={"tampered": tampered})
    again = folded(F.col("tampered"), F.col("proof"))
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


LEAF = "sha256(concat({}))".format(", ".join("coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-')".replace("x", c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")))

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {LEAF.format(text="text")} AS leaf, {LEAF.format(text="changed")} AS tampered FROM (SELECT *, CASE WHEN list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)),
l AS (SELECT source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, leaf AS digest, doc_id, tampered FROM d),
u(source, level, idx, n, digest) AS (SELECT source, level, idx, n, digest FROM l UNION ALL (SELECT source, level + 1, idx // 3, ceil(n / 3)::BIGINT, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY source, level, idx // 3, n)),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM u WHERE n = 1),
v(level, idx, n, digest) AS (SELECT 0, idx, n, subroot FROM s UNION ALL (SELECT level + 1, idx // 3, ceil(n / 3)::BIGINT, sha256(string_agg(digest, '' ORDER BY idx)) FROM v WHERE n > 1 GROUP BY level, idx // 3, n)),
b AS (SELECT a.source, a.level, a.idx, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx < a.idx), '') AS before, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx > a.idx), '') AS after FROM u a JOIN u x ON a.source IS NOT DISTINCT FROM x.source AND a.level = x.level AND a.idx // 3 = x.idx // 3 WHERE a.n > 1 GROUP BY ALL),
c AS (SELECT a.level, a.idx, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx < a.idx), '') AS before, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx > a.idx), '') AS after FROM v a JOIN v x ON a.level = x.level AND a.idx // 3 = x.idx // 3 WHERE a.n > 1 GROUP BY ALL),
f AS (SELECT doc_id, source, leaf, row_number() OVER () AS row_no, tampered, 0 AS level, idx, '' AS proof FROM (SELECT *, digest AS leaf FROM l)),
g(row_no, source, level, idx, node, proof) AS (SELECT row_no, source, 0, idx, tampered, proof FROM f UNION ALL SELECT g.row_no, g.source, g.level + 1, g.idx // 3, sha256(before || node || after), proof || before || after FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source AND g.level = b.level AND g.idx = b.idx),
h AS (SELECT row_no, source, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM g GROUP BY ALL),
k(row_no, level, idx, node, proof) AS (SELECT row_no, 0, idx, node, proof FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source UNION ALL SELECT row_no, k.level + 1, k.idx // 3, sha256(before || node || after), proof || before || after FROM k JOIN c ON k.level = c.level AND k.idx = c.idx),
m AS (SELECT row_no, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM k GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(m.proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM f JOIN m USING (row_no) JOIN s ON f.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT digest AS root FROM v WHERE n = 1)
"""
