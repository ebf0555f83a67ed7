"""Merkle manifest of a dataset: a content-addressed graph of digests, and proofs by descent.

A leaf is the digest of a row's columns. The leaves of a source, by ascending doc_id, are joined in runs of ``ARITY`` into
nodes, and so on up to the source's subroot; subroots, by source, go on to one root. What is stored of a node is a record from its
digest to its children's; equal nodes have one record.

A request names a leaf by its place. Its digits, to the base ``ARITY``, say which child to take at each node from the root down.
Requests descend together: where they have the first digits in common they're one row, so that a step joins each
visited node with its record once, and no digest, not even the root's, meets more than one row of its source. On the
way the children that aren't taken are collected; in the end the segments of the path are reversed, from leaf to root.

Places come from ranges of (source, doc_id, digest): a range is numbered in its task, and the rows of the ranges before are added. A common source
is many ranges and many runs; no group is larger than ``ARITY``.

Null values are ``-`` in a leaf, others their length in bytes, ``:`` and the value, so that null, empty and any other text differ. Null
sources are one source, the first; null doc_ids come first. Rows with one doc_id are ordered by their digests; repeated rows have equal digests, and
each its own place and proof. Texts are digested whole, however long. A lone leaf is its subroot and, if it's the only one, the root; its proof has
no siblings. An empty table gives no rows. Extra columns aren't part of a leaf and are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, read, shuffle_partitions, spread_join

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def _said(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns=COLUMNS, **changed: Column) -> Column:
    """The digest of a row; ``changed`` columns are taken as given."""
    return F.sha2(F.concat(*[_said(changed.get(c, F.col(c))) for c in columns]), 256)


def placed(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``place long``: from 0 in the order of some columns, nulls first."""
    dealt = materialise(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    # one line for each of the ranges
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", (F.col("inside") + F.col("before")).cast("long")).drop("part", "inside", "before")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.struct(n.alias("n"), F.lit(0).alias("h")), lambda a, _: F.when(a.n > 1, F.struct(F.ceil(a.n / ARITY).alias("n"), (a.h + 1).alias("h"))).otherwise(a), lambda a: a.h)


@dataclass
class Manifest:
    """``leaves``: the given rows with ``tree, pos, digest, height`` (their source's number and their place in it); ``trees``: ``tree, source,
    subroot, height``; ``records``: ``digest, children``; ``root`` and its ``height`` above the subroots. Empty tables have no root."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    height: int


def _up(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (``tree, digest``) of trees given by their ``nodes`` (``tree, pos, digest, n``: how many the tree has), and the records on the way."""
    roots, records = [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x.digest)
        joined = materialise(runs.agg(children.alias("children")).select("tree", "pos", F.sha2(F.array_join("children", ""), 256).alias("digest"), "n", "children"))
        if joined.isEmpty():
            return functools.reduce(DataFrame.unionByName, roots), records
        records.append(joined.select("digest", "children"))
        nodes = joined.drop("children")


def manifest(rows: DataFrame) -> Manifest:
    """Of ``rows`` (``source, doc_id, digest`` and others)."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    rows = materialise(placed(rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))), ["source", "doc_id", "digest"], parts))
    sources = materialise(rows.groupBy("name", "source").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    trees = materialise(placed(sources, ["source"], parts).withColumnRenamed("place", "tree").withColumn("height", height(F.col("n"))))
    total = rows.count()
    found = spread_join(rows, trees.select("name", "first", "n", "tree", "height"), ["name"], "n", total, ["place"])
    leaves = materialise(found.withColumn("pos", F.col("place") - F.col("first")).drop("name", "place", "first"))
    subroots, records = _up(leaves.select("tree", "pos", "digest", "n"))
    subroots = materialise(subroots)
    # subroots are the leaves of one tree more
    n = trees.count()
    roots, above = _up(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n).cast("long").alias("n")))
    root = roots.first()
    every = [*records, *above]
    records = materialise(functools.reduce(DataFrame.unionByName, every).dropDuplicates(["digest"])) if every else spark.createDataFrame([], "digest string, children array<string>")
    top = spark.range(1).select(height(F.lit(n).cast("long")).alias("h")).first()["h"]
    named = trees.select("tree", "source", "height").join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    return Manifest(leaves.drop("n"), materialise(named), records, root["digest"] if root else None, top)


def _down(state: DataFrame, wanted: DataFrame, records: DataFrame) -> DataFrame:
    """One step: ``state`` (``tree, idx, digest, path`` and others) to the children of which the ``wanted`` rows (``tree, child`` and others) name the place."""
    opened = state.join(records, "digest").drop("digest")
    met = wanted.withColumn("idx", F.floor(F.col("child") / ARITY)).join(opened, ["tree", "idx"])
    digit = F.pmod(F.col("child"), F.lit(ARITY)).cast("int")
    step = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("before"), F.array_join(F.slice("children", digit + 2, F.lit(ARITY)), "").alias("after"))
    return met.select(F.get("children", digit).alias("digest"), F.concat("path", F.array(step)).alias("path"), F.col("child").alias("idx"), *[c for c in met.columns if c not in ("digest", "path", "idx", "child", "children")])


def prove(found: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree, pos`` and others, none of them named as what is used on the way: ``idx, child, children, digest``) with ``leaf``, ``subroot`` and ``path array<struct<before,after>>``: the siblings on either
    side, joined, from the leaf's run to the root's."""
    spark = requests.sparkSession
    if found.root is None:
        return requests.withColumns({"leaf": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string"), "path": F.lit(None).cast(f"array<{STEP}>")})
    asked = materialise(requests.select("tree").distinct())
    state = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("idx"), F.lit(found.root).alias("digest"), F.array().cast(f"array<{STEP}>").alias("path"))
    for level in reversed(range(found.height)):
        state = materialise(_down(state, asked.select(F.lit(0).cast("long").alias("tree"), F.floor(F.col("tree") / ARITY**level).alias("child")).distinct(), found.records))
    # the same descent within the sources; a tree joins it at its own height
    entries = materialise(state.select(F.col("idx").alias("tree"), "digest", "path").join(found.trees.select("tree", "height"), "tree").withColumns({"idx": F.lit(0).cast("long"), "subroot": F.col("digest")}))
    state = entries.limit(0).drop("height")
    highest = entries.agg(F.max("height")).first()[0] or 0
    for level in reversed(range(1, highest)):
        opened = state.unionByName(entries.where(F.col("height") == level + 1).drop("height"))
        state = materialise(_down(opened, requests.select("tree", F.floor(F.col("pos") / ARITY**level).alias("child")).distinct(), found.records))
    last = _down(state.unionByName(entries.where("height = 1").drop("height")), requests.withColumn("child", F.col("pos")), found.records).drop("idx")
    lone = requests.join(entries.where("height = 0").drop("height", "idx"), "tree")
    out = last.unionByName(lone)
    return out.withColumn("path", F.reverse("path")).withColumnRenamed("digest", "leaf")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda now, step: F.sha2(F.concat(step.before, now, step.after), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.before, step.after)), ""), 256)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; of documents whose doc_id's CRC-32 is divisible by five, the root is
    folded from a row whose text was lower-cased."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = leaf_of(text=F.translate("text", UPPER, LOWER))
    rows = docs.select("doc_id", F.col("source"), leaf_of().alias("digest"), F.when(tampered, lowered).alias("changed"))
    found = manifest(rows)
    proven = prove(found, found.leaves.select("tree", "pos", "doc_id", "changed"))
    out = proven.select("doc_id", "leaf", "subroot", F.lit(found.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


_VALUE = "coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c=c) for c in COLUMNS) + ")"
_TAMPERED = _LEAF.replace("cast(text as varchar)", f"translate(text, '{UPPER}', '{LOWER}')")
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE_SQL = f"""
with recursive rows as (select doc_id, source, {_LEAF} as leaf, case when {_CRC} % 5 = 0 then {_TAMPERED} end as changed from documents),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as tree from rows),
nodes as (select 0 as level, tree, pos, leaf as digest, n from leaves
    union all select level + 1, tree, pos // 16, sha256(string_agg(digest, '' order by pos)), any_value(cast(ceil(n / 16) as bigint)) from nodes where n > 1 group by level, tree, pos // 16),
subroots as (select tree, digest from nodes where n = 1),
tops as (select 0 as level, tree as pos, digest, (select count(*) from subroots) as n from subroots
    union all select level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), any_value(cast(ceil(n / 16) as bigint)) from tops where n > 1 group by level, pos // 16),
runs as (select level, tree, pos // 16 as run, list(digest order by pos) as held from nodes where n > 1 group by all),
topruns as (select level, pos // 16 as run, list(digest order by pos) as held from tops where n > 1 group by all),
paths as (select 0 as level, doc_id, leaf, tree, pos, coalesce(changed, leaf) as now, '' as proof from leaves
    union all select p.level + 1, doc_id, leaf, p.tree, pos // 16, sha256(array_to_string(held[:pos % 16], '') || now || array_to_string(held[pos % 16 + 2:], '')), proof || array_to_string(held[:pos % 16], '') || array_to_string(held[pos % 16 + 2:], '')
    from paths p join runs r on r.level = p.level and r.tree = p.tree and r.run = p.pos // 16),
entered as (select * from paths p where not exists (select 1 from runs r where r.level = p.level and r.tree = p.tree)),
climbs as (select 0 as level, doc_id, leaf, tree, tree as pos, now, proof from entered
    union all select p.level + 1, doc_id, leaf, tree, pos // 16, sha256(array_to_string(held[:pos % 16], '') || now || array_to_string(held[pos % 16 + 2:], '')), proof || array_to_string(held[:pos % 16], '') || array_to_string(held[pos % 16 + 2:], '')
    from climbs p join topruns r on r.level = p.level and r.run = p.pos // 16),
root as (select digest as root from tops where n = 1)
select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, now as folded_root, now = root as verified
from climbs c join subroots s using (tree), root where not exists (select 1 from topruns r where r.level = c.level)
"""
