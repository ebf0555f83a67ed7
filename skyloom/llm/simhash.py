"""SimHash near-duplicates over a forest of vantage-point trees.

Fingerprints: the majority, bit by bit, over the hashes of a text's word shingles, of
which repeats count unless a similarity is given.
Equal fingerprints are one node. Two nodes link at ``radius`` or fewer differing bits;
groups are the connected components.

Search: the bits are cut into blocks. If few bits differ in all, few differ in some
block (of 64 bits in 3 blocks, 4 differing bits leave a block with at most one), so
each block has a vantage-point tree over Hamming distances within the block, and a
small radius ``near`` to search it by. A tree splits at the median distance from a
vantage point. By the triangle inequality two fingerprints within ``near`` differ by at
most ``near`` in their distances from it, so that only those inside the boundary by
less than ``near`` are copied outside, and all other pairs across are pruned. The
upper levels come from a bounded sample and deal the fingerprints to shards in Spark. A shard of more than
``SHARD_ROWS`` gets a tree of its own, grown in a task from a sample of the shard, and so on, so that shards stay
small however many fingerprints there are; within a shard the tree goes on. What is left together is compared bit by
bit over the whole fingerprint.

A shard returns a spanning forest of its links, not the links: in a group of copies a
star around one fingerprint links all within the radius at once, and only what is
outside of the largest star is compared with the rest. Shards larger than
``SHARD_ROWS`` that no vantage point parts (many fingerprints equal in a block) are cut into pieces, of which each
two meet in a task of their own.

Where a similarity is given, the exact Jaccard similarity of the texts' shingle sets
decides, and bits only save work: links within ``radius`` are checked first, which joins
most of what is alike. Blocks are wide there and searched for equal bits, so that trees copy nothing and
few fingerprints that aren't alike meet, however many there are. A shard's forest spends a join on each link, whether it passes or not, so
this finds some links only. The others come from the tiles of ``jaccard``: every pair between the groups so far that
can be similar, by what the sets' smallest hashes share with other groups, by their rarest shingles and by bitmaps, is checked. What is kept of a
set there grows with its size, not with its square.

Texts with one set of shingles are one node there, named by the set's hash: equal
fingerprints alone join nothing.

Null texts count as empty; texts without words have the fingerprint zero and link like
any other. Rows with one doc_id may have different texts; each is fingerprinted, and repeated rows
are in one group. Texts are taken whole, in memory of their length. An empty table gives no rows.
A group whose doc_ids are all null has a null id. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import jaccard
from skyloom.llm.common import bound_batches, materialise, read, spread_join
from skyloom.llm.components import components
from skyloom.llm.shingle_sets import set_name, shingles

#: Fingerprints that the trees' upper levels are built from.
SAMPLE = 8192
#: Fingerprints of a shard, and those of a larger shard's pieces.
LEAF_ROWS, SHARD_ROWS, PIECE_ROWS = 4000, 24_000, 8_000
#: What is compared directly within a shard.
DIRECT = 256
#: Levels of one tree; deeper ones are trees of its leaves.
MAX_DEPTH, LEVEL_BITS = 10, 12


@dataclass(frozen=True)
class Settings:
    """``shingle`` words, ``words`` x 64 bits, links at ``radius`` bits or fewer;
    blocks are (word, mask), searched with the radius ``near``. With a ``similarity``, links
    are checked by it: those of the blocks, and then all that can pass between the
    groups found."""

    shingle: int = 4
    words: int = 1
    radius: int = 4
    near: int = 1
    similarity: float | None = None
    blocks: tuple[tuple[int, int], ...] = field(default=((0, (1 << 22) - 1), (0, ((1 << 21) - 1) << 22), (0, ((1 << 21) - 1) << 43)))

    @property
    def tiles(self) -> jaccard.Settings:
        """Of the exact search; heads of 40 percent leave short texts that share little with others out of it."""
        return jaccard.Settings(self.shingle, round(100 * self.similarity), 40)


#: 64 bits, 4-word shingles, 4 differing bits: one of three blocks has at most one of them.
CONTRACT = Settings()
#: Five words and a Jaccard similarity of 0.8 or more, exactly. In the bits, sets as
#: large as each other with that similarity have cosine 2 * 0.8 / 1.8 and differ in
#: acos(...) / pi = 0.1515 of 512. Blocks of 20 bits, searched for equal ones, find the closest ones first: no fingerprint is copied over a
#: boundary, and one has few unlike it in a block, however many there are (one in a million).
SIMILAR = Settings(shingle=5, words=8, radius=77, near=0, similarity=0.8, blocks=tuple((w, 0xFFFFF << s) for w in range(8) for s in (0, 32)))


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> bytes:
    """Big-endian bits of the fingerprint; further words take the shingle hashes mixed anew."""
    return majority(shingles(text, shingle), words)


def majority(hashes: np.ndarray, words: int) -> bytes:
    out = b""
    n = len(hashes)
    for _ in range(words):
        ones = np.zeros(64, np.int64)
        for s in range(0, n, 1 << 16):
            ones += np.unpackbits(hashes[s : s + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * ones > n).tobytes()
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
    return out


def fingerprints(docs: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``doc_id, text_hash long, fp binary`` of every row; where a similarity is given, ``nid long, n long, head array<long>`` as well:
    the name and size of the text's set of shingles and its smallest hashes."""
    doc_id, sets = docs.schema["doc_id"].dataType.simpleString(), settings.similarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, settings.shingle) for t in batch.column(1).to_pylist()]
            if sets:  # a measure of sets, which the bits then estimate
                own = [np.unique(x.view(np.int64)) for x in own]
            columns = {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array([majority(x.view(np.uint64), settings.words) for x in own], pa.binary())}
            if sets:
                columns |= {"nid": pa.array(list(map(set_name, own)), pa.int64()), "n": pa.array(list(map(len, own)), pa.int64()), "head": jaccard.heads_of(own, settings.tiles)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {doc_id}, text_hash long, fp binary" + ", nid long, n long, head array<long>" * sets)


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u8").astype(np.uint64).reshape(len(column), -1)


# -- trees --------------------------------------------------------------------


@dataclass
class Node:
    vantage: int = 0
    median: int = 0
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = -1


def _split(values: np.ndarray, near: int, random: np.random.Generator) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Vantage point, median, inside, and outside with the copied boundary; None if nothing would be pruned."""
    for at in random.integers(len(values), size=4):
        distance = np.bitwise_count(values ^ values[at]).astype(np.int64)
        median = int(np.partition(distance, (len(distance) - 1) // 2)[(len(distance) - 1) // 2])
        inner, outer = distance <= median, distance > median - near
        if max(inner.sum(), outer.sum()) < 0.9 * len(values):
            return int(values[at]), median, inner, outer
    return None


def grow(values: np.ndarray, near: int, depth: int, seed: int) -> tuple[Node, int]:
    """A tree over the sample, and the number of its leaves."""
    random, root, leaves = np.random.default_rng(seed), Node(), 0
    open_ = [(root, values, depth)]
    while open_:
        node, own, left = open_.pop()
        cut = _split(own, near, random) if left and len(own) >= 8 else None
        if not cut:
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.vantage, node.median, inner, _ = cut
        node.inner, node.outer = Node(), Node()
        open_ += [(node.outer, own[~inner], left - 1), (node.inner, own[inner], left - 1)]
    return root, leaves


def route(values: np.ndarray, root: Node, near: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, each with the positions of the values that belong there."""
    open_ = [(root, np.arange(len(values)))]
    while open_:
        node, own = open_.pop()
        if not len(own):
            continue
        if node.leaf >= 0:
            yield node.leaf, own
            continue
        distance = np.bitwise_count(values[own] ^ np.uint64(node.vantage)).astype(np.int64)
        open_ += [(node.inner, own[distance <= node.median]), (node.outer, own[distance > node.median - near])]


# -- links within a shard ------------------------------------------------------


def _distances(x: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(others)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[rows, w][:, None] ^ x[others, w][None, :])
    return out


class _Forest:
    """Which rows of a shard hang together so far; ``joins`` says whether a link is news."""

    def __init__(self, groups: np.ndarray):
        _, first, at = np.unique(groups, return_index=True, return_inverse=True)
        self.up = first[at].tolist()

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def joins(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _few(x: np.ndarray, block: np.ndarray, groups: np.ndarray, own: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """All links, between different groups, of a few rows that are near in the block."""
    near = np.bitwise_count(block[own][:, None] ^ block[own][None, :]) <= settings.near
    a, b = np.nonzero(np.triu(near, 1))
    a, b = own[a], own[b]
    news = groups[a] != groups[b]
    a, b = a[news], b[news]
    d = np.zeros(len(a), np.uint16)
    for w in range(x.shape[1]):
        d += np.bitwise_count(x[a, w] ^ x[b, w])
    linked = np.flatnonzero(d <= settings.radius)
    linked = linked[np.argsort(d[linked], kind="stable")]
    return list(zip(a[linked].tolist(), b[linked].tolist()))


def _many(x: np.ndarray, tops: list[int], own: np.ndarray, settings: Settings, stars: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows that no vantage point parts; ``tops`` are the rows' groups so far."""
    label, edges = np.unique(tops, return_inverse=True)[1], []
    free = np.ones(len(own), bool)
    for _ in range(stars):
        start = np.flatnonzero(free)
        if not len(start):
            break
        pivot = start[0]
        linked = np.flatnonzero(_distances(x, own[[pivot]], own)[0] <= settings.radius)
        edges += [(own[pivot], own[j]) for j in linked if j != pivot]
        merged = np.isin(label, np.unique(label[linked]))
        label[merged] = label[merged].min()
        free[linked] = free[pivot] = False
    largest = np.bincount(label).argmax()
    rest = np.flatnonzero(label != largest)
    step = max(1, 4_000_000 // len(own))
    for s in range(0, len(rest), step):
        rows = rest[s : s + step]
        distance = _distances(x, own[rows], own)
        new = (distance <= settings.radius) & (label[None, :] != label[rows][:, None])
        for i in np.flatnonzero(new.any(1)):
            to = np.flatnonzero(new[i])
            to = to[np.argsort(distance[i, to], kind="stable")]  # the nearest of each group
            names, first = np.unique(label[to], return_index=True)
            keep = names != label[rows[i]]  # an earlier row of this lot may have joined them
            edges += [(own[rows[i]], own[to[j]]) for j in first[keep]]
            merged = np.isin(label, np.append(names, label[rows[i]]))
            label[merged] = label[merged].min()
    return [(int(a), int(b)) for a, b in edges]


def shard_links(x: np.ndarray, block: int, settings: Settings, groups: np.ndarray | None = None, seed: int = 0) -> list[tuple[int, int]]:
    """Links (positions) that span the groups of a shard, as far as they're near in the
    block; with ``groups``, those that hang together already, only links between them."""
    word, mask = settings.blocks[block]
    values, random = x[:, word] & np.uint64(mask), np.random.default_rng(seed)
    groups = np.arange(len(x)) if groups is None else groups
    # where groups are known, the nearest links between them count, not the quickest
    stars = 8 if len(np.unique(groups)) == len(groups) else 0
    forest = _Forest(groups)
    open_, out = [np.arange(len(x))], []
    while open_:
        own = open_.pop()
        if len(own) < 2:
            continue
        if len(own) <= DIRECT:
            found = _few(x, values, groups, own, settings)
        elif cut := _split(values[own], settings.near, random):
            open_ += [own[cut[2]], own[cut[3]]]
            continue
        else:
            found = _many(x, [forest.top(int(i)) for i in own], own, settings, stars)
        out += [(a, b) for a, b in found if forest.joins(a, b)]
    return out


# -- in Spark -----------------------------------------------------------------


def links(nodes: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``a, b``: links between nodes (``nid long, fp binary``, all nid different) that span every
    group, as far as they're near in one of the blocks. Where nodes
    have ``grp long``, links within one such group are left out."""
    if "grp" not in nodes.columns:
        nodes = nodes.withColumn("grp", F.col("nid"))
    n = nodes.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS)))))
    sample = [bytes(r[0]) for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()] if depth else []
    trees = []
    for i, (word, mask) in enumerate(settings.blocks):
        values = _unpack(sample)[:, word] & np.uint64(mask) if sample else np.zeros(0, np.uint64)
        trees.append(grow(values, settings.near, depth, i)[0])

    def leaves_of(lot: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
        x = _unpack(lot["fp"])
        for i, (word, mask) in enumerate(settings.blocks):
            for leaf, own in route(x[:, word] & np.uint64(mask), trees[i], settings.near):
                yield i, leaf, own

    def count(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            if len(lot):
                yield pd.DataFrame([(i, leaf, len(own)) for i, leaf, own in leaves_of(lot)], columns=["block", "leaf", "n"])

    def deal(lots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in lots:
            if len(lot):
                for i, dealt in itertools.groupby(leaves_of(lot), lambda x: x[0]):
                    _, leaves, owns = zip(*dealt)
                    own = np.concatenate(owns)
                    yield pd.DataFrame({"block": i, "leaf": np.repeat(leaves, list(map(len, owns)))} | {c: lot[c].to_numpy()[own] for c in ("nid", "grp", "fp")})

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        found = shard_links(_unpack(shard["fp"]), int(shard["block"].iloc[0]), settings, shard["grp"].to_numpy())
        ids = shard["nid"].to_numpy()
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    sizes = nodes.select("fp").mapInPandas(count, "block int, leaf long, n long").groupBy("block", "leaf").agg(F.sum("n").alias("n"))
    shards = nodes.select("nid", "grp", "fp").mapInPandas(deal, SHARD)
    return _cut(shards, sizes, settings).groupBy("block", "leaf", "p", "q").applyInPandas(link, "a long, b long")


SHARD = "block int, leaf long, nid long, grp long, fp binary"


def _cut(shards: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """Shards with ``p, q``, the pieces of a shard that meet: those of more than ``SHARD_ROWS`` (``sizes``: ``block, leaf, n``) are
    dealt by trees of their own until they're smaller, and cut into pieces where none parts them."""
    key, out, salts = ["block", "leaf"], [], F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    whole = lambda df: df.withColumns({"p": F.lit(0).cast("long"), "q": F.lit(0).cast("long")})
    wanted = F.least(F.lit(MAX_DEPTH), F.greatest(F.ceil(F.log2(F.col("n") / LEAF_ROWS)), F.lit(1))).cast("int")
    while True:
        large = materialise(sizes.where(F.col("n") > SHARD_ROWS).withColumns({"pieces": F.ceil(F.col("n") / PIECE_ROWS), "depth": wanted}))
        total = large.agg(F.sum("n")).first()[0]
        if not total:
            return functools.reduce(DataFrame.unionByName, [*out, whole(shards)])
        shards = materialise(shards)
        out.append(whole(shards.join(large, key, "left_anti")))
        rows = spread_join(shards, large, key, "n", total, ["nid"]).withColumn("salt", F.pmod(F.xxhash64("nid"), F.col("pieces")))
        sample = rows.where(F.pmod(F.xxhash64("nid"), F.greatest(F.floor(F.col("n") / SAMPLE), F.lit(1))) == 0)
        grown = materialise(sample.groupBy(*key, "depth").applyInPandas(lambda name, lot: _grow_one(name, lot, settings), "block int, leaf long, tree binary"))
        pairs = rows.join(grown, key, "left_anti").withColumn("other", F.explode(salts))
        out.append(pairs.select(*shards.columns, F.least("salt", "other").alias("p"), F.greatest("salt", "other").alias("q")))
        trees = grown.join(large, key).select(*key, "tree", F.explode(salts).alias("salt"))
        parted = rows.select(*shards.columns, "salt").join(grown.select(*key), key, "left_semi")
        shards = materialise(parted.groupBy(*key, "salt").cogroup(trees.groupBy(*key, "salt")).applyInPandas(lambda lot, tree: _deal_on(lot, tree, settings), SHARD))
        sizes = shards.groupBy(*key).agg(F.count("*").alias("n"))


def _grow_one(name: tuple, lot: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """A tree for a shard, from a sample of it; none if no vantage point parts it, or if its leaves' names would be too long."""
    block, leaf, depth = name
    word, mask = settings.blocks[block]
    tree, leaves = grow(_unpack(lot["fp"])[:, word] & np.uint64(mask), settings.near, depth, block)
    parted = leaves > 1 and leaf < 1 << 63 - LEVEL_BITS - 1
    return pd.DataFrame([(block, leaf, pickle.dumps(tree))] if parted else [], columns=["block", "leaf", "tree"])


def _deal_on(lot: pd.DataFrame, tree: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """The rows of a shard, dealt by its tree."""
    word, mask = settings.blocks[int(lot["block"].iloc[0])]
    values = _unpack(lot["fp"])[:, word] & np.uint64(mask)
    rows = lot.drop(columns="salt")
    dealt = route(values, pickle.loads(tree["tree"].iloc[0]), settings.near)
    return pd.concat([rows.iloc[own].assign(leaf=(rows["leaf"].iloc[own] + 1) * (1 << LEVEL_BITS) + leaf) for leaf, own in dealt])


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The ``pairs`` (``a, b``) whose shingle sets have the similarity; nodes name a
    text by ``low`` (``doc_id, text_hash``). A set is made once for each node in a pair."""
    given = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = materialise(given.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("links")))
    wanted = nodes.join(ends, "nid").select("nid", F.col("low.doc_id").alias("low_id"), F.col("low.text_hash").alias("low_hash"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.xxhash64("text") == F.col("low_hash"))).select("nid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingles(t, settings.shingle)).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], names=["nid", "own"])

    # a text that stands in several rows with one doc_id has several equal sets
    sets = materialise(texts.mapInArrow(run, "nid long, own array<long>"))
    # the end with more links comes second, so that its set isn't moved with each of them
    counted = given.join(ends.select(F.col("nid").alias("a"), F.col("links").alias("a_links")), "a").join(ends.select(F.col("nid").alias("b"), F.col("links").alias("b_links")), "b")
    turned = F.col("a_links") < F.col("b_links")
    pairs = counted.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"))
    first = sets.select(F.col("nid").alias("other"), F.col("own").alias("own_b"))
    second = sets.join(ends, "nid").select(F.col("nid").alias("hub"), F.col("own").alias("own_a"), "links")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    either = F.size("own_a") + F.size("own_b") - shared
    met = spread_join(pairs.join(first, "other"), second, ["hub"], "links", given.count(), ["other"])
    return met.where(shared >= settings.similarity * either).select(F.col("hub").alias("a"), F.col("other").alias("b")).distinct()


def groups(docs: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``doc_id, fp, component_id``: every row's fingerprint and the smallest doc_id of its group."""
    prints = materialise(fingerprints(docs, settings))
    lows = F.min(F.struct("doc_id", "text_hash")).alias("low"), F.min("doc_id").alias("low_id")
    if settings.similarity is None:
        key, nodes = "fp", materialise(prints.groupBy("fp").agg(*lows).withColumn("nid", F.monotonically_increasing_id()))
    else:
        key, nodes = "nid", materialise(prints.groupBy("nid").agg(*lows, F.min("fp").alias("fp")))
    edges = links(nodes, settings)
    edges = materialise(edges if settings.similarity is None else similar(edges, nodes, docs, settings))
    if settings.similarity is None:
        roots = components(edges)
    else:  # the links so far are mostly stars: two rounds group them, and what they leave apart is only checked once more
        roots = materialise(components(edges, 2))
        known = roots.groupBy("node").agg(F.min("root").alias("root"))
        grouped = nodes.join(known, nodes["nid"] == known["node"], "left").select("nid", F.coalesce("root", "nid").alias("grp"))
        sets = prints.where("n > 0").select("nid", "n", "head")
        more = jaccard.links_between(sets, docs, nodes.select("nid", F.col("low.doc_id").alias("low")), materialise(grouped), settings.tiles)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    nodes = nodes.select("nid", "fp", F.col("low_id").alias("low"))
    rooted = nodes.join(roots, nodes["nid"] == roots["node"], "left").select(key, "low", "root")
    lows = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lows, "root", "left").select(F.col(key).alias("node"), F.coalesce("component", "low").alias("component_id"))
    return prints.join(named, F.col(key) == F.col("node")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, settings: Settings = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.
    Rows that share a doc_id are one document and stay or go together."""
    kept = groups(docs, settings).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]), "left_semi")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
