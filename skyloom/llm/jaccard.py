"""Similarity join of texts by the Jaccard similarity of their shingle sets: tiles of sizes, bitmap signatures, exact intersection.

Sets are sorted arrays of 64-bit shingle hashes; texts with one set are one node. 100 * shared >= percent * united asks for
``needed(n, m)`` common items of sets of n and m, so that only sets of near sizes can link: sizes are cut into bands, the next one of
which begins at 100 / percent times the size, and a tile is a band and the one before, of sets that hold one item.

1. A set's head is its smallest ``HEAD`` percent of hashes. Two sets that link have at least (percent - 100 + HEAD) percent of n in common in their heads, so that a set
   with fewer of its head's items in other sets links with none and is through; most texts are. Heads are dealt by item, in arrays, and counted; items that a sample
   of the sets has shown to be common are known to be shared and go to their sets at once, so that no item, however common, is gathered.
2. What is left gets its whole set and bitmaps: bits that are each the parity of the items that hash to it. Sets
   differ in at least as many items as their bitmaps differ in bits, which bounds from above what they have in common. Tiles have bitmaps of 512 bits; two to four bits an item are compared after them.
3. Of all of a set's items the first so many make its prefix, in the order of how many candidates have them: those of one set alone come first and take up places, what
   many share comes last. Sets that link meet in a tile of an item that is early enough in both for what is left of them to suffice.
4. In each tile, sets are first held against its hub, the one whose item comes earliest: a group of copies takes as many comparisons as it has members, not pairs.
   Then all pairs of a tile that aren't in one group by then are.

Pairs pass the bitmaps first; those left are decided by intersecting their sets. The end of more pairs is cut into pieces with its pairs.

Texts without words, null and empty ones link with nothing and are their own component; rows without doc_id count for no component's name. Texts are taken whole,
however long: a set is held by a task in memory of its length. Rows with one text, or one doc_id, are each a row of the result. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import bound_batches, materialise, read, spread_join
from skyloom.llm.components import components
from skyloom.llm.shingle_sets import set_name, shingles

#: Items that a task counts or cuts at once, on average.
PART_ITEMS = 500_000
#: Percent of a set's items in its head.
HEAD = 25
#: Words of the signature that goes to tiles: 512 bits.
SIGNATURE = tuple(f"s{i}" for i in range(8))
#: Sets in a sample, at about so many of which an item is common: it's known to be shared, and isn't gathered to be counted.
SAMPLE_SETS, COMMON_SETS = 20_000, 10


@dataclass(frozen=True)
class Settings:
    """Words of a shingle; percent of the united set that has to be shared; percent of a set's items in its head."""

    shingle: int = 4
    percent: int = 85
    head: int = HEAD


CONTRACT = Settings()


def needed(n, m, percent: int):
    """Items that sets of n and m must share; for numbers and arrays."""
    return -(-percent * (n + m) // (100 + percent))


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))


def head_size(n, head: int = HEAD):
    return -(-head * n // 100)


def at_least(n, percent: int, head: int = HEAD):
    """Items of its head that a set of n shares with the head of any set it links with."""
    return np.maximum(1, (percent - 100 + head) * n // 100)


def prefix_size(n, percent: int):
    """Of its first so many items, in one order of all items, a set of n shares one with the like ones of any set it links with."""
    return n - -(-percent * n // 100) + 1


def parities(own: np.ndarray, width: int) -> np.ndarray:
    """Bits, each the parity of the items that fall on it."""
    return np.packbits((np.bincount((own.view(np.uint64) % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8))


def bitmap(own: np.ndarray) -> bytes:
    """Two to four bits an item."""
    return parities(own, 64 << max(0, (len(own) - 1) // 32).bit_length()).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits that two bitmaps differ in; the wider one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Items that two sorted arrays without repeats have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _set_of(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingles(text, shingle).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *values]))


def heads_of(sets: list[np.ndarray], settings: Settings = CONTRACT) -> pa.ListArray:
    """The smallest items of each sorted set."""
    return _lists([x[: head_size(len(x), settings.head)] for x in sets])


def sets_of(docs: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``doc_id, nid, n, head`` of every row: its set's name, size and smallest items; nid is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_set_of(t, settings.shingle) for t in batch.column(1).to_pylist()]
            names = pa.array([set_name(x) if len(x) else None for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(list(map(len, own)), pa.int64()), heads_of(own, settings)], names=["doc_id", "nid", "n", "head"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, nid long, n long, head array<long>")


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """Lines of arrays, one for each part."""
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    for name, at in zip(names.tolist(), np.split(order, starts[1:])):
        yield {"part": name} | {c: v[at] for c, v in columns.items()}


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs begin, and its end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))


def common_items(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of many of the ``total`` sets, sorted, and about how many: at most ``SAMPLE_SETS / COMMON_SETS`` times as many as a set gives on average."""
    step = max(1, total // SAMPLE_SETS)
    sample = sets.where(F.pmod(F.xxhash64("nid"), F.lit(step)) == 0).groupBy("nid").agg(F.first("items").alias("items"))
    found = sample.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("often")).where(F.col("often") >= COMMON_SETS).toPandas().sort_values("item")
    return found["item"].to_numpy(np.int64), found["often"].to_numpy(np.int64) * step


LISTS = "nid array<long>, n array<long>, item array<long>, often array<long>"


def count_part(lines: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of a part of the items, in lines of arrays ``nid, n, size, item`` (and ``grp``): those of several sets (groups), by shares of the sets. An item
    goes with its set's row, not with what is known of the set, and what is through is let go, so that a part takes few bytes an item."""
    nid, n, size = (np.concatenate(lines[c].to_list()) for c in ("nid", "n", "size"))
    grp = np.concatenate(lines["grp"].to_list()) if "grp" in lines else nid
    item = np.concatenate(lines["item"].to_list())
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    # a set that comes again has the same items
    once = np.zeros(len(nid), bool)
    once[np.unique(nid, return_index=True)[1]] = True
    if not once.all():
        kept = once[row]
        item, row = item[kept], row[kept]
    order = np.argsort(item)
    item = item[order]
    row = row[order]
    del order
    starts = _runs(item) if len(item) else np.zeros(1, np.int64)
    often = np.diff(starts)
    # an item is shared if its run holds a group other than its first one
    other = grp[row]
    other = other != np.repeat(other[starts[:-1]], often)
    found = np.logical_or.reduceat(other, starts[:-1]) if len(item) else np.zeros(0, bool)
    held = np.repeat(found, often)
    item, row, often = item[held], row[held], np.repeat(often[found], often[found])
    return pd.DataFrame(list(_dealt(nid[row] % parts, {"nid": nid[row], "n": n[row], "item": item, "often": often})), columns=["part", "nid", "n", "item", "often"])


def shared_items(sets: DataFrame) -> DataFrame:
    """Lines of arrays ``nid, n, item, often`` by ``part``, a share of the sets: those of the sets' ``items`` (``nid, n, items``) that others have, too, and how many have them.
    Where sets have ``grp``, an item that only sets of one group have is left out as well, unless it's common."""
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).first()
    parts = 1 + int(size["items"] or 0) // PART_ITEMS
    common, about = common_items(sets, size["n"])
    named = ["nid", "n", *(["grp"] if "grp" in sets.columns else [])]
    sets = sets.select("items", *named)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """What is ``named`` of the sets, and their items: the row of each, and where it is among the common ones (else -1)."""
        for batch in batches:
            one = np.unique(batch.column(1).to_numpy(), return_index=True)[1]  # copies in a batch go once
            own = [batch.column(0)[int(i)].values.to_numpy() for i in one]
            every = np.concatenate([np.zeros(0, np.int64), *own])
            at = np.minimum(np.searchsorted(common, every), max(0, len(common) - 1))
            yield [c.to_numpy()[one] for c in batch.columns[1:]], np.repeat(np.arange(len(own)), list(map(len, own))), every, np.where(common[at] == every, at, -1) if len(common) else np.full(len(every), -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"part": pa.int64()} | {c: pa.list_(pa.int64()) for c in (*named, "size", "item")}
        for who, row, every, at in items(batches):
            rare = at < 0
            row, every = row[rare], every[rare]
            lines = []
            for line in _dealt((every.view(np.uint64) % np.uint64(parts)).astype(np.int64), {"row": row, "item": every}) if len(every) else ():
                starts = _runs(line["row"])
                first = line["row"][starts[:-1]]
                lines.append((line["part"], *[x[first] for x in who], np.diff(starts), line["item"]))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*lines), kinds.values())], names=list(kinds))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"part": pa.int64()} | {c: pa.list_(pa.int64()) for c in ("nid", "n", "item", "often")}
        for (nid, n, *_), row, every, at in items(batches):
            held = at >= 0
            row, every, often = row[held], every[held], about[at[held]]
            if len(every):
                lines = list(_dealt(nid[row] % parts, {"nid": nid[row], "n": n[row], "item": every, "often": often}))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in lines], k) for c, k in kinds.items()], names=list(kinds))

    def count(lines: pd.DataFrame) -> pd.DataFrame:
        return count_part(lines, parts)

    dealt = sets.mapInArrow(deal, "part long, " + ", ".join(f"{c} array<long>" for c in (*named, "size", "item")))
    counted = dealt.groupBy("part").applyInPandas(count, f"part long, {LISTS}")
    return counted.unionByName(sets.mapInArrow(pass_on, f"part long, {LISTS}")) if len(common) else counted


def _by_set(lines: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each set's name, size, items, ascending, and how many sets have these."""
    nid, item = (np.concatenate(lines[c].to_list()) for c in ("nid", "item"))
    order = np.lexsort((item, nid))
    nid = nid[order]
    item = item[order]
    new = np.append(True, (item[1:] != item[:-1]) | (nid[1:] != nid[:-1]))
    if not new.all():
        nid, item, order = nid[new], item[new], order[new]
    n, often = (np.concatenate(lines[c].to_list())[order] for c in ("n", "often"))
    del order
    starts = _runs(nid)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield int(nid[s]), int(n[s]), item[s:e], often[s:e]


def candidates(sets: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``nid, n``: sets that may link, beyond their group where they have ``grp``, by what their heads share."""

    def cut(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(nid, n) for nid, n, item, _ in _by_set(lines) if len(item) >= at_least(n, settings.percent, settings.head)], columns=["nid", "n"])

    heads = sets.where("nid is not null").withColumnRenamed("head", "items").drop("doc_id")
    return shared_items(heads).groupBy("part").applyInPandas(cut, "nid long, n long")


def prefixes(full: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``nid, n, item, place``: of each set's items, those of no other candidate first and then the rarest, the first so many."""

    def cut(lines: pd.DataFrame) -> pd.DataFrame:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for nid, n, item, often in _by_set(lines):
            left = prefix_size(n, settings.percent) - (n - len(item))
            if left > 0:
                first = np.argsort(often, kind="stable")[:left]
                for column, own in zip(out, (np.full(len(first), nid), np.full(len(first), n), item[first], n - len(item) + np.arange(len(first)))):
                    column.append(own)
        return pd.DataFrame(dict(zip(("nid", "n", "item", "place"), map(np.concatenate, out))))

    return shared_items(full.withColumnRenamed("own", "items").drop("bits", *SIGNATURE)).groupBy("part").applyInPandas(cut, "nid long, n long, item long, place long")


def whole_sets(docs: DataFrame, nodes: DataFrame, found: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``found`` candidates with ``own`` (the whole set), ``bits`` and ``SIGNATURE``. ``nodes`` name a set's document (``nid, low``)."""
    wanted = found.join(nodes.select("nid", F.col("low").alias("low_id")), "nid")
    texts, kept = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("low_id"))).drop("doc_id", "low_id"), found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = {c: i for i, c in enumerate(batch.schema.names)}, []
            for i in range(len(batch)):
                own = _set_of(batch.column(at["text"])[i].as_py(), settings.shingle)
                # another text may have the same doc_id
                if len(own) and set_name(own) == batch.column(at["nid"])[i].as_py():
                    out.append((i, own, bitmap(own), parities(own, 64 * len(SIGNATURE)).view(np.int64)))
            rows = batch.take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[rows.column(at[c]) for c in kept], _lists([x[1] for x in out]), pa.array([x[2] for x in out], pa.binary()), *[pa.array([int(x[3][k]) for x in out], pa.int64()) for k in range(len(SIGNATURE))]], names=[*kept, "own", "bits", *SIGNATURE])

    return texts.mapInArrow(run, f"nid long, n long, own array<long>, bits binary, {', '.join(f'{c} long' for c in SIGNATURE)}").dropDuplicates(["nid"])


def _band(n: Column, percent: int) -> Column:
    """Sets that link are in one band or in two neighbours."""
    return F.floor(F.ln(n.cast("double")) / F.ln(F.lit(100 / percent)) * (1 - 1e-12)).cast("long")


def _may_link(settings: Settings) -> Column:
    """Whether two sets of a tile (``_a``, ``_b``) can share enough: by their sizes, by what is left of them from the item on, and by the bits they differ in."""
    wanted = _needed(F.col("n_a"), F.col("n_b"), settings.percent)
    rest = lambda side: F.col(f"n_{side}") - F.col(f"place_{side}")
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNATURE])
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * settings.percent
    return sizes & (rest("a") >= wanted) & (rest("b") >= wanted) & (F.col("n_a") + F.col("n_b") - apart >= 2 * wanted)


def _tiles(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows in their size's tile (``home``) and in the next one's."""
    band = _band(F.col("n"), settings.percent)
    return rows.withColumn("tile", F.explode(F.array(band, band + 1))).withColumn("home", F.col("tile") == band)


def hub_pairs(rows: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``a, b``: each set and the hubs of its tiles, as far as they may link. ``rows`` are ``prefixes`` with signatures."""
    held = ["nid", "n", "place", *SIGNATURE]
    tiles = _tiles(rows, settings)
    hubs = tiles.groupBy("item", "tile").agg(F.min(F.struct("place", "nid", "n", *SIGNATURE)).alias("hub"), F.count("*").alias("often")).where("often > 1")
    hubs = materialise(hubs.select("item", "tile", "often", *[F.col(f"hub.{c}").alias(f"{c}_a") for c in held]))
    total = hubs.agg(F.sum("often")).first()[0] or 0
    met = spread_join(tiles.select("item", "tile", *[F.col(c).alias(f"{c}_b") for c in held]), hubs, ["item", "tile"], "often", total, ["nid_b"])
    met = met.where((F.col("nid_a") != F.col("nid_b")) & _may_link(settings))
    return met.select(F.least("nid_a", "nid_b").alias("a"), F.greatest("nid_a", "nid_b").alias("b")).distinct()


def pairs_between(rows: DataFrame, groups: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``a, b``: sets of different ``groups`` (``nid, grp``) that are in one tile of an item and may link."""
    rows = materialise(rows.join(groups.select("nid", "grp"), "nid"))
    mixed = rows.groupBy("item").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("item")
    tiles = materialise(_tiles(rows.join(mixed, "item"), settings))
    first, second = (tiles.select("item", "tile", *[F.col(c).alias(f"{c}_{side}") for c in ("home", "nid", "n", "place", "grp", *SIGNATURE)]) for side in "ab")
    other = (F.col("nid_a") < F.col("nid_b")) & (F.col("grp_a") != F.col("grp_b")) & (F.col("home_a") | F.col("home_b"))
    return first.join(second, ["item", "tile"]).where(other & _may_link(settings)).select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()


def _met(pairs: DataFrame, full: DataFrame, column: str) -> DataFrame:
    """Pairs (``hub, other, links``: how many the hub has) with both ends' size and ``column``."""
    other = full.select(F.col("nid").alias("other"), F.col("n").alias("n_b"), F.col(column).alias(f"{column}_b"))
    hub = full.select(F.col("nid").alias("hub"), F.col("n").alias("n_a"), F.col(column).alias(f"{column}_a"))
    often = pairs.groupBy("hub").agg(F.count("*").alias("often"))
    return spread_join(pairs.join(other, "other"), hub.join(often, "hub"), ["hub"], "often", pairs.count(), ["other"])


def linked(pairs: DataFrame, full: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """The ``pairs`` (``a, b``, distinct) that link."""
    pairs = materialise(pairs)
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("links")))
    counted = pairs.join(ends.select(F.col("nid").alias("a"), F.col("links").alias("links_a")), "a").join(ends.select(F.col("nid").alias("b"), F.col("links").alias("links_b")), "b")
    turned = F.col("links_a") < F.col("links_b")
    pairs = materialise(counted.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other")))

    def passing(column: str, judge) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m, x, y = (batch.column(c) for c in ("n_a", "n_b", f"{column}_a", f"{column}_b"))
                least = needed(n.to_numpy(), m.to_numpy(), settings.percent)
                kept = pa.array([judge(x[i], y[i], int(n[i].as_py() + m[i].as_py())) >= least[i] for i in range(len(batch))], pa.bool_())
                yield batch.select(["hub", "other"]).filter(kept)

        return _met(pairs, full, column).select("hub", "other", "n_a", "n_b", f"{column}_a", f"{column}_b").mapInArrow(run, "hub long, other long")

    bound_batches(full.sparkSession)
    pairs = materialise(passing("bits", lambda x, y, both: (both - bits_apart(x.as_py(), y.as_py())) // 2))
    return materialise(passing("own", lambda x, y, both: shared(x.values.to_numpy(), y.values.to_numpy())).select(F.col("hub").alias("a"), F.col("other").alias("b")))


def links_between(sets: DataFrame, docs: DataFrame, nodes: DataFrame, grouped: DataFrame, settings: Settings) -> DataFrame:
    """``a, b``: all links between sets of different groups (``grouped``: ``nid, grp``), for a caller that has found most links. ``sets`` (``nid, n,
    head``) may come more than once; ``nodes`` name each one's document (``nid, low``)."""
    sets = materialise(sets.dropDuplicates(["nid"]).join(grouped, "nid"))
    found = materialise(candidates(sets, settings))
    full = materialise(whole_sets(docs, nodes, found, settings))
    rows = prefixes(full.join(grouped, "nid"), settings).join(full.select("nid", *SIGNATURE), "nid")
    return linked(pairs_between(rows, grouped, settings), full, settings)


def groups(docs: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    sets = materialise(sets_of(docs, settings))
    nodes = materialise(sets.where("nid is not null").groupBy("nid").agg(F.min("doc_id").alias("low"), F.count("*").alias("often")))
    found = materialise(candidates(sets, settings))
    full = materialise(whole_sets(docs, nodes, found, settings))
    rows = materialise(prefixes(full, settings).join(full.select("nid", *SIGNATURE), "nid"))
    links = linked(hub_pairs(rows, settings), full, settings)
    roots = components(links)
    grouped = materialise(full.select("nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("root", "nid").alias("grp")))
    more = linked(pairs_between(rows, grouped, settings), full, settings)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.join(lows, "root").select("nid", "often", "component_id"))
    rows = sets.select("doc_id", "nid", F.col("n").alias("n_shingles"))
    total = rows.count()
    some = spread_join(rows.where("nid is not null"), named, ["nid"], "often", total, ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    return some.unionByName(rows.where("nid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
