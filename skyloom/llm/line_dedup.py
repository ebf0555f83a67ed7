"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
in the tables a key is the pair of its two 64-bit hashes (128 bits: that two keys of
10**12 meet has a chance below 10**-14). Only keys of ``MIN_CHARS`` code points or
more are kept.

* ``postings``: one row (key, document), the exact state.
* ``counts``: the exact references: documents per key and the largest of their ids.
* ``filters``: cuckoo filters of the keys that ``min_docs`` documents or more hold, one row per shard of
  bounded size. They take deletions, so that a key can be withdrawn when documents go.

The three are stored by shard of the key. An insertion or deletion of documents changes the counts by what it
adds and takes away, inserts into and deletes from the stored filters the keys that thereby pass ``min_docs`` up
or down, and writes the shards that its keys fall into anew, under a new version; the other shards' files
stay and are shared by the index before and the index after, both of which can be read.
A filter that outgrows its capacity is built anew from its shard's counts.

Lines are tested against the filters first; the few that pass (all repeated keys and
a false share of about 2**-13) are confirmed by a join with the exact counts, in which common keys are cut into pieces.
Filters go to the tasks as a broadcast where their summed size, which is checked, is below
``BROADCAST_BYTES``; else keys and filters meet by shard.

Null and empty texts have one empty line. Rows with one doc_id are one document for
counting, and repeated lines of a document count once. A null doc_id is a document smaller than all others;
ids are whole numbers (or cast to them). Texts are split whole, however long. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import BLANKS, materialise, new_folder, read, spread_join

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that one filter holds, on average.
SHARD_KEYS = 200_000
#: Files that a shard is written to at most, so that a common key's shard isn't written by one task.
SPLIT = 4
BROADCAST_BYTES = 64 << 20
_STRIP = BLANKS.encode()


def key_hashes(line: bytes) -> tuple[int, int] | None:
    """The signed hash pair of a line's key; None for a key that is too short."""
    key = line.strip(_STRIP).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    whole = xxhash.xxh3_128_intdigest(key)
    high, low = whole >> 64, whole & (1 << 64) - 1
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


# -- cuckoo filter ------------------------------------------------------------

SLOTS, KICKS = 4, 500


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit tags in buckets of four. A key has two
    buckets, each found from the other and the tag, so that tags can move and be
    deleted without the key. Keys that find no place go to a stash."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(4, (int(capacity / SLOTS / 0.85)).bit_length())
        self.tags = np.zeros((self.buckets, SLOTS), np.uint16)
        self.stash: list[int] = []

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of many keys: what finds room in one of its buckets is put there at once."""
        out = cls(len(keys))
        tag, first, second = out._places(np.asarray(keys, np.int64))
        left = np.arange(len(keys))
        for places in (first, second):
            left = left[np.argsort(places[left], kind="stable")]
            at = places[left]
            _, begin, size = np.unique(at, return_index=True, return_counts=True)
            slot = np.arange(len(at)) - np.repeat(begin, size) + (out.tags[at] != 0).sum(1)
            fits = slot < SLOTS
            out.tags[at[fits], slot[fits]] = tag[left[fits]]
            left = left[~fits]
        for key in np.asarray(keys, np.int64)[left].tolist():
            out.insert(key)
        return out

    def capacity(self) -> int:
        return int(self.buckets * SLOTS * 0.95)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        tag = ((keys >> np.uint64(48)).astype(np.int64) % 65535 + 1).astype(np.uint16)
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return tag, first, self._other(first, tag.astype(np.int64))

    def _other(self, bucket, tag):
        return (bucket ^ (tag * 0x5BD1E995 >> 7)) & (self.buckets - 1)

    def _place(self, key: int) -> tuple[int, int, int]:
        key &= (1 << 64) - 1
        tag, first = (key >> 48) % 65535 + 1, key & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def insert(self, key: int) -> None:
        tag, a, b = self._place(int(key))
        at = a
        for kick in range(KICKS):
            for place in (a, b) if not kick else (at,):
                row = self.tags[place].tolist()
                if 0 in row:
                    self.tags[place, row.index(0)] = tag
                    return
            at, slot = (b if not kick else at), kick % SLOTS
            tag, self.tags[at, slot] = int(self.tags[at, slot]), tag
            at = self._other(at, tag)
        self.stash.append(at << 16 | tag)

    def delete(self, key: int) -> bool:
        """Withdraw a key that was inserted."""
        tag, a, b = self._place(int(key))
        for at in (a, b):
            row = self.tags[at].tolist()
            if tag in row:
                self.tags[at, row.index(tag)] = 0
                return True
            if at << 16 | tag in self.stash:
                self.stash.remove(at << 16 | tag)
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(np.asarray(keys, np.int64))
        found = (self.tags[a] == tag[:, None]).any(1) | (self.tags[b] == tag[:, None]).any(1)
        if self.stash:
            held = np.array(self.stash, np.int64)
            found |= np.isin((a << 16) | tag, held) | np.isin((b << 16) | tag, held)
        return found

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, len(self.stash), *self.stash], np.int64).tobytes() + self.tags.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.buckets, n = (int(x) for x in np.frombuffer(data[:16], np.int64))
        out.stash = np.frombuffer(data[16 : 16 + 8 * n], np.int64).tolist()
        out.tags = np.frombuffer(data[16 + 8 * n :], np.uint16).reshape(-1, SLOTS).copy()
        return out


# -- the stored tables --------------------------------------------------------


def postings_of(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id``: each key of each document, once per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, take = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    keys = {*map(key_hashes, text.encode().split(b"\n"))} - {None}
                    for a, b in keys:
                        k1.append(a)
                        k2.append(b)
                    take += [i] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), batch.column(0).take(pa.array(take, pa.int64()))], names=["k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def counts_of(postings: DataFrame) -> DataFrame:
    """``k1, k2, n_docs, last_doc`` of postings that are there once each."""
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def filters_of(keys: DataFrame) -> DataFrame:
    """``shard, n_keys, filter`` for ``shard, k2``."""

    def build(lot: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(lot["shard"].iloc[0])], "n_keys": [len(lot)], "filter": [CuckooFilter.of(lot["k2"].to_numpy()).to_bytes()]})

    return keys.groupBy("shard").applyInPandas(build, FILTERS)


def changed_filters(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """``filters`` of the shards of ``changes`` (``shard, k2, up boolean``) with those keys inserted or deleted;
    a null ``filter`` where it would be too full."""

    def change(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(keys):
            return pd.DataFrame({"shard": np.array([], np.int64), "n_keys": np.array([], np.int64), "filter": np.array([], object)})
        up, down = (keys["k2"][keys["up"] == x].tolist() for x in (True, False))
        one = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(len(up))
        n = (int(held["n_keys"].iloc[0]) if len(held) else 0) + len(up) - len(down)
        for key in down:
            one.delete(key)
        if n <= one.capacity():
            for key in up:
                one.insert(key)
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "n_keys": [n], "filter": [one.to_bytes() if n <= one.capacity() else None]})

    return filters.select("shard", "n_keys", "filter").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, FILTERS)


def candidates(postings: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The postings that pass the filters."""
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = postings.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = {s: CuckooFilter.from_bytes(b) for s, b in held.value.items()}
            for batch in batches:
                k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
                shard, keep = k1 % shards, np.zeros(len(k1), bool)
                for s, one in opened.items():
                    own = np.flatnonzero(shard == s)
                    keep[own] = one.contains(k2[own])
                yield batch.filter(pa.array(keep))

        return postings.mapInArrow(probe, postings.schema)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left[["k1", "k2", "doc_id"]]
        return rows[CuckooFilter.from_bytes(right["filter"].iloc[0]).contains(rows["k2"].to_numpy())] if len(right) else rows[:0]

    # a key's postings are split by document, so that no common key fills one task
    parts = 16
    salted = postings.withColumn("shard", F.pmod("k1", F.lit(shards))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(meet, postings.schema)


POSTINGS, COUNTS, FILTERS = "k1 long, k2 long, doc_id long, shard long", "k1 long, k2 long, n_docs long, last_doc long, shard long", "shard long, n_keys long, filter binary"


class LineIndex:
    """The state: three tables below ``root``, by shard and version. ``versions`` (``shard, version``) says which
    version of a shard is this index's. ``insert`` and ``delete`` return a new index; ``drops`` says what goes where."""

    def __init__(self, root: str, versions: DataFrame, shards: int, min_docs: int = MIN_DOCS):
        self.root, self.versions, self.shards, self.min_docs = root, versions, shards, min_docs

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
        found = materialise(postings_of(docs))
        shards = max(1, -(-found.count() // SHARD_KEYS))
        spark, version = docs.sparkSession, f"v{uuid.uuid4().hex}"
        versions = spark.range(shards).select(F.col("id").alias("shard"), F.lit(version).alias("version"))
        out = cls(new_folder(spark), versions, shards, min_docs)
        out._write("postings", out._sharded(found).distinct(), version)
        out._write("counts", out._sharded(counts_of(out.postings())), version)
        out._write("filters", filters_of(out.counts().where(F.col("n_docs") >= min_docs).select("shard", "k2")), version)
        return out

    def _sharded(self, keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("shard", F.pmod("k1", F.lit(self.shards)))

    def _write(self, name: str, rows: DataFrame, version: str) -> None:
        rows.withColumn("version", F.lit(version)).repartition("shard", F.pmod(F.xxhash64(*rows.columns), F.lit(SPLIT))).write.mode("append").partitionBy("shard", "version").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        rows = self.versions.sparkSession.read.schema(f"{schema}, version string").parquet(f"{self.root}/{name}")
        return rows.join(self.versions, ["shard", "version"]).drop("version")

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def counts(self) -> DataFrame:
        return self._read("counts", COUNTS)

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With these documents; what a document of the same id holds already isn't counted again."""
        found = self._sharded(postings_of(docs)).distinct().alias("n")
        return self._changed(materialise(found.join(self.postings().alias("p"), _same("n", "p"), "left_anti")), 1)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of these ids."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        return self._changed(materialise(self.postings().join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi")), -1)

    def _changed(self, delta: DataFrame, sign: int) -> LineIndex:
        """The index with the postings of ``delta`` added (1) or taken away (-1); only their shards are read and written."""
        version, key = f"v{uuid.uuid4().hex}", ["shard", "k1", "k2"]
        touched = materialise(delta.select("shard").distinct())
        versions = self.versions.join(touched.select("shard", F.lit(version).alias("newer")), "shard", "left").select("shard", F.coalesce("newer", "version").alias("version"))
        out = LineIndex(self.root, materialise(versions), self.shards, self.min_docs)

        old = self.postings().join(touched, "shard", "left_semi")
        out._write("postings", old.unionByName(delta) if sign > 0 else old.alias("p").join(delta.alias("n"), _same("p", "n"), "left_anti"), version)

        moved = delta.groupBy(*key).agg((sign * F.count("*")).alias("more"), F.max("doc_id").alias("top"))
        before = self.counts().join(touched, "shard", "left_semi")
        both = before.join(moved, key, "full").withColumns({"n_old": F.coalesce("n_docs", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))})
        if sign > 0:
            both = both.withColumn("last_doc", F.greatest("last_doc", "top"))
        else:  # the largest id left, of keys that lost theirs
            lost = both.where(F.col("more").isNotNull() & F.col("last_doc").eqNullSafe(F.col("top"))).select(*key)
            left = out.postings().join(lost, key, "left_semi").groupBy(*key).agg(F.max("doc_id").alias("next"), F.lit(True).alias("lost"))
            both = both.join(left, key, "left").withColumn("last_doc", F.when(F.col("lost"), F.col("next")).otherwise(F.col("last_doc")))
        both = materialise(both.select(*key, "n_old", "n_docs", "last_doc"))
        out._write("counts", both.where("n_docs > 0").drop("n_old"), version)

        many = lambda c: F.col(c) >= self.min_docs
        changes = both.where(many("n_old") != many("n_docs")).select("shard", "k2", many("n_docs").alias("up"))
        held = self.filters().join(touched, "shard", "left_semi")
        changed = materialise(changed_filters(held, changes))
        same = held.join(changed.select("shard"), "shard", "left_anti")
        full = changed.where("filter is null").select("shard")
        anew = filters_of(both.where(many("n_docs")).join(full, "shard", "left_semi").select("shard", "k2"))
        out._write("filters", changed.where("filter is not null").unionByName(same.select(changed.columns)).unionByName(anew), version)
        return out

    def drops(self) -> DataFrame:
        """``doc_id, keys array<struct<k1,k2>>``: the keys whose lines a document loses."""
        counts = materialise(self.counts().where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "n_docs", "last_doc"))
        postings = self.postings().select("k1", "k2", "doc_id")
        passed = candidates(postings, self.filters().select("shard", "filter"), self.shards)
        # the filter's false positives end here
        total = counts.agg(F.sum("n_docs")).first()[0] or 0
        lose = spread_join(passed, counts, ["k1", "k2"], "n_docs", total, ["doc_id"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lose.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _same(one: str, other: str) -> Column:
    return F.expr(f"{one}.shard = {other}.shard and {one}.k1 = {other}.k1 and {one}.k2 = {other}.k2 and {one}.doc_id <=> {other}.doc_id")


def _split(text: str | None, keys) -> tuple[int, list[bytes]]:
    lines = (text or "").encode().split(b"\n")
    gone = {(k["k1"], k["k2"]) for k in keys or ()}
    return len(lines), [x for x in lines if key_hashes(x) not in gone] if gone else lines


def _with_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    lost = drops.select(F.col("doc_id").alias("lost_id"), "keys")
    return docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("lost_id")), "left").drop("lost_id")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its repeated lines gone from ``text`` (null stays null); all columns stay."""
    names = docs.columns
    safe = docs.toDF(*[c if c in ("doc_id", "text") else f"given_{i}" for i, c in enumerate(names)])
    at, inner = names.index("text"), safe.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(at).to_pylist(), batch.column(len(inner)).to_pylist())
            text = pa.array([t if k is None else b"\n".join(_split(t, k)[1]).decode() for t, k in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], text, *batch.columns[at + 1 : len(inner)]], names=inner)

    rows = _with_drops(safe, LineIndex.of(docs, min_docs).drops()).select(*safe.columns, "keys")
    return rows.mapInArrow(run, safe.schema).toDF(*names)


def digest(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    rows = _with_drops(docs.select("doc_id", "text"), LineIndex.of(docs, min_docs).drops())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, kept = _split(text, keys)
                n.append(lines)
                dropped.append(lines - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.select("doc_id", "text", "keys").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with parts as (select doc_id, unnest(p) as line_text, unnest(range(len(p))) as pos from (select doc_id, string_split(coalesce("text", ''), chr(10)) as p from documents)),
keyed as (select doc_id, pos, line_text, translate(trim(line_text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from parts),
gone as (select line_key, max(doc_id) as last_doc from keyed where length(line_key) >= 20 group by line_key having count(distinct doc_id) >= 3),
marked as (select k.*, g.line_key is not null and doc_id <> last_doc as dropped from keyed k left join gone g on k.line_key = g.line_key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
    sha256(coalesce(string_agg(line_text, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256 from marked group by doc_id
"""
