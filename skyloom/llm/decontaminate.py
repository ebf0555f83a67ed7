"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items (13 consecutive words, or
the whole item where it has fewer). For each pattern length there is a shift
table over blocks of up to three words: a block that no pattern holds lets the
search move on by nearly a whole window. A block that ends some pattern leads to
the bucket of patterns with that suffix, where the window is compared directly.

The tables travel with the closure, so their size is held: the benchmark is cut
into blocks of at most ``BLOCK_BYTES`` of text, each searched in a pass of its
own, and the hits of a document are united. Documents are never shuffled with
their texts. Null or word-free texts have no words and no hits; items without
words give no windows; a null item_id counts as the empty one; items with equal ids are one item with several texts;
rows of ``docs`` with equal ids are taken apart by a row number. Texts are searched whole, however long. Empty
tables give no rows or no hits. Extra columns are ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, read

WINDOW, BLOCK_WORDS = 13, 3
#: Benchmark text searched for in one pass; bounds what the driver and a task hold (some 100 times as much, for short words).
BLOCK_BYTES = 4 << 20
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20

#: Digits and lower-case letters stay, capitals are lower-cased, bytes of other scripts stay, the rest separates words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class WuManber:
    """Search for word windows; ``find`` gives (first word, after the last word, items) of each occurrence."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                patterns.setdefault(len(window), {}).setdefault(window, set()).add(item)
        self._groups = []
        for length, held in sorted(patterns.items()):
            block = min(BLOCK_WORDS, length)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], tuple[str, ...]]] = {}
            for window, ids in held.items():
                for end in range(block, length + 1):
                    part = window[end - block : end]
                    shift[part] = min(shift.get(part, length), length - end)
                buckets.setdefault(window[-block:], {})[window] = tuple(sorted(ids))
            self._groups.append((length, block, shift, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        for length, block, shift, buckets in self._groups:
            end, whole, n, get = length, length - block + 1, len(words), shift.get
            while end <= n:
                part = tuple(words[end - block : end])
                move = get(part, whole)
                if not move:
                    items = buckets[part].get(tuple(words[end - length : end]))
                    if items:
                        yield end - length, end, items
                    move = 1
                end += move


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans united where they overlap or touch, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    return max(1, -(-size // BLOCK_BYTES))


def _tables(items: DataFrame, window: int) -> WuManber:
    return WuManber([(r[0] or "", r[1]) for r in items.select(F.col("item_id").cast("string"), "text").collect()], window)


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """``key, n_words, spans array<struct<a,b>>, items array<string>`` of every
    row: word positions hit (end excluded) and items with an occurring window."""
    spark, n = docs.sparkSession, _blocks(benchmark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    passes = []
    for block in range(n):
        tables = spark.sparkContext.broadcast(_tables(items.where(F.col("block") == block), window))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            search = tables.value
            for batch in batches:
                n_words, spans, found = [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    hits, ids = [], set()
                    for a, b, some in search.find(words):
                        hits.append((a, b))
                        ids.update(some)
                    n_words.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in joined(hits)])
                    found.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(found, pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])

        passes.append(docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, spans array<struct<a:long,b:long>>, items array<string>"))
    if n == 1:
        return passes[0]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans`` of every document."""
    many = _blocks(benchmark) > 1
    rows = docs.select("doc_id", "text")
    if many:  # several passes meet again by a row's own number
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = find_hits(rows, benchmark, "row" if many else "doc_id", window)
    if many:
        hits = hits.join(rows.select("row", "doc_id"), "row").drop("row")
    # united, so that overlaps between passes count once: spans are few and sorted by start
    united = F.expr("""aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0L),
        (s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.to)), 'to', greatest(s.to, x.b))).n""")
    hits = hits.withColumn("n_hit", united)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay, and each row is judged by its own text."""
    n = _blocks(benchmark)
    if n == 1:
        return _keep_clean(docs, benchmark, window)
    names = docs.columns
    rows = materialise(docs.toDF(*[f"given_{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()))
    text = F.col(f"given_{names.index('text')}").alias("text")
    dirty = judge(rows.select(F.col("row").alias("doc_id"), text), benchmark, window).where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(dirty, "row", "left_anti").drop("row").toDF(*names)


def _keep_clean(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """In one pass where one set of tables holds the whole benchmark."""
    tables = docs.sparkSession.sparkContext.broadcast(_tables(benchmark, window))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                n_hit = sum(b - a for a, b in joined([(a, b) for a, b, _ in tables.value.find(words)]))
                keep.append(not (n_hit and ONE_IN * n_hit >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "spans")


ORACLE_SQL = r"""
with folded as (select doc_id, list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
items as (select item_id, list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
item_windows as (select distinct item_id, len(w) as n, array_to_string(w, ' ') as win from items where len(w) between 1 and 12
    union select distinct item_id, 13, array_to_string(w[i : i + 12], ' ') from (select item_id, w, unnest(range(1, len(w) - 11)) as i from items where len(w) >= 13)),
sizes as (select distinct n from item_windows),
doc_windows as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from folded, sizes where len(w) >= n)),
found as (select d.doc_id, d.i, d.n, b.item_id from doc_windows d join item_windows b on d.n = b.n and d.win = b.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
held as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by doc_id)
select f.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from folded f left join hit using (doc_id) left join held using (doc_id)
"""
