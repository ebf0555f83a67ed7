"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level BPE of the ``tokenizers`` library, which gets a space and the text; B is a ``sentencepiece`` BPE, which adds that space by
itself. Each side's cumulative byte ends go into a dictionary from end to index; the intersection of their keys, sorted, slices both id
lists into groups, and what ends together at a slice's end is linked.

Texts are cut before a space or line feed that follows a character which is no white space (nor U+2581). No piece of A's pattern goes on
over such a place, none looks back, and no piece of B holds a space after another character or a line feed beside one (``Codec`` checks
its vocabulary), so that both encode the chunks as they encode the whole. Distinct chunks are encoded once and kept in a memo of bounded size.

Counts of linked id pairs are gathered over the whole corpus. A task deals its documents to blocks of about ``BLOCK_LINKS`` links; a
block's distinct pairs are numbered, the most frequent first, and a document keeps their numbers and how often it has each.
So Spark moves a pair once for each block, to be summed and back with its count, however often it's linked; the documents then meet the
counts of their own block. Only the highest count of each id of B, of which there are as many as B has pieces, is broadcast.

Texts that are null or empty, or whose bytes one of the tokenizers doesn't give back, have no tokens: all zeros and ''. Texts are taken whole,
however long: a long document is a block by itself, and a long chunk isn't kept. Repeated rows are each counted and returned. Ties for the highest count all are
best. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.bpe import byte_characters
from skyloom.llm.common import bound_batches, materialise, read

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Links of a block of documents, at most but for the last document's.
BLOCK_LINKS = 3_000_000
#: Chunks that a worker keeps, and the longest one that is kept.
MEMO_CHUNKS, MEMO_CHARS = 300_000, 48
#: What sentencepiece writes for a space.
SPACE = "▁"
_CHUNKS = re.compile(rf"[ \n]+[^ \n]*(?:(?<=[\s{SPACE}])[ \n]+[^ \n]*)*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_KEPT: dict[tuple[str, str], Codec] = {}


def common_ends(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids of either side end at or before each common end; ``sizes`` are bytes by id."""
    at_a = dict(zip(np.cumsum(sizes_a[a]).tolist(), range(1, len(a) + 1)))
    at_b = dict(zip(np.cumsum(sizes_b[b]).tolist(), range(1, len(b) + 1)))
    ends = sorted(at_a.keys() & at_b.keys())
    return np.array(list(map(at_a.__getitem__, ends)), np.int64), np.array(list(map(at_b.__getitem__, ends)), np.int64)


class Codec:
    """Both tokenizers, the bytes of their ids, and the ids of known chunks; kept per worker."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.space = self.b.piece_to_id(SPACE)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and p != "\n" for p in pieces):
            raise ValueError("a piece goes on over a space or line feed")
        byte_of = {c: n for n, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for shown, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in shown) if all(c in byte_of for c in shown) else shown.encode()
        self.bytes_b = [bytes.fromhex(m[1]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        # ids as they're written inside of a group and at its end
        self.said_a, self.said_b = [np.array([f"{i}{end}" for end in (",", last) for i in range(len(x))], object) for x, last in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        #: Ids of chunks, as 32-bit numbers; chunks of which a side doesn't give the bytes back are known for one text only.
        self.in_a: dict[str, bytes] = {}
        self.in_b: dict[str, bytes] = {}
        self.lost: set[str] = set()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of a text that begins with the space that B adds (but to an empty text), or with a line feed, before
        which the added one is a token of its own."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = [self.space] if text == " " else self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        return np.array(a, np.int32), np.array(b, np.int32)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, joined: they're cut where neither tokenizer goes on. Those that end in white space, as texts may, go by themselves."""
        open_ = [c for c in chunks if c[-1].isspace() or c[-1] == SPACE]
        closed = [c for c in chunks if not (c[-1].isspace() or c[-1] == SPACE)]
        for lot in [closed, *[[c] for c in open_]]:
            if lot:
                data = [c.encode() for c in lot]
                ends = np.cumsum(list(map(len, data)))
                for ids, table, sizes, memo in zip(self.encode("".join(lot)), (self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b), (self.in_a, self.in_b)):
                    at = np.cumsum(sizes[ids])
                    cuts = (4 * np.append(0, np.searchsorted(at, ends, side="right"))).tolist()
                    raw, same = ids.tobytes(), b"".join([table[i] for i in ids.tolist()]) == b"".join(data)
                    memo.update(zip(lot, [raw[x:y] for x, y in zip(cuts, cuts[1:])]))
                    if not same and len(lot) > 1:  # find those that don't come back
                        for c in lot:
                            self.learn([c])
                        break
                    if not same:
                        self.lost.add(lot[0])

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of a space and the text; None if it has no tokens."""
        if not text:
            return None
        chunks = _CHUNKS.findall(" " + text)
        new = set(chunks).difference(self.in_a)
        if new:
            if len(self.in_a) + len(new) > MEMO_CHUNKS:
                self.forget()
                new = set(chunks)
            self.learn(list(new))
        lost = not self.lost.isdisjoint(chunks)
        ids = None if lost else tuple(np.frombuffer(b"".join(map(memo.__getitem__, chunks)), np.int32) for memo in (self.in_a, self.in_b))
        for c in new:
            if len(c) > MEMO_CHARS or c in self.lost:
                del self.in_a[c], self.in_b[c]
                self.lost.discard(c)
        return ids

    def forget(self) -> None:
        self.in_a.clear(), self.in_b.clear()

    def said(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """The groups (``a1,a2|b1``), joined by ``;``."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[in_a - 1] = last_b[in_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.append(0, in_b)[group_a]] = self.said_a[a + len(self.bytes_a) * last_a]
        out[np.arange(len(b)) + in_a[group_b]] = self.said_b[b + len(self.bytes_b) * last_b]
        return "".join(out.tolist())[:-1]


def codec(a: str, b: str) -> Codec:
    if (a, b) not in _KEPT:
        _KEPT[a, b] = Codec(a, b)
    return _KEPT[a, b]


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """``doc_id, groups array<struct<a array<int>, b array<int>>>`` of every document; none where it has no tokens."""

    def groups(both: Codec, text: str | None) -> list[dict]:
        ids = both.ids(text)
        if not ids:
            return []
        cuts = common_ends(*ids, both.sizes_a, both.sizes_b)
        return [{"a": x, "b": y} for x, y in zip(*[np.split(side, cut[:-1]) for side, cut in zip(ids, cuts)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, kind = codec(a, b), pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([groups(both, t) for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "groups"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>")


def _packed(numbers: np.ndarray, often: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u4").tobytes() + often.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, often = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), often.astype(np.int64)


def blocks(docs: DataFrame, a: str = A, b: str = B, most: int = BLOCK_LINKS) -> DataFrame:
    """``block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links`` of every document, and a line for each block with its
    distinct pairs in ``a, b``, by their numbers, and how often it has them in ``often``."""
    head = {"block": pa.string(), "doc_id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "links": pa.binary()}
    tail = {"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "often": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ids, rows, links, held, kind = codec(a, b), [], [], [], 0, None

        def whole() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            pairs, at = np.unique(np.concatenate([x for x, _ in links]), return_inverse=True)
            often = np.bincount(at, np.concatenate([m for _, m in links]), len(pairs)).astype(np.int64)
            order = np.argsort(-often, kind="stable")
            number = np.empty(len(pairs), np.int64)
            number[order] = np.arange(len(pairs))
            packed, s = [], 0
            for x, m in links:
                own = number[at[s : s + len(x)]]
                s, up = s + len(x), np.argsort(own)
                packed.append(_packed(own[up], m[up]))
            pairs, often = pairs[order], often[order]
            columns = [[name] * (len(rows) + 1), pa.array([*ids, None], kind), *[[*c, None] for c in zip(*rows)], [*packed, None]]
            lists = [[None] * len(rows) + [x] for x in ((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), often)]
            kinds = {**head, "doc_id": kind, **tail}
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip([*columns, *lists], kinds.values())], names=list(kinds))

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = found = both.ids(text) or (np.zeros(0, np.int32),) * 2
                in_x, in_y = common_ends(x, y, both.sizes_a, both.sizes_b)
                data = x[in_x - 1].astype(np.int64) << 32 | y[in_y - 1]
                digest = hashlib.sha256(both.said(*found, in_x, in_y).encode()).hexdigest() if len(x) else ""
                ids.append(doc_id)
                rows.append((len(x), len(y), len(in_x), len(data), digest))
                links.append(np.unique(data, return_counts=True))
                held += len(data)
                if held >= most:
                    yield whole()
                    ids, rows, links, held = [], [], [], 0
        if rows:
            yield whole()

    bound_batches(docs.sparkSession)
    kinds = f"block string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, a array<int>, b array<int>, often array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def counts(dealt: DataFrame) -> DataFrame:
    """``a, b, n, best``: how many links hold two ids linked (``blocks``' lines), and whether no other A id has more with that B id."""
    pairs = dealt.where("a is not null").select(F.inline(F.arrays_zip("a", "b", "often")))
    summed = materialise(pairs.groupBy("a", "b").agg(F.sum("often").alias("n")))
    # a line for each piece of B at most
    highest = summed.groupBy("b").agg(F.max("n").alias("highest"))
    return summed.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def digest(docs: DataFrame, a: str = A, b: str = B, most: int = BLOCK_LINKS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    dealt = materialise(blocks(docs, a, b, most))
    lines = dealt.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("number", "pair")).select("block", "number", "pair.*")
    known = lines.join(counts(dealt), ["a", "b"]).select("block", "number", "n", "best")
    rows = dealt.where("a is null").withColumnRenamed("block", "own_block").drop("a", "b", "often")

    def judge(own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        n[values["number"]], best[values["number"]] = values["n"], values["best"]
        sums = []
        for data in own["links"]:
            numbers, often = _unpacked(data)
            sums.append((int(often[best[numbers]].sum()), int((n[numbers] * often).sum())))
        return own.drop(columns=["own_block", "links"]).assign(n_best=[x for x, _ in sums], count_sum=[x for _, x in sums])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.groupBy("own_block").cogroup(known.groupBy("block")).applyInPandas(judge, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
