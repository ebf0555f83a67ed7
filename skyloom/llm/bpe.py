"""Byte-level BPE encoding and decoding over Arrow batches.

The merges are recovered from a rank file once on the driver, put into the
``tokenizers`` library's own description, and shipped to the tasks with the
closure (its size is that of the vocabulary file, not of the data). Rows stream
through ``mapInArrow``: no shuffle, no state between batches.

Null texts count as empty; empty texts give no ids. Texts are encoded whole, however long, and repeated rows
each on its own. An empty table gives no rows. Extra columns are ignored by the digest and kept by ``encode``
(a column of a result's name is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_CACHE: dict[str, tuple] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    visible in Latin-1, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """``token`` merged by all ranks below its own."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def describe(ranks: dict[bytes, int]) -> str:
    """The ``tokenizers`` description (JSON) of a rank file."""
    chars = byte_characters()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) != 2:
                raise ValueError(f"token {token!r} isn't a merge of two lower ranks")
            merges.append([shown(p) for p in parts])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {shown(t): r for t, r in ranks.items()}, "merges": merges},
    })


def _codec(description: str, pattern: str):
    """Tokenizer, bytes and decimal string of each id, splitter and the ids that memos share; kept per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(f"{pattern}\n{description}".encode()).hexdigest()
    if key not in _CACHE:
        from tokenizers import Tokenizer

        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(description)["model"]["vocab"]
        table = [b""] * (max(vocab.values(), default=-1) + 1)
        for shown, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in shown)
        _CACHE.clear()
        _CACHE[key] = Tokenizer.from_str(description), table, [str(i) for i in range(len(table))], regex.compile(pattern).findall, list(range(len(table)))
    return _CACHE[key]


def decode_bytes(ids, table: list[bytes]) -> bytes:
    """The bytes of ``ids``; exact even where a token ends inside a character."""
    return b"".join([table[i] for i in ids])


def decode_pieces(ids, table: list[bytes]) -> list[str]:
    """One string per id: a character split over tokens appears whole at the
    token that completes it, so that the pieces join to the decoded text."""
    out, held = [], b""
    for i in ids:
        held += table[i]
        try:
            out.append(held.decode())
            held = b""
        except UnicodeDecodeError as e:
            cut = e.start if e.reason == "unexpected end of data" else len(held)
            out.append(held[:cut].decode(errors="replace"))
            held = held[cut:]
    if held and out:
        out[-1] += held.decode(errors="replace")
    return out


def char_offsets(text: str, ids, table: list[bytes]) -> list[int]:
    """Where each token starts, in characters of ``text`` (a token that starts
    inside a character gets that character's place)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.cumsum((raw & 0xC0) != 0x80) - 1
    at = np.concatenate([[0], np.cumsum([len(table[i]) for i in ids])[:-1]]).astype(int) if len(ids) else np.empty(0, int)
    return begins[at].tolist()


#: Distinct pieces whose ids a task keeps; beyond it the memo starts anew. Workers serve other stages later, so that it goes with the task.
MEMO_PIECES = 400_000
#: Longer pieces are encoded each time, so that the memo's memory stays bounded too.
MEMO_CHARS = 40


def _encoded(codec, texts: list[str], memo: dict[str, tuple]) -> Iterator[list[int]]:
    """The ids of each text. The pieces that the pattern cuts are encoded apart
    from each other, so that each distinct piece of a batch goes to the library once."""
    tokenizer, split, shared = codec[0], *codec[3:]
    for text in texts:
        pieces = split(text)
        new = [p for p in set(pieces) if p not in memo]
        if new:
            if len(memo) + len(new) > MEMO_PIECES:
                memo.clear()
                new = list(set(pieces))
            for p, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                memo[p] = tuple([shared[i] for i in e.ids])  # not an object for each id
        yield list(chain.from_iterable([memo[p] for p in pieces]))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text", offsets: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``ids array<int>``, and ``starts array<int>`` if asked for."""
    description = describe(load_ranks(path))
    kept = [c for c in docs.columns if c not in ("ids", "starts")]
    source = docs.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(description, pattern), {}
        table = codec[1]
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            ids = list(_encoded(codec, texts, memo))
            more = [pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                more.append(pa.array([char_offsets(t, i, table) for t, i in zip(texts, ids)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "ids", *["starts"] * offsets])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([*source.schema.fields]).add("ids", ArrayType(IntegerType()))
    return source.mapInArrow(run, schema.add("starts", ArrayType(IntegerType())) if offsets else schema)


def decode(encoded: DataFrame, path: str = RANKS, ids: str = "ids") -> DataFrame:
    """All columns with ``decoded binary``: the bytes of ``ids``. Null ids give null; an unknown id fails."""
    by_id = {r: t for t, r in load_ranks(path).items()}
    table = [by_id.get(i) for i in range(max(by_id, default=-1) + 1)]
    kept = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else decode_bytes(x, table) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return source.mapInArrow(run, StructType([*source.schema.fields]).add("decoded", BinaryType()))


def digest(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, in one
    pass: encoded, decoded again, and only digests leave the task."""
    description = describe(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(description, pattern), {}
        table, numerals = codec[1:3]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for ids in _encoded(codec, [t or "" for t in batch.column(1).to_pylist()], memo):
                n.append(len(ids))
                a.append(sha(" ".join([numerals[i] for i in ids]).encode()))
                b.append(sha(decode_bytes(ids, table)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
