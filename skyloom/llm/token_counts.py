"""Token counts by a linear longest-match automaton.

A trie over the vocabulary's byte strings has, at each node, a failure link and
the number of pieces that taking the link completes. One pass over a word's
bytes then gives the number of greedy longest-match pieces, without building
them and without ever looking back.

Words: ``PATTERN`` over the lower-cased text. Null and empty texts have no words
and count 0. Any byte is a piece of its own, so that every word can be counted.
Texts are counted whole, however long, and repeated rows each. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.bpe import byte_characters
from skyloom.llm.common import read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: Words whose counts a worker keeps; beyond it the memo starts anew.
MEMO_WORDS = 500_000


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's byte strings, without word-end marks and special tokens."""
    with open(path) as f:
        kept = json.load(f)
    special = {t["content"] for t in kept["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    end = kept["model"].get("end_of_word_suffix") or ""
    return sorted({bytes(byte_of[c] for c in (t.removesuffix(end) if end else t)) for t in kept["model"]["vocab"] if t not in special} - {b""})


class LongestMatch:
    """The automaton. ``count(word)`` takes time linear in the word's bytes."""

    def __init__(self, pieces: list[bytes]):
        next_, final = [{}], [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for byte in piece:
                if byte not in next_[at]:
                    next_[at][byte] = len(next_)
                    next_.append({})
                    final.append(False)
                at = next_[at][byte]
            final[at] = True
        link, popped, rest = [0] * len(next_), [0] * len(next_), [0] * len(next_)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for byte, node in next_[above].items():
                if final[node]:
                    link[node], popped[node] = 0, 1
                else:  # the pieces of the string above fall off until what is left can take this byte
                    at, n = link[above], popped[above]
                    while byte not in next_[at]:
                        n += popped[at]
                        at = link[at]
                    link[node], popped[node] = next_[at][byte], n
                queue.append(node)
        for node in range(len(next_)):
            at, n = node, 0
            while at:
                n += popped[at]
                at = link[at]
            rest[node] = n
        self._next, self._link, self._popped, self._rest = next_, link, popped, rest

    def count(self, word: bytes) -> int:
        next_, link, popped = self._next, self._link, self._popped
        at = n = 0
        for byte in word:
            while byte not in next_[at]:
                n += popped[at]
                at = link[at]
            at = next_[at][byte]
        return n + self._rest[at]


#: A worker's automata by vocabulary, so that its tasks build one once.
_BUILT: dict[str, LongestMatch] = {}


def automaton_of(path: str, pieces: list[bytes]) -> LongestMatch:
    if path not in _BUILT:
        _BUILT[path] = LongestMatch(pieces)
    return _BUILT[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every document."""
    pieces = load_pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words, memo = automaton_of(path, pieces), regex.compile(pattern), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                seen = Counter(words.findall((text or "").lower()))
                total = 0
                for word, times in seen.items():
                    n = memo.get(word)
                    if n is None:
                        n = automaton.count(word.encode())
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        if len(word) <= 64:
                            memo[word] = n
                    total += n * times
                n_words.append(seen.total())
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
