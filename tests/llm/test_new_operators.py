"""Similarity join, Merkle manifest and alignment against plain versions, on nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyloom.llm import align, jaccard, merkle
from tests.llm.test_operators import ODD, invented, make, sha, united

# -- op 11 -----------------------------------------------------------------------


def plain_sets(texts, shingle=4):
    out = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append({tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set())
    return out


def plain_join(texts, ids=None, percent=85):
    sets, ids = plain_sets(texts), ids or list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    groups = {}
    tops = united(len(sets), links)
    for i, top in enumerate(tops):
        groups.setdefault(top, []).append(ids[i])
    named = [[x for x in groups[top] if x is not None] for top in tops]
    return sorted(((ids[i], len(sets[i]), min(named[i], default=None)) for i in range(len(sets))), key=repr)


def varied(base, seed, changes):
    r, words = random.Random(seed), base.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def joined(spark, texts, ids=None):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(make(spark, texts, ids)).collect()), key=repr)


@pytest.mark.parametrize("common", [(20_000, 10), (10**9, 2)])
def test_similarity_join_is_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "PART_ITEMS", 300)
    monkeypatch.setattr(jaccard, "SAMPLE_SETS", common[0])
    monkeypatch.setattr(jaccard, "COMMON_SETS", common[1])
    r = random.Random(4)
    long = [" ".join(f"{c}{r.randrange(3000)}" for _ in range(n)) for c, n in zip("pqrst", (40, 80, 150, 300, 900))]
    texts = ODD + invented(40, 3) + [varied(t, seed, seed % 9) for t in long for seed in range(12)]
    chain = " ".join(f"c{i}" for i in range(400)).split()
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 200, 8)]  # neighbours link, the ends don't
    texts += [t.upper() for t in long] + [long[2]] * 3 + ["one two", "one  two", "two one", "a b c d", "A b\tc d"]
    texts += [" ".join(chain[:50]) + " " + " ".join(f"u{k}x{i}" for i in range(60)) for k in range(30)]  # a passage in common, no link
    assert joined(spark, texts) == plain_join(texts)


def test_join_of_ties_and_repeated_ids(spark):
    texts = ["a b c d e", "a b c d e", None, "x y z", "a b c d e f", "x y z"]
    ids = [7, 7, 7, None, 3, 9]
    assert joined(spark, texts, ids) == plain_join(texts, ids)
    assert joined(spark, []) == []


def test_bounds_hold_for_random_sets():
    r = np.random.default_rng(5)
    for _ in range(2000):
        n = int(r.integers(1, 400))
        both = np.unique(r.integers(-(2**62), 2**62, n))
        a = np.sort(both[r.random(len(both)) < r.uniform(0.8, 1)])
        b = np.unique(np.append(both[r.random(len(both)) < r.uniform(0.8, 1)], r.integers(-(2**62), 2**62, int(r.integers(0, 9)))))
        i = jaccard.shared(a, b)
        assert i == len(set(a.tolist()) & set(b.tolist()))
        assert (len(a) + len(b) - jaccard.bits_apart(jaccard.bitmap(a), jaccard.bitmap(b))) // 2 >= i
        if len(a) and len(b) and 100 * i >= 85 * (len(a) + len(b) - i):
            assert i >= jaccard.needed(len(a), len(b), 85)
            heads = [x[: jaccard.head_size(len(x))] for x in (a, b)]
            assert jaccard.shared(*heads) >= max(jaccard.at_least(len(x), 85) for x in (a, b))
            assert jaccard.shared(*[x[: jaccard.prefix_size(len(x), 85)] for x in (a, b)]) >= 1


# -- op 12 -----------------------------------------------------------------------


def plain_manifest(rows):
    """doc_id -> results, for rows of (doc_id, text, lang, source, n_chars)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha("".join(map(said, (d, s, lang, n, t))).encode())

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16]).encode()) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            yield level[at // 16 * 16 : at], level[at + 1 : at // 16 * 16 + 16]
            at //= 16

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: tree([leaf(*r) for r in own[s]]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for at, r in enumerate(own[s]):
            steps = [*path(trees[s], at), *path(top, k)]
            now = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            for before, after in steps:
                now = sha("".join([*before, now, *after]).encode())
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in steps).encode()), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", range(5))
def test_manifest_is_plain(spark, case):
    r = random.Random(case)
    if case == 0:
        rows = [(i, f"Text {i} É", "en", "big" if i % 3 else f"s{i % 40}", i) for i in range(700)]
    elif case == 1:
        rows = [(i if i % 9 else None, t, None if i % 2 else "de", r.choice([None, "", "a", "b\nc", "é", "z" * 50]), None if i % 5 else i) for i, t in enumerate(ODD * 6)] + [(1, "A", "en", "a", 1)] * 20
    elif case == 2:
        rows = [(5, "Lone", "en", None, 4)]
    elif case == 3:
        rows = [(i, "X" * i, "en", f"src{i}", i) for i in range(300)]
    else:
        rows = []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.selectExpr("*", *[f"'x' as {c}" for c in ("tree", "pos", "place", "digest", "leaf", "root", "name", "path", "part", "n")])
    got = [tuple(x) for x in merkle.digest(docs).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs.select("doc_id", "source", merkle.leaf_of().alias("digest")))
    some = found.leaves.where("pos in (0, 17, 199) or tree = 2 and pos = 100").select("tree", "pos", "doc_id", F.col("digest").alias("own"))
    proven = merkle.prove(found, some).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(proven) == 10 and all(x.leaf == x.own and x.folded == found.root for x in proven)
    assert found.records.where("size(children) > 16").isEmpty()


# -- op 13 -----------------------------------------------------------------------


class Plain:
    def __init__(self):
        from skyloom.llm.bpe import byte_characters

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}

    def ends(self, pieces):
        return np.cumsum([len(p) for p in pieces]).tolist()

    def align(self, text):
        """ids of both sides and the groups, or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None
        ends_a, ends_b = self.ends(bytes_a), self.ends(bytes_b)
        groups, i, j = [], 0, 0
        for end in ends_a:
            if end in ends_b:
                x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append((a[i:x], b[j:y]))
                i, j = x, y
        return a, b, groups


@pytest.fixture(scope="module")
def plain():
    return Plain()


def strange(n, seed):
    r, parts = random.Random(seed), [" ", "\n", "\t", "a", "b", "'s", "1", "▁", "\xa0", "é", "!", "\r", "漢", "\U0001f600", "​", "\x00", "﻿", "ﬁ", "́", "\x1c", "　"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(n)]


def test_chunks_encode_as_the_whole(plain):
    both = align.codec(align.A, align.B)
    for text in strange(600, 1) + invented(20, 5) + ODD + ["<|endoftext|> <s> </s> <0x41> it's", "▁x a▁ b ▁ ▁▁", "a  b   c \n  d"]:
        want, got = plain.align(text), both.ids(text)
        assert (got is None) == (want is None), text
        if want:
            assert (got[0].tolist(), got[1].tolist()) == want[:2], text


@pytest.mark.parametrize("most", [10**6, 40])
def test_alignment_is_plain(spark, plain, most):
    texts = ODD[:6] + ODD[7:] + invented(25, 6) + ["a b", "a b", "x▁y", "y" * 3000] + strange(30, 2)
    want, counts = {}, Counter()
    for i, t in enumerate(texts):
        want[i] = plain.align(t)
        if want[i]:
            counts.update((x[-1], y[-1]) for x, y in want[i][2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    got = {r.doc_id: r for r in align.digest(make(spark, texts), most=most).collect()}
    assert len(got) == len(texts)
    for i, found in want.items():
        r = got[i]
        if not found:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups = found
        links = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert tuple(r)[1:] == (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest())
    some = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in align.aligned(make(spark, texts)).collect()}
    assert all(some[i] == (found[2] if found else []) for i, found in want.items())
    assert align.digest(make(spark, [])).count() == 0
