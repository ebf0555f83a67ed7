"""Each operator against a plain version on small tables with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import bpe, common, decontaminate, html_text, jaccard, line_dedup, neighbours, shards, simhash, token_counts, toxicity, url_filter
from skyloom.llm.components import components

CLASH = ["row", "shard", "slot", "rank", "key", "keys", "ids", "score", "fp", "kept", "grp", "bucket", "n_words", "component_id", "lost_id"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def make(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", *["x"] * len(CLASH)) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def invented(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]


ODD = [None, "", " ", "\n\n", "a", "É ñ ß x", "x" * 50_000, "the same line of text here\n" * 3, "\U0001f600 smile‍", "Tab\tand\x0bvertical\x0c\r\n end"]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- op 1 ------------------------------------------------------------------------


def test_bpe_is_tiktoken(spark):
    texts = ODD + invented(30) + ["<|endoftext|> it's they'll 1234 ３ ٥ don't  \n\n  x", "".join(map(chr, range(1, 0x800)))]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    docs = make(spark, texts)
    got = {r.doc_id: r for r in bpe.digest(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    encoded = bpe.encode(docs, offsets=True)
    assert {"row", "lang", "ids", "starts"} <= set(encoded.columns)
    for r in bpe.decode(encoded).collect():
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and len(r.starts) == len(r.ids)
    assert bpe.digest(make(spark, [])).count() == 0


def test_bpe_keeps_no_pieces_beyond_its_task(spark):
    """A worker goes on to other stages, which need its memory."""

    def held(batches):
        for batch in batches:
            size = sum(len(x) for codec in bpe._CACHE.values() for x in codec if isinstance(x, dict))
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(batch), pa.int64()), pa.array([len(bpe._CACHE)] * len(batch), pa.int64())], names=["size", "codecs"])

    assert bpe.digest(make(spark, invented(200)).repartition(8)).where("n_tokens > 0").count() == 200
    got = spark.range(80, numPartitions=8).mapInArrow(held, "size long, codecs long").collect()
    assert max(x.codecs for x in got) == 1 and max(x.size for x in got) == 0


def test_bpe_split_characters():
    table = [b"\xf0\x9f", b"\x98\x80", b"a", b"\xff"]
    assert bpe.decode_pieces([2, 0, 1, 2], table) == ["a", "", "\U0001f600", "a"]
    assert bpe.decode_pieces([0, 2], table)[-1].endswith("a")
    assert bpe.char_offsets("a\U0001f600a", [2, 0, 1, 2], table) == [0, 1, 1, 2]


# -- op 2 ------------------------------------------------------------------------


def test_longest_match_is_greedy(spark):
    pieces = token_counts.load_pieces(token_counts.VOCABULARY)
    held, longest = set(pieces) | {bytes([b]) for b in range(256)}, max(map(len, pieces))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in held)
            n += 1
        return n

    texts = ODD + invented(30)
    got = {r.doc_id: r for r in token_counts.token_counts(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = regex.findall(token_counts.PATTERN, (t or "").lower())
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(w.encode()) for w in words))
    small = token_counts.LongestMatch([b"abcd", b"bc", b"cde", b"de", b"deX"])
    assert [small.count(w) for w in (b"abcd", b"abcde", b"bcde", b"abcX", b"", b"cdeXbc")] == [1, 2, 2, 3, 0, 3]
    assert token_counts.token_counts(make(spark, [])).count() == 0


# -- op 3 ------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    found = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(n, links):
    """The smallest of each of n nodes' groups."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def plain_groups(prints, radius):
    names = sorted(set(prints.values()))
    up = {n: n for n in names}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                up[top(a)] = top(b)
    low = {}
    for i, f in prints.items():
        low[top(f)] = min(low.get(top(f), i), i)
    return {i: low[top(f)] for i, f in prints.items()}


def test_simhash_groups(spark, monkeypatch):
    base, r = invented(40), random.Random(1)
    texts = ODD + base + base[:10]
    for t in base:  # near copies
        words = t.split()
        for _ in range(3):
            more = list(words)
            more[r.randrange(len(more))] = "zz"
            texts.append(" ".join(more))
    got = {x.doc_id: x for x in simhash.groups(make(spark, texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert all(int.from_bytes(got[i].fp, "big") == f for i, f in prints.items())
    assert {i: x.component_id for i, x in got.items()} == plain_groups(prints, 4)
    assert simhash.groups(make(spark, [])).count() == 0
    assert simhash.groups(make(spark, [None, "a"], [None, None])).where("component_id is null").count() == 2


@pytest.mark.parametrize("leaf, shard, piece, depth", [(40, 10_000, 8000, 10), (60, 50, 30, 10), (20, 60, 30, 2)])
def test_vantage_forest_loses_no_link(spark, monkeypatch, leaf, shard, piece, depth):
    """Whole shards, shards in pieces, and trees of trees."""
    for name, value in (("LEAF_ROWS", leaf), ("SHARD_ROWS", shard), ("PIECE_ROWS", piece), ("DIRECT", 16), ("MAX_DEPTH", depth)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(leaf)
    prints = {}
    for _ in range(300):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 12])):
            prints[len(prints)] = f
            for b in r.sample(range(64), r.choice([0, 1, 3, 4, 5])):
                f ^= 1 << b
    ball = r.getrandbits(64)
    for _ in range(400):
        prints[len(prints)] = ball ^ sum(1 << b for b in r.sample(range(0, 20), 3))
    names = sorted(set(prints.values()))
    nodes = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(names)], "nid long, fp binary")
    edges = [(e.a, e.b) for e in simhash.links(nodes).collect()]
    assert all((names[a] ^ names[b]).bit_count() <= 4 for a, b in edges)
    assert dict(enumerate(united(len(names), edges))) == plain_groups(dict(enumerate(names)), 4)


def test_first_links_meet_few_fingerprints_that_differ(monkeypatch):
    """Their work grows with the fingerprints, not with the square: each stands in one leaf of a block's tree, with few of equal bits."""
    r, n, met, few = np.random.default_rng(2), 20_000, np.zeros(2, np.int64), simhash._few
    x = r.integers(0, 2**64, (n, 8), dtype=np.uint64)
    copies = x[:500] ^ np.packbits((r.random((500, 8, 64)) < 0.1).astype(np.uint8), axis=2).view(np.uint64)[..., 0]

    def counted(x, block, groups, own, settings):
        near = np.bitwise_count(block[own][:, None] ^ block[own][None, :]) <= settings.near
        met[:] += len(own), np.triu(near, 1).sum()
        return few(x, block, groups, own, settings)

    monkeypatch.setattr(simhash, "_few", counted)
    found = set()
    for i, (word, mask) in enumerate(simhash.SIMILAR.blocks):
        values = x[:, word] & np.uint64(mask)
        tree, leaves = simhash.grow(values[:8192], simhash.SIMILAR.near, 5, i)
        assert leaves > 16 and sum(len(own) for _, own in simhash.route(values, tree, simhash.SIMILAR.near)) == n
        met[:] = 0
        assert simhash.shard_links(x, i, simhash.SIMILAR) == []
        assert met[0] == n and met[1] < n / 20
        found |= {min(a, b) for a, b in simhash.shard_links(np.vstack([x, copies]), i, simhash.SIMILAR)}
    assert found <= set(range(500)) and len(found) > 350


def test_similar_texts_join_and_others_stay(spark):
    r, base = random.Random(3), invented(30, 5)
    base = [" ".join([t] * 1 + [f"w{i}{j}" for j in range(150)]) for i, t in enumerate(base)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    kept = {x.doc_id for x in simhash.keep_one(make(spark, base + near + [base[20]])).collect()}
    assert kept == set(range(30))


@pytest.mark.parametrize("direct", [256, 8])
def test_similar_groups_are_exact(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    r = random.Random(8)
    texts = list(ODD) + ["a b c d e", "a b c d e " * 3]
    for i in range(40):  # similarities on both sides of 0.8
        w = [f"w{i}x{j}" for j in range(r.randint(60, 300))]
        texts.append(" ".join(w))
        for _ in range(r.choice([1, 2, 6])):
            v = list(w)
            for _ in range(round(len(w) * r.choice([0.004, 0.015, 0.022, 0.025, 0.035]))):
                v[r.randrange(len(v))] = f"n{r.random()}"
            texts.append(" ".join(v))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if u == old else u for u in up]
    docs = make(spark, texts + texts[-3:], [*range(len(texts)), *range(len(texts) - 3, len(texts))])
    got = {x.doc_id: x.component_id for x in simhash.groups(docs, simhash.SIMILAR).collect()}
    assert got == dict(enumerate(up))
    assert simhash.groups(make(spark, []), simhash.SIMILAR).count() == 0
    assert simhash.groups(make(spark, [None, "a", texts[-1], texts[-1]], [None] * 4), simhash.SIMILAR).where("component_id is null").count() == 4


def test_equal_fingerprints_are_checked(spark):
    run = "x " * 70  # one shingle makes up the fingerprint
    texts = [run + " ".join(f"{c}{j}" for j in range(n)) for c, n in (("p", 40), ("q", 45), ("p", 40))]
    docs = make(spark, texts)
    assert len({simhash.fingerprint(t, 5, 8) for t in texts}) == 1
    assert {x.doc_id: x.component_id for x in simhash.groups(docs, simhash.SIMILAR).collect()} == {0: 0, 1: 1, 2: 0}


def test_repeats_and_short_texts_are_found(spark):
    words = [[f"w{i}x{j}" for j in range(9)] for i in range(40)]  # 4 of 5 shingles
    texts = [" ".join(w) for w in words] + [" ".join(w[:8]) for w in words]
    once = [f"u{j}" for j in range(44)]
    texts += [" ".join(once), " ".join(once + once[:5] + ["v"]), " ".join(once + once[:6]), " ".join(once[:5] * 12 + once)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))
    for i, j in sorted(plain_similar(sets), key=lambda x: (x[1], x[0])):
        old, new = max(up[i], up[j]), min(up[i], up[j])
        up = [new if u == old else u for u in up]
    assert up[:80] == [*range(40)] * 2 and up[80:] == [80] * 4
    assert {x.doc_id: x.component_id for x in simhash.groups(make(spark, texts), simhash.SIMILAR).collect()} == dict(enumerate(up))
    prints = simhash.fingerprints(make(spark, ["a b c d e f", "a b c d e " * 3 + "f", "a b c d e " * 9 + "f"]), simhash.SIMILAR).collect()
    assert len({x.fp for x in prints if x.doc_id}) == 1 == len({x.nid for x in prints if x.doc_id})


def plain_similar(sets):
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)}


def test_groups_near_the_limit_are_exact(spark):
    """150 families of ten with similarities on both sides of 0.8: no link is lost, and none is made up."""
    r, texts, up, links = random.Random(12), [], [], collections.Counter()
    for i in range(150):
        base = [f"w{i}x{j}" for j in range(r.randint(90, 125))]
        family = [base]
        for _ in range(9):
            copy = list(r.choice(family[:3]))
            for at in r.sample(range(4, len(copy) - 4), r.choice([1, 2, 2, 2, 3])):
                copy[at] = f"n{r.random()}"
            family.append(copy)
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in family]
        own = list(range(10))
        for a, b in plain_similar(sets):
            links[round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 2)] += 1
            old, new = max(own[a], own[b]), min(own[a], own[b])
            own = [new if u == old else u for u in own]
        up += [10 * i + u for u in own]
        texts += [" ".join(w) for w in family]
    assert sum(n for s, n in links.items() if s < 0.85) > 300
    got = {x.doc_id: x.component_id for x in simhash.groups(make(spark, texts), simhash.SIMILAR).collect()}
    assert got == dict(enumerate(up)) and 150 < len(set(up)) < 1000


def test_components_after_some_rounds_are_parts_of_the_whole(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 120)], "a long, b long")
    some = [(x.node, x.root) for x in components(edges, 1).collect()]
    assert all((n < 100) == (m < 100) and m <= n for n, m in some) and {n for n, _ in some} == {*range(61), *range(100, 120)}
    assert {x.node: x.root for x in components(spark.createDataFrame(some, "a long, b long")).collect()} == {n: 100 if n >= 100 else 0 for n, _ in some}


def test_template_texts_lose_no_link(spark):
    r, texts = random.Random(5), []
    core = [f"c{j}" for j in range(110)]
    for i in range(150):  # every two of them share a long passage, but only a text and its copy are similar
        own = [f"o{i}x{j}" for j in range(30)]
        copy = list(core) + own
        for at in r.sample(range(len(copy)), 2):
            copy[at] = f"n{i}x{at}"
        texts += [" ".join(core + own), " ".join(copy)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))
    for i, j in plain_similar(sets):
        old, new = max(up[i], up[j]), min(up[i], up[j])
        up = [new if u == old else u for u in up]
    assert 100 < len(set(up)) < 250
    assert {x.doc_id: x.component_id for x in simhash.groups(make(spark, texts), simhash.SIMILAR).collect()} == dict(enumerate(up))


@pytest.mark.parametrize("items", [200, 10**6])
def test_links_between_groups_leave_no_pair_out(spark, monkeypatch, items):
    """Of all pairs that are similar, those of different groups, whatever the groups are."""
    monkeypatch.setattr(jaccard, "PART_ITEMS", items)
    r, texts = random.Random(6), [None, "", "a"]
    for i in range(60):
        words = {f"w{r.randrange(60 if i % 2 else 4000)}" for _ in range(r.choice([1, 4, 5, 10, 15, 40]))}
        texts += [" ".join(words), " ".join(list(words)[r.choice([0, 1, 2]) :] + ["new"] * r.choice([0, 1]))]
    tiles = jaccard.Settings(1, 80, 40)
    docs = make(spark, texts)
    sets = jaccard.sets_of(docs, tiles).where("n > 0")
    low = {}
    for x in sets.orderBy("doc_id").collect():
        low.setdefault(x.nid, x.doc_id)
    names = sorted(low)
    nodes = spark.createDataFrame(list(low.items()), "nid long, low long")
    want = plain_similar([set(texts[low[n]].split()) for n in names])
    assert len(want) > 20
    for grp in (range(len(names)), [i // 7 for i in range(len(names))], [0] * len(names)):
        grouped = spark.createDataFrame([(n, names[g]) for n, g in zip(names, grp)], "nid long, grp long")
        got = {(names.index(x.a), names.index(x.b)) for x in jaccard.links_between(sets, docs, nodes, grouped, tiles).collect()}
        assert got == {(i, j) for i, j in want if grp[i] != grp[j]}


def test_counting_a_part_takes_few_bytes_an_item():
    """Items of several groups, by a plain count; a part is held in less than 70 bytes an item (92 before)."""
    r = np.random.default_rng(3)
    sets, each = 4000, 100
    nid, items = r.permutation(sets) + 7, np.arange(each) * 10**4 + r.integers(0, 10**4, (sets, each))
    items[:10, 0] = 10**7  # of one group alone
    grp = np.where(np.arange(sets) < 10, 0, nid // 3)
    rows = [(nid[s : s + 50], np.full(50, 300), grp[s : s + 50], np.full(50, each), items[s : s + 50].ravel()) for s in range(0, sets, 50)]
    lines = pd.DataFrame([*rows, *rows[:2]], columns=["nid", "n", "grp", "size", "item"])
    tracemalloc.start()
    found = jaccard.count_part(lines, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * sets * each
    holders: dict[int, set[int]] = {}
    for i in range(sets):
        for x in items[i].tolist():
            holders.setdefault(x, set()).add(i)
    want = sorted((int(nid[i]), 300, x, len(held)) for x, held in holders.items() if len({int(grp[i]) for i in held}) > 1 for i in held)
    got = set(zip(*[np.concatenate(found[c].to_list()).tolist() for c in ("nid", "n", "item", "often")]))
    assert sorted(got) == want
    assert all((own % 9 == part).all() for part, own in zip(found["part"], found["nid"]))


def test_similar_texts_of_200_000_words(spark):
    """What is kept of long similar texts grows with their size, not with its square: some 20 bytes a word in all."""
    r, n, texts = random.Random(2), 200_000, []
    base = [f"w{r.randrange(10**6)}" for _ in range(n)]
    for k in range(10):
        copy = list(base)
        for at in r.sample(range(n), n // (100 if k < 5 else 12)):
            copy[at] = f"n{k}"
        texts.append(" ".join(copy))
    docs = common.materialise(make(spark, texts))
    with common.scratch() as folders:
        got = [x.component_id for x in simhash.groups(docs, simhash.SIMILAR).orderBy("doc_id").collect()]
    assert got == [0] * 5 + [5, 6, 7, 8, 9]
    size = sum(os.path.getsize(f"{at}/{f}") for folder in folders for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)
    assert size < 30 * n * len(texts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[200] == 199
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- op 4 ------------------------------------------------------------------------


def test_contamination_is_brute_force(spark, monkeypatch):
    r = random.Random(2)
    pool = ["w" + c for c in "abcdef"]
    item = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(str(i), item(n)) for i, n in enumerate([20, 30, 13, 5, 3, 14])] + [("short", "One-Two"), ("none", "!!"), ("null", None), ("0", "again other words for item zero " + item(13)), (None, "nameless item text")]
    texts = ODD + [item(200) for _ in range(20)] + [item(30) + " " + items[0][1].upper() + ", " + item(9), "say one two three", "Nameless... item\ttext", items[1][1] + "\n" + items[1][1]]

    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    def plain(t):
        w, hit, found = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(13, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        found.add(name or "")
        return len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)

    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id string, text string, n_words string")
    docs = make(spark, texts)
    for limit in (32 << 20, 300):  # one pass, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.judge(docs, bench).collect()}
        assert got == {i: plain(t) for i, t in enumerate(texts)}
        clean = decontaminate.keep_clean(docs, bench)
        assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {i for i, t in enumerate(texts) if not plain(t)[4]}
    assert decontaminate.judge(make(spark, []), bench).count() == 0
    assert decontaminate.judge(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# -- op 5 ------------------------------------------------------------------------


def test_shards_are_exact_and_whole(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 7)
    docs = make(spark, ODD + invented(200) + ["copy"] * 90)
    out = shards.shard_rows(docs, 24)
    rows = out.collect()
    assert sorted((x.doc_id, x.text or "") for x in rows) == sorted((x.doc_id, x.text or "") for x in docs.collect()) and out.columns[-2:] == ["shard", "slot"]
    sizes = collections.Counter(x["shard"] for x in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(24):
        assert sorted(x.slot for x in rows if x["shard"] == k) == list(range(sizes[k]))
    assert shards.shard_rows(make(spark, [])).count() == 0
    assert {x["shard"] for x in shards.shard_rows(make(spark, ["a", "b"])).collect()} == {0, 1}


def test_communication_matrix_is_hypergeometric():
    sizes = [40, 7, 0, 13]
    first = []
    for seed in range(400):
        m = shards.communication_matrix(sizes, 3, seed)
        assert m.sum(1).tolist() == sizes and m.sum(0).tolist() == [20, 20, 20] and (m >= 0).all()
        first.append(m[1, 0])
    assert abs(np.mean(first) - 7 / 3) < 0.2 and abs(np.var(first) - 7 * (1 / 3) * (2 / 3) * 53 / 59) < 0.35


@pytest.mark.parametrize("good, bad, drawn", [(5, 9, 7), (300, 4, 290), (4 * 10**8, 96 * 10**8, 10**7), (10**10, 3 * 10**10, 39 * 10**9), (10**12, 10**12, 3)])
def test_hypergeometric_moments(good, bad, drawn):
    """One law at every size, beyond 10**9 too: mean, variance and the middle of the distribution."""
    random, n = np.random.default_rng(2), good + bad
    mean, var = drawn * good / n, drawn * (good / n) * (bad / n) * (n - drawn) / (n - 1)
    x = np.array([shards._hypergeometric(random, good, bad, drawn) for _ in range(3000 if var < 10**6 else 500)])
    assert x.min() >= max(0, drawn - bad) and x.max() <= min(good, drawn)
    assert abs(x.mean() - mean) < 4 * (var / len(x)) ** 0.5 and abs(x.var() / var - 1) < 0.25
    if var > 1000:  # nearly normal
        assert abs(np.mean(np.abs(x - mean) < var**0.5) - 0.6827) < 0.07
    if n < 20:  # against every case
        for k in range(max(0, drawn - bad), min(good, drawn) + 1):
            assert abs(np.mean(x == k) - math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(n, drawn)) < 0.03


def test_matrix_margins_above_a_billion():
    sizes = [10**9 + 7, 3, 5 * 10**9, 0, 10**10]
    m = shards.communication_matrix(sizes, 24, 1)
    assert m.sum(1).tolist() == sizes and (m >= 0).all() and m.sum(0).max() - m.sum(0).min() <= 1


def test_op5_columns_are_plain_ones(spark, tmp_path):
    texts = ODD + invented(60) + ["copy"] * 30
    docs = make(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = shards.op5_shards(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and len({(x["shard"], x.slot) for x in rows}) == len(rows)
    for x in rows:
        b = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(b) + 8, zlib.crc32(b), "rows", None) and 0 <= x["shard"] < 24


# -- op 6 ------------------------------------------------------------------------


def test_toxicity_learns_insults(spark):
    r = random.Random(4)
    texts, labels = [], []
    for i, t in enumerate(invented(900, 9)):
        bad = i % 4 == 0
        w = t.split()
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w) + 1), r.choice(["zomglu", "vrexnik"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad), "x"))
    texts += ODD + ["abc v-r-e-x-n-i-k dag", "cab zomxglu dag"]
    odd = len(texts) - 2
    known = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, score string")
    docs = make(spark, texts)
    got = {x.doc_id: x for x in toxicity.judge(docs, known).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i, _, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert got[odd].predicted == got[odd + 1].predicted == 1 and got[900].predicted == 0
    assert toxicity.judge(docs, known.limit(0)).where("score <> 0").count() == 0
    assert toxicity.judge(make(spark, []), known).count() == 0


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver has no memory for the fit; the model is that of the same texts, but for rounding and the order of words."""
    texts = [f"{t} zomglu{i % 7}" if i % 3 == 0 else t for i, t in enumerate(invented(90, 4))]
    toxic = [int(i % 3 == 0) for i in range(90)]
    docs, labels = make(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    kept = [i for i in range(90) if zlib.crc32(str(i).encode()) % 5]
    driver, fit = os.getpid(), toxicity.fit
    want = fit(*zip(*[(texts[i], label) for label in (1, 0) for i in kept if toxic[i] == label]))

    def away(*given):
        assert os.getpid() != driver
        return fit(*given)

    monkeypatch.setattr(toxicity, "fit", away)
    got = toxicity.train(docs.repartition(7), labels)
    assert np.corrcoef(got.weights, want.weights)[0, 1] > 0.99 and np.allclose(got.scale, want.scale, rtol=0.05)
    assert toxicity.train(docs, labels.where("toxic = 1")).weights is None


def test_kernel_is_plain_kernel():
    words = ["idiot", "idxiot", "aaaa", "été"]
    row, feature, value = toxicity.features(words)
    for i, w in enumerate(words):
        plain = collections.Counter()
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                for c in range(b + 1, min(len(w), a + toxicity.SPAN)):
                    plain[w[a] + w[b] + w[c]] += toxicity.DECAY ** (c - a + 1)
        norm = sum(x * x for x in plain.values()) ** 0.5
        assert np.allclose(sorted(value[row == i]), sorted(x / norm for x in plain.values()))


# -- op 7 ------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://org", "http://ORG/", "https://a.b.org/x?y#z", "http://example.org/es/1", "http://m.example.org/en/12", "http://m.example.org/en/2", "http://notexample.org/es/", "http://example.com/de/x", "http://a.com/fr/?q=://b/", "http://com/de", "ftp://x.com/de/#f", "http://examples.org/es/", "://org/", "http://a..org/", "http://org./x", "http://a.org\n/x"] * 2
    rules = [*url_filter.RULES, ("block", "a.b.org/"), ("block", "b.org/x"), ("block", "noslash.net")]
    got = url_filter.judge(spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string"), rules).collect()
    assert len(got) == len(urls)
    for x in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[x.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules for h, p in [(r.split("/")[0], r[len(r.split("/")[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, best[2], best[3]), urls[x.page_id]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_of_any_length_and_many_labels(spark):
    long = "x" * 1_000_000
    urls = [f"http://a.org/{long}", f"http://{'l.' * 10_000}example.org/es/{long}", f"http://{long}.com/de/", f"http://{long}", f"http://example.org/en/1{long}?{long}", f"{long}://com/fr/x"] * 3
    got = {x.page_id: (len(x.host), len(x.path), x.rule, x.verdict) for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [(5, 1_000_001, "org/", "allow"), (20_011, 1_000_004, "example.org/es/", "block"), (1_000_004, 4, "com/de/", "block"), (1_000_000, 0, None, "allow"), (11, 1_000_005, "example.org/en/1", "block"), (3, 5, "com/fr/", "allow")]
    assert got == {i: want[i % 6] for i in range(18)}


def test_url_rules_nest_deeply_over_many_ranges(spark, monkeypatch):
    """Thousands of nested rules and many ranges of keys: ranges begin inside of open rules, and common paths are split."""
    monkeypatch.setattr(url_filter, "shuffle_partitions", lambda spark: 13)
    r = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "org", "a.org"]
    rules = set()
    while len(rules) < 2500:
        rules.add(r.choice(hosts) + "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 12))))
    rules |= {"a.com/" + "a" * n for n in range(60)} | {"/nohost", "b.org/\U0010ffff"}
    rules = [(r.choice(["allow", "block"]), x) for x in sorted(rules)]
    urls = ["http://" + r.choice(hosts + ["z.x.b.a.com", "nocom"]) + "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 15))) for _ in range(800)]
    urls += ["http://b.a.com/" + "a" * 40] * 300 + [f"http://h{i}.com/" for i in range(300)] + ["http://a.com/" + "a" * 80, "http://b.org/\U0010ffff\U0010ffffx"]
    given = {x: (len(x), len(x.split("/")[0]), x, v) for v, x in rules}
    found = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(found) == len(urls)
    for x in found:
        labels = x.host.split(".")
        fits = [given[k] for i in range(len(labels)) for n in range(len(x.path) + 1) if (k := ".".join(labels[i:]) + x.path[:n]) in given and "/" in k]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (x.rule, x.verdict) == (best[2], best[3]), urls[x.page_id]


# -- op 8 ------------------------------------------------------------------------


def plain_dedup(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {i: ((t or "").split("\n"), [x for x in (t or "").split("\n") if gone.get(key(x), i) == i]) for i, t in rows}


def test_line_dedup(spark, monkeypatch):
    r = random.Random(5)
    lines = [" A line that many documents have ", "a line that many documents have", "short one", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "ééééééééééééééééééé", "another of the frequent lines\t", "x" * 30_000]
    texts = ODD + ["\n".join(r.choice(lines + invented(3, k)) for _ in range(r.randint(1, 8))) for k in range(60)]
    docs = make(spark, texts)
    for limit in (64 << 20, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        want = plain_dedup(list(enumerate(texts)))
        got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in line_dedup.digest(docs).collect()}
        assert got == {i: (len(a), len(a) - len(b), sha("\n".join(b).encode())) for i, (a, b) in want.items()}
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {x.doc_id: x.text for x in out.collect()} == {i: None if texts[i] is None else "\n".join(b) for i, (_, b) in want.items()}
    assert line_dedup.digest(make(spark, [])).count() == 0
    # undone: what was inserted and deleted leaves no trace
    more = make(spark, ["a line that many documents have"] * 5, range(500, 505))
    state = line_dedup.LineIndex.of(docs)
    before = sorted((x.doc_id, sorted(x["keys"])) for x in state.drops().collect())
    assert sorted((x.doc_id, sorted(x["keys"])) for x in state.insert(more).delete(more).drops().collect()) == before
    left = [(i, t) for i, t in enumerate(texts) if i % 3]
    after = line_dedup.LineIndex.of(docs).delete(docs.where("doc_id % 3 = 0")).drops()
    assert {x.doc_id for x in after.collect()} == {i for i, (a, b) in plain_dedup(left).items() if len(a) > len(b)}


def test_line_changes_touch_their_shards_only(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    r = random.Random(9)
    pool = [f"line number {k} of the whole pool" for k in range(150)]
    texts = ["\n".join(r.sample(pool, 4)) for _ in range(80)]
    first = line_dedup.LineIndex.of(make(spark, texts))
    new = [(900, pool[0]), (901, pool[0] + "\n" + "a wholly new line of text"), (902, pool[0]), (7, texts[7])]
    docs = make(spark, [t for _, t in new], [i for i, _ in new])
    second = first.insert(docs)
    third = second.delete(make(spark, ["", ""], [901, 3]))

    def held(index):
        return {x.shard: x.version for x in index.versions.collect()}

    assert first.shards > 20 and len(held(first)) == first.shards
    shard = lambda line: line_dedup.key_hashes(line.encode())[0] % first.shards
    changed = lambda a, b: {s for s, v in held(a).items() if held(b)[s] != v}
    assert changed(first, second) == {shard(pool[0]), shard("a wholly new line of text")}
    assert changed(second, third) == {shard(x) for x in (pool[0] + "\na wholly new line of text\n" + texts[3]).split("\n")}

    def plain(rows):
        held = collections.defaultdict(set)
        for i, t in rows.items():
            for x in t.split("\n"):
                held[line_dedup.key_hashes(x.encode())].add(i)
        return {k: (len(v), max(v)) for k, v in held.items()}

    rows = dict(enumerate(texts))
    for index, now in ((first, rows), (second, rows | {i: t for i, t in new}), (third, {i: t for i, t in (rows | dict(new)).items() if i not in (901, 3)})):
        want = plain(now)
        assert {(x.k1, x.k2): (x.n_docs, x.last_doc) for x in index.counts().collect()} == want
        filters = {x.shard: line_dedup.CuckooFilter.from_bytes(x["filter"]) for x in index.filters().collect()}
        inside = {k for k in want if k[0] % index.shards in filters and filters[k[0] % index.shards].contains(np.array([k[1]]))[0]}
        assert {k for k, (n, _) in want.items() if n >= 3} == inside
        lost = {x.doc_id: {tuple(k) for k in x["keys"]} for x in index.drops().collect()}
        for i, t in now.items():
            keys = {line_dedup.key_hashes(x.encode()) for x in t.split("\n")}
            assert lost.get(i, set()) == {k for k in keys if want[k][0] >= 3 and want[k][1] != i}


def test_filters_that_outgrow_their_capacity_are_built_anew(spark):
    few, many = ["a line that three documents hold"] * 3, ["\n".join(f"line number {k} of many" for k in range(300))] * 3
    index = line_dedup.LineIndex.of(make(spark, few)).insert(make(spark, many, [10, 11, 12]))
    (held,) = index.filters().collect()
    assert held.n_keys == 301 and line_dedup.CuckooFilter.from_bytes(held["filter"]).capacity() >= 301
    assert {x.doc_id: len(x["keys"]) for x in index.drops().collect()} == {0: 1, 1: 1, 10: 300, 11: 300}
    empty = line_dedup.LineIndex.of(make(spark, []))
    assert empty.drops().count() == 0 and {x.doc_id for x in empty.insert(make(spark, few)).drops().collect()} == {0, 1}


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    f = line_dedup.CuckooFilter(3000)
    for k in keys[:3000]:
        f.insert(k)
    assert f.contains(keys[:3000]).all() and f.contains(keys[3000:]).mean() < 0.01
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert all(f.delete(k) for k in keys[:1500]) and f.contains(keys[1500:3000]).all() and f.contains(keys[:1500]).mean() < 0.01
    bulk = line_dedup.CuckooFilter.of(keys[:3000])
    assert bulk.contains(keys[:3000]).all() and bulk.contains(keys[3000:]).mean() < 0.01 and len(bulk.stash) < 10
    assert all(bulk.delete(k) for k in keys[:3000]) and not bulk.tags.any()
    small = line_dedup.CuckooFilter(8)
    for k in keys[:200]:
        small.insert(k)
    assert small.contains(keys[:200]).all()


# -- op 9 ------------------------------------------------------------------------


@pytest.mark.parametrize("part", [40_000, 150])
def test_neighbours(spark, monkeypatch, part):
    monkeypatch.setattr(neighbours, "PART_ROWS", part)
    r = np.random.default_rng(6)
    vectors = [v.tolist() for v in r.standard_normal((1200, 16)).astype(np.float32)]
    for i in range(300, 700):
        vectors[i] = vectors[300]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, "x") for i, v in enumerate(vectors + odd)] + [(None, vectors[0], "x"), (5, vectors[5], "x"), (50, vectors[50], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = neighbours.neighbours(table, table.where("vec_id % 50 = 0 or vec_id = 1206")).collect()
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for f in sorted(found, key=lambda f: (f.query_id, f["rank"])):
        got[f.query_id].append((f.vec_id, f.score))
    assert [v for v, _ in got.pop(1206)] == [1207]
    hits = total = 0
    for q in range(0, 1200, 50):
        score = x @ x[q]
        want = sorted((i for i in range(1200) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(s - score[v]) < 1e-9 for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len({v for v, _ in got[q]} & set(want))
        total += 5
    assert hits / total >= 0.9 and [v for v, _ in got[350]] == [300, 301, 302, 303, 304]
    assert set(got) == set(range(0, 1200, 50)) and neighbours.neighbours(table.limit(0), table).count() == 0


def recall(spark, folder):
    """Of op9 through Spark, against brute force; every query has its five."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for f in neighbours.op9_neighbours(spark, folder).collect():
        got[f.query_id].add(f.vec_id)
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert len(got) == len(asked) and all(len(v) == 5 for v in got.values())
    hits = 0
    for i in asked:
        score = x @ x[i]
        score[i] = -2
        hits += len(got[int(ids[i])] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    return hits / (5 * len(asked))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_recall(spark, sf):
    assert recall(spark, f"/root/testdata/{sf}") >= 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 9])
def test_neighbours_of_small_tables_are_all_candidates(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 64))
    table = spark.createDataFrame([(50 * i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    found = neighbours.neighbours(table, table).collect()
    for i in range(n):
        mine = sorted((f for f in found if f.query_id == 50 * i), key=lambda f: f["rank"])
        cos = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        want = sorted((j for j in range(n) if j != i), key=lambda j: -cos[j])[:5]
        assert len(mine) == min(5, n - 1) and [f["rank"] for f in mine] == list(range(1, len(mine) + 1))
        assert n > 6 or [f.vec_id for f in mine] == [50 * j for j in want]


def test_neighbours_of_a_common_bucket(spark, monkeypatch):
    """Nearly equal vectors in one bucket, cut by rows: with a probe each, only they are visited."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 30)
    r = np.random.default_rng(1)
    x = r.standard_normal(16) + 1e-4 * r.standard_normal((400, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.neighbours(table, table.where("vec_id % 50 = 0"), probes=30).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        score = u @ u[q]
        score[q] = -2
        assert {f.vec_id for f in found if f.query_id == q} == set(np.argsort(-score)[:5].tolist())


# -- op 10 -----------------------------------------------------------------------


def kept(page, *templates):
    p = html_text.parse(page)
    return html_text.left(p.parents, p.hashes, p.shapes, p.blocks, set(templates))


def shapes(page):
    return [x for x in html_text.parse(page).shapes if x]


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
    <nav><ul><li>no<li>no</ul></nav><!-- no > no --><div class="top-ad">no</div><article><header>no</header><h1>Caf&eacute; &amp;&nbsp;more</h1><p><b>One  two<br>three<p>four &lt;b&gt; <i>five</i><button>no</button>.
    <aside>no</aside><ul><li>six<li>seven</ul><table><tr><td>a<td>b</table><form>no</form><section role="navigation"><article>no</article></section><p hidden>no</p></article><footer>no &copy;</footer></body></html>"""
    assert kept(page) == ["Café & more", "One two", "three", "four <b> five.", "six", "seven", "a", "b"]
    assert kept("a &am <p>b</b></p> c < d &#x41;") == ["a &am", "b", "c < d A"]
    assert kept(None) == kept("") == kept("<script>x") == []
    assert kept("<p>x" * 3000) == ["x"] * 3000
    assert kept("<main>x</main><article></article>y") == ["x"] and kept("<p>a<svg><text>no</text></svg> b") == ["a b"]


def test_html_names_of_content_are_no_furniture():
    for name in ("post-with-sidebar", "article-header", "ad-hoc", "results share-results", "has-ads", "download", "advice"):
        assert not shapes(f'<div class="{name}">x</div>'), name
    for name in ("ad", "site-footer", "mainNav", "x cookie_notice", "sidebar1"):
        page = f'<p>y<div id="{name}">x</div>'
        assert len(shapes(page)) == 1 and kept(page, *shapes(page)) == ["y"] and kept(page) == ["y", "x"]
        assert not shapes(f'<p>y <span id="{name}">x</span>') and kept(f'<p>y <span id="{name}">x</span> z') == ["y x z"]


def test_html_templates(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div>Site name</div><p>Text {i}</p><p>Shared by few</p></body>" if i < 3 else f"<body><div>Site name</div><p>Text {i}</p></body>", "x") for i in range(20)]
    rows += [(100 + i, f"http://b.org/{i}", "<article><p>The same article</p></article>", "x") for i in range(30)]
    rows += [(200, None, None, "x"), (201, "http://a.org/", "", "x"), (0, "http://a.org/0", rows[0][2], "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    text = {x.page_id: x.text for x in got}
    assert text[5] == "Text 5" and text[0] == "Text 0\nShared by few" and text[110] == "The same article" and text[200] == text[201] == ""
    assert all(x.n_chars == len(x.text) for x in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_decide_without_names_and_tags(spark):
    """Menus, footers and notices of a host go by their recurrence alone; counts are a plain count's."""
    none = html_text.Rules(frozenset(), frozenset(), frozenset())
    r, rows = random.Random(3), []
    chrome = {h: [f"<ul><li>{h} menu</li><li>more</li></ul>", f"<footer><p>{h} imprint</p></footer>", f"<div>Notice of {h}</div>"] for h in ("a.org", "b.org", "c.org")}
    for h, n in (("a.org", 40), ("b.org", 12), ("c.org", 5)):
        for i in range(n):
            top, foot, note = (c if r.random() < 0.8 or k < 2 else "" for k, c in enumerate(chrome[h]))
            rows.append((len(rows), f"http://{h}/{i}", f"<body>{top}<div><h2>Title {i % 30}</h2><p>Text {i % 30} of {h}</p><p>Same line</p></div>{note}{foot}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    held, whole = collections.Counter(), collections.defaultdict(set)
    firsts = {}
    for _, url, page in rows:
        p, host = html_text.parse(page, none), url.split("/")[2]
        firsts.setdefault((host, p.whole), set()).add(tuple(sorted({x for x in p.hashes if x})))
        whole[host].add(p.whole)
    assert all(len(x) == 1 for x in firsts.values())
    for (host, _), (subtrees,) in firsts.items():
        held.update((host, x) for x in subtrees)
    want = {(h, x) for (h, x), n in held.items() if n >= 10 and n >= 0.5 * len(whole[h])}
    templates = html_text.templates_of(html_text.blocks_of(pages, none))
    assert {(t.host, t.subtree) for t in templates.collect()} == want and want
    for x in html_text.extract(pages, rules=none).collect():
        n = int(x.url.split("/")[3]) % 30
        host = x.url.split("/")[2]
        if host == "c.org":
            assert "menu" in x.text
        else:
            assert x.text == f"Title {n}\nText {n} of {host}"


def test_html_adverts_that_differ_are_one_shape(spark):
    page = lambda i, name: f'<div class="{name}">Buy {i * 7} now</div><p>Text {i}</p>'
    rows = [(i, "http://a.org/", page(i, "ad")) for i in range(30)] + [(50 + i, "http://a.org/", page(50 + i, "notice")) for i in range(4)] + [(90 + i, "http://b.org/", page(90 + i, "ad")) for i in range(4)]
    text = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # an advert on many pages goes; a name that few pages have isn't shown to be template, on a large host or on small ones
    assert all(text[i] == f"Text {i}" for i in range(30)) and all(text[i] == f"Buy {i * 7} now\nText {i}" for i in [*range(50, 54), *range(90, 94)])
    # small hosts are counted together
    rows += [(100 + i, f"http://c{i}.org/", page(100 + i, "ad")) for i in range(9)]
    text = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == f"Text {i}" for i in [*range(30), *range(90, 94), *range(100, 109)])


def test_html_templates_change_the_texts_of_large_hosts(spark):
    """Without the template step, boxes in articles and on pages without regions stay; shapes need a share of the host, too."""
    rows = [(i, "http://a.org/", f'<article><p>Text {i}</p><div class="ad">Buy {i}</div><p>More {i}</p><div>Follow us</div></article>') for i in range(40)]
    rows += [(100 + i, "http://b.org/", f'<p>Text {i}</p><div class="notice">Note {i}</div>' if i < 12 else f"<p>Text {i}</p>") for i in range(1300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    none = spark.createDataFrame([], "host string, subtree long")
    with_, without = ({x.page_id: x.text for x in html_text.extract(pages, templates=t).collect()} for t in (None, none))
    assert all(with_[i] == f"Text {i}\nMore {i}" and without[i] == f"Text {i}\nBuy {i}\nMore {i}\nFollow us" for i in range(40))
    assert all(with_[100 + i] == without[100 + i] == (f"Text {i}\nNote {i}" if i < 12 else f"Text {i}") for i in range(1300))


def test_html_forms_and_headers_that_hold_the_text():
    assert kept("<body><form><h1>Title</h1><p>Some text of the page</p><button>Send</button></form><p>x</p></body>") == ["Title", "Some text of the page", "x"]
    assert kept("<body><form><article><p>Text</p></article><footer>no</footer></form><p>Longer text outside of it</p></body>") == ["Text"]
    assert kept("<p>Some text of the page</p><form><p>Your name</p></form>") == ["Some text of the page"]
    assert kept("<article><header><h1>Head <b>line</b></h1><p>By no one</p></header><p>Text</p></article>") == ["Head line", "Text"]
    assert kept("<header><h1>Site</h1></header><p>Text</p>") == ["Text"] and kept("<header><main><p>Text</p></main></header>") == ["Text"]


def test_html_of_any_depth_and_length():
    n = 200_000
    for page in ("<div>" * n + "x", "<b>" * n + "x" + "</p>" * n, "<p><button>" + "<div>" * n + "x", "<ul><li>" * (n // 2) + "x", "</i>" * n + "x", "<div class=ad>" * n + "x" + "</div>" * n, "<form>" * n + "<p>x"):
        began = time.process_time()
        found = html_text.parse(page)
        assert len(found.parents) <= n + 2 and [t for t, *_ in found.blocks] == ["x"] and time.process_time() - began < 30
        html_text.left(found.parents, found.hashes, found.shapes, found.blocks, set())
