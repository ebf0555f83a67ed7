"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Kernel: two words are alike by the three-letter subsequences that they share, each
weighted ``DECAY ** (letters spanned)`` with at most ``SPAN`` letters spanned,
normalised to length 1. A letter put into an insult, or one left out, moves some weights
and spoils few. Before that, signs inside a word are dropped, digits and signs that
stand for letters are read as those, and letters set apart by single spaces are joined.

Landmarks: ``LANDMARKS`` words of the training texts, the most telling ones and some
others. A word's Nyström features are its kernel values with them, whitened; a linear
function of those is a linear function of the subsequences, so that after training one
weight for each subsequence is left, and words are scored without the landmarks.

Training: a text is labelled, its words are not. As in multiple-instance SVMs, a toxic
text stands for its most toxic words under the present function, a clean one for its
most toxic words too, over some rounds; in the last, toxic words stand there with a
letter put in, too, so that such words are on the toxic side of the scale. A text's score comes from its two highest
words and is put on the scale of a probability.

The fit uses a bounded sample: at most ``SAMPLE_TEXTS`` labelled texts of each class, of at
most ``SAMPLE_BYTES`` bytes each, the first by a hash of their doc_id. All documents are
scored, over their whole texts; scoring is a map with no shuffle.

Null, empty and wordless texts have the score that a text with harmless words has at
most. Labels that are null are left out; of contradicting labels of a doc_id the larger
counts. With labels of one class only, or none, every score is 0. Repeated rows have one score, each for itself. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import bound_batches, read

SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 20_000
LANDMARKS, SPAN, DECAY, ROUNDS = 256, 6, 0.6, 5
#: Weight of toxic words with a letter put in against those as they are.
ALTERED = 0.1
#: Longer words are cut into overlapping pieces of this many letters.
PIECE = 24
#: Words whose values a worker keeps; beyond it the memo starts anew.
MEMO_WORDS = 250_000
#: Texts and pieces of words that a worker takes at once; bounds its memory, not its results.
LOT_TEXTS, LOT_PIECES = 100, 5_000
#: What digits and signs inside a word stand for (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

_APART = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
FEATURES = 1 << 18


def tokens(text: str | None) -> set[str]:
    """The different words of a text, as written."""
    text = (text or "").lower()
    found = set(text.split())
    for run in _APART.findall(text):
        found.add(_NOT_LETTERS.sub("", run))
    return found


def letters(token: str) -> list[str]:
    """What of a token is compared: letters only, in pieces of bounded length."""
    if not token.isalpha():
        token = _NOT_LETTERS.sub("", _EDGES.sub("", token).translate(LOOKALIKES))
    if len(token) < 3:
        return []
    return [token] if len(token) <= PIECE else [token[i : i + PIECE] for i in range(0, len(token) - PIECE // 2, PIECE // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Letters as 1 to 63, rows padded with 0: a to z are 1 to 26, all others share what is left."""
    raw = np.frombuffer("".join(w.ljust(PIECE, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), PIECE)
    code = np.where((raw >= 97) & (raw <= 122), raw - 96, raw % 37 + 27)
    return np.where(raw == 0, 0, code).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, subsequence and value of the normalised features of words (of at most ``PIECE`` letters)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, keys, values = _codes(words), [], []
    row = np.arange(len(words), dtype=np.int64)[:, None] << 18
    for b in range(2, SPAN):
        for a in range(1, b):
            first, mid, last = codes[:, : PIECE - b], codes[:, a : PIECE - b + a], codes[:, b:]
            there = last > 0
            keys.append((row | first << 12 | mid << 6 | last)[there])
            values.append(np.full(len(keys[-1]), DECAY ** (b + 1)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(at, np.concatenate(values), len(key))
    row = key >> 18
    return row, key & FEATURES - 1, value / np.sqrt(np.bincount(row, value**2, len(words)))[row]


@dataclass
class Model:
    """Weights of the subsequences, and of a text's highest and second word."""

    weights: np.ndarray | None = None
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def values(self, words: list[str]) -> np.ndarray:
        """The function at each word; the highest of its pieces."""
        pieces, of = [], []
        for i, w in enumerate(words):
            for piece in letters(w):
                pieces.append(piece)
                of.append(i)
        out = np.full(len(words), 0.0)
        at = np.array(of, np.int64)
        for s in range(0, len(pieces), LOT_PIECES):
            row, feature, value = features(pieces[s : s + LOT_PIECES])
            f = np.bincount(row, value * self.weights[feature], min(LOT_PIECES, len(pieces) - s))
            np.maximum.at(out, at[s : s + LOT_PIECES], f)
        return out

    def probability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a * first + b * second + c, -30, 30)))


def _two_highest(values: np.ndarray, words_of: list[np.ndarray]) -> np.ndarray:
    """The two highest values of each text, at least 0."""
    out = np.zeros((len(words_of), 2))
    for i, w in enumerate(words_of):
        if len(w):
            top = np.sort(values[w])[-2:][::-1]
            out[i, : len(top)] = np.maximum(top, 0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reach: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps. y is 1 or -1."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(ridge / reach + xa.T @ (xa * wa[:, None]), xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], seed: int = 0) -> Model:
    """Fit on a bounded list of texts and their labels."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return Model()
    random = np.random.default_rng(seed)
    number: dict[str, int] = {}
    words_of = []
    for text in texts:
        mine = {piece for t in tokens(text) for piece in letters(t)}
        words_of.append(np.array(sorted(number.setdefault(w, len(number)) for w in mine), np.int64))
    words = list(number)
    if not words:
        return Model()
    text_of = np.repeat(np.arange(len(words_of)), [len(w) for w in words_of])
    word_of = np.concatenate(words_of)
    parts = [(r.astype(np.int32) + s, f.astype(np.int32), v.astype(np.float32)) for s in range(0, len(words), 20_000) for r, f, v in [features(words[s : s + 20_000])]]

    def by_word(weights: np.ndarray) -> np.ndarray:
        return sum(np.bincount(r, v * weights[f], len(words)) for r, f, v in parts)

    def by_feature(of_word: np.ndarray) -> np.ndarray:
        return sum(np.bincount(f, v * of_word[r], FEATURES) for r, f, v in parts)

    # how telling a word is: the log odds of its texts' labels, smoothed over words with the same subsequences
    positive, n_positive = y.sum(), len(y)
    base = positive / n_positive
    seen = np.bincount(word_of, minlength=len(words))
    seen_toxic = np.bincount(word_of, y[text_of], len(words))
    mass = by_feature(seen) + 1e-9
    mass_toxic = by_feature(seen_toxic)
    odds = lambda a, n: np.log((a + 2 * base) / (n - a + 2 * (1 - base)) * (1 - base) / base)
    telling = odds(mass_toxic, mass)
    score = by_word(telling) / 3 + odds(seen_toxic, seen)
    order = np.argsort(-score, kind="stable")
    rest = order[LANDMARKS * 3 // 4 :]
    marks = np.concatenate([order[: LANDMARKS * 3 // 4], random.choice(rest, min(LANDMARKS // 4, len(rest)), replace=False)])

    # Nyström: kernel with the landmarks, whitened by the landmarks' own kernel
    r, f, v = features([words[i] for i in marks])
    used, at = np.unique(f, return_inverse=True)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    landmarks = np.zeros((len(marks), len(used)))
    landmarks[r, at] = v
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    project = landmarks.T @ whiten

    def nystrom(words: list[str]) -> np.ndarray:
        r, f, v = features(words)
        known = place[f] >= 0
        out = np.zeros((len(words), project.shape[1]))
        for s in range(0, len(words), 1000):
            own = known & (r >= s) & (r < s + 1000)
            part = np.zeros((min(1000, len(words) - s), len(used)))
            part[r[own] - s, place[f[own]]] = v[own]
            out[s : s + 1000] = part @ project
        return out

    f_of = score - np.quantile(score, 0.9)
    for step in range(ROUNDS):
        chosen: dict[tuple[str, int], float] = {}
        shown: list[tuple[int, list[str]]] = []
        for i, w in enumerate(words_of):
            if not len(w):
                continue
            best = w[np.argsort(-f_of[w], kind="stable")[: 2 if y[i] else 4]]
            if y[i]:  # the highest word, and the second where it is toxic by itself
                best = best[: 1 + int(len(best) > 1 and f_of[best[1]] > 0)]
                if step == ROUNDS - 1:  # the same words with a letter put in are as toxic
                    shown.append((i, [_with_a_letter(words[j], random) for j in best]))
                    for word in shown[-1][1]:
                        chosen[word, 1] = chosen.get((word, 1), 0) + ALTERED
            for j in best:
                key = (words[j], 1 if y[i] else -1)
                chosen[key] = chosen.get(key, 0) + 1
        sign, weight = np.array([k[1] for k in chosen]), np.array(list(chosen.values()), float)
        for s in (1, -1):
            weight[sign == s] /= max(1.0, weight[sign == s].sum())
        w, bias = _svm(nystrom([k[0] for k in chosen]), sign.astype(float), weight * len(weight) / 2)
        weights = np.zeros(FEATURES)
        weights[used] = project @ w
        f_of = by_word(weights) + bias
    # the offset goes into the text's scale, so that a word without known subsequences has the value 0
    highest = _two_highest(f_of - bias, words_of)
    model = Model(weights.astype(np.float32))
    altered = np.zeros((len(shown), 2))
    for k, (i, held) in enumerate(shown):
        altered[k, : len(held)] = np.maximum(np.sort(model.values(held))[::-1], 0)
    model.scale = tuple(float(x) for x in _logistic(np.vstack([highest, altered]), np.append(y, np.ones(len(shown))).astype(float), np.append(np.ones(len(y)), np.full(len(shown), ALTERED))))
    return model


def _with_a_letter(word: str, random: np.random.Generator) -> str:
    at = int(random.integers(1, len(word)))
    return (word[:at] + "abcdefghijklmnopqrstuvwxyz"[random.integers(26)] + word[at:])[:PIECE]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, label``: the bounded training sample, toxic texts first, in a fixed order in one partition."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = []
    for label in (1, 0):  # ids first: texts are fetched for the chosen ones only
        chosen = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS)
        rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(chosen.select("doc_id"), "doc_id")
        out.append(rows.distinct().orderBy("doc_id", "text").limit(SAMPLE_TEXTS).select("text", F.lit(label).alias("label")))
    return out[0].unionByName(out[1]).coalesce(1)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The fit takes some hundred MB, which a task has and the driver needn't have; the model alone comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, label) for batch in batches for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows.sort(key=lambda x: -x[1])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for t, _ in rows], [label for _, label in rows]))], pa.binary())], names=["model"])

    found = sample(docs, labels).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else Model()


def score(docs: DataFrame, model: Model, keep: bool = False, named: str = "score") -> DataFrame:
    """``doc_id, score`` of every document, or, with ``keep``, all columns and ``score double``, which may have another name; it takes the place of a column of that name."""
    columns = [c for c in docs.columns if c != named] if keep else ["doc_id", "text"]
    source = docs.select(*[f"`{c}`" for c in columns])
    names = [*columns, named] if keep else ["doc_id", named]
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = held.value, {}
        for batch in batches:
            texts = batch.column(columns.index("text"))
            top = np.zeros((len(texts), 2))
            for s in range(0, len(texts) if model.weights is not None else 0, LOT_TEXTS):
                lot = [tokens(t) for t in texts.slice(s, LOT_TEXTS).to_pylist()]
                new = list({w for words in lot for w in words if w not in memo})
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = list(set().union(*lot))
                memo.update(zip(new, model.values(new).tolist()))
                for i, words in enumerate(lot):
                    best = sorted([memo[w] for w in words], reverse=True)[:2]
                    top[s + i, : len(best)] = best
            value = model.probability(top[:, 0], top[:, 1]) if model.weights is not None else np.zeros(len(texts))
            kept = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(value, pa.float64())], names=names)

    from pyspark.sql.types import DoubleType, StructType

    return source.mapInArrow(run, StructType([f for f in source.schema.fields if f.name in names]).add(named, DoubleType()))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all of their columns, whatever these are named."""
    named, taken = "score", {c.lower() for c in docs.columns}
    while named in taken:
        named = f"_{named}"
    return score(docs, model, True, named).where(F.col(named) < 0.5).select(*[f"`{c}`" for c in docs.columns])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
