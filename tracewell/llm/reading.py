"""Reading level of documents from the levels of their sentences.

A character model and a word model, both ridge-regularised and linear on hashed features, score each sentence; cumulative
logits turn the score into a distribution over ``LEVELS`` levels. A document's distribution is the mean of those of its
sentences, weighted by words, and its difficulty is the expected level, calibrated on documents to the scale of the labels.

There are no human labels in the data, so the models learn weak ones that know neither the length of words nor of sentences:
how rare the words of a sentence are in general language, by their ranks in the vocabulary of a public tokenizer, which
lists what is frequent first, and how much it is divided into clauses, by its marks. Both are in bits; their sum is cut at
``CUTS``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prose import letters, prose_paragraphs, sentences
from .tokens import default_vocabulary, encoding
from .words import WordHashes

CUTS = (10.7, 11.4, 12.8, 14.3)
LEVELS = len(CUTS) + 1
DIM = 1 << 15
#: Bounds of the labelled sample: documents (expected number) by hash, and sentences by least hash among theirs.
SAMPLE_DOCS, SAMPLE_SENTENCES = 1_500, 12_000
ROWS = "doc_id long, n_sentences int, n_words int, n_letters long, " + ", ".join(f"level_{k} double" for k in range(LEVELS)) + ", difficulty double"


class Rarity(dict):
    """word -> bits of rarity: log2 of its rank if the vocabulary knows it as one piece, else of the vocabulary's size."""

    def __init__(self, path: str):
        self.encode, self.most = encoding(path).encode_ordinary, encoding(path).n_vocab

    def __missing__(self, word: str) -> float:
        pieces = self.encode(" " + word)
        bits = self[word] = math.log2(1 + (pieces[0] if len(pieces) == 1 else self.most))
        return bits


_ALPHA, _MARK = re.compile(r"[^\W\d_]+"), re.compile(r"[,;:()\u2013\u2014]")


def label(text: str, rarity: Rarity) -> float:
    """Mean rarity of the words of a sentence (letters only, in lower case) and the logarithm of its clauses; 0 without words."""
    words = _ALPHA.findall(text.lower())
    return sum(rarity[w] for w in words) / len(words) + math.log2(1 + len(_MARK.findall(text))) if words else 0.0


@dataclass
class Split:
    """Sentences of some documents: texts, the document of each, words and letters of each."""

    texts: list[str]
    owner: np.ndarray
    words: np.ndarray
    chars: np.ndarray


def split(texts: list[str | None]) -> Split:
    out, owner, n_words, n_chars = [], [], [], []
    for i, text in enumerate(texts):
        for paragraph in prose_paragraphs(text):
            for s in sentences(paragraph):
                if not (c := letters(s)):
                    continue
                out.append(s)
                owner.append(i)
                n_words.append(s.count(" ") + 1 if s.isascii() and "  " not in s and "\t" not in s else len(s.split()))
                n_chars.append(c)
    return Split(out, np.array(owner, np.int64), np.array(n_words, np.int64), np.array(n_chars, np.int64))


def character_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all sentences in a row, and where each sentence begins; a blank stands at both ends."""
    raw = [b"  " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    sizes = np.array([len(r) - 2 for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
    index = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    # Trigrams that reach into the next sentence are its two opening blanks and are left out by position.
    keep = np.ones(len(index), bool)
    ends = starts + sizes
    for k in (0, 1):
        e = ends + k
        keep[e[e < len(keep)]] = False
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return index[keep], begins


def word_features(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all sentences, each sentence with a mark of its length, and where each begins."""
    lists = [t.lower().split() for t in texts]
    flat = [w for ws in lists for w in (*ws, f"\0length {min(40, len(ws)) // 2}")]
    index = (hashes.of(flat) & np.uint64(DIM - 1)).astype(np.int32)
    sizes = np.array([len(ws) + 1 for ws in lists], np.int64)
    return index, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def means(weights: np.ndarray, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Mean weight of the features of each sentence; no sentence is empty."""
    sizes = np.diff(np.append(begins, len(index)))
    return np.add.reduceat(weights[index], begins) / sizes


def ridge(index: np.ndarray, begins: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge regression of ``target`` on mean features, by conjugate gradients."""
    n, sizes = len(begins), np.diff(np.append(begins, len(index)))
    row, value = np.repeat(np.arange(n), sizes), np.repeat(1.0 / sizes, sizes)
    back = lambda r: np.bincount(index, value * r[row], DIM)
    w = np.zeros(DIM)
    g = back(target)
    p, gg = g.copy(), g @ g
    for _ in range(rounds):
        if gg < 1e-12:
            break
        ap = back(means(p, index, begins)) + penalty * p
        step = gg / (p @ ap)
        w += step * p
        g -= step * ap
        new = g @ g
        p, gg = g + (new / gg) * p, new
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of P(y) = 1 / (1 + exp(-(slope x + offset))), by damped Newton steps with a slight penalty."""
    a, b = 1.0, -float(np.mean(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p)
        ga, gb = np.sum((p - y) * x) + 1e-2 * a, np.sum(p - y) + 1e-2 * b
        h = np.array([[np.sum(v * x * x) + 1e-2, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-2]])
        da, db = np.linalg.solve(h, [ga, gb])
        size = max(1.0, abs(da) / 2, abs(db) / 4)
        a, b = a - da / size, b - db / size
    return float(a), float(b)


@dataclass
class LevelModel:
    """Weights of both models, their mix, one cumulative logit for each cut, and the calibration of documents."""

    chars: np.ndarray
    words: np.ndarray
    mix: tuple[float, float, float]
    logits: list[tuple[float, float]]
    scale: tuple[list[float], list[float]]

    def score(self, texts: list[str], hashes: WordHashes) -> np.ndarray:
        c, w, o = self.mix
        return c * means(self.chars, *character_features(texts)) + w * means(self.words, *word_features(texts, hashes)) + o

    def levels(self, score: np.ndarray) -> np.ndarray:
        """Distribution over levels for each score."""
        above = np.stack([1 / (1 + np.exp(-np.clip(a * score + b, -30, 30))) for a, b in self.logits])
        above = np.minimum.accumulate(above, axis=0)
        full = np.concatenate([np.ones((1, len(score))), above, np.zeros((1, len(score)))])
        return (full[:-1] - full[1:]).T

    def calibrated(self, expected: float) -> float:
        """The step line of the calibration, carried on beyond its ends by their mean slope, so that nothing is clamped."""
        xs, ys = self.scale
        slope = (ys[-1] - ys[0]) / (xs[-1] - xs[0]) if len(xs) > 1 and xs[-1] > xs[0] else 1.0
        return float(np.interp(expected, xs, ys)) + slope * (min(0.0, expected - xs[0]) + max(0.0, expected - xs[-1]))


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic regression of y on x (pools adjacent violators): knots, at least two, of a rising step line."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order], strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    xs, ys = [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]
    return xs, ys


def fit(texts: list[str], words: np.ndarray, labels: np.ndarray, owner: np.ndarray, penalty: float = 0.02) -> LevelModel | None:
    """Models of labelled sentences, ``words`` their weights; None if there are none (no document has prose then)."""
    if not texts:
        return None
    level = np.searchsorted(CUTS, labels, side="right").astype(float)
    hashes = WordHashes()
    cf, wf = character_features(texts), word_features(texts, hashes)
    mean = level.mean()
    wc, ww = ridge(*cf, level - mean, penalty), ridge(*wf, level - mean, penalty)
    sc, sw = means(wc, *cf), means(ww, *wf)
    x = np.stack([sc, sw, np.ones(len(sc))], 1)
    mix = np.linalg.solve(x.T @ x + 1e-3 * np.eye(3), x.T @ level)
    score = x @ mix
    logits = [logistic(score, (level > k).astype(float)) for k in range(LEVELS - 1)]
    model = LevelModel(wc.astype(np.float32), ww.astype(np.float32), tuple(float(m) for m in mix), logits, ([0.0, 1.0], [0.0, 1.0]))
    expected = model.levels(score) @ np.arange(LEVELS)
    n = owner.max() + 1
    total = np.bincount(owner, words, n)
    has = total > 0
    e, g = (np.bincount(owner, x * words, n)[has] / total[has] for x in (expected, labels))
    model.scale = rising(e, g, total[has])
    return model


def sampled(documents: DataFrame, docs: int = SAMPLE_DOCS, limit: int = SAMPLE_SENTENCES, vocabulary: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The labelled sample (sentences, words, labels, documents): of about ``docs`` documents, taken by a hash of id and
    text, the ``limit`` sentences of least hash. Only sentences come to the driver."""
    h = F.xxhash64(F.lit("reading"), "doc_id", "text")
    known = documents.filter("text is not null")
    share = min(1.0, docs / max(1, known.count()))
    chosen = known.select("doc_id", "text", h.alias("h")).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = split(batch.column(1).to_pylist())
            hs = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([hs[i] for i in got.owner.tolist()], pa.int64()), pa.array(got.texts, pa.string()), pa.array(got.words)], ["h", "s", "w"])

    rows = chosen.mapInArrow(run, "h long, s string, w long").orderBy(F.xxhash64("h", "s"), "h", "s").limit(limit).collect()
    ids = {h: i for i, h in enumerate(sorted({r["h"] for r in rows}))}
    rarity = Rarity(vocabulary or default_vocabulary())
    labels = np.array([label(r["s"], rarity) for r in rows])
    return [r["s"] for r in rows], np.array([r["w"] for r in rows], np.int64), labels, np.array([ids[r["h"]] for r in rows], np.int64)


def _levels(model: LevelModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(ids):
                size, end = 0, at
                while end < len(ids) and size < 1_000_000:
                    size += len(texts[end] or "")
                    end += 1
                yield _rows(ids[at:end], texts[at:end], model, hashes)
                at = end

    return run


def _rows(ids: list, texts: list, model: LevelModel | None, hashes: WordHashes) -> pa.RecordBatch:
    got, n = split(texts), len(ids)
    count = np.bincount(got.owner, minlength=n)
    words, chars = np.bincount(got.owner, got.words, n), np.bincount(got.owner, got.chars, n)
    shares = np.zeros((n, LEVELS))
    if got.texts and model is not None:
        each = np.empty((len(got.texts), LEVELS))
        begin, size = 0, 0
        for i, t in enumerate(got.texts):  # features of a bounded number of letters at a time
            size += len(t)
            if size > 2_000_000 or i == len(got.texts) - 1:
                each[begin : i + 1] = model.levels(model.score(got.texts[begin : i + 1], hashes))
                begin, size = i + 1, 0
        for k in range(LEVELS):
            shares[:, k] = np.bincount(got.owner, each[:, k] * got.words, n)
        shares /= np.maximum(words, 1)[:, None]
    expected = shares @ np.arange(LEVELS)
    hard = [model.calibrated(x) if c and model is not None else None for x, c in zip(expected, count, strict=True)]
    part = [pa.array([float(v) if c and model is not None else None for v, c in zip(shares[:, k], count, strict=True)], pa.float64()) for k in range(LEVELS)]
    names = ["doc_id", "n_sentences", "n_words", "n_letters", *(f"level_{k}" for k in range(LEVELS)), "difficulty"]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int32()), pa.array(words.astype(np.int64), pa.int32()), pa.array(chars.astype(np.int64), pa.int64()), *part, pa.array(hard, pa.float64())], names)


def reading_levels(documents: DataFrame, docs: int = SAMPLE_DOCS, limit: int = SAMPLE_SENTENCES, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``): ``n_sentences``, ``n_words``, ``n_letters`` of its prose,
    ``level_0`` ... the distribution of its sentences over levels weighted by words, ``difficulty`` in the bits of the labels.

    Prose is what is outside code, logs, traces, tables, headings and lists. Documents without prose, with null or blank
    text among them, have counts of 0 and null levels. The models learn from about ``docs`` documents and at most ``limit``
    sentences, from one sentence on, with labels by the ``vocabulary`` (a rank file of a public tokenizer, read on the driver
    only); all documents are read whole and classified.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    model = fit(*sampled(documents, docs, limit, vocabulary))
    return documents.mapInArrow(_levels(model), ROWS)
