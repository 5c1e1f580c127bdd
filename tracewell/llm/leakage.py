"""Evaluation texts leaking into training text, by size-partitioned MinHash containment search.

Sets of word shingles are compared with windows of documents. Sets are parted by size, and each part has its own window: the
containment that is asked for, the part's sizes and its window give the least Jaccard similarity of a true pair, from which
the hashes that have to agree follow (``SizePart``). What is found is verified by exact comparison.

* ``leaked_passages`` looks for passages of ``passage`` words of the items. All of these sets have one size, and the window is
  as long as the passage, so a passage that is contained is equal: Jaccard 1, all hashes agree, no true pair is missed.
* ``contained_items`` looks for whole items of which a share of the shingles occurs close together. Items of a part have
  between ``low`` and ``2 low - 1`` shingles, windows twice as many as the largest, at steps of half a window.

Items are a stated query set: an index of at most ``INDEX_CHARS`` characters of them at a time is sent to the tasks, and each
such block is looked for in all documents. Texts of documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .words import WordHashes, mix, shingle_hashes, sliding_min, word_pieces

PASSAGE, SHINGLE = 12, 5
#: Characters of items in one index (about ten times as many bytes in each Python worker); more make further blocks.
INDEX_CHARS = 8_000_000
#: Hashes of a passage's signature, which all have to agree, and of an item's, of which one has to.
PASSAGE_HASHES, ITEM_HASHES = 3, 32
#: Words of documents that are looked at together.
SCAN_WORDS = 200_000
HITS = "item_id long, doc_id long, longest_run int, passages int, item_passages int"
SHARES = "item_id long, doc_id long, estimate double, containment double"


@dataclass(frozen=True)
class SizePart:
    """Sets of ``low`` to ``high`` shingles and the windows (in shingles) of documents that they are looked for in."""

    low: int
    high: int
    window: int
    step: int

    def jaccard(self, containment: float) -> float:
        """Least Jaccard similarity of a set with a window that contains this share of it."""
        shared = containment * self.low
        return shared / (self.low + self.window - shared)


def size_part(shingles: int) -> SizePart:
    low = 1 << (shingles.bit_length() - 1)
    high = 2 * low - 1
    return SizePart(low, high, 2 * high, high)


def minima(shingles: np.ndarray, window: int, k: int) -> np.ndarray:
    """Least value under the k-th hash of each run of ``window`` shingles."""
    return sliding_min(mix(shingles ^ mix(np.full(1, k + 1, np.uint64))), window)


def passage_minima(words: np.ndarray, passage: int, shingle: int, hashes: int = PASSAGE_HASHES) -> np.ndarray:
    """Signature of each passage of ``passage`` words: ``hashes`` minima over its shingles, all in one number."""
    shingles = shingle_hashes(words, shingle)
    out = minima(shingles, passage - shingle + 1, 0)
    for k in range(1, hashes):
        out = mix(out) ^ minima(shingles, passage - shingle + 1, k)
    return out


def item_words(text: str | None) -> list[str]:
    return [w for piece in word_pieces(text) for w in piece]


def joined(held: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All words of the pieces, the piece of each word and where each piece begins."""
    lengths = np.array([len(piece) for piece in held], np.int64)
    return [w for piece in held for w in piece], np.repeat(np.arange(len(held)), lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]])


class ItemIndex:
    """Signatures of all passages of the items in order, with the text and place of each. Texts are numbered one by one, so
    two texts of one item never share places."""

    def __init__(self, items: list[tuple[int, str | None]], passage: int, shingle: int):
        self.passage, self.shingle = passage, shingle
        self.item = [item for item, _ in items]
        self.words = [item_words(text) for _, text in items]
        self.sizes: dict[int, int] = {}
        signatures, texts, places, hashes = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], WordHashes()
        for i, (item, words) in enumerate(zip(self.item, self.words, strict=True)):
            self.sizes[item] = self.sizes.get(item, 0) + max(0, len(words) - passage + 1)
            got = passage_minima(hashes.of(words), passage, shingle)
            signatures.append(got)
            texts.append(np.full(len(got), i, np.int32))
            places.append(np.arange(len(got), dtype=np.int32))
        every = np.concatenate(signatures)
        order = np.argsort(every, kind="stable")
        self.signatures, self.texts, self.places = every[order], np.concatenate(texts)[order], np.concatenate(places)[order]

    def ranges(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 entry of each signature."""
        return np.searchsorted(self.signatures, signatures, "left"), np.searchsorted(self.signatures, signatures, "right")


def _pieces(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[list, list, list]]:
    """Rows, first places and words of pieces of the texts in a batch, some ``SCAN_WORDS`` words at a time; a piece repeats
    the last ``overlap`` words of the one before."""
    rows, bases, held, size = [], [], [], 0
    for row, text in enumerate(batch.column(1).to_pylist()):
        tail, base = [], 0
        for piece in word_pieces(text):
            rows.append(row)
            bases.append(base - len(tail))
            held.append(tail + piece)
            size += len(piece)
            base += len(piece)
            tail = held[-1][-overlap:] if overlap else []
            if size > SCAN_WORDS:
                yield rows, bases, held
                rows, bases, held, size = [], [], [], 0
    if held:
        yield rows, bases, held


def _search(shared):
    """Arrow batches of (doc_id, text) to verified hits, all passages of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = getattr(shared, "value", shared)
        hashes, passage = WordHashes(), index.passage
        for batch in batches:
            docs = batch.column(0).to_pylist()
            found: dict[tuple[int, int], list] = {}
            trail: dict[tuple, int] = {}
            for rows, bases, held in _pieces(batch, passage - 1):
                words, owner, starts = joined(held)
                got = passage_minima(hashes.of(words), passage, index.shingle)
                if not len(got) or not len(index.signatures):
                    continue
                low, high = index.ranges(got)
                for i in np.flatnonzero((high > low) & (owner[: len(got)] == owner[passage - 1 : passage - 1 + len(got)])).tolist():
                    who = int(owner[i])
                    row, place = rows[who], bases[who] + i - int(starts[who])
                    here = words[i : i + passage]
                    for e in range(int(low[i]), int(high[i])):
                        text, j = int(index.texts[e]), int(index.places[e])
                        if index.words[text][j : j + passage] == here:
                            length = trail.get((row, text, place - 1, j - 1), 0) + 1
                            trail[(row, text, place, j)] = length
                            best = found.setdefault((index.item[text], row), [0, set()])
                            best[0] = max(best[0], length)
                            best[1].add((text, j))
            if found:
                out = [(item, docs[row], length + passage - 1, len(js), index.sizes[item]) for (item, row), (length, js) in found.items()]
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["item_id", "doc_id", "longest_run", "passages", "item_passages"])

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The texts of the items, block by block; all texts of an id are in one block."""
    items = cut(items.select(F.col("item_id").cast("long"), "item_text").filter("item_id is not null and item_text is not null").distinct())
    size = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("chars"), F.count_distinct("item_id").alias("n")).first()
    n = max(1, min(-(-size["chars"] // max(1, most)), size["n"]))
    for b in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "item_text").collect()]


def _over_blocks(documents: DataFrame, items: DataFrame, most: int, build, search, schema: str) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    out = None
    for block in _blocks(items, most):
        found = docs.mapInArrow(search(documents.sparkSession.sparkContext.broadcast(build(block))), schema)  # at most ``most`` characters of items
        out = found if out is None else out.unionByName(found)
    return out


def leaked_passages(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, shingle: int = SHINGLE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Documents (``doc_id``, ``text``) that hold ``passage`` or more consecutive words of an item (``item_id``,
    ``item_text``): ``item_id``, ``doc_id``, ``longest_run`` (words in a row), ``passages`` (of the item that occur),
    ``item_passages`` (that all its texts have). One row for each such pair, whatever the number of copies.

    Words are maximal runs of letters, digits and underscores after compatibility normalisation, removal of format
    characters and lower-casing. Null or blank texts and items of fewer words hold nothing; rows without an id are left
    out; several rows of one document id count as that document's texts, of one item id as that item's texts, each looked
    at on its own (of a document's rows the greatest figures count). Texts of any length pass whole, in pieces that overlap.
    """
    hits = _over_blocks(documents, items, index_chars, lambda block: ItemIndex(block, passage, shingle), _search, HITS)
    return hits.groupBy("item_id", "doc_id").agg(F.max("longest_run").alias("longest_run"), F.max("passages").alias("passages"), F.max("item_passages").alias("item_passages"))


class ContainmentIndex:
    """Items by size part: distinct shingles of each text, and for each hash the minima of the texts in order."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, threshold: float, hashes: int):
        self.shingle, self.threshold, self.hashes = shingle, threshold, hashes
        self.item = [item for item, _ in items]
        known = WordHashes()
        self.sets = [np.unique(shingle_hashes(known.of(item_words(text)), shingle)) for _, text in items]
        members: dict[SizePart, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                members.setdefault(size_part(len(s)), []).append(i)
        self.parts: list[tuple[SizePart, list[tuple[np.ndarray, np.ndarray]]]] = []
        for part, texts in sorted(members.items(), key=lambda x: x[0].low):
            tables = []
            for k in range(hashes):
                low = np.array([minima(self.sets[i], len(self.sets[i]), k)[0] for i in texts], np.uint64)
                order = np.argsort(low, kind="stable")
                tables.append((low[order], np.array(texts, np.int32)[order]))
            self.parts.append((part, tables))


def _contained(shared):
    """Arrow batches of (doc_id, text) to items of which a window holds the wanted share of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ContainmentIndex = getattr(shared, "value", shared)
        known, overlap = WordHashes(), max((p.window for p, _ in index.parts), default=1) + index.shingle - 1
        for batch in batches:
            docs, best = batch.column(0).to_pylist(), {}
            for rows, _, held in _pieces(batch, overlap):
                for row, words in zip(rows, held, strict=True):
                    shingles = shingle_hashes(known.of(words), index.shingle)
                    for part, tables in index.parts:
                        for (text, estimate), share in _windows(index, part, tables, shingles):
                            key = (index.item[text], docs[row])
                            best[key] = max(best.get(key, (0.0, 0.0)), (share, estimate))
            if best:
                out = [(item, doc, estimate, share) for (item, doc), (share, estimate) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)], ["item_id", "doc_id", "estimate", "containment"])

    return run


def _windows(index: ContainmentIndex, part: SizePart, tables: list, shingles: np.ndarray) -> Iterator[tuple[tuple[int, float], float]]:
    """(text, estimated containment) and exact containment of the part's items in the windows of one text."""
    n = len(shingles)
    if not n:
        return
    width = min(part.window, n)
    at = np.unique(np.append(np.arange(0, n - width + 1, part.step), n - width))  # the last window ends with the text
    agree: dict[tuple[int, int], int] = {}
    for k, (low, texts) in enumerate(tables):
        got = minima(shingles, width, k)[at]
        first, last = np.searchsorted(low, got, "left"), np.searchsorted(low, got, "right")
        for w in np.flatnonzero(last > first).tolist():
            for text in texts[first[w] : last[w]].tolist():
                agree[(text, w)] = agree.get((text, w), 0) + 1
    inside: dict[int, np.ndarray] = {}
    for (text, w), count in agree.items():
        if w not in inside:
            inside[w] = np.unique(shingles[at[w] : at[w] + width])
        own, other = index.sets[text], inside[w]
        share = len(np.intersect1d(own, other, assume_unique=True)) / len(own)
        if share >= index.threshold:
            j = count / index.hashes
            yield (text, min(1.0, j / (1 + j) * (1 + len(other) / len(own)))), share


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, hashes: int = ITEM_HASHES, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Items (``item_id``, ``item_text``) of which ``threshold`` or more of the distinct shingles occur in one window of a
    document (``doc_id``, ``text``): ``item_id``, ``doc_id``, ``estimate`` (containment by the signatures), ``containment``
    (exact). Candidates agree in one of ``hashes`` minima, which misses a true pair with a chance of (1 - J) ** hashes, J as
    in ``SizePart.jaccard``: 0.1 percent for 0.8 and 32 hashes. Words, nulls and repeated ids as in ``leaked_passages``; items of fewer words than a shingle
    hold nothing."""
    hits = _over_blocks(documents, items, index_chars, lambda block: ContainmentIndex(block, shingle, threshold, hashes), _contained, SHARES)
    return hits.groupBy("item_id", "doc_id").agg(F.max("estimate").alias("estimate"), F.max("containment").alias("containment"))
