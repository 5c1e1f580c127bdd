"""Leaked passages against brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest

from tracewell.llm import leakage as L
from tracewell.llm import words as W


def words_of(text):
    text = unicodedata.normalize("NFKC", text or "")
    return [w.lower() for w in re.findall(r"\w+", "".join(c for c in text if unicodedata.category(c) != "Cf"))]


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for j in range(len(w) - n + 1):
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    return {(i, d) for d, t in docs if d is not None for w in [words_of(t)] for j in range(len(w) - n + 1) for i in grams.get(tuple(w[j : j + n]), ()) if i is not None}


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    return d, spark.createDataFrame([(*x, 1) for x in items], "item_id long, item_text string, doc_id int")


def sample(seed, n_docs=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ＡＢＣ", "éte", "naïve"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 11, 12, 13, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "  ")]
    docs = []
    for d in range(n_docs):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randrange(80))]
        if rnd.random() < 0.6:
            w = (rnd.choice(items)[1] or "").split()
            a, b = sorted(rnd.randrange(len(w) + 1) for _ in range(2)) if w else (0, 0)
            piece = [rnd.choice([x.upper(), x, "**" + x + "**", x[:1] + "​" + x[1:]]) for x in w[a:b]]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = piece
        docs.append((d, rnd.choice([" ", "\r\n", ", "]).join(body)))
    return docs + [(None, items[0][1]), (500, None), (501, ""), (502, " \n ")] + docs[:20], items


@pytest.mark.parametrize("index_chars", [L.INDEX_CHARS, 1500])
def test_found(spark, index_chars):
    docs, items = sample(3)
    hits = L.leaked_passages(*frames(spark, docs, items), index_chars=index_chars).collect()
    assert {(r["item_id"], r["doc_id"]) for r in hits} == brute(docs, items)
    assert len(hits) == len({(r["item_id"], r["doc_id"]) for r in hits}) > 10
    text = dict(items)
    for r in hits:
        n = len(words_of(text[r["item_id"]]))
        assert 12 <= r["longest_run"] <= n and r["item_passages"] == n - 11 >= r["passages"] >= r["longest_run"] - 11


def test_long_text_in_pieces(spark):
    item = " ".join(f"q{i}" for i in range(30))
    filler = [f"x{i % 997}" for i in range(200_000)]
    docs = []
    for d, at in enumerate((0, 70_001, 77_770, 133_333, 199_990)):
        body = list(filler)
        body[at:at] = item.split()
        docs.append((d, " ".join(body)))
    assert len(docs[0][1]) > 2 * W.PIECE
    hits = L.leaked_passages(*frames(spark, docs, [(1, item)])).collect()
    assert sorted((r["doc_id"], r["longest_run"], r["passages"]) for r in hits) == [(d, 30, 19) for d in range(5)]


def test_every_cut_between_pieces(monkeypatch):
    """The passage lies over the border of two pieces at every place."""
    import pyarrow as pa

    monkeypatch.setattr(W, "PIECE", 60)
    item = " ".join(f"q{i}" for i in range(14))
    for lead in range(40):
        text = " ".join([*(f"x{i}" for i in range(lead)), item, *(f"y{i}" for i in range(20))])
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["doc_id", "text"])
        rows = [r for b in L._search(L.ItemIndex([(7, item)], 12, 5))(iter([batch])) for r in b.to_pylist()]
        assert [(r["longest_run"], r["passages"]) for r in rows] == [(14, 3)], lead


def test_empty(spark):
    docs, items = sample(1, 5)
    assert L.leaked_passages(*frames(spark, [], items)).collect() == []
    assert L.leaked_passages(*frames(spark, docs, [])).collect() == []


def test_minima_of_equal_passages_are_equal():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        passage = rnd.integers(0, 1 << 60, 12, np.uint64)
        a = np.concatenate([rnd.integers(0, 1 << 60, 30, np.uint64), passage, rnd.integers(0, 1 << 60, 9, np.uint64)])
        assert L.passage_minima(passage, 12, 5)[0] in L.passage_minima(a, 12, 5)


@pytest.mark.parametrize("index_chars", [L.INDEX_CHARS, 40])
def test_texts_of_one_item_are_counted_apart(spark, index_chars):
    one, two = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(17))
    other = " ".join(f"c{i}" for i in range(12))
    docs = [(1, f"x {one} y {two} z"), (2, two), (3, other)]
    hits = L.leaked_passages(*frames(spark, docs, [(7, one), (7, two), (8, other)]), index_chars=index_chars).collect()
    assert sorted(tuple(r) for r in hits) == [(7, 1, 17, 9, 9), (7, 2, 17, 6, 9), (8, 3, 12, 1, 1)]


def shingles_of(text, n=5):
    w = words_of(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_contained_items_recall_and_exactness(spark):
    """Whole items with a few words changed, somewhere in longer texts; recall against brute force over all windows."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([6, 9, 20, 33, 70])))) for i in range(120)]
    docs = []
    for d in range(400):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randrange(300))]
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = "changed"
        at = rnd.randrange(len(body) + 1)
        body[at:at] = w
        docs.append((d, " ".join(body)))
    hits = {(r["item_id"], r["doc_id"]): r for r in L.contained_items(*frames(spark, docs, items)).collect()}
    want = {}
    for i, t in items:
        own = set(shingles_of(t))
        part = L.size_part(len(own))
        for d, text in docs:
            s = shingles_of(text)
            if len(own & set(s)) >= 0.8 * len(own):
                width = min(part.window, len(s))
                ends = sorted({*range(0, len(s) - width + 1, part.step), len(s) - width})
                share = max(len(own & set(s[a : a + width])) for a in ends) / len(own)
                if share >= 0.8:
                    want[(i, d)] = share
    assert set(hits) <= set(want) and len(want) > 150
    assert len(set(hits) & set(want)) >= 0.95 * len(want)
    assert all(abs(hits[k]["containment"] - want[k]) < 1e-9 for k in hits)
    assert np.mean([abs(r["estimate"] - r["containment"]) for r in hits.values()]) < 0.25
    for part in (L.size_part(n) for n in (1, 2, 8, 60)):
        assert (1 - part.jaccard(0.8)) ** L.ITEM_HASHES < 0.002


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 9):
        assert W.sliding_min(x, n).tolist() == [min(x[i : i + n].tolist()) for i in range(len(x) - n + 1)]
