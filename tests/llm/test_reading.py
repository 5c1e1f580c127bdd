"""Prose, sentences and reading levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import prose as P
from tracewell.llm import reading as R
from tracewell.llm.tokens import default_vocabulary

MIXED = """# A heading of a report

The gate opens. It
closes again.

```c
int x = 3; // The gate opens. And closes.
```
- an item of a list. It has two sentences.
1. another item
* third

| a | b |
|---|---|
    indented(code);
   @0 0xe694b9bd in table_scan_tree /src/table/load.c:311
[pulse 0100102] edges=3604 corp=175 rate=37.2k/s
2025-01-01 10:00:00 INFO started
<pre>
Not prose here.
</pre>
> Quoted words count.
Under title
===========
"""


def test_prose_only():
    assert P.prose_paragraphs(MIXED) == ["The gate opens. It closes again.", "Quoted words count. Under title"]
    assert P.prose_paragraphs(MIXED.replace("\n", "\r\n")) == P.prose_paragraphs(MIXED)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "```\nnever closed.", "# only a heading", "<pre>\nopen"])
def test_no_prose(text):
    assert P.prose_paragraphs(text) == []


def test_sentences():
    s = "See e.g. The file a.c:12 of v1.2.3, about 36.5 % of it, i.e. much. Is it? Yes! Cf. Table 2 by J. Smith... and so on (see x/y.c). \"Done.\" z.B. Dies"
    assert P.sentences(s) == ["See e.g. The file a.c:12 of v1.2.3, about 36.5 % of it, i.e. much.", "Is it?", "Yes!", "Cf. Table 2 by J. Smith... and so on (see x/y.c).", '"Done." z.B. Dies']
    assert P.sentences("no point at the end") == ["no point at the end"] and P.sentences("  ") == []
    assert P.letters("a-b_c 1é, %") == 5


def brute(text):
    got = [s for p in P.prose_paragraphs(text) for s in P.sentences(p) if P.letters(s)]
    return len(got), sum(len(s.split()) for s in got), sum(P.letters(s) for s in got)


def test_measures_and_levels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = R.reading_levels(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_sentences"], r["n_words"], r["n_letters"]) == brute(text[r["doc_id"]])
        if r["n_sentences"]:
            assert abs(sum(r[f"level_{k}"] for k in range(R.LEVELS)) - 1) < 1e-6
        else:
            assert r["difficulty"] is None
    rarity = R.Rarity(default_vocabulary())
    rated = [r for r in rows if r["n_sentences"]]
    want = []
    for r in rated:
        got = R.split([text[r["doc_id"]]])
        want.append(np.average([R.label(x, rarity) for x in got.texts], weights=got.words))
    assert np.corrcoef(want, [r["difficulty"] for r in rated])[0, 1] > 0.95


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    parity = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = R.fit(*R.sampled(docs.filter(parity == 0)))
    texts, words, labels, owner = R.sampled(docs.filter(parity == 1), limit=4000)
    level = np.searchsorted(R.CUTS, labels, side="right")
    share = model.levels(model.score(texts, R.WordHashes()))
    exact, near = np.mean(share.argmax(1) == level), np.mean(np.abs(share.argmax(1) - level) <= 1)
    assert exact > 0.6 and near > 0.93, (exact, near)
    # Against measures that no label knows: letters a word and words a sentence of the same held-out documents.
    n = owner.max() + 1
    total, count, letters = np.bincount(owner, words, n), np.bincount(owner, minlength=n), np.bincount(owner, [P.letters(t) for t in texts], n)
    guess = np.bincount(owner, (share @ np.arange(R.LEVELS)) * words, n) / total
    formula = 4.71 * letters / total + 0.5 * total / count - 21.43  # a published readability index
    assert np.corrcoef(guess, formula)[0, 1] > 0.5


def test_nothing_is_clamped_or_dropped(spark):
    easy = [(i, "The small cat sat on the mat. It was a good day.") for i in range(30)]
    hard = "Comprehensive instrumentation infrastructures characteristically necessitate considerable " + "interdisciplinary reconsideration " * 12 + "throughout."
    rows = {r["doc_id"]: r for r in R.reading_levels(spark.createDataFrame([*easy, (99, hard)], "doc_id long, text string")).collect()}
    assert rows[99]["difficulty"] > rows[0]["difficulty"] and rows[99]["n_sentences"] == 1
    alone = R.reading_levels(spark.createDataFrame([(1, hard)], "doc_id long, text string")).collect()[0]
    assert alone["difficulty"] is not None and alone["n_words"] >= 22 and alone["n_letters"] >= 5.8 * alone["n_words"]
    scale = R.LevelModel(None, None, (0, 0, 0), [], ([1.0, 2.0], [10.0, 12.0]))
    assert [scale.calibrated(x) for x in (0.0, 1.5, 3.0)] == [8.0, 11.0, 14.0]


def test_wrapped_lines_and_pairs_in_prose():
    wrapped = "The first part of the sentence ends with a mark of this kind;\nthe second part of it ends here."
    assert P.prose_paragraphs(wrapped) == [wrapped.replace("\n", " ")]
    pairs = "The run with a=1 b=2 finds the same edges as the one before it."
    assert P.prose_paragraphs(pairs) == [pairs]
    for code in ("int x = 3;", "return table[i];", "edges=2657 corp=45 rate=64.1k/s", "level=info worker=3 done", "foo(a, b);"):
        assert P.prose_paragraphs(code) == []


def test_dirty_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "One sentence here."), (3, "Same here. " * 60_000), (3, "Same here."), (4, "```\ncode"), (5, "%% -- !!"), (6, "é" * 200_000)]
    got = R.reading_levels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_sentences"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 60_000), (4, 0), (5, 0), (6, 1)]
    assert R.reading_levels(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert R.reading_levels(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["difficulty"] is None


def test_features_match_a_plain_count():
    texts = ["The gate.", "Ünder é", "x"]
    index, begins = R.character_features(texts)
    for i, t in enumerate(texts):
        raw = b"  " + t.lower().encode() + b" "
        want = [(((raw[j] | raw[j + 1] << 8 | raw[j + 2] << 16) * 2654435761) & 0xFFFFFFFF) >> 17 for j in range(len(raw) - 2)]
        end = begins[i + 1] if i + 1 < len(begins) else len(index)
        assert index[begins[i] : end].tolist() == want


def test_found_on_the_tables(spark, sf):
    from tracewell.llm import queries as Q

    folder = sf.replace("sf0.001", "sf0.01")
    got = {r[0] for r in Q.p8_found(spark, folder).collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        s, w, c = brute(r["text"])
        if s and w >= 22 * s and c >= 5.8 * w:
            want.add(r["doc_id"])
    assert got == want and want
