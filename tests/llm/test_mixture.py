"""Poisson mixtures: distribution, caps, shares, dirty input."""

import bisect
import math
import random

import numpy as np
import pytest

from tracewell.llm import mixture as M
from tracewell.llm.tokens import default_vocabulary, encoding


@pytest.mark.parametrize(("mean", "cap"), [(0.3, 1), (0.9, 1), (1.9, 2), (2.5, 12), (0.01, 3), (5.9, 6), (40.0, 200), (720.0, 1000), (800.0, 1000), (999.5, 1000), (250_000.0, 10**9)])
def test_inverse_has_the_wanted_mean(mean, cap):
    base, steps = M.inverse_table(mean, cap)
    assert steps == sorted(steps) and base + len(steps) <= cap and len(steps) < 18 * math.sqrt(mean) + 200
    rnd = random.Random(1)
    draws = [base + bisect.bisect_right(steps, u) for u in (rnd.random() for _ in range(40_000))]
    assert max(draws) <= cap
    assert abs(sum(draws) / len(draws) - mean) < 5 * math.sqrt(mean / len(draws)) + 1e-3
    assert abs(M.capped_mean(M.poisson_rate(mean, cap), cap) - mean) < 1e-6 * max(1, mean)


def test_edges_of_the_inverse():
    assert M.inverse_table(3.0, 3) == (3, []) and M.inverse_table(0.0, 3) == M.inverse_table(7.0, 0) == (0, [])


def test_probabilities_against_the_formula():
    for rate in (0.01, 0.7, 3.0, 55.5):
        low, p = M.poisson_window(rate)
        want = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(low, low + len(p))]
        assert low == 0 and np.allclose(p, want, atol=1e-12)


def frames(spark, docs, targets):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, n_copies int")
    return d, spark.createDataFrame([(*x, "clash") for x in targets], "source_name string, target_share double, max_repeats int, key string")


def corpus(n=3000):
    rnd = random.Random(5)
    kinds = ["Big", " big ", "BIG\t", "small", "Other", None, "unnamed"]
    return [(i, " ".join(["word"] * rnd.randrange(1, 40)), rnd.choices(kinds, [30, 5, 5, 6, 20, 3, 8])[0]) for i in range(n)]


TARGETS = [("big", 0.3, 1), ("Small", 0.5, 3), ("other", 0.15, 2), ("missing", 0.05, 9)]


def test_report(spark):
    docs = corpus()
    report = {r["source_name"]: r for r in M.mixture(*frames(spark, docs, TARGETS))[0].collect()}
    count = encoding(default_vocabulary()).encode_ordinary
    own = {}
    for _, text, source in docs:
        key = (source or "").strip().lower()
        own[key] = own.get(key, 0) + len(count(text))
    total = sum(own[k] for k in ("big", "small", "other"))
    for name, share, cap in TARGETS:
        r, tokens = report[name], own.get(name.lower(), 0)
        assert r["own_tokens"] == tokens and r["can_reach"] == (share * total <= cap * tokens)
        assert r["copies"] <= cap * r["n_docs"] and r["reached_tokens"] <= cap * tokens
        if r["can_reach"]:
            assert abs(r["reached_tokens"] - share * total) < 0.1 * share * total
    assert not report["Small"]["can_reach"] and report["Small"]["reached_tokens"] == 3 * own["small"]
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9


def test_copies_are_those_of_the_report(spark):
    docs, targets = frames(spark, corpus(600), TARGETS)
    report = {r["source_name"]: r["copies"] for r in M.mixture(docs, targets)[0].collect()}
    rows = M.shuffled_copies(docs, targets).collect()
    got = {}
    for r in rows:
        got[r["source_name"]] = got.get(r["source_name"], 0) + 1
    assert {k: v for k, v in report.items() if v} == got
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert rows == M.shuffled_copies(docs.repartition(3), targets).collect()
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)


def test_dirty(spark):
    docs = [(1, None, "a"), (2, "", "a"), (None, "x y", "A "), (None, "x y", "a"), (3, "z " * 200_000, "a"), (3, "again", "a")]
    targets = [("a", 1.0, 2), ("a", 0.5, 9), (None, 0.3, 1), ("b", None, None)]
    report = {r["source_name"]: r for r in M.mixture(*frames(spark, docs, targets))[0].collect()}
    assert set(report) == {"a", "b"} and report["a"]["target_share"] == 1.0 and report["a"]["max_repeats"] == 2
    assert report["b"]["can_reach"] and report["b"]["copies"] == 0
    assert report["a"]["n_docs"] == 6


def test_empty(spark):
    report = M.mixture(*frames(spark, [], TARGETS))[0].collect()
    assert len(report) == 4 and all(r["copies"] == 0 and r["reached_share"] == 0 for r in report)
    assert M.mixture(*frames(spark, corpus(20), []))[0].collect() == []
    assert M.shuffled_copies(*frames(spark, [], TARGETS)).collect() == []
