"""Ratios of many pairs against the standard library, and bounds of them."""

import random
from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.functions.similarity import Both, bounds, common, ratios


def plain(left, right):
    return np.array([np.nan if not x or not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc é漢", max_size=14), st.text("abc é漢", max_size=14)), max_size=30))
def test_ratios_equal_the_library(pairs):
    left, right = [x for x, _ in pairs], [y for _, y in pairs]
    want = plain(left, right)
    assert np.array_equal(ratios(left, right), want, equal_nan=True)
    bound = bounds(left, right)
    assert np.array_equal(np.isnan(bound), np.isnan(want)) and np.all(bound[~np.isnan(want)] >= want[~np.isnan(want)])


def test_ratios_of_long_and_repeated_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh ", k=k)) for k in (1, 2, 50, 120, 199, 200, 201, 260, 400)] + ["x" * 150, "x" * 199, "ab" * 120, "\ud800x"]
    left, right = (list(x) for x in zip(*[(a, b) for a in texts for b in texts], strict=True))
    assert np.array_equal(ratios(left, right), plain(left, right))
    assert ratios([], []).tolist() == [] == bounds([], []).tolist()


def test_ratios_from_a_least_one_on():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["bridge", "bridges", "drained", "drains", "ronin", "exploit"], k=3)) for _ in range(60)]
    left, right = (list(x) for x in zip(*[(a, b) for a in texts for b in texts], strict=True))
    want, got = plain(left, right), ratios(left, right, 0.82)
    assert np.array_equal(got >= 0.82, want >= 0.82) and np.array_equal(got[want >= 0.82], want[want >= 0.82])


def test_bounds_and_needs_of_many_pairs():
    rng = random.Random(4)
    words = ["bridge", "drained", "ronin", "exploit", "xq", "漢字", "of"]
    texts = [" ".join(rng.choices(words, k=k)) for k in [1, 2, 3, 8, 20, 30, 45, 60] * 4] + ["", "a" * 300, "".join(map(chr, range(100, 400)))]
    left, right = (list(x) for x in zip(*[(a, b) for a in texts for b in texts], strict=True))
    want, x = plain(left, right), Both(left, right)
    i, j = x.a.place, x.b.place
    told = ~np.isnan(want)
    assert np.all(x.ordered(i, j)[told] >= want[told]) and np.all(x.ordered(i, j)[told] <= 1)
    lengths = np.maximum(x.a.length[i] + x.b.length[j], 1)
    assert np.all((2 * common(x.bag_a, x.bag_b)[i, j] / lengths + 1e-6)[told] >= want[told])
    need = np.array([rng.random() for _ in left])
    got = x.ratios(i, j, need)
    high = told & (want >= need)
    assert np.array_equal(got[high], want[high]) and np.all(got[told & ~high] < need[told & ~high])
