"""Candidate spans are bounded in units only; islands with base spans that do not fit are no examples."""

import numpy as np

from mealops.llm import pii

LONG_PHONE = "+1 2 3 4 5 6 7 8 9 0 1"       # 22 units


def test_a_long_candidate_has_a_place():
    email = "a" * 300 + "1@example.com"
    lat = pii.lattice(email, 16)
    whole = [(i, j) for i, j in zip(lat.starts, lat.ends, strict=True)
             if (lat.bounds[i], lat.bounds[j]) == (0, len(email))]
    assert len(whole) == 1
    (_, gold), = pii.examples_of(email, 16)
    assert gold.sum() == 1
    weights = np.zeros((len(pii._FEATURES), len(pii.KINDS)))
    weights[10, 0], weights[33, 0], weights[37, 0] = 3, 1, 1       # one @, five units or more, last letter
    assert pii.best_spans(email, weights, 16) == [(0, 0, len(email))]


def test_island_with_a_span_over_the_bound_is_no_example():
    assert any(k == 3 for _, k, _ in pii.base_spans(LONG_PHONE))
    assert list(pii.examples_of(f"call {LONG_PHONE} now", 16)) == []
    text = f"call {LONG_PHONE} now, mail a1@b.cd today, room 12 upstairs"
    assert [int(gold.sum()) for _, gold in pii.examples_of(text, 16)] == [1, 0]


def test_overlapping_spans_keep_the_first_label():
    text = "x 4111 1111 1111 1111 y"
    (_, gold), = pii.examples_of(text, 16)
    assert gold.sum() == 1
