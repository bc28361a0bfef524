"""Legal and navigation phrases count in the whole line, as hits per word."""

import numpy as np

from mealops.llm import line_quality


def _phrase(text: str) -> float:
    return line_quality.read_document(text).features[0, 9]


def test_phrase_after_400_bytes_counts():
    head = " ".join("abcdefghijklmnop" for _ in range(30))
    assert len(head) > 400 and _phrase(head) == 0
    assert _phrase(f"{head} All Rights Reserved") == 1
    doc = line_quality.read_document(f"{head} all rights reserved\nplain words of the text")
    assert line_quality.weak_labels(doc, True).tolist() == [1, 0]


def test_one_mention_in_a_long_line_does_not_condemn_it():
    for at in (0, 300, 599):
        words = [f"word{i}" for i in range(600)]
        words[at] = "copyright"
        doc = line_quality.read_document(" ".join(words))
        assert 0 < doc.features[0, 9] < 0.2
        assert not line_quality.weak_labels(doc, True).any()
    legal = "copyright all rights reserved terms of privacy policy " * 40
    assert _phrase(legal) == 1


def test_field_follows_phrases_behind_the_start():
    field = line_quality.LineField(tuple(np.eye(line_quality.N_FEATURES)[9] * 4 - np.eye(line_quality.N_FEATURES)[0]),
                                   ((0.0, 0.0), (0.0, 0.0)))
    late = "x" * 500 + " click here to subscribe"
    assert field.content_share(line_quality.read_document(late)) == 0
