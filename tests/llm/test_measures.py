"""Measures of the classifier against whole texts read word by word."""

import random

import numpy as np

from tideline.llm import classifier
from tideline.llm.toxicity import STEM, WORD

ENTRIES = {"harbour": 0, "^harbo": 1, "σας": 1, "σασ": 0, "i": 1, "^straß": 0, "été": 1, "^été": 0, "a": 0}


def test_hits_as_by_whole_texts():
    own = classifier.Measures(classifier.Model(["x", "y"], ENTRIES))
    draw = random.Random(3)
    signs = ["harbour", "Harboured", "ΣΑΣ", "ΣΑΣ.", "İ", "Straße", "STRASSE", "ÉTÉ", "A", "'", "1", "_", "́", "\x1c", "\x85", " ", " ", " ", "\n", "\t", "-"]
    for text in ["", " ", *("".join(draw.choice(signs) for _ in range(draw.randint(1, 60))) for _ in range(300))]:
        hits = np.zeros(2)
        for word in set(WORD.findall(text.lower())):
            for entry in [word] + ([f"^{word[:STEM]}"] if len(word) >= STEM else []):
                if entry in ENTRIES:
                    hits[ENTRIES[entry]] += 1
        n, measures = own(text)
        assert n == len(text.split())
        assert np.array_equal(measures[-4:], np.concatenate([np.log1p(hits), hits > 0])), repr(text)


def test_repeated_words_are_read_once(monkeypatch):
    read = []

    class Words:
        def findall(self, text):
            read.append(len(text))
            return WORD.findall(text)

    monkeypatch.setattr(classifier, "WORD", Words())
    n, measures = classifier.Measures(classifier.Model(["x", "y"], ENTRIES))("harbour pilot " * 5_000)
    assert n == 10_000 and measures[-4:].tolist() == [np.log1p(1), np.log1p(1), 1, 1] and read == [13]
