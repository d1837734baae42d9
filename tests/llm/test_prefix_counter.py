"""The prefix counter against the library, with little room and with words it has met."""

import random

import numpy as np
import public_tokenizers
import sentencepiece

from tideline.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_words_behind_line_ends_are_passed_over_once(monkeypatch):
    counter, passes = token_counts.PrefixCounter(MODEL), []
    counts = counter.counts
    monkeypatch.setattr(counter, "counts", lambda word: passes.append(word) or counts(word))
    first = counter.steps("harbour pilot\nharbour\nharbour pilot\n" * 50)
    assert sorted(passes) == sorted(["▁harbour", "▁pilot", "harbour"])
    assert np.array_equal(first, counter.steps("harbour pilot\nharbour\nharbour pilot\n" * 50)) and len(passes) == 3


def test_every_prefix_with_little_room(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(5)
    signs = ["e", "th", "ing", " ", "\n", "  ", "▁", "0", "42", "É", "ß", "漢", "字", "😀", "́", "\x00", "\x85", "zq", "Straße", "<s>", "</s>", "--", "\t"]
    texts = ["", " ", "\n", "a\n", "\n\nb  c \n d"] + ["".join(draw.choice(signs) for _ in range(draw.randint(1, 40))) for _ in range(40)]
    for room in (token_counts.KEPT_PAIRS, 3):
        monkeypatch.setattr(token_counts, "KEPT_PAIRS", room)
        counter = token_counts.PrefixCounter(MODEL)
        for text in texts:
            table = np.cumsum(counter.steps(text), dtype=np.int64).tolist()
            assert table == [len(library.encode(text[:n])) for n in range(1, len(text) + 1)], text
