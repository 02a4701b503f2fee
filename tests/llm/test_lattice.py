"""Words that are new go through their lattices together, with the ids of the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from sharelode.llm import lattice, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def ids_of(model, texts):
    return [np.frombuffer(f, "<u2").tolist() for f in model.encode([t.encode() for t in texts])]


def made(seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(300)
            for letters in ("thenandrigo", "aaab", "éèç ,.\n", "日本語。 x", "😀\x00\x7fß▁ ", "0123456789-=##")]


def test_new_words_take_no_path_of_their_own(monkeypatch):
    """Before, each new word went through its lattice by itself, character by character."""
    model = pieces.Pieces(PATH)

    def alone(*_):
        raise AssertionError("a short word by itself")

    monkeypatch.setattr(model, "_advance", alone)
    texts = [t for t in made() if "  " not in t and "▁" not in t and not t.startswith(" ") and not t.endswith(" ")]
    assert ids_of(model, texts) == [LIBRARY.encode(t) for t in texts]


@pytest.mark.parametrize("together", [1, 7, 1 << 14])
def test_ids_for_any_number_of_words_together(monkeypatch, together):
    monkeypatch.setattr(pieces, "_TOGETHER", together)
    model = pieces.Pieces(PATH)
    texts = made(together)[:400] + ["x" * n for n in (254, 255, 256, 257, 600)]
    for _ in range(2):  # the second time from memory
        assert ids_of(model, texts) == [LIBRARY.encode(t) for t in texts]


def test_pairs_that_share_a_place(monkeypatch):
    """What is remembered of pairs may be forgotten, but is never taken for another pair's."""
    monkeypatch.setattr(lattice, "_REMEMBERED_BITS", 3)
    texts = made(9)
    assert ids_of(pieces.Pieces(PATH), texts) == [LIBRARY.encode(t) for t in texts]


def test_ids_outside_the_vocabulary_have_no_text():
    model = pieces.load(PATH)
    ids = LIBRARY.encode("some text")
    assert model.decode([-1, *ids, 1 << 16]) == model.decode(ids) == "some text"
    assert model.decode([]) == ""


def test_decoding_in_parts_of_a_batch(spark, monkeypatch):
    import cases

    rows = [(i, None if i % 7 == 0 else f"text {i} é") for i in range(50)]
    model = pieces.PieceTexts(PATH)
    monkeypatch.setattr(pieces, "load_texts", lambda _: model)
    monkeypatch.setattr(pieces, "_DECODED_ROWS", 8)
    encoded = pieces.encode(cases.frame(spark, rows), PATH).coalesce(1).toArrow().to_batches()
    found = list(pieces._decoded(iter(encoded), PATH))
    assert max(b.num_rows for b in found) == 8
    assert [(r["doc_id"], r["text"]) for b in found for r in b.to_pylist()] == rows
