"""The words of a batch are cut once, and the ids stay those of the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sharelode.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def made(seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)
            for letters in ("thenandrigo", "aaa b", "éèçÉ ,.\n\t", "日本語。 x", "'s't're'll A", "-=#|<>0123\x0b",
                            "\x1c\x85\xa0 x\x00", "ab1,é\r\f ")]


def test_a_word_is_cut_once_in_a_batch(monkeypatch):
    """Before, each text was cut by the pattern as a whole."""
    cut = []

    class Counting:
        def findall(self, text, pattern=word_bpe._PARTS):
            cut.append(len(text))
            return pattern.findall(text)

    monkeypatch.setattr(word_bpe, "_PARTS", Counting())
    texts = ["It's a few, words! é " * 50, "words! a few,\n" * 70] * 20
    assert word_bpe.load(PATH).encode(texts) == library(texts)
    assert sum(cut) < 100


def test_ids_are_the_library_s(monkeypatch):
    bpe = word_bpe.WordBpe(PATH, encode_special_tokens=False)
    texts = [None, "", " ", *made(), *[f"{t}<|endoftext|>{t} <|startoftext|>" for t in made(4)[:200]],
             "x" * 300, "ab" * 4000, "ththth" * 90 + " th"]
    rows = pa.array(texts, pa.string())
    for some in (rows, rows.slice(5), rows):  # the second time from memory, and not from the start of the array
        assert bpe.encode_column(some) == library(some.to_pylist())
    assert bpe.encode([]) == []


@pytest.mark.parametrize("together", [1, 5])
def test_ids_for_any_number_of_parts_together(monkeypatch, together):
    monkeypatch.setattr(word_bpe, "_TOGETHER", together)
    texts = made(together)[:200]
    assert word_bpe.WordBpe(PATH, encode_special_tokens=False).encode(texts) == library(texts)


def test_lattices_give_what_merging_in_order_gives():
    bpe, merging = word_bpe.WordBpe(PATH), word_bpe.WordBpe(PATH)
    assert bpe.lattice is not None
    merging.lattice = None
    texts = made(11)
    assert bpe.encode(texts) == merging.encode(texts)
