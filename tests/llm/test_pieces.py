import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import cases
from sharelode.llm import pieces
from sharelode.llm.token_counts import Automaton, token_counts, vocabulary_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ODD = ["", "  x", "x  ", "a    b", " " * 30, "日本語" * 100, "x" * 3000, "abc" * 2000, "\n\n\n", "aé́b\t"]


def _texts():
    rng = random.Random(3)
    letters = "abcdefghij  \n\tééß日本語ÀЖж123.,\"😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    return [*ODD, *made, "".join(rng.choice("thenandrigo") for _ in range(5000))]


def test_ids_are_the_library_s():
    texts = _texts()
    found = pieces.load(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(f, "<u2").tolist() for f in found] == [LIBRARY.encode(t) for t in texts]


def test_paths_settle_anywhere(monkeypatch):
    """Committing early changes no id, whatever the distance between two looks."""
    model = pieces.load(PATH)
    text = "▁" + "".join(random.Random(5).choice("thenandrigo") for _ in range(700))
    whole = model.viterbi(text)
    for stride in (1, 7, 64):
        monkeypatch.setattr(pieces, "_STRIDE", stride)
        assert model.viterbi(text) == whole


def test_round_trip(spark):
    rows = cases.documents(2) + [(4000 + i, t) for i, t in enumerate(_texts())]
    encoded = pieces.encode(cases.frame(spark, rows), PATH)
    decoded = pieces.decode(encoded, PATH)
    assert cases.ordered((r.doc_id, r.text) for r in decoded.collect()) == cases.ordered(rows)
    for r in encoded.collect():
        if r.doc_id is not None and r.doc_id >= 4000:
            assert r.ids == LIBRARY.encode(_texts()[r.doc_id - 4000])


def test_empty_tables(spark):
    encoded = pieces.encode(cases.frame(spark, []), PATH)
    assert pieces.decode(encoded, PATH).count() == 0
    assert token_counts(cases.frame(spark, []), PATH).count() == 0


def greedy(word, known, longest):
    at = n = 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + size] in known:
                n, at = n + 1, at + size
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


def test_counts_against_greedy_cutting(spark):
    known = set(vocabulary_pieces(PATH))
    longest = max(map(len, known))
    rows = cases.documents(8) + [(5000 + i, t) for i, t in enumerate(_texts())]
    found = token_counts(cases.frame(spark, rows), PATH).collect()
    expected = []
    for doc_id, text in rows:
        each = [greedy("▁" + w, known, longest) for w in cases.words(text)]
        expected.append((doc_id, len(each), sum(each), max(each, default=0)))
    assert cases.ordered(tuple(r) for r in found) == cases.ordered(expected)


@pytest.mark.parametrize("seed", range(5))
def test_automaton_of_any_vocabulary(seed):
    rng = random.Random(seed)
    known = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(12)}
    automaton = Automaton(known)
    for _ in range(300):
        word = "".join(rng.choice("abcéx") for _ in range(rng.randint(0, 25)))
        assert automaton.count(word) == greedy(word, known, 5)
