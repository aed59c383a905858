import numpy as np
import pyarrow as pa

from brute import WORD, shingles, words
from fieldloom.llm.words import scan, shingle_sets

TEXTS = ["", None, "a b  c\td e f g", "x", " Ab aB \n", "é ê  z\x1fq end", "the the the the the the", "a b c"]


def test_words_and_joined():
    found = scan(pa.array(TEXTS), lower=False)
    for d, text in enumerate(TEXTS):
        own = [found.data[s:e].tobytes().decode() for s, e in zip(found.start, found.end)][found.first[d] : found.first[d + 1]]
        assert own == WORD.findall(text or "")
    keep = np.arange(len(found.hash)) % 3 != 1
    for d, text in enumerate(TEXTS):
        own = [w for w, k in zip(words(text), keep[found.first[d] : found.first[d + 1]], strict=True) if k]
        assert found.joined(keep)[d].decode() == " ".join(own)


def test_slices_and_shingles():
    array = pa.array(["skipped text here", *TEXTS])[1:]
    sets = shingle_sets(scan(array, lower=True))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in TEXTS]
    again = shingle_sets(scan(pa.array(["A B C", "a b c d"]), lower=True))
    assert again[0].tolist() == sets[-1].tolist() != again[1].tolist()


def test_equal_words_equal_hashes():
    found = scan(pa.array(["alpha beta", "beta gamma alpha"]), lower=False)
    a, b, b2, _, a2 = found.hash.tolist()
    assert (a, b) == (a2, b2) and len({*found.hash.tolist()}) == 3
    assert len(scan(pa.array([], pa.string()), False).hash) == 0
