"""Packing at sizes where the first plan is not the best, and token ids of whole columns."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm.packing import _filled, _number, _rows, _search, complete_bins, fewest, public_tokenizer
from sparkloom.llm.token_cache import WordIds


def held(plan, capacity):
    got = Counter()
    for times, way in plan:
        assert sum(way) <= capacity
        for n in way:
            got[n] += times
    return got


@pytest.mark.parametrize(("low", "high", "seed", "most"), [(820, 1365, 1, 1362), (820, 1365, 2, 1358), (820, 1365, 3, 1364), (585, 819, 1, 864), (1366, 2047, 1, 2500)])
def test_short_pieces_parted_from_long_ones(low, high, seed, most):
    r = random.Random(seed)
    counts = Counter(r.randint(low, high) for _ in range(5000))
    plan = complete_bins(counts, 4096)
    assert held(plan, 4096) == counts
    assert fewest(counts, 4096) <= _number(plan) <= most


def test_counts_of_any_size_take_the_same_steps():
    r = random.Random(4)
    counts = {n: 1_000_000_000 * r.randint(1, 9) for n in range(820, 1366, 5)}
    plan = complete_bins(counts, 4096)
    assert held(plan, 4096) == counts
    assert _number(plan) < 1.03 * fewest(counts, 4096) and len(plan) < 4096


def test_rows_hold_every_piece():
    r = random.Random(5)
    for _ in range(300):
        counts, m = Counter(r.randint(5, 30) for _ in range(r.randint(1, 40))), r.randint(1, 5)
        plan = _rows(counts, 100, m)
        if plan is not None:
            assert held(plan, 100) == counts and _number(plan) == -(-sum(counts.values()) // m)
    assert _rows({60: 2}, 100, 2) is None


def test_search_mends_the_end_of_a_long_plan():
    """4,990 pieces that fit exactly, and ten that the first plan puts in one sequence too many."""
    hard = [59, 57, 44, 35, 27, 26, 20, 13, 9, 8]
    counts = Counter(hard) + Counter({100: 4990})
    assert _number(_filled(counts, 100)) == 4994 > fewest(counts, 100)
    plan = complete_bins(counts, 100)
    assert held(plan, 100) == counts and _number(plan) == 4993
    assert _search(dict(Counter(hard)), 100, 3, [2000]) is not None


def test_columns_of_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizer())
    r = random.Random(6)
    texts = ["", " ", "\n", "a.", "İı ſ Kﬁ", "Straße ÀÉ µªº", "a\u0301bc क़", None, "</w> x</w>y", "don't we're 12,5."]
    texts += ["".join(r.choice("aB éßÀµª×İΣσ'.,19\n\t\u0301中😀") for _ in range(r.randrange(60))) for _ in range(500)]
    column = pa.array(texts, pa.string())
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    words = WordIds(public_tokenizer())
    assert words.letters is not None
    assert [x.tolist() for x in words.column(column)] == want
    assert [x.tolist() for x in words.column(column.slice(3, 200))] == want[3:203]
    words.letters = None  # as for tokenizers whose pre-tokens are not runs of letters
    words.words, words.chunks = {}, {}
    assert [np.frombuffer(x, np.uint32).tolist() for x in words.texts([t or "" for t in texts])] == want
    assert words.column(pa.array([], pa.string())) == []


def test_words_kept_are_bounded():
    """Only words met again are kept, up to a number and a length; what is not kept has the same ids each time."""
    from sparkloom.llm import token_cache

    r = random.Random(7)
    once = ["".join(r.choice("abcdeéñß") for _ in range(12)) + r.choice(["", ".", ",", "!"]) for _ in range(30_000)]
    again, long = [f"word{k}x" for k in range(200)] + ["Straße.", "straße,", "STRASSE"], "x" * 5000 + "1"
    words = WordIds(public_tokenizer())
    for k in range(10):
        words.column(pa.array([" ".join(once[3000 * k : 3000 * (k + 1)] + again + [long])]))
    assert {"word7x", "straße", "strasse"} <= words.words.keys()
    assert len(words.words) < 1000 and max(map(len, words.words)) <= token_cache.CACHE_CHARS
    assert not any(isinstance(x, dict) and len(x) > 1000 for x in vars(words).values())
    whole = WordIds(public_tokenizer()).encode
    texts = [" ".join(once[:50]), " ".join(again), long, "Straße. straße, STRASSE"]
    assert [x.tolist() for x in words.column(pa.array(texts))] == [whole(t, add_special_tokens=False).ids for t in texts]
