"""Rows that must neither crash an operator nor be lost by it."""

from collections import Counter

import numpy as np
import pytest

from sparkloom.llm.embedding_dedup import EmbeddingDedup
from sparkloom.llm.media import A_LAW, IMA_ADPCM, MU_LAW, expand, read_wav, to_pcm, wav
from sparkloom.llm.near_dedup import keep_one

WIDE = "doc_id long, text string, extra string"


def test_keep_one_keeps_every_row_without_words(spark):
    bare = [(None, None, "x"), (None, None, "y"), (None, None, "y"), (7, None, "r"), (7, None, "s"), (7, "", "t"), (8, " \n\t", "u"), (8, " \n\t", "v"), (None, "", None)]
    words = [(1, "one two three four five six", "a"), (1, "one two three four five six", "b"), (2, "one two three four five six", "c"), (None, "other words are here now", "d")]
    got = Counter(map(tuple, keep_one(spark.createDataFrame(bare + words, WIDE)).collect()))
    assert all(got[r] == n for r, n in Counter(bare).items())
    left = got - Counter(bare)
    assert sum(left.values()) == 2 and left[words[3]] == 1 and any(left[r] for r in words[:2])
    assert Counter(map(tuple, keep_one(spark.createDataFrame(bare, WIDE)).collect())) == Counter(bare)


@pytest.mark.parametrize("kind,labels", [("string", ["a", "b", "1.0"]), ("double", [1.2, 1.7, 1.0]), ("int", [1, 2, 3])])
def test_short_vectors_and_any_labels(spark, kind, labels):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=i % 4 + 1)], labels[i % 3]) for i in range(60)]
    rows += [(100, [1.0], labels[0]), (101, [2.0], labels[0]), (102, [-1.0], labels[0]), (103, [1.0], labels[1]), (104, [3.0, 4.0], labels[2]), (105, [3.0, 4.1], labels[2])]
    got = {r.vec_id: r for r in EmbeddingDedup().classify(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    for i, v, label in rows:
        near = [j for j, w, other in rows if j != i and label == other and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        assert got[i].n_links == len(near)
    assert got[101].component_id == got[100].component_id != got[102].component_id and got[105].component_id == got[104].component_id


def test_media_cut_anywhere_are_null_or_short(spark):
    for codec, align in ((MU_LAW, 1), (A_LAW, 1), (IMA_ADPCM, 36)):
        whole = wav(bytes(range(72)), codec, 8000, align)
        full = expand([whole], 8000)[0]
        for n in range(len(whole)):
            pcm = expand([whole[:n]], 8000)[0]
            assert pcm is None or (pcm == full[: len(pcm)]).all()
        header = whole.index(b"data") + 8
        assert all(expand([whole[:n]], 8000)[0] is None for n in range(header))
    bad = [wav(b"abc", MU_LAW, 0), wav(b"abcdefgh", IMA_ADPCM, 8000, 4), wav(b"abc", 1), wav(b"abc")[:30]]
    assert all(read_wav(b) is None for b in bad)
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, media binary")
    assert [r.pcm for r in to_pcm(rows).collect()] == [None] * 4
