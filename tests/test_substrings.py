"""Names inside texts against contains itself."""

import random

from sparkloom.operators.substrings import substring_links


def test_substrings(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB é🎉.") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60))) for i in range(200)] + [(900, None), (901, ""), (902, "abab" * 500)]
    names = [word(rng.randrange(1, 9)) for _ in range(150)] + ["abab", "ABAB", None, "", "zzzz", texts[5][1] or "abba"]
    got = sorted(map(tuple, substring_links(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "k", "name").collect()))
    want = sorted({(k, n) for k, t in texts if t is not None for n in names if n and len(n) >= 4 and n.lower() in t.lower()})
    assert len(want) > 100 and got == want
