"""Hard negatives, pieces and phrases against brute force, the library and SQL, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.hard_negatives import OP11_SQL, HardNegatives, op11_hard_negatives, scores, subset_sums
from sparkloom.llm.phrases import OP13_SQL, Phrases, op13_phrases
from sparkloom.llm.pieces import PieceCodec, decode_ids, digests, encode_documents, op12_pieces, piece_model

DATA = "/root/testdata/sf0.001"
CLASHES = "anchor long, seq long, score long, cell long, block string, positives string, word string, phrase string, parsed long, f long, ids string, chunk string"


def clashing(df):
    for c in CLASHES.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    return sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))


# ---- hard negatives


@pytest.mark.parametrize("dim,bits", [(1, 3), (8, 9), (13, 9), (64, 20), (3, 27)])
def test_four_russians_scores(dim, bits):
    rng = np.random.default_rng(dim)
    a, c = (rng.integers(-(1 << bits), 1 << bits, (n, dim)) for n in (7, 40))
    padded = np.zeros((40, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = c
    planes = np.packbits((padded[:, None, :] >> np.arange(bits + 1)[None, :, None] & 1).astype(np.uint8), axis=2, bitorder="little")
    assert (scores(subset_sums(a), planes) == c @ a.T).all()


def mined(rows, positives, negatives, is_anchor, scale=256):
    q = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: math.inf if i is None else i
    out = []
    for at, (a, la, va) in enumerate(q):
        if not is_anchor(a):
            continue
        s = sorted(((-sum(x * y for x, y in zip(va, v)), last(i), i, label) for j, (i, label, v) in enumerate(q) if j != at and len(v) == len(va)), key=lambda r: r[:2])
        for p in [r for r in s if r[3] == la][:positives]:
            hard = [r for r in s if r[3] != la and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]]
            out += [(a, p[2], k + 1, r[2], -p[0], -r[0]) for k, r in enumerate(hard[:negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,group", [(512, 65536), (2, 7)])
def test_hard_negatives_brute_force(spark, block, group):
    rng = random.Random(3)
    near = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, rng.choice(["a", "b", "c"]), [x + rng.gauss(0, 0.7) for x in near]) for i in range(120)]
    rows += [(200 + i, rng.choice(["a", "b"]), list(near)) for i in range(60)]  # copies: ties everywhere
    rows += [(300, "a", None), (301, None, near), (302, "b", [None] * 12), (303, "b", [math.nan] * 12), (304, "a", [math.inf] * 12)]
    rows += [(305, "a", []), (310, "b", []), (306, "b", near[:5]), (320, "a", near[:5]), (321, "b", [0.0] * 12), (None, "b", near), (None, "a", near), (200, "a", near), (200, "b", near)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    got = HardNegatives(block=block, group=group).mine(df.repartition(5), F.col("vec_id") % 10 == 0)
    expected = mined(rows, 5, 3, lambda i: i is not None and i % 10 == 0)
    assert len(expected) > 100 and sorted(map(tuple, got.collect()), key=str) == expected
    assert HardNegatives().mine(df.limit(0), F.lit(True)).count() == 0
    assert HardNegatives().mine(df.where("vec_id = 301"), F.lit(True)).count() == 0


def test_negative_scores_have_no_negatives(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.7, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, -1.0])], "vec_id long, label int, embedding array<float>")
    got = HardNegatives().mine(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 3, 1, 4, 0, 0)]
    with pytest.raises(Exception, match="53 bits"):
        HardNegatives().mine(spark.createDataFrame([(0, 1, [1e300])], df.schema.simpleString()[7:-1].replace("float", "double")), F.lit(True)).count()


def test_op11(spark):
    assert same_as_sql(op11_hard_negatives(spark, DATA), OP11_SQL, embeddings=f"{DATA}/embeddings.parquet")


# ---- pieces

ODD_TEXTS = ["", "a", " ", "  ", "\n", "<s>", "<0x41>", "▁", "▁▁a", " <unk> x", "a" * 1000, "ab" * 3000, " " * 100, "\n\n  \n", "x\u0000y", "🎉漢字ẞ́", "\r\n\t"]


def test_pieces_equal_the_library():
    rng = random.Random(2)
    letters = " \n▁aeinthABC019.,;<>s/é漢字🎉ẞ\x00�\tͰ"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 150))) for _ in range(1500)]
    codec = PieceCodec(piece_model())
    assert codec.encode(texts) == codec.library.encode(texts)
    assert codec.encode(texts) == codec.library.encode(texts)  # from the table
    some = [t for t in texts if t]
    spelled = [[codec.symbols.get(c, -1) for c in t] for t in some]
    assert [tuple(codec.by_heap(s)) for s in spelled] == codec.by_rounds(some)


def test_a_small_table_changes_nothing(monkeypatch):
    import sparkloom.llm.pieces as pieces

    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 5)
    codec = PieceCodec(piece_model())
    texts = ["one two three four five six seven"] * 2 + ["eight nine"] + ODD_TEXTS
    for t in ([texts[0]], texts, texts[::-1], texts[2:3]):
        assert codec.encode(t) == codec.library.encode(t)
    assert len(codec.cache) <= 5


def test_a_difference_from_the_library_is_an_error(monkeypatch):
    codec = PieceCodec(piece_model())
    monkeypatch.setattr(codec, "by_rounds", lambda chunks: [tuple(codec.symbols[c] for c in x) for x in chunks])
    with pytest.raises(RuntimeError, match="differ"):
        codec.encode(["the other day"])


def test_pieces_of_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(1, "a"), (None, "one two"), (None, None), (7, None), (99, "long " * 30_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    library = PieceCodec(piece_model()).library
    want = sorted(((i, len(x := library.encode(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(map(tuple, digests(df).collect()), key=str) == want
    encoded = encode_documents(df)
    assert sorted((r.doc_id, list(r.ids)) for r in encoded.where("doc_id is not null").collect()) == sorted((i, library.encode(t or "")) for i, t in rows if i is not None)
    assert {r.text for r in decode_ids(encoded.where("doc_id is null")).collect()} == {"one two", ""}
    assert decode_ids(encoded.withColumn("ids", F.lit(None))).where("text is not null").count() == 0
    assert digests(df.limit(0)).count() == 0


def test_op12(spark):
    got = op12_pieces(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    library = PieceCodec(piece_model()).library
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---- phrases


def mined_phrases(rows, longest, least, k):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
            n["und" if lang is None else lang] += len(w)
    out = []
    for lang, count in f.items():
        given = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        covered = {p for q, b in given.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 80 * given[p := q[i : i + m]]}
        scored = []
        for p, a in given.items():
            if p not in covered:
                s, _, left, right = min((2000000 * a // (count[p[:c]] + count[p[c:]]), c, count[p[:c]], count[p[c:]]) for c in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    word = lambda: rng.choice(["New", "york", "City", "of", "the", "é", "n b", "a|b"] + [f"w{i}" for i in range(25)])
    text = lambda n: "".join(rng.choice(["New York City ", "of the ", word() + " ", word() + ", ", word() + ".\n", word() + "\t", "x! ?; "]) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 80)), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(200, rows[0][1], "en")] * 40  # copies
    return rows + [(300, "same " * 4000, "en"), (301, "a b " * 2500 + "end", "de"), (302, None, "en"), (303, "", None), (304, " .,;\n", "de"), (None, "lonely", "xx"), (305, "A" * 100_000, "")]


@pytest.mark.parametrize("every,bits,longest", [(16, 27, 4), (2, 12, 4), (1, 18, 3), (10**9, 20, 2), (5, 1, 5)])
def test_phrases_brute_force(spark, talk, every, bits, longest):
    df = clashing(spark.createDataFrame(talk, "doc_id long, text string, lang string")).repartition(3)
    got = Phrases(longest=longest, least=30, every=every, bits=bits).top(df, 60)
    want = mined_phrases(talk, longest, 30, 60)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want


def test_phrases_summed_early(spark, talk, monkeypatch):
    import pyarrow as pa

    import sparkloom.llm.phrases as phrases

    def total(n):
        texts = pa.Table.from_pylist([{"lang": lang or "und", "text": (t or "").encode()} for _, t, lang in talk], pa.schema([("lang", pa.string()), ("text", pa.binary())])).to_batches(max_chunksize=50)
        order = lambda found: sorted((r for b in found for r in b.to_pylist()), key=lambda r: (r["bucket"], r["lang"]))
        batches = lambda rows, like: pa.Table.from_pylist(rows, like).to_batches(max_chunksize=7)
        found = list(phrases._parse(3, 16, 5)(iter(texts)))
        blocks = list(phrases._numbered(batches(order(found), found[0].schema)))
        found = list(phrases._counted(n, 3, 20, 3, None, None)(iter(blocks)))
        return len(blocks), sorted(str(r) for b in phrases._enough(1)(batches(order(found), found[0].schema)) for r in b.to_pylist())

    for n in (1, 2, 4):
        with monkeypatch.context() as m:
            few, whole = total(n)
            m.setattr(phrases, "BLOCK", 20)  # many blocks, and the sums of a few of them at a time
            many, parts = total(n)
            m.setattr(phrases, "PLACES", 100)
            m.setattr(phrases, "TABLE_WORDS", 3)
            assert many > few and parts == whole and total(n)[1] == whole


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Phrases().top(df).count() == 0
    with pytest.raises(ValueError):
        Phrases(longest=1)


def test_op13(spark):
    assert same_as_sql(op13_phrases(spark, DATA), OP13_SQL, documents=f"{DATA}/documents.parquet")
