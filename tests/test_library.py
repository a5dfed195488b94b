"""Small cases for what the tables don't hold: nulls, clashes, odd names, files, curated concepts."""

import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cells as C
from sparkloom.operators import context as X
from sparkloom.operators import evidence as E
from sparkloom.operators import search as S
from sparkloom.operators import store as K
from sparkloom.operators import tables as Y
from sparkloom.operators import vectors as V
from sparkloom.sources import records as R
from sparkloom.streaming.imports import import_new
from sparkloom.streaming.progress import until_pause


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_texts(spark):
    long = " ".join(f"w{i}" for i in range(50))
    assert one(spark, T.first_sentence, long + ". More") == " ".join(f"w{i}" for i in range(40)) + " [...]"
    assert one(spark, T.first_sentence, "Is it? Yes. No") == "Is it? Yes."
    assert one(spark, T.normalise, "a\x07​b c \t\r\n\n\n\nd\x7f  ") == "ab c\n\nd"
    assert one(spark, T.scrub, "key sk-abcdefgh1 AUTHORIZATION: Bearer xyz end") == "key sk-***REDACTED*** AUTHORIZATION: sk-***REDACTED*** end"
    assert one(spark, T.display_title, "a\\b/My_file--one.v2.pdf") == "My file one.v2" and one(spark, T.display_title, ".pdf") == ".pdf"
    assert one(spark, T.source_path, "/a/./../ b //c.pdf") == "a/b/c.pdf" and one(spark, T.source_path, "../..") == "upload"
    assert one(spark, T.safe_filename, "../x/..we ird?.name.p d!f") == "we_ird_.name.pdf" and one(spark, T.safe_filename, None) == "file"
    assert [one(spark, T.legal_id, v) for v in ("a.b-1", "a..b", ".a", "", None, "a\n")] == [True, False, False, False, False, False]
    assert one(spark, T.folder_name, " . a/b\tc  . ") == "a b c"
    assert one(spark, T.diagram_label, "a[b]\"c\" d-e") == "abc d-e" and one(spark, T.diagram_label, "[]") == "term"
    assert one(spark, T.first_line, "\n  \n x y \nz") == "x y" and one(spark, T.long_terms, "ab abcd ABCD abcde 1abcdef") == ["abcdef", "abcde", "abcd"]


def test_null_keys(spark):
    d = spark.createDataFrame([(1, "x"), (2, None), (None, "x"), (3, None)], "id int, t string")
    got = {(r.id, r.duplicate_of) for r in Y.duplicates(d, "id", "t").collect()}
    assert got == {(1, None), (2, None), (3, None), (None, None)}
    old, new = spark.createDataFrame([(None, 1)], "k string, n int"), spark.createDataFrame([(None, 2), ("a", 3), ("a", 4)], "k string, n int")
    assert {(r.k, r.n) for r in Y.insert_if_absent(old, new, ["k"], ["n"]).collect()} == {(None, 1), ("a", 3)}
    c = spark.createDataFrame([(2, 0, "c"), (None, 0, "a"), (None, 1, "b"), (5000, 0, "d")], "i long, t int, r string")
    got = Y.reading_order(c, "i", ["t"], "r", "before").orderBy("position").collect()
    assert [(r.position, r.r, r.before) for r in got] == [(0, "a", None), (1, "b", "a"), (2, "c", "b"), (3, "d", "c")]
    docs = spark.createDataFrame([(None, 1, "cat dog"), (None, 2, "dog"), (None, 3, "emu"), (None, 4, "fox"), ("s", 5, "cat")], "source string, doc_id int, text string")
    asked = spark.createDataFrame([(0, "cat")], "item_id int, token string")
    assert {(r.source, r.doc_id) for r in S.bm25(docs, asked).collect()} == {(None, 1), ("s", 5)}


def test_null_keys_in_streams(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(None, n), (f"k{n}", n)], "k string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, n int").parquet(f"{tmp_path}/in")
        rows = import_new(stream, f"{tmp_path}/out", ["k"], ["n"]).collect()
    assert {(r.k, r.n) for r in rows} == {(None, 0), ("k0", 0), ("k1", 1)} and len(rows) == 3


@pytest.mark.parametrize("seed", range(6))
def test_free_slugs(spark, seed):
    rng = random.Random(seed)
    slugs = [rng.choice(["a", "a-2", "a-2-2", "a-3", "b"]) for _ in range(14)]
    taken, want = {"b", "a-4"}, []
    for s in slugs:
        n, name = 1, s
        while name in taken:
            n += 1
            name = f"{s}-{n}"
        taken.add(name)
        want.append(name)
    held = spark.createDataFrame([("b",), ("a-4",)], "id string")
    got = Y.free_slugs(spark.createDataFrame(list(enumerate(slugs)), "k long, s string"), "s", "k", held).orderBy("k").collect()
    assert [r.id for r in got] == want


def test_name_groups(spark):
    rng = random.Random(5)
    names = list({"".join(rng.choice("ab -_") for _ in range(rng.randrange(1, 8))) + ".pdf" for _ in range(40)})
    stem = {n: " ".join(n[:-4].replace("-", " ").replace("_", " ").split()).lower() for n in names}

    def prefix(a, b):
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[:i].strip()

    left, want = sorted(names), {}
    while left:
        head = left.pop(0)
        bucket = [head, *[n for n in left if len(prefix(stem[head], stem[n])) >= 4]]
        left = [n for n in left if n not in bucket]
        shared = stem[head]
        for n in bucket:
            shared = prefix(shared, stem[n])
        want |= {n: shared if len(bucket) > 1 else n for n in bucket}
    got = K.shared_prefix_groups(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert {r.name: r.group for r in got} == want
    codes = {n: one(spark, K.course_code, n) for n in ("COMP5211_w1.pdf", "x/comp 5211 syllabus.pdf", "MATH-501a.pdf", "lecture.pdf", "economy1012.pdf")}
    assert list(codes.values()) == ["COMP5211", "COMP5211", "MATH501A", None, None]


def test_references(spark):
    cases = {"A1": ("S", 1, 1, 1, 1), "$B$2:D9": ("S", 2, 2, 4, 9), "'My ''x'!AA3": ("My 'x", 27, 3, 27, 3), "Data!C:C": ("Data", 3, None, 3, None), "2:3": ("S", None, 2, None, 3), "nope(": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", C.reference(F.col("v"), F.lit("S")).alias("r")).collect()
    assert {r.v: r.r and tuple(r.r) for r in rows} == cases
    cells = spark.createDataFrame([("S", i, 1, None if i == 2 else str(i)) for i in range(1, 5)], "sheet string, row long, col long, value string")
    refs = spark.createDataFrame([(0, "A1:A3"), (1, "A:A"), (2, "T!A1"), (3, "A1:ZZ9999"), (4, "?")], "k int, v string").select("k", C.reference(F.col("v"), F.lit("S")).alias("ref"))
    got = {r.k: (r.error, r.cell_count, r.nonblank_count, list(r.sample)) for r in C.resolved(refs, cells, "k").collect()}
    assert got == {0: (None, 3, 2, ["1", "3"]), 1: (None, 4, 3, ["1", "3", "4"]), 2: ("unknown sheet", None, None, []), 3: ("too many cells", None, None, []), 4: ("unsupported reference", None, None, [])}


def test_context(spark):
    chunks = spark.createDataFrame([("c", i, i // 4, i, t) for i, t in enumerate(["one two", "red sun", "blue moon", "", "green sky", "last"])], "course string, chunk_id int, deck int, position int, text string")
    asked = spark.createDataFrame([(5, "c", 5, 4), (0, "c", 0, None)], "query_id int, course string, position int, previous int")
    hits = spark.createDataFrame([(5, 4, 0.9, 1), (5, 0, 0.8, 2), (5, 2, 0.7, 3), (5, 3, 0.6, 4), (5, 1, 0.0, 5), (0, 4, 0.9, 1)], "query_id int, chunk_id int, score double, rank int")
    decks, said = spark.createDataFrame([("c", 0), ("c", 1)], "course string, deck int"), spark.createDataFrame([("c", "one two three")], "course string, summary string")
    got = X.retrieved_context(hits, asked, chunks, decks, said).orderBy("query_id", "place").collect()
    # the chunk before comes first; one the summary says, an empty one, one that scores nothing and later ones don't come
    assert [(r.query_id, r.place, r.chunk_id, r.relation) for r in got] == [(5, 1, 4, "Immediately previous"), (5, 2, 2, "Related earlier slide")]
    concepts = spark.createDataFrame([("regression", list(E.CONCEPTS["regression"]), "curated_alias", 1, 1), ("alpha", [], "course_term", 9, 9), ("beta", [], "course_term", 9, 12)], "label string, aliases array<string>, kind string, artifact_count int, evidence_count int")
    assert [r.label for r in X.ranked_concepts(concepts).orderBy("place").collect()] == ["regression", "beta", "alpha"]
    assert [r.label for r in X.ranked_concepts(concepts, " LEAST_sq").collect()] == ["regression"]
    evidence = spark.createDataFrame([("regression", "f1", "o1", 1), ("regression", "f1", "o2", 2), ("other", "f2", "o3", 1)], "label string, artifact string, object string, place int")
    links = spark.createDataFrame([("f1", "f2", "o1", "o3")], "artifact string, to string, object string, target string")
    before = spark.createDataFrame([("regression", "alpha"), ("regression", "gone")], "required string, advanced string")
    edges = {(r.source, r.target, r.relation, tuple(r.object_ids)) for r in X.graph_edges(concepts, evidence, links, before).collect()}
    assert edges == {("regression", "artifact-f1", "appears_in", ("o1", "o2")), ("artifact-f1", "artifact-f2", "explicit_reference", ("o1", "o3")), ("regression", "alpha", "prerequisite_candidate", ())}
    answers = spark.createDataFrame([("a [S1] b [S3]", 3), ("a [S4]", 3), ("a", 3), (None, 3), ("[S0]", 3)], "a string, n int")
    assert [r.x for r in answers.select(X.cites_validly(F.col("a"), F.col("n")).alias("x")).collect()] == [True, False, False, False, False]


def test_vectors_of_words_and_pairs(spark):
    import hashlib
    import math
    from collections import Counter

    words = "the cat the hat".split()
    features = Counter(words + [f"{a}_{b}" for a, b in zip(words, words[1:])])
    want = [0.0] * 384
    for f, n in features.items():
        h = hashlib.md5(f.encode()).digest()
        want[int.from_bytes(h[:4], "big") % 384] += (-1 if h[4] % 2 else 1) * (1 + math.log(n))
    norm = math.sqrt(sum(x * x for x in want))
    got = {r.i: r.vec for r in V.hash_vectors(spark.createDataFrame([(1, "The cat, the HAT"), (2, ""), (3, None)], "i int, text string"), "i").collect()}
    assert got[1] == pytest.approx([x / norm for x in want]) and set(got[2]) == set(got[3]) == {0.0}


def test_stored(spark, tmp_path):
    a, b = spark.range(5), spark.range(3)
    K.publish(a, f"{tmp_path}/t")
    K.publish(b, f"{tmp_path}/t")
    b.write.parquet(f"{tmp_path}/t/version=9")  # written, never told
    assert K.published(spark, f"{tmp_path}/t").count() == 3
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int"), spark.createDataFrame([("a", 9), ("d", 8), ("d", 10)], "k string, n int")
    assert [(r.k, r.n, r.place) for r in K.upsert_last(old, new, "k", "n").orderBy("place").collect()] == [("b", 2, 0), ("c", 3, 1), ("a", 9, 2), ("d", 10, 3)]
    log = spark.createDataFrame([("p", 1, "x", False), ("p", 2, "x", True), ("p", 3, "x", True), ("p", 4, "y", True), ("q", 5, "x", True), ("p", 6, "x", True), ("q", 7, None, True)], "p string, t int, c string, ok boolean")
    got = K.import_states(log, ["p"], ["t"], "c", F.col("ok")).orderBy("t").collect()
    assert [(r.status, r.version, r.duplicate_of) for r in got] == [("failed", 1, None), ("retried", 1, None), ("unchanged", 1, None), ("superseding", 2, None), ("new", 1, "p"), ("superseding", 3, None), ("superseding", 2, None)]
    assert got[3].supersedes == got[0].content_id and got[5].supersedes == got[3].content_id
    bad = spark.createDataFrame([("u", i, b) for i, b in enumerate([1, 0, 1, 1, 0, 1, 1, 1, 0, 1])] + [("v", 0, 1)], "u string, i int, bad int")
    kept = until_pause(bad, "u", ["i"], F.col("bad") == 1).collect()
    assert max(r.i for r in kept if r.u == "u") == 7 and {(r.u, r.state) for r in kept} == {("u", "paused"), ("v", "idle")}


def test_files(spark, tmp_path):
    for name in ("deck.pptx", "sub/notes.PDF", ".hidden.pdf", "sub/~$deck.pptx", ".git/x.csv", "readme.txt", "a.b.ipynb"):
        p = tmp_path / "files" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = {(r.path, r.kind) for r in R.listed_files(spark, f"{tmp_path}/files").collect()}
    assert got == {("deck.pptx", "pptx"), ("sub/notes.PDF", "pdf"), ("a.b.ipynb", "ipynb")}
    pages = tmp_path / "pages"
    pages.mkdir()
    for name, text in (("page-0001.txt", "one"), ("page-0001.png", "x"), ("page-0003.png", "x"), ("page-12345.txt", "far"), ("page-1.txt", "no")):
        (pages / name).write_text(text)
    assert {(r["index"], r.text) for r in R.read_pages(spark, str(pages)).collect()} == {(0, "one"), (2, ""), (12344, "far")}
    refs = tmp_path / "refs"
    refs.mkdir()
    Path(refs / "abc.txt").write_text("two\nlines")
    assert [tuple(r) for r in R.read_texts(spark, str(refs)).collect()] == [("abc", "two\nlines")]
    lines = ['{"id": "a", "n": 3, "f": 1.5, "b": true, "l": [3, 1, "x", 3, true]}', '{"id": "b", "n": true, "f": 2, "b": 1, "l": 5}', '{"n": 1}', "broken {", "[1]", ""]
    (tmp_path / "lines.jsonl").write_text("\n".join(lines))
    rows = R.read_records(spark, f"{tmp_path}/lines.jsonl", {"id": "string", "n": "long", "f": "double", "b": "boolean", "l": "array<long>"}, ("id",)).orderBy("id").collect()
    assert [(r.id, r.n, r.f, r.b, list(r.l)) for r in rows] == [("a", 3, 1.5, True, [1, 3]), ("b", 0, 2.0, False, [])]
    png = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + b"x").decode()
    data = spark.createDataFrame([(png, "image/png"), (png, "image/gif"), ("!", "image/png"), (None, None), (png, "text/html")], "d string, k string")
    assert [r.x is not None for r in data.select(R.media(F.col("d"), F.col("k")).alias("x")).collect()] == [True, False, False, False, False]
    assert R.lookup(spark.range(3), id=2).count() == 1
    with pytest.raises(KeyError):
        R.lookup(spark.range(3), id=9)
