"""Stemmed search against SQLite's full-text index, sentence functions against a plain scan, and small cases of the other new operators."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sentences as N
from sparkloom.functions.stems import search_words, stem, stems
from sparkloom.operators import evidence as E
from sparkloom.operators import search as S
from sparkloom.operators import tables as X
from sparkloom.plans.texts import PHRASES, banned_sentences, search_stemmed

DATA = "/root/testdata/sf0.001"
WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll by a is regressions naïve".split()


def test_stems_agree_with_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    words = [w.replace("ï", "i") for w in WORDS]
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    theirs = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert {w: stem(w) for w in words} == {w: theirs[i] for i, w in enumerate(words)}


def test_search_words(spark):
    df = spark.createDataFrame([("Naïve foo_bar ÉTÉ éa 3x",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(search_words(F.col("t")).alias("w")).collect()] == [["naive", "foo", "bar", "ete", "ea", "3x"], None, []]


def test_stemmed_scores_agree_with_sqlite(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' WHERE lang = 'en'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet' LIMIT 15").fetchall()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("one"))
    asked = S.query_terms(spark.createDataFrame(items, "item_id long, text string"), "item_id", split=search_words, stem=stems)
    mine = {(r.item_id, r.doc_id): r.score for r in S.bm25(d, asked, split=search_words, stem=stems).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", docs)
    terms = {}
    for r in asked.collect():
        terms.setdefault(r.item_id, []).append(f'"{r.token}"')
    theirs = {}
    for item, each in terms.items():
        # a stem may be stemmed again: ask only for stems that stay
        assert each
        kept = " OR ".join(sorted(t for t in each if stem(t.strip('"')) == t.strip('"')))
        if len(each) == kept.count(" OR ") + 1:
            theirs |= {(item, k): -s for k, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (kept,))}
    assert len(theirs) > 100
    assert {k for k in mine if k[0] in {i for i, _ in theirs}} == theirs.keys()
    assert all(mine[k] == pytest.approx(v, abs=2e-6) for k, v in theirs.items())


def test_search_stemmed_covers_items(spark):
    rows = search_stemmed(spark, DATA).collect()
    assert rows and all(1 <= r.rank <= 5 for r in rows) and len({(r.item_id, r.source, r.rank) for r in rows}) == len(rows)


def scanned(text: str) -> list[tuple[int, int]]:
    """Where sentences begin and end, one sign at a time."""
    cuts, start, i = [], 0, 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        stop = c in ".!?" and text[i - 1 : i] != "." and not (after.isascii() and after.isdigit()) and (not after or after.isspace() or after in "\"'”’)]")
        if c == "." and stop and any(text[: i + 1].lower().endswith(a) for a in N.ABBREVIATIONS):
            stop = False
        if c == "\n" or stop:
            i += 1
            while stop and text[i : i + 1] and text[i] in "\"'”’)]":
                i += 1
            cuts.append((start, i))
            start = i
        else:
            i += 1
    return [*cuts, (start, len(text))]


def cut_out(text: str, phrases) -> tuple[int, str]:
    """Sentences of a text, and the text without those that hold a phrase."""
    found = [(a, b) for a, b in scanned(text) if text[a:b].strip()]
    spans = [(b - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in found]
    if not any(p in text.lower() for p in phrases):
        return len(spans), text
    out, at, kept = "", 0, True
    for a, b in spans:
        gap, core, at = text[at:a], text[a:b], b
        if any(p in core.lower() for p in phrases):
            kept = False
            continue
        if kept:
            out += gap
        elif out:
            out += "" if out[-1].isspace() else " "
            before = out[:-1].rstrip("\"'”’)]")
            if len(out) - 1 - len(before) <= 1 and before[-1:] in tuple(".!?") and core[0].isascii() and core[0].islower():
                core = core[0].upper() + core[1:]
        out += core
        kept = True
    return len(spans), out + (text[at:] if kept else "")


CASES = [
    "One. Two! Three? four", "Version 1.5 is out... really. E.g. this one. Done.", 'He said "Go." Then left. (Really!) yes', "a\nb\n\nc. d", "", None, "   ", "no stop",
    "Kept one. This will be covered soon. and then more.", "This will be covered. rest", "A b.\nSubject matter here.\n\nc d. e", "All gone will be covered", "Ends kept. Subject matter",
    "Slide 3: Title; next — part", "Stop. Subject matter. Subject matter. \"quoted.\" tail",
]


def test_sentences(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = df.select("i", F.size(N.sentences(F.coalesce("t", F.lit("")))).alias("n"), N.without_sentences(F.col("t")).alias("left")).collect()
    for r in got:
        n, left = cut_out(CASES[r.i] or "", N.BANNED)
        if r.i != 13:
            assert (r.n, r.left) == (n, left), CASES[r.i]
    assert got[13].left == "Title. Next, part"
    assert got[8].left == "Kept one. And then more."


def test_banned_sentences(spark):
    import hashlib
    import re

    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    for r in banned_sentences(spark, DATA).collect():
        n, left = cut_out(texts[r.doc_id], PHRASES)
        left = re.sub(r"(?im)^(\s*[-*•]?\s*)Slide\s+\d+\s*:\s*", r"\1", left)
        left = re.sub(r"\s*[–—]\s*", ", ", left)
        left = re.sub(r";\s+([a-zA-Z])", lambda m: ". " + m[1].upper(), left).replace(";", ".")
        assert (r.n_sentences, r.left_md5) == (n, hashlib.md5(left.encode()).hexdigest()), r.doc_id


def test_json_object(spark):
    cases = {'{"a": 1}': '{"a":1}', 'x {"a": {"b": 2}} y': '{"a":{"b":2}}', '```json\n{"a": 3}\n``` end': '{"a":3}', "[1]": None, "{broken": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.j for r in df.select("t", N.json_object(F.col("t")).alias("j")).collect()} == cases


def test_role(spark):
    rows = [("a/Syllabus.pdf", "grading and office hours"), ("w3.pptx", "- a\n" * 7), (None, None), ("x.pdf", "word " * 250), ("x/L01-intro.pdf", "learning outcomes")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = [(r.role, r.confidence) for r in E.role(df, "p", "t").collect()]
    # 4 to 1.5; 2.5 + 1.5 + 1.5 + 1; nothing; 2 to 0; 1.5 + 1.5 to 0.75
    assert got == [("reference", 0.85), ("slides", 0.97), ("slides", 0.5), ("reference", 0.74), ("slides", 0.82)]


def test_expanded_terms(spark):
    q = spark.createDataFrame([(1, "the big data set a"), (2, "other"), (3, None), (4, "")], "item_id long, text string")
    c = spark.createDataFrame([("x", "big data"), ("x", "warehouse"), ("y", "othe")], "label string, alias string")
    got = S.expanded_terms(q, c, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_list("token")).alias("t")).collect()
    assert {r.item_id: r.t for r in got} == {1: ["big", "data", "set", "the", "warehouse"], 2: ["other"]}


def test_first_rows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    got = X.first_rows(df, ["g"], ["k"], 3, salts=8).orderBy("g", "k").collect()
    assert [(r.g, r.k) for r in got] == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]
    assert X.first_rows(df.limit(0), ["g"], ["k"], 3).count() == 0
