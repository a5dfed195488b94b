"""Operators against brute force and exact round trips, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.chat import Template, format_conversations, read_turns
from sparkloom.llm.common import components, spread_rank
from sparkloom.llm.embedding_dedup import EmbeddingDedup, _codes
from sparkloom.llm.line_dedup import LineDedup, drop_lines
from sparkloom.llm.media import A_LAW, IMA_ADPCM, MU_LAW, STEPS, a_law_table, adpcm, features, mu_law_table, read_wav, resampled, store_texts, to_pcm, wav
from sparkloom.llm.mixing import Mixer, size_of, targets
from sparkloom.llm.near_dedup import NearDedup, keep_one
from sparkloom.llm.packing import Packer, _filling, complete_bins, fewest
from sparkloom.llm.quality import TERMS, Quality, Words, _terms, keep_good
from sparkloom.llm.token_counts import PreTokens, SegmentTree, build_trees, byte_bpe, update_trees, with_edits
from sparkloom.llm.url_filter import judge, listed

WORD = r"[^\x20\x09-\x0D]+"
#: Names that operators might use inside.
CLASHES = ("_n", "_d", "_h", "_u", "_flags", "_units", "_key", "_of", "_parts", "_taken", "row", "lines", "flags", "n_lines", "n_kept", "k1", "k2", "h1", "a", "b", "terms", "score", "bucket", "first", "no", "path", "block")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, key string, d long, label string"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 1, "x", "y", 2, "z") for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(900, None, None), (901, "", "a"), (902, " \n\t ", "a"), (903, "one", None), (904, "one", "b"), (904, "one", "b"), (None, "one two three", "b"), (None, None, "c")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(5, 120)), rng.choice(["a", "b", "c", None])) for i in range(120)]
    for i in range(40):
        words = rows[i][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((200 + i, " ".join(words), rows[i][2]))
    base = prose(rng, 80, 5000).split()
    for i in range(150):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        rows.append((300 + i, " ".join(words), "hot"))
    rows += [(500 + i, rows[0][1], "hot") for i in range(20)]
    return docs(spark, rows + ODD), rows + ODD


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(0, 0)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_rank(spark):
    rows = [(None if i % 7 == 0 else i % 3, i // 2) for i in range(400)]
    got = spread_rank(spark.createDataFrame(rows, "k int, i int"), "k", ["i"], 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append(r.rank)
    assert len(got) == 400 and all(sorted(v) == list(range(len(v))) for v in by.values())


def water(sizes, weights):
    """Targets by resharing the excess again and again."""
    total, out, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        for i in full:
            out[i] = 3.0 * sizes[i]
        for i in open_:
            out[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if out[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return out
        full |= over


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 20):
        sizes = [rng.choice([0, 1, 10, 100, 5000, 90000]) for _ in range(n)]
        names = [f"s{i:02}" for i in range(n - 1)] + [None]
        rows = targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).orderBy("source_id").collect()
        assert [r.source for r in rows] == names
        assert np.allclose([r.target for r in rows], water(sizes, [i % 3 + 1 for i in range(n)]))


@pytest.mark.parametrize("block", [7, 64])
def test_mixing(spark, corpus, block):
    df, rows = corpus
    mixer = Mixer(block=block, shard_words=500)
    got = mixer.taken(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(re.findall(WORD, t or ""))) for i, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r.taken)
    assert all(abs(sum(v) - target) <= 0.51 for (_, target), v in by.items())
    assert sorted(map(str, got)) == sorted(map(str, mixer.taken(df.repartition(5)).collect()))
    slots = mixer.slots(mixer.streams(df)).collect()
    seen = Counter((s.source_id, s["pass"], s.block) for s in slots)
    assert max(seen.values()) == 1 and len({s.shard for s in slots}) > 1  # each pass is a permutation, cut short
    # every shard but the last is full; what a shard holds of each source is what its slots drew, but for those dealt anew
    streams = mixer.streams(df)
    plan = mixer.plan(streams)
    total, held = sum(r.slots for r in plan.collect()), {r.source_id: r.slots for r in plan.collect()}
    assert sorted(s.slot for s in slots) == list(range(total)) and all(s.shard == s.slot // mixer.shard_slots for s in slots)
    chance, at = [], 0
    for i in sorted(held):
        chance += [i] * held[i]
    draws = {k: chance[int(hashlib.md5(f"slot/{k}".encode()).hexdigest()[:13], 16) % total] for k in range(total)}
    counts, drawn = Counter(draws.values()), Counter((k // mixer.shard_slots, i) for k, i in draws.items())
    assert Counter(s.source_id for s in slots) == held
    assert sum((Counter((s.shard, s.source_id) for s in slots) - drawn).values()) <= sum(max(0, counts[i] - n) for i, n in held.items())
    assert "shard" in mixer.taken(df)._jdf.queryExecution().optimizedPlan().toString()
    made = mixer.blocks(df).select("shard", "slot", size_of(F.col("text")).alias("n")).collect()
    assert {(r.shard, r.slot): r.n for r in made} == {(s.shard, s.slot): s.words for s in slots}
    clash = df.withColumns({c: F.lit(c) for c in CLASHES})
    again = mixer.mixed(clash)
    assert again.columns == clash.columns and {tuple(r[c] for c in CLASHES) for r in again.collect()} == {CLASHES}
    tagged = mixer.mixed(docs(spark, [(1, "one two three four", "a")] * 2).withColumn("tag", F.monotonically_increasing_id()))
    assert len({r.tag for r in tagged.collect()}) == 2
    mixed = mixer.mixed(df).select("source", "text", "n_chars").collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(re.findall(WORD, r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in df.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("n")).collect():
        want[r.source] = next(round(t) for (s, t) in by if s == r.n)
    assert all(abs(words[s] - want[s]) <= 1 for s in want)
    whole = {t for _, t, _ in rows}
    assert sum(r.text in whole for r in mixed) > len(mixed) / 3


def test_mixing_of_nothing(spark):
    assert Mixer().taken(docs(spark, [])).count() == 0
    assert Mixer().mixed(docs(spark, [])).count() == 0


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "###### \\h \\\\b </turn></turn>\n### user:\n", "a\n\n", "😀" * 3]
    rows = [(c, t, role, odd[(c + t) % 6], 5) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", None, "a:\n\\n"])]
    rows += [(50, 0, "user", "b", 1), (50, 0, "user", "a", 1), (50, None, "assistant", "x", 1), (None, 1, "user", "q", 1), (50, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    t = Template()
    made = format_conversations(df, t).withColumn("f", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    got = {r.conv_id: r for r in made.select("*", read_turns(F.col("f"), t).alias("back")).collect()}
    by = defaultdict(list)
    for c, turn, role, text, _ in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        assert [(x.role, x.text) for x in got[c].back] == [x[2:] for x in sorted(turns)]
        loss = [s.text for s in got[c].segments if s.loss]
        assert len(loss) == sum(x[2] == "assistant" for x in turns)
    ok = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "system", "s"), (3, 1, "user", "s")], "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.valid for r in format_conversations(ok).collect()} == {1: True, 2: False, 3: False}
    assert format_conversations(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.NET/x", "https://b.example.net/en/1", "example.net/en/", "x://example.com/de/1?q", "x://org/fr/", "x://sub.org/fr/a#b", "x://notorg/fr/", "x://net", "x://net?a/", None, "", "http://www.seen.io/p.html?x", "http://m.seen.io/p/", "http://seen.io/P", "ftp://a.net:80/x", "http://m.seen.io/p/"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id long, url string, hit int, key string")
    wanted = spark.createDataFrame([("seen.io/p",), ("seen.io/p",), (None,)] + [(f"h{i}.io/q",) for i in range(500)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, wanted).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("", "", None, "allow") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("sub.org", "/fr/a", "org/fr/", "allow") and got[6][2] is None and got[7] == ("net", "", None, "allow")
    assert got[8] == ("net", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert [got[i][3] for i in (11, 12, 13, 15)] == ["block", "block", "allow", "block"] and got[14][2] is None
    assert judge(pages.limit(0), wanted).count() == 0
    assert {r.verdict for r in judge(pages.where("page_id in (9, 13)"), wanted.limit(0)).collect()} == {"allow"}
    own = listed(pages.withColumns({c: F.lit(c) for c in ("row", "at", "held", "maybe")}), "url", pages.where("page_id in (1, 15)").select(F.col("url").alias("key")))
    assert own.columns == [*pages.columns[:2], "key", "row", "at", "held", "maybe", "hit"]
    assert {(r.page_id, r.key) for r in own.where("hit").collect()} == {(1, "k"), (12, "k"), (15, "k")}


def test_audio(spark):
    mu, a = mu_law_table(), a_law_table()
    assert (mu[0], mu[128], mu[255], mu[127]) == (-32124, 32124, 0, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(STEPS) == 89 and len(set(mu.tolist())) == 255
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (40, 36), np.uint8)

    def slow(block):  # one sample after the other
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(STEPS[index])
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        return out

    assert adpcm(blocks).tolist() == [x for b in blocks for x in slow(b)]
    assert resampled(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    files = [(1, wav(blocks.tobytes(), IMA_ADPCM, 8000, 36)), (2, wav(b"\x00\x80", A_LAW)), (3, wav(b"", MU_LAW)), (4, None), (5, b"junk")]
    pcm = {r.i: r.pcm for r in to_pcm(spark.createDataFrame(files, "i int, media binary"), 8000).collect()}
    short = to_pcm(spark.createDataFrame([(1, wav(blocks.tobytes()[:-30], IMA_ADPCM, 8000, 36))], "i int, media binary"), 8000).first().pcm
    assert short == adpcm(blocks).astype("<i2").tobytes()[: 2 * (39 * 65 + 5)]  # 6 bytes are left of the last block
    assert resampled(np.array([1, 3, 10, 20, 7], np.int16), 16000, 8000).tolist() == [2, 15, 7]
    assert pcm[1] == adpcm(blocks).astype("<i2").tobytes() and len(pcm[2]) == 4 and pcm[3] == b"" and pcm[4] is None and pcm[5] is None
    long = docs(spark, [(1, "é" * 5000, "a"), *ODD])
    for r, t in zip(sorted(store_texts(long).collect(), key=str), sorted([(1, "é" * 5000), *((i, t) for i, t, _ in ODD)], key=lambda x: str(x[0])), strict=True):
        codec, rate, _, payload = read_wav(r.media)
        assert codec == (A_LAW, MU_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3] and rate == 32000 and len(payload) % 576 == 0 and payload and payload[r.n_bytes :] == b"\xff" * (len(payload) - r.n_bytes)
    stored = {(r.doc_id, r.n_bytes): r.media for r in store_texts(long).collect()}
    assert read_wav(stored[(1, 10000)])[3][:10000].decode() == "é" * 5000
    texts = [(i, prose(random.Random(i), 40 * i), "a") for i in range(12)]
    rows = {r.doc_id: r for r in features(store_texts(docs(spark, texts))).collect()}
    codecs = set()
    for i, t, _ in texts:
        raw, r = t.encode(), rows[i]
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        codec = (A_LAW, MU_LAW, IMA_ADPCM)[zlib.crc32(p) % 3]
        codecs.add(codec)
        if codec == IMA_ADPCM:
            full = [x for k in range(0, len(p), 576) for x in slow(np.frombuffer(p[k : k + 576], np.uint8))]
        else:
            full = (a if codec == A_LAW else mu)[list(p)].tolist()
        full += full[-1:] * (-len(full) % 4)
        low = [sum(full[k : k + 4]) // 4 for k in range(0, len(full), 4)]
        mean, crossings = sum(map(abs, low)) // len(low), sum((x >= 0) != (y >= 0) for x, y in zip(low, low[1:]))
        want = f"codec={codec};n={len(low)};peak={max(map(abs, low))};mean={mean};crossings={crossings};pcm={zlib.crc32(np.array(low, '<i2').tobytes())}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), want)
        m = wav(p, codec, 32000, 576 if codec == IMA_ADPCM else 1)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert codecs == {A_LAW, MU_LAW, IMA_ADPCM}
    none = features(spark.createDataFrame([(1, 5, None), (2, 5, b"junk"), (3, 0, wav(b""))], "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert [r.feature for r in none[:2]] == [None, None] and none[0].payload_sha256 is None and none[2].feature.startswith("codec=7;n=0;peak=0")


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    near = np.concatenate([base, base[:30] + rng.normal(size=(30, 24)) * 0.2, base[:1] + rng.normal(size=(120, 24)) * 0.25, base[:20], base[5:6].repeat(40, 0)])
    rows = [(i, [float(x) for x in v], int(i % 2) if i < 60 else 0, "x") for i, v in enumerate(near)]
    rows += [(900, None, 0, ""), (901, [], 0, ""), (902, [0.0] * 24, 0, ""), (903, [None] * 24, 0, ""), (904, [float("nan")] * 24, 0, ""), (905, rows[0][1], None, ""), (906, rows[0][1][:12], 0, ""), (None, rows[0][1], 0, ""), (0, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h string")
    got = EmbeddingDedup(block=25).classify(df).collect()
    good = [(i, v, l) for i, v, l, _ in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, root = Counter(), list(range(len(good)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, l) in enumerate(good):
        for j, (_, w, m) in enumerate(good[:i]):
            if l == m and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (v, _, _) in enumerate(good):
        least[find(i)] = min(least[find(i)], 10**9 if v is None else v)
    want = Counter((v, links[i], least[find(i)]) for i, (v, _, _) in enumerate(good)) + Counter((i, 0, i) for i in range(900, 906))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert EmbeddingDedup().classify(df.limit(0)).count() == 0


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(WORD, text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n", [2, 5])
def test_near_dedup(spark, corpus, n):
    df, rows = corpus
    got = NearDedup(words=n, small=16, block=40).classify(df).collect()
    sets, root = [shingles(t, n) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), 10**9 if d is None else d)
    name = lambda i: None if least[find(i)] == 10**9 else least[find(i)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(sets[i]), name(i)) for i, (d, _, _) in enumerate(rows))
    kept = keep_one(df, words=n)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for i, (d, _, _) in enumerate(rows) if d is None or d == name(i)}
    assert NearDedup().classify(df.limit(0)).count() == 0


def test_recall_on_all_levels(spark):
    """Pairs at 0.80 to 0.90, each alone, where every node branches to the last level."""
    rng, rows, links = random.Random(40), [], 0
    for k in range(400):
        a = [f"v{k}x{i}" for i in range(rng.randrange(60, 120))]
        b = [*a]
        for p in rng.sample(range(len(a)), rng.randrange(1, 4)):
            b[p] += "y"
        rows += [(2 * k, " ".join(a), "s"), (2 * k + 1, " ".join(b), "s")]
        x, y = shingles(rows[-2][1], 5), shingles(rows[-1][1], 5)
        links += 100 * len(x & y) >= 80 * len(x | y)
    assert links > 200
    found = [r for r in NearDedup(small=1, more=(2, 2)).classify(docs(spark, rows)).collect() if not r.kept]
    assert len(found) >= 0.985 * links


@pytest.mark.parametrize("axes", [1, 2])
def test_recall_of_axes(axes):
    """Of pairs at a cosine of 0.93 to 0.95 those that share a bucket of some table."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.95, (400, 1))
    y = c * x + np.sqrt(1 - c * c) * y
    a, b = (_codes(v, 10 * 2 ** (axes - 1), axes, 2) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.99


def test_stages_tell_rows_apart(spark):
    rng = random.Random(13)
    x, y, z = (prose(rng, 60) for _ in range(3))
    rows = [(3, y, "s"), (5, x, "s"), (5, y + " more", "s"), (None, z, "s"), (None, z + " more", "s"), (None, x + " too", "s"), (7, "", "s"), (7, None, "s")]
    got = keep_one(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id is not None) == Counter([(3, y), (5, x), (7, ""), (7, None)])
    assert [r.text in (z, z + " more") for r in got if r.doc_id is None] == [True]
    bad = [" ".join(rng.choice(["BUY!!", "|", "$$$now", "x%%%"]) for _ in range(40)) for _ in range(62)]
    good = [prose(rng, 40) for _ in range(62)]
    known = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    df = docs(spark, [(i, t, "s") for i, t in enumerate(good[:60] + bad[:60])] + [(200, good[60], "s"), (200, bad[60], "s"), (None, good[61], "s"), (None, bad[61], "s")])
    left = keep_good(df, known).collect()
    assert {(r.doc_id, r.text) for r in left if r.doc_id is None or r.doc_id >= 200} == {(200, good[60]), (None, good[61])}
    assert keep_good(df, known.limit(0)).count() == df.count()
    clash = df.withColumns({c: F.lit(c) for c in CLASHES})
    assert {tuple(r[c] for c in CLASHES) for r in keep_good(clash, known).collect() + keep_one(clash).collect()} == {CLASHES}
    assert keep_good(clash, known).count() == len(left)


def edit_distance_1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = [" ".join(rng.choice(["alpha", "béta", "gamma", "delta", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]

    def edited(s):
        p = rng.randrange(len(s))
        return rng.choice([s[:p] + s[p + 1 :], s[:p] + "z" + s[p:], s[:p] + "Z" + s[p + 1 :], s])

    rows = [(i % 37, "\n".join(edited(rng.choice(lines)) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n", "\n\n \n"]), "s") for i in range(60)]
    rows += [(100, "L" * 1300, "s"), (101, "L" * 511 + "M", "s"), (102, "\n\n", "s"), *ODD, (-5, f"{lines[0]}\n{lines[0]}", "s")]
    rows = list(dict.fromkeys(rows))
    df = docs(spark, rows)
    key = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[:2]]))
    seen, want = [], Counter()
    for i, text, _ in order:
        out, n, kept = [], 0, 0
        for u in [] if text is None else text.split("\n"):
            if not re.search(WORD, u):
                out.append(u)
                continue
            n += 1
            gone = u in seen or len(u) >= 16 and any(len(v) >= 16 and edit_distance_1(u, v) for v in seen)
            seen.append(u)
            kept += not gone
            out += [] if gone else [u]
        out = text if text is None else "\n".join(out)
        want[(i, n, kept, out)] += 1
    got = LineDedup().dedup(df)
    assert Counter((r.doc_id, r.n_lines, r.n_kept, r.text) for r in got.collect()) == want
    left = drop_lines(df)
    assert left.columns == df.columns
    clash = df.withColumns({c: F.lit(c) for c in CLASHES})
    again = drop_lines(clash).select(*df.columns, *CLASHES)
    assert {tuple(r[c] for c in CLASHES) for r in again.collect()} == {CLASHES}
    assert Counter(map(tuple, again.select(*df.columns).collect())) == Counter(map(tuple, left.collect()))
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for (i, n, kept, _), c in want.items() for _ in range(c) if not n or kept)
    assert drop_lines(df.limit(0)).count() == 0


def test_whole_lines(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(6))
    lines = [" ".join(word() for _ in range(rng.choice([3, 4, 80, 300]))) for _ in range(25)]
    long = lines[0] + " " + " ".join(word() for _ in range(90))
    texts = [long[:512] + ".", "b.\n" + long[512:] + " " + long[:512] + ".\nc", long[:512] + " other end"]
    for _ in range(80):
        s = rng.choice(lines)
        p = rng.randrange(len(s))
        texts.append(rng.choice([s, s[:p] + s[p + 1 :], s[:p] + "z" + s[p:], s[:p] + " " + s[p + 1 :], word() + s]))
    seen, want = [], Counter()
    for i, text in enumerate(texts):
        own = text.split("\n")
        kept = [u for j, u in enumerate(own) if not any(u == v or min(len(u), len(v)) >= 16 and edit_distance_1(u, v) for v in seen + own[:j])]
        seen += own
        want[(i, len(own), len(kept), "\n".join(kept))] += 1
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert Counter((r.doc_id, r.n_lines, r.n_kept, r.text) for r in LineDedup().dedup(df).collect()) == want
    assert all(n == 1 and kept == 1 or i != 2 for i, n, kept, _ in want)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 2])
def test_line_edits(spark, edits):
    rng = random.Random(edits)
    base = [" ".join(rng.choice(["alpha", "béta", "gamma", "delta", "x"]) for _ in range(rng.randrange(3, 6))) for _ in range(12)]
    lines = ["A report of the year 1998", "A report of the year 2008", "A report of the year 1989"]
    for _ in range(90):
        s = rng.choice(base)
        for _ in range(rng.randrange(edits + 3)):
            p = rng.randrange(len(s))
            s = rng.choice([s[:p] + s[p + 1 :], s[:p] + rng.choice("z ") + s[p:], s[:p] + rng.choice("Z ") + s[p + 1 :]])
        lines.append(s)
    want = [not any(u == v or min(len(u), len(v)) >= 16 and edit_distance(u, v) <= edits for v in lines[:i]) for i, u in enumerate(lines)]
    assert want[2] == (edits < 2)
    df = docs(spark, [(i, t, "s") for i, t in enumerate(lines)])
    got = LineDedup(edits=edits).dedup(df).collect()
    assert {r.doc_id: bool(r.n_kept) for r in got} == dict(enumerate(want))


def test_edits_in_long_lines(spark):
    """One edit at every kind of place of lines of 16 to 5,000 characters; with two it stays."""
    rng = random.Random(21)
    lines, want = [], []
    for n in (16, 17, 31, 150, 400, 513, 1200, 5000):
        s = "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "."
        lines.append(s)
        want.append(True)
        places = sorted({0, 1, n // 2 - 1, n // 2, n // 2 + 1, n - 2, n - 1, *(rng.randrange(n) for _ in range(8))})
        for p in places:
            for t in (s[:p] + s[p + 1 :], s[:p] + "Z" + s[p:], s[:p] + "Y" + s[p + 1 :]):
                lines.append(t)
                want.append(not any(edit_distance_1(t, v) and min(len(t), len(v)) >= 16 or t == v for v in lines[:-1]))
        q = n // 3
        lines.append("XY" + s[:q] + s[q + 2 :])
        want.append(True)
    assert sum(want) < 30
    got = LineDedup().dedup(docs(spark, [(i, t, "s") for i, t in enumerate(lines)])).collect()
    assert {r.doc_id: bool(r.n_kept) for r in got} == dict(enumerate(want))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    extra = [(700, prose(rng, 3000), "a"), (701, "Ünï’s <|endoftext|> don't\u00a0\u2003a\x85b ¿Σς? 12,5...\r\n\t", "a"), (702, "e\u0301 \u0301x İI " * 40, "b")]
    df = corpus[0].unionByName(docs(spark, extra))
    packer = Packer(capacity=512)
    tokenizer = Tokenizer.from_file(packer.tokenizer)
    want = Counter()
    for d, t, _ in corpus[1] + extra:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[(d, k // 512, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packer.pack(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    room = []  # no more sequences than best-fit decreasing
    for n in sorted((r.length for r in got), reverse=True):
        at = min((x for x in room if x >= n), default=None)
        if at is not None:
            room.remove(at)
        room.append((512 if at is None else at) - n)
    assert len(by) <= len(room)
    sequences = packer.sequences(df).collect()
    assert sum(len(p.ids) // 4 for s in sequences for p in s.parts) == sum(r.length for r in got)
    assert packer.pack(df.limit(0)).count() == 0


def test_bin_completion():
    assert complete_bins({}, 10) == []
    assert sum(t for t, _ in complete_bins({6: 2, 4: 1, 3: 2, 2: 1, 1: 2}, 10)) == 3  # 6+4, 6+3+1, 3+2+1; sizes sum to 26
    rng = random.Random(9)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 400)))
        plan = complete_bins(counts, 100)
        assert all(sum(x) <= 100 for _, x in plan)
        assert sum((Counter({n: t * x.count(n) for n in set(x)}) for t, x in plan), Counter()) == counts


def test_bin_completion_is_exhaustive():
    def fewest_of_all(items):
        best = [len(items)]

        def go(i, room):
            if len(room) >= best[0]:
                return
            if i == len(items):
                best[0] = len(room)
                return
            for r in {*room}:
                if r >= items[i]:
                    at = room.index(r)
                    go(i + 1, [*room[:at], r - items[i], *room[at + 1 :]])
            go(i + 1, [*room, 100 - items[i]])

        go(0, [])
        return best[0]

    rng = random.Random(1)
    for _ in range(2000):
        low, high = rng.choice([(1, 100), (5, 60), (20, 50), (10, 70)])
        items = sorted((rng.randrange(low, high + 1) for _ in range(rng.randrange(3, 11))), reverse=True)
        assert sum(t for t, _ in complete_bins(Counter(items), 100)) == fewest_of_all(items), items
    assert sum(t for t, _ in complete_bins(Counter([59, 57, 44, 35, 27, 26, 20, 13, 9, 8]), 100)) == 3


def test_fillings_of_many_pieces():
    rng = random.Random(10)
    for _ in range(200):
        have = Counter(rng.randrange(5, 40) for _ in range(rng.randrange(1, 14)))
        sums = {0}
        for n in have.elements():
            sums |= {x + n for x in sums}
        room = rng.randrange(40, 160)
        way = _filling(room, dict(have), sorted(have, reverse=True))
        assert sum(way) == max(x for x in sums if x <= room) and not Counter(way) - have
    assert _filling(3500, {700: 3, 690: 1, 710: 1}, [710, 700, 690]) == [710, 700, 700, 700, 690]


def test_fewest_sequences():
    # all fit without waste, in more pieces than three; the first plan alone needs more sequences for most of these
    rng, more = random.Random(11), 0
    for _ in range(40):
        counts = Counter()
        for _ in range(5):
            cuts = sorted(rng.sample(range(1, 60), rng.randrange(2, 6)))
            counts.update(b - a for a, b in zip([0, *cuts], [*cuts, 60], strict=True))
        size = lambda plan: sum(t for t, _ in plan)
        assert fewest(counts, 60) == size(complete_bins(counts, 60)) == 5
        more += size(complete_bins(counts, 60, nodes=0)) > 5
    plan = complete_bins({819: 4, 700: 10, 585: 20}, 4096)
    assert sum((Counter({n: t * x.count(n) for n in set(x)}) for t, x in plan), Counter()) == {819: 4, 700: 10, 585: 20}


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, 40).replace("w1", "Word") if good else " ".join(rng.choice(["BUY!!", "|", "$$$now", "x%%%"]) for _ in range(40))
        rows.append((i, text, "s"))
        labels.append((i, int(good), 0))
    labels += [(9999, 1, 0), (None, 1, 0), (3, None, 0)]
    df, known = docs(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Quality(sample=200).score(df, known).collect()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    truth = dict((i, q) for i, q, _ in labels if q is not None)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == held[r.doc_id] for r in got if r.doc_id in held)
    unseen = [r for r in got if held.get(r.doc_id)]
    assert len(unseen) > 100 and sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    # the same vote, by a full sort of all neighbours of each document
    model = Quality(sample=200, k=15)
    features = spark.createDataFrame([(r.doc_id, len(x[0]), *(a.tolist() for a in x)) for r in df.collect() for x in [_terms(r.text or "", Words())]], "doc_id long, n_terms int, terms array<int>, weights array<float>")
    project, near, label = model._fitted(features, known)
    want = []
    for r in df.collect():
        at, weights = _terms(r.text or "", Words())
        v = np.zeros(TERMS)
        v[at] = weights
        v = (v.astype(np.float32) @ project).astype(np.float64)
        best = sorted((-round(float(x), 7), i) for i, x in enumerate(near @ (v / max(np.linalg.norm(v), 1e-12))))[:15]
        w = [max(-x, 1e-6) ** 4 for x, _ in best]
        want.append((str(r.doc_id), sum(x * label[i] for x, (_, i) in zip(w, best, strict=True)) / sum(w) if len(at) else label.mean()))
    for (a, x), (b, y) in zip(sorted(want), sorted((str(r.doc_id), r.score) for r in got), strict=True):
        assert a == b and abs(x - y) < 2e-3
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda rs: sorted((str(r.doc_id), round(r.score, 9)) for r in rs)
    assert key(Quality(sample=200).score(df, flipped).collect()) == key(got)  # held-out labels have no part
    assert {r.score for r in Quality().score(df, known.limit(0)).collect()} == {0.5}
    assert Quality().score(df.limit(0), known).count() == 0


def test_token_counts(spark):
    words, rng = PreTokens.of(byte_bpe()), random.Random(8)
    full = lambda t: len(words.tokenizer.encode(t, add_special_tokens=False).ids)
    bits = ["can't ", "  ", "\n\n ", "x", "don", "'", "ll", "12 ", "é ", "\t", "...", " word", "<|endoftext|>", "'re"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 300)))
        tree = SegmentTree(text, words, leaf=4)
        assert tree.tokens == full(text)
        for _ in range(6):
            a = rng.randrange(-2, len(text) + 3)
            b, new = a + rng.choice([0, 0, 1, 3, 50]), "".join(rng.choice(bits) for _ in range(rng.randrange(3)))
            i = min(max(a, 0), len(text))
            text = text[:i] + new + text[min(max(b, i), len(text)) :]
            tree.edit(a, b, new)
            assert tree.text == text and tree.tokens == full(text), (a, b, new)
    # the table of trees: taken out, edited, kept again and edited once more
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 400))), "a") for i in range(30)]
    trees = build_trees(docs(spark, rows + ODD), leaf=4)
    edits, text = [], {i: t for i, t, _ in rows}
    for i in text:
        for seq in range(rng.randrange(3)):
            a = rng.randrange(len(text[i]) + 2)
            edits.append((i, seq, a, a + rng.randrange(9), rng.choice([*bits, None])))
    table = spark.createDataFrame(edits, "doc_id long, seq int, start long, end long, text string")
    state = trees
    for _ in range(2):
        for i, _, a, b, new in edits:
            text[i] = text[i][:a] + (new or "") + text[i][max(a, b) :]
        got = update_trees(with_edits(state, table), leaf=4, keep=True).collect()
        assert {r.doc_id: (r.tokens_after, r.text) for r in got if r.doc_id in text} == {i: (full(t), t) for i, t in text.items()}
        state = spark.createDataFrame([(r.doc_id, r.text, r.tokens_after, r.pre_tokens, r.leaves) for r in got], trees.schema)
    odd = update_trees(trees.where("doc_id >= 900 or doc_id is null").withColumn("edits", F.expr("array(struct(0L as start, 1L as end, 'a b' as text), null)"))).collect()
    assert len(odd) == len(ODD) and sorted((r.tokens_before, r.tokens_after) for r in odd)[0] == (0, full("a b"))
    assert build_trees(docs(spark, [])).count() == 0
    # an edit at the end of a long text costs a few leaves, not the text
    tree = SegmentTree("word and word. " * 5000, words)
    before = tree.encoded
    tree.edit(74_000, 74_003, "x")
    assert tree.encoded - before < 200 and tree.tokens == full(tree.text)


def naive_lines(rows):
    seen, out = [], []
    for i, t, s in rows:
        kept, n = [], 0
        for u in (t or "").split("\n"):
            if not re.search(WORD, u):
                kept.append((u, False))
                continue
            n += 1
            if not (u in seen or len(u) >= 16 and any(len(v) >= 16 and edit_distance_1(u, v) for v in seen)):
                kept.append((u, True))
            seen.append(u)
        if t is None or not n or any(k for _, k in kept):
            out.append((i, t if t is None else "\n".join(u for u, _ in kept), s))
    return out


def naive_near(rows, n=5):
    sets, root = [shingles(t, n) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [r for i, r in enumerate(rows) if not sets[i] or find(i) == i]


def test_pipeline(spark, corpus, tmp_path):
    """Each stage against a plain version of it; rows come in the order of doc_id, and the first of each group stays."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(30)
    rows = {i: (i, t, s) for i, t, s in corpus[1] if i is not None and i < 500}
    bad = {1000 + k: (1000 + k, " ".join(rng.choice(["BUY!!", "|", "$$$now", "x%%%"]) for _ in range(40)), "b") for k in range(60)}
    rows = [*rows.values(), *bad.values()]
    df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, int(i < 1000), 0) for i, _, _ in rows if i % 3]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    score = {r.doc_id: r.score for r in Quality().score(d, labels).collect()}
    want = sorted((r for r in rows if score[r[0]] >= 0.7), key=lambda r: r[0])
    assert not {i for i, _, _ in want} & bad.keys() and len(want) > 200
    held = []
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (lambda r: r, naive_lines, naive_near, None), strict=True):
        d = stage(spark, d, str(tmp_path)).cache()
        assert d.columns == df.columns, name
        got = [tuple(r) for r in d.select("doc_id", "text", "source").collect()]
        if plain:
            want = plain(want)
            assert Counter(got) == Counter(want), name
            held = got
    words = lambda t: re.findall(WORD, t or "")
    size, taken = Counter(), Counter()
    for _, t, s in held:
        size[s] += len(words(t))
    for _, t, s in got:
        taken[s] += len(words(t))
    names = sorted((s for s in size if s), key=str) + [None] * (None in size)
    goal = water([size[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(names, goal, strict=True))
    source = {i: words(t) for i, t, _ in held}
    assert all(Counter(words(t)) <= Counter(source[i]) for i, t, _ in got)
    encode = Tokenizer.from_file(Packer().tokenizer).encode
    lengths = Counter((i, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in got)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length) for r in out) == lengths  # all are shorter than a sequence
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)
