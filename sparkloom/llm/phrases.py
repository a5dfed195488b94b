"""Phrase collocation mining by prefix-free parsing.

A text's words, with a mark between pieces, are cut into overlapping chunks wherever the last ``longest - 1`` words trigger a
cut by their hash: equal passages are cut alike wherever they stand. The distinct chunks of a language form the
dictionary, with how often each was parsed; it is kept with numbers for words. Phrases are counted inside distinct chunks, weighted, each in the chunk
in which it starts before the overlap, so that overlaps count once. Lengths are counted one after the other: a phrase can only
be frequent if all its words and both its shorter parts are, which a bit map of fixed size tells. The map may let too much
through, never too little, so counts are exact at any size. All else is joins on (lang, phrase).

Nulls and edges: a null or empty text has no words; a null lang is ``und``; rows count one by one, equal ones too; runs of
separators make no empty pieces; texts are taken whole, a text without triggers is one chunk; no documents give no rows;
doc_id and extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, released, slices
from sparkloom.llm.shingles import mix

# fixed values: signs that end a piece
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for the end of a piece in a chunk; no word can hold it.
MARK = b"."
_TO_LINES = bytes.maketrans(ENDS, b"\n" * len(ENDS))
#: Phrase places and words that a task counts together, chunks in a block; none changes a result.
PLACES, TABLE_WORDS, BLOCK = 1_500_000, 500_000, 25_000
_BLOCKS = "lang string, names array<binary>, hashes binary, number binary, size binary, parsed binary, places long"
#: Distinct texts and their counts, many in a row: those of one task, language and bucket.
_DEALT = "bucket int, lang string, texts binary, sizes binary, counts binary"
#: Bytes of texts and places of phrases that make a bucket.
BUCKET_BYTES, BUCKET_PLACES = 8 << 20, 1_000_000
#: An odd number and its inverse modulo 2 ** 64, for hashes of stretches that don't depend on where they stand.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


def _joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from those of its words."""
    acc = np.full(len(parts[0]), len(parts), np.uint64)
    for h in parts:
        acc = mix((acc + np.uint64(_BASE)) ^ h)
    return acc


def _slices_of(raw: bytes, width: int, cuts: np.ndarray) -> pa.Array:
    """``raw`` cut into binary values, at ``cuts`` of items of ``width`` bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _dealt(lang: str, texts: pa.Array, count: np.ndarray, h: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that some of the distinct ``texts`` fall in, by their hashes."""
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    texts, bucket = texts.take(pa.array(order)), bucket[order]
    size = pc.binary_length(texts).to_numpy().astype(np.int32)
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    ends = np.r_[0, np.cumsum(size, dtype=np.int64)][cuts]
    cols = [pa.array(bucket[cuts[:-1]]), pa.array([lang] * (len(cuts) - 1), pa.string()), _slices_of(b"".join(texts.to_pylist()), 1, ends), _slices_of(size.tobytes(), 4, cuts), _slices_of(count[order].astype(np.int64).tobytes(), 8, cuts)]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "lang", "texts", "sizes", "counts"])


def _merged(batches):
    """(language, distinct texts, their sums) of each bucket; the rows of a bucket come one after the other."""

    def summed(held):
        size = np.frombuffer(b"".join(r[1] for r in held), np.int32)
        texts = _slices_of(b"".join(r[0] for r in held), 1, np.r_[0, np.cumsum(size, dtype=np.int64)])
        t = pa.table({"t": texts, "n": np.frombuffer(b"".join(r[2] for r in held), np.int64)}).group_by("t").aggregate([("n", "sum")])
        return t.column("t").combine_chunks(), t.column("n_sum").to_numpy()

    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "texts", "sizes", "counts"))):
            if row[:2] != key and held:
                yield key[1], *summed(held)
                held = []
            key = row[:2]
            held.append(row[2:])
    if held:
        yield key[1], *summed(held)


class _Powers:
    """Powers of a number modulo 2 ** 64, as many as were asked for at most."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.held):
            more = np.full(max(n, 2 * len(self.held)), self.base)
            more[0] = 1
            self.held = np.multiply.accumulate(more)
        return self.held[:n]


def _parse(overlap: int, every: int, buckets: int):
    """Chunks of texts, dealt out: words and marks, cut where ``overlap`` of them trigger it, which belong to both chunks."""

    def counted(lang: str, chunks: list[bytes]):
        t = pa.table({"c": pa.array(chunks, pa.binary())}).group_by("c").aggregate([([], "count_all")])
        distinct = t.column("c").combine_chunks()
        return _dealt(lang, distinct, t.column("count_all").to_numpy(), _hashes(distinct.to_pylist()), buckets)

    def run(batches):
        powers, inverse = _Powers(_BASE), _Powers(_INVERSE)
        held: dict[str, list[bytes]] = {}
        for whole in batches:
            for batch in slices(whole, "text", 2000):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    # bytes: only A-Z change, and words end at blanks and tabs
                    words = text.lower().translate(_TO_LINES).replace(b"\n", b" . ").split() if text else ()
                    if not words:
                        continue
                    words += [MARK] * overlap  # every place of a word starts before an overlap
                    flat = b" ".join(words)
                    raw = np.frombuffer(flat, np.uint8)
                    start = np.r_[0, np.flatnonzero(raw == 32) + 1, len(raw) + 1]
                    # the sum over a stretch, taken back to where it starts, is its hash
                    total = np.r_[np.uint64(0), np.cumsum(raw * powers.upto(len(raw)), dtype=np.uint64)]
                    first, end = start[:-overlap], start[overlap:] - 1
                    window = mix((total[end] - total[first]) * inverse.upto(len(raw))[first])
                    last = len(words) - overlap
                    cuts = np.flatnonzero(window[1:last] % np.uint64(every) == 0) + 1
                    lo = np.r_[0, cuts]
                    hi = np.r_[cuts, last] + overlap
                    chunks = held.setdefault(lang, [])
                    chunks += [flat[a:b] for a, b in zip(start[lo].tolist(), (start[hi] - 1).tolist())]
                    if len(chunks) >= 2 * BLOCK:
                        yield counted(lang, held.pop(lang))
        for lang, chunks in held.items():
            yield counted(lang, chunks)

    return run


def _numbered(batches):
    """Blocks of chunks of a language: their distinct words with hashes, and numbers in place of words; 0 is the mark."""
    for lang, chunks, parsed in _merged(batches):
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        for at in range(0, len(chunks), BLOCK):
            split = pc.split_pattern(chunks.slice(at, BLOCK), b" ")
            coded = pa.concat_arrays([pa.array([MARK], pa.binary()), split.flatten()]).dictionary_encode()
            names, size = coded.dictionary.to_pylist(), pc.list_value_length(split).to_numpy().astype(np.int32)
            number = coded.indices.to_numpy()[1:].astype(np.int32)
            row = [lang, names, (_hashes(names) ^ seed).tobytes(), number.tobytes(), size.tobytes(), parsed[at : at + BLOCK].astype(np.int64).tobytes(), len(number)]
            kinds = (pa.string(), pa.list_(pa.binary()), *[pa.binary()] * 4, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["lang", "names", "hashes", "number", "size", "parsed", "places"])


def _enough(least: int):
    """lang, phrase, f of the phrases with ``least`` or more; a row without a phrase has the sum of all."""

    def run(batches):
        for lang, phrases, f in _merged(batches):
            some = f >= least
            names = pa.concat_arrays([phrases.filter(pa.array(some)), pa.nulls(1, pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array(np.r_[f[some], f.sum()])], ["lang", "phrase", "f"])

    return run


def _counted(n: int, overlap: int, bits: int, buckets: int, frequent, shorter):
    """Dealt out: phrases of ``n`` words in chunks, weighted by how often each chunk was parsed; those that the bit maps rule out are left out."""

    def run(batches):
        allowed, parts = (b and np.frombuffer(b.value, np.uint8) for b in (frequent, shorter))
        state: dict[str, _Held] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                lang = batch.column("lang")[row].as_py()
                here, h, number, size = state.setdefault(lang, _Held(lang, buckets)), get("hashes", np.uint64), get("number", np.int32), get("size", np.int32)
                good = np.ones(len(h), bool) if allowed is None else _hit(allowed, h, bits)
                good[0] = False
                # places before the overlap; what follows them, up to n words, is in the same chunk
                own, ends = good[number], np.cumsum(size)
                for j in range(overlap):
                    own[ends - 1 - j] = False
                at, ok = np.flatnonzero(own), good[number]
                for j in range(1, n):
                    at = at[ok[at + j]]
                if parts is not None:
                    # a shorter phrase that starts at a place, and whether it may be frequent
                    begins = np.unique(np.concatenate([at, at + 1]))
                    hit = np.zeros(len(number), bool)
                    hit[begins] = _hit(parts, _joined_hash([h[number[begins + k]] for k in range(n - 1)]), bits)
                    at = at[hit[at] & hit[at + 1]]
                if len(at):
                    here.add(batch.column("names")[row].values, [number[at + j] for j in range(n)], np.repeat(get("parsed", np.int64), size)[at])
                # of all languages together
                if sum(x.places for x in state.values()) > PLACES or sum(len(x.words) for x in state.values()) > TABLE_WORDS:
                    yield from _summed(state.pop(max(state, key=lambda x: state[x].places)))
        for here in state.values():
            yield from _summed(here)

    return run


class _Held:
    """What a task holds of a language: words in their order of coming, and phrases by word numbers, not summed yet."""

    def __init__(self, lang: str, buckets: int):
        self.lang, self.buckets, self.words, self.held, self.places = lang, buckets, {}, [], 0

    def add(self, names: pa.Array, phrases: list[np.ndarray], weight: np.ndarray) -> None:
        used = np.unique(np.concatenate(phrases))
        own = np.zeros(len(names), np.int64)
        number = self.words.setdefault
        own[used] = [number(w, len(self.words)) for w in names.take(pa.array(used)).to_pylist()]
        self.held.append((np.stack([own[p] for p in phrases]), weight))
        self.places += len(weight)


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the sum of its weights)."""
    order = np.argsort(key)
    ordered = key[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order[start], np.add.reduceat(weight[order], start)


def _summed(here: _Held):
    """Distinct phrases with their sums; word numbers fold in one by one, so that no two phrases are mistaken for each other."""
    if not here.held:
        return
    number, weight = np.concatenate([x for x, _ in here.held], axis=1), np.concatenate([w for _, w in here.held])
    key = number[0]
    for j in range(1, len(number)):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key << np.int64(32) | number[j]
    first, total = _sums(key, weight)
    names = list(here.words)
    h, names = _hashes(names), pa.array(names, pa.binary())
    # some at a time, dealt out by hash: the parts of a bucket come from many tasks anyway
    for at in range(0, len(first), 500_000):
        some = [pa.array(number[j][first[at : at + 500_000]]) for j in range(len(number))]
        phrase = names.take(some[0])
        for x in some[1:]:
            phrase = pc.binary_join_element_wise(phrase, names.take(x), b" ")
        yield _dealt(here.lang, phrase, total[at : at + 500_000], _joined_hash([h[x.to_numpy()] for x in some]), here.buckets)


def _hit(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in _spots(h, bits):
        hit &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def _spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of a hash in a map of 2 ** bits."""
    return [(mix(h + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2)]


def _places(bits: int):
    def run(batches):
        for batch in batches:
            split = [p.split(b" ") for p in batch.column("phrase").to_pylist()]
            if not split:
                continue
            seed = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in batch.column("lang").to_pylist()), np.uint64, len(split))
            parts = [_hashes([p[j] for p in split]) ^ seed for j in range(len(split[0]))]
            h = parts[0] if len(parts) == 1 else _joined_hash(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_spots(h, bits)))], ["spot"])

    return run


class Phrases:
    """Parameters: words in the longest phrase, least count, percent of a count from which a longer phrase covers one, words between cuts, bits of a map (as a power of 2, its size is 16 MB)."""

    def __init__(self, longest: int = 4, least: int = 30, covered: int = 80, every: int = 16, bits: int = 27):
        if longest < 2:
            raise ValueError("a phrase has two words at least")
        self.longest, self.least, self.covered, self.every, self.bits = longest, least, covered, every, bits

    def numbered(self, docs: DataFrame) -> DataFrame:
        """The dictionary of each language: distinct chunks and how often each was parsed, in blocks with numbers for words; it is read once for each length of phrase."""
        given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
        size = given.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
        parsed = given.mapInArrow(released(_parse(self.longest - 1, self.every, buckets)), _DEALT)
        return materialize(self._met(parsed, buckets).mapInArrow(released(_numbered), _BLOCKS), "zstd")

    @staticmethod
    def _met(dealt: DataFrame, buckets: int) -> DataFrame:
        """The rows of a bucket in one task. They are summed in each task before, so a frequent text is no heavier than others."""
        return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang")

    def _map(self, spark, phrases: DataFrame):
        """The bit map of ``phrases`` on all workers: 2 ** bits bits, however many there are."""
        spots = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(_places(self.bits), "spot long")
        # Spark's bit maps hold 32,768 places from 1 on each
        rows = spots.groupBy(F.expr("bitmap_bucket_number(spot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot + 1))").alias("bits")).collect()
        out = np.zeros(max(1, (1 << self.bits) >> 3), np.uint8)
        for r in rows:
            part = np.frombuffer(r["bits"], np.uint8)
            at = (r["bucket"] - 1) * len(part)
            out[at : at + len(part)] = part[: len(out) - at]
        return spark.sparkContext.broadcast(out.tobytes())

    def _count(self, chunks: DataFrame, n: int, buckets: int, frequent=None, shorter=None) -> DataFrame:
        found = chunks.mapInArrow(released(_counted(n, self.longest - 1, self.bits, buckets, frequent, shorter)), _DEALT)
        kept = self._met(found, buckets).mapInArrow(released(_enough(self.least)), "lang string, phrase binary, f long")
        return materialize(kept.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"))

    def counts(self, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(lang, n: all word occurrences; for each length, lang, phrase, f of the frequent phrases)."""
        spark, chunks = docs.sparkSession, self.numbered(docs)
        buckets = max(1, -(-(chunks.agg(F.sum("places")).first()[0] or 0) // BUCKET_PLACES))
        words = self._count(chunks, 1, buckets)
        total = materialize(words.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n")))
        found = [words.where("phrase is not null")]
        frequent = self._map(spark, found[0])
        for n in range(2, self.longest + 1):
            shorter = self._map(spark, found[-1]) if n > 2 else None
            found.append(self._count(chunks, n, buckets, frequent, shorter).where("phrase is not null"))
        return total, found

    def score(self, docs: DataFrame) -> DataFrame:
        """lang, phrase, a, l, r, n, score: every frequent phrase that no longer one covers, by its weakest cut."""
        total, found = self.counts(docs)
        every, phrases = found[0], found[1]
        for x in found[1:-1]:
            every = every.unionByName(x)
        for x in found[2:]:
            phrases = phrases.unionByName(x)
        words = F.split("phrase", " ", -1)
        given = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
        # candidates inside a longer one; the largest count among those tells
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda k: F.array_join(F.slice("w", k, m), " "))))
        longer = given.where("size(w) > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        left = given.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (wide("_longer") * 100 < wide("a") * self.covered)).drop("_longer")
        cut = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cut = cut.withColumn("p1", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("p2", F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")).drop("w")
        cut = cut.join(every.select("lang", F.col("phrase").alias("p1"), F.col("f").alias("l")), ["lang", "p1"])
        cut = cut.join(every.select("lang", F.col("phrase").alias("p2"), F.col("f").alias("r")), ["lang", "p2"])
        cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
        weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
        return weakest.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")

    def top(self, docs: DataFrame, k: int = 2000) -> DataFrame:
        """The first ``k`` of each language, with their rank; ranked within parts of a language first, so that no task gets all its phrases."""
        order = [F.desc("score"), F.desc("a"), "phrase"]
        scored = materialize(self.score(docs)).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)
        return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """All documents: the first 2000 phrases of each language."""
    return Phrases().top(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM split, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
given AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
inner_parts AS (
    SELECT g.lang, array_to_string(g.w[i:i + s - 1], ' ') AS phrase, g.a
    FROM given g, (SELECT unnest([2, 3]) AS s), (SELECT unnest([1, 2, 3]) AS i) WHERE s < g.m AND i + s - 1 <= g.m),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT g.* FROM given g LEFT JOIN longer x USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * g.a::HUGEINT),
parts AS (
    SELECT lang, phrase, a, c AS cut, array_to_string(w[1:c], ' ') AS p1, array_to_string(w[c + 1:], ' ') AS p2
    FROM (SELECT *, unnest(range(1, m)) AS c FROM kept)),
cuts AS (
    SELECT k.*, x.f AS l, y.f AS r, (2000000 * k.a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score
    FROM parts k JOIN f x ON x.lang = k.lang AND x.phrase = k.p1 JOIN f y ON y.lang = k.lang AND y.phrase = k.p2),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
