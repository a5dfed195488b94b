"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words in lower case, hashed to half of ``TERMS`` places, and in the other half the shapes of its words (letters by case,
digits, other signs as they are, runs as one), pairs of shapes in a row, and how many words repeat one of the four before. Document frequencies
count all documents. The vectors of a bounded sample of labelled documents span the latent space (singular vectors of their weighted
terms); they are broadcast, at most ``sample`` times ``rank`` numbers. Every document's cosine with every one of them is computed, in blocks, and the
``k`` nearest vote, weighted by similarity. Ties, of cosines rounded to nine digits, go to the document that comes first in the sample, which is in the
order of a hash of doc_id.

Labels are learnt only from documents whose crc32(doc_id as text) mod 4 is not 2; labels of one doc_id that disagree count by their mean.
Nulls and edges: a text without words, null ones too, gets the share of label 1 in the sample; without any labels the score is 0.5; null doc_id: held_out is
false and it is never learnt from; rows that repeat are all scored; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, released, row_keys, slices

TERMS = 2048
HALF = TERMS // 2
CACHE_WORDS = 200_000


def shape(word: str) -> str:
    out = ""
    for c in word:
        kind = "U" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != kind:
            out += kind
    return out


class Words(dict):
    """For each word 32 bits of its shape's hash, and above them 32 of its own; the table starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        low = xxhash.xxh32_intdigest(shape(word).encode("utf-8", "surrogatepass"))
        self[word] = value = low | xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) << 32
        return value


def _terms(text: str, table: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (square roots of frequencies) of a text's terms."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    s, w = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    again = np.zeros(len(both), bool)
    for k in range(1, 5):
        again[k:] |= both[k:] == both[:-k]
    pair = s[1:] * np.uint64(0x9E3779B97F4A7C15) ^ s[:-1]
    place = np.concatenate([s % np.uint64(HALF - 1), (pair ^ (pair >> np.uint64(32))) % np.uint64(HALF - 1), w % np.uint64(HALF) + np.uint64(HALF)])
    count = np.bincount(place.astype(np.int64), minlength=TERMS)
    count[HALF - 1] = 2 * again.sum()
    at = np.flatnonzero(count)
    return at.astype(np.int32), np.sqrt(count[at] / len(words)).astype(np.float32)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def _features(batches):
    table = Words()
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [_terms(t or "", table) for t in batch.column("text").to_pylist()]
            made = [pa.array([len(a) for a, _ in found], pa.int32()), _lists([a for a, _ in found], pa.int32()), _lists([v for _, v in found], pa.float32())]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "n_terms", "terms", "weights"])


def _dense(terms: pa.Array, weights: pa.Array) -> np.ndarray:
    size = np.diff(terms.offsets.to_numpy())
    out = np.zeros((len(size), TERMS), np.float32)
    out[np.repeat(np.arange(len(size)), size), terms.flatten().to_numpy()] = weights.flatten().to_numpy()
    return out


def _leading(square: np.ndarray, rank: int, rounds: int = 40) -> np.ndarray:
    """The ``rank`` leading eigenvectors of a symmetric matrix by subspace iteration, in little memory."""
    q = np.cos(np.outer(np.arange(len(square)) + 1, np.arange(rank + 16) * 7 + 3))  # any start that is no special one
    for _ in range(rounds):
        q, _ = np.linalg.qr(square @ q)
    value, inner = np.linalg.eigh(q.T @ square @ q)
    return (q @ inner)[:, ::-1][:, :rank]


class Quality:
    """Parameters: labelled documents sampled at most, rank of the latent space, neighbours, threshold."""

    def __init__(self, sample: int = 6000, rank: int = 48, k: int = 15, threshold: float = 0.7, block: int = 200):
        self.sample, self.rank, self.k, self.threshold, self.block = sample, rank, k, threshold, block

    def _fitted(self, features: DataFrame, labels: DataFrame):
        """(projection of weighted terms, unit vectors of the sample, their labels)."""
        n = features.count()
        idf = np.zeros(TERMS, np.float32)
        for term, df in features.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # TERMS rows at most
            idf[term] = np.log((1 + n) / (1 + df)) + 0.2
        learn = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
        learn = learn.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        # the sample's ids come from narrow rows; only their terms are then looked up
        order = [F.xxhash64("doc_id"), "doc_id"]
        ids = features.where("n_terms > 0").select("doc_id").join(learn, "doc_id").distinct().orderBy(*order).limit(self.sample)
        rows = features.where("n_terms > 0").join(F.broadcast(ids), "doc_id").orderBy(*order, F.xxhash64("terms", "weights")).limit(self.sample)
        t = rows.select("terms", "weights", "quality").toArrow().combine_chunks()
        if not t.num_rows:
            return idf[:, None] * 0, np.zeros((0, 1), np.float32), np.zeros(0)
        b = t.to_batches()[0]
        parts = [b.slice(at, self.block) for at in range(0, b.num_rows, self.block)]
        dense = lambda p: _dense(p.column("terms"), p.column("weights")) * idf
        square = np.zeros((TERMS, TERMS))
        for p in parts:
            x = dense(p)
            square += x.T @ x
        basis = _leading(square, self.rank)
        project = (idf[:, None] * basis).astype(np.float32)
        near = [_unit((dense(p) @ basis.astype(np.float32)).astype(np.float64)) for p in parts]
        return project, np.concatenate(near), b.column("quality").to_numpy()

    def scored(self, docs: DataFrame, labels: DataFrame, keys: list | None = None) -> tuple[DataFrame, bool]:
        """(doc_id, the long columns ``keys``, score; whether there were labels to fit on)."""
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(keys or []), F.col("text").cast("string").alias("text"))
        names = ", ".join(f"{c} long" for c in given.columns[:-1])
        features = materialize(given.mapInArrow(released(_features), f"{names}, n_terms int, terms array<int>, weights array<float>"))
        fitted = self._fitted(features, labels)
        model = docs.sparkSession.sparkContext.broadcast(fitted)
        return features.mapInArrow(released(_voted(model, self.k, self.block)), f"{names}, score double"), len(fitted[2]) > 0

    def score(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
        scored, _ = self.scored(docs, labels)
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
        return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= self.threshold, 1).otherwise(0).alias("predicted"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _voted(model, k: int, block: int):
    def run(batches):
        project, known, label = model.value
        first = np.arange(len(label)) * (5e-10 / max(1, len(label)))
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                x = _dense(b.column("terms"), b.column("weights"))
                score = np.full(len(x), float(label.mean()) if len(label) else 0.5)
                some = np.flatnonzero(x.any(axis=1))
                if len(label) and len(some):
                    cosine = np.round(_unit((x[some] @ project).astype(np.float64)) @ known.T, 9)
                    # a tie goes to the first: the sample's order in less than the ninth digit
                    near = np.argpartition(-cosine + first, min(k, len(label)) - 1, axis=1)[:, :k]
                    weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
                    score[some] = (weight * label[near]).sum(axis=1) / weight.sum(axis=1)
                kept = b.schema.names[:-3]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(np.clip(score, 0, 1))], [*kept, "score"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows (by doc_id and text) whose score is under the threshold; without labels to fit on, all of them."""
    model = Quality(**parameters)
    scored, fitted = model.scored(docs, labels, row_keys())
    if not fitted:
        return docs
    rejected = scored.where(F.col("score") < model.threshold).select("doc_id", "k1", "k2").distinct().toDF("d", "r1", "r2")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *row_keys())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
    return keyed.join(rejected, same, "left_anti").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, by labels.quality."""
    return Quality().score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
