"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of a label form one class first. Each table turns a class's vector by three rounds of random signs and a
fast Hadamard transform; the nearest signed axes name its bucket, the next nearest ones its probes. Buckets are dealt
over tasks, large ones as blocks of block pairs. In a block the cosines of all pairs are one matrix product in double
precision; a pair counts in the first table and bucket in which the two meet, so that links add up over tables. Links are summed and
a spanning forest of the block's links is passed on, never the pairs.

Labels may be of any type, as their text tells them apart. Nulls and edges: vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null
label, link with nothing; vectors of different length are never compared; rows with equal vec_id are separate rows, and
a null vec_id counts as larger than all others (component_id null if it is the smallest one); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import components, materialize
from sparkloom.llm.near_dedup import NO_ID, _binary, _runs
from sparkloom.llm.shingles import mix

#: Names of large buckets are broadcast up to this count (8 MB).
BROADCAST_BUCKETS = 500_000


def _packed(v: np.ndarray) -> bytes:
    """A vector's bytes, single precision if that loses nothing; the first byte tells the size of a number."""
    low = v.astype(np.float32)
    return b"\x04" + low.tobytes() if (low == v).all() else b"\x08" + v.tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    """Vectors of one length, in double precision."""
    if len({(r[0], len(r)) for r in rows}) == 1:
        kind = np.float32 if rows[0][0] == 4 else np.float64
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        return np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if r[0] == 4 else np.float64, offset=1).astype(np.float64) for r in rows])


def _size(row: bytes) -> int:
    return (len(row) - 1) // row[0]


def _valid(batches):
    """Digest and bytes of each usable vector; nulls for the others."""
    import xxhash

    for batch in batches:
        out = []
        for e, label in zip(batch.column("embedding"), batch.column("label"), strict=True):
            v = e.as_py()
            if v and label.is_valid and all(x is not None for x in v):
                a = np.array(v, np.float64) + 0.0  # no negative zero
                if np.isfinite(a).all() and np.isfinite(n := np.linalg.norm(a)) and n > 0:
                    out.append((*np.frombuffer(xxhash.xxh3_128_digest(a.tobytes()), np.int64).tolist(), _packed(a)))
                    continue
            out.append((None, None, None))
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("label"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["d", "label", "h", "h2", "v"])


def _turned(v: np.ndarray, seed: int, least: int = 2) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, over vectors padded to a power of two and to ``least`` axes."""
    size = 1 << (max(least, v.shape[1], 2) - 1).bit_length()
    x = np.zeros((len(v), size))
    x[:, : v.shape[1]] = v
    for r in range(3):
        signs = mix(np.arange(size, dtype=np.uint64) + np.uint64((seed * 3 + r + 1) << 32)) & np.uint64(1)
        x *= np.where(signs == 1, 1.0, -1.0)
        half = 1
        while half < size:
            y = x.reshape(len(v), -1, 2, half)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(v), size)
            half *= 2
    return x


def _codes(v: np.ndarray, tables: int, k: int, probes: int) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes): the nearest axes, then for each probe one axis replaced by its next."""
    out = np.empty((len(v), tables, 1 + probes), np.uint32)
    for t in range(tables):
        axes = []
        for j in range(k):
            x = _turned(v, t * k + j, 1 + probes)
            top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, : 1 + probes]
            axes.append(2 * top + (np.take_along_axis(x, top, 1) < 0))
        base = 2 * x.shape[1]
        code = lambda picked: sum(a.astype(np.uint64) * np.uint64(base**j) for j, a in enumerate(picked)) % np.uint64(2**32 - 5)
        out[:, t, 0] = code([a[:, 0] for a in axes])
        for p in range(probes):
            out[:, t, 1 + p] = code([a[:, 1 + p // k] if j == p % k else a[:, 0] for j, a in enumerate(axes)])
    return out


def _buckets(tables: int, k: int, probes: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw = batch.column("v").to_pylist()
                for dim in sorted({_size(x) for x in raw}):
                    rows = np.array([i for i, x in enumerate(raw) if _size(x) == dim])
                    v = _unpacked([raw[i] for i in rows])
                    codes = _codes(v, tables, k, probes)
                    label = batch.column("label").to_numpy()[rows].astype(np.uint64)
                    own = mix(mix(label + np.uint64(dim)) + np.uint64(1))
                    t = np.arange(tables, dtype=np.uint64)[None, :, None]
                    bucket = mix(own[:, None, None] ^ mix((t << np.uint64(32)) + codes.astype(np.uint64)))
                    bucket, which = bucket.reshape(-1), np.repeat(np.arange(len(rows)), tables * (1 + probes))
                    code = codes.reshape(-1).astype(np.int64)
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(rows))
                    take = pa.array(rows[which])
                    packed = _binary(codes.reshape(len(rows), -1)).take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(table), pa.array(code), *(batch.column(c).take(take) for c in ("d", "h", "n", "v")), packed], ["bucket", "table", "code", "d", "h", "n", "v", "codes"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for a in (root[i], root[j], i, j):
            np.minimum.at(new, a, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(least: float, width: int):
    """Sums of links first met here and the smallest connected class, for each class of a cell that has links."""

    def run(batches):
        for t in _runs(batches, "cell"):
            cell = t.column("cell").to_numpy()
            for rows in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(cell)) + 1):
                if len(rows) < 2:
                    continue
                s = t.slice(rows[0], len(rows))
                v = _unpacked(s.column("v").to_pylist())
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                side, n, table = s.column("side").to_numpy(), s.column("n").to_numpy(), s.column("table")[0].as_py()
                code = s.column("code")[0].as_py()
                codes = np.frombuffer(b"".join(s.column("codes").to_pylist()), np.uint32).reshape(len(rows), -1, width)
                near = v @ v.T >= least
                np.fill_diagonal(near, False)
                if (side != side[0]).any():
                    near &= side[:, None] != side[None, :]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                new = np.ones(len(i), bool)
                for part in np.array_split(np.arange(len(i)), max(1, len(i) // 200_000)):
                    for u in range(table + 1):  # in an earlier table, or in a lesser bucket of this one
                        a, b = codes[i[part], u], codes[j[part], u]
                        met = a[:, :, None] == b[:, None, :]
                        if u == table:
                            met &= (a < code)[:, :, None]
                        new[part] &= ~met.any(axis=(1, 2))
                links = np.bincount(i[new], weights=n[j[new]], minlength=len(rows)).astype(np.int64)
                root, d, h = _forest(i, j, len(rows)), s.column("d").to_numpy(), s.column("h").to_numpy()
                some = np.unique(i)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[some], h[some], links[some], d[root[some]], h[root[some]])], ["d", "h", "links", "rd", "rh"])

    return run


class EmbeddingDedup:
    """Parameters: cosine, tables, probes, classes in a block. The axes in a bucket's name grow with the logarithm of the classes."""

    def __init__(self, cosine: float = 0.93, tables: int = 10, probes: int = 2, block: int = 1000):
        self.cosine, self.tables, self.probes, self.block = cosine, tables, probes, block

    def classify(self, vectors: DataFrame) -> DataFrame:
        """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
        given = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("d"), F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = materialize(given.mapInArrow(_valid, "d long, label long, h long, h2 long, v binary"))
        classes = rows.where("h is not null").groupBy("label", "h", "h2").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        # a class's name: smallest vec_id and a digest of label and vector
        classes = materialize(classes.withColumn("k", F.xxhash64("label", "h", "h2")))
        axes = max(1, 1 + round(math.log(max(1, classes.count()) / 100_000) / math.log(128)))
        tables = self.tables * 2 ** (axes - 1)
        dealt = classes.select("label", "d", F.col("k").alias("h"), "n", "v").mapInArrow(_buckets(tables, axes, self.probes), "bucket long, table int, code long, d long, h long, n long, v binary, codes binary")
        dealt = materialize(dealt)
        sizes = materialize(dealt.groupBy("bucket").count().where("count > 1"))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
        parts = F.greatest(F.lit(1), F.ceil(F.col("count") / self.block)).cast("int")
        dealt = dealt.join(sizes, "bucket").withColumn("q", parts).withColumn("side", F.pmod(F.xxhash64("d", "h"), F.col("q")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        cell = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
        cells = dealt.select(cell.alias("cell"), "table", "code", "d", "h", "n", "v", "codes", "side")
        found = cells.repartition("cell").sortWithinPartitions("cell", "d", "h").mapInArrow(_linked(self.cosine, 1 + self.probes), "d long, h long, links long, rd long, rh long")
        found = materialize(found)
        me, root = F.struct("d", "h"), F.struct(F.col("rd").alias("d"), F.col("rh").alias("h"))
        comps = components(found.select(me.alias("a"), root.alias("b"))).select("node", F.col("component.d").alias("c"))
        links = found.groupBy("d", "h").agg(F.sum("links").alias("links"))
        named = classes.select("label", "h", "h2", "d", "n", F.struct("d", F.col("k").alias("h")).alias("node")).join(comps, "node", "left")
        named = named.join(links.select(me.alias("node"), "links"), "node", "left")
        named = named.select("label", "h", "h2", F.coalesce("c", "d").alias("c"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        out = rows.where("h is not null").select("d", "label", "h", "h2").join(named, ["label", "h", "h2"]).select("d", "n_links", "c")
        out = out.unionByName(rows.where("h is null").select("d", F.lit(0).cast("long").alias("n_links"), F.col("d").alias("c")))
        real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
        return out.select(real("d").alias("vec_id"), "n_links", real("c").alias("component_id"), F.coalesce(F.col("d") == F.col("c"), F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors, cosine 0.93, within labels."""
    return EmbeddingDedup().classify(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
