"""MinHash near-dedup: a chosen-path set similarity join.

Texts with equal shingle sets form one class first, so exact copies never meet each other. Each of ``trees``
independent trees starts with all classes at its root; a node picks one coordinate of the minwise signature, and a
second one in a quarter of the cases (1 / 0.8 children expected), and sends each class to the child named by the
minwise token there. The first ``depth`` levels are taken at once; nodes that then hold more than ``small`` classes
branch again. Small nodes are compared exhaustively on 64-byte sketches: each class's candidate is the smaller one that it is
most like. A node that no branching splits holds near copies: its smallest class is a candidate for all its members.
Candidates are confirmed on the full sets, confirmed links give components, and then the components that share a node are compared with the node's main one and each other on full sets, in
blocks. So no pair that shares a node is left out, but pairs inside one component need not be made.

Nulls and edges: null and white-space-only texts have no shingles and link with nothing; rows with an equal doc_id
are separate rows; a null doc_id counts as larger than all others and its component_id is the smallest one reached (null if none).
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, components, materialize, released, row_keys, slices
from sparkloom.llm.shingles import WordHashes, mix, shingle_set, signature

COORDINATES = 64
#: Large nodes are broadcast by their 8-byte names up to this many (16 MB), else joined by a shuffle.
BROADCAST_PATHS = 1_000_000
#: Rows of equal shingles from which on their class is broadcast, under the same bound.
HOT_CLASS = 200
#: So are main components of nodes, by 32 bytes each.
BROADCAST_MAINS = 500_000
NO_ID = np.iinfo(np.int64).max
_FEATURES = "d long, n_shingles long, h1 long, h2 long, sig binary"
_LINKS = "xd long, xh long, yd long, yh long"
_PATHS = "path long, d long, h long, sk binary"


def _constants() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:COORDINATES] | np.uint64(1), x[COORDINATES:]


def _features(size: int):
    def run(batches):
        import xxhash

        hashes, (mul, add) = WordHashes(), _constants()
        for whole in batches:
            for batch in slices(whole, "text", 2000):
                n, h1, h2, sig = [], [], [], []
                for text in batch.column("text"):
                    s = shingle_set(text.as_py(), size, hashes)
                    n.append(len(s))
                    if len(s):
                        digest = xxhash.xxh3_128_digest(s.tobytes())
                        a, b = np.frombuffer(digest, np.int64)
                        h1.append(int(a)), h2.append(int(b)), sig.append(signature(s, mul, add).tobytes())
                    else:
                        h1.append(None), h2.append(None), sig.append(None)
                keys = [c for c in batch.schema.names if c not in ("d", "text")]
                made = [batch.column("d"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), *[batch.column(c) for c in keys]]
                yield pa.RecordBatch.from_arrays(made, ["d", "n_shingles", "h1", "h2", "sig", *keys])

    return run


def _table(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    at = (np.arange(len(rows) + 1, dtype=np.int64) * (raw.shape[1] if len(rows) else 0)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def _branch(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (rows, child paths)."""
    draw = mix(path + np.uint64(0x51))
    first = (draw % np.uint64(COORDINATES)).astype(np.int64)
    second = ((draw >> np.uint64(16)) % np.uint64(COORDINATES)).astype(np.int64)
    at = np.arange(len(path))
    two = at[((draw >> np.uint64(40)) & np.uint64(3)) == 0]
    rows, coordinate = np.concatenate([at, two]), np.concatenate([first, second[two]])
    child = mix(path[rows] ^ mix(np.uint64(0xA5) + (coordinate.astype(np.uint64) << np.uint64(40)) + sig[rows, coordinate].astype(np.uint64)))
    return rows, child


def _root_paths(trees: int, depth: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if not batch.num_rows:
                    continue
                sig = _table(batch.column("sig"), np.uint32, COORDINATES)
                m = batch.num_rows
                path, rows = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64)), m), np.tile(np.arange(m), trees)
                for _ in range(depth):
                    keep, path = _branch(path, sig[rows])
                    rows = rows[keep]
                yield _path_batch(path, rows, batch, _binary(sig.astype(np.uint8)))

    return run


def _path_batch(path, rows, batch, sketches) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("d").take(take), batch.column("h").take(take), sketches.take(take)], ["path", "d", "h", "sk"])


def _more_paths(levels: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = _table(batch.column("sk"), np.uint8, COORDINATES)
            path, rows = batch.column("path").to_numpy().view(np.uint64), np.arange(batch.num_rows)
            for _ in range(levels):
                keep, path = _branch(path, sk[rows])
                rows = rows[keep]
            yield _path_batch(path, rows, batch, batch.column("sk"))

    return run


def _runs(batches, key: str):
    """Batches cut so that equal keys, which are sorted, stay together; the caller bounds how many there can be."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if not t.num_rows:
            continue
        t = t.to_batches()[0]
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _compare(cut: int):
    """Within each path: for each class that is like another one, the smaller class that it is most like, and how much."""

    def run(batches):
        for t in _runs(batches, "path"):
            path, sk, n = t.column("path").to_numpy(), _table(t.column("sk"), np.uint8, COORDINATES), t.num_rows
            mate, best, flagged = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
            at = np.arange(n)
            for k in range(1, n):
                at = at[at < n - k]
                at = at[path[at] == path[at + k]]
                if not len(at):
                    break
                for part in np.array_split(at, max(1, len(at) // 20_000)):
                    same = (sk[part] == sk[part + k]).sum(axis=1)
                    like = part[same >= cut]
                    flagged[like] = flagged[like + k] = True
                    more = same[same >= cut] >= best[like + k]
                    mate[like[more] + k], best[like[more] + k] = like[more], same[same >= cut][more]
            rows, d, h = np.flatnonzero(flagged), t.column("d").to_numpy(), t.column("h").to_numpy()
            m = mate[rows]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (path[rows], d[rows], h[rows], d[m], h[m], best[rows])], ["path", "d", "h", "yd", "yh", "same"])

    return run


def _intersections(sets: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the probes with all sets: products of incidence matrices, some columns at a time."""
    names, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = often > 1  # a shingle of one set only is in no intersection but its own
    place = np.cumsum(shared) - 1
    keep = shared[ids]
    owner, column = owner[keep], place[ids[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(probes), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[i:j], column[i:j] - at] = 1
        some = np.flatnonzero(m[probes].any(axis=1))
        used = np.flatnonzero(m[probes[some]].any(axis=0))
        if len(some):
            both[some] += m[np.ix_(probes[some], used)] @ m[:, used].T
    return both.astype(np.int64)


def _cross(percent: int):
    """Within each block: links of one of the lesser components' classes with a class of another component.

    Intersections of a class with all others of the block are counted at once on full sets; of the links found,
    a spanning forest over the components is given.
    """

    def run(batches):
        for t in _runs(batches, "block"):
            block, lesser = t.column("block").to_numpy(), np.asarray(t.column("lesser"))
            d, h, ld, lh = (t.column(c).to_numpy() for c in ("d", "h", "ld", "lh"))
            for rows in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(block)) + 1):
                sets = [np.frombuffer(t.column("words")[i].as_py(), np.uint64) for i in rows]
                size = np.array([len(s) for s in sets])
                probes = np.flatnonzero(lesser[rows])
                both = _intersections(sets, probes)
                _, label = np.unique(np.stack([ld[rows], lh[rows]]), axis=1, return_inverse=True)
                label, found = label.ravel(), []
                for i, shared in zip(probes, both, strict=True):
                    for j in np.flatnonzero((100 * shared >= percent * (size + size[i] - shared)) & (label != label[i])):
                        if label[j] != label[i]:
                            found.append((rows[i], rows[j]))
                            label[label == label[j]] = label[i]
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[i], h[i], d[j], h[j])], ["xd", "xh", "yd", "yh"])

    return run


def _sets(size: int):
    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in (b for whole in batches for b in slices(whole, "text", 2000)):
            out = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size, hashes)
                out.append((int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]), s.tobytes()) if len(s) else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["d", "h", "words"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    s = np.concatenate([a, b])
                    s.sort(kind="stable")  # two sorted runs: a merge
                    both = int((s[1:] == s[:-1]).sum())
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("xd", "xh", "yd", "yh")], ["xd", "xh", "yd", "yh"])

    return run


class NearDedup:
    """Parameters: words in a shingle, similarity in percent, trees, levels taken at once, classes in a small node."""

    def __init__(self, words: int = 5, percent: int = 80, trees: int = 12, depth: int = 3, more: tuple[int, ...] = (2, 2), small: int = 64, block: int = 500):
        self.words, self.percent, self.trees, self.depth, self.more, self.small, self.block = words, percent, trees, depth, more, small, block
        p = percent / 100
        #: Equal sketch bytes that a pair at the bound falls short of about once in 30,000 times.
        self.cut = max(1, int(COORDINATES * p - 4.2 * (COORDINATES * p * (1 - p)) ** 0.5))

    def links(self, docs: DataFrame, keys: bool = False) -> tuple[DataFrame, DataFrame]:
        """(features of all rows, with ``keys`` their digests too, component of every linked class); classes are structs of smallest doc_id and digest."""
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.col("text").cast("string").alias("text"))
        rows = materialize(texts.select("*", *(row_keys() if keys else [])).mapInArrow(released(_features(self.words)), _FEATURES + ", k1 long, k2 long" * keys))
        classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("d").alias("d"), F.first("sig").alias("sig")).select("d", F.col("h1").alias("h"), "sig")
        paths = materialize(classes.mapInArrow(released(_root_paths(self.trees, self.depth)), _PATHS))
        found, dense = [], None
        for levels in (*self.more, 0):
            big = paths.groupBy("path").count().where(F.col("count") > self.small).select("path")
            big = materialize(big)
            big = F.broadcast(big) if big.count() <= BROADCAST_PATHS else big
            leaves = paths.join(big, "path", "left_anti")
            found.append(materialize(leaves.repartition("path").sortWithinPartitions("path", "d", "h").mapInArrow(released(_compare(self.cut)), "path long, d long, h long, yd long, yh long, same long")))
            paths = paths.join(big, "path", "left_semi")
            if big.isEmpty():
                break
            if levels:
                paths = materialize(paths.mapInArrow(released(_more_paths(levels)), _PATHS))
            else:
                dense = materialize(paths.select("path", "d", "h"))
        leaf = found[0]
        for x in found[1:]:
            leaf = leaf.unionByName(x)
        x, y, me = F.struct(F.col("d").alias("d"), F.col("h").alias("h")), F.struct(F.col("yd").alias("d"), F.col("yh").alias("h")), F.struct("d", "h")
        nearest = leaf.where("same > 0").groupBy("d", "h").agg(F.max_by(y, F.struct("same", -F.col("yd"), "yh")).alias("y"))
        pairs, members = nearest.select(x.alias("x"), "y"), leaf.select("path", "d", "h")
        if dense is not None:
            first = dense.groupBy("path").agg(F.min(me).alias("y"))
            led = dense.join(first, "path").groupBy("d", "h").agg(F.min("y").alias("y"))
            pairs = pairs.unionByName(led.select(x.alias("x"), "y").where("x <> y"))
            members = members.unionByName(dense)
        pairs = materialize(pairs.distinct().select("x.*", "y").select(F.col("d").alias("xd"), F.col("h").alias("xh"), F.col("y.d").alias("yd"), F.col("y.h").alias("yh")))
        sets = self._sets(members, texts)
        links = materialize(self._confirmed(pairs, sets))
        first_round = components(_edges(links))
        labelled = materialize(members.select("path", me.alias("node")).join(first_round, "node", "left").select("path", "node", F.coalesce("component", "node").alias("label")))
        size = labelled.select("node", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        groups = labelled.groupBy("path", "label").count().join(size, "label")
        mixed = groups.groupBy("path").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        mixed = mixed.where("labels > 1").select("path", "main")
        near = materialize(groups.select("path", "label").join(mixed, "path").where("label <> main").select("main", "label").distinct())
        if near.isEmpty():
            return rows, first_round
        more = materialize(self._crossed(near, labelled.select("node", "label").distinct(), sets))
        return rows, first_round if more.isEmpty() else components(_edges(links.unionByName(more)))

    def _crossed(self, near: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Links across components that share a node; rows are dealt to blocks of bounded size around the main component."""
        mains = near.select("main").distinct().select("main", F.col("main").alias("label"), F.lit(False).alias("lesser"))
        n = nodes.join(mains.unionByName(near.withColumn("lesser", F.lit(True))), "label")
        size = n.groupBy("main").agg(F.sum(F.col("lesser").cast("long")).alias("few"), F.count(F.lit(1)).alias("all"))
        parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / self.block)).cast("int")
        spot = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        size = materialize(size)
        size = F.broadcast(size) if size.count() <= BROADCAST_MAINS else size  # else rows of a large main meet in one task
        n = n.join(size, "main").withColumn("p", parts("few")).withColumn("q", parts("all"))
        own = n.where("lesser").withColumn("i", spot("p")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        others = n.withColumn("j", spot("q")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("lesser", F.lit(False))
        cells = own.unionByName(others).select(F.xxhash64("main", "i", "j").alias("block"), F.col("node.d").alias("d"), F.col("node.h").alias("h"), F.col("label.d").alias("ld"), F.col("label.h").alias("lh"), "lesser")
        cells = cells.join(sets, ["d", "h"])
        return cells.repartition("block").sortWithinPartitions("block").mapInArrow(released(_cross(self.percent)), _LINKS)

    def _sets(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """The full shingle sets, made again, of the classes that are like another one."""
        wanted = members.select("d").distinct()
        sets = texts.join(wanted, "d", "left_semi").mapInArrow(released(_sets(self.words)), "d long, h long, words binary").where("h is not null")
        return materialize(sets.groupBy("d", "h").agg(F.first("words").alias("words")))

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full shingle sets are alike enough."""
        both = pairs.join(sets.select(F.col("d").alias("xd"), F.col("h").alias("xh"), F.col("words").alias("xs")), ["xd", "xh"])
        both = both.join(sets.select(F.col("d").alias("yd"), F.col("h").alias("yh"), F.col("words").alias("ys")), ["yd", "yh"])
        return both.select("xd", "xh", "yd", "yh", "xs", "ys").mapInArrow(released(_confirm(self.percent)), _LINKS)

    def classify(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row for each row of ``docs``."""
        rows, comps = self.links(docs)
        out = _joined(rows, _named(rows, comps)).select("d", "n_shingles", F.col("c.d").alias("c"))
        out = out.unionByName(rows.where("h1 is null").select("d", "n_shingles", F.col("d").alias("c")))
        real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
        return out.select(real("d").alias("doc_id"), "n_shingles", real("c").alias("component_id"), F.coalesce(F.col("d") == F.col("c"), F.lit(False)).alias("kept"))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.struct(F.col("xd").alias("d"), F.col("xh").alias("h")).alias("a"), F.struct(F.col("yd").alias("d"), F.col("yh").alias("h")).alias("b"))


def _named(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """h1, h2, n (rows), c: the component of each class, its own node if it is linked with nothing."""
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"))
    named = classes.select("h1", "h2", "n", F.struct("d", F.col("h1").alias("h")).alias("node")).join(comps, "node", "left")
    return named.select("h1", "h2", "n", F.coalesce("component", "node").alias("c"))


def _joined(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows that have shingles, with c of their class. Classes of many copies are broadcast, so that no task gets all rows of one; the others are joined by a shuffle."""
    named = materialize(named)
    hot = named.where(F.col("n") >= HOT_CLASS)
    most = hot.count()
    rows, plain = rows.where("h1 is not null"), named.select("h1", "h2", "c")
    if not 0 < most <= BROADCAST_PATHS:
        return rows.join(plain, ["h1", "h2"])
    few = F.broadcast(hot.select("h1", "h2", "c"))
    return rows.join(few, ["h1", "h2"]).unionByName(rows.join(few.select("h1", "h2"), ["h1", "h2"], "left_anti").join(plain, ["h1", "h2"]))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each group of near copies, the smallest doc_id's (of equal rows, one); all rows whose text has no words stay."""
    some = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    bare, docs = docs.where(~some), docs.where(some)
    rows, comps = NearDedup(**parameters).links(docs, keys=True)
    first = _joined(rows, _named(rows, comps)).groupBy("c").agg(F.min(F.struct("d", "k1", "k2")).alias("k")).select("k.*")
    kept = first.toDF("_kept", "_kept1", "_kept2")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), d, *row_keys())
    keyed = keyed.join(kept, (F.col("d") == F.col("_kept")) & (F.col("k1") == F.col("_kept1")) & (F.col("k2") == F.col("_kept2")), "left_semi")
    # of rows that repeat one stays, with its own extra columns: the least by a hash of them
    hashed = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    return bare.unionByName(keyed.groupBy("d", "k1", "k2").agg(F.min_by("row", hashed).alias("row")).select("row.*"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, 80 percent."""
    return NearDedup(words=2, percent=80).classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
