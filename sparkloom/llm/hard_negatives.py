"""Hard-negative mining by exact integer scores, looked up in Four-Russians tables.

Vectors become integers, floor(scale * x). A candidate is packed into bit planes: bit b of eight neighbouring dimensions is one
byte, in two's complement, with as many planes as the largest component needs. An anchor has for each group of eight dimensions a table of its
256 subset sums. Then a candidate's product with it is, from the top plane down, twice what there is plus
the sums that the plane's bytes look up; the top plane counts negative. No candidate is left out.

Anchors are dealt into blocks, candidates into groups; each block meets each group in a cell, whose task streams the
group's candidates in the order of their ids and keeps, for each anchor, the best so far. A first round finds the positives, a second one
the negatives within each positive's range; what the cells found is ranked once more. A cell gives at most ``positives`` rows an
anchor, ``negatives`` rows a positive.

Nulls and edges: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of another length than
the anchor's are not scored against it; an empty vector scores 0; equal vec_ids are rows of their own, each an anchor if the id asks
for it; a null vec_id is no anchor and comes last among ties; a score that may pass 62 bits is an error, as is a component beyond
53. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize
from sparkloom.llm.near_dedup import NO_ID

_ROW = "id long, seq long, label long, dim int, planes int, bound double, v binary, bits binary"
_CELL = ["anchor", "id", "seq", "label", "dim", "planes", "v", "bits"]
#: Candidates scored at a time: with 512 anchors, 8 MB of scores.
SLICE = 2048


def _packed(scale: int):
    """The usable rows: integers of the vector, and their bit planes (plane by plane, a byte for each eight dimensions)."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("at", "dim", "planes", "bound", "v", "bits")}
            for at, x in enumerate(batch.column("vector")):
                x = x.as_py()
                if x is None or any(c is None for c in x):
                    continue
                a = np.array(x, np.float64)
                if not np.isfinite(a).all():
                    continue
                a = np.floor(scale * a)
                if len(a) and np.abs(a).max() >= 2.0**53:
                    raise ValueError("a component has more than 53 bits")
                q = a.astype(np.int64)
                planes = 1 + max((int(q.max()).bit_length(), int(~q.min()).bit_length() if q.min() < 0 else 0)) if len(q) else 1
                padded = np.zeros(-(-len(q) // 8) * 8, np.int64)
                padded[: len(q)] = q
                bits = (padded[None, :] >> np.arange(planes)[:, None] & 1).astype(np.uint8)
                for k, x in zip(out, (at, len(q), planes, float(np.sqrt((a * a).sum())), q.tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes()), strict=True):
                    out[k].append(x)
            take = pa.array(out["at"], pa.int64())
            made = [pa.array(out[k], t) for k, t in (("dim", pa.int32()), ("planes", pa.int32()), ("bound", pa.float64()), ("v", pa.binary()), ("bits", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "seq", "label")), *made], ["id", "seq", "label", "dim", "planes", "bound", "v", "bits"])

    return run


def subset_sums(v: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions of ``v`` (anchors, dimensions), the sum of every subset."""
    groups = -(-v.shape[1] // 8)
    padded = np.zeros((len(v), groups * 8), np.int64)
    padded[:, : v.shape[1]] = v
    table = np.zeros((groups, 256, len(v)), np.int64)
    for j in range(8):  # subsets with j as the last member
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + padded[:, j::8].T[:, None, :]
    return table


def scores(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact products, from ``bits`` (candidates, planes, groups) by shifts and additions."""
    out = np.zeros((len(bits), table.shape[2]), np.int64)
    top = bits.shape[1] - 1
    for p in range(top, -1, -1):
        out <<= 1
        for g in range(table.shape[0]):
            if p == top:  # the sign's plane
                out -= table[g][bits[:, p, g]]
            else:
                out += table[g][bits[:, p, g]]
    return out


class _Best:
    """The first ``k`` scores of each of ``n`` lists, of candidates that come in order; an earlier one wins a tie."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.at = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), -1)
        self.held = np.zeros(n, np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, ok: np.ndarray, first: int) -> None:
        """``score`` (candidates, lists) where ``ok``, into ``lists``; the candidates are numbered from ``first``."""
        k = self.k
        # beaten by what is held: earlier candidates win ties
        ok &= (score > self.score[lists, -1]) | (self.held[lists] < k)
        some = np.where(ok, score, np.iinfo(np.int64).min)
        if len(some) > k:
            ok &= some >= np.partition(some, len(some) - k, axis=0)[len(some) - k]
        c, own = np.nonzero(ok)
        if not len(c):
            return
        own = lists[own]
        touched = np.unique(own)
        old = np.repeat(touched, k)
        old_at, old_score = self.at[touched].ravel(), self.score[touched].ravel()
        real = old_at >= 0
        own, at, s = np.r_[old[real], own], np.r_[old_at[real], c + first], np.r_[old_score[real], score[ok]]
        order = np.lexsort((at, -s, own))
        own, at, s = own[order], at[order], s[order]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
        top = place < k
        self.score[touched], self.at[touched] = np.iinfo(np.int64).min, -1
        self.score[own[top], place[top]], self.at[own[top], place[top]] = s[top], at[top]
        self.held[touched] = (self.at[touched] >= 0).sum(axis=1)


def _cells(k: int, negatives: bool):
    """Of each cell, the best ``k`` candidates of each anchor (same label, not itself), or of each anchor's positives (other label, in range)."""

    def ended(cell):
        anchors, best, ids = cell
        one, place = np.nonzero(best.at >= 0)
        if len(one):
            at = best.at[one, place]
            own = anchors["seq"][one] if not negatives else anchors["list_anchor"][one]
            cols = [own, ids[0][at], ids[1][at], best.score[one, place]]
            if negatives:
                cols.append(anchors["list_positive"][one])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "id", "seq", "score", "positive"][: len(cols)])
        return None

    def opened(rows):
        v = np.stack([np.frombuffer(x, np.int64) for x in rows.column("v").to_pylist()])
        anchors = {"seq": rows.column("seq").to_numpy(), "label": rows.column("label").to_numpy(), "table": subset_sums(v)}
        n = len(v)
        if negatives:
            given = rows.column("positives").to_pylist()  # of each anchor: its positives (seq, score) in their order
            anchors["of"] = np.array([i for i, g in enumerate(given) for _ in g], np.int64)
            anchors["list_positive"] = np.array([p["seq"] for g in given for p in g], np.int64)
            anchors["list_anchor"] = anchors["seq"][anchors["of"]]
            ps = [p["score"] for g in given for p in g]  # bounds in whole numbers of any size
            anchors["low"] = np.array([-(-p // 2) for p in ps], np.int64)
            anchors["high"] = np.array([95 * p // 100 for p in ps], np.int64)
            n = len(ps)
        return anchors, _Best(n, k), [np.zeros(0, np.int64)] * 2

    def met(cell, rows):
        anchors, best, ids = cell
        for at in range(0, rows.num_rows, SLICE):
            b = rows.slice(at, SLICE)
            planes = b.column("planes").to_numpy()
            label, seq = b.column("label").to_numpy(), b.column("seq").to_numpy()
            raw, groups = b.column("bits").to_pylist(), anchors["table"].shape[0]
            score = np.zeros((len(raw), len(anchors["seq"])), np.int64)
            for p in np.unique(planes):  # nearly always one or two numbers
                some = np.flatnonzero(planes == p)
                bits = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), p, groups)
                score[some] = scores(anchors["table"], bits)
            same = label[:, None] == anchors["label"][None, :]
            first = len(ids[0])
            ids[0], ids[1] = np.r_[ids[0], b.column("id").to_numpy()], np.r_[ids[1], seq]
            if not negatives:
                best.add(np.arange(score.shape[1]), score, same & (seq[:, None] != anchors["seq"][None, :]), first)
                continue
            for at_list in range(0, len(anchors["of"]), 512):
                lists = np.arange(at_list, min(at_list + 512, len(anchors["of"])))
                of = anchors["of"][lists]
                s = score[:, of]
                best.add(lists, s, ~same[:, of] & (s >= anchors["low"][lists]) & (s <= anchors["high"][lists]), first)

    def run(batches):
        cell, key, waiting = None, None, []
        for batch in batches:
            cells, anchor = batch.column("cell").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(anchor.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if key != cells[a]:
                    if cell and (out := ended(cell)):
                        yield out
                    cell, key, waiting = None, cells[a], []
                if anchor[a]:
                    waiting.append(rows)
                    continue
                if cell is None:
                    if not waiting:
                        continue
                    cell = opened(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                met(cell, rows)
        if cell and (out := ended(cell)):
            yield out

    return run


class HardNegatives:
    """Parameters: positives of an anchor, negatives of a positive, the factor before rounding down, anchors in a block, candidates in a group."""

    def __init__(self, positives: int = 5, negatives: int = 3, scale: int = 256, block: int = 512, group: int = 65_536):
        self.positives, self.negatives, self.scale, self.block, self.group = positives, negatives, scale, block, group

    def mine(self, rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows``; anchors are those where ``is_anchor``."""
        ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
        given = rows.where(F.col(label).isNotNull()).select(ids.alias("id"), F.xxhash64(F.col(label).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        # rows that share an id are told apart by number; a written table keeps the numbers
        given = materialize(given.withColumn("seq", F.monotonically_increasing_id()))
        packed = materialize(given.mapInArrow(_packed(self.scale), _ROW))
        bounds = packed.groupBy("dim").agg(F.max("bound").alias("most")).collect()  # one row for each length of a vector
        if any(r["most"] ** 2 >= 2.0**62 for r in bounds):
            raise ValueError("scores have more than 62 bits")
        anchors = materialize(packed.join(given.where("asks").select("seq"), "seq", "left_semi").select(packed.columns))
        found = self._round(anchors.withColumn("positives", F.lit(None).cast("array<struct<seq:long,score:long>>")), packed, self.positives, False)
        order = [F.desc("score"), "id", "seq"]
        found = found.withColumn("no", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("no") <= self.positives)
        found = materialize(found.select("anchor", F.col("seq").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "no"))
        # at most ``positives`` an anchor
        listed = found.groupBy(F.col("anchor").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("no", "positive", "positive_score"))).alias("p"))
        listed = listed.select("seq", F.transform("p", lambda p: F.struct(p["positive"].alias("seq"), p["positive_score"].alias("score"))).alias("positives"))
        hard = self._round(anchors.join(listed, "seq").select(*packed.columns, "positives"), packed, self.negatives, True)
        rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))
        hard = hard.withColumn("rank", rank).where(F.col("rank") <= self.negatives).select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = anchors.select(F.col("seq").alias("anchor"), F.col("id").alias("anchor_id"))
        out = hard.join(found, ["anchor", "positive"]).join(named, "anchor")
        real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
        return out.select(real("anchor_id"), real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")

    def _round(self, anchors: DataFrame, packed: DataFrame, k: int, negatives: bool) -> DataFrame:
        """Each block of anchors meets each group of candidates with vectors of its length."""
        a, n = anchors.count(), packed.count()
        blocks, groups = max(1, -(-a // self.block)), max(1, -(-n // self.group), min(16, n // 1024))
        dealt = lambda m: F.pmod(F.xxhash64("seq", "id"), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        none = F.lit(None).cast("array<struct<seq:long,score:long>>")
        left = anchors.select(dealt(blocks).alias("block"), every(groups).alias("grp"), F.lit(True).alias("anchor"), "id", "seq", "label", "dim", "planes", "v", F.lit(b"").alias("bits"), "positives")
        right = packed.select(every(blocks).alias("block"), dealt(groups).alias("grp"), F.lit(False).alias("anchor"), "id", "seq", "label", "dim", "planes", F.lit(b"").alias("v"), "bits", none.alias("positives"))
        cells = left.unionByName(right).select(F.xxhash64("block", "grp", "dim").alias("cell"), *_CELL, "positives")
        # little data, much work: a number of tasks that Spark doesn't merge
        cells = cells.repartition(min(20_000, blocks * groups), "cell").sortWithinPartitions("cell", F.desc("anchor"), "id", "seq")
        schema = "anchor long, id long, seq long, score long" + ", positive long" * negatives
        return materialize(cells.mapInArrow(_cells(k, negatives), schema))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are the ids divisible by 50, and every seventh id counts under the next label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HardNegatives().mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH q AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
