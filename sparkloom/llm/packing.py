"""Best-fit packing of token pieces into sequences by bin completion.

How full sequences can get depends only on how many pieces have each length, and there are at most ``capacity`` lengths.
So Spark counts the lengths; bin completion works on these counts, as many equal sequences at a time as the counts
allow; and Spark deals the pieces out to the sequences' places by their rank among pieces of that length. Bin completion takes
the longest length left and the filling of it that leaves least, over any number of pieces; best-fit gives the first incumbent, and bit sets
of all sums a better one. If the plan needs more sequences than the lower bound, plans that part short pieces from
long ones are tried as incumbents, and the end of the best is searched again by branching over undominated fillings: more waste than one sequence less allows prunes a branch.

Nulls and edges: a null text is empty, and an empty document is its end token alone; rows with equal doc_id are
separate documents; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, released, root_of, slices, spread_rank
from sparkloom.llm.token_cache import WordIds


#: Plans that part short pieces from long ones: how many together are tried, and of what they spare how much is used. All are tried at any size.
PARTS, SHARES = 8, (1.0, 0.99, 0.98, 0.97, 0.95, 0.9)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    last = np.uint32(end).tobytes()

    def run(batches):
        words = WordIds.of(path)
        for whole in batches:
            for batch in slices(whole, "text", 2000, 4 << 20):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), words.column(batch.column("text")), strict=True):
                    ids = ids.tobytes() + last
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names[: 5 + with_ids])

    return run


def _sums(room: int, have: dict[int, int], lengths: list[int], stop: bool = False) -> tuple[list[tuple[int, int]], int]:
    """(each length with the sums that those before it make, sums of all) as bit sets up to ``room``; ``stop`` at the first way to fill it."""
    steps, sums, full = [], 1, (1 << (room + 1)) - 1
    for n in lengths:
        count, k = min(have[n], room // n), 1
        if not count:
            continue
        steps.append((n, sums))
        while count:
            k = min(k, count)
            sums |= (sums << (k * n)) & full
            count, k = count - k, 2 * k
        if stop and sums >> room:
            break
    return steps, sums


def _filling(room: int, have: dict[int, int], lengths: list[int]) -> list[int]:
    """The lengths, of any number, that leave least of ``room``: best-fit if nothing leaves less, else by all sums."""
    best, left, used = [], room, {}
    for n in lengths:  # best-fit: the longest that fits, again and again
        while n <= left and have[n] > used.get(n, 0):
            best.append(n)
            used[n] = used.get(n, 0) + 1
            left -= n
        if not left:
            return best
    steps, sums = _sums(room, have, lengths, stop=True)
    target = sums.bit_length() - 1
    if target == room - left:
        return best
    best = []
    for n, before in reversed(steps):
        while not before >> target & 1:
            best.append(n)
            target -= n
    return best


def _fillings(room: int, have: dict[int, int], lengths: list[int], slack: int):
    """All undominated fillings that leave at most ``slack``, by what they leave, longer pieces first; None for each dominated one."""
    steps, sums = _sums(room, have, lengths[::-1])

    def ways(last: int, target: int):
        if not target:
            yield []
            return
        for i in range(last, -1, -1):
            n, before = steps[i]
            for k in range(min(have[n], target // n), 0, -1):
                if before >> (target - k * n) & 1:
                    for rest in ways(i - 1, target - k * n):
                        yield [n] * k + rest
            if not before >> target & 1:
                return

    for waste in range(min(slack, room) + 1):
        if sums >> (room - waste) & 1:
            for way in ways(len(steps) - 1, room - waste):
                # dominated: another piece fits in, or fits instead of one
                free = [n for n, _ in steps if have[n] > way.count(n)] if waste else []
                yield None if any(n <= waste or any(x < n <= x + waste for x in way) for n in free) else way


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: long pieces lie apart, and pieces over a part of ``capacity`` lie few together."""
    if not counts:
        return 0
    count = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        count[n] = c
    size = count * np.arange(capacity + 2)
    number, total = np.cumsum(count), np.cumsum(size)
    half, bound = capacity // 2, 0
    for k in range(half + 1):  # pieces under k are left out; those over capacity - k lie alone
        apart, beside = number[-1] - number[half], total[capacity - k] - total[half] if capacity - k > half else 0
        room = (number[max(half, capacity - k)] - number[half]) * capacity - beside
        bound = max(bound, apart + max(0, -((room - (total[half] - (total[k - 1] if k else 0))) // capacity)))
    for m in range(1, capacity):  # at most m of the pieces over capacity / (m + 1)
        bound = max(bound, -(-(number[-1] - number[capacity // (m + 1)]) // m))
    return int(bound)


def _search(counts: dict[int, int], capacity: int, most: int, nodes: list[int]) -> list[list[int]] | None:
    """At most ``most`` sequences that hold ``counts``, by branching over undominated fillings; None if there are none or ``nodes`` end."""
    have, stack = dict(counts), []
    slack = most * capacity - sum(n * c for n, c in counts.items())

    def branch():
        lengths = sorted((n for n, c in have.items() if c), reverse=True)
        n, own = lengths[0], dict(have)
        own[n] -= 1
        stack.append((([n, *way] if way is not None else [] for way in _fillings(capacity - n, own, lengths, slack)), []))

    branch()
    while stack and nodes[0] > 0:
        ways, done = stack[-1]
        for n in done:
            have[n] += 1
        if done:
            slack += capacity - sum(done)
        way = next(ways, None)
        if way is None:
            stack.pop()
            continue
        nodes[0] -= 1
        stack[-1] = ways, way
        if not way:
            continue
        for n in way:
            have[n] -= 1
        slack -= capacity - sum(way)
        if not any(have.values()):
            return [w for _, w in stack]
        if len(stack) < most:
            branch()
    return None


def _filled(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The fillings with least waste of the longest length left, as many times as the counts allow."""
    have, out = dict(counts), []
    lengths = sorted(have, reverse=True)
    while lengths:
        n = lengths[0]
        have[n] -= 1
        chosen = [n, *(_filling(capacity - n, have, lengths) if n < capacity else [])]
        have[n] += 1
        need = {x: chosen.count(x) for x in chosen}
        times = min(have[x] // c for x, c in need.items())
        out.append((times, sorted(chosen, reverse=True)))
        for x, c in need.items():
            have[x] -= times * c
        lengths = [x for x in lengths if have[x]]
    return out


def _number(plan: list[tuple[int, list[int]]]) -> int:
    return sum(times for times, _ in plan)


def _split_counts(counts: dict[int, int], capacity: int, m: int, share: float) -> tuple[dict[int, int], dict[int, int]]:
    """(the pieces over a length, the rest): of the shortest as many as are, on average, no longer than the ``m``-th part of ``capacity``.

    Longer ones exceed that by ``share`` of what shorter ones spare: the rest is room for fillings that leave a little.
    """
    long, short, spare = {}, {}, 0
    for n in sorted(counts):
        over = m * n - capacity
        fit = counts[n] if over <= 0 else 0 if long else min(counts[n], int(spare // over))
        spare -= over * fit * (1 if over > 0 else share)
        if fit:
            short[n] = fit
        if fit < counts[n]:
            long[n] = counts[n] - fit
    return long, short


def _rows(counts: dict[int, int], capacity: int, m: int) -> list[tuple[int, list[int]]] | None:
    """All pieces, ``m`` to a sequence, row by row from the longest, the longest of a row to where least lies; None if one gets too full."""
    number = -(-sum(counts.values()) // m)
    left = sorted(counts.items())
    bins = [(0, number, [])]
    for _ in range(m):
        bins.sort(key=lambda e: e[0])
        made, at, used = [], 0, 0
        while at < len(bins) and left:
            total, times, way = bins[at]
            n, count = left[-1]
            k = min(times - used, count)
            made.append((total + n, k, [*way, n]))
            left[-1] = n, count - k
            used += k
            if count == k:
                left.pop()
            if used == times:
                at, used = at + 1, 0
        made += [(total, times - (used if i == 0 else 0), way) for i, (total, times, way) in enumerate(bins[at:])]
        bins = made
        if max(total for total, _, _ in bins) > capacity:
            return None
    return [(times, way) for _, times, way in bins if times and way]


def _parted(counts: dict[int, int], capacity: int, bound: int, plan: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """``plan`` or a plan of fewer sequences in which the shortest pieces lie ``m`` together and the longer ones by themselves.

    The longest lengths left, filled first, take the shortest pieces with them where fewer together leave as little; what is left then fits badly.
    """
    least = capacity // max(counts) + 1
    for m in range(least, min(least + PARTS, capacity // min(counts) + 1)):
        low, high = 0.0, 1.0
        for _ in range(10):  # the largest share with which rows of m fit
            long, short = _split_counts(counts, capacity, m, (low + high) / 2)
            rows = _rows(short, capacity, m) if short else None
            if rows and fewest(long, capacity) + _number(rows) < _number(plan):
                made = _filled(long, capacity) + rows
                plan = made if _number(made) < _number(plan) else plan
            low, high = ((low + high) / 2, high) if rows else (low, (low + high) / 2)
        for share in SHARES:
            if _number(plan) <= bound:
                return plan
            long, short = _split_counts(counts, capacity, m, share)
            if not long or not short:
                break
            rest = fewest(short, capacity)
            if fewest(long, capacity) + rest >= _number(plan):
                continue
            below = _filled(long, capacity)
            if _number(below) + rest < _number(plan):
                made = below + _filled(short, capacity)
                plan = made if _number(made) < _number(plan) else plan
    return plan


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 2000) -> list[tuple[int, list[int]]]:
    """(how many sequences, their lengths) that hold ``counts`` pieces of each length.

    The fillings with least waste come first, as many times as the counts allow; where that is more than the lower bound, a plan that parts
    short pieces from long ones may be the better incumbent. While that is still more, longer and longer ends of the plan, worst filled
    last, are searched for one sequence less, over ``nodes`` fillings altogether, however many sequences lie before that end.
    """
    have = {n: c for n, c in counts.items() if c > 0}
    if not have:
        return []
    out, bound = _filled(have, capacity), fewest(have, capacity)
    if _number(out) > bound:
        out = _parted(have, capacity, bound, out)
    if _number(out) <= bound:
        return out
    out.sort(key=lambda e: capacity - sum(e[1]))
    left, width = [nodes], 2
    while left[0] >= width and _number(out) > bound:
        rest, end, size = list(out), [], 0
        while rest and size < width:  # the last ``width`` sequences, of many equal ones as many as are missing
            times, way = rest.pop()
            if times > width - size:
                rest.append((times - (width - size), way))
                times = width - size
            end.append((times, way))
            size += times
        held = {}
        for times, way in end:
            for n in way:
                held[n] = held.get(n, 0) + times
        found = None
        if fewest(held, capacity) < size:
            # a share of what is left, so that one end doesn't use up all
            share = [max(size, left[0] // 3)]
            left[0] -= share[0]
            found = _search(held, capacity, size - 1, share)
            left[0] += share[0]
        if found is not None:
            out = rest + sorted(((1, way) for way in found), key=lambda e: capacity - sum(e[1]))
            width = 2
        elif not rest:
            break
        else:
            width *= 2
    return out


class Packer:
    """Parameters: tokens in a sequence, tokenizer file, end token, fillings searched beyond the first plan."""

    def __init__(self, capacity: int = 4096, tokenizer: str | None = None, end: int = 1, nodes: int = 2000):
        self.capacity, self.tokenizer, self.end, self.nodes = capacity, tokenizer or public_tokenizer(), end, nodes

    def pieces(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return given.mapInArrow(released(_pieces(self.tokenizer, self.capacity, self.end, with_ids)), schema)

    def pack(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        """The pieces with sequence_id and offset."""
        pieces = materialize(self.pieces(docs, with_ids))
        counted = pieces.groupBy("length").count().collect()  # one row for each of at most ``capacity`` lengths
        plan = complete_bins({r["length"]: r["count"] for r in counted}, self.capacity, self.nodes)
        entries, first, taken = [], 0, {}
        for times, lengths in plan:
            offset = 0
            for n in dict.fromkeys(lengths):
                m, at = lengths.count(n), taken.get(n, 0)
                entries.append((n, at, at + m * times, m, first, offset))
                taken[n], offset = at + m * times, offset + m * n
            first += times
        # each step of the plan uses up a length or all but a few of its pieces: the entries are bounded by the lengths
        places = docs.sparkSession.createDataFrame(entries, "_n long, _from long, _to long, _m long, _first long, _offset long")
        ranked = spread_rank(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], root_of(sum(r["count"] for r in counted)))
        here = (F.col("length") == F.col("_n")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
        put = ranked.join(F.broadcast(places), here).withColumn("_r", F.col("rank") - F.col("_from"))
        put = put.withColumn("sequence_id", F.col("_first") + F.expr("_r div _m")).withColumn("offset", F.col("_offset") + F.col("_r") % F.col("_m") * F.col("length"))
        return put.select(*pieces.columns, "sequence_id", F.col("offset").cast("long").alias("offset"))

    def sequences(self, docs: DataFrame) -> DataFrame:
        """sequence_id, parts (doc_id, piece, offset, ids): each of at most ``capacity`` tokens."""
        part = F.struct("offset", "doc_id", "piece", "ids")
        return self.pack(docs, with_ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, sequences of 4096 tokens."""
    return Packer().pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
