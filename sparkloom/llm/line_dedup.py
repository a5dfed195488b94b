"""Line dedup by deletion neighbourhoods, with DataFrame functions alone.

A line goes if an earlier one, by doc_id and place, equals it or is at most ``edits`` edits away; equal lines collapse to their first
place before anything else. ``edits`` edits leave one of ``edits`` + 1 parts of a line as it was, so lines that share no part
(by hash, for their length and those up to ``edits`` less) with another line cannot be near one and stop there.

The others emit their variants as hashed keys. For one edit the place is narrowed first: a line is cut in segments of about the square root of
its length, and only a segment whose outside equals another line's outside can hold the edit. Such a segment emits itself and all its
variants with one character deleted: two that lack the same place are a substitution apart, a variant that equals a whole segment is an insertion
apart. So a line of n characters makes about 4 * sqrt(n) keys, however many lines share a part. For more edits a whole line emits all variants
with up to ``edits`` places deleted or marked; two that equal and need no more than ``edits`` of these together are near.
Keys meet in a window, whose size is bounded by the alphabet and the line; no pairs within a group are made: each variant meets only the earliest line that it
can be near, and that pair is verified by its edit distance.

Nulls and edges: null and empty texts stay as they are; blank lines always stay; lines of fewer than
``least`` characters go only if equal to an earlier one; a document left without any line but blank ones goes, if it had some before; rows with
equal doc_id are ordered by a hash of their text, and rows that repeat wholly are treated alike; a null doc_id comes first; extra columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

#: Lines that share a part are broadcast by an 8-byte hash up to this count (16 MB), else joined by a shuffle.
BROADCAST_LINES = 2_000_000

SPACE = " \t\n\x0b\x0c\r"


class LineDedup:
    """Parameters: characters in a line that is compared for edits, edits at most (the variants of a line grow with its length to this power)."""

    def __init__(self, least: int = 16, edits: int = 1):
        self.least, self.edits = least, edits

    def _lines(self, docs: DataFrame) -> DataFrame:
        text = F.col("text").cast("string")
        cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dh"), F.posexplode(F.split(text, "\n")).alias("no", "u"))
        return cols.where(F.trim("u", F.lit(SPACE)) != "")

    def first_places(self, docs: DataFrame) -> DataFrame:
        """a, b (hashes of a distinct line), place (its first one), keys (hashes of its ``edits`` + 1 parts, then of the parts it looks for)."""
        k = self.edits
        part = lambda i, m, moved: f"xxhash64({i}, {m}, substring(u, {i} * ({m}) div {k + 1} + {1 + moved}, {i + 1} * ({m}) div {k + 1} - {i} * ({m}) div {k + 1}))"
        keys = [part(i, "n", 0) for i in range(k + 1)]
        for less in range(k + 1):
            for i in range(k + 1):
                # each part before holds an edit, and so does each part after: that bounds the move from both ends
                moves = range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)
                keys += [part(i, f"n - {less}", moved) for moved in moves if less or moved]
        lines = self._lines(docs).withColumn("n", F.length("u"))
        held = F.expr(f"case when n < {self.least} then array() else array({', '.join(keys)}) end").alias("keys")
        lines = lines.select(F.xxhash64("u").alias("a"), F.xxhash64(F.lit(17), "u").alias("b"), F.struct("doc_id", "dh", "no", held).alias("place"))
        return lines.groupBy("a", "b").agg(F.min("place").alias("place"))

    def _likely(self, docs: DataFrame, first: DataFrame) -> DataFrame:
        """me (place and hashes), u: the distinct lines that share a part with another one."""
        keys = first.select("a", F.posexplode("place.keys").alias("i", "key"))
        own = F.count_if(F.col("i") <= self.edits)
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), own.alias("own")).where("n > 1 and own > 0").select("key")
        likely = materialize(keys.join(shared, "key", "left_semi").select("a").distinct())
        likely = F.broadcast(likely) if likely.count() <= BROADCAST_LINES else likely
        texts = self._lines(docs).withColumn("a", F.xxhash64("u")).join(likely, "a").groupBy("a", F.xxhash64(F.lit(17), "u").alias("b")).agg(F.first("u").alias("u"))
        me = F.struct("place.doc_id", "place.dh", "place.no", "a", "b").alias("me")
        return materialize(texts.join(first.select("a", "b", me), ["a", "b"]).select("me", "u").repartition("me"))

    def _one_edit(self, texts: DataFrame) -> DataFrame:
        """me, mate: each line and the earliest that a variant of one of its segments meets."""
        # a line in its own length and, as the longer of two, in one less: its segment then has one character more
        ways = texts.select("me", "u", F.expr("explode(array(struct(length(u) as m, 0 as more), struct(length(u) - 1 as m, 1 as more))) as w")).select("me", "u", "w.m", "w.more")
        cut = ways.withColumn("s", F.expr("greatest(16, cast(ceil(sqrt(m)) as int))")).withColumn("j", F.expr("explode(sequence(0, (m - 1) div s))"))
        outside = F.expr("xxhash64(j, m, left(u, j * s), substring(u, (j + 1) * s + more + 1))")
        segments = cut.select("me", "more", outside.alias("key"), F.expr("substring(u, j * s + 1, s + more)").alias("g"))
        shared = segments.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("more") == 0).alias("own")).where("n > 1 and own > 0").select("key")
        lacking = "transform(sequence(1, length(g)), p -> struct({p} as p, xxhash64(key, {p}, left(g, p - 1), substring(g, p + 1)) as v))"
        whole = "transform(sequence(1, length(g)), p -> struct(0 as p, xxhash64(key, 0, concat(left(g, p - 1), substring(g, p + 1))) as v))"
        made = F.expr(f"explode(if(more = 1, {whole}, concat(array(struct(-1 as p, xxhash64(key, 0, g) as v)), {lacking.format(p='p')}))) as x")
        variants = segments.join(shared, "key", "left_semi").select("me", made).select("me", "x.p", "x.v")
        v = Window.partitionBy("v")
        least = lambda p: F.min(F.when(F.col("p") == p, F.col("me"))).over(v)
        mate = F.when(F.col("p") == -1, least(0)).when(F.col("p") == 0, least(-1)).otherwise(F.min("me").over(v))
        return variants.select("me", mate.alias("mate")).where("mate < me").distinct()

    def _more_edits(self, texts: DataFrame) -> DataFrame:
        """me, mate: each line and the earliest that one of its variants meets, by how many places the two lack."""

        def ways(made: str, at: str, left: int, lack: int) -> str:
            marked, p = self.edits - left - lack, f"p{left}"
            one = f"array(struct({lack} as lack, {marked} as marked, xxhash64({marked}, concat({made}, substring(u, {at} + 1))) as v))"
            if not left:
                return one
            until = f"concat({made}, substring(u, {at} + 1, {p} - {at}))"
            more = f"concat({ways(f'concat({until}, char(0))', f'({p} + 1)', left - 1, lack)}, {ways(until, f'({p} + 1)', left - 1, lack + 1)})"
            return f"concat({one}, flatten(transform(filter(sequence({at}, length(u)), x -> x < length(u)), {p} -> {more})))"

        found = texts.select("me", F.expr(f"explode({ways("''", '0', self.edits, 0)}) as x")).select("me", "x.*")
        v = Window.partitionBy("v", "marked")
        mate = F.lit(None)
        for lack in range(self.edits + 1):
            earliest = F.min(F.when(F.col("lack") == lack, F.col("me"))).over(v)
            mate = F.least(mate, F.when(F.col("lack") + F.col("marked") + lack <= self.edits, earliest)) if lack else F.when(F.col("lack") + F.col("marked") <= self.edits, earliest)
        return found.select("me", mate.alias("mate")).where("mate < me").distinct()

    def near(self, docs: DataFrame, first: DataFrame) -> DataFrame:
        """a, b of the distinct lines that are at most ``edits`` edits away from an earlier one."""
        texts = self._likely(docs, first)
        pairs = self._one_edit(texts) if self.edits == 1 else self._more_edits(texts)
        both = pairs.join(texts.select("me", F.col("u").alias("x")), "me").join(texts.select(F.col("me").alias("mate"), F.col("u").alias("y")), "mate")
        return both.where(F.levenshtein("x", "y", self.edits) >= 0).select("me.a", "me.b").distinct()

    def _kept(self, docs: DataFrame) -> DataFrame:
        """row (all columns), text (of the lines kept), n_lines, n_kept (lines that are not blank)."""
        first = materialize(self.first_places(docs))
        kept = first.select("a", "b", "place.doc_id", "place.dh", "place.no")
        if self.edits:
            kept = kept.join(self.near(docs, first), ["a", "b"], "left_anti")
        kept = kept.groupBy("doc_id", "dh").agg(F.sort_array(F.collect_list("no")).alias("nos"))
        # a sign for each line up to the last kept one
        flags = "split(array_join(transform(nos, (x, i) -> concat(repeat('0', x - if(i = 0, 0, nos[i - 1] + 1)), '1')), ''), '')"
        kept = kept.select(F.col("doc_id").alias("d"), F.col("dh").alias("h"), F.expr(flags).alias("flags"))
        text = F.col("row.text").cast("string")
        given = docs.select(F.struct(*docs.columns).alias("row")).select("row", text.alias("text"), F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dh"))
        out = given.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dh") == F.col("h")), "left")
        out = out.withColumn("lines", F.split("text", "\n")).withColumn("solid", F.filter("lines", lambda x: F.trim(x, F.lit(SPACE)) != ""))
        n_kept = F.coalesce(F.size(F.filter("flags", lambda x: x == "1")), F.lit(0)).cast("long")
        left = F.filter("lines", lambda x, i: (F.trim(x, F.lit(SPACE)) == "") | F.coalesce(F.get("flags", i) == "1", F.lit(False)))
        out = out.select("row", "text", "lines", "flags", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("solid")).cast("long").alias("n_lines"), F.when(F.col("flags").isNull(), F.lit(0)).otherwise(n_kept).cast("long").alias("n_kept"))
        text = F.when(F.col("text").isNull() | (F.col("n_lines") == F.col("n_kept")), F.col("text")).otherwise(F.array_join(left, "\n"))
        return out.select("row", text.alias("text"), "n_lines", "n_kept")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the lines kept, and columns n_lines and n_kept (lines that are not blank), in place of any of that name."""
        cols = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_kept")]
        return self._kept(docs).select(*cols, "n_lines", "n_kept")

    def drop_lines(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the lines kept; documents left without any go."""
        same = F.col("n_lines") == F.col("n_kept")
        new = {"text": F.col("text"), "n_chars": F.when(same, F.col("row")["n_chars"]).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
        return self._kept(docs).where("n_lines = 0 or n_kept > 0").select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the lines that equal or are near an earlier one; documents left without any line go."""
    return LineDedup(**parameters).drop_lines(docs)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: lines, lines kept, and size and digest of the text left."""
    out = LineDedup().dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP9_SQL = r"""
WITH docs AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS id FROM documents),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM docs WHERE text IS NOT NULL),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(u, '[^\x20\x09-\x0D]')),
firsts AS (SELECT u, min(id * 1000000 + no) AS place, length(u) AS n FROM full_lines GROUP BY u),
halves AS (SELECT u, place, n, n AS m, left(u, n // 2) AS p, right(u, n - n // 2) AS s FROM firsts WHERE n >= 16
  UNION ALL SELECT u, place, n, n - 1, left(u, (n - 1) // 2), right(u, n - 1 - (n - 1) // 2) FROM firsts WHERE n >= 16),
pairs AS (SELECT x.u, y.u AS v FROM halves x JOIN halves y ON x.m = y.m AND x.p = y.p WHERE y.place < x.place
  UNION SELECT x.u, y.u FROM halves x JOIN halves y ON x.m = y.m AND x.s = y.s WHERE y.place < x.place),
near AS (SELECT DISTINCT u FROM pairs WHERE levenshtein(u, v) <= 1),
marked AS (SELECT l.*, regexp_matches(l.u, '[^\x20\x09-\x0D]') AS solid, f.place = l.id * 1000000 + l.no AND l.u NOT IN (SELECT u FROM near) AS keep
  FROM lines l LEFT JOIN firsts f USING (u)),
made AS (SELECT id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND keep) AS n_kept,
  coalesce(string_agg(u, chr(10) ORDER BY no) FILTER (NOT solid OR keep), '') AS text FROM marked GROUP BY id),
done AS (SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN n_lines IS NULL OR n_lines = n_kept THEN d.text ELSE m.text END AS text
  FROM docs d LEFT JOIN made m USING (id))
SELECT doc_id, n_lines, n_kept, length(text)::BIGINT AS kept_chars, md5(text) AS kept_md5 FROM done"""
