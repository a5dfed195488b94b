"""Mixing sources to target weights, with DataFrame functions alone.

Each source is a stream of words: its documents in a fixed pseudorandom order. The stream is packed into blocks of
``block`` words; the last one may be shorter. A source that is to give t of its S words gives t div S whole passes and
the first t mod S words of one more, and so has a fixed number of slots in the mix.

Each output shard holds the same number of slots. Its counts of the sources are drawn as a multinomial: every slot draws its source with the
chances of the sources' slots. Running sums of these counts over the shards number a source's slots; the few drawn beyond the slots that the source
has are dealt to the sources that were drawn too seldom, so that targets are met to the word. A slot's number gives its pass and place; each pass is a
pseudorandom permutation of the full blocks (swap-or-not rounds on the block's index; the short block stays last), so no word
is taken more than one time oftener than another. A slot's block is joined by (source, index), never gathered.

Nulls and edges: a null text has size 0 and gives nothing; a null source is a source of its own, ordered last; rows
with equal doc_id are separate rows; an empty table gives an empty mix; extra columns of any name are carried along by ``mixed``, ignored else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, materialize, root_of

#: md5 gives the same draws in Spark and in SQL elsewhere.
ROUNDS = 12


def draw(*cols: Column) -> Column:
    """A pseudorandom number of 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, source_id, weight, target for each row of ``sizes(source, source_size)``.

    The target is the least of most * source_size and weight * level; the level makes the targets sum to all sizes.
    Sources fill up in the order of capacity per weight, so the level follows from running sums over the sources: it is the
    first, and so the largest, at which the source at hand does not fill up.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_id", F.row_number().over(by).cast("long"))
    kinds = F.array(*[F.lit(w) for w in weights])
    s = s.withColumn("weight", F.element_at(kinds, (F.pmod(F.col("source_id") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    every = Window.partitionBy()
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))).over(every))
    share = F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double"))
    return s.select("source", "source_size", "source_id", "weight", F.least(F.col("cap").cast("double"), share).alias("target"))


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 applied to ``place``: swap-or-not, for any n."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(draw(*key, F.lit("k"), r), n) - x + n, n)
        return F.when(F.pmod(draw(*key, F.lit("b"), r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place.cast("long"), swap)


class Mixer:
    """Parameters: words in a block, words in an output shard, weights by rank of the source, passes at most."""

    #: Slots of which a task permutes the places.
    TASK_SLOTS = 4096
    #: Sources are sent to all tasks up to this count (some 50 bytes each), else joined by a shuffle.
    BROADCAST_SOURCES = 50_000

    def __init__(self, block: int = 1024, shard_words: int = 1 << 20, weights: tuple[int, ...] = (1, 2, 3), most: int = 3):
        self.block, self.weights, self.most = block, weights, most
        self.shard_slots = max(1, shard_words // block)

    def streams(self, docs: DataFrame) -> DataFrame:
        """doc_id, source, h, size, source_size, target, source_id, first (its first word's place in the source), row: for each row of ``docs``."""
        text = F.col("text").cast("string")
        rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.md5(text.cast("binary")).alias("h")))
        n = root_of(rows.count())
        key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("h", F.lit("")))
        rows = rows.withColumn("bucket", F.pmod(draw(key), F.lit(n)))
        sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        total = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), self.weights, self.most)
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        sums = sums.join(total.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "source_size", "source_id", "target")
        joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        own = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "size", "h")
        place = F.col("before") + F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return joined.select("doc_id", "source", "h", "size", "source_size", "target", "source_id", place.alias("first"), F.concat_ws("/", "source_id", "bucket", F.row_number().over(own)).alias("row"))

    def plan(self, streams: DataFrame) -> DataFrame:
        """source_id, source_size, take (words), n (blocks), full (blocks of full length), slots, low (slots of the sources before): one row for each source."""
        s = streams.select("source_id", "source_size", "target").distinct().where("source_size > 0").withColumn("take", F.round("target").cast("long"))
        s = s.withColumn("n", F.ceil(F.col("source_size") / self.block).cast("long")).withColumn("full", F.expr(f"source_size div {self.block}"))
        s = s.withColumn("slots", F.expr(f"take div source_size * n + (take % source_size + {self.block - 1}) div {self.block}")).where("slots > 0")
        return s.withColumn("low", F.coalesce(F.sum("slots").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))

    def drawn(self, plan: DataFrame, total: int) -> DataFrame:
        """shard, slot, source_id: the source that each of the ``total`` slots draws; per shard a multinomial draw of its slots."""
        spark, size = plan.sparkSession, self.shard_slots
        parts = max(1, -(-total // (16 * self.TASK_SLOTS)))
        slots = spark.range(0, -(-total // size), 1, parts).select(F.col("id").alias("shard"), F.explode(F.sequence(F.col("id") * size, F.least(F.col("id") * size + size - 1, F.lit(total - 1)))).alias("slot"))
        slots = slots.withColumn("x", F.pmod(draw(F.lit("slot"), F.col("slot")), F.lit(total)))
        # sources lie side by side on a line of ``total`` places, cut in pieces: a slot meets those of its piece only
        width = max(1, total // 4096)
        pieces = plan.select("source_id", "low", "slots", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(low + slots - 1) div {width}"))).alias("piece"))
        pieces = F.broadcast(pieces) if plan.count() <= self.BROADCAST_SOURCES else pieces
        met = slots.withColumn("piece", F.expr(f"x div {width}")).join(pieces, "piece")
        return met.where("x >= low and x < low + slots").select("shard", "slot", "source_id")

    def slots(self, streams: DataFrame) -> DataFrame:
        """The mix: shard, slot, source_id, pass, place, block, words (taken from the block's start)."""
        plan = materialize(self.plan(streams))
        total = plan.agg(F.sum("slots").alias("n")).first()["n"] or 0
        drawn = materialize(self.drawn(plan, total))
        # the draw: counts of the sources in each shard, and their running sums over groups of shards, then inside a group
        counts = drawn.groupBy("source_id", "shard").agg(F.count(F.lit(1)).alias("count")).withColumn("group", F.expr("shard div 1024"))
        groups = counts.groupBy("source_id", "group").agg(F.sum("count").alias("sum"))
        earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select("source_id", "group", F.coalesce(F.sum("sum").over(earlier(Window.partitionBy("source_id").orderBy("group"))), F.lit(0)).alias("base"))
        inside = F.coalesce(F.sum("count").over(earlier(Window.partitionBy("source_id", "group").orderBy("shard"))), F.lit(0))
        counts = materialize(counts.join(groups, ["source_id", "group"]).select("source_id", "shard", "count", (F.col("base") + inside).alias("base")))
        own = F.row_number().over(Window.partitionBy("source_id", "shard").orderBy("slot")) - 1
        held = plan.select("source_id", F.col("slots").alias("held"))
        named = drawn.withColumn("i", own).join(counts.select("source_id", "shard", "base"), ["source_id", "shard"]).withColumn("number", F.col("base") + F.col("i")).join(held, "source_id")
        named = materialize(named.select("shard", "slot", "source_id", "number", "held"))
        # slots beyond those of their source, by rank, take the numbers that other sources have left
        late = named.where("number >= held").select("source_id", "shard", "slot", (F.col("number") - F.col("held")).alias("over"))
        sums = counts.groupBy("source_id").agg(F.sum("count").alias("count")).join(plan.select("source_id", F.col("slots").alias("held")), "source_id", "right")
        sums = sums.select("source_id", "held", F.coalesce("count", F.lit(0)).alias("count"))
        line = earlier(Window.orderBy("source_id"))
        more, less = F.greatest(F.col("count") - F.col("held"), F.lit(0)), F.greatest(F.col("held") - F.col("count"), F.lit(0))
        sums = materialize(sums.select("source_id", "count", less.alias("less"), F.coalesce(F.sum(more).over(line), F.lit(0)).alias("more_before"), F.coalesce(F.sum(less).over(line), F.lit(0)).alias("less_before")))
        late = late.join(sums.select("source_id", "more_before"), "source_id").select("shard", "slot", (F.col("more_before") + F.col("over")).alias("rank"))
        free = sums.where("less > 0").select("source_id", F.posexplode(F.sequence(F.col("count"), F.col("count") + F.col("less") - 1)).alias("k", "number"), "less_before").select("source_id", "number", (F.col("less_before") + F.col("k")).alias("rank"))
        all_slots = named.where("number < held").select("shard", "slot", "source_id", "number").unionByName(late.join(free, "rank").select("shard", "slot", "source_id", "number"))
        s = all_slots.repartition(max(1, -(-total // self.TASK_SLOTS)), "slot").join(plan.drop("slots", "low"), "source_id")
        s = s.withColumn("pass", F.expr("number div n")).withColumn("place", F.expr("number % n")).withColumn("given", F.least(F.col("source_size"), F.col("take") - F.col("pass") * F.col("source_size")))
        block = F.when(F.col("place") < F.col("full"), permuted(F.col("place"), F.col("full"), F.col("source_id"), F.col("pass"))).otherwise(F.col("place"))
        words = F.least(F.lit(self.block), F.col("given") - F.col("place") * self.block)
        return s.select("shard", "slot", "source_id", "pass", "place", block.alias("block"), words.alias("words"))

    def segments(self, streams: DataFrame, slots: DataFrame) -> DataFrame:
        """What each slot takes of each document: slot columns, row, start (word of the document), n words."""
        s = streams.where("size > 0")
        parts = s.withColumn("block", F.explode(F.sequence(F.expr(f"first div {self.block}"), F.expr(f"(first + size - 1) div {self.block}"))))
        joined = parts.join(slots, ["source_id", "block"])
        start = F.greatest(F.col("first"), F.col("block") * self.block)
        end = F.least(F.col("first") + F.col("size"), F.col("block") * self.block + F.col("words"))
        return joined.withColumn("start", start - F.col("first")).withColumn("n", end - start).where("n > 0")

    def taken(self, docs: DataFrame) -> DataFrame:
        """doc_id, size, source_size, target, taken, shards (those that hold a part of it): one row for each row of ``docs``."""
        streams = materialize(self.streams(docs))
        parts = self.segments(streams, self.slots(streams)).groupBy("row", "shard").agg(F.sum("n").alias("n"))
        words = parts.groupBy("row").agg(F.sum("n").alias("taken"), F.count(F.lit(1)).alias("shards"))
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return streams.join(words, "row", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("shards"))

    def _parts(self, docs: DataFrame, *by: str) -> DataFrame:
        """row (of ``docs``), ``by``, text: what the mix takes of each row, for each value of ``by``; white space between words is kept."""
        streams = materialize(self.streams(docs))
        taken = self.segments(streams, self.slots(streams)).groupBy("row", *by).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"), F.sum("n").alias("taken"))
        streams = streams.select("row", "size", "doc_id", "source", "h", F.regexp_extract("row", r"(\d+)$", 1).cast("int").alias("i"))
        # rows that repeat have equal keys: they are numbered on both sides, so that each keeps its own columns
        key = lambda *c: F.xxhash64(*c, *[F.col(x).isNull() for x in c]).alias("key")
        text = F.col("row.text").cast("string")
        given = docs.select(F.struct(*docs.columns).alias("row")).select(F.col("row").alias("whole"), text.alias("text"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.md5(text.cast("binary")).alias("h"))
        given = given.withColumn("key", key("doc_id", "source", "h"))
        streams = streams.join(taken, "row").withColumn("key", key("doc_id", "source", "h"))
        hashed = F.xxhash64(*[F.col("whole")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
        same = lambda *order: F.dense_rank().over(Window.partitionBy("key").orderBy("doc_id", "source", "h", *order))
        given = given.withColumn("same", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "source", "h", hashed)))
        streams = streams.withColumn("same", same("i"))
        # both sides lie by key already: the rest must not become part of what they are dealt by
        alike = (F.col("g.key") == F.col("s.key")) & (F.col("g.same") - F.col("s.same") == 0)
        met = given.alias("g").join(streams.alias("s"), alike)
        pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # words with the white space after them
        lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
        cut = F.array_join(F.transform("parts", lambda x: F.array_join(F.slice(pieces, (x["start"] + lead + 1).cast("int"), x["n"].cast("int")), "")), "")
        made = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(F.regexp_replace(cut, r"[\x20\x09-\x0D]+$", ""))
        return met.select(F.col("g.whole").alias("row"), *by, F.col("s.row").alias("name"), F.expr("parts[0].start").alias("start"), made.alias("text"))

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: a row for each document and pass, of the words taken, white space between them kept."""
        made = self._parts(docs, "pass")
        new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
        return made.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])

    def blocks(self, docs: DataFrame) -> DataFrame:
        """The mix as it is written: shard, slot, source, text (the words of a block, the parts of its documents parted by newlines)."""
        made = self._parts(docs, "shard", "slot", "pass")
        part = F.struct(F.regexp_extract("name", r"/(\d+)/", 1).cast("long").alias("bucket"), F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("i"), "start", "text")
        joined = made.groupBy("shard", "slot", F.col("row.source").cast("string").alias("source")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        return joined.select("shard", "slot", "source", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: sources weigh 1, 2, 3, repeating, targets stop at three times a source's size."""
    return Mixer().taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_sql(block: int = 1024, shard_slots: int = 1024, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB's SQL, with the same draws."""
    num = lambda s: f"('0x' || md5({s})[1:13])::BIGINT"
    own = "source_id || '/' || pass || '/"
    steps = "p0 AS (SELECT *, place AS x FROM slots WHERE place < full_blocks)"
    for r in range(1, rounds + 1):
        other = f"({num(own + f"k/{r}'")} % full_blocks - x + full_blocks) % full_blocks"
        odd = num(f"{own}b/{r}/' || greatest(x, o)") + " % 2 = 1"
        steps += f",\np{r} AS (SELECT * EXCLUDE (x, o), CASE WHEN {odd} THEN o ELSE x END AS x FROM (SELECT *, {other} AS o FROM p{r - 1}) t)"
    return f"""
WITH sized AS (SELECT doc_id, source, md5(text) AS h, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
n AS (SELECT greatest(16, floor(sqrt(count(*)))::BIGINT) AS n FROM sized),
rows AS (SELECT *, row_number() OVER () AS id, {num("coalesce(doc_id::VARCHAR, '') || '/' || coalesce(h, '')")} % n AS bucket FROM sized, n),
sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1) t),
caps AS (SELECT *, ((source_id - 1) % 3 + 1) AS weight, 3 * source_size AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM caps),
goal AS (SELECT source, source_size, source_id, least(cap::DOUBLE, coalesce(max(CASE WHEN l * weight <= cap THEN l END) OVER () * weight, cap)) AS target FROM levels),
streams AS (SELECT r.id, doc_id, size, source_size, target, source_id, (coalesce(sum(size) OVER (PARTITION BY source_id ORDER BY bucket, doc_id NULLS FIRST, size, h NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
plan AS (SELECT source_id, source_size, round(target)::BIGINT AS take, (source_size + {block - 1}) // {block} AS n, source_size // {block} AS full_blocks FROM goal WHERE source_size > 0),
held AS (SELECT *, (take // source_size * n + (take % source_size + {block - 1}) // {block})::BIGINT AS held FROM plan),
line AS (SELECT *, coalesce(sum(held) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, (sum(held) OVER ())::BIGINT AS total FROM held),
throws AS (SELECT slot, slot // {shard_slots} AS shard, {num("'slot/' || slot")} % (SELECT max(total) FROM line) AS x FROM (SELECT unnest(range((SELECT max(total) FROM line))) AS slot) t),
drawn AS (SELECT shard, slot, source_id, held, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS number FROM throws JOIN line ON x >= low AND x < low + held),
late AS (SELECT shard, slot, row_number() OVER (ORDER BY source_id, number) - 1 AS rank FROM drawn WHERE number >= held),
free AS (SELECT source_id, number, row_number() OVER (ORDER BY source_id, number) - 1 AS rank FROM (SELECT source_id, unnest(range((SELECT count(*) FROM drawn d WHERE d.source_id = l.source_id), held)) AS number FROM line l) t),
every_slot AS (SELECT shard, source_id, number FROM drawn WHERE number < held UNION ALL SELECT shard, source_id, number FROM late JOIN free USING (rank)),
slots AS (SELECT shard, source_id, number // n AS pass, number % n AS place, full_blocks, least(source_size, take - number // n * source_size) AS given FROM every_slot JOIN plan USING (source_id)),
{steps},
dealt AS (SELECT shard, source_id, x AS block, least({block}, given - place * {block}) AS words FROM p{rounds} UNION ALL SELECT shard, source_id, place, least({block}, given - place * {block}) FROM slots WHERE place >= full_blocks),
parts AS (SELECT id, source_id, first, size, unnest(range(first // {block}, (first + size - 1) // {block} + 1)) AS block FROM streams WHERE size > 0),
took AS (SELECT id, sum(t) AS taken, count(DISTINCT shard) AS shards FROM (SELECT id, shard, greatest(0, least(first + size, p.block * {block} + words) - greatest(first, p.block * {block})) AS t FROM parts p JOIN dealt USING (source_id, block)) x WHERE t > 0 GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, 0)::BIGINT AS shards FROM streams LEFT JOIN took USING (id)"""
