"""Registered queries over the given tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import evidence as E
from sparkloom.operators import search as S
from sparkloom.operators import tables as X
from sparkloom.operators import vectors as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    """A table; long texts that lie in fewer splits than there are cores are dealt out first, as work on them outweighs the shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df):
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_FIRST_TOKENS = r"SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:12]) AS token FROM benchmark) t"
_SCORES = r"""
WITH words AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
index AS (SELECT source, doc_id, len(w) AS dl, token, count(*) AS tf FROM (SELECT *, unnest(w) AS token FROM words) t GROUP BY ALL),
tokens AS (_ASKED_),
stats AS (SELECT source, count(*) AS n, avg(len(w)) AS avgdl FROM words GROUP BY 1),
df AS (SELECT source, token, count(*) AS df FROM index GROUP BY 1, 2),
scores AS (SELECT item_id, source, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tokens JOIN index USING (token) JOIN df USING (source, token) JOIN stats USING (source) GROUP BY 1, 2, 3)"""


def bm25_sql(asked: str) -> str:
    """Common tables up to scores(item_id, source, doc_id, score) for the query terms of ``asked``."""
    return _SCORES.replace("_ASKED_", asked)


_BM25 = bm25_sql(_FIRST_TOKENS)


def _scores(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), S.query_terms(table(spark, sf_dir, "benchmark"), "item_id"))


@query(_BM25 + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS rank FROM scores) t WHERE rank <= 5")
def bm25_topk_by_source(spark, sf_dir):
    return S.top(_scores(spark, sf_dir), ["item_id", "source"], "doc_id", 5)


@query(_BM25 + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS i FROM scores)
SELECT * EXCLUDE i FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i > 4, score DESC, doc_id) AS rank FROM r) t WHERE rank <= 20""")
def bm25_diverse_topk(spark, sf_dir):
    return S.diverse_top(_scores(spark, sf_dir), "item_id", "source", "doc_id", 20)


_TOKENS = r"SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents"


@query(f"SELECT token, count(*) AS df, count(DISTINCT source) AS n_sources FROM ({_TOKENS}) t GROUP BY 1")
def doc_freq(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    counts = d.groupBy("token", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("n_sources"))


_STOP = ", ".join(f"'{w}'" for w in (*E.STOP_WORDS, *E.CONCEPTS))


@query(f"SELECT token, count(*) AS df, count(DISTINCT source) AS n_sources FROM ({_TOKENS}) t WHERE length(token) >= 4 AND NOT regexp_matches(token, '^\\d+$') AND token NOT IN ({_STOP}) GROUP BY 1 HAVING count(DISTINCT source) >= 2 AND count(*) BETWEEN 2 AND 500 ORDER BY df DESC, token LIMIT 30")
def mined_terms(spark, sf_dir):
    terms = doc_freq(spark, sf_dir).where(E.useful(F.col("token")) & ~F.col("token").isin(*E.CONCEPTS))
    return terms.where("n_sources >= 2 and df between 2 and 500").orderBy(F.desc("df"), "token").limit(30)


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC, value DESC")
def lww_dedupe(spark, sf_dir):
    return X.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, event_type, ts, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type, ts, value FROM (SELECT DISTINCT ON (user_id) * FROM events e WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') ORDER BY user_id, ts, event_type, value) t")
def insert_if_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    return X.insert_if_absent(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["user_id"], ["ts"])


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce({c}::VARCHAR, '') AS value FROM orders" for c in _PROFILED)


@query(rf"""WITH v AS (SELECT name, value, count(*) AS n, CASE WHEN trim(value) = '' THEN 'missing' WHEN regexp_matches(value, '^[+-]?\d+$') THEN 'integer'
  WHEN regexp_matches(value, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN 'number' WHEN regexp_matches(value, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') THEN 'date_or_datetime' ELSE 'text' END AS type FROM ({_CELLS}) c GROUP BY 1, 2),
t AS (SELECT name, type, sum(n) AS n, count(*) AS d FROM v GROUP BY 1, 2)
SELECT name, sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (type = 'missing'), 0)::BIGINT AS missing, least(sum(d), 10001)::BIGINT AS unique_count, coalesce(arg_max(type, n) FILTER (type <> 'missing'), 'unknown') AS inferred FROM t GROUP BY 1""")
def profile_columns(spark, sf_dir):
    return X.profile(table(spark, sf_dir, "orders"))


@query("SELECT l_returnflag, count(*) FILTER (l_quantity >= 10 AND l_discount < 0.05 AND l_linenumber <> 2) AS countifs, round(coalesce(sum(l_extendedprice) FILTER (l_quantity >= 10 AND l_discount < 0.05 AND l_linenumber <> 2), 0), 2) AS sumifs FROM lineitem GROUP BY 1")
def countifs_sumifs(spark, sf_dir):
    return X.countifs_sumifs(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [("l_quantity", ">=10"), ("l_discount", "<0.05"), ("l_linenumber", "<>2")])


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 6) AS average, min(o_totalprice) AS min, max(o_totalprice) AS max, round(median(o_totalprice), 6) AS median, count(o_totalprice) AS count, round(stddev_samp(o_totalprice), 6) AS stdev FROM orders GROUP BY 1")
def sheet_aggregates(spark, sf_dir):
    return X.sheet_aggregates(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) SELECT doc_id, content_hash, nullif(min(doc_id) OVER (PARTITION BY content_hash), doc_id) AS duplicate_of FROM h")
def exact_duplicates(spark, sf_dir):
    return X.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


_CHAIN = "WITH c AS (SELECT user_id, event_type, ts, event_id, props, coalesce((props <> lag(props) OVER w)::INT, 1) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), v AS (SELECT user_id, event_type, event_id, (sum(n) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS version, n = 0 AS unchanged FROM c) "


def _versions(spark, sf_dir):
    return X.versions(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props").select("user_id", "event_type", "event_id", "version", "unchanged")


@query(_CHAIN + "SELECT * FROM v")
def version_chain(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(_CHAIN + "SELECT user_id, event_type, max(version) AS version, arg_max(event_id, version) AS event_id FROM (SELECT * FROM v WHERE NOT unchanged) t GROUP BY 1, 2")
def current_versions(spark, sf_dir):
    v = _versions(spark, sf_dir).where("not unchanged")
    return v.groupBy("user_id", "event_type").agg(F.max("version").alias("version"), F.max_by("event_id", "version").alias("event_id"))


@query("SELECT conv_id, turn, role, (row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST) - 1) AS position, lag(role) OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST) AS previous_role FROM conversations")
def reading_order(spark, sf_dir):
    return X.reading_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"], "role", "previous_role")


@query("""WITH b AS (SELECT conv_id, turn, least(length(text), 300) AS one, coalesce(sum(least(length(text), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM conversations)
SELECT conv_id, turn, used_before, least(one, 1200 - used_before)::BIGINT AS taken FROM b WHERE 1200 - used_before > 0 AND one > 0""")
def char_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return X.budget_prefix(c, "conv_id", ["turn"], "size", 1200, 300).select("conv_id", "turn", "used_before", "taken")


@query("""WITH t AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS seat FROM t WHERE turn <= 2),
b AS (SELECT *, coalesce(sum(least(n_chars, 900)) OVER (PARTITION BY lang ORDER BY seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM s WHERE seat <= 8)
SELECT lang, source, doc_id, turn, seat, least(n_chars, 900, 5000 - used) AS taken FROM b WHERE least(n_chars, 5000 - used) > 0""")
def round_robin_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return X.round_robin(d, "lang", "source", "doc_id", "n_chars", 2, 8, 5000, 900).select("lang", "source", "doc_id", "turn", "seat", "taken")


@query("""WITH done AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '')
SELECT c.conv_id, count(*) AS total, count(d.turn) AS explained, min(c.turn) FILTER (d.turn IS NULL) AS next_turn,
  CASE WHEN count(d.turn) >= count(*) THEN 'done' WHEN count(d.turn) > 0 THEN 'partial' ELSE 'idle' END AS state
FROM conversations c LEFT JOIN done d ON c.conv_id = d.conv_id AND c.turn = d.turn GROUP BY 1""")
def progress_state(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    done = (F.col("role") == "assistant") & (F.trim("text") != "")
    n, k = F.count(F.lit(1)), F.count_if(done)
    return c.groupBy("conv_id").agg(n.alias("total"), k.alias("explained"), F.min(F.when(~F.coalesce(done, F.lit(False)), F.col("turn"))).alias("next_turn"), F.when(k >= n, "done").when(k > 0, "partial").otherwise("idle").alias("state"))


@query(r"""SELECT doc_id, CASE WHEN len(w) <= 30 THEN t ELSE array_to_string(w[1:30], ' ') || ' [...]' END AS short, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\x{00a0}', ' ', 'g'), '\x{200b}', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normal_md5,
  md5(regexp_replace(regexp_replace('Authorization : Bearer x' || text, 'sk-[A-Za-z0-9]{8,}', 'sk-***REDACTED***', 'g'), '(authorization\s*[:=]\s*)(bearer\s+)?\S+', '\1sk-***REDACTED***', 'gi')) AS scrubbed_md5, md5(coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'course')) AS slug_md5
FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents) d""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(t, 30).alias("short"), F.md5(T.normalise(t).cast("binary")).alias("normal_md5"), F.md5(T.scrub(F.concat(F.lit("Authorization : Bearer x"), t)).cast("binary")).alias("scrubbed_md5"), F.md5(T.slug(t).cast("binary")).alias("slug_md5"))


_FEATURES = r"""SELECT {key} AS k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS t FROM (SELECT {key}, regexp_extract_all(lower(left(text, 8000)), '[\p{{L}}\p{{N}}_]+') AS w FROM {name}) d"""


def hashed_sql(name: str, key: str) -> str:
    """k, b, v: hashed words and pairs of words of each text."""
    return f"""(SELECT k, b, sum(v) AS v FROM (SELECT k, (('0x' || md5(t)[1:8])::BIGINT % 384)::INT AS b, CASE WHEN ('0x' || md5(t)[9:10])::BIGINT % 2 = 1 THEN -1 ELSE 1 END * (1 + ln(count(*))) AS v
  FROM ({_FEATURES.format(name=name, key=key)}) f GROUP BY k, t) x GROUP BY 1, 2)"""


@query(f"SELECT k AS doc_id, count(*) AS buckets, round(sqrt(sum(v * v)), 6) AS norm, arg_max(b, (round(abs(v), 6), b)) AS top_bucket FROM {hashed_sql('documents', 'doc_id')} h GROUP BY 1")
def hash_embed_docs(spark, sf_dir):
    h = V.hash_places(table(spark, sf_dir, "documents"), "doc_id").where("size(b) > 0")
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)), 6)
    top = F.array_max(F.transform(F.arrays_zip("b", "v"), lambda p: F.struct(F.round(F.abs(p["v"]), 6).alias("v"), p["b"].alias("b"))))["b"]
    return h.select("doc_id", F.size("b").cast("long").alias("buckets"), norm.alias("norm"), top.alias("top_bucket"))
