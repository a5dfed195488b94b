"""Registered queries over imports, organisation, replaced tables and derived indexes, each beside DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import store as K
from sparkloom.plans.queries import query, table
from sparkloom.sources.files import shared_folder

_PATH = "user_id || '/' || event_type"


@query(f"""WITH c AS (SELECT user_id, event_type, event_id, ts, props, event_id % 11 <> 0 AS done, sha256(props) AS h, {_PATH} AS path, coalesce((props IS DISTINCT FROM lag(props) OVER w)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
v AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL THEN 1 ELSE fresh END AS f FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version, sha256(h || chr(0) || path)[1:24] AS id FROM v),
s AS (SELECT *, coalesce(bool_or(done) OVER (PARTITION BY user_id, event_type, version ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM r),
heads AS (SELECT user_id, event_type, version + 1 AS version, id AS supersedes FROM r WHERE f = 1), firsts AS (SELECT h, arg_min(path, (ts, event_id)) AS first FROM r GROUP BY 1)
SELECT event_id, version, CASE WHEN before THEN 'unchanged' WHEN NOT done THEN 'failed' WHEN f = 0 THEN 'retried' WHEN version > 1 THEN 'superseding' ELSE 'new' END AS status, id AS content_id, supersedes, nullif(first, path) AS duplicate_of
FROM s LEFT JOIN heads USING (user_id, event_type, version) JOIN firsts USING (h)""")
def import_states(spark, sf_dir):
    return _states(spark, sf_dir).select("event_id", "version", "status", "content_id", "supersedes", "duplicate_of")


def _states(spark, sf_dir):
    return K.import_states(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props", F.col("event_id") % 11 != 0)


_LAST = f"SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) t"


@query(f"""WITH r AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events)
SELECT event_id, supersedes FROM r WHERE event_id NOT IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL)""")
def unsuperseded(spark, sf_dir):
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return K.current_only(table(spark, sf_dir, "events").select("event_id", before.alias("supersedes")), "event_id", "supersedes")


@query(f"SELECT e.user_id, e.event_type, count(*) AS objects, round(sum(value), 6) AS total FROM events e WHERE event_id IN (SELECT event_id FROM ({_LAST} WHERE i <= 3) t) GROUP BY 1, 2")
def current_objects(spark, sf_dir):
    # objects of artifacts that still count: a semi join on their keys
    e = table(spark, sf_dir, "events")
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    kept = e.withColumn("i", own).where("i <= 3").select("event_id")
    return e.join(kept, "event_id", "left_semi").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("objects"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH gone AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 500 = 0), l AS (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = e.user_id AND g.event_type = e.event_type)),
d AS (SELECT DISTINCT props FROM events e WHERE EXISTS (SELECT 1 FROM gone g WHERE g.user_id = e.user_id AND g.event_type = e.event_type) AND props NOT IN (SELECT props FROM l))
SELECT user_id::VARCHAR AS what, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT props, 0 FROM d""")
def delete_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left, gone = K.delete_paths(e, e.where("event_id % 500 = 0"), ["user_id", "event_type"], "props")
    return left.groupBy(F.col("user_id").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(gone.select(F.col("props").alias("what"), F.lit(0).cast("long").alias("n")))


@query("""WITH n AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1), o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1),
k AS (SELECT user_id, event_id, row_number() OVER (ORDER BY event_id, user_id) - 1 AS place FROM o WHERE user_id NOT IN (SELECT user_id FROM n))
SELECT * FROM k UNION ALL SELECT user_id, event_id, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY event_id, user_id) - 1 FROM n""")
def upsert_to_end(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return K.upsert_last(old, e.where("event_type = 'purchase'").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "place")


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def published_table(spark, sf_dir):
    # two versions, one after the other: readers see the whole second one
    path, e = shared_folder(spark), table(spark, sf_dir, "events")
    K.publish(e.where("event_id % 2 = 0"), path)
    K.publish(e, path)
    return K.published(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT role, count(*) AS n, sum(turn)::BIGINT AS turns FROM (SELECT role, turn FROM conversations WHERE role <> 'user' UNION ALL SELECT role, turn + 100 FROM conversations WHERE role = 'user' AND turn = 0) t WHERE role <> 'system' GROUP BY 1")
def replaced_parts(spark, sf_dir):
    # the part of one role is replaced, that of another one dropped: no other file is touched
    path, c = shared_folder(spark), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    K.replace_parts(c, path, "role")
    K.replace_parts(c.where("role = 'user' and turn = 0").withColumn("turn", F.col("turn") + 100), path, "role")
    K.drop_part(spark, path, "role", "system")
    rows = spark.read.schema("conv_id long, turn long, role string").parquet(path)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


def digest_sql(where: str = "true") -> str:
    """source, objects, fingerprint: the digest of digests of ranges of 1,024 ids, three levels deep."""
    return f"""(SELECT source, sum(n)::BIGINT AS objects, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM (SELECT source, b // 1024 AS b, sum(n) AS n, sha256(string_agg(h, '' ORDER BY b)) AS h FROM (SELECT source, doc_id // 1024 AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h
  FROM (SELECT source, doc_id, sha256(doc_id || ':' || text) AS h FROM documents WHERE {where}) t GROUP BY 1, 2) u GROUP BY 1, 2) v GROUP BY 1)"""


def _digest(docs):
    return K.digests(docs, "source", "doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").cast("binary"), 256))


@query(f"SELECT * FROM {digest_sql()} d")
def index_fingerprint(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"))


_STORED = f"(SELECT source, CASE WHEN regexp_extract(source, '[0-9]+$')::INT % 4 = 1 THEN 1 ELSE 2 END AS schema, fingerprint FROM {digest_sql('doc_id % 97 <> 5')} d WHERE regexp_extract(source, '[0-9]+$')::INT % 4 <> 0)"
_STATUS = f"""SELECT n.source, n.fingerprint, concat_ws('; ', CASE WHEN s.source IS NULL THEN 'index has not been built' END, CASE WHEN s.schema <> 2 THEN 'index schema changed' END, CASE WHEN s.fingerprint <> n.fingerprint THEN 'source versions changed' END) AS reasons FROM {digest_sql()} n LEFT JOIN {_STORED} s ON s.source = n.source"""


def _indexes(spark, sf_dir):
    # what was stored before some documents came, under an older schema for some sources, and not at all for others
    d, number = table(spark, sf_dir, "documents"), F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    stored = _digest(d.where("doc_id % 97 <> 5")).where(number % 4 != 0).withColumn("schema", F.when(number % 4 == 1, 1).otherwise(2))
    return _digest(d).select("source", "fingerprint"), stored


@query(f"SELECT source, reasons = '' AS ready, reasons FROM ({_STATUS}) t")
def index_status(spark, sf_dir):
    return K.index_status(*_indexes(spark, sf_dir), "source", 2)


@query(f"SELECT source, 2 AS schema, fingerprint, reasons <> '' AS rebuilt FROM ({_STATUS}) t")
def index_refresh(spark, sf_dir):
    return K.refreshed(*_indexes(spark, sf_dir), "source", 2)


_FOLDERS = """WITH o AS (SELECT o_orderkey, trim(o_orderpriority) AS folder, [o_custkey, o_custkey + 1] AS ids, CASE WHEN o_orderkey % 3 = 0 THEN 'because  of ' || o_orderstatus ELSE '' END AS reason FROM orders),
l AS (SELECT folder, o_orderkey, unnest(ids) AS c_custkey, generate_subscripts(ids, 1) AS pos FROM o), k AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0),
a AS (SELECT c_custkey, arg_min(folder, (o_orderkey, pos)) AS folder FROM l WHERE c_custkey IN (SELECT c_custkey FROM k) GROUP BY 1),
r AS (SELECT folder, arg_max(trim(regexp_replace(reason, ' +', ' ', 'g')), o_orderkey) AS reason FROM o WHERE reason <> '' AND folder IN (SELECT folder FROM a) GROUP BY 1),
f AS (SELECT c.c_custkey, coalesce(a.folder, '') AS folder, coalesce(reason, '') AS folder_reason FROM customer c LEFT JOIN a ON a.c_custkey = c.c_custkey LEFT JOIN r ON r.folder = a.folder) """


def _filed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("because  of "), "o_orderstatus")).otherwise("")
    folders = o.select("o_orderkey", T.folder_name(F.col("o_orderpriority")).alias("folder"), F.array("o_custkey", F.col("o_custkey") + 1).alias("ids"), reason.alias("reason"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return K.filed(c, *K.assigned(folders, c.where("c_custkey % 3 <> 0"), "c_custkey", ["o_orderkey"]), "c_custkey")


@query(_FOLDERS + "SELECT c_custkey, folder, folder_reason FROM f")
def folder_assignments(spark, sf_dir):
    return _filed(spark, sf_dir).select("c_custkey", "folder", "folder_reason")


@query(_FOLDERS + ", g AS (SELECT CASE WHEN folder = '' THEN 'Unfiled' ELSE folder END AS folder, count(*) AS files, coalesce(arg_min(folder_reason, c_custkey) FILTER (folder_reason <> ''), '') AS reason FROM f GROUP BY 1) SELECT *, row_number() OVER (ORDER BY folder = 'Unfiled', folder) AS place FROM g")
def folder_overview(spark, sf_dir):
    return K.folder_overview(_filed(spark, sf_dir), "c_custkey")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def unknown_ids(spark, sf_dir):
    return K.unknown_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0"), "c_custkey")


_CODE = r"upper(regexp_extract(n, '\b([A-Za-z]{2,6})\s*[-_ ]?\s*(\d{3,5}[A-Za-z]?)\b', 1) || regexp_extract(n, '\b([A-Za-z]{2,6})\s*[-_ ]?\s*(\d{3,5}[A-Za-z]?)\b', 2))"


@query(rf"""WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) || '_' || (1000 + p_size) || '-notes.pdf' ELSE p_name || ' ' || p_partkey || '.pdf' END AS name FROM part),
c AS (SELECT p_partkey, name, regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[_\-]+', ' ', 'g') AS n FROM f), k AS (SELECT *, nullif({_CODE}, '') AS code, lower(trim(regexp_replace(n, '\s+', ' ', 'g'))) AS stem FROM c),
s AS (SELECT *, regexp_extract(stem, '^(.{{3,}}?\S)', 1) AS key FROM k WHERE code IS NULL), e AS (SELECT key, min(stem) AS a, max(stem) AS b, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT key, n, rtrim(left(a, coalesce((SELECT max(i) FROM range(1, 200) t(i) WHERE i <= length(a) AND left(a, i) = left(b, i)), 0)::INT)) AS prefix FROM e),
g AS (SELECT code AS title, p_partkey FROM k WHERE code IS NOT NULL UNION ALL SELECT CASE WHEN p.n > 1 THEN prefix ELSE name END, p_partkey FROM s JOIN p USING (key))
SELECT title, count(*) AS files, min(p_partkey) AS first FROM g GROUP BY 1""")
def bulk_groups(spark, sf_dir):
    named = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower("p_type"), F.lit("_"), (F.col("p_size") + 1000).cast("string"), F.lit("-notes.pdf"))).otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".pdf")))
    f = table(spark, sf_dir, "part").select("p_partkey", named.alias("name")).withColumn("code", K.course_code(F.col("name")))
    rest = K.shared_prefix_groups(f.where("code is null"), "name")
    every = f.where("code is not null").select(F.col("code").alias("title"), "p_partkey").unionByName(rest.select(F.col("group").alias("title"), "p_partkey"))
    return every.groupBy("title").agg(F.count(F.lit(1)).alias("files"), F.min("p_partkey").alias("first"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(p_name, ' ', '_') || '-v' || p_size || '.final.pdf', '\.[^.]+$', ''), '[_-]+', ' ', 'g')) AS title FROM part""")
def display_titles(spark, sf_dir):
    name = F.concat(F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-v"), F.col("p_size").cast("string"), F.lit(".final.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", T.display_title(name).alias("title"))


@query("""WITH d AS (SELECT conv_id, greatest(count(*) - conv_id % 3, 0) AS n, count(*) FILTER (role = 'assistant' AND turn >= 0) AS k FROM conversations GROUP BY 1)
SELECT conv_id, n, k, CASE WHEN conv_id % 17 = 0 THEN 'running' WHEN conv_id % 13 = 0 THEN 'paused' WHEN conv_id % 11 = 0 THEN 'error' WHEN n > 0 AND k >= n THEN 'done' WHEN k > 0 THEN 'partial' ELSE 'idle' END AS state FROM d""")
def course_rows(spark, sf_dir):
    c, i = table(spark, sf_dir, "conversations"), F.col("conv_id")
    d = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("role") == "assistant") & (F.col("turn") >= 0)).alias("k")).withColumn("n", F.greatest(F.col("all") - i % 3, F.lit(0)))
    stored = F.when(i % 13 == 0, "paused").when(i % 11 == 0, "error").otherwise("idle")
    return d.select("conv_id", "n", "k", K.shown_state(i % 17 == 0, stored, F.col("n"), F.col("k")).alias("state"))


@query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, 'No syllabus or programme document was provided for ' || source || ', so this description is drawn from the imported material alone. The course holds ' || count(*) || ' decks and about ' || sum(n) || ' slides, in this order: ' || string_agg('Deck ' || lang, ', ' ORDER BY lang) || '. Drop the syllabus in and it can be described properly.' AS overview FROM d GROUP BY 1""")
def fallback_overviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return K.fallback_overview(d, "source", F.concat(F.lit("Deck "), "lang"), "n", ["lang"])


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS now, list_sort(list(DISTINCT event_type) FILTER (event_id % 3 > 0)) AS was, max(CASE WHEN user_id % 4 = 0 THEN '' ELSE 'known' END) AS overview FROM events GROUP BY 1)
SELECT user_id, NOT (now IS NOT DISTINCT FROM was AND trim(overview) <> '') AS rebuild FROM a""")
def overview_rebuilds(spark, sf_dir):
    # the sources of an overview against those there are now, as sets; an empty overview is always written again
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("now"), F.sort_array(F.collect_set(F.when(F.col("event_id") % 3 > 0, F.col("event_type")))).alias("was"))
    overview = F.when(F.col("user_id") % 4 == 0, "").otherwise("known")
    return e.select("user_id", (~((F.col("now") == F.col("was")) & (F.trim(overview) != ""))).alias("rebuild"))


@query("""WITH a AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS i FROM a)
SELECT DISTINCT f.h[1:12] AS file_id, d.doc_id, CASE WHEN d.lang = 'en' THEN '' ELSE d.lang END AS folder FROM a f JOIN d ON d.h[1:12] = f.h[1:12] AND d.i = 1""")
def lecture_of_deck(spark, sf_dir):
    # a deck knows the first twelve signs of its file's digest; of several files the original counts
    a = table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12).alias("file_id")).where("file_id is not null")
    return a.groupBy("file_id").agg(F.min(F.struct("doc_id", "lang")).alias("f")).select("file_id", "f.doc_id", F.when(F.col("f.lang") == "en", "").otherwise(F.col("f.lang")).alias("folder"))


@query("""WITH r AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events), a AS (SELECT event_id, value FROM events WHERE event_id % 3 = 0)
SELECT r.event_id, own.event_id IS NOT NULL AS present, own.event_id IS NULL AND prev.event_id IS NOT NULL AS stale, CASE WHEN own.event_id IS NULL THEN prev.event_id END AS previous, coalesce(own.value, prev.value) AS summary FROM r LEFT JOIN a own ON own.event_id = r.event_id LEFT JOIN a prev ON prev.event_id = r.before""")
def audit_status(spark, sf_dir):
    # a version without an audit of its own shows the one before, as stale
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("before"))
    a = e.where("event_id % 3 = 0").select("event_id", "value")
    out = r.join(a.select("event_id", F.col("value").alias("own")), "event_id", "left").join(a.select(F.col("event_id").alias("before"), F.col("value").alias("prev"), F.col("event_id").alias("p")), "before", "left")
    return out.select("event_id", F.col("own").isNotNull().alias("present"), (F.col("own").isNull() & F.col("p").isNotNull()).alias("stale"), F.when(F.col("own").isNull(), F.col("p")).alias("previous"), F.coalesce("own", "prev").alias("summary"))


@query("SELECT u.conv_id, u.turn, u.role, a.conv_id IS NOT NULL AS has_explanation FROM conversations u LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role <> 'assistant'")
def slides_with_explanations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    told = c.where("role = 'assistant' and trim(text) <> ''").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("told")).distinct()
    return c.where("role <> 'assistant'").join(told, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce("told", F.lit(False)).alias("has_explanation"))


@query("""WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 9 END AS rank FROM events) SELECT user_id, arg_min(event_id, (rank, ts, event_id)) AS event_id, arg_min(event_type, (rank, ts, event_id)) AS event_type FROM p GROUP BY 1""")
def target_roots(spark, sf_dir):
    # the object that stands for a file: of the kind that is preferred, else the first
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).otherwise(9)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct(rank.alias("rank"), "ts", "event_id", "event_type")).alias("r")).select("user_id", "r.event_id", "r.event_type")


@query("WITH d AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 UNION SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '') SELECT conv_id, count(*) AS done, min(turn) AS first FROM d GROUP BY 1")
def done_union(spark, sf_dir):
    # what a checkpoint says is done, and what has a stored result
    c = table(spark, sf_dir, "conversations")
    both = c.where("turn % 2 = 0").select("conv_id", "turn").union(c.where("role = 'assistant' and trim(text) <> ''").select("conv_id", "turn")).distinct()
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("done"), F.min("turn").alias("first"))


@query("SELECT doc_id, state, row_number() OVER (ORDER BY state = 'mismatch' DESC, state = 'verified', doc_id) AS place FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'unknown' WHEN n_chars + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END = length(text) THEN 'verified' ELSE 'mismatch' END AS state FROM documents) t QUALIFY place <= 12")
def worst_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = F.when(F.col("doc_id") % 10 == 4, "unknown").when(F.col("n_chars") + F.when(F.col("doc_id") % 50 == 7, 1).otherwise(0) == F.length("text"), "verified").otherwise("mismatch")
    order = [F.col("state") != "mismatch", F.col("state") == "verified", F.col("doc_id")]
    best = d.select("doc_id", state.alias("state")).orderBy(*order).limit(12)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # twelve rows


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def newest_first(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("place"))


@query("WITH f AS (SELECT user_id, props, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, props, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f) t WHERE place <= 12")
def selected_sources(spark, sf_dir):
    # each thing once, at its first place; then the first twelve
    f = table(spark, sf_dir, "events").groupBy("user_id", "props").agg(F.min("event_id").alias("first"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("place <= 12").select("user_id", "props", "place")
