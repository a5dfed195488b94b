"""Registered queries over what is kept between runs: the index, versions of paths and their contents, each beside DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import context as C
from sparkloom.operators import evidence as E
from sparkloom.operators import search as S
from sparkloom.operators import store as K
from sparkloom.operators.kept_index import KeptIndex
from sparkloom.operators.profiles import whole_profile
from sparkloom.operators.substrings import substring_links
from sparkloom.plans import store as P
from sparkloom.plans.queries import _PROFILED, ORACLE, query, table
from sparkloom.sources.files import shared_folder
from sparkloom.streaming.courses import run_courses
from sparkloom.streaming.versions import ImportStore


def _kept_index(spark, sf_dir) -> KeptIndex:
    """Built when some documents had not come yet, others read otherwise, and some were there that are gone; then brought up to date."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    i = F.col("doc_id")
    old = d.where(i % 97 != 5).withColumn("text", F.when(i % 50 == 3, F.concat(F.lit("an older text "), "text")).otherwise(F.col("text")))
    old = old.unionByName(d.where(i % 89 == 1).withColumn("doc_id", i + 1_000_000_000))
    index = KeptIndex(spark, shared_folder(spark), buckets=16)
    index.refresh(old)
    index.refresh(d)
    return index


@query(ORACLE["bm25_topk_by_source"])
def kept_index_topk(spark, sf_dir):
    scores = _kept_index(spark, sf_dir).bm25(S.query_terms(table(spark, sf_dir, "benchmark"), "item_id"))
    return S.top(scores, ["item_id", "source"], "doc_id", 5)


@query(rf"""WITH t AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents), p AS (SELECT source, doc_id, token, count(*) AS tf FROM t GROUP BY ALL),
c AS (SELECT source, sum(tf)::BIGINT AS words, count(*) AS postings, count(DISTINCT token) AS tokens FROM p GROUP BY 1), o AS (SELECT source, count(text) AS n FROM documents GROUP BY 1)
SELECT s.*, o.n AS objects, words, postings, tokens FROM ({ORACLE["index_refresh"]}) s JOIN c USING (source) JOIN o USING (source)""")
def index_refresh(spark, sf_dir):
    # what the index of each source says of itself, and what it holds once it has been refreshed
    index = _kept_index(spark, sf_dir)
    held = index.postings().groupBy("source", "token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("tf").alias("words"), F.sum("n").alias("postings"), F.count(F.lit(1)).alias("tokens"))
    told = K.refreshed(*P._indexes(spark, sf_dir), "source", 2)
    return told.join(held, "source").join(index.sizes().select("source", F.col("n_objects").alias("objects")), "source")


def _imported(spark, sf_dir) -> ImportStore:
    """Three batches of imports, one after the other."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.col("props").alias("content"), (F.col("event_id") % 11 != 0).alias("done"))
    kinds = dict(e.dtypes)
    store = ImportStore(spark, shared_folder(spark), ", ".join(f"{c} {kinds[c]}" for c in e.columns), ["user_id", "event_type"], ["ts", "event_id"], buckets=8)
    days = F.day("ts")
    for i, some in enumerate((days <= 10, days.between(11, 20), days > 20)):
        store.take(e.where(some), i)
    return store


@query(ORACLE["import_states"])
def keyed_import(spark, sf_dir):
    return _imported(spark, sf_dir).outcomes().select("event_id", "version", "status", "content_id", "supersedes", "duplicate_of")


@query(f"""WITH s AS (SELECT event_id, version, content_id FROM ({ORACLE["import_states"]}) t), v AS (SELECT DISTINCT user_id, event_type, version, sha256(props) AS hash FROM s JOIN events USING (event_id) WHERE user_id % 7 <> 0)
SELECT hash, count(*) AS versions FROM v GROUP BY 1""")
def stored_contents(spark, sf_dir):
    # one copy of each content, counted; what no path holds after some were deleted is gone
    store = _imported(spark, sf_dir)
    store.forget(store.versions.read().where("user_id % 7 = 0"), "deleted")
    return store.contents.read().select("hash", "versions")


@query(r"""WITH c AS (SELECT conv_id, turn * 4 + CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS "at", CASE WHEN length(text) % 3 = 0 THEN '' ELSE role || ' ' || length(text) END AS result FROM conversations),
b AS (SELECT *, coalesce(result, '') = '' AS bad, row_number() OVER (PARTITION BY conv_id ORDER BY "at") AS i FROM c),
s AS (SELECT *, bad AND lag(bad, 1, false) OVER w AND lag(bad, 2, false) OVER w AS stop FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY "at")),
p AS (SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY conv_id) AS first FROM s),
k AS (SELECT *, first IS NOT NULL AND i > first AS waits, string_agg(CASE WHEN NOT bad THEN result END, '|') OVER (PARTITION BY conv_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gists FROM p)
SELECT conv_id::VARCHAR AS course, "at", CASE WHEN waits THEN 'waiting' WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN first IS NOT NULL AND i >= first THEN 'paused' ELSE 'idle' END AS state, CASE WHEN NOT waits THEN coalesce(gists, '') END AS gists FROM k""")
def course_runs(spark, sf_dir):
    """Three runs of a stream over conversations, each going on from what the one before left; at most eight turns, so that all gists are kept."""
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    at = (F.col("turn") * 4 + F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)).alias("at")
    items = c.select(F.col("conv_id").cast("string").alias("course"), at, F.when(n % 3 == 0, "").otherwise(F.concat("role", F.lit(" "), n.cast("string"))).alias("text"), "turn")
    folder = shared_folder(spark)
    parts = (F.col("turn") < 2, F.col("turn").between(2, 3), F.col("turn") > 3)
    for i, some in enumerate(parts):
        items.where(some).drop("turn").write.parquet(f"{folder}/in/part={i}")
        source = spark.readStream.schema(items.drop("turn").schema).parquet(f"{folder}/in/*")
        out = run_courses(source, f"{folder}/run")
    return out.select("course", "at", "status", "state", F.array_join("gists", "|").alias("gists"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://(?:(?:www|blog|m)\.)?([^./?#]+)', 1) AS name, lower(html) AS t FROM pages), n AS (SELECT name, count(*) AS pages FROM u WHERE length(name) >= 4 GROUP BY 1)
SELECT u.page_id, n.name, n.pages FROM u JOIN n ON u.name <> n.name AND contains(u.t, lower(n.name))""")
def substring_references(spark, sf_dir):
    """Pages that name another page's host anywhere in their text, inside words too."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.regexp_extract(F.coalesce("url", F.lit("")), r"://(?:(?:www|blog|m)\.)?([^./?#]+)", 1).alias("own"))
    names = pages.where("length(own) >= 4").groupBy(F.col("own").alias("name")).agg(F.count(F.lit(1)).alias("pages"))
    links = substring_links(pages, names, "page_id", "name")
    return links.join(pages.select("page_id", "own"), "page_id").where("own <> name").join(names, "name").select("page_id", "name", "pages")


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS name, o_orderkey AS i, coalesce({c}::VARCHAR, '') AS v FROM orders" for c in _PROFILED)


@query(rf"""WITH c AS (SELECT *, CASE WHEN trim(v) = '' THEN 'missing' WHEN regexp_matches(v, '^[+-]?\d+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN 'number' WHEN regexp_matches(v, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') THEN 'date_or_datetime' ELSE 'text' END AS type FROM ({_PROFILE}) t),
s AS (SELECT name, string_agg(v, '|' ORDER BY i) AS samples FROM (SELECT name, v, min(i) AS i FROM c WHERE type <> 'missing' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY min(i)) <= 5) t GROUP BY 1)
SELECT name, count(*) AS row_count, count(*) FILTER (type = 'integer') AS integers, count(*) FILTER (type = 'number') AS numbers, count(*) FILTER (type = 'date_or_datetime') AS dates, count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'missing') AS missing, least(count(DISTINCT v), 10001) AS unique_count, coalesce(mode(CASE WHEN type <> 'missing' THEN type END), 'unknown') AS inferred, any_value(samples) AS samples
FROM c LEFT JOIN s USING (name) GROUP BY 1""")
def whole_profiles(spark, sf_dir):
    p = whole_profile(table(spark, sf_dir, "orders"), "o_orderkey")
    t = lambda k, name: F.col(f"type_counts.{k}").alias(name)
    return p.select("name", "row_count", t("integer", "integers"), t("number", "numbers"), t("date_or_datetime", "dates"), t("text", "texts"), F.col("missing_count").alias("missing"), "unique_count", "inferred", F.array_join("samples", "|").alias("samples"))


_TREE = """WITH f AS (SELECT p_partkey, p_brand, CASE right(p_brand, 1) WHEN '1' THEN 'Courses' WHEN '2' THEN p_brand || CASE WHEN p_size = 50 THEN 'x' ELSE '' END ELSE p_brand END || '/' ||
  CASE right(p_brand, 1) WHEN '3' THEN CASE WHEN p_size % 2 = 0 THEN 'Week ' || p_size || '/' ELSE 'Lec' || p_size || '/' END WHEN '4' THEN CASE WHEN p_size = 7 THEN '' ELSE p_type || '/' END ELSE p_type || '/' END || p_name || '.pdf' AS path FROM part),
s AS (SELECT *, string_split(path, '/') AS p FROM f), c AS (SELECT *, CASE WHEN len(p) >= 3 THEN p[2] END AS child FROM s),
g AS (SELECT p_brand, min(len(p)) AS least, min(p[1]) AS root, max(p[1]) AS last, count(DISTINCT child) AS children, bool_and(regexp_full_match(lower(trim(child)), '(l|lec|lecture|week|wk|module|unit|chapter)\\s*\\d+')) AS units, min(p[1]) = 'Courses' AS generic FROM c GROUP BY 1),
k AS (SELECT *, CASE WHEN least < 2 OR root <> last THEN NULL WHEN least = 2 OR children = 0 OR (NOT generic AND units) THEN 'root' WHEN generic OR children > 1 THEN 'folder' END AS kind FROM g) """


@query(_TREE + """SELECT p_partkey, CASE kind WHEN 'root' THEN root WHEN 'folder' THEN child END AS "group", CASE kind WHEN 'root' THEN 'files were selected from the folder "' || root || '"' WHEN 'folder' THEN 'files were selected from the course folder "' || child || '"' END AS reason FROM c JOIN k USING (p_brand)""")
def folder_tree_groups(spark, sf_dir):
    """Files of a brand as one selection: a folder of courses, several roots, units, files straight in the root, or folders."""
    brand, size = F.col("p_brand"), F.col("p_size")
    end, kind = F.right("p_brand", F.lit(1)), F.concat("p_type", F.lit("/"))
    root = F.when(end == "1", "Courses").when(end == "2", F.concat(brand, F.when(size == 50, "x").otherwise(""))).otherwise(brand)
    unit = F.concat(F.when(size % 2 == 0, "Week ").otherwise("Lec"), size.cast("string"), F.lit("/"))
    below = F.when(end == "3", unit).when((end == "4") & (size == 7), "").otherwise(kind)
    files = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(root, F.lit("/"), below, "p_name", F.lit(".pdf")).alias("path"))
    return K.folder_tree(files, "p_brand", "path").select("p_partkey", "group", "reason")


@query(r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '_FINAL' WHEN 1 THEN '-v2 draft' WHEN 2 THEN ' of THE ' || upper(p_type) WHEN 3 THEN '__ 3 final2.copy' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.pptx' ELSE '.pdf ' END AS t FROM part),
w AS (SELECT p_partkey, string_split(regexp_replace(array_to_string(list_filter(regexp_split_to_array(regexp_replace(trim(t), '\.[A-Za-z][A-Za-z0-9]{0,4}$', ''), '[\s_-]+'), lambda x: x <> ''), ' '), '( (v|ver|version|rev|revision|final|draft|copy|edit|updated|latest|new|fixed|done|export)[0-9]*)+$', '', 'i'), ' ') AS w FROM n)
SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN NOT regexp_matches(x, '[A-Za-z]') OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]')) THEN x WHEN i > 1 AND lower(x) IN ('a','an','and','as','at','but','by','for','from','in','into','nor','of','on','or','the','to','vs','with') THEN lower(x) ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS label FROM w""")
def deck_labels(spark, sf_dir):
    i = F.col("p_partkey")
    end = F.when(i % 5 == 0, "_FINAL").when(i % 5 == 1, "-v2 draft").when(i % 5 == 2, F.concat(F.lit(" of THE "), F.upper("p_type"))).when(i % 5 == 3, "__ 3 final2.copy").otherwise("")
    title = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), end, F.when(i % 2 == 0, ".pptx").otherwise(".pdf "))
    return table(spark, sf_dir, "part").select("p_partkey", T.deck_label(title).alias("label"))


#: A caller's catalog: labels and their other names.
_CATALOG = (("english prose", "the"), ("english prose", "of the"), ("german prose", "nicht"), ("german prose", "und der"), ("spanish prose", "para"), ("french prose", "elle"), ("advertising", "class ad"), ("no such thing", "zzzz zzzz"))
_PAGE_STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_GRAPH = rf"""WITH p AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '://(?:(?:www|blog|m)\.)?([^./?#]+)', 1) AS own, regexp_extract_all(lower(html), '[\p{{L}}\p{{N}}_]+') AS w FROM pages WHERE html IS NOT NULL),
c(label, alias) AS (VALUES {", ".join(map(str, _CATALOG))}), named AS (SELECT DISTINCT label AS token, own, page_id FROM p JOIN c ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || alias || ' ')),
words AS (SELECT DISTINCT own, page_id, unnest(w) AS token FROM p), terms AS (SELECT token FROM words WHERE length(token) >= 4 AND NOT regexp_matches(token, '^\d+$') AND token NOT IN ({_PAGE_STOP}) AND token NOT IN (SELECT label FROM c) GROUP BY 1 HAVING count(DISTINCT own) >= 2 AND count(*) BETWEEN 2 AND 500 ORDER BY count(*) DESC, token LIMIT 30),
e AS (SELECT token, own, page_id, 'curated_alias' AS kind, row_number() OVER (PARTITION BY token, own ORDER BY page_id) AS place FROM named QUALIFY place <= 6
  UNION ALL SELECT token, own, page_id, 'course_term', row_number() OVER (PARTITION BY token, own ORDER BY page_id) AS place FROM words JOIN terms USING (token) QUALIFY place <= 2),
best AS (SELECT token, kind FROM e GROUP BY 1, 2 ORDER BY kind <> 'curated_alias', count(DISTINCT own) DESC, count(*) DESC, token LIMIT 18),
n AS (SELECT own AS name, min(page_id) AS target FROM p WHERE length(own) >= 4 GROUP BY 1), l AS (SELECT own, name, min(page_id) AS page_id, any_value(target) AS target FROM p JOIN n ON own <> name AND contains(lower(html), lower(name)) GROUP BY 1, 2),
edges AS (SELECT token AS source, 'artifact-' || own AS target, 'appears_in' AS relation, array_to_string(list(page_id::VARCHAR ORDER BY place)[1:6], ' ') AS object_ids FROM e JOIN best USING (token, kind) GROUP BY 1, 2
  UNION ALL SELECT 'artifact-' || own, 'artifact-' || name, 'explicit_reference', page_id || ' ' || target FROM l
  UNION ALL SELECT a, b, 'prerequisite_candidate', '' FROM (VALUES ('english prose', 'german prose'), ('german prose', 'no such thing')) x(a, b) WHERE a IN (SELECT token FROM best) AND b IN (SELECT token FROM best)) """


def _page_graph(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.regexp_extract(F.coalesce("url", F.lit("")), r"://(?:(?:www|blog|m)\.)?([^./?#]+)", 1).alias("own")).where("text is not null")
    roots = pages.where("length(own) >= 4").groupBy(F.col("own").alias("to")).agg(F.min("page_id").alias("target"))
    links = substring_links(pages, roots, "page_id", "to").join(pages.select("page_id", "own"), "page_id").where("own <> to").groupBy("own", "to").agg(F.min("page_id").alias("page_id")).join(roots, "to")
    catalog = spark.createDataFrame(_CATALOG, "label string, alias string")
    before = spark.createDataFrame([("english prose", "german prose"), ("german prose", "no such thing")], "required string, advanced string")
    return C.concept_graph(pages, "own", "page_id", catalog, links, before)


@query(_GRAPH + "SELECT * FROM edges")
def page_graph_edges(spark, sf_dir):
    """Curated and mined concepts in the hosts whose pages hold them, hosts whose pages name other hosts, and what comes before what."""
    return _page_graph(spark, sf_dir)[1].select("source", "target", "relation", F.array_join("object_ids", " ").alias("object_ids"))


@query(_GRAPH + "SELECT token AS node, 'concept' AS node_type FROM best UNION SELECT unnest([source, target]), 'artifact' FROM edges WHERE relation = 'explicit_reference' UNION SELECT target, 'artifact' FROM edges WHERE relation = 'appears_in'")
def page_graph_nodes(spark, sf_dir):
    return _page_graph(spark, sf_dir)[0]


@query(r"""WITH RECURSIVE o AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS i, (list_reduce(list_prepend(2166136261, list_transform(list_filter(string_split(c_name, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 6)::INT AS own FROM customer),
r AS (SELECT i, own AS pick, [own] AS taken FROM o WHERE i = 1 UNION ALL SELECT o.i, list_filter(list_transform(range(0, 6), lambda s: ((o.own + s) % 6)::INT), lambda p: NOT list_contains(r.taken, p))[1],
  list_append(r.taken, list_filter(list_transform(range(0, 6), lambda s: ((o.own + s) % 6)::INT), lambda p: NOT list_contains(r.taken, p))[1]) FROM r JOIN o ON o.i = r.i + 1 WHERE o.i <= 6)
SELECT o.c_name, coalesce(r.pick, o.own) AS hue FROM o LEFT JOIN r USING (i)""")
def free_hues(spark, sf_dir):
    return K.free_hues(table(spark, sf_dir, "customer"), "c_name", T.fnv1a(F.col("c_name")) % 6, 6)
