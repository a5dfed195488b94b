"""Registered queries over located evidence, citations, retrieved context and the concept graph, each beside DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.ranks import running
from sparkloom.operators import context as C
from sparkloom.operators import evidence as E
from sparkloom.operators import search as S
from sparkloom.operators import vectors as V
from sparkloom.plans.evidence import _EVIDENCE
from sparkloom.plans.queries import _BM25, ORACLE, _scores, mined_terms, query, table
from sparkloom.plans.texts import prerequisites


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 1 THEN 'page ' || l_partkey WHEN 2 THEN 'slide ' || l_suppkey WHEN 3 THEN 'note ' || l_linenumber END AS a, CASE WHEN l_quantity >= 40 THEN 'block ' || (l_quantity::INT + 1) END AS b,
  CASE l_linenumber % 7 WHEN 4 THEN 'sheet ' || l_returnflag || ', B' || l_linenumber WHEN 5 THEN 'notebook cell ' || (l_linenumber + 1) || CASE WHEN l_discount > 0.05 THEN ', output 1' ELSE '' END WHEN 6 THEN 'field l_tax' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(', ', a, b, c), ''), CASE WHEN l_orderkey % 2 = 0 THEN 'row ' || l_orderkey END, 'data row') AS label FROM l""")
def locator_labels(spark, sf_dir):
    n, of = F.col("l_linenumber"), lambda k, c: F.when(F.col("l_linenumber") % 7 == k, c)
    places = {"page": of(1, F.col("l_partkey")), "slide": of(2, F.col("l_suppkey")), "note": of(3, n), "block": F.when(F.col("l_quantity") >= 40, F.col("l_quantity").cast("int")), "sheet": of(4, F.col("l_returnflag")), "cell_range": of(4, F.concat(F.lit("B"), n.cast("string")))}
    places |= {"notebook_cell": of(5, n), "output": of(5, F.when(F.col("l_discount") > 0.05, F.lit(0))), "dataset_field": of(6, F.lit("l_tax"))}
    fragment = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("row "), F.col("l_orderkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.locator_label(places, F.lit("data_row"), fragment).alias("label"))


@query(r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CASE page_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'dataset' ELSE 'prompt' END AS kind, CASE WHEN page_id % 4 = 0 THEN '' ELSE '{"url": "' || coalesce(url, '') || '"}' END AS data FROM pages),
t AS (SELECT *, regexp_replace(html, '^\s+|\s+$', '', 'g') AS plain FROM p)
SELECT page_id, md5(left(concat_ws(chr(10), nullif(url, ''), kind, 'page ' || page_id, nullif(data, ''), nullif(html, '')), 8000)) AS indexed_md5,
  md5(left(concat_ws(chr(10), 'Object type: ' || kind, 'Source location: page ' || page_id, CASE WHEN data <> '' THEN 'Structured data:' || chr(10) || data END, CASE WHEN plain <> '' THEN 'Extracted text:' || chr(10) || plain END), 3000)) AS evidence_md5,
  left(regexp_replace(CASE WHEN kind = 'dataset' AND data <> '' THEN data WHEN plain <> '' THEN plain ELSE data END, '\s+', ' ', 'g'), 320) AS snippet FROM t""")
def object_texts(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "page").when(F.col("page_id") % 3 == 1, "dataset").otherwise("prompt")
    data = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit('{"url": "'), F.coalesce("url", F.lit("")), F.lit('"}')))
    label, html = C.locator_label({"page": F.col("page_id")}, kind), F.col("html")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", md5(C.object_text(F.col("url"), kind, label, data, html)).alias("indexed_md5"), md5(C.evidence_text(kind, label, data, html)).alias("evidence_md5"), C.snippet(kind, data, html).alias("snippet"))


_ANSWERS = r"""WITH e AS (SELECT conv_id, turn, role, left(concat_ws(chr(10), 'Object type: ' || role, 'Source location: slide ' || turn, CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' THEN 'Extracted text:' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') END), 3000) AS t FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS number FROM e),
b AS (SELECT *, 12000 - coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM n WHERE number <= 12),
c AS (SELECT conv_id, turn, role, number, left(left(t, room::INT), 240) AS quote FROM b WHERE room > 0)"""


@query(_ANSWERS + " SELECT conv_id, number, turn, role, quote, 'slide ' || turn AS label FROM c")
def cited_evidence(spark, sf_dir):
    return _cited(table(spark, sf_dir, "conversations")).select("conv_id", "number", "turn", "role", "quote", "label")


def _cited(conversations):
    label = C.locator_label({"slide": F.col("turn")}, F.col("role"))
    e = conversations.select("conv_id", "turn", "role", label.alias("label"), C.evidence_text(F.col("role"), label, F.lit(""), F.col("text")).alias("text"))
    return C.citations(e, "conv_id", ["turn", "role"])


@query(_ANSWERS + """, k AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1), r AS (SELECT conv_id, n, CASE conv_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN n + 1 ELSE n END AS cited FROM k)
SELECT conv_id, n AS citations, conv_id % 5 <> 0 AND cited BETWEEN 1 AND n AS valid FROM r""")
def answer_envelopes(spark, sf_dir):
    # answers that cite none, the first, one too many or the last of their sources; every fifth has no citation at all
    n = _cited(table(spark, sf_dir, "conversations")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("citations"))
    cited = F.when(F.col("conv_id") % 4 == 0, F.lit(0)).when(F.col("conv_id") % 4 == 1, F.lit(1)).when(F.col("conv_id") % 4 == 2, F.col("citations") + 1).otherwise(F.col("citations"))
    answer = F.when(F.col("conv_id") % 5 == 0, F.lit("It is so.")).otherwise(F.concat(F.lit("It is so [S"), cited.cast("string"), F.lit("].")))
    return n.select("conv_id", "citations", C.cites_validly(answer, F.col("citations")).alias("valid"))


_COLLAPSE = r"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(rf"""WITH s AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) END AS body FROM conversations),
t AS (SELECT conv_id, turn, role, concat_ws(chr(10), nullif(role, ''), nullif({_COLLAPSE.format(c='text')}, ''), nullif(body, '')) AS t FROM s),
w AS (SELECT conv_id, turn, role, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t, regexp_split_to_array(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM t)
SELECT conv_id, turn, role, md5(CASE WHEN len(w) <= 300 THEN t ELSE array_to_string(w[1:300], ' ') || ' [...]' END) AS index_md5 FROM w""")
def index_texts(spark, sf_dir):
    body = F.when(F.col("role") == "user", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    c = table(spark, sf_dir, "conversations").withColumn("body", body)
    return c.select("conv_id", "turn", "role", F.md5(C.index_text(F.col("role"), F.col("text"), F.col("body")).cast("binary")).alias("index_md5"))


@query(rf"""WITH f AS (SELECT conv_id, turn, role, {_COLLAPSE.format(c='text')} AS t FROM conversations),
u AS (SELECT *, string_split(CASE WHEN instr(t, '. ') > 1 THEN left(t, instr(t, '. ')) WHEN instr(t, '? ') > 1 THEN left(t, instr(t, '? ')) WHEN instr(t, '! ') > 1 THEN left(t, instr(t, '! ')) ELSE t END, ' ') AS w FROM f)
SELECT conv_id, turn, role, '- Slide ' || (turn + 1) || ': ' || CASE WHEN role = 'system' THEN 'Slide ' || (turn + 1) ELSE role END || CASE WHEN t = '' THEN '' ELSE ': ' || array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN ' [...]' ELSE '' END END AS gist FROM u""")
def gist_lines(spark, sf_dir):
    heading = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.gist(F.col("turn"), heading, F.col("text")).alias("gist"))


#: Courses are labels, decks are runs of 25 vectors, a chunk's text is the document of the same number; every seventh deck is unknown.
_CONTEXT = r"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT label AS course, vec_id AS chunk_id, vec_id // 25 AS deck, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
s AS (SELECT course, text AS summary FROM (SELECT course, text, row_number() OVER (PARTITION BY course ORDER BY chunk_id) AS i FROM c) t WHERE i = 1),
o AS (SELECT course, chunk_id AS query_id, position, CASE WHEN lag(length(text)) OVER w > 0 THEN lag(chunk_id) OVER w END AS previous FROM c WINDOW w AS (PARTITION BY course ORDER BY chunk_id)),
a AS (SELECT * FROM o WHERE query_id % 50 = 0),
h AS (SELECT * FROM (SELECT q.vec_id AS query_id, x.vec_id AS chunk_id, round(list_cosine_similarity(q.v, x.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, x.v), 6) DESC, x.vec_id) AS rank FROM v q JOIN v x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0) t WHERE rank <= 12),
g AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS own FROM c), gs AS (SELECT course, list_distinct(regexp_extract_all(lower(summary), '[\p{L}\p{N}_]+')) AS said FROM s),
fresh AS (SELECT g.course, chunk_id, position AS pos, text FROM g JOIN gs USING (course) WHERE deck % 7 <> 3 AND len(own) > 0 AND (len(said) = 0 OR len(list_intersect(own, said)) / len(own) <= 0.7)),
near AS (SELECT query_id, chunk_id, 'Related earlier slide' AS relation, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM h JOIN a USING (query_id) JOIN fresh USING (course, chunk_id) WHERE score > 0 AND pos < position AND chunk_id IS DISTINCT FROM previous),
kept AS (SELECT * FROM near WHERE r <= 4 UNION ALL SELECT query_id, chunk_id, 'Immediately previous', text, 0 FROM a JOIN c ON c.chunk_id = previous),
cut AS (SELECT query_id, chunk_id, relation, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM kept),
words AS (SELECT *, regexp_split_to_array(t, '\s+') AS w FROM cut),
found AS (SELECT query_id, place, chunk_id, relation, CASE WHEN len(w) <= 200 THEN t ELSE array_to_string(w[1:200], ' ') || ' [...]' END AS text FROM words) """


def _found(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("course"), "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"))
    # places are found on narrow rows, over ranges of all courses; texts are joined after
    placed = running(e.select("course", F.col("vec_id").alias("chunk_id")), ["course", "chunk_id"], out="at")
    starts = placed.groupBy(F.col("course").alias("_c")).agg(F.min("at").alias("start"))
    placed = placed.join(starts, F.col("course").eqNullSafe(F.col("_c"))).withColumn("position", F.col("at") - F.col("start") + 1).drop("_c", "start")
    chunks = placed.join(d.withColumnRenamed("vec_id", "chunk_id"), "chunk_id", "left").select("course", "chunk_id", F.floor(F.col("chunk_id") / 25).alias("deck"), "at", "position", F.coalesce("text", F.lit("")).alias("text"))
    before = chunks.where(F.length("text") > 0).select((F.col("at") + 1).alias("at"), F.col("chunk_id").alias("previous"))
    asked = chunks.where("chunk_id % 50 = 0").join(before, "at", "left").select(F.col("chunk_id").alias("query_id"), "course", "position", F.when(F.col("position") > 1, F.col("previous")).alias("previous"))
    chunks = chunks.drop("at")
    hits = V.cosine_topk(e.where("vec_id % 50 = 0"), e, 12, exclude_self=True, part="course").withColumnRenamed("vec_id", "chunk_id")
    decks = chunks.where("deck % 7 <> 3").select("course", "deck").distinct()
    summaries = chunks.where("position = 1").select("course", F.col("text").alias("summary"))
    return C.retrieved_context(hits, asked, chunks, decks, summaries)


@query(_CONTEXT + "SELECT query_id, place, chunk_id, relation, md5(text) AS text_md5 FROM found")
def retrieval_context(spark, sf_dir):
    return _found(spark, sf_dir).select("query_id", "place", "chunk_id", "relation", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_CONTEXT + r""", lines AS (SELECT query_id, string_agg('- ' || relation || ', Deck ' || (chunk_id // 25) || ', slide ' || (chunk_id % 25 + 1) || ': ' || text, chr(10) ORDER BY place) AS context FROM found GROUP BY 1)
SELECT query_id, md5('## Course overview' || chr(10) || '(no course overview available.)' || chr(10) || chr(10) || '## What this course has covered so far' || chr(10) || '(this is the beginning of the course; nothing has been covered yet.)' || chr(10) || chr(10) || '## Relevant earlier material' || chr(10) || coalesce(context, '(nothing earlier in this course is closely related.)') || chr(10) || chr(10)
  || '## Related files in this lecture folder' || chr(10) || '(no related files have been grouped with this deck.)' || chr(10) || chr(10) || '## This slide (Deck ' || (query_id // 25) || ', ' || (query_id % 25 + 1) || ' of 25)' || chr(10) || 'Extracted text:' || chr(10)
  || coalesce(nullif(left(regexp_replace(c.text, '^\s+|\s+$', '', 'g'), 6000), ''), '(this slide has no extracted text; work from the image.)')) AS prompt_md5 FROM a LEFT JOIN lines USING (query_id) JOIN c ON c.chunk_id = query_id""")
def rendered_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    deck = lambda c: F.concat(F.lit("Deck "), F.floor(F.col(c) / 25).cast("string"))
    lines = C.rendered(_found(spark, sf_dir), "query_id", deck("chunk_id"), F.col("chunk_id") % 25)
    none = F.lit("")
    made = C.prompt(none, none, F.col("context"), none, deck("query_id"), F.col("query_id") % 25, F.lit(25), F.col("text"))
    return e.join(d, "query_id", "left").join(lines, "query_id", "left").select("query_id", F.md5(made.cast("binary")).alias("prompt_md5"))


@query(rf"""WITH f AS (SELECT conv_id, {_COLLAPSE.format(c='text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE n <= 4)
SELECT conv_id, left(coalesce(string_agg(t, ' ' ORDER BY n) FILTER (t <> '' AND before < 500), ''), 500) AS sample FROM b GROUP BY 1""")
def artifact_descriptors(spark, sf_dir):
    return C.descriptors(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"])


@query("""WITH f AS (SELECT s_suppkey, s_nationkey AS folder FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS peer FROM f a JOIN f b ON a.folder = b.folder AND a.s_suppkey <> b.s_suppkey""")
def folder_peers(spark, sf_dir):
    return C.folder_peers(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("folder")), "s_suppkey", "folder")


@query("""WITH s AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'object:' || user_id || ':' || event_id || ':x' WHEN 1 THEN user_id || ':' || event_id % 9 WHEN 2 THEN 'object:' || user_id ELSE user_id || ':no' END AS source FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' ELSE 'slide' END AS kind, CASE event_id % 4 WHEN 0 THEN coalesce(c_name || ' (related file)', 'Related course source')
  ELSE coalesce(c_name, 'Deck') || ', slide ' || (event_id % 9 + 1) || CASE WHEN user_id = 7 AND event_id % 9 = 3 THEN ' (previous slide)' ELSE '' END END AS label FROM s LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 WHERE event_id % 4 < 2""")
def shown_sources(spark, sf_dir):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    name = F.when(e % 4 == 0, F.concat_ws(":", F.lit("object"), u, e.cast("string"), F.lit("x"))).when(e % 4 == 1, F.concat_ws(":", u, (e % 9).cast("string"))).when(e % 4 == 2, F.concat_ws(":", F.lit("object"), u)).otherwise(F.concat_ws(":", u, F.lit("no")))
    s = table(spark, sf_dir, "events").select("event_id", C.parsed_source(name).alias("s")).where("s is not null").select("event_id", "s.*")
    titles = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("a"), "c_name")
    slide = F.col("b").try_cast("long")
    previous = F.when((F.col("a") == "7") & (slide == 3), F.lit(" (previous slide)")).otherwise("")
    label = F.when(F.col("kind") == "object", F.coalesce(F.concat("c_name", F.lit(" (related file)")), F.lit("Related course source"))).otherwise(F.concat(F.coalesce("c_name", F.lit("Deck")), F.lit(", slide "), (slide + 1).cast("string"), previous))
    return s.join(titles, "a", "left").select("event_id", "kind", label.alias("label"))


_CONCEPTS = _EVIDENCE + """, counts AS (SELECT token AS label, count(DISTINCT source) AS artifact_count, count(*) AS evidence_count FROM e WHERE place <= 2 GROUP BY 1),
best AS (SELECT *, row_number() OVER (ORDER BY artifact_count DESC, evidence_count DESC, label) AS place FROM counts WHERE lower(label) LIKE '%_a%') """


def _concepts(spark, sf_dir, wanted):
    held = E.capped_evidence(table(spark, sf_dir, "documents"), mined_terms(spark, sf_dir), "source", "doc_id")
    counts = held.groupBy(F.col("token").alias("label")).agg(F.count_distinct("source").alias("artifact_count"), F.count(F.lit(1)).alias("evidence_count"))
    curated = table(spark, sf_dir, "benchmark").limit(0).select(F.lit("").alias("label"), F.lit(0).alias("artifact_count"), F.lit(0).alias("evidence_count"))
    every = counts.withColumn("aliases", F.array().cast("array<string>")).withColumn("kind", F.lit("course_term")).unionByName(curated.withColumn("aliases", F.array(F.lit(""))).withColumn("kind", F.lit("curated_alias")))
    return held, C.ranked_concepts(every, wanted)


@query(_CONCEPTS + "SELECT label, artifact_count, evidence_count, place FROM best WHERE place <= 18")
def ranked_concepts(spark, sf_dir):
    return _concepts(spark, sf_dir, "_a")[1].select("label", "artifact_count", "evidence_count", "place")


_NODES = _CONCEPTS + """, shown AS (SELECT * FROM best WHERE place <= 18),
app AS (SELECT label AS source, 'artifact-' || e.source AS target, 'appears_in' AS relation, array_to_string(list(doc_id::VARCHAR ORDER BY e.place)[1:6], ' ') AS object_ids FROM e JOIN shown ON token = label WHERE e.place <= 2 GROUP BY label, e.source),
pre AS (SELECT before AS source, after AS target, 'prerequisite_candidate' AS relation, '' AS object_ids FROM (""" + ORACLE["prerequisites"] + """) p WHERE before IN (SELECT label FROM shown) AND after IN (SELECT label FROM shown)) """


@query(_NODES + "SELECT * FROM app UNION ALL SELECT * FROM pre")
def concept_graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", "relation", F.array_join("object_ids", " ").alias("object_ids"))


def _edges(spark, sf_dir):
    held, best = _concepts(spark, sf_dir, "_a")
    evidence = held.select(F.col("token").alias("label"), F.col("source").alias("artifact"), F.col("doc_id").cast("string").alias("object"), "place")
    links = evidence.select("artifact", F.col("artifact").alias("to"), "object", F.col("object").alias("target")).limit(0)
    before = prerequisites(spark, sf_dir).select(F.col("before").alias("required"), F.col("after").alias("advanced"))
    return C.graph_edges(best, evidence, links, before)


@query(_NODES + "SELECT label AS node, 'concept' AS node_type FROM shown UNION SELECT target, 'artifact' FROM app")
def concept_graph_nodes(spark, sf_dir):
    artifacts = _edges(spark, sf_dir).where("relation = 'appears_in'").select(F.col("target").alias("node")).distinct().withColumn("node_type", F.lit("artifact"))
    return _concepts(spark, sf_dir, "_a")[1].select(F.col("label").alias("node"), F.lit("concept").alias("node_type")).unionByName(artifacts)


@query(_BM25 + r""", r AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS i FROM scores),
best AS (SELECT item_id, source, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY i > 4, score DESC, doc_id) AS rank FROM r), results AS (SELECT * FROM best WHERE rank <= 10),
links AS (SELECT DISTINCT source, 'src' || (regexp_extract(source, '\d+$')::INT + 1) AS "to" FROM documents), roots AS (SELECT source AS "to", min(doc_id) AS doc_id FROM documents GROUP BY 1),
found AS (SELECT item_id, "to", min(source) AS via FROM (SELECT DISTINCT item_id, source FROM results) x JOIN links USING (source) GROUP BY 1, 2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY via, "to") AS n FROM found),
more AS (SELECT item_id, "to", doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n) AS n FROM firsts JOIN roots USING ("to") WHERE n <= 4 AND NOT EXISTS (SELECT 1 FROM results x WHERE x.item_id = firsts.item_id AND x.doc_id = roots.doc_id)),
kept AS (SELECT r.* FROM results r LEFT JOIN (SELECT item_id, max(n) AS added FROM more GROUP BY 1) a USING (item_id) WHERE rank <= 10 - coalesce(added, 0))
SELECT item_id, doc_id, source, rank, 'terms' AS matched_by FROM kept UNION ALL SELECT item_id, doc_id, "to", base + n, 'artifact relationship' FROM more JOIN (SELECT item_id, max(rank) AS base FROM kept GROUP BY 1) b USING (item_id)""")
def search_related(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = S.diverse_top(_scores(spark, sf_dir), "item_id", "source", "doc_id", 10).select("item_id", "doc_id", "source", "rank")
    following = F.concat(F.lit("src"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") + 1).cast("string"))
    links = docs.select("source").distinct().withColumn("to", following)
    roots = docs.groupBy(F.col("source").alias("to")).agg(F.min("doc_id").alias("doc_id"))
    return C.related_hits(results, links, roots, "item_id", "doc_id", "source", 10)


@query(r"""WITH t AS (SELECT doc_id, text, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][\p{L}\p{N}_-]{3,}'), lambda x: lower(x))) AS w, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS s FROM documents)
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(w, lambda x: {'n': -length(x), 'w': x}))[1:8], lambda x: x.w), ' ') AS terms, md5(coalesce(l[1], '')) AS line_md5, array_to_string(s[1:6], ' ') AS words, coalesce(nullif(left(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_ -]', '', 'g'), '^\s+|\s+$', '', 'g'), 28), ''), 'term') AS label FROM t""")
def generator_parts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.long_terms(t), " ").alias("terms"), F.md5(T.first_line(t).cast("binary")).alias("line_md5"), T.first_words(t).alias("words"), T.diagram_label(t).alias("label"))


@query(r"""WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages), s AS (SELECT page_id, u, list_filter(list_transform(string_split(replace(u, '\', '/'), '/'), lambda x: trim(x)), lambda x: x NOT IN ('', '.', '..')) AS parts, regexp_extract(u, '([^/]*)$', 1) AS base FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM s)
SELECT page_id, coalesce(nullif(array_to_string(parts, '/'), ''), 'upload') AS path, CASE WHEN contains(base, '.') THEN regexp_replace(regexp_replace(regexp_extract(base, '^(.*)\.[^.]*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') || '.' || left(regexp_replace(regexp_extract(base, '\.([^.]*)$', 1), '[^A-Za-z0-9._-]+', '', 'g'), 12) ELSE coalesce(nullif(left(safe, 80), ''), 'file') END AS safe, regexp_matches(base, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains(base, '..') AS legal,
  list_reduce(list_prepend(2166136261, list_transform(list_filter(string_split(u, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hue FROM b""")
def names_and_paths(spark, sf_dir):
    u = F.coalesce("url", F.lit(""))
    base = F.regexp_extract(u, "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.source_path(u).alias("path"), T.safe_filename(u).alias("safe"), T.legal_id(base).alias("legal"), T.fnv1a(u).alias("hue"))
