"""Registered queries over vectors, phrases, classifiers and the incremental import, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import evidence as E
from sparkloom.operators import vectors as V
from sparkloom.plans.queries import ORACLE, mined_terms, query, table
from sparkloom.sources.files import shared_folder
from sparkloom.streaming.imports import import_new

_COSINE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM e q, e x WHERE q.vec_id % 50 = 0{also}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) """


def _nearest(spark, sf_dir, k, **how):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.cosine_topk(e.where("vec_id % 50 = 0"), e, k, undefined=True, **how)


@query(_COSINE.format(also="") + "SELECT * FROM t WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, 10)


@query(_COSINE.format(also=" AND x.vec_id <> q.vec_id") + "SELECT * FROM t WHERE rank <= 10")
def cosine_topk_excluding(spark, sf_dir):
    return _nearest(spark, sf_dir, 10, exclude_self=True)


@query(_COSINE.format(also="") + ", p AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM t WHERE rank <= 12 AND vec_id < query_id AND score > 0) SELECT * FROM p WHERE place <= 4")
def overfetch_filter_context(spark, sf_dir):
    # three times as many as asked for, and only then the filter on earlier rows: fewer may be left
    near = _nearest(spark, sf_dir, 12).where("vec_id < query_id and score > 0")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 4").drop("rank")


_WORDS = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {_WORDS} || ' ' AS w FROM documents) d, (SELECT item_id, {_WORDS} AS p FROM benchmark) b WHERE p <> '' AND contains(w, ' ' || p || ' ')")
def phrase_links(spark, sf_dir):
    return E.phrase_links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_EVIDENCE = f"""WITH terms AS ({ORACLE["mined_terms"]}), held AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents),
e AS (SELECT token, source, doc_id, row_number() OVER (PARTITION BY token, source ORDER BY doc_id) AS place FROM held JOIN terms USING (token)) """


@query(_EVIDENCE + "SELECT * FROM e WHERE place <= 2")
def capped_evidence(spark, sf_dir):
    return E.capped_evidence(table(spark, sf_dir, "documents"), mined_terms(spark, sf_dir), "source", "doc_id")


@query(_EVIDENCE + "SELECT a.token AS token_a, b.token AS token_b, count(*) AS shared, count(DISTINCT source) AS n_sources FROM (SELECT * FROM e WHERE place <= 2) a JOIN (SELECT * FROM e WHERE place <= 2) b USING (source, doc_id) WHERE a.token < b.token GROUP BY ALL")
def concept_edges(spark, sf_dir):
    # at most 30 terms a document: pairs of a document's terms, never of a group of documents
    held = capped_evidence(spark, sf_dir).groupBy("source", "doc_id").agg(F.sort_array(F.collect_set("token")).alias("t"))
    pairs = held.select("source", F.explode(F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> struct(x as a, y as b))))")).alias("p"))
    one = pairs.groupBy("p", "source").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("p").agg(F.sum("n").alias("shared"), F.count(F.lit(1)).alias("n_sources")).select(F.col("p.a").alias("token_a"), F.col("p.b").alias("token_b"), "shared", "n_sources")


@query(r"""WITH h AS (SELECT page_id, lower(coalesce(url, '')) AS p, lower(concat_ws(' ', url, left(html, 3000))) AS hay FROM pages)
SELECT page_id, CASE WHEN regexp_extract(p, '\.([a-z0-9]+)$', 1) = 'csv' THEN 'dataset' WHEN regexp_matches(hay, 'assignment|homework') THEN 'assignment' WHEN regexp_matches(hay, 'tutorial|exercise|prompt') THEN 'tutorial'
  WHEN regexp_matches(hay, 'solution|worked|answer') THEN 'worked_result' WHEN regexp_extract(p, '\.([a-z0-9]+)$', 1) IN ('pdf', 'pptx') OR regexp_matches(hay, 'lecture') OR regexp_matches(p, '(^|/)l\d+(/|$)') THEN 'lecture'
  WHEN regexp_matches(hay, 'syllabus|reference') THEN 'reference' ELSE 'unknown' END AS purpose FROM h""")
def purpose_cascade(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", E.purpose(F.col("url"), F.col("html")).alias("purpose"))


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
r AS (SELECT doc_id, n >= 200 AS dense, n <= 110 AND n > 0 AS sparse, len(l) >= 6 AND len(list_filter(l, lambda x: len(regexp_split_to_array(trim(x), '\s+')) <= 8)) >= 0.7 * len(l) AS listed FROM w),
s AS (SELECT doc_id, CASE WHEN dense THEN 2.0 ELSE 0 END::DOUBLE AS ref, (CASE WHEN sparse THEN 1.5 ELSE 0 END + CASE WHEN listed THEN 1.0 ELSE 0 END)::DOUBLE AS slide, dense::INT + sparse::INT + listed::INT AS reasons FROM r)
SELECT doc_id, CASE WHEN ref > slide THEN 'reference' ELSE 'slides' END AS role, round(least(greatest(0.5::DOUBLE + 0.12::DOUBLE * abs(ref - slide) + 0.05::DOUBLE * greatest(reasons - 1, 0), 0.3), 0.97), 2) AS confidence FROM s""")
def layout_role(spark, sf_dir):
    return E.layout_role(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(r"""WITH f AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations),
u AS (SELECT conv_id, turn, role, string_split(CASE WHEN instr(t, '. ') > 1 THEN left(t, instr(t, '. ')) WHEN instr(t, '? ') > 1 THEN left(t, instr(t, '? ')) WHEN instr(t, '! ') > 1 THEN left(t, instr(t, '! ')) ELSE t END, ' ') AS w FROM f),
g AS (SELECT conv_id, turn, role, array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN ' [...]' ELSE '' END AS g FROM u)
SELECT conv_id, turn, role, md5(coalesce(string_agg(g, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), '')) AS gists_md5 FROM g""")
def running_gists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return E.running_gists(c, "conv_id", ["turn", "role"], "text").select("conv_id", "turn", "role", F.md5(F.col("gists").cast("binary")).alias("gists_md5"))


@query("SELECT conv_id, turn, CASE WHEN n >= 2 THEN i || ' of ' || n END AS position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) t")
def deck_position(spark, sf_dir):
    own = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = F.count(F.lit(1)).over(own)
    return c.select("conv_id", "turn", F.when(n >= 2, F.concat_ws(" of ", F.row_number().over(own.orderBy("turn", "role")).cast("string"), n.cast("string"))).alias("position"))


@query(r"""WITH f AS (SELECT regexp_extract(lower(url), '(?:lecture|week)[ _-]*(\d+)', 1) AS n, regexp_extract(url, '([^/]+)/[^/]*$', 1) AS folder FROM pages)
SELECT CASE WHEN n <> '' THEN 'Lecture ' || n WHEN folder <> '' THEN folder ELSE 'Course resources' END AS folder, count(*) AS files FROM f GROUP BY 1""")
def folder_groups(spark, sf_dir):
    n, folder = F.regexp_extract(F.lower("url"), r"(?:lecture|week)[ _-]*(\d+)", 1), F.regexp_extract("url", "([^/]+)/[^/]*$", 1)
    label = F.when(n != "", F.concat(F.lit("Lecture "), n)).when(folder != "", folder).otherwise("Course resources")
    return table(spark, sf_dir, "pages").groupBy(label.alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def cascade_delete(spark, sf_dir):
    d, gone = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return E.orphans(d.join(gone, "doc_id", "left_semi"), d.join(gone, "doc_id", "left_anti"), "text")


@query("SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) t WHERE i = 1")
def incremental_import(spark, sf_dir):
    like = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    # a glob, as the table may be one file, which a stream doesn't take by its plain path
    source = spark.readStream.schema(like.schema).parquet(f"{sf_dir}/events.parque[t]")
    return import_new(source, shared_folder(spark), ["user_id", "event_type"], ["ts", "event_id"]).drop("batch")
