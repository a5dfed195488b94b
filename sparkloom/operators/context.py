"""What a question or a generator gets to see: located evidence, citations, retrieved context, rendered prompts, the concept graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import collapse, tokens, truncate_words
from sparkloom.operators.evidence import capped, phrase_links, useful
from sparkloom.sources.files import shared_folder

#: Parts of a place in a file, with the words before each and what is added to its number.
# fixed values
PLACES = (("page", "page ", 0), ("slide", "slide ", 0), ("note", "note ", 0), ("block", "block ", 1), ("sheet", "sheet ", None), ("cell_range", "", None), ("chart", "chart ", None), ("notebook_cell", "notebook cell ", 1), ("output", "output ", 1), ("dataset_field", "field ", None))


def locator_label(places: dict[str, Column], kind: Column, fragment: Column | None = None) -> Column:
    """The places that are known, in order; else the fragment; else the kind of object in words."""
    parts = []
    for name, words, more in PLACES:
        if name in places:
            c = places[name]
            parts.append(F.when(F.nullif(c.cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(words), (c if more is None else c + more).cast("string"))))
    label = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return F.coalesce(label, F.nullif(fragment, F.lit("")) if fragment is not None else F.lit(None), F.replace(kind, F.lit("_"), F.lit(" ")))


def evidence_text(kind: Column, label: Column, data: Column, text: Column, limit: int = 3000) -> Column:
    """Kind, place, structured data (JSON text, empty if none) and extracted text of an object, ``limit`` characters."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parts = [F.concat(F.lit("Object type: "), kind), F.concat(F.lit("Source location: "), label), F.when(F.coalesce(data, F.lit("")) != "", F.concat(F.lit("Structured data:\n"), data)), F.when(trimmed != "", F.concat(F.lit("Extracted text:\n"), trimmed))]
    return F.left(F.concat_ws("\n", *parts), F.lit(limit))


def object_text(*parts: Column, limit: int = 8000) -> Column:
    """What is indexed of an object: its parts that are not empty, a line each, ``limit`` characters."""
    return F.left(F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "\n"), F.lit(limit))


# fixed values
STRUCTURED = ("dataset", "dataset_field", "sheet", "cell", "range", "chart")


def snippet(kind: Column, data: Column, text: Column, limit: int = 320) -> Column:
    """Data (JSON text) for structured kinds, else the text, else the data; white space collapsed, ``limit`` characters."""
    held = F.coalesce(data, F.lit(""))
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    raw = F.when(kind.isin(*STRUCTURED) & (held != ""), held).when(trimmed != "", trimmed).otherwise(held)
    return F.left(F.regexp_replace(raw, r"\s+", " "), F.lit(limit))


def index_text(heading: Column, text: Column, body: Column, limit: int = 300) -> Column:
    """What is embedded of a slide: heading, slide text on one line, explanation; ``limit`` words."""
    flat = collapse(F.coalesce(text, F.lit("")))
    parts = F.filter(F.array(F.coalesce(heading, F.lit("")), flat, F.coalesce(body, F.lit(""))), lambda x: x != "")
    return truncate_words(F.array_join(parts, "\n"), limit)


def overlap(text: Column, summary: Column) -> Column:
    """The share of a text's distinct tokens that a summary has; 1 for no tokens, 0 for an empty summary."""
    own, said = F.array_distinct(tokens(F.coalesce(text, F.lit("")))), F.array_distinct(tokens(F.coalesce(summary, F.lit(""))))
    return F.when(F.size(own) == 0, 1.0).when(F.size(said) == 0, 0.0).otherwise(F.size(F.array_intersect(own, said)) / F.size(own))


def citations(evidence: DataFrame, by: str, order: list[str], text: str = "text", most: int = 12, total: int = 12_000, quote: int = 240) -> DataFrame:
    """``evidence`` with number (from 1), text (cut where the budget of ``total`` characters ends) and quote, the first ``most`` objects of each question."""
    numbered = evidence.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("number") <= most)
    before = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    left = numbered.withColumn("_left", F.lit(total) - F.coalesce(before, F.lit(0))).where("_left > 0")
    return left.withColumn(text, F.left(F.col(text), F.col("_left").cast("int"))).withColumn("quote", F.left(F.col(text), F.lit(quote))).drop("_left")


def cites_validly(answer: Column, n: Column) -> Column:
    """Whether an answer has citations [S1], [S2] ... and only such as there are."""
    refs = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    return (F.size(refs) > 0) & F.forall(refs, lambda r: (r >= 1) & (r <= n))


def retrieved_context(hits: DataFrame, asked: DataFrame, chunks: DataFrame, decks: DataFrame, summaries: DataFrame, k: int = 4, most_said: float = 0.7, words: int = 200) -> DataFrame:
    """query_id, place, chunk_id, relation, text: the earlier chunks that a query sees, the one just before it first.

    ``hits(query_id, chunk_id, score, rank)`` are the nearest of more than will be kept; ``asked(query_id, course, position, previous)`` tells each query's
    place and, if that has an explanation, the chunk before; ``chunks(course, chunk_id, deck, position, text)``; ``decks(course, deck)`` are known;
    ``summaries(course, summary)``. Chunks of unknown decks, later ones, those that score nothing and those that the summary says already are passed over.
    """
    cut = truncate_words(F.col("text"), words)
    first = asked.where("previous is not null").join(chunks, (F.col("previous") == F.col("chunk_id")) & (asked["course"] == chunks["course"]))
    first = first.select("query_id", F.lit(0).alias("rank"), "chunk_id", F.lit("Immediately previous").alias("relation"), cut.alias("text"))
    known = chunks.join(decks, ["course", "deck"], "left_semi").join(F.broadcast(summaries), "course", "left")
    fresh = known.where(overlap(F.col("text"), F.col("summary")) <= most_said).select("course", "chunk_id", F.col("position").alias("at"), cut.alias("text"))
    near = hits.where("score > 0").join(asked, "query_id").join(fresh, ["course", "chunk_id"]).where((F.col("at") < F.col("position")) & ~F.col("chunk_id").eqNullSafe(F.col("previous")))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("rank") <= k)
    both = first.unionByName(near.select("query_id", "rank", "chunk_id", F.lit("Related earlier slide").alias("relation"), "text"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("rank")


def rendered(rows: DataFrame, by: str, title: Column, index: Column) -> DataFrame:
    """by, context: a line for each retrieved chunk, in place."""
    line = F.concat(F.lit("- "), F.col("relation"), F.lit(", "), title, F.lit(", slide "), (index + 1).cast("string"), F.lit(": "), F.regexp_replace("text", r"^\s+|\s+$", ""))
    held = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # a few chunks a query
    return held.select(by, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def prompt(overview: Column, summary: Column, context: Column, related: Column, title: Column, index: Column, n: Column, text: Column, limit: int = 6000) -> Column:
    """The parts that a generator reads, under their headings, with a fixed sentence for what is missing."""
    # fixed values
    parts = (
        ("## Course overview\n", overview, "(no course overview available.)"),
        ("## What this course has covered so far\n", summary, "(this is the beginning of the course; nothing has been covered yet.)"),
        ("## Relevant earlier material\n", context, "(nothing earlier in this course is closely related.)"),
        ("## Related files in this lecture folder\n", related, "(no related files have been grouped with this deck.)"),
    )
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    given = lambda c, none: F.when(c != "", c).otherwise(none)
    out = [F.concat(F.lit(head), given(plain(c), none)) for head, c, none in parts]
    slide = given(F.left(plain(text), F.lit(limit)), "(this slide has no extracted text; work from the image.)")
    out.append(F.concat(F.lit("## This slide ("), title, F.lit(", "), (index + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(")\nExtracted text:\n"), slide))
    return F.concat_ws("\n\n", *out)


def descriptors(objects: DataFrame, by: str, order: list[str], text: str = "text", most: int = 4, limit: int = 500) -> DataFrame:
    """by, sample: the first ``most`` objects' texts on one line, until they have ``limit`` characters."""
    first = objects.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).withColumn("_t", collapse(F.coalesce(F.col(text), F.lit(""))))
    before = F.sum(F.length("_t")).over(Window.partitionBy(by).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_s", F.when((F.col("_t") != "") & (F.col("_before") < limit), F.struct("_n", "_t")))
    held = kept.groupBy(by).agg(F.array_sort(F.collect_list("_s")).alias("s"))  # ``most`` texts at most
    return held.select(by, F.left(F.array_join(F.transform("s", lambda x: x["_t"]), " "), F.lit(limit)).alias("sample"))


def folder_peers(files: DataFrame, key: str, folder: str) -> DataFrame:
    """key, peer: files of one folder, each with the others; for folders of bounded size, as a lecture's."""
    other = files.select(F.col(key).alias("peer"), F.col(folder).alias("_of"))
    return files.join(other, (F.col(folder) == F.col("_of")) & (F.col(key) != F.col("peer"))).select(key, "peer")


def parsed_source(value: Column) -> Column:
    """kind (object or slide), a, b of a source's name "object:a:b" or "a:b" with a number b; null if it is neither."""
    parts = F.split(value, ":")
    a, b = F.get(parts, F.lit(1)), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), ":")
    index = F.get(parts, F.lit(1))
    thing = F.when((F.coalesce(a, F.lit("")) != "") & (b != ""), F.struct(F.lit("object").alias("kind"), a.alias("a"), b.alias("b")))
    slide = F.when((parts[0] != "") & F.coalesce(index, F.lit("")).rlike(r"^\d+$"), F.struct(F.lit("slide").alias("kind"), parts[0].alias("a"), index.alias("b")))
    return F.when(value.startswith("object:"), thing).otherwise(slide)


def ranked_concepts(concepts: DataFrame, wanted: str = "", n: int = 18) -> DataFrame:
    """The first ``n`` of ``concepts(label, aliases, kind, artifact_count, evidence_count)`` with place: curated ones first, then by files, evidence, label.

    ``wanted`` filters label and aliases; its % and _ are wildcards.
    """
    needle = f"%{wanted.strip().lower()}%"
    found = concepts.where(F.lower("label").like(needle) | F.lower(F.array_join("aliases", " ")).like(needle)) if wanted.strip() else concepts
    order = [(F.col("kind") != "curated_alias").cast("int"), F.desc("artifact_count"), F.desc("evidence_count"), F.col("label")]
    best = found.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``n`` rows


def graph_edges(concepts: DataFrame, evidence: DataFrame, links: DataFrame, before: DataFrame, most: int = 6) -> DataFrame:
    """source, target, relation, object_ids, reason: concepts in files, files that name files, what comes before what.

    ``evidence(label, artifact, object, place)`` holds a bounded number of objects for each label and file; ``links(artifact, to, object, target)``.
    """
    shown = evidence.join(F.broadcast(concepts.select("label")), "label", "left_semi").groupBy("label", "artifact").agg(F.array_sort(F.collect_list(F.struct("place", "object"))).alias("o"))
    appears = shown.select(F.col("label").alias("source"), F.concat(F.lit("artifact-"), "artifact").alias("target"), F.lit("appears_in").alias("relation"), F.slice(F.transform("o", lambda x: x["object"]), 1, most).alias("object_ids"), F.concat(F.size("o").cast("string"), F.lit(" exact source object(s) evidence this relationship.")).alias("reason"))
    named = links.select(F.concat(F.lit("artifact-"), "artifact").alias("source"), F.concat(F.lit("artifact-"), "to").alias("target"), F.lit("explicit_reference").alias("relation"), F.array("object", "target").alias("object_ids"), F.lit("A source object explicitly names the file.").alias("reason"))
    order = reduce(lambda p, side: p.join(F.broadcast(concepts.select(F.col("label").alias(side))), side, "left_semi"), ("required", "advanced"), before)
    order = order.select(F.col("required").alias("source"), F.col("advanced").alias("target"), F.lit("prerequisite_candidate").alias("relation"), F.array().cast("array<string>").alias("object_ids"), F.lit("Teaching-order candidate; verify against the linked evidence.").alias("reason"))
    return appears.unionByName(named).unionByName(order)


def related_hits(results: DataFrame, links: DataFrame, roots: DataFrame, query: str, key: str, part: str, limit: int, most: int = 4) -> DataFrame:
    """``results(query, key, part, rank)`` with files that the found ones name: up to ``most`` links of a query, whose target isn't found yet, take the last places.

    ``links(part, to)`` and ``roots(to, key)``, the object that stands for a file.
    """
    found = results.select(query, part).distinct().join(links, part).groupBy(query, "to").agg(F.min(part).alias("via"))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("via", "to"))).where(F.col("_n") <= most)
    more = first.join(roots, "to").join(results.select(query, key), [query, key], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("_n")))
    added = more.groupBy(query).agg(F.max("_n").alias("_added"))
    kept = results.join(added, query, "left").withColumn("_added", F.coalesce("_added", F.lit(0))).where(F.col("rank") <= F.lit(limit) - F.col("_added"))
    base = kept.groupBy(query).agg(F.max("rank").alias("_base"))
    tail = more.join(base, query).select(query, key, F.col("to").alias(part), (F.col("_base") + F.col("_n")).alias("rank"), F.lit("artifact relationship").alias("matched_by"))
    return kept.select(query, key, part, "rank", F.lit("terms").alias("matched_by")).unionByName(tail)


def concept_graph(objects: DataFrame, part: str, key: str, catalog: DataFrame, links: DataFrame, before: DataFrame, wanted: str = "", n: int = 18, mined: int = 30, caps: tuple[int, int] = (6, 2)) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, node_type; edges as ``graph_edges`` gives them) of ``objects(part, key, text)``.

    Concepts are those of ``catalog(label, alias)`` that objects name, and the ``mined`` most frequent useful words that two files share and 2 to 500 objects hold; the
    first ``n`` by ``ranked_concepts`` are shown. Evidence is the first objects of a concept and file: ``caps`` of catalog concepts and of words. It is written
    once, and nodes and edges come from that. ``links(part, to, key, target)`` and ``before(required, advanced)`` are the caller's.
    """
    spark = objects.sparkSession
    given = objects.where(F.col("text").isNotNull())
    named = phrase_links(given, catalog.select("alias", F.col("alias").alias("text")).distinct(), key, "alias").join(catalog, "alias").select(key, F.col("label").alias("token")).distinct()
    curated = capped(named.join(given.select(key, part), key), part, key, caps[0]).withColumn("kind", F.lit("curated_alias"))
    words = given.select(part, key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).where(useful(F.col("token")))
    counts = words.groupBy("token", part).agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("parts"))
    labels = catalog.select(F.col("label").alias("token")).distinct()
    terms = counts.where("parts >= 2 and df between 2 and 500").join(labels, "token", "left_anti").orderBy(F.desc("df"), "token").limit(mined)
    found = curated.unionByName(capped(words.join(F.broadcast(terms.select("token")), "token"), part, key, caps[1]).withColumn("kind", F.lit("course_term")))
    path = shared_folder(spark)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    aliases = catalog.groupBy(F.col("label").alias("token")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))  # a concept's names
    size = found.groupBy("token", "kind").agg(F.count_distinct(part).alias("artifact_count"), F.count(F.lit(1)).alias("evidence_count")).join(aliases, "token", "left")
    size = size.select(F.col("token").alias("label"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "kind", "artifact_count", "evidence_count")
    best = ranked_concepts(size, wanted, n)
    evidence = found.select(F.col("token").alias("label"), F.col(part).alias("artifact"), F.col(key).cast("string").alias("object"), "place")
    told = links.select(F.col(part).alias("artifact"), "to", F.col(key).cast("string").alias("object"), F.col("target").cast("string").alias("target"))
    edges = graph_edges(best, evidence, told, before)
    files = edges.where("relation <> 'prerequisite_candidate'").select(F.explode(F.array("source", "target")).alias("node")).where(F.col("node").startswith("artifact-")).distinct()
    nodes = best.select(F.col("label").alias("node"), F.lit("concept").alias("node_type")).unionByName(files.withColumn("node_type", F.lit("artifact")))
    return nodes, edges
