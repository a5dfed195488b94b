"""Phrase links, capped evidence, rule classifiers, running gists, orphaned contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import collapse, first_sentence, tokens, truncate_words
from sparkloom.operators.tables import numbered


# fixed values
STOP_WORDS = (
    "about", "after", "again", "also", "among", "because", "before", "being", "between", "both", "could", "course", "data", "does", "each", "from", "have",
    "into", "more", "most", "object", "only", "other", "should", "source", "such", "than", "that", "their", "there", "these", "they", "this", "through",
    "using", "value", "values", "were", "what", "when", "where", "which", "while", "with", "would", "your", "true", "false", "none", "null", "text", "type",
    "page", "slide",
)
# fixed values: labels and their other names
CONCEPTS = {
    "regression": ("linear regression", "least squares", "ols", "regression model"),
    "regularization": ("ridge", "lasso", "penalty", "shrinkage"),
    "model evaluation": ("rmse", "mae", "r squared", "residual", "test score"),
    "data leakage": ("look ahead", "look-ahead", "future information", "target leakage"),
    "train test split": ("training set", "test set", "validation set", "out of sample"),
    "entity relationship": ("er diagram", "erd", "entity relationship diagram"),
    "cardinality": ("one to many", "many to many", "optionality", "crow foot"),
    "database key": ("primary key", "foreign key", "identifier", "candidate key"),
    "ethical framework": ("utilitarian", "kantian", "rights", "virtue ethics", "rawls"),
    "stakeholder analysis": ("stakeholder", "affected parties", "consequences"),
    "financial return": ("returns", "simple return", "log return", "rate of return"),
    "risk and volatility": ("volatility", "standard deviation", "variance", "risk measure"),
    "annualization": ("annualised", "annualized", "trading days", "frequency conversion"),
    "spreadsheet formula": ("formula", "countif", "vlookup", "cell reference"),
    "data visualization": ("histogram", "boxplot", "scatter plot", "chart"),
}
# fixed values: what comes before what
PREREQUISITES = (
    ("train test split", "data leakage"), ("regression", "regularization"), ("regression", "model evaluation"), ("entity relationship", "cardinality"),
    ("entity relationship", "database key"), ("ethical framework", "stakeholder analysis"), ("financial return", "risk and volatility"), ("financial return", "annualization"),
)


def useful(token: Column) -> Column:
    """Tokens that may become terms: four characters or more, no stop word, not digits only."""
    return (F.length(token) >= 4) & ~token.isin(*STOP_WORDS) & ~token.rlike(r"^\p{Nd}+$")


def phrase_links(objects: DataFrame, phrases: DataFrame, key: str, name: str, n: int = 5) -> DataFrame:
    """key, name where the phrase's tokens occur in a row in the object's: joined on the first ``n`` tokens, then verified."""
    p = phrases.select(name, tokens(F.col("text")).alias("p")).where("size(p) > 0").withColumn("n", F.least(F.size("p"), F.lit(n)))
    p = p.withColumn("gram", F.xxhash64(F.array_join(F.slice("p", 1, F.col("n")), " ")))
    lengths = sorted(r.n for r in p.select("n").distinct().collect())  # at most ``n`` numbers
    d = objects.select(key, tokens(F.col("text")).alias("w"))
    grams = F.array_distinct(F.flatten(F.array(*[F.expr(f"transform(sequence(1, greatest(size(w) - {m - 1}, 1)), i -> xxhash64(array_join(slice(w, i, {m}), ' ')))") for m in lengths]))) if lengths else F.array().cast("array<long>")
    hits = d.where("size(w) > 0").select(key, F.explode(grams).alias("gram")).join(p.select("gram", name), "gram").select(key, name).distinct()
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    full = hits.join(d.select(key, padded("w").alias("w")), key).join(p.select(name, padded("p").alias("p")), name)
    return full.where(F.col("w").contains(F.col("p"))).select(key, name).distinct()


def capped_evidence(objects: DataFrame, terms: DataFrame, part: str, key: str, cap: int = 2) -> DataFrame:
    """token, part, key, place: of each term and part the first ``cap`` objects that hold it."""
    held = objects.select(part, key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(terms.select("token"), "token")
    return capped(held, part, key, cap)


def capped(held: DataFrame, part: str, key: str, cap: int = 2) -> DataFrame:
    """token, part, key, place: the first ``cap`` of ``held(token, part, key)`` for each token and part."""
    # salted: the first few of each salt, then of these, so no window holds a frequent term's whole group
    few = held.withColumn("s", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("i", F.row_number().over(Window.partitionBy("token", part, "s").orderBy(key))).where(F.col("i") <= cap)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("token", part).orderBy(key))).where(F.col("place") <= cap).select("token", part, key, "place")


def purpose(path: Column, text: Column) -> Column:
    """dataset, assignment, tutorial, worked_result, lecture, reference or unknown: the first rule that fits the path and the first 3000 characters."""
    hay = F.lower(F.concat_ws(" ", path, F.left(text, F.lit(3000))))
    has = lambda *words: hay.rlike("|".join(words))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    # fixed values
    rules = [(suffix == "csv", "dataset"), (has("assignment", "homework"), "assignment"), (has("tutorial", "exercise", "prompt"), "tutorial"), (has("solution", "worked", "answer"), "worked_result"), (suffix.isin("pdf", "pptx") | has("lecture") | F.lower(path).rlike(r"(^|/)l\d+(/|$)"), "lecture"), (has("syllabus", "reference"), "reference")]
    out = F.lit("unknown")
    for rule, name in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def layout_role(df: DataFrame, text: str = "text") -> DataFrame:
    """role (slides or reference) and confidence from words on the page and short lines; ties are slides."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    out = df.withColumn("_n", words).withColumn("_l", F.size(lines)).withColumn("_s", F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 8)))
    # fixed values
    dense, sparse, listed = F.col("_n") >= 200, (F.col("_n") <= 110) & (F.col("_n") > 0), (F.col("_l") >= 6) & (F.col("_s") >= 0.7 * F.col("_l"))
    out = out.withColumn("_ref", F.when(dense, 2.0).otherwise(0.0)).withColumn("_slide", F.when(sparse, 1.5).otherwise(0.0) + F.when(listed, 1.0).otherwise(0.0))
    reasons = dense.cast("int") + sparse.cast("int") + listed.cast("int")
    sure = F.lit(0.5) + 0.12 * F.abs(F.col("_ref") - F.col("_slide")) + 0.05 * F.greatest(reasons - 1, F.lit(0))
    out = out.withColumn("role", F.when(F.col("_ref") > F.col("_slide"), "reference").otherwise("slides")).withColumn("confidence", F.round(F.least(F.greatest(sure, F.lit(0.3)), F.lit(0.97)), 2))
    return out.drop("_n", "_l", "_s", "_ref", "_slide")


def running_gists(df: DataFrame, by: str, order: list[str], text: str, keep: int = 15) -> DataFrame:
    """Column gists: first sentences of up to ``keep`` rows before, oldest first."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(-keep, -1)
    return df.withColumn("_g", first_sentence(F.coalesce(F.col(text), F.lit("")))).withColumn("gists", F.array_join(F.collect_list("_g").over(before), "\n")).drop("_g")


def orphans(removed: DataFrame, remaining: DataFrame, content: str) -> DataFrame:
    """content_hash of removed contents that no remaining row holds: what a cascading delete may drop."""
    hashed = lambda d: d.select(F.sha2(F.col(content).cast("binary"), 256).alias("content_hash")).distinct()
    return hashed(removed).join(hashed(remaining), "content_hash", "left_anti")


# fixed values
REFERENCE_NAME = ("syllabus", "outline", "handbook", "requirements", "program", "programme", "curriculum", "course info", "course-info", "course_info", "assessment", "regulations", "guidelines")
# fixed values
SLIDE_NAME = ("week", "lecture", "lec", "topic", "chapter", "slides", "slide", "deck", "session", "class", "ch", "wk")
# fixed values
REFERENCE_TEXT = (
    "learning outcomes", "learning outcome", "grading", "assessment", "office hours", "prerequisite", "credit", "textbook", "academic honesty", "academic integrity",
    "course description", "grade breakdown", "attendance policy", "plagiarism", "instructor",
)


def role(df: DataFrame, path: str, text: str, pages: str | None = None) -> DataFrame:
    """role (slides or reference) and confidence, from suffix, file name, words a page, telling phrases and short lines; ties are slides.

    ``pages`` names a column of page numbers; without it, or where it is null or under 1, a text is one page.
    """
    flag = lambda c: c.cast("int")
    low, where = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(path), F.lit("")))
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(where, "([^/]*)$", 1), r"\.[a-z0-9]+$", ""), "[_-]+", " ")
    hits = F.filter(F.array(*map(F.lit, REFERENCE_TEXT)), lambda c: F.contains(F.col("_low"), c))
    lines = F.filter(F.split("_low", "[\r\n]+"), lambda x: F.trim(x, F.lit(" \t")) != "")
    size = F.greatest(F.coalesce(F.col(pages), F.lit(1)), F.lit(1)) if pages else F.lit(1)
    out = df.withColumn("_low", low).withColumn("_name", name).withColumn("_hits", hits).withColumn("_lines", lines)
    out = out.withColumn("_wpp", F.size(F.filter(F.split("_low", r"[ \t\r\n]+"), lambda x: x != "")) / size)
    out = out.withColumn("_cues", F.size(F.filter("_hits", lambda c: ~F.exists("_hits", lambda o: (o != c) & F.contains(o, c)))))
    few = F.size(F.filter("_lines", lambda x: F.size(F.split(F.trim(x, F.lit(" \t")), "[ \t]+")) <= 8))
    # fixed values
    deck, named_slide = F.regexp_extract(where, r"(\.[a-z0-9]+)$", 1).isin(".pptx", ".ppt", ".potx", ".key"), F.col("_name").rlike(rf"\b({'|'.join(SLIDE_NAME)})\b|\b[lw]\d{{1,2}}\b|\block\d")
    named, dense, sparse = F.col("_name").rlike("|".join(REFERENCE_NAME)), F.col("_wpp") >= 200, (F.col("_wpp") > 0) & (F.col("_wpp") <= 110)
    listed = (F.size("_lines") >= 6) & (few >= 0.7 * F.size("_lines"))
    cues = F.when(F.col("_cues") >= 2, 2.0).when(F.col("_cues") == 1, 0.75).otherwise(0.0)
    out = out.withColumn("_ref", 2.0 * flag(named) + 2.0 * flag(dense) + cues).withColumn("_slide", 2.5 * flag(deck) + 1.5 * flag(named_slide) + 1.5 * flag(sparse) + flag(listed))
    reference = F.col("_ref") > F.col("_slide")
    why = F.when(reference, flag(named) + flag(dense) + flag(F.col("_cues") > 0)).otherwise(F.greatest(flag(deck) + flag(named_slide) + flag(sparse) + flag(listed), F.lit(1)))
    sure = F.lit(0.5) + 0.12 * F.abs(F.col("_ref") - F.col("_slide")) + 0.05 * (why - 1)
    out = out.withColumn("role", F.when(reference, "reference").otherwise("slides")).withColumn("confidence", F.round(F.least(F.greatest(sure, F.lit(0.3)), F.lit(0.97)), 2))
    return out.drop("_low", "_name", "_hits", "_lines", "_wpp", "_cues", "_ref", "_slide")


def both_present(pairs: DataFrame, a: str, b: str, known: DataFrame, key: str) -> DataFrame:
    """The rows of ``pairs`` whose two names are both known."""
    for side in (a, b):
        pairs = pairs.join(known.select(F.col(key).alias(side)), side, "left_semi")
    return pairs.select(a, b)


def annotations(changes: DataFrame, by: str, term: str, note: str, order: list[str], most: int = 40, term_chars: int = 200, note_chars: int = 600) -> DataFrame:
    """The latest note of each term, whatever its case; a blank note deletes; the ``most`` newest stay."""
    c = changes.withColumn(term, F.left(collapse(F.col(term)), F.lit(term_chars))).withColumn(note, F.left(F.trim(note), F.lit(note_chars))).withColumn("_key", F.lower(term))
    last = c.groupBy(by, "_key").agg(F.max(F.struct(*order, term, note)).alias("r")).select(by, "r.*").where(F.col(note) != "")
    newest = Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])
    return last.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def running_summary(gists: DataFrame, by: str, key: str, gist: str, recent: int = 15, words: int = 1200) -> DataFrame:
    """by, summary: the last ``recent`` gists after the older ones, in order of an integer key; ``words`` words of each part and of all.

    Of the older ones no more than ``words`` can have a share, as each has a word at least: so many are gathered, whatever there are.
    """
    n = numbered(gists, by, key, out="_n")
    size = gists.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_all"))
    kept = n.join(size, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_late", F.col("_n") > F.col("_all") - recent).where(F.col("_late") | (F.col("_n") <= words + 1))
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_n", F.col(gist).alias("g"))))), lambda x: x["g"]), "\n")
    both = kept.groupBy(by).agg(part(~F.col("_late")).alias("older"), part(F.col("_late")).alias("last"))
    whole = F.concat_ws("\n\n", F.nullif(truncate_words(F.col("older"), words), F.lit("")), "last")
    return both.select(by, truncate_words(whole, words).alias("summary"))


def fidelity(source: DataFrame, read: DataFrame, by: str) -> DataFrame:
    """by, expected, actual, ok: how many there are in the source and how many came in."""
    count = lambda d, name: d.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    out = count(source, "expected").join(count(read, "actual"), by, "full")
    both = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "actual")]
    return out.select(by, *both).withColumn("ok", F.col("expected") == F.col("actual"))
