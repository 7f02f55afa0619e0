"""Search of code: expanded terms, weighted fields, prefix, AND and NEAR groups, ranking, hybrid lists.

The words of the documents are written once, one row per document, and read
twice: for the vocabulary, in which the words that begin with a term are looked
up by equality on their prefixes, and for the hits, which only these words give.
Terms and matching words are broadcast below a checked number, and joined by
shuffle beyond it.

The score of a document is the sum over the expanded terms, each of which counts
the words that begin with it; where it holds all base words of the question,
these count once more, and again where they stand close together in one field.

Defined cases: null ids are dropped; a null field has no words; repeated rows of
an id are one document, with the greatest values; a question without terms gives
no rows; equal scores are ordered by id; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import terms as T
from loomspark.functions.text import words
from loomspark.operators.lexical import B, K1, by_repetition, ranked, small
from loomspark.session import cut

#: Words between the first and the last of a NEAR group.
NEAR = 10
LEAST = 0.001


def one_row_per_id(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each id once, with its greatest values; only the rows of repeated ids are shuffled where these are few."""
    single, several = by_repetition(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *columns))
    return single.unionByName(several.groupBy("id").agg(F.max(F.struct(*columns)).alias("r")).select("id", "r.*"))


def code_fields(chunks: DataFrame) -> DataFrame:
    """The fields of a chunk as they are searched: with the parts of identifiers in names and in ``idents``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = lambda c: F.array_join(T.identifier_words(c), " ")
    return chunks.select(
        "id", blank("name").alias("name"), F.concat_ws(" ", blank("qualified_name"), parts(F.col("qualified_name"))).alias("qualified_name"),
        blank("filepath").alias("filepath"), blank("content").alias("content"), parts(F.concat_ws(" ", "name", "content")).alias("idents"),
    )


def question_terms(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(query_id, term, core)``: expanded terms, and whether they are base words of the question."""
    asked = questions.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("query_id"), T.expanded_terms(F.col(text_col)).alias("terms"), T.base_terms(F.col(text_col)).alias("base")
    )
    return asked.select("query_id", "base", F.explode("terms").alias("term")).select("query_id", "term", F.array_contains("base", F.col("term")).alias("core")).distinct()


def _matching(texts: DataFrame, fields: list[str], terms: DataFrame) -> DataFrame:
    """``(word, term)``: words of the texts that begin with a term."""
    lengths = [r[0] for r in terms.select(F.length("term")).distinct().limit(1000).collect()]
    if not lengths:
        return terms.select(F.col("term").alias("word"), "term").limit(0)
    heads = terms.select(F.substring("term", 1, min(lengths)).alias("head")).distinct()
    word = texts.select(F.explode(F.array_distinct(F.concat(*fields))).alias("word"))
    # the first test, on the shortest prefix, thins the words out before they are counted
    word = word.join(small(heads), F.substring("word", 1, min(lengths)) == F.col("head"), "left_semi").distinct()
    cuts = F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in sorted(lengths)])
    return word.select("word", F.explode(F.array_distinct(cuts)).alias("term")).where("term IS NOT NULL").join(terms.select("term").distinct(), "term").select("word", "term")


def _idf(rows: DataFrame, n_docs: int) -> DataFrame:
    raw = F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return rows.groupBy("term").agg(F.count("*").alias("n")).select("term", F.when(raw > 0, raw).otherwise(F.lit(1e-6)).alias("idf"))


def search(docs: DataFrame, weights: dict[str, float], terms: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` of ``docs``, with one row per ``id``, for each question.

    ``terms`` is what :func:`question_terms` gives.
    """
    fields = list(weights)
    texts = cut(docs.select("id", *[words(F.col(c)).alias(c) for c in fields]), "search-words")
    size = reduce(add, [F.size(c) for c in fields])
    n_docs, avg_len = texts.agg(F.count("*"), F.avg(size)).first()
    avg_len = avg_len or 1.0
    terms = cut(terms, "search-terms")
    matching = cut(_matching(texts, fields, terms), "search-matching")
    placed = reduce(DataFrame.unionByName, [
        texts.select("id", size.alias("len"), F.lit(c).alias("field"), F.lit(float(w)).alias("w"), F.posexplode(c).alias("at", "word")) for c, w in weights.items()
    ])
    hits = cut(placed.join(small(matching.select("word").distinct()), "word", "left_semi"), "search-hits")
    part = lambda tf: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avg_len))

    begun = cut(hits.join(small(matching), "word").groupBy("id", "len", "term").agg(F.sum("w").alias("tf")), "search-begun")
    weighed = begun.repartition("id").join(small(_idf(begun, n_docs)), "term").select("id", "term", part(F.col("tf")).alias("part"))
    # all terms of a document are in one task, where the questions meet it: pairs are added up before they travel
    scored = weighed.join(small(terms), "term").groupBy("query_id", "id").agg(F.sum("part").alias("part"))

    core = terms.where("core").select("query_id", "term")
    core = core.join(core.groupBy("query_id").agg(F.count("*").alias("n_core")), "query_id").where("n_core > 1")
    whole = hits.join(small(core.select(F.col("term").alias("word")).distinct()), "word", "left_semi").withColumnRenamed("word", "term")
    exact = cut(whole.groupBy("id", "len", "term").agg(F.sum("w").alias("tf")), "search-exact")
    counts = exact.groupBy("term").agg(F.count("*").alias("n"))
    exact = exact.join(small(_idf(exact, n_docs)), "term").select("id", "term", part(F.col("tf")).alias("part"))
    # only documents with the rarest base word of a question can hold all of them
    rarest = core.join(counts, "term").groupBy("query_id").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("known"), F.max("n_core").alias("n_core"))
    likely = exact.join(small(rarest.where("known = n_core").select("query_id", "term")), "term").select("query_id", "id")
    every = likely.join(small(core), "query_id").join(exact, ["id", "term"]).groupBy("query_id", "id", "n_core").agg(F.sum("part").alias("part"), F.count("*").alias("held"))
    every = cut(every.where("held = n_core").select("query_id", "id", "n_core", "part"), "search-every")
    within = Window.partitionBy("query_id", "id", "field").orderBy("at").rangeBetween(0, NEAR + 1)
    close = every.join(small(core.select("query_id", "term")), "query_id").join(whole.select("id", "term", "field", "at"), ["id", "term"])
    close = close.withColumn("together", F.size(F.collect_set("term").over(within))).where("together = n_core").select("query_id", "id", "part").distinct()
    more = every.select("query_id", "id", "part").unionByName(close).groupBy("query_id", "id").agg(F.sum("part").alias("more"))
    more = cut(more, "search-more")
    total = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6)
    return ranked(scored.join(small(more), ["query_id", "id"], "left").select("query_id", "id", F.when(total == 0, F.lit(LEAST)).otherwise(total).alias("score")), k)


def narrowed(
    chunks: DataFrame, files: DataFrame | None = None, projects: list[str] | None = None, prefix: str | None = None,
    languages: list[str] | None = None, types: list[str] | None = None, since: float | None = None,
) -> DataFrame:
    """Chunks of the given projects, path, languages, types and age of file; what is null does not narrow, what is empty leaves none."""
    for column, allowed in (("project", projects), ("language", languages), ("chunk_type", types)):
        if allowed is not None:
            chunks = chunks.where(F.col(column).isin(allowed) if allowed else F.lit(False))
    if prefix is not None:
        flat = F.lower("filepath")
        chunks = chunks.where((flat == prefix.lower()) | flat.startswith(prefix.lower().rstrip("/") + "/"))
    if since is not None:
        chunks = chunks.join(files.where(F.col("last_modified") >= since).select("filepath").distinct(), "filepath", "left_semi")
    return chunks


def blended(listed: DataFrame, names: DataFrame, terms: DataFrame, central: DataFrame) -> DataFrame:
    """``(query_id, id, score, rank)``: fused score, centrality and exact symbols in one score.

    ``listed`` holds ``(query_id, id, score, rank)``, ``names`` ``(id, name)``,
    ``central`` ``(name, score)`` with the greatest score of a name over its
    projects; a name that it lacks has 0.  Scores are scaled to 0..1 per question.
    """
    # Weights of the fused score, the centrality and the exact symbol
    fused, graph, exact = 0.70, 0.25, 0.05
    base = listed.select("query_id", "id", "score", "rank").join(names.select("id", T.last_component(F.col("name")).alias("name")), "id")
    base = base.join(central.select("name", F.col("score").alias("central")), "name", "left").fillna(0.0, ["central"])
    asked = terms.select("query_id", F.col("term").alias("asked")).distinct()
    base = base.join(small(asked), (base["query_id"] == asked["query_id"]) & (F.lower("name") == F.col("asked")), "left").drop(asked["query_id"])
    scaled = lambda c: scale(F.col(c))
    score = fused * scaled("score") + graph * scaled("central") + exact * F.col("asked").isNotNull().cast("int")
    rows = base.withColumn("blend", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("blend").desc(), F.col("rank"))
    return rows.select("query_id", "id", F.col("blend").alias("score"), F.row_number().over(order).alias("rank"))


def scale(c: Column) -> Column:
    """A column brought to 0..1 within its question; a constant one is 1 if positive, else 0."""
    span = Window.partitionBy("query_id")
    low, high = F.min(c).over(span), F.max(c).over(span)
    return F.when(high > low, (c - low) / (high - low)).otherwise((c > 0).cast("double"))


def with_tail(head: DataFrame, listed: DataFrame, top: int) -> DataFrame:
    """``head``, scored rows among the first ``top`` of ``listed``, and the rest of ``listed`` below its least score.

    The i-th of n rows of the rest has ``floor * (1 - i / (n + 1))``.
    """
    rest = listed.where(F.col("rank") > top).select("query_id", "id", "rank")
    n = F.count("*").over(Window.partitionBy("query_id"))
    low = head.groupBy("query_id").agg(F.min("score").alias("floor"))
    rest = rest.withColumn("n", n).join(low, "query_id").select(
        "query_id", "id", F.round(F.col("floor") * (1 - (F.col("rank") - top) / (F.col("n") + 1)), 6).alias("score"), "rank"
    )
    return head.select("query_id", "id", "score", "rank").unionByName(rest)


def snippets(hits: DataFrame, texts: DataFrame, terms: DataFrame, size: int = 32) -> DataFrame:
    """``(query_id, id, begin, n_marked, snippet)``: the ``size`` words of each hit that hold most matches.

    ``hits`` holds ``(query_id, id)``, ``texts`` ``(id, text)`` with one row per
    id.  Words that begin with a term of the question are marked; of equal
    stretches the first is taken.  A text without words has an empty snippet.
    """
    asked = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    rows = hits.select("query_id", "id").join(small(texts), "id").join(small(asked), "query_id").withColumn("words", words(F.col("text")))
    hit = F.transform("words", lambda w: F.exists("terms", lambda t: F.startswith(w, t)))
    rows = rows.withColumn("hit", hit)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    counts = F.transform(starts, lambda a: F.struct(F.size(F.filter(F.slice("hit", a, size), lambda x: x)).alias("n"), (-a).alias("back")))
    rows = rows.withColumn("best", F.array_max(counts))
    begin = -F.col("best.back")
    shown = F.transform(F.arrays_zip(F.slice("words", begin, size).alias("w"), F.slice("hit", begin, size).alias("h")), lambda x: F.when(x["h"], F.concat(F.lit("\u00ab"), x["w"], F.lit("\u00bb"))).otherwise(x["w"]))
    return rows.select("query_id", "id", begin.alias("begin"), F.col("best.n").alias("n_marked"), F.array_join(shown, " ").alias("snippet"))
