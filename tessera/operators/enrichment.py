"""Enrichment passes over texts: keywords, entities, concepts, relations and summaries; and the order they run in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.sources.storage import stored

ORGANISATION = r"\b([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*\s+(?:" + "|".join(L.ORGANISATION_SUFFIXES) + r"))\b"


@dataclass(frozen=True)
class Pass:
    """A step of the enrichment: what it needs, what it gives, and the function from state to state."""

    name: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    run: Callable[[dict], dict]


def run_passes(passes: list[Pass], state: dict) -> tuple[dict, list[str]]:
    """The state after all passes whose needs are met, and the names of those left out."""
    skipped = []
    for p in passes:
        if all(r in state for r in p.requires):
            state = state | p.run(state)
        else:
            skipped.append(p.name)
    return state, skipped


def entity_fragments(names: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): the words of three bytes or more of entity names (by, name), in lower case."""
    return names.select(*by, F.explode(X.words(F.lower("name"))).alias("value")).where(F.octet_length("value") >= 3).distinct()


def keyword_counts(docs: DataFrame, by: list[str], text_col: str, id_col: str | None = None, fragments: DataFrame | None = None) -> DataFrame:
    """(by, value, frequency): tokens over two bytes that are no digits, no stopwords and no fragments (by, value) of
    entities; with id_col also chunks, the number of texts that hold the value."""
    stop = [*L.ENGLISH_STOPWORDS, *L.TURKISH_STOPWORDS]  # a fixed list
    ids = [F.col(id_col).alias("_id")] if id_col else []
    rows = docs.select(*by, *ids, F.explode(X.keyword_tokens(F.col(text_col))).alias("value"))
    rows = rows.where((F.octet_length("value") > 2) & ~F.col("value").rlike("^[0-9]+$") & ~F.col("value").isin(*stop))
    if fragments is not None:
        rows = rows.join(fragments, [*by, "value"], "left_anti")
    if not id_col:
        return rows.groupBy(*by, "value").agg(F.count("*").alias("frequency"))
    each = rows.groupBy(*by, "value", "_id").agg(F.count("*").alias("_n"))
    return each.groupBy(*by, "value").agg(F.sum("_n").alias("frequency"), F.count("*").alias("chunks"))


def keyword_chunks(chosen: DataFrame, docs: DataFrame, by: list[str], id_col: str, text_col: str) -> DataFrame:
    """(by, value, chunk_id, uses): the texts of each chosen keyword, as rows, so that a common one makes no long array."""
    rows = docs.select(*by, F.col(id_col).alias("chunk_id"), F.explode(X.keyword_tokens(F.col(text_col))).alias("value"))
    return rows.join(chosen.select(*by, "value"), [*by, "value"]).groupBy(*by, "value", "chunk_id").agg(F.count("*").alias("uses"))


def keywords(counts: DataFrame, by: list[str], k: int = 15) -> DataFrame:
    """The k most frequent values (of each group), scored by their share of the greatest frequency."""
    order = (F.col("frequency").desc(), F.col("value").asc())
    if by:
        window = W.partitionBy(*by)
        ranked = counts.withColumns({"rank": F.row_number().over(window.orderBy(*order)), "_most": F.max("frequency").over(window)}).where(F.col("rank") <= k)
        return ranked.withColumn("score", F.round(F.col("frequency") / F.col("_most"), 6)).drop("_most")
    few = counts.orderBy(*order).limit(k)  # k rows; the windows below see only these
    every = W.orderBy(*order)
    return few.withColumns({"rank": F.row_number().over(every), "score": F.round(F.col("frequency") / F.max("frequency").over(W.partitionBy()), 6)})


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, text, type, confidence): organisations by their endings and known names by their triggers, once each."""
    docs, low = docs.select(id_col, text_col, F.lower(text_col).alias("_low")), F.col("_low")  # once for all names
    organisations = F.transform(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(ORGANISATION), F.lit(1)), X.bare)), lambda t: F.struct(t.alias("text"), F.lit("organization").alias("type"), F.lit(0.85).alias("confidence")))
    known = F.array_compact(F.array(*[F.when(low.contains(t), F.struct(F.lit(n).alias("text"), F.lit(k).alias("type"), F.lit(c).alias("confidence"))) for t, n, k, c in L.KNOWN_NAMES]))
    return docs.select(F.col(id_col).alias("chunk_id"), F.inline(F.concat(organisations, known)))


def merge_mentions(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One mention for each chunk, type and lower-cased text: the more confident, the primary one on a tie."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(secondary.withColumn("_p", F.lit(1)))
    best = F.min_by(F.struct("text", "confidence"), F.struct(-F.col("confidence"), F.col("_p"), F.col("text"))).alias("m")
    return both.groupBy("chunk_id", "type", F.lower("text").alias("key")).agg(best).select("chunk_id", "type", "m.text", "m.confidence")


def entities(found: DataFrame) -> DataFrame:
    """(entity_id, name, type, mentions, score): 0.8 and 0.1 for each further mention, 1 at most."""
    grouped = found.groupBy(F.concat_ws(":", "type", F.lower("text")).alias("entity_id"), "type").agg(F.min_by("text", F.struct("chunk_id", "text")).alias("name"), F.count("*").alias("mentions"))
    return grouped.withColumn("score", F.round(F.least(F.lit(1.0), 0.8 + 0.1 * (F.col("mentions") - 1)), 6))


def concepts(headings: DataFrame, phrases: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """(concept_id, name, score): headings of levels 1 to 3, and phrases of several words with a score of 0.75 or more that
    are no fragment (value) of an entity's name."""
    level = F.when(F.col("level") == 1, 0.98).when(F.col("level") == 2, 0.94).otherwise(0.90)
    a = headings.where((F.col("level") <= 3) & (X.bare(F.col("heading")) != "")).select(X.bare(F.col("heading")).alias("name"), level.alias("score"), F.lit(0).alias("_p"))
    b = phrases.where((F.col("score") >= 0.75) & (F.length("value") > 3) & F.col("value").contains(" ")).select(F.col("value").alias("name"), "score", F.lit(1).alias("_p"))
    if fragments is not None:
        b = b.join(fragments.select(F.col("value").alias("_f")), F.lower(F.trim("name")) == F.col("_f"), "left_anti")
    best = F.min_by(F.struct("name", "score"), F.struct("_p", -F.col("score"), F.col("name"))).alias("c")
    return a.unionByName(b).groupBy(F.lower("name").alias("key")).agg(best).select(F.concat(F.lit("concept:"), X.concept_slug(F.col("c.name"))).alias("concept_id"), "c.name", "c.score")


def relations(found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(subject, predicate, object, confidence, chunk_id): founders and places of organisations named in one text; the
    first text of a relation counts."""
    text = docs.select(F.col(id_col).alias("chunk_id"), F.lower(text_col).alias("_t"))
    founded = F.col("_t").rlike("founded|created|started")
    placed = F.col("_t").rlike("in |at ")
    ids = found.select("chunk_id", "type", F.concat_ws(":", "type", F.lower("text")).alias("entity")).distinct()
    grouped = ids.groupBy("chunk_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("entity")))).alias(t) for t in ("organization", "person", "location")])
    grouped = grouped.where(F.size("organization") > 0).join(text, "chunk_id")
    pair = lambda ok, kind, predicate, c: F.when(ok, F.flatten(F.transform("organization", lambda o: F.transform(kind, lambda x: F.struct(o.alias("subject"), F.lit(predicate).alias("predicate"), x.alias("object"), F.lit(c).alias("confidence"))))))
    empty = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    rows = grouped.select("chunk_id", F.inline(F.concat(F.coalesce(pair(founded, "person", "founded_by", 0.90), empty), F.coalesce(pair(placed, "location", "located_in", 0.85), empty))))
    return rows.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.min("chunk_id").alias("chunk_id"))


def named_in(docs: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, name): the names (name) that a lower-cased text holds anywhere.

    A text gives those of its own strings that have a name's size and pass a bitmap of the names' hashes, and these meet the
    names by an equi-join, which is exact. Texts stay where they lie: what is shuffled follows what is found, and neither
    side is broadcast but for the bitmap of fixed size and the names' sizes.
    """
    own = stored(names.where(F.length("name") > 0).select("name", F.lower("name").alias("_low")).distinct(), "names")
    sizes = sorted(r.n for r in own.select(F.octet_length("_low").alias("n")).distinct().collect())  # a few numbers
    bits = A.bitmap(own.select(F.explode(A.spelling(F.col("_low"))).alias("_h")), "_h")
    text = F.lower(F.coalesce(text_col, F.lit("")))
    found = docs.select(F.col(id_col).alias("chunk_id"), F.explode(A.spelled(sizes, bits)(text)).alias("_found"))
    # names and texts grow, so that neither side of the join goes through the driver
    met = found.hint("merge").join(own.withColumn("_found", F.col("_low").cast("binary")).hint("merge"), "_found")
    return met.select("chunk_id", "name")


def related_concepts(found: DataFrame, attached: DataFrame) -> DataFrame:
    """(subject, predicate, object, confidence, chunk_id): each entity named in a text `relates_to` the concepts (chunk_id,
    concept_id) that the text holds; the first text of a relation counts."""
    ids = found.select("chunk_id", F.concat_ws(":", "type", F.lower("text")).alias("subject"))
    # rows that repeat change no minimum, and are not shuffled for being found
    rows = ids.join(attached.select("chunk_id", F.col("concept_id").alias("object")), "chunk_id")
    return rows.groupBy("subject", F.lit("relates_to").alias("predicate"), "object").agg(F.lit(0.80).alias("confidence"), F.min("chunk_id").alias("chunk_id"))


def summary_with_topics(summaries: DataFrame, topics: DataFrame, by: str, k: int = 3) -> DataFrame:
    """summaries (by, summary) with the names of the k best concepts (by, name, score) of each group."""
    ranked = topics.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), "name"))).where(F.col("_n") <= k)
    names = ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ", ").alias("_names"))
    text = F.concat_ws(" ", F.nullif(F.col("summary"), F.lit("")), F.when(F.col("_names").isNotNull(), F.concat(F.lit("Key Topics: "), F.col("_names"), F.lit("."))))
    return summaries.join(names, by, "full").select(by, text.alias("summary")).where("summary <> ''")


def recognised(docs: DataFrame, id_col: str, text_col: str, recogniser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mentions by a recogniser (chunk_id, text) -> (chunk_id, text, type, confidence); a text for which it gives nothing, or
    a null text (an error), falls back on the rules. Without a recogniser all do."""
    if recogniser is None:
        return mentions(docs, id_col, text_col)
    own = docs.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    given = recogniser(own).where("text IS NOT NULL").select("chunk_id", "text", "type", "confidence")
    rest = own.join(given.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return given.unionByName(mentions(rest, "chunk_id", "text"))


def document_summary(docs: DataFrame, by: str, id_col: str, text_col: str, sentences: int = 3) -> DataFrame:
    """(by, summary): the first sentences of the first texts of each group, by a bounded partial aggregate of ranks."""
    first = docs.select(F.col(by), F.col(id_col).alias("_id"), X.first_sentence(F.col(text_col)).alias("s")).where("s IS NOT NULL")
    ranked = first.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_id"))).where(F.col("_n") <= sentences)
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "s"))), lambda x: x["s"]), " ").alias("summary"))
