"""Registered queries over texts: identities, enrichment, structure, answers and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators import answers as A
from tessera.operators import enrichment as N
from tessera.operators import indexing as I
from tessera.operators import retrieval as R
from tessera.operators import structure as S
from tessera.plans import search
from tessera.sources.storage import stored
from tessera.sources.tables import table


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def token_estimates(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.token_estimate(t).alias("tokens"), X.context_tokens(t).alias("context_tokens"))


def content_hash_groups(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def index_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.index_signature(X.content_hash(F.col("text")), "mock", "mock-embed", "1", "1.0.0").alias("signature"))


def corpus_fingerprint(spark, sf_dir):
    """A fingerprint of each conversation: the sorted hashes of its turns."""
    h = F.array_sort(F.collect_list(X.content_hash(F.col("text"))))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.sha2(F.array_join(h, "\n"), 256).alias("fingerprint"))


def point_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.point_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("point_id"))


def language_detect(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.language(F.col("text")).alias("language"))


def keyword_topk_global(spark, sf_dir):
    return N.keywords(N.keyword_counts(_docs(spark, sf_dir), [], "text"), []).select("value", "frequency", "rank", "score")


def keyword_by_source(spark, sf_dir):
    return N.keywords(N.keyword_counts(_docs(spark, sf_dir), ["source"], "text"), ["source"]).select("source", "value", "frequency", "rank", "score")


def summary_first_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.first_sentence(F.col("text")).alias("summary"))


def doc_summary(spark, sf_dir):
    return N.document_summary(_turns(spark, sf_dir), "conv_id", "turn", "text")


def heading_normalize(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", X.normal_heading(F.col("text")).alias("heading"))


def slug_ascii(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", X.slug(F.col("text")).alias("slug"), X.concept_slug(F.col("text")).alias("concept_slug"))


def paragraph_categories(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("Note: ", "Example: ", "See ", "Definition: ", ""))), (F.col("conv_id") % 5 + 1).cast("int"))
    return _turns(spark, sf_dir).groupBy(X.paragraph_category(F.concat(lead, F.col("text"))).alias("category")).agg(F.count("*").alias("n"))


def _named(spark, sf_dir) -> DataFrame:
    """Texts with names in them, one for each order."""
    o = table(spark, sf_dir, "orders")
    founder = F.when(F.col("o_orderkey") % 3 == 0, "Rick Rubin").otherwise("Atatürk")
    place = F.when(F.col("o_orderkey") % 2 == 0, " in New York.").otherwise(" at Ankara.")
    verb = F.when(F.col("o_orderkey") % 5 == 0, " was founded by ").otherwise(" was led by ")
    return o.select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("The firm Anton"), F.col("o_custkey").cast("string"), F.lit(" Holding"), verb, founder, place).alias("text"))


def entity_mentions(spark, sf_dir):
    return N.mentions(_named(spark, sf_dir), "chunk_id", "text")


def mention_merge(spark, sf_dir):
    found = N.mentions(_named(spark, sf_dir), "chunk_id", "text")
    other = found.where("chunk_id % 4 <> 0").withColumns({"text": F.upper("text"), "confidence": F.when(F.col("chunk_id") % 3 == 0, 0.99).otherwise(0.5)})
    return N.merge_mentions(found, other)


def entity_groups(spark, sf_dir):
    return N.entities(N.mentions(_named(spark, sf_dir), "chunk_id", "text"))


def relation_pairs(spark, sf_dir):
    docs = _named(spark, sf_dir)
    return N.relations(N.mentions(docs, "chunk_id", "text"), docs, "chunk_id", "text")


def concept_rank(spark, sf_dir):
    headings = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("heading"), F.lit(1).alias("level"))
    phrases = _turns(spark, sf_dir).select(F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("value"), F.lit(0.8).alias("score")).distinct()
    return N.concepts(headings, phrases).select("concept_id", "name", "score")


def graph_nodes(spark, sf_dir):
    nodes = I.entity_nodes(N.mentions(_named(spark, sf_dir), "chunk_id", "text"))
    return nodes.select("name", "canonical_name", "entity_type", "score", "evidence")


def graph_retrieve(spark, sf_dir):
    """Questions about firms: nodes whose names contain a token, their evidence scored by share of tokens matched."""
    return R.graph_search(*_graph_sides(spark, sf_dir), 10).select("query_id", "id", "score", "rank")


def _graph_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, nodes and their evidence."""
    found = stored(I.names_in_chunks(N.mentions(_named(spark, sf_dir), "chunk_id", "text")), "evidence")  # the graph's tables are read many times
    queries = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("What does the book say about anton"), F.col("c_custkey").cast("string"), F.lit(" and rubin?")).alias("q"))
    return queries, stored(I.nodes_of_chunks(found), "nodes"), found.select("name", "chunk_id")


def graph_fusion(spark, sf_dir):
    """Dense hits joined with graph hits of the same query ids, where there are any."""
    graph = graph_retrieve(spark, sf_dir)
    return R.fuse([(search._dense(spark, sf_dir), 1.0), (graph, 1.0)], 10).select("query_id", "id", "score", "rank")


def graph_bfs(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    seeds = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(name("r", "r_regionkey").alias("node"))
    return I.reachable(edges, seeds, 2)


def diff_plan(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    signature = F.sha2(F.coalesce("text", F.lit("")), 256)
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("point_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(signature).alias("signature"))
    new = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("point_id"), signature.alias("signature"))
    return I.diff_plan(old, new)


def upsert_latest(spark, sf_dir):
    return I.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def entity_evidence(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_discount").alias("score"))
    merged = I.merge_evidence(line.where("document_id % 2 = 0"), line)
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("document_id"))
    return I.node_view(I.forget_document(merged, gone)).select("node_id", "score", F.size("chunks").cast("bigint").alias("chunks"))


def state_transitions(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for p in (("signup", "pending"), ("view", "running"), ("click", "retrying"), ("purchase", "completed"), ("error", "failed")) for x in p])
    states = table(spark, sf_dir, "events").select("user_id", "event_id", names[F.col("event_type")].alias("state"))
    moves = spark.createDataFrame(L.JOB_MOVES, "from_state string, to_state string")
    return I.illegal_moves(states, moves, "user_id", "event_id", "state").groupBy("_from", "state").agg(F.count("*").alias("n")).withColumnRenamed("_from", "from_state")


def _questions(spark, sf_dir) -> DataFrame:
    t = X.tokens(F.col("text"))
    a, b = F.coalesce(F.get(t, 0), F.lit("x")), F.coalesce(F.get(t, 1), F.lit("y"))
    forms = F.array(
        F.concat(F.lit("Compare "), a, F.lit(" with "), b), F.concat(a, F.lit(" vs. "), b), F.concat(F.lit("What is the difference between "), a, F.lit(" and "), b),
        F.concat(F.lit("How do "), a, F.lit(" and "), b, F.lit(" differ?")), F.concat(F.lit("Who wrote "), a, F.lit("?")), F.concat(F.lit("What does the book say about "), b, F.lit("?")), F.concat(F.lit("how to "), a), a,
    )
    return _turns(spark, sf_dir).select("conv_id", "turn", F.element_at(forms, ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")).alias("query"))


def intent_route(spark, sf_dir):
    r = A.route(_questions(spark, sf_dir), "query")
    return r.select("conv_id", "turn", "intent", "hint", "decompose", F.col("top_k").cast("int").alias("top_k"), "use_graph")


def comparison_split(spark, sf_dir):
    # exploded, so that the long expression is not copied into the condition
    q = _questions(spark, sf_dir).select("conv_id", "turn", F.explode(F.array(X.comparison(F.col("query")))).alias("s")).where("s IS NOT NULL")
    return q.select("conv_id", "turn", F.get("s", F.lit(0)).alias("left_side"), F.get("s", F.lit(1)).alias("right_side"))


def _window(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    body = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("document"), F.col("lang").alias("section"), F.array((F.col("doc_id") % 7 + 1).cast("string")).alias("pages"), F.col("text").alias("content"))
    return A.context_window(search._bm25(spark, sf_dir).drop("score").join(body, "id"))


def context_window_budget(spark, sf_dir):
    return _window(spark, sf_dir).select("query_id", "ref", "id", "block_tokens", "total_tokens")


def rag_prompts(spark, sf_dir):
    queries = _docs(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("Summarise "), "source").alias("query"))
    return A.prompts(queries, _window(spark, sf_dir)).select("query_id", F.sha2("user", 256).alias("prompt_sha256"), F.octet_length("user").cast("bigint").alias("bytes"))


def citation_verify(spark, sf_dir):
    turns = _turns(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    n = lambda c, m: ((c % m) + 1).cast("string")
    answers = turns.select(F.col("conv_id").alias("answer_id"), F.concat(F.lit("So it is [Ref "), n(F.col("turn"), 5), F.lit("], and [Ref 1, Ref "), n(F.col("conv_id"), 7), F.lit(", 2], not [3].")).alias("answer"))
    sources = answers.select("answer_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("ref"))
    return A.verify_citations(answers, sources)


def line_offsets(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return rows.groupBy("document_id").agg(F.count("*").alias("lines"), F.max("start").alias("last_start"), F.sum("start").alias("sum_start"))


def _markdown(spark, sf_dir) -> DataFrame:
    """Lines of the documents as Markdown: each sixth is a heading of level 1, 2 or 3."""
    rows = S.lines(_docs(spark, sf_dir), "doc_id", F.col("text"))
    mark = F.concat(F.repeat(F.lit("#"), (F.floor(F.col("ord") / 6) % 3 + 1).cast("int")), F.lit(" "))
    return rows.withColumn("line", F.when(F.col("ord") % 6 == 0, F.concat(mark, "line")).otherwise(F.col("line")))


def section_asof(spark, sf_dir):
    return S.section_of_lines(_markdown(spark, sf_dir)).groupBy("document_id", "section").agg(F.count("*").alias("n"))


def section_tree(spark, sf_dir):
    s = S.sections(_markdown(spark, sf_dir))
    return s.select("document_id", "ord", "level", "heading", "parent_ord", "section_path")


def page_marks(spark, sf_dir):
    rows = _markdown(spark, sf_dir)
    marked = F.when(F.col("ord") % 10 == 9, F.concat(F.lit("--- page "), F.col("ord").cast("string"), F.lit(" ---"))).when(F.col("ord") % 4 == 3, F.lit("<!-- pagebreak -->")).otherwise(F.col("line"))
    return S.page_of_lines(rows.withColumn("line", marked)).groupBy("document_id", "page").agg(F.count("*").alias("n"))


def _spans(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Pieces of size bytes of each document, from the number of its bytes."""
    ends = rows.select(F.col("doc_id").alias("document_id"), F.octet_length("text").cast("bigint").alias("n")).where("n > 0")
    piece = ends.select("document_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(size).cast("bigint"))).alias(f"{prefix}_start"))
    return piece.select("document_id", f"{prefix}_start", F.least(F.col(f"{prefix}_start") + size - 1, F.col("n") - 1).alias(f"{prefix}_end"))


def _line_spans(spark, sf_dir) -> DataFrame:
    rows = S.lines(_docs(spark, sf_dir), "doc_id", F.col("text")).where("line <> ''")
    return rows.select("document_id", "ord", F.col("start").alias("l_start"), (F.col("start") + F.octet_length("line") - 1).alias("l_end"))


def page_overlap(spark, sf_dir):
    """How many pages of 1,000 bytes each line touches, and the first of them."""
    hits = S.overlaps(_line_spans(spark, sf_dir), _spans(_docs(spark, sf_dir), 1000, "r"), "document_id")
    return hits.groupBy("document_id", "ord").agg(F.count("*").alias("pages"), (F.min("r_start") / 1000).cast("bigint").alias("first_page"))


def chunk_overlap(spark, sf_dir):
    hits = S.overlaps(_line_spans(spark, sf_dir), _spans(_docs(spark, sf_dir), 3000, "r"), "document_id")
    return hits.groupBy("document_id", "r_start").agg(F.count("*").alias("lines"))


def html_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?i)<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))).alias("n", "heading"))


def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count("*").alias("n"))


def _rich(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id").cast("string")
    tail = F.concat(F.lit("\n![figure "), i, F.lit("](img/"), i, F.lit('.png)\nas in ['), i, F.lit("] and [Smith et al., 2020] $$x = "), i, F.lit('$$\n<img src="a.png">\n<table><tr></tr></table> ISBN: 978-'), i, F.lit(" [^n"), i, F.lit("]"))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def assets_extract(spark, sf_dir):
    found = S.inline_assets(_rich(spark, sf_dir), "doc_id", F.col("text"))
    return found.groupBy("document_id", "asset_type", "subtype").agg(F.count("*").alias("n"), F.max("raw").alias("raw"))


def _lines_with_tables(spark, sf_dir) -> DataFrame:
    rows = S.lines(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return rows.withColumn("line", F.when(F.col("ord") % 5 < 2, F.concat(F.lit("| "), "line", F.lit(" |"))).otherwise(F.col("line")))


def table_islands(spark, sf_dir):
    runs = S.islands(_lines_with_tables(spark, sf_dir), S.table_line(F.col("line")))
    return runs.select("document_id", "first_ord", "last_ord", F.sha2("body", 256).alias("body_sha256"))


def code_blocks(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir), "doc_id", F.col("text")).withColumn("line", F.when(F.col("ord") % 4 == 1, F.lit("```sql")).otherwise(F.col("line")))
    return S.fenced(rows).where("code_no > 0").groupBy("document_id", "code_no").agg(F.count("*").alias("lines"))


def chunk_neighbors(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.lag("turn").over(order).alias("previous_turn"), F.lead("turn").over(order).alias("next_turn"), F.row_number().over(order).alias("chunk_order"))


def greedy_chunks(spark, sf_dir):
    """Lines packed by their token estimates into groups of 200."""
    sizes = F.transform(F.split("text", "\n"), X.token_estimate)
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.array_max(S.greedy_groups(sizes, 200)).cast("bigint").alias("groups"))


def block_parse(spark, sf_dir):
    return S.blocks(_rich(spark, sf_dir), "doc_id", "text").groupBy("document_id", "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def chunk_documents(spark, sf_dir):
    return S.chunks(S.blocks(_rich(spark, sf_dir), "doc_id", "text")).select("document_id", "chunk_id", "chunk_order", "is_parent", "tokens", "previous_id", "next_id", "content_hash")


from tessera.plans.documents_sql import ORACLE  # noqa: E402,F401

QUERIES = {f.__name__: f for f in (token_estimates, content_hash_groups, index_signature, corpus_fingerprint, point_id, language_detect, keyword_topk_global, keyword_by_source, summary_first_sentence, doc_summary, heading_normalize, slug_ascii, paragraph_categories, entity_mentions, mention_merge, entity_groups, relation_pairs, concept_rank, graph_nodes, graph_retrieve, graph_fusion, graph_bfs, diff_plan, upsert_latest, entity_evidence, state_transitions, intent_route, comparison_split, context_window_budget, rag_prompts, citation_verify, line_offsets, section_asof, section_tree, page_marks, page_overlap, chunk_overlap, html_headings, html_links, assets_extract, table_islands, code_blocks, chunk_neighbors, greedy_chunks, block_parse, chunk_documents)}
