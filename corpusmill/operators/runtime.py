"""The whole retrieval as one plan over a batch of questions: rankings, fusion, passages, reranking, diversity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import slow
from corpusmill.functions import text as t
from corpusmill.operators import dense, fusion, lexical, passages, references, search_text
from corpusmill.operators.staging import staged

#: How many passages a document offers, and how many the reranker sees, to how many characters.
PER_DOC, POOL, POOL_CHARS = 8, 16, 900
#: The weights of the older generation's sources.
OLDER_WEIGHTS = {"base": 1.0, "sections_leads": 2.0, "sections_leads_stem": 1.0, "dense": 1.0, "chunk_dense": 2.0}


@dataclass(frozen=True)
class Corpus:
    """``documents``: ``item, ref, title, base, leads, score_text``; ``chunks``: ``item, ref, path, legal, text``; vectors may be absent.

    ``base`` and ``leads`` are search texts, ``score_text`` what exact and prefix rankings compare with.
    """

    documents: DataFrame
    chunks: DataFrame
    document_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    top_docs: int = 8
    max_chunks: int = 8
    constant: int = 60
    use_lexical: bool = True
    use_anchor: bool = True
    stems: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))


def build_rankings(corpus: Corpus, queries: DataFrame, options: Options, query_vectors: DataFrame | None = None) -> DataFrame:
    """The first twenty documents of each source: ``query_id, source, src_ord, ref, score, rank``."""
    refs = corpus.documents.select("item", "ref")
    asked = queries.select("query_id", t.tokens(F.col("text")).alias("toks"))
    found = []
    if options.use_lexical:
        for source, column in (("base", "base"), ("sections_leads", "leads")):
            items = corpus.documents.select("item", t.tokens(F.col(column)).alias("toks"))
            found.append((source, lexical.rank(items, asked, 20).join(refs, "item")))
        if options.stems:
            # Written first: Python functions can't follow the lambdas that texts may be made with.
            leads, said = staged(corpus.documents.select("item", "leads"), "leads"), staged(queries.select("query_id", "text"), "said")
            items = leads.select("item", slow.stems(F.col("leads")).alias("toks"))
            stemmed = staged(said.select("query_id", slow.stems(F.col("text")).alias("toks")), "stemmed")
            found.append(("sections_leads_stem", lexical.rank(items, stemmed, 20).join(refs, "item")))
    if query_vectors is not None and corpus.document_vectors is not None:
        found.append(("dense", dense.nearest(corpus.document_vectors, query_vectors, 20).join(refs, "item")))
    if query_vectors is not None and corpus.chunk_vectors is not None:
        found.append(("chunk_dense", dense.nearest_owners(corpus.chunk_vectors, query_vectors, corpus.chunks.select("item", "ref"), 20)))
    out = None
    for source, df in found:
        one = df.select("query_id", F.lit(source).alias("source"), F.lit(fusion.SOURCES.index(source)).alias("src_ord"), "ref", "score", F.col("rank").cast("int").alias("rank"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source is enabled")
    return out


def confidences(rankings: DataFrame) -> DataFrame:
    """``query_id, source, confidence`` before anything is filtered, to six digits."""
    return fusion.profiles(rankings).groupBy("query_id", "source").agg(F.round(F.max("confidence"), 6).alias("confidence"))


def stage1(corpus: Corpus, queries: DataFrame, options: Options, query_vectors: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, ref, score``: fused documents, those named in the question first.

    ``queries(query_id, text, [prefix])``; a prefix adds a source and exempts its documents from the anchor filter.
    """
    rankings = staged(build_rankings(corpus, queries, options, query_vectors), "rankings")
    docs = corpus.documents.select("ref", F.col("score_text").alias("text"))
    exact = staged(references.exact_ranking(queries, docs, corpus.chunks.select("ref", "text")), "exact")
    source = lambda df, name: df.select("query_id", F.lit(name).alias("source"), F.lit(fusion.SOURCES.index(name)).alias("src_ord"), "ref", "score", F.col("rank").cast("int").alias("rank"))
    rankings = rankings.unionByName(source(exact, "exact_reference"))
    by_prefix = staged(references.prefix_ranking(queries, docs, corpus.chunks.select("ref", "text")), "prefix") if "prefix" in queries.columns else None
    if options.use_anchor:
        rankings = fusion.anchored(rankings, extra=None if by_prefix is None else by_prefix.select("query_id", "ref"))
    if by_prefix is not None:
        rankings = rankings.unionByName(source(by_prefix, "prefix_overlap"))
    fused = fusion.confidence_weighted(rankings, 20, options.constant, options.weights)
    return fusion.prepended(exact, fused).filter(F.col("rank") <= options.top_docs)


def retrieve(corpus: Corpus, queries: DataFrame, options: Options | None = None, query_vectors: DataFrame | None = None, reranker: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage-1 documents and final passages of all questions.

    ``reranker``: a Column over ``question``, ``passage`` (path and text, cut) that scores the first passages; then
    selection is diverse.  Without it the first passages stay as they are.  Passages: ``query_id, rank, ref, item, score``.
    """
    options = options or Options()
    docs = staged(stage1(corpus, queries, options, query_vectors), "stage1")
    hits = passages.direct_search(queries, docs, corpus.chunks, top_docs=options.top_docs, per_doc=PER_DOC, most=PER_DOC * options.top_docs)
    if reranker is None:
        best = hits.filter(F.col("global_rank") <= options.max_chunks)
        return docs, best.select("query_id", F.col("global_rank").alias("rank"), "ref", "item", F.col("local_score").alias("score"))
    pool = hits.filter(F.col("global_rank") <= POOL).join(corpus.chunks.select("item", "path", "text"), "item").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    pool = pool.withColumn("passage", F.concat_ws("\n", F.array_join("path", " > "), F.left("text", F.lit(POOL_CHARS)))).withColumn("rank", F.col("global_rank"))
    ranked = dense.rerank(pool, reranker, min(options.max_chunks * 3, POOL)).select("query_id", F.col("new_rank").alias("rank"), "ref", "path", "item", F.col("rerank_score").alias("score"))
    ranked = staged(ranked, "reranked")
    picks = passages.diverse(ranked, options.max_chunks)
    return docs, picks.join(ranked.select("query_id", "item", "ref", "score"), ["query_id", "item"]).select("query_id", F.col("pick").alias("rank"), "ref", "item", "score")


def retrieve_older(corpus: Corpus, queries: DataFrame, mapping: DataFrame, query_vectors: DataFrame | None = None, top_docs: int = 5, per_doc: int = 3, max_chunks: int = 8) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The older generation's whole retrieval: expanded questions, documents, passages, and the families of the first two documents.

    ``queries(query_id, text)``; ``mapping(acronym, phrase)`` as :func:`corpusmill.operators.references.acronym_map` makes it.  Lexical
    rankings and passages are searched for with the expanded question; vectors, specificity and evidence go by the question itself.
    """
    expanded = staged(references.expand_queries(queries, mapping).join(queries.select("query_id"), "query_id"), "expanded")
    asked = expanded.select("query_id", F.col("expanded").alias("text"))
    rankings = staged(build_rankings(corpus, asked, Options(stems=True), query_vectors), "rankings")
    fused = staged(fusion.confidence_weighted(rankings, 20, 60, OLDER_WEIGHTS).select("query_id", "ref", "score", "rank"), "fused")
    tails = staged(corpus.documents.select("ref", search_text.document_title_tail(F.col("ref"), F.col("title")).alias("tail")), "tails")
    docs = references.specificity(fused, tails, queries, top=5, weight=0.05, stem=slow.stems).filter(F.col("rank") <= top_docs).select("query_id", "rank", "ref", "score")
    docs = staged(docs, "stage1")
    hits = passages.direct_search(expanded.select("query_id", "text", F.col("expanded").alias("search")), docs, corpus.chunks, top_docs=top_docs, per_doc=per_doc, most=max_chunks)
    found = hits.select("query_id", F.col("global_rank").alias("rank"), "ref", "item", F.col("local_score").alias("score"))
    return expanded, docs, found, references.family_union(docs, corpus.documents.select("ref"), 2)
