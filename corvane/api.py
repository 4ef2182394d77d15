"""The library's front door: build, search, deliver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import deliver as dv
from corvane.operators import fusion as fu
from corvane.operators import index as ix
from corvane.operators import rank as rk
from corvane.session import cut

LEXICAL = ("linear", "fts", "bm25plus", "body", "prf")
RANKERS = (*LEXICAL, "dense", "hybrid", "hybrid-full", "fused")
#: The legs that a served fusion may name.
FUSE_LEGS = ("fts", "linear", "prf")
#: Fixed value: how many times the pool each leg of a hybrid is fetched.
OVERFETCH = 8


@dataclass(frozen=True)
class Profile:
    """The closed vocabularies of a corpus, and the types a search leaves out unless it says otherwise."""

    domains: tuple[str, ...]
    types: tuple[str, ...]
    excluded_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchRequest:
    """What a batch of queries asks for. Filters are lists of allowed values; None passes all, an empty list is refused.

    types, exclude_types and include_history each state the type filter, so at most one of them may be given. overhead is what the
    rendering itself takes of the budget. legs: the legs of ranker 'fused', two or more.
    """

    k: int = 10
    ranker: str = "linear"
    analyzer: str = tx.DEFAULT_ANALYZER
    domains: list[str] | None = None
    types: list[str] | None = None
    exclude_types: list[str] | None = None
    include_history: bool = False
    max_per_doc: int | None = dv.MAX_PER_DOC
    budget: int | None = None
    overhead: int = 0
    as_of: str | None = None
    dense_weight: float = 0.5
    legs: tuple[str, ...] = ("fts", "linear")


def type_filter(request: SearchRequest, profile: Profile | None) -> list[str] | None:
    """The allowed types: those named, else the vocabulary without the exclusion in force; None where nothing is excluded."""
    if request.types is not None:
        return request.types
    if profile is None:
        if request.exclude_types:
            raise ValueError("exclude_types needs a profile, which names the types there are")
        return None
    excluded = () if request.include_history else profile.excluded_types if request.exclude_types is None else request.exclude_types
    if not excluded:
        return None
    kept = [t for t in profile.types if t not in excluded]
    if not kept:
        raise ValueError("every type is excluded, so nothing could be searched")
    return kept


def check(request: SearchRequest, profile: Profile | None) -> None:
    """A value outside its vocabulary is an error that names the vocabulary, never a filter that is dropped."""
    given = [n for n, x in (("types", request.types is not None), ("exclude_types", request.exclude_types is not None), ("include_history", request.include_history)) if x]
    if len(given) > 1:
        raise ValueError(f"{' and '.join(given)} each state the type filter: give one of them")
    asked = [("ranker", [request.ranker], RANKERS), ("analyzer", [request.analyzer], tuple(tx.ANALYZERS))]
    if profile is not None:
        asked += [("domain", request.domains or [], profile.domains), ("type", [*(request.types or []), *(request.exclude_types or [])], profile.types)]
    if request.ranker == "fused":
        asked.append(("leg", list(request.legs), FUSE_LEGS))
        if len(request.legs) < 2 or len(set(request.legs)) < len(request.legs):
            raise ValueError("a fusion needs two or more different legs")
    for name, values, known in asked:
        for v in values:
            if v not in known:
                raise ValueError(f"unknown {name} {v!r}: one of {', '.join(known)}")
    if request.budget is not None and not 0 <= request.overhead <= request.budget:
        raise ValueError("overhead must lie between 0 and the budget")


def lexical_leg(ranker: str, queries: DataFrame, atoms: DataFrame, analyzer: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """(query_id, atom_id, score, rank): the k best of one lexical ranker, of the atoms `among`; statistics cover all atoms."""
    if ranker == "fts":
        plain = "nostem-fold" if tx.ANALYZERS[analyzer][1] or tx.ANALYZERS[analyzer][2] else analyzer
        placed = cut(ix.placed_fields(ix.indexed_fields(atoms), plain, ("body",)))
        return rk.fts_top(placed, plain, rk.disjuncts(queries, plain), {"body": 1.0}, k, among=among)
    title_and_body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    idx = ix.Index.build(atoms, analyzer, title_and_body if ranker == "linear" else F.col("body")).stored()
    terms = rk.query_terms(queries, analyzer)
    if ranker == "prf":
        weights = rk.rm3_weights(rk.query_terms(queries, analyzer, distinct=False), rk.bm25_top(idx, terms, 10), idx.postings)
        return rk.weighted_top(idx, weights, k, among=among)
    return rk.bm25_top(idx, terms, k, among=among, **({"b": 0.7, "delta": 0.5} if ranker == "bm25plus" else {}))


def dense_leg(vectors: DataFrame, query_vectors: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """(query_id, atom_id, score, rank): the k nearest of the vectors (atom_id, embedding), of the atoms `among`."""
    base = vectors if among is None else vectors.join(among, "atom_id", "left_semi")
    return rk.dense_knn(base.select(F.col("atom_id").alias("vec_id"), "embedding"), query_vectors, k).withColumnRenamed("vec_id", "atom_id")


def candidates(request: SearchRequest, queries: DataFrame, atoms: DataFrame, k: int, among: DataFrame | None, vectors: DataFrame | None, query_vectors: DataFrame | None) -> DataFrame:
    """(query_id, atom_id, score, rank) of the request's ranker, down to k (hybrid-full: the whole union of the legs' heads)."""
    if request.ranker in LEXICAL:
        return lexical_leg(request.ranker, queries, atoms, request.analyzer, k, among)
    if request.ranker == "fused":
        legs = None
        for leg in request.legs:
            part = lexical_leg(leg, queries, atoms, request.analyzer, k, among).select(F.lit(leg).alias("leg"), "query_id", "atom_id", "rank")
            legs = part if legs is None else legs.unionByName(part)
        weights = queries.sparkSession.createDataFrame([("served", leg, 1.0 / len(request.legs)) for leg in request.legs], "fusion string, leg string, weight double")
        return fu.fuse_many(legs, weights, depth=k).drop("fusion")
    if vectors is None or query_vectors is None:
        raise ValueError(f"ranker {request.ranker!r} needs vectors of the atoms and of the queries")
    if request.ranker == "dense":
        return dense_leg(vectors, query_vectors, k, among)
    # Each leg is fetched deeper than k; hybrid cuts the fused order, hybrid-full the legs.
    lexical, dense = lexical_leg("body", queries, atoms, request.analyzer, k * OVERFETCH, among), dense_leg(vectors, query_vectors, k * OVERFETCH, among)
    if request.ranker == "hybrid-full":
        return fu.fuse_legs(lexical, dense, request.dense_weight, leg_cut=k)
    return fu.fuse_legs(lexical, dense, request.dense_weight).where(F.col("rank") <= k)


def search(queries: DataFrame, atoms: DataFrame, request: SearchRequest = SearchRequest(), profile: Profile | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, atom_id, document, rank, place, score, title, body) delivered for each query (query_id, query_text).

    In this order: score all atoms (statistics cover every atom, whatever is filtered), filter, cap per document, cut to k, reading order,
    byte budget. A query without hits has no row. vectors (atom_id, embedding) and query_vectors (query_id, embedding) serve the dense
    and hybrid rankers.
    """
    check(request, profile)
    types = type_filter(request, profile)
    facts = atoms.where(dv.member_of("x_domain", request.domains) & dv.member_of("atom_type", types))
    if request.as_of is not None:
        facts = facts.where(dv.is_retrievable(request.as_of))
    facts = facts.select("atom_id", F.coalesce(F.get("sources", F.lit(0)), F.col("atom_id")).alias("document"), "origin_index")
    filtered = request.domains is not None or types is not None or request.as_of is not None
    size = dv.pool_size(request.k, request.max_per_doc)
    # The pool is at most a few hundred rows a query; what the atoms say is joined to it, not it to them.
    pool = candidates(request, queries, atoms, size, facts.select("atom_id") if filtered else None, vectors, query_vectors).join(facts, "atom_id")
    served = dv.renumber(dv.cap_per_document(pool, request.max_per_doc or 0), request.k)
    # Bodies are joined only to what is served.
    placed = dv.reading_order(served).join(atoms.select("atom_id", "title", "body"), "atom_id")
    if request.budget is not None:
        kept = dv.fit_budget(placed.select("query_id", "atom_id", "rank", "body"), tx.byte_size(F.coalesce("body", F.lit(""))), request.budget, request.overhead)
        placed = placed.join(kept.select("query_id", "atom_id"), ["query_id", "atom_id"], "left_semi")
    return placed.select("query_id", "atom_id", "document", "rank", "place", "score", "title", "body")
