"""Queries on retrieval: documents with their vectors, blocked by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import adaptive, retrieval, tiles
from ..sources.claims import CLAIMS_SQL, claims, table
from .pair_queries import RELATIONS_SQL

N_QUERIES = 10


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _queries(spark, sf_dir):
    """The stated query set: vectors whose id 20 divides."""
    return _vectors(spark, sf_dir).where("vec_id % 20 = 0")


def _index(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", "label", F.col("embedding").alias("v"))


def _asked(spark, sf_dir, everything: bool = False):
    rows = _vectors(spark, sf_dir) if everything else _queries(spark, sf_dir)
    return rows.select(F.col("vec_id").alias("query"), "label", F.col("embedding").alias("v"))


def _best_semantic(spark, sf_dir, k, everything: bool = False):
    """Rows that hold the k nearest of each query."""
    return tiles.best(_index(spark, sf_dir), _asked(spark, sf_dir, everything), "vec_id", "label", "semantic", k)


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with vectors and terms: each query vector's document asks, with all its words, for the documents that share any."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(index.select("vec_id"), "vec_id", "left_semi")
    weighted, wanted = retrieval.weighted_terms(docs, _queries(spark, sf_dir), "vec_id", "text")
    return index.join(weighted, "vec_id", "left"), asked.join(wanted, "query", "left")


CHANNELS = ("lexical", "semantic")


def t01_cosine_topk(spark, sf_dir):
    return retrieval.top(_best_semantic(spark, sf_dir, 10), "vec_id", 10).select("query", "vec_id", "score", "rank")


def t02_bm25_topk(spark, sf_dir):
    index, asked = (df.drop("v") for df in _both(spark, sf_dir))
    return retrieval.top(tiles.best(index, asked, "vec_id", "label", "lexical", 10), "vec_id", 10).select("query", "vec_id", "score", "rank")


def w01_channel_rank(spark, sf_dir):
    hits = tiles.pairs(_index(spark, sf_dir), _asked(spark, sf_dir), "vec_id", "label", ("semantic",))
    return retrieval.ranked(hits.select("query", "vec_id", "semantic"), "vec_id", "semantic").select("query", "vec_id", "rank")


def w02_minmax(spark, sf_dir):
    hits = tiles.normal_pairs(_index(spark, sf_dir), _asked(spark, sf_dir), "vec_id", "label", ("semantic",))
    return hits.select("query", "vec_id", F.round("semantic", 5).alias("normal"))


def _fused(spark, sf_dir, k=None, config=retrieval.RetrievalConfig()):
    """Both channels of every pair of a block, or of pairs that hold the k best of each query."""
    return tiles.normal_pairs(*_both(spark, sf_dir), "vec_id", "label", CHANNELS, (config.lexical_weight, config.semantic_weight), k)


def _hybrid_ranks(spark, sf_dir, k):
    """The k best of each query by both channels; scores that differ after the sixth digit tie."""
    return retrieval.top(_fused(spark, sf_dir, k).withColumn("score", F.round("hybrid", 6)), "vec_id", k)


def j05_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query", "vec_id", F.round("lexical", 4).alias("lexical"), F.round("semantic", 4).alias("semantic"))


def w03_hybrid(spark, sf_dir):
    return _hybrid_ranks(spark, sf_dir, 5).select("query", "vec_id", F.round("hybrid", 4).alias("hybrid"))


def w04_adaptive_ladder(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query"), "label")
    # all rows of the block but the query's own
    counts = v.join(v.groupBy("label").agg(F.count("*").alias("n")), "label").join(v.groupBy("label", "query").agg(F.count("*").alias("own")), ["label", "query"])
    counts = counts.groupBy("query").agg(F.sum(F.col("n") - F.col("own")).alias("n")).where("n > 0")
    rung, rounds, reason = retrieval.ladder(F.col("n"))
    return counts.select("query", "n", rung.alias("rung"), rounds.alias("rounds"), reason.alias("reason"))


def _surfaced(spark, sf_dir):
    return retrieval.candidate_pairs(_best_semantic(spark, sf_dir, 10, everything=True), "vec_id", 10).select("one", "other")


def j03_candidate_pairs(spark, sf_dir):
    return _surfaced(spark, sf_dir)


def j06_annotate(spark, sf_dir):
    hits = retrieval.top(_best_semantic(spark, sf_dir, 10), "vec_id", 10)
    known = _vectors(spark, sf_dir).where("vec_id % 7 <> 0").withColumn("label", F.when(F.col("vec_id") % 5 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return retrieval.annotate(hits, known, "vec_id", "label").groupBy("query", "status", "reason").agg(F.count("*").alias("n"))


def _known(spark, sf_dir):
    """Vectors of one label whose ids differ by less than 30."""
    return retrieval.near_ids(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", "label", 30)


def a15_recall_at_k(spark, sf_dir):
    """Known pairs: vectors of one label whose ids differ by less than 30. A rank over the largest level counts as none, so no further ranks are needed."""
    return retrieval.recall_at(_known(spark, sf_dir), retrieval.top(_best_semantic(spark, sf_dir, 100, everything=True), "vec_id", 100), "vec_id")


def a21_index_stats(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("bucket_size"), F.max(F.size("embedding")).alias("dimension"))


def a22_candidate_funnel(spark, sf_dir):
    return retrieval.funnel_counts(tiles.extents(*_both(spark, sf_dir), "vec_id", "label", CHANNELS), 10)


def a14_diagnostics(spark, sf_dir):
    found = tiles.extents(_index(spark, sf_dir), _asked(spark, sf_dir, everything=True), "vec_id", "label", ("semantic",))
    return found.select("query", "n", F.col("semantic_low").alias("low"), F.col("semantic_high").alias("high"))


def p16_metadata_filter(spark, sf_dir):
    """The filter is the feature: only rows whose label is at most 3 may be found."""
    hits = tiles.best(_index(spark, sf_dir).where("label <= 3"), _asked(spark, sf_dir), "vec_id", "label", "semantic", 5)
    return retrieval.top(hits, "vec_id", 5).select("query", "vec_id", "rank")


def p17_query_words(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(texts.query_tokens(F.concat(F.lit("subject: "), F.col("c_name"), F.lit(" measure order_total scope unknown"))), " ").alias("words"))


def f67_normalized(spark, sf_dir):
    v = retrieval.normalized(F.col("embedding"))
    return _vectors(spark, sf_dir).select("vec_id", F.round(retrieval.dot(v, v), 6).alias("norm"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


def j04_relations(spark, sf_dir):
    """All claims, with a budget that no block exceeds: the relations of all pairs."""
    rows = claims(spark, sf_dir)
    largest = rows.groupBy(*adaptive.BLOCK).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    found = adaptive.relations(rows, mode="retrieval", knobs=adaptive.Knobs(k_ladder=(10, max(11, largest))))
    return found.select(F.least("source_id", "target_id").alias("one"), F.greatest("source_id", "target_id").alias("other"), "relation", "reason_code")


def j04_terminations(spark, sf_dir):
    """Why each claim's search ended, on the standard ladder."""
    return adaptive.search(claims(spark, sf_dir)).ends().groupBy("k", "rounds", "reason", "bounded").agg(F.count("*").alias("n"), F.sum("retrieved").alias("retrieved"), F.sum("unblocked").alias("unblocked"))


def j04_blocked(spark, sf_dir):
    """Claims against an authoritative set that lacks some ids and has others in another block: those are blocked."""
    rows = claims(spark, sf_dir)
    known = rows.where("seq % 9 > 0").withColumn("measure", F.when(F.col("seq") % 4 == 0, "other").otherwise(F.col("measure")))
    ends = adaptive.search(rows, known=known, knobs=adaptive.Knobs(k_ladder=(1000,))).ends()
    counts = [F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("blocking_reason"), F.col(c).alias("n")) for status, reason, c in (("candidate", None, "unblocked"), ("blocked", "UNKNOWN_FACT_ID", "unknown"), ("blocked", "BLOCK", "elsewhere"))]
    return ends.select(F.explode(F.array(*counts)).alias("c")).groupBy("c.status", "c.blocking_reason").agg(F.sum("c.n").alias("n")).where("n > 0")


QUERIES = {
    "J-04_retrieval_relations": j04_relations, "J-04_terminations": j04_terminations, "J-04_blocked": j04_blocked,
    "T-01_cosine_topk": t01_cosine_topk, "T-02_bm25_topk": t02_bm25_topk, "W-01_channel_rank": w01_channel_rank, "W-02_minmax": w02_minmax,
    "J-05_fusion": j05_fusion, "W-03_hybrid": w03_hybrid, "W-04_adaptive_ladder": w04_adaptive_ladder, "J-03_candidate_pairs": j03_candidate_pairs,
    "J-06_annotate": j06_annotate, "A-14_diagnostics": a14_diagnostics, "A-15_recall_at_k": a15_recall_at_k, "A-21_index_stats": a21_index_stats,
    "A-22_candidate_funnel": a22_candidate_funnel, "P-16_metadata_filter": p16_metadata_filter, "P-17_query_words": p17_query_words, "F-67_normalized": f67_normalized,
}

_UNIT = "list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double)))))"


def _semantic_sql(queries: str = "vec_id % 20 = 0", index: str = "true") -> str:
    return f"""v as (select vec_id, label, {_UNIT} as u from embeddings),
sem as (select q.vec_id as query, d.vec_id, d.label, round(list_sum(list_transform(list_zip(q.u, d.u), lambda p: p[1] * p[2])), 6) as score
    from (select * from v where {queries}) q join (select * from v where {index}) d on q.label = d.label and q.vec_id <> d.vec_id)"""


_LEX = """words as (select doc_id as vec_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') as w from documents where doc_id in (select vec_id from embeddings)),
idx as (select vec_id, term, len(any_value(w)) as length, count(*) as tf from (select vec_id, w, unnest(w) as term from words) group by vec_id, term),
tot as (select count(*) as big_n, avg(len(w)) as mean from words where len(w) > 0),
qt as (select distinct vec_id as query, unnest(w) as term from words where vec_id % 20 = 0),
df as (select term, count(*) as n from idx where term in (select term from qt) group by term),
raw as (select query, idx.vec_id, sum(greatest(1e-6, ln((big_n - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score
    from idx join qt using (term) join df using (term) cross join tot group by all),
lex as (select query, raw.vec_id, round(score, 6) as score from raw join embeddings a on raw.vec_id = a.vec_id join embeddings b on query = b.vec_id where a.label = b.label and query <> raw.vec_id)"""


def _normal(channel: str) -> str:
    return f"(select query, vec_id, case when min(score) over w = max(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as normal from {channel} window w as (partition by query))"


_FUSED = f"""{_semantic_sql()}, {_LEX},
fused as (select coalesce(l.query, s.query) as query, coalesce(l.vec_id, s.vec_id) as vec_id, coalesce(l.normal, 0.0) as lexical, coalesce(s.normal, 0.0) as semantic
    from {_normal("lex")} l full outer join {_normal("sem")} s on l.query = s.query and l.vec_id = s.vec_id)"""
_RANK = "cast(row_number() over (partition by query order by score desc, vec_id) as integer)"

_BLOCKS = f"{CLAIMS_SQL}, b as (select seq, count(*) over (partition by subject, measure, value_kind) - 1 as n from claims)"

SQL = {
    "J-04_retrieval_relations": f"with {RELATIONS_SQL} select least(source_id, target_id) as one, greatest(source_id, target_id) as other, relation, reason_code from relations",
    "J-04_terminations": f"""with {_BLOCKS}, e as (select *, case when n < 10 then 10 when n < 25 then 25 when n < 50 then 50 else 100 end as k from b)
        select cast(k as integer) as k, cast(case k when 10 then 1 when 25 then 2 when 50 then 3 else 4 end as integer) as rounds, case when n = 0 then 'no_candidates_found' when n < k then 'no_further_candidates' else 'budget_exhausted' end as reason,
            n >= k as bounded, count(*) as n, cast(sum(least(n, k)) as bigint) as retrieved, cast(sum(least(n, k)) as bigint) as unblocked from e group by all""",
    "J-04_blocked": f"""with {CLAIMS_SQL}, p as (select case when b.seq % 9 = 0 then 'UNKNOWN_FACT_ID' when (b.seq % 4 = 0) then 'BLOCK' end as blocking_reason from claims a join claims b on a.subject = b.subject and a.measure = b.measure and a.value_kind = b.value_kind and a.seq <> b.seq)
        select case when blocking_reason is null then 'candidate' else 'blocked' end as status, blocking_reason, count(*) as n from p group by all""",
    "T-01_cosine_topk": f"with {_semantic_sql()}, r as (select query, vec_id, score, {_RANK} as rank from sem) select * from r where rank <= 10",
    "T-02_bm25_topk": f"with {_LEX}, r as (select query, vec_id, score, {_RANK} as rank from lex) select * from r where rank <= 10",
    "W-01_channel_rank": f"with {_semantic_sql()} select query, vec_id, {_RANK} as rank from sem",
    "W-02_minmax": f"with {_semantic_sql()} select query, vec_id, round(normal, 5) as normal from {_normal('sem')}",
    "J-05_fusion": f"with {_FUSED} select query, vec_id, round(lexical, 4) as lexical, round(semantic, 4) as semantic from fused",
    "W-03_hybrid": f"with {_FUSED}, h as (select query, vec_id, 0.45 * lexical + 0.55 * semantic as hybrid from fused), r as (select *, row_number() over (partition by query order by round(hybrid, 6) desc, vec_id) as rank from h) select query, vec_id, round(hybrid, 4) as hybrid from r where rank <= 5",
    "W-04_adaptive_ladder": "with n as (select a.vec_id as query, count(*) as n from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by all) select query, n, cast(case when n < 10 then 10 when n < 25 then 25 when n < 50 then 50 else 100 end as integer) as rung, cast(case when n < 10 then 1 when n < 25 then 2 when n < 50 then 3 else 4 end as integer) as rounds, case when n < 100 then 'no_further_candidates' else 'budget_exhausted' end as reason from n",
    "J-03_candidate_pairs": f"with {_semantic_sql('true')}, r as (select query, vec_id, {_RANK} as rank from sem) select distinct least(query, vec_id) as one, greatest(query, vec_id) as other from r where rank <= 10",
    "J-06_annotate": f"with {_semantic_sql()}, r as (select query, vec_id, label, {_RANK} as rank from sem), x as (select query, case when r.vec_id % 7 = 0 then 'UNKNOWN_FACT_ID' when r.vec_id % 5 = 0 then 'BLOCK' end as reason from r where rank <= 10) select query, case when reason is null then 'candidate' else 'blocked' end as status, reason, count(*) as n from x group by all",
    "A-14_diagnostics": f"with {_semantic_sql('true')} select query, count(*) as n, min(score) as low, max(score) as high from sem group by query",
    "A-15_recall_at_k": f"with {_semantic_sql('true')}, r as (select query, vec_id, {_RANK} as rank from sem), b as (select least(query, vec_id) as one, greatest(query, vec_id) as other, min(rank) as rank from r group by all), k as (select a.vec_id as one, c.vec_id as other from embeddings a join embeddings c on a.label = c.label and a.vec_id < c.vec_id and c.vec_id < a.vec_id + 30) select "
    + ", ".join(f"round(avg(cast(coalesce(rank <= {n}, false) as integer)), 6) as recall_{n}" for n in (10, 25, 50, 100))
    + " from k left join b using (one, other)",
    "A-21_index_stats": "select label, count(*) as bucket_size, cast(max(len(embedding)) as integer) as dimension from embeddings group by label",
    "A-22_candidate_funnel": f"with {_FUSED}, f as (select query, count(*) as fused from fused group by query), l as (select query, count(*) as lexical from lex group by query), s as (select query, count(*) as semantic from sem group by query) select query, fused, coalesce(lexical, 0) as lexical, coalesce(semantic, 0) as semantic, least(fused, 10) as kept from f left join l using (query) left join s using (query)",
    "P-16_metadata_filter": f"with {_semantic_sql(index='label <= 3')}, r as (select query, vec_id, {_RANK} as rank from sem) select * from r where rank <= 5",
    "P-17_query_words": "select c_custkey, concat(array_to_string(regexp_extract_all(lower(c_name), '[a-z0-9_]+'), ' '), ' order_total unknown') as words from customer",
    "F-67_normalized": f"select vec_id, round(list_sum(list_transform({_UNIT}, lambda x: x * x)), 6) as norm, round({_UNIT}[1], 6) as first from embeddings",
}
