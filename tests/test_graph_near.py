"""A traversal that asks for the edges of its nodes alone."""

from attestor.operators import graph, pairs

from .test_jobs_and_retrieval import claims_of


def test_edges_by_nodes_give_the_same_neighborhoods(spark):
    rows = claims_of(spark, 12).localCheckpoint()
    evidence = rows.selectExpr("fact_id", "doc_id", "explode(array(0, 1)) as nth")
    seen = []

    def relate(claims):
        seen.append(claims.select("subject").distinct().count())
        return pairs.relations(pairs.cluster_pairs(claims))

    full = graph.edges(rows, evidence, pairs.relations(pairs.cluster_pairs(rows))).localCheckpoint()
    shown = lambda df: {tuple(r) for r in df.collect()}
    for root, depth, nodes in (("entity:s1", 2, 7), (f"evidence:{rows.first()['fact_id']}#1", 2, 1000)):
        near = lambda asked: graph.edges_near(rows, evidence, relate, asked)
        assert shown(graph.neighborhood(near, root, depth, nodes, spark=spark)) == shown(graph.neighborhood(full, root, depth, nodes)), root
    assert seen[0] == 0 and min(n for n in seen if n) == 1
