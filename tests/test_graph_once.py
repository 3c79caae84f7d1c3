from foliomill import queries
from foliomill.operators import vectors


def test_a_graph_is_searched_for_once(spark, sf, monkeypatch):
    calls, search = [], vectors.knn_edges
    monkeypatch.setattr(vectors, "knn_edges", lambda *args, **options: calls.append(1) or search(*args, **options))
    queries.graph_nodes(spark, sf)
    assert len(calls) == 1
