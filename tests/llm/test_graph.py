import random

from lectern.llm.graph import connected_components


def components(spark, edges):
    return {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long, m long, key string")).collect()}


def test_roots_are_the_least_nodes(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300), 7, "x") for _ in range(220)] + [(1000 + i, 1001 + i, 7, "x") for i in range(60)] + [(5, 5, 1, "x"), (2000, 2000, 1, None)]
    root = {x: x for e in edges for x in e[:2]}
    changed = True
    while changed:
        changed = False
        for u, v, *_ in edges:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    in_edges = {x for u, v, *_ in edges if u != v for x in (u, v)}
    assert components(spark, edges) == {x: y for x, y in root.items() if x in in_edges}


def test_nothing_to_join(spark):
    assert components(spark, []) == {}
    assert components(spark, [(3, 3, 1, "x"), (None, 4, 1, "x"), (4, None, 1, None)]) == {}
