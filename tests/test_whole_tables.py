"""Queries that ask with a whole table, against brute force on small fixtures of more rows than the subsets the SQL names."""

from collections import defaultdict

import numpy as np
import pytest

from evispan import catalogue
from evispan.operators import graph


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 8)).astype(np.float32)
    x[300:330] = x[5]  # ties
    label = r.integers(0, 5, 700)
    out = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{out}/embeddings.parquet")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    sim = np.round(np.clip(u @ u.T, -1, 1), 9)
    return out, sim, [np.lexsort((np.arange(700), -s))[:20].tolist() for s in sim], [np.flatnonzero(label == c)[:20].tolist() for c in label]


def test_every_vector_is_a_query(spark, vectors):
    out, sim, best, _ = vectors
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in catalogue.queries()["vector_topk_all"](spark, out).collect()}
    assert set(got) == {(q, n + 1) for q in range(700) for n in range(10)}
    assert all(got[q, n + 1][0] == best[q][n] and abs(got[q, n + 1][1] - sim[q][best[q][n]]) < 2e-6 for q in range(700) for n in range(10))


@pytest.mark.parametrize("name, weight, most", [("rrf_fusion_all", 1.0, 40), ("rrf_weighted_all", 0.25, 40), ("hybrid_topk_all", 0.5, 5)])
def test_every_vector_is_fused(spark, vectors, name, weight, most):
    out, _, best, same = vectors
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["first_rank"], r["second_rank"]) for r in catalogue.queries()[name](spark, out).collect()}
    want = {}
    for q in range(700):
        one, two = ({c: n + 1 for n, c in enumerate(own)} for own in (best[q], same[q]))
        score = {c: (1 / (60 + one[c]) if c in one else 0) + (weight / (60 + two[c]) if c in two else 0) for c in {*one, *two}}
        order = sorted((c for c in score if score[c] > 0), key=lambda c: (-score[c], c))[:most]
        want |= {(q, n + 1): (c, one.get(c), two.get(c)) for n, c in enumerate(order)}
    assert got == want


def test_every_vector_has_a_group_rank(spark, vectors):
    out, _, best, _ = vectors
    got = {r["query_id"]: (r["first_rank"], r["group_rank"]) for r in catalogue.queries()["group_rank_all"](spark, out).collect()}
    for q in range(700):
        ranks = [best[q].index(c) + 1 if c in best[q] else None for c in (q, q + 1) if c < 700]
        seen = [r for r in ranks if r]
        assert got[q] == (min(seen, default=None), max(ranks) if None not in ranks else None)
    assert len(got) == 700


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """60 customers, a busy one, hubs and parallel edges."""
    r, out = np.random.default_rng(6), str(tmp_path_factory.mktemp("star"))
    put = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{out}/{name}.parquet")
    put("nation", [(n, n % 2) for n in range(3)], "n_nationkey int, n_regionkey int")
    put("supplier", [(k, k % 3) for k in range(1, 9)], "s_suppkey int, s_nationkey int")
    put("customer", [(k, k % 3) for k in range(1, 61)], "c_custkey int, c_nationkey int")
    orders = [(k, 7 if k < 25 else int(r.integers(1, 61))) for k in range(1, 200)]
    put("orders", orders, "o_orderkey int, o_custkey int")
    put("lineitem", [(k, n, 1 + int(r.integers(0, 8)) if k % 5 else 3) for k, _ in orders for n in range(1, 8)], "l_orderkey int, l_linenumber int, l_suppkey int")
    return out


def _paths(out, edges, hops):
    adj = defaultdict(lambda: defaultdict(set))
    for edge, a, b in edges:
        adj[a][b].add(edge)
        adj[b][a].add(edge)
    want = {}
    for c in range(1, 61):
        level, n = [([f"c{c}"], [])], 1
        want[c, 1] = (0, f"c{c}", "")
        for hop in range(1, hops + 1):
            found = [(nodes + [x], via + [e]) for nodes, via in level for x in sorted(y for y in adj[nodes[-1]] if y not in nodes)[:16] for e in sorted(adj[nodes[-1]][x])[:4]]
            level = found[: max(0, 256 - n)]
            for k, (nodes, via) in enumerate(level):
                want[c, n + k + 1] = (hop, ">".join(nodes), ">".join(via))
            n += len(level)
    return want


@pytest.mark.parametrize("hops", [1, 2])
def test_walks_start_from_every_customer(spark, star, hops):
    edges = [(r["edge_id"], r["src"], r["dst"]) for r in catalogue.i.edges(spark, star).collect()]
    got = {(r["query_id"], r["admitted"]): (r["hops"], r["path"], r["via"]) for r in catalogue.queries()[f"graph_walk_{hops}hop_all"](spark, star).collect()}
    assert got == _paths(star, edges, hops)
    assert hops == 1 or max(n for _, n in got) > 40


def test_every_customer_has_ranked_chunks(spark, star):
    edges = [(r["edge_id"], r["src"], r["dst"]) for r in catalogue.i.edges(spark, star).collect()]
    hops = defaultdict(dict)
    for (c, _), (hop, path, via) in sorted(_paths(star, edges, 1).items()):
        for chunk in ["m:" + path.split(">")[-1], *(["e:" + via] if via else [])]:
            hops[c].setdefault(chunk, hop)
    want = {(c, n + 1): (x, own[x]) for c, own in hops.items() for n, x in enumerate(sorted(own, key=lambda x: (own[x], x))[:10])}
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["min_hops"]) for r in catalogue.queries()["graph_rank_chunks_all"](spark, star).collect()} == want


def test_hub_is_cut_before_the_paths_meet_it(spark):
    adj = spark.createDataFrame([("h", f"e{n:03}{k}", f"n{n:03}") for n in range(50) for k in range(6)], "node string, edge_id string, next string")
    got = sorted(tuple(r) for r in graph.nearest_neighbors(adj, 18, 4).collect())
    assert got == sorted(("h", f"e{n:03}{k}", f"n{n:03}") for n in range(18) for k in range(4))


def test_every_part_is_linked(spark, tmp_path):
    names = [f"{'red blue green'.split()[n % 3]} part{n:03}" for n in range(250)]
    spark.createDataFrame([(n + 1, x) for n, x in enumerate(names)], "p_partkey int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["link_query_longest"](spark, str(tmp_path)).collect())
    assert got == [(n + 1, len("which "), x, 1) for n, x in enumerate(names)]
