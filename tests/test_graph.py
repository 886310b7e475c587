"""Traversals against plain Python on random graphs, and the policies' table."""

from collections import defaultdict, deque
from random import Random

import pytest

from tessera.operators import merge, traverse
from tessera.operators.edges import is_test_symbol
from tessera.policy import CERTIFICATION, DIAGNOSTIC, IMPACT, TESTS
from tessera.schemas import CLOSURE_TYPES, EDGE_TYPES, EDGES, SYMBOLS, complete

REASONS = ["", "dispatch", "regex-fallback", "inheritance", "constructor", "ast-narrowed"]


def graph(seed, nodes=40, n=120):
    rng = Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice(EDGE_TYPES), rng.choice([0.5, 0.6, 0.7, 0.85, 0.95]), "ast", rng.choice(REASONS)) for _ in range(n)]


def allowed(policy, e):
    return e[3] >= policy.min_confidence and e[5] not in policy.excluded_reasons


def bfs(edges, seeds, depth):
    into = defaultdict(set)
    for s, d, *_ in edges:
        into[d].add(s)
    seen, todo = dict.fromkeys(seeds, 0), deque(seeds)
    while todo:
        x = todo.popleft()
        if depth is None or seen[x] < depth:
            for y in into[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
    return seen


@pytest.mark.parametrize("policy", [DIAGNOSTIC, TESTS, IMPACT, CERTIFICATION])
def test_inbound_equals_breadth_first_search(spark, policy):
    rows = graph(policy.min_confidence)
    df = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([("n1",), ("n2",), (None,)], "node string")
    kept = [e for e in rows if allowed(policy, e) and e[2] in CLOSURE_TYPES]
    for depth in (1, 2, None):
        got = {r.node: r.depth for r in traverse.inbound(traverse.followed(df, CLOSURE_TYPES, policy), seeds, depth).collect()}
        want = bfs(kept, ["n1", "n2"], depth)
        assert got.keys() == want.keys()
        assert depth is None or got == want


def test_each_seed_and_products(spark):
    rows = graph(9)
    df = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([("n1",), ("n5",)], "node string")
    got = {(r.seed, r.node): r.depth for r in traverse.inbound_each(df, seeds, 2).collect()}
    assert got == {(s, n): d for s in ("n1", "n5") for n, d in bfs(rows, [s], 2).items()}
    best = {(s, s): 1.0 for s in ("n1", "n5")}
    layer = dict(best)
    for _ in range(3):
        step = defaultdict(float)
        for (s, x), p in layer.items():
            for a, b, _, c, *_ in rows:
                if b == x and p * c >= 0.5:
                    step[s, a] = max(step[s, a], p * c)
        layer = {k: v for k, v in step.items() if v > best.get(k, 0)}
        best |= layer
    found = {(r.seed, r.node): r.product for r in traverse.best_product(df, seeds, 0.5, 3).collect()}
    assert found.keys() == best.keys() and all(abs(found[k] - best[k]) < 1e-9 for k in best)


def test_policy_laxer_reaches_more(spark):
    df = spark.createDataFrame(graph(4), EDGES)
    seeds = spark.createDataFrame([("n3",)], "node string")
    reach = lambda p, d: {r.node for r in traverse.inbound(traverse.followed(df, CLOSURE_TYPES, p), seeds, d).collect()}
    assert reach(CERTIFICATION, 3) <= reach(IMPACT, 3) <= reach(DIAGNOSTIC, 3)
    assert reach(DIAGNOSTIC, 1) <= reach(DIAGNOSTIC, 2)


def symbols_of(spark, rows):
    return complete(spark.createDataFrame(rows, "id string, file_path string, name string, language string, kind string").selectExpr("*", "name AS qualified_name"), SYMBOLS)


def test_tests_for_ignores_weak_paths_and_counts_them(spark):
    s = symbols_of(spark, [("T", "a.go", "Target", "go", "function"), ("M", "b.go", "Mid", "go", "function"), ("W", "c.go", "Weak", "go", "function"), ("X1", "a_test.go", "TestMid", "go", "function"), ("X2", "c_test.go", "TestWeak", "go", "function")])
    e = spark.createDataFrame([("M", "T", "calls", 0.95, "ast", "ast-narrowed"), ("X1", "M", "tests", 0.85, "heuristic", "test-evidence"), ("W", "T", "calls", 0.6, "regex", "regex-fallback"), ("X2", "W", "tests", 0.85, "heuristic", "test-evidence")], EDGES)
    found = [r.id for r in traverse.tests_for(s, e, " target ", is_test_symbol()).collect()]
    assert found == ["X1"]
    assert [r.id for r in traverse.tests_for(s, e, "target", is_test_symbol(), DIAGNOSTIC).collect()] == ["X1", "X2"]
    skipped = traverse.skipped_in_closure(e, spark.createDataFrame([("T",)], "node string")).collect()
    assert [(r.reason, r.skipped) for r in skipped] == [("regex-fallback", 1)]
    assert {r.id for r in traverse.tests_for(s, e, "", is_test_symbol()).collect()} == {"X1", "X2"}


def test_merge_keeps_the_most_confident_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", "b", "calls", 0.7, "native", ""), ("a", "b", "calls", 0.9, "ast", "x"), ("a", "b", "calls", 0.9, "regex", "y"), ("a", "c", "calls", 0.5, None, None)], EDGES)
    once = merge.merge_edges(df)
    assert {(r.dst, r.confidence) for r in once.collect()} == {("b", 0.9), ("c", 0.5)}
    assert [r.source for r in once.filter("dst = 'c'").collect()] == ["unknown"]
    assert sorted(map(tuple, merge.merge_edges(once).collect())) == sorted(map(tuple, once.collect()))
    assert merge.sync(once, once).count() == 0
