"""Steps whose cost follows their input: results against plain Python on odd rows, and the bytes they shuffle."""

import time
from collections import defaultdict
from random import Random

from pyspark.sql import functions as F


def shuffled(spark, df):
    """Bytes that writing df shuffles."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.range(1).count()  # the store writes what an executor has done with the next task's end
    return total() - before


CALL_QUERIES = ["callee_resolution_tiers", "fanout_cap", "keep_if_any_arity", "receiver_narrowing"]


def plain_narrow(sites, targets):
    out = set()
    of = defaultdict(list)
    for s, own, callee, want in sites:
        of[s] += [(t, h == want) for t, c, h in targets if c == callee and t != own]
    for s, found in of.items():
        good = [t for t, ok in found if ok]
        out |= {(s, t) for t in good or [t for t, _ in found]}
    return out


def test_narrow_equals_listing_all_candidates(spark):
    """Among them targets of two callees, repeated rows, sites of several rows with one callee, a site's own target as the only good one, and nulls."""
    from tessera.operators import calls

    for seed in range(4):
        rng = Random(seed)
        targets = [(rng.randrange(18), rng.choice("abc"), rng.choice([1, 2, 3, None])) for _ in range(25)] + [(40, "d", 1), (41, "d", 2), (50, "e", 1)]
        sites = [(rng.randrange(20), rng.randrange(18), rng.choice("abc"), rng.choice([1, 2, 3])) for _ in range(45)] + [(30, 40, "d", 1), (31, 40, "d", 2), (32, 50, "e", 1), (33, 40, "d", 1), (33, 41, "d", 1), (34, None, "d", 1), (35, 40, None, 1)]
        got = calls.narrow(spark.createDataFrame(sites, "site long, own long, callee string, want int"), spark.createDataFrame(targets, "target long, callee string, have int")).collect()
        want = plain_narrow([s for s in sites if s[1] is not None and s[2] is not None], targets)
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_narrow_shuffles_rows_and_not_pairs(spark):
    from tessera.operators import calls

    n = 3000
    sites = spark.range(n).select(F.col("id").alias("site"), F.col("id").alias("own"), F.lit("f").alias("callee"), (F.col("id") % 5).alias("want"))
    targets = spark.range(n).select(F.col("id").alias("target"), F.lit("f").alias("callee"), (F.col("id") % 3).alias("have"))
    found = calls.narrow(sites, targets)
    assert shuffled(spark, found) < 2_000_000  # of more than three million pairs
    assert found.count() == sum(n // 3 - (k % 5 == k % 3) if k % 5 < 3 else n - 1 for k in range(n))


def test_fanout_lists_no_site_that_is_over_the_cap(spark):
    from tessera.operators import calls

    parts = spark.range(2000).select(F.col("id").alias("target"), F.when(F.col("id") < 10, "few").otherwise("many").alias("callee"))
    sites = parts.join(calls.rivals(parts), ["callee", "target"]).select(F.col("target").alias("site"), "callee", "others")
    assert {r.site for r in calls.under_cap(sites, 16).collect()} == set(range(10))
    mixed = sites.unionByName(sites.filter("site = 3").select("site", F.lit("many").alias("callee"), F.lit(1989).cast("long").alias("others")))
    assert {r.site for r in calls.under_cap(mixed, 16).collect()} == set(range(10)) - {3}


def test_call_queries_equal_sql_with_parts_of_two_names(spark, tmp_path):
    """Part keys with two rows, and a site whose lines call one name by two parts."""
    import duckdb

    import __spark_entry__ as contract

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT (i % 40)::BIGINT AS p_partkey, ['red', 'hot'][i % 2 + 1] AS p_name, 'Brand#' || (i % 3 + 1) AS p_brand, ['A', 'B'][i % 5 % 2 + 1] AS p_type, 1::INTEGER AS p_size FROM range(43) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT (i % 30)::BIGINT AS l_orderkey, (i * 7 % 41)::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, (i % 9)::DOUBLE AS l_quantity FROM range(75) t(i)")
    for name in ("part", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in CALL_QUERIES:
        got = sorted(tuple(r) for r in contract.queries()[name](spark, str(tmp_path)).select("site", "target").collect())
        assert got == sorted(con.execute(f"SELECT site, target FROM ({contract.oracle_sql()[name]})").fetchall()), name


def spans_and_points(seed):
    rng = Random(seed)
    lines = lambda: (a := rng.randrange(-1, 150), a + rng.randrange(-1, 90))
    return [(f"s{rng.randrange(25)}", rng.choice("fg"), *lines()) for _ in range(40)], [(rng.randrange(25), rng.choice("fgh"), *lines()) for _ in range(40)]


def meets(a, b, c, d):
    return min(a, b, c, d) > 0 and a <= b and c <= d and a <= d and c <= b


def test_touched_equals_all_pairs_and_shuffles_ranges_alone(spark):
    from tessera.operators import certify

    for seed in range(3):
        left, right = spans_and_points(seed)
        hunks = spark.createDataFrame([("d", h, f, False, False, a, b) for h, f, a, b in right], "diff_id string, hunk int, path string, deleted boolean, binary boolean, new_start int, new_end int")
        symbols = spark.createDataFrame([(i, f, "function", i, "go", (a, b), []) for i, f, a, b in left], "id string, file_path string, kind string, name string, language string, span struct<start:int,end:int>, annotations array<string>")
        want = sorted((i, f, a, b) for i, f, a, b in left if any(f == g and meets(a, b, c, d) for _, g, c, d in right))
        assert sorted(map(tuple, certify.touched_symbols(hunks, symbols).select("id", "file_path", "span_start", "span_end").collect())) == want
    n = 20_000
    hunks = spark.range(n).selectExpr("'d' AS diff_id", "CAST(id AS int) AS hunk", "'f' AS path", "false AS deleted", "false AS binary", "CAST(1 + id % 9 AS int) AS new_start", "CAST(9 AS int) AS new_end")
    symbols = spark.range(n).selectExpr("CAST(id AS string) AS id", "'f' AS file_path", "'function' AS kind", "'x' AS name", "'go' AS language", "named_struct('start', CAST(1 + id % 5 AS int), 'end', 7) AS span", "array('') AS annotations")
    assert certify.touched_symbols(hunks, symbols).count() == n  # all pairs would be four hundred million


def test_overlap_counts_equal_all_pairs(spark):
    """Ids with several ranges, of which some repeat, beside ids with one."""
    from collections import Counter

    from tessera.operators.intervals import overlap_counts

    for seed in range(3):
        left, right = spans_and_points(seed)
        right += right[:3] + [(100 + i, "f", 10 * i + 1, 10 * i + 8) for i in range(9)]
        got = overlap_counts(spark.createDataFrame(right, "hunk int, file string, lo int, hi int"), spark.createDataFrame(left, "id string, file string, a int, b int"), "file", ("lo", "hi"), ("a", "b"), "hunk", "id", 16).collect()
        want = Counter((h, i) for h, f, a, b in right for i, g, c, d in left if f == g and meets(a, b, c, d))
        assert len(got) == len(want) and {(r.hunk, r.id): r.n for r in got} == dict(want)


def test_overlap_counts_shuffle_no_pairs(spark):
    from tessera.operators.intervals import overlap_counts

    n = 2000
    a = spark.range(n).selectExpr("id AS hunk", "'f' AS file", "1 + id % 3 AS lo", "5L AS hi")
    b = spark.range(n).selectExpr("CAST(id AS string) AS id", "'f' AS file", "1 + id % 5 AS a", "9L AS b")
    found = overlap_counts(a, b, "file", ("lo", "hi"), ("a", "b"), "hunk", "id")
    assert shuffled(spark, found) < 2_000_000  # of four million pairs
    assert found.count() == n * n


def test_tightest_equals_all_pairs_and_compares_distinct_spans(spark):
    """An identity may have several points; equal spans go by the tie."""
    from tessera.operators.intervals import tightest

    for seed in range(3):
        left, right = spans_and_points(seed)
        points = [(h, f, a) for h, f, a, _ in right]
        got = tightest(spark.createDataFrame(points, "hunk int, file string, at int"), spark.createDataFrame(left + left[:5], "id string, file string, a int, b int"), "file", "at", ("a", "b"), ["hunk"], "id").collect()
        want = {}
        for h, f, at in points:
            for i, g, a, b in left:
                if f == g and meets(a, b, at, at):
                    want[h] = min(want.get(h, (999, "")), (b - a, i))
        assert {r.hunk: (r.b - r.a, r.id) for r in got} == want and len(got) == len(want)
    n = 20_000
    points = spark.range(n).selectExpr("id AS hunk", "'f' AS file", "3 + id % 2 AS at")
    spans = spark.range(n).selectExpr("id AS sid", "'f' AS file", "1 + id % 2 AS a", "9L AS b")
    assert {r.sid for r in tightest(points, spans, "file", "at", ("a", "b"), ["hunk"], "sid").collect()} == {1}  # all pairs would be four hundred million


def test_universe_report_equals_all_pairs(spark):
    """Names with dots, without a part after the last, repeated, and null; and as many declarations of one line as their pairs could not be listed."""
    from collections import Counter

    from tessera.operators import evals

    names = ["a", "x.a", "b", "y.z.b", "c.", "", "a.b", None]
    shape = "file_path string, name string, kind string, span struct<start:int,end:int>"
    for seed in range(4):
        rng = Random(seed)
        symbols = [(rng.choice("fg"), rng.choice(names), rng.choice(["function", "class", None]), (a := rng.randrange(0, 90), a + rng.randrange(-1, 80))) for _ in range(9)]
        decls = [(rng.choice("fgh"), rng.randrange(0, 150), rng.choice(names)) for _ in range(60)]
        want = Counter()
        for file, line, name in set(decls):
            here = [(n, k) for f, n, k, (a, b) in symbols if f == file and 0 < a <= line <= b]
            named = lambda n: name is not None and n is not None and (n in (name, name.rsplit(".")[-1]) or n.endswith("." + name.rsplit(".")[-1]))
            if file not in {s[0] for s in symbols}:
                want["no-symbols"] += 1
            elif name is not None and any(named(n) and k == "class" for n, k in here):
                want["not-callable"] += 1
            elif name is not None and any(n is not None and not named(n) and k == "function" for n, k in here):
                want["name-disagrees"] += 1
            else:
                want["no-span"] += 1
        df = spark.createDataFrame(decls, "file string, line int, name string")
        assert {r.why: r.n for r in evals.universe_report(df, df.limit(0), spark.createDataFrame(symbols, shape)).collect()} == dict(want)
    n = 20_000
    df = spark.range(n).selectExpr("'f' AS file", "5 AS line", "CAST(id AS string) AS name")
    symbols = spark.range(n).selectExpr("'f' AS file_path", "CAST(id AS string) AS name", "IF(id % 2 = 0, 'class', 'function') AS kind", "named_struct('start', 1, 'end', 9) AS span")
    assert {r.why: r.n for r in evals.universe_report(df, df.limit(0), symbols).collect()} == {"not-callable": n // 2, "name-disagrees": n // 2}


def test_reach_counts_equal_each_seed_by_itself(spark):
    from collections import Counter

    from tests.test_graph import bfs, graph

    from tessera.operators import traverse
    from tessera.schemas import EDGES

    rows = graph(9)
    df = spark.createDataFrame([*rows, (None, "n1", "calls", 0.9, "ast", "")], EDGES)
    names = ["n1", "n5", "n7", "alone"]
    seeds = spark.createDataFrame([(n,) for n in [*names, "n1", None]], "node string")
    for depth in (1, 2, 3):
        got = traverse.reach_counts(df, seeds, depth).collect()
        want = {(s, d): n for s in names for d, n in Counter(bfs(rows, [s], depth).values()).items()}
        assert len(got) == len(want) and {(r.seed, r.depth): r.nodes for r in got} == want


def test_counts_of_reach_shuffle_links_and_not_pairs(spark):
    from tessera.operators import traverse

    links = spark.range(20_000).selectExpr("concat('o', id % 4000) AS src", "concat('p', id % 1300) AS dst").unionByName(spark.range(65_000).selectExpr("concat('p', id % 1300) AS src", "concat('s', id * 7 % 900) AS dst"))
    seeds = spark.range(900).selectExpr("concat('s', id) AS node")
    found = traverse.reach_counts(links, seeds, 2)
    assert shuffled(spark, found) < 6_000_000  # of a million pairs at the second hop
    each = traverse.inbound_each(links, seeds, 2).groupBy("seed", "depth").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))


def test_products_shuffle_links_once(spark):
    from tessera.operators import traverse

    links = spark.range(30_000).selectExpr("concat('o', id % 6000) AS src", "concat('p', id % 1300) AS dst", "0.9D AS confidence").unionByName(spark.range(13_000).selectExpr("concat('p', id % 1300) AS src", "concat('s', id * 7 % 10) AS dst", "0.9D AS confidence"))
    seeds = spark.range(10).selectExpr("concat('s', id) AS node")
    found = traverse.best_product(links, seeds, 0.6, 2)
    assert shuffled(spark, found) < 1_500_000
    assert {(r.product, r.n) for r in found.groupBy(F.round("product", 6).alias("product")).agg(F.count("*").alias("n")).collect()} == {(1.0, 10), (0.9, 1300), (0.81, 6000)}


def test_region_size_equals_the_region_and_gathers_no_boundary(spark):
    from tessera.operators import region

    symbols = spark.range(40).selectExpr("concat('p', id) AS id", "'a.py' AS file_path", "concat('bolt', id) AS name", "'q' AS qualified_name", "'s' AS signature", "named_struct('start', 1, 'end', 2) AS span")
    edges = spark.range(3000).selectExpr("IF(id % 7 = 0, 'b.py::x', concat('a.py::', id % 900)) AS src", "IF(id % 11 = 0, NULL, concat('s::', id % 70)) AS dst", "'calls' AS type")
    for intent in ("bolt", "nothing", " "):
        whole = region.isolated_region(symbols, edges, intent).selectExpr("exclusive", "exclusive_files", "CAST(size(boundary) AS long) AS boundary", "CAST(size(shared_read) AS long) AS shared_read", "confidence").first()
        assert region.region_size(symbols, edges, intent).first() == whole


def test_contains_deals_a_large_group_over_tasks(spark):
    from tessera.operators.edges import contains

    n = 1500
    symbols = spark.range(n).selectExpr("concat('p', id) AS id", "'a.py' AS file_path", "IF(id % 2 = 0, 'class', 'method') AS kind", "IF(id % 3 = 0, 'Wheel', 'WHEEL') AS name", "'wheel' AS parent_symbol")
    found = contains(symbols)
    assert found.count() == n // 2 * (n - 1)
    rows = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(rows) > 2 and max(rows) < n * n // 4
    assert found.filter("src = 'p0'").select("dst").distinct().count() == n - 1


def test_index_moves_its_rows_once_to_their_documents(spark):
    from tessera.operators import search

    docs = spark.range(300).selectExpr("IF(id = 0, NULL, id) AS id", "concat('red ', repeat('blue ', CAST(id % 3 AS int)), 'word', chr(97 + CAST(id % 20 AS int)), chr(97 + CAST(id % 23 AS int))) AS text")
    index = search.tf_idf(search.term_counts(docs, F.col("text")))
    rows = index.collect()
    size = {}
    for r in rows:
        size[r.id] = size.get(r.id, 0) + r.weight * r.weight
    assert len(size) == 300 and all(abs(r.norm - size[r.id] ** 0.5) < 1e-9 for r in rows)


def test_document_frequencies_equal_counting_terms(spark):
    """Repeated ids are one document, a null id is one too; nothing is written for it."""
    from tessera import runtime
    from tessera.operators import search

    docs = spark.createDataFrame([(1, "getUser user red"), (1, "red blue"), (2, "blue"), (None, "user"), (None, "user zed"), (3, None), (4, "")], "id long, text string")
    key = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
    want = key(search.idf(search.term_counts(docs, F.col("text"))))
    runtime.release(spark)
    assert key(search.document_frequencies(docs, F.col("text"))) == want and runtime.release(spark) == 0


def test_extraction_hands_on_frames_of_bounded_size():
    import pandas as pd

    from tessera.operators import extract

    text = ("word " * 200 + chr(10)) * 300
    files = pd.DataFrame({"path": [f"d/{i}.txt" for i in range(60)] + ["d/null.txt"], "language": "plaintext", "content": [text.encode()] * 60 + [None]})
    frames = list(extract._frames(iter([files, files[:0]])))
    assert max(f.raw_text.str.len().sum() for f in frames) < extract.PIECE + 2 * len(text)
    assert [p for f in frames for p in f.file_path] == list(files.path[:60])
