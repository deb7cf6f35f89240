"""Bounded search and closure against plain Python on random graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as fn
from tessella.operators import graph


def search(edges, root, depth, budget):
    out, seen, queue = [(root, None, 0)], {root}, [(root, 0)]
    while queue:
        node, level = queue.pop(0)
        if level >= depth:
            continue
        for other in sorted(b for a, b in edges if a == node):
            if other in seen:
                continue
            if len(out) >= budget:
                return out
            seen.add(other)
            out.append((other, node, level + 1))
            queue.append((other, level + 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(26)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string").withColumn("ord", F.lit(0))
    for depth, budget in ((3, 128), (5, 4)):
        found = [(r.node, r.parent, r.depth) for r in graph.bfs(df, "n1", depth, graph.Budget(budget)).orderBy("seq").collect()]
        assert found == search(edges, "n1", depth, budget)
    reach = set()
    for a in {a for a, _ in edges}:
        todo = [b for x, b in edges if x == a]
        while todo:
            b = todo.pop()
            if (a, b) not in reach:
                reach.add((a, b))
                todo += [c for x, c in edges if x == b]
    assert {(r.src, r.dst) for r in graph.closure(df).collect()} == reach
    some = spark.createDataFrame([("n1",), ("n3",), ("none",), ("n1",)], "src string")
    assert sorted((r.src, r.dst) for r in graph.closure(df, some).collect()) == sorted(x for x in reach if x[0] in ("n1", "n3"))


def test_versions_sort_by_value(spark):
    ordered = ["", "alpha", "1.0-SNAPSHOT", "1", "1.0.0.1", "1.2-beta", "1.2-rc1", "1.2-RC2", "1.2.0-SNAPSHOT", "1.2.0.0-x", "1.2", "1.2.0.0.1", "1.2.0.1", "1.10", "2.0", "10"]
    shuffled = random.Random(3).sample(ordered[1:], len(ordered) - 1)
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r.v for r in df.orderBy(fn.version_key(F.col("v"))).collect()] == ordered[1:]
    same = df.limit(1).select(fn.version_key(F.lit("2")).alias("a"), fn.version_key(F.lit("2.0")).alias("b"), fn.version_key(F.lit("9" * 30)).alias("c")).first()
    assert same.a.parts == same.b.parts and same.a.raw < same.b.raw  # equal parts: the text decides
    assert same.c.parts[0].side == 0  # no number of that size


def hierarchy(edges, root, depth, budget):
    """Every edge of types in the order in which they are taken from a queue, each searched from once; one more than the budget is flagged."""
    out, seen, queue = [], set(), [(root, 0)]
    while queue:
        node, level = queue.pop(0)
        if node in seen or level >= depth:
            seen.add(node)
            continue
        seen.add(node)
        for child in sorted(b for a, b in edges if a == node and b != node):
            if len(out) >= budget:
                return [*out, (child, node, level + 1, True)]
            out.append((child, node, level + 1, False))
            queue.append((child, level + 1))
    return out


@pytest.mark.parametrize("budget", [4, 5, 6, 50])
def test_hierarchies_with_diamonds(spark, budget):
    edges = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "A")]
    df = spark.createDataFrame(edges, "src string, dst string").withColumn("ord", F.lit(0))
    found = [(r.node, r.parent, r.depth, r.truncated) for r in graph.emitted(df, "A", 8, graph.Budget(budget)).orderBy("seq").collect()]
    assert found[0] == ("A", None, 0, False) and found[1:] == hierarchy(edges, "A", 8, budget)
    once = graph.bfs(df, "A", 8, graph.Budget(budget), further=True).orderBy("seq").collect()
    assert [r.node for r in once] == list("ABCDE")[: budget + 2] and [r.truncated for r in once if r.truncated] == [True] * (budget < 4)
    near = {r.node: r.depth for r in graph.within(df, "B", 2).collect()}
    assert near == {"B": 0, "D": 1, "E": 2}


def test_wildcards_are_literal_elsewhere(spark):
    df = spark.createDataFrame([("a.b(c)",), ("axb(c)",)], "t string")
    assert [r.t for r in df.where(fn.match("t", "a.b(*", "wildcard")).collect()] == ["a.b(c)"]
    assert [r.t for r in df.where(fn.match("t", "A.B(C)")).collect()] == ["a.b(c)"]
    assert df.where(fn.match("t", "A.B", case_sensitive=True)).count() == 0


def test_what_a_pattern_holds_literally():
    from tessella.operators.postings import literal_grams, literals

    assert literals("a.b*c", "plain") == ["a.b*c"] and literals("ab*c?def", "wildcard") == ["ab", "c", "def"]
    cases = {r"abc\d+def": ["abc", "def"], "abcd*ef": ["abc", "ef"], "ab+cd": ["ab", "cd"], "a(bcd)?ef": ["a", "ef"], "abc|def": [], "[a-z]xyz{2,3}w": ["xy", "w"], r"a\.b\(c": ["a.b(c"], r"ab\x41cd": ["ab"], "(?x)abc": [], "^abc$": ["abc"], r"\Qa.c\E": [], "x[^]]y": ["x", "y"]}
    assert {k: literals(k, "regex") for k in cases} == cases
    assert literal_grams("ABcd") == ["abc", "bcd"] and literal_grams("ab") == [] and len(literal_grams("".join(map(chr, range(97, 123))))) <= 16


def test_patterns_that_match_hold_their_literals():
    import re

    from tessella.operators.postings import literal_grams

    rng = random.Random(5)
    hits = 0
    for _ in range(20000):
        pattern = "".join(rng.choice(["a", "b", "c", "ab", ".", "a*", "b?", "c+", "[ab]", "[^c]", r"\.", "(ab)", "(c)*", "a{1,2}", r"\w", "^", "$"]) for _ in range(rng.randrange(1, 7)))
        text = "".join(rng.choice("abc.") for _ in range(12))
        if re.search(pattern, text):
            hits += 1
            assert all(g in text for g in literal_grams(pattern, "regex")), (pattern, text)
    assert hits > 1000


@pytest.mark.parametrize("size,offset,limit", [(3000, 1700, 40), (3000, 2990, 40), (3000, 3000, 5), (3000, 0, 7), (40, 11, 5), (0, 3, 4)])
def test_deep_pages_are_the_same(spark, size, offset, limit):
    from tessella.operators import paging

    rng = random.Random(size + offset)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(60), i) for i in range(size)]
    df = spark.createDataFrame(rows, "k string, n int, i int").repartition(3)
    order = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    assert [tuple(r) for r in paging.deep_page(df, ["k", "n", "i"], offset, limit).collect()] == sorted(rows, key=order)[offset : offset + limit]
    hot = spark.createDataFrame([("x", 1, i % 2) for i in range(200)], "k string, n int, i int")
    assert [r.i for r in paging.deep_page(hot, ["k", "n", "i"], 98, 4).collect()] == [0, 0, 1, 1]


def chained(step, roots, depth, budget):
    """Levels of one search after another: what the methods of a level lead to, in order, of which the first new ones are taken."""
    out = []
    for root, method in roots:
        seen, level = {method: 0}, [method]
        out.append((root, *method, None, 0, 0))
        for d in range(1, depth + 1):
            new = []
            for m in level:
                for other in step(m):
                    if other not in seen and len(seen) < budget:
                        seen[other] = len(seen)
                        new.append(other)
                        out.append((root, *other, f"{m[1]}#{m[2]}{m[3]}", d, seen[other]))
            level = new
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [1, 3, 6, 40])
def test_chains_of_many_roots_are_those_of_each(spark, budget):
    from tessella.operators import calls

    rng = random.Random(budget)
    method = lambda i: (f"t{i}", "run", "()V")
    edges = sorted({(rng.choice("ab"), rng.randrange(16), rng.randrange(16)) for _ in range(40)})
    types = sorted({(rng.randrange(16), rng.randrange(16)) for _ in range(9)})
    declared = sorted({(rng.choice("abc"), i) for i in range(16) for _ in range(2)})
    df = spark.createDataFrame([(a, *method(x), *method(y)) for a, x, y in edges], "archive_path string, source_owner string, source_name string, source_desc string, target_owner string, target_name string, target_desc string")
    up = spark.createDataFrame([(f"t{p}", f"t{c}") for p, c in types], "parent string, child string")
    methods = spark.createDataFrame([(a, *method(i)) for a, i in declared], "archive_path string, owner string, name string, descriptor string")
    g = calls.CallGraph(df, df, up, up, methods)
    roots = [(i, ("a", *method(i))) for i in range(16)]
    rows = spark.createDataFrame([(i, *m) for i, m in roots], "root int, archive_path string, owner string, name string, descriptor string")

    def down(m):
        keys = []
        for a, x, y in edges:
            if f"t{x}" == m[1]:
                keys.append(((a, f"t{y}", 0, "", ""), (a, *method(y))))
                keys += [((a, f"t{y}", 1, b, f"t{c}"), (b, *method(c))) for p, c in types if p == y for b, i in declared if i == c]
        return [x for _, x in sorted(keys)]

    def back(m):
        keys = [((0, "", a, f"t{x}"), (a, *method(x))) for a, x, y in edges if f"t{y}" == m[1]]
        keys += [((1, f"t{p}", a, f"t{x}"), (a, *method(x))) for p, c in types if f"t{c}" == m[1] for a, x, y in edges if y == p]
        return [x for _, x in sorted(keys)]

    for step, plain in ((calls.callees, down), (calls.callers, back)):
        found = calls.search(lambda f, most, step=step: step(g, f, most), rows, 3, budget).collect()
        assert sorted((tuple(r)[:-1] for r in found), key=str) == chained(plain, roots, 3, budget)
        assert all(r.truncated == (r.seq == budget - 1) for r in found)


@pytest.mark.parametrize("way", ["callees", "callers"])
def test_a_level_is_no_larger_than_the_budgets(spark, way):
    """A type with many subtypes, and a method that many call: what a step gives a search is bounded, and searches without budget left are not gone on with."""
    from tessella.operators import calls

    method = lambda o: F.concat(F.lit(o), "id").alias("owner") if o.endswith("/") else F.lit(o).alias("owner")
    row = lambda df, o: df.select(F.lit("a").alias("archive_path"), method(o), F.lit("run").alias("name"), F.lit("()V").alias("descriptor"))
    many = spark.range(3000)
    c = many.select(F.lit("a").alias("archive_path"), F.concat(F.lit("c/"), "id").alias("source_owner"), F.lit("run").alias("source_name"), F.lit("()V").alias("source_desc"), F.lit("hub").alias("target_owner"), F.lit("run").alias("target_name"), F.lit("()V").alias("target_desc"))
    types = many.select(F.lit("hub").alias("parent"), F.concat(F.lit("s/"), "id").alias("child"))
    g = calls.CallGraph(c, c, types, types, row(many, "s/").unionByName(row(many.limit(1), "hub")))
    roots = row(many.limit(20), "c/" if way == "callees" else "s/").withColumn("root", F.monotonically_increasing_id().cast("int"))
    sizes = []

    def step(f, most):
        found = {"callees": calls.callees, "callers": calls.callers}[way](g, f, most)
        sizes.append((f.count(), found.count()))
        return found

    rows = calls.search(step, roots, 3, 5).collect()
    assert len(rows) == 20 * 5 and sizes == [(20, 20 * 5)]


@pytest.mark.parametrize("whole", [True, False])
def test_a_search_goes_on_from_no_more_methods_than_it_needs(spark, whole):
    """Of several methods that call as many as the budget, the first is enough; what comes before it is needed, and lists made for all give the same."""
    from dataclasses import replace

    from tessella.operators import calls

    name = lambda c: F.concat(F.lit(c), F.lpad(F.col("id").cast("string"), 3, "0"))
    row = lambda df, s, t: df.select(F.lit("a").alias("archive_path"), s.alias("source_owner"), F.lit("run").alias("source_name"), F.lit("()V").alias("source_desc"), t.alias("target_owner"), F.lit("run").alias("target_name"), F.lit("()V").alias("target_desc"))
    mids = spark.createDataFrame([("few",), ("m1",), ("m2",), ("m3",)], "mid string")
    roots = spark.range(10)
    every = row(roots.crossJoin(mids), name("r"), F.col("mid")).unionByName(row(mids.where("mid <> 'few'").crossJoin(spark.range(40)), F.col("mid"), F.concat(F.col("mid"), name("/"))))
    every = every.unionByName(row(spark.range(1), F.lit("few"), F.lit("m2"))).unionByName(row(roots, name("r"), name("r")))
    none = spark.createDataFrame([], "parent string, child string")
    methods = spark.createDataFrame([], "archive_path string, owner string, name string, descriptor string")
    g = calls.CallGraph(every, every, none, none, methods)
    g = replace(g, lists=calls.lists_of(g, 8)) if whole else g
    wanted = roots.select(F.col("id").cast("int").alias("root"), F.lit("a").alias("archive_path"), name("r").alias("owner"), F.lit("run").alias("name"), F.lit("()V").alias("descriptor"))
    sizes = []

    def step(f, most):
        found = calls.callees(g, f, most)
        sizes.append(found.count())
        return found

    found = calls.search(step, wanted, 3, 8).collect()
    assert sizes == [10 * 4, 10 * (1 + 8)]
    for i in range(10):
        assert [(r.owner, r.parent) for r in sorted(found, key=lambda r: r.seq) if r.root == i] == [(f"r00{i}", None), *[(m, f"r00{i}#run()V") for m in ("few", "m1", "m2", "m3")], *[(f"m1/00{k}", "m1#run()V") for k in range(3)]]


@pytest.mark.parametrize("split", [512, 1])
def test_callees_are_expanded_without_a_shuffle(spark, split):
    """Calls to several supertypes of a type lead to its declaration once, by each caller; only what is expanded from is shuffled."""
    from tessella.operators import symbols

    call = "source_owner string, source_name string, source_desc string, target_owner string, target_name string, target_desc string"
    rows = [(s, "go", "()V", t, n, "()V") for s, t, n in (("a", "P", "run"), ("a", "I", "run"), ("a", "I", "run"), ("b", "I", "run"), ("b", "J", "run"), ("c", "J", "stop"), ("d", "Q", "run"), ("e", None, "run"))]
    classes = spark.createDataFrame([("x", "C", "P"), ("y", "C", "P"), ("x", "D", "P"), ("x", "E", None)], "archive_path string, internal_name string, super_name string")
    interfaces = spark.createDataFrame([("x", "C", "I"), ("x", "C", "J"), ("x", "E", "J")], "archive_path string, owner string, interface_name string")
    methods = spark.createDataFrame([(a, o, n, "()V") for a, o, n in (("x", "C", "run"), ("y", "C", "run"), ("x", "D", "run"), ("x", "E", "stop"), ("x", "P", "run"))], "archive_path string, owner string, name string, descriptor string")
    found = symbols.callees(spark.createDataFrame(rows, call), methods, classes, interfaces, split)
    above = {"C": "PIJ", "D": "P", "E": "J"}
    reach = {(s, o, n, "virtual") for s, _, _, t, n, _ in rows for _, o, m, _ in map(tuple, methods.collect()) if m == n and t and t in above.get(o, "")}
    assert sorted(((r.source_owner, r.target_owner, r.target_name, r.via) for r in found.collect()), key=str) == sorted(reach | {(r[0], r[3], r[4], "call") for r in rows}, key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_expansion_of_one_method_is_dealt_out(spark):
    """Few callers of one method with many declarations below it, and no task with more than its share of the rows."""
    from tessella.operators import symbols

    calls = spark.range(8).selectExpr("concat('s', id) as source_owner", "'go' as source_name", "'()V' as source_desc", "'P' as target_owner", "'run' as target_name", "'()V' as target_desc")
    classes = spark.range(2000).selectExpr("'x' as archive_path", "concat('C', id) as internal_name", "'P' as super_name")
    interfaces = spark.createDataFrame([], "archive_path string, owner string, interface_name string")
    methods = classes.selectExpr("archive_path", "internal_name as owner", "'run' as name", "'()V' as descriptor")
    found = symbols.callees(calls, methods, classes, interfaces, 8).where("via = 'virtual'")
    assert found.distinct().count() == 8 * 2000
    shares = [r.n for r in found.groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n")).collect()]
    assert sum(shares) == 8 * 2000 and max(shares) < 8 * 2000 / 2


def test_keys_on_one_side_meet_once(spark):
    from tessella.operators import diff

    left = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, None), (3, 4)], "a int, b int")
    right = spark.createDataFrame([(2, None), (3, 4), (3, 5), (3, 5), (None, 7)], "a int, b int")
    found = diff.keys_on_one_side(left, right, ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(1, 1, "removed"), (None, None, "removed"), (3, 5, "added"), (None, 7, "added")} and found.count() == 4
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_containers_rank_by_their_other_columns(spark):
    from tessella.operators import policy

    rows = [(1, i, 0, "a", "1.0", "x") for i in random.Random(4).sample(range(200), 200)]
    df = spark.createDataFrame(rows, "owner int, id int, priority int, artifact string, version string, name string").repartition(5)
    assert all(r["rank"] == r.id + 1 for r in policy.ranked_containers(df, ["owner"]).collect())


def test_containers_that_lack_something_rank_last(spark):
    """As DuckDB's ORDER BY has it: nulls come last in each column, the version's too, which stands from the newest down."""
    from tessella.operators import policy

    rows = [(0, "a", "2", "x"), (0, "a", "1", "x"), (0, "a", "1", "d/x"), (0, "a", "1", None), (0, "a", None, "x"), (0, None, "3", "x"), (1, "a", "1", "x"), (None, "a", "1", "x"), (None, None, None, None)]
    rows = [(k, i, *r) for k in (1, None) for i, r in enumerate(rows)] + [(k, None, None, None, None, None) for k in (1, None)]
    df = spark.createDataFrame(rows, "owner int, id int, priority int, artifact string, version string, name string").repartition(3)
    found = sorted(((r.owner or 0, r["rank"], r.id) for r in policy.ranked_containers(df, ["owner"]).collect()), key=str)
    assert found == sorted(((k, i + 1, i if i < 9 else None) for k in (1, 0) for i in range(10)), key=str)
