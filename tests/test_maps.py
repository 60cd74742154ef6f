"""Code maps, navigation subjects and seeds against plain searches."""

import random

import pytest

from tessera.operators import codemap, navigation, resolve, seeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_walk(root, calls, most=8):
    queue, seen, out = [root], {root}, []
    while queue and len(out) < most:
        at = queue.pop(0)
        out.append(at)
        for dst in calls.get(at, []):
            if dst not in seen:
                seen.add(dst)
                queue.append(dst)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walks_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, f"n{i % 7}", "function", "" if i % 11 == 10 else f"p{i}", i % 5) for i in range(40)]
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["calls", "calls", "reads"]), rng.randrange(4), k) for k in range(90)]
    order = sorted((e for e in edges if e[2] == "calls" and nodes[e[0]][3] and nodes[e[1]][3]), key=lambda e: (e[3], nodes[e[1]][1], e[4]))
    calls = {}
    for src, dst, *_ in order:
        calls.setdefault(src, []).append(dst)
    roots = [(f"f{i}", i) for i in range(0, 40, 3) if nodes[i][3]] + [("again", 0)]
    got = codemap.call_flows(spark.createDataFrame(roots, "flow string, id long"), spark.createDataFrame(nodes, "id long, label string, kind string, path string, relevance int"), spark.createDataFrame(edges, "src long, dst long, kind string, line int, seq long"))
    want = [(flow, step, node) for flow, root in roots for step, node in enumerate(plain_walk(root, calls))]
    assert rows(got.select("flow", "step", "id")) == sorted(want) and len(want) > len(roots)


def test_steps_lie_at_the_nearest_call(spark):
    flows = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 3)], "flow string, step int, id long")
    nodes = spark.createDataFrame([(i, f"n{i}", f"{i}.go", 10 * i) for i in (1, 2, 3)], "id long, label string, path string, start_line int")
    edges = spark.createDataFrame([(1, 2, "calls", "1.go", 11, 0.5), (1, 2, "calls", "1.go", 12, 0.9), (1, 3, "calls", "1.go", 13, 1.0), (2, 3, "calls", "2.go", 21, 0.1), (3, 3, "calls", "3.go", 31, 1.0)], "src long, dst long, kind string, path string, line int, confidence double")
    got = codemap.flow_steps(flows, nodes, edges).select("step", "path", "line")
    assert rows(got) == [(0, "1.go", 10), (1, "1.go", 12), (2, "2.go", 21)]


def test_limits_of_maps():
    assert [codemap.node_limit(n) for n in (0, 1, 8, 59, 60, 61)] == [36, 8, 8, 59, 60, 60]


def test_a_map_leaves_room_outside(spark):
    symbols = spark.createDataFrame([(i, f"n{i}", "function", f"{i}.go", "go" if i % 2 else "python") for i in range(9)], "id long, name string, kind string, path string, language string")
    edges = [(i, 0, i, "", "calls", "0.go", i, 1.0) for i in range(1, 9)] + [(20 + i, i, None, name, kind, f"{i}.go", 3, 1.0) for i, name, kind in ((1, "len", "calls"), (1, "fmt.Print", "calls"), (1, "os", "imports"), (0, "numpy", "imports"), (2, "numpy.array", "calls"), (1, "local", "calls"), (8, "late", "calls"))]
    edges.append((40, 0, 77, "", "calls", "0.go", 1, 1.0))  # what it points at isn't there
    frame = spark.createDataFrame([(k, *e[1:]) for k, e in enumerate(edges)], "seq long, src long, dst long, to_name string, kind string, path string, line int, confidence double")
    imports = spark.createDataFrame([("1.go", "fmt", "fmt")], "path string, alias string, import_path string")
    nodes, links = codemap.code_map(symbols, frame, imports, [(0, 1.0)], 9)
    assert {r.label for r in nodes.collect()} == {f"n{i}" for i in range(8)} | {"fmt"}  # eight inside, one outside
    assert [r.label for r in nodes.orderBy("place").collect()][:2] == ["n0", "fmt"]
    assert links.count() == 8 and {r.target for r in links.collect()} <= {r.id for r in nodes.collect()}
    wide, _ = codemap.code_map(symbols, frame, imports, [(0, 1.0)])
    assert {(r.label, r.kind) for r in wide.collect() if not r.path} == {("fmt", "stdlib"), ("os", "stdlib"), ("numpy", "external"), ("numpy.array", "external"), ("late", "external")}


def test_ranges_within_lines(spark):
    ranges = spark.createDataFrame([("a", 1, 0, 100, 0, 1), ("a", 5, 4, 5, 10, 2), ("a", 5, 2, 5, 10, 3), ("a", 5, 4, 5, 10, 4), ("a", 70, 3, 130, 1, 5), ("a", 9, 5, 9, 2, 6), ("a", 8, 1, 2, 1, 7)], "path string, start_line int, start_col int, end_line int, end_col int, id long")
    points = [("a", 5, 4), ("a", 5, 3), ("a", 5, 1), ("a", 5, 10), ("a", 5, 11), ("a", 70, 2), ("a", 70, 3), ("a", 130, 1), ("a", 130, 2), ("a", 9, 5), ("a", 1, -1), ("b", 5, 4), ("a", 100, 0)]
    got = resolve.at_line_column(spark.createDataFrame(points, "path string, line int, col int"), ranges, ["path", "line", "col"])
    want = {("a", 5, 4): 2, ("a", 5, 3): 3, ("a", 5, 1): 1, ("a", 5, 10): 2, ("a", 5, 11): 1, ("a", 70, 2): 1, ("a", 70, 3): 5, ("a", 130, 1): 5, ("a", 9, 5): 1, ("a", 100, 0): 5}
    assert {tuple(r)[:3]: r.id for r in got.collect()} == want


RANGE = "path string, start_line int, start_col int, end_line int, end_col int, id long"


def joined_rows(df):
    """Rows that the joins of a frame's plan gave out."""
    df.collect()
    waiting, total = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        plan = waiting.pop()
        name = plan.nodeName()
        if "QueryStage" in name:
            plan = plan.plan()
        elif name == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if "Join" in plan.nodeName():
            total += plan.metrics().apply("numOutputRows").value()
        waiting.append(plan) if plan.nodeName() != name else waiting.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return total


def random_ranges(rng, n, lines, cols):
    some = lambda most: None if rng.random() < 0.03 else rng.randrange(-2, most)
    out = []
    for i in range(n):
        line = rng.randrange(lines)
        out.append((rng.choice("abc"), line, some(cols), line + rng.choice([0, 0, 1, 2, 5, 40, -1]), some(2**31 - 1) if rng.random() < 0.1 else some(cols), i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    lines, cols = [(70, 90), (3, 1000), (4000, 6)][seed]
    held = random_ranges(rng, 300, lines, cols)
    points = [(k, rng.choice("abcd"), rng.randrange(-1, lines), None if rng.random() < 0.05 else rng.randrange(-3, cols)) for k in range(500)]
    ranges = spark.createDataFrame(held, RANGE)
    asked = spark.createDataFrame([*points, *points[:20], (7, "a", None, 3), (8, None, 4, 4)], "request long, path string, line int, col int")
    asked.createOrReplaceTempView("asked"), ranges.createOrReplaceTempView("held")
    want = spark.sql("""SELECT request, min(struct((end_line - start_line) * 100000L + end_col - start_col, id)).id FROM asked p JOIN held r ON p.path = r.path
    WHERE (line > start_line OR (line = start_line AND col >= start_col)) AND (line < end_line OR (line = end_line AND col <= end_col)) GROUP BY request""")
    got = resolve.at_line_column(asked, ranges, ["request"])
    assert rows(got) == rows(want) and len(rows(want)) > 50


def test_ranges_of_one_file_do_not_multiply(spark):
    n = 4000
    ranges = spark.range(n).selectExpr("'a' AS path", "int(id % 50) AS start_line", "int(id % 31) AS start_col", "int(id % 50 + id % 4) AS end_line", "int(id % 31 + id % 41) AS end_col", "id")
    points = spark.range(n).selectExpr("id AS request", "'a' AS path", "int(id % 55) AS line", "int(id % 60) AS col")
    assert joined_rows(resolve.at_line_column(points, ranges, ["request"])) < 40 * n  # all pairs of near lines are about n * n


def test_facts_meet_their_places_once(spark):
    n = 4000
    ranges = spark.range(n).selectExpr("'a' AS path", "int(id % 50) AS start_line", "int(id % 31) AS start_col", "int(id % 50 + id % 4) AS end_line", "int(id % 31 + id % 41) AS end_col", "id")
    symbols = spark.range(n).selectExpr("id", "concat('n', id % 3) AS name", "if(id % 6 = 0, 'file', 'function') AS kind")
    facts = spark.range(n).selectExpr("id div 4 AS request", "concat('n', id % 2) AS identifier", "if(id % 17 = 0, 'jar://x', 'a') AS path", "int(id % 55) AS line", "if(id % 19 = 0, null, int(id % 60)) AS col")
    facts = facts.unionByName(facts.where("request < 50"))
    for name, frame in (("f", facts), ("r", ranges), ("s", symbols)):
        frame.createOrReplaceTempView(name)
    want = spark.sql("""WITH m AS (SELECT request, identifier, f.path, line, col, min(struct((end_line - start_line) * 100000L + end_col - start_col, id)).id AS id FROM (SELECT DISTINCT * FROM f) f JOIN r ON f.path = r.path
    WHERE line >= 1 AND (line > start_line OR (line = start_line AND col >= start_col)) AND (line < end_line OR (line = end_line AND col <= end_col)) GROUP BY ALL),
    t AS (SELECT request, count(DISTINCT m.id) AS n, min(m.id) AS target FROM m JOIN s ON s.id = m.id AND kind <> 'file' AND name = identifier GROUP BY request)
    SELECT request, if(n = 1, target, NULL), CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END FROM (SELECT DISTINCT request FROM f) LEFT JOIN t USING (request)""")
    key = lambda r: (r[0], r[2])
    got = navigation.exact_targets(facts, symbols, ranges)
    found = sorted((tuple(r) for r in got.collect()), key=key)
    assert found == sorted((tuple(r) for r in want.collect()), key=key) and {r[2] for r in found} == {"exact", "ambiguous", "none"}
    assert joined_rows(got) < 60 * n


def test_subjects_go_step_by_step(spark):
    symbols = spark.createDataFrame([(1, "run", "a.run", "x/a.go", "function", "o1"), (2, "run", "b::run", "y/b.go", "file", None), (3, "sole", "c.other", "x/c.go", "function", "3")], "id long, name string, qualified string, path string, kind string, occurrence string")
    ranges = spark.createDataFrame([("x/a.go", 1, 0, 9, 0, 1)], "path string, start_line int, start_col int, end_line int, end_col int, id long")
    asked = [
        ("id", 1, "o1", "sole", "x/a.go", 2, 0), ("gone", 99, None, "sole", "x/a.go", 2, 0), ("occ", None, "o1", "sole", "x/a.go", 2, 0), ("handle", None, "2", None, None, None, None),
        ("both", None, "3", None, None, None, None), ("lost", None, "zz", "sole", None, None, None), ("sole", None, None, "sole", "q.go", 2, 0), ("other", None, None, "other", "q.go", None, None),
        ("many", None, None, "run", "y/z.go", None, None), ("none", None, None, "nope", "x/a.go", 2, 0), ("place", None, None, "", "x/a.go", 2, 0), ("off", None, None, None, "x/a.go", 20, 0), ("empty", None, None, None, None, None, None),
    ]
    got = navigation.subjects(spark.createDataFrame(asked, "request string, symbol_id long, occurrence_id string, identifier string, path string, line int, col int"), symbols, ranges)
    want = {"id": ("symbol", 1, 1), "gone": ("missing", None, 0), "occ": ("occurrence", 1, 1), "handle": ("occurrence", 2, 1), "both": ("occurrence", 3, 1), "lost": ("missing", None, 0), "sole": ("identifier", 3, 1), "other": ("identifier", 3, 1),
            "many": ("identifier", 2, 2), "none": ("identifier", None, 0), "place": ("position", 1, 1), "off": ("missing", None, 0), "empty": ("missing", None, 0)}
    assert {r.request: tuple(r)[1:] for r in got.collect()} == want


def test_subjects_by_position_do_not_multiply(spark):
    n = 4000
    symbols = spark.range(n).selectExpr("id", "concat('n', id % 3) AS name", "concat('p.n', id % 3) AS qualified", "'a' AS path", "'function' AS kind", "concat('o', id) AS occurrence")
    ranges = spark.range(n).selectExpr("'a' AS path", "int(id % 50) AS start_line", "int(id % 31) AS start_col", "int(id % 50 + id % 4) AS end_line", "int(id % 31 + id % 41) AS end_col", "id")
    asked = spark.range(n).selectExpr("id AS request", "bigint(null) AS symbol_id", "string(null) AS occurrence_id", "'' AS identifier", "'a' AS path", "int(id % 55) AS line", "int(id % 60) AS col")
    got = navigation.subjects(asked, symbols, ranges)
    assert joined_rows(got) < 60 * n and {r.step for r in got.collect()} == {"position", "missing"}


def test_packages_of_modules(spark):
    files = spark.createDataFrame([("go.mod", "module ex.com/a\r\ngo 1"), ("b/go.mod", "\n module  ex.com/a/b/ \n"), ("c/go.mod", "module ex.com/c extra\nmodules ex.com/c"), ("d/readme", "module ex.com/d"), ("e/go.mod", None)], "path string, content string")
    imports = spark.createDataFrame([("ex.com/a",), ("ex.com/a/b",), ("ex.com/a/b/x",), ("ex.com/a/z",), ("ex.com/ab",), ("ex.com/c",), ("",), (None,), ("ex.com/a",)], "import_path string")
    # b/go.mod comes before go.mod, as paths are in order
    assert rows(seeds.package_directories(imports, files)) == [("ex.com/a", "."), ("ex.com/a", "."), ("ex.com/a/b", "b"), ("ex.com/a/b/x", "b/x"), ("ex.com/a/z", "z")]


def test_first_of_each_file_then_the_rest(spark):
    symbols = spark.createDataFrame([(1, "low", "function", "p/a.go"), (2, "Run", "method", "p/a.go"), (3, "Store", "interface", "p/a.go"), (4, "tiny", "function", "p/b.go"), (5, "hidden", "type", "p/b.go"), (6, "NewX", "function", "p/c.go"), (7, "TestX", "test", "p/c.go"), (8, "X", "file", "p/d.go"), (9, "Y", "type", "q/a.go")], "id long, name string, kind string, path string")
    targets = spark.createDataFrame([("t", "p")], "target string, dir string")
    assert [r.id for r in seeds.package_seeds(targets, symbols).orderBy("place").collect()] == [3, 5, 7, 6, 2]
    assert [r.id for r in seeds.package_seeds(targets, symbols, 2).orderBy("place").collect()] == [3, 5]


def test_usage_windows_are_cut_at_the_file(spark):
    files = spark.createDataFrame([("a", "1\r\n2\n3\n4\n5\n6"), ("b", " \n\n"), ("c", None)], "path string, code string")
    sites = spark.createDataFrame([("first", "a", 1), ("mid", "a", 3), ("last", "a", 6), ("beyond", "a", 7), ("blank", "b", 1), ("none", "c", 1), ("zero", "a", 0)], "site string, path string, line int")
    got = {r.site: (r.first, r.last, r.content) for r in seeds.usage_windows(sites, files).collect()}
    assert got == {"first": (1, 3, "1\n2\n3"), "mid": (1, 5, "1\n2\n3\n4\n5"), "last": (4, 6, "4\n5\n6")}


MEMBERS = """SELECT target, place, id FROM (SELECT target, s.id, row_number() OVER (PARTITION BY target ORDER BY priority, s.path, s.name, s.id) AS place FROM asked t JOIN (SELECT *,
CASE WHEN kind IN ('test', 'interface') THEN 0 WHEN kind IN ('type', 'class') THEN 1 WHEN kind = 'function' AND startswith(name, 'New') THEN 2 WHEN kind = 'method' THEN 3 ELSE 4 END + CASE WHEN name RLIKE '^[A-Z]' AND kind NOT IN ('file', 'import', 'test') THEN 0 ELSE 10 END AS priority FROM held) s
ON substring_index(t.path, '/', 1) = substring_index(s.path, '/', 1) AND s.id <> target AND ((t.qualified <> '' AND contains(s.qualified, t.qualified || '.')) OR (t.name <> '' AND contains(s.qualified, t.name || '.')))) WHERE place <= {most}"""


@pytest.mark.parametrize("seed", range(3))
def test_members_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab.\u00e9") for _ in range(rng.randrange(5)))
    held = [(i, rng.choice(["New", "x", "Run"]), None if rng.random() < 0.03 else word() + word(), rng.choice(["type", "method", "function", "file", "test"]), f"{rng.choice('pq')}/{rng.randrange(3)}.go") for i in range(200)]
    held += held[:9]
    asked = [(i, None if rng.random() < 0.1 else word()[:2], None if rng.random() < 0.1 else word(), f"{rng.choice('pqr')}/z.go") for i in range(60)]
    targets, symbols = spark.createDataFrame(asked, "target long, name string, qualified string, path string"), spark.createDataFrame(held, "id long, name string, qualified string, kind string, path string")
    targets.createOrReplaceTempView("asked"), symbols.createOrReplaceTempView("held")
    for most in (1, 4, 300):
        want = rows(spark.sql(MEMBERS.format(most=most)))
        assert rows(seeds.member_seeds(targets, symbols, most)) == want and len(want) > 20


def test_members_of_types_named_alike_do_not_multiply(spark):
    n = 6000
    symbols = spark.range(n).selectExpr("id", "concat('n', id) AS name", "concat('Store', id % 6, '.n', id) AS qualified", "if(id % 3 = 0, 'type', 'method') AS kind", "concat('p/', id % 4, '.go') AS path")
    types = symbols.where("kind = 'type'").selectExpr("id AS target", "concat('Store', id % 6) AS name", "concat('pkg.Store', id % 6) AS qualified", "path")
    got = seeds.member_seeds(types, symbols)
    assert joined_rows(got) < 60 * n and got.count() == 19 * n // 3  # all pairs of a directory are n * n / 3
