"""Graph and plan operators against plain-Python brute force on many small random graphs at once
(one repository per graph)."""

import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from repotide.operators import graph
from repotide.plans import impact, repair, waves
from repotide.session import cut_counting

REPOS, NODES = 60, 9


def _graphs(seed, density=0.16):
    rng = random.Random(seed)
    out = {}
    for r in range(REPOS):
        names = [f"n{i}" for i in range(NODES)]
        p = density * rng.choice([0.5, 1.0, 1.6])
        out[f"r{r}"] = (names, {(a, b) for a in names for b in names if a != b and rng.random() < p})
    return out


@pytest.fixture(scope="module")
def graphs():
    return _graphs(7)


@pytest.fixture(scope="module")
def frames(spark, graphs):
    edges = spark.createDataFrame([(r, a, b) for r, (_, es) in graphs.items() for a, b in sorted(es)], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([(r, n) for r, (ns, _) in graphs.items() for n in ns], "repo_id string, node string")
    return nodes, edges


def _reach(edges, start, forward=True):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            nxt = b if forward and a == x else a if not forward and b == x else None
            if nxt is not None and nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return seen


def _components(names, edges):
    return {n: min(m for m in names if m in _reach(edges, n) and n in _reach(edges, m)) for n in names}


def test_scc(graphs, frames):
    nodes, edges = frames
    got = {(r.repo_id, r.node): r.component for r in graph.scc(edges, nodes).collect()}
    for repo, (names, es) in graphs.items():
        for n, c in _components(names, es).items():
            assert got[repo, n] == c


def test_small_cycle_and_orphan(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "d", "a")], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([("r", n) for n in "abcde"], "repo_id string, node string")
    assert [tuple(r) for r in graph.cyclic_components(edges).collect()] == [("r", "a", 3)]
    assert [r.node for r in graph.orphans(nodes, edges).collect()] == ["e"]
    changed = nodes.filter("node = 'c'")
    assert {(r.node, r.level) for r in graph.impact(edges, changed).collect()} == {("b", 1), ("a", 2)}


def test_no_edges(spark):
    edges = spark.createDataFrame([], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([("r", "a")], "repo_id string, node string")
    assert [tuple(r) for r in graph.scc(edges, nodes).collect()] == [("r", "a", "a")]
    assert [tuple(r) for r in graph.topo_batches(edges, nodes).collect()] == [("r", "a", 0)]


def test_reach_counts(graphs, frames):
    nodes, edges = frames
    got = {(r.repo_id, r.node): r.dependents for r in graph.reach_counts(edges, nodes).collect()}
    for repo, (names, es) in graphs.items():
        for n in names:
            assert got[repo, n] == len(_reach(es, n, forward=False)) - 1


def test_topo_order(graphs, frames):
    nodes, edges = frames
    rows = graph.topo_order(edges, nodes).collect()
    place = {(r.repo_id, r.node): (r.layer, r.position) for r in rows}
    for repo, (names, es) in graphs.items():
        comp = _components(names, es)
        assert sorted(place[repo, n][1] for n in names) == list(range(1, NODES + 1))
        for a, b in es:  # a imports b
            if comp[a] != comp[b]:
                assert place[repo, b][0] < place[repo, a][0]
                assert place[repo, b][1] < place[repo, a][1]
            else:
                assert place[repo, b][0] == place[repo, a][0]


def _batches(names, links):
    """Layers of components, each as many batches high as its largest one; in a component by in-degree and name."""
    comp = _components(names, links)
    inside = {(a, b) for a, b in links if a != b}
    layer = dict.fromkeys(set(comp.values()), 0)
    for _ in layer:
        for a, b in inside:
            if comp[a] != comp[b]:
                layer[comp[b]] = max(layer[comp[b]], layer[comp[a]] + 1)
    size = Counter(comp.values())
    height = Counter()
    for c, at in layer.items():
        height[at] = max(height[at], size[c])
    out = {}
    for c, at in layer.items():
        members = sorted((n for n in names if comp[n] == c), key=lambda n: (sum(b == n for _, b in inside), n))
        for i, n in enumerate(members):
            out[n] = sum(height[x] for x in range(at)) + i
    return out


def test_topo_batches(graphs, frames):
    nodes, edges = frames
    got = {(r.repo_id, r.node): r.batch for r in graph.topo_batches(graph.reverse_edges(edges), nodes).collect()}
    for repo, (names, es) in graphs.items():
        for n, b in _batches(names, {(d, s) for s, d in es}).items():
            assert got[repo, n] == b


def test_many_small_cycles_take_few_rounds(spark, monkeypatch):
    """Forty separate two-node cycles go through one layer."""
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: written.append(1) or real(df))
    rows = [("r", f"n{i}{a}", f"n{i}{b}") for i in range(40) for a, b in ("xy", "yx")]
    edges = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    nodes = edges.select("repo_id", F.col("src").alias("node"))
    got = Counter(r.batch for r in graph.topo_batches(edges, nodes).collect())
    assert got == {0: 40, 1: 40} and len(written) < 25


def _bfs(es, direct, depth):
    level, cause, queue = {d: 0 for d in direct}, {}, deque(sorted(direct))
    while queue:
        x = queue.popleft()
        if level[x] >= depth:
            continue
        for p in sorted(a for a, b in es if b == x):
            if p not in level:
                level[p], cause[p] = level[x] + 1, x
                queue.append(p)
    return {n: (level[n], cause[n]) for n in cause}


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_propagation_cause(graphs, frames, depth):
    nodes, edges = frames
    direct = nodes.filter("node IN ('n3', 'n5')")
    got = {}
    for r in impact.propagate(edges, direct, depth).collect():
        got.setdefault(r.repo_id, {})[r.node] = (r.level, r.cause)
    for repo, (_, es) in graphs.items():
        assert got.get(repo, {}) == _bfs(es, {"n3", "n5"}, depth)


def _greedy(cands, cover, failing):
    target = max(1, math.ceil(failing * 0.7 - 1e-9))
    cap = min(8, max(2, math.ceil(len(cands) * 0.25)))
    covered, picked = set(), []
    for c in sorted(cands, key=lambda c: (-c["dependents"], -len(cover.get(c["node"], ())), -c["failing"], c["node"])):
        if len(picked) >= cap:
            break
        before = len(covered)
        covered |= cover.get(c["node"], set())
        if len(covered) == before:
            continue
        picked.append(c["node"])
        if len(picked) >= 2 and len(covered) >= target:
            break
    return picked


@pytest.fixture(scope="module")
def failing(spark, graphs):
    rng = random.Random(3)
    rows = [(repo, n, f"t{rng.randrange(8)}") for repo, (names, _) in graphs.items() for n in names if rng.random() < 0.5]
    return spark.createDataFrame(sorted(set(rows)), "repo_id string, node string, test_path string"), sorted(set(rows))


def test_root_causes(graphs, frames, failing):
    _, edges = frames
    fm, rows = failing
    cover = repair.potential_cover(edges, fm)
    total = fm.select("repo_id", "test_path").distinct().groupBy("repo_id").count().withColumnRenamed("count", "failing_tests")
    got = {}
    for r in repair.root_causes(repair.candidates(edges, fm, cover), cover, total).collect():
        got.setdefault(r.repo_id, {})[r.pick] = r.node
    for repo, (_, es) in graphs.items():
        mine = [(n, t) for r, n, t in rows if r == repo]
        involved = {n for n, _ in mine}
        want_cover = {n: {t for m, t in mine if m in _reach(es, n, forward=False)} for n in involved}
        cands = [{"node": n, "dependents": sum(1 for _, b in es if b == n), "failing": len({t for m, t in mine if m == n})} for n in involved]
        want = _greedy(cands, want_cover, len({t for _, t in mine}))
        assert [got.get(repo, {})[i] for i in sorted(got.get(repo, {}))] == want


def test_repair_plan_covers_every_file(graphs, frames, failing):
    _, edges = frames
    fm, rows = failing
    plan = repair.repair_plan(edges, fm).collect()
    for repo in graphs:
        involved = sorted({n for r, n, _ in rows if r == repo})
        phased = sorted(p.node for p in plan if p.repo_id == repo and p.phase != "order")
        ordered = sorted(p.node for p in plan if p.repo_id == repo and p.phase == "order")
        assert phased == ordered == involved
        # Middle files come in the batches of the graph among themselves.
        middle = {p.node: p.batch for p in plan if p.repo_id == repo and p.phase == "independent"}
        links = {(b, a) for a, b in graphs[repo][1] if a in middle and b in middle}
        assert middle == _batches(sorted(middle), links)


def test_task_waves(spark):
    tasks = spark.createDataFrame([("p", i, 1) for i in range(1, 8)], "project_id string, task_id long, priority int")
    deps = spark.createDataFrame([("p", 2, 1), ("p", 3, 2), ("p", 4, 99), ("p", 5, 6), ("p", 6, 5), ("p", 7, 6)], "project_id string, task_id long, dep long")
    got = {r.task_id: r.level for r in waves.task_waves(tasks, deps).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: None, 6: None, 7: None}
    plan = {r.level: (r.tasks, r.parallel, r.max_parallel) for r in waves.wave_plan(waves.task_waves(tasks, deps)).collect()}
    assert plan == {0: (2, True, 2), 1: (1, False, 1), 2: (1, False, 1)}
    blocked = {(r.task_id, r.waits_for) for r in waves.blocked(tasks, deps, tasks.filter("task_id = 1")).collect()}
    assert blocked == {(3, 2), (5, 6), (6, 5), (7, 6)}


def test_focus_flags_large_graphs(spark):
    edges = spark.createDataFrame([("r", "hub", f"n{i}") for i in range(60)], "repo_id string, src string, dst string")
    start = spark.createDataFrame([("r", "hub")], "repo_id string, node string")
    nodes, links, size = graph.focus(edges, start, 1, max_nodes=50)
    assert nodes.count() == 61 and links.count() == 60 and size.first()["too_large"]
    assert not graph.focus(edges, start, 1)[2].first()["too_large"]


def _watch(monkeypatch, module=graph):
    """Rows of every table that ``module`` writes."""
    written = []

    def note(name):
        real = getattr(module, name)

        def wrapped(*args, **conditions):
            out = real(*args, **conditions)
            written.append((out[0] if isinstance(out, tuple) else out).count())
            return out

        monkeypatch.setattr(module, name, wrapped)

    note("cut")
    note("cut_counting")
    return written


def _links(spark, rows):
    return spark.createDataFrame([("r", a, b) for a, b in rows], "repo_id string, src string, dst string")


def test_component_rounds_on_long_paths(spark, monkeypatch):
    """A chain of 120 files and a ring of 80: the tables follow the square of the logarithm, not the length."""
    written = _watch(monkeypatch)
    names = [f"n{i:04d}" for i in range(200)]
    random.Random(1).shuffle(names)
    chain, ring = names[:120], names[120:]
    rows = list(zip(chain, chain[1:])) + list(zip(ring, ring[1:])) + [(ring[-1], ring[0])]
    got = {r.node: r.component for r in graph.cyclic_nodes(_links(spark, rows)).collect()}
    assert got == dict.fromkeys(ring, min(ring))
    assert len(written) < 2 * math.log2(200) ** 2


def test_equal_numbers_are_dealt_anew(spark, monkeypatch):
    real, salts = F.xxhash64, []

    def weak(salt, *names):
        salts.append(1)
        return F.lit(7).cast("long") if len(salts) == 1 else real(salt, *names)

    monkeypatch.setattr(graph.F, "xxhash64", weak)
    got = {r.node: r.component for r in graph.cyclic_nodes(_links(spark, ["ab", "ba", "bc", "cd", "dc"])).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_log_keeps_rows_in_few_tables(spark):
    log = graph.Log()
    assert log.rows() is None
    for i in range(graph.FAN_IN ** 2 + 3):
        log.add(graph.cut(spark.range(i, i + 1)))
    assert sorted(r.id for r in log.rows().collect()) == list(range(graph.FAN_IN ** 2 + 3))
    assert [len(level) for level in log.levels] == [3, 0, 1]


def test_layers_write_linear_rows(spark, monkeypatch):
    """A ladder of 40 rungs has 41 layers; what is written stays a small multiple of nodes and links."""
    written = _watch(monkeypatch)
    rows = [(f"{s}{i:02d}", f"{t}{i + 1:02d}") for i in range(40) for s in "ab" for t in "ab"]
    nodes = spark.createDataFrame([("r", f"{s}{i:02d}") for i in range(41) for s in "ab"], "repo_id string, node string")
    done, left = graph.peel(_links(spark, rows), nodes)
    assert {r.node: r.layer for r in done.collect()} == {f"{s}{i:02d}": i for i in range(41) for s in "ab"}
    assert left.count() == 0 and sum(written) < 4 * (82 + 160)


def test_bounds_enclose_the_reach(graphs, frames):
    nodes, edges = frames
    _, dag, weights = graph._weighed(edges, nodes)
    bounds = {(r.repo_id, r.node): (r.lower, r.upper, r.weight) for r in graph.reach_bounds(dag, weights).collect()}
    exact = 0
    for repo, (names, es) in graphs.items():
        for c in set(_components(names, es).values()):
            lower, upper, weight = bounds[repo, c]
            reached = len(_reach(es, c, forward=False)) - weight
            assert lower <= reached <= upper
            exact += lower == upper
    assert exact > len(bounds) / 2


def test_top_reach(graphs, frames):
    nodes, edges = frames
    for top, least in ((3, 1), (2, 4), (50, 1)):
        got = {}
        for r in impact.high_risk(graph.top_reach(edges, top, least), least, top).collect():
            got.setdefault(r.repo_id, set()).add((r.dependents, r.node))
        for repo, (names, es) in graphs.items():
            ends = {x for e in es for x in e}
            every = sorted(((-len(_reach(es, n, forward=False)) + 1, n) for n in ends))
            assert got.get(repo, set()) == {(-d, n) for d, n in every[:top] if -d >= least}


def test_top_reach_makes_few_pairs(spark, monkeypatch):
    """A tree of 400 files with some ways that meet again: the pairs stay far under files x files."""
    written = _watch(monkeypatch)
    rng = random.Random(4)
    rows = {(f"n{i:03d}", f"n{i // 2:03d}") for i in range(1, 400)} | {(f"n{i:03d}", f"n{rng.randrange(i // 2):03d}") for i in rng.sample(range(40, 400), 30)}
    rows = {(a, b) for a, b in rows if a != b}
    got = sorted((-r.dependents, r.node) for r in impact.high_risk(graph.top_reach(_links(spark, sorted(rows)), 5), 1, 5).collect())
    want = sorted((1 - len(_reach(rows, n, forward=False)), n) for n in {x for e in rows for x in e})[:5]
    assert got == want and max(written) < 3000


def test_pushed_tests_make_no_file_pairs(spark, monkeypatch):
    """One failing test on a chain of 60 files: a row a file, where pairs of files would be 1830."""
    written = _watch(monkeypatch)
    names = [f"n{i:02d}" for i in range(60)]
    failing = spark.createDataFrame([("r", n, "t") for n in names], "repo_id string, node string, test_path string")
    cover = repair.potential_cover(_links(spark, zip(names, names[1:])), failing)
    assert sorted(r.node for r in cover.collect()) == names and max(written) < 130


def test_propagation_rows_do_not_grow(spark, monkeypatch):
    written = []
    real = impact.cut_counting
    monkeypatch.setattr(impact, "cut_counting", lambda df, **c: written.append([t for _, t in df.dtypes]) or real(df, **c))
    names = [f"n{i:02d}" for i in range(12)]
    start = spark.createDataFrame([("r", names[-1])], "repo_id string, node string")
    got = {r.node: (r.level, r.cause) for r in impact.propagate(_links(spark, zip(names, names[1:])), start, None).collect()}
    assert got == {names[11 - k]: (k, names[12 - k]) for k in range(1, 12)}
    assert all(not t.startswith("array") for kinds in written for t in kinds)


def test_rounds_send_no_table_through_the_driver(spark, frames, monkeypatch):
    """Joins of the rounds sort and merge although every table here is far below the broadcast limit."""
    nodes, edges = frames
    plans = []

    def seen(df, **counts):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut_counting(df, **counts)

    monkeypatch.setattr(graph, "cut_counting", seen)
    graph.topo_layers(edges, nodes)
    graph.reach_counts(edges, nodes)
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
