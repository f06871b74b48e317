"""Import graph, impact, repair plans and task waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.freshness_queries import OWNED
from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions.paths import module_of
from repotide.operators import extract, freshness, graph, windows
from repotide.plans import impact, repair, waves
from repotide.session import cut

DIRECT = f"""{OWNED}, direct AS (SELECT f.repo_id, f.file_id AS node FROM owned o JOIN fx_files f ON f.repo_id = o.repo_id AND f.path = o.path WHERE o.mtime > o.doc_mtime)"""
LEVELS = """l1 AS (SELECT e.repo_id, e.src AS node, 1 AS level, min([d.node]) AS via FROM direct d JOIN fx_edges e ON e.repo_id = d.repo_id AND e.dst = d.node WHERE e.src NOT IN (SELECT node FROM direct) GROUP BY 1, 2),
  l2 AS (SELECT e.repo_id, e.src AS node, 2 AS level, min(list_append(l1.via, l1.node)) AS via FROM l1 JOIN fx_edges e ON e.repo_id = l1.repo_id AND e.dst = l1.node
     WHERE e.src NOT IN (SELECT node FROM direct UNION SELECT node FROM l1) GROUP BY 1, 2),
  prop AS (SELECT repo_id, node, level, via[-1] AS cause FROM l1 UNION ALL SELECT repo_id, node, level, via[-1] FROM l2)"""
REACH = "reach AS (SELECT repo_id, src AS a, dst AS b FROM fx_edges UNION SELECT r.repo_id, r.a, e.dst FROM reach r JOIN fx_edges e ON e.repo_id = r.repo_id AND e.src = r.b)"
CYC = "cyc AS (SELECT x.repo_id, x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.repo_id, x.a)"
FAILMAP = """failmap AS (SELECT DISTINCT m.repo_id, m.source_id AS node, m.test_path FROM fx_test_map m WHERE (m.repo_id, m.test_path) IN (SELECT (repo_id, test_path) FROM fx_test_results WHERE status = 'failed'))"""
COVER = """cover AS (SELECT DISTINCT i.repo_id, i.node, f.test_path FROM (SELECT DISTINCT repo_id, node FROM failmap) i JOIN failmap f ON f.repo_id = i.repo_id
   WHERE f.node = i.node OR EXISTS (SELECT 1 FROM reach r WHERE r.a = f.node AND r.b = i.node))"""
CANDS = """cands AS (SELECT o.repo_id, o.node, o.failing, coalesce(d.n, 0) AS dependents, c.n AS potential_fixes FROM (SELECT repo_id, node, count(*) AS failing FROM failmap GROUP BY 1, 2) o
   LEFT JOIN (SELECT dst AS node, count(*) AS n FROM fx_edges GROUP BY 1) d USING (node) JOIN (SELECT node, count(*) AS n FROM cover GROUP BY 1) c USING (node))"""
RANK = "row_number() OVER (PARTITION BY repo_id ORDER BY dependents DESC, potential_fixes DESC, failing DESC, node)"
ROOTS = f"""rk AS (SELECT *, {RANK} AS rank FROM cands), adds AS (SELECT repo_id, rank, count(*) AS added FROM (SELECT c.repo_id, c.test_path, min(rank) AS rank FROM cover c JOIN rk USING (repo_id, node) GROUP BY 1, 2) GROUP BY 1, 2),
  st AS (SELECT rk.repo_id, rk.node, row_number() OVER w AS pick, sum(added) OVER w AS s FROM rk JOIN adds USING (repo_id, rank) WINDOW w AS (PARTITION BY rk.repo_id ORDER BY rk.rank)),
  lim AS (SELECT repo_id, least(8, greatest(2, ceil(count(*) * 0.25))) AS cap, (SELECT greatest(1, ceil(count(DISTINCT test_path) * 0.7)) FROM failmap f WHERE f.repo_id = rk.repo_id) AS target FROM rk GROUP BY repo_id),
  roots AS (SELECT st.repo_id, st.node, st.pick FROM st JOIN lim USING (repo_id) WHERE pick <= cap AND pick <= coalesce((SELECT min(pick) FROM st s2 WHERE s2.repo_id = st.repo_id AND s2.pick >= 2 AND s2.s >= lim.target), cap))"""


def _edges(spark, sf):
    return cut(table(spark, sf, "fx_edges"))


def _nodes(spark, sf):
    return table(spark, sf, "fx_files").select("repo_id", F.col("file_id").alias("node"), "path")


def _direct(spark, sf):
    files = table(spark, sf, "fx_files")
    changed = freshness.changed_files(files, table(spark, sf, "fx_docs"))
    # The change set is read by several steps, so it is written once.
    return cut(files.join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", F.col("file_id").alias("node")))


def _failmap(spark, sf):
    failed = table(spark, sf, "fx_test_results").filter("status = 'failed'").select("repo_id", "test_path").distinct()
    return table(spark, sf, "fx_test_map").join(failed, ["repo_id", "test_path"], "left_semi").select(
        "repo_id", F.col("source_id").alias("node"), "test_path").distinct()


def _source_map(spark, sf):
    return table(spark, sf, "fx_test_map").select("repo_id", F.col("source_id").alias("source"), "test_path")


_GRAPH = """SELECT repo_id, path AS src, up_path AS dst FROM fx_links WHERE up_path LIKE '%.js' AND up_path NOT LIKE '%.test.js'
  UNION SELECT repo_id, path, jump_path FROM fx_links WHERE p_size > 40 AND jump_path IS NOT NULL"""


@query("e01_build_graph", _GRAPH)
def _(spark, sf):
    return graph.build_graph(table(spark, sf, "fx_code"))[1]


@query("e01_typescript_graph", f"WITH g AS ({_GRAPH}) SELECT repo_id, regexp_replace(src, '[.]js$', '.ts') AS src, regexp_replace(dst, '[.]js$', '.ts') AS dst FROM g")
def _(spark, sf):
    code = table(spark, sf, "fx_code")
    typed = code.withColumns({"path": F.regexp_replace("path", r"\.js$", ".ts"), "content": F.regexp_replace("content", r"\.js\b", ".ts")})
    return graph.build_graph(typed, "typescript")[1]


@query("e01_require_graph", _GRAPH)
def _(spark, sf):
    code = table(spark, sf, "fx_code")
    called = F.regexp_replace("content", r"import (\{[^}]*\}) from ('[^']+');", "const $1 = require($2);")
    return graph.build_graph(code.withColumn("content", called), require=True)[1]


@query("e02_adjacency", "SELECT repo_id, src AS node, 'imports' AS relation, dst AS neighbour FROM fx_edges UNION ALL SELECT repo_id, dst, 'imported_by', src FROM fx_edges")
def _(spark, sf):
    return graph.adjacency(_nodes(spark, sf), _edges(spark, sf))


@query("e02_degrees", """SELECT f.repo_id, f.file_id AS node, (SELECT count(*) FROM fx_edges e WHERE e.src = f.file_id) AS imports, (SELECT count(*) FROM fx_edges e WHERE e.dst = f.file_id) AS imported_by FROM fx_files f""")
def _(spark, sf):
    return graph.degrees(_nodes(spark, sf), _edges(spark, sf))


_MODLINKS = """m AS (SELECT repo_id, file_id AS node, split_part(path, '/', 1) AS module FROM fx_files), k AS (SELECT DISTINCT e.repo_id, a.module AS a, b.module AS b FROM fx_edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst WHERE a.module <> b.module)"""


@query("e03_module_graph", f"""WITH {_MODLINKS} SELECT m.repo_id, m.module, count(*) AS files, (SELECT count(*) FROM k WHERE k.repo_id = m.repo_id AND k.b = m.module) AS in_degree,
   (SELECT count(*) FROM k WHERE k.repo_id = m.repo_id AND k.a = m.module) AS out_degree FROM m GROUP BY 1, 2""")
def _(spark, sf):
    nodes = _nodes(spark, sf).withColumn("module", module_of(F.col("path"), "first"))
    return graph.module_graph(nodes, _edges(spark, sf))[0]


@query("e04_orphans", "SELECT repo_id, file_id AS node FROM fx_files WHERE file_id NOT IN (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges)")
def _(spark, sf):
    return graph.orphans(_nodes(spark, sf), _edges(spark, sf))


@query("e05_cyclic_components", f"WITH RECURSIVE {REACH}, {CYC} SELECT repo_id, component, count(*) AS size FROM cyc GROUP BY 1, 2")
def _(spark, sf):
    return graph.cyclic_components(_edges(spark, sf))


@query("e06_neighbours", f"""WITH {DIRECT} SELECT e.repo_id, e.src AS node, 'imports' AS relation, e.dst AS neighbour FROM fx_edges e WHERE e.src IN (SELECT node FROM direct) UNION ALL SELECT e.repo_id, e.dst, 'imported_by', e.src FROM fx_edges e WHERE e.dst IN (SELECT node FROM direct)""")
def _(spark, sf):
    return graph.neighbours(_edges(spark, sf), _direct(spark, sf))


@query("e07_impact", f"WITH {DIRECT}, {LEVELS} SELECT repo_id, node, CAST(level AS INT) AS level FROM prop")
def _(spark, sf):
    return graph.impact(_edges(spark, sf), _direct(spark, sf))


@query("e08_reach_counts", f"WITH RECURSIVE {REACH}, {DIRECT} SELECT d.repo_id, d.node, (SELECT count(*) FROM reach r WHERE r.b = d.node AND r.a <> d.node) AS dependents FROM direct d")
def _(spark, sf):
    return graph.reach_counts(_edges(spark, sf), _direct(spark, sf))


@query("e09_high_risk", f"""WITH RECURSIVE {REACH}, n AS (SELECT repo_id, b AS node, count(*) FILTER (a <> b) AS dependents FROM reach GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY dependents DESC, node) AS rn FROM n WHERE dependents >= 5) SELECT repo_id, node, dependents FROM k WHERE rn <= 10""")
def _(spark, sf):
    return impact.high_risk(graph.top_reach(_edges(spark, sf), impact.HIGH_RISK_TOP, least=5), least=5)


@query("e10_module_breakdown", f"WITH {DIRECT}, {LEVELS} SELECT p.repo_id, split_part(f.path, '/', 1) AS module, count(*) AS files FROM prop p JOIN fx_files f ON f.file_id = p.node GROUP BY 1, 2")
def _(spark, sf):
    hit = graph.impact(_edges(spark, sf), _direct(spark, sf)).join(_nodes(spark, sf), ["repo_id", "node"])
    return impact.module_breakdown(hit.withColumn("module", module_of(F.col("path"), "root")))


@query("e11_propagation", f"WITH {DIRECT}, {LEVELS} SELECT repo_id, node, CAST(level AS INT) AS level, cause FROM prop")
def _(spark, sf):
    return impact.propagate(_edges(spark, sf), _direct(spark, sf))


@query("e11_propagation_deep", f"""WITH RECURSIVE {DIRECT}, walk AS (SELECT repo_id, node, 0 AS level FROM direct UNION SELECT w.repo_id, e.src, w.level + 1 FROM walk w JOIN fx_edges e ON e.repo_id = w.repo_id AND e.dst = w.node WHERE w.level < 99)
 SELECT repo_id, node, CAST(min(level) AS INT) AS level FROM walk GROUP BY 1, 2 HAVING min(level) > 0""")
def _(spark, sf):
    return impact.propagate(_edges(spark, sf), _direct(spark, sf), 99).select("repo_id", "node", "level")


@query("e12_propagation_summary", f"""WITH {DIRECT}, {LEVELS}, a AS (SELECT repo_id, 'direct' AS level FROM direct UNION ALL SELECT repo_id, 'L' || level FROM prop)
 SELECT repo_id, CASE WHEN grouping(level) = 1 THEN 'total' ELSE level END AS level, count(*) AS files FROM a GROUP BY GROUPING SETS ((repo_id, level), (repo_id))""")
def _(spark, sf):
    direct = _direct(spark, sf)
    return impact.propagation_summary(direct, impact.propagate(_edges(spark, sf), direct))


@query("e13_components", f"WITH RECURSIVE {REACH}, {CYC} SELECT f.repo_id, f.file_id AS node, coalesce(c.component, f.file_id) AS component FROM fx_files f LEFT JOIN cyc c ON c.node = f.file_id")
def _(spark, sf):
    return graph.scc(_edges(spark, sf), _nodes(spark, sf))


@query("e14_topological_order", f"""WITH RECURSIVE {REACH}, {CYC}, c AS (SELECT f.repo_id, f.file_id AS node, coalesce(c.component, f.file_id) AS component FROM fx_files f LEFT JOIN cyc c ON c.node = f.file_id),
  dag AS (SELECT DISTINCT a.component AS before, b.component AS after FROM fx_edges e JOIN c a ON a.node = e.dst JOIN c b ON b.node = e.src WHERE a.component <> b.component),
  lv AS (SELECT component, 0 AS layer FROM c UNION SELECT d.after, lv.layer + 1 FROM lv JOIN dag d ON d.before = lv.component),
  top AS (SELECT component, max(layer) AS layer FROM lv GROUP BY 1)
 SELECT c.repo_id, c.node, CAST(top.layer AS INT) AS layer, row_number() OVER (PARTITION BY c.repo_id ORDER BY top.layer, c.component, c.node) AS position FROM c JOIN top USING (component)""")
def _(spark, sf):
    return graph.topo_order(_edges(spark, sf), _nodes(spark, sf))


def _topo(p: str, nodes: str, links: str) -> str:
    """CTEs over the CTEs ``nodes`` (repo_id, node) and ``links`` (src before dst): {p}c (repo_id, node, component, layer), {p}b (node, batch)."""
    return f"""{p}r AS (SELECT src AS a, dst AS b FROM {links} WHERE src <> dst UNION SELECT r.a, l.dst FROM {p}r r JOIN {links} l ON r.b = l.src WHERE l.src <> l.dst),
  {p}y AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM {p}r x JOIN {p}r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1, x.a),
  {p}k AS (SELECT n.repo_id, n.node, coalesce(y.component, n.node) AS component FROM {nodes} n LEFT JOIN {p}y y USING (node)),
  {p}d AS (SELECT DISTINCT a.component AS before, b.component AS after FROM {links} l JOIN {p}k a ON a.node = l.src JOIN {p}k b ON b.node = l.dst WHERE a.component <> b.component),
  {p}v AS (SELECT component, 0 AS layer FROM {p}k UNION SELECT d.after, v.layer + 1 FROM {p}v v JOIN {p}d d ON d.before = v.component),
  {p}c AS (SELECT k.repo_id, k.node, k.component, t.layer FROM {p}k k JOIN (SELECT component, max(layer) AS layer FROM {p}v GROUP BY 1) t USING (component)),
  {p}s AS (SELECT *, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component
      ORDER BY (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {links} WHERE src <> dst) l WHERE l.dst = {p}c.node), node) - 1 AS place FROM {p}c),
  {p}h AS (SELECT repo_id, layer, sum(max(size)) OVER (PARTITION BY repo_id ORDER BY layer) - max(size) AS base FROM {p}s GROUP BY repo_id, layer),
  {p}b AS (SELECT s.repo_id, s.node, CAST(h.base + s.place AS INT) AS batch FROM {p}s s JOIN {p}h h USING (repo_id, layer))"""


@query("e15_topological_batches", f"""WITH RECURSIVE {FAILMAP}, i AS (SELECT DISTINCT repo_id, node FROM failmap),
  l AS (SELECT e.dst AS src, e.src AS dst FROM fx_edges e WHERE e.src IN (SELECT node FROM i) AND e.dst IN (SELECT node FROM i)), {_topo('t', 'i', 'l')}
 SELECT repo_id, node, batch FROM tb""")
def _(spark, sf):
    involved = _failmap(spark, sf).select("repo_id", "node").distinct()
    return graph.topo_batches(graph.fix_graph(_edges(spark, sf), involved)[0], involved)


@query("e16_fix_graph", f"""WITH {FAILMAP}, i AS (SELECT DISTINCT repo_id, node FROM failmap), l AS (SELECT e.repo_id, e.dst AS src, e.src AS dst FROM fx_edges e WHERE e.src IN (SELECT node FROM i) AND e.dst IN (SELECT node FROM i))
 SELECT i.repo_id, i.node, (SELECT count(*) FROM l WHERE l.src = i.node) AS out_degree, (SELECT count(*) FROM l WHERE l.dst = i.node) AS in_degree FROM i""")
def _(spark, sf):
    return graph.fix_graph(_edges(spark, sf), _failmap(spark, sf))[1]


@query("e17_potential_fixes", f"WITH RECURSIVE {REACH}, {FAILMAP}, {COVER} SELECT repo_id, node, count(*) AS potential_fixes FROM cover GROUP BY 1, 2")
def _(spark, sf):
    return repair.potential_fixes(repair.potential_cover(_edges(spark, sf), _failmap(spark, sf)))


@query("e18_root_causes", f"WITH RECURSIVE {REACH}, {FAILMAP}, {COVER}, {CANDS}, {ROOTS} SELECT repo_id, node, pick FROM roots")
def _(spark, sf):
    edges, failmap = _edges(spark, sf), _failmap(spark, sf)
    cover = repair.potential_cover(edges, failmap)
    total = failmap.groupBy("repo_id").agg(F.countDistinct("test_path").alias("failing_tests"))
    return repair.root_causes(repair.candidates(edges, failmap, cover), cover, total)


@query("e19_repair_plan", f"""WITH RECURSIVE {REACH}, {FAILMAP}, {COVER}, {CANDS}, {ROOTS}, l AS (SELECT e.dst AS src, e.src AS dst FROM fx_edges e WHERE e.src IN (SELECT node FROM cands) AND e.dst IN (SELECT node FROM cands)),
  rest AS (SELECT c.*, (SELECT count(*) FROM l WHERE l.src = c.node) AS outd FROM cands c WHERE node NOT IN (SELECT node FROM roots))
 SELECT repo_id, 'root_causes' AS phase, {RANK} AS position, node, failing AS tests FROM cands WHERE node IN (SELECT node FROM roots)
 UNION ALL SELECT repo_id, 'leaf_nodes', row_number() OVER (PARTITION BY repo_id ORDER BY failing DESC, node), node, failing FROM rest WHERE outd = 0""")
def _(spark, sf):
    plan = repair.repair_plan(_edges(spark, sf), _failmap(spark, sf))
    return plan.filter("phase IN ('root_causes', 'leaf_nodes')").drop("batch")


@query("e19_repair_plan_batches", f"""WITH RECURSIVE {REACH}, {FAILMAP}, {COVER}, {CANDS}, {ROOTS}, l AS (SELECT e.dst AS src, e.src AS dst FROM fx_edges e WHERE e.src IN (SELECT node FROM cands) AND e.dst IN (SELECT node FROM cands)),
  middle AS (SELECT c.* FROM cands c WHERE node NOT IN (SELECT node FROM roots) AND EXISTS (SELECT 1 FROM l WHERE l.src = c.node AND l.dst <> c.node)),
  ml AS (SELECT src, dst FROM l WHERE src IN (SELECT node FROM middle) AND dst IN (SELECT node FROM middle)), {_topo('m', 'middle', 'ml')}, {_topo('q', 'cands', 'l')}
 SELECT repo_id, 'independent' AS phase, batch, row_number() OVER (PARTITION BY repo_id, batch ORDER BY failing DESC, node) AS position, node, failing AS tests FROM mb JOIN middle USING (repo_id, node)
 UNION ALL SELECT repo_id, 'order', 0, row_number() OVER (PARTITION BY repo_id ORDER BY layer, component, node), node, failing FROM qc JOIN cands USING (repo_id, node)""")
def _(spark, sf):
    return repair.repair_plan(_edges(spark, sf), _failmap(spark, sf)).filter("phase IN ('independent', 'order')")


@query("e20_repair_plan_one_hop", f"""WITH {FAILMAP}, o AS (SELECT repo_id, node, count(*) AS failing FROM failmap GROUP BY 1, 2),
  cands AS (SELECT o.*, (SELECT count(*) FROM fx_edges e WHERE e.dst = o.node) AS dependents, coalesce((SELECT CAST(sum(p.failing) AS BIGINT) FROM fx_edges e JOIN o p ON p.node = e.src WHERE e.dst = o.node), 0) AS potential_fixes FROM o),
  a AS (SELECT *, {RANK} AS rn FROM cands), r AS (SELECT *, {RANK} AS rn FROM cands WHERE dependents > 0), lf AS (SELECT *, {RANK} AS rn FROM cands WHERE dependents = 0)
 SELECT repo_id, 'root_causes' AS phase, CAST(0 AS BIGINT) AS batch, rn AS position, node, failing AS tests FROM r WHERE rn <= 10
 UNION ALL SELECT repo_id, 'leaf_nodes', (rn - 1) // 5, (rn - 1) % 5 + 1, node, failing FROM lf UNION ALL SELECT repo_id, 'order', 0, rn, node, failing FROM a WHERE rn <= 20""")
def _(spark, sf):
    return repair.repair_plan_simple(_edges(spark, sf), _failmap(spark, sf))


_ATESTS = """src AS (SELECT repo_id, node, 1 AS level FROM direct UNION ALL SELECT repo_id, node, level + 1 FROM prop),
  aft AS (SELECT t.repo_id, t.test_path, CAST(coalesce(min(s.level), 99) AS INT) AS level FROM fx_test_map t LEFT JOIN src s ON s.node = t.source_id GROUP BY 1, 2)"""


def _affected(spark, sf):
    direct, smap = _direct(spark, sf), _source_map(spark, sf)
    return impact.affected_tests(direct, impact.propagate(_edges(spark, sf), direct), smap, smap)


@query("e21_affected_tests", f"WITH {DIRECT}, {LEVELS}, {_ATESTS} SELECT * FROM aft")
def _(spark, sf):
    return _affected(spark, sf)


@query("e22_test_order", f"""WITH {DIRECT}, {LEVELS}, {_ATESTS}, rk AS (SELECT repo_id, source_id, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, source_id) - 1 AS r FROM fx_test_map GROUP BY 1, 2),
  b AS (SELECT m.repo_id, m.test_path, min(rk.r) AS r FROM fx_test_map m JOIN rk USING (repo_id, source_id) GROUP BY 1, 2)
 SELECT aft.repo_id, aft.test_path, aft.level, row_number() OVER (PARTITION BY aft.repo_id ORDER BY aft.level, coalesce(b.r, 1000000000), aft.test_path) AS position FROM aft LEFT JOIN b USING (repo_id, test_path)""")
def _(spark, sf):
    smap = _source_map(spark, sf)
    counted = smap.groupBy("repo_id", "source").agg(F.count(F.lit(1)).alias("n"))
    ranks = windows.rank_sources(counted, ["repo_id"], [F.col("n").desc(), F.col("source")])
    return impact.order_tests(_affected(spark, sf), smap, ranks)


@query("g07_source_rank", "SELECT repo_id, source_id AS source, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, source_id) - 1 AS source_rank FROM fx_test_map GROUP BY 1, 2")
def _(spark, sf):
    counted = _source_map(spark, sf).groupBy("repo_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return windows.rank_sources(counted, ["repo_id"], [F.col("n").desc(), F.col("source")]).drop("n")


_FOCUS = """both_ AS (SELECT src AS a, dst AS b FROM fx_edges UNION SELECT dst, src FROM fx_edges), s AS (SELECT min(file_id) AS f FROM fx_files WHERE file_id >= 8),
  h1 AS (SELECT b AS n FROM both_, s WHERE a = s.f), nodes AS (SELECT f AS n FROM s UNION SELECT n FROM h1 UNION SELECT b FROM both_ WHERE a IN (SELECT n FROM h1))"""


def _focus(spark, sf):
    start = table(spark, sf, "fx_files").filter("file_id >= 8").agg(F.min(F.struct("file_id", "repo_id")).alias("s")).select(
        F.col("s.repo_id").alias("repo_id"), F.col("s.file_id").alias("node"))
    return graph.focus(_edges(spark, sf), start)


@query("e23_focus_nodes", f"WITH {_FOCUS} SELECT n AS node FROM nodes")
def _(spark, sf):
    return _focus(spark, sf)[0].select("node")


@query("e23_focus_edges", f"WITH {_FOCUS} SELECT repo_id, src, dst FROM fx_edges WHERE src IN (SELECT n FROM nodes) AND dst IN (SELECT n FROM nodes)")
def _(spark, sf):
    return _focus(spark, sf)[1].select("repo_id", "src", "dst")


@query("e24_module_subgraph", "WITH n AS (SELECT file_id FROM fx_files WHERE path LIKE 'small/%') SELECT repo_id, src, dst FROM fx_edges WHERE src IN (FROM n) AND dst IN (FROM n)")
def _(spark, sf):
    return graph.module_subgraph(_nodes(spark, sf), _edges(spark, sf), "small")[1].select("repo_id", "src", "dst")


_DEPS = """todo AS (SELECT project_id, task_id, priority FROM fx_board WHERE status = 'todo'), deps AS (SELECT DISTINCT d.project_id, d.task_id, d.dep FROM (SELECT project_id, task_id, CAST(regexp_extract(x, '\\[([0-9]+)\\]', 1) AS BIGINT) AS dep
   FROM (SELECT project_id, task_id, unnest(regexp_extract_all(description, '(?i)(?:blocked by|depends on:|requires) \\[[0-9]+\\]')) AS x FROM fx_board WHERE status = 'todo')) d JOIN todo t ON t.task_id = d.dep AND t.project_id = d.project_id)"""
_WAVES = f"""{_DEPS}, lv AS (SELECT task_id, 0 AS level FROM todo UNION SELECT d.task_id, lv.level + 1 FROM lv JOIN deps d ON d.dep = lv.task_id WHERE lv.level < 60),
  waves AS (SELECT t.project_id, t.task_id, CASE WHEN max(level) < 60 THEN CAST(max(level) AS INT) END AS level FROM todo t JOIN lv USING (task_id) GROUP BY 1, 2)"""


def _todo(spark, sf):
    return table(spark, sf, "fx_board").filter("status = 'todo'")


def _deps(spark, sf):
    return extract.parse_task_deps(_todo(spark, sf)).withColumn("dep", F.col("dep").cast("bigint"))


@query("e25_task_waves", f"WITH RECURSIVE {_WAVES} SELECT * FROM waves")
def _(spark, sf):
    return waves.task_waves(_todo(spark, sf), _deps(spark, sf))


@query("e26_wave_plan", f"WITH RECURSIVE {_WAVES} SELECT project_id, level, count(*) AS tasks, count(*) > 1 AS parallel, least(count(*), 3) AS max_parallel FROM waves WHERE level IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return waves.wave_plan(waves.task_waves(_todo(spark, sf), _deps(spark, sf)))


@query("h09_wave_order", f"""WITH RECURSIVE {_WAVES}, n AS (SELECT task_id, count(*) AS n_deps FROM (SELECT DISTINCT task_id, regexp_extract(x, '\\[([0-9]+)\\]', 1) AS dep FROM (SELECT task_id, unnest(regexp_extract_all(description, '(?i)(?:blocked by|depends on:|requires) \\[[0-9]+\\]')) AS x FROM fx_board WHERE status = 'todo')) GROUP BY 1)
 SELECT w.project_id, w.level, w.task_id, t.priority, coalesce(n_deps, 0) AS n_deps, row_number() OVER (PARTITION BY w.project_id, w.level ORDER BY t.priority, coalesce(n_deps, 0), w.task_id) AS position
 FROM waves w JOIN todo t USING (task_id) LEFT JOIN n USING (task_id) WHERE w.level IS NOT NULL""")
def _(spark, sf):
    todo, deps = _todo(spark, sf), _deps(spark, sf)
    return waves.order_wave(waves.task_waves(todo, deps), todo, deps)


@query("e28_blocked", """WITH d AS (SELECT project_id, task_id, CAST(regexp_extract(x, '\\[([0-9]+)\\]', 1) AS BIGINT) AS dep FROM (SELECT project_id, task_id, unnest(regexp_extract_all(description, '(?i)(?:blocked by|depends on:|requires) \\[[0-9]+\\]')) AS x FROM fx_board)),
  o AS (SELECT project_id, task_id FROM fx_board WHERE status <> 'done') SELECT DISTINCT d.project_id, d.task_id, d.dep AS waits_for FROM d JOIN o USING (project_id, task_id) JOIN o p ON p.project_id = d.project_id AND p.task_id = d.dep""")
def _(spark, sf):
    board = table(spark, sf, "fx_board")
    deps = extract.parse_task_deps(board).withColumn("dep", F.col("dep").cast("bigint"))
    return waves.blocked(board, deps, board.filter("status = 'done'"))


@query("i01_changed_and_affected", f"WITH {DIRECT}, {LEVELS} SELECT repo_id, node FROM direct UNION SELECT repo_id, node FROM prop")
def _(spark, sf):
    direct = _direct(spark, sf)
    return windows.union_distinct(direct, graph.impact(_edges(spark, sf), direct).select("repo_id", "node"))


@query("i06_unique_sorted", "SELECT DISTINCT repo_id, dst FROM fx_edges")
def _(spark, sf):
    return windows.unique_sorted(_edges(spark, sf), "repo_id", "dst")
