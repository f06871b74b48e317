"""Import-graph operators; ``edges(repo_id, src, dst)`` means "src imports dst".

Iterative operators are loops of DataFrame joins over a shrinking frontier. Each round is fixed by
a reliable checkpoint, so plans stay short and a lost executor costs one round at most. Neighbour
lists are rows, never arrays: a hub may have any number of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.functions.paths import in_scope
from repotide.operators.extract import extract_exports, extract_imports, without_comments
from repotide.operators.joins import resolve_imports
from repotide.session import REPO, cut_counting, release
from repotide.session import cut_wide as cut

NODE = [REPO, "node"]
FAN_IN = 8  # tables of one level of a log that are written as one of the next level
TRIM_SHARE = 4  # trimming goes on while a round drops more than one edge in so many


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(REPO, F.col("dst").alias("src"), F.col("src").alias("dst"))


def build_graph(files: DataFrame, language: str = "javascript", require: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, exports) of the source files of one language; isolated files stay nodes.

    ``require`` also follows ``require(...)`` calls. Python texts keep their comments: its import forms
    are whole lines.
    """
    clean = files if language == "python" else without_comments(files)
    resolved = resolve_imports(extract_imports(clean, language, require), files, language=language)
    edges = resolved.select(REPO, F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    return files.select(REPO, F.col("path").alias("node")), edges, extract_exports(clean, "python" if language == "python" else "javascript")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(REPO, F.col("src").alias("node")).unionByName(
        edges.select(REPO, F.col("dst").alias("node"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Import and importer counts per node."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(REPO, F.col("src").alias("node"), one.alias("o"), zero.alias("i")).unionByName(
        edges.select(REPO, F.col("dst").alias("node"), zero.alias("o"), one.alias("i")))
    counted = ends.groupBy(*NODE).agg(F.sum("o").alias("imports"), F.sum("i").alias("imported_by"))
    return nodes.select(*NODE).join(counted, NODE, "left").na.fill(0, ["imports", "imported_by"])


def adjacency(nodes: DataFrame, edges: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """(node, relation, neighbour): imports, imported_by and exports of each node, in long form."""
    rows = edges.select(REPO, F.col("src").alias("node"), F.lit("imports").alias("relation"), F.col("dst").alias("neighbour")
                        ).unionByName(edges.select(REPO, F.col("dst").alias("node"), F.lit("imported_by").alias("relation"),
                                                   F.col("src").alias("neighbour")))
    if exports is not None:
        rows = rows.unionByName(exports.select(REPO, "node", F.lit("exports").alias("relation"), F.col("symbol").alias("neighbour")))
    return rows.join(nodes.select(*NODE).distinct(), NODE, "left_semi").distinct()


def neighbours(edges: DataFrame, keys: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """The adjacency rows of the asked files only."""
    return adjacency(keys, edges, exports)


def module_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module stats, module edges). ``nodes``: repo_id, node, module; self loops are dropped."""
    side = lambda end: nodes.select(REPO, F.col("node").alias(end), F.col("module").alias(f"{end}_module"))
    links = edges.join(side("src"), [REPO, "src"]).join(side("dst"), [REPO, "dst"]).select(
        REPO, "src_module", "dst_module").filter("src_module <> dst_module").distinct()
    files = nodes.groupBy(REPO, "module").agg(F.count(F.lit(1)).alias("files"))
    out = links.groupBy(REPO, F.col("src_module").alias("module")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = links.groupBy(REPO, F.col("dst_module").alias("module")).agg(F.count(F.lit(1)).alias("in_degree"))
    stats = files.join(inn, [REPO, "module"], "left").join(out, [REPO, "module"], "left").na.fill(0, ["in_degree", "out_degree"])
    return stats, links


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without imports and importers."""
    return nodes.select(*NODE).join(edges.select(REPO, F.col("src").alias("node")), NODE, "left_anti").join(
        edges.select(REPO, F.col("dst").alias("node")), NODE, "left_anti")


class Log:
    """Rows that rounds of a loop add, as tables of growing size.

    ``FAN_IN`` tables of a level become one of the next, so a row is written once for each level (the logarithm
    of the rounds) and the union that reads them stays short.
    """

    def __init__(self):
        self.levels: list[list[DataFrame]] = []

    def add(self, table: DataFrame) -> None:
        """``table`` is one made by ``cut``; the log owns it from here on."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(table)
            if len(self.levels[level]) < FAN_IN:
                return
            merged, table = self.levels[level], cut(reduce(DataFrame.unionByName, [t.select("*") for t in self.levels[level]]))
            self.levels[level] = []
            release(*merged)
            level += 1

    def rows(self) -> DataFrame | None:
        """All rows added so far; None before the first ``add``."""
        tables = [t for level in self.levels for t in level]
        return reduce(DataFrame.unionByName, tables).hint("merge") if tables else None


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b) links, (repo_id, node, id)): the edges between numbers, and the numbers of their ends.

    A number is a hash of the name, so it is found without a join and its order is random. Should two nodes ever
    get the same one, all are dealt out anew with another seed.
    """
    ends = cut(endpoints(edges))
    for salt in count():
        number = lambda c: F.xxhash64(F.lit(salt), REPO, F.col(c))  # noqa: E731, B023
        ids = ends.withColumn("id", number("node"))
        twice = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if twice.isEmpty():
            return edges.filter("src <> dst").select(number("src").alias("a"), number("dst").alias("b")).distinct(), ids


def _trim(links: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Drop links that cannot lie between cycles: those from sources or into sinks, and again.

    It stops once a round drops few of them, so the rounds follow the logarithm of the links and a long chain
    is left to the labels. ``links`` is a table made by ``cut``, with ``size`` rows; the result is one too.
    """
    while size:
        heads, tails = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        left, seen = cut_counting(links.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"))
        release(links)
        links, dropped, size = left, size - seen["rows"], seen["rows"]
        if dropped * TRIM_SHARE <= size:
            break
    return links, size


def _labels(links: DataFrame) -> DataFrame:
    """(id, f, b): the least number that reaches it and the least one it reaches, itself included.

    Both directions are rows of one table. Labels go along the links, and along a link from the node that a label
    names to the one that holds it. As numbers are in random order, that jumps over a share of the way already
    known, so on chains and rings the rounds of a pass, and the passes, follow the logarithm of the length. (Behind a long chain a ring's label can meet
    labels from the chain, which name nobody on the ring, and then it goes on link by link.) Only labels that changed,
    or came to name another node, are sent.
    """
    ways = cut(links.select(F.lit(True).alias("ahead"), F.col("a").alias("by"), F.col("b").alias("id")).unionByName(
        links.select(F.lit(False).alias("ahead"), F.col("b").alias("by"), F.col("a").alias("id"))))
    key = ["ahead", "id"]
    # The first round's labels come straight from the links.
    starts = ways.unionByName(ways.select("ahead", "by", F.col("by").alias("id")))  # also for nodes that nothing leads to
    labels = starts.groupBy(*key).agg(F.least("id", F.min("by")).alias("label"))
    labels, seen = cut_counting(labels.withColumn("moved", F.lit(True)), moved=F.col("label") < F.col("id"))
    while seen["moved"]:
        known = labels.select("ahead", F.col("id").alias("by"), "label", "moved")
        jumps = labels.filter("label <> id").select("ahead", F.col("label").alias("by"), "id", F.col("moved").alias("fresh"))
        told = ways.withColumn("fresh", F.lit(False)).unionByName(jumps).join(known, ["ahead", "by"]).filter("moved or fresh").select(
            *key, "label", F.lit(None).cast("long").alias("old"))
        merged = labels.select(*key, "label", F.col("label").alias("old")).unionByName(told).groupBy(*key).agg(
            F.min("label").alias("label"), F.max("old").alias("old"))
        before = labels
        labels, seen = cut_counting(merged.select(*key, "label", (F.col("label") < F.col("old")).alias("moved")), moved=F.col("moved"))
        release(before)
    release(ways)
    return labels.groupBy("id").agg(*[F.max(F.when(F.col("ahead") == side, F.col("label"))).alias(name) for name, side in (("f", True), ("b", False))])


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(repo_id, node, component) of nodes on a cycle; the component is its smallest node.

    A node whose two labels agree is in one component with the node they name. Solved components leave, links
    between different label pairs cannot lie on a cycle and leave too, and the rest is solved again; every pass
    solves at least the first node left.
    """
    links, ids = _numbered(edges)
    core, seen = cut_counting(links)
    core, size = _trim(core, seen["rows"])
    found = Log()
    while size:
        labels = cut(_labels(core))
        found.add(labels)
        open_ = labels.filter("f <> b")
        ends = lambda e: open_.select(F.col("id").alias(e), F.col("f").alias(f"{e}_f"), F.col("b").alias(f"{e}_b"))
        rest, seen = cut_counting(core.join(ends("a"), "a").join(ends("b"), "b").filter("a_f = b_f AND a_b = b_b").select("a", "b"))
        release(core)
        core, size = _trim(rest, seen["rows"])
    solved = found.rows()
    if solved is None:
        return endpoints(edges).withColumn("component", F.col("node")).limit(0)
    named = solved.filter("f = b").select("id", "f").join(ids, "id")
    big = named.groupBy("f").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("component")).filter("_n > 1").drop("_n")
    return cut(named.join(big, "f").select(*NODE, "component"))


def scc(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(repo_id, node, component) of every node; a node on no cycle is its own component."""
    every = endpoints(edges) if nodes is None else endpoints(edges).unionByName(nodes.select(*NODE)).distinct()
    return every.join(cyclic_nodes(edges), NODE, "left").withColumn("component", F.coalesce("component", "node"))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Cycle groups: component and its size. The members are the rows of ``cyclic_nodes``."""
    return cyclic_nodes(edges).groupBy(REPO, "component").agg(F.count(F.lit(1)).alias("size"))


def condense(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Edges between components (acyclic). ``cyclic`` holds only the nodes on cycles."""
    side = lambda end: cyclic.select(REPO, F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    return edges.join(side("src"), [REPO, "src"], "left").join(side("dst"), [REPO, "dst"], "left").select(
        REPO, F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst")).filter("src <> dst").distinct()


def component_of(rows: DataFrame, cyclic: DataFrame, node: str = "node") -> DataFrame:
    """``rows`` with the component of ``node``."""
    return rows.join(cyclic.select(REPO, F.col("node").alias(node), "component"), [REPO, node], "left").withColumn(
        "component", F.coalesce("component", node))


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_id, start, node): every ``start`` with all nodes that links (node -> next) lead to from its seeds.

    ``seeds``: repo_id, start, node, themselves part of the result. A pair is written once and extended once.
    Run it on a condensed graph so that no pairs inside a cycle are made.
    """
    pair = [REPO, "start", "node"]
    frontier, size = cut_counting(seeds.select(*pair).distinct())
    links, seen = cut(links.select(*NODE, "next")), Log()
    while size["rows"]:
        known = seen.rows()
        step = frontier.join(links, NODE).select(REPO, "start", F.col("next").alias("node")).distinct().join(frontier, pair, "left_anti")
        fresh, size = cut_counting(step if known is None else step.join(known, pair, "left_anti"))
        seen.add(frontier)
        frontier = fresh
    rows = seen.rows()
    return frontier if rows is None else rows


def closure(dag: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, start, node) pairs with ``node`` depending on ``start`` (importers), start included."""
    return spread(dag.select(REPO, F.col("dst").alias("node"), F.col("src").alias("next")),
                  starts.select(REPO, "start", F.col("start").alias("node")))


def reach_bounds(dag: DataFrame, weights: DataFrame) -> DataFrame:
    """(repo_id, node, weight, lower, upper): bounds of the weight that transitively imports each node of ``dag``.

    ``weights``: repo_id, node, weight, for every node. The upper bound adds up over all importers, so it counts
    what comes by several ways several times (up to the weight of everything). The lower one follows a forest: each
    node hands its share on to one of the files it imports, the one with most importers. Where no way splits and
    meets again both are the exact number.
    """
    total = int(weights.agg(F.sum("weight")).first()[0] or 0)
    width = dag.groupBy(REPO, "dst").agg(F.count(F.lit(1)).alias("_in"))
    heir = dag.join(width, [REPO, "dst"]).groupBy(REPO, "src").agg(F.max(F.struct("_in", "dst")).alias("_to"))
    share = weights.select(REPO, F.col("node").alias("src"), F.col("weight").alias("_w"))
    links = dag.join(heir, [REPO, "src"]).join(share, [REPO, "src"]).select(
        REPO, "src", "dst", "_w", (F.col("dst") == F.col("_to.dst")).alias("_heir"))
    sums = {"lower": F.when(F.col("_heir"), F.col("_w") + F.col("lower")).otherwise(0),
            "upper": F.col("_w") + F.least("upper", F.lit(total))}
    placed, _ = peel(links, weights, sums)
    return placed.join(weights, NODE).select(*NODE, "weight", "lower", F.least("upper", F.lit(total)).alias("upper"))


def _reached(dag: DataFrame, weights: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, component, reached): exact weight of the transitive importers of the ``starts`` (repo_id, component)."""
    pairs = closure(dag, starts.select(REPO, F.col("component").alias("start"))).filter("node <> start")
    met = pairs.join(weights, NODE).groupBy(REPO, F.col("start").alias("component")).agg(F.sum("weight").alias("reached"))
    return starts.join(met, [REPO, "component"], "left").na.fill(0, ["reached"])


def _weighed(edges: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cyclic nodes, condensed edges, component weights) of a graph and further nodes."""
    cyclic = cyclic_nodes(edges)
    every = component_of(endpoints(edges).unionByName(extra.select(*NODE)).distinct(), cyclic)
    weights = cut(every.groupBy(REPO, F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("weight")))
    return cyclic, cut(condense(edges, cyclic)), weights


def _counted(dag: DataFrame, weights: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo_id, node, dependents) of ``asked`` (repo_id, node, component, weight, lower, upper).

    Components whose bounds agree need no search; the others are closed exactly.
    """
    open_ = asked.filter("lower < upper").select(REPO, "component").distinct()
    exact = _reached(dag, weights, open_)
    return asked.join(exact, [REPO, "component"], "left").select(
        *NODE, (F.coalesce("reached", "lower") + F.col("weight") - 1).alias("dependents"))


def reach_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, node, dependents): transitive importers of each start, itself not counted.

    Pairs of nodes are made only for starts above which ways split and meet again.
    """
    edges = cut(edges)
    starts = cut(starts.select(*NODE).distinct())
    cyclic, dag, weights = _weighed(edges, starts)
    bounds = reach_bounds(dag, weights).withColumnRenamed("node", "component")
    return _counted(dag, weights, cut(component_of(starts, cyclic).join(bounds, [REPO, "component"])))


def top_reach(edges: DataFrame, top: int, least: int = 1) -> DataFrame:
    """(repo_id, node, dependents): at least the ``top`` files of each repository with most transitive importers.

    Files with fewer than ``least`` are left out. A file can only be among the first if its upper bound reaches
    the lower bound of the file in the last place, so only those are counted, and only where their bounds differ.
    """
    edges = cut(edges)
    cyclic, dag, weights = _weighed(edges, endpoints(edges))
    bounds = reach_bounds(dag, weights).withColumnRenamed("node", "component")
    own = F.col("weight") - 1  # the other files on the same cycle
    files = cut(component_of(endpoints(edges), cyclic).join(bounds, [REPO, "component"]))
    place = Window.partitionBy(REPO).orderBy((F.col("lower") + own).desc(), "node")
    first = files.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= top)
    bar = first.groupBy(REPO).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("lower") + own).alias("_bar"))
    bar = bar.select(REPO, F.greatest(F.lit(least), F.when(F.col("_n") == top, F.col("_bar")).otherwise(0)).alias("_bar"))
    asked = files.join(bar, REPO).filter(F.col("upper") + own >= F.col("_bar")).drop("_bar")
    return _counted(dag, weights, cut(asked)).filter(F.col("dependents") >= least)


def rounds(depth: int | None):
    """1, 2, ... up to ``depth``; without end for None."""
    return count(1) if depth is None else range(1, depth + 1)


def _levels(starts: DataFrame, depth: int | None, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes with the first level at which ``step`` (frontier -> repo_id, node) reaches them, down to
    ``depth`` levels, or all of them for None."""
    frontier, size = cut_counting(starts.select(*NODE).distinct().withColumn("level", F.lit(0)))
    seen = Log()
    for level in rounds(depth):
        if not size["rows"]:
            break
        fresh, known = step(frontier).distinct().join(frontier, NODE, "left_anti"), seen.rows()
        fresh = fresh if known is None else fresh.join(known, NODE, "left_anti")
        fresh, size = cut_counting(fresh.withColumn("level", F.lit(level)))
        seen.add(frontier)
        frontier = fresh
    known = seen.rows()
    return frontier if known is None else known.unionByName(frontier)


def importers_of(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo_id, node, level): the starts (level 0) and their importers, up to ``depth`` hops away (None: all)."""
    edges = cut(edges)
    importers = edges.select(REPO, F.col("dst").alias("node"), F.col("src").alias("next"))
    step = lambda f: f.join(importers, NODE).select(REPO, F.col("next").alias("node"))
    return _levels(starts, depth, step)


def impact(edges: DataFrame, changed: DataFrame, depth: int | None = 2) -> DataFrame:
    """(repo_id, node, level): importers up to ``depth`` hops from the changed files (None: all), those excluded."""
    return importers_of(edges, changed, depth).filter("level > 0")


def focus(edges: DataFrame, start: DataFrame, depth: int | None = 2, max_nodes: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with level, edges among them, one row per repository with size and too_large).

    Both directions from the start files. Nothing is dropped when the limit is passed; the flag
    tells a viewer to narrow the question.
    """
    edges = cut(edges)
    both = edges.select(REPO, F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(
        edges.select(REPO, F.col("dst").alias("node"), F.col("src").alias("next")))
    step = lambda f: f.join(both, NODE).select(REPO, F.col("next").alias("node"))
    nodes = _levels(start, depth, step)
    size = nodes.groupBy(REPO).agg(F.count(F.lit(1)).alias("nodes")).withColumn("too_large", F.col("nodes") >= max_nodes)
    return nodes, induced(edges, nodes), size


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    keep = nodes.select(*NODE).distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), [REPO, "src"], "left_semi").join(
        keep.withColumnRenamed("node", "dst"), [REPO, "dst"], "left_semi")


def module_subgraph(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Nodes under a directory (by ``path``) and the edges inside it."""
    inside = nodes.filter(in_scope(F.col("path"), prefix))
    return inside, induced(edges, inside)


def fix_graph(edges: DataFrame, involved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges dependency -> dependent among the involved files, node degrees)."""
    links = reverse_edges(induced(edges.filter("src <> dst"), involved)).distinct()
    degree = degrees(involved.select(*NODE).distinct(), links)
    return links, degree.select(*NODE, F.col("imports").alias("out_degree"), F.col("imported_by").alias("in_degree"))


def peel(links: DataFrame, nodes: DataFrame, sums: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node with layer, nodes left over): layers of nodes whose predecessors are all in earlier ones.

    ``links``: src before dst. Nodes on or behind a cycle are left over. ``sums`` are further columns of the result:
    each adds up, over the links into a node, an expression of the link's columns and the predecessor's own sums.

    The number of predecessors is a fixed table. A round looks only at the links out of the nodes it placed and logs
    for each node hit how many predecessors that were; what a node got before is read from the log. So rows
    written follow the nodes and links, whatever the number of layers.
    """
    sums = sums or {}
    todo = cut(nodes.select(*NODE).distinct())
    inner = induced(links.filter("src <> dst"), todo)
    inner = cut(inner.dropDuplicates([REPO, "src", "dst"]))
    waits = cut(inner.groupBy(REPO, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")))
    zero = F.lit(0).cast("bigint")
    last, size = cut_counting(todo.join(waits, NODE, "left_anti").select(
        *NODE, zero.alias("got"), *[zero.alias(f"add_{c}") for c in sums], F.lit(True).alias("go"), F.lit(0).alias("layer"), *[zero.alias(c) for c in sums]),
        go=F.lit(True))
    log = Log()
    for layer in count(1):
        if not size["go"]:
            break
        placed = last.filter("go").select(REPO, F.col("node").alias("src"), *sums)
        told = inner.join(placed, [REPO, "src"]).groupBy(REPO, F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("got"), *[F.sum(e).cast("bigint").alias(f"add_{c}") for c, e in sums.items()])
        parts = ["got", *[f"add_{c}" for c in sums]]
        known = log.rows()
        known = last if known is None else known.unionByName(last).hint("merge")
        before = known.select(*NODE, *parts).join(told.select(*NODE), NODE, "left_semi")
        both = told.select(*NODE, *parts, *[F.col(c).alias(f"new_{c}") for c in parts]).unionByName(
            before.select(*NODE, *parts, *[zero.alias(f"new_{c}") for c in parts]))
        whole = both.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in parts], *[F.sum(f"new_{c}").alias(f"new_{c}") for c in parts]).join(waits, NODE)
        table, size = cut_counting(whole.select(
            *NODE, *[F.col(f"new_{c}").alias(c) for c in parts], (F.col("got") == F.col("need")).alias("go"), F.lit(layer).alias("layer"),
            *[F.col(f"add_{c}").alias(c) for c in sums]), go=F.col("go"))
        log.add(last)
        last = table
    known = log.rows()
    every = last if known is None else known.unionByName(last)
    done = cut(every.filter("go").select(*NODE, "layer", *sums))
    return done, todo.join(done, NODE, "left_anti")


def topo_layers(edges: DataFrame, nodes: DataFrame, links_are_ordered: bool = False) -> DataFrame:
    """(node, component, layer): dependencies in earlier layers, cycles as one component."""
    nodes = cut(nodes.select(*NODE).distinct())
    links = cut(induced(edges if links_are_ordered else reverse_edges(edges), nodes))
    cyclic = cyclic_nodes(links)
    placed = component_of(nodes, cyclic)
    layers, _ = peel(condense(links, cyclic), placed.select(REPO, F.col("component").alias("node")))
    return placed.join(layers.withColumnRenamed("node", "component"), [REPO, "component"]).select(*NODE, "component", "layer")


def topo_order(edges: DataFrame, nodes: DataFrame, links_are_ordered: bool = False) -> DataFrame:
    """(node, layer, position): dependency before dependent, by layer, component, name."""
    from repotide.operators.windows import number_rows

    layers = topo_layers(edges, nodes, links_are_ordered)
    return number_rows(layers, [REPO], [F.col("layer"), F.col("component"), F.col("node")], "position").select(
        *NODE, "layer", "position")


def topo_batches(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, batch) for parallel work: what comes before a node is in an earlier batch, except inside a cycle.

    Cycles are one component each and go through the layers as one; its nodes follow each other by
    in-degree and name. A layer takes as many batches as its largest component has nodes, so rounds follow
    the longest path, however many cycles there are.
    """
    from repotide.operators.windows import number_rows

    nodes = cut(nodes.select(*NODE).distinct())
    links = cut(induced(links.filter("src <> dst"), nodes).select(REPO, "src", "dst").distinct())
    layers = cut(topo_layers(links, nodes, links_are_ordered=True))
    sizes = layers.groupBy(REPO, "layer", "component").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(REPO).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy(REPO, "layer").agg(F.max("_n").alias("_h")).select(
        REPO, "layer", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_base"))  # a row per layer
    waits = links.groupBy(REPO, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
    cyclic = layers.join(sizes.filter("_n > 1").select(REPO, "component"), [REPO, "component"], "left_semi").join(waits, NODE)
    places = number_rows(cyclic, [REPO, "component"], [F.col("_in"), F.col("node")], "_rn").select(*NODE, "_rn")
    return layers.join(places, NODE, "left").join(base, [REPO, "layer"]).select(
        *NODE, (F.col("_base") + F.coalesce("_rn", F.lit(1)) - 1).cast("int").alias("batch"))
