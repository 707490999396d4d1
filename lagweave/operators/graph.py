"""Graph metrics on keyed edge tables: every graph is a (profile_id, time_index) key, all graphs advance at once.

A graph has as many nodes as its profile has variables (at most a few dozen by the model policy), so the number of
keys is what grows. Shortest paths run inside one call over rows (graph, chunk of sources) that hold the packed edges:
Dijkstra forward and, for betweenness, the dependencies back. No table of pairs or paths is built round by round.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage, spread
from lagweave.functions.scores import corr
from lagweave.operators.cover import clique_cover  # noqa: F401

KEY = ["profile_id", "time_index"]
TIE = 1e-9
SOURCES_PER_CHUNK = 64


def nodes_of(coefs: DataFrame) -> DataFrame:
    return coefs.select(*KEY, F.explode(F.array("src", "dst")).alias("node")).distinct()


def build_edges(coefs: DataFrame, threshold: float = 1e-10) -> DataFrame:
    """Directed edges with |w| >= threshold, no self loops, distance 1 / (|w| + 1e-12) and sign."""
    aw = F.abs("beta")
    return coefs.where((F.col("src") != F.col("dst")) & (aw >= threshold)).select(
        *KEY, "src", "dst", F.col("beta").alias("w"), aw.alias("aw"), (1 / (aw + 1e-12)).alias("dist"), F.when(F.col("beta") >= 0, 1.0).otherwise(-1.0).alias("sign"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of every linked pair; of two directed weights the larger |w| stays."""
    pair = edges.groupBy(*KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("aw").alias("aw"))
    both = pair.select(*KEY, F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "aw")
    return both.select(*KEY, "e.src", "e.dst", "aw", (1 / (F.col("aw") + 1e-12)).alias("dist"))


def node_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda end, p: edges.groupBy(*KEY, F.col(end).alias("node")).agg(
        F.count(F.lit(1)).alias(f"{p}_degree"), F.sum("aw").alias(f"{p}_strength_abs"), F.sum("w").alias(f"{p}_strength_signed"))
    out = nodes.join(side("dst", "in"), [*KEY, "node"], "left").join(side("src", "out"), [*KEY, "node"], "left")
    return out.fillna(0).fillna(0.0)


def matrices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per graph: sorted node names and the |w| matrix as rows of incoming weights, m[target][source]."""
    grid = nodes.select(*KEY, F.col("node").alias("dst")).join(nodes.select(*KEY, F.col("node").alias("src")), KEY)
    full = grid.join(edges.select(*KEY, "src", "dst", "aw"), [*KEY, "src", "dst"], "left").fillna(0.0, ["aw"])
    by_dst = full.groupBy(*KEY, "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "aw"))), lambda s: s["aw"]).alias("r"))
    packed = F.array_sort(F.collect_list(F.struct("dst", "r")))
    return by_dst.groupBy(*KEY).agg(packed.alias("p")).select(*KEY, F.transform("p", lambda s: s["dst"]).alias("names"), F.transform("p", lambda s: s["r"]).alias("m"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _iterate(start: Column, rounds: int, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: step(x))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used; lambda arguments are never derived again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unroll(mat: DataFrame, cols: list[str]) -> DataFrame:
    z = F.arrays_zip("names", *cols)
    return mat.select(*KEY, F.explode(z).alias("z")).select(*KEY, F.col("z.names").alias("node"), *[F.col(f"z.{c}").alias(c) for c in cols])


def _flip(m: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """Weighted PageRank by a fold over one matrix per graph: no shuffle per round."""
    mat = cut_lineage(matrices(edges, nodes)).withColumn("n", F.size("names").cast("double"))
    out_sum = F.transform(_flip("m"), lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v))
    mat = mat.withColumn("out", out_sum).withColumn("p", F.transform("m", lambda r: F.zip_with(
        r, F.col("out"), lambda a, o: F.when(o > 0, a / o).otherwise(1 / F.col("n")))))
    mat = cut_lineage(spread(mat.select(*KEY, "names", "n", "p"), *KEY))
    start = F.transform("names", lambda _: 1 / F.col("n"))
    rank = _iterate(start, rounds, lambda x: F.transform("p", lambda r: damping * _dot(r, x) + (1 - damping) / F.col("n")))
    return _unroll(mat.withColumn("pagerank", rank), ["pagerank"])


def _scaled(x: Column, size) -> Column:
    return _let(x, lambda v: _let(size(v), lambda n: F.transform(v, lambda e: F.when(n > 0, e / n).otherwise(0.0))))


def _norm2(x: Column) -> Column:
    return _scaled(x, lambda v: F.sqrt(_dot(v, v)))


def _norm1(x: Column) -> Column:
    return _scaled(x, lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e))


def spectral_centrality(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 100) -> DataFrame:
    """Eigenvector (shifted power iteration on incoming weights), Katz, HITS hubs and authorities, all on |w|."""
    mat = cut_lineage(spread(matrices(edges, nodes).withColumn("mt", _flip("m")), *KEY))
    ones = F.transform("names", lambda _: F.lit(1.0))
    eig = _iterate(_norm2(ones), rounds, lambda x: _norm2(F.zip_with(x, F.transform("m", lambda r: _dot(r, x)), lambda a, b: a + b)))
    katz = _norm2(_iterate(ones, rounds, lambda x: F.transform("m", lambda r: alpha * _dot(r, x) + beta)))
    auth = _iterate(_norm1(ones), rounds, lambda x: _norm1(_let(F.transform("mt", lambda q: _dot(q, x)), lambda y: F.transform("m", lambda r: _dot(r, y)))))
    done = mat.withColumn("eigenvector", eig).withColumn("katz", katz).withColumn("hits_authority", auth)
    done = cut_lineage(done).withColumn("hits_hub", _norm1(F.transform("mt", lambda q: _dot(q, F.col("hits_authority")))))
    return _unroll(done, ["eigenvector", "katz", "hits_authority", "hits_hub"])


def _chunks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per (graph, chunk of sources): the graph's node names, its edges by place of their ends, the chunk."""
    named = nodes.groupBy(*KEY).agg(F.array_sort(F.collect_list("node")).alias("names"))
    least = edges.groupBy(*KEY, "src", "dst").agg(F.min("dist").alias("dist"))
    packed = least.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "dist"))).alias("e"))
    at = lambda c: F.transform("e", lambda x: x[c])
    part = F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(names) - 1) div {SOURCES_PER_CHUNK} as int)"))).alias("part")
    return spread(named.join(packed, KEY, "left").select(*KEY, "names", at("src").alias("src"), at("dst").alias("dst"), at("dist").alias("dist"), part), *KEY, "part")


def _dijkstra(out: list[list[tuple[int, float]]], source: int) -> tuple[list[int], list[float], list[float], list[list[int]]]:
    """Nodes in the order they are reached, distances, numbers of shortest paths and last steps; lengths within TIE of
    each other are equal."""
    n = len(out)
    dist, paths, before = [float("inf")] * n, [0.0] * n, [[] for _ in range(n)]
    dist[source], paths[source] = 0.0, 1.0
    done, order, heap = [False] * n, [], [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for w, step in out[v]:
            longer = d + step
            if done[w]:
                continue
            if longer < dist[w] * (1 - TIE):
                dist[w], paths[w], before[w] = longer, paths[v], [v]
                heapq.heappush(heap, (longer, w))
            elif longer <= dist[w] * (1 + TIE):
                paths[w] += paths[v]
                before[w].append(v)
    return order, dist, paths, before


def _graphs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, names, outgoing edges, sources) of each row of `_chunks`."""
    for b in batches:
        for profile, time_index, names, src, dst, dist, part in zip(*[b[c] for c in (*KEY, "names", "src", "dst", "dist", "part")]):
            names = list(names)
            at = {v: k for k, v in enumerate(names)}
            out: list[list[tuple[int, float]]] = [[] for _ in names]
            for x, y, w in zip(src if src is not None else (), dst if dst is not None else (), dist if dist is not None else ()):
                if x != y:
                    out[at[x]].append((at[y], float(w)))
            yield (profile, time_index), names, out, range(part * SOURCES_PER_CHUNK, min(len(names), (part + 1) * SOURCES_PER_CHUNK))


def _schema(nodes: DataFrame, fields: str) -> str:
    return ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in KEY) + ", " + fields


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, d of every pair that a path connects."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, names, out, sources in _graphs(batches):
            rows = []
            for s in sources:
                order, dist, *_ = _dijkstra(out, s)
                rows += [(*key, names[s], names[t], dist[t]) for t in order if t != s]
            yield pd.DataFrame(rows, columns=[*KEY, "src", "dst", "d"])

    return _chunks(edges, nodes).mapInPandas(run, _schema(nodes, "src string, dst string, d double"))


def closeness(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closeness on incoming distances, scaled by the reachable share, and harmonic centrality."""
    n = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    into = dist.groupBy(*KEY, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("s"), F.sum(1 / F.col("d")).alias("harmonic"))
    out = nodes.withColumn("n", n).join(into, [*KEY, "node"], "left")
    return out.select(*KEY, "node", F.coalesce(F.col("r") / F.col("s") * F.col("r") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)).alias("closeness"), F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def path_summary(und_dist: DataFrame, components: DataFrame) -> DataFrame:
    """Global efficiency over reachable pairs; mean path length and diameter of the largest component."""
    eff = und_dist.groupBy(*KEY).agg(F.avg(1 / (F.col("d") + 1e-12)).alias("global_efficiency"))
    sizes = components.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.groupBy(*KEY).agg(F.max_by("component", F.struct("n", "component")).alias("component"), F.max("n").alias("largest_component_size"))
    inside = components.join(big, [*KEY, "component"]).select(*KEY, F.col("node").alias("src"))
    lcc = und_dist.join(inside, [*KEY, "src"]).groupBy(*KEY).agg(F.avg("d").alias("avg_path_length"), F.max("d").alias("diameter"))
    return big.drop("component").join(eff, KEY, "left").join(lcc, KEY, "left")


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normalized weighted betweenness: each source's shortest paths are counted forward, then the share of them that a
    node lies on is gathered backward; sources of a chunk are added up before they leave the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, names, out, sources in _graphs(batches):
            total = [0.0] * len(names)
            for s in sources:
                order, _, paths, before = _dijkstra(out, s)
                share = [0.0] * len(names)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
            yield pd.DataFrame([(*key, names[k], b) for k, b in enumerate(total) if b], columns=[*KEY, "node", "b"])

    dep = _chunks(edges, nodes).mapInPandas(run, _schema(nodes, "node string, b double")).groupBy(*KEY, "node").agg(F.sum("b").alias("b"))
    n = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    out = nodes.withColumn("n", n).join(dep, [*KEY, "node"], "left")
    return out.select(*KEY, "node", F.coalesce(F.col("b") / F.nullif((F.col("n") - 1) * (F.col("n") - 2), F.lit(0)), F.lit(0.0)).alias("betweenness"))


def triangles(und: DataFrame) -> DataFrame:
    """Unordered triangles a < b < c with the three weights scaled by the graph's largest weight."""
    e = und.where("src < dst").withColumn("s", F.col("aw") / F.max("aw").over(W.partitionBy(*KEY)))
    ab = e.select(*KEY, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("s").alias("w1"))
    bc = e.select(*KEY, F.col("src").alias("b"), F.col("dst").alias("c"), F.col("s").alias("w2"))
    ac = e.select(*KEY, F.col("src").alias("a"), F.col("dst").alias("c"), F.col("s").alias("w3"))
    return ab.join(bc, [*KEY, "b"]).join(ac, [*KEY, "a", "c"])


def clustering(und: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted local clustering: geometric mean of the triangle weights over possible pairs of neighbours."""
    deg = und.groupBy(*KEY, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    g = triangles(und).select(*KEY, F.explode(F.array("a", "b", "c")).alias("node"), F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("g"))
    per = g.groupBy(*KEY, "node").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n_triangles"))
    out = nodes.join(deg, [*KEY, "node"], "left").join(per, [*KEY, "node"], "left").fillna(0).fillna(0.0)
    return out.select(*KEY, "node", "n_triangles", F.when(F.col("k") > 1, 2 * F.col("g") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"), F.col("k").alias("degree"))


def core_number(und: DataFrame, nodes: DataFrame) -> DataFrame:
    """Core numbers as the fixed point of the neighbours' h-index, all graphs at once."""
    deg = und.groupBy(*KEY, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    core = cut_lineage(nodes.join(deg, [*KEY, "node"], "left").fillna(0, ["c"]))
    ends = und.select(*KEY, F.col("src").alias("node"), F.col("dst").alias("nb"))
    while True:
        nb = core.select(*KEY, F.col("node").alias("nb"), F.col("c").alias("cn"))
        ranked = ends.join(nb, [*KEY, "nb"]).withColumn("r", F.row_number().over(W.partitionBy(*KEY, "node").orderBy(F.desc("cn"))))
        h = ranked.groupBy(*KEY, "node").agg(F.count_if(F.col("cn") >= F.col("r")).alias("h"))
        new = cut_lineage(core.join(h, [*KEY, "node"], "left").select(*KEY, "node", F.least("c", F.coalesce("h", F.lit(0))).alias("c"), F.col("c").alias("old")))
        if new.where("c != old").limit(1).count() == 0:
            return new.select(*KEY, "node", F.col("c").alias("core_number"))
        core = new.drop("old")


def components(und: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components by the smallest reachable name."""
    label = cut_lineage(nodes.withColumn("component", F.col("node")))
    ends = und.select(*KEY, F.col("src").alias("nb"), F.col("dst").alias("node"))
    while True:
        seen = ends.join(label.select(*KEY, F.col("node").alias("nb"), F.col("component").alias("cn")), [*KEY, "nb"]).groupBy(*KEY, "node").agg(F.min("cn").alias("cn"))
        new = cut_lineage(label.join(seen, [*KEY, "node"], "left").select(*KEY, "node", F.least("component", F.coalesce("cn", "component")).alias("component"), F.col("component").alias("old")))
        if new.where("component != old").limit(1).count() == 0:
            return new.drop("old")
        label = new.drop("old")


def communities(und: DataFrame, nodes: DataFrame, together: int = 8) -> DataFrame:
    """Weighted label propagation: each node takes the label with the largest weight among its neighbours, its own
    label counting with its mean incident weight; ties take the smaller name.

    All nodes move at once for `together` rounds. After that a node waits for neighbours of smaller name that want to
    move too: each move then raises the weight inside modules (or lowers a name at equal weight), so a fixed point is
    reached and two-cycles cannot go on."""
    own = und.groupBy(*KEY, F.col("src").alias("node")).agg(F.avg("aw").alias("self"))
    label = cut_lineage(nodes.join(own, [*KEY, "node"], "left").fillna(0.0, ["self"]).withColumn("module", F.col("node")))
    ends = und.select(*KEY, F.col("src").alias("nb"), F.col("dst").alias("node"), "aw")
    for turn in itertools.count():
        votes = ends.join(label.select(*KEY, F.col("node").alias("nb"), "module"), [*KEY, "nb"]).select(*KEY, "node", "module", "aw").unionAll(label.select(*KEY, "node", "module", "self"))
        best = votes.groupBy(*KEY, "node", "module").agg(F.round(F.sum("aw"), 9).alias("v")).groupBy(*KEY, "node").agg(F.min(F.struct((-F.col("v")).alias("v"), "module"))["module"].alias("new"))
        wish = cut_lineage(label.join(best, [*KEY, "node"]).withColumn("moved", F.col("new") != F.col("module")))
        if wish.where("moved").limit(1).count() == 0:
            break
        if turn >= together:
            first = ends.join(wish.where("moved").select(*KEY, F.col("node").alias("nb")), [*KEY, "nb"]).groupBy(*KEY, "node").agg(F.min("nb").alias("ahead"))
            wish = wish.join(first, [*KEY, "node"], "left").withColumn("moved", F.col("moved") & F.coalesce(F.col("ahead") > F.col("node"), F.lit(True)))
        label = cut_lineage(wish.select(*KEY, "node", "self", F.when(F.col("moved"), F.col("new")).otherwise(F.col("module")).alias("module")))
    return label.select(*KEY, "node", "module")


def modularity(und: DataFrame, modules: DataFrame) -> DataFrame:
    a = modules.select(*KEY, F.col("node").alias("src"), F.col("module").alias("ms"))
    b = modules.select(*KEY, F.col("node").alias("dst"), F.col("module").alias("md"))
    e = und.join(a, [*KEY, "src"]).join(b, [*KEY, "dst"])
    per = e.groupBy(*KEY, F.col("ms").alias("module")).agg(F.sum(F.when(F.col("ms") == F.col("md"), F.col("aw")).otherwise(0.0)).alias("inside"), F.sum("aw").alias("deg"))
    total = F.sum("deg").over(W.partitionBy(*KEY))
    q = per.withColumn("part", F.col("inside") / total - F.pow(F.col("deg") / total, 2)).groupBy(*KEY).agg(F.sum("part").alias("modularity"))
    return modules.groupBy(*KEY).agg(F.count_distinct("module").alias("n_modules")).join(q, KEY, "left")


def participation(und: DataFrame, modules: DataFrame) -> DataFrame:
    """1 - sum over modules of the squared share of a node's weight."""
    m = modules.select(*KEY, F.col("node").alias("dst"), "module")
    per = und.join(m, [*KEY, "dst"]).groupBy(*KEY, F.col("src").alias("node"), "module").agg(F.sum("aw").alias("k"))
    out = per.groupBy(*KEY, "node").agg((1 - F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("participation_coeff"))
    return modules.select(*KEY, "node").join(out, [*KEY, "node"], "left").fillna(0.0)


def structural_holes(und: DataFrame) -> DataFrame:
    """Burt's constraint and effective size from two-hop products of tie shares."""
    by = W.partitionBy(*KEY, "src")
    t = und.withColumn("p", F.col("aw") / F.sum("aw").over(by)).withColumn("m", F.col("aw") / F.max("aw").over(by)).select(*KEY, "src", "dst", "p", "m")
    vw = t.select(*KEY, F.col("src").alias("v"), F.col("dst").alias("w"), F.col("p").alias("p_vw"), F.col("m").alias("m_vw"))
    wu = t.select(*KEY, F.col("src").alias("w"), F.col("dst").alias("u"), F.col("p").alias("p_wu"))
    direct = t.select(*KEY, F.col("src").alias("v"), F.col("dst").alias("u"), F.col("p").alias("p_vu"))
    two = vw.join(wu, [*KEY, "w"]).where("v != u").groupBy(*KEY, "v", "u").agg(F.sum(F.col("p_vw") * F.col("p_wu")).alias("ind"))
    cons = direct.join(two, [*KEY, "v", "u"], "left").groupBy(*KEY, F.col("v").alias("node")).agg(F.sum(F.pow(F.col("p_vu") + F.coalesce("ind", F.lit(0.0)), 2)).alias("constraint"))
    uw = t.select(*KEY, F.col("src").alias("u"), F.col("dst").alias("w"), F.col("p").alias("p_uw"))
    red = direct.select(*KEY, "v", "u").join(uw, [*KEY, "u"]).join(vw.select(*KEY, "v", "w", "m_vw"), [*KEY, "v", "w"]).groupBy(*KEY, "v").agg(F.sum(F.col("p_uw") * F.col("m_vw")).alias("red"))
    size = direct.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("k")).join(red, [*KEY, "v"], "left").select(*KEY, F.col("v").alias("node"), (F.col("k") - F.coalesce("red", F.lit(0.0))).alias("effective_size"))
    return cons.join(size, [*KEY, "node"])


def global_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size, density, reciprocity, transitivity, mean clustering and degree assortativity per graph."""
    und = undirected(edges)
    n = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))
    back = edges.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    e = edges.join(back, [*KEY, "src", "dst"], "left").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"), F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("reciprocity"))
    cl = clustering(und, nodes)
    local = cl.groupBy(*KEY).agg(F.avg("clustering").alias("avg_clustering"), (2 * F.sum("n_triangles") / F.nullif(F.sum(F.col("degree") * (F.col("degree") - 1)), F.lit(0))).alias("transitivity"))
    deg = cl.select(*KEY, "node", "degree")
    ends = und.join(deg.select(*KEY, F.col("node").alias("src"), F.col("degree").alias("ds")), [*KEY, "src"]).join(deg.select(*KEY, F.col("node").alias("dst"), F.col("degree").alias("dd")), [*KEY, "dst"])
    assort = ends.groupBy(*KEY).agg(corr("ds", "dd").alias("degree_assortativity"))
    out = n.join(e, KEY, "left").join(local, KEY, "left").join(assort, KEY, "left").fillna(0, ["n_edges"]).fillna(0.0, ["reciprocity", "transitivity"])
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return out.withColumn("density", density)
