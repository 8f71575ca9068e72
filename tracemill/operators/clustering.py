"""Clustering of failures, and scores of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.ordered import running_total
from tracemill.session import cut

#: The thresholds that are tried, and the largest share of a cluster.
LADDER = (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)
LARGEST = 0.45
#: Weights of queries, and of documents, that meet in one task.
CELL = 2_000_000
#: Clusters whose sums of vectors travel to every row in one array.
MOST_CLUSTERS = 5_000
#: Distances that a task holds at a time.
DISTANCES = 4_000_000


# --- vectors ------------------------------------------------------------------


def _places(docs: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(the different ids, the place of each row's id among them)."""
    e = pc.dictionary_encode(docs.combine_chunks())
    e = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
    return e.dictionary, e.indices.to_numpy()


def _cosines_of_cell(docs: pa.Table, queries: pa.Table) -> pa.Table:
    """``query, doc, score`` of a cell's pairs with a common term.

    Every weight of a document meets the query weights of its term in arrays of at
    most some ``CELL`` products, which are summed by pair.
    """
    if not len(docs) or not len(queries):
        return pa.table({})
    asked = queries["asked"].combine_chunks()
    terms = pc.unique(asked)
    by_term = pc.index_in(asked, terms).to_numpy()
    order = np.argsort(by_term, kind="stable")
    names, q = _places(queries["query"])
    q, qw = q[order], queries["qw"].to_numpy()[order]
    count = np.bincount(by_term, minlength=len(terms))
    first = np.cumsum(count) - count
    met = pc.index_in(docs["term"].combine_chunks(), terms)
    docs, met = docs.filter(pc.is_valid(met)), met.drop_null().to_numpy()
    ids, d = _places(docs["doc"])
    order = np.argsort(d, kind="stable")
    d, met, w = d[order], met[order], docs["weight"].to_numpy()[order]
    # Documents of a step: few enough for a table of sums by pair.
    step = max(1, CELL // max(1, len(names)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(ids), step):
        size = min(step, len(ids) - at)
        sums = np.zeros(size * len(names))
        lo, hi = np.searchsorted(d, (at, at + size))
        products = np.cumsum(count[met[lo:hi]])
        cuts = np.searchsorted(products, np.arange(CELL, products[-1] + CELL, CELL))
        for a, b in zip([0, *np.minimum(cuts + 1, hi - lo)], [*np.minimum(cuts + 1, hi - lo), hi - lo]):
            term = met[lo + a : lo + b]
            n = count[term]
            entry = np.arange(n.sum()) + np.repeat(first[term] - (np.cumsum(n) - n), n)
            pair = np.repeat((d[lo + a : lo + b] - at) * len(names), n) + q[entry]
            sums += np.bincount(pair, np.repeat(w[lo + a : lo + b], n) * qw[entry], len(sums))
        pairs = np.flatnonzero(sums)
        found.append((pairs % len(names), pairs // len(names) + at, sums[pairs]))
    query, doc, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    out = pa.table({"query": names.take(pa.array(query)), "doc": ids.take(pa.array(doc)), "score": score})
    return out.filter(pc.fill_null(pc.not_equal(out["query"], out["doc"]), False))


def sparse_cosine(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, doc, score`` from two tables of positive weights (doc, term, weight), over their common terms; null ids have no pairs.

    Weights meet in cells of a block of queries and a slice of documents, some
    ``CELL`` rows each, so what crosses the network grows with the number of
    cells and not with the pairs of rows under a common term.
    """
    n, m = weights.count(), queries.count()
    blocks = max(1, -(-m // CELL))
    slices = max(1, -(-n // CELL), min(weights.sparkSession.sparkContext.defaultParallelism, n // 50_000))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda k: F.pmod(F.xxhash64("doc"), F.lit(k)).cast("int")
    d = weights.where("doc is not null").select("doc", "term", "weight", deal(slices).alias("slice"), every(blocks).alias("block"))
    q = queries.where("doc is not null").select(F.col("doc").alias("query"), F.col("term").alias("asked"), F.col("weight").alias("qw"), every(slices).alias("slice"), deal(blocks).alias("block"))
    kind = dict(weights.dtypes)["doc"]
    cell = ("block", "slice")
    return d.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(_cosines_of_cell, f"query {dict(queries.dtypes)['doc']}, doc {kind}, score double")


# --- linkage ---------------------------------------------------------------------


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def average_linkage(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of average linkage under cosine distance, nearest first; a new cluster is n, n+1, ... in order.

    The mean cosine of two clusters is the product of their sums of unit vectors
    over the product of their sizes, so a cluster is its sum and size and no matrix
    of distances is made. Chains of nearest neighbours find the merges: average
    linkage never brings clusters nearer by merging others, so two that are each
    other's nearest merge in any order of work.
    """
    n = len(vectors)
    sums, sizes, member = unit_rows(np.asarray(vectors, float)).copy(), np.ones(n), np.arange(n)
    alive, left = np.ones(n, bool), n
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while left > 1:
        if 2 * left < len(sums):
            # Dead rows go; the chain keeps its clusters.
            place = np.cumsum(alive) - 1
            chain = place[chain].tolist()
            sums, sizes, member, alive = sums[alive], sizes[alive], member[alive], np.ones(left, bool)
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        near = sums @ sums[a] / (sizes * sizes[a])
        near[~alive] = -np.inf
        near[a] = -np.inf
        b = int(near.argmax())
        # Of equals the one before in the chain: so a chain always comes nearer and ends.
        if len(chain) > 1 and near[chain[-2]] >= near[b] - 1e-12:
            b = chain[-2]
            del chain[-2:]
            found.append((1 - float(near[b]), int(member[a]), int(member[b])))
            sums[a] += sums[b]
            sizes[a] += sizes[b]
            alive[b] = False
            sums[b] = 0
            left -= 1
        else:
            chain.append(b)
    top = list(range(2 * n - 1))

    def cluster(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    merges = []
    for k, (distance, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        a, b = sorted((cluster(a), cluster(b)))
        top[a] = top[b] = n + k
        merges.append((a, b, distance))
    return merges


def cut_tree(n: int, merges: Sequence[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Labels 0.. by first member when all merges below the threshold are done."""
    root = np.arange(n + len(merges))
    for k in range(len(merges) - 1, -1, -1):
        a, b, distance = merges[k]
        if distance < threshold:
            root[a] = root[b] = root[n + k]
    _, first, inverse = np.unique(root[:n], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def ladder_cut(n: int, merges: Sequence, ladder: Sequence[float] = LADDER, largest: float = LARGEST) -> tuple[np.ndarray, float]:
    """The loosest cut whose largest cluster keeps within its share, else the tightest; one tree, many cuts."""
    labels, t = np.zeros(n, int), ladder[-1]
    for t in sorted(ladder, reverse=True):
        labels = cut_tree(n, merges, t)
        if n and np.bincount(labels).max() / n <= largest:
            break
    return labels, t


def core_distances(units: np.ndarray, least: int) -> np.ndarray:
    """Each row's distance to its ``least``-th nearest, itself counted, some rows against all at a time."""
    n = len(units)
    core = np.empty(n)
    step = max(1, DISTANCES // n)
    for at in range(0, n, step):
        d = np.sqrt(np.clip(2 - 2 * units[at : at + step] @ units.T, 0, 4))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = 0
        core[at : at + step] = np.partition(d, least - 1, axis=1)[:, least - 1]
    return core


def spanning_tree(units: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (length, a, b) of the least spanning tree of mutual reachability, shortest first; a row of distances is made when its point joins."""
    n = len(units)
    ids, best, via = np.arange(1, n), np.full(n - 1, np.inf), np.zeros(n - 1, int)
    rest, far = units[1:], core[1:]
    gone = np.zeros(n - 1, bool)
    edges, at = [], 0
    for left in range(n - 1, 0, -1):
        if 2 * left < len(ids):
            stay = ~gone
            ids, best, via, rest, far, gone = ids[stay], best[stay], via[stay], rest[stay], far[stay], gone[stay]
        reach = np.maximum(np.sqrt(np.clip(2 - 2 * (rest @ units[at]), 0, 4)), np.maximum(core[at], far))
        closer = ~gone & (reach < best)
        best[closer], via[closer] = reach[closer], at
        k = int(np.where(gone, np.inf, best).argmin())
        at = int(ids[k])
        edges.append((float(best[k]), int(via[k]), at))
        gone[k] = True
    return sorted(edges)


def density_clusters(vectors: np.ndarray, least: int) -> np.ndarray:
    """Density clusters by excess of mass; noise is -1.

    The least spanning tree of mutual reachability is taken apart from its
    longest edge down. A part of at least ``least`` points is a cluster; where both
    parts are, it ends and two begin; smaller parts fall out of it. A cluster's
    stability is the sum over its points of the density (1 / length) at which each
    leaves, less that at which the cluster began; of a cluster and those that
    follow it the more stable stay. The whole is never a cluster.
    """
    n, least = len(vectors), max(2, least)
    if n < least:
        return np.full(n, -1)
    u = unit_rows(np.asarray(vectors, float))
    core = core_distances(u, least)
    # The tree of joins: node n + k joins two nodes at the k-th shortest edge.
    top = list(range(2 * n - 1))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    size = [1] * n + [0] * (n - 1)
    parts: list[tuple[int, int, float]] = []
    for k, (length, a, b) in enumerate(spanning_tree(u, core)):
        a, b = find(a), find(b)
        top[a] = top[b] = n + k
        size[n + k] = size[a] + size[b]
        parts.append((a, b, 1 / max(length, 1e-12)))
    # Clusters from the top: 0 is the whole; a point's own is the last that held it.
    parent, birth, stable, own = [-1], [0.0], [0.0], np.zeros(n, int)
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            own[node] = c
            continue
        a, b, density = parts[node - n]
        big = [x for x in (a, b) if size[x] >= least]
        if len(big) == 2:
            stable[c] += (density - birth[c]) * size[node]
            for x in big:
                parent.append(c)
                birth.append(density)
                stable.append(0.0)
                stack.append((x, len(parent) - 1))
            continue
        for x in (a, b):
            if x in big:
                stack.append((x, c))
                continue
            stable[c] += (density - birth[c]) * size[x]
            fallen = [x]
            while fallen:
                y = fallen.pop()
                if y < n:
                    own[y] = c
                else:
                    fallen += parts[y - n][:2]
    follow = [0.0] * len(parent)
    chosen = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = stable[c] >= follow[c]
        follow[parent[c]] += max(stable[c], follow[c])
    label = [-1] * len(parent)
    for c in range(1, len(parent)):
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else (c if chosen[c] else -1)
    found = np.array([label[c] for c in own])
    names, first = np.unique(found[found >= 0], return_index=True)
    rank = {int(x): k for k, x in enumerate(names[np.argsort(first)])}
    return np.array([rank.get(int(x), -1) for x in found])


def cluster_groups(df: DataFrame, key: str, vector: str, scope: str, threshold: float | Sequence[float] | None = None, algorithm: str = "agglomerative", min_size: int = 3) -> DataFrame:
    """Clusters within each scope: ``key, scope, cluster, threshold``; without a threshold the ladder picks one, of several each cuts the one tree.

    A scope is one mechanism of one run, as large as a person reviews: its vectors
    (not their distances) are one task's. Noise points become clusters of their own.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, {scope} {dict(df.dtypes)[scope]}, cluster int, threshold double"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        m = np.array(f[vector].tolist(), float)
        if algorithm == "density":
            labels = density_clusters(m, min_size)
            free = labels < 0
            labels[free] = labels.max(initial=-1) + 1 + np.arange(free.sum())
            cuts = [(labels, float("nan"))]
        else:
            merges = average_linkage(m)
            asked = [threshold] if isinstance(threshold, (int, float)) else threshold
            cuts = [ladder_cut(len(m), merges)] if asked is None else [(cut_tree(len(m), merges, t), t) for t in asked]
        return pd.concat([pd.DataFrame({key: f[key], scope: f[scope], "cluster": labels.astype("int32"), "threshold": float(t)}) for labels, t in cuts])

    return df.select(key, scope, vector).groupBy(scope).applyInPandas(run, schema)


# --- level-0 and level-1 groups ------------------------------------------------------


def level0(runs: DataFrame, run: str = "run_id", task: str = "task_id") -> DataFrame:
    """One row a mechanism (passing runs together): id by name, macro failure rate, count; worst first."""
    key = F.when(F.col("failure_type") == "pass", "pass").otherwise(F.col("mechanism"))
    d = runs.withColumn("name", key)
    t = d.groupBy("name", task).agg(F.avg((F.col("failure_type") != "pass").cast("double")).alias("rate"), F.count("*").alias("n"))
    g = t.groupBy("name").agg(F.avg("rate").alias("failure_rate"), F.sum("n").alias("count"), F.count("*").alias("tasks"))
    # Mechanisms are the names of a fixed list of rules.
    g = g.withColumn("id", F.format_string("l0_%03d", F.row_number().over(W.orderBy("name")) - 1))
    return g.orderBy(F.desc("failure_rate"), F.desc("count"), "id")


def level1(runs: DataFrame, task: str = "task_id") -> DataFrame:
    """Failing runs by mechanism and signature: count, tasks, dominant chain, worst first."""
    d = runs.where("failure_type <> 'pass'")
    g = d.groupBy("mechanism", "signature").agg(F.count("*").alias("count"), F.count_distinct(task).alias("tasks"))
    # Signatures are as many as they like: they are numbered by ranges.
    g = running_total(g, [F.desc("count"), F.asc("mechanism"), F.asc("signature")], F.lit(1), "place")
    g = g.withColumn("id", F.format_string("c_%03d", F.col("place") - 1)).drop("place")
    return g.orderBy(F.desc("count"), "id")


def cohesion(share: Column) -> Column:
    return F.round(share * 4 + 1, 1)


# --- scores ---------------------------------------------------------------------------


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: adjusted Rand index, homogeneity, completeness, V-measure, from the contingency table."""
    c = contingency(df, truth, pred)
    pairs = lambda x: x * (x - 1) / 2
    rows = c.groupBy("t").agg(F.sum("n").alias("m"))
    cols = c.groupBy("p").agg(F.sum("n").alias("m"))
    total = c.agg(F.sum("n").cast("double").alias("n"), F.sum(pairs(F.col("n"))).alias("cells"))
    entropy = lambda d, n: d.crossJoin(F.broadcast(total.select("n"))).agg(F.sum(pairs(F.col("m"))).alias(f"{n}_pairs"), (-F.sum(F.col("m") / F.col("n") * F.log(F.col("m") / F.col("n")))).alias(f"h_{n}"))
    joint = c.withColumnRenamed("n", "k").join(rows.withColumnRenamed("m", "a"), "t").join(cols.withColumnRenamed("m", "b"), "p").crossJoin(F.broadcast(total.select("n")))
    cond = joint.agg((-F.sum(F.col("k") / F.col("n") * F.log(F.col("k") / F.col("b")))).alias("h_tp"), (-F.sum(F.col("k") / F.col("n") * F.log(F.col("k") / F.col("a")))).alias("h_pt"))
    d = total.crossJoin(entropy(rows, "t")).crossJoin(entropy(cols, "p")).crossJoin(cond)
    expected = F.col("t_pairs") * F.col("p_pairs") / F.nullif(pairs(F.col("n")), F.lit(0.0))
    top = (F.col("t_pairs") + F.col("p_pairs")) / 2
    ari = F.when(F.coalesce(top == expected, F.lit(True)), 1.0).otherwise((F.col("cells") - expected) / (top - expected))
    hom = F.when(F.col("h_t") == 0, 1.0).otherwise(1 - F.col("h_tp") / F.col("h_t"))
    com = F.when(F.col("h_p") == 0, 1.0).otherwise(1 - F.col("h_pt") / F.col("h_p"))
    d = d.select(ari.alias("ari"), hom.alias("homogeneity"), com.alias("completeness"))
    return d.withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))))


def purity(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Each cluster's size, most frequent true label (ties: smallest) and its share."""
    c = contingency(df, truth, pred)
    w = W.partitionBy("p").orderBy(F.desc("n"), "t")
    d = c.withColumn("size", F.sum("n").over(W.partitionBy("p"))).withColumn("r", F.row_number().over(w)).where("r = 1")
    return d.select(F.col("p").alias("cluster"), F.col("t").alias("label"), "size", (F.col("n") / F.col("size")).alias("purity"))


def structure_of_sizes(sizes: DataFrame, *by: str) -> DataFrame:
    """Clusters, singletons, largest share, mean size out of a table with a cluster's size ``n`` a row."""
    return sizes.groupBy(*by).agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), (F.max("n") / F.sum("n")).alias("largest_share"), F.avg("n").alias("mean_size"))


def structure(df: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, singletons, largest share, mean size."""
    return structure_of_sizes(df.groupBy(cluster).agg(F.count("*").alias("n")))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    d = df.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("k", "x")).groupBy("cluster", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return d.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


def silhouette(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """``key, silhouette`` under cosine distance, without pairs of rows.

    The mean cosine of a row to a cluster is its product with the sum of the
    cluster's unit vectors, so each row meets clusters, not rows.
    """
    from tracemill.operators.retrieval import dot, doubles

    v = doubles(F.col(vector))
    unit = df.select(F.col(key).alias("key"), F.col(cluster).alias("own"), F.transform(v, lambda x: x / F.sqrt(dot(v, v))).alias("u"))
    parts = unit.select("own", F.posexplode("u").alias("k", "x")).groupBy("own", "k").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("own").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("s"))
    sums = cut(sums.join(unit.groupBy("own").agg(F.count("*").alias("n")), "own").withColumnRenamed("own", "c"))
    # Sums that fit a broadcast meet every row in an array of their own; of more, slices meet slices of rows.
    s_ = F.struct("c", "n", "s")
    slices = -(-sums.count() // MOST_CLUSTERS) or 1
    dealt = sums.withColumn("slice", F.pmod(F.xxhash64("c"), F.lit(slices)).cast("int"))
    per = dealt.groupBy("slice").agg(F.collect_list(s_).alias("all"))
    own = F.col("own")

    def against(row: Column) -> Column:
        """(size, within, nearest) of a row against a slice of clusters."""
        at = F.transform("all", lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"), dot(row, c["s"]).alias("p")))
        mine = F.get(F.filter(at, lambda c: c["c"] == own), F.lit(0))
        other = F.array_min(F.transform(F.filter(at, lambda c: c["c"] != own), lambda c: 1 - c["p"] / c["n"]))
        return F.struct(mine["n"].alias("n"), F.when(mine["n"] > 1, 1 - F.try_divide(mine["p"] - 1, mine["n"] - 1)).alias("a"), other.alias("b"))

    if slices == 1:
        d = unit.crossJoin(F.broadcast(per)).select("key", against(F.col("u")).alias("x")).select("key", "x.*")
    else:
        rows = unit.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        d = rows.join(per, "slice").select("key", against(F.col("u")).alias("x")).groupBy("key").agg(F.max("x.n").alias("n"), F.max("x.a").alias("a"), F.min("x.b").alias("b"))
    return d.select("key", F.when((F.col("n") == 1) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def diverse(df: DataFrame, n: int, group: str, task: str, chain: str, flags: str, order: str) -> DataFrame:
    """Up to n rows of each group that cover tasks, then chains, then flag sets, then anything.

    The first pass is relational in spirit, later passes depend on what was
    picked, so a group is folded; candidates are cut to n a task, chain and flag
    set first, which can't change the picks.
    """
    keep = None
    for c in (task, chain, flags):
        r = F.row_number().over(W.partitionBy(group, c).orderBy(order))
        keep = (r <= n) if keep is None else keep | (r <= n)
    d = df.withColumn("near", keep).where("near").drop("near")

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order).reset_index(drop=True)
        chosen: list[int] = []
        seen: dict[str, set] = {task: set(), chain: set(), flags: set()}

        def take(k: int) -> None:
            chosen.append(k)
            for c in seen:
                seen[c].add(f[c].iloc[k])

        for c in (task, chain, flags, None):
            for k in range(len(f)):
                if len(chosen) >= n:
                    break
                if k not in chosen and (c is None or f[c].iloc[k] not in seen[c]):
                    take(k)
        return f.iloc[chosen].assign(pick=range(1, len(chosen) + 1))

    return d.groupBy(group).applyInPandas(pick, T.StructType([*d.schema.fields, T.StructField("pick", T.LongType())]))


def best_setting(grid: DataFrame, score: str, *, singletons: float = 0.5, largest: float = 0.6) -> DataFrame:
    """The row of a sweep with the best score among those whose structure is sane, else the best of all."""
    sane = (F.col("singletons") / F.col("clusters") <= singletons) & (F.col("largest_share") <= largest)
    return grid.withColumn("sane", sane).orderBy(F.desc("sane"), F.desc_nulls_last(score)).limit(1)


def marginal(grid: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """For each switch the mean score with it less the mean score without."""
    rows = [grid.agg(F.lit(c).alias("switch"), (F.avg(F.when(F.col(c), F.col(score))) - F.avg(F.when(~F.col(c), F.col(score)))).alias("delta")) for c in by]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
