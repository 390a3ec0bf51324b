"""Embedding near-dedup on a robust-pruned graph over overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import park
from tabweave.llm.components import components

NO_ID = 2**63 - 1       # stands for a null vec_id, larger than any
SHARD = 700             # vectors of a cluster, about
BLOCK = 4096            # vectors that a task indexes at a time; larger shards go in blocks
OVERLAP = 3             # clusters that a vector belongs to
SAMPLE = 20_000         # vectors that the centres of a split are fitted on, at most
CHILDREN, LEVELS = 256, 4   # clusters of a split, and splits of splits, at most
ROOTS = 1 << 29         # number of the first shard; above any vector's length, so that the numbers
                        # of splits, multiples of it, do not meet, and that the last fits a long
DEGREE, POOL, RANDOM = 20, 40, 12   # neighbours kept; nearest and random candidates
ALPHA = 1.2             # how much shorter a detour must be to replace a neighbour
BEAM = 24               # candidates of the greedy search
QUERIES = 512           # queries that a step searches at once


# -- graphs, in one task -----------------------------------------------------------------

def fit_centres(units: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    centres = units[rng.choice(len(units), k, replace=False)]
    for _ in range(rounds):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        norm = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def robust_prune(units: np.ndarray, rows: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Of the candidates of some vectors, those that no kept, nearer one makes redundant.

    A candidate goes if a kept neighbour is ALPHA times nearer to it than the vector is.
    Rows of the result end with -1.
    """
    distance = _distance(np.einsum("nd,npd->np", units[rows], units[pool]))
    distance[pool == rows[:, None]] = np.inf
    order = np.argsort(distance, axis=1, kind="stable")
    pool, distance = np.take_along_axis(pool, order, 1), np.take_along_axis(distance, order, 1)
    left = np.isfinite(distance)
    kept = np.full((len(rows), DEGREE), -1, np.int64)
    for slot in range(DEGREE):
        live = np.flatnonzero(left.any(axis=1))
        if not len(live):
            break
        at = left[live].argmax(axis=1)
        chosen = pool[live, at]
        kept[live, slot] = chosen
        between = _distance(np.einsum("nd,npd->np", units[chosen], units[pool[live]]))
        left[live] &= (ALPHA * between > distance[live]) & (pool[live] != chosen[:, None])
    return kept


def build_graph(units: np.ndarray) -> np.ndarray:
    """Neighbours of each vector in one shard, forwards and backwards; rows end with -1.

    The candidates of a vector are its nearest ones in the shard and some random ones,
    which keep the graph in one piece.  A vector named by many keeps the nearest.
    """
    n = len(units)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    rng, near, kept = np.random.default_rng(6), min(POOL, n - 1), []
    for at in range(0, n, QUERIES):
        rows = np.arange(at, min(at + QUERIES, n))
        cosine = units[rows] @ units.T
        cosine[np.arange(len(rows)), rows] = -np.inf
        pool = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(0, n, (len(rows), RANDOM))], axis=1)
        kept.append(robust_prune(units, rows, pool))
    source, slot = np.nonzero(np.concatenate(kept) >= 0)
    target = np.concatenate(kept)[source, slot]
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    a, b = both // n, both % n
    cosine = np.einsum("ed,ed->e", units[a], units[b])
    order = np.lexsort((-cosine, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    inside = rank < 2 * DEGREE
    out = np.full((n, 2 * DEGREE), -1, np.int64)
    out[a[inside], rank[inside]] = b[inside]
    return out


def medoid(units: np.ndarray) -> int:
    return int((units @ units.sum(axis=0)).argmax())


def range_search(
    units: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, cosine: float
) -> np.ndarray:
    """(queries, vectors) booleans: those found at or above the cosine.

    A greedy search from the entry keeps the BEAM best; then every vector found in range
    is expanded, until no vector in range is left to expand.
    """
    n, m = len(queries), len(units)
    seen, found, done = (np.zeros((n, m), bool) for _ in range(3))
    every = np.arange(n)

    def visit(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The neighbours of (query, vector) pairs not seen yet, with their cosines."""
        near = graph[at]
        rows, near = np.repeat(rows, near.shape[1]), near.reshape(-1)
        fresh = (near >= 0) & ~seen[rows, near]
        key = np.unique(rows[fresh] * m + near[fresh])
        rows, near = key // m, key % m
        seen[rows, near] = True
        like = np.einsum("ed,ed->e", queries[rows], units[near])
        close = like >= cosine
        found[rows[close], near[close]] = True
        return rows, near, like

    beam = np.full((n, BEAM), -1, np.int64)
    score = np.full((n, BEAM), -np.inf)
    beam[:, 0], score[:, 0] = entry, queries @ units[entry]
    seen[:, entry] = True
    found[:, entry] = score[:, 0] >= cosine
    while True:
        waiting = (beam >= 0) & ~done[every[:, None], np.maximum(beam, 0)]
        live = np.flatnonzero(waiting.any(axis=1))
        if not len(live):
            break
        best = np.where(waiting[live], score[live], -np.inf).argsort(axis=1)[:, -2:]
        rows, slots = np.repeat(live, best.shape[1]), best.reshape(-1)
        fit = waiting[rows, slots]
        rows, at = rows[fit], beam[rows[fit], slots[fit]]
        done[rows, at] = True
        rows, near, like = visit(rows, at)
        if not len(rows):
            continue
        order = np.lexsort((-like, rows))
        rows, near, like = rows[order], near[order], like[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < BEAM
        more = np.full((n, BEAM), -1, np.int64)
        more_score = np.full((n, BEAM), -np.inf)
        more[rows[top], rank[top]], more_score[rows[top], rank[top]] = near[top], like[top]
        changed = np.unique(rows)
        ids = np.concatenate([beam[changed], more[changed]], axis=1)
        scores = np.concatenate([score[changed], more_score[changed]], axis=1)
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
        beam[changed] = np.take_along_axis(ids, keep, 1)
        score[changed] = np.take_along_axis(scores, keep, 1)
    while True:
        rows, at = np.nonzero(found & ~done)
        if not len(rows):
            return found
        rows, at = rows[:65_536], at[:65_536]
        done[rows, at] = True
        visit(rows, at)


# -- the index, on Spark -----------------------------------------------------------------

def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _one(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with a key of their vector, and one unit vector for each key with copies.

    The first table is (vec_id, h1, h2), with null keys for vectors that link with
    nothing: null, empty or zero, or with null or non-finite components.  The second is
    (node, h1, h2, first, copies, size, unit), where size is the number of components.
    Vectors are scaled by their largest component first, so that squares neither overflow
    nor vanish.
    """
    vector = vectors[vector_col].cast("array<double>")
    rows = vectors.select(F.coalesce(vectors[id_col].cast("long"), F.lit(NO_ID)).alias("vec_id"),
                          vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    good = finite & (largest > 0)
    keyed = park(rows.select(
        "vec_id", F.when(good, F.col("vector")).alias("vector"),
        F.when(good, F.xxhash64("vector")).alias("h1"),
        F.when(good, F.xxhash64(F.lit(1), "vector")).alias("h2")), "vectors")
    distinct = keyed.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"),
        F.any_value("vector").alias("vector"))
    scaled = F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    nodes = park(
        distinct.withColumn("vector", scaled).withColumn("norm", norm)
        .select("h1", "h2", "first", "copies", F.size("vector").alias("size"),
                F.transform("vector", lambda x: x / F.col("norm")).alias("unit"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    return keyed.drop("vector"), nodes


def overlapping_shards(nodes: DataFrame) -> DataFrame:
    """(node, unit, copies, shard): each vector in its OVERLAP nearest clusters.

    Vectors of each length start as a shard of their own, and lengths never meet.  Clusters of more than BLOCK vectors are split again, on centres fitted on a bounded
    sample of their own; what is still larger after LEVELS splits is searched in blocks.
    """
    start = F.col("size").cast("long") + ROOTS
    members = nodes.select("node", "unit", "copies", start.alias("shard"))
    settled = None
    for level in range(LEVELS):
        sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
        large = park(sizes.where(F.col("size") > BLOCK), "large")
        if large.isEmpty():
            break
        small = members.join(large, "shard", "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1_000_003)) / 1_000_003.0
        big = park(members.join(large, "shard").select(
            "node", "unit", "copies", "shard", "size", draw.alias("draw"),
            F.floor(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SAMPLE))).cast("int").alias("salt")), "big")

        def fit(table: pa.Table) -> pa.Table:
            units = _units(_one(table, "unit"))
            k = min(CHILDREN, -(-table["size"][0].as_py() // SHARD), len(units))
            centres = fit_centres(units, max(k, 1))
            return pa.table({"shard": pa.array([table["shard"][0].as_py()] * len(centres), pa.int64()),
                             "child": pa.array(range(len(centres)), pa.int64()),
                             "centre": pa.array(list(centres), pa.list_(pa.float64()))})

        centres = park(
            big.where(F.col("draw") < SAMPLE / F.col("size")).groupBy("shard").applyInArrow(
                fit, "shard long, child long, centre array<double>"), "centres")
        salts = park(big.groupBy("shard", "salt").count().select("shard", "salt"), "salts")

        def assign(members: pa.Table, centres: pa.Table) -> pa.Table:
            units, points = _units(_one(members, "unit")), _units(_one(centres, "centre"))
            width = min(OVERLAP, len(points))
            near = np.argpartition(-(units @ points.T), width - 1, axis=1)[:, :width] if width else \
                np.zeros((len(units), 0), np.int64)
            rows = np.repeat(np.arange(len(units)), width)
            child = _one(centres, "child").to_numpy()[near.reshape(-1)]
            shard = _one(members, "shard").to_numpy()[rows] * (CHILDREN + 1) + child + 1
            part = members.take(pa.array(rows))
            return pa.table({"node": part["node"], "unit": part["unit"], "copies": part["copies"],
                             "shard": pa.array(shard)})

        children = big.groupBy("shard", "salt").cogroup(
            centres.join(salts, "shard").groupBy("shard", "salt")
        ).applyInArrow(assign, "node long, unit array<double>, copies long, shard long")
        # A vector reaches a cluster of a later split once, though by several ways.
        members = park(children, "members")
    return park(members if settled is None else settled.unionByName(members), "shards")


def _with_blocks(members: DataFrame) -> DataFrame:
    """Members with their shards, dealt to (shard, home, guest) groups of bounded size.

    A group indexes the vectors of block ``home`` and searches for those of block
    ``guest``; shards within BLOCK have one group that does both.
    """
    sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
    places = members.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.join(sizes, "shard").join(places, "node").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    base = ["node", "unit", "copies", "shard", "shards"]
    home = dealt.select(*base, F.col("block").alias("home"), other.alias("guest"), F.lit(True).alias("indexed"))
    guest = dealt.where("blocks > 1").select(
        *base, other.alias("home"), F.col("block").alias("guest"), F.lit(False).alias("indexed")
    ).where("home != guest")
    return park(home.unionByName(guest), "dealt")


def _adjacency(dealt: DataFrame) -> DataFrame:
    """(node, near): neighbours from all shards that hold a vector, united."""

    def build(table: pa.Table) -> pa.Table:
        nodes, graph = _one(table, "node").to_numpy(), build_graph(_units(_one(table, "unit")))
        near = [nodes[g[g >= 0]] for g in graph]
        return pa.table({"node": nodes, "near": pa.array(near, pa.list_(pa.int64()))})

    graphs = dealt.where("indexed and home = guest").groupBy("shard", "home").applyInArrow(
        build, "node long, near array<long>")
    return graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


FOUND = "node long, n_links long, other long"


def _search(dealt: DataFrame, adjacency: DataFrame, cosine: float) -> DataFrame:
    """Links by vector and group: their number, copies included, and an edge of their components.

    A pair that shares several shards counts in the smallest of them only.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        indexed = _one(table, "indexed").to_numpy(zero_copy_only=False).astype(bool)
        units, nodes = _units(_one(table, "unit")), _one(table, "node").to_numpy()
        copies = _one(table, "copies").to_numpy()
        if not indexed.any():
            return pa.table({n: pa.array([], pa.int64()) for n in ("node", "n_links", "other")})
        shards = _one(table, "shards")
        width = max(shards.value_lengths().to_pylist())
        places = np.full((len(nodes), width), -1, np.int64)
        lengths = shards.value_lengths().to_numpy()
        places[np.arange(width) < lengths[:, None]] = shards.flatten().to_numpy()
        home = np.flatnonzero(indexed)
        sorter = np.argsort(nodes[home])
        lists = _one(table, "near").take(pa.array(home))
        size = lists.value_lengths().to_numpy()
        owner, target = np.repeat(np.arange(len(home)), size), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(nodes[home], target, sorter=sorter), len(home) - 1)
        inside = nodes[home][sorter[at]] == target
        owner, local = owner[inside], sorter[at[inside]]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        graph = np.full((len(home), max(int(rank.max(initial=0)) + 1, 1)), -1, np.int64)
        graph[owner, rank] = local
        own = units[home]
        entry = medoid(own)
        asks = home if indexed.all() else np.flatnonzero(~indexed)
        found = np.concatenate([
            range_search(own, graph, entry, units[asks[i:i + QUERIES]], cosine)
            for i in range(0, len(asks), QUERIES)])
        if indexed.all():
            found |= found.T
            found[np.arange(len(home)), np.arange(len(home))] = False
        count = np.zeros(len(asks), np.int64)
        source, target = np.nonzero(found)
        for i in range(0, len(source), 1 << 18):
            a, b = source[i:i + (1 << 18)], target[i:i + (1 << 18)]
            # Verified in double precision on unit vectors; links below the bound do not pass.
            true = np.einsum("ed,ed->e", units[asks[a]], own[b]) >= cosine
            found[a[~true], b[~true]] = False
            a, b = a[true], b[true]
            mine, theirs = places[asks[a]], places[home[b]]
            before = (mine >= 0) & (mine < shard)
            earlier = ((mine[:, :, None] == theirs[:, None, :]) & before[:, :, None]).any(axis=(1, 2))
            count += np.bincount(a[~earlier], copies[home[b[~earlier]]], len(asks)).astype(np.int64)
        # One edge for each vector, to the root of its component in this group.
        source, target = np.nonzero(found)
        root = _roots(len(nodes), asks[source], home[target])
        linked = (count > 0) | (root[asks] != asks)
        return pa.table({"node": nodes[asks[linked]], "n_links": count[linked],
                         "other": nodes[root[asks[linked]]]})

    joined = dealt.join(adjacency, "node", "left").select(
        "shard", "home", "guest", "indexed", "node", "unit", "copies", "shards",
        F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    return joined.groupBy("shard", "home", "guest").applyInArrow(run, FOUND)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place by links among them."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Links have a cosine at or above the bound, checked in double precision.  Copies of a
    vector are one node of the index and count one by one.  The index is approximate; its
    recall is ``audit``'s.  Vectors that are null, zero or not finite link with nothing,
    and vectors link with those of their length only.  A component's id is its smallest vec_id; a row without an
    id gets a null one if nothing there has an id, and is kept then.  A repeated row
    counts as another vector.  All rows come back.
    """
    keyed, nodes = distinct_vectors(vectors, id_col, vector_col)
    dealt = _with_blocks(overlapping_shards(nodes))
    found = park(_search(dealt, _adjacency(dealt), cosine), "links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    groups = park(components(found.where("node != other").select("node", "other")), "groups")
    rooted = nodes.select("node", "h1", "h2", "first", "copies").join(groups, "node", "left").withColumn(
        "root", F.coalesce("component", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = park(
        rooted.join(least, "root").join(links, "node", "left").select(
            "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "named")
    component = F.coalesce("least", "vec_id")
    return keyed.join(named, ["h1", "h2"], "left").select(
        F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def exact_links(vectors: DataFrame, id_col: str, vector_col: str, cosine: float, every: int) -> DataFrame:
    """(vec_id, exact): links of the rows whose id is divisible, against all rows, by brute force.

    The queries are a stated set; they meet the rows in blocks, and only counts leave a task.
    """
    keyed, nodes = distinct_vectors(vectors, id_col, vector_col)
    asked = park(keyed.where((F.col("vec_id") != NO_ID) & (F.pmod("vec_id", F.lit(every)) == 0)).join(
        nodes.select("h1", "h2", "node", "size", "unit"), ["h1", "h2"]).select("vec_id", "node", "size", "unit"), "asked")
    n = nodes.count()
    parts = max(1, -(-n // BLOCK)), max(1, -(-n // every // BLOCK))
    rows = nodes.select(F.pmod("node", F.lit(parts[0])).alias("part"), "size", "unit", "copies").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))))
    asks = asked.select("vec_id", "size", "unit", F.pmod("node", F.lit(parts[1])).cast("int").alias("block")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))))

    def count(asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        like = _units(_one(asks, "unit")) @ _units(_one(rows, "unit")).T >= cosine
        return pa.table({"vec_id": asks["vec_id"], "n": like @ _one(rows, "copies").to_numpy()})

    group = "size", "part", "block"
    met = asks.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(
        count, "vec_id long, n long")
    return met.groupBy("vec_id").agg((F.sum("n") - 1).alias("exact"))


def audit(
    vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    cosine: float = 0.9, every: int = 100,
) -> tuple[int, int, float]:
    """Links found and in truth, and their ratio, over the rows whose id is divisible by ``every``."""
    exact = exact_links(vectors, id_col, vector_col, cosine, every)
    row = found.join(exact, "vec_id").agg(F.sum("n_links"), F.sum("exact")).first()
    return row[0] or 0, row[1] or 0, (row[0] / row[1] if row[1] else 1.0)
