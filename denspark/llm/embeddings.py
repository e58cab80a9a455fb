"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to the nearest of the clusters of a bounded sample, each to several, so
that shards overlap.  In each shard a graph is built: of a vector's nearest candidates an
edge is kept unless another kept neighbour is closer to it by a factor.  The adjacency
lists of a vector from all its shards are united.  A search goes greedily from the
medoids of the graph's components, and from the query's own row where the shard has it,
towards the query and, once it is within range, on to everything in range that is
connected.  Recall is audited against brute force on a bounded set of queries, and the
search widened if it falls short; if that doesn't do either, shards are compared whole, in
blocks.  What is found is verified in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructType

from denspark.operators.components import least_reachable
from denspark.storage import checkpointed, written

#: Vectors that the clusters are fitted on, and queries of the audit.
SAMPLE = 8192
AUDIT = 512
#: Vectors of a shard, on average; more clusters than LEAVES aren't fitted, larger shards are split.
SHARD = 2048
LEAVES = 1024
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
#: Recall below which the search is widened, so often, and at last shards are compared whole.
WANTED = 0.97
WIDER = 2
#: Recall below which there is no result at all.
REQUIRED = 0.9
SLACK = 1e-4


def _units(batches):
    """Unit vectors as bytes of doubles; null where a vector has no direction."""
    for batch in batches:
        column, units = batch.column("embedding"), []
        values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
        for valid, a, b in zip(column.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            x = values[a:b]
            most = np.abs(x).max() if b > a else 0.0
            if valid and np.isfinite(most) and most > 0:
                x = x / most  # no overflow in the square
                units.append((x / np.sqrt(x @ x)).tobytes())
            else:
                units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(units, pa.binary())], ["row", "unit"])


def _matrix(units: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
    rows = units.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1).astype(kind) if rows else np.zeros((0, 1), kind)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres.astype(np.float32)


def _dealt(centres: dict[int, np.ndarray], overlap: int):
    """The nearest clusters of each vector, the first of them flagged; vectors of other sizes never meet."""

    def apply(batches):
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("unit").to_pylist()])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                own = centres[size]
                near = np.argsort(-(_matrix(part.column("unit"), np.float32) @ own.T), axis=1, kind="stable")[:, :overlap]
                n = near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls").take(pa.array(np.repeat(np.arange(len(at)), n))), part.column("unit").take(pa.array(np.repeat(np.arange(len(at)), n))), pa.array(near.ravel().astype(np.int64) + (size << 32)), pa.array(np.tile(np.arange(n) == 0, len(at)))],
                    ["cls", "unit", "leaf", "first"],
                )

    return apply


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Out-neighbours of each row: nearest first, leaving out what a kept neighbour is alpha times closer to."""
    n, out = len(x), []
    lanes = max(1, min(256, (1 << 20) // candidates**2))
    for a in range(0, n, lanes):
        near = x[a : a + lanes] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        m = min(candidates, n - 1)
        if m < 1:
            return [np.zeros(0, np.int64)] * n
        top = np.argpartition(-near, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, axis=1)
        distance = np.maximum(2 - 2 * np.take_along_axis(near, top, axis=1), 0)
        among = x[top]  # lanes x m x dims
        between = np.maximum(2 - 2 * np.matmul(among, among.transpose(0, 2, 1)), 0)
        alive = np.ones(top.shape, bool)
        kept = np.zeros(top.shape, bool)
        for j in range(m):
            take = alive[:, j] & (kept.sum(axis=1) < degree)
            kept[:, j] = take
            alive &= ~(take[:, None] & (alpha * alpha * between[:, j] <= distance))
        out += [t[k] for t, k in zip(top, kept, strict=True)]
    return out


def _built(widen: int):
    def apply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("cls").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(table.column("unit"), np.float32)[order]
        edges = robust_prune(x, DEGREE << widen, CANDIDATES << widen)
        a = np.repeat(np.arange(len(ids)), [len(e) for e in edges])
        b = np.concatenate(edges) if edges else a
        pair = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))  # both ways, so that nothing is unreachable from its neighbours
        a, b = pair // max(len(ids), 1), pair % max(len(ids), 1)
        lead = np.searchsorted(a, np.arange(len(ids) + 1))
        return pa.table({"cls": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(lead.astype(np.int32)), pa.array(ids[b]))})

    return apply


def components(start: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Least row of each row's component; edges go both ways."""
    label = np.arange(len(start) - 1)
    owner = np.repeat(label, np.diff(start))
    while True:
        low = label.copy()
        np.minimum.at(low, owner, label[edges])
        np.minimum.at(low, label, low.copy())  # a component's old name takes on the new one
        low = low[low]
        if (low == label).all():
            return label
        label = low


def entry_points(x: np.ndarray, start: np.ndarray, edges: np.ndarray, each: int) -> np.ndarray:
    """Of each component the row nearest to its mean, and further ones up to ``each``."""
    label, out = components(start, edges), []
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        out.append(rows[np.argmax(x[rows] @ x[rows].mean(axis=0))])
        out += rows[np.linspace(0, len(rows) - 1, min(each, len(rows)) - 1).astype(np.int64)].tolist()
    return np.unique(out)


def range_search(x: np.ndarray, start: np.ndarray, edges: np.ndarray, queries: np.ndarray, near: float, beam: int, entry: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of rows at least ``near`` found for each query; edges of row i are ``edges[start[i]:start[i+1]]``.

    A search starts at the rows of ``entry`` and at the query's own row, ``home``, if that isn't -1.

    Each step opens, for all queries at once, the best ``beam`` rows that aren't open yet
    among those in range and among the best ``beam`` seen so far.
    """
    n, m = len(x), len(queries)
    seen = np.full((m, n), -3, np.float32)
    opened = np.zeros((m, n), bool)
    seen[:, entry] = queries @ x[entry].T
    here = np.flatnonzero(home >= 0)
    seen[here, home[here]] = np.einsum("ij,ij->i", queries[here], x[home[here]])
    active = np.arange(m)
    width = min(beam + len(entry) - 1, n)
    while len(active):
        own = seen[active]
        closed = np.where(opened[active], np.float32(-4), own)
        floor = np.partition(own, n - width, axis=1)[:, n - width]  # the worst of the best
        allowed = (closed > -2.5) & ((closed >= floor[:, None]) | (closed >= near))
        closed[~allowed] = -4
        step = min(4, n)
        pick = np.argpartition(-closed, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(closed, pick, axis=1) > -2.5
        active = active[good.any(axis=1)]
        pick, good = pick[good.any(axis=1)], good[good.any(axis=1)]
        if not len(active):
            break
        q = np.repeat(active, good.sum(axis=1))
        row = pick[good]
        opened[q, row] = True
        count = start[row + 1] - start[row]
        to = edges[np.repeat(start[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        q = np.repeat(q, count)
        key = np.unique(q * n + to)
        q, to = key // n, key % n
        new = seen[q, to] < -2.5
        q, to = q[new], to[new]
        for a in range(0, len(q), 1 << 16):
            cut = slice(a, a + (1 << 16))
            seen[q[cut], to[cut]] = np.einsum("ij,ij->i", queries[q[cut]], x[to[cut]])
    return np.nonzero(seen >= near)


def _searched(threshold: float, beam: int, each: int, whole: bool):
    def apply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, asked = table.column("cls").to_numpy(), table.column("asked").to_numpy()
        lists = table.column("near").combine_chunks() if isinstance(table.column("near"), pa.ChunkedArray) else table.column("near")
        exact = _matrix(table.column("unit"))
        member = np.flatnonzero(~asked)
        member = member[np.argsort(ids[member], kind="stable")]
        query = np.flatnonzero(asked)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(member) or not len(query):
            return none
        x, names = exact[member].astype(np.float32), ids[member]
        if whole:
            return found(ids, exact, query, member, lambda own: np.nonzero(exact[own].astype(np.float32) @ x.T >= threshold - SLACK))
        near = lists.take(pa.array(member))
        flat = near.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(member)), pc.list_value_length(near).to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        here = names[at] == flat  # the united list also names members of other shards
        owner, at = owner[here], at[here]
        start = np.searchsorted(owner, np.arange(len(member) + 1))
        entry = entry_points(x, start, at, each)
        place = np.minimum(np.searchsorted(names, ids[query]), len(names) - 1)
        home = np.full(len(ids), -1)
        home[query] = np.where(names[place] == ids[query], place, -1)
        return found(ids, exact, query, member, lambda own: range_search(x, start, at, exact[own].astype(np.float32), threshold - SLACK, beam, entry, home[own]))

    def found(ids, exact, query, member, search) -> pa.Table:
        pairs = []
        for a in range(0, len(query), 512):
            own = query[a : a + 512]
            i, j = search(own)
            q, m = own[i], member[j]
            sure = ids[q] != ids[m]
            q, m = q[sure], m[sure]
            cosine = np.einsum("ij,ij->i", exact[q], exact[m]) if len(q) else np.zeros(0)
            sure = cosine >= threshold
            pairs.append(np.stack([np.minimum(ids[q], ids[m])[sure], np.maximum(ids[q], ids[m])[sure]]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return apply


def _brute(queries: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """All rows against the audit's queries."""

    def apply(batches):
        for batch in batches:
            ids, units = batch.column("cls").to_numpy(), batch.column("unit").to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for size, (names, wanted) in queries.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), size)
                i, j = np.nonzero(x @ wanted.T >= threshold)
                other = ids[at[i]] != names[j]
                a, b = ids[at[i]][other], names[j][other]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return apply


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine is at least ``threshold``; each linked pair is verified in double precision.

    Returns ``row`` (the columns but for the vector), ``n_links``, ``component_id`` (least
    id that can be reached, the row's own included), ``kept`` (the row has that id) and
    ``recall``, the audit's result.

    * null or zero vectors, or with null or non-finite components, and null ids: linked with nothing;
    * vectors of different length are not compared;
    * equal vectors are one node of the graph and are linked with each other; repeated rows are vectors of their own;
    * an id with several different vectors: each is a node of its own, named by that id;
    * ties: a component takes the least id, an edge the earlier row; a very long vector is one row like any other;
    * other columns keep their names inside ``row``, so none can clash;
    * a recall under ``REQUIRED`` even with shards compared whole: an error instead of a result;
    * an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != vector_col])
    given = vectors.select(row.alias("row"), F.col(f"`{vector_col}`").alias("embedding"))
    sound = F.when(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), F.col("embedding").cast("array<double>"))
    units = given.select("row", sound.alias("embedding")).mapInArrow(_units, StructType().add("row", given.schema["row"].dataType).add("unit", BinaryType()))
    own_id = F.col(f"row.`{id_col}`").cast("long")
    units = written(units.withColumn("cls_key", F.when(own_id.isNotNull(), F.sha2("unit", 256))), "units")
    classes = units.where("cls_key is not null").groupBy("cls_key").agg(F.min(own_id).alias("least"), F.count("*").alias("times"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("cls", F.xxhash64("cls_key")), "classes")  # ids needn't be unique, so nodes aren't named by them
    nodes = classes.select("cls", "unit")
    size = F.octet_length("unit")
    counts = {int(r["size"]) // 8: int(r["n"]) for r in nodes.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return units.select("row", F.lit(0).cast("long").alias("n_links"), own_id.alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(8 * k), F.lit(min(1.0, SAMPLE / n)))])
    draw = F.shiftrightunsigned(F.xxhash64("cls", F.lit("sample")), 11).cast("double") / F.lit(float(1 << 53))
    sample = nodes.where(draw < chance[size]).collect()
    centres = {}
    for k, n in counts.items():
        own = np.frombuffer(b"".join(r["unit"] for r in sorted(sample, key=lambda r: r["cls"]) if len(r["unit"]) == 8 * k), np.float64).reshape(-1, k)
        leaves = max(1, min(LEAVES, 2 * n // SHARD, len(own) // 8))
        centres[k] = fit_centres(own, leaves) if len(own) else np.zeros((1, k), np.float32)

    queries = classes.where(F.pmod("least", F.lit(20)) == 0).select("cls", "unit")
    lot = F.shiftrightunsigned(F.xxhash64("cls", F.lit("audit")), 11).cast("double") / F.lit(float(1 << 53))
    asked = queries.where(lot < min(1.0, AUDIT / max(1, queries.count()))).collect()  # about AUDIT rows
    audit = {}
    for k in counts:
        rows = [r for r in asked if len(r["unit"]) == 8 * k]
        if rows:
            audit[k] = (np.array([r["cls"] for r in rows]), np.frombuffer(b"".join(r["unit"] for r in rows), np.float64).reshape(-1, k))
    truth = checkpointed(nodes.mapInArrow(_brute(audit, threshold), "a long, b long").distinct())

    for widen in range(WIDER + 2):
        links = checkpointed(_links(nodes, centres, threshold, min(widen, WIDER), widen > WIDER))
        true = truth.count()
        recall = truth.join(links, ["a", "b"], "left_semi").count() / true if true else 1.0
        if recall >= WANTED:
            break
    if recall < REQUIRED:
        raise RuntimeError(f"of the audit's links {recall:.3f} were found, {REQUIRED} are required")

    either = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    times = classes.select("cls", "times")
    around = either.join(times.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("times").alias("linked"))
    labels = least_reachable(links).withColumnRenamed("vertex", "cls")
    placed = checkpointed(labels.join(classes.select("cls", "least"), "cls"))
    names = placed.join(checkpointed(placed.groupBy("label").agg(F.min("least").alias("component_id"))), "label").select("cls", "component_id")
    named = classes.select("cls_key", "cls", "least", "times").join(around, "cls", "left").join(names, "cls", "left")
    named = checkpointed(named.select("cls_key", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    component = F.coalesce("component_id", own_id)
    return units.join(named, "cls_key", "left").select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == own_id, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"))


def _links(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float, widen: int, whole: bool) -> DataFrame:
    """Distinct verified pairs (a, b), a < b; without a graph if shards are compared ``whole``."""
    kind = StructType().add("cls", LongType()).add("unit", BinaryType()).add("leaf", LongType()).add("first", BooleanType())
    dealt = written(nodes.mapInArrow(_dealt(centres, 2 << widen), kind), "dealt")
    blocks = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("long").alias("blocks"), F.ceil(F.count_if("first") / (2 * SHARD)).cast("long").alias("lanes"))
    placed = dealt.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("lane", F.pmod(F.xxhash64("cls", F.lit(1)), F.greatest("lanes", F.lit(1))))
    if whole:
        listed = placed.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        built = placed.select("leaf", "block", "cls", "unit").groupBy("leaf", "block").applyInArrow(_built(widen), "cls long, near array<long>")
        listed = placed.join(written(built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph"), "cls")
    members = listed.select("leaf", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("lanes", F.lit(1)) - 1)).alias("lane"), "cls", "unit", "near", F.lit(False).alias("asked"))
    queries = placed.where("first").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "lane", "cls", "unit", F.lit(None).cast("array<long>").alias("near"), F.lit(True).alias("asked"))
    return members.unionByName(queries).groupBy("leaf", "block", "lane").applyInArrow(_searched(threshold, 24 << widen, 1 << widen, whole), "a long, b long").distinct()
