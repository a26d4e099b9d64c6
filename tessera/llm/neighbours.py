"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Vectors travel as single-precision bytes, each scaled by a power of two of its own, so that neither very large nor very
small components are lost; these copies choose candidates only.  Final scores are inner products of the original vectors in
double precision.

1. Equal vectors form a class; the graph holds one of each class (its smallest id), so copies cost nothing.
2. Start: ``trees`` partitions by random hyperplanes into cells of about ``leaf`` vectors give every node its first links.
   They are poor (a few hundred comparisons for each node, however many nodes there are); the descent does the work.
3. NN-descent: in a round the neighbours and reverse neighbours of every node meet in pools (those of hubs are dealt into
   several), and members propose each other where at least one of the two links is fresh, that is, was not there a round
   before; each node keeps its best ``k``.  Rounds go on until at most ``settled`` of all links are fresh.
4. Greedy search: a query keeps the ``width`` best nodes seen, at first its own node's neighbours.  In a hop it visits
   all of them that it has not visited yet and sees their neighbours; hops go on until no query has a node to visit.
   By default the width follows the root of the number of nodes (``width_for``), since a fixed one finds less the more there are.
5. The best ``rescored`` classes of a query are scored exactly, expanded to their members and ranked (ties: smaller id).

Proposals to a node that stands in very many pools are merged in parts first, so no group grows with the table.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most; of rows that repeat an id the first vector (by its components) counts; queries have fewer rows only where
there are fewer candidates; columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .repeats import _lists
from .texts import small_batches

#: Pools from which a node's proposals are merged in parts, each of about so many pools.
PARTED = 2000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, components) -> (id, scale and scaled components as bytes)."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
        power = np.minimum(np.frexp(np.abs(x).max(axis=1))[1], 1023)
        scale, small = np.ldexp(1.0, power), np.ldexp(x, -power[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() + r.tobytes() for s, r in zip(scale, small, strict=True)], pa.binary())], names=["id", "v"])


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(scaled components, scales) of packed vectors."""
    if not len(column):
        return np.zeros((0, 1), np.float32), np.zeros(0)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    rows = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    return np.ascontiguousarray(rows[:, 8:]).view(np.float32), np.ascontiguousarray(rows[:, :8]).view(np.float64)[:, 0]


def _cells(trees: int, planes: int, dim: int, seed: int):
    normals = np.random.default_rng(seed).normal(size=(trees, dim, max(planes, 1))).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = _matrix(b.column(1))
            for t in range(trees):
                code = ((x @ normals[t] > 0) @ (1 << np.arange(normals.shape[2]))) if planes and len(x) else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), b.column(0), b.column(1)], names=["tree", "cell", "id", "v"])

    return run


def _proposals(most: int):
    """Pools (members: id, part, fresh, floor, v) -> (id, part, the member's ``most`` best co-members of those it has not met,
    where they are better than ``floor``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, held = b.column(0).offsets.to_numpy(), b.column(0).values
            ids, part, fresh, floor = (held.field(c).to_numpy(zero_copy_only=False) for c in ("id", "part", "fresh", "floor"))
            x, scale = _matrix(held.field("v"))
            at, lists, sims, sizes = [], [], [], []
            for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                if z - a < 2:
                    continue
                own = ids[a:z]
                s = (x[a:z] @ x[a:z].T) * scale[a:z]
                s[(own[:, None] == own) | ~(fresh[a:z, None] | fresh[a:z]) | (s < floor[a:z, None])] = -np.inf
                n = min(most, z - a - 1)
                best = np.argpartition(-s, n - 1, 1)[:, :n]
                score = np.take_along_axis(s, best, 1)
                some = np.isfinite(score)
                at.append(np.arange(a, z))
                lists.append(own[best][some])
                sims.append(score[some])
                sizes.append(some.sum(axis=1))
            if at:
                at, size = np.concatenate(at), np.concatenate(sizes)
                new = _lists(np.ones(size.sum(), bool), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(part[at]), _lists(np.concatenate(lists), size), _lists(np.concatenate(sims), size), new], names=["id", "part", "ns", "ss", "fresh"])

    return run


def _ranked(row: np.ndarray, n: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """Of entries (row, node, similarity, more) each row's ``k`` best distinct nodes, best first.

    Of entries of one node the one with the least first column of ``more`` stands for all.
    """
    order = np.lexsort((*more[:1], n, row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (n[order][1:] != n[order][:-1])
    kept = order[first]
    kept = kept[np.lexsort((n[kept], -s[kept], row[kept]))]
    place = np.arange(len(kept)) - np.searchsorted(row[kept], row[kept])
    kept = kept[place < k]
    return [a[kept] for a in (row, n, s, *more)]


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entries) of a list column; a null list is empty."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _merged(k: int):
    """(id, all proposals) -> (id, best k distinct); a link that any proposal has as an old one is not fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n = _flat(b.column(1), np.int64)
            row, n, s, fresh = _ranked(row, n, _flat(b.column(2), np.float64)[1], k, _flat(b.column(3), bool)[1])
            size = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(n, size), _lists(s, size), _lists(fresh, size)], names=["id", "ns", "ss", "fresh"])

    return run


_GRAPH = "id bigint, ns array<bigint>, ss array<double>, fresh array<boolean>"
_FOUND = "id bigint, part int, ns array<bigint>, ss array<double>, fresh array<boolean>"


def _graph(proposals: DataFrame, k: int) -> DataFrame:
    """Best k of the proposals (id, part, ns, ss, fresh) of each node: by part, then all parts."""
    every = [F.flatten(F.collect_list(c)).alias(c) for c in ("ns", "ss", "fresh")]
    parts = proposals.groupBy("id", "part").agg(*every).drop("part").mapInArrow(_merged(k), _GRAPH)
    return parts.groupBy("id").agg(*every).mapInArrow(_merged(k), _GRAPH)


def start_graph(vectors: DataFrame, scratch: Scratch, rows: int, dim: int, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(id, ns, ss, fresh): the k best neighbours within each node's cells; ``vectors``: (id, v)."""
    planes = max(0, round(math.log2(max(rows, 1) / leaf)))
    placed = vectors.mapInArrow(_cells(trees, planes, dim, seed), "tree int, cell bigint, id bigint, v binary")
    sizes = scratch.write(placed.groupBy("tree", "cell").agg(F.count("*").alias("n")))
    deal = F.when(F.col("n") > 2 * leaf, F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / leaf))).otherwise(F.lit(0))
    member = F.struct("id", F.lit(0).alias("part"), F.lit(True).alias("fresh"), F.lit(float("-inf")).alias("floor"), "v")
    pools = placed.join(sizes, ["tree", "cell"]).withColumn("deal", deal).groupBy("tree", "cell", "deal").agg(F.collect_list(member).alias("pool")).select("pool")
    return scratch.write(_graph(pools.mapInArrow(_proposals(k), _FOUND), k))


def descended(graph: DataFrame, vectors: DataFrame, scratch: Scratch, k: int, proposed: int, settled: float) -> DataFrame:
    """``graph`` after NN-descent; rounds end when at most ``settled`` of the links are fresh."""
    while True:
        links = graph.select(F.col("id").alias("a"), F.explode(F.arrays_zip("ns", "fresh")).alias("x")).select("a", F.col("x.ns").alias("b"), F.col("x.fresh").alias("fresh"))
        edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh"))
        degree = edges.groupBy("a").agg(F.count("*").alias("n"), F.max("fresh").alias("any_fresh"))
        of_pool = degree.where("any_fresh").select("a", F.ceil(F.col("n") / (3 * k)).alias("deals"))
        floor = F.when(F.size("ss") >= k, F.array_min("ss")).otherwise(F.lit(float("-inf"))).alias("floor")
        member = vectors.join(degree.select(F.col("a").alias("id"), F.ceil(F.col("n") / PARTED).cast("int").alias("parts")), "id").join(graph.select("id", floor), "id", "left").na.fill(float("-inf"), ["floor"])
        dealt = edges.join(of_pool, "a").select(F.col("b").alias("id"), "a", "fresh", F.pmod(F.xxhash64("b", "a"), "deals").alias("deal"))
        own = F.struct("id", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), "fresh", "floor", "v")
        pools = dealt.join(member, "id").groupBy("a", "deal").agg(F.collect_list(own).alias("pool")).select("pool")
        old = graph.select("id", F.lit(0).alias("part"), "ns", "ss", F.transform("ns", lambda n: F.lit(False)).alias("fresh"))
        found = scratch.write(_graph(old.unionByName(pools.mapInArrow(_proposals(proposed), _FOUND)), k))
        moved = found.agg(F.sum(F.size(F.filter("fresh", lambda f: f))) / F.sum(F.size("ns"))).first()[0]
        scratch.drop(graph)
        graph = found
        if not moved or moved <= settled:
            return graph


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Visits (q, qv, floor, neighbours: n, v) -> (q, neighbours better than floor, their similarities)."""
    for b in batches:
        held = b.column(3)
        row = np.repeat(np.arange(b.num_rows), held.value_lengths().to_numpy())
        flat = held.flatten()
        x, scale = _matrix(flat.field("v"))
        asked, _ = _matrix(b.column(1))
        s = np.einsum("ij,ij->i", asked[row], x) * scale if len(x) else np.zeros(0)
        good = s >= b.column(2).to_numpy()[row]
        size = np.bincount(row[good], minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(flat.field("n").to_numpy()[good], size), _lists(s[good], size)], names=["q", "ns", "ss"])


def _advanced(width: int):
    """(q, qv, ns, ss, done, found nodes, found similarities) -> the ``width`` best; nodes held before have been visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (row, n), (_, s), (row2, n2), (_, s2) = (_flat(b.column(i), np.float64 if i in (3, 5) else np.int64) for i in (2, 3, 4, 5))
            other = n2 != b.column(0).to_numpy()[row2]
            row2, n2, s2 = row2[other], n2[other], s2[other]
            done = np.concatenate([np.ones(len(n), bool), np.zeros(len(n2), bool)])
            row, n, s, done = _ranked(np.concatenate([row, row2]), np.concatenate([n, n2]), np.concatenate([s, s2]), width, ~done)
            done = ~done
            size = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(n, size), _lists(s, size), _lists(done, size)], names=["q", "qv", "ns", "ss", "done"])

    return run


_STATE = "q bigint, qv binary, ns array<bigint>, ss array<double>, done array<boolean>"


def searched(graph: DataFrame, vectors: DataFrame, asked: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(q, ns, ss): the ``width`` best nodes that a greedy search finds for each node of ``asked`` (q, qv)."""
    links = graph.select("id", F.explode("ns").alias("n")).join(vectors.withColumnRenamed("id", "n"), "n")
    links = scratch.write(links.groupBy("id").agg(F.collect_list(F.struct("n", "v")).alias("near")))  # at most k for each node
    own = graph.drop("fresh").withColumnRenamed("id", "q").join(asked, "q")
    state = scratch.write(own.select("q", "qv", "ns", "ss", F.transform("ns", lambda n: F.lit(False)).alias("done")))
    while True:
        floor = F.when(F.size("ss") >= width, F.array_min("ss")).otherwise(F.lit(float("-inf")))
        todo = F.filter(F.arrays_zip("ns", "done"), lambda x: ~x["done"])
        front = state.select("q", "qv", floor.alias("floor"), F.explode(todo).alias("x")).select("q", "qv", "floor", F.col("x.ns").alias("id"))
        if front.isEmpty():
            return state.select("q", "ns", "ss")
        seen = front.join(links, "id").select("q", "qv", "floor", "near").mapInArrow(_visited, "q bigint, ns array<bigint>, ss array<double>")
        found = seen.where(F.size("ns") > 0).groupBy("q").agg(F.flatten(F.collect_list("ns")).alias("fn"), F.flatten(F.collect_list("ss")).alias("fs"))  # at most width x k for each query
        after = scratch.write(state.drop("done").join(found, "q", "left").select("q", "qv", "ns", "ss", "fn", "fs").mapInArrow(_advanced(width), _STATE))
        scratch.drop(state)
        state = after


def width_for(rows: int) -> int:
    """Best nodes that a query keeps: 200 up to 20,000 nodes, from there with the root of their number."""
    return max(200, math.ceil(200 * math.sqrt(rows / 20_000)))


def nearest(
    table: DataFrame, every: int = 20, top: int = 20, k: int = 32, trees: int = 4, leaf: int = 100, proposed: int = 8, settled: float = 0.02, width: int | None = None, rescored: int = 60, seed: int = 7, descend: bool = True, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by ``every``; without ``descend`` the start graph is searched."""
    small_batches(table.sparkSession)
    scratch = Scratch(table.sparkSession)
    x = F.transform(embedding, lambda c: c.cast("double"))
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), x.alias("x")).where("id is not null and size(x) > 0")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad & F.exists("x", lambda c: c != 0))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = lengths[0]["dim"]
    scratch.sized(lengths[0]["n"])
    rows = scratch.write(rows.where(F.size("x") == dim).withColumn("h", F.xxhash64("x")))
    first = rows.groupBy("h").agg(F.min("id").alias("rep"))
    members = scratch.write(rows.select("id", "h").join(first, "h").select("id", "rep"))
    vectors = scratch.write(rows.join(members.where("id = rep").select("id"), "id").select("id", "x").mapInArrow(_packed, "id bigint, v binary"))
    nodes = vectors.count()
    graph = start_graph(vectors, scratch, nodes, dim, k, trees, leaf, seed)
    if descend:
        graph = descended(graph, vectors, scratch, k, proposed, settled)

    queries = members.where(F.col("id") % every == 0)
    asked = queries.select(F.col("rep").alias("q")).distinct().join(vectors.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    seen = searched(graph, vectors, asked, scratch, width or width_for(nodes))
    best = seen.select("q", F.explode(F.slice("ns", 1, rescored)).alias("rep")).unionByName(seen.select("q", F.col("q").alias("rep")))
    alone = asked.join(seen.select("q"), "q", "left_anti").select("q", F.col("q").alias("rep"))  # a table of one class has no links
    best = best.unionByName(alone)
    # Members of a class have one vector, so a score is found once for each pair of classes; a class of any size gives its
    # first top + 1 members (limited before rows are shuffled).
    exact = rows.select("id", "x")
    dot = F.aggregate(F.zip_with("qx", "cx", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = best.join(exact.select(F.col("id").alias("rep"), F.col("x").alias("cx")), "rep").join(exact.select(F.col("id").alias("q"), F.col("x").alias("qx")), "q").select("q", "rep", dot.alias("score"))
    some = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= top + 1).select("rep", F.col("id").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.join(some, "rep").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    lists = ranked.groupBy(F.col("q").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))  # top + 1 for each class
    own = queries.join(lists, "rep").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, top).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
