"""Strongly connected components, and what a start reaches, of graphs of any depth.

Vertices are numbered. A graph is made smaller by contraction, in rounds that take all that they can at once: vertices that
nothing goes into or out of are taken off, and of a path of vertices with one edge in and one out only a shortcut stays. A
path of any length is found by doubling: each vertex points twice as far along it in each round. So trees and paths go in
rounds as their logarithm. What is left is coloured: the greatest vertex spreads, from all greatest ones at once, and those
that a colour's own vertex is reached from are its component. Contraction is then undone, a join a step.

Before all that, pieces of a sparse graph that hang together by few edges are told apart in a few rounds, dealt to tasks and
coloured there; only what is larger or wider goes the long way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.checkpoints import Seen, forget, keep

#: Rounds of a plain search before the graph is contracted.
PATIENCE = 6
#: Rounds in which small pieces are looked for, the edges that one may have to be coloured within a task, and the edges a
#: vertex above which a graph is taken to hang together as a whole.
PIECE_ROUNDS, PIECE_EDGES, PIECE_DEGREE = 8, 100_000, 4
#: Rows that a task looks through at once.
BLOCK = 2_000_000


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (key, id), edges (a, b) of ids, distinct) of edges (src, dst) of any kind of key."""
    vertices = keep(edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().select("key", F.monotonically_increasing_id().alias("id")))
    ends = edges.join(vertices.select(F.col("key").alias("src"), F.col("id").alias("a")), "src").join(vertices.select(F.col("key").alias("dst"), F.col("id").alias("b")), "dst")
    return vertices, keep(ends.select("a", "b").distinct())


def _degrees(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, before, after): before and after are one neighbour each, the only one where the number is 1."""
    each = F.inline(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("before"), F.col("b").alias("after")), F.struct(F.col("b").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("a").alias("before"), F.lit(None).cast("long").alias("after"))))
    return edges.select(each).groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("before").alias("before"), F.max("after").alias("after"))


@dataclass
class Paths:
    """members (id, last) of paths by their last vertex; ends (last, start, stop, n) are the vertices around a path, and its
    length; rings (id, ring) are paths without an end, by their least vertex."""

    members: DataFrame
    ends: DataFrame
    rings: DataFrame


def paths(degrees: DataFrame) -> Paths | None:
    """Paths of vertices with one edge in and one out (without a loop), or None without any."""
    inner = keep(degrees.where("n_in = 1 and n_out = 1 and before <> id").select("id", "before", "after"))
    n = inner.count()
    if not n:
        forget(inner)
        return None
    ids = inner.select(F.col("id").alias("after"), F.lit(True).alias("inside"))
    # to: as far along the path as known; it is the last one unless open. low: the least vertex on the way.
    jump = keep(inner.join(ids, "after", "left").select("id", F.when(F.col("inside"), F.col("after")).otherwise(F.col("id")).alias("to"), F.coalesce("inside", F.lit(False)).alias("open"), F.least("id", F.when(F.col("inside"), F.col("after"))).alias("low")))
    steps = 1
    while steps < n and not jump.where("open").isEmpty():
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("open").alias("more"), F.col("low").alias("lower"))
        ahead = jump.where("open").join(far, "to").select("id", F.col("further").alias("to"), F.col("more").alias("open"), F.least("low", "lower").alias("low"))
        old, jump = jump, keep(jump.where("not open").unionByName(ahead))
        forget(old)
        steps *= 2
    # Doubled beyond the number of vertices, only those on rings are open.
    members = keep(jump.where("not open").select("id", F.col("to").alias("last")))
    rings = keep(jump.where("open").select("id", F.col("low").alias("ring")))
    forget(jump)
    first = inner.join(ids.select(F.col("after").alias("before")), "before", "left_anti").select("id", F.col("before").alias("start")).join(members, "id").select("last", "start")
    stop = inner.join(members.select("last").distinct(), inner["id"] == F.col("last"), "left_semi").select(F.col("id").alias("last"), F.col("after").alias("stop"))
    ends = keep(first.join(stop, "last").join(members.groupBy("last").agg(F.count("*").alias("n")), "last"))
    forget(inner)
    return Paths(members, ends, rings)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges with no end in gone (id)."""
    return edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of links (a, b): each vertex and the least one that it hangs together with among BLOCK links, where that is another."""

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while len(a):
            # Of two roots the greater hangs on the less; then all point to their roots, and links within a root go.
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (far := root[root]).tobytes() != root.tobytes():
                root = far
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        on = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) >= BLOCK:
            yield told(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
    if held:
        yield told(*(np.concatenate(c) for c in zip(*held, strict=True)))


def pieces_of(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, piece) of vertices of links (a, b), (piece) of those that may not be whole).

    Each task first tells what hangs together among its own links, so that little more than a link a vertex goes through the rounds.
    """
    links = keep(links.mapInArrow(_rooted, "a long, b long").distinct())
    pieces = _pieces(links, float("inf"))
    ends = links.join(pieces.select(F.col("id").alias("a"), F.col("piece").alias("pa")), "a").join(pieces.select(F.col("id").alias("b"), F.col("piece").alias("pb")), "b")
    torn = keep(ends.where("pa <> pb").select(F.explode(F.array("pa", "pb")).alias("piece")).distinct())
    forget(links)
    return pieces, torn


def _pieces(edges: DataFrame, degree: float = PIECE_DEGREE) -> DataFrame | None:
    """(id, piece): the least vertex found near each vertex of edges, or None where the graph is too dense for small pieces.

    A vertex takes the least name among its neighbours', and then the name that this one has, so names come from twice as far
    in each round.
    """
    both = keep(edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near"))))))
    state = keep(both.groupBy("id").agg(F.least("id", F.min("near")).alias("piece")))
    if both.count() > 2 * degree * state.count():
        forget(both, state)
        return None
    # Names only get less, so equal sums are equal names.
    total = lambda: state.agg(F.sum(F.col("piece").cast("decimal(38,0)"))).first()[0]
    last = total()
    for _ in range(PIECE_ROUNDS):
        far = state.join(state.select(F.col("id").alias("piece"), F.col("piece").alias("further")), "piece").select("id", F.col("further").alias("piece"))
        far = keep(far)
        offered = both.join(far.select(F.col("id").alias("near"), "piece"), "near").select("id", "piece")
        merged = keep(offered.unionByName(far).groupBy("id").agg(F.min("piece").alias("piece")))
        forget(state, far)
        state, before = merged, last
        if (last := total()) == before:
            break
    forget(both)
    return state


def coloured(a: np.ndarray, b: np.ndarray, n: int, sweeps: int | None = None) -> np.ndarray:
    """The component of each of n vertices, by one of its vertices; edges go from a to b. After so many sweeps over the edges
    those not yet found are left as components of one."""
    own, part, done = np.arange(n), np.arange(n), 0
    while len(a):
        colour = own.copy()
        while True:
            new = colour.copy()
            np.maximum.at(new, b, colour[a])
            if (new == colour).all():
                break
            colour, done = new, done + 1
            if sweeps is not None and done > sweeps:
                return part
        same = colour[a] == colour[b]
        a, b, back = a[same], b[same], colour == own
        while (more := back[b] & ~back[a]).any():
            back[a[more]], done = True, done + 1
            if sweeps is not None and done > sweeps:
                return part
        part[back & (part == own)] = colour[back & (part == own)]
        left = ~(back[a] | back[b])
        a, b, done = a[left], b[left], done + 1
    return part


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of edges (piece, a, b) in the order of pieces; the last piece of a batch waits for the next one."""

    def told(piece: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        part = coloured(at[: len(a)], at[len(a) :], len(ids))
        on = np.bincount(part, minlength=len(ids))[part] > 1
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[part[on]])], names=["id", "component"])

    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        done = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        held = [r[done:] for r in rows]
        if done:
            yield told(*(r[:done] for r in rows))
    if len(held[0]):
        yield told(*held)


def whole_pieces(edges: DataFrame, most: int, degree: float) -> tuple[DataFrame, DataFrame, list[DataFrame]] | None:
    """(edges (piece, a, b) of pieces found whole and of `most` edges at most, edges (a, b) of all others, tables that the first
    reads), or None where the graph has more than `degree` edges a vertex."""
    pieces = _pieces(edges, degree)
    if pieces is None:
        return None
    named = edges.join(pieces.select(F.col("id").alias("a"), F.col("piece").alias("pa")), "a").join(pieces.select(F.col("id").alias("b"), F.col("piece").alias("pb")), "b")
    named = keep(named.select("a", "b", "pa", "pb"))
    # A piece is whole if no edge leaves it.
    torn = named.where("pa <> pb").select(F.explode(F.array("pa", "pb")).alias("pa"))
    large = named.groupBy("pa").count().where(f"count > {most}").select("pa")
    out = keep(torn.unionByName(large).distinct())
    rest = keep(named.join(out, "pa", "left_semi").select("a", "b"))
    forget(pieces)
    return named.join(out, "pa", "left_anti").select(F.col("pa").alias("piece"), "a", "b"), rest, [named, out]


def _small_pieces(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """((id, component) within small pieces, edges of all others), or None without such pieces."""
    split = whole_pieces(edges, PIECE_EDGES, PIECE_DEGREE)
    if split is None:
        return None
    small, rest, read = split
    found = keep(small.repartition("piece").sortWithinPartitions("piece").mapInArrow(_solved, "id long, component long"))
    forget(*read)
    return found, rest


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of edges (a, b) that lie on cycles of two or more; a component is one of its ids."""
    edges = keep(edges.where("a <> b").select("a", "b").distinct())
    n, found, undo = edges.count(), [], []
    if n and (split := _small_pieces(edges)) is not None:
        found.append(split[0])
        forget(edges)
        edges = split[1]
        n = edges.count()
    while n:
        # Contract while that takes a tenth of the edges, at least.
        while n:
            degrees = keep(_degrees(edges))
            off = degrees.where("n_in = 0 or n_out = 0").select("id")
            run = paths(degrees)
            old, less = edges, _without(edges, off)
            if run is not None:
                found.append(run.rings.withColumnRenamed("ring", "component"))
                undo.append(run)
                less = _without(less, run.members.select("id").unionByName(run.rings.select("id")))
                # A path whose start is gone leads nowhere, and its shortcut goes in the next round.
                less = less.unionByName(run.ends.where("start <> stop").select(F.col("start").alias("a"), F.col("stop").alias("b"))).distinct()
            before, edges = n, keep(less)
            n = edges.count()
            forget(old, degrees)
            if n > before * 0.9:
                break
        if not n:
            break
        colour = _spread(edges)
        same = edges.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        back = keep(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        part = keep(reached(back, colour.where("id = colour").select("id")).join(colour, "id").select("id", F.col("colour").alias("component")))
        found.append(part)
        old, edges = edges, keep(_without(edges, part))
        n = edges.count()
        forget(old, colour, back)
    forget(edges)
    spark = edges.sparkSession
    out = spark.createDataFrame([], "id long, component long")
    for f in found:
        out = out.unionByName(f)
    out = keep(out)
    for run in reversed(undo):
        # A path from a vertex to one of the same component, or to itself, belongs to it.
        at = run.ends.join(out.select(F.col("id").alias("start"), F.col("component").alias("x")), "start", "left").join(out.select(F.col("id").alias("stop"), F.col("component").alias("y")), "stop", "left")
        x, y = F.coalesce("x", "start"), F.coalesce("y", "stop")
        on = at.where(x == y).select("last", x.alias("component"), F.when(F.col("x").isNull(), F.col("start")).alias("alone"))
        more = run.members.join(on, "last").select("id", "component").unionByName(on.where("alone is not null").select(F.col("alone").alias("id"), "component")).distinct()
        old, out = out, keep(out.unionByName(more))
        forget(old, run.members, run.ends)
    sizes = out.groupBy("component").count().where("count > 1").select("component")
    return keep(out.join(sizes, "component", "left_semi").select("id", "component"))


def _spread(edges: DataFrame) -> DataFrame:
    """(id, colour): the greatest vertex that reaches each vertex of edges, itself included. Only changes travel."""
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = keep(ids.select("id", F.col("id").alias("colour")))
    moved = state
    while True:
        offered = edges.join(moved.select(F.col("id").alias("a"), "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("offer"))
        ahead = keep(offered.join(state, "id").where("offer > colour").select("id", F.col("offer").alias("colour")))
        if moved is not state:
            forget(moved)
        if ahead.isEmpty():
            forget(ahead)
            return state
        merged = keep(state.join(ahead.withColumnRenamed("colour", "new"), "id", "left").select("id", F.coalesce("new", "colour").alias("colour")))
        forget(state)
        state, moved = merged, ahead


def _search(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id) reached along edges, in as many rounds as it is far."""
    frontier = keep(start.select("id").distinct())
    seen = Seen(frontier)
    while True:
        found = edges.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = keep(found.join(seen.all(), "id", "left_anti"))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)


def reached(edges: DataFrame, start: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """(id) that start (id) reaches along edges (a, b), itself included.

    A search of a few hops comes first. What it leaves is contracted: vertices that nothing leads to and that aren't on the
    frontier go, those that lead nowhere are put off, paths become shortcuts; then the search goes on in the smaller graph.
    """
    first = keep(start.select("id").distinct())
    seen, frontier = first, first
    for _ in range(patience):
        found = edges.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = keep(found.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    seen = keep(seen)
    # The frontier's own edges, and those between vertices not seen.
    rest = keep(edges.join(seen.select(F.col("id").alias("b")), "b", "left_anti").join(seen.join(frontier, "id", "left_anti").select(F.col("id").alias("a")), "a", "left_anti").where("a <> b").select("a", "b"))
    n, undo = rest.count(), []
    while n:
        degrees = keep(_degrees(rest).join(frontier.select("id", F.lit(True).alias("front")), "id", "left"))
        unled = degrees.where("n_in = 0 and front is null").select("id")
        leaf = degrees.where("n_out = 0 and front is null").select("id")
        run = paths(degrees.where("front is null"))
        put_off = keep(rest.join(leaf.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
        less = _without(rest, unled.unionByName(leaf))
        if run is not None:
            less = _without(less, run.members.select("id").unionByName(run.rings.select("id")))
            less = less.unionByName(run.ends.where("start <> stop").select(F.col("start").alias("a"), F.col("stop").alias("b"))).distinct()
        undo.append((run, put_off))
        before, old, rest = n, rest, keep(less)
        n = rest.count()
        forget(old, degrees)
        if n > before * 0.9:
            break
    out = seen if not n else keep(seen.unionByName(_search(rest, frontier)).distinct())
    for run, put_off in reversed(undo):
        more = put_off.join(out.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        if run is not None:
            on = run.ends.join(out.select(F.col("id").alias("start")), "start", "left_semi").select("last", "stop")
            more = more.unionByName(run.members.join(on, "last", "left_semi").select("id")).unionByName(on.select(F.col("stop").alias("id")))
            # A leaf behind a path hangs on the path's last vertex.
            more = more.unionByName(put_off.join(run.members.join(on, "last", "left_semi").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")))
        out = keep(out.unionByName(more).distinct())
    return out
