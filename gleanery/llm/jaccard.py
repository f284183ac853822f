"""Exact Jaccard join of word n-gram sets: cells, pivots, Voronoi regions and triangle windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import discard, map_rows, mix, sliced, split_words, staged, text_or_empty, windows_of

NGRAM = 3
PERCENT = 90  # documents link when their similarity is at least this
GROWTH = 1.5  # of the size classes
REGION_SETS = 1500  # sets that one task joins
REGION_SHINGLES = 3_000_000
PIVOTS = 16
DEPTH = 4
CELL_SETS = 4000  # sets of a cell that one task holds against each other
HOT_ROUNDS = 3
SALTS = 32
SKETCH_BITS = 7  # of the smallest sketch; there is a part for every SKETCH_SHINGLES shingles at least
SKETCH_SHINGLES = 4
SLICE = 1000  # texts worked on at once


# ---------------------------------------------------------------- shingle sets


def shingle_sets(texts, ngram: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a short text is one shingle, an empty one none."""
    hashes, counts = split_words(texts, lower=True)
    grams, owner = windows_of(hashes, counts, ngram)
    ends = np.cumsum(counts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(counts):
        if n >= ngram:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif n:
            out.append(windows_of(hashes[ends[i] - n : ends[i]], np.array([n]), int(n))[0])
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(s)) * np.uint64(0xD6E8FEB86659FD93)]))[0].astype(np.int64))


# ------------------------------------------------------------------------ cells


class Classes:
    """Size classes and the cells of a set.

    The empty set is the first pivot, the symmetric difference the metric: its
    distance to a set is the set's size.  Two sets of sizes a <= b that link
    have a >= t b and differ in at most (1 - t) / (1 + t) * (a + b) elements.  So
    the sizes form classes, and a set also joins the classes below its own that
    a partner can be in.  Within a class whose pairs differ in at most D
    elements, the universe is dealt by hash into D + 1 parts; a linked pair must
    agree on at least one part entirely.  That part's content is their cell.

    An empty part says nothing, so a class has some spare parts: if either of
    two linked sets has no more empty parts than spare ones, they also agree on
    a part that is not empty.  A set with more empty parts is dealt anew as well,
    by another hash, for its links to other such sets.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low: list[int] = [1]
        self.parts: list[int] = []
        self.spare: list[int] = []

    def most_apart(self, a: int) -> int:
        b = 100 * a // self.percent
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def extend(self, size: int) -> None:
        while self.low[-1] <= size:
            lo = self.low[-1]
            hi = max(lo + 1, int(lo * GROWTH))
            while self.most_apart(hi) == self.most_apart(lo) == 0:
                hi += 1
            self.low.append(hi)
            parts = self.most_apart(hi - 1) + 1
            self.spare.append(int(np.ceil(2 * parts * np.exp(-lo / parts))) + 1 if parts > 1 else 0)
            self.parts.append(parts + self.spare[-1])

    def of(self, size: int) -> list[int]:
        """The classes that a set of this size joins: those of all sizes from percent * size to size."""
        self.extend(size)
        least = -(-self.percent * size // 100)
        first = int(np.searchsorted(self.low, least, side="right")) - 1
        last = int(np.searchsorted(self.low, size, side="right")) - 1
        return [g for g in range(first, last + 1) if self.parts[g] > 1]  # with one part only equal sets agree

    def dealt(self, s: np.ndarray, parts: int, level: int) -> np.ndarray:
        return (mix(s + np.uint64((0xA0761D6478BD642F * (level + 1)) % (1 << 64))) % np.uint64(parts)).astype(np.int64)

    def cells(self, s: np.ndarray) -> np.ndarray:
        """Names of the contents of the parts, of all classes that the set joins."""
        out: list[np.ndarray] = []
        for g in self.of(len(s)) if len(s) else []:
            parts = self.parts[g]
            for level in range(DEPTH):
                part = self.dealt(s, parts, level)
                content = np.zeros(parts, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(content, part, mix(s ^ np.uint64(0xE7037ED1A0B428DB)))
                    place = np.arange(parts, dtype=np.uint64) + np.uint64((g * DEPTH + level) << 32)
                    names = mix(content + mix(place * np.uint64(0x8EBC6AF09C88C6E3)))
                some = np.bincount(part, minlength=parts) > 0
                last = level == DEPTH - 1
                out.append(names if last else names[some])
                if parts - some.sum() <= self.spare[g]:
                    break
        return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Distances to pivots: how many shingles lie in each part of the universe.

    The parts are disjoint, so the differences of two sketches add up to at most
    the symmetric difference of the sets (counts stop at 255, which only lessens
    them): the triangle inequality over all pivots at once.  Large sets are
    told by more parts; neighbouring parts together are a part of a smaller sketch.
    """
    bits = max(SKETCH_BITS, int(np.ceil(np.log2(max(1, len(s)) / SKETCH_SHINGLES))))
    part = (mix(s ^ np.uint64(0x589965CC75374CC3)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def read_sketches(values) -> np.ndarray:
    """Sketches as rows of one matrix, all with as many parts as the smallest has."""
    least = min(map(len, values))
    return np.array([np.frombuffer(v, dtype=np.uint8).reshape(least, -1).sum(1, dtype=np.int32) for v in values])


def keyed_sets(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, key, sketch, cells of each row of (doc_id, text).

    A task gives the cells and the sketch of a set once: copies of a text need none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(percent)
        seen: set[int] = set()  # keys of this task's rows
        for part in sliced(batches, SLICE):
            sets = shingle_sets(part["text"].tolist(), ngram)
            keys, cells, sketches = [set_key(s) for s in sets], [], []
            for key, s in zip(keys, sets):
                new = key not in seen
                cells.append(classes.cells(s) if new else np.empty(0, dtype=np.int64))
                sketches.append(sketch(s) if new else None)
                seen.add(key)
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n": [len(s) for s in sets], "key": keys, "sketch": sketches, "cells": cells})

    return map_rows(docs, run, "doc_id long, n long, key long, sketch binary, cells array<long>")


# -------------------------------------------------------------- sketches in cells


def most_apart(a, b, percent: int):
    """The symmetric difference that linked sets of these sizes have at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def may_link(n: np.ndarray, sketches: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` neither size nor sketch keeps from linking with ``x``."""
    fits = (n[others] * 100 >= percent * n[x]) & (n[x] * 100 >= percent * n[others])
    others = others[fits]
    apart = np.abs(sketches[others] - sketches[x]).sum(1, dtype=np.int64)
    return others[apart <= most_apart(n[others], n[x], percent)]


def cell_edges(keys: np.ndarray, n: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a forest that joins all sets of a cell which may link.

    Sets are taken one by one as pivots and held against all of other
    components, until all that are left are in one.
    """
    m = len(keys)
    label, todo, edges = np.arange(m), np.ones(m, dtype=bool), []
    for x in range(m):
        rest = label[todo]
        if (rest == rest[0]).all():
            break
        todo[x] = False
        hit = may_link(n, sketches, x, np.flatnonzero(label != label[x]), percent)
        for name in np.unique(label[hit]):
            edges.append((int(keys[x]), int(keys[hit[label[hit] == name][0]])))
            label[label == name] = label[x]
    return edges


def joined_cells(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of all cells of (cell, key, n, sketch); a task holds one cell at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in chain(batches, [None]):
            rows = pd.concat([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
            if rows is None or not len(rows):
                continue
            cells = rows["cell"].to_numpy()
            done = len(rows) if batch is None else int(np.flatnonzero(cells == cells[-1])[0])  # the last cell may go on
            held, rows = rows.iloc[done:], rows.iloc[:done]
            if not done:
                continue
            cells, keys, n, sketches = cells[:done], rows["key"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            edges = []
            for lo, hi in zip(starts, np.append(starts[1:], done)):
                edges += cell_edges(keys[lo:hi], n[lo:hi], read_sketches(sketches[lo:hi]), percent)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return members.select("cell", "key", "n", "sketch").repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def hot_cells(members: DataFrame, percent: int, cell_sets: int, most_pivots: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Edges of cells too large for a task, and what is left of them for ``joined_cells``.

    In rounds: a cell draws a few of its sets as pivots.  A set within reach of
    a pivot (it may link with it) is settled by an edge to it; a set that may link with one settled there is
    within twice the reach and gets an edge to the pivot too, so no two sets
    that may link part.  What is settled with no pivot goes on alone, to a task if it is small enough by
    then.  What is still too large after ``HOT_ROUNDS`` is tied together, for
    the exact join to part.
    """
    edges, small = [], []
    for level in range(HOT_ROUNDS):
        slot = F.pmod(F.xxhash64("key", F.lit(10 + level)), F.lit(most_pivots))
        drawn = members.groupBy("cell", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("key", F.lit(30 + level)), "key", "n", "sketch")).alias("p"))
        pivots = drawn.groupBy(F.col("cell").alias("of")).agg(F.collect_list(F.struct("p.key", "p.n", "p.sketch")).alias("pivots"))  # most_pivots a cell

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                links, settled = [], []
                for n, own, around in zip(batch["n"], batch["sketch"], batch["pivots"]):
                    pn = np.array([p["n"] for p in around], dtype=np.int64)
                    told = read_sketches([own, *(p["sketch"] for p in around)])
                    apart = np.abs(told[1:] - told[0]).sum(1, dtype=np.int64)
                    near = apart <= most_apart(n, pn, percent)
                    partner = 100 * n // percent + 1  # a set that links with this one is no larger
                    reach = most_apart(n, partner, percent) + most_apart(partner, pn, percent) + 2
                    links.append([p["key"] for p, ok in zip(around, apart <= reach) if ok])
                    settled.append(bool(near.any()))
                yield batch[["cell", "key", "n", "sketch"]].assign(links=links, settled=settled)

        shape = "cell long, key long, n long, sketch binary, links array<long>, settled boolean"
        done = staged(members.join(pivots, F.col("cell") == F.col("of")).select("cell", "key", "n", "sketch", "pivots").mapInPandas(settle, shape), "hot")
        edges.append(done.select(F.col("key").alias("a"), F.explode("links").alias("b")).filter("a != b"))
        rest = done.filter(~F.col("settled")).select("cell", "key", "n", "sketch")
        counts = rest.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("m"))
        rest = rest.join(counts, F.col("cell") == F.col("of"))
        small.append(rest.filter(F.col("m") <= cell_sets))
        members = rest.filter(F.col("m") > cell_sets).select("cell", "key", "n", "sketch")
        if members.isEmpty():
            return edges, small
    least = members.groupBy(F.col("cell").alias("of")).agg(F.min("key").alias("b"))
    edges.append(members.join(least, F.col("cell") == F.col("of")).select(F.col("key").alias("a"), "b").filter("a != b"))
    return edges, small


# ------------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of an edge table (a, b).

    Alternates large-star and small-star steps until nothing changes; each is an
    aggregation and a join on nodes, over a table no larger than the edges.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = staged(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        near = both(now)
        least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = staged(small.filter("a != b").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components are unfinished after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ------------------------------------------------------------------ local joins


def distance(overlap, a, b):
    return 1.0 - overlap / (a + b - overlap)


def links_at(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with this overlap link."""
    return 100 * overlap >= percent * (a + b - overlap)


def overlap_with(s: np.ndarray, other: np.ndarray) -> int:
    if len(s) > len(other):
        s, other = other, s
    if not len(s):
        return 0
    at = np.searchsorted(other, s)
    at[at == len(other)] = 0
    return int((other[at] == s).sum())


def join_region(keys: np.ndarray, sets: list[np.ndarray], home: np.ndarray, other: np.ndarray, percent: int = PERCENT, tied: bool = False) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the links between home and other sets.

    Sets are taken one by one, the most typical first, as pivots and compared
    exactly with all candidates of other components.  A candidate is left out
    only if its size, or the triangle inequality over the first pivot, excludes a
    link.  When all sets that are not yet pivots are in one component, no
    further comparison can change the components.  ``tied`` homes are one component from the start.
    """
    m = len(keys)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    common = np.bincount(codes)
    typical = np.add.reduceat(common[codes], starts) / sizes
    label = np.arange(m)
    if tied and home.any():
        label[home] = np.flatnonzero(home)[0]
    edges: list[tuple[int, int]] = []
    todo = np.ones(m, dtype=bool)
    first: np.ndarray | None = None
    mark = np.zeros(len(flat), dtype=np.int32)
    r = 1 - percent / 100
    order = list(np.argsort(-typical, kind="stable"))
    while True:
        rest = np.flatnonzero(todo)
        if not len(rest):
            break
        names, n = np.unique(label[rest], return_counts=True)
        if len(names) == 1:
            break
        biggest = names[np.argmax(n)]
        if first is None:
            x = order[0]
        else:
            x = next(i for i in order if todo[i] and label[i] != biggest)
        todo[x] = False
        can = (label != label[x]) & ((home[x] & other) | (other[x] & home))
        can &= (sizes * 100 >= percent * sizes[x]) & (sizes[x] * 100 >= percent * sizes)
        if first is not None:
            can &= np.abs(first - first[x]) <= r + 1e-9
        mark[codes[starts[x] : ends[x]]] = 1
        if first is None:
            overlap = np.add.reduceat(mark[codes], starts)
            first = distance(overlap, sizes, sizes[x])
            hit = np.flatnonzero(can & (100 * overlap >= percent * (sizes + sizes[x] - overlap)))
        else:
            near = np.flatnonzero(can)
            if len(near) * 4 > m:
                overlap = np.add.reduceat(mark[codes], starts)[near]
            else:
                overlap = np.array([int(mark[codes[starts[i] : ends[i]]].sum()) for i in near], dtype=np.int64)
            hit = near[100 * overlap >= percent * (sizes[near] + sizes[x] - overlap)]
        mark[codes[starts[x] : ends[x]]] = 0
        for name in np.unique(label[hit]):
            edges.append((int(keys[x]), int(keys[hit[label[hit] == name][0]])))
            label[label == name] = label[x]
        order = order if len(order) < 64 or todo[order[0]] else [i for i in order if todo[i]]
    return edges


def link_sets(sets: DataFrame, percent: int = PERCENT, region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES, most_pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) that connect all linked sets of each island.

    ``sets`` has island, key, n, shingles and need, how many tasks the island
    would fill.  Sets of different islands are further apart than the radius r.

    An island that fits one task is one region.  A larger one draws pivots.  A
    set within r of its nearest pivot is settled in that pivot's Voronoi
    region, tied to it by an edge, as to every other pivot within r.  By the
    triangle inequality a set linked with one settled there is within 2 r of the
    pivot: such sets are replicated to the region as guests, unless edges
    between pivots tie them to it anyhow, and meet its sets exactly.  Sets
    that no pivot settles can link with settled ones only as guests; among
    themselves they are an island of their own, joined recursively with fresh
    pivots.  Regions too large for a task are cut into blocks of settled sets and blocks
    of guests; so is what ``DEPTH`` rounds leave unsettled.
    """
    base = ["island", "region", "key", "n", "shingles"]
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    whole = lambda rows: rows.select("island", F.lit(-1).alias("region"), "key", "n", "shingles", zero.alias("x"), zero.alias("y"), yes.alias("home"), yes.alias("other"))
    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(F.greatest(m / region_sets, w / region_shingles))).cast("int")
    width = 2 * (1 - percent / 100) + 1e-9

    def gridded(rows: DataFrame) -> DataFrame:
        """(..., home, other) rows cut into blocks: every home meets every other of its region in one task."""
        of = lambda flag, v: F.sum(F.when(F.col(flag), v).otherwise(0))
        grid = rows.groupBy(F.col("island").alias("of"), F.col("region").alias("of_r")).agg(blocks(of("home", 1), of("home", F.col("n"))).alias("rows"), blocks(of("other", 1), of("other", F.col("n"))).alias("columns"))
        cut = rows.join(grid, (F.col("island") == F.col("of")) & (F.col("region") == F.col("of_r")))
        row, column = F.pmod(F.xxhash64("key", F.lit(3)), "rows").cast("int"), F.pmod(F.xxhash64("key", F.lit(4)), "columns").cast("int")
        as_home = cut.filter("home").select(*base, row.alias("x"), F.explode(F.sequence(zero, F.col("columns") - 1)).alias("y"), yes.alias("home"), no.alias("other"))
        as_other = cut.filter("other").select(*base, F.explode(F.sequence(zero, F.col("rows") - 1)).alias("x"), column.alias("y"), no.alias("home"), yes.alias("other"))
        return as_home.unionByName(as_other)

    def voronoi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, centres, tied = None, [], [], []
        for part in (x for batch in batches for x in sliced([batch], SLICE)):
            rows = []
            for island, salt, slot, key, n, shingles in zip(part["island"], part["salt"], part["slot"], part["key"], part["n"], part["shingles"]):
                own = np.asarray(shingles)
                if at != (island, salt):
                    at, keys, centres, tied = (island, salt), [], [], []
                if slot >= 0:  # the pivots come first
                    linked = [q for q, c in enumerate(centres) if links_at(overlap_with(own, c), n, len(c), percent)]
                    group = {len(centres)}.union(*(tied[q] for q in linked))
                    keys.append(int(key))
                    centres.append(own)
                    tied.append(group)
                    for q in group:
                        tied[q] = group
                    continue
                overlap = np.array([overlap_with(own, c) for c in centres], dtype=np.int64)
                sizes = np.array([len(c) for c in centres], dtype=np.int64)
                near, d = links_at(overlap, n, sizes, percent), distance(overlap, n, sizes)
                guest = ~near & (d <= width)
                settled = int(np.argmin(np.where(near, d, 2.0))) if near.any() else -1
                if settled >= 0:
                    guest[sorted(tied[settled])] = False  # a chain of linked pivots ties it to these regions
                rows.append((island, key, n, own, settled, [k for k, ok in zip(keys, near) if ok and k != key], np.flatnonzero(guest).tolist()))
            yield pd.DataFrame(rows, columns=["island", "key", "n", "shingles", "settled", "links", "guests"])

    shape = "island long, key long, n long, shingles array<long>, settled int, links array<long>, guests array<int>"
    tasks, edges = [whole(sets.filter("need <= 1"))], []
    large = staged(sets.filter("need > 1"), "islands")
    for level in range(DEPTH):
        if large.isEmpty():
            break
        slot = F.pmod(F.xxhash64("key", F.lit(level)), F.least("need", F.lit(most_pivots)))
        drawn = large.groupBy("island", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("key", F.lit(20 + level)), "key", "n", "shingles")).alias("p"))
        parts = large.select(F.col("island").alias("of"), "need").distinct()
        first = drawn.join(parts, F.col("island") == F.col("of")).select("island", F.explode(F.sequence(zero, F.col("need") - 1)).alias("salt"), "slot", "p.key", "p.n", "p.shingles")
        rows = large.select("island", F.pmod(F.xxhash64("key", F.lit(5)), "need").cast("int").alias("salt"), F.lit(-1).cast("long").alias("slot"), "key", "n", "shingles")
        spread = first.unionByName(rows).repartition("island", "salt").sortWithinPartitions("island", "salt", F.col("slot") < 0, "slot")
        dealt = staged(spread.mapInPandas(voronoi, shape), "regions")
        edges.append(dealt.select(F.col("key").alias("a"), F.explode("links").alias("b")))
        guests = dealt.select("island", F.explode("guests").alias("region"), "key", "n", "shingles", no.alias("home"), yes.alias("other"))
        visited = guests.select(F.col("island").alias("of"), F.col("region").alias("of_r")).distinct()
        homes = dealt.filter("settled >= 0").select("island", F.col("settled").alias("region"), "key", "n", "shingles", yes.alias("home"), no.alias("other"))
        homes = homes.join(visited, (F.col("island") == F.col("of")) & (F.col("region") == F.col("of_r")), "left_semi")
        tasks.append(gridded(homes.unionByName(guests)).withColumn("region", F.col("region") + level * most_pivots))
        rest = dealt.filter("settled < 0")
        size = rest.groupBy(F.col("island").alias("of")).agg(blocks(F.count("*"), F.sum("n")).alias("need"))
        salt = F.pmod(F.xxhash64("key", F.lit(6)), F.lit(SALTS))  # an island may hold most rows
        size = size.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rest = rest.join(size, (F.col("island") == F.col("of")) & (salt == F.col("of_salt"))).select("island", "key", "n", "shingles", "need")
        tasks.append(whole(rest.filter("need <= 1")).withColumn("region", F.lit(-2 - level)))
        large = staged(rest.filter("need > 1"), "islands")
    else:
        tasks.append(gridded(large.select("island", F.lit(-2 - DEPTH).alias("region"), "key", "n", "shingles", yes.alias("home"), yes.alias("other"))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        flags = rows.groupby("key")[["home", "other"]].any()
        held = dict(zip(rows["key"], rows["shingles"]))
        keys = flags.index.to_numpy()
        tied = int(rows["region"].iloc[0]) >= 0
        linked = join_region(keys, [np.asarray(held[k]) for k in keys], flags["home"].to_numpy(), flags["other"].to_numpy(), percent, tied) if len(keys) > 1 else []
        return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    every = reduce(DataFrame.unionByName, tasks)
    return reduce(DataFrame.unionByName, edges, every.groupBy("island", "region", "x", "y").applyInPandas(run, "a long, b long"))


def candidate_islands(celled: DataFrame, sets: DataFrame, percent: int = PERCENT, cell_sets: int = CELL_SETS, most_pivots: int = PIVOTS) -> DataFrame:
    """of, island: components of the sets that share a cell and may link, as a written table.

    ``sets`` has key, n and sketch.  Cells with the same sets are joined once.
    """
    by_cell = Window.partitionBy("cell")
    every = celled.select("key", F.explode("cells").alias("cell")).withColumns({"least": F.min("key").over(by_cell), "most": F.max("key").over(by_cell)})
    members = staged(every.filter("least != most").select("cell", "key").distinct(), "members")
    named = members.groupBy("cell").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("held1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("held2"))
    kept = staged(named.groupBy("m", "held1", "held2").agg(F.min("cell").alias("of")).select("of", "m"), "kept")
    about = sets.select(F.col("key").alias("key_of"), "n", "sketch")
    rows = members.join(kept, F.col("cell") == F.col("of")).join(about, F.col("key") == F.col("key_of")).select("cell", "key", "n", "sketch", "m")
    edges, small = [], []
    if not kept.filter(F.col("m") > cell_sets).isEmpty():
        edges, small = hot_cells(staged(rows.filter(F.col("m") > cell_sets), "hot"), percent, cell_sets, most_pivots)
    edges.append(joined_cells(rows.filter(F.col("m") <= cell_sets), percent))
    edges += [joined_cells(x, percent) for x in small]
    candidates = components(reduce(DataFrame.unionByName, edges))
    return staged(candidates.select(F.col("node").alias("of"), F.col("component").alias("island")), "candidates")


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when the Jaccard similarity of their shingle sets is at
    least ``percent`` / 100; component_id is the smallest doc_id reachable by
    links.  Equal sets are one set, represented once.  Sets that share a cell
    (see ``Classes``) are candidates; the components of candidates are islands,
    and islands are joined exactly by ``link_sets``.

    A null text is empty: no shingles, its own component.  Null ids get a null
    component_id unless a linked document has an id; equal ids with other texts
    are documents of their own.  Sets are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    celled = staged(keyed_sets(rows, ngram, percent), "cells")
    keyed = staged(celled.select("doc_id", "n", "key"), "sets")
    unique = staged(celled.groupBy("key").agg(F.min("doc_id").alias("one"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "unique")
    regions = {k: v for k, v in limits.items() if k != "cell_sets"}
    islands = candidate_islands(celled, unique, percent, limits.get("cell_sets", CELL_SETS), limits.get("most_pivots", PIVOTS))
    discard(celled)  # its members are written; nothing goes back to the cells

    chosen = staged(unique.join(islands, F.col("key") == F.col("of")).select("key", "one", "island", "n"), "chosen")
    size = F.greatest(F.count("*") / limits.get("region_sets", REGION_SETS), F.sum("n") / limits.get("region_shingles", REGION_SHINGLES))
    need = chosen.groupBy(F.col("island").alias("of")).agg(F.ceil(size).cast("int").alias("need"))
    named = chosen.join(need, F.col("island") == F.col("of")).select("key", "one", "island", "need")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, SLICE):
            sets = shingle_sets(part["text"].tolist(), ngram)
            same = np.array([set_key(s) for s in sets], dtype=np.int64) == part["key"].to_numpy()  # equal ids may have other texts
            yield pd.DataFrame({"island": part["island"].array, "need": part["need"].array, "key": part["key"].array, "n": [len(s) for s in sets], "shingles": [s.astype(np.int64) for s in sets]})[same]

    # the chosen rows grow with the corpus, so they are never broadcast: texts are shuffled once, at every size
    texts = staged(rows.join(named.hint("merge"), rows["doc_id"].eqNullSafe(named["one"])).select("island", "need", "key", "text"), "texts")
    sets = texts.mapInPandas(shingles, "island long, need int, key long, n long, shingles array<long>")
    linked = components(link_sets(sets, percent, **regions)).withColumnsRenamed({"node": "of", "component": "head"})
    named = keyed.select("doc_id", "n", "key").join(linked, F.col("key") == F.col("of"), "left").select("doc_id", "n", F.coalesce("head", "key").alias("head"))
    named = staged(named, "named")
    least = named.filter("n > 0").groupBy(F.col("head").alias("of")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, (F.col("head") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
