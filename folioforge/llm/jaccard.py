"""Exact Jaccard join of shingle sets in metric space.

Jaccard distance is a metric, but between most documents it is nearly 1, so
documents as first pivots would tell nothing apart. The first pivots are
therefore small sets: the universe of shingles is cut into more parts than two
linked documents can differ in, and the content of a part is a pivot. A
document lies in the region of each pivot that is exactly its content in a part
(distance to that pivot restricted to the part: 0); linked documents share at
least one region, since they would otherwise differ in every part. There are more
parts than that, so a document leaves out its most frequent regions, as many as
it can spare: a passage that many documents have does not bring them together.

Regions that share documents form a cell. A cell is cut recursively into the
Voronoi regions of sampled document pivots: a document within the core radius of
a pivot belongs to its nearest one, those beyond all cores form the far region,
and boundary documents are replicated by the triangle inequality into each region
whose pivot is at most twice the threshold further than their own and not beyond
core radius plus threshold. Every link then lies in some region (see
:func:`regions_of`), and the regions are joined in the same way, down to small
ones, in which each pivot meets what the triangle inequality leaves open. What
pivots do not cut (a dense ball) is joined by its rarest shingles and then in the
same way.

Cells too large for a task are cut by size first (the empty set is the pivot of
the metric that counts differing shingles), then into Voronoi regions over all
tasks, for up to ``rounds`` rounds. A cell that pivots do not cut (its documents
would go to many regions each, and again in each round) keeps its documents as
they are and is joined by its rarest shingles, or block by block where that moves
less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import PACKED, PACKED_ARROW, Membership, bits_for, by_bucket, packed
from .common import pick, shuffle_width, stored, worker_cache
from .components import connected
from .hashing import mix, word_hashes

U64 = np.uint64
#: A text in a region: how many of its most frequent regions it can do without, and flags (see NEXT and LARGE).
SIGNATURE = np.dtype([("s", "<u8"), ("u", "<u8"), ("slack", "<u4")])
REGION = np.dtype([("u", "<u8"), ("s", "<u8"), ("texts", "<u4"), ("slack", "<u4")])
#: Flags of ``slack``: the region is of the size class above the text's own; the text stands for many of its task.
NEXT, LARGE = np.uint32(1 << 31), np.uint32(1 << 30)
SPARE = np.uint32((1 << 30) - 1)
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
FLUSH = 1_000_000
#: Texts whose keys are made at once.
TEXTS = 256
#: Texts that a task remembers to pass over their copies; it forgets them all at that number, and copies travel.
SEEN = 200_000
#: Bits of bucket number at least: what a worker holds of a bucket is 1 / 2 ** BITS of all records at most.
BITS = 11
#: Pairs that a cell knows to be apart; it forgets them all at that number, and meets them again.
APART = 200_000
#: Shingles met with pivots at once.
MET = 1 << 16
#: Pivots cut a group if its regions together have at most GROWTH times what it has, and none more than SHRUNK of it.
GROWTH, SHRUNK = 1.5, 0.9


@dataclass(frozen=True)
class Rule:
    """Link when ``den`` * intersection >= ``num`` * union of the sets of ``size`` word shingles."""

    size: int = 3
    num: int = 90
    den: int = 100
    #: Ratio of a size class's ends; parts beyond the least that a class needs.
    growth: float = 1.5
    spare: float = 1.3
    #: Most shingles of one cell in a task; sampled pivots of a cell; rounds of Voronoi cutting over all tasks; radius
    #: of a pivot's core in thresholds.
    cell_shingles: int = 1_000_000
    pivots: int = 64
    rounds: int = 4
    core: float = 2.0
    #: Documents up to which a region is joined whole; above, pivots cut it.
    small: int = 2
    #: Whether the numbers of shingles of all texts are wanted.
    sized: bool = True
    #: Whether regions are ranked by their texts, and each text keeps its rarest.
    ranked: bool = True
    #: Texts of a region from which on a task sends one for all of them.
    many: int = 64

    @property
    def eps(self) -> float:
        return 1 - self.num / self.den

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        return shingles(text, self.size)

    def all_sets(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.sets(t) for t in texts]

    def weights(self, texts: list[str | None]) -> list[int]:
        """Numbers of shingles, or bounds of them."""
        return [len(x) for x in self.all_sets(texts)]

    #: What travels to a region.
    record: ClassVar[np.dtype] = SIGNATURE

    def records(self, texts: list[str | None], us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of shingles, and a record for each region that one of the texts (with keys ``us``) lies in."""
        starts, sizes, parts = classes(self), [], []
        for t, u in zip(texts, us.tolist()):
            s = self.sets(t)
            sizes.append(len(s))
            for key, slack in signatures(s, starts, self) if len(s) else ():
                r = np.zeros(len(key), SIGNATURE)
                r["s"], r["u"], r["slack"] = key, u, slack
                parts.append(r)
        return np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, SIGNATURE)

    def settle(self, records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of one task's records: candidate edges, and the records that regions still need.

        A region of more than ``many`` of the task's texts is kept by all of them, and one text is sent for them. What
        they keep so, they need not count among the regions that they do without.
        """
        r = np.concatenate(records)
        r = r[np.argsort(r["s"], kind="stable")]
        new = np.concatenate([[True], r["s"][1:] != r["s"][:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(r)]]))
        large = size[np.cumsum(new) - 1] > self.many
        heads, mine, rest = r[large & new], r[large], r[~large]
        if len(mine):
            heads["slack"] |= LARGE
            both = np.concatenate([mine, rest])
            owner = np.stack([both["u"], (both["slack"] & NEXT).astype(U64)], axis=1)
            _, at = np.unique(owner, axis=0, return_inverse=True)
            kept = np.bincount(at[: len(mine)].ravel(), minlength=int(at.max()) + 1)[at[len(mine) :].ravel()]
            slack = np.maximum(0, (rest["slack"] & SPARE).astype(np.int64) - kept).astype(np.uint32)
            rest["slack"] = (rest["slack"] & NEXT) | slack
        return np.stack([mine["u"], mine["s"]], axis=1), np.concatenate([heads, rest])

    def shared(self, records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of whole regions: the edges (text, region) of texts that stand for many, and what the other texts of
        regions of two or more need to know of them."""
        r = np.concatenate(records)
        r = r[np.lexsort((r["slack"] & SPARE, ~(r["slack"] & LARGE), r["u"], r["s"]))]
        r = r[np.concatenate([[True], (r["s"][1:] != r["s"][:-1]) | (r["u"][1:] != r["u"][:-1])])]
        first = np.flatnonzero(np.concatenate([[True], r["s"][1:] != r["s"][:-1]]))
        size = np.diff(np.concatenate([first, [len(r)]]))
        large = (r["slack"] & LARGE) > 0
        texts = np.repeat(size + np.add.reduceat(large.astype(np.int64), first) * self.many, size)
        r, large, texts = (x[texts > 1] for x in (r, large, texts))
        out = np.zeros(int((~large).sum()), REGION)
        out["u"], out["s"], out["slack"], out["texts"] = r["u"][~large], r["s"][~large], r["slack"][~large], np.minimum(texts[~large], 1 << 31)
        return np.stack([r["u"][large], r["s"][large]], axis=1), out

    def edges(self, records: list[np.ndarray]) -> np.ndarray:
        """Edges (text, region) of the regions that each text keeps.

        Linked texts differ in at most D regions of a class, so that each may keep its D + 1 rarest ones (in one
        order of all regions): the rarest of those that both lie in is among them. The regions that a text is alone
        in come first, and ``slack`` is the number of its others that it leaves out.
        """
        r = np.concatenate(records)
        r = r[np.lexsort((r["s"], r["texts"], r["slack"] & NEXT, r["u"]))]
        new = np.concatenate([[True], (r["u"][1:] != r["u"][:-1]) | ((r["slack"][1:] & NEXT) != (r["slack"][:-1] & NEXT))])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(r)]]))
        keep = np.repeat(size, size) - np.repeat(np.minimum.reduceat(r["slack"] & SPARE, first).astype(np.int64), size)
        r = r[np.arange(len(r)) - np.repeat(first, size) < keep]
        return np.stack([r["u"], r["s"]], axis=1)

    def cells(self, near: DataFrame) -> DataFrame:
        """(u, cell) from the candidate edges; regions are nodes too."""
        return connected(near).select(F.col("node").alias("u"), F.col("component").alias("cell"))

    def linked(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)

    def most_apart(self, a: int, b: int) -> int:
        """The largest symmetric difference of two linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words the whole sequence is one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U64)
    h = word_hashes(words)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def classes(rule: Rule) -> np.ndarray:
    """First sizes of the size classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * rule.growth)))
    return np.array(out)


def signatures(sets: np.ndarray, starts: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, np.ndarray]]:
    """(region keys, slack) of one set in its size class and, where a linked set may be in the next class, in that class
    too: a key for each part of the universe that it has shingles in. The slack is how many of them it can do without."""
    n = len(sets)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for c in (own, own + 1):
        low, high = int(starts[c]), int(starts[c + 1])  # sizes low .. high - 1
        if c > own and n * rule.den < low * rule.num:
            continue
        parts = int(rule.most_apart(high - 1, high - 1) * rule.spare) + (2 if high > 20 else 1)
        partner = min(high - 1, n * rule.den // rule.num)
        part = (mix(sets ^ U64(0x5851F42D4C957F2D)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        content = np.add.reduceat(mix(sets)[order], first)
        apart, spare = rule.most_apart(max(partner, n), n), None
        if len(found) <= apart:  # so few that all of them could differ: empty parts count too, and since linked sets with
            full = np.zeros(parts, U64)  # more filled parts do not name them, none is left out
            full[found] = content
            found, content, spare = np.arange(parts), full, 0
        key = mix(content ^ mix(found.astype(U64) + U64(c) * U64(1 << 32) + U64(1)))
        spare = max(0, len(key) - apart - 1) if spare is None else spare
        out.append((key, np.full(len(key), np.uint32(spare) | (NEXT if c > own else np.uint32(0)), np.uint32)))
    return out


def as_records(pairs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pairs).view(PAIR).ravel()


def candidate_edges(texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(a, b): texts joined to those they share a region with, and (u, n): each text's number of shingles (if ``sized``)."""
    bits = max(BITS, bits_for(shuffle_width(texts.sparkSession)))
    sizes, settled = -(1 << bits), -(2 << bits)  # first buckets of (u, n) rows and of edges that a task found itself
    asked = np.dtype([("u", "<u8"), ("n", "<u8")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, ask = rule.settle(held)
            yield packed(ask, ask["s"], bits)
            if len(pairs):
                yield packed(as_records(pairs), mix(pairs[:, 0]), bits, settled)

        for batch in batches:
            us = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            if len(seen) > SEEN:
                seen.clear()
            fresh = [i for i, u in enumerate(us.tolist()) if not (u in seen or seen.add(u))]
            for lo in range(0, len(fresh), TEXTS):
                part = fresh[lo : lo + TEXTS]
                own = us[part]
                counts, r = rule.records(batch.column(1).take(pa.array(part, pa.int64())).to_pylist(), own)
                if rule.sized:
                    rows = np.zeros(len(part), asked)
                    rows["u"], rows["n"] = own, counts
                    yield packed(rows, rows["u"], bits, sizes)
                held.append(r)
                n += len(r)
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    kind = "a long, b long, n long"

    def rows(u: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        return pa.RecordBatch.from_arrays([signed(u), pa.nulls(len(u), pa.int64()) if b is None else signed(b), pa.nulls(len(u), pa.int64()) if n is None else pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    def told(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        """What comes as it is: sizes, and edges that are settled."""
        if bucket >= sizes:
            r = np.unique(np.frombuffer(data, asked))
            yield rows(r["u"], None, r["n"])
        else:
            pairs = np.unique(np.frombuffer(data, U64).reshape(-1, 2), axis=0)
            yield rows(pairs[:, 0], pairs[:, 1], None)

    def block(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield from told(bucket, data)
            return
        pairs = rule.edges([np.frombuffer(data, REGION if rule.ranked else rule.record)])
        if len(pairs):
            yield rows(pairs[:, 0], pairs[:, 1], None)

    waiting: list[np.ndarray] = []  # of one task: functions come to each task anew

    def regions(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], schema=PACKED_ARROW)
            return
        pairs, found = rule.shared([np.frombuffer(data, rule.record)])
        if len(pairs):
            yield packed(as_records(pairs), mix(pairs[:, 0]), bits, settled)
        waiting.append(found)
        if sum(map(len, waiting)) > FLUSH:
            yield from finish()

    def finish() -> Iterator[pa.RecordBatch]:
        if sum(map(len, waiting)):
            found = np.concatenate(waiting)
            yield packed(found, mix(found["u"]), bits)
        waiting.clear()

    sent = texts.mapInArrow(send, PACKED)
    if rule.ranked:
        sent = by_bucket(sent, regions, PACKED, finish)
    found = stored(by_bucket(sent, block, kind), "regions")
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").select(F.col("a").alias("u"), "n")


def regions_of(dist: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(document, region) for distances to pivots (documents by pivots); the region after the last is the far one.

    Let t be the threshold and r the core radius. A document whose nearest pivot is within r has that as its own, else
    it is far. It goes to each region k with dist[k] <= nearest + 2t and dist[k] <= r + t, and to the far region if it
    is far. Linked x and y meet: if both are far, in the far region; else let x have own pivot i, then
    dist(y, i) <= dist(x, i) + t <= r + t, and dist(x, i) is at most x's distance to y's nearest pivot, which is at
    most y's plus t, so that dist(y, i) <= nearest(y) + 2t.
    """
    nearest, radius = dist.min(axis=1), rule.core * rule.eps
    near = (dist <= nearest[:, None] + 2 * rule.eps + 1e-9) & (dist <= radius + rule.eps + 1e-9)
    return np.nonzero(np.concatenate([near, (nearest > radius)[:, None]], axis=1))


class Pivots:
    """Sampled sets, thinned so that none lies in another's core, with an index from shingle to pivots."""

    def __init__(self, sets: list[np.ndarray], rule: Rule) -> None:
        self.rule, kept, self.place = rule, [], []
        for i, s in enumerate(sets):
            both = np.array([Cell.inside(s, p).sum() for p in kept])
            if len(s) and (not kept or (1 - both / (len(s) + np.array([len(p) for p in kept]) - both)).min() > rule.core * rule.eps):
                kept.append(s)
                self.place.append(i)
        self.size = np.array([len(p) for p in kept], np.int64)
        flat, owner = np.concatenate(kept), np.repeat(np.arange(len(kept)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.value, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)

    def distances(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        both = self.shared(flat, size)
        return 1 - both / (size[:, None] + self.size[None, :] - both)

    def shared(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Shingles that sets (on end in ``flat``, of ``size`` shingles each, none empty) share with each pivot."""
        stop = np.cumsum(size)
        cut = np.unique(np.searchsorted(stop, np.arange(MET, len(flat), MET), side="right"))  # sets that hold each MET-th shingle
        if not len(cut) or len(size) == 1:
            return self._shared(flat, size)
        at = np.unique(np.concatenate([[0], cut, [len(size)]]))
        edge = np.concatenate([[0], stop])[at]
        return np.concatenate([self._shared(flat[a:b], size[i:j]) for i, j, a, b in zip(at[:-1], at[1:], edge[:-1], edge[1:])])

    def _shared(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.value, flat), len(self.value) - 1)
        hit = np.flatnonzero(self.value[at] == flat)
        doc, at = np.repeat(np.arange(len(size)), size)[hit], at[hit]
        times = self.many[at]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pivot = self.owner[np.repeat(self.first[at], times) + step]
        return np.bincount(np.repeat(doc, times) * len(self.size) + pivot, minlength=len(size) * len(self.size)).reshape(len(size), len(self.size))


class Cell:
    """Links inside one cell: regions, pivots, triangle inequality, union-find."""

    #: Documents above which a pivot's distances to a region are kept, and the pivots whose distances are.
    WINDOW, PIVOTS = 48, 8

    def __init__(self, sets: list[np.ndarray], rule: Rule) -> None:
        self.sets, self.rule = sets, rule
        self.size = np.array([len(s) for s in sets], np.int64)
        self.root = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []
        self.cuts = 0
        self.apart: set[tuple[int, int]] = set()

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.root[of]
        while not np.array_equal(up := self.root[r], r):
            r = up
        self.root[of] = r
        return r

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``pivot`` with ``others``."""
        if len(others) == 1:
            return np.array([np.count_nonzero(self.inside(self.sets[others[0]], self.sets[pivot]))])
        flat = np.concatenate([self.sets[i] for i in others])
        cut = np.concatenate([[0], np.cumsum(self.size[others])[:-1]])
        return np.add.reduceat(self.inside(flat, self.sets[pivot]), cut)

    @staticmethod
    def inside(flat: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat).astype(np.int64)

    def regions(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """Groups of the documents ``of``, of which linked ones share at least one.

        Groups belong to shingles, rarest first: a linked document shares one of the first
        size - ceil(threshold * size) + 1 of another's.
        """
        flat = np.concatenate([self.sets[i] for i in of])
        size = self.size[of]
        owner = np.repeat(np.arange(len(of)), size)
        _, number, seen = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((number, seen[number], owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        lead = size + (-self.rule.num * size // self.rule.den) + 1
        number, owner = number[order], owner[order]
        kept = (place < lead[owner]) & (seen[number] > 1)
        number, owner = number[kept], owner[kept]
        order = np.argsort(number, kind="stable")
        owner = owner[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(number[order]) > 0])) if len(owner) else order
        stop = np.concatenate([first[1:], [len(owner)]])
        roots = self.roots(of)[owner]
        if len(owner):  # groups that are one component already need no more
            open_ = np.minimum.reduceat(roots, first) < np.maximum.reduceat(roots, first)
            yield from (of[owner[a:b]] for a, b in zip(first[open_].tolist(), stop[open_].tolist()))

    def links(self) -> list[tuple[int, int]]:
        """Links that join what the link graph joins: one comparison for two documents, else Voronoi regions of
        pivots, recursively."""
        if len(self.sets) == 2:
            both = self.inside(self.sets[0], self.sets[1]).sum()
            return [(0, 1)] if self.rule.linked(both, *self.size.tolist()) else []
        return self._links()

    def _links(self) -> list[tuple[int, int]]:
        """A spanning forest of the link graph: Voronoi regions of pivots, recursively."""
        todo = [np.arange(len(self.sets))]
        while todo:
            region = todo.pop()
            if len(np.unique(self.roots(region))) == 1:
                continue
            if len(region) <= self.rule.small:
                self.join(region)
                continue
            parts = self.voronoi(region)
            if sum(map(len, parts)) > GROWTH * len(region) or max(map(len, parts)) > SHRUNK * len(region):  # pivots cut nothing off
                for part in self.regions(region):
                    self.join(part)
            else:
                todo += [p for p in parts if len(p) > 1]
        return self.edges

    def voronoi(self, region: np.ndarray) -> list[np.ndarray]:
        """The regions of sampled pivots, and the far region."""
        self.cuts += 1
        sets = [self.sets[i] for i in region]
        step = max(1, len(sets) // min(self.rule.pivots, math.isqrt(len(sets))))
        sampled = np.arange(len(sets))[self.cuts % step :: step]
        pivots, size = Pivots([sets[i] for i in sampled], self.rule), self.size[region]
        both = pivots.shared(np.concatenate(sets), size)
        for k, i in enumerate(pivots.place):  # the distances are known: what is within the threshold is linked
            self.link(int(region[sampled[i]]), region[self.rule.linked(both[:, k], size, pivots.size[k])])
        doc, part = regions_of(1 - both / (size[:, None] + pivots.size[None, :] - both), self.rule)
        order = np.argsort(part, kind="stable")
        return np.split(region[doc[order]], np.flatnonzero(np.diff(part[order])) + 1)

    def link(self, p: int, others: np.ndarray) -> None:
        """``p`` is linked with the others: edges where that joins something."""
        for q in others.tolist():
            a, b = self.roots(np.array([p, q])).tolist()
            if a != b:
                self.root[b] = a
                self.edges.append((p, q))

    def join(self, region: np.ndarray) -> None:
        """All links of a region but those inside a component.

        Pivots are the documents outside the region's largest component, since each open pair has one of them;
        a pivot meets the others within the window of sizes and of the distances to earlier pivots.
        """
        if len(region) <= self.WINDOW:
            self.join_few(region)
            return
        rule, roots = self.rule, self.roots(region)
        heads, members = np.unique(roots, return_counts=True)
        if len(heads) == 1:
            return
        size, dist = self.size[region], np.zeros((0, len(region)))
        for at in np.flatnonzero(roots != heads[members.argmax()]).tolist():
            p, roots = int(region[at]), self.roots(region)
            open_ = (roots != roots[at]) & (size * rule.num <= size[at] * rule.den) & (size[at] * rule.num <= size * rule.den)
            if len(dist):
                open_ &= (np.abs(dist - dist[:, at : at + 1]) <= rule.eps + 1e-9).all(axis=0)
            others = [q for q in region[open_].tolist() if (min(p, q), max(p, q)) not in self.apart]
            if not others:
                continue
            full = len(others) > self.WINDOW and len(dist) < self.PIVOTS
            others = np.array(others)
            both = self.shared(p, region if full else others)
            if full:
                dist = np.vstack([dist, 1 - both / (size + size[at] - both)])
                both = both[np.isin(region, others)]
            linked = rule.linked(both, self.size[others], self.size[p])
            self.link(p, others[linked])
            if len(self.apart) > APART:
                self.apart.clear()
            self.apart.update((min(p, q), max(p, q)) for q in others[~linked].tolist())

    def join_few(self, region: np.ndarray) -> None:
        """The same of a small region, on plain numbers: a pivot meets at once what is open."""
        rule, at = self.rule, region.tolist()
        root = self.roots(region).tolist()
        size = self.size[region].tolist()
        most = max(root, key=root.count)
        for i in [i for i, r in enumerate(root) if r != most]:
            p, n, own = at[i], size[i], root[i]
            low, high = n * rule.num, n * rule.den
            open_ = [j for j, (r, m) in enumerate(zip(root, size)) if r != own and m * rule.num <= high and low <= m * rule.den and (min(p, at[j]), max(p, at[j])) not in self.apart]
            if not open_:
                continue
            if len(self.apart) > APART:
                self.apart.clear()
            for j, both in zip(open_, self.shared(p, [at[j] for j in open_]).tolist()):
                q = at[j]
                if not rule.linked(both, size[j], n):
                    self.apart.add((min(p, q), max(p, q)))
                elif root[j] != root[i]:
                    self.edges.append((p, q))
                    self.root[root[j]] = root[i]
                    gone = root[j]
                    root = [root[i] if r == gone else r for r in root]


def _cell_links(cells: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) links that span each cell's components; ``cells`` has cell, u, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                found = Cell(sets, rule).links()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells_, us = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            once = np.concatenate([[True], (cells_[1:] != cells_[:-1]) | (us[1:] != us[:-1])])  # a text comes from each task that read it
            batch = batch.take(pa.array(np.flatnonzero(once)))
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                for cell, u, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), rule.all_sets(part.column(2).to_pylist())):
                    if cell != now:
                        yield from close()
                        now, keys, sets = cell, [], []
                    if not keys or keys[-1] != u:
                        keys.append(u)
                        sets.append(found)
        yield from close()

    width = shuffle_width(cells.sparkSession)
    # by a hash of the key: Spark leaves out an exchange by the key itself after a join by it, and may then read that join's
    # shuffle by mapper, which parts a cell among tasks
    dealt = cells.select("cell", "u", "text").repartition(width, F.xxhash64("cell"))
    return dealt.sortWithinPartitions("cell", "u").mapInArrow(run, "a long, b long")


def _counted(cells: DataFrame, rule: Rule) -> DataFrame:
    """``cells`` with exact numbers of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                n = [len(x) for x in rule.all_sets(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), part.column(3)], names=["cell", "u", "n", "text"])

    return cells.select("cell", "u", "n", "text").mapInArrow(run, "cell long, u long, n long, text string")


def _size_bands(cells: DataFrame, rule: Rule) -> DataFrame:
    """Cut each cell by size, which is the distance to the empty set when differing shingles are counted: linked
    sets are of one band or of neighbouring ones, so a document also goes to the band above its own."""
    width = math.log(rule.den / rule.num)
    cells = _counted(cells, rule)
    low = F.floor(F.log(F.col("n").cast("double")) / width)
    high = F.floor((F.log(F.col("n").cast("double")) + width) / width + 1e-9)
    return cells.withColumn("band", F.explode(F.sequence(low, high))).select(F.xxhash64("cell", "band").alias("cell"), "u", "n", "text")


def _regions(cells: DataFrame, rule: Rule) -> DataFrame:
    """The regions of each cell's pivots: (cell, u, n, part), boundary documents in several; texts stay where they are.

    A cell is dealt to several tasks by salt; its pivots go to each of them, ahead of the documents.
    """
    order = Window.partitionBy("cell").orderBy(F.xxhash64("u", "cell"), "u")
    pivots = cells.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rule.pivots)
    salts = cells.groupBy("cell").agg(F.ceil(F.sum("n") * 2 / rule.cell_shingles).cast("int").alias("salts"))
    lead = pivots.join(salts, "cell").select("cell", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "r", "u", "n", "text")
    rows = cells.join(salts, "cell").select("cell", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.lit(1 << 30).alias("r"), "u", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pivots = None, [], None
        for batch in batches:
            keep: list[tuple[int, int]] = []
            for i, (cell, salt, r, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), batch.column(5))):
                if (cell, salt) != now:
                    now, held, pivots = (cell, salt), [], None
                s = rule.sets(text.as_py())
                if r <= rule.pivots:
                    held.append(s)
                    continue
                pivots = pivots or Pivots(held, rule)
                keep += [(i, j) for j in regions_of(pivots.distances(s, np.array([len(s)])), rule)[1].tolist()]
            if keep:  # a document may go to several regions
                taken = batch.select(["cell", "u", "n"]).take(pa.array([i for i, _ in keep], pa.int64()))
                region = np.array([j for _, j in keep], np.uint64)
                new = mix(taken.column(0).to_numpy(zero_copy_only=False).view(U64) * U64(31) + region + U64(7)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(new)], names=["cell", "u", "n", "part"])

    width = shuffle_width(cells.sparkSession)
    dealt = lead.union(rows).repartition(width, F.xxhash64("cell", "salt")).sortWithinPartitions("cell", "salt", "r")
    return dealt.mapInArrow(run, "cell long, u long, n long, part long")


def _voronoi(cells: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Cut each cell into the regions of its pivots: (cell, u, n, text) with new cells, and the cells that pivots do not cut,
    as they are. The regions are weighed before any text goes to them."""
    parts = stored(_regions(cells, rule), "parts")
    weighed = parts.groupBy("cell", "part").agg(F.sum("n").alias("w")).groupBy("cell").agg(F.sum("w").alias("all"), F.max("w").alias("most"))
    fine = weighed.join(cells.groupBy("cell").agg(F.sum("n").alias("own")), "cell").filter(f"all <= {GROWTH} * own AND most <= {SHRUNK} * own").select("cell")
    fine = stored(fine, "fine")
    return cells.join(parts.join(fine, "cell", "left_semi").drop("n"), ["cell", "u"]).select(F.col("part").alias("cell"), "u", "n", "text"), cells.join(fine, "cell", "left_anti")


def _by_shingle(cells: DataFrame, rule: Rule) -> DataFrame:
    """Cells that pivots do not cut: (cell, u, n, text) in which linked documents meet, as in :meth:`Cell.regions`.

    A document goes to a cell for each of its first size - ceil(threshold * size) + 1 shingles, rarest first, that another
    goes to as well. Where its blocks move less, a cell is cut into these instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                sets = rule.all_sets(part.column(2).to_pylist())
                size = np.array([len(x) for x in sets], np.int64)
                each = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), size) for i in (0, 1)]
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*each, np.repeat(size, size), flat)], names=["cell", "u", "n", "h"])

    each = stored(cells.select("cell", "u", "text").mapInArrow(run, "cell long, u long, n long, h long"), "shingles")
    seen = each.join(each.groupBy("cell", "h").agg(F.count("*").alias("c")).filter("c > 1"), ["cell", "h"])
    own = Window.partitionBy("cell", "u")
    place = F.row_number().over(own.orderBy("c", "h")) + F.col("n") - F.count("*").over(own)  # those that no other has come first
    lead = F.expr(f"n - (n * {rule.num} + {rule.den - 1}) div {rule.den} + 1")
    kept = stored(seen.withColumn("place", place).filter(F.col("place") <= lead).select("cell", "u", "n", "h"), "rarest")
    many = kept.groupBy("cell", "h").agg(F.count("*").alias("c"), F.sum("n").alias("w")).filter("c > 1")
    moved = lambda w: F.when(w > rule.cell_shingles, w * F.ceil(w * 2 / rule.cell_shingles)).otherwise(w)
    cost = many.groupBy("cell").agg(F.sum(moved(F.col("w"))).alias("cost"))
    whole = cells.groupBy("cell").agg(F.sum("n").alias("w")).join(cost, "cell", "left")
    whole = stored(whole.select("cell", (F.coalesce("cost", F.lit(0)) < moved(F.col("w"))).alias("rare")), "ways")
    groups = kept.join(many.select("cell", "h", "w"), ["cell", "h"]).join(whole.filter("rare"), "cell", "left_semi")
    groups = cells.join(groups.drop("n"), ["cell", "u"]).select(F.xxhash64("cell", "h").alias("cell"), "u", "n", "text", "w")
    small, large = groups.filter(F.col("w") <= rule.cell_shingles).drop("w"), groups.filter(F.col("w") > rule.cell_shingles).drop("w")
    return small.union(_blocks(large.union(cells.join(whole.filter("NOT rare"), "cell", "left_semi").select("cell", "u", "n", "text")), rule))


def _blocks(cells: DataFrame, rule: Rule) -> DataFrame:
    """Each pair of blocks of a cell becomes a cell."""
    total = cells.groupBy("cell").agg(F.ceil(F.sum("n") * 2 / rule.cell_shingles).cast("int").alias("k"))
    own = cells.join(total, "cell").withColumn("mine", F.pmod(F.xxhash64("u"), F.col("k")).cast("int"))
    with_other = own.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return with_other.select(F.xxhash64("cell", low, high).alias("cell"), "u", "n", "text")


def links(texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that span the components of the link graph of ``texts`` (u long, text), and (u, n)."""
    spark = texts.sparkSession
    near, sizes = candidate_edges(texts, rule)
    cells = stored(rule.cells(near), "cells")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts that may be in a cell, one of equal ones in a task, with their numbers of shingles."""
        held_filters = worker_cache("jaccard")
        if token not in held_filters:
            held_filters.clear()
            held_filters[token] = Membership(bits, shared.value)
        known, seen = held_filters[token], set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            may = known(mix(keys.view(U64)))
            if len(seen) > SEEN:
                seen.clear()
            take = [i for i in np.flatnonzero(may).tolist() if not (keys[i] in seen or seen.add(keys[i]))]
            for lo in range(0, len(take), TEXTS):
                part = batch.take(pa.array(take[lo : lo + TEXTS], pa.int64()))
                n = rule.weights(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), part.column(1)], names=["u", "n", "text"])

    bits = bits_for(shuffle_width(spark))
    shared = spark.sparkContext.broadcast(_member_filter(cells, bits))
    token = shared._jbroadcast.id()
    members = texts.mapInArrow(once, "u long, n long, text string").join(cells, "u")
    members = stored(members.select("cell", "u", "n", "text"), "members")  # a text comes once from each task that read it
    weights = members.groupBy("cell").agg(F.sum("n").alias("w"))
    found = _cell_links(members.join(weights.filter(F.col("w") <= rule.cell_shingles), "cell", "left_semi"), rule)
    large = members.join(weights.filter(F.col("w") > rule.cell_shingles), "cell", "left_semi").dropDuplicates(["cell", "u"])
    whole = []  # cells that pivots do not cut
    for cut_by in (_size_bands, *[_voronoi] * rule.rounds):
        if large.isEmpty():
            break
        cut = cut_by(large, rule)
        if isinstance(cut, tuple):
            whole.append(cut[1])
            cut = cut[0]
        cut = stored(cut, "cut")
        weights = cut.groupBy("cell").agg(F.sum("n").alias("w"))
        found = found.union(_cell_links(cut.join(weights.filter(F.col("w") <= rule.cell_shingles), "cell", "left_semi"), rule))
        large = cut.join(weights.filter(F.col("w") > rule.cell_shingles), "cell", "left_semi")
    else:
        whole.append(large)
    if whole:
        rest = stored(reduce(DataFrame.union, [x.select("cell", "u", "n", "text") for x in whole]), "whole")
        found = found.union(_cell_links(_by_shingle(rest, rule), rule))
    return stored(found, "links"), sizes


def _member_filter(cells: DataFrame, bits: int, nbytes: int = 1 << 22) -> dict[int, bytes]:
    """Segments of a Bloom filter of fixed size that holds the texts in cells."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).view(U64))
            if len(h):
                yield packed(h, h, bits)

    def segment(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([Membership.part(np.frombuffer(data, U64), max(64, nbytes >> bits))], pa.binary())], names=["bucket", "data"])

    return {r[0]: bytes(r[1]) for r in by_bucket(cells.select("u").mapInArrow(send, PACKED), segment, PACKED).collect()}


def text_components(texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(u, component) for texts that have a link to another text, and (u, n) for all."""
    found, sizes = links(texts, rule)
    return connected(found).select(F.col("node").alias("u"), "component"), sizes


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id that links lead to, itself included).

    Documents without words (or with null text) have no shingles and link with
    nothing. Equal texts link. Repeated rows are documents of their own with
    the same id; a null id is never the least unless its component has no
    other, and is then null. An empty table gives no rows. Texts and shingles
    are told apart by 64-bit hash.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("u"))
    parts, sizes = text_components(docs.select("u", "text"), rule)
    rows = docs.select("doc_id", "u").join(sizes, "u").join(parts, "u", "left")
    group = F.coalesce("component", "u")
    rows = stored(rows.select("doc_id", "n", group.alias("g"), F.col("component").isNotNull().alias("linked")), "rows")
    least = rows.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(size=5, num=80)) -> DataFrame:
    """One row of each component of linked documents, the one of least id (then of least text hash); all columns.

    Documents without words stay. Rows with equal id and text are one document. A null id comes last.
    """
    at = df.columns
    docs = pick(df, __key=id_col, __text=text_col, **{f"__{i}": c for i, c in enumerate(at)})
    docs = docs.withColumn("u", F.xxhash64("__text")).withColumn("k", F.xxhash64("__key", "__text"))
    parts, sizes = text_components(docs.select("u", F.col("__text").alias("text")), rule)
    rows = docs.select(F.col("__key").alias("doc_id"), "u", "k").join(sizes.filter("n > 0"), "u").join(parts, "u", "left")
    rows = stored(rows.select("doc_id", "u", "k", F.coalesce("component", "u").alias("g")), "group-rows")
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u")).alias("first"), F.min("k").alias("low"), F.max("k").alias("high"))
    others = rows.join(first.filter("low < high"), "g").filter(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("u") != F.col("first.u")))
    left = docs.join(stored(others.select("k").distinct(), "losers"), "k", "left_anti").dropDuplicates(["k"])
    return left.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(at)])
