"""Ranked lexical search of all documents for each item of a query table, as a threshold-seeded join.

1. Every whole text is cut into terms once; of each document its length and the
   counts of the terms that queries use are stored.
2. A pass over the stored counts keeps, for each term, the k documents of
   highest impact and the number of documents that hold it.
3. Seeds: an item's k-th score is at least the k-th stored impact of any of its
   terms, and at least the k-th highest sum of stored impacts by document.
4. An item's terms are ranked by their highest impact. The longest suffix whose
   bounds sum to less than the seed is pruned: a document with pruned terms
   alone stays below the k-th score. The others generate candidates.
5. Candidates whose known part plus the pruned terms' bound reaches the seed
   are scored exactly; tasks keep k documents an item, a window ranks them.

What the driver and the workers hold follows the query table, not the
documents, and is bounded: items are searched in blocks of about
``max_index_bytes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored, text_slices, worker_cache
from .decontamination import words_of

#: Bound of one block's item terms; the driver holds k stored impacts a term beside them.
MAX_INDEX_BYTES = 4 << 20
#: Expanded (document, item) entries that a task handles at once.
AT_ONCE = 2_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): the distinct terms of each row of (item_id, text); ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("search")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts: dict[bytes, int] = {}
                for w in words_of(text.as_py()):
                    counts[w] = counts.get(w, 0) + 1
                out += [(row, item_id, w, c) for w, c in counts.items()]
                row += 1
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.field(0).type), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], names=["item", "item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


class Index:
    """A block of items: numbered terms, and each item's terms with their counts, item by item."""

    def __init__(self, item: np.ndarray, term: list[bytes], times: np.ndarray) -> None:
        self.items, owner = np.unique(item, return_inverse=True)
        self.terms = sorted(set(term))
        number = {t: i for i, t in enumerate(self.terms)}
        of = np.fromiter(map(number.__getitem__, term), np.int64, len(term))
        order = np.lexsort((of, owner))
        self.term, self.times = of[order], times[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.items)))])


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(row, doc_id, n, terms, counts) of each document of (doc_id, text) with a term: its length in terms, and the
    numbers (ascending) and counts of those of ``terms``, as little-endian 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    token = shared._jbroadcast.id()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("search")
        if token not in held:
            held.clear()
            held[token] = {t: i for i, t in enumerate(shared.value)}
        get, size, row = held[token].get, len(held[token]), TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in text_slices(batch, 1):
                texts = [words_of(t.as_py()) for t in piece.column(1)]
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                ids = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int64, int(n.sum()))
                doc = np.repeat(np.arange(len(n)), n)
                key, counts = np.unique((doc * size + ids)[ids >= 0], return_counts=True)
                at = np.searchsorted(key, np.arange(len(n) + 1) * size) * 4
                number, counts = (key % max(size, 1)).astype("<i4").tobytes(), counts.astype("<i4").tobytes()
                cut = lambda raw, at=at: pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                full = pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), piece.column(0), pa.array(n), cut(number), cut(counts)], schema=schema)
                row += len(n)
                yield full.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "row long, doc_id long, n long, terms binary, counts binary")


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the batch, term, count) of the stored rows."""
    terms, counts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("terms", "counts"))
    doc = np.repeat(np.arange(batch.num_rows), [len(t) // 4 for t in terms])
    return doc, np.frombuffer(b"".join(terms), "<i4").astype(np.int64), np.frombuffer(b"".join(counts), "<i4").astype(np.int64)


def rates(n: np.ndarray, tf: np.ndarray, texts: int, total: int) -> np.ndarray:
    """Impact of a term by its weight: in integers, from the document's length and the term's count."""
    m = 75 + (25 * n * texts) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_of(key: np.ndarray, value: np.ndarray, *ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values of each key, lowest ties first."""
    order = np.lexsort((*ties[::-1], -value, key))
    sorted_key = key[order]
    start = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


def stored_impacts(held: DataFrame, size: int, texts: int, total: int, k: int) -> DataFrame:
    """(term, row, rate): the k highest rates of each term; and with row -1, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("search")
        df, top = np.zeros(size, np.int64), [np.zeros(0, np.int64)] * 3
        for batch in batches:
            doc, term, tf = unpacked(batch)
            df += np.bincount(term, minlength=size)
            n, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            top = [np.concatenate([a, b]) for a, b in zip(top, (term, row[doc], rates(n[doc], tf, texts, total)))]
            kept = best_of(top[0], top[2], top[1], k=k)
            top = [a[kept] for a in top]
        some = np.flatnonzero(df)
        parts = [np.concatenate(x) for x in ((top[0], some), (top[1], np.full(len(some), -1)), (top[2], df[some]))]
        yield pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int32)), pa.array(parts[1]), pa.array(parts[2])], names=["term", "row", "rate"])

    return held.select("n", "row", "terms", "counts").mapInArrow(run, "term int, row long, rate long")


class Seeds:
    """Bounds of a block: which terms generate candidates, the least score that counts, and what pruned terms may add."""

    def __init__(self, index: Index, df: np.ndarray, term: np.ndarray, row: np.ndarray, rate: np.ndarray, texts: int, k: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        size, items = len(df), len(index.items)
        order = np.lexsort((-rate, term))
        term, row, impact = term[order], row[order], rate[order] * self.weight[term[order]]
        at = np.searchsorted(term, np.arange(size + 1))
        most, kth = np.zeros(size, np.int64), np.zeros(size, np.int64)
        full = at[1:] > at[:-1]
        most[full] = impact[at[:-1][full]]
        enough = at[1:] - at[:-1] >= k
        kth[enough] = impact[at[:-1][enough] + k - 1]
        self.least, self.rest, generates = np.ones(items, np.int64), np.zeros(items, np.int64), []
        for i in range(items):
            own, times = index.term[index.ptr[i] : index.ptr[i + 1]], index.times[index.ptr[i] : index.ptr[i + 1]]
            self.least[i] = max(1, int((times * kth[own]).max(initial=0)))
            spans = at[own + 1] - at[own]
            places = np.repeat(at[own] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            rows, which = np.unique(row[places], return_inverse=True)
            if len(rows) >= k:
                part = np.zeros(len(rows), np.int64)
                np.add.at(part, which, impact[places] * np.repeat(times, spans))
                self.least[i] = max(int(self.least[i]), int(np.partition(part, len(part) - k)[len(part) - k]))
            bound = times * most[own]
            ascending = np.argsort(bound, kind="stable")
            sums = np.cumsum(bound[ascending])
            pruned = int(np.searchsorted(sums, self.least[i]))  # sums below the seed
            self.rest[i] = sums[pruned - 1] if pruned else 0
            generates += [(int(own[j]), i, int(times[j])) for j in ascending[pruned:]]
        generates.sort()
        parts = np.array(generates, np.int64).reshape(-1, 3)
        self.item, self.times = parts[:, 1], parts[:, 2]
        self.ptr = np.searchsorted(parts[:, 0], np.arange(size + 1))


def expanded(count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, ``count[i]`` entries: i, and the places from ``start[i]`` on."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def scores_of(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, index: Index, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of the pairs that reach the item's seed; the postings are in order of (doc, term)."""
    items, size = len(index.items), len(index.terms)
    owner, place = expanded(seeds.ptr[term + 1] - seeds.ptr[term], seeds.ptr[term])
    key = doc[owner] * items + seeds.item[place]
    order = np.argsort(key, kind="stable")
    key, part = key[order], (impact[owner] * seeds.times[place])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    known = np.add.reduceat(part, first) if len(first) else part
    pair = key[first]
    pair = pair[known + seeds.rest[pair % items] >= seeds.least[pair % items]]
    found, postings = np.zeros(len(pair), np.int64), doc * size + term
    width = np.diff(index.ptr)
    lo = 0
    for hi in cuts(width[pair % items]):
        d, i = np.divmod(pair[lo:hi], items)
        owner, place = expanded(width[i], index.ptr[i])
        wanted = d[owner] * size + index.term[place]
        at = np.minimum(np.searchsorted(postings, wanted), max(len(postings) - 1, 0))
        gain = np.where(postings[at] == wanted, impact[at] * index.times[place], 0)
        np.add.at(found, lo + owner, gain)
        lo = hi
    d, i = np.divmod(pair, items)
    good = found >= seeds.least[i]
    return d[good], i[good], found[good]


def cuts(counts: np.ndarray) -> list[int]:
    """Ends of runs whose counts sum to about :data:`AT_ONCE`."""
    out, total = [], np.cumsum(counts)
    while not out or out[-1] < len(counts):
        lo = out[-1] if out else 0
        before = total[lo - 1] if lo else 0
        out.append(max(min(lo + 1, len(counts)), int(np.searchsorted(total, before + AT_ONCE, "right"))))
    return out


def search(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score for each row of ``items``, scores above 0.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased. Equal scores are ranked by ascending doc_id,
    a null one last; repeated documents are ranked each, repeated items each
    have their own list. Null, empty and blank texts have no terms: such
    documents are found by nothing and do not count, such items find nothing.
    Empty tables give no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    queries = stored(item_terms(pick(items, item_id=item_col, text=item_text_col)), "item-terms")
    total = queries.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_index_bytes))
    parts = [_block(docs, queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = reduce(DataFrame.union, parts)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    named = queries.select("item", "item_id").distinct()
    return ranked.filter(F.col("rank") <= k).join(named, "item").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): at most k documents an item from each task, the k best among them."""
    spark = docs.sparkSession
    own = queries.select("item", "term", "times").toArrow()
    index = Index(own["item"].to_numpy(), own["term"].to_pylist(), own["times"].to_numpy())
    empty = spark.createDataFrame([], "item long, doc_id long, score long")
    if not index.terms:
        return empty
    held = stored(term_counts(docs, index.terms), "term-counts")
    texts, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return empty
    size = len(index.terms)
    kept = stored(stored_impacts(held, size, texts, total, k), "impacts")
    df = np.zeros(size, np.int64)
    counts = kept.filter("row < 0").groupBy("term").agg(F.sum("rate").alias("df")).toArrow()
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("rate"), "row"))
    top = kept.filter("row >= 0").withColumn("at", best).filter(F.col("at") <= k).select("term", "row", "rate").toArrow()
    seeds = Seeds(index, df, top["term"].to_numpy().astype(np.int64), top["row"].to_numpy(), top["rate"].to_numpy(), texts, k)
    shared = spark.sparkContext.broadcast((index, seeds))
    token = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("search")
        if token not in cache:
            cache.clear()
            cache[token] = shared.value
        index, seeds = cache[token]
        top = [np.zeros(0, np.int64)] * 4  # item, score, no id, id
        for batch in batches:
            doc, term, tf = unpacked(batch)
            n = batch.column(1).to_numpy()
            impact = rates(n[doc], tf, texts, total) * seeds.weight[term]
            ids = batch.column(0)
            none, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            spread = np.concatenate([[0], np.cumsum(seeds.ptr[term + 1] - seeds.ptr[term])])
            lo = 0
            for hi in cuts(np.diff(spread[edges])):
                a, b = edges[lo], edges[hi]
                d, i, s = scores_of(doc[a:b], term[a:b], impact[a:b], index, seeds)
                top = [np.concatenate([x, y]) for x, y in zip(top, (i, s, none[d], ids[d]))]
                top = [x[kept] for kept in [best_of(top[0], top[1], top[2], top[3], k=k)] for x in top]
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(index.items[top[0]]), pa.array(top[3], pa.int64(), mask=top[2] == 1), pa.array(top[1])], names=["item", "doc_id", "score"])

    return held.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")
