"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne).

An n-gram of quantised log-count q is entered q times, once for each level; a
reader probes level after level until one is absent and so gets q back, never
too small. Probabilities are Dirichlet-smoothed bigrams over an add-one unigram
base. Unigram counts are exact; they also give the base score.

All counts are summed over the whole training part of the corpus, by hash
buckets. The filter grows with the corpus and is broadcast in passes of at most
``max_filter_bytes``: each token's bigram belongs to one pass, and a document's
score is the sum over passes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import PACKED, bits_for, by_bucket, packed
from .common import pick, shuffle_width, stored, worker_cache
from .hashing import mix, word_hashes

U64 = np.uint64
#: Token ids beside the hashes of words.
END, START = U64(0x0E0D0E0D0E0D0E0D), U64(0x57A7757A7757A775)
COUNT = np.dtype([("h", "<u8"), ("c", "<i8")])
FLUSH, PROBES = 1_000_000, 3


def tokens_of(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, U64)
    out[:-1] = word_hashes(words)
    out[-1] = END
    return out


def bigrams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; ``starts`` are the documents' first tokens."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return mix(before * U64(0x9E3779B97F4A7C15) + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised log-counts: 1 for 1, 2 for 2 and 3, 3 for 4 to 7 ..."""
    return np.floor(np.log2(counts)).astype(np.int64) + 1


#: What a level stands for: the geometric mean of its counts, 1 for level 1.
LEVEL_COUNT = np.array([0.0, 1.0, *[(float(1 << (q - 1)) * float((1 << q) - 1)) ** 0.5 for q in range(2, 63)]])


def held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


class Filter:
    """Segments of a log-frequency Bloom filter, by the top bits of the n-gram hash.

    ``sizes`` has the bytes of each segment, ``raw`` the segments on end; it is read in place.
    """

    def __init__(self, bits: int, sizes: dict[int, int], raw: bytes) -> None:
        self.shift = U64(64 - bits)
        self.size = np.zeros(1 << bits, np.int64)
        for i, n in sizes.items():
            self.size[i] = n * 8
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(raw or b"\0", np.uint8)

    @classmethod
    def of(cls, bits: int, parts: list[tuple[int, bytes]]) -> Filter:
        return cls(bits, {i: len(p) for i, p in parts}, b"".join(p for _, p in sorted(parts)))

    @staticmethod
    def places(hashes: np.ndarray, level: int, size) -> Iterator[np.ndarray]:
        h = mix(hashes + U64(level * 0xA24BAED4963EE407 % (1 << 64)))
        low, step = (h & U64(0xFFFFFFFF)).astype(np.int64), (h >> U64(33)).astype(np.int64) | 1
        for i in range(PROBES):
            yield (low + i * step) % size

    @classmethod
    def segment(cls, hashes: np.ndarray, counts: np.ndarray, bits_per_entry: int) -> bytes:
        q = levels(counts)
        flags = np.zeros(max(64, -(-int(q.sum()) * bits_per_entry // 8)) * 8, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            for place in cls.places(hashes[q >= level], level, np.int64(len(flags))):
                flags[place] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes belong to a segment of this filter."""
        return self.size[(hashes >> self.shift).astype(np.int64)] > 0

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts: membership probes of level 1, 2 ... up to the first that is absent."""
        q = np.zeros(len(hashes), np.int64)
        live = np.flatnonzero(self.holds(hashes))
        for level in range(1, 63):
            if not len(live):
                break
            h = hashes[live]
            seg = (h >> self.shift).astype(np.int64)
            hit = np.ones(len(live), bool)
            for place in self.places(h, level, self.size[seg]):
                bit = self.at[seg] + place
                hit &= (self.raw[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            q[live] = level
        return LEVEL_COUNT[q]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    r = np.concatenate(parts)
    r = r[np.argsort(r["h"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], r["h"][1:] != r["h"][:-1]]))
    out = r[first].copy()
    out["c"] = np.add.reduceat(r["c"], first)
    return out


def _counted(hashes: np.ndarray) -> np.ndarray:
    h, c = np.unique(hashes, return_counts=True)
    out = np.empty(len(h), COUNT)
    out["h"], out["c"] = h, c
    return out


def ngram_counts(docs: DataFrame, bits_per_entry: int, folds: int, fold: int) -> tuple[DataFrame, int]:
    """(bucket, n, data) over the training documents and the bits of a bucket: filter segments from bucket 0,
    unigram counts below."""
    bits = bits_for(shuffle_width(docs.sparkSession))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            one, two = _counted(tokens), _counted(bigrams(tokens, starts))
            yield packed(two, two["h"], bits)
            yield packed(one, mix(one["h"]), bits, -(1 << bits))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held_out(doc_id, folds, fold):
                    continue
                held.append(tokens_of(text.as_py()))
                n += len(held[-1])
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def block(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        r = _summed([np.frombuffer(data, COUNT)])
        out = r.tobytes() if bucket < 0 else Filter.segment(r["h"], r["c"], bits_per_entry)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(out)], pa.int64()), pa.array([out], pa.binary())], names=["bucket", "n", "data"])

    return stored(by_bucket(docs.mapInArrow(send, PACKED), block, "bucket int, n long, data binary"), "ngrams"), bits


class Unigrams:
    """Exact counts by token hash, from arrays that are read in place."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        self.h, self.c = h, c
        self.total, self.distinct = int(self.c.sum()), len(self.h)
        end = np.searchsorted(self.h, END)
        self.texts = int(self.c[end]) if end < len(self.h) and self.h[end] == END else 0

    @staticmethod
    def sorted(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order and their counts."""
        r = np.concatenate([np.zeros(0, COUNT), *[np.frombuffer(p, COUNT) for p in parts]])
        order = np.argsort(r["h"], kind="stable")
        return r["h"][order], r["c"][order]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.h, tokens), len(self.h) - 1)
        return np.where(self.h[at] == tokens, self.c[at], 0)


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, prior: float = 200.0,
    bits_per_entry: int = 8, max_filter_bytes: int = 1 << 28, max_unigram_bytes: int = 1 << 29,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the documents outside the held-out fold and scores all. Null and
    empty texts have the end token alone; a null id's text is empty, so it
    trains. Repeated rows count and are scored each. An empty table gives no
    rows; with no training text every token is unknown and scores
    log10(1 / (V + 1)). Vocabularies beyond ``max_unigram_bytes`` (16 bytes a
    word) raise ValueError.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    found, bits = ngram_counts(docs, bits_per_entry, folds, fold)
    vocabulary = found.filter("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if vocabulary > max_unigram_bytes:
        raise ValueError(f"the vocabulary takes {vocabulary} bytes, more than {max_unigram_bytes}")
    one = spark.sparkContext.broadcast(Unigrams.sorted(r[0] for r in found.filter("bucket < 0").select("data").toLocalIterator()))
    passes: list[list[int]] = [[]]
    size = 0
    for bucket, n in found.filter("bucket >= 0").select("bucket", "n").orderBy("bucket").collect():  # one row per bucket
        if size + n > max_filter_bytes and passes[-1]:
            passes.append([])
            size = 0
        passes[-1].append(bucket)
        size += n
    if len(passes) > 1:  # stored, so that each pass sees the same numbers
        rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows").select("doc_id", "text", "row")
    else:
        rows = docs.withColumn("row", F.lit(0).cast("long"))
    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(buckets: list[int], lead: bool) -> DataFrame:
        low, high = (buckets[0], buckets[-1]) if buckets else (0, -1)
        segments = found.filter((F.col("bucket") >= low) & (F.col("bucket") <= high)).select("bucket", "data").toLocalIterator()
        segments = sorted((r[0], bytes(r[1])) for r in segments)
        two = spark.sparkContext.broadcast(({i: len(p) for i, p in segments}, b"".join(p for _, p in segments)))
        del segments
        token = two._jbroadcast.id()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = worker_cache("lm_scoring")
            if token not in held:
                held.clear()
                held[token] = (Unigrams(*one.value), Filter(bits, *two.value))
            uni, grams = held[token]
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    yield score_batch(batch.slice(lo, 500), uni, grams)

        def score_batch(batch: pa.RecordBatch, uni: Unigrams, grams: Filter) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            texts = [tokens_of(t.as_py()) for t in batch.column(1)]
            n = np.array([len(t) for t in texts])
            starts = np.cumsum(n) - n
            tokens = np.concatenate(texts)
            kinds, which = np.unique(tokens, return_inverse=True)
            c = uni(kinds)[which]
            base = np.log10((c + 1) / (uni.total + uni.distinct + 1))
            context = np.empty_like(c)
            context[1:] = c[:-1]
            context[starts] = uni.texts
            pairs = bigrams(tokens, starts)
            both = np.minimum(grams.counts(pairs), context)
            p = np.log10((both + prior * (c + 1) / (uni.total + uni.distinct + 1)) / (context + prior))
            if len(passes) > 1:  # a bigram is scored where its segment is; the first pass has those of absent segments
                p = np.where(grams.holds(pairs) | lead_only(pairs, lead), p, 0.0)
            sums = lambda x: np.add.reduceat(x, starts)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(2), batch.column(0), pa.array([held_out(i, folds, fold) for i in ids], pa.bool_()),
                    pa.array(n, pa.int64()), pa.array(sums((c > 0).astype(np.int64)), pa.int64()),
                    pa.array(np.full(len(n), uni.total), pa.int64()), pa.array(sums(base)), pa.array(sums(p)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        def lead_only(pairs: np.ndarray, lead: bool) -> np.ndarray:
            seg = (pairs >> U64(64 - bits)).astype(np.int64)
            return ~np.isin(seg, everything) if lead else np.zeros(len(pairs), bool)

        return rows.mapInArrow(run, kind)

    everything = np.array([b for p in passes for b in p], np.int64)
    out = scored(passes[0], True)
    if len(passes) > 1:
        for p in passes[1:]:
            out = out.union(scored(p, False))
        same = [F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")]
        out = out.groupBy("row").agg(*same, F.sum("score").alias("score"))
    return out.drop("row")
