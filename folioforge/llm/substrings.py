"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed in blocks. So that not every word has
to travel, texts are first sieved by winnowing: of the short runs of words in a
window, the one of least hash is its anchor, and equal windows have equal
anchors. A window whose anchor stands at one place only is unique. Repeated
anchors go to all tasks as a Bloom filter of fixed size: false alarms cost time
and change no result.

What is left goes to the reference blocks: a block holds the words around all
places of the anchors in its range and indexes them as a suffix array. Each place
is factored greedily against its block: the longest match from the first word on
is a factor, found by comparing words with the neighbours in the suffix array;
the parse then goes on at the first window that crosses the factor's end. Places
of very frequent anchors are dealt out window by window instead, so that no block
gathers them all.

The factors of a text come together from all blocks. Those that continue each
other at the same reference are one; of the others, the greedy parse takes the one
that reaches furthest, again and again, with its part before the last factor's
end, so that windows across the boundary of two factors are kept. Factors of a
window or more are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import PACKED, Membership, bits_for, by_bucket, packed
from .common import pick, shuffle_width, stored, worker_cache
from .hashing import mix, prefix, runs, sliding, span, word_hashes

ANCHOR = np.dtype([("a", "<u8"), ("u", "<u8"), ("p", "<u4"), ("many", "<u4")])
FACTOR = np.dtype([("u", "<u8"), ("ru", "<u8"), ("p", "<u4"), ("rp", "<u4"), ("n", "<u4")])
#: Words of an anchor's run, bytes of the anchor filter, records that a task gathers before it sends them.
ANCHOR_WORDS, FILTER_BYTES, FLUSH = 16, 1 << 24, 2_000_000
#: Places from which on an anchor's places are dealt out window by window; share of the filter's bytes for these.
HOT, HOT_SHARE = 2048, 16
#: In ``many``: the anchor has several places; the lower bits count them.
SEVERAL = np.uint32(1 << 31)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(text key, words) of each text that the task has not seen yet; copies would only repeat it."""
    seen: set[int] = set()
    for batch in batches:
        for u, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if u not in seen:
                seen.add(u)
                yield u & (2**64 - 1), (text.as_py() or "").encode("utf-8", "surrogatepass").split()


def anchors(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, the least of them in each window, and which of them are anchors."""
    a = runs(h, k)
    least = sliding(a, window - k + 1)
    edge = np.zeros(window - k, np.uint64)
    return a, least, sliding(np.concatenate([edge, least, edge]), window - k + 1, np.maximum) == a


def _anchor_records(parts: list[np.ndarray]) -> np.ndarray:
    """One record per anchor hash with the number of its places; SEVERAL is set where they are not one and the same."""
    r = np.concatenate(parts)
    r = r[np.lexsort((r["p"], r["u"], r["a"]))]
    new = np.flatnonzero(np.concatenate([[True], r["a"][1:] != r["a"][:-1]]))
    last = np.concatenate([new[1:], [len(r)]]) - 1
    out = r[new].copy()
    several = np.maximum.reduceat(r["many"], new) >= SEVERAL
    several |= (r["u"][new] != r["u"][last]) | (r["p"][new] != r["p"][last])
    count = np.minimum(np.add.reduceat((r["many"] & ~SEVERAL).astype(np.int64), new), 1 << 30)
    out["many"] = count.astype(np.uint32) | np.where(several, SEVERAL, np.uint32(0))
    return out


def anchor_filters(texts: DataFrame, window: int, k: int, filter_bytes: int, hot: int) -> tuple[int, dict[int, bytes], dict[int, bytes]]:
    """Bits and segments of the filters of the anchors that stand at two places or more, and at more than ``hot``."""
    bits = bits_for(shuffle_width(texts.sparkSession))
    nbytes = max(64, filter_bytes >> bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for u, words in texts_of(batches):
            if len(words) < window:
                continue
            a, _, marked = anchors(word_hashes(words), window, k)
            at = np.flatnonzero(marked)
            r = np.zeros(len(at), ANCHOR)
            r["a"], r["u"], r["p"], r["many"] = a[at], u, at, 1
            held.append(r)
            n += len(r)
            if n > FLUSH:
                out = _anchor_records(held)
                yield packed(out, out["a"], bits)
                held, n = [], 0
        if held:
            out = _anchor_records(held)
            yield packed(out, out["a"], bits)

    def segment(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        r = _anchor_records([np.frombuffer(data, ANCHOR)])
        many = r["a"][r["many"] >= SEVERAL]
        often = r["a"][(r["many"] >= SEVERAL) & ((r["many"] & ~SEVERAL) > hot)]
        if len(many):
            both = [Membership.part(many, nbytes), Membership.part(often, max(64, nbytes // HOT_SHARE)) if len(often) else None]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in both]], names=["bucket", "data", "often"])

    found = by_bucket(texts.mapInArrow(send, PACKED), segment, PACKED + ", often binary").collect()  # of fixed size
    return bits, {r[0]: bytes(r[1]) for r in found}, {r[0]: bytes(r[2]) for r in found if r[2] is not None}


def place_type(window: int, k: int) -> np.dtype:
    """Words around a place of an anchor: ``w[lo:hi]``, with the place at window - k. ``key`` says whose place it is."""
    return np.dtype([("key", "<u8"), ("w", "<u4", 2 * window - k), ("lo", "<u2"), ("hi", "<u2"), ("u", "<u8"), ("p", "<u4")])


def places(u: int, h: np.ndarray, at: np.ndarray, keys: np.ndarray, before: int, window: int, k: int) -> np.ndarray:
    """Places ``at`` of a text of word hashes ``h`` with up to ``before`` words before each."""
    middle = window - k
    r = np.zeros(len(at), place_type(window, k))
    where = at[:, None] + np.arange(-middle, window)
    fits = (where >= np.maximum(0, at - before)[:, None]) & (where < len(h))
    r["w"] = np.where(fits, h[np.clip(where, 0, len(h) - 1)].astype(np.uint32), 0)
    r["lo"], r["hi"] = middle - np.minimum(at, before), middle + np.minimum(window, len(h) - at)
    r["key"], r["u"], r["p"] = keys, u, at
    return r


def settle(r: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one task's places: factors of those that have equal words around them, and one place of each kind."""
    kind = np.ascontiguousarray(r).view(np.uint8).reshape(len(r), -1)[:, : r.dtype.fields["u"][1]]
    kind = np.ascontiguousarray(kind).view(f"V{kind.shape[1]}").ravel()
    order = np.argsort(kind, kind="stable")
    r, kind = r[order], kind[order]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.concatenate([first, [len(r)]]))
    mine = np.flatnonzero((size[group] > 1) & (r["hi"].astype(np.int64) - r["lo"] >= window))
    other = np.where(first[group[mine]] == mine, mine + 1, first[group[mine]])
    start = r["lo"][mine].astype(np.int64)
    return _factors(r, mine, other, start, r["hi"][mine] - start, window - k), r[first]


def _factors(r: np.ndarray, mine: np.ndarray, other: np.ndarray, start: np.ndarray, words: np.ndarray, middle: int) -> np.ndarray:
    out = np.zeros(len(mine), FACTOR)
    out["u"], out["ru"], out["n"] = r["u"][mine], r["u"][other], words
    out["p"], out["rp"] = r["p"][mine] + start - middle, r["p"][other] + start - middle
    return out


def factors_in_block(r: np.ndarray, window: int, k: int) -> np.ndarray:
    """Greedy factors of all places of a block, against the others with the same key.

    A place's parse stands at an offset of its words. The words from there on are looked up in the suffix array of
    that offset; the longest match is with a neighbour. A match of a window or more is a factor, and the parse goes on
    at the first window across its end; else it goes on by a word. Only windows that contain the place's anchor count.
    """
    _, one = np.unique(r[["key", "u", "p"]], return_index=True)
    r = r[one]
    _, group, size = np.unique(r["key"], return_inverse=True, return_counts=True)
    keep = size[group] > 1
    r, group = r[keep], group[keep]
    lo, hi, middle = r["lo"].astype(np.int64), r["hi"].astype(np.int64), window - k
    stands, found = lo.copy(), []
    for o in range(middle + 1):
        asks = (stands == o) & (hi - o >= window)
        if not asks.any():
            continue
        asked = np.zeros(len(size), bool)
        asked[group[asks]] = True
        index = np.flatnonzero(asked[group] & (lo <= o) & (hi - o >= window))
        rest = r["w"][index, o:]
        sorts = np.concatenate([group[index].astype("<u4")[:, None], rest], axis=1)
        order = np.argsort(np.ascontiguousarray(sorts).view(f"V{sorts.shape[1] * 4}").ravel(), kind="stable")
        index, rest = index[order], rest[order]
        differ = rest[1:] != rest[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rest.shape[1])
        same = np.minimum(same, np.minimum(hi[index[1:]], hi[index[:-1]]) - o)
        same[group[index[1:]] != group[index[:-1]]] = 0
        up, down = np.concatenate([[0], same]), np.concatenate([same, [0]])
        longest, at = np.maximum(up, down), np.arange(len(index))
        other = index[np.clip(np.where(up >= down, at - 1, at + 1), 0, len(index) - 1)]
        mine = asks[index]
        index, longest, other = index[mine], longest[mine], other[mine]
        hit = longest >= window
        found.append(_factors(r, index[hit], other[hit], np.full(int(hit.sum()), o), longest[hit], middle))
        stands[index] = np.where(hit, o + longest - window + 1, o + 1)
    return np.concatenate(found) if found else np.zeros(0, FACTOR)


def block_factors(texts: DataFrame, window: int, k: int, filter_bytes: int, hot: int) -> DataFrame:
    """Packed FACTOR records, by bucket of the text key."""
    spark = texts.sparkSession
    bits, parts, often = anchor_filters(texts, window, k, filter_bytes, hot)
    shared = spark.sparkContext.broadcast((parts, often))
    token = shared._jbroadcast.id()
    kind = place_type(window, k)
    most = max(1000, FLUSH * 24 // kind.itemsize)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places for the blocks (buckets from 0), and what this task could settle itself (buckets below 0)."""
        held_filters = worker_cache("substrings")
        if token not in held_filters:
            held_filters.clear()
            held_filters[token] = tuple(Membership(bits, x) for x in shared.value)
        known, frequent = held_filters[token]
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            factors, ask = settle(np.concatenate(held), window, k)
            yield packed(ask, mix(ask["key"]), bits)
            if len(factors):
                yield packed(factors, factors["u"], bits, -(1 << bits))

        for u, words in texts_of(batches):
            if len(words) < window:
                continue
            h = word_hashes(words)
            a, least, marked = anchors(h, window, k)
            at = np.flatnonzero(marked)
            at = at[known(a[at])]
            if not len(at):
                continue
            apart = frequent(a[at])
            held.append(places(u, h, at[~apart], a[at[~apart]], window - k, window, k))
            n += len(held[-1])
            at = at[apart]
            if len(at):
                starts = at[:, None] - np.arange(window - k + 1)[None, :]
                fits = (starts >= 0) & (starts < len(least))
                fits &= least[np.where(fits, starts, 0)] == a[at][:, None]
                starts = np.unique(starts[fits])
                held.append(places(u, h, starts, span(prefix(h), starts, starts + window), 0, window, k))
                n += len(held[-1])
            if n > most:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    settled: list[np.ndarray] = []  # of one task: functions come to each task anew

    def block(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        factors = np.frombuffer(data, FACTOR) if bucket < 0 else factors_in_block(np.frombuffer(data, kind), window, k)
        if len(factors):
            settled.append(factors)
        if sum(map(len, settled)) > FLUSH:
            yield from finish()

    def finish() -> Iterator[pa.RecordBatch]:
        if settled:
            factors = np.concatenate(settled)
            settled.clear()
            yield packed(factors, factors["u"], bits)

    return by_bucket(texts.mapInArrow(send, PACKED), block, PACKED, finish)


def parse(matches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text key, factors) for each text: rows (start, words, reference key as signed, reference start).

    Matches that overlap or touch and continue at the same reference are one. Then, from the first word on, the
    factor is the match that covers the word after the last factor's end (or starts next) and reaches furthest.
    """
    shift = matches["rp"].astype(np.int64) - matches["p"].astype(np.int64)
    order = np.lexsort((matches["p"], shift, matches["ru"], matches["u"]))
    m, shift = matches[order], shift[order]
    start = m["p"].astype(np.int64)
    stop = start + m["n"]
    line = np.concatenate([[True], (m["u"][1:] != m["u"][:-1]) | (m["ru"][1:] != m["ru"][:-1]) | (shift[1:] != shift[:-1])])
    far = 1 << 34  # apart from all places of a text, so that running maxima do not cross lines
    reach = np.maximum.accumulate(stop + np.cumsum(line) * far) - np.cumsum(line) * far
    first = np.flatnonzero(line | np.concatenate([[True], start[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(m)]]) - 1
    rows = np.stack([start[first], reach[last] - start[first], m["ru"][first].view(np.int64), start[first] + shift[first]], axis=1)
    keys = m["u"][first]
    order = np.lexsort((-rows[:, 1], rows[:, 0], keys))
    rows, keys = rows[order], keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        taken, best, covered = [], None, 0
        for row in rows[i:j].tolist():
            if best is not None and row[0] > covered:  # no other match covers the next word
                taken.append(best)
                covered, best = best[0] + best[1], None
            if best is None and row[0] > covered:
                covered = row[0]
            if row[0] + row[1] > (best[0] + best[1] if best is not None else covered):
                best = row
        yield int(keys[i]), np.array([*taken, best] if best is not None else taken, np.int64)


def factored(texts: DataFrame, window: int = 35, k: int = ANCHOR_WORDS, filter_bytes: int = FILTER_BYTES, hot: int = HOT) -> DataFrame:
    """(u, factors binary): the factors of each text that has any, as rows of four 64-bit integers.

    ``texts`` has a 64-bit text key and the text. The factors are runs of a window of words or more
    that also stand elsewhere, in other texts or in the text itself.
    """

    def per_text(bucket: int, data: bytes) -> Iterator[pa.RecordBatch]:
        found = list(parse(np.frombuffer(data, FACTOR)))
        keys = np.array([u for u, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([f.tobytes() for _, f in found], pa.binary())], names=["u", "factors"])

    return by_bucket(block_factors(texts, window, k, filter_bytes, hot), per_text, "u long, factors binary")


def covered(factors: bytes | None, n: int) -> np.ndarray:
    """Which of n words lie in a factor."""
    step = np.zeros(n + 1, np.int64)
    if factors:
        f = np.frombuffer(factors, "<i8").reshape(-1, 4)
        np.add.at(step, f[:, 0], 1)
        np.add.at(step, np.minimum(f[:, 0] + f[:, 1], n), -1)
    return np.cumsum(step[:n]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = ANCHOR_WORDS, filter_bytes: int = FILTER_BYTES, hot: int = HOT, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and the kept words joined by blanks (``digest``: their SHA-256).

    A word goes if a window of ``window`` words over it also starts anywhere
    else. A text that several rows share is wholly repeated if it has a window.
    Null, empty and shorter texts lose nothing; repeated rows are copies of each
    other; an empty table gives no rows. Texts are told apart by 64-bit hash.
    """
    if not 0 < k <= window:
        raise ValueError("anchors must have between 1 word and the window's words")
    docs = pick(df, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("u"))
    copies = stored(docs.groupBy("u").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    factors = stored(factored(docs.select("u", "text"), window, k, filter_bytes, hot), "factors")
    joined = docs.join(factors, "u", "left").join(copies, "u", "left")
    out = "kept_sha256" if digest else "kept"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, f, c in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, gone = len(words), 0
                if c and n >= window:
                    words, gone = [], n
                elif f:
                    hit = covered(f, n)
                    gone = int(hit.sum())
                    words = [w for w, x in zip(words, hit.tolist()) if not x]
                left = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", out])

    return joined.select("doc_id", "text", "factors", "copies").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {out} string")


def substring_digest(df: DataFrame, **how) -> DataFrame:
    return remove_repeats(df, digest=True, **how)
