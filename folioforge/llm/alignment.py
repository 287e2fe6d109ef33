"""Aligning the tokens of two tokenizers over a corpus by distinct segments.

1. Texts are cut before white space at which neither vocabulary can merge
   (:func:`cuts_of` proves it from the files; where it cannot, a text is one
   segment). Documents are kept as numbers into the distinct segments of a
   chunk of bounded size, which are dealt to buckets by hash.
2. A bucket meets each of its segments once over all chunks: both tokenizers
   run, byte ranges give groups and links.
3. Counts of linked id pairs are summed over the corpus, with the highest for
   each id of the second tokenizer, and joined back to the buckets' pairs.
4. Each chunk gets its segments' results back and composes its documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import bits_for
from .common import pick, shuffle_width, stored, text_slices, worker_cache

#: Characters of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 24
#: Characters that are tokenised at once.
ENCODE_CHARS = 1 << 20
BLANK = "▁"
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """Byte-level entries write a printable Latin-1 byte as itself and the others, in order, as U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts_of(first: dict, proto: bytes) -> str:
    """The white space before which a text may be cut, or none.

    First tokenizer: byte-level entries over its pre-tokens, which no
    normalizer or further added token touches; a pre-token never holds white
    space behind another character. Second: pieces of the text as it is (no
    character map, no squeezing, a blank put before the text, bytes for what
    has no piece), none of which has a blank behind another character, or a
    line feed at all. So no merge spans such a place.
    """
    level = first.get("pre_tokenizer") or {}
    if first.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True):
        return ""
    if first["model"].get("type") != "BPE" or any(not t["special"] for t in first.get("added_tokens", [])):
        return ""
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except ImportError:
        return ""
    model = pb.ModelProto.FromString(proto)
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not (rule.add_dummy_prefix and rule.escape_whitespaces):
        return ""
    if not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
        return ""
    pieces = [p.piece for p in model.pieces if p.type != pb.ModelProto.SentencePiece.BYTE]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        return ""
    return " " if any("\n" in p for p in pieces) else " \n"


class Encoders:
    """Both tokenizers of a worker, and the cut of texts into segments."""

    def __init__(self, first_path: str, second_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        alphabet = byte_alphabet()
        entries = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        self.first_bytes = [bytes(alphabet[c] for c in entries[i]) if i in entries and all(c in alphabet for c in entries[i]) else b"" for i in range(max(entries) + 1)]
        sp = self.second
        self.second_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(sp.get_piece_size())]
        self.blank = sp.piece_to_id(BLANK)
        cuts = cuts_of(json.loads(self.first.to_str()), sp.serialized_model_proto())
        self.cuts = cuts
        # a segment: one such blank, more white space, other characters, on over white space that may not be cut; the last takes the text's end
        self.find = re.compile(rf"[{cuts}]\s*\S+(?:[^\S{cuts}]\s*\S+)*(?:\s+\Z)?|\s+\Z").findall if cuts else None

    def segments(self, text: str | None) -> list[str]:
        """Segments of a blank and the text; none where the text is empty or known to lose bytes."""
        if not text or self.cuts and BLANK in text:
            return []
        return self.find(" " + text) if self.cuts else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; none where either's bytes are not the segment's."""
        one = [e.ids for e in self.first.encode_batch(segments, add_special_tokens=False)]
        inner = [s[0] != " " for s in segments]
        two = self.second.encode([s if x else s[1:] for s, x in zip(segments, inner)], num_threads=1)
        for k, s in enumerate(segments):
            raw = s.encode("utf-8", "surrogatepass")
            if inner[k]:  # the blank put before the segment is not the text's
                two[k] = two[k][1:] if two[k][:1] == [self.blank] else []
            if b"".join(map(self.first_bytes.__getitem__, one[k])) != raw or b"".join(map(self.second_bytes.__getitem__, two[k])) != raw:
                if self.cuts:
                    raise ValueError(f"a segment's tokens are not its bytes: {s[:80]!r}")
                one[k], two[k] = [], []
        return one, two


def worker_encoders(first_path: str, second_path: str) -> Encoders:
    held = worker_cache("alignment")
    if (first_path, second_path) not in held:
        held[first_path, second_path] = Encoders(first_path, second_path)
    return held[first_path, second_path]


class Numbers(dict):
    """Strings numbered in order of their first call."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def links_of(end_a: np.ndarray, len_a: np.ndarray, end_b: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose byte ranges overlap."""
    low = np.searchsorted(end_b, end_a - len_a, "right")
    count = np.searchsorted(end_b - len_b, end_a, "left") - low
    a = np.repeat(np.arange(len(end_a)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


class Aligned:
    """Distinct segments with their tokens' groups and links."""

    def __init__(self, segments: list[str], encoders: Encoders) -> None:
        self.stats: list[np.ndarray] = []
        self.groups: list[str] = []
        segs, pairs = [], []
        sizes = np.cumsum([len(s) for s in segments])
        lo = 0
        while lo < len(segments):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + ENCODE_CHARS, "right")))
            self._add(segments[lo:hi], encoders, lo, segs, pairs)
            lo = hi
        self.stats = [np.concatenate(x) for x in zip(*self.stats)] if self.stats else [np.zeros(0, np.int64)] * 4
        self.link_segment = np.concatenate(segs) if segs else np.zeros(0, np.int64)
        self.pairs, self.link_pair = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_inverse=True)

    def _add(self, segments: list[str], encoders: Encoders, first: int, segs: list, pairs: list) -> None:
        n = len(segments)
        sides = []
        for ids, raw in zip(encoders.encode(segments), (encoders.first_bytes, encoders.second_bytes)):
            flat = np.array([i for x in ids for i in x], np.int64)
            owner = np.repeat(np.arange(n), [len(x) for x in ids])
            size = np.array([len(raw[i]) for i in flat.tolist()], np.int64)
            sides.append((flat, owner, size, np.cumsum(size)))
        (a, own_a, len_a, end_a), (b, own_b, len_b, end_b) = sides
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        own_group = own_a[np.searchsorted(end_a, shared)]
        la, lb = links_of(end_a, len_a, end_b, len_b)
        self.stats.append([np.bincount(x, minlength=n) for x in (own_a, own_b, own_group, own_a[la])])
        segs.append(own_a[la] + first)
        pairs.append((a[la] << 32) | b[lb])
        ta, tb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b = (np.searchsorted(e, shared, "right").tolist() for e in (end_a, end_b))
        each, pa_, pb_ = [], 0, 0
        for qa, qb in zip(cut_a, cut_b):
            each.append(f"{ta[pa_]}|{tb[pb_]}" if qa - pa_ == 1 == qb - pb_ else f"{','.join(ta[pa_:qa])}|{','.join(tb[pb_:qb])}")
            pa_, pb_ = qa, qb
        edge = np.searchsorted(own_group, np.arange(n + 1)).tolist()
        self.groups += [";".join(each[x:y]) for x, y in zip(edge, edge[1:])]


def raw(x: np.ndarray, kind: str = "<i4") -> bytes:
    return x.astype(kind).tobytes()


def narrow(rows: np.ndarray) -> bytes:
    """Rows of numbers from 0 on, each in the least width that holds it, behind its width in bytes."""
    out = []
    for x in rows:
        width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w - (w == 8)))
        out += [bytes([width]), x.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def wide(data: bytes, rows: int, n: int) -> np.ndarray:
    """The numbers of :func:`narrow`."""
    out, at = np.empty((rows, n), np.int64), 0
    for i in range(rows):
        width = data[at]
        out[i] = np.frombuffer(data, f"<u{width}", n, at + 1)
        at += 1 + width * n
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte: all lowest bytes, then all second ones, as far as there are any."""
    held = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return b"".join(held[:, i].tobytes() for i in range(used)) + bytes([used])


def from_planes(data: bytes) -> np.ndarray:
    used = data[-1]
    out = np.frombuffer(data, np.uint8, len(data) - 1).reshape(used, -1)
    held = np.zeros(out.shape[1], np.int64)
    for i in range(used):
        held |= out[i].astype(np.int64) << (8 * i)
    return held


_CHUNKS = "kind int, chunk long, bucket int, doc_id long, ids binary, segments array<string>, times binary"


def chunked(docs: DataFrame, first_path: str, second_path: str, bits: int, chunk_chars: int) -> DataFrame:
    """Kind 0: a document's segments as numbers within its chunk. Kind 1: a chunk's segments of one bucket, numbered
    on from bucket to bucket, and how often they occur."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("segments", pa.list_(pa.string())), ("times", pa.binary())])

    def flush(chunk: int, ids: list, local: list[np.ndarray], numbers: Numbers) -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in names), np.uint64, len(names)) >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        times = np.zeros(len(names), np.int64)
        for lo in range(0, len(ids), 500):
            packed = []
            for x in local[lo : lo + 500]:
                now = place[x]
                np.add.at(times, now, 1)
                packed.append(planes(now))
            yield rows(0, chunk, [None] * len(packed), ids[lo : lo + 500], packed, [None] * len(packed), [None] * len(packed))
        found, start = np.unique(bucket[order], return_index=True)
        stop = [*start[1:].tolist(), len(order)]
        order = order.tolist()
        for b, x, y in zip(found.tolist(), start.tolist(), stop):
            yield rows(1, chunk, [b], [None], [None], [[names[i] for i in order[x:y]]], [narrow(times[None, x:y])])

    def rows(kind: int, chunk: int, bucket: list, doc_id: list, ids: list, segments: list, times: list) -> pa.RecordBatch:
        n = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([kind] * n, [chunk] * n, bucket, doc_id, ids, segments, times), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, chunk = worker_encoders(first_path, second_path), TaskContext.get().partitionId() << 33
        ids, local, numbers, chars = [], [], Numbers(), 0
        for batch in batches:
            for piece in text_slices(batch, 1):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if ids and chars + len(text or "") > chunk_chars:
                        yield from flush(chunk, ids, local, numbers)
                        ids, local, numbers, chars, chunk = [], [], Numbers(), 0, chunk + 1
                    ids.append(doc_id)
                    local.append(np.fromiter(map(numbers.__getitem__, encoders.segments(text)), np.int32))
                    chars += len(text or "")
        if ids:
            yield from flush(chunk, ids, local, numbers)

    return docs.mapInArrow(run, _CHUNKS)


def by_key(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with one value of column ``key``, in the order they come; a key may come in several runs."""
    for batch in batches:
        k = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield int(k[lo]), batch.slice(lo, hi - lo)


_ALIGNED = "kind int, bucket int, chunk long, place binary, stats binary, groups array<string>, link_segment binary, link_pair binary, pairs array<long>, totals array<long>"


def aligned(lists: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """Kind 0: a bucket's distinct segments, aligned, with the times of its id pairs. Kind 2: a chunk's places among them."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("place", pa.binary()), ("stats", pa.binary()), ("groups", pa.list_(pa.string())), ("link_segment", pa.binary()), ("link_pair", pa.binary()), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])

    def row(**held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held.get(f.name)], f.type) for f in schema], schema=schema)

    def finish(bucket: int, numbers: Numbers, times: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        total = np.zeros(len(numbers), np.int64)
        for place, n in times:
            total[place] += n
        found = Aligned(list(numbers), worker_encoders(first_path, second_path))
        sums = np.zeros(len(found.pairs), np.int64)
        np.add.at(sums, found.link_pair, total[found.link_segment])
        return row(kind=0, bucket=bucket, stats=narrow(np.stack(found.stats)), groups=found.groups, link_segment=raw(found.link_segment), link_pair=raw(found.link_pair), pairs=found.pairs, totals=sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, times = None, Numbers(), []
        for bucket, part in by_key(batches, 0):
            if bucket != now:
                if now is not None:
                    yield finish(now, numbers, times)
                now, numbers, times = bucket, Numbers(), []
            for chunk, segments, n in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                place = np.fromiter(map(numbers.__getitem__, segments.as_py()), np.int64, len(segments))
                times.append((place, wide(n, 1, len(place))[0]))
                yield row(kind=2, bucket=bucket, chunk=chunk, place=raw(place))
        if now is not None:
            yield finish(now, numbers, times)

    width = shuffle_width(lists.sparkSession)
    return lists.select("bucket", "chunk", "segments", "times").repartition(width, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _ALIGNED)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, total, best) over the corpus: how many links hold the pair, and whether none of its second id has more."""
    each = held.filter("kind = 0").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("total"))
    second = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("total") == F.max("total").over(second))


_RESULTS = "kind int, chunk long, bucket int, stats binary, groups array<string>"


def results(held: DataFrame, counts: DataFrame) -> DataFrame:
    """For each chunk and bucket: the six numbers and the groups of the chunk's segments, in the chunk's order."""
    own = held.filter("kind = 0").select("bucket", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "x")).select("bucket", "at", F.col("x.pairs").alias("pair"))
    known = own.join(counts, "pair").select("bucket", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), "total", "best")
    rest = held.select("bucket", "kind", F.col("chunk").alias("at"), "place", "stats", "groups", "link_segment", "link_pair")
    every = rest.unionByName(known, allowMissingColumns=True).select("bucket", "kind", "at", "total", "best", "place", "stats", "groups", "link_segment", "link_pair")
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("stats", pa.binary()), ("groups", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("alignment")
        now, held, totals, table, groups = None, None, [], None, None
        for bucket, part in by_key(batches, 0):
            if bucket != now:
                now, totals, table = bucket, [], None
            kinds = part.column(1).to_numpy()
            for k in np.unique(kinds).tolist():
                rows = part.filter(pa.array(kinds == k))
                if k == 0:
                    held = {c: rows.column(rows.schema.get_field_index(c))[0] for c in ("stats", "groups", "link_segment", "link_pair")}
                elif k == 1:
                    totals.append((rows.column(3).to_numpy(), rows.column(4).to_numpy(zero_copy_only=False)))
                else:
                    if table is None:
                        stats = wide(held["stats"].as_py(), 4, len(held["groups"]))
                        segment, pair = (np.frombuffer(held[c].as_py(), "<i4") for c in ("link_segment", "link_pair"))
                        total, best = (np.concatenate(x) for x in zip(*totals)) if totals else (np.zeros(0, np.int64), np.zeros(0, bool))
                        more = np.zeros((2, stats.shape[1]), np.int64)
                        np.add.at(more[0], segment, best[pair].astype(np.int64))
                        np.add.at(more[1], segment, total[pair])
                        table, groups = np.concatenate([stats, more]), held["groups"].values
                    for chunk, place in zip(rows.column(2).to_pylist(), rows.column(5).to_pylist()):
                        place = np.frombuffer(place, "<i4")
                        out = [0], [chunk], [bucket], [narrow(table[:, place])]
                        taken = groups.take(pa.array(place))
                        texts = pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)
                        yield pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(out, schema)), texts], schema=schema)

    width = shuffle_width(held.sparkSession)
    return every.repartition(width, "bucket").sortWithinPartitions("bucket", "kind", "at").mapInArrow(run, _RESULTS)


def composed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document from its chunk's results."""
    every = found.unionByName(docs.select(F.lit(1).alias("kind"), "chunk", "doc_id", "ids"), allowMissingColumns=True).select("chunk", "kind", "bucket", "stats", "groups", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("alignment")
        now, parts, groups, table = None, [], [], None
        for chunk, part in by_key(batches, 0):
            if chunk != now:
                now, parts, groups, table = chunk, [np.zeros((len(STATS), 0), np.int64)], [], None
            kinds = part.column(1).to_numpy()
            for row in part.filter(pa.array(kinds == 0)).select(["stats", "groups"]).to_pylist():
                parts.append(wide(row["stats"], len(STATS), len(row["groups"])))
                groups += row["groups"]
            rows = part.filter(pa.array(kinds == 1))
            if rows.num_rows:
                if table is None:
                    table, parts = np.concatenate(parts, axis=1), []
                ids = list(map(from_planes, rows.column(6).to_pylist()))
                sums = np.array([table[:, x].sum(axis=1) for x in ids], np.int64).reshape(-1, len(STATS))
                text = [hashlib.sha256(";".join(map(groups.__getitem__, x.tolist())).encode()).hexdigest() if n else "" for x, n in zip(ids, sums[:, 0].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(5), *(pa.array(sums[:, i]) for i in range(len(STATS))), pa.array(text, pa.string())], names=["doc_id", *STATS, "groups_sha256"])

    width = shuffle_width(docs.sparkSession)
    return every.repartition(width, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", groups_sha256 string")


def alignment_digest(df: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that either tokenizer does not give back
    byte by byte, have no tokens: zeros and ''. Repeated rows count and are
    aligned each; an empty table gives no rows. Both tokenizers' files lie
    under the same path on every worker.
    """
    held, found = _aligned(df, first_path, second_path, id_col, text_col, chunk_chars)
    counts = stored(pair_counts(found), "pairs")
    return composed(held.filter("kind = 0"), results(found, counts))


def _aligned(df: DataFrame, first_path: str, second_path: str, id_col: str, text_col: str, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    bits = bits_for(shuffle_width(docs.sparkSession))
    held = stored(chunked(docs, first_path, second_path, bits, chunk_chars), "chunks")
    return held, stored(aligned(held.filter("kind = 1"), first_path, second_path), "aligned")


def token_pairs(df: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(a, b, links, best): the map between both vocabularies: linked ids, their links in the corpus, and whether no other
    id of the first tokenizer has more links with ``b``."""
    _, found = _aligned(df, first_path, second_path, id_col, text_col, chunk_chars)
    split = [F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b")]
    return pair_counts(found).select(*split, F.col("total").alias("links"), "best")
