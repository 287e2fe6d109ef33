"""Packing by concatenating and cutting.

Pass one tokenises every document once and stores ids with their running total
inside the partition; prefix sums over the partitions' totals then give each
document its place in one endless token stream; pass two cuts that stream into
windows of a fixed length and writes one boundary record per piece.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, release_memory, stored, worker_cache

#: Entries of each of the two generations of a worker's cache from white-space separated chunk to its ids.
CACHE_ENTRIES = 500_000
#: Punctuation that is cut off a chunk's end; a run of it is one pre-token.
TAIL = ".,;:!?"
#: Texts on which a tokenizer that can be taken chunk by chunk gives the same ids as on the whole text.
PROBES = ("Two words", "Ends. Here, THERE", "two  blanks\n\tand lines ", " it's 3.14 don't, x'll.", "É à la Ærø ß µm 日本. 'quoted' (a-b) a/b <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb")


class ChunkEncoder(dict):
    """Ids of chunks as little-endian unsigned 32-bit integers; a text's ids are those of its chunks in order.

    Where white space ends every pre-token of a tokenizer and is then dropped,
    encoding chunk by chunk equals encoding the text whole. A chunk of Latin-1
    letters with or without punctuation behind it is one pre-token or two,
    which go to the tokenizer's model directly; all others are encoded in full.
    Whether a tokenizer is of that kind is tried on PROBES; texts of any other
    kind are encoded whole (``chunked`` is then false).
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0xAA, 0x100) if chr(i).isalpha()}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        try:
            self.chunked = all(self._by_chunks(t) == self._whole(t) for t in PROBES)
        except Exception:  # a model without the methods that chunks go to
            self.chunked = False

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, chunk: str) -> bytes:
        core = chunk.rstrip(TAIL)
        if not core.isalpha():
            return self._whole(chunk)
        tail = chunk[len(core) :]
        if tail not in self.tails:
            self.tails[tail] = self._whole(tail)
        word = core.lower()
        if not core.isascii():
            if max(core) > "\u00ff":
                return self._whole(chunk)
            word = word.translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)]) + self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return list(map(self._by_chunks, texts))

    def _by_chunks(self, text: str) -> bytes:
        # ASCII blanks only: other white space stays inside a chunk, where the tokenizer deals with it
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def worker_encoder(path: str) -> ChunkEncoder:
    held = worker_cache("packing")
    if path not in held:
        release_memory()
        held[path] = ChunkEncoder(path)
    return held[path]


def tokenised(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, ord, doc_id, ids, n, local): ids as little-endian bytes, local the tokens before them in the partition."""
    docs = pick(df, doc_id=id_col, text=text_col)
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, total = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                ids = [x + end for x in encoder.encode(["" if t is None else t for t in piece.column(1).to_pylist()])]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                local = total + np.cumsum(n) - n
                columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), piece.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(local)]
                row, total = row + len(ids), total + int(n.sum())
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, ord long, doc_id long, ids binary, n long, local long")


def placed(tokens: DataFrame) -> DataFrame:
    """Each stored document with its start in the global stream.

    The broadcast side has one row per partition of the stored table, which
    the driver holds anyway.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("local")).drop("base", "local")


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """Boundary records: one row per document and window that it reaches into, with the ids in between."""
    windows = docs.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {length}, (at + n - 1) div {length})")))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    windows = windows.withColumn("start", start)
    windows = windows.withColumn("length", F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at")) - F.col("start"))
    return windows.withColumn("offset", F.col("at") + F.col("start") - F.col("sequence_id") * length).withColumn(
        "piece", F.expr("substring(ids, int(start * 4 + 1), int(length * 4))")
    )


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces with their ids as little-endian bytes: (doc_id, start, length, piece, doc_tokens, sequence_id, offset).

    All sequences are full but the last, so padding is below one sequence in
    total. Null or empty text: the end id alone. Repeated rows are packed each;
    an empty table gives no pieces.
    """
    tokens = stored(tokenised(df, id_col, text_col, tokenizer_path, end_id), "tokens")
    return pieces(placed(tokens), length).select("doc_id", "start", "length", "piece", F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def packing_digest(df: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """:func:`pack` with a checksum in place of the ids."""
    out = pack(df, tokenizer_path, **how)
    return out.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
