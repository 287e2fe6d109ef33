"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of normalised benchmark words become the automaton's patterns; each
text is normalised and scanned once; hits map back to words and to character
offsets of the original text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, pick, worker_cache

#: UTF-8 bytes to normalised bytes: A-Z lowered, every other ASCII byte that is no letter or digit a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Most bytes of benchmark text that are broadcast; the automaton takes about 60 times as much.
MAX_BENCHMARK_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words; all words of a shorter text; none of an empty one."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """Automaton over all items' windows. Patterns and texts have a blank at either end, so hits are whole words."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).add(item)
        self.auto = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
        if owners:
            self.auto.make_automaton()
        self.any = bool(owners)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [from, to) that hits cover, and the items they belong to."""
        if not self.any or not words:
            return [], set()
        found = list(self.auto.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return [], set()
        ends, at = [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at)  # place of the blank after the word
        spans, items = [], set()
        for place, (n, ids) in found:
            items.update(ids)
            last = bisect_left(ends, place) + 1
            spans.append((last - n, last))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    if not ranges:
        return []
    flat, at, places = text.encode("utf-8", "surrogatepass").translate(NORMAL), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(count(places[a][0]), count(places[b - 1][1])) for a, b in ranges]


def benchmark_items(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = MAX_BENCHMARK_BYTES) -> list[tuple[str, str | None]]:
    """The items on the driver, if their texts together stay within ``limit`` bytes; else ValueError."""
    items = pick(bench, item=item_col, text=text_col).select(F.col("item").cast("string"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"benchmark texts have {size} bytes; the automaton is built for {limit} at most: scan them in parts")
    return [("" if r[0] is None else r[0], r[1]) for r in items.collect()]


def shared_scanner(bench: DataFrame, size: int) -> Callable[[], Scanner]:
    """A function for workers that gives the scanner, built once in each worker."""
    shared = bench.sparkSession.sparkContext.broadcast(benchmark_items(bench))
    key = f"{shared._jbroadcast.id()}-{size}"

    def scanner() -> Scanner:
        held = worker_cache("decontamination")
        if key not in held:
            held.clear()
            held[key] = Scanner(shared.value, size)
        return held[key]

    return scanner


def scan_documents(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings), and with ``spans`` the hit
    code point ranges of the original text.

    Null or empty text has no words and no hits. Items without words match
    nothing. Repeated rows are scanned each; an empty benchmark contaminates nothing.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    scanner_of = shared_scanner(bench, size)
    kind = "doc_id long, n_words long, n_hit long, items array<string>" + (", spans array<array<long>>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        for batch in batches:
            n_words, n_hit, items, places = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                words = words_of(text)
                ranges, owners = scanner.scan(words)
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in ranges))
                items.append(sorted(owners))
                if spans:
                    places.append([list(x) for x in char_spans(text, ranges)])
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "items"]
            if spans:
                out, names = [*out, pa.array(places, pa.list_(pa.list_(pa.int64())))], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def decontamination_digest(df: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The contract's columns from :func:`scan_documents`."""
    found = scan_documents(df, bench, **how)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, bench: DataFrame, text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose texts hold no benchmark window."""
    at = df.columns.index(text_col)
    scanner_of = shared_scanner(bench, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        for batch in batches:
            clean = [not scanner.scan(words_of(t.as_py()))[0] for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return kept_rows(df, run)
