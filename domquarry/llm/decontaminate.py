"""Benchmark decontamination: one FM-index a shard of documents, searched backwards for the windows of benchmark items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is 13 consecutive words of an
item; an item of fewer words, but not none, is one window. A shard is a run of documents of one partition, of about
SHARD_WORDS words, and at least one document: nothing is shuffled. A word that no window holds can't be part of an
occurrence, so a shard's index keeps only runs of window words that are long enough to hold a window, with a separator
after each; all other text needs no index. Positions of occurrences become spans of words, which are merged.

The benchmark is taken in blocks of at most BLOCK_WORDS words; only a block is ever on the driver or broadcast. With more
than one block the documents are read once for each and their spans merged by shuffle.

Cases: null or empty text has no words and isn't contaminated; null items are none; rows that repeat an item count once,
rows that repeat a doc_id are each judged; equal windows of several items hit for all of these.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_binary, extended, limit_batches, lut, materialize, slices, span_hash, tidy, word_spans
from .fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 19


def words_of(column: pa.Array):
    """(first row, hashes of the words, where each row's words begin, starts and ends in bytes, offsets) for each slice of the column."""
    for a, _, data, off in slices(column):
        low = LOWER[data]
        start, end, first = word_spans(low, off, lut("alnum"))
        yield a, span_hash(low, start, end), first, start, end, off


class Windows:
    """The distinct windows of a block of items, over symbols of their words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        by: dict[bytes, set[int]] = {}
        for item, hashes in items:
            s = np.searchsorted(self.vocabulary, hashes) + 1
            size = min(window, len(s))
            for i in range(len(s) - size + 1 if size else 0):
                by.setdefault(s[i : i + size].astype(np.int32).tobytes(), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(k) // 4 for k in by}):
            own = [(np.frombuffer(k, np.int32), sorted(v)) for k, v in by.items() if len(k) == 4 * size]
            self.by_length[size] = (np.stack([k for k, _ in own]), [v for _, v in own])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def search_shard(symbols: np.ndarray, first: np.ndarray, windows: Windows) -> tuple[list[np.ndarray], list[list[int]]]:
    """symbols of a shard's words, where each document's begin: merged spans (rows of start, end) and items by document."""
    n_docs = len(first) - 1
    spans, items = [np.zeros((0, 2), np.int64)] * n_docs, [[] for _ in range(n_docs)]
    if not windows.by_length or not len(symbols):
        return spans, items
    known = np.zeros(len(symbols) + 1, bool)
    known[1:] = symbols > 0
    cut = np.zeros(len(symbols) + 1, bool)
    cut[first[:-1][first[:-1] < len(symbols)]] = True
    edge = np.flatnonzero(known[1:] & (~known[:-1] | cut[:-1]))  # runs of window words, within documents
    stop = np.flatnonzero(known[1:] & (np.append(~known[2:], True) | np.append(cut[1:-1], True))) + 1
    long = stop - edge >= min(windows.by_length)
    edge, size = edge[long], (stop - edge)[long]
    if not len(edge):
        return spans, items
    begin = np.cumsum(size + 1) - (size + 1)  # in the index; each run is followed by a separator
    total = int((size + 1).sum())
    source = np.arange(total) - np.repeat(begin - edge, size + 1)
    separator = begin + size
    text = symbols[np.minimum(source, len(symbols) - 1)] + 1  # symbol 1 separates
    text[separator] = 1
    index = FMIndex(text, len(windows.vocabulary) + 2)
    marks = np.zeros(len(symbols) + 1, np.int64)
    pairs: list[np.ndarray] = []
    for length, (patterns, owners) in windows.by_length.items():
        which, at = index.locate(*index.search(patterns + 1))
        at = source[at]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        doc = np.searchsorted(first, at, "right") - 1
        seen = np.unique(doc * len(owners) + which)
        for d, w in zip(seen // len(owners), seen % len(owners), strict=True):
            items[d] += owners[w]
    hit = np.cumsum(marks[:-1]) > 0
    flags = np.zeros(len(symbols) + 2, bool)
    flags[1:-1] = hit
    bounds = np.zeros(len(symbols) + 1, bool)
    bounds[first] = True
    a = np.flatnonzero(flags[1:-1] & (~flags[:-2] | bounds[:-1]))
    b = np.flatnonzero(flags[1:-1] & (~flags[2:] | bounds[1:])) + 1
    doc = np.searchsorted(first, a, "right") - 1
    for d in np.unique(doc):
        own = doc == d
        spans[d] = np.stack([a[own], b[own]], 1) - first[d]
    return spans, [sorted(set(x)) for x in items]


def _searcher(sent, text_at: int, extra: int, cut: bool = False):
    """Over batches: the first ``extra`` columns, n_words, spans and items; if ``cut``, those columns of uncontaminated rows, without spans."""

    def run(batches):
        windows: Windows = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []  # symbols and word counts, until a shard is full
        rest: list[pa.RecordBatch] = []
        size = 0

        def flush():
            symbols = np.concatenate([s for s, _ in held])
            counts = np.concatenate([c for _, c in held])
            first = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=first[1:])
            spans, items = search_shard(symbols, first, windows)
            if cut:
                whole = pa.Table.from_batches(rest).combine_chunks()
                hit = np.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans])
                whole = _without_spans(whole, text_at, spans).filter(pa.array((hit == 0) | (20 * hit < counts)))
                held.clear()
                rest.clear()
                return whole.to_batches()
            flat = np.concatenate(spans)
            offs = np.zeros(len(spans) + 1, np.int32)
            np.cumsum([len(s) for s in spans], out=offs[1:])
            span_column = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
            whole = pa.Table.from_batches(rest)
            out = pa.Table.from_arrays([*whole.columns, pa.array(counts), span_column, pa.array(items, pa.list_(pa.int64()))], [*whole.column_names, "n_words", "spans", "items"])
            held.clear()
            rest.clear()
            return out.combine_chunks().to_batches()

        for batch in batches:
            a = 0
            for row, hashes, first, _, _, off in words_of(batch.column(text_at)):
                held.append((windows.symbols(hashes), np.diff(first)))
                size += len(hashes)
                if size >= SHARD_WORDS:
                    rest.append(pa.RecordBatch.from_arrays([batch.column(i).slice(a, row + len(off) - 1 - a) for i in range(extra)], batch.schema.names[:extra]))
                    a, size = row + len(off) - 1, 0
                    yield from flush()
            if a < batch.num_rows:
                rest.append(pa.RecordBatch.from_arrays([batch.column(i).slice(a) for i in range(extra)], batch.schema.names[:extra]))
        if held:
            yield from flush()

    return run


def _blocks(benchmark: DataFrame, window: int):
    """The benchmark's windows, at most about BLOCK_WORDS words at a time. A longer item is cut with an overlap of window - 1 words."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        hashes = np.concatenate([h for _, h, *_ in words_of(pa.array([r["text"]]))] or [np.zeros(0, np.uint64)])
        step = max(window, BLOCK_WORDS)
        for i in range(0, max(1, len(hashes) - window + 1), step):
            piece = hashes[i : i + step + window - 1]
            if len(piece):
                held.append((r["item_id"], piece))
                size += len(piece)
            if size >= BLOCK_WORDS:
                yield Windows(held, window)
                held, size = [], 0
    if held:
        yield Windows(held, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with n_words, spans (merged; of words, end exclusive) and items; own columns of these names go."""
    own = [c for c in keep or docs.columns if c not in ("n_words", "spans", "items")]
    blocks = _blocks(benchmark, window)
    block, more = next(blocks, Windows([], window)), next(blocks, None)
    if more is None:
        return _search(docs, block, own)
    # rows are numbered, as ids may repeat or lack; the numbers are written, so that all blocks see the same
    numbered = docs.select(*own, *([] if "text" in own else ["text"]))
    numbered = materialize(numbered.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    union = None
    for one in itertools.chain([block, more], blocks):
        part = materialize(_search(numbered, one, ["_row"]), "decontaminate-part")
        union = part if union is None else union.unionByName(part)
    merged = union.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.select("_row", "n_words", _merge_spans("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    return numbered.join(merged, "_row").select(*own, "n_words", "spans", "items")


def _search(docs: DataFrame, windows: Windows, own: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(windows)  # a block: BLOCK_WORDS bounds its size
    limit_batches(docs.sparkSession)
    passed = docs.select(*own, *([] if "text" in own else ["text"]))
    schema = extended(docs.select(*own), "n_words long, spans array<struct<start:long,end:long>>, items array<long>")
    return passed.mapInArrow(tidy(_searcher(sent, passed.columns.index("text"), len(own))), schema)


def _merge_spans(column: str):
    """Overlapping or touching spans of an array as one."""
    struct = "struct<start:long,end:long>"
    return F.expr(
        f"""aggregate(array_sort({column}), cast(array() as array<{struct}>), (acc, s) ->
            CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= s.start
                 THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
                 ELSE concat(acc, array(s)) END)"""
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    found = find_contamination(docs, benchmark, window, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def cut_spans(text: bytes, spans: np.ndarray) -> bytes:
    """text without the bytes from the first to the last word of each span, and without one of two blanks left touching."""
    data = np.frombuffer(text, np.uint8)
    start, end, _ = word_spans(LOWER[data], np.array([0, len(data)]), lut("alnum"))
    out, at = [], 0
    for first, stop in spans.tolist():
        a, b = int(start[first]), int(end[stop - 1])
        while b < len(text) and text[b] not in b" \n" and text[b] < 0x80:  # the punctuation that ends the span
            b += 1
        out.append(text[at:a])
        at = b + 1 if b < len(text) and text[b : b + 1] == b" " and (a == 0 or text[a - 1 : a] in (b" ", b"\n")) else b
    return b"".join(out) + text[at:]


def _without_spans(table: pa.Table, text_at: int, spans: list) -> pa.Table:
    """The table with spans cut out of its texts; null texts stay null."""
    if not any(len(s) for s in spans):
        return table
    column = table.column(text_at)
    texts = [cut_spans(t.as_py(), s) if len(s) else t.as_py() for t, s in zip(as_binary(column), spans, strict=True)]
    clean = pa.array(texts, pa.binary(), mask=np.asarray(column.combine_chunks().is_null())).cast(column.type)
    return table.set_column(text_at, table.column_names[text_at], clean)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; those with a smaller share of hit words lose the hit spans and stay."""
    own = docs.columns
    blocks = _blocks(benchmark, window)
    block, more = next(blocks, Windows([], window)), next(blocks, None)
    if more is None:
        limit_batches(docs.sparkSession)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = docs.mapInArrow(tidy(_searcher(sent, own.index("text"), len(own), True)), docs.schema)
    else:
        found = find_contamination(docs.select(F.struct(*own).alias("_own"), "text"), benchmark, window)
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
        kept = found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("_own.*", F.col("spans").alias("_spans"))

        def run(batches):
            for batch in batches:
                spans = [np.array([[s["start"], s["end"]] for s in x], np.int64).reshape(-1, 2) for x in batch.column(len(own)).to_pylist()]
                yield from _without_spans(pa.Table.from_batches([batch.select(list(range(len(own))))]), own.index("text"), spans).combine_chunks().to_batches()

        out = kept.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
