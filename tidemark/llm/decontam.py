"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so whole documents would have next to no resemblance to an
item. Items are partitioned by size (4, 8, 16, ... shingles). For each size class, documents are cut
into windows of twice the class's size at steps of its size: a run of shingles as long as an item lies
whole in some window, whose resemblance to the item then has a lower bound. Windows and items that
agree in any of ``hashes`` MinHash values are candidates, verified by exact shingle containment in the
whole document. Items of fewer words than a shingle have one shingle of all their words, and are looked up
among the documents' shingles of that length: a class for each length, where the hash itself is the MinHash value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_chunks
from .wordhash import Words, shingle_hashes

#: Items, and bytes of their texts, that are searched in one block; their text and MinHash values go to every task.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20
SMALLEST_CLASS = 4


def shingles(text: str | None, k: int) -> list[bytes]:
    """Distinct word shingles, A-Z lower-cased; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    k = min(k, len(words))
    return list(dict.fromkeys(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


class Index:
    """MinHash values of a block of items, by size class."""

    def __init__(self, items: list[tuple[Any, str | None]], k: int, hashes: int, seed: int = 7):
        self.k = k
        full = [(i, x) for i, t in items if (x := shingles(t, k))]
        self.ids = [i for i, _ in full]
        self.sets = [x for _, x in full]
        #: words of each item's shingles: k, or all of a shorter item's
        self.words = [x[0].count(b" ") + 1 for x in self.sets]
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in sorted({w for w in self.words if w < k}):
            members = [n for n, w in enumerate(self.words) if w == size]
            lines = [Words(raw := np.frombuffer(self.sets[n][0], np.uint8), np.array([0, len(raw)])) for n in members]
            h = np.array([w.grams(size)[0][0] for w in lines], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short.append((size, h[order], np.array(members)[order]))
        draw = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, (2, hashes), dtype=np.uint64)
        self.a, self.b = draw[0] * np.uint64(2) + np.uint64(1), draw[1]
        by_class: dict[int, list[int]] = {}
        for n, s in enumerate(self.sets):
            if self.words[n] < k:
                continue
            size = SMALLEST_CLASS
            while size < len(s):
                size *= 2
            by_class.setdefault(size, []).append(n)
        self.classes = []
        for size, members in sorted(by_class.items()):
            values = np.empty((hashes, len(members)), np.uint64)
            for j, n in enumerate(members):
                raw = np.frombuffer(b"\n".join(self.sets[n]), np.uint8)
                words = Words(raw, np.array([0, len(raw)]))
                own, inside = shingle_hashes(words, k, np.cumsum([0, *[len(x) + 1 for x in self.sets[n][:-1]]]))
                values[:, j] = (own[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1)
            bits = max(14, min(22, (64 * len(members)).bit_length()))
            table = np.zeros((hashes, 1 << bits), bool)
            np.put_along_axis(table, (values >> np.uint64(64 - bits)).astype(np.int64), True, axis=1)
            flat, item = values.ravel(), np.tile(np.array(members), hashes)
            order = np.argsort(flat, kind="stable")
            self.classes.append((size, bits, table, flat[order], item[order]))
        self.base = min((c[0] for c in self.classes), default=0)


def _runs(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of ``step`` places within consecutive runs of ``counts`` places, and blocks of each run."""
    blocks = -(-counts // step)
    first = np.cumsum(counts) - counts
    number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(first, blocks) + number * step, blocks


def candidates(index: Index, raw: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs of which some window and the item agree in a MinHash value."""
    out: set[tuple[int, int]] = set()
    words = Words(raw, offsets, fold=True)
    if not len(words):
        return out
    for size, values, items in index.short:
        grams, inside = words.grams(size)
        of, seen = words.of_text()[inside], grams[inside]
        lo, hi = np.searchsorted(values, seen, "left"), np.searchsorted(values, seen, "right")
        for j in np.flatnonzero(hi > lo):
            out.update((int(of[j]), int(x)) for x in items[lo[j] : hi[j]])
    if not index.classes:
        return out
    h, inside = shingle_hashes(words, index.k)
    h = h[inside]
    counts = np.maximum(words.counts - index.k + 1, np.minimum(words.counts, 1))
    starts, blocks = _runs(counts, index.base)
    mins = np.empty((len(index.a), len(starts)), np.uint64)
    buffer = np.empty_like(h)
    for i, (a, b) in enumerate(zip(index.a, index.b, strict=True)):
        np.multiply(h, a, out=buffer)
        np.add(buffer, b, out=buffer)
        mins[i] = np.minimum.reduceat(buffer, starts)
    for size, bits, table, values, items in index.classes:
        at, n = _runs(blocks, size // index.base)
        low = np.minimum.reduceat(mins, at, axis=1) if size > index.base else mins
        text = np.repeat(np.arange(len(n)), n)
        same = text[1:] == text[:-1]
        window = low.copy()
        np.minimum(low[:, :-1], low[:, 1:], out=window[:, :-1], where=same[None, :])
        row = np.arange(len(index.a))[:, None]
        hit = np.nonzero(table[row, (window >> np.uint64(64 - bits)).astype(np.int64)])
        seen, of = window[hit], text[hit[1]]
        lo, hi = np.searchsorted(values, seen, "left"), np.searchsorted(values, seen, "right")
        for j in np.flatnonzero(hi > lo):
            out.update((int(of[j]), int(x)) for x in items[lo[j] : hi[j]])
    return out


def verified(index: Index, text: str, items: list[int], threshold: float) -> list[tuple[int, int, int]]:
    """(item, its shingles in the text, its shingles) of the items that the whole text contains."""
    wanted = set().union(*[index.sets[i] for i in items])
    words = text.encode("utf-8", "surrogatepass").lower().split()
    there = set().union(*[wanted.intersection(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) for k in {index.words[i] for i in items}])
    out = []
    for i in items:
        shared = sum(s in there for s in index.sets[i])
        if shared >= threshold * len(index.sets[i]):
            out.append((i, shared, len(index.sets[i])))
    return out


def _found(index: Index, column: pa.Array, threshold: float) -> dict[int, list[tuple[int, int, int]]]:
    out: dict[int, list[tuple[int, int, int]]] = {}
    for lo, _, raw, offsets in text_chunks(column):
        by_text: dict[int, list[int]] = {}
        for t, i in candidates(index, raw, offsets):
            by_text.setdefault(lo + t, []).append(i)
        for t, items in by_text.items():
            if hits := verified(index, column[t].as_py(), sorted(items), threshold):
                out[t] = hits
    return out


def _passes(bench: DataFrame, item_col: str, text_col: str, k: int, hashes: int):
    """An index for each block of items; blocks are as many as the benchmark needs."""
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    blocks = max(-(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    for b in range(blocks):
        part = bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
        # a block is about ITEMS_PER_PASS items and BYTES_PER_PASS bytes, dealt by text and id
        rows = part.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else part.collect()
        yield bench.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows], k, hashes))


def contaminated(docs: DataFrame, bench: DataFrame, k: int = 5, threshold: float = 0.8, hashes: int = 64, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item_id, n_shared, n_item, containment``: which items a document contains.

    An item is contained if at least ``threshold`` of its distinct shingles of ``k`` words (A-Z
    lower-cased) are anywhere in the document. Null and empty texts and items contain nothing and are in
    nothing; an item of fewer than ``k`` words is one shingle of all its words. Ids may be of any type. Rows that
    repeat give repeated results. The benchmark is searched in blocks of about ``ITEMS_PER_PASS`` items and
    ``BYTES_PER_PASS`` bytes, each a pass over the documents
    without a shuffle; an empty table gives no rows. Other columns aren't read.
    """
    item_type = bench.schema[item_col].dataType
    arrow_item = to_arrow_type(item_type)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, n_shared long, n_item long, containment double"
    rows = docs.select(id_col, text_col)
    out = docs.sparkSession.createDataFrame([], schema)
    for handle in _passes(bench, item_col, item_text_col, k, hashes):

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index = handle.value
            for batch in batches:
                hits = [(t, *h) for t, hs in sorted(_found(index, batch.column(1), threshold).items()) for h in hs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([index.ids[h[1]] for h in hits], arrow_item),
                        pa.array([h[2] for h in hits], pa.int64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([h[2] / h[3] for h in hits], pa.float64()),
                    ],
                    names=[id_col, "item_id", "n_shared", "n_item", "containment"],
                )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, k: int = 5, threshold: float = 0.8, hashes: int = 64, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item in the sense of ``contaminated``; all columns stay."""
    out = docs
    at = docs.columns.index(text_col)
    for handle in _passes(bench, item_col, item_text_col, k, hashes):

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[list(_found(handle.value, batch.column(at), threshold))] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
