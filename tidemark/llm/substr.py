"""Removal of word sequences that also stand earlier in the corpus, found with FM-indexes of shards.

Every window of ``length`` words has a minimizer, the least hash of its word 4-grams. Runs of windows
with one minimizer form a segment, and a segment goes to the shard of its minimizer: equal windows
meet in one shard, and each window is in one shard only. Windows with a minimizer that very many segments have are
segments of their own and are dealt by the hash of the whole window. A shard indexes its distinct segments and streams
them through backward search; its matching statistics alone say which windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, text_chunks
from .fmindex import FMIndex, matching_statistics
from .wordhash import Words

GRAM = 4
#: Bytes of distinct segments after which a task sends what it has gathered.
FLUSH_BYTES = 24 << 20
#: Shards for each shuffle partition, so that chance puts near equal loads together.
SHARDS_PER_PARTITION = 4
#: One row in so many is looked at for minimizers of very many segments, and those with more than one segment in HOT_SHARE
#: are such: HOT_SHARE at most. That says where windows meet, not which are removed.
SAMPLE, HOT_SHARE, HOT_SEGMENTS = 64, 2000, 256
_NULL_ID = -(1 << 63)
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_PARCELS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_NO_MINIMIZERS = np.zeros(0, np.uint64)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(a[i : i + width]); shorter by width - 1."""
    span = 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def segments(words: Words, length: int, hot: np.ndarray = _NO_MINIMIZERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, minimizer) of each run of windows with one minimizer in one text.

    Windows with one of the ``hot`` minimizers (sorted) have the hash of the whole window in its place.
    """
    n = len(words)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    gram = min(GRAM, length)
    least = _sliding_min(words.grams(gram)[0][: n - gram + 1], length - gram + 1)
    if len(hot):
        near = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        which = np.flatnonzero(hot[near] == least)
        if len(which):
            least[which] = words.grams(length)[0][which]
    text = words.of_text()
    inside = text[: n - length + 1] == text[length - 1 :]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1 : len(inside)] != text[: len(inside) - 1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    first = np.flatnonzero(fresh)
    return first, np.flatnonzero(last) + length, least[first]


class Gathered:
    """Distinct segments of a task with their earliest place (id, hash of text, first word).

    Before anything is shuffled, a later copy of a whole segment becomes a span. Of rows that have an id in common
    neither is earlier, so the shard gets the places of both.
    """

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[Any, int, int, int]] = {}
        self.more: list[tuple[bytes, tuple[Any, int, int, int]]] = []
        self.bytes = 0
        self.spans: list[tuple[Any, int, int, int]] = []

    def add(self, segment: bytes, minimizer: int, doc: Any, th: int, start: int) -> None:
        here = (doc, th, start, minimizer)
        old = self.seen.get(segment)
        if old is None:
            self.seen[segment] = here
            self.bytes += len(segment)
            return
        if here == old:
            return
        if doc == old[0] and th != old[1]:
            self.more.append((segment, here))
            self.bytes += len(segment)
            return
        if here[:3] < old[:3]:
            self.seen[segment], here = here, old
        stop = here[2] + segment.count(b" ") + 1
        last = self.spans[-1] if self.spans else None
        if last and last[:2] == here[:2] and last[2] <= here[2] <= last[3]:
            self.spans[-1] = (*last[:3], max(last[3], stop))
        else:
            self.spans.append((*here[:3], stop))

    def items(self) -> Iterator[tuple[bytes, tuple[Any, int, int, int]]]:
        yield from self.seen.items()
        yield from self.more


def _ids(values: list) -> Any:
    return np.array(values, np.int64) if values and isinstance(values[0], int) else values


def _pack(items: list[tuple[bytes, tuple[Any, int, int, int]]]) -> bytes:
    import zstandard

    docs, th, starts = _ids([p[0] for _, p in items]), np.array([p[1] for _, p in items], np.int64), np.array([p[2] for _, p in items], np.int32)
    return zstandard.compress(pickle.dumps((docs, th, starts, b"\n".join(k for k, _ in items)), 5), 4)


def _unpack(payload: bytes) -> Iterable[tuple[bytes, Any, int, int]]:
    import zstandard

    docs, th, starts, text = pickle.loads(zstandard.decompress(payload))
    return zip(text.split(b"\n"), docs if isinstance(docs, list) else docs.tolist(), th.tolist(), starts.tolist(), strict=True)


def _cut(length: int, shards: int, hot: np.ndarray, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        turn = 0

        def parcels() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for item in gathered.items():
                by.setdefault(item[1][3] % shards, []).append(item)
            for shard, items in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([1], pa.int32()), pa.array([_pack(items)], pa.binary())], schema=_PARCELS)
            if gathered.spans:
                doc, th, start, stop = zip(*gathered.spans, strict=True)
                spans = pickle.dumps((_ids(list(doc)), np.array(th, np.int64), np.array(start, np.int64), np.array(stop, np.int64)), 5)
                # spans need no shard; they travel along
                yield pa.RecordBatch.from_arrays([pa.array([(turn * 7919 + len(spans)) % shards], pa.int32()), pa.array([0], pa.int32()), pa.array([spans], pa.binary())], schema=_PARCELS)

        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False) if whole else np.array([_text_id(x) for x in batch.column(0).to_pylist()], object)
            hashes = batch.column(1).to_numpy()
            for lo, _, raw, offsets in text_chunks(batch.column(2), CHUNK_BYTES):
                words = Words(raw, offsets)
                first, stop, least = segments(words, length, hot)
                text = np.searchsorted(words.bounds, first, "right") - 1
                line = raw.tobytes().translate(_TO_SPACE)
                docs, ths, starts = ids[lo + text].tolist(), hashes[lo + text].tolist(), (first - words.bounds[text]).tolist()
                for a, b, m, d, h, s in zip(words.starts[first].tolist(), words.stops[stop - 1].tolist(), least.tolist(), docs, ths, starts, strict=True):
                    part = line[a:b]
                    if b"  " in part:
                        part = b" ".join(part.split())
                    gathered.add(part, m, d, h, s)
                if gathered.bytes >= FLUSH_BYTES:
                    yield from parcels()
                    gathered, turn = Gathered(), turn + 1
        yield from parcels()

    return run


def _text_id(value: str | None) -> str:
    """Ids that aren't whole numbers are ordered as text, after a null id."""
    return "" if value is None else f"={value}"


class Shard:
    """The distinct segments of a shard, and the places (segment, id, hash of text, first word) where they stand."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.places: list[tuple[int, Any, int, int]] = []

    def add(self, segment: bytes, doc: Any, th: int, start: int) -> None:
        self.places.append((self.number.setdefault(segment, len(self.number)), doc, th, start))

    def _words(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of the segments' words, their numbers of words, and which may hold a window that stands elsewhere.

        Equal windows have the same least n-gram: they share it with another segment, or have it twice in their own.
        All other segments are left out of the index. A run of segments is hashed at a time.
        """
        hashes, sizes, least, twice = [], [], [], []
        segments_, at = list(self.number), 0
        while at < len(segments_):
            end, total = at, 0
            while end < len(segments_) and total < CHUNK_BYTES:
                total += len(segments_[end])
                end += 1
            raw = np.frombuffer(b"\n".join(segments_[at:end]), np.uint8)
            at = end
            words = Words(raw, np.array([0, len(raw)]))
            n = np.diff(np.searchsorted(words.starts, np.append(np.flatnonzero(raw == 10), len(raw))), prepend=0)
            begins = np.cumsum(n) - n
            bounds = np.stack([begins, begins + np.maximum(n - gram + 1, 1)], 1).ravel()
            grams = np.append(words.grams(gram)[0], np.uint64(0))  # a bound may lie at the end
            low = np.minimum.reduceat(grams, bounds)[::2]
            same = np.append(grams[:-1] == np.repeat(low, n), False)
            hashes.append(words.hash)
            sizes.append(n)
            least.append(low)
            twice.append(np.add.reduceat(same, bounds, dtype=np.int64)[::2] > 1)
        low = np.concatenate(least)
        order = np.argsort(low, kind="stable")
        equal = low[order][1:] == low[order][:-1]
        shared = np.zeros(len(low), bool)
        shared[order[1:][equal]] = True
        shared[order[:-1][equal]] = True
        return np.concatenate(hashes), np.concatenate(sizes), shared | np.concatenate(twice)

    def spans(self, length: int) -> tuple[Any, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, hashes of texts, starts, stops) of runs of windows that stand earlier too, as the index says."""
        none = np.zeros(0, np.int64)
        if not self.places:
            return none, none, none, none
        hashes, sizes, comparable = self._words(min(GRAM, length))
        docs = [p[1] for p in self.places]
        seg, th, start = (np.array([p[i] for p in self.places], np.int64) for i in (0, 2, 3))
        known, doc = np.unique(np.array(docs, np.int64 if isinstance(docs[0], int) else object), return_inverse=True)
        order = np.lexsort((start, th, doc, seg))
        seg, doc, th, start = seg[order], doc[order], th[order], start[order]
        # rows that repeat id and text are one document
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1])
        seg, doc, th, start = seg[new], doc[new], th[new], start[new]

        keep = comparable | (np.bincount(seg, minlength=len(sizes)) > 1)
        inside = keep[seg]
        seg, doc, th, start = (np.cumsum(keep) - 1)[seg[inside]], doc[inside], th[inside], start[inside]
        # words are told apart by their 64-bit hashes
        names, symbol = np.unique(hashes[np.repeat(keep, sizes)], return_inverse=True)
        sizes = sizes[keep]
        del hashes
        begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        text[np.arange(len(symbol)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol + 1
        copies = np.bincount(seg, minlength=len(sizes))

        counts = sizes - length + 1
        which = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        index = FMIndex(text, len(names) + 1, length)
        found, lo = matching_statistics(index, text, begins[which] + offset + length - 1, length, np.where(copies[which] > 1, 1, 2))
        del index, text
        hit = np.flatnonzero(found >= length)
        # a window's occurrences all have its name: each is judged against the earliest
        each = copies[which[hit]]
        window = np.repeat(hit, each)
        place = np.repeat((np.cumsum(copies) - copies)[which[hit]], each) + np.arange(len(window)) - np.repeat(np.cumsum(each) - each, each)
        name, d, t, at = lo[window], doc[place], th[place], start[place] + offset[window]
        order = np.lexsort((at, t, d, name))
        name, d, t, at = name[order], d[order], t[order], at[order]
        first = np.ones(len(name), bool)
        first[1:] = name[1:] != name[:-1]
        least = d[np.maximum.accumulate(np.where(first, np.arange(len(name)), 0))] if len(name) else d
        again = np.zeros(len(name), bool)
        again[1:] = (name[1:] == name[:-1]) & (d[1:] == d[:-1]) & (t[1:] == t[:-1])
        gone = again | (d > least)
        d, t, at = d[gone], t[gone], at[gone]
        order = np.lexsort((at, t, d))
        d, t, at = d[order], t[order], at[order]
        opens = np.ones(len(d), bool)
        opens[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + length)
        closes = np.append(opens[1:], True)[: len(d)]
        return known[d[opens]], t[opens], at[opens], at[closes] + length


def _search(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: Any, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            ids = np.asarray(ids)
            keys = pa.array(ids, pa.int64(), mask=ids == _NULL_ID) if whole else pa.array([x[1:] if x else None for x in ids.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array(th, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "th", "start", "stop"])

        number, shard = None, Shard()
        for batch in batches:
            for s, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 0:
                    yield out(*pickle.loads(payload.as_py()))
                    continue
                if s != number:
                    yield out(*shard.spans(length))
                    number, shard = s, Shard()
                for item in _unpack(payload.as_py()):
                    shard.add(*item)
        yield out(*shard.spans(length))

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc_id, th, text``, and whether ids are whole numbers."""
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return docs.select(F.col(id_col).cast("long" if whole else "string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text")), whole


def hot_minimizers(rows: DataFrame, length: int) -> np.ndarray:
    """Minimizers, sorted, of more than one segment in HOT_SHARE among one row in SAMPLE; HOT_SHARE numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0), CHUNK_BYTES):
                least, n = np.unique(segments(Words(raw, offsets), length)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], names=["m", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "m long, n long")
    counts = sample.groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_SEGMENTS // 8)
    found = counts.orderBy(F.desc("n")).limit(HOT_SHARE).collect()
    total = sum(r["n"] for r in found)
    return np.sort(np.array([r["m"] for r in found if r["n"] > max(HOT_SEGMENTS, total // HOT_SHARE)], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, start, stop`` (words, stop exclusive): spans of windows of ``length`` words that also start earlier.

    Earlier means in a document with a smaller id, or earlier in the same document; ``th`` is the hash of the text.
    Spans of a document may touch or overlap; every window in a span's union of windows qualifies. A null id counts as
    the smallest. Ids that aren't whole numbers are given and ordered as text.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, whole = _rows(docs, id_col, text_col)
    parcels = rows.mapInArrow(_cut(length, partitions * SHARDS_PER_PARTITION, hot_minimizers(rows, length), whole), "shard int, kind int, payload binary")
    # of one mind about memory: a worker takes few parcels at a time
    dealt = parcels.repartition(partitions, "shard").sortWithinPartitions("kind", "shard")
    return dealt.mapInArrow(_search(length, whole), f"doc_id {'long' if whole else 'string'}, th long, start long, stop long")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            keep = np.ones(len(words), bool)
            if spans.is_valid:
                pair = spans.values
                for a, b in zip(pair.field(0).to_pylist(), pair.field(1).to_pylist(), strict=True):
                    keep[a:b] = False
            kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if not keep.all() else b" ".join(words)
            rows.append((len(words), int(len(words) - keep.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        n, r, t, h = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.string()), pa.array(h, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for every row of ``docs``.

    Words are runs of characters other than space and 0x09-0x0D. A word goes if a window of ``length``
    words covers it whose word sequence also starts earlier in ``docs`` as it came; ``kept`` is what
    stays, joined by one space. Null text has no words. A null id counts as the smallest; ids that aren't whole
    numbers are ordered as text. Rows that repeat an id with another text are documents of their own of which neither
    is earlier; rows that repeat both are one document, and what goes from one goes from the others. An
    empty table gives no rows; other columns aren't read.
    """
    spans = repeated_spans(docs, length, id_col, text_col).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "s_id", "th": "s_th"})
    rows, _ = _rows(docs, id_col, text_col)
    rows = rows.withColumnRenamed("doc_id", "key").withColumn("doc_id", F.col("key") if rows.schema["doc_id"].dataType == docs.schema[id_col].dataType else F.col("key").cast(docs.schema[id_col].dataType))
    joined = rows.join(spans, F.col("key").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string")
