"""SimHash fingerprints, multi-index hashing search, and groups of near copies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, row_keys, text_chunks
from .components import connected_components
from .wordhash import Words, mix, shingle_hashes

#: A table key with more stored fingerprints than this, and the keys one bit beside it, are searched in blocks.
HOT_KEY = 64
#: Fingerprints on each side of a block pair, and rows of it that are compared at once.
BLOCK, STRIP = 4096, 256


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """64 bits; bit i is 1 if it is set in over half of the XXH64 values of the word shingles.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased; a text with fewer
    words is one shingle, and a text without words has fingerprint 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths).tolist()
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], 42) for i, j in zip(starts, stops[k - 1 :].tolist(), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``id_col, fp`` (fp: the fingerprint's 64 bits as a signed long) for every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that cover 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _radii(distance: int, m: int) -> list[int]:
    """Radii of the balls around m segments: two fingerprints within ``distance`` bits are that near in one of them.

    If every segment differed in more than its radius, all would differ in ``distance - m + 1 + m`` bits at least.
    """
    each, more = divmod(max(0, distance - m + 1), m)
    return [each + (i < more) for i in range(m)]


def choose_segments(distance: int, nodes: int) -> int:
    """The number of segments with the fewest lookups and fingerprints met by them, for so many nodes."""

    def cost(m: int) -> float:
        looks = lambda w, r: (1, 1 + w / 2, 1 + w / 2 + w * (w - 1) / 4)[r]
        return sum(looks(w, r) * (1 + nodes / 2 / 2**w) for (_, w), r in zip(_segments(m), _radii(distance, m), strict=True))

    return min((m for m in range(2, distance + 2) if max(_radii(distance, m)) <= 2), key=cost)


def _beside(value: F.Column, tag: F.Column, width: int, radius: int) -> list[F.Column]:
    """Arrays of the keys in the ball around ``value`` that it looks up; of two that lie in each other's ball one does."""
    lacks = F.filter(F.array(*[F.lit(1 << b) for b in range(width)]), lambda b: value.bitwiseAND(b) == 0)
    out = [F.array(value.bitwiseOR(tag))]
    if radius:
        out.append(F.transform(lacks, lambda b: value.bitwiseOR(b).bitwiseOR(tag)))
    if radius > 1:
        two = F.array(*[F.lit((1 << a) | (1 << b)) for b in range(width) for a in range(b)])
        # both bits are lacking, or the higher one is while the lower one goes
        out.append(F.transform(F.filter(two, lambda x: value.bitwiseAND(x) == 0), lambda x: value.bitwiseOR(x).bitwiseOR(tag)))
        swap = F.filter(two, lambda x: (value.bitwiseAND(x) != 0) & (value.bitwiseAND(x) == x.bitwiseAND(-x)))
        out.append(F.transform(swap, lambda x: value.bitwiseXOR(x).bitwiseOR(tag)))
    return out


def _keys(fp: str, radii: list[int], first: int = 0) -> tuple[F.Column, F.Column]:
    """Arrays of table keys: where a fingerprint is stored, and where it looks: in the Hamming balls of its segments.

    ``first``: the number of its first segment, which tells its keys from those of other fingerprints.
    """
    stored, sought = [], []
    for i, ((shift, width), radius) in enumerate(zip(_segments(len(radii)), radii, strict=True)):
        value = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit((first + i) << 40)
        stored.append(value.bitwiseOR(tag))
        sought += _beside(value, tag, width, radius)
    return F.array(*stored), F.concat(*sought)


def _ball(width: int, radius: int) -> list[int]:
    """What a key differs by from those in its ball."""
    one = [1 << b for b in range(width)]
    return [0, *one[: width if radius else 0], *([a | b for b in one for a in one if a < b] if radius > 1 else [])]


def _block_forest(distance: int, wide: list[str], wide_distance: int):
    def run(block: pa.Table) -> pa.Table:
        """A spanning forest of the links between the block's stored and searching nodes."""
        columns = {c: block.column(c).to_numpy() for c in ("side", "node", "fp", *wide)}
        left, right = ({c: v[columns["side"] == s] for c, v in columns.items()} for s in (0, 1))
        n_left, n_right = len(left["node"]), len(right["node"])

        def apart(column: str, rows: slice) -> np.ndarray:
            x, y = (np.ascontiguousarray(side[column], np.int64).view(np.uint64) for side in (left, right))
            return np.bitwise_count(x[rows, None] ^ y[None, :])

        near = np.zeros((n_left, n_right), bool)
        for first in range(0, n_left, STRIP):
            rows = slice(first, first + STRIP)
            near[rows] = apart("fp", rows) <= distance
            if wide:
                near[rows] &= sum(apart(c, rows).astype(np.int16) for c in wide) <= wide_distance
        names_left, names_right = left["node"], right["node"]
        open_left, open_right = np.ones(n_left, bool), np.ones(n_right, bool)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for first in range(n_left):
            if not open_left[first]:
                continue
            open_left[first] = False
            queue = [(0, first)]
            while queue:
                side, x = queue.pop()
                hit = np.flatnonzero(near[x] & open_right) if side == 0 else np.flatnonzero(near[:, x] & open_left)
                if len(hit):
                    (open_right if side == 0 else open_left)[hit] = False
                    queue += [(1 - side, int(y)) for y in hit]
                    a.append(np.full(len(hit), names_left[x] if side == 0 else names_right[x]))
                    b.append(names_right[hit] if side == 0 else names_left[hit])
        none = np.zeros(0, np.int64)
        ends = np.concatenate([none, *a]), np.concatenate([none, *b])
        real = ends[0] != ends[1]
        return pa.table({"a": ends[0][real], "b": ends[1][real]})

    return run


def near_links(nodes: DataFrame, distance: int = 4, segments: int | None = None, wide: list[str] | None = None, wide_distance: int = 0, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect exactly what all links between nodes would connect.

    ``nodes``: checkpointed rows with a unique long ``node`` and its fingerprint ``fp``. Two nodes are linked
    if their fingerprints differ in at most ``distance`` bits and, where more fingerprint columns ``wide`` are
    named, these in at most ``wide_distance`` bits together. Multi-index hashing: fingerprints are cut into
    ``segments``, by default as many as suit the number of nodes, and two that are near each other lie in each
    other's Hamming ball (radius 0 to 2) in some segment. Every node is stored under each of its segments, looks up
    the ball around each, and whole distances are verified in the join. Around keys with more
    than ``hot_key`` nodes, where near copies in their thousands would make a pair each, ``_hot_links`` finds
    links that connect the same nodes.
    """
    return _search(nodes, ["fp"], None, distance, segments, wide or [], wide_distance, hot_key, block)


def _search(nodes: DataFrame, prints: list[str], bands: str | None, distance: int, segments: int | None, wide: list[str], wide_distance: int, hot_key: int, block: int) -> DataFrame:
    """Links that connect what the links of ``near_links`` by each of ``prints`` and those of ``band_links`` would connect together.

    All keys lie in one table, as each search on its own would be another pass of joins. A key's highest bits say which
    fingerprint it belongs to; the bands' keys are negative, and their fingerprint is 0.
    """
    radii = _radii(distance, segments or choose_segments(distance, nodes.count())) if prints else []
    if max(radii, default=0) > 2:
        raise ValueError("more segments are needed for this distance")
    m = len(radii)
    keys = [_keys(p, radii, i * m) for i, p in enumerate(prints)]
    if bands:
        sign = F.lit(-(1 << 63)) if prints else F.lit(0)
        keys.append((F.transform(bands, lambda x: x.bitwiseOR(sign)),) * 2)
    is_band = lambda key: F.lit(True) if not prints else key < 0 if bands else F.lit(False)
    of = [F.when(~is_band(F.col("key")) & (F.shiftright("key", 40) < (i + 1) * m), F.col(p)) for i, p in enumerate(prints)]
    stored, sought = ([k[side] for k in keys] for side in (0, 1))

    def keyed(arrays: list[F.Column]) -> DataFrame:
        return nodes.select(F.explode(F.concat(*arrays)).alias("key"), "node", *prints).select("key", "node", F.coalesce(*of, F.lit(0).cast("long")).alias("fp"))

    held, seek = keyed(stored), keyed(sought)
    crowded = held.groupBy("key").count().where(F.col("count") > hot_key)
    balls = [_ball(width, r) for (_, width), r in zip(_segments(m), radii, strict=True)] * len(prints) if prints else []
    flips = [F.when(~is_band(F.col("key")) & (F.shiftright("key", 40) == i), F.array(*map(F.lit, ball))) for i, ball in enumerate(balls)]
    around = crowded.select("count", F.explode(F.transform(F.coalesce(*flips, F.array(F.lit(0))), lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
    # a bound of a key's rows: those of crowded keys around it, and of all others in the ball
    hot = cut(around.groupBy("key").agg((2 * F.sum("count") + hot_key * max(map(len, balls), default=0)).alias("weight")))
    any_hot = bool(hot.take(1))
    cold = join_hot(seek, hot, ["key"], "weight", "left_anti") if any_hot else seek

    # both ends look up a band's key, so one direction will do
    other = F.when(is_band(F.col("s.key")), F.col("s.node") < F.col("h.node")).otherwise(F.col("s.node") != F.col("h.node"))
    near = (F.col("s.key") == F.col("h.key")) & other & (F.bit_count(F.col("s.fp").bitwiseXOR(F.col("h.fp"))) <= distance)
    pairs = cold.alias("s").join(held.alias("h"), near).select(F.col("s.node").alias("a"), F.col("h.node").alias("b"))
    if wide:
        # candidates are few beside the keys, so only they are joined to the other fingerprints
        for end in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in wide]), end)
        total = F.lit(0)
        for c in wide:
            total = total + F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
        pairs = pairs.where(total <= wide_distance).select("a", "b")
    if not any_hot:
        return pairs
    rows = held.withColumn("side", F.lit(0)).union(seek.withColumn("side", F.lit(1)))
    rows = join_hot(rows, hot, ["key"], "weight", "left_semi")
    if wide:
        rows = rows.join(nodes.select("node", *wide), "node")
    return pairs.union(_hot_links(cut(rows), distance, wide, wide_distance, block))


def _hot_links(rows: DataFrame, distance: int, wide: list[str], wide_distance: int, block: int) -> DataFrame:
    """Links that connect what the links between stored (``side`` 0) and searching rows of each key connect.

    Rows that are near their key's least node are linked to it, so no pair of them need be compared. What is left,
    few rows among near copies, is dealt into blocks and compared with all rows of its key, block pair by block
    pair, each of which gives a spanning forest.
    """
    of = ["fp", *wide]
    pivots = cut(rows.groupBy("key").agg(F.min_by(F.struct("node", *of), "node").alias("p"), F.count("*").alias("weight")))
    rows = join_hot(rows, pivots, ["key"], "weight")

    def apart(column: str) -> F.Column:
        return F.bit_count(F.col(column).bitwiseXOR(F.col(f"p.{column}")))

    near = apart("fp") <= distance
    if wide:
        near = near & (reduce(F.Column.__add__, map(apart, wide)) <= wide_distance)
    rows = cut(rows.select("key", "node", *of, "side", near.alias("star"), F.col("p.node").alias("pivot")))
    star = rows.where(F.col("star") & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    # stored rows that are left meet all searching ones, and the others those that are left
    sets = F.when(F.col("side") == 0, F.array(F.when(F.col("star"), 1).otherwise(0))).otherwise(F.when(F.col("star"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    rows = rows.select("key", F.explode(sets).alias("set"), "node", *of, "side")
    counts = [F.ceil(F.sum((F.col("side") == s).cast("long")) / block).cast("int").alias(f"n{s}") for s in (0, 1)]
    parts = cut(rows.groupBy("key", "set").agg(*counts, F.count("*").alias("weight")).where("n0 > 0 and n1 > 0"))
    dealt = join_hot(rows, parts, ["key", "set"], "weight")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)
    what = ["key", "set", "node", *of, "side"]
    dealt = dealt.select(*what, own.alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select(*what, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("b0"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("b1"))
    return star.union(dealt.groupBy("key", "set", "b0", "b1").applyInArrow(_block_forest(distance, wide, wide_distance), "a long, b long"))


def band_links(nodes: DataFrame, bands: str, wide: list[str], wide_distance: int, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect what all pairs with a common key in the array ``bands`` would connect.

    A pair is linked if its fingerprints ``wide`` differ in at most ``wide_distance`` bits together. Keys with
    more than ``hot_key`` nodes are searched as in ``near_links``.
    """
    return _search(nodes, [], bands, 0, None, wide, wide_distance, hot_key, block)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, distance: int = 4, segments: int | None = None, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the least id (of any type with an order) that is reachable over links between fingerprints
    that differ in at most ``distance`` bits; equal fingerprints are linked. Rows with equal fingerprints meet only in
    an aggregation, so exact copies cost no pairs. Null and empty texts have fingerprint 0. Rows with a
    null id get a null component of their own. Repeated rows are kept. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs.select(id_col, text_col), id_col, text_col, shingle_words))
    nodes = cut(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("weight")))
    # fingerprints are signed longs, so they are the nodes themselves; components are renamed afterwards
    links = near_links(nodes.select(F.col("fp").alias("node"), "fp"), distance, segments, hot_key=hot_key, block=block)
    parts = cut(connected_components(links, "a", "b"))
    of = cut(nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", "weight", F.coalesce("component", "fp").alias("part")))
    named = cut(of.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    members = cut(join_hot(of, named, ["part"], "size").select("fp", "component_id", "weight"))
    out = join_hot(prints, members, ["fp"], "weight", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def _simhash(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of n texts from its features' hashes; ``text`` ascends."""
    out = np.zeros(n, np.uint64)
    if len(h):
        counts = np.bincount(text, minlength=n)
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


#: Fingerprints that candidates are searched by, and those that similarity is judged by.
SEARCH, JUDGE = ["k0", "k1"], ["w0", "w1", "w2", "w3"]
#: Keys by which candidates are searched too, and MinHash values in each: at a resemblance of 0.8 two texts have a
#: key in common but once in 4,500 times (0.7: 1 in 80), whether they differ by scattered edits or by a block.
BANDS, BAND_ROWS = 16, 4
_DRAW = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def _bands(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """BANDS keys of each of n texts from its shingles' hashes; ``text`` ascends, and a text without any has zeros."""
    out = np.zeros((n, BANDS), np.uint64)
    if len(h):
        counts = np.bincount(text, minlength=n)
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        buffer = np.empty_like(h)
        for i, (a, b) in enumerate(zip(_DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1], strict=True)):
            np.multiply(h, a, out=buffer)
            np.add(buffer, b, out=buffer)
            out[full, i // BAND_ROWS] = mix(out[full, i // BAND_ROWS] * np.uint64(31) + np.minimum.reduceat(buffer, starts) + np.uint64(i))
    return out


def signatures(docs: DataFrame, text_col: str = "text", shingle_words: int = 5, long_word: int = 6) -> DataFrame:
    """``docs`` without its text, but with two fingerprints of the text's long words (SEARCH), 256 bits (JUDGE) and MinHash ``bands`` over its word shingles.

    One edited word changes as many shingles as they have words, so shingles tell texts apart
    sharply but differ too much between near copies to be searched by; words differ little. A block that
    is added or cut changes words as much as shingles; such copies are found by their bands.
    """
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(6)]
            bands = [np.zeros((0, BANDS), np.uint64)]
            for lo, hi, raw, offsets in text_chunks(batch.column(len(rest))):
                words, n = Words(raw, offsets, fold=True), hi - lo
                text = words.of_text()
                long = words.stops - words.starts >= long_word
                # a text of short words only has them all
                long |= (np.bincount(text, long, minlength=n) == 0)[text]
                grams, inside = shingle_hashes(words, shingle_words)
                features = [(text[long], mix(words.hash[long] + np.uint64(s))) for s in (1, 2)] + [(text[inside], mix(grams[inside] + np.uint64(s))) for s in (3, 4, 5, 6)]
                for part, (t, h) in zip(parts, features, strict=True):
                    part.append(_simhash(t, h, n))
                bands.append(_bands(text[inside], grams[inside], n))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(np.concatenate(p).view(np.int64)) for p in parts], keys], names=[*rest, *SEARCH, *JUDGE, "bands"])

    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in rest) + ", ".join(f"{c} long" for c in SEARCH + JUDGE) + ", bands array<long>"
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, distance: int, segments: int | None, judge_distance: int) -> tuple[DataFrame, DataFrame]:
    """``id, th, s0, s1`` of every row with an id, and ``s0, s1, weight, first`` of every signature: the least (id, th) of its group."""
    prints = signatures(row_keys(docs, id_col, text_col), "text", shingle_words)
    every = [*SEARCH, *JUDGE, "bands"]
    prints = cut(prints.select("id", "th", *every, F.xxhash64(*every).alias("s0"), F.xxhash64(F.lit(1), *every).alias("s1")))
    single = prints.groupBy("s0", "s1").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("weight"), *[F.any_value(c).alias(c) for c in every])
    single = cut(single.withColumn("node", F.monotonically_increasing_id()))
    links = _search(single, SEARCH, "bands", distance, segments, JUDGE, judge_distance, HOT_KEY, BLOCK)
    parts = cut(connected_components(links, "a", "b"))
    of = single.select("s0", "s1", "weight", "first", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("node", "component")
    named = cut(of.groupBy("part").agg(F.min("first").alias("least"), F.count("*").alias("size")))
    return prints.select("id", "th", "s0", "s1"), cut(join_hot(of, named, ["part"], "size").select("s0", "s1", "weight", F.col("least").alias("first")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, distance: int = 7, segments: int | None = 4, judge_distance: int = 50) -> DataFrame:
    """``id_col, component_id`` for every row of ``docs``: groups of texts whose word shingles resemble each other.

    Candidates are within ``distance`` bits in either fingerprint of their long words, or share one of the
    ``bands``; links are those whose 256 bits over shingles differ in at most ``judge_distance``. At a resemblance of 0.8, 39 bits
    differ on average with a standard deviation of 6, at 0.6 it is 59, and unrelated texts differ in 128.
    ``component_id`` is the least id of the group; ids may be of any type with an order. Texts without any word are copies
    of one another. Rows with a null id have a null component. An empty table gives no rows.
    """
    prints, groups = _similar(docs, id_col, text_col, shingle_words, distance, segments, judge_distance)
    out = join_hot(prints, groups, ["s0", "s1"], "weight").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))
    none = docs.where(F.col(id_col).isNull()).select(id_col, F.col(id_col).alias("component_id"))
    return out.union(none)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, distance: int = 7, segments: int | None = 4, judge_distance: int = 50) -> DataFrame:
    """The first row of each group of ``similar_groups``, by id and then by the hash of its text; all columns stay.

    Texts without any word are copies of one another. Rows with a null id have no group and stay; of rows that repeat
    id and text one stays. Rows that repeat an id with another text are documents of their own.
    """
    _, groups = _similar(docs, id_col, text_col, shingle_words, distance, segments, judge_distance)
    keep = groups.select(F.col("first.id").alias("__id"), F.col("first.th").alias("__th")).distinct()
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(keep, (docs[id_col] == keep["__id"]) & (own == keep["__th"]), "left_semi")
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col, own.alias("__th")).count().where("count > 1").take(1):
        kept = kept.withColumn("__th", own).dropDuplicates([id_col, "__th"]).drop("__th")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
