"""Token sequences of fixed length by bounded-space online packing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

#: Chunks of text whose ids a worker remembers; beyond that it starts afresh.
CACHE_CHUNKS = 300_000
#: Partitions whose last windows meet in one task of the final merge.
MERGE_FAN_IN = 64
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s")
#: Characters beyond Latin letters and common punctuation.
_UNSURE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
#: Fixed value: how byte-level BPE splits text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text, exactly as the tokenizer of a byte-level BPE file gives them.

    Plain text goes through a faster engine that is built from the same file: its vocabulary, whose ids
    are merge ranks, and its splitting pattern. Text with characters on which the Unicode tables of the
    two might disagree, and files of another make, go through the tokenizer itself, piece by piece with
    a memory for repeated ones: such a text is split before every single space between two characters other
    than white space, where the pattern splits too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.fast = self._fast()

    def _fast(self):
        import tiktoken

        spec = json.loads(self.model.to_str())
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        if sorted(ranks.values()) != list(range(len(ranks))) or any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            return None
        return tiktoken.Encoding("same", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _piecewise(self, text: str) -> bytes:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        cuts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        pieces = [cuts[0], *[" " + x for x in cuts[1:]]]
        new = list({p for p in pieces if p not in known})
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for p, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        return b"".join([known[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.fast is None or _UNSURE.search(text):
            return self._piecewise(text)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder that a worker keeps for all its tasks."""
    return Encoder(path)


class Windows:
    """At most ``limit`` open windows of ``size`` tokens; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, limit: int, min_piece: int):
        self.size, self.limit, self.min_piece = size, limit, min_piece
        self.open: list[tuple[int, list[tuple]]] = []  # free tokens, pieces
        self.done: list[list[tuple]] = []

    def _put(self, at: int, piece: tuple) -> None:
        free, pieces = self.open[at]
        n = len(piece[2]) // 4
        pieces.append(piece)
        if free == n:
            self.done.append(pieces)
            self.open.pop(at)
        else:
            self.open[at] = (free - n, pieces)

    def add(self, doc_id: int | None, ids: bytes, start: int, tokens: int) -> None:
        """Whole windows are cut off first; the rest goes where it fits best, or else opens a window.

        When nothing fits and no window may be opened, the fullest is emitted; the piece's head fills
        what is free there unless that is under ``min_piece`` tokens.
        """
        whole = 4 * self.size
        full = len(ids) // whole
        for i in range(full):
            self.done.append([(doc_id, start + i * self.size, ids[i * whole : (i + 1) * whole], tokens)])
        ids, start = ids[full * whole :], start + full * self.size
        while ids:
            n = len(ids) // 4
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= n]
            if fits:
                self._put(min(fits)[1], (doc_id, start, ids, tokens))
                return
            if len(self.open) < self.limit:
                self.open.append((self.size - n, [(doc_id, start, ids, tokens)]))
                return
            free, at = min((free, i) for i, (free, _) in enumerate(self.open))
            if free >= self.min_piece:
                self._put(at, (doc_id, start, ids[: 4 * free], tokens))
                ids, start = ids[4 * free :], start + free
            else:
                self.done.append(self.open.pop(at)[1])

    def flush(self) -> None:
        """The open windows' pieces are laid end to end; what doesn't fill a window stays open."""
        left = [p for _, pieces in self.open for p in pieces]
        self.open = []
        self.append(left)

    def append(self, pieces: Iterable[tuple]) -> None:
        """Pieces fill the one open window in their order and are cut at its end."""
        for doc_id, start, ids, tokens in pieces:
            while ids:
                if not self.open:
                    self.open.append((self.size, []))
                free = self.open[0][0]
                self._put(0, (doc_id, start, ids[: 4 * free], tokens))
                start, ids = start + len(ids[: 4 * free]) // 4, ids[4 * free :]


def _powers(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """The last window cut into sequences whose lengths are powers of two, which need no padding."""
    total = sum(len(p[2]) // 4 for p in pieces)
    out: list[list[tuple]] = []
    rest = list(pieces)
    for bit in reversed(range(size.bit_length())):
        need = 1 << bit
        if not total & need:
            continue
        part: list[tuple] = []
        while need:
            doc_id, start, ids, tokens = rest.pop(0)
            part.append((doc_id, start, ids[: 4 * need], tokens))
            if len(ids) > 4 * need:
                rest.insert(0, (doc_id, start + need, ids[4 * need :], tokens))
            need -= len(part[-1][2]) // 4
        out.append(part)
    return out


_NUMBERS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task"]
_NAMES = ["doc_id", *_NUMBERS, "ids"]


def _rows(sequences: Iterable[list[tuple]], first: int, task: int | None) -> dict[str, list]:
    """Columns of the pieces of ``sequences``; with a task number they are leftovers and keep their ids."""
    out: dict[str, list] = {c: [] for c in _NAMES}
    for number, pieces in enumerate(sequences):
        at = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            for c, v in zip(_NAMES, (doc_id, start, n, zlib.crc32(ids), tokens, first + number, at, task, None if task is None else ids), strict=True):
                out[c].append(v)
            at += n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    open_windows: int = 64,
    min_piece: int = 8,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``size`` tokens.

    Columns: doc_id, start (the document's tokens before it), length, ids_crc32 (of the little-endian
    unsigned 32-bit ids), doc_tokens (with the closing ``end_id``), sequence_id, offset. Every token of
    every document lies in exactly one piece; within a sequence offsets have no gaps. Each partition
    keeps ``open_windows`` windows; rests of documents go where they fit best, and at its end the open
    ones are laid end to end. The one window that a partition leaves is merged with those of other
    partitions, ``MERGE_FAN_IN`` at a time; what then is left is cut into sequences whose lengths are
    powers of two, which aren't padded.

    Null and empty texts are documents of the single token ``end_id``. Repeated rows are packed as often
    as they occur, a null id stays null, and ids may be of any type. An empty table gives no rows. tokenizer: path of a byte-level
    BPE file of the ``tokenizers`` library that every executor can read.
    """

    kind = docs.schema[id_col].dataType
    schema = ", ".join([f"doc_id {kind.simpleString()}", *[f"{c} long" for c in _NUMBERS], "ids binary"])
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in _NUMBERS], ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, windows = encoder_of(tokenizer), Windows(size, open_windows, min_piece)
        end, number = np.array([end_id], "<u4").tobytes(), task << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    windows.add(doc_id, ids, 0, len(ids) // 4)
                if windows.done:
                    yield pa.RecordBatch.from_pydict(_rows(windows.done, number, None), schema=arrow)
                    number += len(windows.done)
                    windows.done = []
        windows.flush()
        yield pa.RecordBatch.from_pydict(_rows(windows.done, number, None), schema=arrow)
        yield pa.RecordBatch.from_pydict(_rows((p for _, p in windows.open), 0, task), schema=arrow)

    def merge(group: pa.Table) -> pa.Table:
        windows = Windows(size, 1, min_piece)
        group = group.sort_by([("task", "ascending"), ("offset", "ascending")])
        windows.append(zip(*[group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True))
        last = [s for _, p in windows.open for s in _powers(p, size)]
        return pa.Table.from_pydict(_rows(windows.done + last, (1 << 62) + (group.column("task")[0].as_py() << 20), None), schema=arrow)

    # kept: the rows and the leftovers come from one run, so a lost executor can't mix two packings
    packed = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    left = packed.where("task IS NOT NULL")
    merged = left.groupBy(F.floor(F.col("task") / MERGE_FAN_IN).alias("g")).applyInArrow(merge, schema)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.where("task IS NULL").select(names).unionByName(merged.select(names))
