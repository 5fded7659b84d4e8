"""Jobs: their registry, what they report, and the command line that handles them."""

from __future__ import annotations

import json
import re
import struct
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format_lsn, lsn_lag, time_lag

KINDS = ("manager", "capture", "receiver", "integrate", "progress")
STATES = ("nop", "init", "online", "offline")


@dataclass
class Job:
    kind: str
    name: str
    state: str = "nop"
    members: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, int] = field(default_factory=dict)


class CommandError(ValueError):
    """A command that can't be carried out."""


class Manager:
    """The jobs of a folder, each a small JSON file that is replaced as a whole."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.handlers: dict[str, Callable[[Job], None]] = {}
        self.refreshes: list[tuple[str, str]] = []

    def _path(self, kind: str, name: str) -> Path:
        return self.folder / f"{kind}.{name}.json"

    def load(self, kind: str, name: str) -> Job:
        if kind not in KINDS:
            raise CommandError(f"unknown kind {kind}")
        path = self._path(kind, name)
        if not path.exists():
            raise CommandError(f"no {kind} {name}")
        return Job(**json.loads(path.read_text()))

    def save(self, job: Job) -> None:
        path = self._path(job.kind, job.name)
        tmp = path.with_suffix(".tmp")
        tmp.write_text(json.dumps(asdict(job), sort_keys=True))
        tmp.replace(path)

    def list(self) -> list[Job]:
        return [Job(**json.loads(p.read_text())) for p in sorted(self.folder.glob("*.json"))]

    def create(self, kind: str, name: str, items: list[str]) -> Job:
        if kind not in KINDS:
            raise CommandError(f"unknown kind {kind}")
        if self._path(kind, name).exists():
            raise CommandError(f"{kind} {name} exists")
        job = Job(kind, name, members=items)
        self.save(job)
        return job

    def alter(self, name: str, action: str, items: list[str]) -> Job:
        job = self.load("progress", name)
        job.members = [*dict.fromkeys([*job.members, *items])] if action == "add" else [m for m in job.members if m not in items]
        self.save(job)
        return job

    def remove(self, kind: str, name: str) -> None:
        """Takes a job that doesn't run from the registry."""
        if self.load(kind, name).state == "online":
            raise CommandError(f"{kind} {name} is running")
        self._path(kind, name).unlink()

    def drop(self, kind: str, name: str) -> None:
        """Takes a job away with all its state, running or not."""
        self.load(kind, name)
        self._path(kind, name).unlink()

    def _to(self, kind: str, name: str, state: str, allowed: tuple[str, ...]) -> Job:
        job = self.load(kind, name)
        if job.state not in allowed:
            raise CommandError(f"{kind} {name} is {job.state}")
        job.state = state
        if kind in self.handlers:
            self.handlers[kind](job)
        self.save(job)
        return job

    def init(self, kind: str, name: str) -> Job:
        return self._to(kind, name, "init", ("nop", "offline"))

    def start(self, kind: str, name: str) -> Job:
        return self._to(kind, name, "online", ("init", "offline"))

    def stop(self, kind: str, name: str) -> Job:
        return self._to(kind, name, "offline", ("online",))

    def reload(self, kind: str, name: str) -> Job:
        """Options are read again; takes effect at the next batch."""
        return self._to(kind, name, "online", ("online",))

    def edit(self, kind: str, name: str, options: dict[str, str]) -> Job:
        job = self.load(kind, name)
        job.options |= options
        self.save(job)
        return job

    def refresh(self, name: str, tables: list[str]) -> list[str]:
        self.load("capture", name)
        bad = [t for t in tables if not re.fullmatch(r"[^.\s]+\.[^.\s]+", t)]
        if bad:
            raise CommandError(f"not schema.table: {', '.join(bad)}")
        self.refreshes += [(name, t) for t in tables]
        return tables

    def frame(self, spark: SparkSession) -> DataFrame:
        """All jobs with kind and state."""
        return spark.createDataFrame([(j.kind, j.name, j.state) for j in self.list()], "kind string, name string, state string")


_COMMANDS = {
    "create": r"create\s+(\w+)\s+(\w+)(?:\s+(.+))?",
    "alter": r"alter\s+progress\s+(\w+)\s+(add|remove)\s+(.+)",
    "remove": r"remove\s+(\w+)\s+(\w+)",
    "drop": r"drop\s+(\w+)\s+(\w+)",
    "init": r"init\s+(\w+)\s+(\w+)",
    "edit": r"edit\s+(\w+)\s+(\w+)\s+(.+)",
    "start": r"start\s+(\w+)\s+(\w+)",
    "stop": r"stop\s+(\w+)\s+(\w+)",
    "reload": r"reload\s+(\w+)\s+(\w+)",
    "info": r"info\s+(\w+)\s+(\w+)",
    "watch": r"watch\s+(\w+)\s+(\w+)(?:\s+(\d+))?",
    "refresh": r"refresh\s+(\w+)\s+(.+)",
    "list": r"list",
}


def _items(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def execute(manager: Manager, line: str, out: Callable[[str], None] = print, rounds: int | None = None) -> None:
    """One command line, ended by a semicolon or not; names fold to lower case."""
    text = line.strip().rstrip(";").strip()
    verb = text.split(None, 1)[0].lower() if text else ""
    if verb not in _COMMANDS:
        raise CommandError(f"unknown command {verb!r}")
    m = re.fullmatch(_COMMANDS[verb], text, re.I)
    if not m:
        raise CommandError(f"bad syntax: {text}")
    args = [a.lower() if a and i < 2 else a for i, a in enumerate(m.groups())]
    if verb == "list":
        for j in manager.list():
            out(f"{j.kind} {j.name} {j.state}")
    elif verb == "create":
        manager.create(args[0], args[1], _items(args[2]))
    elif verb == "alter":
        manager.alter(args[0], args[1], _items(args[2]))
    elif verb == "edit":
        manager.edit(args[0], args[1], dict(x.split("=", 1) for x in _items(args[2])))
    elif verb == "refresh":
        manager.refresh(args[0], _items(m[2]))
    elif verb in ("info", "watch"):
        n = 0
        while True:
            j = manager.load(args[0], args[1])
            out(f"{j.kind} {j.name} {j.state} " + " ".join(f"{k}={v}" for k, v in sorted(j.metrics.items())))
            n += 1
            if verb == "info" or n == (rounds or sys.maxsize):
                break
            time.sleep(int(args[2] or 5))
    else:
        getattr(manager, verb)(args[0], args[1])


def encode_command(line: str) -> bytes:
    """A command as it travels: its length in 4 bytes, then its text."""
    raw = line.encode()
    return struct.pack(">I", len(raw)) + raw


def encode_rows(columns: list[str], rows: list[list[str | None]], error: str | None = None) -> bytes:
    """A result: an error text, or column names and rows with a bitmap of nulls each."""
    out = [struct.pack(">?", error is not None)]

    def put(text: str) -> None:
        raw = text.encode()
        out.append(struct.pack(">I", len(raw)) + raw)

    if error is not None:
        put(error)
        return b"".join(out)
    out.append(struct.pack(">HI", len(columns), len(rows)))
    for c in columns:
        put(c)
    for row in rows:
        bits = bytearray((len(row) + 7) // 8)
        for i, v in enumerate(row):
            if v is None:
                bits[i // 8] |= 1 << i % 8
        out.append(bytes(bits))
        for v in row:
            if v is not None:
                put(v)
    return b"".join(out)


def decode_rows(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Column names and rows of a result; raises the error that it holds."""
    at = 1

    def take() -> str:
        nonlocal at
        (n,) = struct.unpack_from(">I", data, at)
        at += 4 + n
        return data[at - n : at].decode()

    if data[0]:
        raise CommandError(take())
    width, count = struct.unpack_from(">HI", data, at)
    at += 6
    columns = [take() for _ in range(width)]
    rows: list[list[str | None]] = []
    for _ in range(count):
        bits = data[at : at + (width + 7) // 8]
        at += len(bits)
        rows.append([None if bits[i // 8] >> i % 8 & 1 else take() for i in range(width)])
    return columns, rows


def serve(manager: Manager, message: bytes) -> bytes:
    """The manager's answer to one encoded command: rows of ``list`` and ``info``, an empty result, or an error."""
    (n,) = struct.unpack_from(">I", message)
    line = message[4 : 4 + n].decode()
    lines: list[str] = []
    try:
        execute(manager, line, lines.append, rounds=1)
    except CommandError as e:
        return encode_rows([], [], str(e))
    rows: list[list[str | None]] = [[p or None for p in (x.split(" ", 3) + [""])[:4]] for x in lines]
    return encode_rows(["kind", "name", "state", "metrics"], rows)


class Client:
    """Sends commands through ``transport`` (bytes to bytes) and reads the answers."""

    def __init__(self, transport: Callable[[bytes], bytes]):
        self.transport = transport
        self.error: str | None = None

    def command(self, line: str) -> list[dict[str, str | None]] | None:
        """The rows of the result, or None with the reason in ``error``."""
        try:
            columns, rows = decode_rows(self.transport(encode_command(line)))
        except CommandError as e:
            self.error = str(e)
            return None
        self.error = None
        return [dict(zip(columns, r, strict=True)) for r in rows]


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The last value of each counter of a job; metrics: job, counter, at, value."""
    return metrics.groupBy("job", "counter").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def progress_lag(captures: DataFrame, integrates: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, capture, integrate, lsnlag, traillag, timelag of each progress that has exactly one of each.

    captures: name, flush_lsn, trail_no, flush_micros; integrates: name, sync_lsn, sync_trail_no, sync_micros;
    pairs: name, capture, integrate. A lag of a capture that is behind its integrate is ``N/A``.
    """
    single = pairs.groupBy("name").agg(F.count("*").alias("n"), F.min("capture").alias("capture"), F.min("integrate").alias("integrate")).where("n = 1").drop("n")
    j = single.join(captures.withColumnRenamed("name", "capture"), "capture").join(integrates.withColumnRenamed("name", "integrate"), "integrate")

    def behind(a: str, b: str, text) -> object:
        lag = F.col(a) - F.col(b)
        return F.when(lag < 0, F.lit("N/A")).otherwise(text(lag))

    lags = [behind("flush_lsn", "sync_lsn", lsn_lag).alias("lsnlag"), behind("trail_no", "sync_trail_no", lambda n: n.cast("string")).alias("traillag"), behind("flush_micros", "sync_micros", time_lag).alias("timelag")]
    return j.select("name", "capture", "integrate", *lags)


def capture_info(metrics: DataFrame) -> DataFrame:
    """A row for each capture with its positions as text; metrics: job and counters as columns."""
    lsns = ["redo_lsn", "restart_lsn", "confirm_lsn", "load_lsn", "parse_lsn", "flush_lsn"]
    return metrics.select("job", *[format_lsn(F.col(c)).alias(c) for c in lsns if c in metrics.columns], *[c for c in ("trail_no", "trail_start", "state") if c in metrics.columns])


def main(argv: list[str] | None = None) -> int:
    """``python -m tidemark.plans.jobs FOLDER [COMMAND...]``: one command, or lines from standard input."""
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print(main.__doc__)
        return 2
    manager = Manager(argv[0])
    lines = [" ".join(argv[1:])] if argv[1:] else sys.stdin
    code = 0
    for line in lines:
        if not line.strip():
            continue
        try:
            execute(manager, line)
        except CommandError as e:
            print(f"error: {e}", file=sys.stderr)
            code = 1
    return code


if __name__ == "__main__":
    sys.exit(main())
