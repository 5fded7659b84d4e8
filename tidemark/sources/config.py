"""Configuration files of jobs: ``key = value`` lines, checked against the options of the job's kind."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Options as (name, kinds of jobs, type, default, least, most); "list" may repeat.
_OPTIONS = """
jobname          capture,integrate,receivelog,manager str   -         -    -
data             capture,integrate,receivelog,manager str   -         -    -
log_dir          capture,integrate,receivelog,manager str   -         -    -
log_level        capture,integrate,receivelog,manager str   info      -    -
url              capture,integrate                    str   -         -    -
wal_dir          capture                              str   -         -    -
dbtype           capture                              str   postgres  -    -
dbversion        capture                              str   12        -    -
catalog_schema   capture,integrate                    str   -         -    -
trail_dir        integrate                            str   -         -    -
trail_max_size   capture,integrate                    int   128       0    4096
capture_buffer   capture                              int   128       1    32768
integrate_buffer integrate                            int   128       1    32768
max_work_per_refresh capture,integrate                int   1         1    100
max_page_per_refreshsharding capture                  int   1000      100  10000000
refreshstragety  capture                              int   0         0    1
ddl              capture                              int   1         0    1
mergetxn         integrate                            int   0         0    1
txbundlesize     integrate                            int   0         0    10000000
truncate_table   integrate                            int   0         0    1
table            capture                              list  -         -    -
tableexclude     capture                              list  -         -    -
addtablepattern  capture                              list  -         -    -
"""


class ConfigError(ValueError):
    """A line that can't be read, or a value that its option doesn't allow."""


@dataclass(frozen=True)
class Option:
    name: str
    kinds: frozenset[str]
    type: str
    default: str | None
    least: int | None
    most: int | None

    def value(self, text: str, line: int) -> str | int:
        if self.type != "int":
            return text
        if not re.fullmatch(r"[+-]?\d+", text):
            raise ConfigError(f"line {line}: {self.name} needs a whole number, not {text!r}")
        n = int(text)
        if not self.least <= n <= self.most:
            raise ConfigError(f"line {line}: {self.name} must be from {self.least} to {self.most}, not {n}")
        return n


def _options() -> dict[str, Option]:
    out = {}
    for line in _OPTIONS.strip().splitlines():
        name, kinds, kind, default, least, most = line.split()
        bound = [None if x == "-" else int(x) for x in (least, most)]
        out[name] = Option(name, frozenset(kinds.split(",")), kind, None if default == "-" else default, *bound)
    return out


OPTIONS = _options()
_LINE = re.compile(r"""\s*([A-Za-z_]\w*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#'"]+(?:[^\S\n]+[^\s#'"]+)*))?\s*(?:#.*)?""")


def parse_config(text: str, kind: str) -> dict[str, str | int | list[str]]:
    """Options by name, defaults included. Values may be quoted; ``#`` begins a comment; lists gather repeated keys.

    Options that the kind of job doesn't know are kept as text, as a file may be shared.
    """
    out: dict[str, str | int | list[str]] = {}
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _LINE.fullmatch(line)
        if not m:
            raise ConfigError(f"line {number}: not key = value: {line.strip()!r}")
        name = m[1].lower()
        value = re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3].replace("''", "'") if m[3] is not None else (m[4] or "")
        option = OPTIONS.get(name)
        if option is not None and option.type == "list":
            out.setdefault(name, []).append(value)
        else:
            out[name] = option.value(value, number) if option is not None else value
    for o in OPTIONS.values():
        if kind in o.kinds and o.name not in out:
            if o.type == "list":
                out[o.name] = []
            elif o.default is not None:
                out[o.name] = o.value(o.default, 0)
    return out
