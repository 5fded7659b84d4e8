"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SYMBOLS = "#*$%&|<>"
#: Words of windows that count as repeated.
WINDOW = 3
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper_words", "n_shout_words", "n_marked_words", "n_distinct"]


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS``; words are runs of characters other than space and 0x09-0x0D."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = np.zeros(len(words) + WINDOW, bool)
        at = np.fromiter((i for i, w in enumerate(windows) if w in often), np.int64)
        for j in range(WINDOW):
            covered[at + j] = True
        repeated = int(covered.sum())
    decoded = [w.decode("utf-8", "replace") for w in words]
    letters = sum(map(str.isalpha, text))
    upper = sum(w.isupper() and len(w) > 1 for w in decoded)
    shout = sum(w.endswith(("!!", "??")) for w in decoded)
    marked = sum(not w[-1].isalnum() and w[-1] in "#*$%&|<>=+^~\\_@" for w in decoded)
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), letters, upper, shout, marked, len(set(words))


def _share(part: str, whole: str, bad: float, good: float) -> Column:
    """Votes -1 above the share ``bad``, 1 up to ``good``, and abstains (0) between."""
    a, b = F.col(part).cast("double"), F.greatest(F.col(whole), F.lit(1)).cast("double")
    return F.when(a > bad * b, -1).when(a <= good * b, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: -1 against, 1 for, 0 abstains."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": F.when(F.col("n_words") < 50, -1).when(F.col("n_words") >= 80, 1).otherwise(0),
        "word_length": F.when((mean < 2.0) | (mean > 15.0), -1).when((mean >= 3.0) & (mean <= 10.0), 1).otherwise(0),
        "symbols": _share("n_symbols", "n_words", 0.1, 0.03),
        "dup_lines": _share("n_dup_lines", "n_lines", 0.5, 0.35),
        "repeats": _share("n_repeat_words", "n_words", 0.5, 0.3),
        "letters": F.when(F.col("n_letters") < 0.6 * F.col("word_chars"), -1).when(F.col("n_letters") >= 0.8 * F.col("word_chars"), 1).otherwise(0),
        "capitals": _share("n_upper_words", "n_words", 0.3, 0.1),
        "shouting": _share("n_shout_words", "n_words", 0.1, 0.02),
        "marks": _share("n_marked_words", "n_words", 0.1, 0.03),
        "variety": F.when(F.col("n_distinct") < 0.15 * F.col("n_words"), -1).when(F.col("n_distinct") >= 0.3 * F.col("n_words"), 1).otherwise(0),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.85, rounds: int = 200, strength: float = 10.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(vote | good), P(vote | bad), P(good)) by expectation-maximisation over vote patterns.

    patterns: rows of -1, 0, 1; counts: how many documents have each. The tables are (rules, 3) for the
    votes -1, 0, 1. It starts from rules that are right more often than not, and Dirichlet
    pseudo-counts of ``strength`` documents keep it there where the data say nothing.
    """
    rules = patterns.shape[1]
    start_good, start_bad = np.array([0.02, 0.08, 0.9]), np.array([0.3, 0.1, 0.6])
    good, bad, share = np.tile(start_good, (rules, 1)), np.tile(start_bad, (rules, 1)), prior
    one_hot = patterns[:, :, None] == np.array([-1, 0, 1])
    counts = counts.astype(float)
    for _ in range(rounds):
        p = posterior(patterns, good, bad, share)
        new_good = np.einsum("p,prk->rk", counts * p, one_hot) + strength * start_good
        new_bad = np.einsum("p,prk->rk", counts * (1 - p), one_hot) + strength * start_bad
        new_good /= new_good.sum(1, keepdims=True)
        new_bad /= new_bad.sum(1, keepdims=True)
        new_share = (counts @ p + strength * prior) / (counts.sum() + strength)
        done = max(np.abs(new_good - good).max(), np.abs(new_bad - bad).max(), abs(new_share - share)) < 1e-9
        good, bad, share = new_good, new_bad, float(new_share)
        if done:
            break
    return good, bad, share


def posterior(patterns: np.ndarray, good: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    """P(good | votes) of each row of votes."""
    at = np.arange(patterns.shape[1])
    log = np.log(share) - np.log1p(-share) + (np.log(good[at, patterns + 1]) - np.log(bad[at, patterns + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(log, -500, 500)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """For every row: its counts, ``base_failed``, ``probability`` (of good quality) and ``kept``.

    The base rule fails texts of fewer than 50 words and texts whose repeated 3-word windows cover over
    half their words. Beside it, ten rules vote or abstain; their accuracies are estimated over all rows
    of ``docs`` by expectation-maximisation, for which only the number of rows of each vote pattern comes to
    the driver: at most 3**10 patterns, however many rows there are. ``kept`` is false where the base rule
    fails, and else true where the posterior probability reaches ``threshold``.

    Null text counts as empty, which the base rule fails. Repeated rows are scored alike; null ids stay.
    An empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *_COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    rules = votes()
    counted = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    counted = cut(counted.withColumn("pattern", F.concat(*[(v + 1).cast("string") for v in rules.values()])))
    found = counted.groupBy("pattern").count().collect()
    scores = []
    if found:
        patterns = np.array([[int(c) - 1 for c in r["pattern"]] for r in found])
        p = posterior(patterns, *fit(patterns, np.array([r["count"] for r in found])))
        scores = [(r["pattern"], float(x)) for r, x in zip(found, p, strict=True)]
    table = docs.sparkSession.createDataFrame(scores, "pattern string, probability double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # as many rows as there are patterns: 3**10 at most
    out = counted.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
