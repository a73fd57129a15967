"""Quality rules: fixed rules on counts of a text, then boosted trees over its statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.boosting import Forest, fit
from candlemill.llm.common import extended, labelled, per_batch, texts, with_columns

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

# Statistics of a text, and which way a score may go as each rises (0: either).
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "repeated_line_share": -1, "repeated_word_share": -1,
    "upper_share": -1, "digit_share": 0, "exclamation_share": -1, "bare_symbol_share": -1, "distinct_share": 0,
    "longest_run": -1, "line_words": 0, "ended_share": 0,
}
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    mixed = hashes.view(np.uint64)
    keys = mixed[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mixed[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0  # different hashes, different windows
    at = np.flatnonzero(np.isin(keys, twice)).tolist()
    windows = [(words[i], words[i + 1], words[i + 2]) for i in at]
    seen = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, w in zip(at, windows):
        if seen[w] > 1:
            covered[i:i + 3] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of the base rules, and the statistics."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    code_points = len(text.decode("utf-8", "replace"))
    chars = code_points - (len(text) - len(joined))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated_lines = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n)
    repeated = repeated_words(words, hashes)
    same = np.flatnonzero(np.append(hashes[1:] != hashes[:-1], True)) if n else np.zeros(0, int)
    run = int(np.diff(same, prepend=-1).max()) if n else 0
    c, m = max(chars, 1), max(n, 1)
    bare = sum(map(words.count, (b"|", b"#", b"*", b"&", b"<", b">"))) if symbols else 0
    return [n, chars, symbols, repeated_lines, repeated], [
        np.log1p(n), chars / m, symbols / c, repeated_lines / max(len(lines), 1), repeated / m,
        (len(joined) - len(joined.translate(None, UPPER))) / c, (len(joined) - len(joined.translate(None, DIGITS))) / c,
        text.count(b"!") / m, bare / m, len(np.unique(hashes)) / m, min(run, 20), n / max(len(lines), 1),
        (text.count(b".\n") + text.rstrip().endswith(b".")) / max(len(lines), 1)]


def measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = [measure(t) for t in texts(batch)]
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
    return counts, np.array([r[1] for r in rows], float).reshape(-1, len(STATISTICS))


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Forest:
    """Trees fitted on the quality labels of at most ``most`` documents (not the held-out ones)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = measured(batch)[1]
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["x", "label"])

    sample = labelled(docs, labels, "quality", most).mapInArrow(per_batch(run), "x array<double>, label int").toArrow()
    x = np.array(sample["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(sample["label"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive must not matter
    return fit(x[order], y[order], list(STATISTICS.values()))


def _judge(forest: Forest, threshold: float) -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
    def judge(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, x = measured(batch)
        n, repeated = counts[:, 0], counts[:, 4]
        failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
        score = forest.score(x)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {k: pa.array(counts[:, i]) for i, k in enumerate(names)} | {
            "base_failed": pa.array(failed), "rule_score": pa.array(score), "kept": pa.array(~failed & (score >= threshold))}

    return judge


def judge_quality(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_score and kept.

    Rows stay where they are. Null and empty texts have no words and so fail. Repeated rows are judged alike.
    Columns of these names in the input are replaced; others come through. An empty table gives an empty result.
    """
    judge = _judge(forest, threshold)
    run = per_batch(lambda batch: with_columns(batch, judge(batch)))
    return docs.mapInArrow(run, extended(docs.schema, BASE + ", rule_score double, kept boolean"))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    judge = _judge(forest, threshold)
    return docs.mapInArrow(per_batch(lambda batch: batch.filter(judge(batch)["kept"])), docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = judge_quality(docs.select("doc_id", "text"), fit_rules(docs, labels))
    return found.select("doc_id", *(c.split()[0] for c in BASE.split(", ")), "kept", F.round("rule_score", 6).alias("rule_score"))
