"""Quality rules: fixed limits on document statistics, then boosted trees over all statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.boosting import Trees, fit
from kinelane.llm.common import arrow_pass, filter_pass, text_of
from kinelane.llm.rolling import WORD_BYTE, window_hashes, word_hashes

#: Labelled documents that the trees are fitted on, at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
#: A document is kept if the trees give at least this probability of good quality.
KEEP = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further statistics, as shares: of words, characters or lines.
SHARES = {
    "symbols_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "upper_share": -1,
    "shout_share": -1,
    "digit_share": 0,
    "mean_word": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "punctuation_share": 0,
    "odd_share": -1,
    "log_words": 0,
}
_SYMBOLS, _SHOUTS, _MARKS = (np.frombuffer(s, np.uint8) for s in (b"#*$%&|<>", b"!?", b".,;:'\"()-"))


def statistics(text: str) -> list[float]:
    """COUNTS, then SHARES, of a whole text."""
    raw = text.encode()
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(bytes_.sum() - bytes_[0x80:0xC0].sum())
    word_chars = points - int(bytes_[~WORD_BYTE].sum())
    symbols = int(bytes_[_SYMBOLS].sum())
    hashes = word_hashes(raw)
    n = len(hashes)
    repeated = repeat_words(hashes)
    lines = text.split("\n")
    seen: set[str] = set()
    dup_lines = with_word = 0
    for line in lines:
        if line.strip(" \t\x0b\x0c\r"):
            with_word += 1
            dup_lines += line in seen
            seen.add(line)
    letters = int(bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[0xC0:].sum())
    words, chars = max(n, 1), max(word_chars, 1)
    shares = [
        symbols / words,
        repeated / words,
        dup_lines / max(with_word, 1),
        int(bytes_[65:91].sum()) / max(letters, 1),
        int(bytes_[_SHOUTS].sum()) / words,
        int(bytes_[48:58].sum()) / chars,
        word_chars / words,
        len(np.unique(hashes)) / words,
        n / max(with_word, 1),
        int(bytes_[_MARKS].sum()) / words,
        int(bytes_[:32].sum() - bytes_[9:14].sum() + bytes_[127]) / chars,
        float(np.log1p(n)),
    ]
    return [n, word_chars, symbols, dup_lines, repeated, *shares]


def repeat_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside a window of ``width`` words that is found twice or more in the text, the first included."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def document_statistics(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, COUNTS (long) and SHARES (double) per row; null text has no words. Other columns are not read."""

    def work(rows: dict[str, list]) -> dict[str, object]:
        found = np.array([statistics(t) for t in rows["text"]], float).reshape(len(rows["text"]), -1)
        made = {n: pa.array(found[:, i].astype(np.int64)) for i, n in enumerate(COUNTS)}
        made |= {n: pa.array(found[:, len(COUNTS) + i]) for i, n in enumerate(SHARES)}
        return {"doc_id": rows["doc_id"], **made}

    kind = df.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} long" for n in COUNTS], *[f"{n} double" for n in SHARES]])
    return arrow_pass(df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text")), work, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents (``labels``: doc_id, quality 0 or 1; nulls are left out).

    ``docs``: doc_id, text. The ids are chosen among the labels of ``docs``, at most ``rows``, so they are broadcast and no
    text is shuffled.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(F.broadcast(known), "doc_id").select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    sample = document_statistics(chosen).select("doc_id.quality", *SHARES).toPandas()
    x = sample[list(SHARES)].to_numpy(float).reshape(len(sample), len(SHARES))
    ways = {i: way for i, way in enumerate(SHARES.values()) if way}
    return fit(x, sample["quality"].to_numpy(float), ways)


def verdicts(found: np.ndarray, trees: Trees, keep: float = KEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base failed, kept, score) of rows of ``statistics``."""
    score = trees.score(found[:, len(COUNTS) :])
    n, repeated = found[:, 0], found[:, COUNTS.index("n_repeat_words")]
    failed = (n < 50) | (100 * repeated > 50 * n)
    return failed, ~failed & (score >= keep), score


def judge(stats: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed``, ``kept``, ``score`` from ``document_statistics``."""
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def run(batches):
        for batch in batches:
            found = np.stack([batch.column(n).to_numpy().astype(float) for n in (*COUNTS, *SHARES)], 1)
            made = [pa.array(column) for column in verdicts(found, trees, keep)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in COUNTS], *made], names=names)

    kind = stats.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} long" for n in COUNTS], "base_failed boolean, kept boolean, score double"])
    return stats.mapInArrow(run, schema)


def quality_rules(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics and verdict per row of ``df``; the trees are fitted on labelled rows of ``df`` itself.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows. ``kept`` is false for those
    and for rows that the trees score below KEEP. Null and empty texts have no words and fail the base; null ids are
    judged like others (and never labelled); repeated rows repeat; without any labels every score is the same even
    chance, which keeps; an empty table gives no rows.
    """
    docs = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    return judge(document_statistics(docs), train(docs, labels))


def keep_good(df: DataFrame, trees: Trees, text_column: str = "text") -> DataFrame:
    """Rows of ``df``, with all columns, that pass the base limits and the trees."""

    def verdict(texts: list[str]) -> list[bool]:
        return verdicts(np.array([statistics(t) for t in texts], float).reshape(len(texts), -1), trees)[1].tolist()

    return filter_pass(df, verdict, text_column)
