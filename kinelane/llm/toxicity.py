"""Toxic passages as maximal scoring segments of token log-odds, judged against the extremes of clean documents."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelane.llm.common import filter_pass, small, stored, text_of
from kinelane.llm.rolling import _BYTE, _ROOT, SEGMENT, _between, _prefix, mix, window_hashes

#: Labelled documents the model is fitted on, at most: those with the least hash of their id.
TRAIN_ROWS = 24_000
#: The least documents of the bounded sample for a token's statistics to be kept; the sample bounds their number.
LEAST = 3
#: Prior weights, in documents: of a prefix for its longer prefix or word, and of the overall rate for a prefix.
PRIOR = 20.0
#: Taken off every token, so that ordinary text drifts down and segments end.
DRIFT = 0.25
PREFIXES = (4, 6)
#: Standard errors by which positive log-odds are lowered, so that rare tokens do not pass for toxic ones.
CAUTION = 1.5
PREDICTED = 0.7
#: Evidence (nats) beyond which a document is no more certain for the calibration.
EVIDENCE = 40.0
TAIL = 0.98

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123), *range(0x80, 0x100)]] = True


def tokens(text: str) -> np.ndarray:
    """Hashes of a text's tokens (runs of letters and digits, lower case), a row for each PREFIXES and the whole."""
    raw = text.lower().encode()
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and _TOKEN[raw[end]]:
            end += 1
        own = np.frombuffer(raw, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(_TOKEN[own].astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            prefix = _prefix(_BYTE[own], _ROOT)
            levels = [mix(_between(prefix, starts, np.minimum(ends, starts + k), _ROOT) ^ np.uint64(k)) for k in PREFIXES]
            found.append(np.stack([*levels, mix(_between(prefix, starts, ends, _ROOT))]))
        at = end
    return np.concatenate(found, 1) if found else np.empty((len(PREFIXES) + 1, 0), np.uint64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time.

    Runs of equal sign are added up first. A candidate is merged with those before it as long as one of them begins
    lower and ends lower; what remains cannot be extended or cut without losing score.
    """
    up = scores > 0
    if not up.any():
        return []
    cuts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    sums = np.add.reduceat(scores, cuts)
    ends = np.append(cuts[1:], len(scores))
    total, found = 0.0, []  # found: begin, end, total before, total after
    for begin, end, score in zip(cuts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if score <= 0:
            total += score
            continue
        own = [begin, end, total, total + score]
        total += score
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= own[2]:
                k -= 1
            if k < 0 or found[k][3] >= own[3]:
                break
            own[0], own[2] = found[k][0], found[k][2]
            del found[k:]
        found.append(own)
    return [(b, e, r - l) for b, e, l, r in found]


class Model(NamedTuple):
    """Token scores by hash for every level, and the calibration of segment scores."""

    keys: list[np.ndarray]
    scores: list[np.ndarray]
    # Extreme-value law of the best segment of n clean tokens: location + growth * log(n), and the scale around it.
    location: float = 0.0
    growth: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def token_scores(self, levels: np.ndarray) -> np.ndarray:
        """Score of the longest level known for each token, less the drift.

        The odds are those of a document having the token at all, so the k-th occurrence adds a k-th of a positive score.
        """
        out = np.zeros(levels.shape[1])
        for hashes, keys, scores in zip(levels, self.keys, self.scores, strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, scores[at], out)
        up = np.flatnonzero(out > 0)
        if len(up):
            _, which = np.unique(levels[-1][up], return_inverse=True)
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], which[order])
            out[up[order]] /= np.arange(1, len(up) + 1) - first
        return out - DRIFT

    def evidence(self, scores: list[float], words: int) -> float:
        """Nats by which all significant segments exceed what the best segment of so much clean text reaches."""
        bar = self.location + self.growth * np.log(max(words, 1))
        return min(EVIDENCE, float(sum(max(0.0, (s - bar) / self.scale) for s in scores)))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Chance of toxicity, and the significant passages (begin, end, score)."""
        levels = tokens(text)
        words = levels.shape[1]
        found = segments(self.token_scores(levels))
        x = self.slope * self.evidence([s for _, _, s in found], words) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), [f for f in found if self.evidence([f[2]], words) > 0]


def log_odds(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], toxic: int, clean: int) -> Model:
    """Scores from document counts (hash, hash of the level above, toxic, clean) of each level, shortest first.

    The rate of a token has a Dirichlet prior of weight PRIOR around the rate of its prefix, whose own prior is around
    the overall rate; the score is the posterior log-odds against the overall odds, where positive at their lower bound.
    """
    overall = (toxic + 1) / (toxic + clean + 2)
    base = np.log(overall / (1 - overall))
    keys, scores, rates = [], [], []
    for k, (own, above, bad, good) in enumerate(levels):
        prior = np.full(len(own), overall)
        if k and len(keys[-1]):
            at = np.minimum(np.searchsorted(keys[-1], above), len(keys[-1]) - 1)
            prior = np.where(keys[-1][at] == above, rates[-1][at], overall)
        rate = (bad + PRIOR * prior) / (bad + good + PRIOR)
        order = np.argsort(own)
        keys.append(own[order])
        rates.append(rate[order])
        odds = np.log(rate / (1 - rate)) - base
        error = np.sqrt(1 / (bad + PRIOR * prior) + 1 / (good + PRIOR * (1 - prior)))
        scores.append(np.where(odds > 0, np.maximum(0, odds - CAUTION * error), odds)[order])
    return Model(keys, scores)


def calibrate(model: Model, found: list[tuple[int, int, list[float]]]) -> Model:
    """``found``: (label, words, segment scores) of documents that the token scores were not learnt from.

    The best segments of clean documents follow an extreme-value law in score and log length: its growth is fitted by
    least squares, location and scale from the median and the TAIL quantile, which a few wrong labels do not move. Evidence beyond it becomes a
    probability by logistic regression.
    """
    clean = [(n, max(s, default=0.0)) for y, n, s in found if not y and n]
    if len(clean) > 20:
        log_n, best = np.log([n for n, _ in clean]), np.array([m for _, m in clean])
        spread = log_n - log_n.mean()
        growth = float(max(0.0, (spread @ best) / max(spread @ spread, 1e-9)))
        middle, high = np.quantile(best - growth * log_n, (0.5, TAIL))
        level = [-np.log(-np.log(q)) for q in (0.5, TAIL)]  # of the standard law
        scale = float(max((high - middle) / (level[1] - level[0]), 0.1))
        model = model._replace(growth=growth, scale=scale, location=float(middle - scale * level[0]))
    x = np.array([model.evidence(s, n) for _, n, s in found])
    y = np.array([label for label, _, _ in found], float)
    if len(y) == 0 or y.min() == y.max():
        return model._replace(shift=-2.0)
    a = np.stack([x / EVIDENCE, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(100):  # Newton steps, shortened where they would overshoot
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (y - p) - 0.1 * w)
        w = w + step / max(1.0, np.abs(step).max())
    return model._replace(slope=float(max(w[0], 1e-3)) / EVIDENCE, shift=float(w[1]))


def _train_ids(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out third, half of them for counts and half to calibrate.

    They are chosen among the labels of ``docs``, so that labels of other documents take no place in the sample.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return first.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One row of each group of copies in the bounded sample, else the rare words of a copied document count as many.

    Copies share the least hash of their three-token windows, or another such hash, unless chance parts them in both.
    """

    def keys(batches):
        for batch in batches:
            for part in small(batch):
                found = []
                for text in part.column(1).to_pylist():
                    windows = window_hashes(tokens(text)[-1], 3)
                    least = [windows.min(), mix(windows).min()] if len(windows) else [mix(np.array([hash_bytes(text)], np.uint64))[0]] * 2
                    found.append(np.array(least, np.uint64).view(np.int64))
                k1, k2 = np.array(found).T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1), pa.array(k2)], names=["doc_id", "k1", "k2"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.select("doc_id", "text").mapInArrow(keys, f"doc_id {kind}, k1 long, k2 long")
    one = found.groupBy("k1").agg(F.min(F.struct("doc_id", "k2")).alias("one")).select("one.*")
    one = one.groupBy("k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return stored(sample.join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id"]), "distinct")


def hash_bytes(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def held_out(column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """``docs``: doc_id, text. Sends the token counts of a sample of ``rows`` documents, and their calibration rows, to the driver.

    The calibration is fitted on the half that the token scores in it did not see; the final scores are from both halves.
    """
    sample = _without_copies(stored(docs.join(F.broadcast(_train_ids(docs, labels, rows)), "doc_id"), "sample")).select("text", "toxic", "half")
    depth = len(PREFIXES) + 1

    def count(batches):
        for batch in batches:
            for part in small(batch):
                held = [[] for _ in range(4)]  # level, (hash, hash above), toxic, half
                for text, toxic, half in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    levels = tokens(text)
                    for k in range(depth):
                        own, first = np.unique(levels[k], return_index=True)
                        above = levels[max(k - 1, 0)][first]
                        held[0].append(np.full(len(own), k))
                        held[1].append(np.stack([own, above]))
                        held[2].append(np.full(len(own), toxic))
                        held[3].append(np.full(len(own), half))
                level, pair = np.concatenate(held[0]), np.concatenate(held[1], 1)
                order = np.lexsort((pair[0], level))
                level, pair = level[order], pair[:, order]
                toxic, half = np.concatenate(held[2])[order], np.concatenate(held[3])[order]
                cuts = np.flatnonzero((np.diff(level, prepend=-1) != 0) | np.concatenate([[True], pair[0][1:] != pair[0][:-1]])[: len(level)])
                if len(cuts):
                    kinds = [np.add.reduceat((toxic == t) & (half <= h), cuts, dtype=np.int64) for h in (0, 1) for t in (1, 0)]
                    columns = [level[cuts].astype(np.int32), pair[0][cuts].view(np.int64), pair[1][cuts].view(np.int64), *kinds]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["level", "own", "above", "bad_half", "good_half", "bad", "good"]
    counted = sample.mapInArrow(count, "level int, " + ", ".join(f"{n} long" for n in names[1:]))
    table = counted.groupBy("level", "own").agg(F.min("above").alias("above"), *[F.sum(n).alias(n) for n in names[3:]])
    kept = table.filter(F.col("bad") + F.col("good") >= LEAST).toPandas().sort_values(["level", "own"])
    sizes = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}

    def model_of(suffix: str, halves: tuple[int, ...]) -> Model:
        levels = []
        for k in range(depth):
            own = kept[kept["level"] == k]
            hashes = [own[n].to_numpy(np.int64).view(np.uint64) for n in ("own", "above")]
            levels.append((*hashes, own[f"bad{suffix}"].to_numpy(float), own[f"good{suffix}"].to_numpy(float)))
        return log_odds(levels, *[sum(sizes.get((t, h), 0) for h in halves) for t in (1, 0)])

    model = model_of("_half", (0,))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def probe(batches):
        for batch in batches:
            for part in small(batch):
                out = [[], [], []]
                for text, toxic, _ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    levels = tokens(text)
                    found = sorted((s for _, _, s in segments(shared.value.token_scores(levels))), reverse=True)
                    for column, value in zip(out, (toxic, levels.shape[1], found), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], names=["toxic", "words", "found"])

    probed = sample.filter("half = 1").mapInArrow(probe, "toxic int, words long, found array<double>")
    fitted = calibrate(model, [(r["toxic"], r["words"], list(r["found"])) for r in probed.collect()])
    whole = model_of("", (0, 1))
    return fitted._replace(keys=whole.keys, scores=whole.scores)


PASSAGE = "array<struct<begin:long,end:long,score:double>>"


def toxic_passages(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, passages``: the chance of toxicity and the significant passages (token numbers, nats).

    One pass over whole texts. Null text is empty and scored like it; null ids, repeated rows and an empty table pass
    through row by row; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_column].dataType.simpleString()
    passage = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in small(batch):
                score, passages = [], []
                for text in part.column(1).to_pylist():
                    chance, found = own.score(text)
                    score.append(chance)
                    passages.append([{"begin": b, "end": e, "score": s} for b, e, s in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(passages, passage)], names=["doc_id", "score", "passages"])

    slim = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, score double, passages {PASSAGE}")


def keep_clean(df: DataFrame, model: Model, limit: float = PREDICTED, text_column: str = "text") -> DataFrame:
    """Rows of ``df``, with all columns, whose toxicity score is below ``limit``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_pass(df, lambda texts: [shared.value.score(t)[0] < limit for t in texts], text_column)


def toxicity(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` per row; learnt from the labelled rows that are not held out.

    ``held_out``: crc32 of the id as text leaves remainder 1 by 3 (null ids: false). Without labels of both kinds every
    score is low and nothing is predicted.
    """
    docs = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    model = train(docs, labels)
    found = toxic_passages(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "passages")
