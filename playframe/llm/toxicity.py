"""Toxic passages as maximal scoring segments of token log-odds.

Learning, on a bounded sample of labelled rows:

* Texts with one least hash over their five-word runs, mostly near copies, share one
  document's weight and are in the same half; no labelled row is left out.
* Units are words and their prefixes of ``PREFIXES`` letters. The weights of documents
  with a unit by class give its log-odds under an informative Dirichlet prior whose
  mass per unit is ``PRIOR`` times its count. Units with an effect and a z-value
  beyond the thresholds form the lexicon.
* A token scores as its longest lexicon unit; every other token costs ``DRIFT``.
* Each half of the sample is scored by the lexicon of the other half. From that,
  extreme-value parameters come from clean documents (lambda solves
  E[exp(lambda * score)] = 1, K matches the segments seen) and a logistic curve maps
  a document's evidence to a probability. The lexicon used is that of the whole sample.

Scoring, on every whole text: one linear scan finds all maximal segments. A segment
of score S in m tokens has E-value K * m * exp(-lambda * S); the evidence of a
document is the sum of -log E over its segments with E < 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop, slices, worker_state, written
from .minhash import shingle_set

#: Labelled rows to learn from, at most; the rows with the smallest seeded hash.
SAMPLE = 20_000
PREFIXES = (4, 5, 6)
PRIOR = 0.1
MIN_EFFECT = 1.0
MIN_Z = 2.5
#: Cost of a token outside the lexicon: what a passage may hold of them between two hits.
DRIFT = 0.05
#: Token scores a Python worker keeps, some 150 bytes each, and the longest token kept.
MEMO_WORDS, MEMO_CHARS = 200_000, 64
TOKEN = re.compile(r"\w+")
#: Columns of unit counts: clean and toxic documents of each half.
PARTS = ("clean0", "toxic0", "clean1", "toxic1")


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    base: float = -20.0

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * evidence))))


def units(token: str) -> list[str]:
    """A token's units from long to short: the word itself, marked by a final stop, then its prefixes."""
    return [token + ".", *(token[:k] for k in reversed(PREFIXES) if len(token) >= k)]


class _Memo(dict):
    """Token to score; 0 outside the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        found = next((self.lexicon[u] for u in units(token) if u in self.lexicon), 0.0)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[token] = found
        return found


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sequence.

    ``hits`` are the positions and scores of its tokens that don't cost ``drift``. A
    segment's score is a difference of two running totals; each step keeps those
    candidates that no later one can absorb. Each keeps a link to the nearest earlier
    one whose total before it is smaller: a search follows links, so it passes no
    candidate that an earlier search has passed, and the scan is linear.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    link: list[int] = []
    total, at = 0.0, 0
    for i, score in hits:
        total -= drift * (i - at)
        at = i + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, k = i, len(found) - 1
        while k >= 0 and found[k][2] >= before:
            k = link[k]
        while k >= 0 and found[k][3] < total:
            first, before, up = found[k][0], found[k][2], link[k]
            del found[k:], link[k:]
            k = up
        found.append((first, i, before, total))
        link.append(k)
    return [(a, b, after - before) for a, b, before, after in found]


def _hits(text: str | None, memo: _Memo) -> tuple[list[tuple[int, float]], int]:
    scores = list(map(memo.__getitem__, TOKEN.findall(text.lower()))) if text else []
    return [(i, s) for i, s in enumerate(scores) if s], len(scores)


def held_out(row_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(y, half, weight, text) of at most ``sample`` labelled ids that aren't held out.

    The ids are broadcast, which ``sample`` bounds. Texts stay in Spark; what learning
    brings to the driver is the units beyond the thresholds, of which whole texts of
    ``sample`` rows can hold no more than they have words and prefixes.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull() & ~held_out(f"`{row_id}`")).groupBy(F.col(f"`{row_id}`").alias("_id")).agg(F.max(f"`{label}`").alias("y"))
    order = F.xxhash64(F.col("_id"), F.lit(17))
    chosen = known.select("_id", F.col("y").cast("int").alias("y"), order.alias("_order")).orderBy("_order").limit(sample)
    rows = docs.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen.select("_id", "y")), "_id").where("text is not null")
    kind = rows.select("_id").dtypes[0][1]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            least = [int(runs[0]) >> 1 if len(runs) else 0 for runs in map(shingle_set, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "_sketch"])

    rows = written(rows.select("_id", "y", "text").mapInArrow(sketched, f"_id {kind}, y int, text string, _sketch long"))
    weights = rows.groupBy(F.col("_sketch").alias("_of")).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    rows = rows.join(weights, F.col("_sketch") == F.col("_of"))
    return rows.select("y", F.pmod(F.xxhash64("_sketch"), F.lit(2)).cast("int").alias("half"), "weight", "text")


def _lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons learned from half 0, half 1 and the whole sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[str, float]] = [defaultdict(float) for _ in range(4)]
        for b in slices(batches):
            for y, half, weight, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = seen[2 * half + (y > 0)]
                for unit in {u for t in set(TOKEN.findall(text.lower())) for u in units(t)}:
                    own[unit] += weight
        names = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x.get(n, 0.0) for n in names], pa.float64()) for x in seen)], names=["unit", *PARTS])

    counts = sample.select("y", "half", "weight", "text").mapInArrow(count, "unit string, " + ", ".join(f"{c} double" for c in PARTS))
    counts = written(counts.groupBy("unit").agg(*[F.round(F.sum(c), 6).alias(c) for c in PARTS]))
    whole = (F.col("clean0") + F.col("clean1"), F.col("toxic0") + F.col("toxic1"))
    found = [_lexicon(counts.select("unit", a.alias("clean"), b.alias("toxic"))) for a, b in ((F.col("clean0"), F.col("toxic0")), (F.col("clean1"), F.col("toxic1")), whole)]
    drop(counts)
    return found


def _lexicon(counts: DataFrame) -> dict[str, float]:
    toxic, clean = counts.agg(F.coalesce(F.round(F.sum("toxic"), 3), F.lit(0.0)), F.coalesce(F.round(F.sum("clean"), 3), F.lit(0.0))).first()
    if not toxic or not clean:
        return {}
    counts = counts.where("toxic + clean > 0")
    prior, mass = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")), PRIOR * (toxic + clean)

    def log_odds(name: str, total: float) -> Column:
        return F.log((F.col(name) + prior) / (total + mass - F.col(name) - prior))

    scored = counts.withColumn("score", log_odds("toxic", toxic) - log_odds("clean", clean))
    scored = scored.withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    kept = scored.where((F.abs("score") >= MIN_EFFECT) & (F.abs("z") >= MIN_Z)).select("unit", "score")
    return {r.unit: r.score for r in kept.collect()}


def _evidence(segments: list[tuple[int, int, float]], tokens: int, decay: float, log_k: float) -> float:
    return sum(max(0.0, decay * s - log_k - math.log(tokens)) for _, _, s in segments)


def _decay(hits: dict[float, float], tokens: float) -> float:
    """The positive root of E[exp(x * score)] = 1 over the clean tokens, by bisection."""
    rest = max(1.0, tokens - sum(hits.values()))

    def excess(x: float) -> float:
        return (sum(n * math.exp(min(700.0, x * s)) for s, n in hits.items()) + rest * math.exp(-x * DRIFT)) / (rest + sum(hits.values())) - 1.0

    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, base) by Newton's method on weighted rows; a small ridge keeps separable classes finite."""
    beta, a = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        ridge = np.array([1e-2, 1e-4])
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents whose id isn't held out.

    Null labels are ignored; of several labels of one id the largest holds. Without
    both classes the lexicon is empty and every score is near 0.
    """
    rows = written(training_sample(docs, labels, row_id, text, label, sample))
    *halves, lexicon = _lexicons(rows)
    if not lexicon:
        drop(rows)
        return Model()

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean documents, scored by the lexicon of the other half: how often each score comes; null for tokens, NaN for segments."""
        memos = [_Memo(x) for x in reversed(halves)]
        scores: dict[float, float] = defaultdict(float)
        tokens = segments = 0.0
        for b in slices(batches):
            for y, half, weight, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hits, n = _hits(t, memos[half]) if not y else ([], 0)
                tokens += weight * n
                segments += weight * len(maximal_segments(hits))
                for _, s in hits:
                    scores[s] += weight
        yield pa.RecordBatch.from_arrays([pa.array([None, math.nan, *scores], pa.float64()), pa.array([tokens, segments, *scores.values()], pa.float64())], names=["score", "n"])

    # One row for each score of the lexicons.
    seen = {r.score if r.score == r.score else "segments": r.n for r in rows.select("y", "half", "weight", "text").mapInArrow(observed, "score double, n double").groupBy("score").agg(F.round(F.sum("n"), 6).alias("n")).collect()}
    tokens, segments = seen.pop(None, 0.0) + 1, seen.pop("segments", 0.0)
    seen[max(lexicon.values())] = seen.get(max(lexicon.values()), 0.0) + 1
    decay = _decay(seen, tokens)
    least = min(s for s in lexicon.values() if s > 0) if max(lexicon.values()) > 0 else 1.0
    log_k = math.log((segments + 0.5) / tokens) + decay * least

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [_Memo(x) for x in reversed(halves)]
        for b in slices(batches):
            out = []
            for half, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                hits, n = _hits(t, memos[half])
                out.append(_evidence(maximal_segments(hits), n, decay, log_k) if n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64())], names=["y", "weight", "evidence"])

    # Three numbers for each of at most ``sample`` labelled documents.
    found = rows.select("y", "half", "weight", "text").mapInArrow(evidences, "y int, weight double, evidence double").where("evidence is not null").groupBy("y", F.round("evidence", 9).alias("evidence")).agg(F.round(F.sum("weight"), 6).alias("weight")).orderBy("evidence", "y").toPandas()
    drop(rows)
    if not len(found):
        return Model()
    slope, base = _logistic(found["evidence"].to_numpy(float), (found["y"] > 0).to_numpy(float), found["weight"].to_numpy(float))
    return Model(lexicon, decay, log_k, slope, base)


SEGMENT = pa.struct([("first_char", pa.int64()), ("end_char", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: ``score`` in [0, 1], and ``passages``, its significant segments with character ranges of the text.

    Adds two columns to all columns of ``docs`` (replacing any so named). Null and
    empty texts score as texts without evidence. Only the text decides.
    """
    m = model  # goes with the function; Spark broadcasts functions that are large

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        if state.get("toxicity_lexicon") != m.lexicon:
            state["toxicity_lexicon"], state["toxicity_memo"] = m.lexicon, _Memo(m.lexicon)
        memo = state["toxicity_memo"]
        for b in slices(batches):
            scores, passages = [], []
            for t in b.column(at).to_pylist():
                hits, n = _hits(t, memo)
                segments = maximal_segments(hits) if hits else []
                scores.append(m.probability(_evidence(segments, n, m.decay, m.log_k) if segments else 0.0))
                own = [(a, z, s, math.exp(min(0.0, m.log_k + math.log(n) - m.decay * s))) for a, z, s in segments if m.decay * s > m.log_k + math.log(n)]
                if own:  # lower-casing may change a text's length: ranges come from the text itself where it doesn't
                    lower = t.lower()
                    spans = [x.span() for x in TOKEN.finditer(lower if len(lower) == len(t) else t)]
                    own = [(a, z, s, e) for a, z, s, e in own if z < len(spans)]
                passages.append([{"first_char": spans[a][0], "end_char": spans[z][1], "score": s, "e_value": e} for a, z, s, e in own])
            columns = [*b.columns[:kept], pa.array(scores, pa.float64()), pa.array(passages, pa.list_(SEGMENT))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    # Names that hold dots or clash never reach the task: columns go by their place, and the text goes once.
    keep = [c for c in docs.columns if c not in ("score", "passages")]
    sent = keep if text in keep else [*keep, text]
    at, kept = sent.index(text), len(keep)
    placed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    added = StructType.fromDDL(f"c{kept} double, c{kept + 1} array<struct<first_char: long, end_char: long, score: double, e_value: double>>")
    return placed.mapInArrow(scan, StructType([*placed.schema.fields[:kept], *added.fields])).toDF(*keep, "score", "passages")


def clean_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, with the columns of ``docs``, whatever their names.

    Null and empty texts have no evidence and stay; repeated rows are judged alike; an
    empty table gives no rows. Every row is scored on its whole text.
    """
    names = docs.columns
    placed = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    kept = score(placed, model, text=f"k{names.index(text)}").where(F.col("score") < threshold)
    return kept.drop("score", "passages").toDF(*names)
