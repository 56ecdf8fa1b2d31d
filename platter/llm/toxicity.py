"""Toxicity by maximum-scoring segments (operator 2).

Model, learnt from a bounded sample of labelled documents: a token's score is
the log-odds of toxic against clean under Dirichlet priors. Priors are nested:
the base rate is the prior of a token's first `STEMS[0]` letters, these of its
first `STEMS[1]` letters, and so on up to the token itself, so a rare or new
form of a known stem takes the stem's evidence and an unknown token none. A
drift taken off every score makes its mean over clean text negative.

Search: a linear-time scan (Ruzzo and Tompa) over a document's token scores
finds every maximal segment. Clean text's segment scores follow an
extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)) for n tokens:
lambda solves sum p exp(lambda s) = 1 over clean tokens, K is fitted to clean
documents' greatest scores. A segment is significant where that probability is
below `SIGNIFICANT`. A document's features are its best segment's -log E and
the sum of its significant segments'; a logistic regression, fitted to labelled
documents that the token model hasn't seen, gives the score.

Only text enters a score. Counting, scanning and calibration use whole texts
and run in tasks; the driver gets counts of tokens that two documents hold or more (a
rarer one has its stem's evidence), a histogram of scores and a few numbers a
sampled document. The sample's bound `SAMPLE` is per label; the documents whose
hashes of doc_id are least are taken, so below the bound every labelled document
counts. Where the bound drops more of one label, the regression's constant is
put right by the labels' shares among all usable rows.

Very long texts: time grows with the length, memory by some 100 bytes a token.

Defined results: null and empty texts have no segment and take the score of
that. Where one of the labels is missing, every score is the share of toxic
labels, 0 without labels. Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from platter.llm._common import Scratch, map_batches

SAMPLE = 8_000
#: Scores remembered by a process, and the most letters of their tokens; longer tokens are counted by so many.
MEMO_TOKENS, TOKEN_CHARS = 200_000, 64
#: A token or stem is known to the model from so many sampled documents on.
LEAST_DOCS = 2
#: Of one document of so many only the features are learnt.
CHECKED = 4
THRESHOLD = 0.3
STEMS = (3, 4, 5, 6)
PRIOR = 8.0
DRIFT = 1.0
CLIP = 6.0
#: A token whose score is this near to its stem's takes that and isn't held.
SAME = 0.3
SIGNIFICANT = 1e-3
#: A positive token that came within so many tokens before is no new evidence and counts as an unknown one.
REPEAT = 100
_TOKEN = re.compile(r"[^\W_]+")
_EULER = 0.5772156649015329


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


@dataclass
class ToxicityModel:
    """scores: of tokens and, with a trailing `*`, of stems; unknown tokens take their longest known stem's."""

    scores: dict[str, float]
    unknown: float
    lam: float
    k: float
    weights: tuple[float, float, float]
    constant: float | None = None

    def __post_init__(self):
        self._memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def score_of(self, token: str) -> float:
        found = self.scores.get(token)
        for n in reversed(STEMS):
            if found is not None:
                return found
            if len(token) > n:
                found = self.scores.get(token[:n] + "*")
        return self.unknown if found is None else found

    def token_scores(self, words: list[str]) -> list[float]:
        memo = self._memo
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        long: dict[str, float] = {}
        for w in set(words):
            if w not in memo:
                (memo if len(w) <= TOKEN_CHARS else long)[w] = self.score_of(w[:TOKEN_CHARS])
        if long:
            memo = memo | long
        last: dict[str, int] = {}
        out = []
        for at, w in enumerate(words):
            s = memo[w]
            if s > 0:
                if at - last.get(w, -REPEAT) < REPEAT:
                    s = self.unknown
                last[w] = at
            out.append(s)
        return out

    def features(self, text: str | None) -> tuple[float, float, int]:
        """-log E of the best segment and the sum over significant ones, both 0 at least; their number."""
        words = tokens(text)
        scores = self.token_scores(words)
        best = total = 0.0
        many = 0
        if not words or max(scores) <= 0:
            return best, total, many
        base = np.log(self.k * len(words))
        for _, _, s in segments(scores):
            x = self.lam * s - base
            best = max(best, x)
            if -np.expm1(-np.exp(-x)) < SIGNIFICANT:
                total += x
                many += 1
        return best, total, many

    def probability(self, text: str | None) -> tuple[float, int]:
        if self.constant is not None:
            return self.constant, 0
        best, total, many = self.features(text)
        z = self.weights[0] + self.weights[1] * np.log1p(best) + self.weights[2] * np.log1p(total)
        return float(1 / (1 + np.exp(-z))), many


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Scores that aren't positive only move the running sum, so the scan visits the
    positive ones; an array of sums before each place is made once.
    """
    sums = list(accumulate(scores, initial=0.0))
    # Open segments, as a stack: start, end, sum before and sum after it, and for each the
    # index of the nearest earlier segment whose left sum is less.
    stack: list[tuple[int, int, float, float, int]] = []
    for at, s in enumerate(scores):
        if s <= 0:
            continue
        start, left, right = at, sums[at], sums[at + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, at + 1, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _log_odds(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], float]:
    """Scores of tokens and stems, from the toxic and clean documents that hold them; repeats within one don't count."""
    base = n_toxic / (n_toxic + n_clean)
    base_odds = np.log(base / (1 - base))
    rates: dict[str, float] = {}

    def rate(w: str, stem: str | None) -> float:
        t, c = counts[w]
        prior = rates[stem] if stem else base
        return (t + PRIOR * prior) / (t + c + PRIOR)

    for n in STEMS:
        shorter = [m for m in STEMS if m < n]
        for w in counts:
            if w[-1] == "*" and len(w) == n + 1:
                rates[w] = rate(w, w[: shorter[-1]] + "*" if shorter else None)
    for w in counts:
        if w[-1] != "*":
            own = [m for m in STEMS if m < len(w)]
            rates[w] = rate(w, w[: own[-1]] + "*" if own else None)
    scores: dict[str, float] = {}
    for w, r in sorted(rates.items(), key=lambda x: (x[0][-1] != "*", len(x[0]))):  # stems first, short ones first
        s = min(CLIP, max(-CLIP, float(np.log(r / (1 - r)) - base_odds))) - DRIFT
        own = [w[:m] + "*" for m in reversed(STEMS) if m < len(w.rstrip("*"))]
        if abs(s - next((scores[x] for x in own if x in scores), -DRIFT)) > SAME:
            scores[w] = s
    return scores, -DRIFT


def _with_stems(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _fit_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    p = weights / weights.sum()
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(mid * scores)).sum() < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of training rows, those whose crc32(doc_id) mod 4 isn't 2, at most `sample` of each label; all usable rows by label."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 != 2")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    many = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    taken = None
    for y in (0, 1):  # a top-k each: heaps in the tasks, `sample` ids to the driver
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        taken = part if taken is None else taken.unionByName(part)
    taken = F.broadcast(taken)  # 2 * sample ids at most
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(taken, "doc_id")
        .groupBy("doc_id")  # a doc_id that rows repeat is one document
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )
    return rows, many


def _count(rows: DataFrame) -> tuple[dict[str, tuple[int, int]], dict[str, int]]:
    """Toxic and clean documents of each token and stem, of LEAST_DOCS or more, and the tokens' uses in clean ones."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            uses: dict[str, int] = {}
            for w in tokens(text):
                w = w[:TOKEN_CHARS]
                uses[w] = uses.get(w, 0) + 1
            for w in _with_stems(set(uses)):
                now = held.setdefault(w, [0, 0, 0])
                now[1 - y] += 1
                if not y:
                    now[2] += uses.get(w, 0)
        columns = [pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(3))]
        return pa.RecordBatch.from_arrays(columns, ("w", "t", "c", "uses"))

    counted = map_batches(rows, one, "w string, t long, c long, uses long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("uses").alias("uses"))
    kept = counted.where(F.col("t") + F.col("c") >= LEAST_DOCS).toArrow()
    names, t, c, uses = (kept.column(i).to_pylist() for i in range(4))
    return dict(zip(names, zip(t, c))), dict(zip(names, uses))


def _features(rows: DataFrame, model: ToxicityModel, of) -> list:
    """What `of` makes of each row's text, with its label: numbers of the sampled documents, in no order that matters."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [of(sent.value, t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(2)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *columns], ("doc_id", "toxic", "x", "y"))

    made = map_batches(rows, one, "doc_id long, toxic int, x double, y double").toArrow().sort_by("doc_id")
    return list(zip(*(made.column(c).to_pylist() for c in ("toxic", "x", "y"))))


def _greatest(model: ToxicityModel, text: str | None) -> tuple[float, float]:
    """Score of the best segment and number of tokens."""
    words = tokens(text)
    return max((x[2] for x in segments(model.token_scores(words))), default=0.0), float(len(words))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Model of the labelled sample; one document of CHECKED, in the order of hashed ids within its label, calibrates."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows, many = labelled_sample(docs, labels, sample)
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    ranked = rows.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))  # ids alone: 2 * sample rows at most
    ranked = ranked.select("doc_id", (F.row_number().over(order) % CHECKED == 1).alias("check"))
    rows = scratch.table(rows, "texts")
    rows = scratch.table(rows.join(F.broadcast(ranked), "doc_id").repartition("doc_id"), "sample")
    had = {(r.check, r.toxic): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    total = {y: had.get((True, y), 0) + had.get((False, y), 0) for y in (0, 1)}
    if len(had) < 4:
        share = total[1] / (total[0] + total[1]) if total[0] + total[1] else 0.0
        return ToxicityModel({}, -DRIFT, 1.0, 1.0, (0.0, 0.0, 0.0), share)
    learn, check = rows.where("not check"), rows.where("check")
    counts, uses = _count(learn)
    scores, unknown = _log_odds(counts, had[False, 1], had[False, 0])
    model = ToxicityModel(scores, unknown, 1.0, 1.0, (0.0, 0.0, 0.0))
    names = [w for w, n in uses.items() if n]
    model.lam = _fit_lambda(np.array([model.score_of(w) for w in names] or [-1.0]), np.array([uses[w] for w in names] or [1]))
    # ln K: clean documents' mean of lambda S - ln n, less Euler's constant
    greatest = [model.lam * s - np.log(n) for y, s, n in _features(check, model, _greatest) if not y and n]
    if greatest:
        model.k = float(np.exp(np.mean(greatest) - _EULER))
    found = np.array(_features(check, model, lambda m, t: m.features(t)[:2]))
    w = _logistic(np.log1p(found[:, 1:]), found[:, 0])
    # Of each label, how much of what there is was learnt from.
    offset = np.log(many[1] / min(many[1], sample)) - np.log(many[0] / min(many[0], sample))
    # A score never falls as a segment's significance grows.
    model.weights = (float(w[0] + offset), max(0.0, float(w[1])), max(0.0, float(w[2])))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of significant segments of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.probability(t) for t in batch.column("text").to_pylist()]
        score = np.array([p for p, _ in found], np.float64)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "score": score,
                "predicted": pa.array((score >= threshold).astype(np.int32)),
                "n_segments": pa.array([n for _, n in found], pa.int64()),
            }
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return map_batches(docs, one, "doc_id long, score double, predicted int, n_segments long").select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "n_segments"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text):
        return type(text)([sent.value.probability(t)[0] < threshold for t in text], index=text.index)

    return docs.where(clean(F.col("text").cast("string")))
