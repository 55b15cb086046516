"""Subject areas of documents: complement naive Bayes from labels, expectation-maximisation over all documents, calibration.

The unit is the sentence, as a document may deal with several subjects and mostly with none. Features are the words whose
document frequency is a fixed part of a language's documents or more, so their number is bounded by the mean length over
that part, language by language.
1. Labelled documents give word counts by subject; the weight of a word for a subject is the log of its share in the
   subject over its share in the complement (all else). What all texts talk about has a weight near zero everywhere.
2. Expectation: every sentence of every document gets posteriors over the subjects and "none" from its words' weights.
   Maximisation: the counts by subject, and those of none, are summed anew over the corpus. Counts are made in partitions
   and combined; only a matrix of words by subjects reaches the driver.
3. Calibration: on a bounded sample of labelled documents, a logistic curve for each subject maps a sentence's log odds of
   the subject against "none" to the posterior that an annotator names it. Subjects are independent of one another: a
   sentence deals with every subject of a posterior of one half or more, so with several or with none. A second curve maps
   the share of a document's sentences to the same for the document.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import checkpointed

#: Ends of sentences: white space after a full stop, question or exclamation mark, or a blank line.
SENTENCE = r"(?<=[.!?])\s+|\n\s*\n"
FEATURE = r"\p{L}+"
#: The same in the words of Python's own, faster expressions.
LETTERS = r"[^\W\d_]+"
MIN_SHARE, MIN_DOCS = 0.0005, 5
#: Words added to each count; the dead zone and the limit of a word's weight; flat part of a document's prior.
SMOOTH, DEAD, MOST, FLAT = 2.0, 0.7, 4.0, 0.1
#: The dead zone while only labels count, where every text counts a word once.
DEAD_FIRST = 0.25
#: Log weight of "none" in each round: low at first, so that weak evidence from few labels counts.
NONE = (-1.0, -0.5, 0.0, 0.0)
SAMPLE = 20_000
PART = 0.25
#: Weights are a matrix of words by areas in every worker, so a longer list of areas is an error.
MOST_AREAS = 1_000


@dataclass
class Model:
    subjects: list[str]
    words: dict[str, int]
    weights: np.ndarray  # words + an empty row x subjects
    curves: np.ndarray | None = None  # subjects x (slope, offset), of a document's share
    odds_curves: np.ndarray | None = None  # the same of a sentence's log odds; the odds as they are without


def vocabulary(docs: DataFrame, min_share: float, min_docs: int) -> dict[str, int]:
    """Words that, in some stratum, stand in ``min_share`` of its documents and in at least ``min_docs`` of them."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(FEATURE), F.lit(0)))
    sizes = {r["stratum"]: r["count"] for r in docs.groupBy("stratum").count().collect()}
    if not sizes:
        return {}
    least = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(max(min_docs, min_share * n)))]), F.col("stratum"))
    counts = docs.select("stratum", F.explode(found).alias("w")).groupBy("stratum", "w").agg(F.count(F.lit(1)).alias("n"))
    return {w: i for i, w in enumerate(sorted(r["w"] for r in counts.where(F.col("n") >= least).select("w").distinct().toArrow().to_pylist()))}


#: The end of a sentence and a word that is no feature, as numbers; the mark of an end within a text.
BREAK, OTHER = -1, -2
MARK = "\x00"


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        return OTHER


class Gaps(dict):
    """Characters that are neither letters nor marks become blanks; each is looked at once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c == MARK or re.fullmatch(LETTERS, c) else " "
        return self[code]


def distinct_in_sentences(found: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature words of each sentence once, a ``BREAK`` after each that has any, and the offsets of the texts.

    ``found`` holds the numbers of all words, a ``BREAK`` after each sentence and each of the texts' ``sizes``.
    """
    ends = found == BREAK
    s = np.cumsum(ends) - ends
    kept = found >= 0
    pairs = np.unique(s[kept] * np.int64(words + 1) + found[kept])
    sentence, word = pairs // (words + 1), (pairs % (words + 1)).astype(np.int32)
    last = np.r_[sentence[1:] != sentence[:-1], [True] * (len(sentence) > 0)]
    codes = np.full(len(word) + int(last.sum()), BREAK, np.int32)
    codes[np.arange(len(word)) + np.cumsum(last) - last] = word
    of = np.repeat(np.arange(len(sizes)), sizes)[ends]  # the text of each sentence
    counts = np.bincount(of[sentence], minlength=len(sizes)) + np.bincount(of[sentence[last]], minlength=len(sizes))
    return codes, np.r_[0, np.cumsum(counts)].astype(np.int32)


def encoded(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """id, stratum and the feature words of each text (distinct within a sentence), a ``BREAK`` after each sentence.

    Texts are cut once and the numbers kept in the shared checkpoint folder; the rounds read only these.
    """
    known = docs.sparkSession.sparkContext.broadcast(words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gaps, end = Numbers(known.value), Gaps(), re.compile(SENTENCE)
        number[MARK] = BREAK
        for b in batches:
            found, sizes = array("i"), []
            for t in b["text"].to_pylist():
                before = len(found)
                found.extend(map(number.__getitem__, end.sub(f" {MARK} ", t.lower().replace(MARK, " ")).translate(gaps).split()))
                found.append(BREAK)
                sizes.append(len(found) - before)
            codes, offsets = distinct_in_sentences(np.array(found, np.int32), np.array(sizes, np.int64), len(known.value))
            yield pa.RecordBatch.from_arrays([b["id"], b["stratum"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes))], ["id", "stratum", "codes"])

    kind = dict(docs.dtypes)["id"]
    return checkpointed(docs.select("id", "stratum", "text").mapInArrow(cut, f"id {kind}, stratum int, codes array<int>"))


def sentences(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature words, their sentence, and the document of each sentence."""
    offsets = codes.offsets.to_numpy().astype(np.int64)
    w = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    d = np.repeat(np.arange(len(codes)), np.diff(offsets))
    ends = w == BREAK
    s = np.cumsum(ends) - ends
    return w[~ends].astype(np.int64), s[~ends], d[ends]


def scores(w: np.ndarray, s: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Sentences x subjects: the sums of their words' weights."""
    score = np.zeros((n, weights.shape[1]))
    if len(w):
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        score[s[starts]] = np.add.reduceat(weights[w], starts, axis=0)
    return score


def posteriors(w: np.ndarray, s: np.ndarray, d: np.ndarray, docs: int, weights: np.ndarray, none: float = 0.0) -> np.ndarray:
    """Sentences x (subjects + none), exclusive. A subject's prior is its part in the rest of the document, found by two passes."""
    n, k = len(d), weights.shape[1]
    score = scores(w, s, n, weights)
    prior = np.full((docs, k), 1.0 / k)
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if n else np.empty(0, np.int64)
    for _ in range(3):
        logit = np.c_[score + np.log(prior[d]), np.full(n, none)]
        post = np.exp(logit - logit.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        prior = np.full((docs, k), FLAT)
        if n:
            prior[d[first]] += np.add.reduceat(post[:, :-1], first, axis=0)
        prior /= prior.sum(axis=1, keepdims=True)
    return post


def evidence(w: np.ndarray, s: np.ndarray, d: np.ndarray, docs: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words, and log odds of each subject against none, whatever the other subjects' (sentences x subjects).

    Words of other subjects say nothing against a subject, so weights below zero are left out. The prior is the subject's part in the document's sentences, as above, but a sentence may be part of several subjects.
    """
    n, k = len(d), weights.shape[1]
    score = scores(w, s, n, np.maximum(weights, 0))
    prior = np.full((docs, k), 1.0 / k)
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if n else np.empty(0, np.int64)
    for again in (True, True, False):
        odds = score + np.log(prior[d])
        if again and n:
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            some = np.full((docs, 1), FLAT * k)
            some[d[first], 0] += np.add.reduceat(post.max(axis=1), first)
            prior = np.full((docs, k), FLAT)
            prior[d[first]] += np.add.reduceat(post, first, axis=0)
            prior /= some
    return score, odds


def independent(score: np.ndarray, odds: np.ndarray, curves: np.ndarray | None) -> np.ndarray:
    """Sentences x subjects: each subject's posterior, whatever the others'; 0 where no word speaks for it."""
    z = odds if curves is None else odds * curves[:, 0] + curves[:, 1]
    return np.where(score > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def log_odds(counts: Iterable[np.ndarray], dead: float = DEAD) -> np.ndarray:
    """Complement weights: words x subjects, from a matrix of words x (subjects + none) for each stratum.

    The log of a word's count in a subject over what its share in the complement would give there, language by language, so
    that the words of a language whose documents lean to a subject don't pass for the subject's. Both are smoothed so that
    rare words weigh little; weights nearer zero than ``dead`` are none, as words of one phrase err together.
    """
    own, expected = 0.0, 0.0
    for m in counts:
        total = m.sum(axis=0)
        rest = m.sum(axis=1, keepdims=True) - m[:, :-1]
        own = own + m[:, :-1]
        expected = expected + rest * (total[:-1] / np.maximum(total.sum() - total[:-1], 1e-9))
    odds = np.log((own + SMOOTH) / (expected + SMOOTH))
    return np.sign(odds) * np.clip(np.abs(odds) - dead, 0, MOST)


class Sums:
    """Sums of ``classes`` numbers by key. Only keys that occur are held, at most some ``HELD``; more are emptied into a batch."""

    HELD = 400_000

    def __init__(self, classes: int):
        self.classes, self.keys, self.rows = classes, [], []

    def add(self, keys: np.ndarray, entry: np.ndarray, values: np.ndarray) -> None:
        """Adds ``values[entry[i]]`` to ``keys[i]``."""
        found, at = np.unique(keys, return_inverse=True)
        self.keys.append(found)
        self.rows.append(np.stack([np.bincount(at, values[entry, c], len(found)) for c in range(self.classes)], axis=1))

    def emptied(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if sum(map(len, self.keys)) <= self.HELD and not last or not self.keys:
            return
        found, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        order = np.argsort(at, kind="stable")
        rows = np.add.reduceat(np.concatenate(self.rows)[order], np.r_[0, np.flatnonzero(np.diff(at[order])) + 1], axis=0) if len(found) else np.zeros((0, self.classes))
        if len(found) <= self.HELD * 3 // 4 and not last:
            self.keys, self.rows = [found], [rows]
            return
        self.keys, self.rows = [], []
        yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(np.ascontiguousarray(rows[:, c])) for c in range(self.classes)]], ["k", *[f"v{c}" for c in range(self.classes)]])

    @staticmethod
    def ddl(classes: int) -> str:
        return "k long, " + ", ".join(f"v{c} double" for c in range(classes))


def summed(rows: DataFrame, strata: int, n_words: int, n_classes: int) -> Iterator[np.ndarray]:
    """Adds up the rows of ``Sums``: a matrix of words by classes for each stratum, one at a time."""
    t = rows.groupBy("k").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(n_classes)]).orderBy("k").toArrow()
    k = t["k"].to_numpy()
    for stratum in range(strata):
        lo, hi = np.searchsorted(k, [stratum * n_words, (stratum + 1) * n_words])
        out = np.zeros((n_words, n_classes))
        for c in range(n_classes):
            out[k[lo:hi] - stratum * n_words, c] = t[f"v{c}"][lo:hi].to_numpy()
        yield out


def labelled_counts(docs: DataFrame, labels: DataFrame, words: dict[str, int], n: int, strata: int) -> Iterator[np.ndarray]:
    """Word counts by subject; a document's weight is shared among the subjects its annotators name."""
    many = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(n + 1)
        for b in batches:
            w, s, d = sentences(b["codes"])
            w = w + b["stratum"].to_numpy().astype(np.int64)[d[s]] * many
            own = np.c_[np.array(b["v"].to_pylist(), float).reshape(-1, n), np.zeros(b.num_rows)]
            once = np.unique(np.c_[w, d[s]].reshape(-1, 2), axis=0)  # words of one text err together, so a text counts once
            total.add(once[:, 0], once[:, 1], own)
            yield from total.emptied()
        yield from total.emptied(last=True)

    return summed(docs.join(labels, "id").select("codes", "stratum", "v").mapInArrow(count, Sums.ddl(n + 1)), strata, many, n + 1)


def expected_counts(docs: DataFrame, model: Model, none: float, strata: int) -> Iterator[np.ndarray]:
    """Word counts by subject and none over all documents, weighted by the sentences' posteriors."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    classes = len(model.subjects) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = known.value, Sums(classes)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                x = b.slice(lo, 1000)
                w, s, d = sentences(x["codes"])
                at = w + x["stratum"].to_numpy().astype(np.int64)[d[s]] * len(m.words)
                total.add(at, s, posteriors(w, s, d, x.num_rows, m.weights, none))
                yield from total.emptied()
        yield from total.emptied(last=True)

    return summed(docs.select("codes", "stratum").mapInArrow(count, Sums.ddl(classes)), strata, len(model.words), classes)


def label_votes(labels: DataFrame, subjects: list[str], doc_id: str) -> DataFrame:
    """id and the share of its labels for each subject; labels are matched without regard to case and blanks, others dropped."""
    clean = F.trim(F.lower("subject"))
    rows = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), clean.alias("s")).where(F.col("s").isin([x.lower() for x in subjects]))
    sums = rows.groupBy("id").agg(*[F.sum((F.col("s") == x.lower()).cast("double")).alias(f"v{i}") for i, x in enumerate(subjects)])
    all_ = sum((F.col(f"v{i}") for i in range(len(subjects))), F.lit(0.0))
    return sums.select("id", F.array(*[F.col(f"v{i}") / all_ for i in range(len(subjects))]).alias("v"))


def shares(docs: DataFrame, model: Model, keep: str = "") -> DataFrame:
    """id, the number of sentences with a subject, and each subject's number of them; ``keep`` names an extra column."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)
    names = ["id", *([keep] if keep else [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                x = b.slice(lo, 1000)
                w, s, d = sentences(x["codes"])
                score, odds = evidence(w, s, d, x.num_rows, m.weights)
                sure = (independent(score, odds, m.odds_curves) >= 0.5).astype(float)
                total = np.bincount(d, sure.max(axis=1, initial=0.0), x.num_rows)
                per = np.zeros((x.num_rows, len(m.subjects)))
                for c in range(per.shape[1]):
                    per[:, c] = np.bincount(d, sure[:, c], x.num_rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, per.size + 1, per.shape[1], np.int32)), pa.array(per.ravel()))
                yield pa.RecordBatch.from_arrays([*[x[c] for c in names], pa.array(total), flat], [*names, "total", "per"])

    return docs.select(*names, "codes").mapInArrow(count, ", ".join(f"{c} {kind[c]}" for c in names) + ", total double, per array<double>")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: tuple[float, float]) -> np.ndarray:
    """Slope and offset of the curve of y over x: Newton's method with a small ridge towards ``start``, steps halved until they gain."""
    design, a0 = np.c_[x, np.ones(len(x))], np.array(start)
    loss = lambda a: (weight * (np.logaddexp(0, design @ a) - y * (design @ a))).sum() + 0.25 * ((a - a0) ** 2).sum()
    a = a0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 0.5 * (a - a0)
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2), grad)
        while loss(a + step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        a = a + step
    return a


#: Log odds are counted in bins of this width between these bounds, so that the counts alone reach the driver.
WIDTH, BOUND = 0.25, 30.0


def sampled(votes: DataFrame, sample: int) -> DataFrame:
    return votes.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)


def odds_calibrated(docs: DataFrame, votes: DataFrame, model: Model, sample: int) -> np.ndarray:
    """Each subject's curve over the log odds of sentences with a word for it, from at most ``sample`` labelled documents.

    A subject without such sentences, or whose curve doesn't rise, keeps the odds as they are (slope 1, offset 0).
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    n, bins = len(model.subjects), int(2 * BOUND / WIDTH) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = known.value, Sums(2)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                x = b.slice(lo, 1000)
                w, s, d = sentences(x["codes"])
                score, odds = evidence(w, s, d, x.num_rows, m.weights)
                named = np.array(x["v"].to_pylist(), float).reshape(-1, n) > 0
                i, k = np.nonzero(score > 0)
                at = k * bins + np.rint((np.clip(odds[i, k], -BOUND, BOUND) + BOUND) / WIDTH).astype(np.int64)
                total.add(at, named[d[i], k].astype(np.int64), np.eye(2))
                yield from total.emptied()
        yield from total.emptied(last=True)

    found = summed(docs.join(sampled(votes, sample), "id").select("codes", "v").mapInArrow(count, Sums.ddl(2)), n, bins, 2)
    x = np.arange(bins) * WIDTH - BOUND
    out = [logistic(np.r_[x, x], np.r_[np.zeros(bins), np.ones(bins)], np.r_[t[:, 0], t[:, 1]], (1.0, 0.0)) for t in found]
    return np.array([a if a[0] > 0 else (1.0, 0.0) for a in out])


def calibrated(docs: DataFrame, votes: DataFrame, model: Model, sample: int) -> np.ndarray:
    """Slope and offset of each subject's logistic curve over the share of sentences, from at most ``sample`` labelled documents."""
    t = shares(docs.join(sampled(votes, sample), "id"), model, "v").toArrow()
    if not t.num_rows:
        return np.tile([8.0, -2.0], (len(model.subjects), 1))
    per, v, total = np.array(t["per"].to_pylist()), np.array(t["v"].to_pylist()) > 0, t["total"].to_numpy()
    share = per / np.maximum(total, 1)[:, None]
    return np.array([logistic(share[:, k], v[:, k].astype(float), np.ones(len(share)), (8.0, -2.0)) for k in range(len(model.subjects))])


def fitted(docs: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", rounds: tuple[float, ...] = NONE, calibrate: bool = True, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model of all documents (id, text, lang) and labels, and the documents as numbers.

    Languages of a hundredth of the documents or more are strata (so at most a hundred), the others and unknown ones one more.
    """
    lang = F.coalesce(F.trim(F.lower(F.col("lang").cast("string"))), F.lit(""))
    least = 0.01 * docs.count()
    counted = docs.groupBy(lang.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r["l"] for r in counted.where((F.col("n") >= least) & (F.col("l") != "")).collect())
    docs = docs.withColumn("stratum", F.coalesce(F.array_position(F.array(*map(F.lit, langs)), lang).cast("int"), F.lit(0)) if langs else F.lit(0))
    strata = len(langs) + 1
    words = vocabulary(docs, MIN_SHARE, MIN_DOCS)
    docs = encoded(docs, words)
    votes = label_votes(labels, subjects, doc_id)
    first = labelled_counts(docs, votes, words, len(subjects), strata)
    model = Model(subjects, words, log_odds(first, DEAD_FIRST))
    for none in rounds:
        model.weights = log_odds(expected_counts(docs, model, none, strata))
    if calibrate:
        model.odds_curves = odds_calibrated(docs, votes, model, sample)
        model.curves = calibrated(docs, votes, model, sample)
    return model, docs


def classified(documents: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", part: float = PART, calibrate: bool = True) -> DataFrame:
    """doc_id, subject, share and (with ``calibrate``) posterior: a row for each subject of ``part`` or more of a document's sentences with any.

    Documents without such sentences, null or blank ones, give no row; null ids are left out; a repeated row gives its rows
    again; labels that name no area are ignored; without labels or documents there is no row. Texts are read whole.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col(doc_id).alias("id"), "text", (F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")).alias("lang"))
    subjects = sorted(r["subject"] for r in areas.select("subject").where("subject IS NOT NULL").distinct().take(MOST_AREAS + 1))
    if len(subjects) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} subject areas")
    if not subjects:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['id']}, subject string, share double" + ", posterior double" * calibrate)
    model, docs = fitted(docs, labels, subjects, doc_id, calibrate=calibrate)
    found = shares(docs, model).where("total > 0")
    rows = found.select(F.col("id").alias("doc_id"), "total", F.posexplode("per").alias("k", "n")).where(F.col("n") >= F.lit(part) * F.col("total") - 1e-9)
    share = F.col("n") / F.col("total")
    out = [F.col("doc_id"), F.element_at(F.array(*map(F.lit, subjects)), F.col("k") + 1).alias("subject"), share.alias("share")]
    if calibrate:
        curve = lambda i: F.element_at(F.array(*[F.lit(float(c[i])) for c in model.curves]), F.col("k") + 1)
        out.append((1 / (1 + F.exp(-(curve(0) * share + curve(1))))).alias("posterior"))
    return rows.select(*out)
