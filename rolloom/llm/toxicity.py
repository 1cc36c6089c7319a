"""Toxicity by compression distance.

Two zstandard dictionaries are trained from a bounded sample of labelled texts. The
ordinary one is trained on the windows of ordinary text. The toxic one is trained on
toxic text less what is common to both: of each toxic text those words that several
toxic texts and hardly any ordinary ones show; the ordinary content follows it, so what
differs between the two is what is peculiar to toxic text. Every text is cut into
windows of ``window`` words, each window is compressed with both, and the difference of
the two lengths is its distance. How often each distance occurs in toxic and in ordinary
texts gives it a weight, and a logistic curve over the sum of weights, the largest weight
and the number of windows gives the score, so that 0.5 is the threshold. Words and labels
of the sample, and the share of toxic labels among the usable documents, are all it
learns from; scoring takes the text alone.

Bounds of the sample: ``most_docs`` texts of each class, of ``most_chars`` characters
at most each, chosen by a hash of their id. Scoring reads whole texts of any length,
one pass without shuffle.

Edge cases: null and empty texts have no windows and get the curve's value there;
without labelled texts of both classes every score is the share of toxic labels (0
without any); repeated rows score alike, and of rows that share an id one text (the
least) is learned from; a label without a document and a document without a label do
nothing in training; several labels of one text all count; extra columns are passed
over unless named in ``carry``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOW, HIGH = -4, 12


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _windows(text: str | None, window: int) -> list[bytes]:
    ws = _words(text)
    return [b" " + b" ".join(ws[i : i + window]) for i in range(0, len(ws), window)]


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary of about ``size`` bytes; b"" without samples. A small sample
    is repeated, as training asks for several times the dictionary's size."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(size, samples * max(1, -(-20 * size // total))).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def peculiar_words(toxic: Sequence[str], ordinary: Sequence[str], share: float = 0.01, most: float = 0.002) -> list[bytes]:
    """Each toxic text's words, in order, that at least ``share`` of the toxic texts (three
    at least) and under ``most`` of the ordinary ones show; texts without any are left out."""
    seen: Counter = Counter()
    for t in toxic:
        seen.update(set(_words(t)))
    shared = {w for w, n in seen.items() if n >= max(3, share * len(toxic))}
    other: Counter = Counter()
    for t in ordinary:
        other.update(shared.intersection(_words(t)))
    kept = {w for w in shared if other[w] < max(1, most * len(ordinary))}
    texts = ([w for w in _words(t) if w in kept] for t in toxic)
    return [b" " + b" ".join(ws) + b" " for ws in texts if ws]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=11, hash_log=11, search_log=3, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


class Scorer:
    """Distances and scores from a model (a dict of plain values)."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.pair = [_compressor(model[k]).compress for k in ("ordinary", "toxic")]

    def histogram(self, text: str | None) -> np.ndarray:
        ordinary, toxic = self.pair
        gains = [len(ordinary(w)) - len(toxic(w)) for w in _windows(text, self.model["window"])]
        return np.bincount(np.clip(np.array(gains, np.int64), LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)

    def features(self, counts: np.ndarray) -> np.ndarray:
        w = np.asarray(self.model["weights"])
        return np.stack([counts @ w, ((counts > 0) * w).max(axis=1), np.log1p(counts.sum(axis=1)), np.ones(len(counts))], axis=1)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        x = self.features(np.array([self.histogram(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.model["curve"]), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(toxic: list[str], ordinary: list[str], prior: float, window: int = 6, ordinary_bytes: int = 4096, toxic_bytes: int = 512) -> dict:
    """A model from texts of both classes; ``prior``: the share of toxic labels.

    Weights and curve are fitted on distances of texts under dictionaries that the other
    half of the texts gave; the model's own dictionaries come from all of them."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return {"constant": prior}

    def dictionaries(bad: list[str], good: list[str]) -> dict:
        common = trained([w for t in good for w in _windows(t, window)], ordinary_bytes) or b" "
        return {"window": window, "ordinary": common, "toxic": trained(peculiar_words(bad, good), toxic_bytes) + common}

    counts: list[list] = [[], []]
    for half in (0, 1):
        scorer = Scorer(dictionaries(toxic[half::2], ordinary[half::2]))
        for held, part in zip(counts, (toxic, ordinary), strict=True):
            held += [scorer.histogram(t) for t in part[1 - half :: 2]]
    model = dictionaries(toxic, ordinary)
    bad, good = (np.array(c) for c in counts)
    rates = [(c / np.maximum(1, c.sum(axis=1, keepdims=True))).mean(axis=0) + 1e-5 for c in (bad, good)]
    model["weights"] = np.log(rates[0] / rates[1]).tolist()
    x = Scorer(model).features(np.concatenate([bad, good]))
    y = np.repeat([1.0, 0.0], [len(bad), len(good)])
    model["curve"] = _logistic(x, y, np.where(y == 1, prior / len(bad), (1 - prior) / len(good)) * len(y)).tolist()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, most_docs: int, most_chars: int) -> tuple[dict[int, list[str]], float]:
    """Texts by class, and the share of toxic labels; both from usable documents alone."""
    marks = labels.select(F.col(id_col).alias("__label_id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic in (0, 1)")
    rows = docs.where(usable).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    short = F.coalesce(F.length("__text") <= most_chars, F.lit(False))
    marked = rows.select("__id", short.alias("__short")).join(marks, F.col("__id") == F.col("__label_id"))
    marked = materialize(marked.groupBy("__id", "__toxic").agg(F.max("__short").alias("__short")), "toxicity-labels")
    seen = {r[0]: r[1] for r in marked.groupBy("__toxic").count().collect()}
    # the ids are chosen before any text is joined; at most ``most_docs`` of a class
    first = lambda c: marked.where((F.col("__toxic") == c) & F.col("__short")).orderBy(F.xxhash64("__id"), "__id").limit(most_docs)
    chosen = first(0).unionByName(first(1)).select("__id", "__toxic")
    texts = rows.where(short).join(F.broadcast(chosen), "__id").groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))
    found: dict[int, list[str]] = {0: [], 1: []}
    for _, c, text in sorted(tuple(r) for r in texts.collect()):
        found[c].append(text)
    total = sum(seen.values())
    return found, (seen.get(1, 0) / total if total else 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ("doc_id",), most_docs: int = 2000, most_chars: int = 20_000) -> DataFrame:
    """Columns ``carry`` under their names with ``__`` before, and ``score``.

    ``usable``: which documents may be learned from."""
    sample, prior = labelled_sample(docs, labels, usable, id_col, text_col, most_docs, most_chars)
    model = train(sample[1], sample[0], prior)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    def make():
        model = sent.value
        if "constant" in model:
            return lambda texts: {"score": np.full(len(texts), model["constant"])}
        scorer = Scorer(model)
        return lambda texts: {"score": pa.array(scorer.scores(texts))}

    return map_texts(docs, text_col, carry, "score double", make)
