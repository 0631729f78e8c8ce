"""Toxicity classifier that is held to the same score when the identity terms of a text are swapped."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm import calibration, common
from tallyloom.llm.calibration import sigmoid
from tallyloom.llm.common import ALNUM_BYTES

#: Terms that name groups of people. Terms of one list stand for one another.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "christlich", "muslimisch", "jüdisch",
                 "chrétien", "musulman", "juif", "cristiano", "musulmán", "judío"),
    "gender": ("woman", "man", "female", "male", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "schwul", "lesbisch", "homosexuel", "homosexual"),
    "origin": ("black", "white", "asian", "african", "european", "latino", "arab", "indian", "immigrant", "refugee",
               "ausländer", "immigré", "inmigrante"),
    "ability": ("blind", "deaf", "disabled", "autistic", "behindert", "aveugle", "ciego"),
}
SAMPLE_DOCS, FEATURES = 20_000, 4096
#: Features that a task counts before it passes their partial counts on.
HELD = 400_000
#: Up to so many labels are broadcast, so that the texts of unlabelled documents do not move; more are joined by a shuffle.
NEAR_LABELS = 1_000_000


def features_of(text: bytes | None, terms: frozenset[bytes] = frozenset()) -> set[bytes]:
    """The distinct words of a text, lower-cased, and the first four and five bytes of the longer ones, after ``^``.

    ``terms`` have no beginnings, so that a swap exchanges one feature for another and nothing else.
    """
    words = set((text or b"").translate(ALNUM_BYTES).split())
    longer = words - terms
    return words | {b"^" + w[:4] for w in longer if len(w) > 4} | {b"^" + w[:5] for w in longer if len(w) > 5}


def _counted(terms: frozenset[bytes]):
    """Partial counts (word, n, n1): documents, and toxic documents, with the feature; null stands for all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def partial() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            n = [counts[0][w] + counts[1][w] for w in words]
            return pa.RecordBatch.from_arrays([
                pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array([counts[1][w] for w in words], pa.int64())],
                names=["word", "n", "n1"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update(features_of(text, terms))
                counts[y][None] += 1
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield partial()
                    for c in counts:
                        c.clear()
        yield partial()
    return run


@dataclass(frozen=True)
class Examples:
    """Rows of word numbers (``words`` by ``starts``), their labels and weights, and swaps (row, word out, word in; -1: none)."""

    words: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    importance: np.ndarray
    swaps: np.ndarray


def _encoded(number: dict[bytes, int], terms: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in batches:
            found = [sorted(number[w] for w in known & features_of(t, terms)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["y", "h", "f"])
    return run


def _examples(drawn: pa.Table, weight: dict[int, float], groups: list[list[int]]) -> Examples:
    """The sample in the order of its hashes, so that a fit does not depend on how Spark dealt the rows."""
    labels, hashes = drawn["y"].to_numpy(), drawn["h"].to_numpy()
    lists = drawn["f"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.int64)
    place = np.empty(len(labels), np.int64)
    place[np.lexsort((labels, hashes))] = np.arange(len(labels))
    rows = np.repeat(place, sizes)
    order = np.argsort(rows, kind="stable")
    rows, flat, y = rows[order], flat[order], np.empty(len(labels))
    y[place] = labels
    return Examples(flat, rows, y, np.where(y == 1, weight[1], weight[0]), swaps_of(rows, flat, groups))


def swaps_of(rows: np.ndarray, words: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """For every identity term of a row: the term taken out, and exchanged for each other term of its list."""
    out = []
    for group in groups:
        here = np.isin(words, group)
        present: dict[int, set[int]] = {}
        for row, term in zip(rows[here].tolist(), words[here].tolist()):
            present.setdefault(row, set()).add(term)
        for row, terms in present.items():
            for term in sorted(terms):
                out.append((row, term, -1))
                out.extend((row, term, other) for other in group if other not in terms)
    return np.array(out, np.int64).reshape(-1, 3)


def train(examples: Examples, n_words: int, *, swap_penalty: float = 1.0, sparsity: float = 2e-4, rounds: int = 400) -> np.ndarray:
    """Weights of the words, and the intercept last.

    Minimises the log loss, an L1 term, and ``swap_penalty`` times the mean squared change of the score's logit over the swaps, by
    accelerated proximal gradient steps.
    """
    n = len(examples.labels)
    weight = examples.importance / examples.importance.sum()
    swaps = examples.swaps

    def slope(w: np.ndarray) -> np.ndarray:
        logit = np.bincount(examples.rows, w[examples.words], n) + w[-1]
        residual = weight * (sigmoid(logit) - examples.labels)
        g = np.append(np.bincount(examples.words, residual[examples.rows], n_words), residual.sum())
        if len(swaps):
            out, into, has = swaps[:, 1], swaps[:, 2], swaps[:, 2] >= 0
            change = (w[out] - np.where(has, w[into], 0.0)) * 2 * swap_penalty / len(swaps)
            g[:-1] += np.bincount(out, change, n_words) - np.bincount(into[has], change[has], n_words)
        return g

    # An upper bound of the curvature, by power iteration on the design.
    v = np.ones(n_words + 1) / np.sqrt(n_words + 1)
    top = 1.0
    for _ in range(30):
        u = weight * (np.bincount(examples.rows, v[examples.words], n) + v[-1])
        v = np.append(np.bincount(examples.words, u[examples.rows], n_words), u.sum())
        top = float(np.linalg.norm(v)) or 1.0
        v = v / top
    step = 1.0 / (0.3 * top + (4 * swap_penalty if len(swaps) else 0.0) + 1e-6)
    w = np.zeros(n_words + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        moved = ahead - step * slope(ahead)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0.0)
        shrunk[-1] = moved[-1]
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = shrunk + (t - 1) / t_next * (shrunk - w)
        w, t = shrunk, t_next
    return w


def _scored(weights: dict[bytes, float], intercept: float, terms: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            *rest, texts = batch.columns
            logits = [sum(weights[w] for w in sorted(known & features_of(t, terms))) + intercept for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sigmoid(np.array(logits, float)))], names=[*batch.schema.names[:-1], "score"])
    return run


class CounterfactualClassifier:
    """Feature weights and an intercept; :meth:`fit` makes one and :meth:`score` applies it."""

    def __init__(self, weights: dict[bytes, float], intercept: float, terms: frozenset[bytes] = frozenset()):
        self.weights, self.intercept, self.terms = weights, intercept, terms

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, label: str = "label", text: str = "text", key: str = "doc_id",
            sample_docs: int = SAMPLE_DOCS, features: int = FEATURES, swap_penalty: float = 1.0,
            identity_terms: dict[str, tuple[str, ...]] | None = None) -> CounterfactualClassifier:
        """Learns from the documents that ``labels`` marks 1 (toxic) or 0.

        Spark counts, over all labelled documents, in how many of each class a feature stands; the ``features`` ones
        with the largest G statistic and the identity terms become the model's. The weights are fitted on up to ``sample_docs``
        labels, half of each class, see :func:`calibration.draw`, weighted to the share that the classes have among all labels;
        a feature that none of these documents holds gets no weight. In each of them, every identity term is taken out, and
        swapped for the others of its list; ``swap_penalty`` holds the score to the same value. Null texts are empty.
        Without labels of both classes all scores are the share of toxic labels.
        """
        terms = IDENTITY_TERMS if identity_terms is None else identity_terms
        groups = [[t.encode() for t in g] for g in terms.values()]
        whole = frozenset(t for g in groups for t in g)
        rows, counted = calibration.draw(docs, labels, label=label, text=text, key=key, per_class=sample_docs // 2)
        share = counted.get(1, 0) / sum(counted.values()) if counted else 0.5
        constant = cls({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        if len(counted) < 2:
            return constant
        keys = calibration.labelled(labels, label, key).distinct()
        near = sum(counted.values()) <= NEAR_LABELS
        documents = calibration.texts_of(docs, F.broadcast(keys) if near else keys, text=text, key=key)
        seen = documents.select("y", "t").mapInArrow(_counted(whole), "word binary, n long, n1 long").groupBy("word").agg(
            F.sum("n").alias("n"), F.sum("n1").alias("n1")).where("n > 1 or word is null")
        seen = common.staged(seen, "toxicity")
        total, toxic = next(((r.n, r.n1) for r in seen.where("word is null").collect()), (0, 0))
        if not 0 < toxic < total:
            return constant
        toxic_share = toxic / total

        def part(observed, expected):
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
        gain = part(n1, n * toxic_share) + part(n - n1, n * (1 - toxic_share)) + part(toxic - n1, (total - n) * toxic_share) \
            + part(total - toxic - (n - n1), (total - n) * (1 - toxic_share))
        top = seen.where("word is not null").select("word", gain.alias("g")).orderBy(F.desc("g"), "word").limit(features).collect()
        common.discard(seen)
        words = list(dict.fromkeys([bytes(r.word) for r in top] + [t for g in groups for t in g]))
        number = {w: i for i, w in enumerate(words)}
        # Feature numbers, not words, come to the driver: at most sample_docs short lists of whole numbers.
        drawn = rows.mapInArrow(_encoded(number, whole), "y int, h long, f array<int>").toArrow()
        counts = Counter(drawn["y"].to_pylist())
        if len(counts) < 2:
            return constant
        terms_of = [[number[t] for t in g] for g in groups]
        examples = _examples(drawn, {y: counted[y] / counts[y] for y in (0, 1)}, terms_of)
        fitted = train(examples, len(words), swap_penalty=swap_penalty)
        return cls({w: float(x) for w, x in zip(words, fitted[:-1]) if x}, float(fitted[-1]), whole)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` without ``text``, with ``score``: how likely the whole text is toxic, from 0 to 1.

        Null and empty texts score by the intercept alone. Repeated rows are all scored; an empty table gives no rows; a column
        named score is replaced. At most ``FEATURES`` weights and the identity terms travel with the job.
        """
        known = common.without(docs, "score") if text.lower() != "score" else docs
        others = [c for c in known.columns if c != text]
        ready = known.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").cast("binary").alias("__bytes"))
        schema = StructType([*ready.schema.fields[:-1], StructField("score", DoubleType())])
        return ready.mapInArrow(_scored(self.weights, self.intercept, self.terms), schema)
