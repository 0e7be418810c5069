"""Language identification with a string kernel.

A text is the set of its character n-grams (n = 1 to 3, over all code points,
letters folded to lower case): the blended-spectrum presence kernel of two texts
is the number of n-grams they share, divided by the geometric mean of their own
numbers. The n-grams are those of the landmarks, a bounded set of training texts,
in sorted tables of 64-bit codes; kernel ridge regression, one class against the
rest, is solved in the Nystroem space of the landmarks. Since the kernel is a
normalised product of presence vectors, the landmark matrix and the solution fold
into one matrix, and a text's scores are the sum of the rows of its n-grams.

Fit: at most about `per_label` texts a label, chosen by a hash of their id, each
of at most `max_chars` characters (a label that only longer texts have is not
learned), and about `max_bytes` in all, shared equally by the labels. More labels than `max_labels` raise a ValueError: the model has a row
an n-gram and a column a label, and travels to every worker. Texts are always
scored whole. Null text, or text without a letter, gives the label `und` and
score 0; the score of others is the winning regression value, limited to 0..1.
Ties go to the label that sorts first. Rows with a null id or label are never
learned from; without any learnable row everything is `und`. Kept columns whose
names clash with results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segments as seg

UNKNOWN = "und"
ORDERS = 3
#: Code points there are; n-gram codes that are looked up by place rather than by search, at most.
POINTS, DIRECT = 0x110000, 1 << 22
#: Characters whose n-grams are looked up at once, rows of the matrix that are summed at once.
CHUNK, ROWS = 1 << 18, 1 << 14


@dataclass
class LanguageModel:
    labels: list[str]
    alphabet: np.ndarray  #: code by code point, from 1; 0 if no landmark holds it
    grams: list[np.ndarray]  #: sorted n-gram codes of the landmarks, for each n
    places: list[np.ndarray | None]  #: number in `grams` by n-gram code, -1 if unknown; None: search
    weights: np.ndarray  #: n-gram columns x labels

    def columns(self, text: str) -> np.ndarray:
        """Columns of the text's n-grams, sorted, once each; those no landmark holds have none."""
        return self.look(text)[0]

    def look(self, text: str) -> tuple[np.ndarray, float]:
        """The columns, and the share of the text's n-grams that have one (each as often as it stands)."""
        points = code_points(text)
        width = sum(map(len, self.grams))
        found, known, total = [], 0, 0
        for start in range(0, len(points), CHUNK):  # n-grams that begin in the chunk
            base = 0
            for grams, places, codes in zip(self.grams, self.places, gram_codes(self.alphabet, points[start : start + CHUNK + ORDERS - 1]), strict=True):
                codes = codes[:CHUNK]
                if places is not None:
                    place = places[codes]
                    place = place[place >= 0]
                else:
                    place = np.minimum(np.searchsorted(grams, codes), max(len(grams) - 1, 0))
                    place = place[grams[place] == codes] if len(grams) else place[:0]
                known, total = known + len(place), total + len(codes)
                found.append(distinct(place, len(grams)) + base)
                base += len(grams)
        if len(found) <= ORDERS:
            own = np.concatenate(found) if found else np.zeros(0, np.int64)
        else:
            own = distinct(np.concatenate(found), width)
        return own, known / max(total, 1)

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts x n-grams, true where the text holds the n-gram."""
        out = np.zeros((len(texts), len(self.weights)), bool)
        for row, text in zip(out, texts, strict=True):
            row[self.columns(text)] = True
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x labels, the regression values."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and the share of n-grams of each text that landmarks hold."""
        out, familiar = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for i, (row, text) in enumerate(zip(out, texts, strict=True)):
            own, familiar[i] = self.look(text)
            for k in range(0, len(own), ROWS):
                row += self.weights[own[k : k + ROWS]].sum(0, dtype=np.float64)
            row /= np.sqrt(max(len(own), 1))
        return out, familiar


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(alphabet: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
    """For each n the codes of the n-grams: digits in the base of the alphabet, 0 for unknown letters."""
    letters = alphabet[points].astype(np.int64)
    base = int(alphabet[-1])
    gram = letters
    for n in range(1, ORDERS + 1):
        if n > 1:
            gram = gram[:-1] * base + letters[n - 1 :]
        yield gram


def distinct(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct values below `width`."""
    if len(values) * 32 < width:
        return np.unique(values).astype(np.int64)
    here = np.zeros(width, bool)
    here[values] = True
    return np.flatnonzero(here)


def folded_points() -> np.ndarray:
    """Code point of the lower-case letter by code point; others, and letters that fold to several, stand for themselves."""
    lower = ((chr(p).lower(), p) for p in range(POINTS))
    return np.fromiter((ord(c) if len(c) == 1 else p for c, p in lower), np.int64, POINTS)


def landmark_grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Alphabet, its last entry the base of codes, and sorted n-gram codes of the texts."""
    fold = folded_points()
    used = np.zeros(POINTS, bool)
    for text in texts:
        used[fold[code_points(text)]] = True
    alphabet = np.where(used, np.cumsum(used), 0)[fold]
    alphabet = np.append(alphabet, used.sum() + 1).astype(np.int32)
    grams = [np.zeros(0, np.int64)] * ORDERS
    for k in range(0, len(texts), 16):
        own = [[np.unique(codes) for codes in gram_codes(alphabet, code_points(text))] for text in texts[k : k + 16]]
        grams = [np.unique(np.concatenate([grams[n], *(codes[n] for codes in own)])) for n in range(ORDERS)]
    return alphabet, grams


def direct(grams: np.ndarray, size: int) -> np.ndarray | None:
    """Number by code where the table of all codes is small."""
    if size > DIRECT:
        return None
    out = np.full(size, -1, np.int32)
    out[grams] = np.arange(len(grams))
    return out


def fit(texts: list[str], labels: list[str], *, landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """Nystroem kernel ridge regression on labelled texts, in the order given."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros(POINTS + 1, np.int32), [], [], np.zeros((0, 0), np.float32))
    by_name: dict[str, list[int]] = {}
    for i, name in enumerate(labels):
        by_name.setdefault(name, []).append(i)
    chosen = [i for name in names for i in by_name[name][: max(1, landmarks // len(names))]]  # the same number for each label
    alphabet, grams = landmark_grams([texts[i] for i in chosen])
    width = sum(map(len, grams))
    model = LanguageModel(names, alphabet, grams, [direct(g, int(alphabet[-1]) ** n) for n, g in enumerate(grams, 1)], np.zeros((width, len(names)), np.float32))

    held = [model.columns(texts[i]) for i in chosen]
    sizes = np.array([len(h) for h in held], np.float64)
    holders = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
    column = np.concatenate(held)
    holders = holders[np.argsort(column, kind="stable")]  # landmarks by n-gram
    edges = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=width))])
    del column

    def kernel(own: np.ndarray) -> np.ndarray:
        """Values of the kernel between a text and the landmarks."""
        shared = np.zeros(len(held), np.int64)
        for k in range(0, len(own), ROWS):
            starts, counts = edges[own[k : k + ROWS]], edges[own[k : k + ROWS] + 1] - edges[own[k : k + ROWS]]
            at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared += np.bincount(holders[at], minlength=len(held))
        return shared / np.sqrt(np.maximum(sizes, 1) * max(len(own), 1))

    values, vectors = np.linalg.eigh(np.array([kernel(own) for own in held]))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    number = {name: k for k, name in enumerate(names)}
    gram, target = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
    for text, label in zip(texts, labels, strict=True):
        space = kernel(model.columns(text)) @ root
        gram += np.outer(space, space)
        target[:, number[label]] += space
    solved = np.linalg.solve(gram + ridge * len(texts) * np.eye(len(gram)) / 100, target)
    for own, row in zip(held, root @ solved, strict=True):
        model.weights[own] += (row / np.sqrt(max(len(own), 1))).astype(np.float32)
    return model


def training_sample(docs: DataFrame, learnable: Column, *, id_col: str, text_col: str, label_col: str, per_label: int, max_chars: int, max_labels: int, max_bytes: int) -> DataFrame:
    """About `per_label` texts of each label, by a hash of the id, and about `max_bytes` over all; no single task sees a whole label."""
    rows = docs.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.length(text_col).between(1, max_chars))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).limit(max_labels + 1).collect()
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels in {label_col}: raise max_labels")
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, per_label / r["n"], max_bytes / len(sizes) / r["bytes"])) for r in sizes], T.StructType([T.StructField("label", rows.schema["label"].dataType), T.StructField("keep", T.DoubleType())]))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(shares), "label").where(share < F.col("keep")).select("id", "text", "label")


def fit_languages(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 800, max_chars: int = 50_000, landmarks: int = 256, max_labels: int = 1000, max_bytes: int = 256 << 20) -> LanguageModel:
    """Model from a bounded sample: `per_label` texts a label (in expectation), each of at most `max_chars`, about `max_bytes` in all; ValueError beyond `max_labels`."""
    rows = training_sample(docs, learnable, id_col=id_col, text_col=text_col, label_col=label_col, per_label=per_label, max_chars=max_chars, max_labels=max_labels, max_bytes=max_bytes).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["label"], r["text"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], landmarks=landmarks)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, batch_bytes: int = seg.BATCH_BYTES) -> DataFrame:
    """`keep` columns with lang_pred, score and familiar. Map-only.

    `familiar` is the share of the text's n-grams that landmarks hold: near 1 for
    learned languages, near 0 for scripts that were never seen.
    """
    made = ("lang_pred", "score", "familiar")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seg.take_over("language")
        for batch in seg.byte_balanced(batches, text_col, batch_bytes):
            texts = seg.large_text(batch.column(text_col)).to_pylist()
            labels, scores = [], []
            values, familiar = m.judged(texts) if m.labels else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            best = values.argmax(1)
            for text, b, v in zip(texts, best.tolist(), values[np.arange(len(texts)), best].tolist(), strict=True):
                known = bool(m.labels) and has_letter(text)
                labels.append(m.labels[b] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(v))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar)], [*keep, *made])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
