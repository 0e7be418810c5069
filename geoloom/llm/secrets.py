"""Find secrets in whole texts: known shapes, and strings that look drawn at random.

Known shapes (kinds assign, access, hex) are leftmost non-overlapping matches of
fixed patterns. Every other run of at least 16 symbols of the usual encodings is
tested (kind random):

* its encoding is the smallest alphabet that holds it (decimal, hex, base 32, 36,
  62, 64, ...);
* against "drawn at random from that alphabet": chi-squared of its symbol counts,
  runs above and below the middle of the alphabet, serial correlation at lag one,
  each two-sided or upper-tailed with moments that are exact in the length, joined
  by Bonferroni; a run that fails at `RANDOM_LEVEL` is not random;
* against "ordinary text": as few repeated symbols, or as many changes between
  lower case, upper case, digits and marks, as runs of that length in this corpus
  hardly ever have. Symbol frequencies and the rate of changes come from all texts;
* the second p-value is judged by false-discovery control (Benjamini-Hochberg on a
  grid of levels) in each of `LENGTHS` by itself, so that the many short words don't
  hide what a long run shows, and a short run needs the evidence of its length.

Runs that touch a known shape are not reported again. Positions are in code points,
ends exclusive. Null and empty texts have no spans; rows that repeat have equal
results (each counts in the corpus); very long texts are read whole; columns other
than those kept are left out; an empty table gives no rows.

How it scales: one pass over the texts writes spans and test figures, far smaller
than the texts; what the driver sees is one row a symbol and at most one a length
class and level. A task holds a batch of about 2 MB of text, or one longer text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import byte_balanced, large_text
from .storage import materialise

#: Fixed patterns by kind, with the group and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs end where they must, so a least length drops the shorter ones
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from small to large, in the order of their values.
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
SYMBOLS = ALPHABETS["mixed"]
VALUES = [{s: v for v, s in enumerate(a)} for a in ALPHABETS.values()]
SETS = [frozenset(a) for a in ALPHABETS.values()]
CLASS = {s: k for k, group in enumerate((LOWER, UPPER, DIGITS, "+/-_"), 1) for s in group}

RANDOM_LEVEL = 0.001
FALSE_DISCOVERIES = 0.01
#: Length classes begin here.
LENGTHS = (16, 24, 40, 80, 160)
#: Levels are 10 ** (-k / GRID), to k = LEVELS.
GRID, LEVELS = 8, 8 * 40

SPAN = "struct<kind:string,start:long,end:long>"
RUNS = "array<struct<start:long,end:long,alphabet:int,pairs:long,changes:long,p_random:double>>"
SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
RUN_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.int32()), ("pairs", pa.int64()), ("changes", pa.int64()), ("p_random", pa.float64())])


def known_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(pairs: int, n: int, size: int) -> float:
    """Upper tail of chi-squared against equal frequencies; pairs: ordered pairs of equal symbols."""
    chi = size / n * (pairs + n) - n
    mean, variance = size - 1, 2 * (size - 1) * (n - 1) / n
    scale, freedom = variance / (2 * mean), 2 * mean * mean / variance
    spread = 2 / (9 * freedom)
    return upper_normal(((max(chi, 0) / scale / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def runs_test(values: list[int], size: int) -> float:
    """Two-sided, on runs above and below the middle of the alphabet."""
    high = [v >= size / 2 for v in values]
    n, up = len(high), sum(high)
    down = n - up
    if not up or not down:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * up * down / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    return 1.0 if variance <= 0 else 2 * upper_normal(abs(runs - mean) / math.sqrt(variance))


def serial_test(values: list[int]) -> float:
    """Two-sided, on the correlation of neighbours."""
    n = len(values)
    mean = sum(values) / n
    apart = [v - mean for v in values]
    total = sum(a * a for a in apart)
    if total == 0:
        return 0.0
    r = sum(a * b for a, b in zip(apart, apart[1:])) / total
    return 2 * upper_normal(abs(r + 1 / n) * math.sqrt(n))


def tested(run: str) -> tuple[int, int, int, float]:
    """(alphabet, ordered pairs of equal symbols, changes of class, p-value against a random draw)."""
    counts = Counter(run)
    seen = counts.keys()
    alphabet = next(k for k, s in enumerate(SETS) if seen <= s)
    values = [VALUES[alphabet][s] for s in run]
    pairs = sum(c * (c - 1) for c in counts.values())
    classes = [CLASS[s] for s in run]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    size = len(SETS[alphabet])
    p = min(uniformity(pairs, len(run), size), runs_test(values, size), serial_test(values))
    return alphabet, pairs, changes, min(1.0, 3 * p)


def tested_runs(text: str, known: list[tuple[str, int, int]]) -> list[tuple]:
    out, k = [], 0
    covered = merged_spans(known)
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k == len(covered) or covered[k][0] >= end:
            out.append((start, end, *tested(m[0])))
    return out


def merged_spans(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_BYTE_CLASS = np.zeros(256, np.uint8)
_BYTE_CLASS[[ord(s) for s in CLASS]] = list(CLASS.values())


def symbol_counts(texts: pa.Array) -> np.ndarray:
    """How often each of SYMBOLS stands in the texts, neighbouring pairs of them, and pairs of two classes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    each = np.bincount(flat, minlength=256)[[ord(s) for s in SYMBOLS]]
    kind = _BYTE_CLASS[flat]
    meet = (kind[:-1] > 0) & (kind[1:] > 0)
    edges = offsets[1:-1] - offsets[0]
    edges = edges[(edges > 0) & (edges < len(flat))]
    meet[edges - 1] = False
    return np.append(each, [meet.sum(), (meet & (kind[:-1] != kind[1:])).sum()])


def scanned(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in byte_balanced(batches, text_col):
        texts = large_text(batch.column(text_col))
        known = [known_spans(t) for t in texts.to_pylist()]
        runs = [tested_runs(t, k) for t, k in zip(texts.to_pylist(), known, strict=True)]
        counts = [symbol_counts(texts)] + [None] * (batch.num_rows - 1)
        kept = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != text_col]
        lists = [
            pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in k] for k in known], pa.list_(SPAN_TYPE)),
            pa.array([[dict(zip(RUN_TYPE.names, r, strict=True)) for r in k] for k in runs], pa.list_(RUN_TYPE)),
            pa.array(counts, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([*kept, *lists], [*(n for n in batch.schema.names if n != text_col), "_known", "_runs", "_symbols"])


class Corpus(NamedTuple):
    """Of ordinary text: by alphabet, sums of squared and cubed symbol frequencies; the rate of class changes."""

    squares: list[float]
    cubes: list[float]
    change: float


def corpus_of(counts: list[int]) -> Corpus:
    """From the counts of `symbol_counts` over all texts; one of each symbol is added."""
    each = {s: c + 1 for s, c in zip(SYMBOLS, counts, strict=False)}
    squares, cubes = [], []
    for alphabet in ALPHABETS.values():
        total = sum(each[s] for s in alphabet)
        squares.append(sum((each[s] / total) ** 2 for s in alphabet))
        cubes.append(sum((each[s] / total) ** 3 for s in alphabet))
    return Corpus(squares, cubes, (counts[-1] + 1) / (counts[-2] + 2))


def against_text(n: np.ndarray, alphabet: np.ndarray, pairs: np.ndarray, changes: np.ndarray, corpus: Corpus) -> np.ndarray:
    """p-values of runs as ordinary text: few repeats (normal), many changes (Chernoff's bound), joined by Bonferroni."""
    n = n.astype(float)
    s2, s3 = np.array(corpus.squares)[alphabet], np.array(corpus.cubes)[alphabet]
    mean = n * (n - 1) / 2 * s2
    variance = n * (n - 1) / 2 * (s2 - s2**2) + n * (n - 1) * (n - 2) * (s3 - s2**2)
    z = (pairs / 2 - mean) / np.sqrt(np.maximum(variance, 1e-12))
    few = np.array([upper_normal(-x) for x in z])
    share, rate = changes / (n - 1), corpus.change
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    many = np.where(share > rate, np.exp(-(n - 1) * np.nan_to_num(apart)), 1.0)
    return np.minimum(1.0, 2 * np.minimum(few, many))


def judged(lists: pa.ListArray, corpus: Corpus) -> dict[str, np.ndarray]:
    """Of all runs of a batch: their row, place, both p-values, length class and level."""
    flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    inside = slice(int(offsets[0]), int(offsets[-1]))
    column = {f: flat.field(f).to_numpy(zero_copy_only=False)[inside] for f in RUN_TYPE.names}
    length = column["end"] - column["start"]
    p = against_text(length, column["alphabet"], column["pairs"], column["changes"], corpus)
    level = np.minimum(np.floor(-GRID * np.log10(np.maximum(p, 1e-300))), LEVELS).astype(np.int64)
    return column | {"row": np.repeat(np.arange(len(lists)), np.diff(offsets)), "p_text": p, "length_class": np.searchsorted(LENGTHS, length, "right") - 1, "level": level}


def level_counts(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[pa.RecordBatch]:
    """Runs by length class and level (p at most 10 ** (-level / GRID))."""
    counts = np.zeros((len(LENGTHS), LEVELS + 1), np.int64)
    for batch in batches:
        j = judged(batch.column(0), corpus)
        np.add.at(counts, (j["length_class"], j["level"]), 1)
    cls, level = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(level), pa.array(counts[cls, level])], ["length_class", "level", "n"])


def thresholds(counts: dict[tuple[int, int], int]) -> list[int]:
    """By length class, the least level whose expected share of false findings is small enough; none: beyond all levels."""
    out = []
    for c in range(len(LENGTHS)):
        own = {level: n for (cls, level), n in counts.items() if cls == c}
        total, least, upto = sum(own.values()), LEVELS + 1, 0
        for level in range(LEVELS, -1, -1):
            upto += own.get(level, 0)
            if upto and total * 10 ** (-level / GRID) <= FALSE_DISCOVERIES * upto:
                least = level
        out.append(least)
    return out


def decided(batches: Iterator[pa.RecordBatch], corpus: Corpus, least: list[int]) -> Iterator[pa.RecordBatch]:
    """Known spans and those of runs that are random and hardly text, by start."""
    for batch in batches:
        known, runs = batch.column("_known"), batch.column("_runs")
        j = judged(runs, corpus)
        taken = np.flatnonzero((j["p_random"] >= RANDOM_LEVEL) & (j["level"] >= np.array(least)[j["length_class"]]))
        more: dict[int, list[dict]] = {}
        for k in taken.tolist():
            more.setdefault(int(j["row"][k]), []).append({"kind": "random", "start": int(j["start"][k]), "end": int(j["end"][k])})
        spans = [sorted(base + more.get(i, []), key=lambda s: (s["start"], KINDS.index(s["kind"]))) for i, base in enumerate(known.to_pylist())]
        kept = [k for k, n in enumerate(batch.schema.names) if n not in ("_known", "_runs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), known, pa.array(spans, pa.list_(SPAN_TYPE))], [*(batch.schema.names[k] for k in kept), "base", "spans"])


def find_secrets(docs: DataFrame, text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep`, base (spans of the fixed kinds) and spans (all), each with kind, start and end."""
    keep = ["doc_id"] if keep is None else keep
    names = [f"_c{k}" for k in range(len(keep))]
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).alias("_text"))
    columns = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in names)
    start = f"{columns}, " if names else ""
    scan = materialise(own.mapInArrow(lambda b: scanned(b, "_text"), f"{start}_known array<{SPAN}>, _runs {RUNS}, _symbols array<long>"), "scan")
    counts = {r.k: r.n for r in scan.select(F.posexplode("_symbols").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("n")).collect()}
    corpus = corpus_of([counts.get(k, 0) for k in range(len(SYMBOLS) + 2)])
    levels = scan.select("_runs").mapInArrow(lambda b: level_counts(b, corpus), "length_class long, level long, n long")
    least = thresholds({(r.length_class, r.level): r.n for r in levels.groupBy("length_class", "level").agg(F.sum("n").alias("n")).collect()})
    found = scan.drop("_symbols").mapInArrow(lambda b: decided(b, corpus, least), f"{start}base array<{SPAN}>, spans array<{SPAN}>")
    return found.toDF(*keep, "base", "spans")
