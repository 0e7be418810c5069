"""Token counts of whole texts, as the tokenizers library gives them.

Batches balanced by bytes go through Arrow functions that return lengths only.
Long and short texts alike are split at safe boundaries: before a blank, tab, line
feed, carriage return or form feed that follows a character which no engine takes
for white space. No token of a byte-level BPE with the usual splitting pattern holds
a non-space before a white-space character, and the string of a special token that
has no space in it and takes none from its sides lies within one segment. The
library encodes each distinct segment once. Only what lies between two boundaries
is in one piece: a run without such spaces (in Chinese, or base 64) is as long as
it is.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows give repeated
results; an empty table gives no rows; extra columns pass through unless their
names clash with the results', which then replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import segments as seg

#: White space and separators other than those at which texts are cut: no cut follows one.
ODD_SPACE = r"\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_COUNTERS: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts tokens of Arrow string arrays with one tokenizer file."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Cutting is proven only for byte-level BPE without a normaliser, and special strings that stand for themselves.
        special = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in special)
        self.cuttable = plain and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.cached = seg.SegmentCache(self.lengths)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        mark = seg.free_mark(texts) if self.cuttable else None
        if mark is None:  # a text at a time
            return np.array([self.lengths([t])[0] for t in texts.to_pylist()], np.int64)
        offsets, flat = seg.cut(texts, " \\t\\n\\f\\r", more_space=ODD_SPACE, mark=mark)
        coded = flat.dictionary_encode()
        table = np.array(self.cached(coded.dictionary.to_pylist()), dtype=np.int64)
        return seg.segment_sums(table[coded.indices.to_numpy()], offsets)


def counter(tokenizer_path: str) -> TokenCounter:
    if tokenizer_path not in _COUNTERS:
        _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path)
    return _COUNTERS[tokenizer_path]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    limit_tokens: int = 512,
    batch_bytes: int = seg.BATCH_BYTES,
) -> DataFrame:
    """`keep` columns (default: all but the text) with n_bytes, n_tokens, over_limit.

    Map-only: no shuffle, memory bounded by `batch_bytes` and the longest text (its segments, not its tokens).
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made and c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        seg.take_over("token_counts")
        for batch in seg.byte_balanced(batches, text_col, batch_bytes):
            texts = seg.large_text(batch.column(text_col))
            n = count(texts)
            columns = [batch.column(c) for c in keep] + [pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit_tokens)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *made])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
