"""Token counts by a public byte-level tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split pattern of the byte-level vocabularies. FIXED VALUE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file of ``base64 rank`` lines."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: tuple[str, ...], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep…, n_tokens``; null texts have 0 tokens."""
    rows = df.select(*keep, F.col(text_col).alias("texto_"))
    kinds = dict(rows.dtypes)

    def make():
        encode = encoding(vocabulary).encode_ordinary

        def run(cols: dict[str, list]) -> dict[str, list]:
            return {c: cols[c] for c in keep} | {"n_tokens": [len(encode(t)) if t else 0 for t in cols["texto_"]]}

        return run

    return map_rows(rows, make, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_tokens int")
