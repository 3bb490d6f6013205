"""U1 token counting.

The default counter is native: ``len(text) // 5`` in code points, the rule
used whenever a byte-pair vocabulary is not available.  An optional Arrow
``pandas_udf`` wraps a real tokenizer and falls back to the same rule per text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 5   # fixed value of the fallback rule


def fallback_tokens(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.floor(F.length(c) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("bigint")


def count_tokens(c, encoding_name: str | None = None) -> Column:
    """Token count column.  ``encoding_name=None`` keeps the native rule."""
    if encoding_name is None:
        return fallback_tokens(c)
    return tokenizer_udf(encoding_name)(c)


def tokenizer_udf(encoding_name: str):
    """Arrow-batched counter; the encoder is loaded once per Python worker."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def _count(texts: pd.Series) -> pd.Series:
        enc = _encoder(encoding_name)
        out = []
        for t in texts:
            if t is None:
                out.append(0)
                continue
            try:
                if enc is None:
                    raise RuntimeError("no encoder")
                out.append(len(enc.encode(t)))
            except Exception:
                out.append(len(t) // CHARS_PER_TOKEN)
        return pd.Series(out, dtype="int64")

    return _count


_ENCODERS: dict = {}


def _encoder(name: str):
    if name not in _ENCODERS:
        try:
            import tiktoken
            _ENCODERS[name] = tiktoken.get_encoding(name)
        except Exception:
            _ENCODERS[name] = None
    return _ENCODERS[name]
