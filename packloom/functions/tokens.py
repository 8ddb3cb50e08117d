"""Token estimates. The heuristics are plain arithmetic on code points; exact
counts run in an Arrow UDF with the vocabulary loaded once per worker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token (fixed values).
CHARS_PER_TOKEN = {"chars-div4": 4.0, "llama3": 3.5, "llama2": 3.3}
#: Names of vocabularies that need a file; without it the count falls back.
BPE = {"cl100k": "chars-div4", "o200k": "chars-div4", "claude": "chars-div4", "hf": "llama3"}
_loaded: dict = {}


def tokenizer_label(name: str, file: str | None = None) -> str:
    return f"hf:{file}" if name == "hf" and file else name


def estimate(text: Column, tokenizer: str = "llama3") -> Column:
    """ceil(code points / rate); empty and null texts have none."""
    rate = CHARS_PER_TOKEN.get(tokenizer) or CHARS_PER_TOKEN[BPE[tokenizer]]
    return F.coalesce(F.ceil(F.length(text).cast("double") / F.lit(rate)).cast("bigint"), F.lit(0).cast("bigint"))


def exact(text: Column, file: str | None, tokenizer: str = "hf") -> Column:
    """Count by a local tokenizer file; any failure to load it gives the
    heuristic, decided once, when the plan is built."""
    if not file or _encoder(file) is None:
        return estimate(text, tokenizer)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(file)
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def _encoder(file: str):
    if file not in _loaded:
        try:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(file)
            _loaded[file] = lambda x: t.encode(x, add_special_tokens=False).ids
        except Exception:  # the library raises bare Exception for unreadable files
            _loaded[file] = None
    return _loaded[file]
