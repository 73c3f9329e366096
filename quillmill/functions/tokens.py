"""Token counts under a tokenizer of one's choice; see operators.costs for what they cost."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TokenCounter(ABC):
    """Sent to the executors as it is; a tokenizer that can't be pickled belongs behind a cache in count()."""

    @abstractmethod
    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""


class FileCounter(TokenCounter):
    """A vocabulary file of the ``tokenizers`` library, loaded once a worker. No begin or end tokens are added."""

    _loaded: dict[str, object] = {}

    def __init__(self, path: str):
        self.path = path

    def count(self, texts: list[str]) -> list[int]:
        from tokenizers import Tokenizer

        if self.path not in self._loaded:
            self._loaded[self.path] = Tokenizer.from_file(self.path)
        return [len(e.ids) for e in self._loaded[self.path].encode_batch(texts, add_special_tokens=False)]


def count_tokens(text: Column, counter: TokenCounter) -> Column:
    """Tokens of each text as int, in Arrow batches; null and empty texts have none."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(counter.count(texts.fillna("").tolist()))

    return run(text)
