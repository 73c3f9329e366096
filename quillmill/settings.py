"""Settings from the environment, and the errors of this library."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, fields


class QuillmillError(Exception):
    """Base of all errors raised on purpose."""


class ValidationError(QuillmillError):
    """An argument or a file isn't what it has to be."""


class EmbeddingError(QuillmillError):
    """A provider gave no vectors; trying again may help."""


class PermanentEmbeddingError(EmbeddingError):
    """A provider refused a batch (a wrong key, a bad request): trying again won't help."""


class ConfigurationError(ValidationError):
    """A setting isn't what it has to be."""


class RetrievalError(QuillmillError):
    """A search can't be answered."""


def setup_logging(level: str = "INFO") -> logging.Logger:
    """This library's logger, writing to standard output at this level (INFO if unknown). Other loggers stay as they are."""
    log = logging.getLogger("quillmill")
    log.setLevel(logging.getLevelNamesMapping().get(level.upper(), logging.INFO))
    if not log.handlers:
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(out)
    return log


@dataclass(frozen=True)
class Settings:
    TOP_K: int = 5
    SIMILARITY_THRESHOLD: float = 0.7
    EMBEDDING_DIMENSIONS: int = 64
    INDEX_DIR: str = "./data/index"
    CHUNK_SIZE: int = 512
    CHUNK_OVERLAP: int = 50
    LOG_LEVEL: str = "INFO"

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Fields from variables of the same name, case and all; other variables are ignored."""
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        try:
            return cls(**{f.name: kinds[str(f.type)](env[f.name]) for f in fields(cls) if f.name in env})
        except ValueError as e:
            raise ConfigurationError(f"settings: {e}") from e
