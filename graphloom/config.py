"""Settings: models with their limits, embedding and chunking, read from YAML or defaults."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field

LOG = logging.getLogger("graphloom")


@dataclass(frozen=True)
class Model:
    name: str
    provider: str = ""
    rpm: int = 10
    rpd: int = 1000
    key_env: str = ""
    tokens: int = 0  # of the free tier; 0 where none is told


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1000
    overlap: int = 100
    include_signatures: bool = True
    include_docstrings: bool = True

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_chars:
            raise ValueError("the overlap must be smaller than the window")


@dataclass(frozen=True)
class Embedding:
    provider: str = "hash"
    model: str = "hash-projection"
    dimension: int = 256
    normalize: bool = True


@dataclass(frozen=True)
class Settings:
    models: list[Model] = field(default_factory=list)
    embedding_models: list[Model] = field(default_factory=list)
    reranking_models: list[Model] = field(default_factory=list)
    threshold: float = 0.8
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)


def load(path: str | None = None) -> Settings:
    """The explicit file, else ./aimodels.yaml, else ~/.aimodels.yaml, else defaults; a broken file is a warning and defaults."""
    for where in filter(None, (path, "aimodels.yaml", os.path.expanduser("~/.aimodels.yaml"))):
        if os.path.exists(where):
            try:
                return parse(open(where, encoding="utf-8").read())
            except Exception as e:  # noqa: BLE001
                LOG.warning("cannot use %s: %s", where, e)
                return Settings()
    return Settings()


def parse(text: str) -> Settings:
    import yaml

    data = yaml.safe_load(text) or {}

    def models(*keys: str) -> list[Model]:
        found = next((data[k] for k in keys if data.get(k)), [])
        return [Model(m["name"], m.get("provider", ""), int(m.get("rpm_free_tier_limit", m.get("rpm", 10))), int(m.get("rpd_free_tier_limit", m.get("rpd", 1000))), m.get("api_key_env", ""), int(m.get("tokens_free_tier_limit", 0))) for m in found]

    return Settings(
        models=models("natural_language_models", "models"),
        embedding_models=models("embedding_models"),
        reranking_models=models("reranking_models"),
        threshold=float((data.get("config") or data).get("sufficiency_threshold", 0.8)),
        chunking=Chunking(**(data.get("chunking") or {})),
        embedding=Embedding(**(data.get("embedding") or {})),
    )
