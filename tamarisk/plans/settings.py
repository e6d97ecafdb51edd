"""Settings of the pipeline, with overrides from the environment (TAMARISK_*)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    docs_dir: str = "data/docs"
    index_dir: str = "data/index"
    chunk_size: int = 900
    chunk_overlap: int = 150
    top_k: int = 4
    min_similarity: float = 0.30
    hybrid: bool = True
    lexical_scale: float = 16.0
    backend: str = "auto"
    temperature: float = 0.1
    max_tokens: int = 600
    check_groundedness: bool = True
    answer_mode: str = "auto"
    min_groundedness: float = 0.34
    answer_language: str = "Türkçe"

    @classmethod
    def from_env(cls, env: dict | None = None) -> Settings:
        """Blank values are defaults; a malformed number raises ValueError."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"TAMARISK_{f.name.upper()}", "").strip()
            if raw:
                found[f.name] = raw.lower() not in ("0", "false", "no") if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(raw)
        return cls(**found)

    def validate(self) -> None:
        rules = {
            "chunk_size must be positive": self.chunk_size > 0,
            "chunk_overlap can't be negative": self.chunk_overlap >= 0,
            "chunk_overlap must be smaller than chunk_size": self.chunk_overlap < self.chunk_size,
            "top_k must be positive": self.top_k > 0,
            "min_similarity must be between -1 and 1": -1 <= self.min_similarity <= 1,
            "answer_mode must be auto, generative or extractive": self.answer_mode in ("auto", "generative", "extractive"),
        }
        for message, holds in rules.items():
            if not holds:
                raise ValueError(message)
