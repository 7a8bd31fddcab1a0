"""Settings with typed defaults, overridden by LOREKEEP_* variables of the environment or a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    # chunks
    chunk_target_tokens: int = 380
    chunk_max_tokens: int = 620
    chunk_overlap_tokens: int = 60
    chunk_min_tokens: int = 25
    # channels and fusion
    top_k_vector: int = 30
    top_k_bm25: int = 30
    top_k_final: int = 6
    rrf_k: int = 60
    rrf_k_title: int = 20
    rrf_k_graph: int = 20
    weight_vector: float = 1.0
    weight_bm25: float = 1.0
    weight_title: float = 1.4
    weight_graph: float = 0.8
    title_pages: int = 4
    title_chunks: int = 3
    context_tokens: int = 2600
    chunks_per_page: int = 3
    # graph
    kg_enabled: bool = True
    kg_pages: int = 6
    kg_page_chunks: int = 2
    kg_facts: bool = False
    kg_max_facts: int = 12
    kg_max_hops: int = 2
    kg_beam: int = 24
    kg_path_limit: int = 12
    kg_hub_degree: int = 40
    kg_connect_hops: int = 3
    kg_chains: bool = True
    kg_max_chains: int = 4
    # answering
    decompose: bool = False
    decompose_parts: int = 3
    profile: str = "fast"
    model_fast: str = "small"
    model_quality: str = "large"
    temperature: float = 0.1
    max_answer_tokens: int = 512
    embed_batch: int = 16
    # fetching
    request_spacing_s: float = 0.35
    request_attempts: int = 6
    request_maxlag: int = 5
    titles_per_request: int = 50

    def model(self, profile: str | None = None) -> str:
        name = profile or self.profile
        if name not in ("fast", "quality"):
            raise ValueError(f"unknown profile {name}")
        return self.model_fast if name == "fast" else self.model_quality

    @property
    def index_dir(self) -> str:
        return f"{self.data_dir}/index"

    @property
    def graph_dir(self) -> str:
        return f"{self.data_dir}/graph"

    @property
    def raw_dir(self) -> str:
        return f"{self.data_dir}/raw"


def from_env(env: dict[str, str]) -> Settings:
    given = {}
    for f in fields(Settings):
        raw = env.get(f"LOREKEEP_{f.name.upper()}")
        if raw is not None:
            kind = type(f.default)
            given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return Settings(**given)


@lru_cache
def settings() -> Settings:
    env: dict[str, str] = {}
    if Path(".env").is_file():
        for line in Path(".env").read_text().splitlines():
            k, eq, v = line.partition("=")
            if eq and not k.lstrip().startswith("#"):
                env[k.strip()] = v.strip().strip("\"'")
    return from_env(env | dict(os.environ))
