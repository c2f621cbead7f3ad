"""Settings: defaults, a JSON file over them, the environment over that."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "LODESTONE_"


@dataclass
class Config:
    data_dir: str = ""
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    rrf_dense_weight: float = 1.0
    rrf_sparse_weight: float = 0.5
    ppr_alpha: float = 0.85
    ppr_seed_k: int = 20
    min_graph_edges_for_ppr: int = 50
    dense_candidates: int = 50
    sparse_candidates: int = 50
    subgraph_hops: int = 1
    neighbours: int = 10
    snippet_chars: int = 600
    reranker_k: int = 50
    rerank_by_default: bool = False
    chunk_strategy: str = "ast"
    chunk_window_lines: int = 64
    chunk_overlap_lines: int = 16
    watch_debounce_s: float = 2.0
    auto_index_paths: list[str] = field(default_factory=list)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """A value of the environment that can't be read as its setting's kind stays a text; an empty one doesn't count."""
    data = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    env = dict(os.environ) if env is None else env
    for f in fields(Config):
        said = env.get(PREFIX + f.name.upper())
        if not said:
            continue
        try:
            if f.type == "int":
                data[f.name] = int(said)
            elif f.type == "float":
                data[f.name] = float(said)
            elif f.type == "bool":
                data[f.name] = said.lower() in ("1", "true", "yes", "on")
            elif f.type == "list[str]":
                data[f.name] = json.loads(said) if said.startswith("[") else [x for x in said.split(":") if x]
            else:
                data[f.name] = said
        except ValueError:
            data[f.name] = said
    names = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in data.items() if k in names})
