"""Settings that change results: typed defaults under a user file under a project file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """The defaults."""

    turns_between_memory: int = 10
    session_idle_memory_seconds: int = 600
    consolidation_dark_period_seconds: int = 300
    recall_result_limit: int = 5
    recall_candidate_pool: int = 20
    recall_live_turn_window: int = 3
    recall_query_max_chars: int = 12000
    recall_similarity_threshold: float = 0.3
    recall_project_tiebreaker: bool = True
    recall_project_score_bonus: float = 0.05
    recall_llm_filter_enabled: bool = True
    recall_llm_filter_candidate_limit: int = 12
    recall_llm_filter_prompt_max_chars: int = 12000
    embedding_model: str = "hash-embedding"
    memory_cluster_distance_threshold: float = 0.21125
    memory_cluster_min_size: int = 3
    memory_cluster_max_size: int = 5
    max_memory_length: int = 12000
    max_formulation_tokens: int = 32000
    tool_call_truncation_chars: int = 500
    backlog_max_concurrent_remote_jobs: int = 1
    backlog_formulation_turn_window: int = 10


def merge(base: dict, over: dict) -> dict:
    """`over` laid over `base`, tables within tables."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(*paths: str | Path) -> Config:
    """Defaults with each file that exists laid over them in turn; unknown keys are left out. A leading ~ is the home folder."""
    found: dict = {}
    for p in (Path(expand_home(str(x))) for x in paths):
        if p.exists():
            found = merge(found, tomllib.loads(p.read_text()))
    flat = {k: v for part in [found, *(v for v in found.values() if isinstance(v, dict))] for k, v in part.items() if not isinstance(v, dict)}
    names = {f.name for f in fields(Config)}
    return replace(Config(), **{k: v for k, v in flat.items() if k in names})


def expand_home(path: str, home: str | None = None) -> str:
    """`path` with a leading ~ replaced by the home folder; ~name and all else stay as they are."""
    if path != "~" and not path.startswith("~/"):
        return path
    folder = home or os.environ.get("HOME")
    if not folder:
        raise ValueError("no home folder is known")
    return folder + path[1:]
