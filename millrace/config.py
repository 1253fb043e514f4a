"""Settings of the engine, from a mapping of names to strings (an environment) or by hand."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

KINDS = ("prose", "table", "code", "mixed", "list", "blockquote")


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    """Only the word true counts as true."""
    value = env.get(name)
    return default if value is None else value.strip().lower() == "true"


def positive(env: Mapping[str, str], name: str, default: int, least: int = 1) -> int:
    value = env.get(name)
    if value is None or not value.strip():
        return default
    if not re.fullmatch(r"[0-9]+", value.strip()) or int(value) < least:
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return int(value)


def open_unit(env: Mapping[str, str], name: str, default: float) -> float:
    value = env.get(name)
    if value is None or not value.strip():
        return default
    if not 0 < (number := float(value)) < 1:
        raise ValueError(f"{name} must lie between 0 and 1")
    return number


def threshold(value: str | float | None, default: float) -> float:
    """A number from 0 to 1, or the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return number if 0 <= number <= 1 else default


@dataclass(frozen=True)
class Retrieval:
    limit: int = 5
    threshold: float = 0.5
    hybrid: bool = False
    trigram_threshold: float = 0.18
    pre_fusion_limit: int = 12
    rerank: bool = False
    rerank_candidates: int = 10
    rerank_timeout_s: float = 2.5
    rewrite: bool = False
    rewrite_timeout_s: float = 3.0
    rewrite_retries: int = 1
    rewrite_debug: bool = False
    rerank_debug: bool = False
    #: Fuse to the limit before reranking, so that reranking is always skipped; off by default.
    cut_before_rerank: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Retrieval:
        return cls(
            threshold=threshold(env.get("RETRIEVE_THRESHOLD_DEFAULT"), 0.55), hybrid=flag(env, "HYBRID_RETRIEVAL_ENABLED"), trigram_threshold=open_unit(env, "HYBRID_LEXICAL_TRIGRAM_THRESHOLD", 0.18),
            pre_fusion_limit=positive(env, "HYBRID_PRE_FUSION_LIMIT", 12), rerank=flag(env, "RERANKING_ENABLED"), rerank_candidates=positive(env, "RERANKING_CANDIDATE_COUNT", 10),
            rerank_timeout_s=positive(env, "RERANKING_TIMEOUT_MS", 2500) / 1000, rewrite=flag(env, "QUERY_REWRITE_ENABLED"), rewrite_timeout_s=positive(env, "QUERY_REWRITE_TIMEOUT_MS", 3000) / 1000,
            rewrite_retries=positive(env, "QUERY_REWRITE_MAX_RETRIES", 1, 0), rewrite_debug=flag(env, "QUERY_REWRITE_DEBUG"), rerank_debug=flag(env, "RERANKING_DEBUG"),
        )

    def branch_limit(self) -> int:
        """Rows that each branch fetches before fusion."""
        return max(3 * self.limit, self.pre_fusion_limit) if self.hybrid else max(self.limit, 8)


@dataclass(frozen=True)
class Enrichment:
    enabled: bool = True
    kinds: tuple[str, ...] = ("prose", "table", "code")
    min_chars: int = 300
    retries: int = 2
    timeout_s: float = 15.0

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Enrichment:
        kinds = tuple(x.strip() for x in env.get("ENRICH_CONTENT_KINDS", "prose,table,code").split(",") if x.strip())
        if unknown := set(kinds) - set(KINDS):
            raise ValueError(f"unknown content kinds: {sorted(unknown)}")
        return cls(flag(env, "ENRICH_ENABLED", True), kinds, positive(env, "ENRICH_MIN_CHARS", 300), positive(env, "ENRICH_MAX_RETRIES", 2, 0), positive(env, "ENRICH_TIMEOUT_MS", 15000) / 1000)


@dataclass(frozen=True)
class Quota:
    rpm: int = 15
    tpm: int = 250_000
    rpd: int = 500
    reserve: int = 1024


QUERY_QUOTA = Quota()
EMBEDDING_QUOTA = Quota(100, 30_000, 1_000, 0)


def batch_size(value: str | None, default: int = 50) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return number if number > 0 else default


def api_key(env: Mapping[str, str], own: str, shared: str) -> str:
    """A feature's own key, else the shared one."""
    if key := env.get(own) or env.get(shared):
        return key
    raise KeyError(f"neither {own} nor {shared} is set")
