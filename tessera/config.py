"""Settings of the sequence operators: thresholds, word lists, and how a YAML file is laid over them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# Portuguese words that run into the next one.
ARTICLES = ("o", "a", "os", "as", "um", "uma", "uns", "umas")
PREPOSITIONS = ("de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "para", "pra", "pro")
# Words too common to anchor an alignment.
COMMON_WORDS = (
    "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "para", "pra", "pro", "por", "com", "sem", "que", "se", "e", "ou", "mas", "mais", "menos", "eu", "tu", "ele", "ela", "vos", "eles", "elas", "meu", "minha", "seu", "sua", "teu", "tua", "este", "esta", "esse", "essa", "aquele", "aquela", "nao", "sim", "muito", "pouco", "ja", "ainda", "the", "an", "is", "are", "was", "were", "be", "been",
)


@dataclass(frozen=True)
class GapSettings:
    """Upper ends of gap types in ms, and the liaison word lists."""

    micro_max: float = 50
    short_max: float = 150
    medium_max: float = 400
    natural_max: float = 600
    sentence_boundary_min: float = 600
    articles: tuple[str, ...] = ARTICLES
    prepositions: tuple[str, ...] = PREPOSITIONS
    article_liaison: bool = True
    preposition_liaison: bool = True


@dataclass(frozen=True)
class QualitySettings:
    review_threshold: float = 0.80
    max_timing_deviation: float = 100
    correction_min: float = 0.7
    min_word_ms: float = 200


@dataclass(frozen=True)
class Settings:
    language: str = "pt"
    provider: str = "local"
    use_local: bool = False
    bundle_assets: bool = False
    gaps: GapSettings = field(default_factory=GapSettings)
    quality: QualitySettings = field(default_factory=QualitySettings)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over laid on it, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


#: Sections of the file that go by another name here.
RENAMED = {"gap_classification": "gaps", "gap_thresholds": "gaps"}


def flattened(raw: Mapping[str, Any]) -> dict[str, Any]:
    """A file's sections as Settings names them: project.language at the top, transcription.provider too."""
    out: dict[str, Any] = {}
    for k, v in raw.items():
        if k == "project" and isinstance(v, Mapping):
            out |= {n: v[n] for n in ("language",) if n in v}
        elif k == "transcription" and isinstance(v, Mapping):
            out |= {n: v[n] for n in ("provider", "use_local") if n in v}
        else:
            out[RENAMED.get(k, k)] = v
    return out


def settings(*layers: Mapping[str, Any]) -> Settings:
    """Defaults under the layers, later ones on top; names that Settings doesn't have are ignored."""

    def lay(base, values):
        known = {f.name for f in fields(base)}
        changes = {}
        for k, v in values.items():
            if k in known:
                own = getattr(base, k)
                changes[k] = lay(own, v) if is_dataclass(own) and isinstance(v, Mapping) else tuple(v) if isinstance(own, tuple) else v
        return replace(base, **changes)

    total: dict[str, Any] = {}
    for x in layers:
        total = merged(total, x)
    return lay(Settings(), total)


def load_settings(path: str, **overrides: Any) -> Settings:
    """Settings of a YAML file; keyword arguments outrank it."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(flattened(yaml.safe_load(f) or {}), overrides)
