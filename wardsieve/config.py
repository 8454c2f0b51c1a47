"""Settings of the screening pipeline."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class TextSettings:
    reject_threshold: float = 0.85
    review_threshold: float = 0.5
    gate: bool = True
    bloom_bits: int = 8 * 1024 * 1024
    bloom_hashes: int = 5
    cache_ttl_seconds: int = 24 * 3600


@dataclass(frozen=True)
class ImageSettings:
    nsfw_threshold: float = 0.7
    max_distance: int = 10
    gate: bool = True
    bloom_bits: int = 1024 * 1024
    bloom_hashes: int = 7
    cache_ttl_seconds: int = 24 * 3600
    top: int = 5


@dataclass(frozen=True)
class Settings:
    text: TextSettings = TextSettings()
    image: ImageSettings = ImageSettings()

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From nested mappings; keys that are not given keep their defaults, unknown ones raise."""
        out = cls()
        for part, given in values.items():
            known = {f.name for f in fields(getattr(out, part))}
            if bad := set(given) - known:
                raise ValueError(f"unknown settings of {part}: {sorted(bad)}")
            out = replace(out, **{part: replace(getattr(out, part), **given)})
        return out

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a JSON file, or a YAML file where a YAML library is installed."""
        with open(path) as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return cls.of(yaml.safe_load(f))
            return cls.of(json.load(f))
