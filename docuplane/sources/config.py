"""Settings: defaults, then a TOML file, then environment variables DOCUPLANE_*."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields


@dataclass
class Config:
    batch_size: int = 1000
    max_content_length: int = 100_000
    max_extract_depth: int = 5
    embed_batch: int = 50
    embed_dimension: int = 1024
    context_length: int = 8192
    chunk_overlap: int = 200
    data_dir: str = "data"

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        values: dict = {}
        if path:
            with open(path, "rb") as f:
                values |= tomllib.load(f)
        env = os.environ if env is None else env
        values |= {f.name: env[f"DOCUPLANE_{f.name.upper()}"] for f in fields(cls) if f"DOCUPLANE_{f.name.upper()}" in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in values.items() if k in kinds})
