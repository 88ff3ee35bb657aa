"""Settings from the environment, and a session with sensible defaults for large scans."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Defaults: adaptive plans, Arrow transfer, UTC.  Sizes of shuffles are left to adaptive execution.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(**conf: str) -> SparkSession:
    return SparkSession.builder.config(map=DEFAULTS | conf).getOrCreate()


@dataclass(frozen=True)
class Settings:
    """What the service reads from its environment; blank values are defaults, malformed ones raise."""

    search_timeout: int = 25
    search_permits: int = 2
    search_interval_ms: int = 10_000
    categories: str = "general,it,science,news,map"
    embeddings: bool = True

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "MILLRACE_") -> Settings:
        env = dict(os.environ) if env is None else env
        out = {}
        for name, kind in cls.__annotations__.items():
            raw = env.get(prefix + name.upper(), "").strip()
            if not raw:
                continue
            if kind == "int":
                out[name] = int(raw)
            elif kind == "bool":
                if raw.lower() not in ("true", "false", "1", "0"):
                    raise ValueError(f"{prefix}{name.upper()}: {raw!r} is no boolean")
                out[name] = raw.lower() in ("true", "1")
            else:
                out[name] = raw
        return cls(**out)
