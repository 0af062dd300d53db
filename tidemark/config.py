"""Run configuration: keyword over environment over default."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

PREFIX = "TIDEMARK_"
RUN_MODES = ("incremental", "full")
ENVIRONMENTS = ("local", "cluster")
LAYERS = ("bronze", "silver", "gold")


@dataclass(frozen=True)
class Settings:
    """Where tables live and what a run covers.

    catalog may be empty; a table's name then has two parts. as_of anchors all
    recency features, so a run can be repeated.
    """

    base_path: str = "data/lake"
    input_path: str = "data/input"
    catalog: str = ""
    bronze_schema: str = "bronze"
    silver_schema: str = "silver"
    gold_schema: str = "gold"
    environment: str = "local"
    run_mode: str = "incremental"
    batch_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    as_of: dt.date | None = None

    def __post_init__(self) -> None:
        for name, allowed in (("run_mode", RUN_MODES), ("environment", ENVIRONMENTS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")

    @property
    def full(self) -> bool:
        return self.run_mode == "full"

    def schema_of(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer!r}")
        return getattr(self, f"{layer}_schema")

    def table_name(self, layer: str, table: str) -> str:
        return ".".join(part for part in (self.catalog, self.schema_of(layer), table) if part)

    def table_path(self, layer: str, table: str) -> str:
        return f"{self.base_path.rstrip('/')}/{self.schema_of(layer)}/{table}"

    def quarantine_path(self, entity: str) -> str:
        return self.table_path("silver", f"_quarantine/{entity}")

    def as_dict(self) -> dict[str, str]:
        return {k: "" if v is None else str(v) for k, v in asdict(self).items()}


def load_settings(environ: Mapping[str, str] | None = None, **given) -> Settings:
    """Settings from keywords (None counts as not given), then TIDEMARK_* variables, then defaults."""
    environ = os.environ if environ is None else environ
    names = {f.name for f in fields(Settings)}
    unknown = set(given) - names
    if unknown:
        raise TypeError(f"no such setting: {', '.join(sorted(unknown))}")
    chosen = {name: environ[PREFIX + name.upper()] for name in names if environ.get(PREFIX + name.upper())}
    chosen |= {k: v for k, v in given.items() if v is not None}
    if isinstance(chosen.get("as_of"), str):
        chosen["as_of"] = dt.datetime.strptime(chosen["as_of"], "%Y-%m-%d").date()
    return Settings(**chosen)
