"""Options of a store, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

STRATEGIES = ("leveled", "tiered", "fifo")


@dataclass
class Config:
    rows_per_file: int = 1_000_000
    strategy: str = "leveled"
    level0_trigger: int = 4
    level0_stop: int = 12
    level_base_bytes: int = 64 << 20
    level_ratio: int = 10
    tier_least: int = 4
    tier_most: int = 32
    tier_ratio: float = 4.0
    fifo_bytes: int = 640 << 20
    fifo_ttl_seconds: int = 0
    client_rate: float = 100.0
    global_rate: float = 10_000.0

    def validate(self) -> Config:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and not isinstance(v, bool) and (v < 0 or v == 0 and f.name != "fifo_ttl_seconds"):
                raise ValueError(f"{f.name} must be above 0")
        if self.level0_stop < self.level0_trigger or self.tier_most < self.tier_least:
            raise ValueError("a limit lies below its trigger")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text)).validate()
