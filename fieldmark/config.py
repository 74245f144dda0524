"""Where things lie; FIELDMARK_HOME moves all of it, to another folder or to a store that Spark reads."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

#: What lies where below the home.
PLACES = {
    "facts": "facts",
    "manifest": "manifests/facts.json",
    "listing": "manifests/listing.json",
    "keys": "registry/keys.json",
    "datasets": "registry/datasets.jsonl",
    "organisations": "registry/organisations.jsonl",
    "dimension": "dimension",
    "results": "results",
    "reports": "reports",
    "runs": "runs.jsonl",
}


@dataclass(frozen=True)
class Paths:
    home: str

    def __getattr__(self, name: str) -> str:
        if name not in PLACES:
            raise AttributeError(name)
        return f"{self.home}/{PLACES[name]}"


def default_paths() -> Paths:
    home = os.environ.get("FIELDMARK_HOME", "data")
    return Paths(home.rstrip("/") if "://" in home else str(Path(home).resolve()))
