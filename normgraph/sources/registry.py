"""Formats of documents by name: loaded from files, listed by jurisdiction, and detected in texts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.operators.extraction import format_scores

try:
    import yaml
except ImportError:  # YAML files need PyYAML; JSON files do not
    yaml = None


class Formats(Mapping):
    """Formats (id to its indicators), each {"jurisdiction": .., "required": [[pattern, weight]], "optional": .., "negative": ..}."""

    def __init__(self, formats: Mapping[str, Mapping] | None = None):
        self._formats = dict(formats or {})
        for name, f in self._formats.items():
            if not f.get("required"):
                raise ValueError(f"{name} has no required indicator")

    @classmethod
    def load(cls, folder: str) -> "Formats":
        """Formats of the .json, .yaml and .yml files of a folder, named by their ``id`` or the file's name; later names replace earlier ones."""
        found = {}
        for path in sorted(Path(folder).iterdir()):
            if path.suffix == ".json":
                f = json.loads(path.read_text())
            elif path.suffix in (".yaml", ".yml"):
                if yaml is None:
                    raise ImportError(f"{path.name} needs PyYAML")
                f = yaml.safe_load(path.read_text())
            else:
                continue
            found[f.get("id", path.stem)] = f
        return cls(found)

    def __getitem__(self, name: str) -> Mapping:
        return self._formats[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._formats)

    def __len__(self) -> int:
        return len(self._formats)

    def of(self, jurisdiction: str) -> list[str]:
        return sorted(n for n, f in self._formats.items() if str(f.get("jurisdiction", "")).lower() == jurisdiction.lower())

    def indicators(self) -> dict[str, dict[str, list[tuple[str, float]]]]:
        return {n: {k: [(p, float(w)) for p, w in f.get(k, ())] for k in ("required", "optional", "negative")} for n, f in self._formats.items()}

    def detect(self, documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
        """(key, format, score): the best format of each text with a score over ``least``.

        Of equal scores, the format with more required indicators wins, then the lesser name.
        """
        scores = format_scores(documents, self.indicators(), key, text)
        needs = F.create_map(*[F.lit(x) for n, f in self._formats.items() for x in (n, len(f["required"]))])
        best = scores.filter(F.col("score") > least).groupBy(key).agg(F.min_by("format", F.struct(-F.col("score"), -needs[F.col("format")], "format")).alias("format"), F.max("score").alias("score"))
        return best.select(key, "format", "score")
