"""The topic list of a run as plan constants.

Topics are a parameter of a run: a short list somebody named. Their vectors are read once, checked
against a size bound, and then travel inside the plan. Above the bound `tiles` joins them instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from talkspan.functions import vectors as vx

MAX_CONSTANT_NUMBERS = 1_000_000


@dataclass(frozen=True)
class TopicSpace:
    """Ordered topic names and their unit vectors (one row per topic)."""

    names: tuple[str, ...]
    rows: np.ndarray

    @property
    def size(self) -> int:
        return len(self.names)

    @property
    def dim(self) -> int:
        return int(self.rows.shape[1])

    def literal(self):
        return vx.matrix(self.rows.tolist())


def topic_space(topics: DataFrame, dim: int) -> TopicSpace:
    """Reads `topic_idx, name, vec`. Refuses lists beyond the bound, which `tiles` joins instead."""
    most = max(MAX_CONSTANT_NUMBERS // dim, 1)
    rows = topics.select("topic_idx", "name", "vec").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} topics of {dim} numbers: use tiles.similarities or tiles.top_topics")
    rows.sort(key=lambda r: r["topic_idx"])
    return TopicSpace(
        tuple(r["name"] for r in rows), vx.unit_rows([[float(x) for x in r["vec"]] for r in rows])
    )
