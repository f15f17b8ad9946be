"""Refine or recompute: a cost model from what earlier batches took."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Change
from .bsp import Run, refine, run


def fit(samples: DataFrame) -> DataFrame:
    """(slope, intercept) of seconds over work, by Spark's regression aggregates."""
    return samples.agg(F.regr_slope("seconds", "work").alias("slope"), F.regr_intercept("seconds", "work").alias("intercept"))


@dataclass
class Adaptive:
    """Keeps (work, seconds) of past refinement steps and decides for the next batch."""

    samples: list[tuple[float, float]] = field(default_factory=list)
    last_full: float | None = None
    decisions: list[str] = field(default_factory=list)

    def predicted(self, work: float) -> float | None:
        n = len(self.samples)
        if n < 2:
            return None
        mx, my = sum(w for w, _ in self.samples) / n, sum(s for _, s in self.samples) / n
        spread = sum((w - mx) ** 2 for w, _ in self.samples)
        slope = sum((w - mx) * (s - my) for w, s in self.samples) / spread if spread else 0.0
        return my + slope * (work - mx)

    def advance(self, old: Run, change: Change) -> Run:
        """The next run, by the way that is likely to be cheaper."""
        share = self.samples[-1][0] if self.samples else 0.0
        cost = self.predicted(share)
        if cost is not None and self.last_full is not None and cost * max(1, len(old.states) - 1) > self.last_full:
            self.decisions.append("recompute")
            new = run(old.program, change.after)
            self.last_full = sum(new.seconds)
        else:
            self.decisions.append("refine")
            new = refine(old, change)
            self.samples += list(zip(new.work, new.seconds))  # noqa: B905  steps past the old horizon have no work figure
        return new
