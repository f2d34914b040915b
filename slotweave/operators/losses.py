"""What mapping turns into null, counted while the rows are written.

Metrics are observed on the rows on their way to the sink: how many values of
each coded slot the list lacks, the commonest of these with their counts, and how
many rows lack a required slot.  There is no second scan and nothing is
collected but the metrics: ``TOP`` values for each coded slot at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slotweave.sources.local import local_table

#: Values told of each slot, and values that are tracked for it: counts are exact where no more are unmapped.
TOP, TRACKED = 200, 10_000


@dataclass
class Losses:
    """Filled by the first action on the rows that ``execute`` returns."""

    coded: list[tuple[Observation, str, str, dict[str, tuple[str, str]]]] = field(default_factory=list)
    lacking: list[tuple[Observation, str, str, dict[str, str]]] = field(default_factory=list)

    def watched(self, data: DataFrame, source_class: str, target_class: str, coded: dict[tuple, tuple[Column, Column]]) -> DataFrame:
        if not coded or data.isStreaming:
            return data
        seen, metrics, names = Observation(), [], {}
        for k, (slots, (value, hit)) in enumerate(coded.items()):
            lost = F.when(hit.isNull(), value)  # null values of the data are no loss
            metrics += [F.count(lost).alias(f"n{k}"), F.call_function("approx_top_k", lost, F.lit(TOP), F.lit(TRACKED)).alias(f"v{k}")]
            names[f"{k}"] = slots[:2]
        self.coded.append((seen, source_class, target_class, names))
        return data.observe(seen, *metrics)

    def required(self, rows: DataFrame, source_class: str, target_class: str, slots: list[str]) -> DataFrame:
        if not slots or rows.isStreaming:
            return rows
        seen = Observation()
        self.lacking.append((seen, source_class, target_class, {f"r{k}": s for k, s in enumerate(slots)}))
        return rows.observe(seen, *(F.count(F.when(F.col(f"`{s}`").isNull(), 1)).alias(f"r{k}") for k, s in enumerate(slots)))

    def values(self, spark: SparkSession) -> DataFrame:
        """(source_class, source_slot, target_class, target_slot, value, n) of the commonest values that became null."""
        rows = []
        for seen, source_class, target_class, names in self.coded:
            told = seen.get
            for k, (to, slot) in names.items():
                rows += [(source_class, slot, target_class, to, r["item"], r["count"]) for r in told[f"v{k}"] or [] if r["item"] is not None]
        return local_table(spark, rows, "source_class string, source_slot string, target_class string, target_slot string, value string, n long")

    def counts(self, spark: SparkSession) -> DataFrame:
        """(source_class, target_class, target_slot, reason, n): values that became null, and rows that lack a required slot; zeros included."""
        rows = [(source, target, to, "unmapped value", seen.get[f"n{k}"]) for seen, source, target, names in self.coded for k, (to, _) in names.items()]
        rows += [(source, target, s, "required slot is null", seen.get[k]) for seen, source, target, names in self.lacking for k, s in names.items()]
        return local_table(spark, rows, "source_class string, target_class string, target_slot string, reason string, n long")
