"""Two-step density grids with closed-form level indices, so no range join is needed to find a bin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Levels low, low + step1, ... up to mid, then by step2 up to high (high itself is the end of the axis)."""

    low: float = 19.0
    mid: float = 26.0
    high: float = 28.5
    step1: float = 0.2
    step2: float = 0.1

    @property
    def coarse(self) -> int:
        return round((self.mid - self.low) / self.step1)

    @property
    def size(self) -> int:
        return self.coarse + round((self.high - self.mid) / self.step2)

    def value(self, index: Column) -> Column:
        return F.when(index < self.coarse, self.low + index * self.step1).otherwise(self.mid + (index - self.coarse) * self.step2)

    def step(self, index: Column) -> Column:
        return F.when(index < self.coarse, self.step1).otherwise(self.step2)

    def _place(self, rho: Column) -> Column:
        # nine decimals: a value that is a level up to rounding counts as that level
        return F.when(rho < self.mid, F.round((rho - self.low) / self.step1, 9)).otherwise(self.coarse + F.round((rho - self.mid) / self.step2, 9))

    def bin(self, rho: Column) -> Column:
        """Index of the bin [level, next level) of a density; null outside of the grid."""
        at = F.floor(self._place(rho)).cast("int")
        return F.when((at >= 0) & (at < self.size), at)

    def bins_closed(self, rho: Column) -> Column:
        """Indices of the bins [level, next level] of a density, both ends included: two where it is on a level between bins."""
        place = self._place(rho)
        i = F.floor(place).cast("int")
        on_edge = place == F.floor(place)
        both = F.array(F.when(on_edge, i - 1), i)
        return F.filter(both, lambda k: (k >= 0) & (k < self.size))

    def first_at_or_above(self, rho: Column) -> Column:
        """Index of the first level >= a density; may be below 0 or beyond the grid."""
        return F.ceil(self._place(rho)).cast("int")

    def table(self, spark: SparkSession) -> DataFrame:
        """(rho_idx, rho, lo, hi, d_rho); the first lo is 0 and the last hi 50."""
        i = F.col("id").cast("int")
        lo = F.when(i == 0, 0.0).otherwise(self.value(i))
        hi = F.when(i == self.size - 1, 50.0).otherwise(self.value(i + 1))
        return spark.range(self.size).select(i.alias("rho_idx"), self.value(i).alias("rho"), lo.alias("lo"), hi.alias("hi"), self.step(i).alias("d_rho"))


SURFACE = Grid(22.0, 25.0, 29.0, 0.1, 0.05)
