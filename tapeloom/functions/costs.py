"""Transaction costs, in weights (turnover) and in currency (fills)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.expr import as_col


@dataclass(frozen=True)
class CostModel:
    # Default rates of the cost schedule.
    commission: float = 0.00025
    stamp: float = 0.0005
    transfer: float = 0.00001
    slippage: float = 0.0001
    impact: float = 0.1
    min_commission: float = 5.0

    def turnover_cost(self, held: Column | str, previous: Column | str) -> Column:
        """Return drag of moving from ``previous`` to ``held``; stamp tax on reductions only."""
        move = as_col(held) - as_col(previous)
        both = self.commission + self.transfer + self.slippage
        return F.abs(move) * both + F.greatest(-move, F.lit(0.0)) * self.stamp

    def trade_cost(self, notional: Column, is_sell: Column, participation: Column) -> Column:
        """Currency cost of one fill, with the commission floor and square-root impact."""
        impact = F.sqrt(F.greatest(participation, F.lit(0.0))) * self.impact
        return (
            F.greatest(notional * self.commission, F.lit(self.min_commission))
            + notional * (impact + (self.transfer + self.slippage))
            + F.when(is_sell, notional * self.stamp).otherwise(F.lit(0.0))
        )


FREE = CostModel(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
