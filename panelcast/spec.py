"""Names and constants of a panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The modelling contract.
HORIZON = 1
MAX_LAG = 6
MIN_HISTORY = 7
CONTRACT_VERSION = 1
FESTIVE_MONTHS = (8, 9, 10, 11)
SUMMER_MONTHS = (4, 5, 6)
TOTAL_LABEL = "All India (U+R)"
GATE_TOTAL_WMAPE = 6.00
GATE_VS_NAIVE = 0.80
GATE_MASE = 1.00

SPLIT = "__split"
TRAIN, TEST = "train", "test"


@dataclass(frozen=True)
class PanelSpec:
    """One row per (entity, segment, date) with a target and exogenous metrics.

    A series is an (entity, segment) pair. Its length is bounded by the calendar,
    because dates are months and a month occurs once per series; the contract's
    ``duplicate_keys`` rule reports panels where that does not hold.
    """

    entity: str = "brand"
    segment: str = "zone"
    date: str = "date"
    target: str = "value_lakhs"
    # fixed values: the metrics of the panel, in their order
    exog: tuple[str, ...] = (
        "numeric_dist_pct",
        "wtd_dist_val",
        "num_stores",
        "ms_value",
        "volume_tonnes",
        "sah",
        "str_days",
        "pdo_rs",
    )
    total_label: str = TOTAL_LABEL
    festive_months: tuple[int, ...] = FESTIVE_MONTHS
    summer_months: tuple[int, ...] = SUMMER_MONTHS
    max_lag: int = MAX_LAG
    min_history: int = MIN_HISTORY

    @property
    def series(self) -> list[str]:
        return [self.entity, self.segment]

    @property
    def key(self) -> list[str]:
        return [self.entity, self.segment, self.date]

    @property
    def metrics(self) -> list[str]:
        return [self.target, *self.exog]

    @property
    def columns(self) -> list[str]:
        return self.key + self.metrics

    @property
    def entity_code(self) -> str:
        return f"{self.entity}_code"

    @property
    def segment_code(self) -> str:
        return f"{self.segment}_code"

    @property
    def codes(self) -> list[str]:
        return [self.entity_code, self.segment_code]

    @property
    def exog_features(self) -> list[str]:
        return [name for c in self.exog for name in (f"{c}_l1", f"{c}_d1")]

    @property
    def numeric_features(self) -> list[str]:
        """Every model feature except the two codes, in contract order: fixed values."""
        return [
            "d_l3",
            "rm6",
            "sd6",
            "zt_d1",
            "share_l1",
            *self.exog_features,
            "month",
            "is_festive",
        ]

    @property
    def feature_order(self) -> list[str]:
        """Model inputs. The order is part of the contract with a fitted model."""
        return self.numeric_features + self.codes

    @property
    def schema(self) -> T.StructType:
        fields = [
            T.StructField(self.entity, T.StringType(), False),
            T.StructField(self.segment, T.StringType(), False),
            T.StructField(self.date, T.DateType(), False),
        ]
        fields += [T.StructField(m, T.DoubleType(), True) for m in self.metrics]
        return T.StructType(fields)
