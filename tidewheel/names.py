"""Column names, fixed values and the naming convention of engineered columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SYMBOL, DATE, TIME, WEIGHT = "symbol_id", "date_id", "time_id", "weight"
KEYS = [SYMBOL, DATE, TIME]
STEP = [DATE, TIME]
SERIES = [SYMBOL, DATE]

# ---- fixed values of the data model -------------------------------------
FEATURES = [f"feature_{i:02d}" for i in range(79)]
CATEGORICAL = ["feature_09", "feature_10", "feature_11"]
RESPONDERS = [f"responder_{i}" for i in range(9)]
TARGET = "responder_6"
ROLLED_FEATURES = [
    "feature_06", "feature_04", "feature_07", "feature_36",
    "feature_60", "feature_45", "feature_56", "feature_05",
    "feature_51", "feature_19", "feature_66", "feature_59",
    "feature_54", "feature_70", "feature_71", "feature_72",
]
RANKED_FEATURES = [
    "feature_37", "feature_38", "feature_60", "feature_45", "feature_06", "feature_13",
]
FIRST_STABLE_DATE = 700
STEPS_PER_DAY = 968
ROLLING_ROWS = 1000

# Label construction: responder -> rows of the forward mean, per venue.
VENUE_A = {6: 20, 7: 120, 8: 4}
VENUE_B = {3: 20, 4: 120, 5: 4}
# Spread responder -> (minuend, subtrahend): venue B minus venue A.
VENUE_SPREAD = {0: (3, 6), 1: (4, 7), 2: (5, 8)}
# Momentum / venue-spread features: name -> (a, b) for lag(a) - lag(b).
LAG_DIFFERENCES = {
    "rsig_momA_short": (8, 6),
    "rsig_momA_med": (6, 7),
    "rsig_momB_short": (5, 3),
    "rsig_momB_med": (3, 4),
    "rsig_spread_fine": (8, 5),
}
# -------------------------------------------------------------------------


def rolling_diff(col: str, rows: int) -> str:
    return f"{col}_diff_rolling_avg_{rows}"


def rolling_std(col: str, rows: int) -> str:
    return f"{col}_rolling_std_{rows}"


def market_avg(col: str) -> str:
    return f"{col}_avg_per_date_time"


def rank_name(col: str) -> str:
    return f"{col}_rank_per_time"


def ewma_name(col: str, span: int = 30) -> str:
    return f"{col}_ewma_{span}"


def lag_name(r: int) -> str:
    return f"responder_{r}_lag1d"


def is_raw_feature(name: str) -> bool:
    """A native, non-categorical ``feature_NN`` column."""
    return name not in CATEGORICAL and re.fullmatch(r"feature_\d{2}", name) is not None


# Family -> pattern of the engineered column name.
_FAMILY = {
    "diff_rolling_avg": re.compile(r"(?P<col>.+)_diff_rolling_avg_(?P<rows>\d+)"),
    "rolling_std": re.compile(r"(?P<col>.+)_rolling_std_(?P<rows>\d+)"),
    "market_avg": re.compile(r"(?P<col>.+)_avg_per_date_time"),
    "rank": re.compile(r"(?P<col>.+)_rank_per_time"),
    "ewma": re.compile(r"(?P<col>.+)_ewma_(?P<rows>\d+)"),
    "lag1d": re.compile(r"responder_(?P<r>\d+)_lag1d"),
    "rsig": re.compile(r"rsig_\w+"),
    "time": re.compile(r"feature_time_id"),
    "raw": re.compile(r"feature_\d{2}"),
}


def family(name: str) -> str:
    """Feature family of an engineered column name (``other`` when unknown)."""
    for fam, pattern in _FAMILY.items():
        if pattern.fullmatch(name):
            return fam
    return "other"


@dataclass
class Recipe:
    """What must be computed to obtain a list of engineered columns."""

    columns: list[str]
    rows: int | None = None
    rolled: list[str] = field(default_factory=list)
    averaged: list[str] = field(default_factory=list)
    ranked: list[str] = field(default_factory=list)
    smoothed: list[str] = field(default_factory=list)
    lagged: list[int] = field(default_factory=list)
    differences: list[str] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)
    time: bool = False


def parse_recipe(columns: list[str]) -> Recipe:
    """Read the feature recipe back out of the column names."""
    rec = Recipe(list(columns))

    def add(into: list, item) -> None:
        if item not in into:
            into.append(item)

    for name in columns:
        fam = family(name)
        if fam == "other":
            raise ValueError(f"not an engineered column name: {name}")
        found = _FAMILY[fam].fullmatch(name).groupdict()
        if fam in ("diff_rolling_avg", "rolling_std"):
            rows = int(found["rows"])
            if rec.rows not in (None, rows):
                raise ValueError(f"mixed rolling windows: {rec.rows} and {rows}")
            rec.rows = rows
            add(rec.rolled, found["col"])
        elif fam == "market_avg":
            add(rec.averaged, found["col"])
        elif fam == "rank":
            add(rec.ranked, found["col"])
        elif fam == "ewma":
            add(rec.smoothed, found["col"])
        elif fam == "lag1d":
            add(rec.lagged, int(found["r"]))
        elif fam == "rsig":
            add(rec.differences, name)
            for r in LAG_DIFFERENCES[name]:
                add(rec.lagged, r)
        elif fam == "time":
            rec.time = True
        else:
            add(rec.raw, name)
    return rec
