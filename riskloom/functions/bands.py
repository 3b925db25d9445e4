"""Tables of thresholds."""

from __future__ import annotations

import math

#: Rating bands (name, lowest score, score that is too high).
RATINGS = [("AAA", 90, 100), ("AA", 80, 90), ("A", 70, 80), ("BBB", 60, 70), ("BB", 50, 60), ("B", 40, 50), ("CCC", 30, 40), ("CC/C", 0, 30)]

#: The five levels of four measures (lowest value, value that belongs to the next level).
LEVELS = {
    "capital_adequacy": {"very_strong": (15.0, math.inf), "strong": (12.0, 15.0), "adequate": (10.0, 12.0), "weak": (8.0, 10.0), "very_weak": (0.0, 8.0)},
    "npl_ratio": {"very_strong": (0.0, 2.0), "strong": (2.0, 4.0), "adequate": (4.0, 7.0), "weak": (7.0, 10.0), "very_weak": (10.0, math.inf)},
    "roe": {"very_strong": (15.0, math.inf), "strong": (10.0, 15.0), "adequate": (5.0, 10.0), "weak": (0.0, 5.0), "very_weak": (-math.inf, 0.0)},
    "liquidity": {"very_strong": (40.0, math.inf), "strong": (30.0, 40.0), "adequate": (20.0, 30.0), "weak": (15.0, 20.0), "very_weak": (0.0, 15.0)},
}

#: The features that a complete model needs.
REQUIRED = (
    "gdp_per_capita", "credit_to_gdp_gap", "govt_debt_gdp", "current_account_gdp", "inflation", "capital_adequacy",
    "npl_ratio", "roe", "liquid_assets_st_liab", "loan_concentration", "real_estate_loans",
)
