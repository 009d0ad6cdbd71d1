"""Settings for the usual panel of twelve assays, to be passed as ``overrides`` of a screening run."""

from __future__ import annotations

# Assay names, and number and depth of trees per assay.
ASSAYS = (
    "NR-AR",
    "NR-AR-LBD",
    "NR-AhR",
    "NR-Aromatase",
    "NR-ER",
    "NR-ER-LBD",
    "NR-PPAR-gamma",
    "SR-ARE",
    "SR-ATAD5",
    "SR-HSE",
    "SR-MMP",
    "SR-p53",
)
ASSAY_MODELS = {
    "NR-Aromatase": {"trees": 200, "depth": 15},
    "NR-AR": {"trees": 150, "depth": 12},
    "NR-AR-LBD": {"trees": 180, "depth": 14},
    "NR-ER": {"trees": 160, "depth": 13},
    "NR-ER-LBD": {"trees": 170, "depth": 14},
    "NR-PPAR-gamma": {"trees": 140, "depth": 11},
    "NR-AhR": {"trees": 190, "depth": 16},
    "SR-ARE": {"trees": 200, "depth": 15},
    "SR-ATAD5": {"trees": 130, "depth": 10},
    "SR-HSE": {"trees": 150, "depth": 12},
    "SR-MMP": {"trees": 160, "depth": 13},
    "SR-p53": {"trees": 180, "depth": 14},
}
# Feature selection of two assays that differ from the default.
ASSAY_SELECTION = {
    "NR-AR": {"correlation_limit": 0.85, "univariate_k": 400, "model_top_n": 120},
    "SR-ARE": {"correlation_limit": 0.95, "univariate_k": 600, "model_top_n": 180},
}
ASSAY_SETTINGS = {name: ASSAY_MODELS.get(name, {}) | ASSAY_SELECTION.get(name, {}) for name in ASSAYS}
