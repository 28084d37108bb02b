"""Fixed values that must equal the clinical query definitions and the
driver-table fixture mapping.  Kept together, in natural order, as data.
"""

from __future__ import annotations

# --- fixed values: measurement codes of the height/weight mart ------------
# (itemid, parameter, factor to kg or cm)
HEIGHT_WEIGHT_CODES = [
    (762, "WEIGHT", 1.0),
    (763, "WEIGHT", 1.0),
    (3723, "WEIGHT", 1.0),
    (3580, "WEIGHT", 1.0),
    (226512, "WEIGHT", 1.0),
    (3581, "WEIGHT", 0.45359237),      # pounds
    (3582, "WEIGHT", 0.0283495231),    # ounces
    (920, "HEIGHT", 2.54),             # inches
    (1394, "HEIGHT", 2.54),
    (4187, "HEIGHT", 2.54),
    (3486, "HEIGHT", 2.54),
    (226707, "HEIGHT", 2.54),
    (3485, "HEIGHT", 1.0),             # centimetres
    (4188, "HEIGHT", 1.0),
]
LB_TO_KG = 0.45359237

# --- fixed values: vasopressor codes ---------------------------------------
# CareVue (inputevents_cv): drug -> codes whose rate is per minute and must be
# divided by body weight, and codes already per kg.
CV_DRUGS = {
    "norepinephrine": {"per_weight": [30047], "per_kg": [30120]},
    "epinephrine": {"per_weight": [30044], "per_kg": [30119, 30309]},
    "dopamine": {"per_weight": [], "per_kg": [30043, 30307]},
    "dobutamine": {"per_weight": [], "per_kg": [30042, 30306]},
}
CV_CODES = [30047, 30120, 30044, 30119, 30309, 30043, 30307, 30042, 30306]
# MetaVision (inputevents_mv): drug -> code
MV_DRUGS = {
    "norepinephrine": 221906,
    "epinephrine": 221289,
    "dopamine": 221662,
    "dobutamine": 221653,
}
MV_CODES = [221906, 221289, 221662, 221653]
MV_REWRITTEN = "Rewritten"

# --- fixed values: observations per seasonal cycle by unit ------------------
FREQUENCY = {
    "year": [1.0],
    "quarter": [4.0],
    "month": [12.0],
    "week": [52.0],
    "day": [7.0, 365.25],
    "hour": [24.0, 168.0, 8766.0],
    "minute": [60.0, 1440.0, 10080.0, 525960.0],
}

# --- fixed values: fixture mapping of the driver `events` table -------------
# chartevents itemid by position 1 + event_id % 16
FIXTURE_CHART_ITEMS = [762, 763, 3723, 3580, 226512, 3581, 3582, 920, 1394,
                       4187, 3486, 226707, 3485, 4188, 226531, 999]
# inputevents_cv itemid by position 1 + event_id % 10
FIXTURE_CV_ITEMS = [30047, 30120, 30044, 30119, 30309, 30043, 30307, 30042,
                    30306, 30001]
# inputevents_mv itemid by position 1 + event_id % 4
FIXTURE_MV_ITEMS = [221906, 221289, 221662, 221653]


def hw_itemids() -> list[int]:
    return [c[0] for c in HEIGHT_WEIGHT_CODES]


def weight_itemids() -> list[int]:
    return [c[0] for c in HEIGHT_WEIGHT_CODES if c[1] == "WEIGHT"]
