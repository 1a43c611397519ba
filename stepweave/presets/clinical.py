"""Preset: intensive-care feature dictionary, drug tables and thresholds."""

from __future__ import annotations

from stepweave.operators.features import FeatureSpec, Registry, make_registry

# Intravenous fluid items
FLUID_ITEMS = (
    220949, 220950, 225158, 225159, 225161, 225168, 225828, 225823, 225825, 226089, 220952, 220955,
)

# Vasopressor items and their norepinephrine equivalence
AGENT_ITEMS = {
    221906: "norepinephrine",
    221289: "epinephrine",
    221662: "dopamine",
    222315: "phenylephrine",
    222042: "vasopressin",
}
AGENT_FACTORS = {
    "norepinephrine": 1.0,
    "epinephrine": 1.0,
    "dopamine": 0.01,
    "phenylephrine": 0.1,
    "vasopressin": 2.5,
}

# Drug name keywords of the antibiotic order scan
ANTIBIOTIC_KEYWORDS = (
    "CEFAZOLIN",
    "CEFTRIAXONE",
    "CEFEPIME",
    "CEFTAZIDIME",
    "VANCOMYCIN",
    "PIPERACILLIN",
    "MEROPENEM",
    "IMIPENEM",
    "CIPROFLOXACIN",
    "LEVOFLOXACIN",
    "METRONIDAZOLE",
    "AMPICILLIN",
    "GENTAMICIN",
    "TOBRAMYCIN",
    "AMIKACIN",
    "AZITHROMYCIN",
    "DOXYCYCLINE",
    "TRIMETHOPRIM",
    "LINEZOLID",
    "DAPTOMYCIN",
    "ERTAPENEM",
    "DORIPENEM",
    "COLISTIN",
    "POLYMYXIN",
    "TIGECYCLINE",
    "AZTREONAM",
    "CEFOXITIN",
    "CEFUROXIME",
    "NAFCILLIN",
    "OXACILLIN",
    "CLINDAMYCIN",
    "PENICILLIN",
    "AMOXICILLIN",
)

# Score components, ``name: (items, threshold)``
SCORE_COMPONENTS = {
    "cardio": ((220052, 220181), 70),
    "resp": ((220277,), 94),
    "neuro": ((223901,), 15),
}
SCORE_ITEMS = (220052, 220181, 220277, 223901, 226559)

# Limits of the proxy score on the state table
PROXY_LIMITS = {"map": 70.0, "spo2": 94.0, "gcs_total": 15.0}

# The feature dictionary, in state order.
# Infusion and output amounts are aggregated without a range check.
FEATURES = (
    FeatureSpec("heart_rate", "chart", (220045,), "last", "forward_fill", (0.0, 350.0), (0.0, 300.0), 75.0, False),
    FeatureSpec(
        "map", "chart",
        (220052, 52, 220181, 224),
        "last", "forward_fill", (0.0, 300.0), (0.0, 200.0), 80.0, True,
    ),
    FeatureSpec("sbp", "chart", (220179, 51), "last", "forward_fill", (0.0, 300.0), (0.0, 250.0), 120.0, False),
    FeatureSpec("dbp", "chart", (220180, 8368), "last", "forward_fill", (0.0, 250.0), (0.0, 200.0), 70.0, False),
    FeatureSpec("resp_rate", "chart", (220210, 618), "last", "forward_fill", (0.0, 100.0), (0.0, 80.0), 16.0, False),
    FeatureSpec(
        "temperature", "chart",
        (223762, 676),
        "last", "forward_fill", (25.0, 45.0), (25.0, 42.0), 37.0, False,
    ),
    FeatureSpec("spo2", "chart", (220277, 646), "min", "forward_fill", (50.0, 100.0), (50.0, 100.0), 98.0, True),
    FeatureSpec(
        "gcs_total", "chart",
        (220739, 223900, 223901),
        "last", "forward_fill", (3.0, 15.0), (3.0, 15.0), 15.0, True,
    ),
    FeatureSpec("fio2_vent", "chart", (223835, 3420), "last", "forward_fill", (0.21, 1.0), (0.21, 1.0), 0.21, True),
    FeatureSpec("peep", "chart", (220339, 224700), "last", "forward_fill", (0.0, 40.0), (0.0, 35.0), 0.0, True),
    FeatureSpec("pao2", "lab", (50821,), "last", "forward_fill", (20.0, 600.0), (20.0, 550.0), 95.0, True),
    FeatureSpec("paco2", "lab", (50818,), "last", "forward_fill", (5.0, 200.0), (5.0, 150.0), 40.0, True),
    FeatureSpec("arterial_ph", "lab", (50820,), "last", "forward_fill", (6.5, 8.0), (6.8, 7.8), 7.4, True),
    FeatureSpec("bicarbonate", "lab", (50882, 50803), "last", "median_train", (0.0, 60.0), (2.0, 50.0), 24.0, True),
    FeatureSpec("base_excess", "lab", (50802,), "last", "median_train", (-30.0, 30.0), (-25.0, 25.0), 0.0, True),
    FeatureSpec("lactate", "lab", (50813,), "max", "forward_fill", (0.0, 30.0), (0.0, 20.0), 1.0, True),
    FeatureSpec("creatinine", "lab", (50912,), "last", "forward_fill", (0.0, 20.0), (0.0, 15.0), 0.9, True),
    FeatureSpec("bun", "lab", (51006,), "last", "forward_fill", (0.0, 300.0), (0.0, 200.0), 14.0, True),
    FeatureSpec("bilirubin_total", "lab", (50885,), "last", "median_train", (0.0, 50.0), (0.0, 40.0), 0.6, True),
    FeatureSpec("albumin", "lab", (50862,), "last", "median_train", (0.5, 6.0), (0.5, 5.5), 4.0, True),
    FeatureSpec("sodium", "lab", (50983, 50824), "last", "forward_fill", (100.0, 180.0), (110.0, 170.0), 140.0, True),
    FeatureSpec("potassium", "lab", (50971, 50822), "last", "forward_fill", (1.0, 10.0), (1.5, 9.0), 4.0, True),
    FeatureSpec(
        "glucose", "lab",
        (50931, 50809),
        "last", "forward_fill", (20.0, 1500.0), (20.0, 1000.0), 110.0, True,
    ),
    FeatureSpec("inr", "lab", (51237,), "last", "median_train", (0.5, 20.0), (0.5, 15.0), 1.0, True),
    FeatureSpec("ptt", "lab", (51275,), "last", "median_train", (10.0, 200.0), (10.0, 150.0), 30.0, True),
    FeatureSpec("wbc", "lab", (51301, 51300), "last", "forward_fill", (0.0, 500.0), (0.0, 400.0), 8.0, True),
    FeatureSpec("haemoglobin", "lab", (51222,), "last", "forward_fill", (0.0, 25.0), (1.0, 20.0), 12.0, True),
    FeatureSpec("haematocrit", "lab", (51221,), "last", "forward_fill", (0.0, 100.0), (5.0, 65.0), 38.0, False),
    FeatureSpec("platelets", "lab", (51265,), "last", "forward_fill", (0.0, 3000.0), (0.0, 2000.0), 200.0, True),
    FeatureSpec(
        "cum_iv_fluid_ml", "input",
        FLUID_ITEMS,
        "cumulative", "zero", (0.0, 50000.0), (0.0, 30000.0), 0.0, False, check_range=False,
    ),
    FeatureSpec(
        "cum_vasopressor_dose_nor_equiv", "input",
        (221906, 221289, 222315, 221662),
        "cumulative", "zero", (0.0, 1000.0), (0.0, 500.0), 0.0, False, check_range=False,
    ),
    FeatureSpec(
        "urine_output_4h", "output",
        (226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558),
        "sum", "zero", (0.0, 2000.0), (0.0, 1500.0), 0.0, True, check_range=False,
    ),
    FeatureSpec("age_years", "static", (), "last", "median_train", (18.0, 120.0), (18.0, 110.0), None, False),
    FeatureSpec("weight_kg", "static", (), "last", "median_train", (20.0, 400.0), (20.0, 300.0), None, False),
    FeatureSpec(
        "pf_ratio", "derived",
        (),
        "last", "median_train", (10.0, 700.0), (20.0, 600.0), 400.0, True, parents=("pao2", "fio2_vent"),
    ),
    FeatureSpec(
        "shock_index", "derived",
        (),
        "last", "forward_fill", (0.0, 10.0), (0.0, 5.0), 0.6, False, parents=("heart_rate", "sbp"),
    ),
    FeatureSpec("hours_since_onset", "grid", (), "last", "normal_value", (-24.0, 48.0), (-24.0, 48.0), 0.0, False),
)


def clinical_registry() -> Registry:
    return make_registry(FEATURES)
