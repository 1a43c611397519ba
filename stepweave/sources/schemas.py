"""Explicit schemas of raw tables and stored artifacts.

Raw CSV columns that need lenient parsing are read as text and cast with
``try_cast`` in the readers.
"""

from __future__ import annotations

# Column names of the external tables and of stored artifacts, here and below.
# Raw text columns per table
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "stays": (
        "subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit", "intime", "outtime", "los",
    ),
    "patients": ("subject_id", "gender", "anchor_age"),
    "admissions": ("subject_id", "hadm_id", "deathtime", "hospital_expire_flag"),
    "cultures": ("subject_id", "hadm_id", "chartdate", "charttime", "spec_type_desc"),
    "prescriptions": ("subject_id", "hadm_id", "starttime", "stoptime", "drug", "route"),
    "chartevents": ("subject_id", "hadm_id", "stay_id", "charttime", "itemid", "valuenum"),
    "labevents": ("hadm_id", "charttime", "itemid", "valuenum"),
    "inputevents": ("stay_id", "starttime", "endtime", "itemid", "amount", "rate", "patientweight"),
    "outputevents": ("stay_id", "charttime", "itemid", "value"),
}

# Type of each raw column after the lenient cast
RAW_TYPES: dict[str, str] = {
    "subject_id": "long", "hadm_id": "long", "stay_id": "long", "itemid": "long",
    "anchor_age": "int", "hospital_expire_flag": "int",
    "los": "double", "valuenum": "double", "value": "double", "amount": "double", "rate": "double",
    "patientweight": "double",
    "intime": "timestamp", "outtime": "timestamp", "deathtime": "timestamp", "charttime": "timestamp",
    "chartdate": "date", "starttime": "timestamp", "endtime": "timestamp", "stoptime": "timestamp",
}

METRIC_LOG = "step long, epoch long, name string, value double, timestamp double"

# A stored manifest, partitioned by split
MANIFEST = "key long, stay_id long, n_episodes long, split string"
