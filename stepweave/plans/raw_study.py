"""The staged pipeline over raw text tables made from the bundled ones.

``events`` plays the clinical warehouse: a user is a stay, and every event type
becomes the rows of an item. All tables are written as gzip CSV and read back by
the readers, so the whole path from text to the replay table runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import anchor, features
from stepweave.plans import pipeline
from stepweave.presets import clinical
from stepweave.session import configure, cut_lineage, scratch_path
from stepweave.sources import readers, writers

# Items of the preset that the event types stand for
PRESSURE, OXYGEN, COMA, LACTATE, DRUG, FLUID, URINE = 220052, 220277, 223901, 50813, 221906, 220949, 226559
OBSERVED = (
    "map", "spo2", "gcs_total", "lactate", "cum_iv_fluid_ml", "cum_vasopressor_dose_nor_equiv", "urine_output_4h",
    "age_years", "weight_kg", "hours_since_onset",
)
WHO = ("subject_id", "hadm_id", "stay_id")


def stamp(time: str | Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


class RawStudy:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir
        self.root = scratch_path(spark, "raw")
        self.config = pipeline.PipelineConfig(
            onset=anchor.OnsetConfig(lookback_hours=72, lookahead_hours=120),
            registry=features.select_features(clinical.clinical_registry(), OBSERVED),
        )

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Some users are readmissions of the user before them."""
        user = F.col("user_id")
        return self.table("events").select(
            "event_id", F.col("ts").alias("at"), F.col("value").alias("v"), "event_type",
            F.get_json_object("props", "$.k").alias("k"), user.alias("stay_id"), (user + 1000).alias("hadm_id"),
            F.when(user % 6 == 1, user - 1).otherwise(user).alias("subject_id"),
        )

    def of_type(self, kind: str) -> DataFrame:
        return self.events.where(F.col("event_type") == kind)

    # --- the raw tables

    def stays(self) -> DataFrame:
        """A third of the stays ends after five days."""
        spans = self.events.groupBy(*WHO).agg(F.min("at").alias("first"), F.max("at").alias("last"))
        short = F.least("last", F.col("first") + F.make_dt_interval(F.lit(5)))
        spans = spans.withColumn("last", F.when(F.col("stay_id") % 3 == 2, short).otherwise(F.col("last")))
        seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "first"), F.date_trunc("second", "last"))
        return spans.select(
            *WHO, stamp("first").alias("intime"), stamp("last").alias("outtime"), (seconds / 86400).alias("los")
        )

    def patients(self) -> DataFrame:
        age = (18 + F.floor(F.abs("c_acctbal") / 150)).cast("string")
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"),
            F.when(F.col("c_custkey") % 9 == 4, F.lit("n/a")).otherwise(age).alias("anchor_age"),
        )

    def admissions(self) -> DataFrame:
        """A quarter of the stays ends with a death, some of them early; some death times cannot be read."""
        fatal = self.events.where("stay_id % 4 = 0").groupBy("hadm_id", "stay_id").agg(F.min("at").alias("first"))
        after = F.make_dt_interval(F.lit(4) + F.col("stay_id") % 5)
        died = fatal.select("hadm_id", (F.col("first") + after).alias("died"))
        return (
            self.events.select("subject_id", "hadm_id").distinct().join(died, "hadm_id", "left")
            .select(
                "subject_id", "hadm_id",
                F.when(F.col("hadm_id") % 5 == 0, F.lit("unknown")).otherwise(stamp("died")).alias("deathtime"),
                F.col("died").isNotNull().cast("int").alias("hospital_expire_flag"),
            )
        )

    def cultures(self) -> DataFrame:
        return self.of_type("purchase").select(
            "subject_id", "hadm_id", F.date_format("at", "yyyy-MM-dd").alias("chartdate"),
            F.when(F.col("event_id") % 2 == 0, stamp("at")).alias("charttime"), F.lit("BLOOD").alias("spec_type_desc"),
        )

    def prescriptions(self) -> DataFrame:
        drug = F.when(F.col("event_id") % 3 == 0, F.lit("Aspirin")).otherwise(F.lit("vancomycin, iv"))
        return self.of_type("signup").select(
            "subject_id", "hadm_id", stamp("at").alias("starttime"), stamp("at").alias("stoptime"), drug.alias("drug"),
            F.lit("IV").alias("route"),
        )

    def chartevents(self) -> DataFrame:
        """Charted once a day, so many events share a time; some pressures cannot be read."""
        kind = F.col("event_type")
        item = F.when(kind == "view", PRESSURE).when(kind == "click", OXYGEN).otherwise(COMA)
        unreadable = (kind == "view") & (F.col("event_id") % 13 == 0)
        value = F.when(kind == "error", 3 + F.col("event_id") % 13).otherwise(F.col("v")).cast("string")
        return self.events.where(kind.isin("view", "click", "error")).select(
            *WHO, F.date_format("at", "yyyy-MM-dd 00:00:00").alias("charttime"), item.alias("itemid"),
            F.when(unreadable, F.lit("n/a")).otherwise(value).alias("valuenum"),
        )

    def labevents(self) -> DataFrame:
        return self.of_type("error").select(
            "hadm_id", stamp("at").alias("charttime"), F.lit(LACTATE).alias("itemid"), (F.col("v") / 10).alias("valuenum")
        )

    def inputevents(self) -> DataFrame:
        """Purchases are infusions of a drug, clicks are fluids without an end."""
        drip = F.col("event_type") == "purchase"
        end = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("v") * 900))
        return self.events.where(F.col("event_type").isin("purchase", "click")).select(
            "stay_id", stamp("at").alias("starttime"), F.when(drip, stamp(end)).alias("endtime"),
            F.when(drip, DRUG).otherwise(FLUID).alias("itemid"),
            F.when(drip, F.col("v")).otherwise(F.col("v") * 10).alias("amount"),
            F.when(drip, F.col("k").cast("double") / 100).alias("rate"),
            F.when(drip, F.col("k")).alias("patientweight"),
        )

    def outputevents(self) -> DataFrame:
        return self.of_type("signup").select(
            "stay_id", stamp("at").alias("charttime"), F.lit(URINE).alias("itemid"), (F.col("v") * 5).alias("value")
        )

    # --- the pipeline

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        """All tables, written as text, read back by their readers and landed."""
        names = (
            "stays", "patients", "admissions", "cultures", "prescriptions", "chartevents", "labevents", "inputevents",
            "outputevents",
        )
        paths = {}
        for name in names:
            rows = getattr(self, name)()
            paths[name] = f"{self.root}/text/{name}"
            writers.write_text(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)), paths[name])
        own = {
            "stays": readers.read_stays(self.spark, paths["stays"]),
            "cultures": readers.read_cultures(self.spark, paths["cultures"]),
            "prescriptions": readers.read_orders_matching(
                self.spark, paths["prescriptions"], clinical.ANTIBIOTIC_KEYWORDS
            ),
        }
        return {n: self.landed(n, own[n] if n in own else readers.raw_table(self.spark, paths[n], n)) for n in names}

    def landed(self, name: str, rows: DataFrame) -> DataFrame:
        """A table parsed once, as stages read most tables several times; events are sorted by item."""
        if "itemid" not in rows.columns:
            return cut_lineage(rows)
        path = f"{self.root}/landed/{name}"
        writers.land_events(rows, path, key="hadm_id" if name == "labevents" else "stay_id")
        return readers.raw_table(self.spark, path, name, "parquet")

    @cached_property
    def paths(self) -> dict[str, str]:
        return pipeline.run(self.spark, self.raw, f"{self.root}/out", self.config)

    def stage(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    @property
    def columns(self) -> list[str]:
        return features.feature_columns(self.config.registry)
