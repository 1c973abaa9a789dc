"""Clinical tables on disk: conforming load of whatever columns are there, and a sorted, year-partitioned export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_dir

#: Standard columns of tables that files may lack, with their types; more tables can be added by the caller.
COLUMNS: dict[str, dict[str, str]] = {
    "visit_occurrence": {"visit_occurrence_id": "bigint", "person_id": "bigint", "visit_concept_id": "bigint", "visit_start_date": "date", "visit_end_date": "date", "visit_type_concept_id": "bigint", "provider_id": "bigint", "care_site_id": "bigint", "visit_source_concept_id": "bigint", "admitting_source_concept_id": "bigint", "discharge_to_concept_id": "bigint"},
    "condition_occurrence": {"condition_occurrence_id": "bigint", "person_id": "bigint", "condition_concept_id": "bigint", "condition_start_date": "date", "condition_end_date": "date", "condition_type_concept_id": "bigint", "stop_reason": "string", "provider_id": "bigint", "visit_occurrence_id": "bigint"},
    "measurement": {"measurement_id": "bigint", "person_id": "bigint", "measurement_concept_id": "bigint", "measurement_date": "date", "value_as_number": "double", "unit_concept_id": "bigint", "range_low": "double", "range_high": "double"},
}

#: The date that a table is partitioned by, and the columns it is sorted by inside a year.
LAYOUT = {
    "visit_occurrence": ("visit_start_date", ["visit_concept_id", "person_id"]),
    "condition_occurrence": ("condition_start_date", ["condition_concept_id", "person_id"]),
    "drug_exposure": ("drug_exposure_start_date", ["drug_concept_id", "person_id"]),
    "procedure_occurrence": ("procedure_date", ["procedure_concept_id", "person_id"]),
    "measurement": ("measurement_date", ["measurement_concept_id", "person_id"]),
    "observation": ("observation_date", ["observation_concept_id", "person_id"]),
}


def conform(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The standard columns, matched without regard to case, missing ones as typed nulls; and the names left out."""
    have = {c.lower(): c for c in rows.columns}
    kept = [(F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns.items()]
    return rows.select(*kept), [c for low, c in have.items() if low not in columns]


def load(spark: SparkSession, path: str, table: str, columns: dict[str, str] | None = None) -> DataFrame:
    """All Parquet files below a folder as one conforming table; an empty table where there are none."""
    columns = columns or COLUMNS[table]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in columns.items()))
    return conform(spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path), columns)[0]


def export(rows: DataFrame, table: str, path: str | None = None) -> str:
    """Writes a table by year of its date, sorted by concept and person so that row groups can be skipped."""
    path = path or f"{scratch_dir(rows.sparkSession)}/export-{table}-{uuid.uuid4().hex}"
    date, keys = LAYOUT[table]
    by_year = rows.withColumn("__year", F.coalesce(F.year(date).cast("string"), F.lit("__null__")))
    # a year's rows are spread by person, so that no year is one task
    spread = by_year.repartition(F.col("__year"), F.pmod(F.xxhash64("person_id"), F.lit(8))).sortWithinPartitions("__year", *keys)
    spread.write.partitionBy("__year").option("compression", "zstd").parquet(path)
    return path


#: What cohort generation leaves behind, and the columns that its tables are partitioned by.
RESULT_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "cohort": ("cohort_definition_id int, subject_id long, cohort_start_date date, cohort_end_date date", ("cohort_definition_id",)),
    "cohort_inclusion": ("cohort_definition_id int, rule_sequence int, name string, description string", ("cohort_definition_id",)),
    "cohort_inclusion_result": ("cohort_definition_id int, mode_id int, inclusion_rule_mask long, person_count long", ("cohort_definition_id", "mode_id")),
    "cohort_inclusion_stats": ("cohort_definition_id int, mode_id int, rule_sequence int, person_count long, gain_count long, person_total long", ("cohort_definition_id", "mode_id")),
    "cohort_summary_stats": ("cohort_definition_id int, mode_id int, base_count long, final_count long", ("cohort_definition_id", "mode_id")),
    "cohort_censor_stats": ("cohort_definition_id int, lost_count long", ("cohort_definition_id",)),
}


def init_results(spark: SparkSession, path: str) -> list[str]:
    """Makes the folders of result tables that are not there yet; the names of those made. Tables that are there stay as they are."""
    made = []
    for table in RESULT_TABLES:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            files.mkdirs(where)
            made.append(table)
    return made


def read_results(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A result table with its columns, empty where nothing was written."""
    return spark.read.schema(RESULT_TABLES[table][0]).parquet(f"{path}/{table}")


def upsert(rows: DataFrame, path: str, table: str, **keys: int) -> None:
    """Replaces the rows of one cohort (and mode) in a result table: one partition, so other cohorts are not read or written."""
    schema, partition = RESULT_TABLES[table]
    if tuple(keys) != partition:
        raise ValueError(f"{table} is partitioned by {', '.join(partition)}")
    columns = [x.split() for x in schema.split(", ")]
    inside = [F.col(n).cast(t).alias(n) for n, t in columns if n not in keys]
    rows.select(*inside).write.mode("overwrite").parquet("/".join([path, table, *[f"{k}={v}" for k, v in keys.items()]]))


def upsert_cohort(rows: DataFrame, path: str, cohort_id: int) -> None:
    """Replaces one cohort's rows in a store partitioned by cohort_definition_id; an empty cohort leaves an empty partition."""
    rows.drop("cohort_definition_id").write.mode("overwrite").parquet(f"{path}/cohort_definition_id={cohort_id}")
