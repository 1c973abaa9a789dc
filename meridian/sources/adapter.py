"""Clinical (OMOP-shaped) tables derived from the driver's star schema.

Each table is one query in SQL that Spark and DuckDB read alike, over base tables and tables defined
before it. Spark gets DataFrames from it, the DuckDB oracles a common WITH prefix.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .scratch import materialize

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

TABLES: dict[str, str] = {
    "person": """
        SELECT c_custkey AS person_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS BIGINT) AS gender_concept_id,
               CAST(1930 + c_custkey % 70 AS INT) AS year_of_birth, CAST(1000 + c_nationkey AS BIGINT) AS race_concept_id,
               CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2001 WHEN 'BUILDING' THEN 2002 WHEN 'FURNITURE' THEN 2003 WHEN 'HOUSEHOLD' THEN 2004 ELSE 2005 END AS BIGINT) AS ethnicity_concept_id,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS location_id,
               c_custkey % 120 AS provider_id, CAST(c_nationkey AS BIGINT) AS care_site_id FROM customer""",
    "observation_period": """
        SELECT person_id * 4 + k AS observation_period_id, person_id, CAST(s AS DATE) AS observation_period_start_date, CAST(e AS DATE) AS observation_period_end_date, 44814724 + k AS period_type_concept_id
        FROM (
          SELECT c_custkey AS person_id, CAST(0 AS BIGINT) AS k, DATE '1995-03-01' + CAST(c_custkey % 60 AS INT) AS s, DATE '1997-12-31' + CAST(c_custkey % 60 AS INT) AS e FROM customer
          UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), DATE '1998-07-01' + CAST(c_custkey % 60 AS INT), DATE '2001-06-30' + CAST(c_custkey % 60 AS INT) FROM customer WHERE c_custkey % 3 < 2
          UNION ALL SELECT DISTINCT user_id, CAST(2 AS BIGINT), DATE '2024-01-01', DATE '2024-01-31' FROM events) x""",
    "visit_occurrence": """
        SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, CAST(9200 AS BIGINT) + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS visit_concept_id,
               CAST(o_orderdate AS DATE) AS visit_start_date, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INT) - CASE WHEN o_orderkey % 101 = 0 THEN 20 ELSE 0 END END AS visit_end_date,
               CAST(32000 + o_orderkey % 3 AS BIGINT) AS visit_type_concept_id, o_custkey % 130 AS provider_id, o_orderkey % 27 AS care_site_id,
               CAST(o_orderkey % 5 AS BIGINT) AS visit_source_concept_id, CAST(o_orderkey % 4 AS BIGINT) AS discharge_to_concept_id, 'home ' || CAST(o_orderkey % 3 AS VARCHAR(9)) AS discharge_to_source_value FROM orders""",
    "visit_detail": """
        SELECT visit_occurrence_id * 10 AS visit_detail_id, person_id, visit_concept_id + 100 AS visit_detail_concept_id, visit_start_date AS visit_detail_start_date, visit_end_date AS visit_detail_end_date,
               visit_type_concept_id AS visit_detail_type_concept_id, provider_id, care_site_id, visit_occurrence_id, visit_source_concept_id AS visit_detail_source_concept_id
        FROM visit_occurrence WHERE visit_occurrence_id % 3 = 0""",
    "line": """
        SELECT l.*, o_custkey AS person_id, CAST(l_shipdate AS DATE) AS d,
               l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n
        FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey""",
    "condition_occurrence": """
        SELECT n AS condition_occurrence_id, person_id, 3000 + l_partkey % 50 AS condition_concept_id, d AS condition_start_date,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE d + CAST(l_suppkey % 9 AS INT) - CASE WHEN l_suppkey % 97 = 0 THEN 15 ELSE 0 END END AS condition_end_date,
               CAST(32800 + l_linenumber AS BIGINT) AS condition_type_concept_id, CAST(CASE WHEN l_linestatus = 'F' THEN 4230359 ELSE 4033240 END AS BIGINT) AS condition_status_concept_id,
               CASE WHEN l_linenumber = 3 THEN 'resolved' WHEN l_linenumber = 5 THEN 'ruled out' END AS stop_reason,
               l_suppkey % 125 AS provider_id, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey + CASE WHEN l_suppkey % 50 = 0 THEN 100000000 ELSE 0 END END AS visit_occurrence_id, 6000 + l_partkey % 20 AS condition_source_concept_id
        FROM line WHERE l_returnflag = 'R'""",
    "drug_exposure": """
        SELECT n AS drug_exposure_id, person_id, 4000 + l_partkey % 50 AS drug_concept_id, d AS drug_exposure_start_date,
               CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE d + CAST(l_quantity AS INT) - CASE WHEN l_suppkey % 89 = 0 THEN 60 ELSE 0 END END AS drug_exposure_end_date, CAST(32810 + l_linenumber AS BIGINT) AS drug_type_concept_id,
               CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS days_supply, CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE CAST(l_linenumber - 1 AS INT) END AS refills, CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_quantity END AS quantity, CAST(4112421 + l_linenumber AS BIGINT) AS route_concept_id, CASE WHEN l_linenumber = 4 THEN 'LOT4' END AS lot_number,
               l_suppkey % 125 AS provider_id, l_orderkey AS visit_occurrence_id, 7000 + l_partkey % 20 AS drug_source_concept_id
        FROM line WHERE l_returnflag = 'N'""",
    "procedure_occurrence": """
        SELECT n AS procedure_occurrence_id, person_id, 5000 + l_partkey % 40 AS procedure_concept_id, d AS procedure_date, CAST(32820 + l_linenumber AS BIGINT) AS procedure_type_concept_id,
               CAST(l_linenumber % 3 AS BIGINT) AS modifier_concept_id, CASE WHEN l_linenumber = 6 THEN NULL ELSE 'M' || CAST(l_linenumber AS VARCHAR(9)) END AS modifier_source_value, CAST(l_quantity AS INT) AS quantity, l_suppkey % 125 AS provider_id, l_orderkey AS visit_occurrence_id, 8000 + l_partkey % 20 AS procedure_source_concept_id
        FROM line WHERE l_returnflag = 'A'""",
    "device_exposure": """
        SELECT n AS device_exposure_id, person_id, 5500 + l_partkey % 15 AS device_concept_id, d AS device_exposure_start_date, d + CAST(l_suppkey % 30 AS INT) AS device_exposure_end_date, CAST(32830 + l_linenumber AS BIGINT) AS device_type_concept_id,
               CAST(l_quantity AS INT) AS quantity, l_suppkey % 125 AS provider_id, l_orderkey AS visit_occurrence_id, 8500 + l_partkey % 7 AS device_source_concept_id FROM line WHERE l_linenumber = 7""",
    "measurement": """
        SELECT event_id AS measurement_id, user_id AS person_id, CAST(CASE event_type WHEN 'view' THEN 9001 WHEN 'click' THEN 9002 ELSE 9003 END AS BIGINT) AS measurement_concept_id, event_type AS measurement_source_value, CAST(ts AS DATE) AS measurement_date,
               CAST(44818700 + event_id % 2 AS BIGINT) AS measurement_type_concept_id, CAST(4171754 + event_id % 4 AS BIGINT) AS operator_concept_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value_as_number,
               CASE WHEN event_id % 7 = 0 THEN CAST(4155142 + event_id % 3 AS BIGINT) END AS value_as_concept_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(8800 + event_id % 3 AS BIGINT) END AS unit_concept_id,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 4 * 5 AS DOUBLE) END AS range_low, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 4 * 5 + 40 AS DOUBLE) END AS range_high,
               event_id % 125 AS provider_id, event_id AS visit_occurrence_id, 9500 + event_id % 9 AS measurement_source_concept_id FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "observation": """
        SELECT event_id AS observation_id, user_id AS person_id, CAST(CASE event_type WHEN 'error' THEN 9101 ELSE 9102 END AS BIGINT) AS observation_concept_id, CAST(ts AS DATE) AS observation_date, CAST(38000276 + event_id % 3 AS BIGINT) AS observation_type_concept_id,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value_as_number, CASE WHEN event_id % 4 = 0 THEN 'text ' || CAST(event_id % 9 AS VARCHAR(9)) END AS value_as_string, CASE WHEN event_id % 6 = 0 THEN CAST(45877994 + event_id % 2 AS BIGINT) END AS value_as_concept_id,
               CAST(event_id % 3 AS BIGINT) AS qualifier_concept_id, 'Q' || CAST(event_id % 6 AS VARCHAR(9)) AS qualifier_source_value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(8800 + event_id % 3 AS BIGINT) END AS unit_concept_id, event_id % 125 AS provider_id, event_id AS visit_occurrence_id, 9600 + event_id % 9 AS observation_source_concept_id
        FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""",
    "death": """
        SELECT c_custkey AS person_id, DATE '1998-08-01' + CAST(c_custkey * 7 % 1500 AS INT) AS death_date, CAST(38003569 + c_custkey % 2 AS BIGINT) AS death_type_concept_id, CAST(3000 + c_custkey % 50 AS BIGINT) AS cause_concept_id, CAST(6000 + c_custkey % 20 AS BIGINT) AS cause_source_concept_id
        FROM customer WHERE c_acctbal < -500""",
    "condition_era": """
        SELECT person_id * 100000 + row_number() OVER (PARTITION BY person_id ORDER BY condition_concept_id, s) AS condition_era_id, person_id, condition_concept_id, s AS condition_era_start_date, e AS condition_era_end_date, c AS condition_occurrence_count FROM (
          SELECT person_id, condition_concept_id, g, min(s) AS s, max(e) AS e, CAST(count(*) AS INT) AS c FROM (
            SELECT person_id, condition_concept_id, s, e, sum(CASE WHEN p IS NULL OR s > p + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, condition_concept_id ORDER BY s, e, i) AS g FROM (
              SELECT person_id, condition_concept_id, s, e, i, max(e) OVER (PARTITION BY person_id, condition_concept_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (
                SELECT person_id, condition_concept_id, condition_occurrence_id AS i, condition_start_date AS s, coalesce(condition_end_date, condition_start_date + 1) AS e FROM condition_occurrence) a) b) c
          GROUP BY person_id, condition_concept_id, g) d""",
    "drug_era": """
        SELECT person_id * 100000 + row_number() OVER (PARTITION BY person_id ORDER BY drug_concept_id, s) AS drug_era_id, person_id, drug_concept_id, s AS drug_era_start_date, e AS drug_era_end_date, c AS drug_exposure_count, 0 AS gap_days FROM (
          SELECT person_id, drug_concept_id, g, min(s) AS s, max(e) AS e, CAST(count(*) AS INT) AS c FROM (
            SELECT person_id, drug_concept_id, s, e, sum(CASE WHEN p IS NULL OR s > p + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, drug_concept_id ORDER BY s, e, i) AS g FROM (
              SELECT person_id, drug_concept_id, s, e, i, max(e) OVER (PARTITION BY person_id, drug_concept_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (
                SELECT person_id, drug_concept_id, drug_exposure_id AS i, drug_exposure_start_date AS s, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) AS e FROM drug_exposure) a) b) c
          GROUP BY person_id, drug_concept_id, g) d""",
    "payer_plan_period": """
        SELECT c_custkey * 2 + k AS payer_plan_period_id, c_custkey AS person_id, s AS payer_plan_period_start_date, e AS payer_plan_period_end_date, CAST(c_custkey % 6 AS BIGINT) AS payer_source_concept_id, CAST(100 + c_custkey % 4 AS BIGINT) AS payer_concept_id FROM (
          SELECT c_custkey, CAST(0 AS BIGINT) AS k, DATE '1995-01-01' + CAST(c_custkey % 90 AS INT) AS s, DATE '1996-12-31' + CAST(c_custkey % 200 AS INT) AS e FROM customer
          UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), DATE '1998-01-01' + CAST(c_custkey % 30 AS INT), DATE '2000-06-30' - CASE WHEN c_custkey % 71 = 0 THEN 1000 ELSE 0 END FROM customer WHERE c_custkey % 2 = 0) x""",
    "cost": """
        SELECT n AS cost_id, n AS cost_event_id, CASE l_returnflag WHEN 'N' THEN 'Drug' WHEN 'A' THEN 'Procedure' ELSE 'Condition' END AS cost_domain_id, CAST(floor(l_extendedprice * CAST(0.1 AS DOUBLE)) AS DOUBLE) AS paid_patient_copay, CAST(floor(l_extendedprice * CAST(0.05 AS DOUBLE)) AS DOUBLE) AS paid_patient_coinsurance,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(floor(l_extendedprice * l_tax) AS DOUBLE) END AS paid_patient_deductible, CAST(floor(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS paid_by_payer, CAST(floor(l_extendedprice * CAST(0.8 AS DOUBLE)) AS DOUBLE) AS paid_by_primary, CAST(floor(l_extendedprice * l_discount) AS DOUBLE) AS paid_by_patient, l_extendedprice AS total_paid,
               CAST(floor(l_extendedprice * CAST(0.7 AS DOUBLE)) AS DOUBLE) AS paid_ingredient_cost, CAST(floor(l_extendedprice * CAST(0.02 AS DOUBLE)) AS DOUBLE) AS paid_dispensing_fee, CAST(floor(l_extendedprice * CAST(1.1 AS DOUBLE)) AS DOUBLE) AS total_cost, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(38000000 + l_linenumber AS BIGINT) END AS revenue_code_concept_id FROM line""",
    "provider": "SELECT s_suppkey AS provider_id, CAST(38004400 + s_nationkey AS BIGINT) AS specialty_concept_id, CAST(s_nationkey % 4 AS BIGINT) AS specialty_source_concept_id, CAST(s_nationkey AS BIGINT) AS care_site_id FROM supplier WHERE s_suppkey % 10 <> 9",
    "care_site": "SELECT CAST(n_nationkey AS BIGINT) AS care_site_id, CAST(n_nationkey AS BIGINT) AS location_id, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE CAST(8700 + n_regionkey AS BIGINT) END AS place_of_service_concept_id FROM nation WHERE n_nationkey <> 7",
    "location": "SELECT CAST(n_nationkey AS BIGINT) AS location_id, CAST(10000 + n_nationkey * 137 AS VARCHAR(9)) AS zip, CASE WHEN n_nationkey % 9 = 8 THEN NULL ELSE r_name END AS state, CAST(42000000 + n_regionkey AS BIGINT) AS region_concept_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3",
    "location_history": "SELECT c_custkey AS entity_id, 'PERSON' AS domain_id, CAST(c_nationkey AS BIGINT) AS location_id, DATE '1994-01-01' + CAST(c_custkey % 300 AS INT) AS start_date, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '1999-01-01' END AS end_date FROM customer UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'CARE_SITE', CAST(n_nationkey AS BIGINT), DATE '1990-01-01', CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE DATE '1999-06-30' END FROM nation",
    "specimen": "SELECT event_id AS specimen_id, user_id AS person_id, CAST(9700 + event_id % 4 AS BIGINT) AS specimen_concept_id, CAST(ts AS DATE) AS specimen_date, CAST(32850 + event_id % 2 AS BIGINT) AS specimen_type_concept_id, value AS quantity, CAST(8800 + event_id % 3 AS BIGINT) AS unit_concept_id FROM events WHERE event_id % 6 = 1",
    "note": "SELECT event_id AS note_id, user_id AS person_id, CAST(ts AS DATE) AS note_date, CAST(44814637 + event_id % 4 AS BIGINT) AS note_type_concept_id FROM events WHERE event_id % 10 = 3",
    "dose_era": "SELECT drug_era_id AS dose_era_id, person_id, drug_concept_id, CAST(8576 + drug_concept_id % 2 AS BIGINT) AS unit_concept_id, CAST(drug_exposure_count * 2.5 AS DOUBLE) AS dose_value, drug_era_start_date AS dose_era_start_date, drug_era_end_date AS dose_era_end_date FROM drug_era WHERE drug_exposure_count > 1",
    "episode": "SELECT condition_era_id AS episode_id, person_id, condition_concept_id AS episode_concept_id, condition_concept_id + 10 AS episode_object_concept_id, CAST(32545 AS BIGINT) AS episode_type_concept_id, condition_occurrence_count AS episode_number, condition_era_start_date AS episode_start_date, condition_era_end_date AS episode_end_date FROM condition_era WHERE condition_occurrence_count > 1",
    "concept": """
        SELECT CAST(concept_id AS BIGINT) AS concept_id, concept_name, domain_id, vocabulary_id, concept_class_id, standard_concept, concept_code, invalid_reason FROM (
          SELECT DISTINCT 3000 + p_partkey % 50 AS concept_id, 'Condition ' || CAST(p_partkey % 50 AS VARCHAR(9)) AS concept_name, 'Condition' AS domain_id, 'SNOMED' AS vocabulary_id, 'Clinical Finding' AS concept_class_id, CASE WHEN p_partkey % 50 < 45 THEN 'S' END AS standard_concept, 'C' || CAST(p_partkey % 50 AS VARCHAR(9)) AS concept_code, CASE WHEN p_partkey % 50 = 49 THEN 'D' END AS invalid_reason FROM part
          UNION ALL SELECT DISTINCT 4000 + p_partkey % 50, 'Drug ' || CAST(p_partkey % 50 AS VARCHAR(9)), 'Drug', 'RxNorm', 'Ingredient', 'S', 'D' || CAST(p_partkey % 50 AS VARCHAR(9)), NULL FROM part
          UNION ALL SELECT DISTINCT 5000 + p_partkey % 40, 'Procedure ' || CAST(p_partkey % 40 AS VARCHAR(9)), 'Procedure', 'CPT4', 'Procedure', 'S', 'P' || CAST(p_partkey % 40 AS VARCHAR(9)), NULL FROM part
          UNION ALL SELECT DISTINCT 3100 + p_partkey % 5, 'Condition group ' || CAST(p_partkey % 5 AS VARCHAR(9)), 'Condition', 'MedDRA', 'HLT', 'C', 'CG' || CAST(p_partkey % 5 AS VARCHAR(9)), NULL FROM part
          UNION ALL SELECT DISTINCT 4100 + p_partkey % 2, 'Drug class ' || CAST(p_partkey % 2 AS VARCHAR(9)), 'Drug', 'ATC', 'ATC 4th', 'C', 'DC' || CAST(p_partkey % 2 AS VARCHAR(9)), NULL FROM part
          UNION ALL SELECT 3200, 'All conditions', 'Condition', 'MedDRA', 'SOC', 'C', 'ALLC', NULL
          UNION ALL SELECT 4200, 'All drugs', 'Drug', 'ATC', 'ATC 1st', 'C', 'ALLD', NULL
          UNION ALL SELECT 8507, 'MALE', 'Gender', 'Gender', 'Gender', 'S', 'M', NULL UNION ALL SELECT 8532, 'FEMALE', 'Gender', 'Gender', 'Gender', 'S', 'F', NULL
          UNION ALL SELECT * FROM (VALUES (9001, 'Viewed', 'Measurement', 'LOINC', 'Lab Test', 'S', 'V1', NULL), (9002, 'Clicked', 'Measurement', 'LOINC', 'Lab Test', 'S', 'V2', NULL), (9003, 'Bought', 'Measurement', 'LOINC', 'Lab Test', 'S', 'V3', NULL), (9101, 'Error', 'Observation', 'LOINC', 'Survey', 'S', 'E1', NULL), (9102, 'Other', 'Observation', 'LOINC', 'Survey', 'S', 'E2', NULL)) m(c1, c2, c3, c4, c5, c6, c7, c8)
          UNION ALL SELECT * FROM (VALUES (9201, 'Inpatient Visit', 'Visit', 'Visit', 'Visit', 'S', 'IP', NULL), (9202, 'Outpatient Visit', 'Visit', 'Visit', 'Visit', 'S', 'OP', NULL), (9203, 'Emergency Room Visit', 'Visit', 'Visit', 'Visit', 'S', 'ER', NULL), (2001, 'Group 1', 'Ethnicity', 'Ethnicity', 'Ethnicity', 'S', 'G1', NULL), (1001, 'Race 1', 'Race', 'Race', 'Race', 'S', 'R1', NULL)) v(c1, c2, c3, c4, c5, c6, c7, c8)
          UNION ALL SELECT * FROM (VALUES (3250, 'Disorders', 'Condition', 'MedDRA', 'HLGT', 'C', 'DIS', NULL), (3260, 'Findings', 'Condition', 'MedDRA', 'Top', 'C', 'FIN', NULL), (4150, 'Drugs of a kind', 'Drug', 'ATC', 'ATC 2nd', 'C', 'DK', NULL), (9050, 'Lab tests', 'Measurement', 'LOINC', 'Group', 'C', 'LT', NULL), (9060, 'All tests', 'Measurement', 'LOINC', 'Group', 'C', 'AT', NULL), (9061, 'Any test', 'Measurement', 'LOINC', 'Group', 'C', 'NT', NULL), (9150, 'Surveys', 'Observation', 'LOINC', 'Group', 'C', 'SV', NULL)) g(c1, c2, c3, c4, c5, c6, c7, c8)
          UNION ALL SELECT * FROM (VALUES (4040390, 'Procedure', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R0', NULL), (4040391, 'Surgery', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R1', NULL), (4040392, 'Therapy', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R2', NULL), (4040393, 'Repair', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R3', NULL), (4040394, 'Training', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R4', NULL), (4040395, 'Repair of a joint', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R5', NULL), (4040396, 'Training of a joint', 'Procedure', 'SNOMED', 'Procedure', 'S', 'R6', NULL)) g(c1, c2, c3, c4, c5, c6, c7, c8)
          UNION ALL SELECT * FROM (VALUES (32801, 'Inpatient detail - primary', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T1', NULL), (32802, 'Inpatient header - 1st position', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T2', NULL), (32803, 'Inpatient header - 2nd position', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T3', NULL), (32804, 'Outpatient detail - primary', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T4', NULL), (32805, 'Outpatient header - 2nd position', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T5', NULL), (32806, 'Problem list', 'Type Concept', 'Condition Type', 'Condition Type', 'S', 'T6', NULL),
            (32821, 'Claim', 'Type Concept', 'Type Concept', 'Type Concept', 'S', 'T7', NULL), (32811, 'Dispensed', 'Type Concept', 'Type Concept', 'Type Concept', 'S', 'T8', NULL), (38000276, 'Reported', 'Type Concept', 'Type Concept', 'Type Concept', 'S', 'T9', NULL), (44818701, 'From a device', 'Type Concept', 'Type Concept', 'Type Concept', 'S', 'T10', NULL), (38003569, 'Register', 'Type Concept', 'Death Type', 'Death Type', 'S', 'T11', NULL),
            (8800, 'piece', 'Unit', 'UCUM', 'Unit', 'S', 'U0', NULL), (8801, 'gram', 'Unit', 'UCUM', 'Unit', 'S', 'U1', NULL), (4171754, '<=', 'Meas Value Operator', 'SNOMED', 'Qualifier Value', 'S', 'O1', NULL), (4171756, '<', 'Meas Value Operator', 'SNOMED', 'Qualifier Value', 'S', 'O2', NULL), (4155142, 'Small', 'Meas Value', 'SNOMED', 'Qualifier Value', 'S', 'V4', NULL), (45877994, 'Yes', 'Meas Value', 'LOINC', 'Answer', 'S', 'A1', NULL), (1, 'Mild', 'Observation', 'SNOMED', 'Qualifier Value', 'S', 'Q1', NULL)) g(c1, c2, c3, c4, c5, c6, c7, c8)
          UNION ALL SELECT DISTINCT 6000 + p_partkey % 20, 'Source condition ' || CAST(p_partkey % 20 AS VARCHAR(9)), 'Condition', 'ICD10CM', 'Code', NULL, 'I' || CAST(p_partkey % 20 AS VARCHAR(9)), NULL FROM part) c""",
    "concept_ancestor": """
        SELECT CAST(a AS BIGINT) AS ancestor_concept_id, CAST(d AS BIGINT) AS descendant_concept_id, CAST(lo AS INT) AS min_levels_of_separation, CAST(lo AS INT) AS max_levels_of_separation FROM (
          SELECT concept_id AS a, concept_id AS d, 0 AS lo FROM concept WHERE standard_concept IN ('S', 'C')
          UNION ALL SELECT 3100 + (concept_id - 3000) % 5, concept_id, 1 FROM concept WHERE concept_id >= 3000 AND concept_id < 3050
          UNION ALL SELECT 3200, concept_id, 2 FROM concept WHERE concept_id >= 3000 AND concept_id < 3050 UNION ALL SELECT 3200, concept_id, 1 FROM concept WHERE concept_id >= 3100 AND concept_id < 3105
          UNION ALL SELECT 4100 + (concept_id - 4000) % 2, concept_id, 1 FROM concept WHERE concept_id >= 4000 AND concept_id < 4050
          UNION ALL SELECT 4200, concept_id, 2 FROM concept WHERE concept_id >= 4000 AND concept_id < 4050 UNION ALL SELECT 4200, concept_id, 1 FROM concept WHERE concept_id >= 4100 AND concept_id < 4102
          UNION ALL SELECT 3250, concept_id, CASE WHEN concept_id = 3200 THEN 1 WHEN concept_id >= 3100 THEN 2 ELSE 3 END FROM concept WHERE concept_id >= 3000 AND concept_id <= 3200
          UNION ALL SELECT 3260, concept_id, CASE WHEN concept_id = 3250 THEN 1 WHEN concept_id = 3200 THEN 2 WHEN concept_id >= 3100 THEN 3 ELSE 4 END FROM concept WHERE concept_id >= 3000 AND concept_id <= 3250
          UNION ALL SELECT 4150, concept_id, CASE WHEN concept_id >= 4100 THEN 1 ELSE 2 END FROM concept WHERE concept_id >= 4000 AND concept_id <= 4101 UNION ALL SELECT 4200, 4150, 1 FROM concept WHERE concept_id = 4200
          UNION ALL SELECT 9050, concept_id, 1 FROM concept WHERE concept_id IN (9001, 9002) UNION ALL SELECT 9060, 9050, 1 FROM concept WHERE concept_id = 9050 UNION ALL SELECT 9061, 9050, 1 FROM concept WHERE concept_id = 9050 UNION ALL SELECT 9060, concept_id, 2 FROM concept WHERE concept_id IN (9001, 9002) UNION ALL SELECT 9061, concept_id, 2 FROM concept WHERE concept_id IN (9001, 9002) UNION ALL SELECT 9150, 9101, 1 FROM concept WHERE concept_id = 9150
          UNION ALL SELECT * FROM (VALUES (4040390, 4040391, 1), (4040390, 4040392, 1), (4040390, 4040393, 2), (4040390, 4040394, 2), (4040390, 4040395, 3), (4040390, 4040396, 3), (4040391, 4040393, 1), (4040392, 4040394, 1), (4040391, 4040395, 2), (4040392, 4040396, 2), (4040393, 4040395, 1), (4040394, 4040396, 1)) v(x1, x2, x3)
          UNION ALL SELECT 4040395 + concept_id % 3, concept_id, 1 FROM concept WHERE concept_id >= 5000 AND concept_id < 5040 AND concept_id % 3 < 2 UNION ALL SELECT 4040393 + concept_id % 3, concept_id, 2 FROM concept WHERE concept_id >= 5000 AND concept_id < 5040 AND concept_id % 3 < 2
          UNION ALL SELECT 4040391 + concept_id % 3, concept_id, 3 FROM concept WHERE concept_id >= 5000 AND concept_id < 5040 AND concept_id % 3 < 2 UNION ALL SELECT 4040390, concept_id, 4 FROM concept WHERE concept_id >= 5000 AND concept_id < 5040 AND concept_id % 3 < 2) x""",
    "concept_relationship": """
        SELECT CAST(a AS BIGINT) AS concept_id_1, CAST(b AS BIGINT) AS concept_id_2, r AS relationship_id, i AS invalid_reason FROM (
          SELECT concept_id AS a, 3000 + (concept_id - 6000) AS b, 'Maps to' AS r, CASE WHEN concept_id = 6019 THEN 'D' END AS i FROM concept WHERE concept_id >= 6000 AND concept_id < 6020
          UNION ALL SELECT 3000 + (concept_id - 6000), concept_id, 'Mapped from', NULL FROM concept WHERE concept_id >= 6000 AND concept_id < 6020) x""",
    "vocabulary": "SELECT vocabulary_id, vocabulary_id || ' names' AS vocabulary_name, 'set ' || lower(vocabulary_id) AS vocabulary_reference, 'v' || CAST(length(vocabulary_id) AS VARCHAR(9)) AS vocabulary_version, CAST(44819000 + length(vocabulary_id) AS BIGINT) AS vocabulary_concept_id FROM (SELECT DISTINCT vocabulary_id FROM concept UNION ALL SELECT 'None') v",
    "domain": "SELECT DISTINCT domain_id, domain_id || ' domain' AS domain_name, CAST(length(domain_id) AS BIGINT) AS domain_concept_id FROM concept",
    "relationship": "SELECT DISTINCT relationship_id, relationship_id || ' (name)' AS relationship_name FROM concept_relationship",
    "concept_synonym": "SELECT concept_id, concept_name || ' synonym' AS concept_synonym_name FROM concept WHERE concept_id % 3 = 0",
    "source_to_concept_map": "SELECT 'X' || concept_code AS source_code, concept_id AS target_concept_id, 'LOCAL' AS source_vocabulary_id, CAST(NULL AS VARCHAR(1)) AS invalid_reason FROM concept WHERE concept_id >= 4000 AND concept_id < 4010",
    "concept_recommended": "SELECT concept_id AS concept_id_1, concept_id + 1 AS concept_id_2, 'Lexical' AS relationship_id FROM concept WHERE concept_id >= 3000 AND concept_id < 3040",
}

_NAME = {t: re.compile(rf"\b(FROM|JOIN)\s+{t}\b") for t in (*BASE, *TABLES)}


def needs(sql: str) -> list[str]:
    """The derived tables that a query reads, directly or not, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for t in TABLES:
            if t not in found and _NAME[t].search(text):
                found.add(t)
                todo.append(TABLES[t])
    return [t for t in TABLES if t in found]


def with_prefix(sql: str) -> str:
    """A DuckDB query over the derived tables, complete in itself."""
    parts = [f"{t} AS MATERIALIZED ({TABLES[t]})" for t in needs(sql)]
    if not parts:
        return sql
    body = sql.lstrip()
    joint = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return "WITH " + ", ".join(parts) + joint


#: Clinical tables already written in this application, by directory.
_WRITTEN: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Cdm:
    """The clinical tables of one directory as DataFrames.

    A derived table is written to the shared folder when first asked for and then read by every query
    of the application, as a clinical database would lie there in the first place.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made = _WRITTEN.setdefault((spark.sparkContext.applicationId, sf_dir), {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                self._made[name] = materialize(self.sql(TABLES[name]))
        return self._made[name]

    def load(self, names: list[str] | None = None, threads: int = 6) -> None:
        """Writes derived tables that are not there yet; those that don't read each other at the same time."""
        todo = [t for t in TABLES if names is None or t in names]
        while todo:
            ready = [t for t in todo if not any(o in todo for o in needs(TABLES[t]))]
            with ThreadPoolExecutor(threads) as pool:
                list(pool.map(self.__getitem__, ready))
            todo = [t for t in todo if t not in ready]

    def derived(self, name: str, make) -> DataFrame:
        """A further table under a name of its own, written like the others when first asked for."""
        if name not in self._made:
            self._made[name] = materialize(make())
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A query over base and derived tables."""
        used = [t for t in (*BASE, *TABLES) if _NAME[t].search(text)]
        for t in used:
            text = _NAME[t].sub(rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self[t] for t in used})
