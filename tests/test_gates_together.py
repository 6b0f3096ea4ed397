"""All gates from one table of codes give what the gates one by one give."""

import random

from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.operators import gates

SCHEMA = "id int, ein string, establishment_name string, company_name string, naics_code string, annual_average_employees string, total_hours_worked string, total_injuries string"
CODES = ["238220", "23822", "2382", "238", "23", "999999", "112000", "112", "11", "541511", "541512", "5415", "31", "311000", "3110", "621111"]


def one_by_one(records, codes, rates):
    df = gates.rarity_gate(gates.entity_gate(gates.name_gate(gates.code_gates(records, codes))))
    return gates.priority(gates.rate_gates(gates.size_gate(df), rates))


def test_same_as_one_by_one(spark):
    rnd = random.Random(9)
    pool = [*CODES, *(c + "0" for c in CODES if len(c) < 6), "12A", "", None, "2382201", " 23", "230000", "0", "700000"]
    rows = []
    for i in range(1500):
        size = rnd.choice(["3", "5", "7", "8", "9", "10", "12", "400", "60000", "n/a", "", None, "0005"])
        rows.append((i, rnd.choice(["1", "2", " ", None, str(rnd.randint(3, 400))]), rnd.choice(["Acme Plumbing", "City Clinic", "", None, "Grand Hotel"]), rnd.choice(["Bolt", None]), rnd.choice(pool), size, rnd.choice(["0", "", None, "2000", "900000"]), rnd.choice(["0", "1", "-1", "9", "x", None])))
    records = spark.createDataFrame(rows, SCHEMA).repartition(3)
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    rates = spark.createDataFrame([("238", 3.0), ("23822", 1.5), ("11", 9.0), ("541511", 0.0), ("31", 2.0), ("3110", 2.5), ("999", 1.0), ("70", 4.0), ("0", 2.0)], "prefix string, value double")
    columns = ["id", *fixed.FLAGS, "n_flags", "priority_tier", "trir", "bls_benchmark", "bls_matched_naics"]
    got, want = (sorted((tuple(r) for r in f(records, codes, rates).select(*columns).collect()), key=str) for f in (gates.all_gates, one_by_one))
    assert got == want and len({r[1:9] for r in got}) > 20
    assert gates.all_gates(records, codes, rates).columns[: len(records.columns)] == records.columns


def test_records_meet_codes_once(spark):
    records = spark.createDataFrame([], SCHEMA)
    facts = gates.code_facts(records, spark.createDataFrame([], "code string"), spark.createDataFrame([], "prefix string, value double"))
    assert facts.count() == 0 and len(facts.columns) == len(set(facts.columns))
    df = gates.all_gates(records.withColumn("v", F.lit(1)), spark.createDataFrame([], "code string"), spark.createDataFrame([], "prefix string, value double"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5
