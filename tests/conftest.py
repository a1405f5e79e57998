import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def edge_rows(pairs, kind="parent_of"):
    return [(f"{kind}|{a}|{b}", a, b, kind, 1.0, "active", "human_curated", 1.0) for a, b in pairs]


EDGE = ("id string, source_skill_id string, target_skill_id string, relationship_type string, confidence double, "
        "status string, provenance string, weight double")
SKILL = "id string, canonical_name string, status string, category string, slug string"


@pytest.fixture
def make_edges(spark):
    return lambda pairs, kind="parent_of": spark.createDataFrame(edge_rows(pairs, kind), EDGE)


@pytest.fixture
def make_skills(spark):
    def make(names, status="active"):
        return spark.createDataFrame([(n, n, status, "tool", n.lower()) for n in names], SKILL)
    return make


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())
