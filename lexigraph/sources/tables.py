"""Taxonomy tables on shared storage: load, seed, publish, snapshot and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.schemas import SCHEMAS

Tables = dict[str, DataFrame]


def load_taxonomy(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> Tables:
    """The tables with their fixed schemas."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in names}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of the stored table; missing columns become NULL, a column that it does not know is an error."""
    unknown = set(df.columns) - set(SCHEMAS[name].names)
    if unknown:
        raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCHEMAS[name].fields])


def seed(locales: DataFrame, skills: DataFrame, new_locales: DataFrame, new_roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the locales and root concepts that are not there yet; a second run adds nothing."""
    more = new_locales.join(locales.select("locale"), "locale", "left_anti")
    roots = new_roots.join(skills.select("slug"), "slug", "left_anti")
    return (locales.unionByName(more, allowMissingColumns=True), skills.unionByName(roots, allowMissingColumns=True))


def seed_roots(spark: SparkSession) -> DataFrame:
    """The six root concepts of the first load, one per category."""
    rows = spark.createDataFrame(list(config.SEED_ROOTS), "canonical_name string, slug string, category string")
    return rows.select(F.concat(F.lit("R:"), "slug").alias("id"), "canonical_name", "slug", F.col("slug").alias("path"), "category",
                       F.lit("active").alias("status"), F.lit("curator").alias("source"), F.lit(1).alias("version"))


def seed_locales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, True) for a, b in config.SEED_LOCALES],
                                 "locale string, display_name string, is_active boolean")


def counts(tables: Tables) -> DataFrame:
    """One row per table with its number of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot(tables: Tables, path: str, version: int, day: str) -> str:
    """All tables in one version folder; the manifest is written last and makes the snapshot valid."""
    folder = f"{path}/v{version}-{day}"
    for name, df in tables.items():
        conform(df, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    stored = load_taxonomy(next(iter(tables.values())).sparkSession, folder, tuple(tables))
    manifest = counts(stored).withColumns({"version": F.lit(version), "day": F.lit(day)})
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return folder


publish = snapshot


def restore(spark: SparkSession, folder: str) -> Tables:
    """The tables of a snapshot, if their sizes are those of its manifest."""
    manifest = spark.read.schema("table string, rows bigint, version int, day string").json(f"{folder}/manifest")
    names = tuple(r["table"] for r in manifest.select("table").limit(len(SCHEMAS)).collect())
    tables = load_taxonomy(spark, folder, names)
    if not counts(tables).exceptAll(manifest.select("table", "rows")).isEmpty():
        raise ValueError(f"{folder} does not match its manifest")
    return tables


def round_trip(a: Tables, b: Tables) -> DataFrame:
    """Rows found in only one of two versions of each table, both ways (map columns compared as sorted entries)."""
    out = None
    for name in a:
        def plain(df: DataFrame) -> DataFrame:
            maps = [f.name for f in SCHEMAS[name].fields if f.dataType.typeName() == "map"]
            return conform(df, name).withColumns({m: F.array_sort(F.map_entries(m)) for m in maps})

        # Copies of each row counted in one pass: more on the left count up, more on the right count down.
        x, y = plain(a[name]).withColumn("__n", F.lit(1)), plain(b[name]).withColumn("__n", F.lit(-1))
        more = x.unionByName(y).groupBy(*[c for c in x.columns if c != "__n"]).agg(F.sum("__n").alias("__n"))
        sums = more.agg(*[F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias(side)
                          for side, n in (("left", F.col("__n")), ("right", -F.col("__n")))])
        one = sums.select(F.lit(name).alias("table"), F.expr("stack(2, 'left', left, 'right', right) as (side, rows)"))
        out = one if out is None else out.unionByName(one)
    return out


def read_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Documents {id, text, metadata, source_type}."""
    schema = "id string, text string, metadata map<string,string>, source_type string"
    return spark.read.schema(schema).format(fmt).load(path)


def read_golden(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Golden documents, one row per expected concept."""
    schema = "id string, text string, expected_skills array<string>, source string"
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return rows.select("id", "text", "source", F.explode("expected_skills").alias("skill_id"))
