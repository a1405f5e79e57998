"""What the operators of this folder share: reading, held-out rows, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.plans.scale import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that nothing may be learnt from (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has (Spark does not tell capitals apart)."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


#: Labels that are sent to all tasks at most (a few MB), and rows of a link table a partition holds.
FEW, ROWS = 100_000, 100_000


def _packed(df: DataFrame) -> tuple[DataFrame, int]:
    """A stored table in as few partitions as its rows ask for, and how many rows it has."""
    df = cut(df)
    n = df.count()
    return df.coalesce(max(1, -(-n // ROWS))), n


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in ``links``: the smallest id that can be reached.

    Each round every id takes the smallest label among its neighbours, then labels are followed twice as far (pointer
    jumping), so that the number of rounds follows the logarithm of a component's width. A neighbour's label is a
    minimum, taken before the shuffle as well, so that one id with very many links is no hot key. Small label tables (of
    a checked size) are sent to the tasks; the result is the same.
    """
    both, _ = _packed(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                      .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct())
    labels, n = _packed(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    sent = F.broadcast if n <= FEW else (lambda df: df)
    while True:
        near = (both.join(sent(labels.withColumnRenamed("id", "v")), "v")
                .groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near")))
        # The label of the old label's holder also learns of a smaller one.
        hooked = (labels.join(sent(near), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new")))
        roots = hooked.groupBy(F.col("old").alias("root")).agg(F.min("new").alias("best"))
        step, _ = _packed(hooked.join(sent(roots), F.col("new") == F.col("root"), "left")
                          .select("id", "old", F.least("new", F.coalesce("best", "new")).alias("component")))
        changed = step.filter("component < old").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels
