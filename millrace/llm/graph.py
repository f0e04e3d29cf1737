"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the least id that it is connected to.

    Each round, an id takes the least label among its neighbours, and then the label of its label. Labels live in tables in the
    shared folder, so a round starts from files and not from a growing plan.
    """
    edges = table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = table(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        step = labels.join(heard.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = table(step.join(jump, "comp").select("id", "was", F.least("comp", "far").alias("comp")), "cc-labels")
        labels = new.select("id", "comp")
        if not new.where("was <> comp").limit(1).count():
            return labels
