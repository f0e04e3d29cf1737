"""Record transforms of the task domain, as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut
from .trees import numbered


#: Rules that are held against every subject.
MOST_RULES = 10_000


def signed_rollup(events: DataFrame, group: str, event_id: str, ts: str, amount: Column, since: Column, until: Column) -> DataFrame:
    """Count and exact two-digit sum of `amount` by group in [since, until), each event id once.

    Identical rows of one id count once; rows of one id that differ in group, time or amount fail the job, in the window or not.
    """
    record = F.struct(F.col(group).alias("g"), F.col(ts).alias("t"), amount.cast("decimal(38,2)").alias("a"))
    held = events.groupBy(event_id).agg(F.min(record).alias("r"), F.max(record).alias("other"))
    once = held.select(F.when(F.col("r").eqNullSafe(F.col("other")), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("rows in conflict: "), F.col(event_id).cast("string")))).alias("r")).select("r.*")
    inside = once.where((F.col("t") >= since) & (F.col("t") < until))
    return inside.groupBy(F.col("g").alias(group)).agg(F.count(F.lit(1)).alias("n"), F.sum("a").cast("decimal(38,2)").alias("balance"))


def pick(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__n = 1").drop("__n")


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, of a table in which they are there once; a repeated key fails the job."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    told = F.raise_error(F.concat(F.lit("there more than once: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return counted.where((F.col("__n") == 1) | told.cast("boolean")).select(*keys)


def latest_versions(df: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """The row of the highest version of each key, and `place`: the row's place, from 0, among the keys in the order in which they first
    appear (`order`, which tells rows apart). The same version of a key twice fails the job.

    Places are counted over all keys without one task for all (`trees.numbered`).
    """
    once = _once(df, [key, version]).groupBy(key).agg(F.max(version).alias(version))
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    placed = numbered(first.select(key, *(F.col(f"__first.{c}").alias(f"__{i}") for i, c in enumerate(order))), [f"__{i}" for i in range(len(order))], "place")
    return df.join(once, [key, version], "left_semi").join(placed.select(key, "place"), key)


def counts_by_status(df: DataFrame, key: str, status: str) -> DataFrame:
    """(status, n) over rows whose keys are there once: a repeated key fails the job, null keys do not count as one."""
    named = df.where(F.col(key).isNotNull())
    kept = named.join(_once(named, [key]), key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    return kept.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def allocation(demand: DataFrame, request: str, item: str, wanted: str, stock: DataFrame, item_key: str, held: str) -> DataFrame:
    """All or nothing per request: request, status (allocated, shortfall, unknown item) and how many items fall short."""
    need = demand.groupBy(request, item).agg(F.sum(wanted).alias("wanted"))
    both = need.join(stock.select(F.col(item_key).alias("__item"), F.col(held).alias("held")), F.col(item) == F.col("__item"), "left")
    found = both.groupBy(request).agg(F.count_if(F.col("held").isNull()).alias("unknown"), F.count_if(F.col("held") < F.col("wanted")).alias("short"))
    status = F.when(F.col("unknown") > 0, "unknown item").when(F.col("short") > 0, "shortfall").otherwise("allocated")
    return found.select(request, status.alias("status"), F.col("short").cast("long").alias("n_short"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth): all ancestors with their least depth, by joining what is new until nothing is. A cycle is an error."""
    edges = edges.select("child", "parent").distinct()
    found = new = cut(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    step = edges.select(F.col("child").alias("ancestor"), "parent")
    depth = 1
    while not new.isEmpty():
        if not new.where("child = ancestor").isEmpty():
            raise ValueError("a cycle")
        depth += 1
        reached = new.join(step, "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        new = cut(reached.join(found, ["child", "ancestor"], "left_anti"))
        found = cut(found.unionByName(new))
    return found


def resolved(names: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, canonical) of what is asked: the end of its chain of aliases (child, parent). A chain that ends in no name fails the
    job, a cycle too. names, asked: one column, name."""
    chain = closure(aliases).groupBy("child").agg(F.max_by("ancestor", "depth").alias("end"))
    found = asked.join(chain, asked["name"] == chain["child"], "left").select("name", F.coalesce("end", "name").alias("end"))
    known = found.join(names.select(F.col("name").alias("canonical")), F.col("end") == F.col("canonical"), "left")
    return known.select("name", F.when(F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.raise_error(F.concat(F.lit("no such name: "), "end"))).alias("canonical"))


def half_even(amount: Column, places: int) -> Column:
    """Exact half-even rounding of a decimal, at its own scale."""
    return F.bround(amount, places)


def decided(subjects: DataFrame, rules: DataFrame, matches: Column, key: str) -> DataFrame:
    """key and verdict: deny if a matching rule denies, else allow if one allows, else the default `deny`. rules: at most MOST_RULES
    of (effect, pattern), counted and then sent to every task; more are an error."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    joined = subjects.join(F.broadcast(rules), matches, "left")
    found = joined.groupBy(key).agg(F.count_if(F.col("effect") == "deny").alias("d"), F.count_if(F.col("effect") == "allow").alias("a"))
    return found.select(key, F.when(F.col("d") > 0, "deny").when(F.col("a") > 0, "allow").otherwise("deny").alias("verdict"))


def backoff(base: Column, factor: int, cap: int, n: int) -> Column:
    """Delays base * factor**i for i < n, none above cap; compared with the cap before they could overflow."""
    grown = lambda i: base.cast("double") * F.pow(F.lit(float(factor)), i)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(grown(i), F.lit(float(cap))).cast("long"))


def overlaid(*layers: Column) -> Column:
    """The first layer that has the field."""
    return F.coalesce(*layers)
