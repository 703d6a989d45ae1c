"""Operator 8: mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). Siblings share their
parent's budget by weight; what one cannot use goes to its siblings, and only what
the whole family cannot use reaches the family's own siblings. Each leaf then
gives the token prefix of its documents' seeded order, over as many epochs as its
budget pays for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

SEED = 8
#: Times a document may be taken.
MAX_EPOCHS = 2
#: Leaves that may be broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_LEAVES = 100_000
#: Hash prefixes by which a leaf's order is summed before its cut is sought.
PREFIX_DIGITS = 3


def token_count(text: str = "text") -> Column:
    """Words between blanks; null: none."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def row_name() -> Column:
    """What a row's place in the orders depends on: its doc_id or, where that is
    null, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64(F.col("text").cast("string")).cast("string")))


def order_key(epoch: Column, name: Column, seed: int = SEED) -> Column:
    """Place of a document in an epoch's order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), name).cast("binary"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Splits `budget` among siblings: adds `given`. A node is full if its capacity
    is at most its share of what fuller siblings leave; the rest share the rest, and
    the tokens that do not divide go one by one to the largest remainders."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    fill = family.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")), level)
    wide = lambda c: c.cast("decimal(19,0)")
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col("weight") > 0) & (wide(F.col("capacity")) * wide(F.col("still")) <= wide(F.col("left")) * wide(F.col("weight")))
    marked = nodes.withColumn("left", left).withColumn("still", still).withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))
    parts = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    exact = "cast(rest as decimal(19,0)) * cast(weight as decimal(19,0))"
    shared = marked.withColumns({"rest": rest, "parts": F.nullif(parts, F.lit(0))}).withColumns({"floor": F.expr(f"({exact}) div cast(parts as decimal(19,0))"), "over": F.expr(f"({exact}) % cast(parts as decimal(19,0))")})
    sharing = ~F.col("full") & (F.col("weight") > 0)
    spare = F.col("rest") - F.sum(F.when(sharing, F.col("floor"))).over(family)
    nth = F.row_number().over(family.orderBy(F.when(sharing, F.col("over")).desc_nulls_last(), level))
    return (
        shared.withColumns({"spare": spare, "nth": nth})
        .withColumn("given", F.when(F.col("full"), F.col("capacity")).when(sharing, F.col("floor") + F.when(F.col("nth") <= F.col("spare"), 1).otherwise(0)).otherwise(0))
        .drop("left", "still", "full", "rest", "parts", "floor", "over", "spare", "nth")
    )


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (levels, tokens) with `given`, the tokens each is to provide: never
    more than max_epochs times its tokens. Weights are whole numbers by level and
    name, 1 where none is stated, 0 for nothing: a node can use only what those of
    its descendants can that have weight all the way down."""
    capacity = (F.col("tokens") * max_epochs).alias("capacity")
    given = None
    for depth, level in enumerate(levels):
        keys = levels[: depth + 1]
        usable = F.lit(True)
        for below in levels[depth + 1 :]:
            usable = usable & (_weight(below, weights) > 0)
        nodes = leaves.groupBy(*keys).agg(F.sum(F.when(usable, F.col("tokens") * max_epochs).otherwise(0)).alias("capacity")).withColumn("weight", _weight(level, weights))
        if given is None:
            nodes = nodes.crossJoin(F.broadcast(leaves.agg(budget.cast("long").alias("budget"))))  # one row
        else:
            nodes = nodes.join(given.withColumnRenamed("given", "budget"), keys[:-1])
        given = _share(nodes, keys[:-1], level).select(*keys, "given")
    return leaves.join(given, levels).withColumn("capacity", capacity)


def mix_sources(
    documents: DataFrame,
    weights: dict[str, dict[str, int]],
    levels: dict[str, Column],
    budget_share: float = 0.6,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Rows of `documents` chosen by weight, with mix_epoch (int) and mix_tokens
    (long). levels: name -> column of each level, from the root; a leaf is one value
    of all. The budget is budget_share of all tokens; a token is a word between
    blanks, which the JVM counts where the packer's tokenizer would need Python.

    In each epoch a leaf's documents follow a seeded order; the epoch in which its
    budget ends gives the longest prefix that does not exceed it. A row appears once
    for each epoch that takes it. A null level counts as '', a null text as empty
    (0 tokens). Rows of one doc_id in a leaf share their place and are taken
    together, as are rows without doc_id that have one text. Columns named mix_epoch or mix_tokens are replaced. An empty table
    gives an empty result."""
    documents = documents.drop("mix_epoch", "mix_tokens")
    columns, names = documents.columns, [f"__level_{k}" for k in range(len(levels))]
    levelled = documents.withColumn("__name", row_name())
    for name, column in zip(names, levels.values(), strict=True):
        levelled = levelled.withColumn(name, F.coalesce(column.cast("string"), F.lit("")))
    narrow = stored(levelled.select("__name", token_count().alias("mix_tokens"), *names), "mix-tokens")
    leaves = stored(narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")), "mix-leaves")
    renamed = {own: weights.get(level, {}) for own, level in zip(names, levels, strict=True)}
    share = F.floor(F.sum("tokens") * F.lit(round(budget_share * 1_000_000)) / 1_000_000)
    plan = leaf_budgets(leaves, names, renamed, F.coalesce(share, F.lit(0)), max_epochs).where("tokens > 0")
    plan = stored(plan.withColumn("epochs", F.expr("given div tokens").cast("int")).withColumn("rest", F.expr("given % tokens")).select(*names, "epochs", "rest"), "mix-plan")
    small = plan.count() <= BROADCAST_LEAVES
    sized = lambda df: F.broadcast(df) if small else df

    # where the last epoch ends: the prefix's bucket first, then the place in it
    partial = narrow.join(sized(plan.where("rest > 0")), names).withColumn("key", order_key(F.col("epochs"), F.col("__name"), seed)).withColumn("bucket", F.substring("key", 1, PREFIX_DIGITS))
    sums = partial.groupBy(*names, "rest", "bucket").agg(F.sum("mix_tokens").alias("n"))
    along = Window.partitionBy(*names).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(along)).where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    ends = ends.select(*names, F.col("cut.bucket").alias("bucket"), F.col("cut.before").alias("before"))
    inside = partial.join(sized(ends), [*names, "bucket"])
    place = Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("before") + F.sum("mix_tokens").over(place)).where("upto <= rest").groupBy(*names).agg(F.max("key").alias("last_key"))
    cuts = ends.join(last, names, "left").select(*names, F.coalesce("last_key", "bucket").alias("last_key"))
    plan = stored(plan.join(cuts, names, "left"), "mix-cuts")
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    more = F.when((F.col("rest") > 0) & (order_key(F.col("epochs"), F.col("__name"), seed) <= F.col("last_key")), F.array("epochs")).otherwise(F.array().cast("array<int>"))
    taken = levelled.join(sized(plan), names).withColumn("__epochs", F.concat(whole, more)).where(F.size("__epochs") > 0)
    # counted again only for what is taken: a join with the counts would move all texts
    return taken.withColumn("mix_tokens", token_count()).select(*columns, F.explode("__epochs").alias("mix_epoch"), "mix_tokens")
