"""Data sets made of pairs and registers: product cohorts, holdouts, alias queries, private ids, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.normalize import component_split, keyed_id, normalize_text
from kinweave.operators import graph
from kinweave.operators.splits import LEARNING, _labels
from kinweave.session import cut


def offer_violations(pairs: DataFrame) -> DataFrame:
    """(rule, key) of offer pairs (left, right, left_product, right_product, label, hard): self pairs, pairs that stand
    more than once in either order, offers of several products, labels that the products contradict, hard positives."""
    key = F.concat_ws("|", F.least("left", "right"), F.greatest("left", "right"))
    rule = lambda test, name: pairs.where(test).select(F.lit(name).alias("rule"), key.alias("key"))
    again = pairs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_pair"), "key")
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(s).alias("key"), F.col(s + "_product").alias("product")) for s in ("left", "right")])).alias("e")).select("e.*")
    torn = ends.groupBy("key").agg(F.count_distinct("product").alias("n")).where("n > 1").select(F.lit("offer_of_products"), F.col("key").cast("string"))
    wrong = rule("label is null or label <> cast(left_product = right_product as int)", "label_contradicts_products")
    return rule("left = right", "self_pair").union(again).union(torn).union(wrong).union(rule("label = 1 and hard", "hard_positive"))


def offer_groups(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a group_id: offers are tied by pairs and by products, so that a draw of whole groups parts neither."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    o, p = (lambda s: node("o", s)), (lambda s: node("p", s + "_product"))
    ties = F.array(*[F.struct(a.alias("left"), b.alias("right")) for a, b in ((o("left"), o("right")), (o("left"), p("left")), (o("right"), p("right")))])
    label = graph.components(pairs.select(F.explode(ties).alias("t")).select("t.*").distinct())
    return pairs.withColumn("__node", o("left")).join(label.select(F.col("node").alias("__node"), F.col("label").alias("group_id")), "__node").drop("__node")


def offer_statistics(grouped: DataFrame) -> DataFrame:
    """One row of counts of ``offer_groups``' pairs."""
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    pairs = grouped.agg(F.count("*").alias("pairs"), n(F.col("label") == 1).alias("positive"), n(F.col("label") == 0).alias("negative"), n((F.col("label") == 0) & F.col("hard")).alias("hard_negative"), n((F.col("label") == 0) & ~F.col("hard")).alias("random_negative"))
    ends = grouped.select(F.explode(F.array(*[F.struct(F.col(s).alias("offer"), F.col(s + "_product").alias("product")) for s in ("left", "right")])).alias("e")).select("e.*").distinct()
    offers = ends.agg(F.count_distinct("offer").alias("records"), F.count_distinct("product").alias("products"))
    groups = grouped.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("dependency_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group_pairs"))
    return pairs.crossJoin(F.broadcast(offers)).crossJoin(F.broadcast(groups))  # one row each


def without_products(pairs: DataFrame, training: DataFrame) -> DataFrame:
    """Pairs none of whose products stands in the training pairs."""
    seen = training.select(F.explode(F.array("left_product", "right_product")).alias("p")).distinct()
    out = pairs
    for s in ("left_product", "right_product"):
        out = out.join(seen.withColumnRenamed("p", s), s, "left_anti")
    return out.select(*pairs.columns)


def fresh_holdout(population: DataFrame, prior: DataFrame, entity: str, required: bool = True) -> DataFrame:
    """Rows of the population whose entity no row of ``prior`` has, as test rows. Where ``required``, fails
    if a prior entity has gone or no entity is fresh."""
    if required and prior.select(entity).distinct().join(population, entity, "left_anti").limit(1).count():
        raise ValueError("an entity of the prior data set is gone")
    fresh = population.join(prior.select(entity).distinct(), entity, "left_anti").select(*population.columns)
    if required and not fresh.limit(1).count():
        raise ValueError("no entity is fresh")
    return fresh.withColumn("split", F.lit("test"))


ADDRESS_CONDITIONS = {"name_only": (), "partial_address": ("postcode",), "current_address": ("address", "postcode", "city", "country")}


def alias_queries(records: DataFrame, names: DataFrame, first: str, second: str) -> DataFrame:
    """(number, condition, name, address, postcode, city, country): records of ``first`` asked for by a previous name.

    ``records`` (number, source, name, address, postcode, city, country), ``names`` (number, name) of previous names. Of a
    number that both sources hold, the first name in order counts whose normalized form isn't that of the current name;
    each condition leaves some of the current address."""
    origin = records.where(F.col("source") == first)
    held = records.where(F.col("source") == second).select("number").distinct()
    other = origin.join(held, "number", "left_semi").join(names.select("number", F.col("name").alias("previous")).distinct(), "number")
    chosen = other.where(~normalize_text("previous").eqNullSafe(normalize_text("name"))).groupBy("number").agg(F.min("previous").alias("previous"))
    fields = ("address", "postcode", "city", "country")
    views = [F.struct(F.lit(c).alias("condition"), *[(F.col(f) if f in kept else F.lit(None).cast("string")).alias(f) for f in fields]) for c, kept in ADDRESS_CONDITIONS.items()]
    asked = origin.join(chosen, "number").select("number", F.col("previous").alias("name"), F.explode(F.array(*views)).alias("v"))
    return asked.select("number", "v.condition", "name", *[f"v.{f}" for f in fields])


def private_ids(registry: DataFrame, rows: DataFrame, secret: str) -> DataFrame:
    """The registry (source, source_key, content, record_id, version_id) after rows (source, source_key, content): known
    keys and contents keep their ids, new ones get ids that only a holder of the secret can make."""
    seen = registry.select("source", "source_key", "record_id").distinct()
    fresh = rows.select("source", "source_key", "content").distinct().join(registry, ["source", "source_key", "content"], "left_anti")
    named = fresh.join(seen, ["source", "source_key"], "left").withColumn("record_id", F.coalesce("record_id", keyed_id(registry.sparkSession, secret, "source", "source_key", prefix="r-")))
    version = keyed_id(registry.sparkSession, secret, "source", "source_key", "content", prefix="v-")
    return registry.unionByName(named.withColumn("version_id", version).select(*registry.columns))


def last_edges(edges: DataFrame, seq: str) -> DataFrame:
    """One row for each unordered pair of versions (left_version, right_version): that of the greatest ``seq``."""
    rest = [c for c in edges.columns if c not in ("left_version", "right_version", seq)]
    ends = [F.least("left_version", "right_version").alias("left_version"), F.greatest("left_version", "right_version").alias("right_version")]
    return edges.groupBy(*ends).agg(F.max_by(F.struct(*rest), seq).alias("row")).select("left_version", "right_version", "row.*")


def learning_violations(pairs: DataFrame, seed: int = 7, bounds: tuple[tuple[int, str], ...] = LEARNING) -> DataFrame:
    """(rule, left, right) of a learning data set (left, right, label, group_id, split), components and splits being made
    anew: groups or splits that aren't theirs, and negatives inside the closure of the positives."""
    whole = cut(_labels(pairs.select("left", "right", "label", "group_id", "split")))
    own = component_split(F.concat(F.lit(f"{seed}:"), "component_left"), bounds)
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "left", "right")
    positive = cut(graph.components(pairs.where("label = 1").select("left", "right")))
    side = lambda s: positive.select(F.col("node").alias(s), F.col("label").alias("p" + s))
    inside = pairs.where("label = 0").join(side("left"), "left").join(side("right"), "right").where("pleft = pright")
    return rule(whole.where(~F.col("group_id").eqNullSafe(F.col("component_left"))), "group").union(rule(whole.where(~F.col("split").eqNullSafe(own)), "split")).union(rule(inside, "negative_in_closure"))
