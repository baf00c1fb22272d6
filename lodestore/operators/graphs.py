"""Graph and interval operators: neighbours, expansions, shared-entry links, bucketed interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def directed(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, weight), both ways: an OR of endpoints as a union of two equi-joins."""
    return edges.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), "relation", "weight").unionByName(edges.select(F.col("id2").alias("src"), F.col("id1").alias("dst"), "relation", "weight"))


def neighbours(seeds: DataFrame, edges: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, id, weight): each seed's neighbours with their heaviest edge."""
    both = directed(edges if relations is None else edges.where(F.col("relation").isin(*relations)))
    return both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("seed"), F.col("dst").alias("id")).agg(F.max("weight").alias("weight"))


def heaviest(seeds: DataFrame, edges: DataFrame, per_seed: int, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, id, weight): the heaviest few neighbours of each seed."""
    w = Window.partitionBy("seed").orderBy(F.desc("weight"), "id")
    return neighbours(seeds, edges, relations).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_seed).drop("n")


def expanded(seeds: DataFrame, edges: DataFrame, per_seed: int = 3, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(id, weight, seed): the heaviest few neighbours of each seed, each neighbour once, with its heaviest seed, the least of them. Ids are of any type."""
    best = heaviest(seeds, edges, per_seed, relations).groupBy("id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "seed")).alias("b"))
    return best.select("id", (-F.col("b.w")).alias("weight"), F.col("b.seed").alias("seed"))


#: Members of one side of a block of a group: a larger group is joined block by block, in as many tasks.
BLOCK = 512
#: Rows that a task is dealt, pairs that it counts, and tasks at most: more input makes more tasks, not larger ones.
ROWS, PAIRS, TASKS = 250_000, 250_000, 4_000


def in_tasks(n: int, each: int) -> int:
    return max(1, min(TASKS, -(-n // each)))


def dealt_blocks(rows: DataFrame, n: int, group: str, member: str, block: int) -> tuple[DataFrame, int]:
    """Rows, n of them, with (_parts, _p): into how many blocks their group is cut, by a hash of the member, and which is theirs; and how many pairs the groups make. Groups of one row go."""
    rows = rows.repartition(in_tasks(n, ROWS), group)  # for the sizes and for the join
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    pairs = sizes.agg(F.sum(F.expr("_n * (_n - 1) div 2"))).first()[0] or 0
    dealt = rows.join(sizes.select(group, F.ceil(F.col("_n") / block).cast("int").alias("_parts")), group)
    return dealt.withColumn("_p", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")), pairs


def meeting(dealt: DataFrame) -> DataFrame:
    """Dealt rows once for each pair of blocks (_x <= _y) of their group in which their own is one of the two."""
    at = F.expr("transform(sequence(0, _parts - 1), q -> struct(least(q, _p) as _x, greatest(q, _p) as _y))")
    return dealt.withColumn("_at", F.explode(at)).select("*", "_at.*").drop("_at", "_parts")


def shared_pairs(links: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, n) members a < b that share n groups.

    Groups of one member make no pair and go before the join. A group of more than BLOCK members is cut into blocks by a hash of the member, and each pair of
    blocks is a key of its own: no key holds more than two blocks, whatever the group's size, and no pair is lost or met twice. A block's own pairs are
    told from one row that lists it, and pairs are dealt to as many tasks as their number asks.
    """
    own = links.select(F.col(group).alias("_g"), F.col(member).alias("m")).where("_g is not null and m is not null")
    n = own.count()
    own = own.repartition(in_tasks(n, ROWS), "_g")
    sizes = own.groupBy("_g").agg(F.count("*").alias("_n"))  # repeated links count too: a bound
    pairs, large = sizes.agg(F.coalesce(F.sum(F.expr("_n * (_n - 1) div 2")), F.lit(0)), F.count_if(F.col("_n") > BLOCK)).first()
    tasks = in_tasks(pairs, PAIRS)
    rest, listed = own, None
    if large:
        big = sizes.where(F.col("_n") > BLOCK).select("_g")
        rest = own.join(big, "_g", "left_anti")
        dealt, _ = dealt_blocks(own.join(big, "_g", "left_semi").distinct(), n, "_g", "m", BLOCK)
        listed = dealt.repartition(tasks, "_g", "_p").groupBy("_g", "_parts", "_p").agg(F.collect_list("m").alias("ms"))
    lists = rest.groupBy("_g").agg(F.collect_set("m").alias("ms")).select("ms")
    lists = (lists if listed is None else lists.unionByName(listed.select("ms"))).where(F.size("ms") > 1).select(F.sort_array("ms").alias("ms"))
    out = lists.select("ms", F.posexplode("ms").alias("_i", "a")).select("a", F.explode(F.slice("ms", F.col("_i") + 2, F.size("ms"))).alias("b"))
    if listed is not None:
        blocks = meeting(listed.where("_parts > 1")).where("_x < _y").repartition(tasks, "_g", "_x", "_y")
        left, right = blocks.where("_p = _x").withColumnRenamed("ms", "ma"), blocks.where("_p = _y").select("_g", "_x", "_y", F.col("ms").alias("mb"))
        across = left.join(right, ["_g", "_x", "_y"]).select(F.explode("ma").alias("a"), "mb").select("a", F.explode("mb").alias("b"))
        out = out.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return out.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def within_seconds(a: DataFrame, b: DataFrame, key: str, at_a: str, at_b: str, seconds: int) -> DataFrame:
    """Rows of one key whose instants (longs) lie within so many seconds: an equi-join on key and bucket, then the range."""
    left = a.withColumn("_b", F.explode(F.array(*[F.floor(F.col(at_a) / seconds) + i for i in (-1, 0, 1)])))
    right = b.withColumn("_b", F.floor(F.col(at_b) / seconds))
    return left.join(right, [key, "_b"]).where(F.abs(F.col(at_a) - F.col(at_b)) <= seconds).drop("_b")


def within_days(a: DataFrame, b: DataFrame, day_a: str, day_b: str, days: int) -> DataFrame:
    """Rows whose dates lie within so many days: an equi-join on buckets of that width, then the range."""
    def bucket(c: str) -> Column:
        return F.floor(F.unix_date(F.col(c)) / days)

    left = a.withColumn("_b", F.explode(F.array(*[bucket(day_a) + i for i in (-1, 0, 1)])))
    return left.join(b.withColumn("_b", bucket(day_b)), "_b").where(F.abs(F.datediff(day_a, day_b)) <= days).drop("_b")


def group_means(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Unit-length mean vector of each group."""
    flat = vectors.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = flat.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(group, F.transform("mean", lambda x: x / norm).alias("mean"))
