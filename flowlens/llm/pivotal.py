"""Mix sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents shall be taken f = target / size times on average. Each gets the whole part; what is
left is a probability. Pairs of documents hand mass to each other, weighted by their sizes so that the words
expected stay the same, until one of the two is whole (0 or 1). A group of documents leaves one residual;
residuals form groups again, level by level, until a source has one left, which is rounded to the nearer
whole. So a source misses its target by half a document at most.

Random numbers are hashes of document, level and seed: reruns agree, whatever the partitions.

Equal rows (same id, source, size and hash of the text) form one item, which shares out its copies evenly, so that
a repeated row makes no large group. Groups are cut by hash, GROUP items on average. Nulls: a null text has size 0, a
null source is a source of its own, sorted last; a null id is an id. Documents of size 0 are taken 0 words.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import land

GROUP = 48
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, filled up to cap times the size.

    Sources in code point order, null last, get the weights in turn. What a full source leaves is
    shared by weight among the rest: target = min(cap * size, level * weight), where the level is
    found by filling sources in the order of cap * size / weight. One row for each source is sorted.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = by_source.withColumn("turn", F.row_number().over(in_turn) - 1)
    named = named.withColumn("weight", F.element_at(cycle, F.pmod("turn", F.lit(len(weights))).cast("int") + 1))
    named = named.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("most") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    # The level if this source and all that fill later were not full.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(fill), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    )
    at = named.withColumn("level", level)
    # It rises while the next source is full and falls from then on: the highest is the one that holds.
    level = F.max("level").over(every)
    return at.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def _uniform(seed: int, level: int, *keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *keys), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _fold(items: str, epsilon: float) -> str:
    """SQL of a left fold: the carried item meets each next one; settled items are appended.

    An item is (size, p, u, key). With a = mass that may rise and b = mass that may fall, the carried
    item rises by a with probability b / (a + b), else falls by b; its partner makes up for it.
    """
    item = "struct(CAST({0} AS DOUBLE) AS size, CAST({1} AS DOUBLE) AS p, CAST({2} AS DOUBLE) AS u, {3} AS key)"
    rise = "least(1D - s.held.p, x.p * x.size / s.held.size)"
    fall = "least(s.held.p, (1D - x.p) * x.size / s.held.size)"
    moved = f"IF(x.u * ({rise} + {fall}) < {fall}, {rise}, -({fall}))"
    p = f"(s.held.p + {moved})"
    q = f"(x.p - {moved} * s.held.size / x.size)"
    one = item.format("s.held.size", p, "s.held.u", "s.held.key")
    two = item.format("x.size", q, "x.u", "x.key")
    whole = f"({p} <= {epsilon} OR {p} >= 1D - {epsilon})"
    return (
        f"aggregate(slice({items}, 2, size({items})), "
        f"named_struct('held', {items}[0], 'done', slice({items}, 1, 0)), "
        f"(s, x) -> IF({whole}, named_struct('held', {two}, 'done', concat(s.done, array({one}))), "
        f"named_struct('held', {one}, 'done', concat(s.done, array({two})))))"
    )


_KEY = ["doc_id", "source", "size", "text_hash"]


def _keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(text).alias("text_hash"),
    ]


def _decided(sized: DataFrame, weights: tuple[float, ...], cap: float, seed: int, group: int) -> DataFrame:
    """Items, each with its equal rows and all copies that these are taken together."""
    goal = targets(sized, weights, cap)
    items = _with_targets(sized.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows")), goal)
    share = F.col("rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Whole up to rounding errors of the division.
    items = items.withColumn("share", F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share))
    items = items.withColumn("whole", F.floor("share")).withColumn("p", F.col("share") - F.floor("share"))
    items = land(items.withColumn("key", F.struct(*_KEY)), "mix-items")

    open_items = items.where((F.col("p") > 0) & (F.col("size") > 0)).select(
        "key", "source", F.col("size").cast("double").alias("size"), "p"
    )
    settled: list[DataFrame] = []
    level = 0
    while (open_items.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0) > 1:
        open_items, done = _round(open_items, seed, level, group)
        settled.append(done)
        level += 1
    ups = open_items.select("key", F.round("p").cast("long").alias("up"))
    for done in settled:
        ups = ups.unionByName(done)
    ups = ups.select("key.*", "up")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"u.{c}")) for c in _KEY]
    joined = items.alias("i").join(ups.alias("u"), same, "left")
    return joined.select(
        *[F.col(f"i.{c}") for c in (*_KEY, "rows", "source_size", "target")],
        (F.col("i.whole") + F.coalesce("u.up", F.lit(0))).cast("long").alias("all_copies"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    id_col="doc_id",
    text_col="text",
    source_col="source",
    seed: int = 7,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each document."""
    sized = land(docs.select(*_keys(id_col, text_col, source_col)), "sizes")
    each = _times(_decided(sized, weights, cap, seed, group), "rows", "n")
    copies = F.floor(F.col("all_copies") / F.col("rows")) + F.when(
        F.col("n") <= F.pmod("all_copies", "rows"), 1
    ).otherwise(0)
    return each.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeated(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    id_col="doc_id",
    text_col="text",
    source_col="source",
    seed: int = 7,
    group: int = GROUP,
) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Rows of one item may differ in other columns: the item's copies are dealt out over its rows as `mix` does, in the order
    of a hash of all columns. All is decided on sizes and hashes; the texts move once, to meet their number of copies.
    """
    variant = _variant(docs)
    sized = land(docs.select(*_keys(id_col, text_col, source_col), variant), "sizes")
    items = _decided(sized, weights, cap, seed, group).where("all_copies > 0").select(*_KEY, "rows", "all_copies")
    once = sized.groupBy(*_KEY, "variant").agg(F.count(F.lit(1)).alias("same"))
    earlier = Window.partitionBy(*_KEY).orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("before", F.coalesce(F.sum("same").over(earlier), F.lit(0)))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"i.{c}")) for c in _KEY]
    rest = F.pmod("all_copies", "rows") - F.col("before")
    copies = F.floor(F.col("all_copies") / F.col("rows")) * F.col("same") + F.greatest(F.lit(0), F.least("same", rest))
    taken = once.alias("d").join(items.alias("i"), same).withColumn("copies", copies.cast("long")).where("copies > 0")
    taken = land(taken.select("variant", "same", "copies"), "copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), variant).join(taken, "variant")
    # Rows that are equal in all columns share their copies evenly; what is left over goes to one of them.
    uneven = F.pmod("copies", "same") > 0
    each = _times(whole.where(~uneven).withColumn("copies", F.expr("copies div same")), "copies", "n").select("doc.*")
    if taken.where(uneven).isEmpty():
        return each
    one = whole.where(uneven).groupBy("variant").agg(F.first("doc").alias("doc"), F.first("copies").alias("copies"))
    return each.unionByName(_times(one, "copies", "n").select("doc.*"))


def _variant(docs: DataFrame) -> Column:
    """128 bits of hash of all columns and of which are null."""
    values = []
    for field in docs.schema:
        column = F.col(f"`{field.name}`")
        values += [column.isNull(), F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column]
    return F.struct(*[F.xxhash64(F.lit(half), *values).alias(f"h{half}") for half in (1, 2)]).alias("variant")


_BLOCK = 1 << 16


def _times(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as it says, numbered from 1, in blocks, so that no array is as long as a large count."""
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {_BLOCK}"))
    each = rows.withColumn("_block", F.explode(blocks))
    numbers = F.sequence(F.col("_block") * _BLOCK + 1, F.least(F.col(count), (F.col("_block") + 1) * _BLOCK))
    return each.withColumn(name, F.explode(numbers)).drop("_block")


def _with_targets(items: DataFrame, goal: DataFrame) -> DataFrame:
    """One row for each source, met by hash join; Spark decides by its size whether to broadcast it."""
    goal = goal.withColumnRenamed("source", "goal_source")
    return items.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")


def _round(items: DataFrame, seed: int, level: int, group: int, epsilon: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """One level of the tree: each group settles all its items but one. Residuals, and (key, up)."""
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("count_source"), F.ceil(F.col("n") / F.lit(group)).alias("groups")
    )
    cell = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("key")), F.col("groups"))
    dealt = items.join(counts, F.col("source").eqNullSafe(F.col("count_source"))).withColumn("cell", cell)
    entry = F.struct("size", "p", _uniform(seed, level, F.lit("u"), F.col("key")).alias("u"), "key")
    # Largest first, so that the residual tends to be small.
    order = "(l, r) -> CASE WHEN l.size > r.size THEN -1 WHEN l.size < r.size THEN 1 WHEN l.u < r.u THEN -1 WHEN l.u > r.u THEN 1 ELSE 0 END"
    folded = (
        dealt.groupBy("source", "cell")
        .agg(F.collect_list(entry).alias("items"))
        .withColumn("items", F.expr(f"array_sort(items, {order})"))
        .select("source", F.expr(_fold("items", epsilon)).alias("f"))
    )
    folded = land(folded, f"mix-level-{level}")
    # A residual that became whole by its last step is settled, too.
    held = folded.select("source", "f.held.*")
    settled = folded.select(F.explode("f.done").alias("d")).select("d.key", F.round("d.p").cast("long").alias("up"))
    whole = (F.col("p") <= epsilon) | (F.col("p") >= 1 - epsilon)
    settled = settled.unionByName(held.where(whole).select("key", F.round("p").cast("long").alias("up")))
    return held.where(~whole).select("key", "source", "size", "p"), settled
