"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot t of the schedule is the golden-ratio point frac((t + 1) * phi) mapped through the cumulative target shares to a
source. Slots are ranked within their source; rank r takes block r modulo the source's blocks. Blocks hold `block_words`
words of the source's documents in hash order. A source's last slot is cut so that it gives its target of words; the few
slots by which the sequence's discrepancy leaves a source short follow at the end of the schedule.

A null source is a source of its own and comes last; documents without words are in no block; documents may repeat ids
(each row counts) or have none. Same rows, same schedule: order comes from a hash of id, source and text alone, never from row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import free_names, materialize

#: Fixed values of the mixture: weights repeat over the sources in order; total and cap are shares of the words there are.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2.0
CHUNK = 1 << 15
ORDER_BUCKETS = 1 << 12
GRID = 1024


def running_sum(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = 64) -> DataFrame:
    """df with `out`: the sum of `value` before each row, per `by` and by `order` (a whole number, once per `by`).

    In two levels, so that no task holds more than `width` neighbours, or a width-th of a group's rows.
    """
    upto = lambda keys, x: Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    d = df.withColumn("_run", F.expr(f"{order} div {width}"))
    base = d.groupBy(*by, "_run").agg(F.sum(value).alias("_sum"))
    base = base.select(*by, "_run", F.coalesce(F.sum("_sum").over(upto(by, "_run")), zero).alias("_base"))
    d = d.withColumn("_inner", F.coalesce(F.sum(value).over(upto([*by, "_run"], order)), zero)).join(base, [*by, "_run"])
    return d.withColumn(out, F.col("_base") + F.col("_inner")).drop("_run", "_base", "_inner")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a stable order key of each document."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("doc_id", "text").alias("mix_key"))


def targets(by_source: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Water-filling: target = min(cap * size, level * weight), with the level at which targets sum to total * all sizes.

    One row per source; the windows below run over sources, not documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.select("source", "source_size", w.alias("weight")).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open_weight": F.sum("weight").over(after), "all": F.sum("source_size").over(whole) * total})
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("open_weight"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(whole))
    return s.select("source", "source_size", "weight", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def blocks(sized: DataFrame, block_words: int) -> DataFrame:
    """The part of each document in each block: doc_id, source, block, lo, hi (words from the block's start).

    Positions are prefix sums over the hash order, in two levels, so that one large source spreads over many tasks.
    """
    s = sized.where("size > 0").withColumns({"part": F.shiftrightunsigned("mix_key", 64 - ORDER_BUCKETS.bit_length() + 1).cast("int"), "src": F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))})
    part = s.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    part = running_sum(part, ["src"], "part", "part_size", "part_start").select("src", "part", "part_start")
    inner = Window.partitionBy("src", "part").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(part, ["src", "part"])
    s = s.withColumn("start", F.col("part_start") + F.col("inner")).withColumn("stop", F.col("start") + F.col("size"))
    b = F.lit(block_words)
    s = s.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(stop - 1) div {block_words}"))))
    return s.select("doc_id", "mix_key", "size", "src", "block", (F.greatest("start", F.col("block") * b) - F.col("block") * b).alias("lo"), (F.least("stop", (F.col("block") + 1) * b) - F.col("block") * b).alias("hi"))


def schedule(target: DataFrame, block_words: int, slots: int) -> DataFrame:
    """slot, src, rank: each slot's source by the golden-ratio point, ranked within the source; plus the slots still owed.

    Ranks are built from counts per (source, chunk of slots) so that no task sees all slots of a source.
    """
    spark = target.sparkSession
    t = target.where("target >= 1").withColumn("src", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    order = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"upto": F.sum("target").over(order), "sum": F.sum("target").over(Window.partitionBy(F.lit(0)))})
    t = t.select("src", "target", "source_size", F.when(F.col("upto") - F.col("target") < 0, 0.0).otherwise((F.col("upto") - F.col("target")) / F.col("sum")).alias("from"), F.when(F.row_number().over(Window.orderBy(F.col("src").desc())) == 1, 1.0).otherwise(F.col("upto") / F.col("sum")).alias("to"))
    b = float(block_words)
    passes, rest = F.expr("cast(floor(target) as long) div source_size"), F.expr("cast(floor(target) as long) % source_size")
    t = t.withColumn("need", (passes * F.ceil(F.col("source_size") / b) + F.ceil(rest / b)).cast("long"))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * GRID).cast("int"), F.floor(F.col("to") * GRID).cast("int"))))
    # frac((t + 1) * phi) with t split in two, so that doubles keep ten digits however large t is
    phi, far = "0.6180339887498949D", repr(((5**0.5 - 1) / 2 * 2**20) % 1) + "D"
    u = f"(({phi} * ((id + 1) & 1048575) + {far} * ((id + 1) >> 20)) % 1.0D)"
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(u).alias("u")).withColumn("cell", F.floor(F.col("u") * GRID).cast("int")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    hit = points.join(F.broadcast(cells) if _few(target) else cells, "cell").where("u >= `from` and u < `to`").select("slot", "chunk", "src", "need")
    per = hit.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    base = running_sum(per, ["src"], "chunk", "n", "base", 1024).select("src", "chunk", "base")
    inner = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = hit.withColumn("k", F.row_number().over(inner) - 1).join(base, ["src", "chunk"]).select("slot", "src", (F.col("base") + F.col("k")).alias("rank"), "need").where("rank < need")
    got = per.groupBy("src").agg(F.sum("n").alias("got"))
    owed = t.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need").select((F.lit(slots) + F.col("got")).alias("slot"), "src", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"), "need")
    return ranked.unionByName(owed)


def mix(docs: DataFrame, block_words: int = 128, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with what is taken of each, the schedule joined to its blocks, targets by source)."""
    sized = materialize(sizes(docs), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = materialize(targets(by_source, weights, total, cap), "mix-targets")
    words = int(target.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0])
    plan = schedule(target, block_words, max(1, -(-words // block_words)))
    piece = blocks(sized, block_words)
    src = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    size_of = target.select(src.alias("src"), "source_size", "target")
    # a source's blocks: the last one may be short, so words up to rank r are counted exactly
    b = F.lit(block_words)
    plan = plan.join(F.broadcast(size_of) if _few(target) else size_of, "src").withColumn("n_blocks", F.ceil(F.col("source_size") / b.cast("double")).cast("long"))
    plan = plan.withColumn("block", F.col("rank") % F.col("n_blocks")).withColumn("pass", F.expr("rank div n_blocks"))
    start = F.col("pass") * F.col("source_size") + F.col("block") * b
    length = F.least(b, F.col("source_size") - F.col("block") * b)
    plan = plan.withColumn("take", F.greatest(F.lit(0), F.least(length, F.floor("target") - start)).cast("long"))
    hits = plan.groupBy("src", "block").agg(F.sum(F.when(F.col("take") == length, 1).otherwise(0)).alias("full"), F.max(F.when(F.col("take") < length, F.col("take"))).alias("cut"))
    used = piece.join(hits, ["src", "block"]).withColumn("words", (F.col("hi") - F.col("lo")) * F.col("full") + F.greatest(F.lit(0), F.least("hi", F.coalesce("cut", F.lit(0))) - F.col("lo")))
    taken = used.groupBy("src", "doc_id", "mix_key", "size").agg(F.sum("words").alias("words"))
    # repeated rows (same id, source and text) share what their pieces got together
    per_row = taken.select(F.col("src").alias("_src"), F.col("doc_id").alias("_doc_id"), F.col("mix_key").alias("_mix_key"), "words")
    same = (F.col("src") == F.col("_src")) & (F.col("mix_key") == F.col("_mix_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    out = sized.withColumn("src", src).join(F.broadcast(size_of) if _few(target) else size_of, "src").join(per_row, same, "left")
    twin = Window.partitionBy("src", "doc_id", "mix_key").orderBy("size")
    out = out.withColumns({"i": F.row_number().over(twin), "copies": F.count("*").over(Window.partitionBy("src", "doc_id", "mix_key"))})
    share = F.expr("words div copies") + F.when(F.col("i") <= F.expr("words % copies"), 1).otherwise(0)
    mixed = out.select("doc_id", "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken"), "source", "mix_key")
    return mixed, plan.select("slot", "src", "rank", "block", "pass", "take"), target


def mixed_rows(docs: DataFrame, block_words: int = 128) -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it, to the nearest whole number."""
    mixed = mix(docs, block_words)[0].where("size > 0")
    copies = mixed.groupBy("mix_key", "source").agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias("n")).where("n > 0")
    key, source, n, own, i = free_names(docs, "_mix_key", "_mix_source", "_mix_n", "_mix_own", "_mix_i")
    copies = copies.select(F.col("mix_key").alias(key), F.col("source").alias(source), F.col("n").alias(n))
    d = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    same = (F.col(own) == F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    rows = d.join(copies.hint("shuffle_hash"), same).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _few(target: DataFrame, most: int = 100_000) -> bool:
    return target.count() <= most
