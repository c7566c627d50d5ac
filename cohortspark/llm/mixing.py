"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with a fractional number of copies, its source's target over its source's size. The whole
part is certain; the fractional parts are settled in pairs: probability mass, measured in words, moves
at random from one document of a pair to the other until one of the two is integral, and the
other goes on with what is left. A move never changes the pair's expected words. Pairs meet in a reduction tree: blocks of
about FAN_IN documents settle all but one of theirs, the remaining ones of FAN_IN blocks meet in the next level, and so on.

Documents are settled by classes of size, the largest first. The one that a class leaves is paired with all smaller
documents of its source together, whose common fraction takes up what it gives or lacks; so what is left undecided in
the end is as small as the source's smallest documents, and a huge document can't take its source off its target.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, unit, written

FAN_IN = 64
WORD_RUN = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 50_000
CLASS_BITS = 3  # sizes of a class differ by less than a factor of 2^CLASS_BITS


def source_targets(sizes: DataFrame, *, max_factor: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(rank, source, source_size, n, weight, target) from (source, source_size, n): one row for each source.

    Sources in code point order, null last, get the weights in turn. Targets share the total by weight; a
    target above max_factor times its source's size stops there and the excess is shared again: the
    common level at which the remaining sources fill up has a closed form over the sources sorted by
    how soon they stop. This table has a row for each source, never for each document."""
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("stop", max_factor * F.col("source_size"))
    by_stop = W.orderBy(F.col("stop") / F.col("weight"), "rank")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_stop.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
        .withColumn("stops", F.col("stop") / F.col("weight") <= F.col("level"))
        .withColumn("at", F.row_number().over(by_stop))
    )
    first = F.min(F.when(~F.col("stops"), F.struct("at", "level"))).over(everything)
    return level.withColumn("common", first["level"]).select("rank", "source", "source_size", "n", "weight", F.when(F.col("common").isNull() | (F.col("stop") <= F.col("common") * F.col("weight")), F.col("stop")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _settle(items: Column, item: str, seed: int) -> Column:
    """Fold a block's items pairwise: struct(done: settled items with their bit, carry: the item left over)."""
    start = F.expr(f"struct(CAST(array() AS ARRAY<STRUCT<item: {item}, bit: BIGINT>>) AS done, CAST(NULL AS {item}) AS carry)")

    def meet(acc: Column, j: Column) -> Column:
        i = acc["carry"]
        up = F.least((1 - i["f"]) * i["size"], j["f"] * j["size"])
        down = F.least(i["f"] * i["size"], (1 - j["f"]) * j["size"])
        gains = unit(i["h"], j["h"], F.lit(seed)) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        fi, fj = i["f"] + moved / i["size"], j["f"] - moved / j["size"]
        i_done = F.when(gains, (1 - i["f"]) * i["size"] <= j["f"] * j["size"]).otherwise(i["f"] * i["size"] <= (1 - j["f"]) * j["size"])
        bit = F.when(gains, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        out = F.when(i_done, F.struct(i.alias("item"), bit.alias("bit"))).otherwise(F.struct(j.alias("item"), (1 - bit).alias("bit")))
        left = F.when(i_done, j.withField("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fj)))).otherwise(i.withField("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fi))))
        both = F.struct(F.concat(acc["done"], F.array(out)).cast(f"ARRAY<STRUCT<item: {item}, bit: BIGINT>>").alias("done"), left.cast(item).alias("carry"))
        return F.when(i.isNull(), F.struct(acc["done"].alias("done"), j.cast(item).alias("carry"))).otherwise(both)

    return F.aggregate(items, start, meet)


def _hand_down(last: DataFrame, seed: int) -> DataFrame:
    """Pair a class's remaining document (fraction f) with all smaller ones of its source (`below` words, fraction
    `common`): adds bit and the smaller ones' new `common`. If those become integral first, the document is drawn alone."""
    up = F.least((1 - F.col("f")) * F.col("size"), F.col("common") * F.col("below"))
    down = F.least(F.col("f") * F.col("size"), (1 - F.col("common")) * F.col("below"))
    gains = unit(F.col("h"), F.lit(seed), F.lit("below")) * (F.col("up") + F.col("down")) < F.col("down")
    moved = F.when(F.col("up") + F.col("down") <= 0, 0.0).when(gains, F.col("up")).otherwise(-F.col("down"))
    f = F.col("f") + F.col("moved") / F.col("size")
    common = F.when(F.col("below") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("common") - F.col("moved") / F.col("below")))).otherwise(F.col("common"))
    bit = F.when(f > 1 - 1e-9, 1).when(f < 1e-9, 0).when(unit(F.col("h"), F.lit(seed), F.lit("last")) < f, 1).otherwise(0)
    return last.withColumn("up", up).withColumn("down", down).withColumn("moved", moved).select("rank", "id", "nth", "size", "base", bit.cast("long").alias("bit"), common.alias("common"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_factor: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, nth): one row for each row of docs.

    Null texts have size 0. Documents without words take no words. Repeated rows are told apart by a running
    number nth, so each is drawn by itself. Draws depend on ids, sizes and the seed only: reruns agree."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_RUN)).cast("long").alias("size"))
    rows = saved(rows.groupBy("id", "source", "size").agg(F.count("*").alias("repeats")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"), F.sum("repeats").alias("n"))
    targets = saved(source_targets(sizes, max_factor=max_factor, weights=weights))
    bound = targets.agg(F.max("n").alias("n"), F.count("*").alias("sources")).first()
    known = F.broadcast(targets) if bound["sources"] <= BROADCAST_SOURCES else targets

    few = lambda frame: F.broadcast(frame) if bound["sources"] <= BROADCAST_SOURCES else frame
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        rows.alias("r").join(known.alias("t"), F.expr("r.source <=> t.source")).select("id", "size", "rank", rate.alias("rate"), F.explode(F.expr("sequence(1L, repeats)")).alias("nth"))
        .withColumn("base", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn("f", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
        .withColumn("h", F.xxhash64(F.col("id"), F.col("nth"), F.col("size"), F.lit(seed)))
        .withColumn("class", F.when((F.col("size") > 0) & (F.col("f") > 1e-12), F.floor((F.length(F.bin("size")) - 1) / CLASS_BITS).cast("int")))
    )
    units = written(units.select("id", "nth", "size", "rank", "base", "f", "h", "class"))
    smaller = W.partitionBy("rank").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    classes = units.where("class is not null").groupBy("rank", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("f").alias("f"))
    classes = saved(classes.withColumn("below", F.coalesce(F.sum("words").over(smaller), F.lit(0))))  # a row for each source and class
    state = classes.groupBy("rank").agg(F.min("f").alias("f"))
    item = f"STRUCT<largest: BIGINT, h: BIGINT, id: {kind}, nth: BIGINT, size: BIGINT, base: BIGINT, f: DOUBLE>"
    settled = [units.where("class is null").select("id", "nth", "size", "rank", "base", F.lit(0).cast("long").alias("bit"))]
    for c in classes.groupBy("class").agg(F.max("n").alias("n")).orderBy(F.desc("class")).collect():  # at most 22 classes
        here = classes.where(F.col("class") == c["class"]).select("rank", "n", "below").join(state, "rank")
        level = units.where(F.col("class") == c["class"]).drop("f").join(few(here), "rank")
        level = level.select("rank", F.struct((-F.col("size")).alias("largest"), "h", "id", "nth", "size", "base", "f").alias("item"), F.ceil(F.col("n") / FAN_IN).alias("blocks"))
        level = level.withColumn("block", F.pmod(F.xxhash64(F.col("item.h")), F.col("blocks")))
        most, depth = -(-c["n"] // FAN_IN), 0
        while True:
            blocks = saved(level.groupBy("rank", "blocks", "block").agg(F.array_sort(F.collect_list(F.col("item").cast(item))).alias("items")).select("rank", "blocks", "block", _settle(F.col("items"), item, seed + depth).alias("s")))
            settled.append(blocks.select("rank", F.explode("s.done").alias("d")).select(F.col("d.item.id").alias("id"), F.col("d.item.nth").alias("nth"), F.col("d.item.size").alias("size"), "rank", F.col("d.item.base").alias("base"), F.col("d.bit").alias("bit")))
            level = blocks.where("s.carry is not null").select("rank", F.col("s.carry").alias("item"), F.ceil(F.col("blocks") / FAN_IN).alias("blocks"), F.floor(F.col("block") / FAN_IN).alias("block"))
            if most <= 1:
                break
            most, depth = -(-most // FAN_IN), depth + 1
        left = saved(_hand_down(level.select("rank", "item.*").join(few(here.select("rank", "below", F.col("f").alias("common"))), "rank"), seed))
        settled.append(left.select("id", "nth", "size", "rank", "base", "bit"))
        state = saved(state.join(few(left.select("rank", "common")), "rank", "left").select("rank", F.coalesce("common", "f").alias("f")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = F.col("base") + F.col("bit")
    return out.join(known, "rank").select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "nth")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
