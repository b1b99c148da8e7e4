"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

Sizes are words. Targets share all words by weight, no source above ``most`` times its own
size, the excess shared again by weight until none is above.

The schedule is a sequence of slots, one block of words each. Blocks are as long as the table's size
suggests, but shorter in a source whose target would else be fewer than SLOTS_PER_SOURCE of them. A source
needs target / own block words slots. Slot t has the golden-ratio point frac((t + 1/2) * phi), which
falls into one source's interval of the cumulative shares of slots; in any stretch of slots
every source gets its share to within a few slots, and the few that it lacks after the last follow at the end. Within a source the
documents are shuffled by a seeded hash, laid end to end and cut into equal blocks; the source's
r-th slot takes block r mod K, so it goes round all its K blocks before it repeats one. A
document's ``taken`` is its overlap with the blocks taken, repeats counted.

Scale: words are counted in one scan and only (doc_id, source, size) goes on. Running sums and
ranks are taken in two levels (inside parts of about PART rows, then over the parts), so no
source, however large, meets in one task; its blocks are joined by (source, block). The table of sources
is one row a source; it is ordered as a whole and must fit one task, as names of sources do.

Edge cases: null text has size 0; documents of size 0 are returned with taken 0. The null
source is a source of its own, last in order. Sources without words have target 0. Repeated
rows and equal hashes are laid out by doc_id and each counts; mixture adds up rows of one
doc_id and leaves out those of none. An empty table gives no rows.
Extra columns are ignored by mix and kept by mixture. Rerunning gives the same rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.shared import stored

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # times its size that a source or document is taken at most
SLOTS_PER_SOURCE = 2000  # slots that the schedule has for each source at least, if its words suffice
BLOCK_WORDS = 2048  # words of a block at most
PART = 1024  # rows of a part in running sums
PHI = 0.6180339887498949
LEAP = 1 << 20  # slots numbers are split here, so that late points keep their digits
LEAP_PHI = float(Decimal(LEAP) * ((Decimal(5).sqrt() - 1) / 2) % 1)
BROADCAST_SOURCES = 10_000  # with more sources their table is joined by a shuffle
SEED = 20240607


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size)."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target, place) of each source of docs(source, size)."""
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    table = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).select("source", "source_size", "n_docs", place.alias("place"), weight.alias("weight"))
    # Sources reach their limit in the order of limit / weight; the level is what a unit of
    # weight gets once those before are full.
    limit = F.col("source_size") * F.lit(float(most))
    order = W.orderBy(limit / F.col("weight"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    table = table.withColumn("level", level)
    open_ = F.min(F.when(limit > F.col("weight") * F.col("level"), F.struct(limit / F.col("weight"), "place", "level"))).over(every)["level"]
    return table.select("source", "source_size", "n_docs", F.least(limit, F.col("weight") * F.coalesce(open_, F.lit(0.0))).alias("target"), "place")


def _running(rows: DataFrame, key: str, part: str, order: list, value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their key that come before, by (part, order)."""
    sums = rows.groupBy(key, part).agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, part, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(key, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(sums, [key, part]).withColumn(name, F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_ahead")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of documents(doc_id, text, source)."""
    spark = documents.sparkSession
    docs = stored(sized(documents), "mix-sizes")
    sources = stored(targets(docs, weights, most), "mix-sources")
    total, n_sources = sources.select(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block = max(1, min(BLOCK_WORDS, total // max(1, n_sources * SLOTS_PER_SOURCE)))
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df

    # Blocks of each source: n_blocks equal runs of its shuffled words, cut at whole words.
    length = F.least(F.lit(float(block)), F.col("target") / SLOTS_PER_SOURCE)
    cut = sources.where("target > 0").withColumn("n_blocks", F.least("source_size", F.ceil(F.col("source_size") / length)))
    cut = cut.withColumn("need", F.col("target") * F.col("n_blocks") / F.col("source_size"))
    share = F.sum("need").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) / F.greatest(F.sum("need").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(1e-300))
    cut = cut.withColumn("high", share)
    cut = cut.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("place")), F.lit(0.0))).withColumn("high", F.when(F.lead("place").over(W.orderBy("place")).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    cut = stored(cut, "mix-cuts")
    n_slots = cut.select(F.ceil(F.coalesce(F.sum("need"), F.lit(0.0)))).first()[0]

    # Slots find their source by the cell of the unit interval that their point lies in.
    cells = max(1, min(1 << 16, n_sources * 64))
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))))
    places = cut.select("place", "low", "high", "n_blocks", cell.alias("cell"))
    point = F.expr(f"pmod(pmod((id div {LEAP}) * {LEAP_PHI}D, 1D) + (id % {LEAP} + 0.5D) * {PHI}D, 1D)")
    slots = spark.range(n_slots).select("id", point.alias("point"), F.floor(point * cells).alias("cell"))
    slots = slots.join(small(places), "cell").where("point >= low and point < high").select("id", "place", "n_blocks", F.floor(F.col("id") / PART).alias("part"), F.lit(1).alias("one"))
    slots = stored(slots, "mix-slots")
    ranked = _running(slots, "place", "part", ["id"], "one", "rank").select("place", "n_blocks", "rank")
    had = slots.groupBy("place").agg(F.count("*").alias("had"))
    short = cut.select("place", "n_blocks", F.round("need").cast("long").alias("need")).join(had, "place", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    ranked = ranked.union(short.where("had < need").select("place", "n_blocks", F.explode(F.expr("sequence(had, need - 1)")).alias("rank")))
    uses = ranked.where(F.col("rank") < most * F.col("n_blocks")).groupBy("place", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("uses"))

    # Words of each document on its source's line; block k begins at word k * source_size div n_blocks, so
    # that the first blocks, which are taken once more than the others, are no longer than those.
    named = docs.where("size > 0").join(small(cut.select("source", "source_size", "n_docs", "place", "n_blocks")), docs["source"].eqNullSafe(cut["source"])).drop(cut["source"])
    hashed = named.withColumn("mark", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("part", F.pmod("mark", F.ceil(F.col("n_docs") / PART)))
    line = _running(hashed, "place", "part", ["mark", "doc_id", "size"], "size", "start").withColumn("end", F.expr("start + size"))
    line = line.withColumns({"words": F.expr("source_size div n_blocks"), "longer": F.expr("source_size % n_blocks")})
    of = lambda at: f"(cast({at} + 1 as decimal(19)) * cast(n_blocks as decimal(18)) - 1) div source_size"
    spans = line.select("place", "start", "end", "words", "longer", "n_blocks", F.explode(F.expr(f"sequence({of('start')}, {of('(end - 1)')})")).alias("block"))
    low, high = (F.expr(f"(block + {k}) * words + (block + {k}) * longer div n_blocks") for k in (0, 1))
    spans = spans.select("place", "start", "block", (F.least("end", high) - F.greatest("start", low)).alias("overlap"))
    taken = spans.join(uses, ["place", "block"]).groupBy("place", "start").agg(F.sum(F.col("overlap") * F.col("uses")).alias("taken"))
    laid = line.select("doc_id", "place", "start", "size").join(taken, ["place", "start"], "left").select("doc_id", "place", "size", "taken")
    info = small(sources.select("source", "place", "source_size", "target"))
    without = docs.where("size = 0").join(info, docs["source"].eqNullSafe(info["source"])).select("doc_id", "size", "source_size", "target", F.lit(None).alias("taken"))
    return laid.join(info.drop("source"), "place").select("doc_id", "size", "source_size", "target", "taken").union(without).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """documents that the mix takes, with ``size`` and ``taken`` words in place of columns so named."""
    plan = mix(documents, weights, most).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).where("taken > 0")
    return documents.drop("size", "taken").join(plan, "doc_id")
