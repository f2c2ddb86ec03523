"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the certain whole copies of its source's ratio (target size over source size). What is
left of the target is drawn: documents are ranked by Q = odds(U) / odds(p), U a uniform number from the document's
seeded hash and p its inclusion probability, and the smallest Q are taken until the words left are filled. With a
column of inclusion weights, p differs between the documents of a source; without one it is the ratio's fraction. The
query and the pipeline weigh a document by its words, up to LONG_WORDS, so that longer texts are likelier to be drawn.
DataFrame functions only; no source's rows meet in one task, as only the bin of Q in which the cut falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the rank statistic in which a source's words are counted before one bin is ordered: at least so many, and
#: so many that a bin of the largest source has about so many rows.
BINS, BIN_ROWS = 4096, 50_000
#: Words beyond which a document's inclusion weight does not grow.
LONG_WORDS = 1000
#: Tables of up to so many sources (two strings' size and a few numbers each) are broadcast, larger ones joined.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size), one row per source, null included.

    Sources in code point order, null last, have the given weights in turn and share the total size by them; a
    target above ``most`` times its source's size is cut there and the rest is shared again by weight. That is
    target = min(most * size, weight * level) for the level at which the targets add up; sources are capped in the
    order of most * size / weight, so the level is the first that caps no further source. There is one row for each
    source here, and the windows run over those.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double")).withColumn("turn", turn)
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(whole).cast("double"),
            "capped": F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("left", F.col("total") - F.col("capped"))
    fits = F.col("weight") * F.col("left") / F.col("open") <= F.col("most")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), F.col("turn"), F.col("left"), F.col("open")))).over(whole))
    level = F.col("weight") * F.col("level.left") / F.col("level.open")
    return rows.select("source", "source_size", F.coalesce(F.least("most", level), F.col("most")).alias("target"))


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) from the md5 of seed and keys: the first 48 bits plus a half."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def words_up_to(most: int = LONG_WORDS) -> Column:
    """An inclusion weight: a document's words, at most so many."""
    return F.least(word_count(), F.lit(most))


def _ranked(docs: DataFrame, seed: int, inclusion: str | None) -> DataFrame:
    """docs with __size, __u, __wish and the tie-break __key, which only repeated rows share."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    wish = F.greatest(F.coalesce(F.col(inclusion).cast("double"), F.lit(0.0)), F.lit(1e-9)) if inclusion else F.lit(1.0)
    return docs.withColumns({"__size": word_count(), "__u": uniform(seed, "doc_id"), "__wish": wish, "__key": key})


def _statistic() -> Column:
    """Q / (1 + Q), which ranks as Q = odds(u) / odds(p) does and lies between 0 and 1."""
    p = F.least(F.greatest(F.col("part") * F.col("__wish") * F.col("rows") / F.col("wishes"), F.lit(1e-12)), F.lit(1 - 1e-12))
    q = (F.col("__u") / (1 - F.col("__u"))) / (p / (1 - p))
    return q / (1 + q)


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    side = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 20, inclusion: str | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, copies and taken = copies * size added.

    copies is how often the mix holds the row: its whole copies plus one if it is drawn. Each source's taken words
    differ from its target by at most half its last drawn document, and no row has more than ``most`` copies.
    inclusion names a column of relative inclusion weights (null or not positive: hardly ever); without one all
    documents of a source have the same. A null or empty text has size 0 and adds no words; a source without words
    has target 0. A null source is a source of its own. Of rows with equal doc_id and text among which the cut
    falls, exactly as many are drawn as fit, whichever these are. Texts may have any length. Other columns are kept,
    but columns named size, source_size, target, copies or taken are replaced; an empty table gives no rows.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*added)
    ranked = _ranked(docs, seed, inclusion)
    narrow = cut_lineage(ranked.select("source", "__size", "__u", "__wish", "__key"))
    sums = cut_lineage(narrow.groupBy("source").agg(F.sum("__size").alias("source_size"), F.sum("__wish").alias("wishes"), F.count("*").alias("rows")))
    known = sums.agg(F.count("*").alias("sources"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    few, bins_of = known["sources"] <= BROADCAST_SOURCES, max(BINS, -(-known["most"] // BIN_ROWS))
    targets = _with_source(source_targets(sums.select("source", "source_size"), weights, most), sums.drop("source_size"), few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long"))
    targets = targets.withColumn("part", F.col("ratio") - F.col("whole")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = cut_lineage(targets.drop("ratio"))

    placed = _with_source(narrow, targets, few).withColumn("__stat", _statistic())
    bin_of = F.least(F.floor(F.col("__stat") * bins_of), F.lit(bins_of - 1)).cast("int")
    placed = placed.withColumn("__bin", bin_of)
    bins = placed.groupBy("source", "__bin").agg(F.sum("__size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("words").over(upto))
    crossed = bins.where("upto >= left and words > 0").groupBy("source").agg(F.min(F.struct("__bin", F.expr("upto - words").alias("before"))).alias("at"))
    crossed = cut_lineage(crossed.select("source", F.col("at.__bin").alias("cut_bin"), F.col("at.before").alias("before")))
    inside = _with_source(placed, crossed, few).where("__bin = cut_bin")
    order = Window.partitionBy("source").orderBy("__stat", "__key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    # of equal rows that the cut falls among, as many as fit are drawn; they are as long, so it does not matter which
    fits = inside.withColumn("fits", (ahead + F.col("__size") / 2 <= F.col("left")).cast("long"))
    ties = fits.groupBy("source", "__stat", "__key").agg(F.sum("fits").alias("drawn"), F.count("*").alias("equal")).where("drawn > 0")
    last = ties.groupBy("source").agg(F.max(F.struct("__stat", "__key", "drawn", "equal")).alias("last"))
    side = crossed.withColumnRenamed("source", "s").join(last, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "cut_bin", "last")
    side = targets.withColumnRenamed("source", "s").join(side, F.col("s").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("s", "source")
    side = cut_lineage(side)

    done = _with_source(ranked, side, few).withColumn("__stat", _statistic())
    at, cut = F.struct("__stat", "__key"), F.struct(F.col("last.__stat").alias("__stat"), F.col("last.__key").alias("__key"))
    tie = F.coalesce((bin_of == F.col("cut_bin")) & (at == cut) & (F.col("last.drawn") < F.col("last.equal")), F.lit(False))
    drawn = F.col("cut_bin").isNull() | (bin_of < F.col("cut_bin")) | ((bin_of == F.col("cut_bin")) & F.coalesce(at <= cut, F.lit(False)))
    done = done.withColumns({"__tie": tie, "__drawn": drawn})
    if not side.where("last.drawn < last.equal").isEmpty():
        counted = _counted_off(done.where("__tie")).withColumn("__drawn", F.col("__number") < F.col("last.drawn")).drop("__number")
        done = done.where("not __tie").unionByName(counted)
    copies = F.least(F.col("whole") + (F.col("__drawn") & (F.col("left") > 0)).cast("long"), F.lit(most).cast("long"))
    done = done.withColumns({"size": F.col("__size"), "copies": copies, "taken": copies * F.col("__size")})
    return done.select(*docs.columns, *added)


def _counted_off(rows: DataFrame, parts: int = 64) -> DataFrame:
    """rows with __number from 0 within their source. They lie in a checkpoint, so that a repeated task sees the same
    numbers, and a source's rows are counted in several parts."""
    kept = cut_lineage(rows).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    sizes = kept.groupBy(F.col("source").alias("__source"), F.col("__part").alias("__own")).agg(F.count("*").alias("__rows"))
    upto = Window.partitionBy("__source").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__rows").over(upto), F.lit(0))).drop("__rows")
    inside = F.row_number().over(Window.partitionBy("source", "__part").orderBy("__key")) - 1
    joined = kept.withColumn("__inside", inside).join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__own")))
    return joined.withColumn("__number", F.col("__start") + F.col("__inside")).drop("__part", "__own", "__source", "__start", "__inside")


def mix_by_length(docs: DataFrame, **options) -> DataFrame:
    """mix_sources with the inclusion weights words_up_to(); rows and columns as there."""
    return mix_sources(docs.withColumn("__inclusion", words_up_to()), inclusion="__inclusion", **options).drop("__inclusion")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as mix_by_length takes it, with the columns of docs."""
    taken = mix_by_length(docs, **options).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
