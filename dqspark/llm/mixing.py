"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sizes are words. Every stage is a DataFrame aggregation; the driver sees scalars only.

Defined results: a null or empty text has size 0 and is taken 0 times; a long text counts whole; a null source is a source of its
own, last in order; null ids and repeated rows are rows like any other, and rows that are alike take equal parts; ties in the
seeded order are between such rows only; an empty table gives no rows; other columns of the input, whatever their names, are
ignored by :func:`mix` and carried along by :func:`repeated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, Workspace, text_column

#: Rows of all sources that share one bucket of the seeded order, on average.
BUCKET_ROWS = 1024
PLACE_BITS = 60
#: Rows of edge buckets, of some 40 bytes each, that are broadcast at most.
BROADCAST_ROWS = 200_000


def place(seed: int, doc_id, text):
    """Where a row stands in the seeded order: PLACE_BITS bits of a digest of seed, id and text, which any SQL engine can compute."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary"))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def n_words(text):
    return F.regexp_count(text, F.lit(WORD_REGEX)).cast("long")


def ranked_sources(sizes: DataFrame, work: Workspace) -> DataFrame:
    """source, source_size, rank from 0 by code point, null last; no step gathers all sources in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = F.monotonically_increasing_id()
    placed = work.save(ordered.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    before, offset = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        before += [F.lit(r["part"]), F.lit(offset)]
        offset += r["n"]
    if not before:
        return placed.select("source", "source_size", F.col("at").alias("rank"))
    return placed.select("source", "source_size", (F.col("at") + F.create_map(*before)[F.col("part")]).alias("rank"))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds target: weight's share of all sizes, clamped at max_epochs times the source's own size.

    Each round clamps what is above its cap at the current level and shares the rest by weight;
    a round clamps one source at least, and clamped ones stay clamped.
    """
    cap, level = F.col("source_size") * F.lit(float(max_epochs)), None
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    clamped = F.lit(False)
    seen = -1
    while True:
        held, weight, n = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight"))), F.count(F.when(clamped, 1))).first()
        if n == seen or not weight:
            break
        level, seen = (total - (held or 0.0)) / weight, n
        clamped = F.col("weight") * F.lit(level) > cap
    share = F.col("weight") * F.lit(level or 0.0)
    return sources.withColumn("target", F.least(cap, share) if level is not None else cap)


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17, work: Workspace | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs(doc_id, text, source).

    A source's documents are all taken floor(target / size) times whole; in a seeded order they are
    then taken once more until the target is reached, the last of them by a fraction. The order is by hash
    buckets: sums of buckets are cumulated, and only the bucket at which a source's target falls is ordered
    row by row, so that no source meets in one task; what each row is joined with is one row per source.
    `weights` repeat over the sources in code point order.
    """
    return _mixed(docs, (), weights, max_epochs, seed, work)


def _mixed(docs: DataFrame, carried: tuple[str, ...], weights=(1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17, work: Workspace | None = None) -> DataFrame:
    """:func:`mix`, with the i-th carried column as _c<i>, so that no name of the input meets one of these."""
    work = work or Workspace(docs.sparkSession, "mix")
    keep = tuple(f"_c{i}" for i in range(len(carried)))
    text = text_column()
    counted = docs.select("doc_id", "source", *[F.col(c).alias(k) for c, k in zip(carried, keep)], n_words(text).alias("size"), place(seed, F.col("doc_id"), text).alias("h"))
    sizes = work.save(counted.drop(*keep), "sizes")
    n = sizes.count()
    buckets = 1 << max(4, min(16, (n // BUCKET_ROWS).bit_length()))
    bucket = F.shiftright("h", PLACE_BITS - buckets.bit_length() + 1).cast("int")
    sizes = sizes.withColumn("bucket", bucket)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = water_fill(ranked_sources(sizes, work).withColumn("weight", cycle[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")]), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.least(F.floor(ratio), F.lit(int(max_epochs)))).withColumn("extra", F.greatest(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    sources = work.save(sources.select("source", "source_size", "target", "whole", "extra"), "targets")
    # the bucket at which a source's extra words end, and the words of the buckets before it
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    s, f = sources.alias("s"), filled.alias("f")
    at_edge = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("bucket_size") > F.col("extra"))
    edges = f.join(s, F.col("f.source").eqNullSafe(F.col("s.source"))).where(at_edge).select(F.col("f.source").alias("source"), F.col("bucket").alias("edge"), F.col("extra") - F.col("before"))
    edges = edges.toDF("source", "edge", "room")
    e = edges.alias("e")
    # every bucket is before the edge of a source that takes all its words once more, and after that of one that takes none
    none = F.when(F.col("extra") > 0, F.lit(buckets)).otherwise(F.lit(-1))
    plan = s.join(e, F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.source", "source_size", "target", "whole", F.coalesce("edge", none).alias("edge"), "room")
    plan = work.save(plan, "plan")
    # rows of one bucket of each source are ordered one by one; those that are alike in all that counts are one row of it
    p = plan.alias("p")
    near = sizes.alias("d").join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.edge"))).groupBy("d.source", "h", "size").agg(F.count("*").alias("alike"), F.first("room").alias("room"))
    rows = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    all_of = F.col("size") * F.col("alike")
    room = F.least(F.greatest(F.col("room") - F.coalesce(F.sum(all_of).over(rows), F.lit(0)), F.lit(0)), all_of)
    near = work.save(near.withColumn("own", F.floor(room / F.col("alike"))).select(F.col("source").alias("n_source"), F.col("h").alias("n_h"), F.col("size").alias("n_size"), "own"), "near")
    # columns that are kept come from docs, whose sizes are counted again rather than written with the text
    d = (counted.withColumn("bucket", bucket) if keep else sizes).alias("d")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "whole", "edge")
    own = F.col("source").eqNullSafe(F.col("n_source")) & (F.col("h") == F.col("n_h")) & (F.col("size") == F.col("n_size"))
    more = F.when(F.col("bucket") < F.col("edge"), F.col("size")).when(F.col("bucket") == F.col("edge"), F.coalesce("own", F.lit(0))).otherwise(F.lit(0))
    if near.count() <= BROADCAST_ROWS:
        both = joined.join(F.broadcast(near), own, "left")
    else:  # only rows of edge buckets are shuffled
        inside = joined.where(F.col("bucket") == F.col("edge")).join(near, own, "left")
        both = joined.where(F.col("bucket") != F.col("edge")).withColumn("own", F.lit(None).cast("long")).unionByName(inside.drop("n_source", "n_h", "n_size"))
    taken = F.col("whole") * F.col("size") + more
    return both.select("doc_id", "source", *keep, F.col("size").cast("long"), "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows as often as they are taken; a fraction of a document is its first words.

    The text is carried through the mix, so that rows whose ids repeat stay apart.
    """
    names = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    rows = _mixed(docs, tuple(names), **options)
    some = F.greatest(F.col("size"), F.lit(1))
    whole, part = F.floor(F.col("taken") / some), F.col("taken") % some
    times = F.sequence(F.lit(1), whole.cast("int") + F.when(part > 0, 1).otherwise(0))
    times = F.when(F.col("taken") > 0, times).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("_whole", whole).withColumn("_part", part.cast("int")).withColumn("_time", F.explode(times))
    cut, text = F.col("_time") > F.col("_whole"), F.col(at["text"])
    words = F.regexp_extract_all(text, F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"), F.lit(1))
    out = out.withColumn("_text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_part")), "")).otherwise(text))
    shown = {c: F.col(k) for c, k in at.items()} | {"text": F.col("_text")}
    if "n_chars" in at:
        shown["n_chars"] = F.when(cut, F.length("_text").cast("long")).otherwise(F.col(at["n_chars"]))
    return out.select(*[c.alias(n) for n, c in shown.items()])
