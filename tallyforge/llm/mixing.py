"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, distinct_names, written

#: Words: runs of anything but a space and the characters 9 to 13.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words. A null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc: Column, seed: int) -> Column:
    """52 bits of the MD5 of seed and id, which any engine can compute alike."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Weights are 1 to `weights`, repeating, by the sources' code points, null
    last. Shares are by weight, but none above `epochs` times its source's size;
    what is cut off is shared anew by weight. That ends where every source has
    min(epochs * size, level * weight) and all of them sum to all sizes; the
    level is found by running sums over the sources in order of epochs * size /
    weight, which are taken in ranges: sources can be as many as documents.
    Empty tables give no rows.
    """
    cap = (F.col("source_size") * F.lit(epochs)).cast("double")
    ranked = running(sources.withColumn("cap", cap).withColumn("one", F.lit(1.0)), [F.col("source").asc_nulls_first()], {"one": "nth"})
    # null is the last source
    nulls = ranked.where("source is null").count()
    nth = F.when(F.col("source").isNull(), ranked.count() - 1).otherwise(F.col("nth") - nulls)
    ranked = ranked.withColumn("weight", (nth % weights + 1).cast("double")).drop("one", "nth")
    in_ratio = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    found = running(ranked, in_ratio, {"cap": "caps", "weight": "weights"})
    whole = ranked.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights")).head()
    level = (F.lit(whole.sizes) - F.col("caps")) / (F.lit(whole.weights) - F.col("weights"))
    least = found.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), "level"))["level"].alias("level")).head()
    level = F.lit(None if least is None else least.level).cast("double")
    return ranked.select("source", "source_size", "weight", F.coalesce(F.least("cap", level * F.col("weight")), F.lit(0.0)).alias("target"))


def running(rows: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """rows with sums (values: doubles' column and the sum's name) over all rows before each in the order, which is total; ranges are summed apart, and the driver adds their totals."""
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = sorted(map(tuple, placed.groupBy("_part").agg(*(F.sum(v) for v in values)).collect()))  # a row for each range
    starts, sums = [], [0.0] * len(values)
    for part, *own in totals:
        starts.append((part, *sums))
        sums = [a + b for a, b in zip(sums, own, strict=True)]
    start = placed.sparkSession.createDataFrame(starts, "_p int, " + ", ".join(f"_start{i} double" for i in range(len(values))))
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(start), F.col("_part") == F.col("_p"))
    for i, (value, name) in enumerate(values.items()):
        joined = joined.withColumn(name, F.coalesce(F.sum(value).over(upto), F.lit(0.0)) + F.col(f"_start{i}"))
    return joined.drop("_part", "_p", *(f"_start{i}" for i in range(len(values))))


def mix(docs: DataFrame, weights: int = 3, epochs: int = 3, bucket_rows: int = 8_192, seed: int = 11, with_rows: bool = True) -> DataFrame:
    """Every row of docs as row (a struct of its columns), doc_id, source, size, source_size, target, whole and part.

    It is taken `whole` times, and once more for `part` of its words. Each row
    gets a hash-random key. A source's rows, in the order of keys, are cut into
    ranges of about `bucket_rows` rows (the keys are uniform, so equal ranges
    hold equally many and a hot source simply has more of them); sums run within
    each range and then over the ranges' totals. A source takes
    floor(target / size) whole epochs, and of the next the documents up to its
    budget, of the last one only the words that fit. All is computed from
    hashes, so reruns agree. Words are counted once, into a table of ids and
    sizes; without rows (with_rows=False) the texts are read for that alone.

    A null text has size 0. Null is a source of its own, the last. Repeated
    rows are further documents, in one order or the other, which makes no
    difference to the result's rows. Empty tables give no rows.
    """
    docs = distinct_names(docs)
    text, source, doc = column(docs, "text", "string"), column(docs, "source", "string"), column(docs, "doc_id", "long")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("doc_id"), source.alias("source"), words(text).alias("size"), random_key(doc, seed).alias("key"))
    thin = written(base.drop("row"), "sizes")
    base = base if with_rows else thin
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    planned = written(targets(sizes, weights, epochs).join(sizes.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight"), "targets")

    def known(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
        renamed = other.withColumnsRenamed({c: f"_{c}" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        small = other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return df.join(F.broadcast(renamed) if small else renamed, cond).drop(*(f"_{c}" for c in on))

    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(bucket_rows)))
    spot = F.floor(F.col("key") / F.lit(float(1 << 52)) * ranges)
    order = W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    within = known(thin, planned, "source").withColumn("range", spot).groupBy("source", "range").agg(F.sum("size").alias("total"))
    offsets = written(within.select("source", "range", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("before")), "offsets")
    placed = known(known(base, planned, "source").withColumn("range", spot).withColumn("end", F.sum("size").over(order)), offsets, "source", "range")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("before") + F.col("end") - F.col("size"))))
    return placed.select(*["row"] * with_rows, "doc_id", "source", "size", "source_size", "target", whole.cast("long").alias("whole"), part.cast("long").alias("part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    gaps = F.split(text, WORD, -1)
    return F.array_join(F.zip_with(F.slice(gaps, 1, n.cast("int")), F.slice(found, 1, n.cast("int")), lambda a, b: F.concat(a, b)), "")


def mixed(docs: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """The mix itself: docs' own columns, a row for each time that a document is taken, the last one cut to its words.

    Documents of which nothing is taken go. n_chars, where docs has it, follows the cut text.
    """
    docs = distinct_names(docs)
    found = mix(docs, weights, epochs)
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    full = F.when((F.col("part") > 0) & ~cut, F.col("whole") + 1).otherwise(F.col("whole"))
    copies = F.array_repeat(F.lit(None).cast("long"), full.cast("int"))
    rows = found.select("row", F.explode(F.when(cut, F.array_append(copies, F.col("part"))).otherwise(copies)).alias("take"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "text" in own:
        own["text"] = F.when(F.col("take").isNotNull(), first_words(F.col("row.text"), F.col("take"))).otherwise(F.col("row.text"))
    if "text" in own and "n_chars" in own:
        own["n_chars"] = F.when(F.col("take").isNotNull(), F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*(v.alias(c) for c, v in own.items()))


def op2_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; see mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, with_rows=False).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))
