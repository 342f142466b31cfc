"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources take turns by the golden-ratio sequence: slot i of the schedule belongs to the source in
whose share of the unit interval frac(i * phi) falls, so each source gets its share of every
stretch of the schedule.  A source's documents are shuffled by a hash and cut into blocks of
``block_words`` words; its slot of rank r takes block r, and begins again behind the last block.
The slot that reaches the source's target takes only the words that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.spread import running_sum
from codestrata.scale import materialize

BLOCK_WORDS = 4096
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
WEIGHTS = (3, 1, 2)
# Fractional part of the golden ratio in units of 2**-31, odd, so that it takes every value.
GOLDEN = 1327217885
UNIT = 1 << 31
# Slots a source gets beyond those it needs, more than the sequence can be off for any interval.
SPARE_SLOTS = 32
# Slots, or documents, whose running sum one task works out at once.
BUCKET_ROWS = 1 << 14


def word_count(text: Column) -> Column:
    """Number of words; none in a null text."""
    parts = F.split(text, "[ \\x09-\\x0D]+")
    blank_ends = (F.element_at(parts, 1) == "").cast("int") + (
        (F.element_at(parts, -1) == "") & (F.size(parts) > 1)
    ).cast("int")
    return F.coalesce(F.size(parts) - blank_ends, F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """What a source's documents are shuffled by: a hash of the id and the text."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def targets(sizes: list[tuple[str | None, int]], share: float, most: float) -> list[float]:
    """Words to take of each source, by its weight, none above ``most`` times its size.

    ``sizes`` has the sources by code point, null last.  What is above goes to the others by
    weight, again and again until none is above.
    """
    weights = [WEIGHTS[n % len(WEIGHTS)] for n in range(len(sizes))]
    wanted = share * sum(size for _, size in sizes)
    found: dict[int, float] = {}
    while True:
        open_ones = [n for n in range(len(sizes)) if n not in found]
        left, weight = wanted - sum(found.values()), sum(weights[n] for n in open_ones)
        over = [n for n in open_ones if left * weights[n] / weight > most * sizes[n][1]]
        if not over:
            found |= {n: left * weights[n] / weight for n in open_ones}
            return [found[n] for n in range(len(sizes))]
        found |= {n: float(most * sizes[n][1]) for n in over}


def source_order(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block_words: int = BLOCK_WORDS,
    share: float = TOTAL_SHARE,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """Words taken of each document: ``(doc_id, source, size, source_size, target, taken, key)``.

    ``key`` is the hash that a source's documents are shuffled by; only rows of one id and text share it.
    A null or empty text has size 0 and is never taken; a null source is a source of its own; a
    null id stays null; repeated rows are documents of their own; other columns are left out; an
    empty table gives no rows.  The names of the sources go through the driver, one row each.
    Rows of a source that agree in id and size are shuffled as one; they get different places, and
    which of them gets which changes nothing in the result.
    """
    spark = docs.sparkSession
    sized = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        docs[source_column].alias("source"),
        word_count(docs[text_column]).alias("size"),
        shuffle_key(docs[id_column], docs[text_column]).alias("shuffled"),
    )
    sized = materialize(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = sorted(totals.collect(), key=lambda row: source_order(row["source"]))
    if not rows:
        return _empty(sized)
    wanted = targets([(row["source"], row["s"]) for row in rows], share, most)
    plan = [
        (n, row["source"], row["s"], target, int(target), -(-row["s"] // block_words), row["n"])
        for n, (row, target) in enumerate(zip(rows, wanted, strict=True))
    ]
    # One row for each source: as many as the groups that were just collected.
    sources = spark.createDataFrame(
        plan,
        "no int, source string, source_size long, target double, quota long, blocks long, n long",
    )

    known = F.col("d.source").eqNullSafe(F.col("s.source"))
    placed = sized.alias("d").join(F.broadcast(sources).alias("s"), known)
    placed = placed.select("doc_id", "size", "shuffled", "no", "n").filter("size > 0")
    place = F.conv(F.substring("shuffled", 1, 15), 16, 10).cast("long")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    bucket = F.floor(place.cast("double") / F.lit(float(1 << 60)) * buckets).cast("long")
    starts = running_sum(placed, ["no"], bucket, ["shuffled", "doc_id"], "size", "start")
    first, last = (
        F.floor(F.col("start") / block_words),
        F.floor((F.col("start") + F.col("size") - 1) / block_words),
    )
    block = F.explode(F.sequence(first, last)).alias("block")
    pieces = starts.select("no", "doc_id", "size", "start", "shuffled", block)

    taken = _block_visits(spark, plan, block_words)
    # Words of the piece within its block, and those of a visit that ends inside the block.
    at = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    until = F.least(
        F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)
    )
    partly = F.least(F.greatest(F.col("part") - at, F.lit(0)), until - at)
    by_piece = pieces.join(taken, ["no", "block"]).select(
        "no", "doc_id", "size", "start", "shuffled", (F.col("whole") * (until - at) + partly).alias("words")
    )
    # A document has a start of its own within its source, as it has at least one word.
    by_doc = by_piece.groupBy("no", "start", "doc_id", "size", "shuffled").agg(F.sum("words").alias("taken"))
    never = starts.select("no", "start", "doc_id", "size", "shuffled", F.lit(0).cast("long").alias("taken"))
    scheduled = (
        by_doc.unionByName(never)
        .groupBy("no", "start", "doc_id", "size", "shuffled")
        .agg(F.max("taken").alias("taken"))
        .join(F.broadcast(sources), "no")
    )
    scheduled = scheduled.withColumnRenamed("shuffled", "key")
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "key"]
    empty = (
        sized.filter("size = 0")
        .alias("d")
        .join(F.broadcast(sources).alias("s"), known)
        .select(
            "d.doc_id",
            "d.source",
            "size",
            "source_size",
            "target",
            F.lit(0).cast("long").alias("taken"),
            F.col("shuffled").alias("key"),
        )
    )
    return scheduled.select(*out).unionByName(empty)


def _empty(sized: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sized.select(
        "doc_id",
        "source",
        "size",
        zero.alias("source_size"),
        F.lit(0.0).alias("target"),
        zero.alias("taken"),
        F.col("shuffled").alias("key"),
    )


def _block_visits(spark, plan: list[tuple], block_words: int) -> DataFrame:
    """How often the schedule takes each block: ``(no, block, whole, part)``.

    ``part`` is the number of words of a visit that the source's target ends.  Shares are counted
    in slots, with spare ones; slots behind a source's target take nothing.
    """
    slots_of = [-(-quota // block_words) + SPARE_SLOTS for _, _, _, _, quota, _, _ in plan]
    total = sum(slots_of)
    edges = [UNIT * sum(slots_of[:n]) // total for n in range(1, len(plan))]
    # Integers throughout: a mask takes the fractional part.
    point = F.expr(f"((id & {UNIT - 1}L) * {GOLDEN}L) & {UNIT - 1}L")
    upper = F.array(*[F.lit(edge).cast("long") for edge in edges]).cast("array<long>")
    no = F.size(F.filter(upper, lambda edge: edge <= F.col("point")))
    slots = spark.range(total).select("id", point.alias("point"))
    slots = slots.select("id", no.alias("no"), F.lit(1).cast("long").alias("one"))
    ranked = running_sum(slots, ["no"], F.expr(f"id div {BUCKET_ROWS}"), ["id"], "one", "rank")
    facts = spark.createDataFrame(
        [(n, size, quota, blocks) for n, _, size, _, quota, blocks, _ in plan if quota],
        "no int, source_size long, quota long, blocks long",
    )
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    return (
        ranked.join(F.broadcast(facts), "no")
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("left", F.col("quota") - epoch * F.col("source_size"))
        .withColumn("left", F.col("left") - F.col("block") * block_words)
        .filter("left > 0")
        .withColumn(
            "length", F.least(F.col("source_size") - F.col("block") * block_words, F.lit(block_words))
        )
        .groupBy("no", "block")
        .agg(
            F.count_if(F.col("left") >= F.col("length")).alias("whole"),
            F.coalesce(F.sum(F.when(F.col("left") < F.col("length"), F.col("left"))), F.lit(0)).alias(
                "part"
            ),
        )
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block_words: int = BLOCK_WORDS,
    share: float = TOTAL_SHARE,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them.

    A document of which a part is taken counts as taken if that is half of it or more.  Rows that
    agree in id, text and source are one document, taken as often as they are together.
    """
    taken = mix(docs, id_column, text_column, source_column, block_words, share, most)
    times = taken.filter("taken > 0").groupBy("key", "source").agg(
        F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("times")
    )
    times = times.filter("times > 0").select("key", F.col("source").alias("from"), "times")
    rows = docs.select(
        F.struct("*").alias("row"),
        shuffle_key(docs[id_column], docs[text_column]).alias("key"),
        docs[source_column].alias("from"),
    )
    rows = rows.dropDuplicates(["key", "from"]).alias("d")
    same = (F.col("d.key") == F.col("t.key")) & F.col("d.from").eqNullSafe(F.col("t.from"))
    chosen = rows.join(times.alias("t"), same)
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")
    return chosen.select("row", repeated).select("row.*")
