"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .sharding import global_prefix_sums


def van_der_corput(i: Column, bits: int) -> Column:
    """The point of slot ``i`` as an integer below 2**bits: its binary digits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` -> also ``weight, target``: ``share`` of all words dealt by weight, no
    source above ``cap`` times its size, the excess reshared by weight until none is above.

    Sources are put by code point, null last, and get the weights in turn. The level at which
    sources fill up is found in one pass: in order of cap over weight, the words per weight left after
    the caps before rise up to the first source that they don't fill and fall after it, so the level
    is their maximum. Both orders are prefix sums over partitions, since sources may be many.
    """
    one, last, nth, full, per, caps, heavy = fresh("one", "last", "nth", "full", "per", "caps", "heavy")
    s = sizes.select("source", "source_size", F.lit(1).cast("long").alias(one), F.col("source").isNull().alias(last))
    s = global_prefix_sums(s, [last, "source"], {nth: one})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col(nth) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn(full, F.col("source_size") * F.lit(float(cap))).withColumn(per, F.col(full) / F.col("weight"))
    s = global_prefix_sums(s, [per, last, "source"], {caps: full, heavy: "weight"})
    size, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level = s.agg(F.max((F.lit(float(size or 0)) * F.lit(float(share)) - F.col(caps)) / (F.lit(weight or 1.0) - F.col(heavy)))).first()[0] or 0.0
    return s.select("source", "source_size", "weight", F.least(F.col(full), F.lit(level) * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, block: int = 1024) -> DataFrame:
    """``slot, source, rank``: which source each slot of the mix draws its next block from.

    A source needs ceil(target / block) blocks. Slot i maps its van der Corput point through the
    sources' cumulative block counts, scaled to 2**m points with 2**m at least twice the blocks: an
    interval of the 2**m points is met once for each integer in it, so each source is met at least
    as often as it needs, evenly over the schedule. Slots are ranked for each source; those beyond
    its need are left out.
    """
    spark = targets.sparkSession
    last, before, lo, hi, cell_, point, one = fresh("last", "before", "lo", "hi", "cell", "point", "one")
    need = targets.select("source", F.ceil(F.floor("target") / F.lit(block)).cast("long").alias("blocks"), F.col("source").isNull().alias(last)).where("blocks > 0")
    need = global_prefix_sums(need, [last, "source"], {before: "blocks"})
    total = need.agg(F.sum("blocks")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "slot long, source string, rank long")
    bits = max(1, (2 * total - 1).bit_length())
    scale = lambda c: F.expr(f"CAST((CAST({c} AS DECIMAL(19, 0)) * CAST({1 << bits} AS DECIMAL(19, 0))) DIV CAST({total} AS DECIMAL(19, 0)) AS BIGINT)")
    need = need.withColumn(lo, scale(before)).withColumn(hi, scale(f"({before} + blocks)"))
    # Each source's interval is cut at the borders of equal cells; points meet intervals by cell.
    cell = max(0, bits - 10)
    cells = F.sequence(F.shiftright(lo, cell), F.shiftright(F.col(hi) - 1, cell))
    pieces = need.select("source", "blocks", lo, hi, F.explode(cells).alias(cell_))
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), van_der_corput(F.col("id"), bits).alias(point)).withColumn(cell_, F.shiftright(point, cell))
    drawn = slots.join(pieces, cell_).where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).select("slot", "source", "blocks", F.lit(1).cast("long").alias(one))
    ranked = global_prefix_sums(drawn, ["slot"], {"rank": one}, ["source"])
    return ranked.where("rank < blocks").select("slot", "source", "rank")


def _dealt(docs: DataFrame, size: str, weights: tuple[int, ...], share: float, cap: float, block: int, seed: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``position`` in their source's stream, and the pieces of :func:`mix_pieces`."""
    taken = {"doc_id", "source", "size", "source_size", "target", "position", "slot", "rank", "epoch", "from", "words"}
    if taken.intersection(c.lower() for c in carry):
        raise ValueError(f"carry can't be one of {sorted(taken)}")
    h, one, start, s_, r_, e_ = fresh("hash", "one", "start", "source", "rank", "epoch")
    rows = written(docs.select("doc_id", "source", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), *carry), "sizes")
    rows = rows.withColumn(h, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn(one, F.lit(1).cast("long"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    at = global_prefix_sums(rows, [h, "doc_id", "size", *carry], {start: "size", "position": one}, ["source"])
    t = targets.select(F.col("source").alias(s_), "source_size", "target")
    # Sources are few or many: Spark broadcasts them if small, else joins by key and splits a hot one.
    at = at.join(t, F.col("source").eqNullSafe(F.col(s_))).drop(s_, h, one)
    begin = lambda e: F.col(start) + e * F.col("source_size")
    span = lambda e: F.struct(F.lit(e).alias("epoch"), begin(e).alias("a"), F.least(begin(e) + F.col("size"), F.floor("target")).alias("b"))
    epoch, a, b = (F.col(f"{e_}.{x}") for x in ("epoch", "a", "b"))
    reading = at.where("size > 0").withColumn(e_, F.explode(F.array(span(0), span(1)))).where(b > a)
    blocks = F.sequence(F.floor(a / block), F.floor((b - 1) / block))
    wanted = reading.select("source", "position", "doc_id", *carry, e_, F.explode(blocks).alias("rank"))
    slots = schedule(targets, block).select(F.col("source").alias(s_), F.col("rank").alias(r_), "slot")
    first = F.greatest(a, F.col("rank") * block)
    words = F.least(b, (F.col("rank") + 1) * block) - first
    pieces = wanted.join(slots, F.col("source").eqNullSafe(F.col(s_)) & (F.col("rank") == F.col(r_)))
    return at.drop(start), pieces.select("slot", "rank", "source", "position", "doc_id", *carry, epoch.alias("epoch"), (first - a).alias("from"), words.alias("words"))


def mix_pieces(docs: DataFrame, size: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 1024, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself: ``slot, rank, source, position, doc_id``, the columns ``carry``, ``epoch, from, words``.

    Each row is the run of ``words`` words of a document, from its word ``from`` on, that stands in the
    slot; the slot draws block ``rank`` of the source. The mix's order is slot, epoch, position.
    """
    return _dealt(docs, size, weights, share, cap, block, seed, carry)[1]


def mix_documents(docs: DataFrame, size: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 1024, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Light rows ``doc_id, source, size`` -> one row for each with ``source_size, target`` and the words
    the mix takes of its first and second reading (``first_words, second_words``; from the front), the
    slots in which these begin (``first_slot, second_slot``) and in which the last of them ends
    (``last_slot``; slots are null if nothing is taken), the ``position`` in its source's stream, and
    the columns ``carry``, which also put rows in order that are equal else.

    The documents of a source, shuffled by a hash, form a stream that is read up to twice and cut
    into blocks of ``block`` words; the slot of rank k takes block k, the last one up to the target.

    Defined cases: null sizes count 0, a null source is a source of its own, equal rows are
    neighbours in the stream, an empty table gives an empty result, a very long document stands in as
    many slots as it has blocks, other columns don't pass through unless ``carry`` names them.
    """
    at, pieces = _dealt(docs, size, weights, share, cap, block, seed, carry)
    s_, m_ = fresh("source", "position")
    of = lambda e, c: F.when(F.col("epoch") == e, F.col(c))
    got = (pieces.groupBy(F.col("source").alias(s_), F.col("position").alias(m_))
           .agg(F.sum(of(0, "words")).alias("first_words"), F.sum(of(1, "words")).alias("second_words"), F.min(of(0, "slot")).alias("first_slot"), F.min(of(1, "slot")).alias("second_slot"), F.max("slot").alias("last_slot")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (at.join(got, F.col("source").eqNullSafe(F.col(s_)) & (F.col("position") == F.col(m_)), "left")
            .select("doc_id", "source", "size", "source_size", "target", zero("first_words"), zero("second_words"), "first_slot", "second_slot", "last_slot", "position", *carry))
