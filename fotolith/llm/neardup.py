"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, verified on full sets.

SetSketch: each of REGISTERS registers keeps the truncated logarithm (base BASE) of the smallest of
exponential variates, one for each shingle, so registers of a union are the maxima of registers. Two
sketches agree in a register more often the more alike their sets are; bands of ROWS registers that
agree make candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textkernel import U, chunks, mix, shingle_sets

REGISTERS, ROWS, BASE, RATE, TOP = 256, 8, 1.1, 20.0, 254
BANDS = REGISTERS // ROWS
_rng = np.random.default_rng(11)
_A = _rng.integers(1, 2**62, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint8 registers of a set of 64-bit hashes: floor(1 - log_BASE(x / RATE)), cut to 0..TOP + 1, where x
    is the smallest exponential variate of the register. RATE scales the values so that sets of one
    to tens of millions of shingles stay inside the range."""
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        v = ((shingles[i:i + 2048, None] * _A + _B) >> U(32)).astype(np.uint32)
        np.minimum(low, v.min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the joint register order of pairs with known set sizes.

    With u = na / (na + nb), v = nb / (na + nb) a register is larger on the left, larger on the right or
    equal with chances p(u - v j), p(v - u j), the rest, where p(x) = -log_b(1 - x (b - 1) / b) and b
    is BASE. The likelihood is searched on a grid of j.
    """
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log(np.clip(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE, 1e-12, 1)) / np.log(BASE)
    pu, pv = p(u - v * j), p(v - u * j)
    score = up * np.log(np.maximum(pu, 1e-12)) + down * np.log(np.maximum(pv, 1e-12)) + same * np.log(np.maximum(1 - pu - pv, 1e-12))
    return j[np.arange(len(j)), score.argmax(1)]


SKETCH = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, registers binary"


def sketches(docs: DataFrame, words: int = 3) -> DataFrame:
    """:data:`SKETCH` of each whole text: set_a and set_b are two sums over the set's mixed hashes, so equal
    sets have equal pairs; null and wordless texts have no shingles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blobs = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(blobs):
                sets = shingle_sets(blobs[lo:hi], words)
                sums = np.array([[mix(s).sum(), mix(s ^ U(0xABCDEF)).sum()] for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0], pa.int64()), pa.array(sums[:, 1], pa.int64()),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary())], [x.split()[0] for x in SKETCH.split(", ")])

    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, SKETCH)


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs ``a, b, na, nb, ra, rb`` those whose likely similarity is at least ``least``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                ok = pa.array(np.concatenate([likely_jaccard(ra[i:i + 4096], rb[i:i + 4096], na[i:i + 4096], nb[i:i + 4096]) for i in range(0, len(na), 4096)]) >= least)
                yield batch.select(["a", "b"]).filter(ok)

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """Of pairs ``a, b, ta, tb`` those whose full shingle sets are alike: 100 |A n B| >= percent |A u B|."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist()
            keep: list[bool] = []
            for lo in range(0, len(a), 64):
                sa, sb = shingle_sets(a[lo:lo + 64], words), shingle_sets(b[lo:lo + 64], words)
                for x, y in zip(sa, sb, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """Of rows ``cid, text``: one row ``cid, shingle`` for each member of each text's set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in chunks(blobs, 1 << 19):
                sets = shingle_sets(blobs[lo:hi], words)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids[lo:hi], np.int64), [len(x) for x in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["cid", "shingle"])

    return texts.mapInArrow(run, "cid long, shingle long")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, comp`` of every node of the edges ``a, b``: comp is the smallest node reachable.

    Alternates large-star and small-star steps on the edge table, each of which keeps the number of
    edges and at least halves the distance to the smallest node, until nothing changes (an error after
    ``rounds`` rounds); each round is written to the shared folder. A node's links are never gathered: both steps use a minimum that
    is pre-aggregated before the shuffle and joined back.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        two = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = two.join(low, "u").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, "edges")
        # Done when each node has one smaller neighbour that has none itself: a forest of stars.
        roots = new.select(F.col("u").alias("v")).distinct()
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(roots, "v", "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    own = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return own.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


#: Postings of more rows are read and paired in blocks of about as many.
LONG = 1024


def beside(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``stats`` of their ``key``, among them ``holders``; rows of keys that aren't there go.

    Rows of long groups are joined apart from the others: these groups are few, so Spark sends their
    stats to all tasks if they are small, and a group's rows needn't meet in one task. Without any the
    join stands once in the plan: plans that hold their rows twice at several steps weigh on the driver.
    """
    stats = written(stats, "stats")
    if stats.where(F.col("holders") > LONG).isEmpty():
        return rows.join(stats, key)
    long = stats.where(F.col("holders") > LONG)
    rest = rows.join(long.select(key), key, "left_anti").join(stats.where(F.col("holders") <= LONG), key)
    return rest.unionByName(rows.join(long, key))


def posting_pairs(post: DataFrame, alike: Column) -> DataFrame:
    """Pairs ``cid, cid_b`` of rows ``shingle, cid, n, comp, left, holders`` of one shingle and different
    components that satisfy ``alike`` (the second row's columns end in ``_b``).

    A posting is dealt to blocks of about :data:`LONG` rows by a hash of its members. Blocks i <= j
    meet under a key of their own, so no task gets more than two blocks of a posting, however long it
    is; a row is sent as often as the posting has blocks.
    """
    blocks = F.ceil(F.col("holders") / F.lit(LONG)).cast("int")
    rows = post.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    one = rows.select("shingle", "cid", "n", "comp", "left", F.col("_block").alias("i"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("j"))
    two = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "comp", "left")], F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("i"), F.col("_block").alias("j"))
    return one.join(two, ["shingle", "i", "j"]).where("(i < j or cid < cid_b) and comp <> comp_b").where(alike).select("cid", "cid_b")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 3, slack: float = 0.12) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts of equal shingle sets are one class, whose smallest doc_id stands for it. Classes whose
    registers agree in a band of :data:`ROWS` share a bucket (at a similarity of 0.85 a pair shares
    none with a chance under 1e-4). A bucket's pairs are never listed. Its members first meet its hub,
    the one of smallest hash. In buckets that then still hold several components they meet a second
    hub, the member whose shingles are the most widespread: of a text and its edited copies that is
    the least edited one. What is left is cut exactly: shingles are put in one order, rare before
    common, and two sets alike enough share one that has enough of both sets at or after it. Only
    members that hold the same such shingle meet, so a large group of heavily edited copies, each
    mostly of its own rare shingles up to there, ends without its pairs; long postings meet in blocks
    (:func:`posting_pairs`). A pair that meets goes on if
    its likely similarity is at least the threshold less ``slack`` (over 4 standard errors) and links
    if its full sets pass. Buckets within one component drop out; so every pair that shares a bucket
    is linked, refused or joined by others.

    Defined cases: texts without words link with nothing; null texts count as empty; null doc_ids
    come out unlinked and not kept apart from their own row; equal rows share their component, and
    both are kept if theirs is the smallest doc_id; a very long text is in memory whole, with its set;
    an empty table gives an empty result; other columns don't pass through.
    """
    sk = written(sketches(docs, words), "sketches")
    classes = written(sk.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
                      .agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
                      .select("set_a", "set_b", F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("text_hash"), "n", "registers"), "classes")
    # doc_ids may repeat with other texts: classes are told apart by a hash of the set, not by doc_id.
    classes = classes.withColumn("cid", F.col("set_a"))
    band = lambda i: F.xxhash64(F.lit(i), F.substring("registers", i * ROWS + 1, ROWS))
    banded = classes.select("cid", "n", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("sig"))
    counts = banded.groupBy("sig").agg(F.count("*").alias("holders"), F.min(F.struct(F.xxhash64("cid").alias("h"), "cid", "n")).alias("hub")).where("holders > 1")
    buckets = written(beside(banded, counts, "sig").select("sig", "cid", "n", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    light = classes.select("cid", "n", "registers")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def enough(left: str, mine: str, other: Column) -> Column:
        """Whether ``left`` common shingles suffice for sets of these sizes."""
        return F.col(left) * (100 + percent) >= (F.col(mine) + other) * percent

    def fits(mine: str, other: str) -> Column:
        """Whether two sizes allow the similarity: exact, and before any text is read."""
        return F.least(mine, other) * 100 >= F.greatest(mine, other) * percent

    # The texts of all that share a bucket, read from the table once; rows of one doc_id and text are one.
    bucketed = buckets.select("cid").distinct().join(classes, "cid").select("cid", F.col("id").alias("doc_id"), "text_hash")
    read = written(bucketed.join(texts, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "cid").agg(F.first("text").alias("text")).select("cid", "text"), "texts")

    def texts_of(cids: DataFrame) -> DataFrame:
        return read.join(cids.distinct(), "cid", "left_semi")

    def link(pairs: DataFrame) -> DataFrame:
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one, two = (light.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
        likely = written(_estimated(p.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb"), percent / 100 - slack), "likely")
        one, two = (read.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return written(_verified(likely.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), percent, words), "links")

    def unresolved(rows: DataFrame) -> DataFrame:
        """Rows of buckets that still hold more than one component, with the bucket's smallest set."""
        mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("smallest"), F.count("*").alias("holders")).where("lo <> hi")
        return written(beside(rows, mixed, "sig").drop("lo", "hi", "holders"), "rest")

    def named(rows: DataFrame, comp: DataFrame) -> DataFrame:
        return rows.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after these further links."""
        if links.isEmpty():
            return comp
        return connected_components(links.union(comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    members = buckets.where("cid <> hub")
    edges = link(members.where(fits("n", "hub_n")).select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    comp = connected_components(edges)
    rest = unresolved(named(members.select("sig", "cid", "n"), comp))
    if not rest.isEmpty():
        # Partners are among these rows: shingles that only one of them has can't be common to two.
        shingles = written(shingle_rows(texts_of(rest.select("cid")), words), "shingles")
        holders = shingles.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
        shared = written(beside(shingles, holders, "shingle"), "shared")
        of_text = shared.groupBy("cid").agg(F.count("*").alias("shared"), F.sum(F.log("holders")).alias("spread"))
        partner = F.greatest("smallest", F.ceil(F.col("n") * percent / 100))
        rest = unresolved(rest.join(of_text, "cid").where(enough("shared", "n", partner)).select("sig", "cid", "n", "comp", "spread"))

        central = F.max(F.struct((F.col("spread") / F.col("n")).alias("spread"), "cid", "n", "comp")).alias("hub")
        met = beside(rest, rest.groupBy("sig").agg(central, F.count("*").alias("holders")), "sig").where("cid <> hub.cid")
        met = written(met.select("sig", "cid", "n", "comp", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.comp").alias("hub_comp")), "met")
        found = link(met.where("comp <> hub_comp").where(fits("n", "hub_n")).select(F.col("cid").alias("a"), F.col("hub").alias("b")))
        comp = joined(comp, found)
        rest = unresolved(named(met.select("sig", "cid", "n"), comp))

        # left: how many of a set's shingles come at this one or after it, in the order rare to common.
        order = Window.partitionBy("cid").orderBy(F.desc("holders"), F.desc("shingle"))
        left = shared.join(rest.select("cid", "n", "comp").distinct(), "cid").withColumn("left", F.row_number().over(order))
        post = written(left.where(enough("left", "n", F.ceil(F.col("n") * percent / 100))).select("shingle", "cid", "n", "comp", "left"), "postings")
        met_at = post.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("n").alias("smallest"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        pairs = posting_pairs(beside(post, met_at, "shingle").where(enough("left", "n", partner)), enough("left", "n", F.col("n_b")) & enough("left_b", "n", F.col("n_b")))
        comp = joined(comp, link(pairs.select(F.col("cid").alias("a"), F.col("cid_b").alias("b"))))
    least = classes.select("cid", "id").join(comp.withColumnRenamed("node", "cid"), "cid").groupBy("comp").agg(F.min("id").alias("component_id"))
    ids = comp.join(least, "comp").select(F.col("node").alias("cid"), "component_id")
    of_class = classes.join(ids, "cid", "left").select("set_a", "set_b", F.coalesce("component_id", "id").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
