"""Homomorphic multiset hashes of documents.

A document is the multiset of its paragraphs (the parts between newlines). Each paragraph is hashed
into a wide vector; the fingerprint is the sum of the vectors, lane by lane, modulo powers of two. So
it doesn't depend on the paragraphs' order, and a paragraph is added to or taken from a fingerprint
by one vector addition. A vector has two parts:

* EXACT lanes, uniform modulo 2**64 (from BLAKE2b): equal fingerprints mean equal multisets;
* NEAR lanes, modulo 2**32, which no text of under 2 GB overflows: each 3-word shingle of the paragraph
  adds 1 to or takes 1 from one lane, so the sums are a signed sketch of the shingle counts and inner
  products estimate overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import U, Words, mix

EXACT, NEAR = 4, 512
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraph_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Summed vectors of each text: (texts, EXACT) modulo 2**64 and (texts, NEAR) modulo 2**32. The empty
    text is the empty multiset; otherwise each part between newlines counts, empty ones too."""
    exact = np.zeros((len(texts), EXACT), np.uint64)
    near = np.zeros((len(texts), NEAR), np.int64)
    paragraphs, owner = [], []
    for d, t in enumerate(texts):
        for p in t.split(b"\n") if t else ():
            exact[d] += np.frombuffer(hashlib.blake2b(p, digest_size=8 * EXACT).digest(), "<u8")
            paragraphs.append(p)
            owner.append(d)
    if paragraphs:
        w = Words(paragraphs)
        h = w.hashes()
        own = np.array(owner, np.int64)
        sh, first = w.windows(3, h)
        doc = own[w.doc[first]]
        short = np.flatnonzero(w.counts[w.doc] < 3)  # of a paragraph under 3 words each word counts
        sh, doc = np.concatenate([sh, mix(h[short] + U(977))]), np.concatenate([doc, own[w.doc[short]]])
        lane = (sh % U(NEAR)).astype(np.int64)
        sign = np.where((sh >> U(40)) & U(1), 1.0, -1.0)
        near = np.bincount(doc * NEAR + lane, weights=sign, minlength=len(texts) * NEAR).astype(np.int64).reshape(len(texts), NEAR)
    return exact, near & 0xFFFFFFFF


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint vectors of the union of two multisets, or with sign -1 of what is left of the first."""
    return (a[0] + b[0] if sign > 0 else a[0] - b[0]), (a[1] + sign * b[1]) & 0xFFFFFFFF


def to_strings(exact: np.ndarray, near: np.ndarray) -> list[str]:
    """Hex of the EXACT lanes and of the NEAR lanes, little-endian, after each other."""
    e, n = exact.astype("<u8"), near.astype("<u4")
    return [e[i].tobytes().hex() + n[i].tobytes().hex() for i in range(len(e))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 a.b / (a.a + b.b) of NEAR lanes read as signed numbers, cut to 0..1: about the share of shingle
    counts that two texts have in common. Two empty sketches are alike (1)."""
    a, b = (np.where(x >= 1 << 31, x - (1 << 32), x).astype(float) for x in (a, b))
    both = (a * a).sum(-1) + (b * b).sum(-1)
    return np.where(both > 0, np.clip(2 * (a * b).sum(-1) / np.where(both > 0, both, 1), 0, 1), 1.0)


def edited_texts(texts: list[str], nexts: list[str]) -> list[str]:
    """Each text with its last floor(n/2) code points replaced by the first as many of the next."""
    return [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, nexts, strict=True)]


def fingerprint_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """:data:`RESULT` for every row, next to the row that follows by ascending doc_id.

    doc_ids are cut at quantiles into ranges; the first rows of each range are also sent to the range
    before it (the first of all to the last), so that each task meets each of its rows' successor and
    the table moves once. Ties of doc_id go by text, so of equal rows each follows the other; null
    doc_ids come first, all in one range; null texts are empty; a very long text is in memory with the
    next one. A table of one row follows itself; an empty table gives an empty result; other columns
    don't pass through.
    """
    n = max(1, partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    marks = sorted(set(marks or []))
    # Bounds are searched in two levels, some 2 * sqrt(n) comparisons a row.
    step = max(1, int(len(marks) ** 0.5))
    fine = [marks[i:i + step] for i in range(0, len(marks), step)]

    def below(bounds: list[int], c: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(m) for m in bounds]), lambda b: b <= c))

    def part(c: Column) -> Column:
        if not marks:
            return F.lit(0)
        group = below([m[0] for m in fine], c)
        own = F.element_at(F.array(*[F.array(*[F.lit(m) for m in g]) for g in fine]), group)
        inside = (group - 1) * step + F.size(F.filter(own, lambda b: b <= c))
        return F.when(c.isNull() | (c < F.lit(marks[0])), 0).otherwise(inside).cast("int")

    # Of each range that has rows: its first doc_id. At most n rows.
    heads = sorted((r["part"], r["first"]) for r in rows.groupBy(part(F.col("doc_id")).alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect())
    schema = rows.withColumn("part", F.lit(0)).withColumn("guest", F.lit(False))
    own = rows.withColumn("part", part(F.col("doc_id"))).withColumn("guest", F.lit(False))
    both = own
    if heads:
        to = {heads[i][1]["doc_id"]: heads[i - 1][0] for i in range(len(heads))}
        ids = [k for k in to if k is not None]
        home = F.lit(None).cast("int")
        if ids:
            home = F.element_at(F.create_map(*[F.lit(x) for k in ids for x in (k, to[k])]), F.col("doc_id"))
        if None in to:
            home = F.when(F.col("doc_id").isNull(), F.lit(to[None])).otherwise(home)
        # Of rows that tie in doc_id with the first of a range only the first by text is its head.
        starts = rows.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if None in to else F.lit(False))).groupBy("doc_id").agg(F.min("text").alias("text"))
        both = own.unionByName(starts.select("doc_id", "text", home.alias("part"), F.lit(True).alias("guest")))
    assert both.columns == schema.columns
    placed = both.repartitionById(len(marks) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[int, str]] = []

        def out(pairs: list[tuple[int, str]]) -> Iterator:
            ids, texts = [p[0] for p in pairs[:-1]], [p[1] for p in pairs]
            edited = edited_texts(texts[:-1], texts[1:])
            raw = [t.encode() for t in texts]
            raw_edited = [t.encode() for t in edited]
            e, v = paragraph_vectors(raw)
            ee, ev = paragraph_vectors(raw_edited)
            cols = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(b).hexdigest() for b in raw_edited], to_strings(e[:-1], v[:-1]), to_strings(ee, ev), likeness(v[:-1], ev), likeness(v[:-1], v[1:])]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

        for batch in batches:
            size = 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(row)
                size += len(row[1])
                if (size > 1 << 20 or len(held) > 1000) and len(held) > 1:
                    yield from out(held)
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield from out(held)

    return placed.select("doc_id", "text").mapInArrow(run, RESULT)
