"""Source divergence audit by count-level bitmaps.

The kept terms of a language get dense ids, frequent ones first. For each (group, count) the ids of
the terms that the group has that often form a bitset, held in words of 64 ids. In a word, the
bitsets of two groups' levels ANDed and popcounted give the joint cells: at how many terms one group
counts a and the other b. Cells times the difference of the two levels' probabilities, summed over
words, is the pair's divergence. The level of count 0 is the complement of a group's other levels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .sharding import global_prefix_sums

#: ASCII letters, lower-cased, and all bytes of other characters stay; the rest parts terms.
_TERM_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20
#: Distinct (group, term) entries a task holds before it passes its counts on.
_HELD = 300_000
SCALE, SMOOTH = 1_000_000_000, 5


def pieces(blob: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some 1 MB at a time: what ``table`` maps to a space parts words."""
    at = 0
    while at < len(blob):
        end = at + _PIECE
        while end < len(blob) and table[blob[end]] != 32:
            end += 1
        yield blob[at:end].translate(table).split(b" ")
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: counts of one task each, to be summed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, t, k, d[t]) for (lang, source), (n, d) in held.items() for t, k in n.items()]
            held.clear()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in pieces(text, _TERM_BYTES):
                    n.update(terms)
                    own.update(terms)
                n.pop(b"", None)
                own.discard(b"")
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > _HELD:
                yield flush()
        yield flush()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def kept_cells(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n`` of the terms that stand in at least ``min_docs`` documents of the language.

    One shuffle by language and term carries both sums."""
    dealt = term_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    return summed.withColumn("in_lang", F.sum("docs").over(over)).where(F.col("in_lang") >= min_docs).select("lang", "source", "term", "n")


def probability(n: str, total: str, terms: str):
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms)), in exact decimals."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(20,0))) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20,0)) AS BIGINT)")


def level_bitmaps(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, word, place, p, bits``: for each (group, count) and word of 64 term ids the bitset of the
    terms of that count, with the count's probability; count 0 is the complement."""
    at = cells.select("lang", "source", "n", F.expr("id div 64").alias("word"), F.expr("shiftleft(1L, CAST(id % 64 AS INT))").alias("bit"))
    levels = at.groupBy("lang", "word", "source", "n").agg(F.bit_or("bit").alias("bits"))
    full = levels.groupBy("lang", "word").agg(F.bit_or("bits").alias("full"))
    own = levels.groupBy("lang", "word", "source").agg(F.bit_or("bits").alias("own"))
    zero = (full.join(groups.select("lang", "source"), "lang").join(own, ["lang", "word", "source"], "left")
            .select("lang", "word", "source", F.lit(0).cast("long").alias("n"), F.col("full").bitwiseXOR(F.coalesce(F.col("own"), F.lit(0).cast("long"))).alias("bits")).where("bits <> 0"))
    both = levels.unionByName(zero).join(groups, ["lang", "source"])
    return both.select("lang", "word", "place", "sources", probability("n", "total", "terms").alias("p"), "bits")


def pair_sums(levels: DataFrame, block: int = 64, words: int = 16) -> DataFrame:
    """``lang, a, b, value`` (places of two groups, a < b): joint cells by AND and popcount, times the
    difference of the levels' probabilities, summed.

    A task's group is ``words`` words of two blocks of ``block`` sources at most, however many there are.
    """
    mine, part = F.expr(f"place div {block}"), F.expr(f"word div {words}")
    other = F.explode(F.expr(f"sequence(0L, (sources - 1) div {block})"))
    spread = levels.withColumns({"mine": mine, "part": part}).withColumn("other", other)
    spread = spread.select("lang", "part", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "word", "place", "mine", "p", "bits")

    def joint(pdf):
        import pandas as pd

        lang, lo, hi = pdf["lang"].iloc[0], int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        total = np.zeros((block, block), np.int64)
        pdf = pdf.sort_values(["word", "place"])
        word, place, mine, p, bits = (pdf[c].to_numpy() for c in ("word", "place", "mine", "p", "bits"))
        cut = np.flatnonzero(np.diff(word, prepend=-1))
        for first, last in zip(cut, [*cut[1:], len(word)], strict=True):
            own = slice(first, last)
            rows, cols = (np.flatnonzero(mine[own] == x) + first for x in (lo, hi))
            if not len(rows) or not len(cols):
                continue
            at_c = np.flatnonzero(np.diff(place[cols], prepend=-1))
            sums = []
            for r in range(0, len(rows), max(1, 1_000_000 // len(cols))):
                some = rows[r:r + max(1, 1_000_000 // len(cols))]
                cells = np.bitwise_count(bits[some].view(np.uint64)[:, None] & bits[cols].view(np.uint64)[None, :]).astype(np.int64)
                cells *= np.abs(p[some][:, None] - p[cols][None, :])
                sums.append(np.add.reduceat(cells, at_c, axis=1))
            at_r = np.flatnonzero(np.diff(place[rows], prepend=-1))
            total[np.ix_(place[rows][at_r] - lo * block, place[cols][at_c] - hi * block)] += np.add.reduceat(np.concatenate(sums), at_r, axis=0)
        a, b = np.nonzero(total)
        out = pd.DataFrame({"lang": lang, "a": a + lo * block, "b": b + hi * block, "value": total[a, b]})
        return out[out["a"] < out["b"]]

    parts = spread.groupBy("lang", "part", "lo", "hi").applyInPandas(joint, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of the columns ``text, lang, source``.

    Part ``pair``: for each other source of the language the summed difference of smoothed term
    probabilities over the language's kept terms, all of them. Part ``term``: the group's ``top``
    terms that it has more of than its language, by the difference. All arithmetic is in integers.

    Defined cases: null texts, languages and sources count as empty strings; a group without kept
    terms still has its pairs, at 0 where the language keeps no term; repeated rows count each time,
    as documents too; ties rank by the item's UTF-8 bytes; a text of any length is read in pieces of
    about 1 MB; an empty table gives an empty result; other columns are not read.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = written(kept_cells(plain, min_docs), "kept-terms")
    one = F.lit(1).cast("long").alias("one")
    totals = found.groupBy("lang", "term").agg(F.sum("n").alias("in_lang")).select("lang", "term", "in_lang", (-F.col("in_lang")).alias("neg"), one)
    ids = global_prefix_sums(totals, ["neg", "term"], {"id": "one"}, groups=["lang"]).drop("neg")
    cells = written(found.join(ids, ["lang", "term"]), "cells")
    langs = cells.groupBy("lang").agg(F.max("id").alias("last"), F.sum("n").alias("lang_total"))
    by_lang = Window.partitionBy("lang")
    groups = (plain.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), (F.coalesce("last", F.lit(-1)) + 1).alias("terms"),
                      (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(by_lang).alias("sources")))
    groups = written(groups, "groups")
    sums = pair_sums(level_bitmaps(cells, groups))
    a, b = groups.select("lang", "source", F.col("place").alias("x")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("y"))
    pairs = a.join(b, "lang").where("x <> y").select("lang", "source", "item", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    of = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(of))
    terms = cells.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (probability("n", "total", "terms") - probability("in_lang", "lang_total", "terms")).alias("value"))
    return pairs.unionByName(terms.where("value > 0").withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= top))
