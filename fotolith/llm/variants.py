"""Spelling variants by a bit-sliced position index.

For a block of the vocabulary, a bitset for each (position, letter) tells which words have that
letter there. A query word is read letter by letter: the set of words that agree with it so far and
the sets of those that are one edit away are each updated for 64 words at once, by AND with the
bitset of the letter at the same position (no error, or one replaced), the next one (the word has a
letter more) or the one before (a letter less).

Two words one edit apart agree in their first or in their last half, so each block is made of words
of like length that share such a half, not of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_RUN = "[a-zA-ZÀ-ÿ]{%d,}"
_HELD = 500_000
#: Letter codes of Latin-1 bytes, 0 for none.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[192:256] = np.arange(27, 91)
_LETTERS = 91
_ONES = np.uint64(2**64 - 1)
#: Lanes (a query and 64 words) that are worked on at once.
_LANES = 1 << 18


def word_counts(docs: DataFrame, min_length: int = 7, drop: int = 31) -> DataFrame:
    """``word, n`` over all texts of ``doc_id, text``: letter runs in lower-case, those whose crc32 with their
    document's id is divisible by ``drop`` with one letter less; words of at least ``min_length`` letters."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = re.compile(_RUN % min_length).finditer
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(m[0] for m in find(text.lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > _HELD:
                    yield flush()
        yield flush()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return docs.select(plain[0].alias("doc_id"), plain[1].cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _half(s):
    """Letters of the first half: one edit of a word of ``s`` letters leaves these or the other ``s`` minus these."""
    return (s - 1) // 2


def halves(words: DataFrame, block: int) -> DataFrame:
    """``s, kind, key, cross, side, word, n``: each word under its first and last half, as the shorter of a pair
    (its own length) and as the longer (one less). Halves of one word only are left out; one of more than
    ``block`` words is cut in blocks by hash, of which each two meet under a key of their own (``cross``)."""
    size = F.char_length("word")
    both = words.withColumn("s", F.explode(F.array(size, size - 1))).withColumn("kind", F.explode(F.array(F.lit("first"), F.lit("last"))))
    first = F.floor((F.col("s") - 1) / 2).cast("int")
    key = F.when(F.col("kind") == "first", F.expr("substring(word, 1, CAST(floor((s - 1) / 2) AS INT))")).otherwise(F.expr("right(word, s - CAST(floor((s - 1) / 2) AS INT))"))
    rows = both.where(first > 0).select("s", "kind", key.alias("key"), "word", "n")
    of = ["s", "kind", "key"]
    counts = rows.groupBy(*of).agg(F.count("*").alias("held"), F.count_if(F.char_length("word") == F.col("s")).alias("short"))
    # A pair has a word of s letters; alone, or with longer words only, there is nothing to find.
    met = rows.join(counts.where("held > 1 AND short > 0"), of).withColumn("blocks", F.ceil(F.col("held") / block))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks"))
    spread = met.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return spread.select("s", "kind", F.concat_ws("/", "key", lo, hi).alias("key"), (lo != hi).alias("cross"), (F.col("mine") != lo).cast("int").alias("side"), "word", "n")


class Block:
    """Buckets of words, one after the other: words of ``s`` or ``s + 1`` letters that share a half."""

    def __init__(self, s: int, kind: str, key: list[str], cross: np.ndarray, side: np.ndarray, words: list[str], n: np.ndarray):
        self.s, self.kind, self.words, self.n, self.side = s, kind, words, n, side
        size = len(words)
        raw = np.array([w.encode("latin-1") for w in words], dtype=f"S{s + 1}")
        self.codes = _CODE[raw.view(np.uint8).reshape(size, s + 1)]
        self.long = self.codes[:, s] > 0
        order = np.lexsort((raw, -n))
        self.rank = np.empty(size, np.int64)
        self.rank[order] = np.arange(size)
        self.by_rank = order
        first = np.flatnonzero(np.concatenate([[True], np.array(key[1:], object) != np.array(key[:-1], object)]))
        sizes = np.diff(np.append(first, size))
        # Small buckets share a word of 64; a bucket that wouldn't fit begins a new one, a large one fills its words.
        start, at = np.empty(len(first), np.int64), 0
        for i, k in enumerate(sizes.tolist()):
            if at % 64 and at % 64 + k > 64:
                at += 64 - at % 64
            start[i] = at
            at += k if k <= 64 else (k + 63) // 64 * 64
        bucket = np.repeat(np.arange(len(first)), sizes)
        self.slot = start[bucket] + np.arange(size) - first[bucket]
        self.row = np.full((at + 63) // 64 * 64, -1, np.int64)
        self.row[self.slot] = np.arange(size)
        self.n_words = (at + 63) // 64
        self.word, self.bit = self.slot // 64, np.uint64(1) << (self.slot % 64).astype(np.uint64)
        self.lo, self.hi = (start // 64)[bucket], ((start + sizes - 1) // 64)[bucket]
        # Words that a query may meet: its bucket's, of a crossing key those of the other side.
        shared = sizes <= 64
        width = np.where(shared, sizes, 64).astype(np.uint64)
        ones = np.where(width == 64, _ONES, (np.uint64(1) << (width % np.uint64(64))) - np.uint64(1))
        self.own = np.where(shared, ones << (start % 64).astype(np.uint64), _ONES)[bucket]
        self.cross = cross
        self.sides = [self._set(side == x) for x in (0, 1)]
        self.short_set, self.long_set = self._set(~self.long), self._set(self.long)

    def _set(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        np.add.at(out, self.word[rows], self.bit[rows])
        return out

    def letters(self, at: int) -> np.ndarray:
        """By letter and word of 64: who has that letter at position ``at``."""
        out = np.zeros(_LETTERS * self.n_words, np.uint64)
        if 0 <= at <= self.s:
            c = self.codes[:, at].astype(np.int64)
            some = c > 0
            np.add.at(out, (c * self.n_words + self.word)[some], self.bit[some])
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of near words in the block, and the row of the best one (-1: none)."""
        count, best = np.zeros(len(self.words), np.int64), np.full(len(self.words), len(self.words), np.int64)
        for queries in (np.flatnonzero(~self.long), np.flatnonzero(self.long)):
            lanes = np.cumsum(self.hi[queries] - self.lo[queries] + 1)
            first = 0
            while first < len(queries):
                done = lanes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(lanes, done + _LANES, side="right")))
                self._search(queries[first:last], count, best)
                first = last
        return count, np.where(best < len(self.words), self.by_rank[np.minimum(best, len(self.words) - 1)], -1)

    def _search(self, rows: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
        wide = self.hi[rows] - self.lo[rows] + 1
        q = np.repeat(rows, wide)
        w = np.arange(len(q)) - np.repeat(np.cumsum(wide) - wide, wide) + self.lo[q]
        allowed = self.own[q] & np.where(self.cross[q], np.where(self.side[q] == 0, self.sides[1][w], self.sides[0][w]), _ONES)
        exact, one, more = allowed.copy(), np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        longer = bool(self.long[rows[0]])
        before, here, after = np.zeros(_LETTERS * self.n_words, np.uint64), self.letters(0), self.letters(1)
        prefix = allowed
        for i in range(self.s + longer):
            at = self.codes[q, i].astype(np.int64) * self.n_words + w
            same = here[at]
            if longer:  # the query has a letter more: the word's letters stand one place before
                one = one & before[at] | exact
            else:
                more = (more | exact) & after[at]
                one = one & same | exact & ~same
            exact = exact & same
            if i + 1 == _half(self.s):
                prefix = exact
            before, here, after = here, after, self.letters(i + 2)
        hit = one & self.short_set[w] if longer else one & self.short_set[w] | (more | exact) & self.long_set[w]
        if self.kind == "last":
            hit &= ~prefix  # these meet under their first half
        some = np.flatnonzero(hit)
        if len(some):
            np.add.at(count, q[some], np.bitwise_count(hit[some]).astype(np.int64))
            bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lane, bit = np.nonzero(bits)
            np.minimum.at(best, q[some[lane]], self.rank[self.row[w[some[lane]] * 64 + bit]])


def near_words(keyed: DataFrame, letters: int = 1 << 18) -> DataFrame:
    """``word, n_near, best_n, best`` for each key of :func:`halves`, found in blocks of whole keys of about
    ``letters`` letters; each pair of near words is met once in each direction over all keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def search(rows: list[tuple]) -> pa.RecordBatch:
            _, _, key, cross, side, words, n = zip(*rows, strict=True)
            n = np.array(n, np.int64)
            count, best = Block(rows[0][0], rows[0][1], list(key), np.array(cross), np.array(side), list(words), n).near()
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), pa.array(count[some]), pa.array(n[best[some]]), pa.array([words[i] for i in best[some]], pa.string())], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[:2] != held[0][:2] or size > letters and row[2] != held[-1][2]):
                    yield search(held)
                    held, size = [], 0
                held.append(row)
                size += row[0]
        if held:
            yield search(held)

    dealt = keyed.select("s", "kind", "key", "cross", "side", "word", "n").repartition("s", "kind", "key").sortWithinPartitions("s", "kind", "key")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: forms followed to the last one, by doubling steps until
    nothing changes. A form occurs ten times as often as its word, so there is no ring and few steps."""
    up = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        up = after.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, drop: int = 31, block: int = 4096) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``doc_id, text``, all of them.

    Words are runs of ASCII letters and U+00C0 to U+00FF, only A-Z lower-cased, with at least
    ``min_length`` letters and ``min_count`` occurrences; of a document's occurrences of a run, those
    whose ``crc32("<doc_id>:<run>")`` is divisible by ``drop`` lack the letter at that number modulo
    the run's length. Two words are near if one inserted, deleted or replaced letter parts them.
    ``form`` is the near word of largest ``n`` (then smallest) if it has ``ratio`` times the word's
    ``n``; ``root`` the last of the forms that follow, the word itself if it has none.

    Defined cases: null texts have no words; a null doc_id reads as empty in the hash; repeated rows
    count each time; ties of ``n`` go by code points; a run of any length is one word; an empty table
    gives an empty result; other columns are not read. ``min_length`` is 3 at least, else words have no
    half to share.
    """
    if min_length < 3:
        raise ValueError("min_length must be 3 at least")
    words = written(word_counts(docs, min_length, drop).where(F.col("n") >= min_count), "words")
    near = near_words(halves(words, block)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    is_form = -F.col("top.n") >= F.col("n") * ratio
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.n")).alias("form_n"))
    formed = written(formed, "forms")
    end = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
