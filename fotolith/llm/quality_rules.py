"""Rule statistics of documents, and an isolation forest that finds the anomalous ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .textkernel import U, Words, chunks, mix

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_distinct", "n_lines", "n_ended", "n_bytes")
#: What the forest and the rule ensemble see, in this order.
RATIOS = ("word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_per_word", "distinct_share", "words_per_line", "ended_share")

_flags = lambda s: np.isin(np.arange(256), np.frombuffer(s, np.uint8))
_SYMBOL, _UPPER, _DIGIT = _flags(b"#*$%&|<>"), _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags(b"0123456789")
_PUNCT, _END = _flags(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _flags(b".!?\"")


def count_statistics(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` of each text. Characters are code points; letters beyond A-Z aren't
    counted as upper case; a line is what stands between newlines and has a word."""
    w = Words(blobs)
    h = w.hashes()
    doc_mix = mix(np.arange(w.n_docs, dtype=np.uint64) + U(1))
    lead = (w.buf & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": w.per_doc(lead & ~w.space)}
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = w.per_doc(flags[w.buf])
    out["n_bytes"] = np.fromiter(map(len, blobs), np.int64, len(blobs))
    sh, first = w.windows(3, h)
    _, at, n = np.unique(sh ^ doc_mix[w.doc[first]], return_inverse=True, return_counts=True)
    repeated = np.zeros(len(h), bool)
    again = first[n[at] > 1]
    for j in range(3):
        repeated[again + j] = True
    out["n_repeat_words"] = np.bincount(w.doc[repeated], minlength=w.n_docs)
    _, where = np.unique(h ^ doc_mix[w.doc], return_index=True)
    out["n_distinct"] = np.bincount(w.doc[where], minlength=w.n_docs)
    dup, lines, ended = (np.zeros(w.n_docs, np.int64) for _ in range(3))
    for d, b in enumerate(blobs):
        with_word = [x for x in b.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
        lines[d], dup[d] = len(with_word), len(with_word) - len(set(with_word))
        ended[d] = sum(x.rstrip()[-1:] in b".!?\"" for x in with_word)
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_ended": ended}


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and the counts of every whole text, and the columns ``carry`` as they are; null texts count
    as empty. ``carry`` can't be one of the columns that are added."""
    if {*COUNTS, *RATIOS, "doc_id", "anomaly", "base_failed", "kept"}.intersection(c.lower() for c in carry):
        raise ValueError("carry has the name of a column that is added")
    whole = fresh("text")[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blobs = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(blobs):
                s = count_statistics(blobs[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *[pa.array(s[c], pa.int64()) for c in COUNTS], *[batch.column(2 + i)[lo:hi] for i in range(len(carry))]], ["doc_id", *COUNTS, *carry])

    types = [*[f"{c} long" for c in COUNTS], *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]]
    return docs.select("doc_id", F.col("text").cast("string").alias(whole), *carry).mapInArrow(run, "doc_id long, " + ", ".join(types))


def with_ratios(stats: DataFrame) -> DataFrame:
    """Add :data:`RATIOS`, as double columns without nulls."""
    words, lines, size = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_bytes"))
    return stats.select(
        "*", (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbols_per_word"), (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("n_upper") / size).alias("upper_share"), (F.col("n_digits") / size).alias("digit_share"),
        (F.col("n_punct") / words).alias("punct_per_word"), (F.col("n_distinct") / words).alias("distinct_share"), F.log1p(F.col("n_words") / lines).alias("words_per_line"), (F.col("n_ended") / lines).alias("ended_share"),
    )


class IsolationForest:
    """Random splits of small samples; a row that few splits set apart is anomalous (score near 1).

    A row that lies outside the range that a node's sample had of the split's statistic is set apart
    there, so a forest grown on normal rows isolates what they don't show.
    """

    def __init__(self, sample: np.ndarray, trees: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        self.norm = self.usual(min(rows, max(len(sample), 2)))
        self.trees = []
        for _ in range(trees if len(sample) else 0):
            own = sample[rng.choice(len(sample), min(rows, len(sample)), replace=False)]
            feature, value, path = [], [], []

            def grow(at: np.ndarray, depth: int, own=own, feature=feature, value=value, path=path) -> int:
                node = len(feature)
                feature.append([-1, node, node])
                value.append((0.0, -np.inf, np.inf))
                path.append(depth + self.usual(len(at)))
                if depth < self.depth and len(at) > 1:
                    lo, hi = own[at].min(0), own[at].max(0)
                    can = np.flatnonzero(hi > lo)
                    if len(can):
                        f = int(rng.choice(can))
                        v = float(rng.uniform(lo[f], hi[f]))
                        left = own[at, f] <= v
                        feature[node] = [f, grow(at[left], depth + 1), grow(at[~left], depth + 1)]
                        value[node] = (v, lo[f], hi[f])
                        path[node] = depth + 1.0
                return node

            grow(np.arange(len(own)), 0)
            self.trees.append((np.array(feature), np.array(value), np.array(path)))

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of an unsuccessful search in a tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for nodes, value, path in self.trees:
            at = np.zeros(len(x), np.int64)
            inside = np.ones(len(x), bool)
            for _ in range(self.depth):
                f = nodes[at, 0]
                own = x[rows, f]
                inside &= (f < 0) | (own >= value[at, 1]) & (own <= value[at, 2])
                at = np.where((f < 0) | ~inside, at, nodes[at, np.where(own <= value[at, 0], 1, 2)])
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / max(self.norm, 1e-9))


def fit_forest(ratios: DataFrame, trees: int = 100, rows: int = 256, seed: int = 7) -> IsolationForest:
    """Fit on the trees * rows (25,600 by default) rows of smallest hash, of which each tree draws ``rows``:
    the subsamples that the method itself asks for, the same at every input size."""
    picked = ratios.orderBy(F.xxhash64("doc_id", *RATIOS, F.lit(seed)), "doc_id").limit(trees * rows).select(*RATIOS).collect()
    return IsolationForest(np.array(picked, float).reshape(-1, len(RATIOS)), trees, rows, seed)


def score_rows(ratios: DataFrame, forest: IsolationForest) -> DataFrame:
    """``ratios`` with ``anomaly`` (0 to 1)."""
    names = ratios.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x), pa.float64())], [*names, "anomaly"])

    return ratios.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ratios.dtypes) + ", anomaly double")


def calibrate(scores: DataFrame, labels: DataFrame, loss: float = 0.002) -> float:
    """The anomaly score above which documents go: over all labelled rows, the cut with most bad rows
    above it of those with at most ``loss`` of the good rows above. Labels come back as a histogram of
    at most 2,001 bins. Without labels of both kinds the cut is 1: nothing goes."""
    own = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    hist = (scores.select("doc_id", "anomaly").join(own, "doc_id").groupBy(F.ceil(F.col("anomaly") * 2000).alias("bin"))
            .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect())
    good, bad = sum(r["good"] for r in hist), sum(r["bad"] for r in hist)
    if not good or not bad:
        return 1.0
    best, cut, g, b = -1.0, 1.0, 0, 0
    for r in sorted(hist, key=lambda r: -r["bin"]):
        g, b = g + r["good"], b + r["bad"]
        if g <= loss * good and b / bad > best:
            best, cut = b / bad, (r["bin"] - 1) / 2000
    return cut


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat: int = 50, loss: float = 0.002, trees: int = 100, rows: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the rule counts, the columns ``carry``, :data:`RATIOS`, ``anomaly``, ``base_failed`` and ``kept``.

    The forest is grown on rows that pass the base rules and are labelled good (all that pass, if none is).

    ``base_failed``: under ``min_words`` words, or over ``max_repeat`` % of them in 3-word windows that
    come again. Of the others the forest's score decides, by the cut that :func:`calibrate` finds in
    the labelled rows that pass the base rules.

    Defined cases: one row comes out for each row that goes in; null texts count as empty and fail the
    base rules; null and repeated doc_ids are judged by their own texts, and a repeated one's label
    counts for each of its rows; equal texts get equal verdicts; a very long text is in memory whole;
    an empty table gives an empty result; other columns don't pass through unless ``carry`` names them.
    """
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    ratios = written(with_ratios(statistics(docs, carry)).withColumn("base_failed", failed), "rule-statistics")
    passed = ratios.where(~F.col("base_failed"))
    good = passed.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    forest = fit_forest(good, trees, rows)
    forest = forest if forest.trees else fit_forest(passed, trees, rows)
    cut = calibrate(score_rows(passed.select("doc_id", *RATIOS), forest), labels, loss)
    return score_rows(ratios, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(cut)))
