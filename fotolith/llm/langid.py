"""Language ID of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, labelled_sample
from .textkernel import U, Words, chunks, mix

TABLE = 1 << 16
ORDERS, AFFIXES = (3, 4), (1, 2, 3)
#: Emission tables: the whole word (lexicon), its n-grams, its first and its last letters.
KINDS = ("lexicon", "n-grams", "prefixes", "suffixes")


class Vocabulary:
    """The different words of a run of texts with their features: rows of the emission tables.

    A word's features are read from its own bytes with one border before and after it, never from
    its neighbours, so they are the same in every document, batch and partition.
    """

    def __init__(self, blobs: list[bytes]):
        w = Words(blobs)
        every = w.hashes()
        self.hashes, first, self.word = np.unique(every, return_index=True, return_inverse=True)
        self.doc, self.counts = w.doc, w.counts
        begin, lens = w.starts[first], w.ends[first] - w.starts[first] + 2
        start = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(lens)), lens)
        at = np.arange(len(owner)) - start[owner]
        edge = (at == 0) | (at == lens[owner] - 1)
        buf = np.where(edge, 0, w.buf[np.where(edge, 0, begin[owner] + at - 1)]).astype(np.uint8)
        letters = (buf >= 0x80) | (((buf | 32) >= 97) & ((buf | 32) <= 122))
        self.lettered = np.add.reduceat(letters.astype(np.int64), start) > 0 if len(lens) else np.zeros(0, bool)
        rows, owners, scale = [(self.hashes >> U(48)).astype(np.int64)], [np.arange(len(lens))], [np.ones(len(lens))]
        del edge
        byte = buf.astype(np.uint64) + U(1)
        gram = np.zeros(len(buf), np.uint64)
        for n in range(1, max(*ORDERS, *AFFIXES) + 2):
            # The n bytes that end here as one number, where they lie in one word.
            gram = np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) * U(0x9E3779B97F4A7C15) + byte if len(gram) else gram
            whole = at >= n - 1
            if n in ORDERS:
                here = np.flatnonzero(whole)
                rows.append(self._row("n-grams", n, gram[here]))
                owners.append(owner[here])
                scale.append(4.0 / (lens[owner[here]] - n + 1))
            if n - 1 in AFFIXES:  # the border and n - 1 letters
                for kind, here in (("prefixes", np.flatnonzero(at == n - 1)), ("suffixes", np.flatnonzero(whole & (at == lens[owner] - 1)))):
                    rows.append(self._row(kind, n, gram[here]))
                    owners.append(owner[here])
                    scale.append(np.ones(len(here)))
        self.rows, self.owner, self.scale = np.concatenate(rows, dtype=np.int32, casting="unsafe"), np.concatenate(owners, dtype=np.int32, casting="unsafe"), np.concatenate(scale, dtype=np.float32, casting="unsafe")
    @staticmethod
    def _row(kind: str, n: int, h: np.ndarray) -> np.ndarray:
        return (mix(h + U(n * 7919)) >> U(48)).astype(np.int64) + KINDS.index(kind) * TABLE

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(different words, labels): the sum of the features' weights, n-grams averaged over the word; 0 for
        words without letters."""
        out = np.stack([np.bincount(self.owner, weights=weights[self.rows, y] * self.scale, minlength=len(self.hashes)) for y in range(weights.shape[1])], 1)
        out[~self.lettered] = 0
        return out

    def gradient(self, per_word: np.ndarray, size: int) -> np.ndarray:
        """Sums over the features of a gradient on the different words' emissions."""
        g = (per_word * self.lettered[:, None])[self.owner] * self.scale[:, None]
        return np.stack([np.bincount(self.rows, weights=g[:, y], minlength=size) for y in range(g.shape[1])], 1)


def forward_backward(em: np.ndarray, trans: np.ndarray, counts: np.ndarray, block: int = 32, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of each word's label, and the expected number of each transition (only if ``pairs``).

    ``em`` holds the words of all chains after each other, ``counts`` the words of each chain. Chains
    are cut into blocks that begin with the chain. The transfer matrix of each block is formed for all
    blocks at once, the states at the blocks' borders are passed along for all chains at once, and the
    words inside are filled in for all blocks at once. All steps are elementwise over labels, so a
    chain's figures don't depend, not even in the last bit, on the chains beside it.
    """
    n, k = em.shape
    counts = np.asarray(counts, np.int64)
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    per = -(-counts // block)
    head = np.cumsum(per) - per
    place = np.arange(n) + np.repeat(head * block - (np.cumsum(counts) - counts), counts)
    nb = int(per.sum())
    e, real = np.ones((nb * block, k)), np.zeros(nb * block, bool)
    e[place], real[place] = np.exp(em - em.max(1, keepdims=True)), True
    e, real = e.reshape(nb, block, k), real.reshape(nb, block)
    opens = np.zeros(nb, bool)
    opens[head[per > 0]] = True
    a = np.exp(trans - trans.max())
    moved = lambda x: sum(x[..., i, None] * a[i] for i in range(k))  # noqa: E731  x @ a
    back = lambda x: sum(x[..., j, None] * a[:, j] for j in range(k))  # noqa: E731  a @ x
    total = lambda x: sum(x[..., i] for i in range(k))[..., None]

    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        step = moved(m)
        if t == 0:  # nothing comes before a chain's first word
            step[opens] = total(m)[opens] / k
        step = step * e[:, t, None, :]
        step = step / total(total(step)[..., 0])[..., None]
        m = np.where(real[:, t, None, None], step, m)
    into, out = np.full((nb, k), 1.0 / k), np.full((nb, k), 1.0 / k)
    for o in range(1, int(per.max())):
        at = head[per > o] + o
        v = sum(into[at - 1][:, i, None] * m[at - 1][:, i, :] for i in range(k))
        into[at] = v / total(v)
    for o in range(int(per.max()) - 2, -1, -1):
        at = head[per > o + 1] + o
        v = sum(m[at + 1][:, :, j] * out[at + 1][:, j, None] for j in range(k))
        out[at] = v / total(v)
    del m
    alpha = np.empty((nb, block, k))
    right = np.empty((nb, block, k)) if pairs else None
    f = into
    for t in range(block):
        step = moved(f)
        if t == 0:
            step[opens] = 1.0 / k
        step = step * e[:, t]
        f = np.where(real[:, t, None], step / total(step), f)
        alpha[:, t] = f
    post = np.empty((nb, block, k)) if pairs else alpha  # in place where alpha isn't needed further
    for t in range(block - 1, -1, -1):
        p = alpha[:, t] * out
        post[:, t] = p / total(p)
        r = out * e[:, t]
        if pairs:
            right[:, t] = r
        step = back(r)
        out = np.where(real[:, t, None], step / total(step), out)
    del e
    post = post.reshape(-1, k)[place]
    if not pairs:
        return post, None
    alpha, right = (x.reshape(-1, k)[place] for x in (alpha, right))
    inner = np.ones(n, bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    x, y = alpha[:-1][inner[1:]], right[1:][inner[1:]]
    return post, a * (x.T @ (y / total(moved(x) * y)))


def log_likelihood(em: np.ndarray, trans: np.ndarray, labels: np.ndarray) -> float:
    """Log-chance of the labels of one chain (first labels are alike before the words are seen)."""
    v = em[0].astype(float)
    for t in range(1, len(em)):
        v = np.logaddexp.reduce(v[:, None] + trans, axis=0) + em[t]
    own = em[np.arange(len(em)), labels].sum() + trans[labels[:-1], labels[1:]].sum()
    return float(own - np.logaddexp.reduce(v))


class LanguageField:
    """Emission weights (tables * TABLE, labels) and transitions between labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    def posteriors(self, words: Vocabulary) -> np.ndarray:
        return forward_backward(words.emissions(self.weights)[words.word], self.trans, words.counts, pairs=False)[0]


def train(texts: list[str], langs: list[str], passes: int = 2, run: int = 24, chain: int = 256, batch: int = 16_000, seed: int = 5) -> LanguageField:
    """Fit by Adam steps on the log-likelihood of chains, over all words of all ``texts``.

    Training chains switch language as code-switched text does: each document gives its words in
    pieces of 1 to ``run`` words, the pieces are shuffled, and about ``chain`` words follow each other
    in a chain. Every word's label is its document's language. Words of languages with fewer words
    weigh more, by the share of the largest one's words over theirs, up to 8. A step reads about
    ``batch`` words; every word is read ``passes`` times.
    """
    labels = sorted(set(langs))
    k, size = len(labels), len(KINDS) * TABLE
    if k < 2:
        return LanguageField(labels, np.zeros((size, max(k, 1))), np.zeros((max(k, 1),) * 2))
    rng = np.random.default_rng(seed)
    pieces: list[tuple[list[bytes], int]] = []
    for t, lang in zip(texts, langs, strict=True):
        w = t.lower().encode().split()
        i, y = 0, labels.index(lang)
        while i < len(w):
            n = int(rng.integers(1, run + 1))
            pieces.append((w[i:i + n], y))
            i += n
    own = np.bincount([y for _, y in pieces], weights=[len(p) for p, _ in pieces], minlength=k)
    weigh = np.clip(own.max() / np.maximum(own, 1), 1, 8)
    weights, trans = np.zeros((size, k)), np.zeros((k, k))
    m1, m2, t1, t2 = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(pieces))
        i = 0
        while i < len(order):
            chains: list[tuple[list[bytes], list[int]]] = []
            read = 0
            while i < len(order) and read < batch:
                words, marks = [], []
                while i < len(order) and len(words) < chain:
                    p, y = pieces[order[i]]
                    words += p
                    marks += [y] * len(p)
                    i += 1
                chains.append((words, marks))
                read += len(words)
            v = Vocabulary([b" ".join(c) for c, _ in chains])
            y = np.concatenate([np.array(m) for _, m in chains])
            gold = np.eye(k)[y]
            post, pairs = forward_backward(v.emissions(weights)[v.word], trans, v.counts)
            g = (gold - post) * weigh[y][:, None]
            per_word = np.stack([np.bincount(v.word, weights=g[:, c], minlength=len(v.hashes)) for c in range(k)], 1)
            grad = v.gradient(per_word, size) / len(y) - 1e-6 * weights
            inner = v.doc[1:] == v.doc[:-1]
            tg = (gold[:-1][inner].T @ gold[1:][inner] - pairs) / len(y)
            step += 1
            for p, d, a, b, rate in ((weights, grad, m1, m2, 0.15), (trans, tg, t1, t2, 0.1)):
                a *= 0.9
                a += 0.1 * d
                b *= 0.99
                b += 0.01 * d * d
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return LanguageField(labels, weights.astype(np.float32), trans)


def fit(docs: DataFrame, rows: int = 2000) -> LanguageField:
    """Learn from the whole texts of at most ``rows`` labelled rows, the bounded training sample: an equal
    share of each language (:func:`~.common.labelled_sample`, which also settles texts that stand there
    with several languages). Rows without text or lang don't count; without any there are no labels."""
    known = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    picked = labelled_sample(known, "text", "lang", rows).collect()
    return train([r["text"] for r in picked], [r["label"] for r in picked])


def predict(docs: DataFrame, model: LanguageField, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``carry`` for every row: the label of most posterior mass
    over the whole text's words with letters, and its share.

    A row's result depends on its text and the model alone. Defined cases: null texts and texts
    without a letter are ``und`` with score 0; equal texts have equal results; labels that tie go to
    the first by code point; a very long text is a chain of its own, in memory in proportion to it;
    an empty table gives an empty result; other columns don't pass through unless ``carry`` names them.
    """
    if {"lang_pred", "score"}.intersection(c.lower() for c in carry):
        raise ValueError("carry can't be lang_pred or score")
    names = [*carry, "lang_pred", "score"] if "doc_id" in carry else ["doc_id", *carry, "lang_pred", "score"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = len(model.labels)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # texts leave Arrow a few at a time
                batch = whole.slice(at, 512)
                texts = batch.column(0).to_pylist()
                blobs = [(t or "").lower().encode() for t in texts]
                for lo, hi in chunks(blobs, 1 << 19):
                    v = Vocabulary(blobs[lo:hi])
                    has = v.lettered[v.word]
                    doc = v.doc[has]
                    n = np.bincount(doc, minlength=hi - lo)
                    if k > 1:
                        post = model.posteriors(v)[has]
                        mass = np.stack([np.bincount(doc, weights=post[:, y], minlength=hi - lo) for y in range(k)], 1)
                    else:
                        mass = n[:, None].astype(float)
                    share = mass / np.maximum(n, 1)[:, None]
                    best = share.argmax(1)
                    know = [n[i] > 0 and k > 0 and any(c.isalpha() for c in texts[lo + i]) for i in range(hi - lo)]
                    told = [model.labels[best[i]] if know[i] else "und" for i in range(hi - lo)]
                    score = [float(min(1.0, share[i, best[i]])) if know[i] else 0.0 for i in range(hi - lo)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(j)[lo:hi] for j in range(1, batch.num_columns)], pa.array(told, pa.string()), pa.array(score, pa.float64())], names)

    kept = docs.select(F.col("text").cast("string").alias(fresh("text")[0]), *names[:-2])
    schema = [f"`{c}` {kept.schema[1 + i].dataType.simpleString()}" for i, c in enumerate(names[:-2])]
    return kept.mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))
