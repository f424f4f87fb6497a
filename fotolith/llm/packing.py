"""Packing tokenised documents into fixed-length sequences by vector bin packing."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: How a byte-level BPE of this kind splits a text into words before it merges.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = 500


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others are numbered on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_bpe(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE of which ids alone say what merges first: ids rise with
    the merges, and each longer token is what one merge gives, and one only."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    if len(set(made)) < len(made) or {t for t in model["vocab"] if len(t) > 1 and t not in added} != set(made):
        return False
    return all(a < b for a, b in itertools.pairwise(model["vocab"][t] for t in made))


class TextTokenizer:
    """Ids of whole texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    A byte-level BPE whose ids rise with its merges is also a table of ranks, which tiktoken merges by
    at a third of the time. The library itself encodes what that way isn't made for: other kinds of
    files, texts with an added token's string, and texts with words or white space of
    :data:`_PROBE` characters and more, on which the merge by ranks takes quadratic time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if _plain_bpe(spec):
            import tiktoken

            of, added = _byte_of(), set(self.added)
            ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
            self.fast = tiktoken.Encoding("byte-level", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _ordinary(self, text: str) -> bool:
        for i in range(0, len(text) - _PROBE + 1, _PROBE):
            part = text[i:i + _PROBE]
            if " " not in part or part.isspace():
                return False
        return not any(t in text for t in self.added)

    def encode(self, text: str) -> np.ndarray:
        if self.fast and self._ordinary(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


def dot_product_pack(sizes: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Bins of item numbers by the dot-product heuristic.

    ``sizes`` is (items, dimensions), ``capacity`` the limit of each dimension. A bin takes, one
    after another, the item that fits and has the largest weighted dot product of its needs and
    what the bin has left; a dimension weighs as much as the items ask for of it. Items of equal
    needs are one kind, so a step looks at the kinds left, not at the items.
    """
    share = sizes / capacity
    kinds, kind_of = np.unique(share, axis=0, return_inverse=True)
    items = [list(x) for x in np.split(np.argsort(kind_of.ravel(), kind="stable"), np.cumsum(np.bincount(kind_of.ravel(), minlength=len(kinds)))[:-1])]
    left = np.array([len(x) for x in items])
    weight = share.mean(0) if len(share) else share
    need = kinds * weight
    alive = np.arange(len(kinds))
    bins: list[list[int]] = []
    while len(alive):
        room, members = np.ones(kinds.shape[1]), []
        k = kinds[alive]
        while True:
            fits = (k <= room + 1e-12).all(1) & (left[alive] > 0)
            if not fits.any():
                break
            best = alive[np.argmax(np.where(fits, need[alive] @ room, -1.0))]
            members.append(int(items[best].pop()))
            left[best] -= 1
            room = room - kinds[best]
        if not members:
            raise ValueError("an item exceeds a limit by itself; cut it first")
        bins.append(members)
        alive = alive[left[alive] > 0]
    return bins


def pack_rest(tokens: np.ndarray, loss: np.ndarray, length: int, segments: int, loss_limit: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, to): dot-product packing of items under ``length`` tokens, ``segments`` pieces
    and ``loss_limit`` loss-bearing tokens. Bins with room are then filled by cutting up the items of
    the emptiest bins, last bin first; each id stays in one piece."""
    bins = dot_product_pack(np.stack([tokens, np.ones_like(tokens), loss], 1).astype(float), np.array([length, segments, loss_limit], float))
    out = [[(i, 0, int(tokens[i])) for i in b] for b in bins]
    fill = [sum(int(tokens[i]) for i in b) for b in bins]
    burden = [float(sum(loss[i] for i in b)) for b in bins]
    order = sorted(range(len(out)), key=lambda b: -fill[b])
    last = len(order) - 1
    for k, b in enumerate(order):
        while k < last and fill[b] < length and len(out[b]) < segments and burden[b] < loss_limit:
            give = order[last]
            if not out[give]:
                last -= 1
                continue
            i, a, e = out[give].pop()
            rate = loss[i] / max(int(tokens[i]), 1)
            n = min(e - a, length - fill[b], int((loss_limit - burden[b]) / rate) if rate else e - a)
            if n <= 0:
                out[give].append((i, a, e))
                break
            if n < e - a:
                out[give].append((i, a + n, e))
            out[b].append((i, a, a + n))
            for x, d in ((b, n), (give, -n)):
                fill[x] += d
                burden[x] += d * rate
    return [b for b in out if b]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, segments: int = 128, loss_limit: int | None = None, loss: str | None = None, end_id: int = 1, window: int = 4096) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``.

    A document is its text's ids and ``end_id``. Full ``length``s of a document are sequences of their
    own; rests are packed in windows of ``window`` by :func:`pack_rest` under limits on tokens,
    ``segments`` and loss-bearing tokens (``loss_limit``, at most ``length``). ``loss`` names a column
    with the share of a row's ids that bear loss (default 1 for each). Limits of 0 or less fail.

    Each input partition packs its own rows, so nothing is shuffled and at most its last sequence
    has room; what a window leaves in its emptiest bin goes into the next one. A sequence's id has
    the partition in its upper bits. Over a table read from files a task that runs again gives the
    same rows.

    Defined cases: null and empty texts are ``end_id`` alone; null and repeated doc_ids stay as they are,
    and equal rows are packed each; a very long text fills sequences of its own, its ids in memory
    whole; an empty table gives an empty result; other columns don't pass through.
    """
    limit = loss_limit or length
    if min(length, segments, limit, window) < 1:
        raise ValueError("limits must be positive")
    columns = ["doc_id", "text", *([loss] if loss else [])]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tok = TextTokenizer(tokenizer)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        carry: list[tuple] = []  # (doc_id, ids, start, doc_tokens, share of loss)

        def frame(rows: list[tuple]) -> Iterator:
            for i in range(0, len(rows), 2000):
                cols = list(zip(*rows[i:i + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if j == 3 else pa.int64()) for j, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def full(final: bool) -> list[tuple]:
            nonlocal sequence, carry
            n = np.array([len(c[1]) for c in carry])
            bins = pack_rest(n, n * np.array([c[4] for c in carry]), length, segments, limit)
            keep = []
            if not final and len(bins) > 1:  # the emptiest waits for more
                keep = bins.pop(min(range(len(bins)), key=lambda b: sum(e - a for _, a, e in bins[b])))
            rows = []
            for b in bins:
                at = 0
                for i, a, e in b:
                    doc, ids, start, total, _ = carry[i]
                    rows.append((doc, start + a, e - a, ids[a:e].tobytes(), total, sequence, at))
                    at += e - a
                sequence += 1
            carry = [(carry[i][0], carry[i][1][a:e], carry[i][2] + a, carry[i][3], carry[i][4]) for i, a, e in keep]
            return rows

        for batch in batches:
            d = batch.to_pydict()
            shares = d[loss] if loss else [1.0] * len(d["doc_id"])
            for lo in range(0, len(shares), 512):
                rows = []
                for doc, text, share in zip(d["doc_id"][lo:lo + 512], d["text"][lo:lo + 512], shares[lo:lo + 512], strict=True):
                    ids = np.append(tok.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    share = min(max(share or 0.0, 0.0), 1.0)
                    step = length if share * length <= limit else max(1, int(limit / share))
                    whole = len(ids) // step * step
                    for a in range(0, whole, step):
                        rows.append((doc, a, step, ids[a:a + step].tobytes(), len(ids), sequence, 0))
                        sequence += 1
                    if whole < len(ids):
                        carry.append((doc, ids[whole:].copy(), whole, len(ids), share))
                if len(carry) >= window:
                    rows += full(False)
                yield from frame(rows)
        if carry:
            yield from frame(full(True))

    return docs.select(*columns).mapInArrow(run, PIECES)
