"""Main text of web pages by a recurrent block labeller: a numpy bidirectional LSTM over leaf blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest_by_hash
from .textkernel import U, Words

PATH_DIM, WORD_DIM, SHAPE_DIM = 96, 32, 4
_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STEP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is never text of a page.
_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "textarea", "select", "object", "button"}
_RAW = {"script", "style", "textarea", "title"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "input", "label", "meta", "link", "base", "source"}
_VOID = {"hr", "area", "col", "embed", "param", "track"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_WORD = re.compile(r"[a-z]+")
#: Element and class names by which the training pages' blocks are marked (fixed values).
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BOILER_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "cookie", "consent", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "comment", "comments", "reply", "replies", "discussion", "respond", "share", "social", "related", "recommended", "widget", "tags", "pagination", "copyright", "legal", "disclaimer", "form", "search", "toolbar"}
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, {"article", "content", "main", "post", "entry", "story", "body"}


class Path:
    """An open element, "tag name name ...", below its parent. What the labeller reads of the whole path
    is kept as it grows (hashed tags and names as bits), so depth costs nothing a block."""

    __slots__ = ("tag", "mask", "boiler", "main")

    def __init__(self, parent: Path | None, name: str = ""):
        self.tag, *names = name.split(" ")
        self.mask = parent.mask if parent else 0
        self.boiler, self.main = (parent.boiler, parent.main) if parent else (False, False)
        if parent:
            for x in (f"<{self.tag}>", *names):
                self.mask |= 1 << _path_slot(x)
            self.boiler |= self.tag in BOILER_TAGS or bool(BOILER_NAMES.intersection(names))
            self.main |= self.tag in MAIN_TAGS or bool(MAIN_NAMES.intersection(names))


def _path_slot(name: str) -> int:
    return crc32(name.encode()) % PATH_DIM


ROOT = Path(None)


def path(*names: str) -> Path:
    at = ROOT
    for x in names:
        at = Path(at, x)
    return at


@dataclass
class Block:
    path: Path
    text: str
    linked: int  # characters inside links


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends that is open at ``at``: behind the first ``>`` outside quoted values, or the page's
    end. Each character is read once."""
    while True:
        m = _STEP.search(page, at)
        if not m:
            return len(page)
        if not m[1]:
            return m.end()
        close = page.find(m[1], m.end())
        if close < 0:
            return len(page)
        at = close + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: the text between borders of block elements, entities decoded and white
    space turned into single spaces. Unclosed elements close as browsers close them. Takes time in
    proportion to the page, however broken its markup is."""
    out: list[Block] = []
    stack: list[Path] = []
    depth: Counter[str] = Counter()  # open elements by tag
    silent = links = 0
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1] if stack else ROOT, text, linked))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)

    def shut() -> str:
        nonlocal silent
        tag = stack.pop().tag
        depth[tag] -= 1
        silent -= tag in _SILENT
        return tag

    n = len(page)
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        if not m[2]:
            comment = m[0] == "<!--"
            end = page.find("-->" if comment else ">", m.end())
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        tag, at = m[2].lower(), _tag_end(page, m.end())
        inside = page[m.end():at]
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                say(" ")
            continue
        if m[1]:
            if depth[tag]:
                flush()
                while shut() != tag:
                    pass
            continue
        flush()
        links = 0
        if tag in _VOID:  # the slash of other elements, as in <div/>, means nothing in HTML
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "body":
            while depth["head"]:
                shut()
        if tag in _CLOSES:
            while stack and stack[-1].tag in _CLOSES[tag]:
                shut()
        elif stack and stack[-1].tag == "p":
            shut()
        names = " ".join(_WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(inside)).lower()))
        stack.append(Path(stack[-1] if stack else ROOT, f"{tag} {names}" if names else tag))
        depth[tag] += 1
        silent += tag in _SILENT
    flush()
    return out


_paths: dict[tuple[int, str], np.ndarray] = {}


def _path_vector(p: Path) -> np.ndarray:
    v = _paths.get((p.mask, p.tag))
    if v is None:
        v = np.unpackbits(np.frombuffer(p.mask.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
        if p.tag:
            v[_path_slot("leaf " + p.tag)] = 1
        if len(_paths) < 50_000:  # a cache; beyond it vectors are made anew
            _paths[p.mask, p.tag] = v
    return v


def features(pages: list[list[Block]]) -> np.ndarray:
    """(blocks of all pages, dims): hashed tag path, hashed words, share of links, length, end of sentence."""
    every = [b for p in pages for b in p]
    x = np.zeros((len(every), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    if not every:
        return x
    w = Words([b.text.encode() for b in every], lower=True)
    lane = (w.hashes() % U(WORD_DIM)).astype(np.int64)
    x[:, PATH_DIM:PATH_DIM + WORD_DIM] = (np.bincount(w.doc * WORD_DIM + lane, minlength=len(every) * WORD_DIM).reshape(len(every), WORD_DIM)) / np.maximum(w.counts, 1)[:, None]
    for i, b in enumerate(every):
        x[i, :PATH_DIM] = _path_vector(b.path)
        x[i, -SHAPE_DIM:] = (min(1.0, b.linked / len(b.text)), np.log1p(len(b.text)) / 8, b.text[-1] in ".!?", 1)
    return x


def like_lengths(counts: list[int], budget: int) -> Iterator[list[int]]:
    """Numbers of the pages that have blocks, in groups of like length: a group times its longest page is at
    most ``budget`` blocks, or it is one page."""
    own: list[int] = []
    for i in sorted(range(len(counts)), key=lambda i: counts[i]):
        if own and (len(own) + 1) * counts[i] > budget:
            yield own
            own = []
        if counts[i]:
            own.append(i)
    if own:
        yield own


class BlockLSTM:
    """Bidirectional LSTM with a logistic output for each block; parameters are plain arrays."""

    def __init__(self, dims: int, hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": rng.normal(0, 0.1, (dims, 4 * hidden)), f"U{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"c{d}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        self.p |= {"V": rng.normal(0, 0.1, (2 * hidden + dims, 1)), "v": np.zeros(1)}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; ``keep`` also gives what the gradients need of each step."""
        n, t, _ = x.shape
        h = self.h
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, t, h)), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, i] + state @ self.p[f"U{d}"]
            f, g, o, z = self._sigmoid(a[:, :h]), self._sigmoid(a[:, h:2 * h]), self._sigmoid(a[:, 2 * h:3 * h]), np.tanh(a[:, 3 * h:])
            m = mask[:, i, None]
            new = f * cell + g * z
            tc = np.tanh(new)
            if keep:
                kept.append((i, state, cell, f, g, o, z, tc, m))
            cell, state = np.where(m, new, cell), np.where(m, o * tc, state)
            out[:, i] = state
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, kf = self._run(x, mask, "f", keep)
        hb, kb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb, x], 2)
        return self._sigmoid((both @ self.p["V"])[..., 0] + self.p["v"]), (both, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        prob, (both, kf, kb) = self.forward(x, mask, True)
        n, h = mask.sum(), self.h
        delta = np.where(mask, prob - y, 0) / n
        g = {"V": np.einsum("ntk,nt->k", both, delta)[:, None], "v": delta.sum(keepdims=True).reshape(1)}
        up = delta[..., None] * self.p["V"][:, 0]
        for d, kept, lo in (("f", kf, 0), ("b", kb, h)):
            dW, dU, dc = (np.zeros_like(self.p[f"{k}{d}"]) for k in "WUc")
            ds, dcell = np.zeros((len(x), h)), np.zeros((len(x), h))
            for i, state, cell, f, gi, o, z, tc, m in reversed(kept):
                ds = ds + up[:, i, lo:lo + h]
                dn = np.where(m, ds * o * (1 - tc**2) + dcell, 0)
                a = np.concatenate([dn * cell * f * (1 - f), dn * z * gi * (1 - gi), np.where(m, ds * tc, 0) * o * (1 - o), dn * gi * (1 - z**2)], 1)
                dW += x[:, i].T @ a
                dU += state.T @ a
                dc += a.sum(0)
                ds, dcell = np.where(m, 0, ds) + a @ self.p[f"U{d}"].T, np.where(m, dn * f, dcell)
            g |= {f"W{d}": dW, f"U{d}": dU, f"c{d}": dc}
        loss = -np.where(mask, y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9), 0).sum() / n
        return g, float(loss)

    def predict(self, x: np.ndarray, counts: list[int], budget: int = 8192) -> np.ndarray:
        """Chance of main text of each block; ``counts`` blocks a page. Pages of like length run together,
        ``budget`` blocks with their padding at most; a longer page runs by itself."""
        out = np.zeros(len(x))
        at = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        for own in like_lengths(counts, budget):
            px, mask, where = padded(x, at, own)
            out[where] = self.forward(px, mask)[0][mask]
        return out


def padded(x: np.ndarray, at: np.ndarray, own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of pages ``own`` as (pages, longest, dims), which of these are real, and the rows' numbers."""
    counts = [int(at[i + 1] - at[i]) for i in own]
    px, mask = np.zeros((len(own), max(counts), x.shape[1])), np.zeros((len(own), max(counts)), bool)
    for k, i in enumerate(own):
        px[k, :counts[k]], mask[k, :counts[k]] = x[at[i]:at[i + 1]], True
    return px, mask, np.concatenate([np.arange(at[i], at[i + 1]) for i in own])


def marked(p: Path) -> bool:
    """Whether the markup itself says that a block is main text: the weak label for training."""
    return p.main and not p.boiler


_LEAVES = ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td", "div")
_FRAMES = (("article",), ("main",), ("main", "article"), ("div content",), ("div main content",), ("article post",), ("div post", "div entry content"), ("section", "article"), ("div article body",))


def varied(page: list[Block], spare: list[str], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A training page rebuilt, each block with its label: its main element renamed, and boilerplate of
    other kinds put before, inside and after its main text, so that one site's template isn't all
    that is learned. A third of the rebuilt pages have no telling tag or name at all: there boilerplate is
    short or links, as it mostly is, and only words, shape and the blocks around can tell it."""
    main = [b for b in page if marked(b.path)]
    if not main or rng.random() < 0.25:
        return [(b, marked(b.path)) for b in page]
    nameless = rng.random() < 1 / 3
    made_up = lambda: "".join("bdfgklmnprstvz"[rng.integers(14)] + "aeiou"[rng.integers(5)] for _ in range(rng.integers(2, 4)))
    box_tags = ("div", "section", "ul", "p", "aside")
    bare = (("div",), (), ("table", "tr"))[rng.integers(3)] if nameless else ()
    bare_box = lambda: f"{'td' if 'tr' in bare and rng.random() < 0.7 else box_tags[rng.integers(3)]} {made_up()}"
    frame = (*bare, f"td {made_up()}" if "tr" in bare else f"{box_tags[rng.integers(2)]} {made_up()}") if nameless else _FRAMES[rng.integers(len(_FRAMES))]
    wrap = ("html", "body", *[("div", "div wrapper", "div page")[rng.integers(3)] for _ in range(rng.integers(0, 2))])

    def boiler(inside: tuple[str, ...]) -> list[tuple[Block, bool]]:
        tags, names = sorted(BOILER_TAGS), sorted(BOILER_NAMES)
        if nameless:
            box = bare_box()
        elif rng.random() < 0.45:
            box = tags[rng.integers(len(tags))]
        else:
            box = f"{box_tags[rng.integers(5)]} " + " ".join(names[i] for i in rng.choice(len(names), rng.integers(1, 3), replace=False))
        leaf = [("ul", "li"), ("p",), ("div",), (), ("div", "p"), ()][rng.integers(6)]
        at, out = path(*inside, box, *leaf), []
        for _ in range(rng.integers(1, 7 if nameless else 5)):
            text = spare[rng.integers(len(spare))]
            if nameless or rng.random() < 0.5:
                text = " ".join(text.split()[:rng.integers(1, 9)])
            out.append((Block(at, text, len(text) if rng.random() < (0.7 if nameless else 0.4) else 0), False))
        return out

    body: list[tuple[Block, bool]] = []
    inside = (*wrap, *frame)
    for b in main:
        leaf = b.path.tag if b.path.tag in _LEAVES else ("p", "h2", "blockquote", "li")[rng.integers(4)]
        body.append((Block(path(*inside, *(("ul",) if leaf == "li" else ()), leaf), b.text, b.linked), True))
        if not nameless and rng.random() < 0.08:
            body += boiler(inside)
    if rng.random() < 0.5:
        body += boiler(wrap if nameless else inside)
    before = [x for _ in range(rng.integers(0, 4)) for x in boiler(wrap)]
    after = [x for _ in range(rng.integers(0, 4)) for x in boiler(wrap)]
    return before + body + after


def fit(pages: DataFrame, rows: int = 240, page_bytes: int = 1 << 18, rounds: int = 16, repeats: int = 2, budget: int = 4096, seed: int = 2) -> BlockLSTM:
    """Train on at most ``rows`` whole pages of at most ``page_bytes`` bytes, those of smallest hash (the
    bounded training sample), whose blocks the markup marks. Each of ``rounds`` rounds makes another
    variation of each page and steps over it ``repeats`` times, by groups of ``budget`` blocks."""
    few = pages.where("html is not null").select(F.col("html").cast("string").alias("html")).where(F.octet_length("html") <= page_bytes)
    picked = smallest_by_hash(few, F.col("html"), rows).collect()
    return train([b for b in (blocks(r["html"]) for r in picked) if b], rounds, repeats, budget, seed)


def train(parsed: list[list[Block]], rounds: int = 16, repeats: int = 2, budget: int = 4096, seed: int = 2) -> BlockLSTM:
    model = BlockLSTM(PATH_DIM + WORD_DIM + SHAPE_DIM, seed=seed)
    if not parsed:
        return model
    rng = np.random.default_rng(seed)
    spare = [b.text for p in parsed for b in p]
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        own = [varied(p, spare, rng) for p in parsed]
        x, counts = features([[b for b, _ in p] for p in own]), [len(p) for p in own]
        y = np.array([main for p in own for _, main in p], float)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        for _ in range(repeats):
            groups = list(like_lengths(counts, budget))
            for i in rng.permutation(len(groups)):
                px, mask, where = padded(x, at, groups[i])
                py = np.zeros(mask.shape)
                py[mask] = y[where]
                g, _ = model.gradients(px, mask, py)
                step += 1
                for k in model.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                    model.p[k] = model.p[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def extract(pages: DataFrame, model: BlockLSTM, cut: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, and the columns ``carry``: the blocks labelled main
    text, joined by two newlines.

    Defined cases: null html counts as empty; pages without blocks, and those of which none is main,
    give ''; null page_ids and urls stay null; repeated rows each give a row; an empty table gives an
    empty result; of a very long page one page's blocks are in memory at a time; other columns don't
    pass through unless ``carry`` names them (none of the four).
    """
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(batch: pa.RecordBatch, lo: int, own: list[list[Block]]) -> pa.RecordBatch:
            prob = model.predict(features(own), [len(p) for p in own])
            texts, at = [], 0
            for p in own:
                texts.append("\n\n".join(b.text for b, q in zip(p, prob[at:at + len(p)], strict=True) if q >= cut))
                at += len(p)
            part = batch.slice(lo, len(own))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *part.columns[3:]], [*names, *carry])

        for batch in batches:
            own: list[list[Block]] = []
            lo = size = 0
            for i in range(batch.num_rows):
                own.append(blocks(batch.column(2)[i].as_py() or ""))
                size += len(own[-1])
                if size >= 8192 or len(own) == 512:
                    yield out(batch, lo, own)
                    lo, own, size = i + 1, [], 0
            if own:
                yield out(batch, lo, own)

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *carry)
    more = [f"`{c}` {kept.schema[3 + i].dataType.simpleString()}" for i, c in enumerate(carry)]
    return kept.mapInArrow(run, ", ".join(["page_id long, url string, text string, n_chars long", *more]))
