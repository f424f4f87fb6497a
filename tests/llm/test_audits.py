"""Source divergence, spelling variants and license scans against SQL and brute force; edge cases."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.llm import divergence, html_extract, licenses, queries, variants

from test_llm import ODD, SCHEMA  # tests of one folder are importable from each other

NAMES = ["op11_divergence", "op12_spelling_variants", "op13_licenses"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5) for r in ODD], SCHEMA)


def plain(rows):
    return sorted(tuple("null" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


def by_sql(name, sf):
    con = duckdb.connect()
    one = os.path.isfile(f"{sf}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet{'' if one else '/*.parquet'}')")
    got = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in got.description]
    cols = sorted(names)
    return cols, plain(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name, sf):
    at = f"/root/testdata/{sf}"
    cols, want = by_sql(name, at)
    df = queries.queries()[name](spark, at)
    assert sorted(df.columns) == cols and plain(df.select(*cols).collect()) == want and want


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns of clashing names; no rows at all."""
    long_run = "ab" * 4000
    more = [(7, f"Wonderful {long_run} wonderful ẞtraße WONDERFUİ mit mit-license the Apache\nlicense", "en", "a", 0, 0.5), (None, "wonderfull wonderful" + " wonderful" * 30 + f" {long_run}x {long_run}", None, "a", None, 0.5), (8, "x" * 3_000_000 + " general public license licensed under CC BY-NC 4.0.", "en", "b", 1, 0.5)]
    for i, rows in enumerate(([(*r, 0.5) for r in ODD] + more, [])):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("1") for c in ("n", "term", "word", "docs", "id", "p", "bits", "labels", "matches", "rank", "value", "s", "key")})
        at = f"{tmp_path}/{i}"
        df.coalesce(1).write.parquet(f"{at}/documents.parquet")
        cols, want = by_sql(name, at)
        assert plain(queries.queries()[name](spark, at).select(*cols).collect()) == want
        assert bool(want) == bool(rows) or name == NAMES[0]


@pytest.mark.parametrize("name", NAMES)
def test_order_and_partitions_change_nothing(spark, name, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = []
    for i, df in enumerate((docs.coalesce(1).orderBy("doc_id"), docs.repartition(7, F.xxhash64("text")).sortWithinPartitions(F.desc("doc_id")))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out.append(plain(queries.queries()[name](spark, f"{tmp_path}/{i}").collect()))
    assert out[0] == out[1]


def small_corpus(seed, docs=120, sources=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice([*map(str, range(sources - 1)), None])) for i in range(docs)]


def test_divergence_by_plain_loops(spark, monkeypatch):
    """Every value again from plain counts; blocks of two sources and small words of segments change nothing."""
    rows = small_corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sums = divergence.pair_sums
    want = {}
    for lang in {r[2] or "" for r in rows}:
        own = [((r[3] or ""), Counter(r[1].split())) for r in rows if (r[2] or "") == lang]
        kept = sorted({t for _, c in own for t in c if sum(t in d for _, d in own) >= 8})
        v = len(kept)

        def probabilities(counts, kept=kept, v=v):
            n = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept]

        by = {s: sum((c for x, c in own if x == s), Counter()) for s in {x for x, _ in own}}
        p = {s: probabilities(c) for s, c in by.items()}
        q = probabilities(sum(by.values(), Counter()))
        for s in by:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in by if o != s))
            terms = sorted((b - a, t.encode(), t) for t, a, b in zip(kept, p[s], q, strict=True) if by[s][t] and a > b)
            want |= {(lang, s, "pair", o, r): -x for r, (x, _, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, r): -x for r, (x, _, t) in enumerate(terms[:5], 1)}
    for block, words in ((64, 16), (2, 1)):
        monkeypatch.setattr(divergence, "pair_sums", lambda levels, b=block, w=words: sums(levels, b, w))
        got = {(r.lang, r.source, r.part, r.item, r["rank"]): r.value for r in divergence.source_divergence(df, 8, 5).collect()}
        assert got == want


def test_joint_cells_are_counts_of_terms():
    """AND and popcount of two levels' bitsets: at how many terms one source counts a, the other b."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 64), rng.integers(0, 4, 64)
    bits = lambda x, n: sum(1 << int(i) for i in np.flatnonzero(x == n))
    for i in range(4):
        for j in range(4):
            assert (bits(a, i) & bits(b, j)).bit_count() == ((a == i) & (b == j)).sum()


def near(a, b):
    """One insertion, deletion or replacement, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [4096, 3])
def test_near_words_by_plain_loops(spark, block):
    """Few letters, so halves are shared by many and edits have several readings; keys cut in blocks too."""
    rng = random.Random(block)
    words = sorted({"".join(rng.choice("abä") for _ in range(rng.randint(3, 9))) for _ in range(400)})
    n = {w: rng.choice([1, 2, 3, 50, 700]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = variants.near_words(variants.halves(df, block)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")).collect()
    want = {}
    for w in words:
        own = sorted((-n[o], o) for o in words if near(w, o))
        if own:
            want[w] = (len(own), *own[0])
    assert {r.word: (r.n_near, r.top.n, r.top.best) for r in got} == want


def test_bit_sets_of_one_block():
    """More than 64 words in a bucket, small buckets behind it in shared words."""
    rng = random.Random(5)
    words = sorted({"abc" + "".join(rng.choice("xy") for _ in range(rng.choice([4, 5]))) for _ in range(300)})
    words = [w for w in words if len(w) in (7, 8)] * 1
    key = ["abc"] * len(words)
    for k in range(6):
        own = sorted({f"d{k}e" + "".join(rng.choice("xyz") for _ in range(rng.choice([4, 5]))) for _ in range(9)})
        words += [w.replace("0", "p").replace("1", "q").replace("2", "r").replace("3", "s").replace("4", "t").replace("5", "u") for w in own]
        key += [f"d{k}e"] * len(own)
    n = np.arange(len(words)) % 5
    count, best = variants.Block(7, "first", key, np.zeros(len(words), bool), np.zeros(len(words), int), words, n).near()
    for i, w in enumerate(words):
        own = [j for j, o in enumerate(words) if key[j] == key[i] and near(w, o) and min(len(w), len(o)) == 7]
        assert count[i] == len(own) and best[i] == min(own, key=lambda j: (-n[j], words[j]), default=-1)


def test_roots_follow_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w13"} and len(got) == 13
    assert variants.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_dropped_letters(spark):
    rows = [(i, "Marvellous marvellous things") for i in range(200)]
    got = {r.word: r.n for r in variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter()
    for i, _ in rows:
        h = zlib.crc32(f"{i}:marvellous".encode())
        want["marvellous" if h % 31 else "marvellous"[:h % 10] + "marvellous"[h % 10 + 1:]] += 2
    assert got == dict(want) and len(want) > 1


def test_filters_lose_no_template():
    """Prefix, length and positional filters against all blocks and all templates, at several thresholds."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    for threshold in (0.5, 0.8, 0.9, 1.0):
        templates = [(f"t{i % 9}", " ".join(rng.choices(vocabulary, k=rng.randint(2, 30)))) for i in range(25)]
        known = {w.encode() for _, t in templates for w in t.split()}
        index = licenses.TemplateIndex(templates, {w: rng.randint(0, 50) for w in known}, threshold)
        sets = [set(t.split()) for _, t in templates]
        found = 0
        for _ in range(60):
            words = rng.choices([*vocabulary, "other"], k=rng.randint(0, 150))
            if rng.random() < 0.5:
                words[3:3] = rng.choice(templates)[1].split()
            got = {(m["template"], m["first"]): m["containment"] for m in index.scan(*licenses.vocabulary_words(" ".join(words).encode(), index.ids))}
            want = {}
            for s in {licenses.step(len(t.split())) for _, t in templates}:
                for b in range(0, len(words), s):
                    own = set(words[b:b + 2 * s])
                    met = {k: len(own & t) / len(t) for k, t in enumerate(sets) if licenses.step(len(templates[k][1].split())) == s and len(own & t) >= licenses.needed(len(t), threshold)}
                    want |= {(k, b): c for k, c in met.items() if not any(sets[k] < sets[o] for o in met)}
            assert got == want
            found += len(want)
        assert found


def test_spans_and_labels(spark):
    text = "intro " * 20 + "Released under the MIT\nlicense. " + "x " * 50 + "Licensed under CC BY-NC 4.0."
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "licensed under cc by nd"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    a, b, c = got
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (1, 23, 23, "mit", "cc-by-nc,mit", 1.0)
    assert all(m.first <= 75 and m.last >= 81 for m in a.matches) and {m.label for m in a.matches} == {"cc-by-nc"}
    assert (b.n_words, b.labels, b.score) == (5, "", 0.0) and (c.n_words, c.n_base, c.labels, c.first_word) == (0, 0, "", None)




def test_slashes_and_buttons():
    """A slash doesn't close an element that isn't empty by itself; a button's text is no text."""
    page = "<body><article/><p>One.</p><div/>Two.<button>Send <b>now</b></button> three<br/>four</article><hr/><p>Five"
    assert [b.text for b in html_extract.blocks(page)] == ["One.", "Two.", "three four", "Five"]
    assert [html_extract.marked(b.path) for b in html_extract.blocks(page)] == [True, True, True, False]


def test_lstm_by_a_plain_loop():
    """Both directions step by step, one page at a time; other pages of the group change nothing."""
    rng = np.random.default_rng(4)
    model = html_extract.BlockLSTM(5, 3, 1)
    pages = [rng.normal(0, 1, (n, 5)) for n in (1, 4, 7, 4)]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(x, d):
        h, c, out = np.zeros(3), np.zeros(3), []
        for v in x:
            a = v @ model.p[f"W{d}"] + h @ model.p[f"U{d}"] + model.p[f"c{d}"]
            c = sig(a[:3]) * c + sig(a[3:6]) * np.tanh(a[9:])
            h = sig(a[6:9]) * np.tanh(c)
            out.append(h)
        return np.array(out)

    got = model.predict(np.concatenate(pages), [len(p) for p in pages], budget=9)
    want = [sig(np.concatenate([states(x, "f"), states(x[::-1], "b")[::-1], x], 1) @ model.p["V"][:, 0] + model.p["v"]) for x in pages]
    assert np.allclose(got, np.concatenate(want))


def test_text_of_a_page_depends_on_it_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_extract.fit(pages, rounds=4)
    a, b = (html_extract.extract(df, model).orderBy("page_id").collect() for df in (pages.coalesce(1).orderBy("page_id"), pages.repartition(9, F.xxhash64("html"))))
    assert a == b and any(r.n_chars for r in a)
