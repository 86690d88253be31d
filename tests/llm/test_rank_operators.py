"""Source divergence, ranked search and language identification: brute force on small tables, edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scorefold.llm import divergence, language_id, ranked_search
from scorefold.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, item_id string, shard int, term string, k int, q int, score string, n long, y int, row string, h int, kind int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source); the other columns carry names that operators use inside."""
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], DOCS)


# ---------------------------------------------------------------- divergence

def divergences(rows, least=3, top=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    docs, count, groups = defaultdict(int), Counter(), {(g, s) for _, g, s in rows}
    for t, g, s in rows:
        found = WORD.findall(t.translate(LOWER))
        for w in set(found):
            docs[g, w] += 1
        for w in found:
            count[g, s, w] += 1
    out = set()
    for g in {g for g, _ in groups}:
        kept = [w for (x, w), n in docs.items() if x == g and n >= least]
        sources = sorted(s for x, s in groups if x == g)

        def share(counts):
            whole = sum(counts.values()) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // whole for w in kept}

        shares = {s: share({w: count[g, s, w] for w in kept}) for s in sources}
        whole = share({w: sum(count[g, s, w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(sum((p - shares[o][w]) ** 2 // shares[o][w] for w, p in shares[s].items()), o) for o in sources if o != s]
            own = [((p - whole[w]) ** 2 // whole[w], w) for w, p in shares[s].items() if count[g, s, w] and p > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(g, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def some_rows(n=300, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"{c}{d}" for c in "abcdefgh" for d in "aeiouéß漢"] + ["The", "THE", "it's", "x1y"]
    rows = []
    for k in range(n):
        size = int(rng.integers(0, 40))
        text = " ".join(rng.choice(names, size, p=np.arange(len(names), 0, -1) / (len(names) * (len(names) + 1) / 2)))
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(0, 5)}"
        rows.append((k, text, ["en", "de", None][int(rng.integers(0, 3))], source if rng.random() > 0.1 else None))
    return [*rows, *rows[:20], (None, None, None, None), (900, "", "en", "quiet"), (901, "same same", "fr", "a"), (901, "same same", "fr", "a"), (902, "same", "fr", "b"), (903, None, "xx", "none")]


def as_rows(df):
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]


def test_divergence_against_brute_force(spark):
    rows = some_rows()
    got = as_rows(divergence.divergences(frame(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == divergences(rows)
    got = as_rows(divergence.divergences(frame(spark, rows), least=1, top=3))
    assert set(got) == divergences(rows, 1, 3)


def test_divergence_of_long_texts_and_empty_tables(spark):
    assert divergence.divergences(frame(spark, [])).count() == 0
    rows = [(0, "word " * 400_000 + "z" * 100_000, "en", "a"), (1, "word other", "en", "b"), (2, "word", "en", "b"), (3, "1 2 3", "en", "c")]
    assert set(as_rows(divergence.divergences(frame(spark, rows)))) == divergences(rows)


def test_merge_streams_by_whole_terms(monkeypatch):
    """Many small runs whose chunks split terms give the counts of one dictionary, and little is held at a time."""
    monkeypatch.setattr(divergence, "CHUNK", 3)
    monkeypatch.setattr(divergence, "MEMORY", 40)
    rows = [(t or "", g or "", s or "") for _, t, g, s in some_rows(120)]
    want = Counter()
    for t, g, s in rows:
        for w in WORD.findall(t.translate(LOWER)):
            want[g, s, w.encode()] += 1
    batches = [pa.RecordBatch.from_pylist([{"lang": g, "source": s, "text": t} for t, g, s in rows[a : a + 7]]) for a in range(0, len(rows), 7)]
    chunks = [r for b in divergence._runs(4)(iter(batches)) for r in b.to_pylist()]
    assert all(len(c["term"]) <= 3 and c["term"][0] == c["head"] and c["term"] == sorted(c["term"]) for c in chunks)
    got, kept = Counter(), Counter()
    for shard in range(4):
        mine = sorted((c for c in chunks if c["shard"] == shard), key=lambda c: (c["lang"], c["head"]))
        schema = pa.schema([("lang", pa.string()), ("head", pa.binary()), ("term", pa.list_(pa.binary())), ("source", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
        parts = [pa.RecordBatch.from_pylist(mine[a : a + 5], schema=schema) for a in range(0, len(mine), 5)]
        for b in divergence._merge(1)(iter(parts)):
            for r in b.to_pylist():
                if r["kind"] == divergence.TERMS:
                    got.update({(r["lang"], s, t): n for t, s, n in zip(r["term"], r["sources"], r["ns"])})
                    kept[r["lang"]] += len(set(r["term"]))
                elif r["kind"] == divergence.KEPT:
                    kept[r["lang"]] -= r["n"]
    assert got == want and not any(kept.values())


def test_shares_are_exact():
    counts, whole = np.array([0, 5, 10**12 - 1, 2**52]), np.array([1, 7, 10**12, 2**52 + 1])
    assert divergence.share(counts, whole).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(counts.tolist(), whole.tolist())]


# ---------------------------------------------------------------- search

def ranked(docs, queries, top=10):
    texts = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, tokens = sum(map(bool, texts)), sum(map(len, texts))
    df = Counter(w for t in texts for w in set(t))
    out = []
    for item, q in queries:
        wanted = set(TERM.findall((q or "").translate(LOWER)))
        scores = []
        for (key, _), found in zip(docs, texts):
            counts, m = Counter(found), 10 + (90 * len(found) * n) // max(tokens, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * counts[w] // (1000 * counts[w] + 8 * m)) for w in wanted if counts[w])
            if s > 0:
                scores.append((-s, -(2**63) if key is None else key))
        for rank, (s, key) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if key == -(2**63) else key, -s))
    return sorted(out, key=str)


def searched(spark, docs, queries, **more):
    index = ranked_search.build(frame(spark, [(k, t, None, None) for k, t in docs]))
    asked = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id string, text string, q int")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(index, asked, **more).collect()), key=str)


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    names = np.array([f"w{k}" for k in range(400)])
    p = 1 / np.arange(1, 401)
    docs = [(int(k), " ".join(rng.choice(names, int(rng.integers(1, 60)), p=p / p.sum()))) for k in rng.permutation(9000)]
    docs += docs[:300] + [(None, "w0 w399"), (None, None), (20_000, ""), (20_001, "W0 w0 É é 漢字 w399"), (20_002, "w1 " * 70_000)]
    queries = [(f"i{k}", " ".join(rng.choice(names, int(rng.integers(1, 30))))) for k in range(25)]
    queries += [("none", None), ("empty", "  "), ("same", "w399 w399 unknown"), ("same", "w399"), (None, "É 漢字"), ("all", "w0")]
    assert searched(spark, docs, queries) == ranked(docs, queries)
    assert searched(spark, docs, queries, top=3) == ranked(docs, queries, 3)


def test_search_without_documents_or_queries(spark):
    assert searched(spark, [], [("a", "b")]) == [] == searched(spark, [(1, "b")], []) == searched(spark, [(1, None)], [("a", "b")])


def test_search_skips_blocks(monkeypatch):
    """Blocks that cannot hold a result are not decoded, and the result is the same as with all of them."""
    rng = np.random.default_rng(4)
    texts = [" ".join(["common"] * int(rng.integers(1, 4)) + (["rare"] if k in (5, 6, 9000) else []) + ["pad"] * int(rng.integers(0, 50))) for k in range(10_000)]
    monkeypatch.setattr(ranked_search, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["k", "text"])
    (shard,) = ranked_search._shards(iter([rows]))
    block = ranked_search.Queries(["a"], ["common rare"])
    weights = np.array([{"common": 50, "rare": 8000}[t] for t in block.names.cast(pa.string()).to_pylist()])
    tokens = sum(len(t.split()) for t in texts)
    lists = ranked_search.Lists(shard, 0, block.names, weights, len(texts), tokens)
    decoded = []
    whole = lists.decoded
    monkeypatch.setattr(lists, "decoded", lambda which: (decoded.append(len(which)), whole(which))[1])
    best = ranked_search.Best(2)
    ranked_search.search_shard(lists, block.terms[0], best)
    counts = [Counter(t.split()) for t in texts]
    m = [10 + 90 * sum(c.values()) * len(texts) // tokens for c in counts]
    scores = [sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m[k])) for t, w in (("common", 50), ("rare", 8000)) if c[t]) for k, c in enumerate(counts)]
    assert best.keys.tolist() == sorted(range(len(texts)), key=lambda k: (-scores[k], k))[:2]
    assert sum(decoded) < len(lists.sizes) / 3


# ---------------------------------------------------------------- language

@pytest.fixture(scope="module")
def vocab():
    return language_id.vocabulary(language_id.vocabulary_path())


def pieces_of(path):
    import base64

    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()} | {bytes([b]) for b in range(256)}
    return sorted(p for p in found if len(p) <= language_id.LONGEST)


def all_cuts(word, p, of):
    """Sum over all segmentations, one at a time."""
    if not word:
        return 1.0
    return sum(p[of[word[:k]]] * all_cuts(word[k:], p, of) for k in range(1, len(word) + 1) if word[:k] in of)


def uses_of(word, p, of):
    """Total probability of all segmentations, and of those times the uses of each piece."""
    def walk(rest, used, prob):
        if not rest:
            yield prob, used
        for k in range(1, len(rest) + 1):
            if rest[:k] in of:
                yield from walk(rest[k:], [*used, of[rest[:k]]], prob * p[of[rest[:k]]])

    total, uses = 0.0, Counter()
    for prob, used in walk(word, [], 1.0):
        total += prob
        for u in used:
            uses[u] += prob
    return {u: v / total for u, v in uses.items()}


def test_forward_sums_all_segmentations(vocab):
    of = {w: k for k, w in enumerate(pieces_of(language_id.vocabulary_path()))}
    assert vocab.size == len(of)
    rng = np.random.default_rng(1)
    p = rng.random((vocab.size + 1, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    texts = ["the", "Über", "nation", "x", "漢字", "aaaaaa", "q9-!"]
    spans = words(pa.array(texts))
    assert len(spans.starts) == len(texts)
    got = language_id.word_scores(spans, np.arange(len(texts)), vocab, p)
    lowered = [b" " + t.translate(LOWER).encode() for t in texts]
    for k in range(2):
        assert np.allclose(got[:, k], [math.log(all_cuts(w, p[:, k], of)) for w in lowered], rtol=1e-9)
    counts = rng.integers(1, 5, (len(texts), 2)).astype(float)
    found = language_id.expected(spans, counts, vocab, p)
    for k in range(2):
        want = np.zeros(vocab.size + 1)
        for w, c in zip(lowered, counts[:, k]):
            for piece, n in uses_of(w, p[:, k], of).items():
                want[piece] += c * n
        assert np.allclose(found[:, k], want, rtol=1e-8, atol=1e-12)


def test_long_words_do_not_underflow(vocab):
    p = np.full((vocab.size + 1, 1), 1 / vocab.size)
    p[-1] = 0
    spans = words(pa.array(["zq" * 20_000, "zq" * 40]))
    one = language_id.word_scores(spans, np.array([0, 1]), vocab, p)[:, 0]
    assert np.isfinite(one).all() and one[0] < one[1] < 0


def test_predictions(spark):
    import zlib

    rng = np.random.default_rng(2)
    stock = {"aa": ["the", "nation", "was", "here"], "bb": ["der", "nicht", "über", "und"], "cc": ["le", "été", "dans", "où"]}
    rows = []
    for k in range(300):
        lang = sorted(stock)[k % 3]
        rows.append((k, " ".join(rng.choice(stock[lang], 12)), lang if k % 10 else None, "s"))
    odd = [(1000, None, "aa", None), (1001, "", "aa", "s"), (1002, "123 ... !!", "bb", "s"), (1003, "und " * 100_000, None, "s"), (None, "le été", "cc", None), (1004, "漢字", None, "s")]
    rows += [*odd, *rows[:5]]
    df = frame(spark, rows)
    model = language_id.fit(df, language_id.vocabulary_path(), rounds=2)
    assert model.langs == ["aa", "bb", "cc"] and np.allclose(model.p.sum(axis=0), 1)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by_id[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003][0] == "bb" and by_id[None][0] == "cc" and by_id[1004][0] in model.langs
    assert all(by_id[k][0] == sorted(stock)[k % 3] for k in range(300))
    # The held-out fold teaches nothing.
    held = [r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    changed = frame(spark, [(k, "the the the" if k in held else t, "zz" if k in held else g, s) for k, t, g, s in rows])
    again = language_id.fit(changed, language_id.vocabulary_path(), rounds=2)
    assert again.langs == model.langs and np.allclose(again.p, model.p)


def test_predictions_without_anything(spark):
    path = language_id.vocabulary_path()
    nothing = frame(spark, [])
    assert language_id.predict(nothing, language_id.fit(nothing, path)).count() == 0
    unlabelled = frame(spark, [(1, "text", None, None)])
    assert [(r.lang_pred, r.score) for r in language_id.predict(unlabelled, language_id.fit(unlabelled, path)).collect()] == [("und", 0.0)]
