"""Near-dedup, embeddings, classifiers, language model, pipeline: brute force on small tables."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

import corpus_pipeline
from scorefold.llm import common, embedding_dedup, katz_lm, minhash_dedup, quality, toxicity
from scorefold.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k int, id int, component_id int, kept int, __x int, score int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 6) for i, t in rows], DOCS)


def random_text(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, share):
    return " ".join("zz" + w if rng.random() < share else w for w in text.split())


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_agree_as_often_as_weighted_sets_overlap():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    wa = rng.random(400) * 5 + 0.1
    wb = wa.copy()
    wb[:80] *= 0.2
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    salts = minhash_dedup._SALTS
    minhash_dedup._SALTS = np.random.default_rng(2).integers(0, 2**64, 2000, dtype=np.uint64) | np.uint64(1)
    try:
        x, y = (minhash_dedup.samples(a, w, np.array([400])) for w in (wa, wb))
    finally:
        minhash_dedup._SALTS = salts
    assert abs((x == y).mean() - want) < 0.04


def test_minhash_finds_near_copies(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(60)]
    rows = list(enumerate(texts))
    passage = random_text(rng, 60)
    for i in range(20):
        rows.append((1000 + i, edited(rng, texts[i], 0.01)))
        rows.append((2000 + i, texts[i].upper() if i % 2 else texts[i]))
        rows.append((3000 + i, random_text(rng, 200) + " " + passage))
    rows += [(4000 + i, edited(rng, texts[30], 0.005)) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One Two"), (None, "one two"), (0, texts[0])]
    got = minhash_dedup.classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert comp[5000] == comp[5001] == comp[5002] == 5000 and comp[5003] == comp[5004] == 5003
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i in range(20):
        assert comp[2000 + i] == comp[i]
        assert comp[3000 + i] == 3000 + i
        both = len(sets[i] & sets[1000 + i]) / len(sets[i] | sets[1000 + i])
        assert (comp[1000 + i] == comp[i]) or both < 0.84
    assert sum(comp[4000 + i] == comp[30] for i in range(120)) >= 118
    kept = minhash_dedup.keep(docs(spark, rows))
    assert kept.columns == docs(spark, rows[:1]).columns
    assert len({r.doc_id for r in kept.collect()}) == len({r.component_id for r in got})
    assert minhash_dedup.classes(docs(spark, [])).count() == 0


def near_pairs(spark, rows, least=minhash_dedup.LEAST):
    """Weighted Jaccard similarity of all pairs of texts (key, text), and the smallest key of each true component."""
    idf = minhash_dedup.frequencies(docs(spark, rows))
    made, count, per_text, *_ = minhash_dedup.shingles(pa.array([t or "" for _, t in rows]))
    weight = minhash_dedup.weights_of(made, count, idf)
    ends = np.cumsum(per_text)
    sets = [(made[a:b], weight[a:b]) for a, b in zip(ends - per_text, ends)]
    keys = np.array([i for i, _ in rows])
    holders = defaultdict(list)
    for t, (m, _) in enumerate(sets):
        for x in m.tolist():
            holders[x].append(t)
    sim = np.eye(len(rows))
    for a, b in {(a, b) for at in holders.values() for a in at for b in at if a < b}:
        sim[a, b] = sim[b, a] = minhash_dedup.weighted_jaccard(sets[a], sets[b])
    low = keys.copy()
    while True:
        new = np.where(sim >= least, low[None, :], keys.max()).min(axis=1)
        if (new == low).all():
            return sim, dict(zip(keys.tolist(), low.tolist()))
        low = new


def scattered(rng, text, n):
    out = text.split()
    for at in rng.sample(range(2, len(out) - 2), n):
        out[at] = random_text(rng, 2).replace(" ", "")
    return " ".join(out)


def test_minhash_links_leftovers_to_matched_texts(spark):
    rng = random.Random(7)
    hub = random_text(rng, 400)
    rows = [(0, hub)] + [(1 + i, scattered(rng, hub, 6)) for i in range(200)] + [(1000 + i, random_text(rng, 100)) for i in range(50)]
    sim, want = near_pairs(spark, rows)
    edits = sim[1:201, 1:201]
    assert (sim[0, :201] >= 0.8).all() and (edits[~np.eye(200, dtype=bool)] >= 0.8).mean() < 0.05
    assert {r.doc_id: r.component_id for r in minhash_dedup.classes(docs(spark, rows)).collect()} == want
    assert set(want.values()) == {0} | set(range(1000, 1050))


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8))
    X = np.concatenate([base, base[:60] + 0.06 * rng.normal(size=(60, 8)), np.repeat(base[:1], 30, 0), base[:5] * 1e-3])
    rows = [(int(i), [float(x) for x in v], int(i % 2) if i < 60 else None if i % 50 == 0 else 1) for i, v in enumerate(X)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, [float("inf")] * 8, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1)]
    odd.append((None, rows[0][1], 0))
    schema = "vec_id long, embedding array<double>, label int, id int, w int, n_links int"
    df = spark.createDataFrame([(*r, None, None, None) for r in rows + odd], schema)
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = X / np.linalg.norm(X, axis=1, keepdims=True)
    label = np.array([-1 - r[0] if r[2] is None else r[2] for r in rows])
    hits = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hits, False)
    low = np.arange(len(X))
    for _ in range(len(X)):
        low = np.minimum(low, np.where(hits, low[None, :], len(X)).min(axis=1))
    for i in range(len(X)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hits[i].sum(), low[i], low[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[906].n_links == 1 and got[907].component_id == 906 and not got[907].kept
    assert got[None].n_links == 0 and not got[None].kept
    assert embedding_dedup.link(spark.createDataFrame([], schema)).count() == 0


def test_centres_bound_replicas():
    X = np.random.default_rng(0).normal(size=(3000, 16))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    centres = embedding_dedup.choose_centres(X, 0.2)
    assert embedding_dedup.cells_of(X, centres, 0.2)[1].sum(axis=1).mean() <= embedding_dedup.VISITS


BAD = ["idiot", "moron", "loser", "clown", "pathetic"]


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = random_text(rng, 80).split()
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(BAD, 2):
                words[rng.randrange(80)] = w
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(8)
    rows = labelled(rng, 400)
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs(spark, [(i, t) for i, t, _ in rows]), labels)
    plain = random_text(rng, 60)
    tests = {1: plain, 2: plain + " idiot", 3: plain + " i.d.i.o.t!", 4: plain + " i d i o t " + plain, 5: plain + " MORON,", 6: None, 7: "", 8: plain + " mo-ron", 9: "x" * 50_000 + " clown", 10: plain + " iddiot"}
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, tests.items()).drop("score"), model, keep=["doc_id"]).collect()}
    assert {i for i, s in got.items() if s >= 0.5} == {2, 3, 4, 5, 8, 9, 10}
    assert all(0 <= s <= 1 for s in got.values())
    accepted = toxicity.accepted(docs(spark, tests.items()), model)
    assert accepted.columns == docs(spark, [(1, "a")]).columns and {r.doc_id for r in accepted.collect()} == {1, 6, 7}
    assert toxicity.score(docs(spark, []), model, keep=["doc_id"]).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a")]), none)
    assert toxicity.score(docs(spark, [(1, "a b"), (2, None)]), model, keep=["doc_id"]).where("score < 0.5").count() == 2


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.3), ("op7_toxicity", "toxic", 0.5)])
def test_held_out_accuracy(spark, name, label, least):
    from scorefold.llm.queries import QUERIES

    d = SMALL.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES[name][0](spark, d).collect()}
    truth = {r.doc_id: r[label] for r in common.table(spark, d, "labels").collect()}
    assert len(got) == common.table(spark, d, "documents").count()
    assert all(r.predicted == int(r.score >= least) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    test = [(truth[i], r.predicted) for i, r in got.items() if i in truth and r.held_out]
    assert sum(y == p for y, p in test) / len(test) >= (0.95 if label == "quality" else 0.85)


def test_quality_rules(spark):
    rng = random.Random(2)
    rows = [(i, random_text(rng) if i % 2 else random_text(rng, 60).replace(" ", "!! ").upper()) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels)
    assert 0 < len(model.rules) < 100
    got = {r.doc_id: r.score for r in quality.score(docs(spark, rows + [(900, None), (901, ""), (902, "y " * 90_000)]), model, keep=["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in rows) and all(0 <= s <= 1 for s in got.values())
    lone = quality.fit(docs(spark, rows), labels.where("quality = 1"))
    assert lone.rules == [] and quality.score(docs(spark, rows[:2]), lone, keep=["doc_id"]).where("score > 0.9").count() == 2
    assert quality.score(docs(spark, []), model, keep=["doc_id"]).count() == 0


def katz(rows, order, folds=10):
    """Brute force: (n_tokens, n_known, base, score) of each text."""
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b" "]
    top = katz_lm.TOP
    count = [Counter() for _ in range(order + 1)]  # by length; a text begins after an end
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % folds:
            w = cut(t)
            count[1].update((x,) for x in w)
            for n in range(2, order + 1):
                count[n].update(tuple(([b" "] + w)[k : k + n]) for k in range(len(w) + 2 - n))
    d = [None] + [katz_lm.discounts([sum(v == r for v in c.values()) for r in range(1, top + 2)]) for c in count[1:]]
    total = max(sum(count[1].values()), 1)
    unknown = 1 - sum(d[1][min(c, top + 1)] * c / total for c in count[1].values())
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in count[n]:
            after[g[:-1]].append(g[-1])

    @functools.cache
    def weight(h):
        n = len(h) + 1
        rest = 1 - math.fsum(d[n][min(count[n][(*h, w)], top + 1)] * count[n][(*h, w)] / count[n - 1][h] for w in after[h])
        return rest / (1 - math.fsum(p(h[1:], w) for w in after[h]))

    def p(h, w):
        n = len(h) + 1
        c = count[n][(*h, w)]
        if n == 1:
            return d[1][min(c, top + 1)] * c / total if c else unknown
        if c:
            return d[n][min(c, top + 1)] * c / count[n - 1][h]
        return p(h[1:], w) * (weight(h) if after[h] else 1)

    for h in [*list(after)[:20], *list(after)[-20:]]:
        assert abs(math.fsum(p(h, w) for w, in count[1]) + p(h, b"\0") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = cut(t)
        base = sum(math.log10((count[1][(x,)] + 0.1) / (sum(count[1].values()) + 0.1 * (len(count[1]) + 1))) for x in w)
        log = math.fsum(math.log10(p(tuple(([b" "] + w)[max(0, k + 2 - order) : k + 1]) if order > 1 else (), x)) for k, x in enumerate(w))
        out.append((i, len(w), sum((x,) in count[1] for x in w), base, log))
    return out


@pytest.mark.parametrize("ranges, order", [(1_000_000, 3), (500, 3), (500, 1), (500, 2), (2000, 4)])
def test_katz_equals_brute_force(spark, monkeypatch, ranges, order):
    monkeypatch.setattr(katz_lm, "RANGE_TOKENS", ranges)
    rng = random.Random(6)
    common_words = random_text(rng, 80).split()
    rows = [(i, " ".join(rng.choice(common_words[: rng.randint(5, 80)]) for _ in range(60))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "Some null key"), (502, "same same same " * 3000), (7, rows[7][1]), (503, "É é\x0bNew word"), (504, "one")]
    got = sorted(katz_lm.score(docs(spark, rows), order=order).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(katz(rows, order), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.n_tokens, g.n_known) == w[:3]
        assert abs(g.base_score - w[3]) < 1e-9 * g.n_tokens and abs(g.score - w[4]) < 1e-9 * g.n_tokens
    assert katz_lm.score(docs(spark, []), order=order).count() == 0


def test_packed_arrays():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (katz_lm.unpack_sorted(katz_lm.pack_sorted(x)) == x).all()
    assert (katz_lm.unpack(katz_lm.pack(x), np.uint64) == x).all()
    cut = katz_lm.slices(x, 7)
    assert [a for _, a, _ in cut] == [0] + [b for _, _, b in cut[:-1]] and cut[-1][2] == len(x)


def redacted(text):
    """Brute force of the secret stage."""
    spans = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            spans.append(m.span())
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_against_brute_force(spark):
    d = SMALL.replace("sf0.001", "sf0.01")
    docs_now = common.table(spark, d, "documents")
    columns, before = docs_now.columns, {r.doc_id: r.text for r in docs_now.collect()}
    toxic = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").collect()}
    folded = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    cut = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(t.lower().split())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, d).cache()
        assert docs_now.columns == columns, name
        rows = {r.doc_id: r for r in docs_now.collect()}
        assert len(rows) == docs_now.count() and set(rows) <= set(before), name
        gone = set(before) - set(rows)
        if name == "toxicity":
            assert gone and sum(toxic.get(i) == 0 for i in gone) <= 0.02 * len(before)
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[folded(t)] = max(i, best.get(folded(t), i))
            assert set(rows) == set(best.values())
        elif name == "near dedup":
            kept = {i: cut(before[i]) for i in rows}
            near = lambda a, b: len(a & b) / len(a | b)
            assert gone and all(max(near(cut(before[i]), k) for k in kept.values()) >= 0.6 for i in gone)
        else:
            assert not gone and all(r.text == redacted(before[i]) for i, r in rows.items())
            assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i])
            assert any(r.text != before[i] for i, r in rows.items())
        if name != "secret scans":
            assert all(r.text == before[i] for i, r in rows.items())
        before = {i: r.text for i, r in rows.items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_now, d).collect()
    assert {r.doc_id for r in packed} == set(before)
    filled_to = Counter()
    for r in packed:
        filled_to[r.sequence_id] += r.length
    assert max(filled_to.values()) <= 4096
