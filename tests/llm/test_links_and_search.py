"""Near duplicates, vectors and neighbours against brute force; the pipeline against its parts."""

import numpy as np
import pytest

from gumshoe.llm.common import Scratch, components
from gumshoe.llm.minhash import link_documents
from gumshoe.llm.nearest import balanced_partition, neighbour_graph, search_nearest
from gumshoe.llm.vector_links import link_vectors


def groups_of(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000 + i, 2500) for i in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == groups_of(nodes, [e for e in edges if e[0] != e[1]])


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def copies():
    """Groups around an original, copies of it, chains, short and odd texts."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(4000)])
    rows = []
    for group in range(5):
        base = rng.choice(words, 200 if group else 30)
        for _ in range(25):
            text = base.copy()
            for _ in range(rng.integers(0, 6)):
                text[rng.integers(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    chain = list(rng.choice(words, 120))
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[4:] + list(rng.choice(words, 4))
    rows += [" ".join(rng.choice(words, 40)) for _ in range(40)] + ["same text here"] * 300
    order = rng.permutation(len(rows))
    docs = [(int(i), rows[k]) for i, k in enumerate(order)]
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "É x"), (n + 6, "é x")]


def test_minhash(spark, copies):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in copies] + [(None, "one two", 1, 2)], "doc_id long, text string, n int, component_id int").repartition(4)
    got = link_documents(docs).collect()
    assert len(got) == len(copies) + 1
    sets = {i: shingles(t) for i, t in copies}
    linked = []
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                    linked.append((a, b))
    truth = groups_of(ids, linked)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), truth[r.doc_id], truth[r.doc_id] == r.doc_id)
    assert link_documents(docs.limit(0)).count() == 0


def test_minhash_star_is_not_the_first(spark):
    """Copies of one original that are not near each other, all with smaller ids than it."""
    rng = np.random.default_rng(2)
    words = np.array([f"v{i}" for i in range(9000)])
    base = rng.choice(words, 400, replace=False)
    rows = []
    for i in range(80):
        text = base.copy()
        at = rng.choice(400 // 5, 6, replace=False) * 5
        text[at] = rng.choice(words, 6)
        rows.append((i, " ".join(text)))
    rows.append((500, " ".join(base)))
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def vectors(spark, rng, odd=True):
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:400] = x[0] + 0.02 * rng.standard_normal((300, 16)).astype(np.float32)
    x[400:440] = x[1]
    for i in range(440, 500):
        x[i] = x[i - 1] + 0.14 * rng.standard_normal(16).astype(np.float32)
    rows = [(int(i), v.tolist(), int(i % 2) if i >= 500 else 1, 7) for i, v in enumerate(x)]
    if odd:
        rows += [(1000, None, 1, 7), (1001, [0.0] * 16, 1, 7), (1002, [float("nan")] * 16, 1, 7), (1003, [1.0, None], 1, 7), (1004, [], 1, 7), (1005, x[1].tolist(), None, 7), (1006, [2.0, 2.0], 1, 7), (1007, [3.0, 3.0], 1, 7), (None, x[1].tolist(), 1, 7), (1008, [float("inf")] * 16, 1, 7)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int").repartition(3)


def test_vector_links(spark):
    x, rows = vectors(spark, np.random.default_rng(3))
    got, recall = link_vectors(rows)
    got = {r.vec_id: r for r in got.collect()}
    assert len(got) == 910 and recall >= 0.999
    label = np.array([i % 2 if i >= 500 else 1 for i in range(900)])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(like, False)
    truth = groups_of(range(900), zip(*np.nonzero(like)))
    for i in range(900):
        assert (got[i].n_links, got[i].component_id) == (like[i].sum(), truth[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008))
    assert got[1006].n_links == 1 and got[1007].component_id == 1006 and got[None].n_links == 0
    assert link_vectors(rows.limit(0))[0].count() == 0


def test_vector_links_of_small_groups(spark, monkeypatch):
    """One group of many near copies and many pairs, with trees that separate most pairs."""
    from gumshoe.llm import vector_links

    for name, value in (("TREES", 1), ("LEAF", 4), ("LEAF_MOST", 8)):
        monkeypatch.setattr(vector_links, name, value)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 24))
    x[:300] = x[0] + 0.02 * rng.standard_normal((300, 24))
    x[301:700:2] = x[300:700:2] + 0.1 * rng.standard_normal((200, 24))
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got, recall = link_vectors(rows)
    got = {r.vec_id: r for r in got.collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = unit @ unit.T >= 0.98
    np.fill_diagonal(like, False)
    truth = groups_of(range(700), zip(*np.nonzero(like)))
    wrong = [i for i in range(700) if (got[i].n_links, got[i].component_id) != (like[i].sum(), truth[i])]
    assert recall >= 0.999 and len(wrong) <= 0.002 * 700


def test_vector_lists_name_a_neighbour_once(spark):
    """One pair met with cosines that differ in the last bit is one entry, and descents end."""
    from gumshoe.llm.vector_links import NEIGHBOURS, _change, _merged

    near = -0.1728530782880411
    schema = "id long, near array<struct<far:double,id:long>>, anchor long"
    lists = [(1, [(near, 105), (near, 106)], None), (1, [(np.nextafter(near, 0), 105)], 7), (2, [], 1), (3, [(-0.9 + i / 100, 10 + i) for i in range(15)], None), (3, [(float(np.nextafter(-0.9, 0)), 10)], 2)]
    lists = [(i, [(float(f), k) for f, k in x], a) for i, x, a in lists]
    once = _merged(spark.createDataFrame(lists, schema))
    got = {r.id: ([(e.far, e.id) for e in r.near], r.anchor) for r in once.collect()}
    assert got[1] == ([(near, 105), (near, 106)], 7) and got[2] == ([], 1)
    assert [k for _, k in got[3][0]] == list(range(10, 10 + NEIGHBOURS)) and got[3][1] == 2
    doubled = spark.createDataFrame([(1, [(near, 105), (float(np.nextafter(near, 0)), 105)], None)], schema)
    assert _change(doubled, doubled)[0] == 0.0


def test_cosines_do_not_depend_on_the_rows_beside():
    from gumshoe.llm.vector_links import _cosines, _linked

    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    a, b = rng.integers(0, 400, (2, 3000))
    whole = _cosines(x, x, a, b)
    for size in (2, 3, 7, 50):
        some = rng.choice(400, size, replace=False)
        i, j = (c.ravel() for c in np.meshgrid(np.arange(size), np.arange(size)))
        assert (_cosines(x[some], x[some], i, j) == _cosines(x, x, some[i], some[j])).all()
    assert (whole == _cosines(x, x, b, a)).all()
    exact = whole[5]
    assert _linked(x, x, exact)[a[5], b[5]] and _linked(x[[a[5]]], x[[b[5]]], exact).all() and not _linked(x[[a[5]]], x[[b[5]]], np.nextafter(exact, 1)).any()


def test_recall_is_not_the_large_groups(spark):
    from gumshoe.llm.vector_links import _recall

    truth = spark.createDataFrame([(0, 9999), *((i, 1) for i in range(1, 10))], "id long, truth long")
    found = spark.createDataFrame([(0, 9999), (1, 1), *((i, 0) for i in range(2, 10))], "id long, others long")
    assert _recall(found, truth) == pytest.approx(0.2)
    assert _recall(truth.withColumnRenamed("truth", "others"), truth) == 1.0 and _recall(found, truth.limit(0)) == 1.0


def test_nearest_small_is_exact(spark):
    x, rows = vectors(spark, np.random.default_rng(4))
    got, recall = search_nearest(rows)
    got = got.toPandas()
    assert recall == 1.0
    x = np.concatenate([x.astype(float), x[1:2].astype(float)])
    ids = np.array([*range(900), 1005])
    for q in range(0, 900, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score.round(12)))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, score[best], rtol=0, atol=1e-12)
        assert own.vec_id.tolist() == ids[best].tolist() or np.abs(np.diff(score[best])).min() < 1e-9
    assert set(got.query_id) == set(range(0, 900, 20))
    assert search_nearest(rows.limit(0))[0].count() == 0
    few = search_nearest(rows.filter("vec_id in (20, 21, 22)"))[0].collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_nearest_in_partitions(spark, monkeypatch):
    from gumshoe.llm import nearest

    monkeypatch.setattr(nearest, "PARTITION", 256)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.5 * rng.standard_normal((3000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, recall = search_nearest(rows)
    found = {q: set(p.vec_id) for q, p in got.toPandas().groupby("query_id")}
    hit = 0
    for q in range(0, 3000, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.93 * 20 * 150 and recall >= 0.93


def test_partition_is_balanced():
    x = np.random.default_rng(6).standard_normal((1000, 8))
    part = balanced_partition(neighbour_graph(x), 8)
    counts = np.bincount(part, minlength=8)
    assert counts.max() - counts.min() <= 4


def test_pipeline(spark, small_dir):
    import corpus_pipeline
    from gumshoe.llm import language, toxicity
    from gumshoe.llm.common import table

    docs = table(spark, small_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = table(spark, small_dir, "labels").filter(toxicity.id_remainder("doc_id", 5) != 0)
    scorer = toxicity.Scorer(toxicity.fit_on(docs, labels))
    left = {i: t for i, t in texts.items() if scorer.score(t or "") < 0.5}
    some = spark.createDataFrame([(i,) for i in left], "doc_id long")
    model = language.fit_on(docs.join(some, "doc_id", "left_semi").select(docs.columns))
    names = language.Parser(model).determined([t or "" for t in left.values()])
    left = {i: t for (i, t), n in zip(left.items(), names) if n != "und"}
    sets = {i: shingles(t) for i, t in left.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    groups = groups_of(sets, linked)
    kept = {i for i in sets if groups[i] == i}
    rows = corpus_pipeline.run(spark, small_dir).collect()
    assert {r.doc_id for r in rows} == kept and len(kept) < len(texts)
    for i in kept:
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2] and own[0][0] == 0


def test_pipeline_odd_rows(spark, small_dir):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 3), (3, "12 34", "en", "s", 5), (4, "some words here", "en", "s", 15), (4, "some words here", "en", "s", 15), (5, "some words here", "en", "s", 15)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small_dir)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(str(r.doc_id) for r in docs.collect()) == (["4", "None"] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() == (2 if data else 0)
