"""Near-duplicates of texts and vectors, components, and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumenforge.llm import covertree, embed_dedup, minhash, quality, shingles
from lumenforge.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def text_links(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    return [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def test_shingles_equal_restatement():
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "B", "é", " ", "\n", "\t", "cat", "\x0b", " "]) for _ in range(r.randint(0, 30))) for _ in range(500)] + ["", " ", "x" * 9000 + " y"]
    for k in (2, 5):
        for t, s in zip(texts, shingles.shingle_sets(pa.array(texts), k), strict=True):
            assert len(s) == len(shingle_set(t, k)), t
    part = pa.array(texts).slice(100, 50)
    assert [len(s) for s in shingles.shingle_sets(part, 2)] == [len(shingle_set(t, 2)) for t in texts[100:150]]


def test_sequential_test_keeps_similar_pairs():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (20000, 96), dtype=np.uint16)
    for share, lo, hi in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(r.random(a.shape) < share, a, a + np.uint16(1))
        assert lo <= len(minhash.survivors(a, b, 0.8)) / len(a) <= hi


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, n = [], 0
    for _ in range(25):  # texts and some edited copies
        base = [word() for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, 4)):
            copy = [w if r.random() > 0.03 else word() for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    base = [word() for _ in range(60)]  # one large group whose members are not all linked to its centre
    for _ in range(90):
        copy = list(base)
        for _ in range(r.randint(1, 5)):
            copy[r.randrange(60)] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(900, rows[0][1].upper()), (901, rows[0][1]), (902, None), (903, ""), (904, " \n"), (905, "one"), (906, "ONE"), (907, "one two")]
    return rows


def test_near_duplicates(spark, texts, monkeypatch):
    want = components([i for i, _ in texts], text_links(texts, 2, 80))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in texts] + [(None, texts[0][1], 0, 0)], "doc_id long, text string, n int, bh int")
    for small, broadcast in ((32, 500_000), (3, 0)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(minhash, "BLOCK", 16 if small == 3 else 256)
        rows = minhash.near_duplicates(d, k=2).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
                assert r["n_shingles"] == len(shingle_set(dict(texts)[r["doc_id"]], 2))


def test_large_bucket_blocks(spark, texts, monkeypatch):
    """The block comparison alone joins what brute force joins."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    group = texts[-98:-8]
    links = text_links(group, 2, 80)
    d = spark.createDataFrame(group, "doc_id long, text string")
    rest = spark.createDataFrame([(1, i, i if i % 3 else group[0][0]) for i, _ in group], "bh long, id long, c long")
    start = [(i, group[0][0]) for i, _ in group if i % 3 == 0]
    got = [(r["a"], r["b"]) for r in minhash._block_links(d, "doc_id", "text", rest, 2, 80).collect()]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in links}
    ids = [i for i, _ in group]
    assert components(ids, got + start) == components(ids, links + start)


def test_shared_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d"), (5, "a b c d"), (5, "w x y z"), (9, "w x y z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(d, k=2).collect()} == {(1, 1), (5, 1), (9, 1)}
    assert minhash.near_duplicates(d.where("false"), k=2).count() == 0
    kept = minhash.drop_duplicates(d.where("text like 'a%'"), k=2)
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links + [(7, 7), (None, 3)], "src long, dst long")).collect()}
    ids = {i for x in links if x[0] != x[1] for i in x}
    assert got == components(ids, [x for x in links if x[0] != x[1]])


def test_cover_tree_finds_all_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 8))
    x[300:600] = x[:300] + 0.02 * r.normal(size=(300, 8))
    x[600:700] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for split in (None, 400):
        got = []
        a, b = (covertree.Tree(x), None) if split is None else (covertree.Tree(x[:split]), covertree.Tree(x[split:]))
        covertree.pairs_within(a, b, 0.98, lambda i, j: got.extend(zip(i.tolist(), (j if split is None else j + split).tolist(), strict=True)))  # noqa: B023
        near = x @ x.T >= 0.98
        want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j and (split is None or i < split <= j)}
        assert Counter((min(p), max(p)) for p in got) == Counter(want)
    apart = np.concatenate([x[:1] + 0.001 * r.normal(size=(600, 8)), -x[:1] + 0.001 * r.normal(size=(600, 8))])
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    assert covertree.pairs_within(covertree.Tree(apart), None, 0.98, lambda i, j: None) > 0


def test_near_embeddings(spark):
    r = np.random.default_rng(5)
    rows, vecs = [], {}
    for i in range(150):
        v = vecs[i - 1] + 0.05 * r.normal(size=16) if i % 3 and i else r.normal(size=16)
        vecs[i] = v.astype(np.float32).astype(float)
        rows.append((i, vecs[i].tolist(), [1, 2, None][i // 3 % 3], 0))
    rows += [(200, vecs[0].tolist(), 1, 0), (201, (2 * vecs[0]).tolist(), 1, 0), (202, None, 1, 0), (203, [0.0] * 16, 1, 0), (204, [float("nan")] * 16, 1, 0), (205, [float("inf")] + [1.0] * 15, 1, 0), (206, [], 1, 0), (207, [1.0, None] * 8, 1, 0), (208, [1.0, 2.0], 1, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, m int")
    good = [(i, np.array(v), g) for i, v, g, _ in rows if v and None not in v and np.isfinite(v).all() and any(v) and g is not None]
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    want, n = components([x[0] for x in rows], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for block in (4096, 10):
        got = embed_dedup.near_embeddings(d, block=block).collect()
        assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got} == {i: (n[i], want[i], want[i] == i) for i in want} and len(got) == len(rows)
    assert embed_dedup.near_embeddings(d.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    r = random.Random(2)
    prose = lambda: ("The " + " ".join(r.choice(["the", "of", "and", "in", "cat", "house"]) + str(r.randint(0, 99)) * (r.random() < 0.5) for _ in range(80))).replace("  ", " ") + "."
    rows = [(i, prose(), "en", "ab"[i % 2], 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "a", 0), (101, rows[1][1] + " token = deadbeef00112233445566778899aa", "en", "b", 0), (102, "too short", "en", "a", 0), (103, None, "en", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    columns, docs, seen = d.columns, d, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns and docs.dtypes == d.dtypes
        seen[name] = docs.collect()
    assert {x["doc_id"] for x in seen["quality rules"]} == {x["doc_id"] for x in quality.judge(d).collect() if x["kept"]} and 102 not in {x["doc_id"] for x in seen["quality rules"]}
    kept = {x["doc_id"]: x["text"] for x in seen["quality rules"]}
    want = components(kept, text_links(list(kept.items()), 5, 80))
    assert {x["doc_id"] for x in seen["near dedup"]} == {i for i in kept if want[i] == i}
    assert all("deadbeef0011" not in x["text"] and x["n_chars"] == len(x["text"]) for x in seen["secret scan"])
    assert {x["doc_id"] for x in seen["source mix"]} <= {x["doc_id"] for x in seen["secret scan"]} and len(seen["source mix"]) > len(seen["secret scan"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(x["doc_id"] for x in seen["source mix"]) and all(x["n_tokens"] * 4 == len(x["ids"]) for x in out)


def test_cover_tree_levels_halve():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(700, 12)), r.normal(size=(300, 12)) * 0.1 + 1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.Tree(x)
    assert sorted(t.order.tolist()) == list(range(1000))
    for k, (lo, hi) in enumerate(t.kids):
        own = x[t.members(k)]
        assert np.sqrt(np.maximum(0, 2 - 2 * own @ x[t.centre[k]])).max() <= t.radius[k] + 1e-7 <= max(2.0, t.level[k]) + 2e-7
        if lo == hi:
            assert t.end[k] - t.begin[k] <= covertree.LEAF or t.radius[k] <= 1e-7
            continue
        centres = x[np.array(t.centre[lo:hi])]
        assert t.centre[lo] == t.centre[k] and t.begin[lo] == t.begin[k] and t.end[hi - 1] == t.end[k]
        halves = np.log2(t.level[k] / t.level[lo])
        assert halves >= 0 and halves == int(halves) and set(t.level[lo:hi]) == {t.level[lo]} and t.level[lo] < t.radius[k] or k == 0
        gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) + 9 * np.eye(len(centres))
        assert gap.min() > t.level[lo] - 1e-7


def test_near_embeddings_of_repeated_ids(spark, monkeypatch):
    """Rows are counted by label and vector, ids are nodes."""
    from lumenforge.llm import common

    r = np.random.default_rng(9)
    base = {c: r.normal(size=8) for c in "pqrs"}
    near = lambda c: (base[c] + 0.02 * r.normal(size=8)).tolist()
    p = base["p"].tolist()
    rows = [(1, p, "A"), (2, near("p"), "A"), (3, near("p"), "A"), (1, p, "B"), (4, near("p"), "B"), (10, near("q"), "A"), (10, near("q"), "A"), (5, near("r"), "A"), (5, near("s"), "A"), (6, near("s"), "A"), (0, near("r"), "A")]
    rows += [(20, base["q"].tolist(), "C")] * 40 + [(30 + i, base["q"].tolist(), "C") for i in range(40)] + [(3, None, "A"), (None, p, "A"), (8, p, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = [None if v is None or i is None or g is None else np.array(v) / np.linalg.norm(v) for i, v, g in rows]
    linked = lambda a, b: a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98 - 1e-12
    n = [sum(linked(a, b) for b in range(len(rows))) for a in range(len(rows))]
    comp = components({i for i, _, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if linked(a, b)])
    want = Counter((i, k, i if u is None else comp[i]) for (i, _, _), k, u in zip(rows, n, unit, strict=True))
    for heavy, broadcast, block in ((50_000, 500_000, 4096), (7, 0, 3)):
        monkeypatch.setattr(embed_dedup, "HEAVY", heavy)
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        got = embed_dedup.near_embeddings(d, block=block, largest=block).collect()
        assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == want
        assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)


def test_drop_duplicates_of_shared_and_missing_ids(spark):
    schema = "doc_id long, text string, _gone int, node string, extra map<string,int>"
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a b c d", 0), (5, "a b c d", 0), (5, "w x y z", 0), (1, "A b c d", 1), (None, "a b c d", 0), (None, long, 0), (None, long + " !", 0), (9, "p q r s", 3), (9, "p q r s", 3), (9, "p q r s", 3), (None, None, 0), (None, None, 0), (7, "", 0), (7, "", 0), (12, long + "x", 0), (13, "solo text is here now", 0)]
    d = spark.createDataFrame([(i, t, g, "n", {"a": g}) for i, t, g in rows], schema)
    out = minhash.drop_duplicates(d, k=2)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    got = out.collect()
    assert sorted(r["text"].lower() for r in got if r["text"]) == sorted(["a b c d", "w x y z", "p q r s", long + "x", "solo text is here now"])
    assert {r["doc_id"] for r in got if r["text"]} == {1, 5, 9, 12, 13} and sum(not r["text"] for r in got) == 4
    again = minhash.drop_duplicates(spark.createDataFrame([(1, "x y z", 1), (2, "x y z", 2), (3, "x y q", 3)], "doc_id long, text string, _gone int"), k=2)
    assert sorted((r["doc_id"], r["_gone"]) for r in again.collect()) == [(1, 1), (3, 3)]
