"""Mixing, whitening and manifests against brute force, and their defined results on awkward rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.llm import manifest, mixing, whitening

TEXTS = [None, "", " \n\t ", "One", "é" * 3000 + " a\u0000b", "x Y " * 15000, "same text", "same text"]


def corpus(spark, n=0, seed=1):
    """Awkward rows, then ``n`` more: a hot source, small ones, a null one, a source of null and blank texts."""
    rng = random.Random(seed)
    rows = [(i, t, "en", ["b", None, "ä"][i % 3], len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [(7, TEXTS[7], None, "b", 9), (7, TEXTS[7], None, "b", 9), (None, "no id", "en", None, 5), (None, None, None, None, None),
             (40, None, "en", "blank", None), (41, "  ", "en", "blank", 2)]
    for i in range(n):
        text = " ".join("W" + str(rng.randrange(50)) for _ in range(rng.choice([1, 3, 20, 80])))
        rows.append((100 + i, text, "en", "hot" if i % 3 == 0 else f"s{rng.randrange(30)}", len(text)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
            .withColumns({c: F.lit(1) for c in ("_row", "size", "target", "key", "_hash", "n", "leaf", "mix", "kept")}))


def by_source(row):
    return (row is not None, (row or "").encode())


# --- 11 mixing

def brute_targets(sizes):
    """Water-filling with fractions, one clamped source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target = Fraction(sum(sizes.values())), {}
    while len(target) < len(order):
        open_ = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in open_)
        tight = [s for s in open_ if 3 * sizes[s] < weight[s] * level]
        if not tight:
            return target | {s: weight[s] * level for s in open_}
        target[tight[0]] = Fraction(3 * sizes[tight[0]])
        left -= target[tight[0]]
    return target


@pytest.mark.parametrize("n", [0, 900])
def test_mix_meets_water_filled_targets(spark, n):
    docs = corpus(spark, n)
    rows = mixing.mix(docs, keep=["doc_id", "source", "text"]).collect()
    assert len(rows) == docs.count()
    sizes, taken, least = {}, {}, {}
    for r in rows:
        words = len(re.findall(rb"[^\x20\x09-\x0d]+", (r["text"] or "").encode()))
        assert r["mix"]["size"] == words and r["mix"]["taken"] == words * r["mix"]["repeats"] and r["mix"]["repeats"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + words
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix"]["taken"]
        least[r["source"]] = max(least.get(r["source"], 0), words)
    want = brute_targets(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1
    for r in rows:
        assert r["mix"]["source_size"] == sizes[r["source"]]
        assert r["mix"]["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (max(2, want[s] / 50) if n and s in ("hot", "b") else least[s] / 2 + 1)
    again = mixing.mix(docs.repartition(3), keep=["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_repeats_whole_documents(spark):
    docs = corpus(spark, 200).drop("mix")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix"]
    words = mixed.agg(F.sum("mix.repeats")).first()[0]
    out = mixing.repeated(mixed)
    assert out.count() == words and set(out.columns) == {*docs.columns, "repetition"}
    assert mixing.mix(docs.limit(0)).count() == 0
    short = docs.where(F.length("text") < 9000)  # sources with words of about the same number: none repeats all alike
    first, other = ([str(r) for r in mixing.mix(short, keep=["doc_id"], seed=k).orderBy("doc_id").collect()] for k in (11, 5))
    assert len(first) == len(other) and first != other


# --- 12 whitening

def test_factors_give_eigenvalues_and_components():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        d = int(rng.integers(1, 40))
        r = int(rng.integers(1, d + 1))
        a = rng.normal(size=(d, r)) * 10.0 ** rng.integers(-3, 4, size=r)
        c = a @ a.T
        g = whitening.pivoted_cholesky(c)
        assert np.allclose(g @ g.T, c, atol=1e-11 * np.abs(c).max())
        values, vectors = whitening.one_sided_jacobi(g)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][:len(values)], rtol=1e-8, atol=1e-12 * values[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        assert np.allclose(c @ vectors, vectors * values, atol=1e-11 * values[0])
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_matches_a_dense_eigensolver(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.2, (400, 20)) @ rng.normal(size=(20, 20)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(300)]  # a third are copies
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 18), (2002, [float("nan")] * 20), (2003, []), (2004, [1.0]),
           (2005, [float("inf")] * 20)]
    df = (spark.createDataFrame(rows + [(None, base[5].tolist())] + bad, "vec_id long, embedding array<double>")
          .withColumns({c: F.lit(1) for c in ("id", "x", "n", "v", "d")}).repartition(5))
    got = whitening.whiten(df).toPandas().sort_values("vec_id")
    assert len(got) == 701 and got["vec_id"].isna().sum() == 1
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1000000
    fit_list = np.unique(x, axis=0)
    n, s = len(fit_list), fit_list.sum(axis=0)
    z = fit_list - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - s / n) @ vectors[:, :16] / np.sqrt(values[:16])
    have = np.stack(got["whitened"].to_numpy()[:700])
    assert np.allclose(have * np.sign((have * want).sum(axis=0)), want, atol=1e-7)
    assert got["deviation"].tolist()[:700] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert np.allclose(got["explained"].iloc[0], values[:16] / values.sum(), rtol=1e-9)
    assert (got["n"] == n).all() and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_awkward_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [0.5, 0.1]), (2, [0.5, 0.1])])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    flat = whitening.whiten(frame([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)])).collect()  # one direction varies
    assert len(flat) == 50 and all(len(r["whitened"]) == 1 for r in flat)
    large = whitening.whiten(frame([(i, [1e30 * i, float(i % 3)]) for i in range(3)])).collect()
    assert {r["deviation"] for r in large} == {None}
    shifted = [(i, [1e12 + i, float(i * i)]) for i in range(20)]  # a mean far from zero costs no digits
    got = {r["vec_id"]: r for r in whitening.whiten(frame(shifted)).collect()}
    x = [[int(64 * a) for a in v] for _, v in shifted]
    s = [sum(c) for c in zip(*x)]
    assert [got[i]["deviation"] for i in range(20)] == [sum((20 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    assert got[0]["identity_error"] < 1e-9


# --- 13 manifest

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, each leaf's path of (before, after)) by plain recursion."""
    paths, owners, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        nexts, owned = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            nexts.append(h("".join(run)))
            owned.append(sum(owners[a:a + 16], []))
        nodes, owners = nexts, owned
    return nodes[0], paths


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(enc(r[c]) for c in manifest.FIELDS[:-1]) + enc(text))
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    out, subroots = [], {}
    sources = sorted({r["source"] for r in rows}, key=by_source)
    for s in sources:
        members = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), i) for i, r in enumerate(rows) if r["source"] == s)
        subroots[s] = tree([m[0][2] for m in members]) + (members,)
    root, tops = tree([subroots[s][0] for s in sources])
    for s, top in zip(sources, tops):
        subroot, paths, members = subroots[s]
        for (key, i), path in zip(members, paths):
            r, full = rows[i], path + top
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate(lower)) if bad else key[2]
            for before, after in full:
                node = h(before + node + after)
            out.append((r["doc_id"], key[2], subroot, root, h("".join(a + b for a, b in full)), node, node == root))
    return out


@pytest.mark.parametrize("n", [0, 1200])  # the hot source then spans two blocks, the sources three runs
def test_manifest_matches_plain_recursion(spark, tmp_path, n):
    docs = corpus(spark, n).drop("_row")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_manifest(docs.collect())))
    assert {r["verified"] for r in got} == ({True, False} if n else {True})


def test_manifest_of_few_rows(spark):
    leaves = spark.createDataFrame([(1, "a", "x" * 64)], "doc_id long, source string, leaf string")
    row = manifest.merkle_manifest(leaves).first()
    assert (row["subroot"], row["root"], row["path"]) == ("x" * 64, "x" * 64, [])
    assert manifest.merkle_manifest(leaves.limit(0)).count() == 0
    two = manifest.merkle_manifest(leaves.unionAll(leaves)).collect()
    assert [r["subroot"] for r in two] == [h("x" * 128)] * 2
