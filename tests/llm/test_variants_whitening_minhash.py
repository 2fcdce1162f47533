"""Spelling variants, whitening and MinHash groups against brute force."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from words import prose

from gaugeworks.llm import minhash, queries, simhash, spelling, whitening

# op11


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_by_force(rows, letters=5, occurrences=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= occurrences}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    p = next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))
    return u[p + (len(u) == len(v)) :] == v[p + 1 :]


def variants_by_force(words):
    by_gap = {}
    for w in words:  # words that are near share a text with one letter left out
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_gap.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for those in by_gap.values():
        for w in those:
            near[w] |= {x for x in those if one_edit(w, x)}
    form = {}
    for w, those in near.items():
        best = min(those, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1024, 4])
def test_variants_of_the_whole_table(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = variants_by_force(words_by_force([(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = found_variants(queries.op11_spelling_variants(spark, sf_dir))
    assert got == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("letters", ["ab", "abc", "aéÿ"])
def test_variants_of_dense_words(spark, monkeypatch, letters):
    """Words over two or three letters, where nearly all pairs are near and one letter repeats."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    rng = np.random.default_rng(len(letters))
    rows = [(i, " ".join("".join(rng.choice(list(letters), rng.integers(4, 10))) for _ in range(300))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = variants_by_force(words_by_force(rows))
    assert len(want) > 50 and found_variants(spelling.spelling_variants(df)) == want


def test_variants_odd(spark, odd, empty):
    assert spelling.spelling_variants(empty).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found_variants(spelling.spelling_variants(odd)) == variants_by_force(words_by_force(rows))
    long = "x" * 100_000
    rows = [(1, f"{long} {long} {long} {long}y {long}y {long}y {long}"), (2, "×÷Àÿé Ābcdef ÀBCDEF" * 3), (None, "abcde " * 4), (None, "abcde " * 4)]
    got = found_variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == variants_by_force(words_by_force(rows)) and len(got) >= 4


def test_chains_of_forms(spark):
    """Forms of forms: the root is the last, however long the way."""
    n = [f"{'a' * i}{'b' * (9 - i)}" for i in range(10)]
    df = spark.createDataFrame(list(zip(n, n[1:], strict=False)), "word string, form string")
    assert {r["word"]: r["root"] for r in spelling._roots(df).collect()} == {w: "a" * 9 for w in n[:-1]}


# op12


def whitened_by_force(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    return x, s, v, deviation


def check_whitening(rows, vectors, ids, components):
    x, s, v, deviation = whitened_by_force(vectors)
    n, d = len(x), len(x[0])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    assert sorted((r["vec_id"], int(r["deviation"])) for r in rows if r["component"] == 1) == sorted(zip(ids, deviation, strict=True))
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    centred = (np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)] for r in x]) @ u)[:, :k] / np.sqrt(e[:k])
    mine = np.array([[got[i, c + 1] for c in range(k)] for i in ids])
    gap = np.diff(e[: k + 1]) if d > k else np.append(np.diff(e), -e[-1])
    for c in range(k):
        if min(abs(gap[c]), abs(gap[c - 1]) if c else 1e9) > 1e-6 * e[0]:
            assert min(np.abs(mine[:, c] - centred[:, c]).max(), np.abs(mine[:, c] + centred[:, c]).max()) < 1e-6
    cov = (mine - mine.mean(axis=0)).T @ (mine - mine.mean(axis=0)) / n
    error = {r["identity_error"] for r in rows}
    assert len(error) == 1 and error.pop() <= 1e-4 and np.abs(cov - np.eye(k)).max() <= 1e-4
    explained = {r["component"]: r["explained"] for r in rows}
    assert np.allclose([explained[c + 1] for c in range(k)], e[:k] / np.trace(v), rtol=1e-4)


def test_whitening_of_the_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = queries.op12_embedding_whitening(spark, sf_dir)
    assert dict(rows.dtypes)["deviation"] == "bigint" and dict(rows.dtypes)["component"] == "int"
    check_whitening(rows.collect(), [r["embedding"] for r in table], [r["vec_id"] for r in table], 32)


@pytest.mark.parametrize("scale", [1e-2, 1.0, 1e7, 1e14])
def test_whitening_of_large_entries(spark, scale):
    """Entries whose products pass the doubles' and the longs' whole numbers."""
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 5)) * scale + 40 * scale).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    check_whitening(whitening.whitened(df, components=3).collect(), vectors, list(range(60)), 3)


def test_scatter_is_exact():
    rng = np.random.default_rng(0)
    for top in (10, 1 << 24, 1 << 40, 1 << 62):
        y = rng.integers(-top, top, (50, 4))
        s, p = whitening.scatter(y)
        z = y.tolist()
        assert s.tolist() == [sum(r[i] for r in z) for i in range(4)]
        assert p.tolist() == [[sum(r[i] * r[j] for r in z) for j in range(4)] for i in range(4)]
        assert all(sum(v << (30 * k) for k, v in enumerate(whitening._limbs(int(x)))) == x for x in p.ravel())


def test_whitening_odd(spark):
    kinds = "vec_id long, embedding array<float>, n int, component string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [0.25, -2.0]), (None, [0.125, 3.0]), (1, [0.5, 1.0]), (8, [1.0])]
    got = whitening.whitened(spark.createDataFrame([(*r, 1, "x") for r in rows], kinds).repartition(3)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i in (1, 1, 7, None) for c in (1, 2))
    assert {r["n"] for r in got} == {4}
    assert whitening.whitened(spark.createDataFrame([], kinds)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(2, None, 1, "x")], kinds)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1, "x")], kinds)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 1, "x") for i in range(9)], kinds)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)} and flat[0]["identity_error"] < 1e-9


# op13


def sets_by_force(texts, k=3):
    out = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", lowered(t or ""))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    return out


def groups_by_force(rows):
    sets = sets_by_force([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                links += a != sets[j]
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)), d == low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str), links


def found_groups(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_groups_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = groups_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found_groups(queries.op13_minhash_groups(spark, sf_dir)) == want


def test_groups_odd(spark, odd, empty):
    assert minhash.near_duplicates(empty).collect() == []
    got = found_groups(minhash.near_duplicates(odd))
    want, _ = groups_by_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got == want
    assert all(r[2] == r[0] and r[3] for r in got if r[1] == 0)


@pytest.mark.parametrize("block", [256, 8])
def test_groups_at_the_edge_of_the_similarity(spark, monkeypatch, block):
    """Texts whose similarities lie on both sides of 0.85, some just at it, in chains and around originals."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = np.random.default_rng(8)
    texts = []
    for n in range(12):
        own = prose(300 + n, int(rng.choice([9, 19, 40, 120, 400]))).split()
        for m in range(10):
            words = list(own)
            for i in rng.choice(len(words), int(len(words) * rng.choice([0, 0.01, 0.02, 0.03, 0.05])), replace=False):
                words[int(i)] = f"e{n}x{m}x{i}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 3))]))
    exact = [f"w{i} v{i}" for i in range(30)]
    texts += [" ".join(exact[:20]), " ".join(exact[:17]), " ".join(exact[:23])]
    rows = list(enumerate(texts))
    want, links = groups_by_force(rows)
    assert links > 40
    assert found_groups(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_sketch_fills_and_agrees_like_the_sets():
    """Every coordinate is filled for sets of any size; the share of equal ones is the similarity, within five deviations."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 900, 5000):
        both, size = [], []
        for _ in range(60):
            h = np.unique(rng.integers(0, 1 << 63, n + n // 5 + 1, np.uint64))
            a, b = h[:n], h[len(h) - n :]
            x, y = minhash.sketch(a), minhash.sketch(b)
            assert not (x == (1 << 64) - 1).any()
            both.append((x == y).sum())
            size.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        s = float(np.mean(size))
        assert abs(np.mean(both) / minhash.SIZE - s) < 5 * np.sqrt(max(s * (1 - s), 1e-9) / (minhash.SIZE * 60)) + 1e-9
        assert np.var(both) < 2.5 * minhash.SIZE * s * (1 - s) + 1


def test_sketch_takes_the_first_round_that_fills():
    """Each coordinate by the definition, round by round."""
    own = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 40, np.uint64))
    want = [None] * minhash.SIZE
    for i in range(2 * minhash.SIZE):
        if None not in want:
            break
        for x in own:
            h = int(minhash._mixed(np.array([x ^ minhash._ROUNDS[i]]))[0])
            at = ((h >> 32) * minhash.SIZE) >> 32 if i < minhash.SIZE else i - minhash.SIZE
            value = (i << 32) | (h & 0xFFFFFFFF)
            want[at] = value if want[at] is None else min(want[at], value)
    assert minhash.sketch(own).tolist() == want


def test_new_queries_have_their_columns(spark, sf_dir):
    want = {
        "op11_spelling_variants": [("word", T.StringType()), ("form", T.StringType()), ("root", T.StringType()), ("n", T.LongType()), ("n_near", T.LongType()), ("form_n", T.LongType())],
        "op13_minhash_groups": [("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("component_id", T.LongType()), ("kept", T.BooleanType())],
    }
    for name, columns in want.items():
        out = queries.queries()[name](spark, sf_dir)
        assert [(f.name, f.dataType) for f in out.schema] == columns
        assert out.where(F.col("n_near").isNull() if "n_near" in out.columns else F.col("kept").isNull()).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, sf_dir, name):
    from compare import difference

    assert difference(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) == ""
