"""Each query's digest against a brute-force version, over odd documents and the smallest tables."""

import hashlib
import json
import re
import unicodedata
import wave
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer
from words import prose

from gaugeworks.llm import bpe, license_scan, media, packing, quality, queries, secret_scan, simhash, syncmers, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session", params=["odd", "docs"])
def table(request, tmp_path_factory, spark):
    """A folder with the table ``documents``, and its rows as (doc_id, text)."""
    df = request.getfixturevalue(request.param)
    path = tmp_path_factory.mktemp(request.param)
    df.write.parquet(f"{path}/documents.parquet")
    return str(path), [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def same(df, columns, want):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(want)


def test_bpe(spark, table):
    path, rows = table
    tk = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False))))
    same(queries.op8_bpe_round_trip(spark, path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def test_bpe_overlapping_pairs():
    v = bpe.vocabulary(WORD)
    tk = Tokenizer.from_file(WORD)
    for w in ("aaaaaaa", "lalalalalala", "zzzzzzzzzzzzzzzz", "ababababab", "nnnnn"):
        ids, at = v.encode_all([w.encode(), b"x", w.encode()])
        assert ids[at[0] : at[1]].tolist() == ids[at[2] : at[3]].tolist() == tk.encode(w, add_special_tokens=False).ids


def test_packing(spark, table):
    path, rows = table
    tk = Tokenizer.from_file(BYTE)
    pieces = queries.op10_packing(spark, path).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and all(p["offset"] == 0 for p in pieces)
    assert all(p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048 for p in pieces)
    want = []
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        start, rest = 0, len(ids)
        size = 2048
        while rest:
            while size > rest:
                size //= 2
            want.append((i, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()), len(ids)))
            start, rest = start + size, rest - size
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == Counter(want)


def test_cut():
    assert packing.cut(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.cut(1) == [1] and packing.cut(0) == []


def test_syncmers(spark, table):
    path, rows = table
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for n, (known, i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        q = len(t) // 4
        want.append((i if known else None, len(t), sha(t[: len(t) - q] + after[:q])))
    df = queries.op9_syncmer_fingerprints(spark, path)
    same(df, ["doc_id", "n_chars", "edited_sha256"], want)
    by_text = {}
    text_of = {i: t or "" for i, t in rows}
    for r in df.collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text_of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def brute_syncmers(text, k, s):
    """Positions of k-mers whose smallest s-mer (by the operator's hash) is first or last."""
    codes = np.array([ord(c) for c in text], np.uint64)
    h = syncmers._mers(codes, s)
    inner = k - s + 1
    return [i for i in range(len(codes) - k + 1) if min(h[i : i + inner]) in (h[i], h[i + inner - 1])]


def test_closed_syncmers_by_hand(docs):
    for r in docs.limit(5).collect():
        text = r["text"][:800]
        assert syncmers.anchors(text)[1].tolist() == brute_syncmers(text, syncmers.K, syncmers.S)


def test_edit_moves_near_anchors_only():
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    a = set(syncmers.anchors(text)[1].tolist())
    b = set(syncmers.anchors(text[:100] + "#" + text[101:])[1].tolist())
    assert all(100 - syncmers.K < p <= 100 for p in a ^ b)


def test_media(spark, table):
    path, rows = table
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        out = BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((1, 1, media.RATE, 0, "NONE", "NONE"))
            f.writeframes(pad)
        want.append((i, len(raw), len(pad), sha(pad), zlib.crc32(pad[-64:]), len(out.getvalue()), sha(out.getvalue())))
    df = queries.op5_media_columns(spark, path)
    same(df, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"], want)
    assert df.select("payload_sha256", "feature").distinct().count() == df.select("payload_sha256").distinct().count()


def test_pure_tone_peaks_at_its_bin():
    n = np.arange(media.WINDOW * 8)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * n / media.WINDOW)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[:, 1].tolist()) == {20}
    times, codes = media.landmarks(media.peaks(tone))
    n, bands = len(media.peaks(tone)), len(media.BANDS) - 1
    assert n == 16 and len(times) == len(codes) == n * 6 + (n - 1 + n - 2) * bands**2


def test_long_payload_in_runs(monkeypatch):
    data = media.samples(media.to_wav(bytes(range(256)) * 50 + b"tail"))
    whole = media.peaks(data)
    monkeypatch.setattr(media, "FRAMES", 7)
    assert (media.peaks(data) == whole).all()


def brute_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, t=3):
    fps = [(i, brute_fp(text)) for i, text in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= t:
                parent[root(a)] = root(b)
    low = {}
    for n, (i, _) in enumerate(fps):
        r = root(n)
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    return [(i, f"{fp:016x}", low[root(n)]) for n, (i, fp) in enumerate(fps)]


def test_simhash(spark, table):
    path, rows = table
    same(queries.op7_simhash_groups(spark, path), ["doc_id", "fingerprint", "component_id"], brute_groups(rows))


def test_simhash_blocks_find_every_link(spark, monkeypatch):
    """A dense ball of fingerprints, in blocks far smaller than a key's rows."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 150:
        x = base if rng.random() < 0.5 else int(rng.choice(sorted(fps)[:20]))
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps.add(x & (1 << 64) - 1)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    unsigned = dict(zip(signed, fps, strict=True))
    assert all((unsigned[r["a"]] ^ unsigned[r["b"]]).bit_count() <= 3 for r in got)

    def classes(links):
        p = {x: x for x in fps}

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            p[root(a)] = root(b)
        out = {}
        for x in fps:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    brute = [(a, b) for n, a in enumerate(fps) for b in fps[:n] if (a ^ b).bit_count() <= 3]
    assert classes([(unsigned[r["a"]], unsigned[r["b"]]) for r in got]) == classes(brute)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    places = sorted(i for i, _ in at)
    return len(words), len(at), places[0] if at else None, places[-1] if at else None, ",".join(sorted({x for _, x in at}))


def test_license(spark, table):
    path, rows = table
    df = queries.op2_license_scan(spark, path)
    same(df, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], [(i, *brute_base(t)) for i, t in rows])
    for r in df.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def brute_rules(text):
    """Labels by the rules, each tried on every text, with Python's regular expressions and plain loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    norm = "^ " + " ".join(words) + " "
    found = [(m.start(), m.end(), r.priority, n, r.label) for n, r in enumerate(license_scan.rules()) for m in re.finditer(r.pattern, norm)]

    def overruled(d):
        for e in found:
            inside = e[0] <= d[0] and d[1] <= e[1]
            longer = e[1] - e[0] > d[1] - d[0]
            if e[0] < d[1] and d[0] < e[1] and (e[2] > d[2] or (e[2] == d[2] and inside and (longer or (e[:2] == d[:2] and e[3] < d[3])))):
                return True
        return False

    return {d[4] for d in found if not overruled(d)}


TEXTS = [
    "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the Apache License, Version 2.0 (the License)", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "released under the terms of the GNU Lesser General Public License version 3", "GNU Affero General Public License v3", "dual licensed either way MIT or Apache-2.0", "CC BY-NC-SA 4.0 and CC BY 4.0",
    "BSD 3-Clause license", "nothing here", "das ist mit Lizenz", "Mozilla Public License 2.0; Eclipse Public License 1.0",
]


def test_license_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"]) - set(r["base"]) for r in license_scan.license_labels(df).collect()}
    for i, t in enumerate(TEXTS):
        base = set(filter(None, brute_base(t)[4].split(",")))
        assert got[i] == brute_rules(t) - base, t
    assert "lgpl" in got[0] and "mit" in got[2] and got[8] == set() and len(license_scan.rules()) > 200


SHORT = [
    ("Released under Apache 2.0", "apache"), ("distributed under the MPL 2.0", "mpl"), ("BSD 3-Clause", "bsd"), ("EPL 2.0", "epl"), ("CDDL 1.0", "cddl"), ("published under MIT", "mit"),
    ("available under the ISC", "isc"), ("OFL 1.1", "ofl"), ("BSL 1.0", "boost"), ("released under the GNU GPL 3", "gpl"), ("released under the PSF License", "python"), ("Creative Commons Zero 1.0", "cc0"),
]


def test_license_rules_without_any_gate(spark):
    """Every rule tried on every text, whatever its keyword, finds the same labels."""
    texts = [t for t, _ in SHORT] + TEXTS + ["submit or permit commits", "mit freundlichen Grüßen", "see the psf for apache"]
    texts += [re.sub(r"\\|[?]:|[()?]", "", x).replace("|", " ").replace("[cs]", "s") for _, names, *_ in [f[1:] for f in license_scan.FAMILIES] for x in (f"released under {names}", f"{names} license")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"]) for r in license_scan.license_labels(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_rules(t) | set(filter(None, brute_base(t)[4].split(","))), t
    assert all(label in got[i] for i, (_, label) in enumerate(SHORT))


def brute_secrets(text):
    t = text or ""
    out = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    out.sort()
    n = Counter(k for *_, k in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in out))


def test_secrets(spark, table):
    path, rows = table
    df = queries.op3_secret_scan(spark, path)
    same(df, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], [(i, *brute_secrets(t)) for i, t in rows])


def test_secret_model_on_new_samples():
    model = secret_scan.train(secret_scan.labelled_samples())
    new = secret_scan.labelled_samples(1000, seed=99)
    right = sum((model.ratio(s) > secret_scan.THRESHOLD) == bool(y) for s, y in new)
    assert right / len(new) > 0.98
    none = secret_scan.train([])
    assert none.ratio("anything") == 0


@pytest.mark.parametrize("name", ["database_connection_string=", "AZURE_STORAGE_ACCOUNT_CONNECTION=", "/api/v1/users/settings/account/", "config/production/service/credentials/", ""])
def test_values_behind_names_and_paths(name):
    model = secret_scan.train(secret_scan.labelled_samples())
    rng = np.random.default_rng(len(name))
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = 0
    for n in (20, 32, 40) * 30:
        value = "".join(rng.choice(letters, n))
        found += (len(name) + 4, len(name) + 4 + n, 3) in secret_scan.scan(f"see {name}{value} end", model)
    assert found >= 88
    assert not secret_scan.scan(f"see {name}user/settings/default_value_of_the_account end", model)


def test_what_a_pattern_leaves_of_a_run():
    model = secret_scan.train(secret_scan.labelled_samples())
    value = "Zx9Qp4Lm2Tr8Vb6Nw1Ks7Hd3"
    text = f"{value}/deadbeefdeadbeefdeadbeef01/service/{value[::-1]}"
    found = secret_scan.scan(text, model)
    assert all(any(s <= a and a + 24 <= e for s, e, k in found if k == 3) for a in (0, len(text) - 24))
    assert [k for *_, k in found] == [3, 2, 3]


def test_redaction(odd):
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(odd).select("doc_id", "text").collect()}
    assert got[2] is None and got[7].startswith("[assign]") and "AKIA" not in got[7] and "Zx9Q" not in got[7] and "token:abc" in got[7]


def test_quality(spark, sf_dir):
    df = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = df.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in df.collect())


def test_quality_odd(odd, empty, spark):
    labels = spark.createDataFrame([(11, 1), (13, 1), (10, 0), (9, 0), (14, None)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).where("score is null").count() == 0
    assert {r["score"] for r in quality.quality_scores(odd, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_quadratic_density():
    """Scores are those of the two normal densities written out."""
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    cov = [np.cov(rng.normal(size=(d, 50))) + np.eye(d) for _ in range(2)]
    mean = rng.normal(size=(2, d))
    chol = [np.linalg.cholesky(c) for c in cov]
    model = quality.Quadratic(mean, np.array([np.linalg.inv(c) for c in chol]), np.array([-np.log(np.diag(c)).sum() for c in chol]))
    x = rng.normal(size=(7, d))
    log = [[-0.5 * (v - mean[c]) @ np.linalg.inv(cov[c]) @ (v - mean[c]) - 0.5 * np.linalg.slogdet(cov[c])[1] for v in x] for c in (0, 1)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.subtract(log[0], log[1]))))


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = warc.responses(pages)
    made = warc.derive(source).collect()
    by_id = {r["record_id"]: warc.parse(r["record"]) for r in source.collect()}
    assert len(made) == 2 * pages.count() and len({r["record_id"] for r in made}) == len(made)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in made:
        fields, block = warc.parse(r["record"])
        origin, http = by_id[fields["WARC-Refers-To"]]
        assert fields["WARC-Target-URI"] == origin["WARC-Target-URI"] and fields["WARC-Date"] == origin["WARC-Date"]
        assert fields["WARC-Payload-Digest"] == origin["WARC-Payload-Digest"] == warc.digest(html[r["page_id"]].encode())
        assert fields["WARC-Block-Digest"] == warc.digest(block)
        if r["warc_type"] == "metadata":
            meta = json.loads(block)
            assert meta["warc_headers"] == origin and meta["http_status"] == "HTTP/1.1 200 OK"
        else:
            text = block.decode()
            assert "<" not in text.replace("<|", "") or "&lt;" in html[r["page_id"]]
            assert "track(" not in text and "margin:0" not in text


def test_warc_odd(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a &amp; b<script>x()</script></p><p>c"), (2, "v", "<title>T</title>plain"), (2, "v", "<title>T</title>plain")], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages)).collect()
    texts = sorted(warc.parse(r["record"])[1] for r in made if r["warc_type"] == "conversion")
    assert texts == [b"", b"a & b\nc", b"plain", b"plain"]
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "page_id long, record binary")
    assert [r["warc_type"] for r in warc.derive(broken).collect()] == ["metadata", "metadata"]
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


def test_empty_tables(empty):
    assert bpe.encode_decode(empty, WORD).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert syncmers.edited_fingerprints(empty).count() == 0
    assert syncmers.fingerprints(empty).count() == 0
    assert media.media_columns(empty).count() == 0
    assert secret_scan.secret_spans(empty).count() == 0
    assert license_scan.license_labels(empty).count() == 0
    assert simhash.near_duplicate_groups(empty).count() == 0
    assert simhash.similar_groups(empty).count() == 0
    assert simhash.one_of_each_group(empty, simhash.similar_groups(empty)).count() == 0


def test_normal_forms_match_library():
    v = bpe.vocabulary(WORD)
    tk = Tokenizer.from_file(WORD)
    texts = ["é", unicodedata.normalize("NFD", "Ångström"), "ﬁ Ⅳ ½", "a b　c", "x\x1cy", "ΑΣ"]
    ids, _ = bpe._Encoder(v).encode(texts)
    assert [i.tolist() for i in ids] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("shape", ["a{}Y {}1 '{}\u0301", "{}"])
def test_every_code_point_is_encoded_as_the_library_does(shape):
    v, tk = bpe.vocabulary(WORD), Tokenizer.from_file(WORD)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    if shape == "{}":  # random texts of any code points instead
        rng = np.random.default_rng(12)
        texts = ["".join(map(chr, rng.choice(points, rng.integers(1, 12)))) for _ in range(4000)]
    else:
        texts = [shape.format(*[chr(c)] * 3) for c in points[::97]]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        ids, decoded = bpe._Encoder(v).encode(part)
        assert [i.tolist() for i in ids] == [x.ids for x in tk.encode_batch(part, add_special_tokens=False)]
        assert decoded == tk.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


def test_one_of_each_group(odd):
    for groups in (simhash.near_duplicate_groups(odd), simhash.similar_groups(odd)):
        kept = simhash.one_of_each_group(odd, groups).select("doc_id").collect()
        ids = Counter(r["doc_id"] for r in kept)
        assert ids[None] == 1 and ids[16] == 1 and ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[11] == 1 and ids[12] == 0


def jaccard(a, b, k=5):
    a, b = (x.split() for x in (a, b))
    a, b = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_similar_groups(spark):
    """Copies with a few changed words are found; documents that share half their text are not."""
    texts, alike, apart = [], 0, 0
    for n in range(30):
        words = prose(n, 300).split()
        edited = list(words)
        for i in range(3):
            edited[(n * 37 + i * 90) % 300] = f"edit{n}{i}"
        texts += [" ".join(words), " ".join(edited), " ".join(words[:150]) + " " + prose(1000 + n, 150)]
        alike += jaccard(texts[-3], texts[-2]) >= 0.8
        apart += jaccard(texts[-3], texts[-1]) < 0.5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert alike == apart == 30
    assert sum(got[3 * n + 1] == 3 * n for n in range(30)) >= 28
    assert all(got[3 * n + 2] == 3 * n + 2 for n in range(30))


def brute_similar(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in range(len(texts))}


def test_similar_groups_are_exact(spark):
    """Edits spread over the text, from well above to well below the threshold; shared lines, chains of copies."""
    rng = np.random.default_rng(5)
    line, texts = prose(900, 40), []
    for n in range(60):
        words = (prose(n, int(rng.integers(60, 400))) + (" " + line if n % 2 else "")).split()
        texts.append(" ".join(words))
        for share in rng.uniform(0.005, 0.05, 3):
            words = [f"new{n}x{i}" if rng.random() < share else w for i, w in enumerate(words)]
            texts.append(" ".join(words))
    want = brute_similar(texts)
    near = sum(0.8 <= jaccard(texts[i], texts[i + 1]) < 0.85 for i in range(len(texts) - 1))
    assert near >= 8 and sum(want[i] == i for i in want) > 70
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == want


def test_similar_groups_blocks(spark, monkeypatch):
    texts = [prose(5, 200) + f" tail{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert {r["component_id"] for r in simhash.similar_groups(df).collect()} == {0}


def test_license_rules_on_shuffled_phrases(spark):
    words = "mit license apache licensed under the terms of gnu general public version 2 0 cc by sa nc 4 bsd 3 clause or later only spdx identifier mpl dual all rights reserved x".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_labels(df).collect():
        t = texts[r["doc_id"]]
        assert set(r["labels"]) == brute_rules(t) | set(filter(None, brute_base(t)[4].split(",")))


def test_license_text_of_thousands_of_matches(spark):
    df = spark.createDataFrame([(1, "MIT License Apache License " * 1500)], "doc_id long, text string")
    r = license_scan.license_labels(df).first()
    assert r["n_base"] == 3000 and len(r["detections"]) == 3000 and r["labels"] == ["apache", "mit"] and r["last_word"] == 5998


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<![foo[x]]>after", "after"),
        ("<head><title>T</title><p>body text here", "body text here"),
        ("<html><p>a<noscript>b", "ab"),
        ("<p>a<template>b", "ab"),
        ("<p>a<noscript>b</noscript>c", "ac"),
        ("<p>a<!-- b > c", "a c"),
        ("<p>a<!-->b", "ab"),
        ("<title>T<p>body", "body"),
        ("<script>x()", ""),
        ("a < b <3 <", "a < b <3 <"),
        ("<p title='>'>x</p", "x</p"),
        ('<p title=">x</p>', "x"),
        ("<a href=x>y</a><?php z ?>&#99999999999999999999;&#" + "9" * 5000 + ";&amp;&#0000000000065;", "y��&A"),
        ("<div/>a</>b</1>c<br/>d", "abc\nd"),
    ],
)
def test_broken_pages_keep_their_text(html, text):
    assert warc.read_page(html)[0] == text


@pytest.mark.parametrize("unit", ["<a ", "<", "<!--", "</", "<a '", '<a ">" ', "<script", "<title>", "<noscript>", "&#", "<a b=", "<a =", "<a /", "-->", "<![x[", "<template></template>", '<a ">">', "<p a='" + '"'])
def test_broken_pages_take_time_in_proportion(unit):
    import time

    def took(n):
        page = unit * n
        began = time.perf_counter()
        warc.read_page(page)
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 4


def test_byte_soup_gives_two_records_each(spark):
    rng = np.random.default_rng(6)
    bits = ["<", ">", "</", "<!", "--", "-->", "<![", "]]>", '"', "'", "=", " ", "a", "script", "style", "title", "head", "body", "noscript", "&#x", ";", "&", "é", "\u0000", "\r\n", "İ", "p", "/", "<?", "\U0001f600"]
    rows = [(i, f"http://h/{i}\r\nX-Evil: 1\n", "".join(rng.choice(bits, rng.integers(0, 120)))) for i in range(400)]
    made = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert Counter((r["page_id"], r["warc_type"]) for r in made) == Counter((i, k) for i in range(400) for k in ("metadata", "conversion"))
    for r in made:
        fields, block = warc.parse(r["record"])
        assert fields["WARC-Block-Digest"] == warc.digest(block) and "X-Evil" not in fields
        assert fields["WARC-Target-URI"] == f"http://h/{r['page_id']}%0D%0AX-Evil: 1%0A"
