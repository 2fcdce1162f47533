"""Brute-force versions of what the digests hold: statistics and fit, rules, stretches, pages, landmarks, places; very long texts."""

import json
import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from words import prose

from gaugeworks.llm import bpe, license_scan, media, packing, quality, queries, secret_scan, simhash, substring, syncmers, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# operator 1


def brute_statistics(text):
    words, chars = text.split(), text.encode()
    n, prior = len(words), 40
    mean = (sum(map(len, words)) + prior * 5) / (n + prior)
    spread = math.sqrt((sum((len(w) - mean) ** 2 for w in words) + prior * 9) / (n + prior))
    share = lambda x, of, usual, weight: math.log(0.001 + (x + usual * weight) / (of + weight))
    symbols = [c for c in map(chr, chars) if "!" <= c <= "~" and not c.isalnum() and c not in ".,'\"-"]
    lines = [x for x in text.split("\n") if x]
    return [
        math.log(n + 1), math.log(mean), math.log(spread), share(sum("A" <= chr(c) <= "Z" for c in chars), len(chars), 0.02, 240), share(sum("0" <= chr(c) <= "9" for c in chars), len(chars), 0.001, 240),
        share(len(symbols), len(chars), 0.001, 240), share(text.count(".") + text.count(","), n, 0.15, prior), math.log((len(set(words)) + prior) / (n + prior)),
        share(sum(len(w) <= 3 for w in words), n, 0.4, prior), share(len(lines) - len(set(lines)), len(lines), 0.0, 4), share(len(lines), n, 0.03, prior),
    ]


def test_statistics(docs, odd):
    for df in (docs, odd):
        for r in df.select("text").collect():
            assert np.allclose(quality.statistics(r["text"] or ""), brute_statistics(r["text"] or ""))


def test_fit_and_scores(spark):
    """Moments, shrinkage, priors and the fold, from the rows themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    x = {i: brute_statistics(t) for i, t in texts.items()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in x and r["quality"] is not None}
    train = [i for i in y if zlib.crc32(str(i).encode()) % 5]
    rows = [np.array([x[i] for i in train if y[i] == c]) for c in (0, 1)]
    cov = [np.cov(r.T, bias=True) for r in rows]
    common = sum(len(r) * c for r, c in zip(rows, cov, strict=True)) / len(train)
    density = []
    for r, c in zip(rows, cov, strict=True):
        own = 0.95 * c + 0.05 * common
        own = 0.95 * own + 0.05 * np.diag(np.diag(own)) + 1e-4 * np.eye(len(c))
        inverse, logdet = np.linalg.inv(own), np.linalg.slogdet(own)[1]
        d = np.array(list(x.values())) - r.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d) - 0.5 * logdet + math.log((len(r) + 1) / (len(train) + 2)))
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))), strict=True))
    got = {r["doc_id"]: r["score"] for r in queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}


# operator 2


def expansions(tree):
    """Texts that a parsed pattern matches: each alternative, with and without each optional part."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in arg])
        elif name == "SUBPATTERN":
            parts.append(expansions(arg[3]))
        elif name == "BRANCH":
            parts.append([e for b in arg[1] for e in expansions(b)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            parts.append(sorted({e * k for e in expansions(inner) for k in {low, min(high, low + 1)}}))
        elif name == "ANY":
            parts.append(["z"])
        elif name in ("ASSERT", "ASSERT_NOT"):
            parts.append([""])
        else:
            raise ValueError(name)
    if math.prod(map(len, parts)) <= 3000:
        return ["".join(p) for p in product(*parts)]
    first = [p[0] for p in parts]  # else each choice once, the others fixed
    return ["".join([*first[:i], e, *first[i + 1 :]]) for i, p in enumerate(parts) for e in p]


def matching(rule):
    """Texts (normalised words) in which a rule's own pattern matches, one at least for each alternative."""
    inner = rule.pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")
    texts = {f"^ {e.strip()} {tail}" for e in expansions(re._parser.parse(inner)) for tail in ("", "licensed under it ")}
    return [t for t in sorted(texts) if "  " not in t and re.search(rule.pattern, t)]


def test_every_rule_implies_its_gate():
    by_keyword = license_scan._by_keyword()
    gate = re.compile(license_scan.keyword_pattern(by_keyword))
    rules = license_scan.rules()
    assert len(rules) > 500 and len({r.pattern for r in rules}) == len(rules)
    for n, r in enumerate(rules):
        texts = matching(r)
        assert texts, r
        for t in texts:
            assert r.keyword in t and r.also in t, (r, t)
            reached = {x["rule"] for k in set(gate.findall(t)) for x in by_keyword[k]}
            assert n in reached, (r, t)


def brute_labels(text):
    """Every rule on the whole text, with plain loops; nothing decides beforehand which rules are tried."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm = "^ " + " ".join(words) + " "
    found = [(m.start(), m.end(), r.priority, n, r.label) for n, r in enumerate(license_scan.rules()) for m in re.finditer(r.pattern, norm)]

    def overruled(d):
        for e in found:
            inside = e[0] <= d[0] and d[1] <= e[1]
            longer = e[1] - e[0] > d[1] - d[0]
            if e[0] < d[1] and d[0] < e[1] and (e[2] > d[2] or (e[2] == d[2] and inside and (longer or (e[:2] == d[:2] and e[3] < d[3])))):
                return True
        return False

    kept = [d for d in found if not overruled(d)]
    base = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in norm.replace("^", "", 1)}
    top = max([d[2] for d in kept] + [2] * bool(base), default=None)
    return ",".join(sorted({d[4] for d in kept} | base)), 0.0 if top is None else 0.25 + 0.15 * top


def test_labels_of_whole_tables(spark, sf_dir, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for path in (sf_dir, str(tmp_path)):
        rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
        got = Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in queries.op2_license_scan(spark, path).collect())
        assert got == Counter((r["doc_id"], (b := brute_labels(r["text"]))[0], round(b[1], 9)) for r in rows)


def test_labels_of_signatures(spark):
    """A text for each rule, and each again among words of others."""
    texts = [matching(r)[0][2:] for r in license_scan.rules()]
    texts += [prose(i, 20) + " " + texts[i] + " mit " + texts[(i * 7 + 3) % len(texts)] for i in range(0, len(texts), 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in license_scan.license_labels(df).collect():
        want, score = brute_labels(texts[r["doc_id"]])
        assert ",".join(r["labels"]) == want != "" and abs(r["score"] - score) < 1e-9, texts[r["doc_id"]]


# operator 3


def brute_stretches(text, begin, end, model, threshold):
    """Stretches of a run that look generated, from all pairs of ends."""
    if end - begin < secret_scan.CANDIDATE:
        return []
    at = [secret_scan.ALPHABET.index(c) for c in text[begin:end]]
    inner = [i < 62 for i in at]
    n = len(at)
    starts = [i for i in range(n) if i == 0 or (inner[i] and not inner[i - 1])]
    ends = [i for i in range(n) if i == n - 1 or (inner[i] and not inner[i + 1])]
    mass = lambda s, e: model.first[at[s]] + sum(model.step[at[i], at[i + 1]] for i in range(s, e))
    found = [(mass(s, e) - threshold * (e - s + 1), s, e) for s in starts for e in ends if e - s + 1 >= secret_scan.CANDIDATE]
    best = max(found, default=(0, 0, 0))
    if best[0] <= 0:
        return []
    top = [f for f in found if f[0] > best[0] - 1e-9]
    _, s, e = min(top, key=lambda f: (f[2], f[1]))
    s = max((x for x in starts if x <= s), key=lambda x: (mass(x, e), -x))
    e = max((x for x in ends if x >= e), key=lambda x: (mass(s, x), -x))
    left, right = brute_stretches(text, begin, begin + s, model, threshold), brute_stretches(text, begin + e + 1, end, model, threshold)
    return [*left, (begin + s, begin + e + 1), *right]


def brute_segments(text, model):
    """What is left of a run without its ordinary parts, by their definition."""
    parts = [(m.start(), m.end(), len(m[0]) * model.ratio(m[0])) for m in re.finditer("[A-Za-z0-9]+", text)]
    gone, i = [], 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j][2] < 0:
            j += 1
        if j > i and sum(x for *_, x in parts[i:j]) <= secret_scan.ORDINARY:
            gone.append((parts[i - 1][1] if i else 0, parts[j][0] if j < len(parts) else len(text)))
        i = max(j, i + 1)
    ends = [0, *(x for g in gone for x in g), len(text)]
    return [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b]


def test_random_stretches():
    model = secret_scan.train(secret_scan.labelled_samples())
    rng = np.random.default_rng(11)
    letters = list(secret_scan.ALPHABET[:62])
    for n in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            parts.append("".join(rng.choice(letters, int(rng.integers(4, 34)))) if rng.random() < 0.5 else str(rng.choice(secret_scan._PARTS)))
        text = str(rng.choice(list("_/-=+"))).join(parts)
        got = sorted(secret_scan._random_parts(text, 0, len(text), model, secret_scan.THRESHOLD))
        want = [x for a, b in brute_segments(text, model) for x in brute_stretches(text, a, b, model, secret_scan.THRESHOLD)]
        assert got == sorted(want), text


RULERS = ["-" * 24, "_" * 20, "=" * 80, "x" * 24, "+-" * 20, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "AaBbCcDdEeFfGgHhIiJjKkLl", "zyxwvutsrqponmlkjihgfedcba", "qwertyuiopasdfghjklzxcvbnm"]
DATES = ["2024-01-15_2024-02-17-102231", "20240115-120000_20240116-130000", "2024/01/15/08/30/00/2024", "1-2-3_4-5-6_7-8-9-10-11-12", "/usr/local/lib/python3/site-packages/module_name", "the-quick-brown-fox-jumps-over-the-lazy-dog"]


@pytest.mark.parametrize("text", [*RULERS, *DATES, *(u * 9 for u in ("Xk3", "Zx9Qp", "a1-B2=", "Tr8Vb6Nw"))])
def test_rulers_alphabets_repeats_and_dates_are_no_secrets(text):
    model = secret_scan.train(secret_scan.labelled_samples())
    assert [x for x in secret_scan.scan(f"see {text} end", model) if x[2] == 3] == []


def test_ordinary_parts_between_secrets_stay():
    """Strings of a generator that trains nothing here, behind and before names and paths; only they are found.

    They hold - and _ as well, so a few letters at an end may stay.
    """
    model = secret_scan.train(secret_scan.labelled_samples())
    rng = np.random.default_rng(21)
    import base64

    whole = long = 0
    for n in range(60):
        values = [base64.urlsafe_b64encode(rng.bytes(24)).decode() for _ in range(3)]
        names = [str(rng.choice(["configuration", "deployments/production", "database_connection"])) for _ in range(4)]
        text = "/".join(x for p in zip(names, [*values, ""], strict=True) for x in p).rstrip("/")
        found = [(s, e) for s, e, k in secret_scan.scan(text, model) if k == 3]
        at = [text.index(v) for v in values]
        whole += sum(sum(max(0, min(e, a + 32) - max(s, a)) for s, e in found) >= 24 for a in at)
        long += sum(any(text[s:e].count(x) for s, e in found) for x in names)
    assert whole >= 0.97 * 180 and long <= 4


def test_ratio_is_that_of_the_two_chains():
    samples = secret_scan.labelled_samples(300)
    model = secret_scan.train(samples)
    first, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for s, label in samples:
        first[label][s[0]] += 1
        pairs[label].update(zip(s, s[1:], strict=False))
    size = len(secret_scan.ALPHABET)

    def log_likelihood(s, c):
        out = math.log((first[c][s[0]] + 0.5) / (sum(first[c].values()) + 0.5 * size))
        for a, b in zip(s, s[1:], strict=False):
            out += math.log((pairs[c][a, b] + 0.5) / (sum(v for (x, _), v in pairs[c].items() if x == a) + 0.5 * size))
        return out

    for s, _ in samples[::60]:
        assert math.isclose(model.ratio(s), (log_likelihood(s, 1) - log_likelihood(s, 0)) / len(s), abs_tol=1e-9)


# operator 4


def brute_page(html):
    """Text, title and links of a page of the kind in ``pages``, with patterns in place of a parser."""
    import html as entities

    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    links = [(m[1].upper(), next(g for g in m.groups()[2:] if g is not None)) for m in re.finditer(r"""(?is)<(a|img|link|script|iframe)\b[^>]*?\s(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", html)]
    return " ".join(entities.unescape(title[1]).split()) if title else "", [(t, entities.unescape(u)) for t, u in links]


def test_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    made = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    for r in made:
        _, block = warc.parse(r["record"])
        title, links = brute_page(pages[r["page_id"]])
        if r["warc_type"] == "metadata":
            meta = json.loads(block)
            assert meta["title"] == title
            assert [(x["path"].split("@")[0], x["url"]) for x in meta["links"]] == links
        else:
            # every word of the text stands in the page, in this order, outside tags
            plain = re.sub(r"(?is)<(script|style|noscript|template|head|svg)\b.*?</\1>|<!--.*?-->", " ", pages[r["page_id"]])
            import html as entities

            words = entities.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)</?(?:p|div|li|br|h[1-6]|tr|td|th|ul|ol|table|nav|footer|header|section|article|main|aside|body|html|blockquote|pre|form)\b[^>]*>", " ", plain))).split()
            assert block.decode().split() == words


# operator 5


def brute_landmarks(found):
    out = []
    for t, row in enumerate(found):
        for i, a in enumerate(row):
            out += [(t, int(a) << 16 | int(b) << 8) for b in row[i + 1 :]]
            out += [(t, int(a) << 16 | int(b) << 8 | d) for d in (1, 2) if t + d < len(found) for b in found[t + d]]
    return sorted(out)


def brute_power(payload):
    n = max(1, -(-len(payload) // 128))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 255) for i in range(256)]
    angle = -2j * math.pi / 256 * np.outer(np.arange(129), np.arange(256))
    frames = [[(payload[t * 128 + i] - 128) * window[i] if t * 128 + i < len(payload) else 0.0 for i in range(256)] for t in range(n)]
    return np.abs(np.exp(angle) @ np.array(frames).T).T


def test_features(spark, odd, docs):
    sample = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(20)).where("text is null or length(text) < 6000")
    for r in media.media_columns(sample).collect():
        power, found = brute_power(bytes(r["payload"])), media.peaks(bytes(r["payload"]))
        assert len(found) == len(power)
        for b, (lo, hi) in enumerate(zip(media.BANDS, media.BANDS[1:], strict=False)):
            top = power[:, lo:hi].max(axis=1)
            own = power[np.arange(len(power)), found[:, b]]
            assert ((found[:, b] >= lo) & (found[:, b] < hi) & (own >= top - 1e-3 * np.maximum(1, top))).all()
        assert list(zip(r["times"], r["codes"], strict=True)) == brute_landmarks(found)
        assert len(r["times"]) >= 6


def test_short_texts_have_features_of_their_own(spark):
    texts = [prose(i, 3 + i % 20)[:250] for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(texts))], "doc_id long, text string")
    made = media.media_columns(df).select("codes").collect()
    assert len({tuple(r["codes"]) for r in made}) > 0.8 * len(made)


# operator 9


def brute_sketch(text):
    """{bin: (value, place)} from all k-mers, by the operator's hashes of k-mers and s-mers."""
    k, s = syncmers.K, syncmers.S
    codes = np.array([ord(c) for c in text], np.uint64)
    if not len(codes):
        return {}
    if len(codes) < k:
        anchors = [(int(syncmers._mers(codes, len(codes))[0]), 0)]
    else:
        small, large = syncmers._mers(codes, s), syncmers._mers(codes, k)
        inner = k - s + 1
        anchors = [(int(large[i]), i) for i in range(len(large)) if min(small[i : i + inner]) in (small[i], small[i + inner - 1])]
    out = {}
    for h, at in anchors:
        entry = (min(h >> 32 & 0xFFFF, 0xFFFE), at)
        out[h % syncmers.BINS] = min(out.get(h % syncmers.BINS, entry), entry)
    return out


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    pairs = sorted((a[i][1], b[i][1]) for i in a.keys() & b.keys() if a[i][0] == b[i][0])
    longest = []
    for n, (p, q) in enumerate(pairs):
        longest.append(1 + max((longest[m] for m in range(n) if pairs[m][0] < p and pairs[m][1] < q), default=0))
    return max(longest, default=0) / len(a.keys() | b.keys())


def hexed(sketch):
    return "".join(f"{sketch[i][0]:04x}{sketch[i][1]:08x}" if i in sketch else "ffff00000000" for i in range(syncmers.BINS))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_fingerprints_and_likeness(spark, request, name, tmp_path):
    df = request.getfixturevalue(name)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect()))
    want = []
    for n, (known, i, t) in enumerate(rows):
        after, q = rows[(n + 1) % len(rows)][2], len(t) // 4
        own, edited, other = brute_sketch(t), brute_sketch(t[: len(t) - q] + after[:q]), brute_sketch(after)
        want.append((i if known else None, hexed(own), hexed(edited), round(brute_likeness(own, edited), 9), round(brute_likeness(own, other), 9)))
    got = queries.op9_syncmer_fingerprints(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == Counter(want)


def test_order_counts():
    text = prose(1, 400)
    parts = [text[i : i + 500] for i in range(0, len(text), 500)]
    of = lambda t: syncmers.sketch(syncmers.anchors(t))
    assert syncmers.likeness(of(text), of(text)) == 1
    assert syncmers.likeness(of(text), of("".join(reversed(parts)))) < 0.6 < syncmers.likeness(of(text), of("#" + text[:1700] + "?" + text[1700:]))


# very long texts


LONG = {
    "newlines": "\n" * 1_200_000,
    "blanks": "x" + " " * 1_200_000 + "y",
    "tabs and blanks": ("\t \n" * 400_000) + "end",
    "one letter": "a" * 1_200_000,
    "one word": "".join(chr(97 + i * i % 26) for i in range(1_000_000)),
    "digits": "0123456789" * 120_000,
    "marks": "!?" * 600_000,
    "wide": "日本語" * 300_000,
    "prose": prose(3, 60_000) + " " + prose(4, 60_000),
}


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_long_texts_are_encoded_as_the_library_does(spark, long, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1_000_000)
    docs = spark.read.parquet(f"{long}/documents.parquet")
    word, byte, texts = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE), list(LONG.values())
    for r in bpe.encode_decode(docs, WORD).collect():
        assert r["ids"] == word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    pieces = packing.pack(docs, BYTE).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        got = np.frombuffer(b"".join(p["ids"] for p in pieces if p["doc_id"] == i), "<u4").tolist()
        assert got == [*byte.encode(t, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("name", [n for n in queries.queries() if not n.startswith(("op4_", "op8_", "op10_", "op12_"))])
def test_long_texts_through_every_operator(spark, long, name):
    out = queries.queries()[name](spark, long)
    if name.startswith("op11_"):  # a row a word, not a document
        assert out.where("n_near is null or root is null").isEmpty() and out.count() > 0
        return
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert name.startswith("op6_") or sorted(ids) == list(range(len(LONG)))


def test_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 400_000 + "</p>" + "\n" * 1_000_000)], "page_id long, url string, html string")
    made = {r["warc_type"]: warc.parse(r["record"])[1] for r in warc.derive(warc.responses(pages)).collect()}
    assert made["conversion"].count(b"word") == 400_000


# passages of several partners


def test_stock_lines_side_by_side_are_no_passage(spark):
    """Three lines of 17 words, each first seen in another document: no passage of 50 words stands twice."""
    lines = [prose(700 + i, 17) for i in range(3)]
    texts = [prose(i, 60) + " " + lines[i] + " " + prose(50 + i, 60) for i in range(3)] + [prose(20 + i, 80) + " " + " ".join(lines[i:] + lines[:i]) + " " + prose(90 + i, 80) for i in range(2)] + [" ".join(lines)]
    found = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in found.where("passage_end - passage_start >= 50").collect()} <= {5}
    left = {r["doc_id"]: r["text"] for r in substring.without_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), found).collect()}
    assert all(left[i] == texts[i] for i in range(5))


def test_recall_by_share_of_changed_words(spark):
    """Passages of 60 words whose words are replaced at random: 95 % are found at 8 %, 85 % at 12 %."""
    rng = np.random.default_rng(2)
    for share, least in ((0.0, 1.0), (0.04, 0.97), (0.08, 0.93), (0.12, 0.8)):
        texts = []
        for n in range(60):
            own = prose(2000 + n, 60).split()
            changed = [f"new{n}x{i}" if rng.random() < share else w for i, w in enumerate(own)]
            texts += [prose(n, 80) + " " + " ".join(own) + " " + prose(300 + n, 40), prose(600 + n, 70) + " " + " ".join(changed) + " " + prose(900 + n, 60)]
        found = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passage=40).select("doc_id").distinct().count()
        assert found >= least * 60, (share, found)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """Fingerprints that share a key far beyond a block are linked as brute force links them."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    fps = sorted({0x1234_5678_0000_0000 | int(v) for v in rng.integers(0, 1 << 14, 400)})
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in links)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r["a"])] = root(r["b"])
    got = {frozenset(f for f in fps if root(f) == q) for q in map(root, fps)}
    parent = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    assert got == {frozenset(f for f in fps if root(f) == q) for q in map(root, fps)}


def test_clashing_and_extra_columns(odd):
    assert "score" in odd.columns and quality.accepted(odd.where("false"), odd.select("doc_id", F.lit(1).alias("quality"))).columns == odd.columns


def test_large_group_around_one_original(spark, monkeypatch):
    """Copies that are like the original but not like each other: all are found, in blocks, whichever comes first."""
    monkeypatch.setattr(simhash, "SET_BLOCK", 16)
    rng = np.random.default_rng(4)
    own = prose(4321, 300).split()
    texts = []
    for n in range(120):
        words = list(own)
        for i in rng.choice(300, 6, replace=False):
            words[int(i)] = f"edit{n}x{i}"
        texts.append(" ".join(words))
    texts.append(" ".join(own))
    texts += [prose(5000 + i, 200) for i in range(20)]
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b)
    assert sum(like(s, sets[120]) >= 0.8 for s in sets[:120]) > 20 and sum(like(sets[0], s) >= 0.8 for s in sets[1:120]) < 10
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]) >= 0.8:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()} == {i: root(i) for i in range(len(texts))}
