"""Licences, BPE, chat, PII, quality and packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tindra.llm import bpe, chat, licenses, packing, pii, quality, queries
from tindra.llm.common import table

LIC = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. mit-license MIT LICENSE", "Licensed under CC BY-NC 4.0.", "All rights reserved. cc bykes", "MİT license gnu general public", "GNU lesser general public licence; the gnu general public license"]


def plain_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for t in licenses.templates():
        n, (k, m) = len(t["words"]), t["key"]
        for s in range(len(w)):
            got = w[s : s + n]
            same = [a == b for a, b in zip(got, t["words"])]
            if sum(same) >= t["need"] and len(same) >= k + m and all(same[k : k + m]):
                hits.append((t["label"], s, sum(same) / n, t["base"]))
    base = [h for h in hits if h[3]]
    return (len(w), len(base), min((h[1] for h in base), default=None), max((h[1] for h in base), default=None), ",".join(sorted({h[0] for h in base})), ",".join(sorted({h[0] for h in hits})), max((h[2] for h in hits), default=0.0))


def test_licenses(frame, odd):
    rows = odd + [(100 + i, x) for i, x in enumerate(LIC)] + [(200, " ".join(LIC))]
    got = licenses.report(frame(rows)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_licenses(t)) for i, t in rows)


def test_licenses_empty(frame):
    assert licenses.report(frame([])).count() == 0


@pytest.fixture(scope="module")
def coders():
    import base64

    import public_tokenizers as P
    import tiktoken

    vocab = bpe.read_vocabulary(P.path(queries.TOKENIZER))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
    return vocab, P.PATTERN, bpe.ByteBPE(vocab, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_tiktoken(coders, sf_dir):
    import pyarrow.parquet as pq

    _, _, own, ref = coders
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\tab'sll1.é日  \xa0\x1cABZ|") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["x" * 3000, "ab" * 3000, "<|endoftext|>", " ", "  ", "\n \n", "ﬁ🙂" * 90] + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    packed = own.encode_packed(texts)
    for t, p in zip(texts, packed, strict=True):
        assert np.frombuffer(p, "<u4").tolist() == ref.encode_ordinary(t)
        assert own.decode_packed(p) == t.encode()


def test_bpe_small_caches(coders, monkeypatch):
    vocab, pattern, _, ref = coders
    monkeypatch.setattr(bpe, "CACHE", 10)
    own = bpe.ByteBPE(vocab, pattern)
    texts = [f"word{i} some  other{i * 7}\n \n it's {i}" for i in range(60)]
    assert [np.frombuffer(p, "<u4").tolist() for p in own.encode_packed(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_bpe_frames(frame, odd, coders):
    vocab, pattern, _, ref = coders
    df = frame(odd)
    want = Counter((i, len(ids := ref.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd)
    assert Counter(map(tuple, bpe.digests(df, vocab, pattern).collect())) == want
    back = bpe.decode(bpe.encode(df, vocab, pattern), vocab, pattern).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t in odd)
    assert bpe.digests(frame([]), vocab, pattern).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "\\", "a\\", "\\\\[INST]", "[/INST", "<", "[:]", "[ROLE]x[:]y[/ROLE]", "", "plain", "ends [", "<s><s>", "\n[ANS]", "日\\</s>"]


def test_chat_turns_round_trip():
    for role in ("user", "assistant", "system", "", "[:]", "a\\b[/ROLE]"):
        for text in NASTY + [a + b for a in NASTY for b in NASTY]:
            assert [x[:2] for x in chat.parse(chat.rendered(role, text))] == [(role, text)]
    whole = "".join(chat.rendered("assistant", t) + chat.rendered("user", t) for t in NASTY)
    assert [x[1] for x in chat.parse(whole)] == [t for t in NASTY for _ in "ab"]
    assert chat.rendered("user", "plain") == "[INST]plain[/INST]"
    for bad in ("x", "[INST]a", "[INST]a</s>", "\\a", "[ROLE]a[/ROLE]"):
        with pytest.raises(chat.Malformed):
            chat.parse(bad)


def test_chat_frames(frame):
    rows = [(i % 3, i // 3, ("user", "assistant", "system")[i % 2 + (i % 7 == 0)], t) for i, t in enumerate(NASTY * 3)]
    rows += [(9, 0, None, None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (8, 0, "user", "z"), (8, 0, "user", "z"), (7, 1, "assistant", "q" * 200_000)]
    df = chat.probe(frame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    all_rows = rows + [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    for conv in {r[0] for r in all_rows}:
        turns = sorted((r for r in all_rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, chat.rendered(r[2], r[3])))
        r, loss = got[conv], "".join(t or "" for _, _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert r.formatted_chars == 3 + sum(len(chat.rendered(role, t)) for _, _, role, t in turns)
    assert len(got) == len({r[0] for r in all_rows})


# ---- personal data
PII = [
    "mail a.b+c@mail8.example.com, x@y z@w.de and @@a@b.c.d", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1..2.3.4", "card 4539 1488 0343 6467 4539148803436467x 1234567890123456 4-5-3-9-1-4-8-8-0-3-4-3-6-4-6-7", "phone +1 (988) 555-2485, +44 20 7946 0958 1 +12 +1234567890123456",
    "password=b7db7aa4a5fcc78305 token = \"1beb58b8af68854f\" (212) 555-0199", "name [at] mail (dot) example.com", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "", None, "日本 a@b.co 日本", "9" * 5000, "a@" * 3000, "+1 " + "(" * 3000, "1." * 3000,
]


def plain_base(text):
    text, out = text or "", []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_pii_base_is_the_contract():
    rng = random.Random(5)
    texts = [t for t in PII if t is None or len(t) < 4000] + ["".join(rng.choice("0123456789 .-+()@ab.") for _ in range(60)) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t or "") == plain_base(t), t


def test_pii_frames(spark, frame):
    df = frame([(i, t) for i, t in enumerate(PII)] + [(None, PII[0]), (0, PII[0])])
    got = pii.report(spark, df).collect()
    assert len(got) == len(PII) + 2
    for r in got:
        base = plain_base(PII[r.doc_id or 0])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",") if r.spans else [])
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[8].text is None and out[9].text == "日本 [EMAIL] 日本" and out[0].key == "x"
    assert "b7db7aa4" not in out[4].text and "@mail8" not in out[0].text
    assert pii.report(spark, frame([])).count() == 0 and pii.redact(frame([])).count() == 0


def test_pii_em_prefers_agreement():
    p, _ = pii.reliabilities({"0yyyyy": 900, "0yyn-y": 20, "0--n-n": 50, "4-y-yy": 300, "4-n-yn": 10})
    assert p["0yyyyy"] > 0.9 and p["0--n-n"] < p["4-y-yy"]


# ---- quality
def plain_boosting(x, y):
    """Scores of the rows by boosting that tries every cut of every statistic at every node."""
    share = (y.sum() + 1) / (len(y) + 2)
    f = np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        nodes = [np.arange(len(y))]
        for _ in range(quality.DEPTH):
            below = []
            for rows in nodes:
                best = (1e-6, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + quality.PENALTY)
                for j in range(x.shape[1]):
                    for c in cuts[j]:
                        left = x[rows, j] <= c
                        hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                        if hl >= 1 and hr >= 1:
                            gain = g[rows][left].sum() ** 2 / (hl + quality.PENALTY) + g[rows][~left].sum() ** 2 / (hr + quality.PENALTY) - whole
                            if gain > best[0] + 1e-12:
                                best = (gain, left)
                below += [rows[best[1]], rows[~best[1]]] if best[1] is not None else [rows, rows[:0]]
            nodes = below
        for rows in nodes:
            f[rows] -= quality.STEP * g[rows].sum() / (h[rows].sum() + quality.PENALTY)
    return 1 / (1 + np.exp(-f))


def test_quality_fit_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=150) > 0.3).astype(float)
    assert np.allclose(quality.fit(x, y).score(x), plain_boosting(x, y), atol=1e-9)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    rows = quality.with_score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98


def test_quality_edges(spark, frame, odd):
    df = frame(odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.with_score(df, quality.train(df, none)).collect()} == {(1.0, 1)} or all(r.score > 0.999 for r in quality.with_score(df, quality.train(df, none)).collect())
    one = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rows = quality.with_score(df, quality.train(df, one)).collect()
    assert len(rows) == len(odd) and len({r.score for r in rows}) == 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert quality.with_score(df, quality.train(df, one), keep=True).columns == df.columns
    assert quality.with_score(frame([]), quality.train(frame([]), none)).count() == 0


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    for i in range(20):
        f = m.base
        for feature, cut, value in zip(m.feature, m.cut, m.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[i, feature[node]] > cut[node])
            f += value[node - len(feature)]
        assert abs(m.score(x[i : i + 1])[0] - 1 / (1 + np.exp(-f))) < 1e-12


# ---- packing
def filled(hist, caps, **more):
    """The plan as a list of bins: capacity and contents in order; and that it is a plan."""
    placed, bins = packing.best_fit(hist, caps, **more)
    content = {}
    for n, rank, k, first, off, each in placed:
        for i in range(k):
            content.setdefault(first + i // each, []).append((off + i % each * n, n))
    assert Counter(n for x in content.values() for _, n in x) == Counter({k: v for k, v in hist.items() if v})
    size = {first + i: (used, cap) for first, n, used, cap in bins for i in range(n)}
    assert set(size) == set(content)
    for b, items in content.items():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert size[b] == (at, min(c for c in caps if c >= at))
    return sorted((size[b][1], tuple(n for _, n in sorted(items))) for b, items in content.items())


def plain_best_fit(hist, caps, overhead, span):
    """Piece by piece: the open bin with the least room, else a bin of the least cost by a trial fill, chosen once a length."""
    left, bins, size = dict(hist), [], {}
    for n in sorted((x for x, k in hist.items() for _ in range(k)), reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if not fits:
            def cost(c):
                space, got, have = c - n, n, {**left, n: left[n] - 1}
                for m in sorted(have, reverse=True):
                    take = min(have[m], space // m)
                    got, space = got + take * m, space - take * m
                return (overhead + c + c * c / span) / got
            if n not in size:
                size[n] = min((c for c in caps if c >= n), key=lambda c: (cost(c), -c))
            bins.append([size[n], []])
            fits = bins[-1:]
        best = min(fits, key=lambda b: (b[0], -sum(b[1])))
        best[0] -= n
        best[1].append(n)
        left[n] -= 1
    return sorted((min(c for c in caps if c >= sum(x)), tuple(x)) for _, x in bins)


def test_best_fit_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(150):
        caps = tuple(sorted(rng.sample(range(8, 60), 3)))
        hist = {n: rng.randint(0, 12) for n in {rng.randint(1, caps[-1]) for _ in range(rng.randint(0, 12))}}
        overhead, span = rng.choice([0, 1, 9]), rng.choice([10, 64, 1000])
        got, want = filled(hist, caps, overhead=overhead, span=span), plain_best_fit(hist, caps, overhead, span)
        assert sorted((c, sum(x)) for c, x in got) == sorted((c, sum(x)) for c, x in want), (hist, caps)
    assert packing.best_fit({}) == ([], [])
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, (8,))
    assert filled({7: 1, 5: 1, 3: 1, 2: 1}, (10,)) == [(10, (5, 2)), (10, (7, 3))]


def test_costs_use_several_sizes():
    rng = random.Random(4)
    hist = Counter(min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(3000))
    sizes = Counter(c for c, _ in filled(hist, packing.CAPACITIES))
    assert len(sizes) >= 3 and sum(n * k for n, k in hist.items()) > 0.9 * sum(c * k for c, k in sizes.items())


def test_packing_frames(spark, frame, odd):
    rows = odd + [(1000 + i, "w " * (i % 40 + 1)) for i in range(400)] + [(1500, "same words") for _ in range(300)]
    got = packing.pack(spark, frame(rows), capacities=(8, 16, 64)).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
    want = Counter()
    for i, t in rows:
        want[i] += len(re.findall(r"[^ \t\n\x0b\f\r]{1,8}", t or ""))
    assert words == want
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for items in bins.values():
        at = 0
        for r in sorted(items, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_capacity for r in items} == {min(c for c in (8, 16, 64) if c >= at)}
    pieces = sorted((r.piece, r.first_token, r.n_tokens) for r in got if r.doc_id == 7)
    assert [p[1] for p in pieces] == [64 * i for i in range(len(pieces))] and sum(p[2] for p in pieces) == 20_000
    assert sum(r.n_tokens for r in got if r.doc_id == 6) == 6250  # a word of 50,000 characters
    assert packing.pack(spark, frame([])).count() == 0
    given = spark.createDataFrame([(1, 70), (2, 5), (3, None)], "doc_id long, tokens int").withColumn("text", F.lit("x"))
    got = sorted((r.doc_id, r.n_tokens) for r in packing.pack(spark, given, capacities=(8, 16, 64), measured="tokens").collect())
    assert got == [(1, 6), (1, 64), (2, 5), (3, 0)]


def plain_em(counts, rounds=50):
    """Dawid and Skene's EM for two classes, one candidate at a time."""
    items = [(p[0], p[1 : pii.VOTES], n) for p, n in counts.items()]
    prob = {}
    for k, v, _ in items:
        y, n = v.count("y"), v.count("n")
        prob[k, v] = min(max((y + 0.5) / (y + n + 1), 0.05), 0.95)
    for _ in range(rounds):
        prior = {k: (sum(n * prob[q, v] for q, v, n in items if q == k) + 2) / (sum(n for q, _, n in items if q == k) + 4) for k, _, _ in items}
        rate = {}
        for j in range(len(pii.LABELERS)):
            for true, extra in ((1, 3), (0, 1)):
                w = [(n * (prob[k, v] if true else 1 - prob[k, v]), v[j]) for k, v, n in items]
                rate[j, true] = (sum(x for x, c in w if c == "y") + extra) / (sum(x for x, c in w if c != "-") + 4)
        new = {}
        for k, v, _ in items:
            yes, no = prior[k], 1 - prior[k]
            for j, c in enumerate(v):
                if c == "y":
                    yes, no = yes * rate[j, 1], no * rate[j, 0]
                elif c == "n":
                    yes, no = yes * (1 - rate[j, 1]), no * (1 - rate[j, 0])
            new[k, v] = yes / (yes + no)
        prob = new
    return {k + v: p for (k, v), p in prob.items()}


def test_pii_em_is_the_plain_one():
    rng = random.Random(8)
    counts = {f"{rng.randint(0, 4)}{''.join(rng.choice('yn-') for _ in range(5))}": rng.randint(1, 500) for _ in range(60)}
    got, _ = pii.reliabilities({f"{p}000000": n for p, n in counts.items()})
    want = plain_em(counts)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in got)


def test_pii_classifier_sees_the_span():
    """Two kinds of spans with the same votes are told apart by their features, as far as their votes' company suggests."""
    text = "key = a1b2c3d4e5f6 and token"
    assert pii.features(text, "a1b2c3d4e5f6", "123456", 6, 18) != pii.features(text, "and", "", 19, 22)
    base = {"4yyyyy120012": 500, "4-nnnn000033": 500}
    p = pii.classifier({**base, "4---y-120012": 40, "4---y-000033": 40})
    assert p["4---y-120012"] > p["4---y-000033"] and p["4yyyyy120012"] > 0.5 > p["4-nnnn000033"]
