"""Fingerprints, BPE, quality rules, LM scores, PII, licences."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from impulsia.llm import bpe, common, ctw, fingerprints, licences, pii, quality_rules

from . import corpus as C


def by_id(rows):
    return sorted((r.asDict() for r in rows), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_fingerprints_match_edits(spark):
    data = [r for r in C.rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    got = {r["doc_id"]: r for r in by_id(fingerprints.edited_fingerprints(C.frame(spark, data)).collect())}
    order = sorted(data, key=lambda r: -r[0])
    seen = {}
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(own) // 3
        edited = own[: len(own) - k] + after[:k]
        x = got[r[0]]
        assert x["n_chars"] == len(own) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        assert seen.setdefault(own, x["fingerprint"]) == x["fingerprint"]
        a, b = C.shingles(own, low=False), C.shingles(edited, low=False)
        true = len(a & b) / len(a | b) if a | b else 1.0
        # Of the union's hashes a fraction of at least FLOOR, or one in SCALE, is compared: five standard errors.
        seen_of = max(fingerprints.FLOOR, len(a | b) / fingerprints.SCALE)
        assert abs(x["near_edited"] - true) <= 5 * math.sqrt(true * (1 - true) / seen_of) + 1 / seen_of
        if len(a) <= fingerprints.FLOOR and len(b) <= fingerprints.FLOOR:
            assert x["near_edited"] == pytest.approx(true)
    assert len(got) == len(data)


def test_fingerprints_of_odd_tables(spark):
    df = C.frame(spark, C.rows())
    assert fingerprints.edited_fingerprints(df).count() == len(C.rows())
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(df.where("doc_id = 0")).collect()[0]
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprints(df).columns == [c for c in df.columns if c != "fingerprint"] + ["fingerprint"]


@pytest.mark.parametrize("ids", ["sparse", "one", "null", "ties", "large"])
def test_fingerprints_follow_any_ids(spark, ids):
    """Hashed ids, and ids or null ids that a third of the rows and more have: every row has one successor by descending id."""
    rng = random.Random(12)
    of = {"sparse": lambda i: rng.randrange(-(1 << 62), 1 << 62), "one": lambda i: 7 if i % 2 else i, "null": lambda i: None if i % 2 else i, "ties": lambda i: i // 3, "large": lambda i: (1 << 62) + (1 if i % 2 else i)}[ids]
    data = [(of(i), f"{i:04d} " + C.prose(rng, 30)) for i in range(400)] + [(of(1), "the same row")] * 40
    got = fingerprints.edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    key = lambda i: (i is not None, i or 0)
    order = sorted((key(i) for i, _ in data), reverse=True)
    after = collections.defaultdict(set)
    for i, k in enumerate(order):
        after[k].add(order[(i + 1) % len(order)])
    edits = collections.Counter()
    by_id, texts = collections.defaultdict(set), collections.defaultdict(list)
    for i, t in data:
        by_id[key(i)].add(t)
        texts[key(i), len(t)].append(t)
    for r in got:
        k = key(r["doc_id"])
        made = {hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest() for t in texts[k, r["n_chars"]] for n in after[k] for x in by_id[n]}
        assert r["edited_sha256"] in made
        edits[k] += 1
    assert edits == collections.Counter(key(i) for i, _ in data)


def test_fingerprints_merge_and_containment(spark):
    rng = random.Random(3)
    whole, part = C.prose(rng, 8000), None
    part = " ".join(whole.split()[:800])
    other = C.prose(rng, 4000)
    rows = [(1, whole), (2, part), (3, other)]
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert fingerprints.compare(f[2], f[1])[1] == 1.0
    assert fingerprints.compare(f[1], f[2])[1] == pytest.approx(0.1, abs=0.04)
    both = fingerprints.merge(f[1], f[3])
    assert fingerprints.compare(f[3], both)[1] == 1.0 and fingerprints.compare(f[1], both)[1] == 1.0
    assert int(both.split(".")[0], 16) == pytest.approx(12000, rel=0.1)


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    data = C.rows()
    got = by_id(bpe.digests(C.frame(spark, data), path).collect())
    want = []
    for r in data:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got))) == sorted(map(str, want))
    df = C.frame(spark, data)
    back = bpe.decode(bpe.encode(df, path), path)
    assert back.where("coalesce(text, '') <> decoded").count() == 0
    assert bpe.digests(df.limit(0), path).count() == 0


def test_bpe_merges_by_both_ways():
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rng = random.Random(5)
    words = ["".join(rng.choice("aabcdetn -=") for _ in range(rng.randrange(1, 400))).encode() for _ in range(300)]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for w, made in zip(words, codec.encode_words(words), strict=True):
        assert made == codec.merge(w)
    flat, lengths = codec.merger.merge_flat(np.concatenate([codec.singles[np.frombuffer(w, np.uint8)] for w in words]), np.array([len(w) for w in words]))
    at = 0
    for w, n in zip(words, lengths, strict=True):
        assert flat[at : at + n].tolist() == codec.merge(w)
        at += n
    assert lib.encode("tttttttt").ids == codec.encode(["tttttttt"])[0].tolist()


def _quality(t):
    w = C.words(t)
    lines = [x for x in (t or "").split("\n") if C.words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_count_and_keep(spark):
    data = C.rows()
    rng = random.Random(9)
    good = [(10_000 + i, C.prose(rng, rng.randrange(60, 200)), "en", "s", 0, *C.rows()[0][5:]) for i in range(400)]
    bad = [(20_000 + i, " ".join(w + "***" for w in C.prose(rng, 100).split()), "en", "s", 0, *C.rows()[0][5:]) for i in range(60)]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (10_000, None)], "doc_id long, quality int")
    df = C.frame(spark, data + good + bad)
    got = quality_rules.judged(df, labels).collect()
    assert len(got) == len(data) + 460
    texts = {r[0]: r[1] for r in data + good + bad}
    for r in got:
        n = _quality(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(kept[r[0]] for r in good) >= 0.98 * sum(not r["base_failed"] for r in got if r["doc_id"] and 10_000 <= r["doc_id"] < 20_000)
    assert not any(kept[r[0]] for r in bad)
    none = quality_rules.judged(df, labels.limit(0))
    assert none.where("not base_failed and not kept").count() == 0
    assert quality_rules.judged(df.limit(0), labels).count() == 0


def test_quality_rules_bound_the_verdict_not_each_rule(spark):
    """Good documents fail different rules, each under the bound and more of them together."""
    columns = ["doc_id", *quality_rules.COUNTS]
    plain = dict(n_words=1000, word_chars=5000, n_symbols=0, n_dup_lines=0, n_repeat_words=0, n_lines=100, n_upper=0, n_marks=0)
    odd = [dict(n_symbols=900), dict(n_marks=900), dict(n_upper=4000), dict(n_dup_lines=90), dict(n_repeat_words=450), dict(word_chars=30_000)]
    good = [plain | (odd[i % 6] if i < 6 * 150 else {}) for i in range(10_000)]  # 1.5% beyond each
    bad = [plain | odd[i % 6] for i in range(600)]
    rows = [(i, *(x[c] for c in quality_rules.COUNTS)) for i, x in enumerate(good + bad)]
    measured = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(rows))], "doc_id long, quality int")
    found = {r: row[f"cut_{r}"] for row in quality_rules.cutoffs(measured, labels).collect() for r in quality_rules.RULES if row[f"cut_{r}"] is not None}
    fails = " or ".join(["false", *(f"{quality_rules.RULES[r]} > {cut}" for r, cut in found.items())])
    assert measured.where(f"doc_id < {len(good)} and ({fails})").count() <= quality_rules.RISK * len(good)


def _kept_by_hand(rows, labels, risk, level):
    """kept of each (doc_id, stratum, measures or None if the base rules fail), by the method in plain Python."""
    grid, rules = quality_rules.GRID, list(quality_rules.RULES)
    half = {i: h for i, h in labels["half"].items()}
    good = {s: [[m for i, t, m in rows if m and t == s and labels["quality"].get(i) == q and half[i] == h] for h in (0, 1) for q in (1, 0)] for s in {t for _, t, _ in rows}}
    at = {}
    for s, (good0, bad0, _, _) in good.items():
        for k, rule in enumerate(rules):
            fine = [g for g in range(len(grid)) if good0 and sum(m[k] > grid[g] for m in good0) <= risk * len(good0)]
            last = max((g for g in fine if all(x in fine for x in range(g))), default=None)
            if last is None or not any(m[k] > grid[last] for m in bad0):
                continue
            at.setdefault(s, {})[k] = next(g for g in range(last + 1) if sum(m[k] > grid[g] for m in bad0) >= quality_rules.NEARLY * sum(m[k] > grid[last] for m in bad0))
    cuts = {}
    for s, own in at.items():
        held, found = good[s][2], None
        for steps in range(len(grid) - 1, -1, -1):
            lost = sum(any(g >= steps and m[k] > grid[g - steps] for k, g in own.items()) for m in held)
            if not held or quality_rules.upper_bound(lost, len(held), level / len(at)) > risk:
                break
            found = steps
        if found is not None:
            cuts[s] = {k: grid[g - found] for k, g in own.items() if g >= found}
    return {i: m is not None and not any(m[k] > c for k, c in cuts.get(t, {}).items()) for i, t, m in rows}, cuts


@pytest.mark.parametrize("few", [True, False])
def test_quality_rules_keep_what_plain_python_keeps(spark, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "STRATA", 100 if few else 0)
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(2600):
        lang, bad = rng.choice(["en", "en", "de", None, "xx"]), rng.random() < 0.25
        w = C.prose(rng, rng.randrange(40, 90)).split()
        odd = rng.choice([lambda x: x + "$$", lambda x: x.upper(), lambda x: x + "!!!"]) if bad or rng.random() < 0.001 else (lambda x: x)
        docs.append((i, " ".join(map(odd, w)), lang))
        if rng.random() < 0.9 and lang != "xx":
            labels.append((i, int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    label = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.judged(df, label).collect()
    half = {r["doc_id"]: r["half"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()}
    by = {r["doc_id"]: r for r in got}
    measures = lambda r: None if r["base_failed"] else [eval(e, {}, {c: r[c] for c in quality_rules.COUNTS}) for e in quality_rules.RULES.values()]  # noqa: E731, S307
    want, cuts = _kept_by_hand([(i, t or "", measures(by[i])) for i, _, t in docs], {"quality": dict(labels), "half": half}, quality_rules.RISK, quality_rules.LEVEL)
    assert {i: r["kept"] for i, r in by.items()} == want
    assert "en" in cuts and "xx" not in cuts


def test_quality_rules_hold_their_risk_over_many_samples():
    """Of simulated holdouts, no more than LEVEL certify cutoffs whose true false rejection exceeds RISK."""
    rng = np.random.default_rng(3)
    wrong = 0
    for _ in range(400):
        # The true share rejected up to each number of steps, from lenient (many steps) to strict.
        true = np.sort(rng.uniform(0, 0.06, 6))
        n = 1500
        at = rng.multinomial(n, np.diff(np.concatenate([[0], true, [1]])))
        most = {5 - k: int(c) for k, c in enumerate(at[:6])} | {-1: int(at[6])}
        steps = quality_rules.certified(n, most, quality_rules.LEVEL)
        wrong += steps is not None and steps <= 5 and true[5 - steps] > quality_rules.RISK
    assert wrong <= quality_rules.LEVEL * 400 + 3 * math.sqrt(400 * 0.05 * 0.95)


def test_binomial_bound_is_exact():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, level in ((0, 50, 0.05), (3, 200, 0.01), (10, 40, 0.1)):
        u = quality_rules.upper_bound(k, n, level)
        assert tail(k, n, u) == pytest.approx(level, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_lm_scores(spark):
    data = C.rows()
    got = ctw.scored(C.frame(spark, data)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = collections.Counter()
    for r in data:
        if not held(r[0]):
            count.update(C.words(C.lower(r[1])) + ["\0"])
    n, v = sum(count.values()), len(count)
    texts = collections.defaultdict(list)
    for r in data:
        texts[r[0]].append(r[1])
    assert len(got) == len(data)
    for r in got:
        w = C.words(C.lower(texts[r["doc_id"]][0])) + ["\0"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held(r["doc_id"]), len(w), n, sum(count[x] > 0 for x in w))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (len((texts[r["doc_id"]][0] or "").encode()) + 1))
    bits = sorted(r["bits_per_byte"] for r in got if r["held_out"])
    assert bits[len(bits) // 2] < 4.0
    assert ctw.scored(C.frame(spark, data).limit(0)).count() == 0


def test_lm_words_are_asked_where_they_are_counted(spark, tmp_path, monkeypatch):
    """On a table so large that its size sets the number of slots."""
    C.frame(spark, C.rows()).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in ctw.scored(docs).collect())
    monkeypatch.setattr(ctw, "parts", lambda df: common.parts(df, 1 << 12))
    assert 4 < ctw.parts(docs.select("doc_id", "text")) < ctw.parts(docs)
    assert sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in ctw.scored(docs).collect()) == want


def test_lm_counts_of_heavy_slots_are_combined(spark):
    sent = C.plain(spark, C.rows()).select("text").repartition(3).mapInArrow(ctw._count(2), ctw.SENT)

    def sums(df):
        total = collections.Counter()
        for r in df.collect():
            for k, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()):
                total[r["kind"], r["_slot"], k] += n
        return total

    both = ctw.combined(sent, 1 << 12)
    assert sums(both) == sums(sent)
    assert sum(len(r["keys"]) for r in both.collect()) == 8 * len(sums(sent)) < sum(len(r["keys"]) for r in sent.collect())


def test_lm_scores_are_of_the_whole_tree(spark):
    """Against the recursion over all nodes by hand: contexts are kept apart, and one never seen falls back to the longest seen."""
    data = [r for r in C.rows() if len(r[1] or "") < 3000]
    nodes = collections.defaultdict(lambda: [0, 0])

    def steps(t):
        raw = bytes(5) + C.lower(t).encode() + b"\0"
        for i in range(5, len(raw)):
            for k in range(8):
                yield raw[i - 5 : i], 1 << k | raw[i] >> 8 - k, raw[i] >> 7 - k & 1

    for r in data:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            for context, node, bit in steps(r[1]):
                for d in range(6):
                    nodes[context[5 - d :], node][bit] += 1
    longer, weight = collections.defaultdict(float), {}
    for (context, node), (zeros, ones) in sorted(nodes.items(), key=lambda x: -len(x[0][0])):
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)
        whole = own
        if len(context) < 5:
            whole = np.logaddexp(own, longer[context, node]) - math.log(2)
            weight[context, node] = math.exp(own - math.log(2) - whole)
        if context:
            longer[context[1:], node] += whole

    def score(t):
        total = 0.0
        for context, node, bit in steps(t):
            q = None
            for d in range(5, -1, -1):
                if (context[5 - d :], node) in nodes:
                    zeros, ones = nodes[context[5 - d :], node]
                    p, w = (ones + 0.5) / (zeros + ones + 1), weight.get((context[5 - d :], node), 1)
                    q = p if q is None else w * p + (1 - w) * q
            total += math.log10(0.5 if q is None else q if bit else 1 - q)
        return total

    texts = {r[0]: r[1] for r in data}
    for r in ctw.scored(C.frame(spark, data)).collect():
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), rel=1e-9), r["doc_id"]


def test_lm_probabilities_sum_to_one(spark):
    _, _, _, tree = ctw.train(C.plain(spark, C.rows()))
    scorer = ctw.Scorer(tree)
    for context in (b"\0\0\0\0\0", b"there", b" and ", b"zqxjk", "é漢".encode()[-5:]):
        cells = np.arange(256, dtype=np.uint64)
        for d, byte in enumerate(reversed(context), 1):
            cells = cells | (np.uint64(byte) << np.uint64(8 * (ctw.DEPTH - d + 1)))
        assert (10 ** scorer.evaluate(cells)).sum() == pytest.approx(1, abs=1e-5)
    assert np.allclose(scorer.logs(cells), scorer.evaluate(cells)) and np.allclose(scorer.logs(cells), scorer.evaluate(cells))


def test_context_weights_are_the_tree_posterior():
    """Against the recursion over a tiny tree by hand: depth-1 weights of nodes from two-byte contexts."""
    own = ctw.log_kt(np.array([3]), np.array([1]))
    kt = math.log(0.5 * 1.5 * 2.5 * 0.5 / (1 * 2 * 3 * 4))
    assert own[0] == pytest.approx(kt)
    logs, w = ctw._weights(np.array([1 << 8 | 1], np.uint64), np.array([3]), np.array([1]), (np.array([(1 << 8 | 5) << 8 | 1, (1 << 8 | 6) << 8 | 1], np.uint64), np.array([-1.0, -0.5])))
    assert logs[0] == pytest.approx(math.log(0.5 * math.exp(kt) + 0.5 * math.exp(-1.5)))
    assert w[0] == pytest.approx(math.exp(kt) / (math.exp(kt) + math.exp(-1.5)))


def test_pii_permutes_within_formats(spark):
    f = pii.Permutation(b"k")
    assert sorted(f(i, 1000, "t") for i in range(1000)) == list(range(1000))
    assert sorted(f(i, 100, "t", lambda v: v % 2 == 0) for i in range(0, 100, 2)) == list(range(0, 100, 2))
    text = "Mail a.b7@x.example.org, call +1 (499) 555-6503 170.106.47.218, card 4111 1111 1111 1111 or 4111111111111112, on 2021-02-28, 31.12.1999 and 2021-02-30, 123-45-6789, DE89 3704 0044 0532 0130 00, key 6df57b16f87eabefefcab67b433efd90636bb6bd, v2.0."
    made, counts = pii.pseudonymise(text, f)
    assert counts == {"email": 1, "phone": 1, "ip": 1, "card": 1, "date": 2, "ssn": 1, "iban": 1, "secret": 1}
    for old in ("a.b7@", "555-6503", "170.106.47.218", "4111 1111 1111 1111", "2021-02-28", "31.12.1999", "123-45-6789", "0532 0130", "6df57b16"):
        assert old not in made
    assert "4111111111111112" in made and "2021-02-30" in made and "v2.0." in made and "@x.example.org" in made
    card = "".join(c for c in made.split("card ")[1].split(" or")[0] if c.isdigit())
    assert pii.luhn_digit(card[:-1]) == card[-1] and card[0] == "4"
    assert pii.pseudonymise(text, f)[0] == made and pii.pseudonymise(text, pii.Permutation(b"other"))[0] != made


def test_pii_of_odd_tables(spark):
    data = C.rows()
    df = C.frame(spark, data)
    out = pii.pseudonymised(df, b"k")
    assert [c for c in out.columns if c in df.columns] == df.columns
    assert out.count() == len(data) and out.where("text is null").count() == sum(r[1] is None for r in data)
    assert pii.pseudonymised(df.limit(0), b"k").count() == 0


def test_licences(spark):
    rng = random.Random(2)
    filler = [C.prose(rng, 60) for _ in range(40)]
    notices = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "mit": "Released under the MIT License.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "proprietary": "All rights reserved.",
    }
    rows = [(i, t) for i, t in enumerate(filler)] + [(100 + i, C.prose(rng, 40) + "\n" + t) for i, t in enumerate(notices.values())]
    rows += [(200, C.prose(rng, 30) + " released under the MIT License " + C.prose(rng, 30)), (201, None), (202, ""), (203, "Released under the Frobnicate Community License 7."), (204, "the license to drive all"), (None, "x")]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, f in enumerate(notices):
        assert (got[100 + i]["licence"], got[100 + i]["confirmed"]) == (f, True)
    assert got[200]["licence"] == "mit" and got[203]["licence"] == "unknown" and not got[203]["confirmed"]
    assert all(got[i]["n_notices"] == 0 for i in [*range(40), 201, 202, 204])
    df = C.frame(spark, C.rows())
    assert licences.scanned(df).count() == len(C.rows()) and licences.scanned(df.limit(0)).count() == 0
    plan = licences.scanned(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def scanned_by_hand(text, model):
    """Notices (line, family, probability, confirmed) of a text, by the method in plain Python."""
    at = {f: i for i, f in enumerate(model["features"])}
    w, b = model["weights"] / model["temperature"], model["bias"] / model["temperature"]
    lines = [[x for x in regex.split(r"[^\p{L}\p{N}]+", line) if x] for line in (text or "").lower().split("\n")]
    hits = [{g for g in licences.grams(ws) if g in at} for ws in lines]

    def link(i):
        if i + 1 < len(lines) and lines[i] and lines[i + 1]:
            return {(lines[i][-1], lines[i + 1][0])} & at.keys()
        return set()

    def judge(start, end, found):
        z = sum((w[at[g]] for g in found), b)
        e = np.exp(z - z.max())
        best = int(np.argmax(e[:-1]))
        if e[-1] / e.sum() >= 0.5:
            return None
        family, p, alike = licences.CLASSES[best], e[best] / e.sum(), 0.0
        for n in licences.NOTICES.get(family, []):
            ws = licences.words(n)
            pairs = set(zip(ws, ws[1:]))
            alike = max(alike, len(pairs & found) / len(pairs))
        sure = p >= licences.SURE and alike >= licences.CONFIRM
        return {"line": start, "family": family if sure else licences.UNKNOWN, "p": p, "sure": sure, "end": end, "alike": alike}

    alone = [x for x in (judge(i, i, h) for i, h in enumerate(hits) if h) if x]
    own = {x["line"] for x in alone if x["sure"]}
    joined = []
    for i in range(len(lines)):
        if i in own or not (hits[i] or link(i)):
            continue
        found, n, end = set(hits[i]), 0, i
        while end + 1 < len(lines) and end - i < licences.LONGEST and n < licences.LONGEST and lines[end + 1] and end + 1 not in own:
            found |= link(end) | hits[end + 1]
            n += len(lines[end + 1])
            end += 1
        x = judge(i, end, found) if end > i and len(found) > 1 else None
        if not x or not x["sure"]:
            continue
        last = joined[-1] if joined else None
        if last and last["family"] == x["family"] and last["end"] >= x["line"]:
            joined[-1] = (x if x["alike"] >= last["alike"] else last) | {"end": max(last["end"], x["end"])}
        else:
            joined.append(x)
    rest = [x for x in alone if x["sure"] or not any(m["line"] <= x["line"] <= m["end"] for m in joined)]
    return sorted((x["line"], x["family"], x["p"], x["sure"]) for x in rest + joined)


def test_licences_scan_as_plain_python_does(spark):
    rng = random.Random(21)
    notices = [n for ns in (*licences.NOTICES.values(), *licences.HELD.values(), licences.OTHERS) for n in ns]
    docs = [(i, C.prose(rng, 50)) for i in range(60)]
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            ws = rng.choice(notices).split()[rng.choice([0, 0, 0, 3]) :] if rng.random() < 0.6 else C.prose(rng, rng.randrange(0, 25)).split()
            while ws:
                k = rng.choice([4, 8, 30])
                lines.append(rng.choice(["", "# ", " * "]) + " ".join(ws[:k]))
                ws = ws[k:]
            lines += [""] * rng.randrange(2)
        docs.append((1000 + i, "\n".join(lines)))
    df = spark.createDataFrame([*docs, (None, None), (3, ""), (4, "\n\n")], "doc_id long, text string")
    model = licences.train(df)
    total = 0
    for r in licences.scan(df, model).collect():
        got, want = [tuple(x) for x in r["notices"]], scanned_by_hand(r["text"], model)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want], r["text"]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-5)
        total += len(want)
    assert total > 200


def test_licences_of_wordings_that_training_has_not(spark):
    """Neither among the notices of training and comparison nor among those of calibration."""
    wordings = {
        "apache-2.0": "Licensed to you under the Apache License, Version 2.0, with no warranty",
        "mit": "The whole repository is released under the MIT License",
        "gpl": "The sources are licensed under the GNU General Public License, version 3 or later",
        "cc-by": "Photographs are licensed under CC BY 4.0",
        "cc-by-sa": "The guide is licensed under CC BY-SA 4.0",
        "unknown": "Distributed under the Microsoft Public License",
        None: "She was licensed to practise medicine in two states",
    }
    read = {n for ns in (*licences.NOTICES.values(), *licences.HELD.values(), licences.OTHERS, licences.HELD_OTHERS) for n in ns}
    assert not read & set(wordings.values())
    assert not {n for ns in licences.NOTICES.values() for n in ns} & {n for ns in licences.HELD.values() for n in ns} and not {*licences.OTHERS} & {*licences.HELD_OTHERS}
    rng = random.Random(3)
    rows = [(i, C.prose(rng, 60)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(wordings.values())]
    got = {r["doc_id"]: r["licence"] for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(len(wordings))] == list(wordings)


def test_licences_learn_ordinary_text_from_whole_texts(spark):
    """Words that only later lines, or later parts of a long line, have are ordinary too."""
    rng = random.Random(8)
    rows = [(i, "\n".join([C.prose(rng, 8) for _ in range(4)] + ["so unencumbered here"] * 40) if i % 2 else C.prose(rng, 300) + " so dedicated here" * 300) for i in range(80)]
    features = licences.train(spark.createDataFrame(rows, "doc_id long, text string"))["features"]
    assert ("unencumbered",) not in features and ("dedicated",) not in features and ("universal",) in features


def test_licences_wrapped_over_lines(spark):
    rng = random.Random(4)
    wrapped = {
        "gpl": ["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by", "# the Free Software Foundation, either version 3 of the License, or", "# (at your option) any later version."],
        "mit": [" * Permission is hereby granted, free of charge, to any person", " * obtaining a copy of this software and associated documentation", " * files, to deal in it"],
        "bsd": ["Redistribution and use in source and binary", "forms, with or without modification, are", "permitted provided that the following", "conditions are met:"],
    }
    rows = [(i, C.prose(rng, 60)) for i in range(40)]
    rows += [(100 + i, C.prose(rng, 40) + "\n" * k + "\n".join(x)) for i, (x, k) in enumerate((x, k) for x in wrapped.values() for k in (1, 2))]
    rows += [(200, "Released under the MIT License.\n" + "\n".join(wrapped["gpl"])), (201, "Released under the MIT License.\nLicensed under CC BY 4.0"), (202, "free software can\n\nredistribute")]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, f in enumerate(f for f in wrapped for _ in range(2)):
        assert (got[100 + i]["licence"], got[100 + i]["confirmed"], got[100 + i]["families"].split(",").count(f)) == (f, True, 1), f
    assert got[200]["families"].split(",")[:2] == ["mit", "gpl"] and got[201]["families"] == "mit,cc-by"
    assert all(got[i]["n_notices"] == 0 for i in range(40)) and not got[202]["confirmed"]


@pytest.mark.parametrize("old", ["12 March 1990", "March 2, 1990", "1990/03/12", "12-03-1990", "(499) 555-6503", "499-555-6503", "+44 20 7946 0958"])
def test_pii_knows_other_ways_to_write(old):
    f = pii.Permutation(b"k")
    made, counts = pii.pseudonymise(f"on {old}, x", f)
    assert old not in made and sum(counts.values()) == 1 and made.endswith(", x")


@pytest.mark.parametrize("old", ["+442079460958", "+4930123456", "+44 7700 900123", "+91 98765 43210", "+49 30 123456", "+33 1 23 45 67 89", "+44.20.7946.0958", "+44 (0)20 7946 0958", "1-415-555-2671", "5/6/2020", "1-2-2020", "2024-5-6", "5/26/2020", "2024-05-06T10:00:00Z"])
def test_pii_of_common_layouts(old):
    f = pii.Permutation(b"k")
    made, counts = pii.pseudonymise(f"on {old}, x", f)
    assert made.split(",")[0][3:] != old and sum(counts.values()) == 1 and made.endswith(", x")
    assert [c if not c.isdigit() else "0" for c in made] == [c if not c.isdigit() else "0" for c in f"on {old}, x"]
    for code in ("+44", "+49", "+91", "+33", "1-"):
        assert not old.startswith(code) or not counts.get("phone") or made[3:].startswith(code)
    assert "T" not in old or made.endswith("T10:00:00Z, x")


def test_pii_beside_phones_stays_apart():
    f = pii.Permutation(b"k")
    for other, kind in (("2021-02-28", "date"), ("123-45-6789", "ssn"), ("170.106.47.218", "ip"), ("4111 1111 1111 1111", "card"), ("499-555-6503", "phone")):
        made, counts = pii.pseudonymise(f"+44 7700 900123 {other}", f)
        assert sum(counts.values()) == 2 and counts[kind] >= 1 and made.split(" ", 3)[3] == pii.pseudonymise(other, f)[0]
    assert pii.pseudonymise("+442079460958", f)[0] == pii.pseudonymise("+44 20 7946 0958", f)[0].replace(" ", "")
    days = [f"{d}/{m}/2001" for d in range(1, 10) for m in range(1, 10)]
    assert len({pii.pseudonymise(x, f)[0] for x in days}) == len(days)
    for same in ("+123456", "13/45/2020", "2024-05-06Thursday", "+1234567890123456789"):
        assert pii.pseudonymise(same, f) == (same, {})


def test_pii_is_linear_in_long_runs():
    f = pii.Permutation(b"k")
    text = "q" * 200_000 + " a@b.example.org " + "1" * 100_000 + " " + "+1 " * 20_000
    assert "a@b" not in pii.pseudonymise(text, f)[0]
