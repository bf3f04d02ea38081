"""Substring dedup, the Jaccard join, components, packing, the classifier and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from impulsia.llm import common, exchange, jaccard_join, nbsvm, packing, substring_dedup
from impulsia.llm.components import components

from . import corpus as C

BIG = 1 << 63


def cut_words(data):
    """For each row the words that stay, and how many there were."""
    first = {}
    for r in data:
        w, i = C.words(r[1]), BIG if r[0] is None else r[0]
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, BIG), i)
    out = []
    for r in data:
        w, i = C.words(r[1]), BIG if r[0] is None else r[0]
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append(([x for k, x in enumerate(w) if k not in gone], len(w), len(gone)))
    return out


def group_of(data):
    """component_id and set size of each row."""
    sets = [frozenset(C.shingles(r[1])) for r in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(data)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(data):
        ids[find(i)].append(r[0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return [(least[find(i)] if s else data[i][0], len(s)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_exact(spark, seed):
    data = C.rows(seed)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(C.frame(spark, data), digest=True).collect())
    want = collections.Counter((r[0], n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (kept, n, gone) in zip(data, cut_words(data), strict=True))
    assert got == want and sum(gone * k for (_, _, gone, _), k in got.items()) > 500
    out = substring_dedup.deduplicated(C.frame(spark, data))
    assert out.where("n_removed = 0").count() == sum(not g for _, _, g in cut_words(data))
    assert substring_dedup.deduplicated(C.frame(spark, data).limit(0), digest=True).count() == 0


def test_exchanges_by_relays_give_the_same(spark, monkeypatch):
    data = C.rows(5) + [(4242, "the very same row, " * 9, *C.rows()[0][2:])] * 60
    df = C.frame(spark, data)
    assert exchange.slots_for(7) == (7, 1) and exchange.slots_for(7, 2) == (9, 3) and exchange.slots_for(9, 2) == (9, 3)
    monkeypatch.setattr(exchange, "slots_for", lambda n: exchange.Slots(9, 3))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(df, digest=True).collect())
    assert got == collections.Counter((r[0], n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (kept, n, gone) in zip(data, cut_words(data), strict=True))
    links = collections.Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard_join.joined(df).collect())
    assert links == collections.Counter((r[0], c, n) for r, (c, n) in zip(data, group_of(data), strict=True))


def test_hot_keys_are_spread(spark):
    left = spark.range(300).select(F.col("id"), F.when(F.col("id") < 200, 5).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.createDataFrame([(5, 200, "hot"), (250, 1, "one"), (999, 1, "none")], "k long, times long, v string")
    got = {r["id"]: r["v"] for r in common.spread_join(left, right, "k", "times", 10, "id").collect()}
    assert got == {i: "hot" if i < 200 else "one" if i == 250 else None for i in range(300)}


def test_any_long_match_shares_an_aligned_anchor():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    for a, b in itertools.product(range(p), repeat=2):
        assert any((a + t) % p in cover and (b + t) % p in cover for t in range(p))


@pytest.mark.parametrize("seed", [1, 3])
def test_jaccard_join_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 4)  # several cells, several parts
    data = C.rows(seed)
    rng = random.Random(seed)
    base = C.prose(rng, 120).split()
    for k in range(25):  # a chain: neighbours link, the ends don't
        base = list(base)
        for _ in range(2):
            base[rng.randrange(120)] = f"link{rng.randrange(999)}"
        data.append((5000 + k, " ".join(base), *data[0][2:]))
    got = collections.Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard_join.joined(C.frame(spark, data)).collect())
    want = collections.Counter((r[0], c, n) for r, (c, n) in zip(data, group_of(data), strict=True))
    assert got == want
    assert jaccard_join.joined(C.frame(spark, data).limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(500, 500), (None, 3), (9, 8), (8, 9), (9, 8)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(300, 340)]} | {8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_packing(rows, data, limit=packing.LIMIT):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in data:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want[(r[0], k // limit, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def test_packing_places_every_piece(spark):
    data = C.rows()
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(C.frame(spark, data), path).collect()
    assert check_packing(rows, data) <= -(-sum(r["length"] for r in rows) // packing.LIMIT) + 1
    assert packing.pack(C.frame(spark, data).limit(0), path).count() == 0


def fewest(sizes, limit):
    """Bins of an optimal packing, by trying all."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins) if b + sizes[i] <= limit}.values():
            place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best


def test_packing_is_optimal_on_small_sets():
    for seed in range(40):
        rng = random.Random(seed)
        limit = rng.choice([20, 50, 100])
        sizes = [rng.randrange(1, limit + 1) for _ in range(10)]
        made = packing.pack_lengths(collections.Counter(sizes), limit)
        used = collections.Counter(x for f, n in made for x in f for _ in range(n))
        assert used == collections.Counter(sizes) and all(sum(f) <= limit for f, _ in made)
        assert packing.lower_bound(collections.Counter(sizes), limit) <= fewest(sizes, limit) == sum(n for _, n in made)
    assert packing.pack_lengths({}) == []


@pytest.mark.parametrize("counts, best", [({1: 100_000}, 49), ({20: 10_200}, 100), ({2048: 3, 1500: 50, 1: 50_000, 2: 20_000, 7: 3_000}, 94), ({3: 10_000, 5: 10_000}, 40)])
def test_packing_fills_sequences_with_short_pieces(counts, best):
    made = packing.pack_lengths(counts)
    used = collections.Counter()
    for f, n in made:
        assert sum(f) <= packing.LIMIT
        for x, k in collections.Counter(f).items():
            used[x] += n * k
    assert used == collections.Counter(counts) and sum(n for _, n in made) == best


@pytest.mark.parametrize("draw, n", [(lambda r: 10, 100_000), (lambda r: r.randrange(5, 41), 200_000), (lambda r: min(2048, int(r.lognormvariate(5.5, 1.2)) + 1), 100_000), (lambda r: r.randrange(1, 2049), 50_000), (lambda r: 1 if r.random() < 0.3 else r.randrange(300, 1500), 60_000)])
def test_packing_is_near_the_lower_bound(draw, n):
    rng = random.Random(1)
    counts = collections.Counter(draw(rng) for _ in range(n))
    made = packing.pack_lengths(counts)
    used = collections.Counter()
    for f, times in made:
        assert sum(f) <= packing.LIMIT
        for x, k in collections.Counter(f).items():
            used[x] += times * k
    assert used == counts and sum(times for _, times in made) <= 1.01 * packing.lower_bound(counts, packing.LIMIT)


def test_classifier_with_repeated_rows_clashing_columns_and_long_texts(spark):
    docs, labels = labelled()
    rng = random.Random(1)
    long_ = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000))
    odd = [*docs, (docs[1][0], docs[1][1], "en", "s", 0), (docs[1][0], "other text " * 30, "en", "s", 0), (9000, long_, "en", "s", 0), (9001, None, None, None, None)]
    df = C.plain(spark, odd).withColumns({"quality": F.lit("x"), "score": F.lit("y"), "buckets": F.lit(1), "one": F.lit(2)})
    label = spark.createDataFrame([*labels, (9000, 1, 0), labels[1], labels[1]], "doc_id long, quality int, toxic int")
    rows = nbsvm.scored(df, label).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in odd)
    assert all(0 <= r["score"] <= 1 for r in rows)
    buckets, bounds = nbsvm.features(np.frombuffer((long_ + docs[0][1]).encode(), np.uint8), np.array([0, len(long_.encode()), len((long_ + docs[0][1]).encode())]))
    few, at = nbsvm._sampled(buckets, bounds)
    assert np.diff(bounds)[0] > nbsvm.FEATURES == np.diff(at)[0] and np.array_equal(few[at[1] :], buckets[bounds[1] :])
    out = nbsvm.score(df, nbsvm.train(df, label))
    assert out.columns == [c for c in df.columns if c != "score"] + ["score"] and out.count() == len(odd)


def labelled(seed=6, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t, q = C.prose(rng, rng.randrange(30, 150)), 1
        if i % 4 == 0:
            t, q = " ".join(w + rng.choice(["***", "$$$", "###"]) for w in t.split()), 0
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, q, 0))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled()
    rows = nbsvm.scored(C.plain(spark, [*docs, (None, None, None, None, None), (900, "", None, None, 0)]), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all((r["held_out"]) == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    empty = next(r for r in rows if r["doc_id"] == 900)
    assert empty["score"] == pytest.approx(sum(q for i, q in truth.items() if zlib.crc32(str(i).encode()) % 3 != 1) / sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in truth), abs=1e-6)


def test_classifier_without_labels(spark):
    docs, labels = labelled(n=20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in nbsvm.scored(C.plain(spark, docs), none).collect()} == {0.5}
    good = spark.createDataFrame([r for r in labels if r[1]], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in nbsvm.scored(C.plain(spark, docs), good).collect()} == {1.0}
    assert nbsvm.scored(C.plain(spark, docs).limit(0), good).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = labelled(n=160)
    extra = [(1000 + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(C.texts())]
    data = docs + extra + [(5000, "Write to me.you@mail.example.com or call +1 (499) 555-6503 now, " + C.prose(random.Random(8), 80), "en", "s", 0)]
    C.plain(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = nbsvm.train(C.plain(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r["doc_id"] for r in nbsvm.score(C.plain(spark, data), model).where("score >= 0.5").collect()}
    rows = [r for r in data if r[0] in kept]
    assert not any(q == 0 and i in kept for i, q, _ in labels)
    rows = [r for r, (c, _) in zip(rows, group_of(rows), strict=True) if c == r[0]]
    cut = [(r[0], " ".join(w) if gone else r[1]) for r, (w, _, gone) in zip(rows, cut_words(rows), strict=True)]
    from impulsia.llm.pii import DEMO_KEY, Permutation, pseudonymise

    f = Permutation(DEMO_KEY)
    final = [(i, None if t is None else pseudonymise(t, f)[0]) for i, t in cut]
    assert any("me.you@" in (t or "") for _, t in cut) and not any("me.you@" in (t or "") for _, t in final)
    check_packing(got, final)


def test_stages_keep_the_columns_and_pass_empty_tables(spark, tmp_path):
    docs, labels = labelled(n=40)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = C.frame(spark, C.rows())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (df, df.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            assert n <= df.count() + 40 and (n == 0 or rows is df)
            if k < 4:
                assert out.columns == corpus_pipeline.COLUMNS and out.where(F.col("n_chars") != F.char_length("text")).count() == 0
