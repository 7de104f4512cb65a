"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and no rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoledger.llm import audio, langmodel, mixing, near_dedup, pii, quality, sentencepieces, substring_dedup, token_rollup, topk
from chronoledger.storage import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, p long, `key` string, node long"


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fixture_rows():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 300)]
    near = base[:150] + ["other"] + base[151:]
    far = base[:60] + [f"z{i}" for i in range(200)]
    texts = {
        1: " ".join(base), 2: "\n".join(base), 3: " ".join(near), 4: " ".join(far), 5: None, 6: "", 7: "one two", 8: "One TWO", 9: " \t\n ",
        10: "é中 x　y " * 40, 11: " ".join(base * 40), 12: "mail a.b@c.example 4111 1111 1111 1111 on 1980-02-29", 13: "x" * 5000,
    }
    rows = [(i, t, "en", "s" + str(i % 3), 0, 0.5, 1, "k", 2) for i, t in texts.items()]
    rows += [rows[0], (1, "same id, other text here now", None, None, None, None, None, None, None), (None, texts[1], "fr", "", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def order(x):
    return float("inf") if x is None else x


def test_op1_brute_force(spark, docs, none):
    rows, first = fixture_rows(), {}
    for r in sorted(rows, key=lambda r: order(r[0])):
        w = words(r[1])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), order(r[0]))
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < order(r[0]):
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = substring_dedup.substring_dedup(spark, docs)
    assert Counter(map(tuple, got.collect())) == want
    assert substring_dedup.substring_dedup(spark, none).count() == 0


def test_op2_targets_and_draws(spark, docs, none):
    got = mixing.mix_sources(docs, docs_per_block=2, blocks_per_shard=2).cache()
    taken = got.where("copy is not null").groupBy("source", "target").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    assert taken and all(abs(r.n - r.target) <= r.most for r in taken)
    assert got.where("copy > 1").count() == 0 and got.select("row").distinct().count() == len(fixture_rows())
    again = mixing.mix_sources(docs.repartition(3), docs_per_block=2, blocks_per_shard=2)
    assert sorted(map(str, got.drop("row").collect())) == sorted(map(str, again.drop("row").collect()))
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_op2_targets(spark):
    def targets(sizes, weights, share, most):
        left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
        while free:
            w = sum(weights[i % len(weights)] for i in free)
            over = {i for i in free if left * weights[i % len(weights)] / w > most * sizes[i]}
            out = [left * weights[i % len(weights)] / w if i in free - over else most * sizes[i] if i in over else out[i] for i in range(len(sizes))]
            if not over:
                break
            left, free = left - sum(out[i] for i in over), free - over
        return out

    rng = np.random.default_rng(7)
    for sizes in ([10, 10, 1], [0, 5, 0, 7], *(rng.integers(0, 1000, n).tolist() for n in (1, 4, 30))):
        for share in (1.5, 2.0):
            found = mixing.source_targets(spark.createDataFrame(list(enumerate(sizes)), "rank long, size long"), (3, 1, 2), share, 2.0)
            assert np.allclose([r.target for r in found.orderBy("rank").collect()], targets(sizes, (3, 1, 2), share, 2.0))


def test_op2_tree():
    split = mixing.split_tree(np.array([10, 0, 33]), 0, 7, 1)
    assert [x[:2] for x in split] == [(i, i + 1) for i in range(7)]
    counts = np.array([x[2] for x in split])
    assert counts.sum(0).tolist() == [10, 0, 33] and counts.sum(1).max() - counts.sum(1).min() <= 1
    # In steps of levels as at once.
    steps = [y for lo, hi, c in mixing.split_tree(np.array([10, 0, 33]), 0, 7, 1, 1) for y in mixing.split_tree(c, lo, hi, 1)]
    assert [(x[0], x[2].tolist()) for x in steps] == [(x[0], x[2].tolist()) for x in split]
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (400, 30, 100), (3, 10**12, 10**11), (5 * 10**11, 10**12, 10**6)):
        draws = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(300)])
        mean = n * good / (good + bad)
        dev = np.sqrt(mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1))
        assert abs(draws.mean() - mean) < 5 * dev / np.sqrt(300) and draws.min() >= max(0, n - bad) and draws.max() <= min(n, good)


def test_op2_shards_hold_what_the_tree_gives(spark):
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 3 if i % 2 else 0}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` long")
    got = mixing.mix_sources(df, docs_per_block=4, blocks_per_shard=8).where("copy is not null")
    # A block is drawn once a pass, and shards differ by what blocks weigh only.
    assert got.groupBy("row", "copy").count().where("count > 1").count() == 0
    per = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(per) > 10 and max(per) < 4 * 8 * 3
    mixed = mixing.mixed_documents(df, docs_per_block=4, blocks_per_shard=8)
    assert mixed.columns == df.columns
    where = {(r.doc_id): r.shard for r in got.where("copy = 0").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in got.collect())
    once = [i for i, c in Counter(r.doc_id for r in got.collect()).items() if c == 1]
    for part in mixed.rdd.glom().collect():  # shard by shard
        order = [where[r.doc_id] for r in part if r.doc_id in set(once)]
        assert order == sorted(order)


def brute_scores(rows):
    """By row: held out, tokens, known, training tokens, base score, score."""
    counts, two, three = Counter(), Counter(), Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [words(folded(r[1])) + [None] for r in rows]
    for r, t in zip(rows, tokens):
        if not held(r[0]):
            counts.update(t)
            t = ["<begin>", *t]
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v, before = sum(counts.values()), len(counts), counts | {"<begin>": sum(not held(r[0]) for r in rows)}
    before = {**before, **two}
    grams = {**two, **three}
    kept = {g: float(langmodel.BOOK[langmodel.quantised(np.array([(c - langmodel.DISCOUNT[len(g) - 2]) / before[g[0] if len(g) == 2 else g[:2]]]))[0]]) for g, c in grams.items() if c >= 2}
    used = Counter()
    for g, c in grams.items():
        if c >= 2:
            used[g[:-1]] += c - langmodel.DISCOUNT[len(g) - 2]
    left = lambda h: 1 - used[h] / max(1, before.get(h[0] if len(h) == 1 else h, 0))

    def p(w, h):
        if not h:
            return (counts[w] + 0.5) / (n + 0.5 * (v + 1))
        known = kept.get(h) if len(h) == 2 else h[0] == "<begin>" or counts[h[0]] >= 2
        return kept.get((*h, w), 0) + left(h) * p(w, h[1:]) if known else p(w, h[1:])

    out = []
    for r, t in zip(rows, tokens):
        full = ["<begin>", *t]
        base = sum(np.log10(p(w, ())) for w in t)
        score = sum(np.log10(min(1, p(full[i], tuple(full[max(0, i - 2) : i])))) for i in range(1, len(full)))
        out.append((r[0], held(r[0]), len(t), sum(counts[x] > 0 for x in t), n, round(base, 6), round(score, 6)))
    return out


def scored(df, **settings):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in langmodel.score_documents(df, **settings).collect())


def test_op3_brute_force(spark, docs, none, tmp_path):
    want = Counter(brute_scores(fixture_rows()))
    assert scored(docs) == want
    # Many chunks, and every context that occurs ten times in several buckets: the same scores.
    assert scored(docs, chunk_bytes=2000, bucket=10, model_path=str(tmp_path / "model")) == want
    levels = spark.read.parquet(str(tmp_path / "model")).collect()
    assert {r.level for r in levels} == {2, 3} and all(langmodel.Level(bytes(r.data)).contexts.n for r in levels)
    assert langmodel.score_documents(none).count() == 0
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert scored(d) == Counter(brute_scores([tuple(r) for r in d.collect()]))


def test_op3_keeps_pairs_at_any_size(spark):
    # A passage that occurs twice is kept however many other words there are.
    rows = [(2, "alpha beta gamma delta"), (4, "alpha beta gamma delta")]
    for n in (10, 100_000):
        filler = [(100 + 2 * i, " ".join(f"f{j % 997}" for j in range(i * 50, i * 50 + 50))) for i in range(n // 50 + 1)]
        got = {r.doc_id: r for r in langmodel.score_documents(spark.createDataFrame(rows + filler, "doc_id long, text string")).where("doc_id = 2").collect()}
        assert got[2].score > got[2].base_score / 3


def test_op3_elias_fano():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 0), (1, 2**50), (1000, 300), (5000, 2**40), (4000, 2**63)):
        v = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
        seq = langmodel.EliasFano(*langmodel.EliasFano.build(v).values())
        assert n == 0 or (seq.get(np.arange(n)) == v).all()
        probe = np.unique(np.r_[v, rng.integers(0, top + 1, 500, dtype=np.uint64)])
        there = np.isin(probe, v)
        found = seq.find(probe) if n else np.full(len(probe), -1)
        assert ((found >= 0) == there).all() and (v[found[there]] == probe[there]).all()


def thue_morse(a="a", b="b", bytes_=1024):
    text = a
    while len(text) < bytes_:
        text += "".join({a: b, b: a}[c] for c in text)
    return text, "".join({a: b, b: a}[c] for c in text)


def test_words_that_collide_under_polynomials(spark):
    """Two different words whose polynomial hashes agree modulo 2**64 whatever the base."""
    x, y = thue_morse()
    rows = [(2, " ".join([x] * 13)), (3, " ".join([y] * 13)), (4, x), (5, y), (6, f"{x} {x} {x} {x} {x} end"), (7, f"{y} {y} {y} {y} {y} end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(spark, df).collect()} == {0}
    assert all(r.component_id == r.doc_id for r in near_dedup.near_duplicates(spark, df).collect())
    assert scored(df) == Counter(brute_scores(rows))
    tokens = sentencepieces.encoded(df)
    assert tokens.where("not round_trip").count() == 0
    assert {tuple(r) for r in sentencepieces.decoded(tokens).collect()} == set(rows)


def test_op4_parity_and_round_trip(spark, docs, none):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    tokens = sentencepieces.encoded(docs).cache()
    want = Counter((r[0], tuple(theirs.encode(r[1] or ""))) for r in fixture_rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == want
    assert tokens.where("not round_trip").count() == 0
    assert Counter(map(tuple, sentencepieces.decoded(tokens).collect())) == Counter((r[0], r[1] or "") for r in fixture_rows())
    assert sentencepieces.encoded(none).count() == 0


def test_op4_parity_on_random_texts(spark):
    import sentencepiece

    rng = np.random.default_rng(4)
    symbols = list("aeinorst,.019-AZ") + [" ", "  ", "\n", "\t", "é", "ß", "中", "文", "\u3000", "\u00a0", "\u0301", "ﬁ", "①", "🙂", "\u200d", "\u2581", "the", "ing"]
    rows = [(i, "".join(rng.choice(symbols, rng.integers(0, 60)))) for i in range(400)]
    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    tokens = sentencepieces.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.ids) for r in tokens} == {i: theirs.encode(x) for i, x in rows}


def field(number, value):
    """A protobuf field of bytes, a float or a number."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)


def unigram_model(fallback, remove_extra, charsmap=b""):
    """A unigram model by hand: nothing is trained."""
    rng = np.random.default_rng(9)
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("gone", -1.0, 5), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback)]
    normal = ["\u2581", "\u2581the", "ing", "the", "an", "\u2581a", "\u2581an", "rin", "sing", "st", "<", ">", "</", "\u4e2d", "\u2581x", "0x", "go", "ne", *"abcdefghinorst0123456789A"]
    pieces = special + [(p, float(-rng.uniform(2, 12)), 1) for p in normal]
    body = b"".join(field(1, field(1, p.encode()) + field(2, x) + field(3, t)) for p, x, t in pieces)
    return body + field(2, field(3, 1) + (field(35, 1) if fallback else b"")) + field(3, field(2, charsmap) + field(3, 1) + field(4, int(remove_extra)) + field(5, 1))


@pytest.mark.parametrize("fallback, remove_extra", [(True, False), (False, False), (True, True)])
def test_op4_unigram_parity(spark, tmp_path, fallback, remove_extra):
    import sentencepiece

    data = unigram_model(fallback, remove_extra)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = np.random.default_rng(4)
    symbols = list("aeinorst019A") + [" ", "  ", "\n", "é", "中", "文", "🙂", "<s>", "</s>", "<unk>", "<0x0A>", "gone", "the", "ing", " the"]
    texts = ["<s>", "a <s> b</s>", "gone", "<0x0A>", "", " ", "🙂🙂 中文", *("".join(rng.choice(symbols, rng.integers(0, 40))) for _ in range(300))]
    (tmp_path / "m.model").write_bytes(data)
    tokens = sentencepieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "m.model"))
    rows = tokens.collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: theirs.encode(x) for i, x in enumerate(texts)}
    if fallback and not remove_extra:
        assert all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in sentencepieces.decoded(tokens, str(tmp_path / "m.model")).collect()}
    assert back == {i: theirs.decode(theirs.encode(x)) for i, x in enumerate(texts)}


def test_op4_user_defined_pieces_are_an_error():
    data = unigram_model(True, False) + field(1, field(1, b"own") + field(2, 0.0) + field(3, 4))
    with pytest.raises(ValueError, match="user-defined"):
        sentencepieces.check_parity(data)


def test_op5_brute_force(spark, docs, none):
    rows = fixture_rows()
    sets = []
    for r in rows:
        w = words(folded(r[1]))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    own = list(range(len(rows)))
    for a, b in combinations([i for i, r in enumerate(rows) if r[0] is not None], 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            own = [own[a] if x == own[b] else x for x in own]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if own[j] == own[i] and rows[j][0] is not None]
        least = None if r[0] is None else min(ids)
        want[r[0], len(sets[i]), least, r[0] is None or r[0] == least] += 1
    got = near_dedup.near_duplicates(spark, docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert near_dedup.near_duplicates(spark, none).count() == 0


def test_op5_shingles_of_equal_half_hashes_are_not_linked(spark):
    """Two texts without a common word whose only shingles agree in the first 64 bits."""
    texts = ["harvest1 lanterns meridian copperxy quietly9", "zzzzzzz1 yyyyyyy2 xxxxxxx3 2ihe1llc k[f!u5c]"]
    data = pa.array(texts)
    assert len({near_dedup.shingles(*near_dedup.buffers(data.slice(i, 1)))[0][0] for i in (0, 1)}) == 1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    assert {(r.component_id, r.kept) for r in near_dedup.near_duplicates(spark, df).collect()} == {(1, True), (2, True)}


def test_op5_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, rest = rng.integers(0, 2**63, 600).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(np.r_[common, rest[:200]]), np.unique(np.r_[common, rest[200:]])
    sig = near_dedup.super_minhash(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.2


def test_op5_strays_of_a_bucket_are_dealt_too(spark, monkeypatch):
    n, size = 200, 20
    crowded = spark.range(n).selectExpr("7L as key", "id as node", "0L as a")
    mine = spark.range(n).selectExpr("id as node", "5L as n_shingles", "cast('x' as binary) as low", "array(7L) as keys", "'text' as text", "4 as n_bytes")
    found = spark.range(2).selectExpr("id as node", "0L as component")
    sides = lambda t: (np.asarray(t["node"])[np.asarray(t["copied"])], np.asarray(t["node"])[~np.asarray(t["copied"])])
    rows = lambda exact: lambda key, t: pa.table({"a": [len(sides(t)[0])], "b": [len(sides(t)[1])]})
    pairs = lambda exact: lambda key, t: pa.table(dict(zip("ab", (x.ravel() for x in np.meshgrid(*sides(t))))))
    monkeypatch.setattr(near_dedup, "BLOCK", size)
    monkeypatch.setattr(near_dedup, "_across", rows)
    for r in near_dedup._mixed(crowded, mine, found, True).collect():
        assert r.a <= 3 * size and r.b <= 3 * size
    monkeypatch.setattr(near_dedup, "_across", pairs)
    assert near_dedup._mixed(crowded, mine, found, True).count() == (n - 2) * n


def test_op6_held_out(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify_quality(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95 and got.score.between(0, 1).all()
    assert quality.classify_quality(docs, labels).count() == len(fixture_rows())
    assert quality.keep_quality(none, labels).count() == 0
    assert quality.classify_quality(docs, labels.limit(0)).where("score = 1").count() == len(fixture_rows())


def test_op7_ties_and_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [-0.001, 0.0]), (None, [1.0, 1.0]), (50, [0.5]), (51, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_topk(v, v.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(1, 81920), (2, 81920), (50, 32768), (51, 0), (7, -256)], 50: [(0, 32768), (1, 32768), (2, 32768), (51, 0), (7, -128)]}
    assert topk.exact_topk(v.limit(0), v).count() == 0


def test_op7_blocks_and_bounds(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (5, 20))
    vectors = np.concatenate([centres[i % 5] + rng.normal(0, 0.2, 20) for i in range(700)]).reshape(700, 20).round(3)
    vectors[100:110] = vectors[0]  # ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * vectors).astype(np.int64)
    for blocks in ({}, {"query_block": 7, "row_block": 90}):
        got = {}
        for r in topk.exact_topk(v, v.where("vec_id % 50 = 0"), **blocks).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        for i in range(0, 700, 50):
            want = sorted(((-int(whole[i] @ whole[j]), j) for j in range(700) if j != i))[:5]
            assert [got[i][k + 1] for k in range(5)] == [(j, -s) for s, j in want]


def test_op7_scores_beyond_a_long_are_an_error(spark):
    v = spark.createDataFrame([(0, [1e8, 1.0], "x"), (1, [1e8, 1.0], "y"), (2, [1e6, 0.0], "z")], "vec_id long, embedding array<double>, score string")
    assert [r.vec_id for r in topk.exact_topk(v.where("vec_id > 0"), v.where("vec_id = 0").selectExpr("vec_id", "transform(embedding, x -> x / 1e6) as embedding")).collect()] == [1, 2]
    big = v.selectExpr("vec_id", "transform(embedding, x -> x * 1000) as embedding")
    with pytest.raises(Exception, match="exceed a long"):
        topk.exact_topk(big, big).collect()


@pytest.mark.parametrize("query, sql", [(topk.op7_exact_topk, topk.TOPK_SQL), (token_rollup.op10_token_rollup, token_rollup.ROLLUP_SQL)])
def test_matches_duckdb(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(map(str, map(tuple, query(spark, SF).collect()))) == sorted(map(str, con.execute(sql).fetchall()))


def test_op8_pseudonyms(spark, docs, none):
    text = "a.b@c.example 4111 1111 1111 1111 4111111111111112 1980-02-29 31/02/1980 29/02/1980 10.20.30.40 +1 (988) 555-2485 DE89370400440532013000 v1.2.3"
    df = spark.createDataFrame([(1, text), (2, "x 4111111111111111 y a.b@c.example"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(df, "k", "n").collect()}
    assert out[1].n == 7 and out[3].text is None and out[4].text == ""
    for gone in ("a.b@", "4111 1111", "1980-02-29", "29/02/1980", "10.20.30.40", "555-2485", "DE8937"):
        assert gone not in out[1].text
    for kept in ("4111111111111112", "31/02/1980", "v1.2.3", "+1 ("):
        assert kept in out[1].text
    card = re.search(r"\d{16}", out[2].text)[0]
    assert card == re.search(r"\d{4} \d{4} \d{4} \d{4}", out[1].text)[0].replace(" ", "")
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert out[2].text.split()[-1] == out[1].text.split()[0]
    many = spark.range(10000).select(pii.feistel(F.lpad(F.col("id").cast("string"), 4, "0"), "k").alias("x"))
    assert many.distinct().count() == 10000
    assert pii.pseudonymised(docs, "k").columns == docs.columns and pii.pseudonymised(none, "k").count() == 0


def test_op8_values_among_other_numbers(spark):
    card, bank = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = {
        1: (f"{card} 12/27", 1), 2: (f"{card} 123 cvv", 1), 3: ("7 4111111111111111", 1), 4: ("card-4111111111111111", 1), 5: (bank, 1),
        6: (f"pay {bank} BIC COBADEFF {card}", 2), 7: (f"{card} 5500 0000 0000 0004", 2), 8: (f"AT12 {card}", 1), 9: ("1234 555-123-4567", 1),
        10: (f"{card} 2024-05-01", 2), 11: ("4111 1111 1111 1112 12", 0), 12: ("12345678901234567890123", 0), 13: ("1 " * 400, None), 14: ("7" * 20000, 0),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(df, "k", "n").collect()}
    for i, (text, n) in texts.items():
        assert (n is None or out[i].n == n) and len(out[i].text) == len(text) and (n != 0 or out[i].text == text)
        for gone in (card, "4111111111111111", "5500 0000", bank, "3704 0044", "555-123-4567", "2024-05-01"):
            assert gone not in out[i].text
    new = {re.search(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", out[i].text.removeprefix("7 "))[0].replace(" ", "") for i in (1, 2, 3, 4, 7)}
    assert len(new) == 1 and out[1].text.endswith(" 12/27") and out[2].text.endswith(" 123 cvv") and out[3].text.startswith("7 ")
    moved = out[5].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 and out[5].text in out[6].text and "BIC COBADEFF" in out[6].text


def test_op8_dates_are_permuted(spark):
    # Every day, day first and month first, with slashes: as many pseudonyms as values, all of them dates.
    day = F.date_add(F.lit(pii.FIRST_DAY).cast("date"), (F.col("id") * 16).cast("int"))
    texts = spark.range(pii.DAYS // 16).select(F.explode(F.array(F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd.MM.yyyy"))).alias("text")).distinct()
    out = pii.pseudonymised(texts, "k", "n").cache()
    assert out.where("n > 1").count() == 0 and out.where("n = 0").count() < 3  # a fixed point of the permutation may occur
    assert out.select("text").distinct().count() == texts.count()
    months = pii.pseudonymised(texts.where("try_to_timestamp(text, 'dd/MM/yyyy') is null and text like '%/%'"), "k")
    assert months.where("try_to_timestamp(text, 'MM/dd/yyyy') is null or cast(substr(text, 4, 2) as int) <= 12").count() == 0


def test_op8_only_valid_numbers(spark):
    texts = ["000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000", "01.02.3.4", "1.2.3.4", "123-45-6789", "912-12-3456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymised(df, "k", "n").collect()}
    for i, text in enumerate(texts):
        assert (out[i].text != text) == (i > 4)
    many = spark.range(20000).select(F.concat(F.lpad((F.col("id") % 899 + 1).cast("string"), 3, "0"), F.lit("-12-"), F.lpad((F.col("id") % 9999 + 1).cast("string"), 4, "0")).alias("text")).where("text not like '666%'").distinct()
    made = pii.pseudonymised(many, "k")
    assert made.distinct().count() == many.count()
    assert made.where(~F.col("text").rlike(r"^(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")).count() == 0


def test_op8_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example", "x", "y", "z")], "doc_id long, text string, pii_found0 string, `pii.made0` string, __pii_made string")
    row = pii.pseudonymised(df, "k").first()
    assert row.asDict().keys() == dict.fromkeys(df.columns).keys() and row[2:] == ("x", "y", "z") and "a.b@" not in row.text
    assert pii.secret_key(spark) == "public"
    spark.conf.set(pii.KEY_SETTING, "own")
    assert pii.secret_key(spark) == "own"
    spark.conf.unset(pii.KEY_SETTING)


def test_op9_read_back(spark, docs, none):
    got = audio.audio_features(audio.text_media(docs)).collect()
    want = Counter()
    for r in fixture_rows():
        raw = (r[1] or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        full = raw + b"\xff" * (n - len(raw))
        want[r[0], len(raw), n, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    features = {}
    for r in got:
        assert features.setdefault(r.payload_sha256, (r.feature, r.tensors)) == (r.feature, r.tensors)
    table = pa.ipc.open_stream(got[0].tensors).read_all()
    assert table["log_mel"].type.shape == [audio.PATCH, audio.MELS] and table["end_s"][-1].as_py() > 0
    assert audio.audio_features(audio.text_media(none)).count() == 0
    # Every sample is in a frame: a change of the last byte of a text changes its feature.
    tails = spark.createDataFrame([(i, "ab" * 5000 + c) for i, c in enumerate("xyz")], "doc_id long, text string")
    for n in (0, 100, 300):
        longer = tails.select("doc_id", F.concat(F.lit("q" * n), "text").alias("text"))
        assert len({r.feature for r in audio.audio_features(audio.text_media(longer)).collect()}) == 3
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000).astype(np.float32)
    assert abs(np.argmax(np.abs(np.fft.rfft(audio.resampled(tone)))) - 440) < 2


def test_op10_commits_are_idempotent(spark, docs, none):
    counts = token_rollup.counted(docs)
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    state = lambda: sorted(map(str, rollup.totals().collect()))
    assert rollup.commit(1, token_rollup.inserted(counts, "words-1"))
    once = state()
    want = Counter()
    for r in fixture_rows():
        want[r[3], r[2]] += 1
    assert {(r.source, r.lang): r.n_docs for r in rollup.totals().collect()} == want
    assert not rollup.commit(1, token_rollup.inserted(counts, "words-1")) and state() == once
    # A snapshot keeps the ids that it covers: the batch again, after compaction, still changes nothing.
    rollup.compact()
    assert not rollup.commit(1, token_rollup.inserted(counts, "words-1")) and state() == once
    rollup.vacuum()
    assert state() == once and token_rollup.Rollup(spark, rollup.path).totals().count() == len(once)
    # A folder that was written but not published (a crash in between) is not seen.
    token_rollup.inserted(counts, "words-1").write.parquet(f"{rollup.path}/delta-9-lost")
    assert state() == once
    # Two runs that both published one id count once.
    folder = [f for f in rollup._state()[1]]
    rollup.commit(2, token_rollup.revised(counts, "words-1", "words-2"))
    rollup._publish(2, sorted(set(rollup._state()[1]) - set(folder))[0], None)
    assert {r.tokenizer for r in rollup.totals().collect()} == {"words-2"} and rollup.totals().agg(F.sum("n_docs")).first()[0] == len(fixture_rows())
    rollup.commit(3, token_rollup.deleted(counts, "words-2"))
    rollup.commit(4, token_rollup.inserted(token_rollup.counted(none), "words-1"))
    assert rollup.totals().count() == 0


def test_op10_ignores_other_columns(spark):
    df = spark.createDataFrame([("a b", "s", "en", 5, "x", 1)], "text string, source string, lang string, tokens long, tokenizer string, `docs.n` long")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit(1, token_rollup.inserted(token_rollup.counted(df), "words-1"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "words-1", 1, 2)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.quality(spark, docs, SF)
    bad = quality.classify_quality(docs, labels).where("predicted = 0").select("doc_id")
    assert good.columns == docs.columns and good.join(bad, "doc_id").count() == 0
    assert good.count() + bad.count() == docs.count()
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    plan = mixing.mix_sources(docs).where("copy is not null")
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter(r.doc_id for r in plan.select("doc_id").collect())


def test_pipeline_on_odd_rows(spark, docs, none):
    """Nulls, empty texts, repeated rows, odd column names and no rows at all, through every stage."""
    import corpus_pipeline

    odd = docs.withColumn("a.b", F.lit("x")).withColumn("__key", F.lit("y")).withColumn("row", F.lit("z")).withColumn("shard", F.lit("w"))
    for df in (odd, odd.limit(0), odd.where("text is null")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            rows = out.collect()
            if name == "sentencepiece":
                assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and len(rows) == df.count()
            else:
                assert out.columns == df.columns and all(r["a.b"] == "x" and r["__key"] == "y" and r["row"] == "z" and r["shard"] == "w" for r in rows)
            if name in ("near_dedup", "pii"):
                empty = lambda rows: sum(not r.text for r in rows)
                assert empty(rows) == empty(df.collect())
            if name == "mixing":
                assert all(words(r.text) for r in rows)


def test_pipeline_against_brute_force(spark):
    """The rows of ``run`` as its stages, one after another in plain Python, leave them."""
    import corpus_pipeline
    import sentencepiece

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.classify_quality(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept)
    sets, own = [], list(range(len(rows)))
    for r in rows:
        w = words(folded(r[1]))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            own = [own[a] if x == own[b] else x for x in own]
    rows = [r for i, r in enumerate(rows) if own.index(own[i]) == i]
    size = Counter()
    for r in rows:
        size[r[2]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        w = sum((3, 1, 2)[order.index(s) % 3] for s in free)
        over = {s for s in free if left * (3, 1, 2)[order.index(s) % 3] / w > 2 * size[s]}
        target |= {s: 2 * size[s] if s in over else left * (3, 1, 2)[order.index(s) % 3] / w for s in over or free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    text = {r[0]: r[1] for r in rows}
    taken = Counter()
    for r in got:
        taken[next(x[2] for x in rows if x[0] == r.doc_id)] += len(words(text[r.doc_id]))
    longest = max(len(words(x)) for x in text.values())
    assert {r.doc_id for r in got} <= set(text) and all(abs(taken[s] - target[s]) <= longest for s in order)
    assert max(Counter(r.doc_id for r in got).values()) <= 2 and all(r.round_trip for r in got)
    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    hidden = {r.doc_id: r.text for r in pii.pseudonymised(docs, pii.secret_key(spark)).collect()}
    assert all(list(r.ids) == theirs.encode(hidden[r.doc_id]) for r in got)
