"""BPE encoding against the tokenizers library, spelling variants and Merkle manifests against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoledger.llm import bpe, merkle, variants

from .test_operators import SCHEMA, fixture_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(bpe.MODEL, "rb") as f:
        return bpe.Codec(f.read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("query, sql", [(variants.op12_spelling_variants, variants.VARIANTS_SQL), (merkle.op13_merkle_manifest, merkle.MERKLE_SQL)])
def test_matches_duckdb(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = query(spark, SF), con.execute(sql)
    assert got.columns == [d[0] for d in want.description]
    want = want.fetchall()
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op11_parity_on_all_documents(spark, library):
    d = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op11_bpe_encoding(spark, SF).collect()
    assert len(got) == len(d)
    for r in got:
        ids = ids_of(library, d[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op11_odd_rows(spark, docs, none, library):
    rows = fixture_rows()
    got = bpe.decoded(bpe.encoded(docs).withColumn("text", F.lit("other")))
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got.collect()) == Counter((r[0], tuple(ids_of(library, r[1])), r[1] or "") for r in rows)
    assert bpe.encoded(none).count() == 0 and bpe.decoded(bpe.encoded(none)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 99999, -1, 50256, 220]), (4, [169])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(odd).collect()} == {1: "", 2: "", 3: "<|endoftext|> ", 4: library.decode([169])}


def test_op11_parity_on_random_texts(codec, library):
    rng = random.Random(4)
    parts = ["a", "b", "aa", "the", " ", "  ", "\n", "\t", "é", "中", "'s", "'ll", "1", "23", "!!", "<|endoftext|>", "<|", "　", "՘", "😀", "\x00", "\x85", "Ᲊ", "ing", "ation"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(60))) for _ in range(1000)] + [c * n for c in "ab=- é" for n in (1, 2, 3, 17, 255, 3000)]
    found = [codec.encode(t) for t in texts]
    assert [x.tolist() for x in found] == [ids_of(library, t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    assert codec.decode(np.concatenate(found), off) == texts
    wild = [[rng.randrange(50300) for _ in range(9)] for _ in range(500)]
    assert codec.decode(np.array(wild).ravel(), np.arange(0, 4501, 9)) == [library.decode(w, skip_special_tokens=False) for w in wild]


def test_op11_long_texts_are_cut_at_blanks(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)
    text = "some words  and\n\n more   of them, " * 20 + "x" * 500 + "  end "
    assert codec.encode(text).tolist() == ids_of(library, text)


def test_op11_pairs_are_what_merging_gives(codec, library):
    """The table against the library: two tokens are compatible if their joined text is encoded as these two."""
    rng = random.Random(7)
    plain = [i for x, i in codec._ids.items() if re.fullmatch(rb"[a-z]+", x)]
    for a, b in [(rng.choice(plain), rng.choice(plain)) for _ in range(4000)]:
        text = library.decode([a]) + library.decode([b])
        assert codec._pairs[a, b] == (ids_of(library, text) == [a, b])


def brute_words(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if r[0] is not None:
                h = zlib.crc32(f"{r[0]}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if edit_one(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def wordy(seed=9):
    """Words with chains of forms, ties, families that share long beginnings and ends, long words, letters of two bytes."""
    rng = random.Random(seed)
    words = Counter()
    for base in ("lantern", "abcdefgh", "zzzzz", "éèêëà", "straße", "q" * 70, "internationalisation"):
        words[base] += rng.randrange(3, 60)
        for _ in range(60):
            w = base
            for _ in range(rng.randrange(1, 4)):
                p, c = rng.randrange(len(w) + 1), rng.choice("abézq")
                w = rng.choice((w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]))
            words[w] += rng.randrange(1, 30)
    for a in "abcdefghij":
        for b in "abcdefghij":
            words["prefixed" + a + b] += rng.randrange(2, 9)
            words[a + b + "suffix"] += 4
    return words


@pytest.mark.parametrize("settings", [{}, {"LIST": 2}, {"LIST": 10**6}, {"DICTIONARY": 5}, {"REACH": 3, "DICTIONARY": 10**6}])
def test_op12_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(variants, k, v)
    rows = [(i, " ".join([w] * n), "x") for i, (w, n) in enumerate(wordy().items())] + [(None, "LANTERN lantern", "y"), (5, None, "z"), (6, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {tuple(r) for r in variants.variants(df).collect()} == brute_variants(brute_words(rows))


def test_op12_odd_rows(spark, docs, none):
    assert variants.variants(none).count() == 0
    assert {tuple(r) for r in variants.variants(docs).collect()} == brute_variants(brute_words(fixture_rows()))


def test_op12_grams_survive_an_edit():
    """Whatever the edit, one of the chosen grams stays: at its place or, behind an insertion, one on."""
    rng = random.Random(3)
    frequent = {x + y for x in "abc" for y in "abc"} | {"abc", "bca", "aaaa", "aaa"}
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 40)))
        p, c, n = rng.randrange(len(w) + 1), rng.choice("abcd"), len(w)
        most, grams = min(variants.MOST, n // 2), variants.chosen(w, frequent)
        other = w[:p] + c + w[p:]
        assert any(variants.gram_at(other, q, most, frequent) == g for at, g in grams for q in (at, at + 1))
        if p < n:
            other = w[:p] + c + w[p + 1 :]
            assert any(variants.gram_at(other, at, most, frequent) == g for at, g in grams)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(levels, at, leaf):
    """The siblings' hash and the root that ``leaf`` gives at place ``at`` of the first of ``levels``."""
    sibs, value = [], leaf
    for level in levels[:-1]:
        lo = at // 3 * 3
        run = level[lo : lo + 3]
        i = at - lo
        sibs += run[:i] + run[i + 1 :]
        value = h(*run[:i], value, *run[i + 1 :])
        at //= 3
    return sibs, value


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        odd = doc_id is None or zlib.crc32(str(doc_id).encode()) % 2
        leaf = lambda t: h(*map(field, (doc_id, source, lang, n_chars, t)))
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(text), leaf(text if odd or text is None else text.replace("\n", "")), doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        for i, (*_, leaf, tampered, doc_id) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            sibs, value = fold(trees[s], i, tampered)
            more, value = fold(top, k, value)
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], h(*sibs, *more), value, value == top[-1][0]] += 1
    return out


def manifested(df):
    back = merkle.folded(F.col("tampered"), F.col("path"))
    rows = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"), back.alias("b"), "root").collect()
    return Counter((*r[:6], r[5] == r[6]) for r in map(tuple, rows))


def test_op13_odd_rows(spark, docs, none):
    assert merkle.manifest(none).count() == 0
    assert manifested(docs) == brute_manifest(fixture_rows())


@pytest.mark.parametrize("digits", [1, 2])
def test_op13_blocks(spark, monkeypatch, digits):
    """Small blocks: sources of one block and of several levels of blocks, and more sources than a block holds."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = [(i, f"a\n{i}", "en", "hot" if i < 40 else f"s{i % 11}", i, None, None, None, None) for i in range(60)] + [(None, None, None, None, None, None, None, None, None)] * 4
    rows += [(100 + i, "x", None, f"t{i}", 1, None, None, None, None) for i in range(3 ** (2 * digits - 1))]
    assert manifested(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)
