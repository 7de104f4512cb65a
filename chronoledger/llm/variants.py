"""Spelling variants: words one inserted, deleted or replaced code point apart, by an index of variable-length grams.

Gram dictionary: substrings of LEAST to MOST - 1 code points are counted over all words, and those with more than one
DICTIONARY-th of all of their length are frequent; so there are fewer than DICTIONARY of each length, which bounds the
broadcast. A word's gram at a place starts with LEAST code points and grows while it is frequent, up to MOST, half of the word or
its end. Words are indexed by length, place and gram.

A word looks for words of its own length and of one more. It takes its grams from the rarest on until the affected-gram bound, the most
of them that one edit can touch, is below their number: then one stays whole in every near word, at its place or one place
on, and the lists of these grams hold all near words. Candidates are verified by edit distance. Lists of more than LIST words
are not met pair by pair: their words are grouped by what is left when one place is blanked (near by replacement) or cut out
(near by deletion), groups that hold near words only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import positions
from ..storage import Scratch, written
from .crc import TABLE, crc32_sql
from .words import slices

RUN = "[A-Za-zÀ-ÿ]+"
#: Shortest word, fewest occurrences, and the divisor of the crc32 that spoils a run.
SHORTEST, FEWEST, SPOILT = 5, 3, 97
LEAST, MOST, DICTIONARY, LIST = 2, 6, 20_000, 32
#: Grams are taken from this many places at either end of a word, so a word's rows are bounded.
REACH = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def lowered(text: str) -> str:
    """``text`` with A-Z lower-cased and all else as it is."""
    return text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()


def _count(batches):
    runs, held = re.compile(RUN), {}

    def told():
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in slices(batches):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            begun = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs.findall(lowered(text or ""))).items():
                if begun is not None:  # without a doc_id no run is spoilt
                    h = zlib.crc32(run.encode(), begun)
                    if not h % SPOILT:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= SHORTEST:
                    held[run] = held.get(run, 0) + n
        if len(held) >= HELD:
            yield told()
    yield told()


def words_of(docs: DataFrame) -> DataFrame:
    """word and n: how often each word of FEWEST occurrences stands in all texts of ``docs`` (doc_id, text).

    Null and empty texts have none; repeated rows count each time; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def frequent_grams(words: DataFrame) -> set[str]:
    """The frequent substrings of LEAST to MOST - 1 code points: fewer than DICTIONARY of each length, whatever the words."""
    size, span = F.length("word"), REACH + MOST
    ends = F.when(size <= 2 * span, F.col("word")).otherwise(F.concat_ws(" ", F.left("word", F.lit(span)), F.right("word", F.lit(span))))
    at = lambda p: F.transform(F.sequence(F.lit(LEAST), F.lit(MOST - 1)), lambda q: F.substring("ends", p, q))
    grams = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.length("ends") - LEAST + 1), at)), lambda g: ~g.contains(" "))
    counts = words.select(ends.alias("ends")).select(F.explode(grams).alias("gram")).groupBy("gram").count().withColumn("size", F.length("gram"))
    total = counts.groupBy("size").agg(F.sum("count").alias("total"))
    found = counts.join(F.broadcast(total), "size").where(F.col("count") * DICTIONARY > F.col("total"))
    return {r.gram for r in found.select("gram").collect()}


def gram_at(word: str, at: int, most: int, frequent: set[str]) -> str:
    """The variable-length gram at a place: no longer than it must be to be rare, ``most`` allows and the word lasts."""
    q, end = LEAST, min(at + most, len(word))
    while at + q < end and word[at : at + q] in frequent:
        q += 1
    return word[at : at + q]


def places(n: int) -> list[int]:
    """Where grams are taken from in a word of ``n`` code points."""
    return [p for p in range(n - LEAST + 1) if p < REACH or p >= n - LEAST + 1 - REACH] if n <= 4 * REACH else [*range(REACH), *range(n - LEAST + 1 - REACH, n - LEAST + 1)]


def chosen(word: str, frequent: set[str]) -> list[tuple[int, str]]:
    """Places and grams, rarest first, so many that one edit cannot touch them all."""
    n, most = len(word), min(MOST, len(word) // 2)
    grams = [(p, gram_at(word, p, most, frequent)) for p in places(n)]
    grams.sort(key=lambda g: (g[1] in frequent, -len(g[1]), g[0]))
    out, touched = [], Counter()
    for p, g in grams:
        out.append((p, g))
        # an edit is at a code point x (2x + 1) or in a gap before it (2x); a gram that ends with the word feels one added there
        touched.update(range(2 * p + 1, 2 * (p + len(g)) + (p + len(g) == n)))
        if max(touched.values()) < len(out):
            break
    return out


def _rows(frequent: set[str]):
    """The index rows of words and the rows by which they ask: length asked for, what it is more than, place, gram."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at, asks, length, more, place, gram = [], [], [], [], [], []
                for i, w in enumerate(part["word"].to_pylist()):
                    n = len(w)
                    rows = [(False, n, 0, p, gram_at(w, p, min(MOST, n // 2), frequent)) for p in places(n)]
                    if n > SHORTEST:
                        short = min(MOST, (n - 1) // 2)
                        spots = places(n - 1)
                        rows += [(False, n - 1, 1, p, gram_at(w, p, short, frequent)) for p in sorted({*spots, *(p + 1 for p in spots)})]
                    for p, g in chosen(w, frequent):
                        rows += [(True, n, 0, p, g), (True, n, 1, p, g), (True, n, 1, p + 1, g)]
                    for ask, size, d, p, g in rows:
                        at.append(i)
                        asks.append(ask)
                        length.append(size)
                        more.append(d)
                        place.append(p)
                        gram.append(g)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(at), part["word"].take(at), part["n"].take(at), pa.array(asks, pa.bool_()), pa.array(length, pa.int32()), pa.array(more, pa.int32()), pa.array(place, pa.int32()), pa.array(gram, pa.string())],
                    names=["id", "word", "n", "asks", "length", "more", "place", "gram"],
                )

    return run


def _holes(batches):
    """128-bit digests of what is left of each word without each of its places, blanked or cut out, and of the words themselves."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            at, kind, left = [], [], []

            def put(i, k, x):
                at.append(i)
                kind.append(k)
                left.append(hashlib.blake2b(x.encode(), digest_size=16).digest())

            for i, w in enumerate(part["word"].to_pylist()):
                for p in range(len(w)):
                    put(i, 0, f"{w[:p]} {w[p + 1 :]}")
                for x in {w[:p] + w[p + 1 :] for p in range(len(w))}:
                    put(i, 1, x)
                put(i, 2, w)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([part["id"].take(at), part["n"].take(at), pa.array(kind, pa.int32()), pa.array(left, pa.binary())], names=["id", "n", "kind", "left"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n_near and best (near_n, turned: the negative id) of each word (id, word, n; ids ascend with words) that has near words."""
    rows = words.mapInArrow(_rows(frequent_grams(words)), "id long, word string, n long, asks boolean, length int, more int, place int, gram string")
    rows = scratch.written(rows.select("id", "word", "n", "asks", F.xxhash64("length", "more", "place", "gram").alias("list")), "grams")
    index, asks = rows.where("not asks").drop("asks"), rows.where("asks").drop("asks")
    long = scratch.written(index.groupBy("list").count().where(F.col("count") > LIST).select("list"), "lists")
    # pairs of short lists: at most LIST a row that asks
    held = index.join(long, "list", "left_anti").select("list", F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    met = asks.join(held, "list").where("id <> other").where(F.levenshtein("word", "other_word", 1) == 1)
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.when(F.col("id") < F.col("other"), F.struct(F.col("n").alias("an"), F.col("other_n").alias("bn"))).otherwise(F.struct(F.col("other_n").alias("an"), F.col("n").alias("bn"))).alias("ns"))
    pairs = scratch.written(pairs.groupBy("a", "b").agg(F.first("ns").alias("ns")), "pairs")
    # words of long lists
    crowded = scratch.written(rows.join(long, "list", "left_semi").groupBy("id").agg(F.first("word").alias("word"), F.first("n").alias("n")), "crowded")
    left = crowded.mapInArrow(_holes, "id long, n long, kind int, left binary")
    flag = crowded.select("id", F.lit(True).alias("crowded"))
    both = pairs.join(flag.withColumnsRenamed({"id": "a", "crowded": "ca"}), "a", "left").join(flag.withColumnsRenamed({"id": "b", "crowded": "cb"}), "b", "left")
    both = both.where("ca is null or cb is null")  # two crowded words meet below
    one = both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near"), F.col("ns.bn").alias("near_n")), F.struct(F.col("b").alias("id"), F.col("a").alias("near"), F.col("ns.an").alias("near_n")))).alias("p"))
    one = one.select("p.id", F.lit(1).cast("long").alias("n_near"), F.struct("p.near_n", (-F.col("p.near")).alias("turned")).alias("best"))
    ranked = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("n").alias("near_n"), (-F.col("id")).alias("turned")))), False)
    # one code point or one insertion tells the members of a group apart, so letters times places bound its size
    groups = left.withColumn("cut", F.col("kind") > 0).groupBy("cut", "left").agg(ranked(0).alias("same"), ranked(1).alias("longer"), ranked(2).alias("own")).where("size(same) > 1 or (size(longer) > 0 and size(own) > 0)")
    member = lambda x, n, best: F.struct((-x["turned"]).alias("id"), n.cast("long").alias("n_near"), best.alias("best"))
    beside = F.transform("same", lambda x: member(x, F.size("same") - 1, F.when(x["turned"] == F.col("same")[0]["turned"], F.col("same")[1]).otherwise(F.col("same")[0])))
    above = F.transform("longer", lambda x: member(x, F.lit(1), F.col("own")[0]))
    below = F.transform("own", lambda x: member(x, F.size("longer"), F.col("longer")[0]))
    two = groups.select(F.explode(F.when(~F.col("cut"), F.when(F.size("same") > 1, beside)).otherwise(F.concat(above, below))).alias("m")).select("m.*")
    return one.unionByName(two).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text); other columns are ignored.

    A word's form is its near word of largest n, if that is twice the word's or more; root follows forms to the last. Null and empty
    texts have no words, an empty table gives no rows. Occurrences double along forms, so roots are found in a few
    rounds in which each word takes its form's form.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        listed = scratch.written(words_of(docs), "words")
        words = scratch.written(positions(listed, [], ["word"], name="id", write=scratch.written), "words")
        best = scratch.written(near_words(words, scratch), "best")
        known = words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.near_n") >= 2 * F.col("n"), F.col("best")).alias("best"))
        known = scratch.written(known.select("id", "word", "n", "n_near", (-F.col("best.turned")).alias("form_id"), F.col("best.near_n").alias("form_n")), "forms")
        roots = known.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
        while True:
            on = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
            step = scratch.written(roots.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
            if not step.where("moved").take(1):
                break
            roots = step.select("id", "root_id")
        name = lambda key, value: words.select(F.col("id").alias(key), F.col("word").alias(value))
        out = known.join(step.select("id", "root_id"), "id", "left").join(name("form_id", "form"), "form_id", "left").join(name("root_id", "root"), "root_id", "left")
        return written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their forms and roots."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER = "".join(map(chr, range(65, 91)))
VARIANTS_SQL = f"""with recursive {TABLE},
 runs as (select doc_id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{_UPPER}', '{_UPPER.lower()}') as run from documents),
 own as (select doc_id, run, count(*) as n from runs group by all),
 hashed as (select own.*, {crc32_sql("cast(doc_id as varchar) || ':' || run")} as h from own, crc),
 kept as (select case when h % {SPOILT} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
 w as (select word, cast(sum(n) as bigint) as n from kept where length(word) >= {SHORTEST} group by word having sum(n) >= {FEWEST}),
 cut as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from w)),
 blank as (select word, n, substr(word, 1, i - 1) || ' ' || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from w)),
 pairs as (select a.word, b.word as near, b.n as near_n from blank a join blank b on a.rest = b.rest and a.word <> b.word
  union all select w.word, c.word, c.n from w join cut c on c.rest = w.word union all select c.word, w.word, w.n from w join cut c on c.rest = w.word),
 best as (select word, count(*) as n_near, arg_max(near, {{'n': near_n, 'k': -rank}}) as near, max(near_n) as near_n from (select *, dense_rank() over (order by near) as rank from pairs) group by word),
 f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n from w left join best on w.word = best.word),
 walk as (select word, word as root, form as next from f union all select walk.word, f.word, f.form from walk join f on f.word = walk.next)
 select f.word, f.form, walk.root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word where walk.next is null"""
