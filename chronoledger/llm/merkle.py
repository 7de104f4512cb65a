"""A Merkle tree over a table: one root for all rows, and for each row the proof that leads to it.

Rows are leaves, ranked within their source; a node stands for FAN consecutive ones of the level below. A rank is split
into a block and DIGITS digits to the base FAN. Rows are dealt by source and block once; then one digit after the other is
grouped away, each time nesting the nodes of a run in the struct of their parent. A block's struct holds at most
FAN ** DIGITS leaves, however large its source is. Block roots are nested in the same way by the digits of their block number until
one node of each source remains, and then the sources' roots. On the way back the steps of a path come to each block by union
and grouping, two rows a group, and a transform over the nested structs hands every leaf what stands left and right of it
at each level. No join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import positions
from ..storage import Scratch, written
from .crc import TABLE, crc32_sql

FAN, DIGITS = 3, 6
#: What a leaf's hash covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UP = "struct<path: array<struct<left: string, right: string>>, subroot: string, root: string>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda n: n["h"]), "")


def _nested(nodes: DataFrame, key: str) -> DataFrame:
    """One row for each key and block of ``nodes`` (key, place, node: a struct with ``h``): the block's root as a struct.

    A struct has ``h``, ``kids`` and ``only``: its one kid is the only node of its key on its level and is not hashed again.
    """
    digits = [F.pmod(F.floor(F.col("place") / FAN**d), F.lit(FAN)).cast("int").alias(f"d{d}") for d in range(DIGITS)]
    rows = nodes.select(key, F.floor(F.col("place") / FAN**DIGITS).alias("block"), *digits, "node")
    for d in range(DIGITS):
        above = ["block", *[f"d{e}" for e in range(d + 1, DIGITS)]]
        run = F.transform(F.array_sort(F.collect_list(F.struct(f"d{d}", "node"))), lambda x: x["node"])
        rows = rows.groupBy(key, *above).agg(run.alias("kids"))
        # the first run of a level has a second node if the level has one
        only = (F.size("kids") == 1) & (F.greatest(*[F.col(c) for c in above]) == 0 if len(above) > 1 else F.col("block") == 0)
        h = F.when(only, F.col("kids")[0]["h"]).otherwise(F.sha2(_joined(F.col("kids")), 256))
        rows = rows.select(key, *above, F.struct(h.alias("h"), "kids", only.alias("only")).alias("node"))
    return rows


def _leaves(node: Column, level: int, path: Column) -> Column:
    """All that lies ``level`` levels below a struct, each with its steps from there up to where ``path`` begins."""

    def one(kid: Column, i: Column) -> Column:
        kids = node["kids"]
        step = F.struct(_joined(F.slice(kids, 1, i)).alias("left"), _joined(F.slice(kids, i + 2, F.lit(FAN))).alias("right"))
        steps = F.concat(F.filter(F.array(step), lambda _: ~node["only"]), path)  # names ``path`` once: expressions are copied, not shared
        return _leaves(kid, level - 1, steps) if level > 1 else F.array(F.struct(kid.alias("node"), steps.alias("path")))

    return F.flatten(F.transform(node["kids"], one))


def _proved(nodes: DataFrame, key: str, top: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """``nodes`` (key, place, node) with ``up``: the path from each, its key's root and the root of all.

    ``top`` turns the roots of keys (key, h) into (key, block = 0, up).
    """
    nested = scratch.written(_nested(nodes, key), "nests")
    if nested.where("block > 0").take(1):
        # beyond its block a node is known by its hash alone
        short = nested.select(key, F.col("block").alias("place"), F.struct("node.h").alias("node"))
        up = _proved(short, key, top, scratch).select(key, F.col("place").alias("block"), "up")
    else:
        up = top(nested.select(key, "node.h"))
    both = nested.withColumn("up", F.lit(None).cast(_UP)).unionByName(up, allowMissingColumns=True)
    met = both.groupBy(key, "block").agg(F.first("node", True).alias("node"), F.first("up", True).alias("up"))
    found = met.select(key, "block", "up", F.posexplode(_leaves(F.col("node"), DIGITS, F.col("up.path"))).alias("i", "leaf"))
    return found.select(key, (F.col("block") * FAN**DIGITS + F.col("i")).alias("place"), "leaf.node", F.struct("leaf.path", "up.subroot", "up.root").alias("up"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path and tampered (the leaf of the altered text) of every row of ``docs``.

    Reads the columns FIELDS, any other is ignored. Leaves of a source ascend by doc_id, null first, then by their hash; null
    is a source. Repeated rows are leaves of their own with equal hashes. An empty table gives no rows and has no root.
    The text of every second doc_id (by crc32) is altered, which deletes its line feeds; null doc_ids and texts stay.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
        hashed = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", hashed(F.col("text")).alias("h"), hashed(altered).alias("tampered"), F.monotonically_increasing_id().alias("tie"))
        placed = positions(scratch.written(leaves, "leaves"), ["source"], ["doc_id", "h", "tie"], write=scratch.written)
        nodes = placed.select("source", "place", F.struct("h", "doc_id", "tampered").alias("node"))

        def over_sources(roots: DataFrame) -> DataFrame:
            ranked = positions(scratch.written(roots.withColumn("all", F.lit(0)), "roots"), ["all"], ["source"], write=scratch.written)
            found = _proved(ranked.select("all", "place", F.struct("h", "source").alias("node")), "all", _whole, scratch)
            return found.select("node.source", F.lit(0).cast("long").alias("block"), F.struct("up.path", F.col("node.h").alias("subroot"), "up.root").alias("up"))

        found = _proved(nodes, "source", over_sources, scratch)
        return written(found.select("node.doc_id", "source", F.col("node.h").alias("leaf"), "up.subroot", "up.root", "up.path", "node.tampered"), "manifest")


def _whole(root: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<left: string, right: string>>")
    return root.select("all", F.lit(0).cast("long").alias("block"), F.struct(none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root")).alias("up"))


def proof(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its altered text is told apart."""
    found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = folded(F.col("tampered"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(cast(octet_length(encode({c})) as varchar) || ':' || {c}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=text if c == "text" else f"cast({c} as varchar)") for c in FIELDS) + ")"


_ALTERED = f"case when {crc32_sql('cast(doc_id as varchar)')} % 2 = 0 then replace(text, chr(10), '') else text end"
MERKLE_SQL = f"""with recursive {TABLE},
 d as (select doc_id, coalesce('s' || source, '') as source, {_leaf_sql('text')} as leaf, {_leaf_sql(f'({_ALTERED})')} as tampered from documents, crc),
 r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from d),
 t as (select 0 as level, source, place, n, leaf as h from r
  union all select level + 1, source, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by place)) from t where n > 1 group by level, source, place // 3),
 s as (select source, h, row_number() over (order by source) - 1 as place, count(*) over () as n from t where n = 1),
 u as (select 0 as level, place, n, h from s union all select level + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by place)) from u where n > 1 group by level, place // 3),
 p as (select source, place, n, 0 as level, '' as sibs, leaf, tampered as h, place as at, n as left_n, doc_id from r
  union all select p.source, p.place, p.n, p.level + 1, p.sibs || x.a || x.b, p.leaf, sha256(x.a || p.h || x.b), p.at // 3, (p.left_n + 2) // 3, p.doc_id from p join
   (select o.level, o.source, o.place, coalesce(string_agg(q.h, '' order by q.place) filter (q.place < o.place), '') as a, coalesce(string_agg(q.h, '' order by q.place) filter (q.place > o.place), '') as b
    from t o join t q on q.level = o.level and q.source = o.source and q.place // 3 = o.place // 3 where o.n > 1 group by all) x
   on x.level = p.level and x.source = p.source and x.place = p.at where p.left_n > 1),
 v as (select p.*, s.h as subroot, s.place as spot, s.n as spots from p join s on s.source = p.source where left_n = 1),
 w as (select doc_id, leaf, subroot, sibs, h, spot as at, spots as left_n, 0 as level from v
  union all select w.doc_id, w.leaf, w.subroot, w.sibs || x.a || x.b, sha256(x.a || w.h || x.b), w.at // 3, (w.left_n + 2) // 3, w.level + 1 from w join
   (select o.level, o.place, coalesce(string_agg(q.h, '' order by q.place) filter (q.place < o.place), '') as a, coalesce(string_agg(q.h, '' order by q.place) filter (q.place > o.place), '') as b
    from u o join u q on q.level = o.level and q.place // 3 = o.place // 3 where o.n > 1 group by all) x on x.level = w.level and x.place = w.at where w.left_n > 1)
 select doc_id, leaf, subroot, u.h as root, sha256(sibs) as proof_sha256, w.h as folded_root, w.h = u.h as verified from w cross join (select h from u where n = 1) u where left_n = 1"""
