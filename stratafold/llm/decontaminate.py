"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window of a benchmark item is a set of word shingles (``shingle`` words each, fewer where the window is shorter). A window that
occurs whole in a document brings all its shingles along, so one necessary prefix token is enough: its rarest shingle, rarity
counted over all documents. Steps:

1. One pass over the documents explodes their words and keeps the places whose shingle occurs in some window, each with as many
   words around it as a window may reach. All other words end there, inside the scan's own stage.
2. The kept places give the frequency of every shingle. A window with a shingle that no document has drops out; every other one
   is indexed under its rarest shingle alone.
3. Places meet windows on that shingle. The place fixes where the window would start: it must start inside the document
   (positional bound) and end inside it (length bound). What is left is compared word by word.

Words are the runs of digits, letters a-z and everything beyond ASCII, after lower-casing A-Z only.

Defined cases: a null or empty text has no words, is not contaminated and keeps its row; an item without words has no window; an
item without identifier marks words but is not listed; items that share an identifier are one item; repeated rows (equal
identifier and text) each get the same result; a null identifier is matched like any other; empty tables give no rows or no hits;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, stored

# Letters that are lower-cased and the characters between words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_ROWS = 500_000  # rows of shingles or windows; larger tables are joined by shuffle


def words(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(t, BETWEEN), "")


def shingle_at(w: Column, at: Column, n: int) -> Column:
    """Hash of the n words from a place on; null where fewer are left."""
    return F.when(at + n <= F.size(w), F.xxhash64(F.lit(n), *[F.get(w, at + j) for j in range(n)]))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(win, m, items): distinct windows, their number of words and the identifiers of the items that hold them."""
    b = pick(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    b = b.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    b = b.select("item", F.slice("w", F.col("s") + 1, window).alias("win"))
    return b.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")).select("win", F.size("win").alias("m"), "items")


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, m, items, o, h): every shingle of a window and its offset."""
    lengths = [F.when(F.col("m") == n, shingle_at(F.col("win"), F.col("o"), n)) for n in range(1, shingle)]
    own = F.coalesce(*lengths, shingle_at(F.col("win"), F.col("o"), shingle))
    starts = F.sequence(F.lit(0), F.greatest(F.col("m") - shingle, F.lit(0)))
    return windows.select("*", F.explode(starts).alias("o")).select("*", own.alias("h"))


def small(df: DataFrame, limit: int) -> DataFrame:
    """The table as a broadcast side where its counted rows stay below the limit, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def meeting_places(docs: DataFrame, shingles: DataFrame, window: int, shingle: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, k1, k2, n_words, first, p, h, lo, around): one row ``first`` for each document, and every place with a known shingle."""
    lengths = sorted(r[0] for r in shingles.select(F.least("m", F.lit(shingle)).alias("n")).distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("k1"), F.hash(F.col("text"), F.length("text")).alias("k2"), words(F.col("text")).alias("w"))
    x = d.select("doc_id", "k1", "k2", "w", F.posexplode_outer("w").alias("p", "_"))
    if len(lengths) == 1:
        x = x.select("doc_id", "k1", "k2", "w", "p", F.lit(0).alias("l"), shingle_at(F.col("w"), F.col("p"), lengths[0]).alias("h"))
    else:
        x = x.select("doc_id", "k1", "k2", "w", "p", F.posexplode(F.array(*[shingle_at(F.col("w"), F.col("p"), n) for n in lengths])).alias("l", "h"))
    known = small(shingles.select(F.col("h").alias("t")).distinct(), limit)
    first = (F.coalesce("p", F.lit(0)) == 0) & (F.col("l") == 0)
    x = x.join(known, F.col("h") == F.col("t"), "left").where(F.col("t").isNotNull() | first)
    lo = F.greatest(F.col("p") - (window - 1), F.lit(0))
    return x.select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), first.alias("first"), "p", F.col("t").alias("h"), lo.alias("lo"),
                    F.when(F.col("t").isNotNull(), F.slice("w", lo + 1, 2 * window)).alias("around"))


def occurrences(places: DataFrame, shingles: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, k1, k2, s, e, items): where a window occurs in a document, by words from s to before e."""
    found = places.where("h is not null")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    rare = shingles.join(often, "h", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rare = rare.groupBy("win", "m", "items").agg(F.min(F.struct("f", "h", "o")).alias("r")).where("r.f > 0")
    rare = small(rare.select("win", "m", "items", F.col("r.h").alias("h"), F.col("r.o").alias("o")), limit)
    c = found.join(rare, "h").withColumn("s", F.col("p") - F.col("o")).where((F.col("s") >= 0) & (F.col("s") + F.col("m") <= F.col("n_words")))
    same = F.slice("around", F.col("s") - F.col("lo") + 1, F.col("m")) == F.col("win")
    return c.where(same).select("doc_id", "k1", "k2", "s", (F.col("s") + F.col("m")).alias("e"), "items").distinct()


def merged(spans: Column) -> Column:
    """Sorted overlapping or touching spans as maximal ones."""
    start = F.array().cast("array<struct<s:int,e:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        apart = F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]), grown).otherwise(apart)

    return F.aggregate(F.array_sort(spans), start, add)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, spans, items), one row per input row: the maximal word spans that windows cover, and the items found."""
    shingle = min(shingle, window)
    shingles = stored(window_shingles(benchmark_windows(items, window), shingle), "benchmark-shingles")
    places = stored(meeting_places(docs, shingles, window, shingle, limit), "meeting-places")
    hits = occurrences(places, shingles, limit).groupBy("doc_id", "k1", "k2").agg(
        F.collect_set(F.struct("s", "e")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "k1", "k2")], merged(F.col("spans")).alias("spans"), "items")
    rows = places.where("first").select("doc_id", "k1", "k2", "n_words")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "k1", "k2")])
    none = F.array().cast("array<struct<s:int,e:int>>")
    return rows.join(hits, on, "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) as w from documents),
b as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) as w from benchmark),
bs as (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from b where len(w) > 0),
win as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[s + 1 : s + 10], ' ') as win from bs),
lens as (select distinct m from win),
ds as (select doc_id, w, m, unnest(range(0, len(w) - m + 1)) as s from d, lens where len(w) >= m),
hit as (select doc_id, s, win.m, item_id from (select doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') as win from ds) x join win using (m, win)),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""
