"""Benchmark decontamination with a stored positional inverted index. DataFrame functions only.

Index: one row per occurrence of a term that the test items use, (row, term, pos), plus one
length posting per document, written to the shared folder.  Text is read once; counts, seeds,
intersections and lengths all come from the index.

Exact phrases: every window of an item takes its two rarest terms by corpus frequency.
Their lists, shifted by the offset of the term in the item, are intersected on
(document, item, shift).  What is left is completed with the other terms of the window.
Proximity: all terms of a window within a span of words, found from the rarest term.

A word is a run of 0-9, a-z (A-Z lowered) and non-ASCII characters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = "\x00"  # the length posting; no word holds it
TERM_ROWS = 1_000_000  # distinct test terms up to which they are broadcast to the scan


def words(text: str = "text") -> Column:
    """Words of a text column; null has none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWERED)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (row number of its own), item_id, words; items without words are left out."""
    out = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words().alias("words"))
    return cut(out.filter(F.size("words") > 0))


def build_index(docs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Stored postings (row, keys..., tid, pos) of `terms` (term, tid); tid -1 is the length posting."""
    # leading empty word: the first split part may be empty; its position is corrected, no filter pass is needed
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWERED)
    parts = F.split(lowered, BETWEEN)
    src = docs.select(F.monotonically_increasing_id().alias("row"), *keys, parts.alias("__parts"))
    lead = F.when(F.element_at("__parts", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("__parts") > 1) & (F.element_at("__parts", -1) == ""), 1).otherwise(0)
    src = src.select("row", *keys, lead.alias("__lead"), (F.size("__parts") - lead - tail).alias("__n"), F.concat("__parts", F.array(F.lit(END))).alias("__parts"))
    each = src.select("row", *keys, "__lead", "__n", F.posexplode("__parts").alias("__at", "term"))
    vocabulary = terms.unionByName(terms.sparkSession.createDataFrame([(END, -1)], "term string, tid int"))
    kept = each.join(checked(vocabulary, TERM_ROWS), "term")
    pos = F.when(F.col("tid") == -1, F.col("__n")).otherwise(F.col("__at") - F.col("__lead"))
    return cut(kept.select("row", *keys, "tid", pos.cast("int").alias("pos")))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item, item_id, start, len, words: every `size` consecutive words; a shorter item is one window."""
    n = F.size("words")
    out = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))))
    return out.select("item", "item_id", "start", F.least(n, F.lit(size)).alias("len"), F.slice("words", F.col("start") + 1, F.least(n, F.lit(size))).alias("words"))


def prepare(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, terms, index, term frequencies)."""
    items = items_of(benchmark)
    # ids of the distinct terms: a running number over the test vocabulary alone
    distinct = items.select(F.explode("words").alias("term")).distinct()
    terms = cut(distinct.select("term", F.row_number().over(Window.orderBy("term")).alias("tid")))
    index = build_index(docs, terms, keys)
    freq = cut(index.filter("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("cf")))
    return items, terms, index, freq


def _places(windows: DataFrame, terms: DataFrame, freq: DataFrame) -> DataFrame:
    """One row per word of a window: item, start, len, ipos, tid, cf; windows with an absent term are dropped."""
    each = windows.select("item", "start", "len", F.posexplode("words").alias("o", "term")).join(terms, "term").join(freq, "tid", "left")
    each = each.select("item", "start", "len", (F.col("start") + F.col("o")).alias("ipos"), "tid", F.coalesce("cf", F.lit(0)).alias("cf"))
    dead = each.filter("cf = 0").select("item", "start").distinct()
    return each.join(dead, ["item", "start"], "left_anti")


def phrase_hits(items: DataFrame, terms: DataFrame, index: DataFrame, freq: DataFrame, size: int = 10) -> DataFrame:
    """row, item, at (position in the document), start, len: every exact occurrence of a window."""
    places = cut(_places(windows_of(items, size), terms, freq))
    order = F.row_number().over(Window.partitionBy("item", "start").orderBy("cf", "ipos"))
    ranked = places.withColumn("rank", order)
    pair = ranked.filter("rank <= 2").groupBy("item", "start", "len").agg(F.min("ipos").alias("p1"), F.max("ipos").alias("p2"))
    pair = cut(pair)
    seeds = pair.select("item", F.col("p1").alias("ipos")).unionByName(pair.select("item", F.col("p2").alias("ipos"))).distinct()
    seeds = cut(seeds.join(places.select("item", "ipos", "tid").distinct(), ["item", "ipos"]))
    lists = index.select("row", "tid", "pos").join(checked(seeds), "tid").select("row", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    # the two offset-adjusted lists of a window meet on (row, item, shift)
    at = lists.groupBy("row", "item", "shift").agg(F.collect_set("ipos").alias("found"))
    near = at.join(checked(pair), "item").filter(F.array_contains("found", F.col("p1")) & F.array_contains("found", F.col("p2")))
    near = cut(near.select("row", "item", "shift", "start", "len"))
    # all positions of what is left, against the same index
    need = near.select("row", "item", "shift", F.explode(F.sequence("start", F.expr("start + len - 1"))).alias("ipos")).distinct()
    need = need.join(checked(places.select("item", "ipos", "tid").distinct()), ["item", "ipos"]).select("row", "item", "shift", "ipos", "tid", (F.col("shift") + F.col("ipos")).alias("pos"))
    few = index.select("row", "tid", "pos").join(checked(near.select("row").distinct()), "row", "left_semi")
    met = need.join(few, ["row", "tid", "pos"]).select("row", "item", "shift", "ipos").distinct()
    got = met.groupBy("row", "item", "shift").agg(F.collect_set("ipos").alias("met"))
    full = near.join(got, ["row", "item", "shift"]).filter(F.forall(F.sequence("start", F.expr("start + len - 1")), lambda p: F.array_contains("met", p)))
    return full.select("row", "item", (F.col("shift") + F.col("start")).alias("at"), "start", "len")


def proximity_hits(items: DataFrame, terms: DataFrame, index: DataFrame, freq: DataFrame, size: int = 10, span: int = 20) -> DataFrame:
    """row, item, start, anchor: every term of the window occurs, in any order, within `span` words that hold
    the anchor, an occurrence of the window's rarest term."""
    places = cut(_places(windows_of(items, size), terms, freq))
    distinct = places.select("item", "start", "tid", "cf").distinct()
    order = Window.partitionBy("item", "start").orderBy("cf", "tid")
    ranked = distinct.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item", "start")))
    anchors = index.select("row", "tid", F.col("pos").alias("anchor")).join(checked(ranked.filter("rank = 1").select("item", "start", "tid", "n")), "tid")
    anchors = cut(anchors.select("row", "item", "start", "anchor", "n"))
    few = index.filter("tid >= 0").select("row", "tid", "pos").join(checked(anchors.select("row").distinct()), "row", "left_semi")
    rest = anchors.join(checked(ranked.select("item", "start", "tid")), ["item", "start"])
    met = rest.join(few, ["row", "tid"]).filter(F.abs(F.col("pos") - F.col("anchor")) < span)
    # a frame of `span` words that starts at a found position and holds the anchor
    begins = met.filter("pos <= anchor").select("row", "item", "start", "anchor", F.col("pos").alias("begin")).distinct()
    inside = met.join(begins, ["row", "item", "start", "anchor"]).filter((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + span))
    full = inside.groupBy("row", "item", "start", "anchor", "begin", "n").agg(F.countDistinct("tid").alias("m")).filter("m = n")
    return full.select("row", "item", "start", "anchor").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys..., n_words, n_hit, n_items, items_sha256, contaminated: one row per input row.

    A document word is hit if it lies inside any occurrence of a window.  A null text has no
    words; an item with a null id marks words but is not listed.  Ids that occur twice in
    the benchmark are one item.
    """
    keys = list(keys)
    items, terms, index, freq = prepare(docs, benchmark, keys)
    hits = cut(phrase_hits(items, terms, index, freq, size))
    covered = hits.select("row", F.explode(F.sequence("at", F.expr("at + len - 1"))).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("row", "item").distinct().join(checked(items.select("item", "item_id")), "item").filter("item_id IS NOT NULL")
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    lengths = index.filter("tid = -1").select("row", *keys, F.col("pos").cast("bigint").alias("n_words"))
    found = covered.join(listed, "row", "left")
    out = lengths.join(found, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        *keys,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""
