"""Benchmark decontamination by token windows, in DataFrame and SQL functions alone.

Words are normalised, and every window of `size` consecutive words of an item is a test n-gram. Scanning all windows of all documents is
not needed: a window of ten words holds a five-word gram that starts at a multiple of six in the document, so one five-word gram in six
is hashed and looked up, and only documents where one of them belongs to an item are scanned window by window. Hits are verified on the
words themselves, never on hashes alone.

The grams are counted first. At most MAX_LITERALS of them are a literal hash set that travels with the plan; at most MAX_BROADCAST are a
table that is broadcast and looked up by joins; beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import checkpoint

SIZE = 10
ANCHOR = 5
#: Grams that a plan may carry.
MAX_LITERALS = 50_000
#: Grams, with what is looked up of each, that are sent to every executor: some 100 bytes each.
MAX_BROADCAST = 1_000_000
#: What parts words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, n, gram) distinct windows of items: n words joined by spaces, n under size only if the item has no more."""
    own = benchmark.select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0")
    return own.select("item_id", F.expr(f"least(size(words), {size})").alias("n"), F.expr(f"explode(transform(sequence(1, greatest(1, size(words) - {size - 1})), p -> concat_ws(' ', slice(words, p, {size}))))").alias("gram")).distinct()


def anchors(of: str, at: str) -> str:
    return f"xxhash64(slice({of}, {at}, {ANCHOR}))"


def in_set(value: str, found: list) -> str:
    return f"{value} IN ({', '.join(found)})" if found else "false"


def text_literal(gram: str) -> str:
    return "'" + gram.replace("\\", "\\\\").replace("'", "\\'") + "'"  # words hold neither; a custom window might


def hits(docs: DataFrame, windows: DataFrame, size: int = SIZE, max_literals: int = MAX_LITERALS) -> DataFrame:
    """docs (any columns, words) with hits: array of (p, n, gram), p from 1, for every place where a window of an item stands."""
    lengths = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]  # at most `size` of them
    empty = "cast(array() as array<struct<p: int, n: int, gram: string>>)"
    if not lengths:
        return docs.withColumn("hits", F.expr(empty))
    grams = windows.select("n", "gram").distinct()
    number = grams.count()
    if number > max_literals:
        return joined_hits(docs, grams, lengths, empty, number <= MAX_BROADCAST)
    known = {n: [r["gram"] for r in grams.filter(F.col("n") == n).collect()] for n in lengths}  # max_literals in all
    tests = []
    for n in lengths:
        if n < 2 * ANCHOR:  # short windows are looked up at every place
            tests.append(f"(size(words) >= {n} AND exists(sequence(1, size(words) - {n - 1}), p -> {in_set(f"concat_ws(' ', slice(words, p, {n}))", [text_literal(g) for g in known[n]])}))")
            continue
        parts = windows.filter(F.col("n") == n).select(F.split("gram", " ").alias("w")).select(F.expr(f"explode(transform(sequence(1, {n - ANCHOR + 1}), p -> {anchors('w', 'p')}))").alias("h")).distinct()
        tests.append(f"(size(words) >= {n} AND exists(sequence(1, size(words) - {ANCHOR - 1}, {n - ANCHOR + 1}), p -> {in_set(anchors('words', 'p'), [f'{r["h"]}L' if r['h'] > -(2**63) else 'long(-9223372036854775808)' for r in parts.collect()])}))")
    found = [
        f"CASE WHEN size(words) >= {n} THEN filter(transform(sequence(1, size(words) - {n - 1}), p -> struct(p AS p, {n} AS n, concat_ws(' ', slice(words, p, {n})) AS gram)), h -> {in_set('h.gram', [text_literal(g) for g in known[n]])}) ELSE {empty} END"
        for n in lengths
    ]
    return docs.withColumn("hits", F.expr(f"CASE WHEN {' OR '.join(tests)} THEN concat({', '.join(found)}) ELSE {empty} END"))


def joined_hits(docs: DataFrame, grams: DataFrame, lengths: list[int], empty: str, few: bool) -> DataFrame:
    """hits() where the grams are too many to travel with the plan: their anchors and then windows meet documents in joins."""
    sent = F.broadcast if few else lambda df: df
    keyed = checkpoint(docs.sparkSession, docs.withColumn("row", F.monotonically_increasing_id()))  # the numbers are read three times
    keys = []
    for n in lengths:
        width, step = (ANCHOR, n - ANCHOR + 1) if n >= 2 * ANCHOR else (n, 1)
        theirs = grams.filter(F.col("n") == n).select(F.split("gram", " ").alias("w")).select(F.expr(f"explode(transform(sequence(1, {n - width + 1}), p -> xxhash64(slice(w, p, {width}))))").alias("h")).distinct()
        ours = keyed.filter(F.expr(f"size(words) >= {n}")).select("row", F.expr(f"explode(array_distinct(transform(sequence(1, size(words) - {width - 1}, {step}), p -> xxhash64(slice(words, p, {width})))))").alias("h"))
        keys.append(ours.join(sent(theirs), "h", "left_semi").select("row"))
    some = keys[0]
    for k in keys[1:]:
        some = some.union(k)
    scan = keyed.join(some.distinct(), "row", "left_semi")
    places = None
    for n in lengths:
        own = scan.filter(F.expr(f"size(words) >= {n}")).select("row", F.expr(f"explode(transform(sequence(1, size(words) - {n - 1}), p -> struct(p AS p, {n} AS n, concat_ws(' ', slice(words, p, {n})) AS gram)))").alias("h")).select("row", "h.*")
        places = own if places is None else places.union(own)
    found = places.join(sent(grams), ["n", "gram"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("p", "n", "gram")).alias("hits"))
    return keyed.join(found, "row", "left").withColumn("hits", F.coalesce("hits", F.expr(empty))).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_literals: int = MAX_LITERALS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id, text).

    A word is hit if a window of an item covers it. Null and empty texts have no words; items without words are no windows; repeated
    rows have a row each. Texts of any length are scanned whole, an empty table gives an empty one, and other columns are ignored.
    """
    windows = item_windows(benchmark, size)
    own = docs.select("doc_id", words(F.col("text")).alias("words"))
    found = hits(own, windows, size, max_literals).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "hits")
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["p"], h["p"] + h["n"] - 1)))))
    counted = found.select("row", "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.explode_outer(F.array_distinct(F.transform("hits", lambda h: F.struct(h["n"].alias("n"), h["gram"].alias("gram"))))).alias("g"))
    named = counted.join(windows.select(F.col("n").alias("w_n"), F.col("gram").alias("w_gram"), "item_id"), (F.col("g.n") == F.col("w_n")) & (F.col("g.gram") == F.col("w_gram")), "left")
    per_row = named.groupBy("row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return per_row.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_literals: int = MAX_LITERALS) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item stands; null and empty texts stay, and so do all if there are no items."""
    named = docs.withColumn("words", words(F.col("text"))) if "words" not in docs.columns else None
    if named is None:  # a clashing column keeps its values
        renamed = docs.withColumnRenamed("words", "own words")
        return clean(renamed, benchmark, size, max_literals).withColumnRenamed("own words", "words").select(docs.columns)
    found = hits(named, item_windows(benchmark, size), size, max_literals)
    # a filter would move below the words, which its conditions would then make anew for every window; a generator stays above them
    return found.withColumn("hits", F.explode(F.when(F.size("hits") == 0, F.array(F.lit(1))))).select(docs.columns)
