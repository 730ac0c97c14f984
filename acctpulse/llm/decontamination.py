"""Benchmark decontamination by SimHash of item-sized windows.

A window as long as a benchmark item, in words, gets a 64-bit SimHash of its
words. Fingerprints are cut into BLOCKS parts; two that differ in at most RADIUS
bits agree in at least one part (one part more than bits), so joining on parts
finds every pair within the radius. A window may be similar and still differ in
more bits. So pairs that share one of their first shingles in the order of hashes
are verified as well: two sets as similar as SIMILARITY cannot differ in all of
them, also where a document is shorter than the item (prefix filter). What is found is verified by the exact weighted similarity
of five-word shingles, each weighted by how often it occurs.

Every window that can reach the similarity is fingerprinted, wherever it starts:
such a window shares SIMILARITY of the shingles of an item of its length, so it
holds at least so many that some item of that length has. Which item a window is,
fingerprints and first shingles decide. Windows are fingerprinted and verified once per
distinct wording, so a passage that many documents share costs one verification.

Built-in expressions only. The shingles of the benchmark are broadcast behind a
check of their number; a larger benchmark joins by shuffle. Positions meet the
shingles without their texts; the texts that have a window join afterwards.

Defined results: null and empty texts have no windows; items with fewer than
five words have no shingle and match nothing; a window that would pass an end of
the document is moved inside, and a document shorter than the item is one window;
rows that repeat id and text give one result; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.words import let, text_of
from acctpulse.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which all fingerprints are found, and the parts that guarantee it.
RADIUS = 11
BLOCKS = RADIUS + 1
#: Benchmark shingles that are broadcast at most, some 40 bytes each.
MOST_SENT = 1_000_000


def words_of(text: str = "text") -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column) -> Column:
    """64 bits; each is the majority of that bit among the hashes of the words."""

    def majority(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)))
            return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: f.bitwiseOR(bit(b)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), majority)


def parts(fingerprint: Column) -> Column:
    """The fingerprint's parts with their places."""
    ends = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v"))
            for k, (a, b) in enumerate(zip(ends, ends[1:]))
        ]
    )


def weighted_shingles(words: Column) -> Column:
    """Shingles, each labelled with how often it occurred before: sets of these compare as multisets do.

    In the order of the shingles, where equal ones are neighbours, so that the time grows with the sort only."""
    starts = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    plain = F.sort_array(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(SHINGLE)))))

    def label(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(at: Column) -> Column:
            def run(first: Column, j: Column) -> Column:
                times = F.coalesce(F.get(at, j + 1), F.size(s)) - first
                return F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.concat_ws("#", F.get(s, first), k.cast("string")))

            return F.flatten(F.transform(at, run))

        return let(firsts, runs)

    return F.when(F.size(words) >= SHINGLE, let(plain, label)).otherwise(F.array().cast("array<string>"))


def first_shingles(shingles: Column) -> Column:
    """Hashes of so many first shingles in hash order that two windows of SIMILARITY share one of them, whatever their sizes.

    What they share is at least SIMILARITY of all, and so of either side's own shingles."""
    m = F.size(shingles)
    common = F.ceil(F.lit(SIMILARITY) * m - 1e-9).cast("int")
    return F.slice(F.sort_array(F.transform(shingles, lambda x: F.xxhash64(x))), 1, m - common + 1)


def _starts(at: Column, n: Column, last: Column) -> Column:
    """Starts up to ``last`` of all windows of n words that hold SIMILARITY of n words' shingles, by the sorted positions of known ones."""
    needed = F.ceil(F.lit(SIMILARITY) * (n - SHINGLE + 1) - 1e-9).cast("int")

    def span(i: Column) -> Column:
        # The windows that hold the i-th and as many after it as are needed; those before it have been named.
        low = F.greatest(F.get(at, i + needed - 1) - (n - SHINGLE), F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.lit(0))
        high = F.least(F.get(at, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - needed), span))
    return F.when(F.size(at) >= needed, spans).otherwise(F.array().cast("array<int>"))


def proposed(docs: DataFrame, items: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, start, n, aligned, wording, print): item-sized windows of documents that can be as similar as SIMILARITY;
    aligned: a shingle stands where an item of that size has it; print: md5 of the wording."""
    seeds = materialize(
        items.select("n", F.posexplode(_shingle_hashes(F.col("words"))).alias("offset", "seed")).distinct(), "seeds"
    )
    shape = let(words_of(text), lambda w: F.struct(F.size(w).alias("len"), _shingle_hashes(w).alias("hashes")))
    rows = docs.select(F.md5(text_of(text)).alias("key"), shape.alias("d"))
    few = seeds.count() <= MOST_SENT
    hits = rows.select("key", "d.len", F.posexplode("d.hashes").alias("at", "seed")).join(F.broadcast(seeds) if few else seeds, "seed")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("len") - F.col("n"))).cast("int")
    held = hits.select("key", "n", "len", "at", start.alias("start")).groupBy("key", "n", "len")
    held = held.agg(F.sort_array(F.collect_set("at")).alias("at"), F.collect_set("start").alias("aligned"))
    places = held.select("key", "n", "aligned", _starts(F.col("at"), F.col("n"), F.greatest(F.lit(0), F.col("len") - F.col("n"))).alias("starts"))

    def marked(starts: Column, aligned: bool) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.col("n").alias("n"), F.lit(aligned).alias("aligned")))

    ws = F.concat(marked(F.array_intersect("starts", "aligned"), True), marked(F.array_except("starts", "aligned"), False))
    windows = places.where(F.size("starts") > 0).select("key", ws.alias("ws"))
    # A text's windows are as many as its words at most; texts meet them once.
    windows = materialize(windows.groupBy("key").agg(F.flatten(F.collect_list("ws")).alias("ws")), "window_places")
    # Texts without a window drop out before they are shuffled.
    keys = windows.select("key")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text_of(text)).alias("key"), F.col(text).alias("dc_text"))
    texts = texts.join(F.broadcast(keys) if windows.count() <= MOST_SENT else keys, "key", "left_semi").dropDuplicates(["doc_id", "key"])
    cut = let(
        words_of("dc_text"),
        lambda t: F.transform("ws", lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), w["aligned"].alias("aligned"), F.array_join(F.slice(t, w["start"] + 1, w["n"]), " ").alias("wording"))),
    )
    return texts.join(windows, "key").select("doc_id", "key", F.inline(cut)).withColumn("print", F.md5("wording"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """One row per document (id and text) and item that it holds: doc_id, key, item_id, similarity, start (of the best
    window, in words; of equals an aligned one), n (its words), n_windows (aligned windows as similar as SIMILARITY), n_similar (all such windows)."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(item_text).alias("words")).withColumn("n", F.size("words"))
    items = materialize(items.where(F.col("n") >= SHINGLE), "items")
    found = materialize(proposed(docs, items, text, doc_id), "windows")
    # Each distinct wording once.
    wordings = found.select("n", "print", "wording").distinct()
    wordings = materialize(wordings.select("n", "print", "wording", simhash(F.split("wording", " ")).alias("fp")), "wordings")
    shingles = weighted_shingles(F.split("wording", " ")).alias("s")
    prints = items.select("n", "item_id", simhash(F.col("words")).alias("fp"), weighted_shingles(F.col("words")).alias("s"))
    prints = materialize(prints, "prints")
    left = wordings.select("n", "print", "wording", "fp", F.explode(parts(F.col("fp"))).alias("p")).select("n", "p.*", "print", "wording", "fp")
    right = prints.select("n", "item_id", "fp", "s", F.explode(parts(F.col("fp"))).alias("p")).select(
        "n", "p.*", "item_id", F.col("fp").alias("item_fp"), F.col("s").alias("item_s")
    )
    near = left.join(right, ["n", "k", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("n", "print", shingles, "item_id", "item_s")
    first = wordings.select("n", "print", shingles).select("n", "print", "s", F.explode(first_shingles(F.col("s"))).alias("v"))
    item_first = prints.select("n", "item_id", F.col("s").alias("item_s"), F.explode(first_shingles(F.col("s"))).alias("v"))
    near = near.unionByName(first.join(item_first, ["n", "v"]).select(*near.columns))
    common = F.size(F.array_intersect("s", "item_s"))
    alike = common / (F.size("s") + F.size("item_s") - common).cast("double")
    sure = near.select("print", "n", "item_id", alike.alias("similarity")).where(F.col("similarity") >= SIMILARITY).distinct()
    sure = materialize(sure, "sure")
    hits = found.drop("wording").join(sure, ["print", "n"])
    best = F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("minus"), "n"))
    return (
        hits.groupBy("doc_id", "key", "item_id")
        .agg(best.alias("best"), F.count_if("aligned").alias("n_windows"), F.count(F.lit(1)).alias("n_similar"))
        .select("doc_id", "key", "item_id", "best.similarity", (-F.col("best.minus")).alias("start"), "best.n", "n_windows", "n_similar")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    bad = materialize(leaks(docs, benchmark, text, doc_id).select(F.col("key").alias("dc_bad")).distinct(), "leaked")
    keyed = docs.withColumn("dc_key", F.md5(text_of(text)))
    return keyed.join(bad, F.col("dc_key") == F.col("dc_bad"), "left_anti").drop("dc_key")
