"""Near-duplicate classes by order MinHash and banded alignment.

A document is a sequence of words, its k-mers are K words in a row, each
labelled with how often it occurred before, so that repetition counts. Each of
SKETCHES hash functions samples the KEPT smallest labelled k-mers and retains
their order in the text; the hash of that tuple is one sketch. Texts within a
small edit distance share some sketch, while texts with the same phrases in
another order do not. At a similarity of exactly SIMILARITY with scattered edits
a k-mer survives with 0.8 ** K, and two texts of 30 words or more share one of
the sketches with a probability of 0.995 or more. A text of at most SHORT words
has too few k-mers for that: it gives all its subsequences that an edit within
the similarity can leave, so pairs of short texts are found without exception.
Candidates are confirmed by aligning their words inside a band of the diagonals
that a similarity of SIMILARITY leaves.

Copies of one text are one node. The texts of a bucket are compared to leaders:
first to one, the text with most links so far, then to a few and ever more of them, until
the bucket's texts are all in one class or each has been a leader. Only texts of
different classes are compared, so that a group of near copies costs few rounds,
and no link that decides a class is missed inside a bucket. Lengths and bit maps of
the words leave out pairs that cannot be similar, before their words are read.
Classes are connected components, found by passing on smallest labels and
following pointers.

Buckets are aggregated before they are shuffled, nothing is collected, and what
a later step reads again is written to the shared folder. Hot leaders meet their
members in a join that Spark splits by skew.

Defined results: texts without words (null, empty) are one class per text;
repeated rows and repeated ids belong to the class of their text; class ids are
smallest document ids (null if all are null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.batches import hashed_words, map_texts, scramble
from acctpulse.session import discard, materialize

K, SKETCHES, KEPT = 3, 64, 2
SIMILARITY = 0.8
#: Words up to which texts are matched by subsequences.
SHORT = 14
#: Leaders of a bucket beside its best one, by round; then so many times more each round. Few at first: where texts
#: are alike, most join a class by these, and only the others meet the many.
LEADERS, GROWTH = (0, 16), 512
#: Rounds in which a text meets one leader only.
SINGLE = 1
#: Longs of the bit map by which pairs that cannot be similar are left out. With 8 of them the maps of two texts of 800
#: words differ in fewer bits than their edits may flip, whatever the texts are; 32 tell texts of over a thousand words.
MAP = 32
#: Bits for each text that shares a bucket, and at most, in the filter that keeps other texts from being shuffled.
FILTER_BITS, MOST_BITS = 8, 1 << 25
_TOP = np.uint64(2**64 - 1)


def labelled_kmers(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers in text order, and the offset of each text's first.

    A text with fewer than k words has one k-mer, of all its words.
    """
    words, at = hashed_words(texts)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offset = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(at[:-1] - offset[:-1], count) + np.arange(offset[-1])
    end = np.minimum(start + k, np.repeat(at[1:], count))
    key = np.full(len(start), 7, np.uint64)
    for i in range(k):
        inside = start + i < end
        key = scramble(key + np.where(inside, words[np.minimum(start + i, max(len(words) - 1, 0))], np.uint64(i)) if len(words) else key)
    of = np.repeat(np.arange(len(n)), count)
    # How many equal k-mers came before in the same text.
    own = scramble(key + scramble(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    first = np.concatenate(([True], own[order][1:] != own[order][:-1])) if len(own) else np.zeros(0, bool)
    run = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) if len(own) else own.astype(np.int64)
    before = np.empty(len(own), np.uint64)
    before[order] = run.astype(np.uint64)
    return scramble(key ^ scramble(before)), offset


def sketches(texts: list[str]) -> np.ndarray:
    """SKETCHES hashes per text; a row of zeros for a text without words."""
    key, offset = labelled_kmers(texts)
    out = np.zeros((len(texts), SKETCHES), np.uint64)
    some = np.flatnonzero(np.diff(offset))
    if not len(some):
        return out
    starts, count = offset[some], np.diff(offset)[some]
    # The lower half of a hash is replaced by the place in the text, so that the least one tells where it stands.
    place = (np.arange(len(key)) - np.repeat(starts, count)).astype(np.uint64)
    low = np.uint64(2**32 - 1)
    for j in range(SKETCHES):
        h = (key ^ scramble(np.array([j + 1], np.uint64))) * (scramble(np.array([j + 1001], np.uint64)) | np.uint64(1))
        h = (h & ~low) | place
        picks = []
        for _ in range(KEPT):
            least = np.minimum.reduceat(h, starts)
            gone = least == _TOP  # fewer k-mers than are kept: the last one again
            at = np.where(gone, picks[-1] if picks else starts, starts + (least & low).astype(np.int64))
            picks.append(at)
            h[at] = _TOP
        value = np.full(len(some), j + 1, np.uint64)
        for at in np.sort(np.stack(picks), 0):
            value = scramble(value + key[at])
        out[some, j] = value
    return out


#: Choices already listed, by their sizes; a plain table, so that the functions that use it travel to the tasks by value.
_places: dict[tuple[int, int], np.ndarray] = {}


def _kept_places(n: int, m: int) -> np.ndarray:
    """All choices of m of n places, in order."""
    if (n, m) not in _places:
        _places[n, m] = np.array(list(combinations(range(n), m)), np.int64).reshape(-1, m)
    return _places[n, m]


def subsequences(words: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Hashes of what an alignment of at least that similarity can leave of a short text, by the longer text's words."""
    n, lengths = len(words), set()
    for longer in range(n, SHORT + 1):
        m = longer - int((1 - least) * longer + 1e-9)
        if m <= n:
            lengths.add(m)
    out = []
    for m in sorted(lengths):
        at = _kept_places(n, m)
        h = np.full(len(at), 2**32 + m, np.uint64)
        for i in range(m):
            h = scramble(h + words[at[:, i]])
        out.append(h)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parities(texts: list[str]) -> np.ndarray:
    """A bit map per text: each word, labelled with how often it occurred before, flips a bit.

    An edit changes two labelled words at most, so the maps of two texts differ in at most twice as many bits as edits.
    """
    key, offset = labelled_kmers(texts, 1)
    flips = np.zeros((len(texts), 64 * MAP), np.uint8)
    of = np.repeat(np.arange(len(texts)), np.diff(offset))
    np.bitwise_xor.at(flips, (of, (key % np.uint64(64 * MAP)).astype(np.int64)), 1)
    return np.packbits(flips, axis=1).view(np.int64)


def buckets_of(texts: list[str], least: float = SIMILARITY) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of each text, none without words, and its number of words."""
    words, at = hashed_words(texts)
    n = np.diff(at)
    found = sketches(texts)
    out = []
    for i, k in enumerate(n):
        short = subsequences(words[at[i] : at[i + 1]], least) if 0 < k <= SHORT else found[i, :0]
        # Texts that can be similar to one above SHORT.
        out.append(np.concatenate((short, found[i])) if k >= least * (SHORT + 1) - 1e-9 else short)
    return out, n


def distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` if it is larger.

    Column by column, a band of 2 * most + 1 diagonals is kept as two bit vectors
    of vertical differences.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    lo = 0
    while lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < m - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    n, m = len(a), len(b)
    if not m:
        return n if n <= most else most + 1
    band = min(most, n)
    width = 2 * band + 2
    mask = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    bits = {x: sum(1 << i for i in p) for x, p in where.items()}
    vp, vn = mask ^ ((1 << (width - band - 1)) - 1), 0
    score, top, shift, row = band, 1 << (width - 1), band + 1 - width, 1 << (width - 2)
    for j, x in enumerate(b):
        seen = bits.get(x, 0)
        seen = (seen << -shift if shift < 0 else seen >> shift) & mask
        d0 = ((((seen & vp) + vp) & mask) ^ vp) | seen | vn
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if j < n - band:
            score += not d0 & top
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        vp = hn | (mask & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
        shift += 1
    return score if score <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """Share of words that an alignment leaves unchanged (1 - distance / longer length), or None below ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return None
    # Words that one has more often than the other must be edited.
    both = np.concatenate((a, b))
    sign = np.concatenate((np.ones(len(a), np.int64), -np.ones(len(b), np.int64)))
    _, of = np.unique(both, return_inverse=True)
    balance = np.bincount(of, sign)
    if max(balance[balance > 0].sum(), -balance[balance < 0].sum()) > most:
        return None
    x, y = a.tolist(), b.tolist()
    near = min(most, 64)  # most copies differ little: a narrow band first
    d = distance(x, y, near)
    if d > near and most > near:
        d = distance(x, y, most)
    return 1 - d / max(longer, 1) if d <= most else None


def text_key(text: str = "text") -> Column:
    """The node of a text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _exact_id(name: str) -> Column:
    """An id as text, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _may_hold(texts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``texts`` whose key may be one of those ``wanted``, and the table of bits that tells.

    Bits of hashed keys, aggregated by Spark, keep most other texts from being shuffled; an exact join follows.
    """
    bits = min(max(FILTER_BITS * wanted.count(), 1), MOST_BITS)
    bit = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1
    known = wanted.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    known = materialize(known, "known")
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1
    return texts.join(known, (F.bitmap_bucket_number(bit) == F.col("part")) & is_set, "left_semi"), known


def _verify(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(lead, key, alike): similarity of each of the (written) pairs, null below ``least``.

    Pairs are narrow, leaders few: while these are small, only the words of the pairs are shuffled, not the table's.
    """
    leads = words.select(F.col("key").alias("lead"), F.col("words").alias("w_lead")).join(pairs.select("lead").distinct(), "lead", "left_semi")
    joined = (
        pairs.join(words, "key")
        .withColumnRenamed("words", "w_key")
        .join(leads, "lead")
        .select("lead", "key", "w_key", "w_lead")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least)
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.float64())], names=["lead", "key", "alike"])

    return joined.mapInArrow(run, "lead long, key long, alike double")


def links(contents: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (lead, key, alike) between different texts, by their nodes, and (key, label) of every node on one.

    ``contents`` has node, key, id and the buckets of each text.
    """
    spark = docs.sparkSession
    # Only (bucket, text) is shuffled, until the buckets of a single text are gone.
    held = contents.select(F.col("node").alias("key"), F.explode("buckets").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = materialize(held.join(shared, "bucket"), "bucket_members")
    # Words and bit maps of the texts that share a bucket at all. A text's copies are spread by their ids; one of them is read.
    shares = held.select(F.col("key").alias("node")).distinct()
    wanted = contents.join(shares, "node", "left_semi").select("node", "key", _exact_id("id").alias("id"))
    wanted = materialize(wanted, "wanted")
    texts = docs.select(text_key(text).alias("key"), _exact_id(doc_id).alias("id"), F.col(text).alias("nd_text"))
    maybe, known = _may_hold(texts, wanted)
    found = maybe.join(wanted, ["key", "id"]).dropDuplicates(["key", "id"]).select(F.col("node").alias("key"), "nd_text")

    def coded(batch: list[str]) -> list[pa.Array]:
        words, at = hashed_words(batch)
        cut = pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        return [cut, pa.array(np.diff(at), pa.int64()), pa.array(list(parities(batch)), pa.list_(pa.int64()))]

    words = map_texts(found, ["key"], "words binary, n_words long, parity array<bigint>", lambda: coded, "nd_text")
    words = materialize(words, "words")
    discard(known)
    discard(wanted)
    maps = words.select("key", "n_words", *[F.coalesce(F.get("parity", F.lit(i)), F.lit(0)).alias(f"p{i}") for i in range(MAP)])
    words = words.select("key", "words")
    judged = spark.createDataFrame([], "lead long, key long, alike double")
    labels = spark.createDataFrame([], "key long, label long")
    # The same for a text in all its buckets: who leads in one leads in the smaller ones, now or before.
    chance = F.pmod(F.xxhash64(F.lit("leader"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    turn, rest = -SINGLE, held
    while True:
        ends = judged.where("alike IS NOT NULL").select(F.explode(F.array("lead", "key")).alias("key"))
        degree = ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
        members = rest.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        members = members.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        # Buckets with texts of different classes; who has most links leads, and more texts each round. Equals rank alike
        # in all buckets, so that those of one group have the same leader.
        rank = F.struct("degree", F.xxhash64("key"), "key")
        open_ = members.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.max(rank).alias("best"))
        members = materialize(members.join(open_.where("a != z").select("bucket", "best"), "bucket").drop("degree"), "open_members")
        # A bucket of one class stays one: later rounds read the open ones alone.
        discard(rest)
        rest = members.select("bucket", "key", "size")
        if members.isEmpty():
            break
        if turn < 0:
            # Each text meets the highest leader of all its buckets: a group of copies forms around few leaders, and
            # what is in one class is not compared again.
            top = members.where("key != best.key").groupBy("key").agg(F.max("best").alias("best"), F.first("label").alias("label"))
            met = top.select("key", "label", F.col("best.key").alias("lead"))
            met = met.join(labels.select(F.col("key").alias("lead"), F.col("label").alias("of_lead")), "lead", "left")
            met = met.where(F.col("label") != F.coalesce("of_lead", "lead")).join(maps, "key")
            met = met.join(maps.select(F.col("key").alias("lead"), *_as_lead()), "lead").where(_can(least))
        else:
            of = lambda t: F.lit(float(_leaders(t))) / F.col("size")
            is_best = F.col("key") == F.col("best.key")
            fresh = is_best | ((chance >= of(turn - 1 if turn else 0)) & (chance < of(turn)))
            by_size = F.array_sort(F.collect_list(F.struct("size", "bucket"))).getField("bucket")
            own = members.groupBy("key").agg(by_size.alias("own")).select("key", F.posexplode("own").alias("at", "bucket"), "own")
            own = own.select("key", "bucket", F.slice("own", F.lit(1), F.col("at")).alias("smaller"))
            wide = members.join(own, ["bucket", "key"]).join(maps, "key").withColumn("leads", fresh)
            lead = wide.where("leads").select(
                "bucket", F.col("key").alias("lead"), F.col("label").alias("of_lead"), is_best.alias("is_best"), F.col("smaller").alias("l_smaller"), *_as_lead()
            )
            # Two texts share many buckets: they meet in the smallest of these, once if both lead there, and elsewhere
            # under the best leader only.
            once = ~F.col("leads") | (F.col("lead") < F.col("key"))
            first = F.col("is_best") | (once & ~F.arrays_overlap("smaller", "l_smaller"))
            met = wide.join(lead, "bucket").where((F.col("label") != F.col("of_lead")) & _can(least) & first)
        pairs = met.select(F.least("lead", "key").alias("lead"), F.greatest("lead", "key").alias("key")).distinct()
        pairs = materialize(pairs.join(judged, ["lead", "key"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            new = materialize(_verify(pairs, words, least), "judged")
            judged = judged.unionByName(new)
            old, labels = labels, joined_labels(labels, new.where("alike IS NOT NULL").select("lead", "key"))
            discard(old)
        discard(pairs)
        # Every text of the largest open bucket has led.
        largest = members.agg(F.max("size")).first()[0]
        if turn > 0 and _leaders(turn) >= largest:
            break
        turn += 1
    for table in (rest, words):
        discard(table)
    return judged.where("alike IS NOT NULL"), labels


def _leaders(turn: int) -> int:
    """Leaders of a bucket up to that round, beside its best one."""
    return LEADERS[turn] if turn < len(LEADERS) else LEADERS[-1] * GROWTH ** (turn - len(LEADERS) + 1)


def _as_lead() -> list[Column]:
    """Length and bit map of a leader."""
    return [F.col("n_words").alias("n_lead"), *[F.col(f"p{i}").alias(f"l{i}") for i in range(MAP)]]


def _can(least: float) -> Column:
    """Lengths and bit maps of a text and a leader allow the similarity."""
    longer, shorter = F.greatest("n_words", "n_lead"), F.least("n_words", "n_lead")
    most = F.floor((1 - least) * longer + 1e-9)
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"l{i}"))) for i in range(MAP)), F.lit(0))
    return (longer - shorter <= most) & (differ <= 2 * most - (longer - shorter))


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label) after new edges (lead, key): components of what the ends were labelled before."""
    known = lambda end: labels.select(F.col("key").alias(end), F.col("label").alias(f"{end}_label"))
    named = edges.join(known("lead"), "lead", "left").join(known("key"), "key", "left")
    named = materialize(
        named.select(F.coalesce("lead_label", "lead").alias("lead"), F.coalesce("key_label", "key").alias("key")).where("lead != key").distinct(),
        "new_edges",
    )
    parts = components(named)
    merged = parts.withColumnsRenamed({"key": "was", "label": "now"})
    old = labels.join(merged, labels.label == merged.was, "full")
    # A node without a label so far was its own.
    out = materialize(old.select(F.coalesce("key", "was").alias("key"), F.coalesce("now", "label").alias("label")), "labels")
    discard(named)
    discard(parts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key of the component of every key on an edge (lead, key).

    Every round takes the smallest label among the neighbours and then the label
    of that label; rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select(F.col("lead").alias("a"), F.col("key").alias("b"))
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        of = labels.select(F.col("key").alias("b"), F.col("label").alias("near"))
        least = both.join(of, "b").groupBy(F.col("a").alias("key")).agg(F.min("near").alias("near"))
        own = labels.join(least, "key").select("key", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("over"))
        new = own.join(jump, "next", "left").select("key", "label", F.least("next", "over").alias("next"))
        new = materialize(new, "labels")
        discard(labels)
        labels = new.select("key", F.col("next").alias("label"))
        if new.where("label != next").isEmpty():
            discard(both)
            return labels


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (its text), class_key, class_id (the smallest doc_id of its class),
    class_size (rows of the class), n_links (confirmed links of its text to other texts)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("nd_text"))

    def make():
        def rows(texts: list[str]) -> list[pa.Array]:
            found, _ = buckets_of(texts, least)
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return rows

    rows = materialize(map_texts(keyed, ["doc_id", "key"], "buckets array<bigint>", make, "nd_text"), "sketches")
    contents = rows.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("buckets").alias("buckets"))
    contents = materialize(contents.withColumn("node", F.monotonically_increasing_id()), "contents")
    discard(rows)
    edges, labels = links(contents, docs, text, doc_id, least)
    ends = edges.select(F.explode(F.array("lead", "key")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = contents.join(labels.withColumnRenamed("key", "node"), "node", "left").join(ends, "node", "left").select(
        "key", "id", "copies", F.coalesce("label", "node").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    nodes = materialize(nodes, "nodes")
    totals = nodes.groupBy("class_key").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = nodes.select("key", "class_key", "n_links").join(totals, "class_key")
    discard(contents)
    keys = keyed.select("doc_id", "key")
    return keys.join(known, "key").select("doc_id", "key", "class_key", "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of one row per class: of the smallest text key with the smallest id; of equal rows one.

    The row to keep is found among narrow rows; the texts are shuffled once, by key and id, which spreads copies.
    """
    found = classes(docs, text, doc_id)
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("k"))
    kept = materialize(kept.select(F.col("k.key").alias("nd_k"), F.col("k.doc_id").cast("string").alias("nd_i")), "kept")
    rows = docs.withColumns({"nd_key": text_key(text), "nd_id": F.col(doc_id).cast("string")})
    same = (F.col("nd_key") == F.col("nd_k")) & F.col("nd_id").eqNullSafe(F.col("nd_i"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["nd_key", "nd_id"]).select(*docs.columns)
