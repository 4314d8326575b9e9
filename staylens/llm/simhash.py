"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Words are the runs between ASCII white space of the text with A-Z lower-cased; shingles are ``words`` consecutive words
joined by spaces, repeats included (a shorter text is one shingle of all its words).  A bit of the fingerprint is 1 if it
is set in over half of the shingles' XXH64 values.  No words: fingerprint zero, linked like any other.

With ``blocks`` blocks of bits, two fingerprints that differ in at most ``distance`` bits agree in ``blocks - distance``
whole blocks, so each choice of that many blocks is one join key.  Work is on distinct fingerprints.  Every bucket first
links its members to its smallest member where they are close enough; the components of these stars are found, and
only pairs of different components are then compared.  A dense group of near copies thus gives a star of links, not
all its pairs, and no link that joins two components is lost.

The pipeline stage links by another rule, a Jaccard similarity of the sets of five-word shingles of ``SIMILARITY`` or more.
A fingerprint of 64 bits cannot find such pairs with few keys, so candidates are texts that share one of ``BANDS`` keys
of ``BAND_ROWS`` seeded minima each (a pair at 0.8 is missed once in 360).  Eight bits of every minimum are a sketch that estimates
the similarity; pairs more than ``SIGMAS`` standard errors below the bound are not compared further (a pair at 0.8 is missed
once in 740), and each link is verified on both sets of shingles.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, components, pick, stored

SEED = 42
_ROWS = 1 << 14
STAGE_WORDS, SIMILARITY, BANDS, BAND_ROWS, SIGMAS = 5, 0.8, 32, 8, 3.0
_DRAWS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * BAND_ROWS), np.int64).astype(np.uint64)
_ODD, _ADD = _DRAWS[0] | np.uint64(1), _DRAWS[1]


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    n, digest = len(w), xxhash.xxh64_digest
    size = np.fromiter(map(len, w), np.int64, n)
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: max(n - words + 1, 1)], end[min(words, n) - 1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), _ROWS):
        spans = zip(first[i:i + _ROWS].tolist(), last[i:i + _ROWS].tolist())
        h = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; ``fp`` is the fingerprint as a signed long.  Null texts count as empty."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return pick(docs, doc_id="long", text="binary").select("doc_id", of("text").alias("fp"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - distance`` of the blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    whole = [sum(c) for c in combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _keyed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, distance)])
    return fps.select("*", F.posexplode(keys).alias("choice", "key"))


def _near(a, b, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def link_fingerprints(fps: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(fp, root): each distinct fingerprint with the smallest fingerprint reachable over links.

    Joins of keyed rows are by sort and merge: Spark sizes them as the fingerprints before the explode and would broadcast all keys.
    """
    keyed = _keyed(fps.select("fp"), blocks, distance)
    heads = keyed.groupBy("choice", "key").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    star = (keyed.join(heads.hint("merge"), ["choice", "key"]).filter((F.col("fp") != F.col("head")) & _near("fp", "head", distance))
            .select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct())
    first = components(star, "simhash-stars")
    labelled = stored(fps.select("fp").join(first, F.col("fp") == F.col("node"), "left")
                      .select("fp", F.coalesce("root", "fp").alias("comp")), "simhash-labelled")
    keyed = _keyed(labelled, blocks, distance)
    mixed = (keyed.groupBy("choice", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo < hi").select("choice", "key"))
    left = keyed.join(mixed.hint("merge"), ["choice", "key"], "left_semi")
    right = left.select("choice", "key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    cross = (left.join(right.hint("merge"), ["choice", "key"])
             .filter((F.col("fp") < F.col("fp2")) & (F.col("comp") != F.col("comp2")) & _near("fp", "fp2", distance))
             .select(F.least("comp", "comp2").alias("a"), F.greatest("comp", "comp2").alias("b")).distinct())
    second = components(cross, "simhash-cross")
    return (labelled.join(second, F.col("comp") == F.col("node"), "left")
            .select("fp", F.coalesce("root", "comp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(doc_id, fp, component_id), one row per document; ``component_id`` is the smallest doc_id reachable.

    Repeated rows stay repeated.  A null doc_id is kept and never a component's id, unless no row of it has one.
    An empty table gives an empty result.
    """
    members = stored(fingerprints(docs, words), "simhash-fingerprints")
    fps = members.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = stored(fps.join(link_fingerprints(fps, distance, blocks), "fp"), "simhash-roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return members.join(roots.join(lowest, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def row_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text): a row is known by its id and 128 bits of its text's hash; a null text counts as empty."""
    text = F.coalesce("text", F.lit("").cast("binary"))
    return pick(docs, doc_id="long", text="binary").select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2"), text.alias("text"))


def _keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of each ``root`` of ``rooted`` (doc_id, h1, h2, root), the row of ``docs`` with the smallest (doc_id, h1, h2), null ids last.

    Rows equal in id and text are reduced to the one whose other columns have the smallest hash.
    """
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("doc_id"), F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(SEED), text).alias("t2"), row.alias("row"))
    same = keyed["id"].eqNullSafe(kept["doc_id"]) & (keyed["t1"] == kept["h1"]) & (keyed["t2"] == kept["h2"])
    rest = F.xxhash64(F.to_json(F.struct(F.col("row.text").isNull().alias("no_text"), *[F.col(f"row.`{c}`") for c in docs.columns if c != "text"])))
    one = keyed.join(kept, same, "left_semi").groupBy("id", "t1", "t2").agg(F.min_by("row", rest).alias("row"))
    return one.select("row.*")


def keep_one_per_group(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """One row of ``docs`` for each component of linked fingerprints: the smallest id, then the smallest text hash.

    A row without an id stays only where its whole component has none.  Rows are told apart by id and text, so rows that
    share an id, or have none, but not a component all stay.
    """
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    rows = stored(row_keys(docs).select("doc_id", "h1", "h2", of("text").alias("fp")), "simhash-rows")
    return _keep_first(docs, rows.join(link_fingerprints(rows.select("fp").distinct(), distance, blocks), "fp"))


def shingle_set(text: bytes | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct shingles of one whole text as sorted 64-bit hashes; none without words."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    n, digest = len(w), xxhash.xxh64_digest
    size = np.fromiter(map(len, w), np.int64, n)
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: max(n - words + 1, 1)], end[min(words, n) - 1:]
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())]), ">u8").astype(np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest shingle under each of ``BANDS`` x ``BAND_ROWS`` seeded orders."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1 << 10):
        h = shingles[i:i + (1 << 10), None] * _ODD + _ADD
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` signed keys, each a hash of ``BAND_ROWS`` of the minima."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, BAND_ROWS)], np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Eight bits of each of the minima, eight of them in a signed long."""
    return least.astype(np.uint8).view(np.int64)


def sketches(texts: pd.Series) -> pd.DataFrame:
    """(n, keys, sketch) of each text: its number of shingles, band keys and sketch; one shingle set is held at a time."""
    n, keys, sketched = np.empty(len(texts), np.int32), [], []
    for i, text in enumerate(texts):
        found = shingle_set(text)
        least = minima(found)
        n[i] = len(found)
        keys.append(band_keys(least))
        sketched.append(sketch(least))
    return pd.DataFrame({"n": n, "keys": keys, "sketch": sketched})


def most_unlike(least: float) -> int:
    """So many minima of two texts may differ in their sketches if their similarity may be ``least``."""
    k = BANDS * BAND_ROWS
    return int(np.floor(k * (1 - least) + SIGMAS * np.sqrt(k * least * (1 - least))))


def _unlike(a: str, b: str):
    """Number of bytes in which two sketches differ."""
    def bytes_set(x, y):
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # the lowest bit of a byte becomes 1 if any of its bits is
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return F.aggregate(F.zip_with(a, b, bytes_set), F.lit(0), lambda s, v: s + v)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose two shingle sets (h1, set) have a similarity of ``least`` or more; row by row in the JVM."""
    left = sets.select(F.col("h1").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("h1").alias("b"), F.col("set").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    return pairs.join(left, "a").join(right, "b").filter((union == 0) | (both >= union * F.lit(least) - 1e-9)).select(*pairs.columns)


def link_similar(rows: DataFrame, full: DataFrame, least: float = SIMILARITY, stars: int = 2) -> DataFrame:
    """(h1, h2, root): each text of ``rows`` (h1, h2, n, keys) and ``full`` (h1, h2, text) with the smallest h1 reachable over verified links.

    In each of ``stars`` rounds a bucket links its members to one of them, another in each band and round; only then are members
    of a bucket's smaller components compared with those of its other components, where their sketches allow it and no earlier
    band has both.  Texts whose numbers of shingles differ too much for ``least`` are not compared.  Of different texts with one h1 only the smallest h2 is looked at.
    """
    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t).view(np.int64))

    nodes = stored(rows.groupBy("h1").agg(F.min("h2").alias("h2"), *[F.min_by(c, "h2").alias(c) for c in ("n", "keys", "sketch")]), "similar-nodes")
    keyed = nodes.select("h1", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    keyed = stored(keyed.join(shared, ["band", "key"], "left_semi"), "similar-buckets")
    labels = stored(keyed.select("h1").distinct().withColumn("comp", F.col("h1")), "similar-labels")
    wanted = nodes.select("h1", "h2").join(labels.select("h1"), "h1", "left_semi")
    sets = stored(full.join(wanted, ["h1", "h2"], "left_semi").groupBy("h1").agg(F.first("text").alias("text")).select("h1", shingles("text").alias("set")), "similar-sets", TEXTS_PER_BATCH)
    size = F.least("n", "n2") >= F.greatest("n", "n2") * F.lit(least) - 1e-9
    for turn in range(stars + 1):
        now = keyed.join(labels, "h1")
        if turn < stars:
            mixed = now.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                                   F.min(F.struct(F.xxhash64(F.lit(turn), "band", "h1").alias("o"), "h1", "n", "comp")).alias("head")).filter("lo < hi")
            other = mixed.select("band", "key", F.col("head.h1").alias("h2"), F.col("head.n").alias("n2"), F.col("head.comp").alias("comp2"))
            pairs = now.join(other, ["band", "key"]).filter((F.col("comp") != F.col("comp2")) & size)
            pairs = pairs.select(F.col("h2").alias("a"), F.col("h1").alias("b"), F.col("comp2").alias("u"), F.col("comp").alias("v"))
        else:
            parts = now.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("members"))
            mixed = (parts.groupBy("band", "key").agg(F.max(F.struct("members", "comp")).alias("most"), F.count(F.lit(1)).alias("parts"))
                     .filter("parts > 1").select("band", "key", F.col("most.comp").alias("largest")))
            split = now.join(mixed, ["band", "key"]).join(nodes.select("h1", "keys", "sketch"), "h1")
            right = split.select("band", "key", "largest", *[F.col(c).alias(d) for c, d in (("h1", "h2"), ("n", "n2"), ("comp", "comp2"), ("keys", "keys2"), ("sketch", "sketch2"))])
            left = split.filter(F.col("comp") != F.col("largest")).drop("largest")
            once = (F.col("comp2") == F.col("largest")) | (F.col("h1") < F.col("h2"))
            first = F.array_position(F.zip_with("keys", "keys2", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
            alike = _unlike("sketch", "sketch2") <= most_unlike(least)
            pairs = left.join(right, ["band", "key"]).filter((F.col("comp") != F.col("comp2")) & once & size & first & alike)
            pairs = pairs.select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b"), F.when(F.col("h1") < F.col("h2"), F.col("comp")).otherwise(F.col("comp2")).alias("u"),
                                 F.when(F.col("h1") < F.col("h2"), F.col("comp2")).otherwise(F.col("comp")).alias("v"))
        links = _verified(stored(pairs.distinct(), "similar-pairs"), sets, least)
        merged = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")), "similar-links")
        labels = stored(labels.join(merged, F.col("comp") == F.col("node"), "left").select("h1", F.coalesce("root", "comp").alias("comp")), "similar-labels")
    return nodes.select("h1", "h2").join(labels, "h1", "left").select("h1", "h2", F.coalesce("comp", "h1").alias("root"))


def keep_one_of_similar(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """As ``keep_one_per_group``, for texts linked by a five-word similarity of ``least`` or more; a text is known by h1 and h2."""
    sketched = F.pandas_udf(sketches, "n int, keys array<long>, sketch array<long>")
    full = row_keys(docs)
    rows = stored(full.select("doc_id", "h1", "h2", sketched("text").alias("s")).select("doc_id", "h1", "h2", "s.*"), "similar-rows", TEXTS_PER_BATCH)
    roots = link_similar(rows, full.select("h1", "h2", "text"), least).withColumnRenamed("h2", "known")
    alone = F.xxhash64("h1", "h2")  # a text whose h1 is another's
    rooted = rows.select("doc_id", "h1", "h2").join(roots, "h1")
    return _keep_first(docs, rooted.select("doc_id", "h1", "h2", F.when(F.col("h2") == F.col("known"), F.col("root")).otherwise(alone).alias("root")))
