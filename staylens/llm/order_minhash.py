"""Order MinHash fingerprints, and each document's likeness to its edited text and to its neighbour.

All ``K``-character substrings of a text are numbered by occurrence and hashed with that number: their place on the ring
depends on nothing else, so that texts of any two lengths place a shared substring alike.  For each of ``SLOTS``
evenly spaced points of the hash ring the ``TUPLE`` next hashes are selected: minima of a random order, as many for a short
text as for a long one.  The selected substrings are put back into text order and hashed together, so a slot agrees only if
both texts select the same substrings in the same order; that makes the share of equal slots follow edit distance.

The next document in descending id order is found without sorting all rows in one place: ids are cut into ranges, each
range is one sorted run, and only the first document of each range is copied to the range before it.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

K, SLOTS, TUPLE = 8, 64, 2
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, k: int = K, slots: int = SLOTS, size: int = TUPLE) -> np.ndarray:
    """``slots`` 32-bit numbers; a text shorter than ``k`` is its own only substring, an empty one gives all zeros."""
    if not text:
        return np.zeros(slots, np.uint32)
    chars = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    k = min(k, len(chars))
    h = chars[:len(chars) - k + 1].copy()
    for i in range(1, k):
        h = h * _MULT + chars[i:len(chars) - k + 1 + i]
    h = _mix(h + np.uint64(k))
    n = len(h)
    order = np.argsort(h)
    gram = h[order]
    same = gram[1:] == gram[:-1]
    at = np.arange(n)
    first = np.concatenate([[True], ~same])
    if same.any():  # argsort is not stable: occurrences of one substring are put into text order
        order = np.sort((np.cumsum(first) << 32) | order) & 0xFFFFFFFF
    number = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    priority = _mix(gram + number * _MULT)
    ring = np.argsort(priority)
    step = np.arange(slots, dtype=np.uint64) * np.uint64((1 << 64) // slots)
    chosen = (np.searchsorted(priority[ring], step)[:, None] + np.arange(min(size, n))) % n
    places = np.sort(order[ring[chosen]], axis=1)
    out = np.zeros(slots, np.uint64)
    for c in range(places.shape[1]):
        out = _mix(out * _MULT + h[places[:, c]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, nxt: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many characters from the start of ``nxt``."""
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """(range, tail, nulls, down, h, doc_id, text): each row in its range, and again as ``tail`` of the range before."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))
    cuts = np.array(sorted(set(bounds)), float)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(float), "right"), dtype="int32")

    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(text)
    late = (len(cuts) + 1 + F.floor((h / F.lit(2.0 ** 64) + 0.5) * n)).cast("int")  # rows without an id, by their text's hash
    rows = docs.select(F.when(F.col("doc_id").isNull(), late).otherwise(place(F.coalesce("doc_id", F.lit(0)))).alias("range"),
                       F.col("doc_id").isNull().alias("nulls"), F.bitwise_not("doc_id").alias("down"), h.alias("h"), "doc_id", text.alias("text"))
    heads = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min(F.struct("nulls", "down", "h")).alias("first")).collect()}
    order = sorted(heads)
    before = [(r, heads[r]["h"], order[i - 1]) for i, r in enumerate(order)]
    firsts = spark.createDataFrame(before, "range int, h long, to int")
    same = rows["range"].eqNullSafe(firsts["range"]) & (rows["h"] == firsts["h"])
    marked = rows.join(F.broadcast(firsts), same, "left").select(rows["*"], "to")
    mine, copy = F.struct("range", F.lit(False).alias("tail")), F.struct(F.col("to").alias("range"), F.lit(True).alias("tail"))
    put = F.explode(F.when(F.col("to").isNull(), F.array(mine)).otherwise(F.array(mine, copy)))
    return marked.withColumn("put", put).select("put.range", "put.tail", "nulls", "down", "h", "doc_id", "text")


def fingerprint_neighbours(docs: DataFrame, k: int = K, slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id; after the last comes the first.  Rows without an id come
    last, ordered by a hash of their text; rows of one id by that hash, then the text.  A null text is empty, a single
    row is its own neighbour, and an empty table gives no rows.
    """
    def run(batches):
        held = None  # the row whose neighbour comes next: (range, doc_id, text, fingerprint)
        for b in batches:
            out = []
            for r, tail, i, text in zip(b["range"], b["tail"], b["doc_id"], b["text"]):
                if held is None or held[0] != r:
                    if tail:
                        continue  # rows of one id may be copied more than once; the first is the neighbour
                    held = (r, i, text, fingerprint(text, k, slots, size))
                    continue
                own = held[3]
                nxt = own if text == held[2] else fingerprint(text, k, slots, size)
                edited = edited_text(held[2], text)
                changed = own if edited == held[2] else fingerprint(edited, k, slots, size)
                out.append((held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            own.astype(">u4").tobytes().hex(), changed.astype(">u4").tobytes().hex(), likeness(own, changed), likeness(own, nxt)))
                held = None if tail else (r, i, text, nxt)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                                             "near_next"]).astype({"doc_id": "Int64"})

    sort = ["range", "tail", "nulls", "down", "h", "text"]
    return (_in_ranges(pick(docs, doc_id="long", text="string")).repartition("range").sortWithinPartitions(*sort)
            .mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                              "near_edited double, near_next double"))
