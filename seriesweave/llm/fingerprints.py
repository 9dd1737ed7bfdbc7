"""Document fingerprints: 64-bit SimHash over words, and search by permuted block tables.

Every word of a text votes with its hash: for each bit, for 1 or for 0, with the word's
length as weight, so that long and rare words outweigh short and common ones. Votes are
counted two bits to a long (a lane of 32 bits holds the weight of any text) by plain sums,
which Spark generates code for and combines before the shuffle. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
SPACE = r"[\x20\x09-\x0D]+"
RUN = 2048  # documents that one window orders
RUNS = 50_000


def _runs(docs: DataFrame) -> DataFrame:
    """Add `run`: quantile ranges of doc_id, null in run -1."""
    count = docs.count()
    runs = min(RUNS, max(1, -(-count // RUN)))
    bounds: list = []
    if runs > 1:
        at = [i / runs for i in range(1, runs)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * runs))).first()[0] or []))
    splits = [float("-inf"), *(float(b) for b in bounds), float("inf")]
    if len(splits) == 2:
        return docs.withColumn("run", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_run", handleInvalid="keep")
    marked = cut.transform(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    return marked.withColumn("run", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_run").cast("int"))).drop("_id", "_run")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by falling doc_id, the first's after the last.

    Null ids come last; documents of one id are ordered by text. A null text is an empty one.
    Documents are dealt to runs of ids, one shuffle; every run also gets the first document
    of the next one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _runs(rows).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.coalesce(F.col("doc_id").isNotNull().cast("int"), F.lit(0)).alias("known"), "doc_id", "tie")
    rows = rows.withColumn("order", order)
    heads = rows.groupBy("run").agg(F.max("order").alias("head"))
    whole, rising = Window.partitionBy(), Window.orderBy("run")
    above = F.coalesce(F.lead("run").over(rising), F.min("run").over(whole))
    heads = F.broadcast(heads.select(F.col("run").alias("_of"), "head", above.alias("goes_to")))  # RUNS rows at most
    guests = rows.join(heads, (F.col("run") == F.col("_of")) & F.col("order").eqNullSafe(F.col("head")))
    guests = guests.groupBy("goes_to", "doc_id").agg(F.max("text").alias("text"))
    guests = guests.select("doc_id", "text", F.col("goes_to").alias("run"), F.lit(0).cast("long").alias("tie"), F.lit(True).alias("guest"))
    every = rows.select("doc_id", "text", "run", "tie", F.lit(False).alias("guest")).unionByName(guests)
    falling = Window.partitionBy("run").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    every = every.withColumn("next_text", F.lead("text").over(falling)).filter(~F.col("guest"))
    return every.select("doc_id", "text", "next_text")


def _votes(hash_: Column, weight: Column) -> list[Column]:
    lanes = F.lit(0x0000000100000001)
    return [F.sum(F.shiftright(hash_, j).bitwiseAND(lanes) * weight).alias(f"v{j}") for j in range(32)]


def _fingerprint() -> Column:
    """The bits that have more than half of the weight, from the sums of _votes."""
    low = [((F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF))) * 2 > F.col("weight")).cast("long") for j in range(32)]
    high = [(F.shiftrightunsigned(F.col(f"v{j}"), 32) * 2 > F.col("weight")).cast("long") for j in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(bit, j) for j, bit in enumerate(low + high)])


def _fingerprints(rows: DataFrame, texts: dict[str, Column], keys: list[str]) -> DataFrame:
    """A long column for each text of a row; keys are fixed-width columns that tell rows apart."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), t.alias("text")) for i, t in enumerate(texts.values())))
    each = rows.select(*keys, F.explode(kinds).alias("t")).select(*keys, "t.kind", F.explode(F.split(F.lower("t.text"), SPACE)).alias("word"))
    each = each.select(*keys, "kind", F.xxhash64("word").alias("h"), F.length("word").cast("long").alias("w"))
    sums = each.groupBy(*keys, "kind").agg(*_votes(F.col("h"), F.col("w")), F.sum("w").alias("weight"))
    bits = sums.select(*keys, "kind", _fingerprint().alias("bits"))
    return bits.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == i, F.col("bits"))).alias(name) for i, name in enumerate(texts)))


def _as_text(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(bits)), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (16 hex digits) of docs(doc_id, text, ...); a text without words has all zeros."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    return _fingerprints(rows, {"bits": F.col("text")}, ["_row", "doc_id"]).select("doc_id", _as_text("bits").alias("fingerprint"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses; see op7 in queries.py."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", changed).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    words = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    rows = rows.select("doc_id", "n_chars", "text", "edited", "next_text", *words).withColumn("_row", F.monotonically_increasing_id())
    texts = {"own": F.col("text"), "other": F.col("edited"), "next": F.col("next_text")}
    found = _fingerprints(rows, texts, ["_row", "doc_id", "n_chars", "s0", "s1", "s2", "s3"])
    sha = F.lower(F.concat(*(F.lpad(F.hex(F.col(f"s{i}")), 16, "0") for i in range(4))))
    return found.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), _as_text("own").alias("fingerprint"), _as_text("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def within_radius(found: DataFrame, radius: int = 3, extra: int = 3) -> DataFrame:
    """Pairs (a, b, distance), a < b, of different fingerprints with at most `radius` unequal bits.

    found has a column fingerprint; documents are its members, so copies are not paired.
    The bits are cut into radius + extra blocks; two fingerprints within the radius agree in
    at least `extra` of them, so one table for each choice of `extra` blocks finds every pair.
    """
    blocks = radius + extra
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in chosen) for chosen in combinations(list(zip(edges, edges[1:])), extra)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    bits = F.conv("fingerprint", 16, -10).cast("long")
    one = found.filter(F.col("fingerprint").isNotNull()).select("fingerprint").distinct().withColumn("bits", bits)
    tables = F.array(*(F.struct(F.lit(i).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)))
    keyed = one.select("bits", F.explode(tables).alias("key"))
    left, right = keyed.select(F.col("bits").alias("a"), "key"), keyed.select(F.col("bits").alias("b"), F.col("key").alias("same"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (F.col("key") == F.col("same")) & (F.col("a") < F.col("b")) & (distance <= radius)
    pairs = left.join(right, near).select("a", "b", distance.alias("distance")).distinct()
    text = lambda c: F.lower(F.lpad(F.hex(c), BITS // 4, "0"))
    return pairs.select(F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "distance")
