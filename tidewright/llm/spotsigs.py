"""Operator 10: SpotSigs fingerprints, with DataFrame functions only.

Words that are not in COMMON are content words. Where common words precede a content word, the last of them and the next CHAIN content words
(fewer at the end) make a spot signature; a text's fingerprint is the sorted set of the signatures' 64-bit hashes. A text without such
a place takes every content word as the beginning of a chain, and one without content words the hash of the whole text, so that equal texts
always have equal fingerprints; the empty text has the empty set. Likeness is the Jaccard index, 1 for two empty sets.

Null text counts as empty; null ids come last in the order; rows that share an id are ordered by a hash of the text; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CHAIN = 3
# Frequent function words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nach nicht noch sich sie sind so und von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con cuando del e el ella era ese esta este fue ha hay la las lo los más me mi muy no o para pero por porque si sin sobre su sus también te tu una uno y ya"
).split()


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds `out`, the sorted distinct signatures of a text column (array<bigint>)."""
    w, p = f"__w_{out}", f"__p_{out}"
    df = df.withColumn(w, F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"))
    common = sorted(set(COMMON))
    df = df.withColumn(p, F.filter(F.transform(F.col(w), lambda x, i: F.when(~x.isin("", *common), i)), lambda x: x.isNotNull()))
    word = lambda i: F.get(F.col(w), i)

    def chain(k: Column) -> list[Column]:
        return [word(F.get(F.col(p), k + j)) for j in range(CHAIN)]

    def spot(at: Column, k: Column) -> Column:
        before = F.coalesce(F.get(F.col(p), k - 1), F.lit(-1))
        return F.when((at - before > 1) & (word(at - 1) != ""), F.xxhash64(word(at - 1), *chain(k)))

    spots = F.filter(F.transform(F.col(p), spot), lambda x: x.isNotNull())
    df = df.withColumn(out, spots)
    every = F.transform(F.col(p), lambda at, k: F.xxhash64(F.lit(""), *chain(k)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    df = df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).when(F.size(p) > 0, every).otherwise(whole))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.col(out)))).drop(w, p)


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def _bucket(bounds: list[int], value: Column) -> Column:
    """The last bound that is not above the value, as a balanced tree of comparisons; null goes last."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(value < F.lit(bounds[mid]).cast("long"), tree(low, mid - 1)).otherwise(tree(mid, high))

    return tree(0, len(bounds) - 1)


def with_next(docs: DataFrame, parts: int) -> DataFrame | None:
    """(doc_id, text, next_text, fingerprint, next_fingerprint): each row with the next in ascending id order, after the last the first.

    Rows are dealt to ranges whose bounds are ids of the table; the first rows of each range also go, as guests, to the range before it,
    and those of the first range to the last one. So no task orders the whole table. None for an empty table.
    """
    wanted = [k / parts for k in range(parts)]
    least, found, rows = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", wanted, 10000), F.count("*")).first()
    if not rows:
        return None
    bounds = sorted({least, *found}) if least is not None else [0]
    last = len(bounds) - 1
    own = _bucket(bounds, F.col("doc_id"))
    firsts = F.col("doc_id").isin(*bounds) if least is not None else F.lit(True)
    guests = F.when(firsts, F.array(F.lit(-1), F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1))).otherwise(F.array(F.lit(-1)))
    dealt = docs.withColumn("own", own).withColumn("guest", F.explode(guests)).withColumn("range", F.when(F.col("guest") < 0, F.col("own")).otherwise(F.col("guest")))
    dealt = dealt.select("range", (F.col("guest") >= 0).alias("guest"), "doc_id", "text").repartition("range")
    dealt = with_signatures(dealt, "text", "fingerprint")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return dealt.select("guest", "doc_id", "text", "fingerprint", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("not guest").drop("guest")


def spotsigs_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(docs, max(1, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if rows is None:
        return df.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint array<bigint>, edited_fingerprint array<bigint>, near_edited double, near_next double")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("near_next", jaccard("fingerprint", "next_fingerprint")).drop("text", "next_text", "next_fingerprint")
    rows = with_signatures(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", jaccard("fingerprint", "edited_fingerprint").alias("near_edited"), "near_next")


def spotsigs_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near duplicates at a Jaccard index of `threshold` or more: (class_a, class_b, likeness, key_a, key_b) between classes of equal fingerprints, and
    membership (doc_id, class_id, key).

    A class is known by its key, 96 bits of hashes of its set; class_id is its smallest id, null where all its ids are null. Texts that share an id
    are in classes of their own. Sets are partitioned by length: a set of n signatures can only match sets of n*t to n/t, so lengths are cut
    into bands of ratio t and a set meets its own band and the one above. Within a band only the rarest signatures, n - ceil(t*n) + 1 of them, are
    indexed: two matching sets share one of these. Pairs that meet are compared in full once. Empty sets form one class without pairs.
    """
    docs = with_signatures(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sigs")
    key = F.concat(F.lpad(F.hex(F.xxhash64("sigs")), 16, "0"), F.lpad(F.hex(F.hash("sigs")), 8, "0"))
    docs = materialise(docs.select("doc_id", "sigs", key.alias("key")), "spots")
    classes = materialise(docs.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "spot-classes")
    members = docs.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id", "key")
    spots = classes.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = materialise(spots.groupBy("sig").agg(F.count("*").alias("df")), "spot-counts")
    order = F.row_number().over(Window.partitionBy("key").orderBy("df", "sig"))
    rare = spots.join(counts, "sig").withColumn("rank", order).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold))).cast("int")
    rare = materialise(rare.where("df > 1").select("key", "n", "sig", band.alias("band")), "spot-index")
    up = rare.select(F.col("key").alias("key_a"), F.col("n").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    down = rare.select(F.col("key").alias("key_b"), F.col("n").alias("nb"), "sig", "band")
    ordered = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("key_a") < F.col("key_b"))
    met = up.join(down, ["sig", "band"]).where(ordered & (F.col("na") >= F.lit(threshold) * F.col("nb"))).select("key_a", "key_b").distinct()
    side = lambda x: classes.select(F.col("key").alias(f"key_{x}"), F.col("class_id").alias(f"class_{x}"), F.col("sigs").alias(f"s{x}"))
    pairs = met.join(side("a"), "key_a").join(side("b"), "key_b").withColumn("likeness", jaccard("sa", "sb")).where(F.col("likeness") >= threshold)
    return pairs.select("class_a", "class_b", "likeness", "key_a", "key_b"), members
