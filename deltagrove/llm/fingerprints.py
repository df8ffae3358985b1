"""Canonical exact digests of documents, with DataFrame and SQL functions only.

The canonical form is NFKC, case-folded, NFKC again, with runs of white space as one blank and none at the ends. The
fingerprint is 128 bits of xxhash over it; documents with equal hashes are compared byte by byte, and an ordinal sets apart
different texts that share a hash. Equal canonical texts have likeness 1, others 0.

A null text counts as empty. Repeated ids are ordered by text. Null ids come first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_ICU_NORMALIZER, _ICU_CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit(_ICU_NORMALIZER), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.reflect(F.lit(_ICU_CHARACTER), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    h = lambda *salt: F.lower(F.lpad(F.hex(F.xxhash64(*salt, canon)), 16, "0"))
    return F.concat(h(), h(F.lit("second"), F.lit(0)))


def shared_buckets(docs: DataFrame) -> DataFrame:
    """Compares bytes inside buckets of equal hash: fp, canon and ordinal for each bucket that holds different texts (none,
    short of a collision of 128 bits). Copies are folded before the shuffle, so each task sends a text once."""
    texts = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("fp", wide_hash(F.col("canon"))).distinct()
    many = texts.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    if many.isEmpty():
        return docs.sparkSession.createDataFrame([], "fp string, canon string, ordinal long")
    odd = written(texts.join(many, "fp"))
    return odd.withColumn("ordinal", F.row_number().over(Window.partitionBy("fp").orderBy("canon")).cast("long") - 1)


def settle(df: DataFrame, canon: str, fp: str, odd: DataFrame) -> DataFrame:
    """Adds the ordinal of the text within its bucket to the hashes that different texts share."""
    keys = odd.select(F.col("fp").alias(fp), F.col("canon").alias(canon), F.col("ordinal").alias("_n"))
    return df.join(keys, [fp, canon], "left").withColumn(fp, F.concat_ws("-", fp, F.when(F.col("_n") > 0, F.col("_n").cast("string")))).drop("_n")


def fingerprint(docs: DataFrame) -> DataFrame:
    """The rows of docs (as row) with their fingerprint, checked byte by byte inside equal buckets."""
    odd = shared_buckets(docs)
    out = docs.select(F.struct("*").alias("row"), canonical(F.coalesce("text", F.lit(""))).alias("_canon")).withColumn("fingerprint", wide_hash(F.col("_canon")))
    return (out if odd.isEmpty() else settle(out, "_canon", "fingerprint", odd)).select("row", "fingerprint")


_BITS = 6


def _successors(keys: DataFrame, name: str, span: int) -> DataFrame:
    """Each distinct key with the next larger one (the last: null). Keys of a group of 2^10 neighbours are ordered in one
    window; only the groups' first keys meet on the level above, so no task sorts them all."""
    level = keys.select(F.col(name).alias("k")).distinct()
    if span < 1 << 10:
        w = Window.partitionBy("_g").orderBy("k")
        return level.withColumn("_g", F.lit(0)).select(F.col("k").alias(name), F.lead("k").over(w).alias("next"))
    level = level.withColumn("_g", F.shiftright("k", 10))
    inner = level.withColumn("next", F.lead("k").over(Window.partitionBy("_g").orderBy("k")))
    first = level.groupBy("_g").agg(F.min("k").alias("_first"))
    up = _successors(first, "_g", span >> 10).withColumnRenamed("next", "_ng")
    jump = up.join(first.select(F.col("_g").alias("_ng"), "_first"), "_ng", "left").select("_g", "_first")
    return inner.join(jump, "_g", "left").select(F.col("k").alias(name), F.coalesce("next", "_first").alias("next"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by (doc_id, text); after the last row comes the first.

    Rows of 2^6 neighbouring ids share a window. Each group's last row gets the first text of the next group that has rows,
    found over group numbers alone. The texts are dealt out once; the three uses share that exchange."""
    key = F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), _BITS)
    base = docs.select(key.alias("_g"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("_g")
    groups = written(docs.select(key.alias("_g")).distinct())
    lo, hi = groups.agg(F.min("_g"), F.max("_g")).first()
    if lo is None:
        return base.select("doc_id", "text", F.lit("").alias("next_text"))
    shifted = groups.select((F.col("_g") - lo).alias("_g"))
    follows = _successors(shifted, "_g", hi - lo).select((F.col("_g") + lo).alias("_g"), F.coalesce(F.col("next") + lo, F.lit(lo)).alias("_ng"))
    w = Window.partitionBy("_g").orderBy("doc_id", "text")
    rows = base.withColumn("next_text", F.lead("text").over(w))
    first = base.groupBy("_g").agg(F.min_by("text", F.struct("doc_id", "text")).alias("next_text")).withColumnRenamed("_g", "_ng")
    last = rows.where("next_text is null").select("_g", "doc_id", "text").join(follows, "_g").join(first, "_ng")
    return rows.where("next_text is not null").select("doc_id", "text", "next_text").unionByName(last.select("doc_id", "text", "next_text"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (its second half replaced by the next text's start), and the
    likeness of both, and of the next document's."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = with_next_text(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(canonical(F.col(c)).alias(f"_{c}") for c in ("text", "edited", "next_text")))
    names = {"_text": "fingerprint", "_edited": "edited_fingerprint", "_next_text": "_next_fingerprint"}
    d = d.select("doc_id", "n_chars", "edited_sha256", *names, *(wide_hash(F.col(c)).alias(f) for c, f in names.items()))
    odd = shared_buckets(docs)
    if not odd.isEmpty():
        for c, f in names.items():
            d = settle(d, c, f, odd)
    like = lambda f: (F.col("fingerprint") == F.col(f)).cast("double")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("_next_fingerprint").alias("near_next"))
