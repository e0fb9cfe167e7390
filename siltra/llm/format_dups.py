"""Records that differ by formatting only: a stored, bucketed ledger of canonical keys.

The ledger is two tables in the shared folder, both cut into buckets by key: *counts* (one row a canonical key: copies
and earliest representative) and *links* (the two keys of records that have both). A batch is aggregated by key and
full-outer-joined against the buckets it meets; only those are read, and they are written anew as files of the next
version. A manifest names the version of each bucket and is written last, so that a batch counts wholly or not at all.
Groups are read off the ledger: the connected parts of the links. Counts and links are sums and unions, so it makes no
difference how the records were dealt to batches.

Hot keys never meet in one task: they are combined before the shuffle, and in the join back to the records the keys
that hold more than a ``1 / HOT_PARTS`` part of all copies (at most ``HOT_PARTS`` of them) are broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.llm.common import materialize, shared_dir

#: Keys a bucket should hold when a ledger begins, and the least number of buckets; a bucket is read and written by one task.
BUCKET_KEYS, BUCKETS = 1_000_000, 8
HOT_PARTS = 1000

_LETTERS = r"[^\p{L}\p{N}]+"
_PART = r"[\n\r|;]+"
_FIELD = r"^[^:=]*[\p{L}\p{N}][^:=]*[:=](?s:.)*[\p{L}\p{N}](?s:.)*$"
_SHAPES = {"counts": "ck binary, copies long, keep_no long, bucket int", "links": "k1 binary, k2 binary, bucket int"}


def _canon(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.upper(c), _LETTERS, ""))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def canonical_keys(text: Column) -> tuple[Column, Column]:
    """(k1, k2) of a text: the digest of its letters and digits in order, and, for a record made only of named
    fields (two or more, else k1 says the same), the digest of its fields in name order; else null."""
    k1 = _digest(_canon(text))
    parts = F.filter(F.split(text, _PART), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    cut = lambda p: F.regexp_instr(p, F.lit("[:=]"))
    field = lambda p: F.struct(
        _canon(F.substring(p, F.lit(1), cut(p) - 1)).alias("n"), _canon(F.substring(p, cut(p) + 1, F.length(p))).alias("v")
    )
    fields = F.array_sort(F.transform(parts, field))
    spelled = F.array_join(F.transform(fields, lambda f: F.concat(f["n"], F.lit("\u0001"), f["v"])), "\u0002")
    k2 = F.when(text.rlike("[:=]") & (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(_FIELD)), _digest(spelled))
    return k1, k2


def keyed(df: DataFrame, key: str = "chunk_no", text: str = "text") -> DataFrame:
    """(key, k1, k2) of each record. A null text equals nothing and is left out; texts without letter or digit are alike."""
    t = F.col(text)
    k1, k2 = canonical_keys(t)
    return df.where(t.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), k1.alias("k1"), k2.alias("k2"))


class Ledger:
    """A stored ledger. ``Ledger(spark, folder)`` opens the one in ``folder`` or begins one there.

    ``buckets`` is fixed when a ledger begins: if not given, by the number of records of its first batch, which should
    then be no less than a tenth of what is to come.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets, self.version = spark, folder.rstrip("/"), buckets, 0
        self.at: dict[str, dict[int, int]] = {"counts": {}, "links": {}}
        try:
            rows = spark.read.schema("name string, bucket int, at int, version int, buckets int").json(f"{self.folder}/manifest/*").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return
        self.version = max(r.version for r in rows)
        for r in rows:  # at most 2 rows a bucket and version
            if r.version == self.version:
                self.buckets = r.buckets
                if r.bucket >= 0:
                    self.at[r.name][r.bucket] = r.at

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The rows of a table, of the buckets in ``only`` alone where that is given."""
        paths = [f"{self.folder}/{name}/v={v}/bucket={b}" for b, v in sorted(self.at[name].items()) if only is None or b in only]
        shape = _SHAPES[name]
        return self.spark.read.schema(shape).option("basePath", f"{self.folder}/{name}").parquet(*paths).drop("v") if paths else self.spark.createDataFrame([], shape)

    def _bucket(self, c: str) -> Column:
        # the place that repartition(buckets, c) gives a row: each task then writes one bucket
        return F.pmod(F.hash(c), F.lit(self.buckets)).cast("int")

    def _store(self, name: str, df: DataFrame, key: str) -> None:
        df.withColumn("bucket", self._bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/v={self.version + 1}")

    def take(self, keys: DataFrame) -> None:
        """One more batch of ``keyed`` records."""
        self.buckets = self.buckets or max(BUCKETS, -(-keys.count() // BUCKET_KEYS))
        new = keys.groupBy(F.coalesce("k2", "k1").alias("ck")).agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("keep_no"))
        new = materialize(new.withColumn("bucket", self._bucket("ck")), "batch")
        pairs = materialize(keys.where("k2 is not null").select("k1", "k2").distinct().withColumn("bucket", self._bucket("k1")), "batch-links")
        met = {"counts": self._met(new), "links": self._met(pairs)}
        old = self.read("counts", met["counts"])
        a, b = old.repartition(self.buckets, "ck").alias("a"), new.repartition(self.buckets, "ck").alias("b")
        merged = a.join(b, F.col("a.ck") == F.col("b.ck"), "full_outer").select(
            F.coalesce("a.ck", "b.ck").alias("ck"),
            (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
            F.least("a.keep_no", "b.keep_no").alias("keep_no"),
        )
        self._store("counts", merged, "ck")
        both = self.read("links", met["links"]).unionByName(pairs).select("k1", "k2")
        self._store("links", both.repartition(self.buckets, "k1").distinct(), "k1")
        self.version += 1
        for name in self.at:
            self.at[name] |= dict.fromkeys(met[name], self.version)
        rows = [(name, b, v, self.version, self.buckets) for name, at in self.at.items() for b, v in at.items()] or [("counts", -1, 0, self.version, self.buckets)]
        self.spark.createDataFrame(rows, "name string, bucket int, at int, version int, buckets int").coalesce(1).write.json(f"{self.folder}/manifest/{self.version}")

    @staticmethod
    def _met(batch: DataFrame) -> set[int]:
        return {r.bucket for r in batch.select("bucket").distinct().collect()}  # at most one row a bucket

    def named(self) -> DataFrame:
        """(ck, grp, copies, keep_no) of every canonical key; one grp for all keys that are linked."""
        labels = _labels(self.read("links").select("k1", "k2"))
        return self.read("counts").join(labels, F.col("ck") == F.col("name"), "left").select("ck", F.coalesce("lab", "ck").alias("grp"), "copies", "keep_no")


def _labels(links: DataFrame) -> DataFrame:
    """(name, lab): the least k2 of the connected part of each key that isn't its own label; ``links`` are distinct."""
    labels = links.groupBy(F.col("k1").alias("name")).agg(F.min("k2").alias("lab"), F.count(F.lit(1)).alias("n"))
    # where no text is read as fields in two ways a k1 has one k2, and every k2 is its own label
    return labels.select("name", "lab") if labels.where("n > 1").isEmpty() else _spread(links)


def _spread(pairs: DataFrame) -> DataFrame:
    """Least label of each connected part of the (k1, k2) graph; one aggregation a step, ends when none changes."""
    lab2 = pairs.select("k2").distinct().withColumn("lab", F.col("k2"))
    while True:
        lab1 = pairs.join(lab2, "k2").groupBy("k1").agg(F.min("lab").alias("lab"))
        new2 = materialize(pairs.join(lab1, "k1").groupBy("k2").agg(F.min("lab").alias("lab")), "labels")
        done = new2.alias("a").join(lab2.alias("b"), "k2").where("a.lab <> b.lab").isEmpty()
        lab2 = new2
        if done:
            lab1 = pairs.join(lab2, "k2").groupBy(F.col("k1").alias("name")).agg(F.min("lab").alias("lab"))
            return lab1.unionByName(lab2.where("k2 <> lab").withColumnRenamed("k2", "name"))


def distinct_records(named: DataFrame) -> DataFrame:
    """(grp, copies, keep_no): one row a group of alike records."""
    return named.groupBy("grp").agg(F.sum("copies").alias("copies"), F.min("keep_no").alias("keep_no"))


def repeats(keys: DataFrame, named: DataFrame) -> DataFrame:
    """(keep_no, key) of each of the ``keyed`` records that repeats another of the ledger."""
    kept = distinct_records(named).where("copies > 1").select("grp", F.col("keep_no").alias("kept"))
    lead = named.join(kept, "grp").select(F.col("ck").alias("_ck"), F.col("kept").alias("keep_no"), "copies")
    lead = materialize(lead, "repeated")
    often = max(int(named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]) // HOT_PARTS, 1000)
    rows = keys.select("key", F.coalesce("k2", "k1").alias("ck"))
    hot = F.broadcast(lead.where(F.col("copies") > often))  # at most HOT_PARTS keys have so many copies
    warm = rows.join(hot, F.col("ck") == F.col("_ck")).select("keep_no", "key")
    cold = rows.join(F.broadcast(hot.select("_ck")), F.col("ck") == F.col("_ck"), "left_anti").join(
        lead.where(F.col("copies") <= often), F.col("ck") == F.col("_ck")
    )
    return cold.select("keep_no", "key").unionByName(warm).where("key > keep_no")


def format_duplicates(
    df: DataFrame, key: str = "chunk_no", text: str = "text", batches: int = 2, folder: str | None = None, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, members): one row (keep_no, copies) a distinct record, and (keep_no, key) for each row that repeats one.

    Alike are texts with the same letters and digits in the same order whatever their case, white space and
    punctuation, and records of named fields in any field order. Null texts are no records; an empty table gives none.
    The rows come to the ledger in ``folder`` (a new one in the shared folder where none is given) as ``batches``
    batches, one after the other, each merged with what was stored before; a folder's earlier records count too.
    """
    spark = df.sparkSession
    keys = materialize(keyed(df, key, text), "keys")
    ledger = Ledger(spark, folder or f"{shared_dir(spark)}/siltra/ledger-{uuid.uuid4().hex}", buckets)
    for i in range(batches):
        ledger.take(keys.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i))
    named = materialize(ledger.named(), "named")
    return distinct_records(named).select("keep_no", "copies"), repeats(keys, named).select("keep_no", F.col("key").alias(key))
