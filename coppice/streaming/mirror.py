"""A mirror of a keyed table that follows a stream of deltas, stored by hash buckets under a tree of digests."""

from __future__ import annotations

import hashlib
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.digests import PARTS, digest_of, row_text, summed_parts
from coppice.plans.staging import stage

SUMS = ["n", *[f"s{i}" for i in range(PARTS)]]
SUMS_DDL = "n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(PARTS))
INDEX_DDL = f"bucket long, place string, {SUMS_DDL}"
#: Children of a node of the digest tree.
FANOUT = 16


class Mirror:
    """STR-7, STR-16: generations of (key, values) in a folder.

    The table lies in buckets by the hash of the key. A change writes the buckets that it touches
    anew, to a place of its own; an index says where the newest of each bucket lies and what
    its rows sum up to; a log row, written last, makes the change count. So a run that breaks off
    leaves the generation before it whole, a refused change leaves nothing that is read, and a
    new object on the same folder goes on from there. A frame reads and writes the buckets
    of its keys and no others.

    Sums of buckets add up to sums of nodes of FANOUT children, up to a root whose digest is
    that of the table. Two mirrors find the buckets in which they differ from the root down.

    Frames (frame, base, base_digest, target_digest; rows pos, op, key, values, and if wanted
    granted and seen) are merged whole or refused whole, with a reason:
    ahead (the mirror is past the base), gap (it is not there yet), digest-mismatch (it differs
    from the base, or the result from the target), scope (a row that is not granted), stale (a
    row that has seen another clock of its key). A frame merged before is left alone.
    """

    COMPACT = 8

    def __init__(self, spark: SparkSession, path: str, key: str, values: list[str], buckets: int = 256):
        self.spark, self.path, self.key, self.values, self.buckets = spark, path, key, values, buckets

    # --- what is stored -----------------------------------------------------------------------

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("bucket")

    def head(self, frame: int | None = None) -> dict | None:
        """The newest log row: number, base, generation, frame, event, digest, n, s0 to s3, and whether the given frame has been merged; None before the first hydration."""
        if not self._there("log"):
            return None
        log = self.spark.read.schema(f"base long, generation long, frame long, event string, {SUMS_DDL}, number long").parquet(f"{self.path}/log")
        row = log.agg(F.max_by(F.struct("*"), "number").alias("h"), F.bool_or(F.col("frame") == F.lit(frame)).alias("done")).first()
        return row["h"].asDict() | {"digest": self._digest([row["h"][c] for c in SUMS]), "done": bool(row["done"])}

    def index(self, head: dict | None = None) -> DataFrame:
        """bucket, place and sums of the newest version of each bucket (at most one row a bucket)."""
        head = head or self.head()
        entries = self.spark.read.schema(f"{INDEX_DDL}, number long").parquet(f"{self.path}/index").filter(F.col("number").between(head["base"], head["number"]))
        return entries.groupBy("bucket").agg(F.max_by(F.struct("place", *SUMS), "number").alias("e")).select("bucket", "e.*")

    def _read(self, entries: list) -> DataFrame:
        """Rows of buckets at their places."""
        schema = self._empty().schema
        paths = [f"{self.path}/parts/{e['place']}/bucket={e['bucket']}" for e in entries if self._there(f"parts/{e['place']}/bucket={e['bucket']}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self._empty()

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self._kinds())

    def _kinds(self):
        return self.spark.read.parquet(f"{self.path}/kinds").schema

    def rows(self, clocks: bool = False) -> DataFrame:
        """The table of the newest generation, with the clock of each key if wanted (how many generations have touched it; deleted keys stay as rows then)."""
        out = self._read(self.index().collect())  # a row a bucket
        return out if clocks else out.filter("op <> 'delete'").select(self.key, *self.values)

    def events(self) -> DataFrame:
        """number, generation, frame, event of what has happened: hydrate and attest, in order."""
        return self.spark.read.parquet(f"{self.path}/log").select("number", "generation", "frame", "event")

    def refusals(self) -> DataFrame:
        if not self._there("refused"):
            return self.spark.createDataFrame([], "frame long, reason string, batch long")
        return self.spark.read.parquet(f"{self.path}/refused").select("frame", "reason", F.col("batch").cast("long").alias("batch"))

    # --- the tree of digests --------------------------------------------------------------------

    def depth(self) -> int:
        """Levels below the root."""
        levels, width = 0, 1
        while width < self.buckets:
            levels, width = levels + 1, width * FANOUT
        return levels

    def nodes(self, level: int, under: list[int] | None = None) -> DataFrame:
        """node, digest of a level (0: the root; depth: the buckets); only those under the given nodes of the level above."""
        span = FANOUT ** (self.depth() - level)
        entries = self.index().withColumn("node", F.floor(F.col("bucket") / span))
        if under is not None:
            entries = entries.filter(F.floor(F.col("node") / FANOUT).isin(under))
        return entries.groupBy("node").agg(*[F.sum(c).alias(c) for c in SUMS]).select("node", digest_of(*[F.col(c) for c in SUMS]).alias("digest"))

    def differing(self, other: Mirror) -> list[int]:
        """Buckets in which two mirrors of as many buckets differ, found from the root down: only children of nodes that differ are compared."""
        if self.buckets != other.buckets:
            raise ValueError("mirrors of different widths")
        found: list[int] | None = None
        for level in range(self.depth() + 1):
            a, b = self.nodes(level, found), other.nodes(level, found).withColumnRenamed("digest", "its")
            found = [r["node"] for r in a.join(b, "node", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("its"))).select("node").collect()]  # nodes of one level that differ
            if not found:
                return []
        return sorted(found)

    # --- what happens -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, touched: list[int]) -> list[tuple]:
        """Writes rows (key, op, clock, values) by bucket to a new place; gives the index entries of the touched buckets, also of those that have no row left."""
        place = uuid.uuid4().hex
        mine = rows.select(self.key, "op", "clock", *self.values)
        mine.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/parts/{place}")
        there = self.spark.read.schema(mine.withColumn("bucket", F.lit(0).cast("long")).schema).parquet(f"{self.path}/parts/{place}")
        # deleted rows stay in the bucket for their clock, and are left out of the sums
        sums = there.filter("op <> 'delete'").groupBy("bucket").agg(*summed_parts(row_text(self.key, *self.values))).collect()  # a row a bucket
        found = {r["bucket"]: tuple(r[c] for c in SUMS) for r in sums}
        return [(b, place, *found.get(b, (0,) * len(SUMS))) for b in touched]

    def _commit(self, number: int, base: int, generation: int, frame: int, event: str, entries: list[tuple], sums: list) -> None:
        exact = [(b, place, n, *map(Decimal, s)) for b, place, n, *s in entries]
        self.spark.createDataFrame(exact, INDEX_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/number={number}")
        row = self.spark.createDataFrame([(base, generation, frame, event, sums[0], *map(Decimal, sums[1:]))], f"base long, generation long, frame long, event string, {SUMS_DDL}")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/number={number}")

    def _digest(self, sums: list) -> str:
        """As digest_of makes it."""
        return hashlib.sha256(":".join(str(int(x)) for x in sums).encode()).hexdigest()

    def hydrate(self, table: DataFrame, digest: str | None = None, generation: int = 0) -> str:
        """Replaces the mirror by a whole table. Refused if that does not have the digest: then what was there before stays as it was."""
        have = self.head()
        rows = table.select(self.key, F.lit("upsert").alias("op"), F.lit(0).cast("long").alias("clock"), *self.values)
        if have is None:
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/kinds")
        entries = self._write(rows, list(range(self.buckets)))
        sums = [sum(e[2 + i] for e in entries) for i in range(len(SUMS))]
        if digest is not None and self._digest(sums) != digest:
            return "digest-mismatch"
        number = have["number"] + 1 if have else 0
        self._commit(number, number, generation, -1, "hydrate", entries, sums)
        return "attest"

    def sync(self, frame: dict, rows: DataFrame) -> str:
        """Merges one frame's rows, or says why not."""
        have = self.head(frame["frame"])
        if have is None:
            return "gap"
        if have["done"]:
            return "done"
        if have["generation"] != frame["base"]:
            return "ahead" if have["generation"] > frame["base"] else "gap"
        if have["digest"] != frame["base_digest"]:
            return "digest-mismatch"
        granted = F.bool_and("granted") if "granted" in rows.columns else F.lit(True)
        seen = F.max("seen") if "seen" in rows.columns else F.lit(None).cast("long")
        last = stage(rows.groupBy(self.key).agg(F.max_by(F.struct("op", *self.values), "pos").alias("c"), granted.alias("granted"), seen.alias("seen")).withColumn("bucket", self._bucket()))
        about = last.agg(F.bool_and("granted").alias("granted"), F.count("seen").alias("seen"), F.array_sort(F.collect_set("bucket")).alias("touched")).first()  # buckets at most
        if about["granted"] is False:
            return "scope"
        entries = self.index(have).filter(F.col("bucket").isin(about["touched"])).collect()
        held = self._read(entries).withColumnsRenamed({c: f"was_{c}" for c in ["op", "clock", *self.values]})
        merged = held.join(last, self.key, "full_outer")
        if about["seen"] and not merged.filter("seen is not null and seen <> coalesce(was_clock, 0)").isEmpty():
            return "stale"
        pick = lambda new, old: F.when(F.col("c").isNotNull(), new).otherwise(F.col(old))
        clock = pick(F.coalesce("was_clock", F.lit(0).cast("long")) + 1, "was_clock")
        new = self._write(merged.select(self.key, pick(F.col("c.op"), "was_op").alias("op"), clock.alias("clock"), *[pick(F.col(f"c.{v}"), f"was_{v}").alias(v) for v in self.values]), about["touched"])
        sums = [have[c] - sum(e[c] for e in entries) + sum(e[2 + i] for e in new) for i, c in enumerate(SUMS)]
        if self._digest(sums) != frame["target_digest"]:
            return "digest-mismatch"  # what was written is in no index
        number, base = have["number"] + 1, have["base"]
        if (number - base) % self.COMPACT == 0:  # a whole index now and then, so that few are read
            new += [tuple(e) for e in self.index(have).filter(~F.col("bucket").isin(about["touched"])).collect()]
            base = number
        self._commit(number, base, have["generation"] + 1, frame["frame"], "attest", new, sums)
        return "attest"

    def merge(self, batch: DataFrame, number: int) -> None:
        """A micro-batch's frames in order; what is refused goes to a side table. For foreachBatch: a repeated batch does no harm."""
        batch = stage(batch)
        frames = batch.select("frame", "base", "base_digest", "target_digest").distinct().orderBy("frame").toLocalIterator()  # a row a frame, fetched part by part
        refused = []
        for f in frames:
            outcome = self.sync(f.asDict(), batch.filter(F.col("frame") == f["frame"]))
            if outcome not in ("attest", "done"):
                refused.append((f["frame"], outcome))
        if refused:
            self.spark.createDataFrame(refused, "frame long, reason string").write.mode("overwrite").parquet(f"{self.path}/refused/batch={number}")
