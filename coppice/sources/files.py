"""Reading and writing trees, logs, snapshots and manifests as files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.columns import redacted
from coppice.operators.edits import render
from coppice.operators.versions import content_digest, diff
from coppice.plans.digests import row_text, row_text_sql, summed_digest, summed_digest_sql
from coppice.plans.staging import folder, ship_package, stage
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, LOG_SQL, NODES_SQL, edges, log, nodes, read, segments, with_sql

REG = Registry()

#: Records of a metrics log; `kind` tells which fields are set.
METRICS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("session", T.LongType()), T.StructField("wall", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("note", T.StringType()),
])
KINDS = ("click", "error", "purchase", "signup", "view")


def scan_tree(spark: SparkSession, path: str, glob: str = "*.txt", excluded: str | None = None) -> DataFrame:
    """SRC-1: path, text of every file below, by name pattern, without excluded directory names."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.filter(~F.col("path").rlike(f"/({excluded})/")) if excluded else found


def load_unique(df: DataFrame, path: str, key: str, partition_by: str | None = None) -> DataFrame:
    """SRC-2, SRC-3: writes df, refused if a key comes twice."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][0]}")
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_metrics(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """SRC-5: any malformed line or unknown kind is an error; blank lines are skipped."""
    rows = spark.read.schema(METRICS).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("null")))))
    return rows.withColumn("kind", known)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = METRICS) -> DataFrame:
    """SRC-6: the rows of logs of JSON lines, and one with truncated = true (and no values) for a log that ends in a cut line.

    Every file is a log. Only its last line may be cut, which shows by the file not ending in a
    newline; that line is reported, not read, even where it would parse. Any other line that
    does not parse is an error; blank lines are skipped. Whether a file ends in a newline follows
    from its size: its lines, with a newline each, have one byte more than it if not. So files
    are read in splits, and nothing but sums and last lines is gathered by file.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at.alias("at"))
    ends = lines.groupBy("file").agg(F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"), F.max("size").alias("size"), F.max("at").alias("at"))
    cut = ends.filter("bytes > size").select("file", "at", F.lit(True).alias("truncated"))
    marked = lines.join(cut, ["file", "at"], "left").filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    whole = F.from_json(F.when(~F.col("truncated"), F.col("value")), schema, {"mode": "FAILFAST"})
    return marked.select(whole.alias("r"), "truncated").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], "truncated")


def redacted_all(value: Column, kind: T.DataType) -> Column:
    """value with every string in it redacted, in structs, arrays and values of maps too; keys and names stay."""
    if isinstance(kind, T.StringType):
        return redacted(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted_all(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redacted_all(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redacted_all(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def write_contract(df: DataFrame, path: str, schema: T.StructType = METRICS, stamp: str | None = None, mode: str = "append") -> None:
    """SRC-7, SRC-8: columns checked against a closed schema, strings redacted at any depth, a time put on if named."""
    names = [f.name for f in schema.fields]
    extra = [c for c in df.columns if c not in names]
    if extra:
        raise ValueError(f"fields outside the contract: {extra}")
    value = lambda f: redacted_all(F.col(f.name), df.schema[f.name].dataType) if f.name in df.columns else F.lit(None)
    out = df.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields])
    (out.withColumn(stamp, F.current_timestamp()) if stamp else out).write.mode(mode).json(path)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-9: path, bytes, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_snapshot(df: DataFrame, path: str, generation: int, order: list[str], head: int | None = None, digest: str | None = None) -> None:
    """SRC-12, SRC-16: a generation as sorted parquet; writing one twice is an error.

    Refused when the generation is ahead of the log's head, or when the rows' digest is not the
    one given; then nothing is written.
    """
    if head is not None and generation > head:
        raise ValueError(f"generation {generation} is ahead of the log, which ends at {head}")
    if digest is not None and content_digest(df, df.columns).first()["digest"] != digest:
        raise ValueError(f"generation {generation} differs from its digest")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/generation={generation}")


#: Folders that rendered files are dealt over.
SHELVES = 256


def write_texts(texts: DataFrame, path: str) -> int:
    """SRC-17: path/shelf=../module=<module>.txt for each row (module, text), with a newline after the text; returns how many.

    Tasks write the files through Arrow's file systems: Spark's writer makes and renames folders
    for each value of a partition column. A file is moved to its name when it is whole, so a
    task that is run again changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), made = _store(path), set()
        for batch in batches:
            for shelf, module, text in zip(*batch.columns, strict=True):
                folder_ = f"{root}/shelf={shelf}"
                if folder_ not in made:
                    store.create_dir(folder_)
                    made.add(folder_)
                own = f"{folder_}/{uuid.uuid4().hex}.part"
                with store.open_output_stream(own) as out:
                    out.write((text.as_py() or "").encode() + b"\n")
                store.move(own, f"{folder_}/module={'' if module.as_py() is None else module}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ship_package(texts.sparkSession)
    shelf = F.pmod(F.xxhash64("module"), F.lit(SHELVES)).alias("shelf")
    return texts.select(shelf, "module", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0  # one number


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it."""
    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)


#: Tasks that read shelves, bytes read at a time, and files of a batch.
SHELF_TASKS, CHUNK, BATCH_FILES = 64, 1 << 20, 5000


def shelved_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9, SRC-17: module (null, if the file's name has none), sha256 and bytes of every file of write_texts.

    Tasks list the shelves and read the files: Spark's reader holds the names of all files in
    the driver, and they are as many as there are modules. A task holds the names of one shelf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)

        def read(name: str) -> tuple[str, int]:
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(name) as found:
                while chunk := found.read(CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            return digest.hexdigest(), size

        for batch in batches:
            for shelf in batch.column(0).to_pylist():
                names = [(f.path, m[1]) for f in store.get_file_info(fs.FileSelector(f"{root}/shelf={shelf}", allow_not_found=True)) if (m := re.fullmatch(r"module=(-?\d*)\.txt", f.base_name))]
                for at in range(0, len(names), BATCH_FILES):
                    some = names[at : at + BATCH_FILES]
                    digests, sizes = zip(*[read(name) for name, _ in some], strict=True)
                    modules = pa.array([int(m) if m else None for _, m in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([modules, pa.array(digests), pa.array(sizes, pa.int64())], ["module", "sha256", "bytes"])

    ship_package(spark)
    return spark.range(0, SHELVES, 1, SHELF_TASKS).mapInArrow(run, "module long, sha256 string, bytes long")


def metrics(spark, sf_dir) -> DataFrame:
    l = log(spark, sf_dir)  # noqa: E741
    return l.select("kind", "seq", "session", F.col("k").alias("wall"), "value", F.concat(F.lit("from 10.0.0."), F.col("k").cast("string"), F.lit(" by a.b@example.com")).alias("note"))


@REG.add("src_scan_tree", "SELECT c_nationkey AS nation, count(*) AS lines, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer WHERE c_nationkey NOT IN (3, 4) GROUP BY 1")
def src_scan_tree(spark, sf_dir):
    """SRC-1: customers written to text files by nation, and the tree scanned back without two directories."""
    path = folder(spark, "tree")
    read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value")).write.partitionBy("nation").text(path)
    found = scan_tree(spark, path, "*.txt", "nation=3|nation=4")
    by = found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), F.regexp_count("text", F.lit("\n")).alias("lines"), F.octet_length("text").alias("bytes"))
    return by.groupBy("nation").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@REG.add("src_render_tree", "SELECT doc_id AS module, sha256(text || chr(10)) AS sha256, strlen(text)::BIGINT + 1 AS bytes FROM documents")
def src_render_tree(spark, sf_dir):
    """SRC-17: every module rendered from its lines to a text file of its own, and the files read back."""
    path = folder(spark, "rendered")
    if not write_texts(render(segments(spark, sf_dir)), path):
        return spark.createDataFrame([], "module long, sha256 string, bytes long")
    return shelved_manifest(spark, path)


@REG.add("src_bulk_load", with_sql("SELECT kind, count(*) AS n, count(DISTINCT parent_id) AS parents FROM nodes GROUP BY kind", nodes=NODES_SQL))
def src_bulk_load(spark, sf_dir):
    """SRC-2."""
    got = load_unique(nodes(spark, sf_dir), folder(spark, "nodes"), "id", "kind")
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("parent_id").alias("parents"))


@REG.add("src_load_edges", with_sql("SELECT kind, count(*) AS n, count(DISTINCT to_id) AS targets FROM edges GROUP BY kind", edges=EDGES_SQL))
def src_load_edges(spark, sf_dir):
    """SRC-3: at most one edge a source."""
    got = load_unique(edges(spark, sf_dir), folder(spark, "edges"), "from_id", "kind")
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("to_id").alias("targets"))


@REG.add("src_append_log", with_sql("SELECT session, count(*) AS n, max(seq) AS last FROM l GROUP BY session", l=LOG_SQL))
def src_append_log(spark, sf_dir):
    """SRC-4: the log appended in two parts."""
    path, rows = folder(spark, "log"), log(spark, sf_dir)
    for part in (0, 1):
        rows.filter(F.col("seq") % 2 == part).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("session").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@REG.add("src_metrics_log", with_sql("SELECT kind, count(*) AS n, sum(k)::BIGINT AS wall FROM l GROUP BY kind", l=LOG_SQL))
def src_metrics_log(spark, sf_dir):
    """SRC-5."""
    path = folder(spark, "metrics")
    write_contract(metrics(spark, sf_dir), path)
    return read_metrics(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("wall").alias("wall"))


@REG.add("src_tolerant_read", with_sql("""
SELECT truncated, count(*) AS n, coalesce(sum(seq), 0)::BIGINT AS seqs FROM (SELECT last AND log % 2 = 1 AS truncated, CASE WHEN NOT (last AND log % 2 = 1) THEN seq END AS seq
FROM (SELECT seq // 500 AS log, seq, seq = max(seq) OVER (PARTITION BY seq // 500) AS last FROM l)) GROUP BY truncated""", l=LOG_SQL))
def src_tolerant_read(spark, sf_dir):
    """SRC-6: a log for each five hundred sequence numbers; every other one ends in a line that is cut short."""
    path, line = folder(spark, "stream"), F.to_json(F.struct(*METRICS.names))
    logs = metrics(spark, sf_dir).groupBy(F.floor(F.col("seq") / 500).alias("log")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])).alias("value"))
    cut = F.col("log") % 2 == 1
    # a writer ends each row by its separator: a comma there leaves the last line open
    logs.filter(cut).withColumn("value", F.regexp_replace("value", '[^,]*$', "")).withColumn("value", F.regexp_replace("value", ",$", "")).write.option("lineSep", ",").partitionBy("log").text(path)
    logs.filter(~cut).write.mode("append").partitionBy("log").text(path)
    return read_tolerant(spark, path).groupBy("truncated").agg(F.count("*").alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seqs"))


@REG.add("src_contract_sink", with_sql("SELECT seq, 'from [address] by [mail]' AS note FROM l", l=LOG_SQL))
def src_contract_sink(spark, sf_dir):
    """SRC-7, SRC-8."""
    path = folder(spark, "sink")
    write_contract(metrics(spark, sf_dir), path, mode="errorifexists")
    return read_metrics(spark, path).select("seq", "note")


@REG.add("src_manifest", "SELECT c_nationkey AS nation, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer GROUP BY 1")
def src_manifest(spark, sf_dir):
    """SRC-9: one sorted file a nation."""
    path = folder(spark, "manifest")
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    rows.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)
    return manifest(spark, path, "*.txt").select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "sha256", "bytes")


@REG.add("src_session_log", with_sql("SELECT seq, kind AS tool, '{\"k\": [handle]}' AS args FROM l WHERE kind IN ('click', 'view')", l=LOG_SQL))
def src_session_log(spark, sf_dir):
    """SRC-10, SRC-11: a tagged union of events; the tool calls among them, with handle-shaped values masked."""
    path = folder(spark, "session")
    l = log(spark, sf_dir)  # noqa: E741
    call = F.col("kind").isin("click", "view")
    l.select("seq", F.when(call, "tool_call").otherwise("other").alias("type"), F.when(call, F.col("kind")).alias("tool"), F.when(call, F.col("params")).alias("args"), F.when(~call, F.col("value")).alias("cost")).write.json(path)
    union = spark.read.schema("seq long, type string, tool string, args string, cost double").option("mode", "FAILFAST").json(path)
    return union.filter("type = 'tool_call'").select("seq", "tool", F.regexp_replace("args", r"[0-9]+", "[handle]").alias("args"))


@REG.add("src_snapshot_roundtrip", with_sql("SELECT 'nodes' AS part, 3::BIGINT AS generation, count(*) AS n, 0::BIGINT AS differing FROM nodes UNION ALL SELECT 'edges', 3, count(*), 0 FROM edges", nodes=NODES_SQL, edges=EDGES_SQL))
def src_snapshot_roundtrip(spark, sf_dir):
    """SRC-12, SRC-13: nodes by id and edges by (from, to, kind); what is imported differs in no row from what was exported."""
    out = None
    for part, rows, order, key in (("nodes", nodes(spark, sf_dir), ["id"], "id"), ("edges", edges(spark, sf_dir), ["from_id", "to_id", "kind"], "from_id")):
        path, rows = folder(spark, part), stage(rows)
        export_snapshot(rows, path, 3, order)
        again = spark.read.parquet(path)
        values = [c for c in rows.columns if c != key]
        counts = again.groupBy(F.col("generation").cast("long").alias("generation")).agg(F.count("*").alias("n"))
        one = counts.join(diff(rows, again, key, values).agg(F.count("*").alias("differing"))).select(F.lit(part).alias("part"), "generation", "n", "differing")  # one row each
        out = one if out is None else out.union(one)
    return out


@REG.add("src_checkpoint", with_sql("""SELECT 'sound' AS attempt, 'written' AS outcome, count(*) AS n FROM nodes UNION ALL SELECT 'again', 'refused', 0 UNION ALL SELECT 'ahead', 'refused', 0 UNION ALL SELECT 'other_digest', 'refused', 0""", nodes=NODES_SQL))
def src_checkpoint(spark, sf_dir):
    """SRC-16: a checkpoint of generation 3 of a log that ends at 5; the same once more, one of generation 6, and one whose rows are not those of its digest."""
    path, rows = folder(spark, "checkpoint"), stage(nodes(spark, sf_dir))
    digest = content_digest(rows, rows.columns).first()["digest"]
    out = []
    for attempt, generation, df in (("sound", 3, rows), ("again", 3, rows), ("ahead", 6, rows), ("other_digest", 4, rows.filter("kind <> 'Order'"))):
        try:
            export_snapshot(df, path, generation, ["id"], 5, digest)
            out.append((attempt, "written", spark.read.parquet(f"{path}/generation={generation}").count()))
        except (ValueError, AnalysisException):
            out.append((attempt, "refused", 0))
    return spark.createDataFrame(out, "attempt string, outcome string, n long")


COPIED_SQL = "SELECT 'copy_' || lpad(c::VARCHAR, 4, '0') AS copy, n.*, 'copy_' || lpad(c::VARCHAR, 4, '0') || '/' || n.id AS new_id, 'copy_' || lpad(c::VARCHAR, 4, '0') || '/' || n.parent_id AS new_parent FROM nodes n, (SELECT unnest(range(0, 3)) AS c)"


@REG.add("src_replicate", with_sql(f"""
SELECT copy, count(*) AS n, min(new_id) AS first_id, {summed_digest_sql(row_text_sql("new_id", "kind", "new_parent", "child_index", "payload"))} AS digest, copy = 'copy_' || lpad((5381 % 3)::VARCHAR, 4, '0') AS is_target FROM k GROUP BY copy""", nodes=NODES_SQL, k=COPIED_SQL))
def src_replicate(spark, sf_dir, copies: int = 3, seed: int = 5381):
    """SRC-14: a corpus scaled to N copies under zero-padded prefixes, a content digest of each, and the copy that a seed marks as the target."""
    out = replicate(nodes(spark, sf_dir), copies)
    target = F.concat(F.lit("copy_"), F.lpad(F.lit(str(seed % copies)), 4, "0"))
    return out.groupBy("copy").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), summed_digest(row_text("id", "kind", "parent_id", "child_index", "payload")).alias("digest")).withColumn("is_target", F.col("copy") == target)


def replicate(df: DataFrame, copies: int) -> DataFrame:
    copy = F.concat(F.lit("copy_"), F.lpad(F.col("_c").cast("string"), 4, "0"))
    out = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("copy", copy)
    put = lambda c: F.concat_ws("/", "copy", c)
    return out.withColumns({"id": put("id"), "parent_id": F.when(F.col("parent_id").isNotNull(), put("parent_id"))}).drop("_c")


@REG.add("src_schema_evolution", with_sql("SELECT seq, kind AS event_kind, CASE WHEN seq % 2 = 1 THEN k ELSE 0 END AS cost FROM l", l=LOG_SQL))
def src_schema_evolution(spark, sf_dir):
    """SRC-15: an old part without a column and with an old name, a new part with both changed; defaults fill in."""
    path, l = folder(spark, "evolve"), log(spark, sf_dir)  # noqa: E741
    l.filter("seq % 2 = 0").select("seq", "kind").write.parquet(f"{path}/part=old")
    l.filter("seq % 2 = 1").select("seq", F.col("kind").alias("event_kind"), F.col("k").alias("cost")).write.parquet(f"{path}/part=new")
    both = spark.read.option("mergeSchema", "true").parquet(path)
    return both.select("seq", F.coalesce("event_kind", "kind").alias("event_kind"), F.coalesce("cost", F.lit(0).cast("long")).alias("cost"))


QUERIES, SQL = REG.queries, REG.sql
