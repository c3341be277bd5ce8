"""Tables that change by transactions: a base, and for each generation a delta that holds what it takes to undo it."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from coppice.plans.digests import PARTS, digest_of, row_text, row_text_sql, summed_digest, summed_digest_sql, summed_parts
from coppice.plans.staging import folder, stage
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, NODES_SQL, edges, nodes, order_lines, read, with_sql

REG = Registry()

SUMS = [f"s{i}" for i in range(PARTS)]
LOG_DDL = "tx string, kind string, name string, affected long, inserted long, deleted long, n long, " + ", ".join(f"{s} decimal(38,0)" for s in SUMS)


class Kept(NamedTuple):
    """A table of a store: its key columns, all its columns as DDL, and links (column, table): the column names a row of that table by its one key."""

    keys: tuple[str, ...]
    schema: str
    links: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    def row(self, alias: str) -> Column:
        """The values as a struct that is never null, also if there are none."""
        return F.struct(F.lit(True).alias("there"), *self.values).alias(alias)

    def delta_schema(self) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(self.schema)}
        inner = ", ".join(["there: boolean", *[f"`{v}`: {kinds[v]}" for v in self.values]])
        keys = ", ".join(f"`{k}` {kinds[k]}" for k in self.keys)
        return f"{keys}, before struct<{inner}>, after struct<{inner}>, generation int"


class Store:
    """EDT-8, EDT-9: tables under one folder, with a generation for each transaction that was committed or rolled back.

    A generation is a delta: for each key that it touches, the row before and the row after
    (null: no row). Reading one merges the deltas since the last base into that base; only the
    deltas are aggregated, and the base is not shuffled while they are small enough for Spark to
    broadcast their keys. A base is written for every COMPACT-th generation. Its rows lie in
    folders by key hash, and a commit reads only the folders of the keys that it touches.

    A generation counts once its log rows are there: they are written last, so an attempt that
    breaks off, or is refused, leaves nothing that is read, and the next one overwrites it. Log
    rows carry sums of row hashes, brought forward by the delta alone. One writer at a time.

    Keys are unique and not null. Tables stand after those they link to.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Kept], buckets: int = 16):
        """buckets: folders of a base; about the bytes of the largest table by 1 GB is a good number."""
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    # --- reading ----------------------------------------------------------------------------------

    def log(self) -> DataFrame | None:
        """generation, tx, kind, name, affected, inserted, deleted, n and sums: a row a table and generation. None before the seed."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(f"{LOG_DDL}, generation int").parquet(f"{self.path}/log") if there else None

    def head(self) -> int:
        """The newest generation, -1 if there is none."""
        found = self.log()
        return -1 if found is None else found.agg(F.max("generation")).first()[0]

    def delta(self, name: str, first: int, last: int) -> DataFrame:
        """Keys, before, after and generation of what generations first to last (from 1) have changed."""
        at = f"{self.path}/{name}/delta"
        schema = self.tables[name].delta_schema()
        paths = [f"{at}/generation={g}" for g in range(first, last + 1)]
        return self.spark.read.schema(schema).option("basePath", at).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def at(self, name: str, generation: int, keys: DataFrame | None = None) -> DataFrame:
        """A table as of a generation; with keys, only the rows of these, read from their buckets. keys are evaluated more than once: stage them if they are dear."""
        return self._merged(name, generation - generation % self.COMPACT, generation, keys)

    def _bucket(self, t: Kept) -> Column:
        return F.pmod(F.xxhash64(*t.keys), F.lit(self.buckets)).cast("int")

    def _merged(self, name: str, base: int, generation: int, keys: DataFrame | None = None) -> DataFrame:
        t = self.tables[name]
        rows = self.spark.read.schema(f"{t.schema}, bucket int").parquet(f"{self.path}/{name}/base/generation={base}")
        changes = self.delta(name, base + 1, generation)
        if keys is not None:
            keys = keys.select(*t.keys).distinct()
            touched = [r[0] for r in keys.select(self._bucket(t)).distinct().collect()]  # buckets at most
            rows = rows.filter(F.col("bucket").isin(touched)).join(keys, list(t.keys), "left_semi")
            changes = changes.join(keys, list(t.keys), "left_semi")
        rows = rows.select(*t.columns)
        if base == generation:
            return rows
        last = changes.groupBy(*t.keys).agg(F.max_by("after", "generation").alias("after"))
        put = last.filter("after is not null").select(*[c if c in t.keys else F.col(f"after.{c}").alias(c) for c in t.columns])
        return rows.join(last.select(*t.keys), list(t.keys), "left_anti").unionByName(put)

    def digests(self, name: str) -> DataFrame:
        """generation, read_digest: for every generation the summed digest of the table as at() reads it.

        Each version of a row is read and hashed once, with the generations in which it is there;
        the sums of versions that are there in the same ones (few) add up to those of the generations.
        """
        t, head, parts = self.tables[name], self.head(), []
        for base in range(0, head + 1, self.COMPACT):
            top = min(base + self.COMPACT - 1, head)
            rows = self.spark.read.schema(t.schema).parquet(f"{self.path}/{name}/base/generation={base}")
            changes = self.delta(name, base + 1, top)
            until = changes.groupBy(*t.keys).agg(F.min("generation").alias("until"))
            parts.append(rows.join(until, list(t.keys), "left").select(*t.columns, F.lit(base).alias("first"), F.coalesce(F.col("until") - 1, F.lit(top)).alias("last")))
            last = F.coalesce(F.lead("generation").over(Window.partitionBy(*t.keys).orderBy("generation")) - 1, F.lit(top))  # a row of a key for each generation at most
            put = changes.select(*t.keys, "after", F.col("generation").alias("first"), last.alias("last")).filter("after is not null")
            parts.append(put.select(*[c if c in t.keys else F.col(f"after.{c}").alias(c) for c in t.columns], "first", "last"))
        sums = reduce(DataFrame.unionByName, parts).groupBy("first", "last").agg(*summed_parts(row_text(*t.columns)))
        every = self.spark.range(head + 1).select(F.col("id").cast("int").alias("generation"))
        found = every.join(F.broadcast(sums), F.col("generation").between(F.col("first"), F.col("last")), "left").groupBy("generation")  # COMPACT ** 2 rows a base at most
        whole = found.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), *[F.sum(c).alias(c) for c in SUMS])
        return whole.select("generation", digest_of(F.col("n"), *[F.col(c) for c in SUMS]).alias("read_digest"))

    # --- writing ----------------------------------------------------------------------------------

    def _write_base(self, name: str, generation: int, rows: DataFrame) -> None:
        t = self.tables[name]
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(t.schema)]
        out = rows.select(*cast).withColumn("bucket", self._bucket(t)).hint("rebalance", F.col("bucket"))
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/base/generation={generation}")

    def _check_keys(self, name: str, rows: DataFrame) -> None:
        keys = self.tables[name].keys
        none = F.lit(False)
        for k in keys:
            none = none | F.col(k).isNull()
        if not rows.groupBy(*keys).count().filter((F.col("count") > 1) | none).isEmpty():
            raise ValueError(f"{name}: a key is null or comes twice")

    def _write_log(self, generation: int, rows: list[tuple]) -> int:
        self.spark.createDataFrame(rows, LOG_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/generation={generation}")
        return generation

    def seed(self, **given: DataFrame) -> int:
        """Generation 0: whole tables."""
        if self.head() >= 0:
            raise ValueError("there is a seed already")
        out = []
        for name, t in self.tables.items():
            self._write_base(name, 0, given[name])
            there = self._merged(name, 0, 0)
            self._check_keys(name, there)
            sums = there.agg(*summed_parts(row_text(*t.columns))).first()
            out.append(("seed", "seed", name, 0, 0, 0, sums["n"], *[sums[s] or Decimal(0) for s in SUMS]))
        return self._write_log(0, out)

    def commit(self, tx: str, **changes: DataFrame) -> int:
        """The next generation. changes: by table, its columns and `gone`: rows to put in or over others, or (gone) to take away.

        Rows taken away take those that link to them along; what is not there can be taken away
        without effect. A link to nothing, a null key and a key given twice are errors, and
        nothing is committed.
        """
        found = self.log().filter(F.col("tx") == tx)
        if not found.isEmpty():
            raise ValueError(f"there is a transaction {tx} already")
        return self._advance(tx, "commit", changes, cascade=True)

    def rollback(self, tx: str) -> int:
        """What a transaction's commit changed is put back, rows it put in go; done already, or unknown, it changes nothing.

        Later generations stay in force. One that has since changed a row which this commit
        changed, or links to a row it put in, is an error; roll that one back first.
        """
        mine = self.log().filter(F.col("tx") == tx).groupBy("generation").agg(F.max("kind").alias("kind")).orderBy("generation").collect()  # at most two rows
        if tx == "seed" or not mine or mine[-1]["kind"] == "rollback":
            return self.head()
        made, head = mine[-1]["generation"], self.head()
        undone = {}
        for name, t in self.tables.items():
            changed = stage(self.delta(name, made, made).filter("not (before <=> after)").drop("generation"))
            now = self.at(name, head, changed).select(*t.keys, t.row("now"))
            if not changed.join(now, list(t.keys), "left").filter("not (after <=> now)").isEmpty():
                raise ValueError(f"{name}: a row that {tx} changed has been changed since")
            undone[name] = changed.select(*t.keys, F.col("after").alias("before"), F.col("before").alias("after"))  # what is there now is what the commit left
        return self._advance(tx, "rollback", {}, cascade=False, deltas=undone)

    def _advance(self, tx: str, kind: str, changes: dict[str, DataFrame], cascade: bool, deltas: dict[str, DataFrame] | None = None) -> int:
        """deltas: those of all tables, if they are known; else they come from changes."""
        head = self.head()
        made, base = head + 1, head - head % self.COMPACT
        moved: dict[str, dict] = {}
        for name, t in self.tables.items():
            if deltas:
                deltas[name].write.mode("overwrite").parquet(f"{self.path}/{name}/delta/generation={made}")
            else:
                along = [(c, target) for c, target in t.links if cascade and target != name and moved[target]["deleted"]]
                self._write_delta(name, made, head, changes.get(name), along)
            moved[name] = self._moved(name, made)
        for name in self.tables:
            self._check_links(name, made, base, moved, cascade)
        before = {r["name"]: r for r in self.log().filter(F.col("generation") == head).collect()}  # a row a table
        rows = []
        for name, m in moved.items():
            rows.append((tx, kind, name, m["affected"], m["inserted"], m["deleted"], before[name]["n"] + m["n"], *[Decimal(before[name][s] + m[s]) for s in SUMS]))
            if made % self.COMPACT == 0:
                self._write_base(name, made, self._merged(name, base, made))
        return self._write_log(made, rows)

    def _moved(self, name: str, made: int) -> dict:
        """What a generation does to a table: rows affected, inserted and deleted, rows it has after, and by how much n and the sums move."""
        t, mine = self.tables[name], self.delta(name, made, made)
        side = lambda one, other: mine.filter(f"{one} is not null").select(F.lit(one).alias("side"), F.col(other).isNull().alias("alone"), row_text(*[c if c in t.keys else F.col(f"{one}.{c}") for c in t.columns]).alias("text"))
        none = {"alone": 0, "n": 0, **dict.fromkeys(SUMS, 0)}
        sums = {r["side"]: r for r in side("before", "after").union(side("after", "before")).groupBy("side").agg(F.count_if("alone").alias("alone"), *summed_parts(F.col("text"))).collect()}
        was, now = sums.get("before", none), sums.get("after", none)
        return {"affected": was["n"] + now["alone"], "inserted": now["alone"], "deleted": was["alone"], "after": now["n"], **{c: now[c] - was[c] for c in ("n", *SUMS)}}

    def _write_delta(self, name: str, made: int, head: int, given: DataFrame | None, along: list[tuple[str, str]]) -> None:
        """along: links to tables of which this generation has deleted rows."""
        t = self.tables[name]
        keys, at = list(t.keys), f"{self.path}/{name}/delta/generation={made}"
        kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(t.schema)]
        if given is None:
            given = self.spark.createDataFrame([], f"{t.schema}, gone boolean")
            if not along:
                given.select(*keys, t.row("before"), t.row("after")).write.mode("overwrite").parquet(at)
                return
        given = stage(given.select(*kinds, F.coalesce("gone", F.lit(False)).alias("gone")))
        self._check_keys(name, given)
        for column, target in along:  # rows of one table that hang on each other are for the caller to name
            taken = self.delta(target, made, made).filter("after is null").select(F.col(self.tables[target].keys[0]).alias(column))
            more = self.at(name, head).join(taken, column, "left_semi").join(given, keys, "left_anti").withColumn("gone", F.lit(True))
            given = stage(given.unionByName(more))
        held = self.at(name, head, given).select(*keys, t.row("before"))
        put = given.select(*keys, F.when(~F.col("gone"), t.row("row")).alias("after"))
        delta = put.join(held, keys, "left").select(*keys, "before", "after").filter("before is not null or after is not null")
        delta.write.mode("overwrite").parquet(at)

    def _check_links(self, name: str, made: int, base: int, moved: dict[str, dict], cascade: bool) -> None:
        """Rows that this generation put in name what is there, and nothing that it took away is named any more.

        Columns that name the same table are looked up together. What linked to rows of another
        table that were taken away has gone along, if cascade, so that only what was put in is left to see to.
        """
        t = self.tables[name]
        mine = self.delta(name, made, made)

        def lost(columns: list[str], target: str) -> bool:
            key = self.tables[target].keys[0]
            each = [mine.filter("after is not null").select((F.col(c) if c in t.keys else F.col(f"after.{c}")).alias(key)) for c in columns]
            named = reduce(DataFrame.unionByName, each).filter(F.col(key).isNotNull())
            return not named.join(self._merged(target, base, made, named), key, "left_anti").isEmpty()

        def held(column: str, target: str) -> bool:
            taken = self.delta(target, made, made).filter("after is null").select(F.col(self.tables[target].keys[0]).alias(column))
            return not self._merged(name, base, made).join(taken, column, "left_semi").isEmpty()

        for target in dict.fromkeys(target for _, target in t.links):
            columns = [c for c, other in t.links if other == target]
            broken = [c for c in columns if lost([c], target)] if moved[name]["after"] and lost(columns, target) else []
            if not broken and moved[target]["deleted"] and (target == name or not cascade):
                broken = [c for c in columns if held(c, target)]
            if broken:
                raise ValueError(f"{name}.{broken[0]} would name a row of {target} that is not there")


GRAPH = {
    "nodes": Kept(("id",), "id string, kind string, parent_id string, child_index long, payload string"),
    "edges": Kept(("from_id", "to_id", "kind"), "from_id string, to_id string, kind string", (("from_id", "nodes"), ("to_id", "nodes"))),
}

_NODE, _EDGE = row_text_sql("id", "kind", "parent_id", "child_index", "payload"), row_text_sql("from_id", "to_id", "kind")
_TAKEN = "kind = 'Line' AND try_cast(substr(parent_id, 2) AS BIGINT) % 40 = 0"
_FIRST = "kind = 'Order' AND try_cast(substr(id, 2) AS BIGINT) % 30 = 0"
_SECOND = "kind = 'Customer' AND try_cast(substr(id, 2) AS BIGINT) % 20 = 0"
_UNTIED = "kind = 'value' AND try_cast(substr(from_id, 2) AS BIGINT) % 25 = 3"


def _marked(which: str, mark: str) -> str:
    return f"id, kind, parent_id, child_index, CASE WHEN {which} THEN payload || '{mark}' ELSE payload END AS payload"


def _log_sql(g: int, kind: str, name: str, affected: str, inserted: str, deleted: str) -> str:
    d = summed_digest_sql(_NODE if name == "nodes" else _EDGE)
    return f"SELECT {g} AS generation, '{kind}' AS kind, '{name}' AS name, ({affected})::BIGINT AS affected, ({inserted})::BIGINT AS inserted, ({deleted})::BIGINT AS deleted, count(*) AS n, {d} AS digest, {d} AS read_digest FROM {name[0]}{g}"


_N = {k: f"(SELECT count(*) FROM n0 WHERE {v})" for k, v in {"taken": _TAKEN, "first": _FIRST, "second": _SECOND}.items()} | {
    "new": "(SELECT count(*) FROM nation)", "along": "(SELECT count(*) FROM e0 WHERE from_id IN (SELECT id FROM gone))", "untied": f"(SELECT count(*) FROM e0 WHERE {_UNTIED})"}


@REG.add("edt_store_rollback", with_sql(
    "\nUNION ALL ".join(_log_sql(*row) for row in (
        (0, "seed", "nodes", "0", "0", "0"), (0, "seed", "edges", "0", "0", "0"),
        (1, "commit", "nodes", f"{_N['taken']} + {_N['first']} + {_N['new']}", _N["new"], _N["taken"]), (1, "commit", "edges", f"{_N['along']} + {_N['new']}", _N["new"], _N["along"]),
        (2, "commit", "nodes", _N["second"], "0", "0"), (2, "commit", "edges", _N["untied"], "0", _N["untied"]),
        (3, "rollback", "nodes", f"{_N['taken']} + {_N['first']} + {_N['new']}", _N["taken"], _N["new"]), (3, "rollback", "edges", f"{_N['along']} + {_N['new']}", _N["along"], _N["new"]),
        (4, "rollback", "nodes", _N["second"], "0", "0"), (4, "rollback", "edges", _N["untied"], _N["untied"], "0"),
    )),
    n0=f"SELECT * FROM ({NODES_SQL}) UNION ALL SELECT 'P' || p_partkey, 'Part', NULL, NULL, p_name FROM part", e0=f"SELECT DISTINCT * FROM ({EDGES_SQL})",
    gone=f"SELECT id FROM n0 WHERE {_TAKEN}",
    n1=f"SELECT {_marked(_FIRST, '!')} FROM n0 WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'C-N' || n_nationkey, 'Customer', 'N' || n_nationkey, -1, n_name FROM nation",
    e1="SELECT * FROM e0 WHERE from_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'C-N' || n_nationkey, 'N' || n_nationkey, 'home' FROM nation",
    n2=f"SELECT {_marked(_SECOND, '?')} FROM n1", e2=f"SELECT * FROM e1 WHERE NOT coalesce({_UNTIED}, false)",
    n3=f"SELECT {_marked(_SECOND, '?')} FROM n0", e3=f"SELECT * FROM e0 WHERE NOT coalesce({_UNTIED}, false)",
    n4="SELECT * FROM n0", e4="SELECT * FROM e0"))
def edt_store_rollback(spark, sf_dir):
    """EDT-8, EDT-9 on nodes and edges: two transactions (lines go with their edges, orders are marked, customers come with an edge; then customers are marked and edges go), the older one rolled back under the newer (twice, to the same effect), then the newer. Digests as the log brings them forward, and of the tables as they are read."""
    store = Store(spark, folder(spark, "store"), GRAPH)
    lines = stage(order_lines(spark, sf_dir))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Part").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("long").alias("child_index"), F.col("p_name").alias("payload"))
    store.seed(nodes=nodes(spark, sf_dir, lines).unionByName(parts), edges=edges(spark, sf_dir, lines).distinct())
    held, tied = store.at("nodes", 0), store.at("edges", 0)
    keep, gone = F.lit(False).alias("gone"), F.lit(True).alias("gone")
    nation, number = read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    new_id, home = F.concat(F.lit("C-N"), number), F.concat(F.lit("N"), number)
    mark = lambda which, sign: held.filter(which).withColumn("payload", F.concat("payload", F.lit(sign))).withColumn("gone", keep)
    born = nation.select(new_id.alias("id"), F.lit("Customer").alias("kind"), home.alias("parent_id"), F.lit(-1).cast("long").alias("child_index"), F.col("n_name").alias("payload"), keep)
    store.commit("t1", nodes=held.filter(_TAKEN).withColumn("gone", gone).unionByName(mark(_FIRST, "!")).unionByName(born), edges=nation.select(new_id.alias("from_id"), home.alias("to_id"), F.lit("home").alias("kind"), keep))
    store.commit("t2", nodes=mark(_SECOND, "?"), edges=tied.filter(_UNTIED).withColumn("gone", gone))
    store.rollback("t1")
    store.rollback("t1")
    store.rollback("t2")
    seen = reduce(DataFrame.unionByName, [store.digests(name).select("generation", F.lit(name).alias("name"), "read_digest") for name in GRAPH])
    logged = store.log().select("generation", "kind", "name", "affected", "inserted", "deleted", "n", digest_of(F.col("n"), *[F.col(s) for s in SUMS]).alias("digest"))
    return logged.join(F.broadcast(seen), ["generation", "name"])  # ten rows


QUERIES, SQL = REG.queries, REG.sql
