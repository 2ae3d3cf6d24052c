"""Published tables that micro-batches update: all of a batch becomes visible at once, and only once.

A table is cut into parts, by a hash of its key or by a column of its own such as the day. A batch writes
only its own rows, as one more file set of each part it touches, and then publishes a
manifest that names the file sets of every part, the greatest number given out, and the batch.
Readers follow the newest manifest and take the newest row of each key. A part with many file sets is
rewritten as one when the next batch touches it, so neither readers nor writers ever
work on more than they need. A batch that runs again after it was published does nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.times import DAY_US
from tidemark.operators import alerts as alert_ops
from tidemark.operators import bars as bar_ops
from tidemark.operators import upsert

BAR_KEY = ["symbol", "timeframe", "ts"]


class Published:
    """One published table in ``home`` (a folder all executors share). Without ``key`` rows are only added.

    ``part`` gives the part of a row (an integer); by default ``parts`` parts by a hash of the key.
    """

    def __init__(self, spark: SparkSession, home: str, schema: str, key: list[str], parts: int = 16, part: Column | None = None, most_sets: int = 8) -> None:
        self.spark, self.home, self.schema, self.key, self.parts, self.most_sets = spark, home.rstrip("/"), schema, key, parts, most_sets
        self._part = part
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest or that of a version; an empty one before the first batch."""
        pattern = self._hadoop.Path(f"{self.home}/manifest-{'*' if version is None else version}.json")
        found = self._fs.globStatus(pattern) or []
        newest = max((f.getPath().toString() for f in found), default=None, key=lambda p: int(p.rpartition("-")[2][:-5]))
        if newest is None:
            return {"version": 0, "batch": -1, "high_water": 0, "files": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(newest, wholetext=True).collect()))

    def read(self, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        files = self.manifest(version)["files"]
        sets = [p for n, p in files.items() if parts is None or int(n) in parts]
        load = lambda paths: self.spark.read.schema(f"{self.schema}, _version long").parquet(*paths)
        plain = [p for ps in sets if len(ps) == 1 or not self.key for p in ps]
        mixed = [p for ps in sets if len(ps) > 1 and self.key for p in ps]
        found = [load(plain)] if plain else []
        if mixed:
            rows = load(mixed)
            columns = [c for c in rows.columns if c not in self.key]
            found.append(rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns), "_version").alias("_v")).select(*self.key, "_v.*").select(*rows.columns))
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, found).drop("_version")

    def part_of(self) -> Column:
        return (F.pmod(F.xxhash64(*self.key), F.lit(self.parts)) if self._part is None else self._part).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that hold keys of ``rows``: at most as many as there are parts."""
        return sorted(r["p"] for r in rows.select(self.part_of().alias("p")).distinct().collect())

    def publish(self, rows: DataFrame, batch: int, high_water: int) -> int:
        """Add a batch's new and changed rows; gives the version published."""
        now = self.manifest()
        version = now["version"] + 1
        files = {n: list(p) for n, p in now["files"].items()}
        for n, path in self._write(rows, version).items():
            files.setdefault(n, []).append(path)
        for n in [n for n, p in files.items() if len(p) > self.most_sets]:
            files |= self._rewritten(int(n), files[n], version)
        return self._commit({"version": version, "batch": batch, "high_water": high_water, "files": files})

    def keep(self, test: Column, spared: int) -> int:
        """Drop the rows for which ``test`` is not true: whole parts below ``spared``, rows of that part, nothing above."""
        now = self.manifest()
        version = now["version"] + 1
        files = {n: p for n, p in now["files"].items() if int(n) >= spared}
        if str(spared) in files:
            rest = self._write(self.read([spared]).filter(test), version)
            files = {n: p for n, p in files.items() if int(n) != spared} | {n: [p] for n, p in rest.items()}
        return self._commit(now | {"version": version, "files": files})

    def _rewritten(self, part: int, paths: list[str], version: int) -> dict[str, list[str]]:
        rows = self.spark.read.schema(f"{self.schema}, _version long").parquet(*paths)
        if self.key:
            columns = [c for c in rows.columns if c not in self.key]
            rows = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns), "_version").alias("_v")).select(*self.key, "_v.*")
        return {str(part): list(self._write(rows.drop("_version"), version).values())}

    def _write(self, rows: DataFrame, version: int) -> dict[str, str]:
        folder = f"{self.home}/data/{uuid.uuid4().hex}"
        typed = [F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema.fields]
        rows.select(*typed, F.lit(version).cast("long").alias("_version")).withColumn("_part", self.part_of()).write.partitionBy("_part").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(folder))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def _commit(self, body: dict) -> int:
        hidden = self._hadoop.Path(f"{self.home}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not self._fs.rename(hidden, self._hadoop.Path(f"{self.home}/manifest-{body['version']}.json")):
            raise RuntimeError("another writer published first")
        return body["version"]


def upsert_bars(target: Published, incoming: DataFrame, batch: int) -> DataFrame | None:
    """Fold a batch of bars (``arrival`` tells the last of equal keys) into the published ones; gives the rows written, None if the batch was there already."""
    now = target.manifest()
    if batch <= now["batch"]:
        return None
    _, written = bar_ops.upsert(target.read(target.touched(incoming)), incoming, now["high_water"])
    written = written.persist()
    target.publish(written, batch, now["high_water"] + written.count())
    return written


ARTICLES = (
    "id long, headline string, symbols array<string>, summary string, author string, created_at string, updated_at string, content_html string, content_text string, url string, source string, "
    "raw_json string, first_seen_at string, last_seen_at string, latency_ms long, is_content_present boolean, update_count int, seq long"
)


def upsert_articles(target: Published, incoming: DataFrame, batch: int) -> DataFrame | None:
    """Fold a batch of normalised articles (``arrival`` gives their order) into the published ones.

    Gives the states the batch went through (``was_new``, ``content_changed``, ...), from
    which versions are appended and alerts made; None if the batch was there already.
    """
    now = target.manifest()
    if batch <= now["batch"]:
        return None
    ids = incoming.select("id").distinct()
    fields = ["id", "headline", "symbols", *upsert.KEPT, "raw_json", "latency_ms", "is_content_present"]
    held = target.read(target.touched(incoming)).join(ids, "id", "left_semi")
    old = held.select(*fields, F.col("first_seen_at").alias("received_at"), F.lit(-1).cast("long").alias("arrival"), F.col("update_count").alias("_had"), F.col("seq").alias("_seq"))
    new = incoming.select(*fields, "received_at", "arrival", F.lit(None).cast("int").alias("_had"), F.lit(None).cast("long").alias("_seq"))
    states = upsert.apply_updates(old.unionByName(new), ["arrival"])
    line = Window.partitionBy("id")
    states = states.withColumn("_had", F.coalesce(F.max("_had").over(line), F.lit(0))).withColumn("_seq", F.max("_seq").over(line))
    states = states.withColumn("update_count", F.col("update_count") + F.col("_had")).withColumn("_moved", F.max(F.when(F.col("changed") | (F.col("was_new") & (F.col("arrival") >= 0)), F.col("arrival"))).over(line)).persist()
    last = upsert.current(states)
    numbered = last.filter("_moved IS NOT NULL").select("id", (F.row_number().over(Window.orderBy("_moved", "id")) + now["high_water"]).alias("_new"))
    done = last.join(numbered, "id", "left").withColumn("seq", F.coalesce("_new", "_seq").cast("long"))
    target.publish(done.select(*(c.split()[0] for c in ARTICLES.split(", "))), batch, now["high_water"] + last.filter("_moved IS NOT NULL").count())
    return states.filter("arrival >= 0").drop("_had", "_seq", "_moved")


ALERTS = "alert_id string, article_id long, created_us long, severity string, category string, symbols array<string>, headline string, reason string, acknowledged boolean, content_hash string, direction string, seq long"


def alert_id(*parts: Column) -> Column:
    """A stable id of an alert, so that a batch that runs again makes the same ones."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256), 1, 32)


def fresh_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming alerts that the store takes: the first of an article and category for ever, and none whose category
    and content another article's kept alert had within a day before. Alerts without article are taken once by id.
    """
    columns = incoming.columns
    both = stored.select(*columns, F.lit(0).alias("_late")).unionByName(incoming.withColumn("_late", F.lit(1)))
    own = F.when(F.col("article_id").isNotNull(), F.concat_ws("|", F.col("article_id").cast("string"), "category")).otherwise(F.concat(F.lit("#"), "alert_id"))
    once = both.withColumn("_own", own).groupBy("_own").agg(F.min_by(F.struct(*columns, "_late"), F.struct("_late", "created_us", "alert_id")).alias("_a")).select("_a.*")
    plain, keyed = once.filter("content_hash IS NULL"), once.filter("content_hash IS NOT NULL")
    # what is stored was kept once and is kept again, and holds back what comes within a day
    kept = alert_ops.leading_edge(keyed, ["category", "content_hash"], "created_us", DAY_US + 1)
    return plain.unionByName(kept).filter("_late = 1").drop("_late")


def insert_alerts(target: Published, incoming: DataFrame, batch: int) -> DataFrame | None:
    """Add a batch of alerts (columns of ``ALERTS`` but ``seq`` and ``acknowledged``); gives the rows taken, None if the batch was there already."""
    now = target.manifest()
    if batch <= now["batch"]:
        return None
    columns = [c.split()[0] for c in ALERTS.split(", ")][:-1]
    rows = incoming.withColumn("acknowledged", F.lit(False)).select(*columns)
    taken = fresh_alerts(target.read().select(*columns), rows)
    taken = taken.withColumn("seq", (F.row_number().over(Window.orderBy("created_us", "alert_id")) + now["high_water"]).cast("long")).persist()
    target.publish(taken, batch, now["high_water"] + taken.count())
    return taken


def acknowledge(target: Published, alert_ids: list[str]) -> int:
    """Set the flag of alerts; gives how many there were."""
    now = target.manifest()
    seen = target.read().filter(F.col("alert_id").isin(alert_ids)).withColumn("acknowledged", F.lit(True)).persist()
    found = seen.count()
    if found:
        target.publish(seen, now["batch"], now["high_water"])
    return found


class MarketStore:
    """Trades, quotes, statuses, bands and raw events that batches add to, all tables at once.

    Each table publishes a version of its own; a commit then names one version of each, and readers see the newest
    commit only. Parts are days, so retention drops whole parts.
    """

    TABLES = {"trades": schemas.TRADES, "quotes": schemas.QUOTES, "statuses": schemas.STATUSES, "bands": schemas.BANDS, "raw": "message_type string, raw_json string, ts_us long"}

    def __init__(self, spark: SparkSession, home: str) -> None:
        day = F.expr(f"ts_us div {DAY_US}L")
        self.tables = {n: Published(spark, f"{home}/{n}", schema, [], part=F.coalesce(day, F.lit(0))) for n, schema in self.TABLES.items()}
        self.commits = Published(spark, f"{home}/commits", "ts_us long", [])

    def insert(self, tables: dict[str, DataFrame], batch: int) -> bool:
        """Add the rows of a batch; False if it was there already."""
        now = self.commits.manifest()
        if batch <= now["batch"]:
            return False
        for name, rows in tables.items():
            target = self.tables[name]
            if batch > target.manifest()["batch"]:
                target.publish(rows, batch, 0)
        self._commit(batch)
        return True

    def _commit(self, batch: int) -> None:
        now = self.commits.manifest()
        versions = {n: t.manifest()["version"] for n, t in self.tables.items()}
        self.commits._commit({"version": now["version"] + 1, "batch": batch, "high_water": 0, "files": versions})

    def read(self, name: str) -> DataFrame:
        version = self.commits.manifest()["files"].get(name, 0)
        return self.tables[name].read(version=version)

    def keep_since(self, name: str, ts_us: int) -> None:
        """Drop what is older."""
        self.tables[name].keep(F.col("ts_us") >= ts_us, ts_us // DAY_US)
        self._commit(self.commits.manifest()["batch"])
