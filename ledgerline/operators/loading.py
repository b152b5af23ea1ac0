"""Loads into the serving tables: upserts, fingerprints, continuity, publication.

Parquet has no merge, so a load writes whole new tables into a staging folder
and renames it; readers see the old run or the new one.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.functions.money import plain_amount


class LoadError(ValueError):
    """A load that must not change anything."""


def upsert(stored: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """New rows over stored ones by key; ``keep`` columns stay as stored if there.

    One full outer join; a row that only one side has passes as it is.
    """
    keep = keep or []
    a = stored.select(*[F.col(c).alias(f"_o_{c}") for c in stored.columns], F.lit(True).alias("_old"))
    b = new.withColumn("_new", F.lit(True))
    both = b.join(a, F.col(key) == F.col(f"_o_{key}"), "full")
    out = []
    for c in stored.columns:
        if c not in new.columns:
            value = F.col(f"_o_{c}")
        elif c in keep or c == key:
            value = F.coalesce(f"_o_{c}", c) if c != key else F.coalesce(c, f"_o_{c}")
        else:
            value = F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def replace_declarations(stored: DataFrame, new: DataFrame, entries: DataFrame, new_entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations with their entries replaced, unless any stored one is fresher."""
    fresher = stored.select("declaration_id", F.col("fetched_at").alias("_at")).join(new, "declaration_id").filter(F.col("_at") > F.col("fetched_at"))
    if not fresher.isEmpty():
        raise LoadError("a stored declaration was fetched after the one to load")
    kept = entries.join(new.select("declaration_id"), "declaration_id", "left_anti")
    return upsert(stored, new, "declaration_id"), kept.unionByName(new_entries)


def without_orphans(funders: DataFrame, entries: DataFrame) -> DataFrame:
    """Funders (or their aliases) that an entry still names."""
    return funders.join(entries.select("funder_id").distinct(), "funder_id", "left_semi")


def fingerprint(parts: dict[str, bytes]) -> str:
    """SHA-256 over parts in order of name: lengths (8 bytes, big-endian) and bytes."""
    out = hashlib.sha256()
    for name in sorted(parts):
        for piece in (name.encode(), parts[name]):
            out.update(len(piece).to_bytes(8, "big") + piece)
    return out.hexdigest()


def check_run(runs: dict[str, str], key: str, mark: str) -> str:
    """"load" for a new key, "already_loaded" for the same content, else an error."""
    if key not in runs:
        return "load"
    if runs[key] != mark:
        raise LoadError(f"run {key} was loaded with other content")
    return "already_loaded"


def continuity(stored: DataFrame, incoming: DataFrame, occurrences: DataFrame, new_occurrences: DataFrame) -> DataFrame:
    """(identity, id): incoming identities that keep the id of a stored funder.

    ``stored`` has id, identity and presentation, ``incoming`` identity and
    presentation; occurrences are (owner, occurrence) of either side.  A stored
    funder whose identity comes in again is taken.  Of the others, one keeps its
    id for the identity with the same presentation and the same complete set of
    occurrences, if that is unique both ways.
    """
    taken = stored.join(incoming.select("identity"), "identity", "left_semi")
    free = stored.join(taken.select("id"), "id", "left_anti")
    new = incoming.join(taken.select("identity"), "identity", "left_anti")

    def marked(rows: DataFrame, occ: DataFrame, key: str) -> DataFrame:
        sets = occ.select(F.col("owner").alias(key), "occurrence").distinct().groupBy(key)
        # A digest of the ordered set is the join key, the set itself decides.
        sets = sets.agg(F.array_sort(F.collect_list("occurrence")).alias("all")).withColumn("digest", F.xxhash64("all"))
        return rows.join(sets, key)

    a, b = marked(free, occurrences, "id"), marked(new, new_occurrences, "identity")
    a = a.select("id", F.col("presentation").alias("_p"), F.col("all").alias("_all"), F.col("digest").alias("_digest"))
    pairs = b.join(a, (F.col("digest") == F.col("_digest")) & (F.col("presentation") == F.col("_p")) & (F.col("all") == F.col("_all"))).select("identity", "id")
    once = pairs.groupBy("identity").agg(F.count("*").alias("n")).filter("n = 1").select("identity")
    single = pairs.join(once, "identity", "left_semi")
    back = single.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select("id")
    return single.join(back, "id", "left_semi").select("identity", "id")


def _files(spark: SparkSession, folder: str):
    """(file system, path) of a folder, whatever Hadoop file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _sibling(spark: SparkSession, path, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.getParent(), name)


@contextmanager
def writer_lock(spark: SparkSession, folder: str) -> Iterator[None]:
    """Only one writer of ``folder`` at a time: a lock file that is created or fails, never replaced."""
    fs, path = _files(spark, folder)
    lock = _sibling(spark, path, f".{path.getName()}.lock")
    if not fs.createNewFile(lock):
        raise LoadError(f"{folder} has another writer")
    try:
        yield
    finally:
        fs.delete(lock, False)


def write_table(table: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """A new Parquet table of exactly these columns and types; one that exists is an error."""
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in table.columns or table.schema[f.name].dataType != f.dataType]
        if missing:
            raise LoadError(f"columns missing or of another type: {', '.join(missing)}")
        table = table.select(*schema.fieldNames())
    table.write.mode("errorifexists").parquet(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, manifest: dict | None = None) -> None:
    """Write tables, and a manifest.json if given, into a staging folder and rename it to ``folder``, never over one.

    A writer lock keeps two publications of a folder apart, so that between the
    look and the rename nothing can take its place; a failure leaves nothing.
    """
    fs, target = _files(spark, folder)
    staging = _sibling(spark, target, f".{target.getName()}-{uuid.uuid4().hex}")
    with writer_lock(spark, folder):
        if fs.exists(target):
            raise LoadError(f"{folder} exists")
        try:
            fs.mkdirs(staging)
            for name, table in tables.items():
                write_table(table, f"{staging}/{name}.parquet")
            if manifest is not None:
                _write_bytes(spark, fs, f"{staging}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True).encode())
            if not fs.rename(staging, target):
                raise LoadError(f"{folder} cannot be published")
        finally:
            if fs.exists(staging):
                fs.delete(staging, True)


def _write_bytes(spark: SparkSession, fs, path: str, content: bytes) -> None:
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def publish_pages(spark: SparkSession, pages: list[bytes], folder: str, manifest: dict) -> None:
    """A capture's pages as they were received, page-1.json and on, with their manifest, renamed as one folder."""
    fs, target = _files(spark, folder)
    staging = _sibling(spark, target, f".{target.getName()}-{uuid.uuid4().hex}")
    with writer_lock(spark, folder):
        if fs.exists(target):
            raise LoadError(f"{folder} exists")
        try:
            fs.mkdirs(staging)
            for number, content in enumerate(pages, 1):
                _write_bytes(spark, fs, f"{staging}/page-{number}.json", content)
            _write_bytes(spark, fs, f"{staging}/manifest.json", json.dumps(manifest, indent=2).encode())
            if not fs.rename(staging, target):
                raise LoadError(f"{folder} cannot be published")
        finally:
            if fs.exists(staging):
                fs.delete(staging, True)


def copy_latest_raw(spark: SparkSession, root: str, key: str) -> str | None:
    """The raw folder of the latest run as that of a new run ``key``; returns the run copied, or None for none.

    Links and special files are errors, and a failed copy leaves no run.
    """
    source = latest_run(spark, root)
    if source is None:
        return None
    fs, top = _files(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staging = path(top, key), path(top, f".raw-copy-{uuid.uuid4().hex}")
    raw = path(path(top, source), "raw")

    def special(at) -> bool:
        """Links and devices, which only local file systems have."""
        if at.toUri().getScheme() != "file":
            return False
        name = at.toUri().getPath()
        return os.path.islink(name) or not (os.path.isfile(name) or os.path.isdir(name))

    def check(at) -> None:
        for status in fs.listStatus(at):
            if special(status.getPath()):
                raise LoadError(f"{status.getPath()} is a link or a special file")
            if status.isDirectory():
                check(status.getPath())

    raw = fs.makeQualified(raw)
    if special(raw) or not fs.getFileStatus(raw).isDirectory():
        raise LoadError(f"{raw} is no folder")
    check(raw)
    with writer_lock(spark, f"{root.rstrip('/')}/{key}"):
        if fs.exists(target):
            raise LoadError(f"{target} exists")
        try:
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            fs.mkdirs(staging)
            if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, raw, fs, path(staging, "raw"), False, conf) or not fs.rename(staging, target):
                raise LoadError(f"{target} cannot be written")
        finally:
            if fs.exists(staging):
                fs.delete(staging, True)
    return source


def raw_rows(declarations: DataFrame, entries: DataFrame, key: str = "declaration_id") -> DataFrame:
    """A row per entry of each declaration, and one with empty entry columns for a declaration without any."""
    return declarations.join(entries.withColumnRenamed(key, f"_{key}"), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")


def write_raw(rows: DataFrame, folder: str, member: str = "parliament_member_id") -> None:
    """Raw rows as one folder per member, ``<member>.parquet``, which must not exist before.

    Rows are dealt by member, so a member's files are written by one task, and
    named by a rename of the partition folders on the driver: as many as members.
    """
    spark = rows.sparkSession
    fs, target = _files(spark, folder)
    if fs.exists(target):
        raise LoadError(f"{folder} exists")
    rows.withColumn("_m", F.col(member)).repartition(member).write.partitionBy("_m").mode("errorifexists").parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("_m="):
            fs.rename(status.getPath(), path(target, f"{name[3:]}.parquet"))


def replace_aliases(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Aliases (funder_id, alias) with those of loaded funders (funder_id, funder_name, aliases) replaced.

    A loaded funder's aliases are the ones it brings and its own name.
    """
    new = loaded.select("funder_id", F.explode(F.array_union("aliases", F.array("funder_name"))).alias("alias"))
    return stored.join(loaded.select("funder_id"), "funder_id", "left_anti").unionByName(new.distinct())


def insert_entries(entries: DataFrame, funders: DataFrame) -> DataFrame:
    """``entries`` with the funder_id of their identity; an identity that no funder has stops the job."""
    known = funders.select(F.col("identity").alias("_i"), "funder_id")
    out = entries.join(known, F.col("identity") == F.col("_i"), "left")
    lost = F.raise_error(F.concat(F.lit("resolved identity was not inserted: "), "identity"))
    return out.withColumn("funder_id", F.when(F.col("identity").isNotNull() & F.col("_i").isNull(), lost).otherwise(F.col("funder_id"))).drop("_i")


def touched(stored: DataFrame, new: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> DataFrame:
    """``stored`` with rows of ``new`` over them, and a fresh stamp only where a value differs (null equals null)."""
    columns = [c for c in stored.columns if c not in (key, stamp)]
    b = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = stored.join(b, F.col(key) == F.col("_k"), "left")
    there = F.col("_k").isNotNull()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    values = [F.when(there, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return both.select(F.col(key), *values, F.when(there & ~same, now).otherwise(F.col(stamp)).alias(stamp))


def replace_trees(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Tree rows with those of every member in ``new`` replaced as a whole."""
    return stored.join(new.select("member_id").distinct(), "member_id", "left_anti").unionByName(new)


def load(spark: SparkSession, runs: DataFrame, key: str, mark: str, write, refresh) -> str:
    """Run a load once: ``write()`` for a new key, only ``refresh()`` of the groups for one that is there with this mark.

    ``runs`` has ingestion_key and fingerprint; another mark under a key is an
    error.  Returns "loaded" or "already_loaded".
    """
    found = {r["ingestion_key"]: r["fingerprint"] for r in runs.filter(F.col("ingestion_key") == key).select("ingestion_key", "fingerprint").limit(2).collect()}
    outcome = check_run(found, key, mark)
    if outcome == "load":
        write()
        outcome = "loaded"
    refresh()
    return outcome


def wire(rows: DataFrame, ids: list[str], amounts: list[str], times: list[str] = ()) -> DataFrame:
    """Rows as JSON objects, one column ``json``: ids as texts, amounts as plain decimals, times in UTC with a Z, nulls kept."""
    columns = []
    for name in rows.columns:
        c = F.col(name)
        if name in ids:
            c = c.cast("string")
        elif name in amounts:
            c = plain_amount(c.cast("decimal(38,18)"))
        elif name in times:
            c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        columns.append(c.alias(name))
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The run folder (named by a UUID) that was changed last; ties go to the larger name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return None
    found = []
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        try:
            uuid.UUID(name)
        except ValueError:
            continue
        if status.isDirectory():
            found.append((status.getModificationTime(), name))
    return max(found)[1] if found else None


def uncovered(payments: DataFrame, attributions: DataFrame, key: str = "payment_id") -> DataFrame:
    """Keys that are not exactly once on each side, with their counts."""
    a = payments.groupBy(key).agg(F.count("*").alias("payments"))
    b = attributions.groupBy(key).agg(F.count("*").alias("attributions"))
    both = a.join(b, key, "full").fillna(0, ["payments", "attributions"])
    return both.filter((F.col("payments") != 1) | (F.col("attributions") != 1))
