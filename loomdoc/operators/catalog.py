"""The speaker catalog as append-only frames: every change is a new frame, derived columns are aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.operators import vectors
from loomdoc.session import cut

# The catalog's tables.
SCHEMAS = {
    "schema_version": "version int",
    "speakers": "id string, name string, centroid array<float>, enrollment_count int, meeting_count int, mean_distance double, std_distance double, last_seen_at string, created_at string, updated_at string",
    "enrollments": "id string, speaker_id string, embedding array<float>, source_file string, segment_start double, segment_end double, source_type string, confidence double, is_representative int, created_at string",
    "speaker_merges": "id string, from_speaker string, to_speaker string, reason string, merged_at string",
    "speaker_groups": "id string, name string, created_at string, updated_at string",
    "speaker_group_members": "group_id string, speaker_id string, added_at string",
}


def add_rows(table: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """``table`` with the rows whose ``unique`` columns it does not hold yet."""
    new = rows.join(table.select(*unique), unique, "left_anti").dropDuplicates(unique)
    return table.unionByName(new, allowMissingColumns=True)


def delete_where(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_speaker(speakers: DataFrame, enrollments: DataFrame, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the speaker, its enrollments and memberships."""
    gone = speakers.where(F.col("name") == name).select(F.col("id").alias("speaker_id"))
    return speakers.where(F.col("name") != name), delete_where(enrollments, gone, ["speaker_id"]), delete_where(members, gone, ["speaker_id"])


def merge_speakers(speakers: DataFrame, enrollments: DataFrame, merges: DataFrame, source: str, target: str, *, reason: str | None, merged_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enrollments of ``source`` become ``target``'s, the merge is recorded, ``source`` is gone."""
    ids = speakers.where(F.col("name").isin(source, target)).agg(F.max(F.when(F.col("name") == source, F.col("id"))).alias("_from"), F.max(F.when(F.col("name") == target, F.col("id"))).alias("_to"))
    moved = enrollments.crossJoin(F.broadcast(ids)).withColumn("speaker_id", F.when(F.col("speaker_id") == F.col("_from"), F.col("_to")).otherwise(F.col("speaker_id"))).drop("_from", "_to")
    note = ids.select(F.concat_ws(">", "_from", "_to").alias("id"), F.col("_from").alias("from_speaker"), F.col("_to").alias("to_speaker"), F.lit(reason).cast("string").alias("reason"), F.lit(merged_at).alias("merged_at"))
    return speakers.where(F.col("name") != source), moved, merges.unionByName(note)


def next_unknown(speakers: DataFrame) -> DataFrame:
    """One row ``name``: ``Unknown_n`` with the next free number."""
    n = F.when(F.col("name").rlike(r"^Unknown_\d+$"), F.substring("name", 9, 20).try_cast("int"))
    return speakers.agg(F.concat(F.lit("Unknown_"), (F.coalesce(F.max(n), F.lit(-1)) + 1).cast("string")).alias("name"))


def group_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """``name, member_count`` of every group, empty ones too."""
    return groups.join(members, groups["id"] == members["group_id"], "left").groupBy(groups["name"]).agg(F.count("speaker_id").alias("member_count"))


def group_members(groups: DataFrame, members: DataFrame, speakers: DataFrame) -> DataFrame:
    """``group_name, member``: the speakers of every group."""
    m = members.join(speakers.select(F.col("id").alias("speaker_id"), F.col("name").alias("member")), "speaker_id")
    return m.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id").select("group_name", "member")


def resolve_names(tokens: DataFrame, groups: DataFrame, members: DataFrame, speakers: DataFrame) -> DataFrame:
    """``pos, name``: comma-separated names, ``@group`` replaced by its members in name order, each name once where it first stands."""
    t = tokens.select(F.posexplode(F.split("names", ",")).alias("p", "tok")).select("p", F.trim("tok").alias("tok")).where("tok != ''")
    g = groups.select(F.col("id").alias("gid"), F.concat(F.lit("@"), F.col("name")).alias("tok"))
    m = members.join(speakers.select(F.col("id").alias("speaker_id"), F.col("name").alias("member")), "speaker_id").select(F.col("group_id").alias("gid"), "member")
    x = t.join(g, "tok", "left").join(m, "gid", "left").select("p", F.coalesce("member", "tok").alias("name"), "member")
    first = x.groupBy("name").agg(F.min(F.struct("p", F.coalesce("member", F.lit("")).alias("m"))).alias("o"))
    return first.select(F.row_number().over(Window.orderBy("o")).alias("pos"), "name")


# ---- the catalog as a whole ------------------------------------------------------------------------

#: The version of the tables above; older catalogs are brought to it by ``MIGRATIONS``: version to the columns it adds by table.
VERSION = 2
MIGRATIONS = {2: {"speakers": {"mean_distance": "double", "std_distance": "double"}}}


def to_blob(vec: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vec)


def from_blob(blob: Column) -> Column:
    """The vector of :func:`to_blob`."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(blob)


def new_id() -> Column:
    return F.expr("uuid()")


def now_iso() -> Column:
    """The second of the query in UTC, as the catalog writes times."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@dataclass(frozen=True)
class Catalog:
    """All tables of one catalog.  Every method gives a new catalog; nothing is written before :meth:`save`.

    Names are unique among speakers and among groups.  What a method cannot find or would double is a ``ValueError``, told by
    one look-up of that name.
    """

    frames: dict[str, DataFrame]

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        frames = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return cls(frames | {"schema_version": spark.createDataFrame([(VERSION,)], SCHEMAS["schema_version"])})

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Catalog:
        """The catalog of a folder of parquet tables, migrated to ``VERSION``; an empty one where the folder has none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = {n for n in SCHEMAS if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, n))}
        made = cls.empty(spark).frames
        return cls({n: spark.read.parquet(f"{folder}/{n}") if n in held else made[n] for n in SCHEMAS}).migrated()

    def save(self, folder: str) -> None:
        """Write all tables; to another folder than the one that was opened, since frames are read as they are written."""
        for n, df in self.frames.items():
            df.write.mode("overwrite").parquet(f"{folder}/{n}")

    def version(self) -> int:
        return self.frames["schema_version"].agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v

    def migrated(self) -> Catalog:
        frames, at = dict(self.frames), self.version()
        for v in range(at + 1, VERSION + 1):
            for name, columns in MIGRATIONS.get(v, {}).items():
                for c, kind in columns.items():
                    if c not in frames[name].columns:
                        frames[name] = frames[name].withColumn(c, F.lit(None).cast(kind))
        if at < VERSION:
            one = frames["schema_version"].sparkSession.createDataFrame([(VERSION,)], SCHEMAS["schema_version"])
            frames["schema_version"] = frames["schema_version"].unionByName(one)
        return Catalog(frames)

    def _with(self, **frames: DataFrame) -> Catalog:
        return Catalog(self.frames | frames)

    def _one(self, table: str, **values: object) -> DataFrame:
        """A row of ``table``; values may be columns."""
        spark = self.frames[table].sparkSession
        kinds = dict(self.frames[table].dtypes)
        lit = lambda c: values[c] if isinstance(values.get(c), Column) else F.lit(values.get(c))
        return spark.range(1, numPartitions=1).select(*[lit(c).cast(k).alias(c) for c, k in kinds.items()])

    def speaker(self, name: str) -> DataFrame:
        return self.frames["speakers"].where(F.col("name") == name)

    def group(self, name: str) -> DataFrame:
        return self.frames["speaker_groups"].where(F.col("name") == name)

    def _id(self, rows: DataFrame, what: str) -> str:
        found = rows.select("id").head(1)
        if not found:
            raise ValueError(f"not found: {what}")
        return found[0][0]

    def add_speaker(self, name: str, at: str, ident: str) -> Catalog:
        if self.speaker(name).head(1):
            raise ValueError(f"there is a speaker {name!r}")
        row = self._one("speakers", id=ident, name=name, enrollment_count=0, meeting_count=0, created_at=at, updated_at=at)
        return self._with(speakers=self.frames["speakers"].unionByName(row))

    def speakers(self) -> DataFrame:
        return self.frames["speakers"].orderBy("name")

    def remove_speaker(self, name: str) -> Catalog:
        self._id(self.speaker(name), name)
        f = self.frames
        s, e, m = delete_speaker(f["speakers"], f["enrollments"], f["speaker_group_members"], name)
        return self._with(speakers=s, enrollments=e, speaker_group_members=m)

    def merge(self, source: str, target: str, at: str, reason: str | None = None) -> Catalog:
        """``source`` becomes ``target``: enrollments are moved, the merge is recorded, counts and centroid are told anew."""
        if source == target:
            raise ValueError("a speaker cannot be merged with itself")
        a, b = (self._id(self.speaker(n), n) for n in (source, target))
        f = self.frames
        s, e, m = merge_speakers(f["speakers"], f["enrollments"], f["speaker_merges"], source, target, reason=reason, merged_at=at)
        gone = f["speaker_group_members"].where(F.col("speaker_id") != a)
        return self._with(speakers=s, enrollments=e, speaker_merges=m, speaker_group_members=gone).refreshed(at, [b])

    def enroll(self, rows: DataFrame, at: str) -> Catalog:
        """New enrollments (``id, speaker_id, embedding`` and any other columns) of known speakers, whose counts, centroids and distances follow."""
        e = self.frames["enrollments"]
        known = rows.join(self.frames["speakers"].select(F.col("id").alias("speaker_id")), "speaker_id", "left_semi")
        for c, kind in e.dtypes:
            if c not in known.columns:
                known = known.withColumn(c, F.lit(at if c == "created_at" else None).cast(kind))
        ids = [r[0] for r in known.select("speaker_id").distinct().collect()]  # the speakers of one call
        return self._with(enrollments=add_rows(e, known.select(*e.columns), ["id"])).refreshed(at, ids)

    def refreshed(self, at: str, ids: list[str] | None = None) -> Catalog:
        """Counts, centroids and distances of the speakers ``ids`` (all of them if none are named) from their enrollments."""
        f = self.frames
        mine = F.lit(True) if ids is None else F.col("speaker_id").isin(ids)
        e = f["enrollments"].where(mine & F.col("embedding").isNotNull())
        n = f["enrollments"].where(mine).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("_n"))
        c = vectors.mean_vectors(e, "speaker_id", "embedding")
        d = vectors.distance_stats(e, "speaker_id", "embedding", c).drop("enrollment_count").withColumnsRenamed({"mean_distance": "_m", "std_distance": "_s"})
        told = n.join(c.withColumnRenamed("centroid", "_c"), "speaker_id", "left").join(d, "speaker_id", "left").withColumnRenamed("speaker_id", "_id")
        here = F.lit(True) if ids is None else F.col("id").isin(ids)
        s = f["speakers"].join(told, F.col("id") == F.col("_id"), "left")
        new = {"centroid": F.col("_c").cast("array<float>"), "enrollment_count": F.coalesce("_n", F.lit(0)).cast("int"), "mean_distance": F.col("_m"), "std_distance": F.col("_s"), "updated_at": F.lit(at)}
        return self._with(speakers=s.select(*[F.when(here, new[k]).otherwise(F.col(k)).alias(k) if k in new else F.col(k) for k in f["speakers"].columns]))

    def seen(self, ids: list[str], at: str) -> Catalog:
        """One more meeting of each of the speakers."""
        s, here = self.frames["speakers"], F.col("id").isin(ids)
        new = {"meeting_count": F.coalesce("meeting_count", F.lit(0)) + 1, "last_seen_at": F.lit(at), "updated_at": F.lit(at)}
        return self._with(speakers=s.select(*[F.when(here, v).otherwise(F.col(k)).alias(k) if (v := new.get(k)) is not None else F.col(k) for k in s.columns]))

    def pruned(self, at: str, keep: int = vectors.KEEP) -> Catalog:
        """At most ``keep`` enrollments of each speaker, the newest; all derived columns follow."""
        e = vectors.prune_gallery(self.frames["enrollments"], "speaker_id", [F.desc_nulls_last("created_at"), F.desc("id")], keep=keep)
        return self._with(enrollments=e).refreshed(at)

    def create_group(self, name: str, at: str, ident: str) -> Catalog:
        if self.group(name).head(1):
            raise ValueError(f"there is a group {name!r}")
        return self._with(speaker_groups=self.frames["speaker_groups"].unionByName(self._one("speaker_groups", id=ident, name=name, created_at=at, updated_at=at)))

    def delete_group(self, name: str) -> Catalog:
        gid = self._id(self.group(name), name)
        f = self.frames
        return self._with(speaker_groups=f["speaker_groups"].where(F.col("id") != gid), speaker_group_members=f["speaker_group_members"].where(F.col("group_id") != gid))

    def add_member(self, group: str, speaker: str, at: str) -> Catalog:
        """A member is added once, however often it is asked for."""
        row = self._one("speaker_group_members", group_id=self._id(self.group(group), group), speaker_id=self._id(self.speaker(speaker), speaker), added_at=at)
        return self._with(speaker_group_members=add_rows(self.frames["speaker_group_members"], row, ["group_id", "speaker_id"]))

    def remove_member(self, group: str, speaker: str) -> Catalog:
        gid, sid = self._id(self.group(group), group), self._id(self.speaker(speaker), speaker)
        m = self.frames["speaker_group_members"]
        if not m.where((F.col("group_id") == gid) & (F.col("speaker_id") == sid)).head(1):
            raise ValueError(f"{speaker!r} is no member of {group!r}")
        return self._with(speaker_group_members=m.where((F.col("group_id") != gid) | (F.col("speaker_id") != sid)))

    def members(self, group: str) -> DataFrame:
        """``name, added_at`` of a group's members by name."""
        gid = self._id(self.group(group), group)
        m = self.frames["speaker_group_members"].where(F.col("group_id") == gid)
        return m.join(self.frames["speakers"].select(F.col("id").alias("speaker_id"), "name"), "speaker_id").select("name", "added_at").orderBy("name")

    def groups(self) -> DataFrame:
        return group_counts(self.frames["speaker_groups"], self.frames["speaker_group_members"]).orderBy("name")

    def named(self, names: str) -> DataFrame:
        """:func:`resolve_names` of a list of names and ``@group``; an unknown group is an error."""
        for g in (t.strip()[1:] for t in names.split(",") if t.strip().startswith("@")):
            self._id(self.group(g), f"@{g}")
        f = self.frames
        one = f["speakers"].sparkSession.range(1, numPartitions=1).select(F.lit(names).alias("names"))
        return resolve_names(one, f["speaker_groups"], f["speaker_group_members"], f["speakers"])


def identify(segments: DataFrame, meeting: str, label: str, vec: str, start: str, end: str, catalog: Catalog, *, names: list[str] | None = None, high: float = vectors.HIGH, low: float = vectors.LOW) -> DataFrame:
    """``meeting, label, speaker_id, name, matched, distance, high_conf, embedding`` of every label of every meeting.

    Each label's vector is the mean of its segments' vectors by duration, matched with the enrollments of the
    catalog (of the speakers ``names`` only, where given) within ``low``.  A label that nobody matches, or without any usable
    vector, keeps its name, or is ``Unknown`` under a filter.
    """
    speakers = catalog.frames["speakers"] if not names else catalog.frames["speakers"].where(F.col("name").isin(names))
    key = F.to_json(F.struct(F.col(meeting).alias("m"), F.col(label).alias("l")))
    seg = segments.where(F.col(meeting).isNotNull() & F.col(label).isNotNull()).select(key.alias("_q"), F.col(meeting).alias(meeting), F.col(label).alias(label), F.col(vec).alias("_v"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    mean = cut(vectors.weighted_mean(seg, "_q", "_v", "_s", "_e"))  # asks twice and goes out with the result
    e = catalog.frames["enrollments"].select(F.col("id").alias("enrollment_id"), "speaker_id", "embedding")
    met = vectors.match_speaker(mean, "_q", "centroid", e, speakers, threshold=low).drop("enrollment_id")
    all_labels = seg.select("_q", meeting, label).distinct()
    out = all_labels.join(met, "_q", "left").join(mean.withColumnRenamed("centroid", "embedding"), "_q", "left")
    other = F.lit("Unknown") if names else F.col(label).cast("string")
    return out.select(
        meeting, label, "speaker_id", F.coalesce("name", other).alias("name"), F.col("name").isNotNull().alias("matched"), F.abs("distance").alias("distance"), F.coalesce(F.col("distance") <= high, F.lit(False)).alias("high_conf"), "embedding",
    )


def learn(catalog: Catalog, found: DataFrame, meeting: str, at: str) -> Catalog:
    """The catalog after :func:`identify`: what was matched with high confidence is enrolled, counted as a meeting and pruned."""
    sure = found.where("high_conf").select(
        F.md5(F.concat_ws("|", F.col(meeting).cast("string"), "speaker_id")).alias("id"), "speaker_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col(meeting).cast("string").alias("source_file"),
        F.lit("auto_identify").alias("source_type"), F.round(1 - F.col("distance"), 4).alias("confidence"), F.lit(0).alias("is_representative"), F.lit(at).alias("created_at"),
    )
    ids = [r[0] for r in sure.select("speaker_id").distinct().collect()]  # speakers of the meetings at hand
    return catalog.enroll(sure, at).seen(ids, at).pruned(at)


def expected_report(found: DataFrame, expected: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """``name, status`` of expected speakers: ``identified`` or ``missing``, and of labels that nobody was matched with: ``unidentified``."""
    got = found.where("matched").select(F.col(name).alias("name")).distinct().withColumn("_i", F.lit(True))
    want = expected.select(F.col(name).alias("name")).where("name is not null").distinct().join(got, "name", "left").select("name", F.when(F.col("_i"), "identified").otherwise("missing").alias("status"))
    return want.unionByName(found.where("not matched").select(F.col(label).cast("string").alias("name"), F.lit("unidentified").alias("status")).distinct())
