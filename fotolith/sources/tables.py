"""Sources, keyed maintenance and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of photo files (fixed values).
RAW, JPEG = ("cr2", "cr3", "nef", "arw", "raf", "rw2", "orf", "dng"), ("jpg", "jpeg")


def list_photos(spark: SparkSession, path: str, exts: tuple[str, ...] = RAW + JPEG) -> DataFrame:
    """Files below ``path`` with a photo's extension, without their contents; dot-files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*exts) & ~name.startswith(".")).orderBy("path")


def pair_raw_jpeg(files: DataFrame, key: str = "stem") -> DataFrame:
    """A stem with both kinds keeps one row, its first JPEG linked to its first RAW; else all rows stay."""
    raw, jpg = F.col("ext").isin(*RAW), F.col("ext").isin(*JPEG)
    g = files.groupBy(key).agg(F.min(F.when(jpg, F.col("photo_id"))).alias("jpg"), F.min(F.when(raw, F.col("photo_id"))).alias("raw"), F.collect_list("photo_id").alias("every"))
    both = F.col("jpg").isNotNull() & F.col("raw").isNotNull()
    return g.select(key, F.explode(F.when(both, F.array("jpg")).otherwise(F.col("every"))).alias("photo_id"), F.when(both, F.col("raw")).alias("linked_raw"))


def catalog_harvest(images: DataFrame, files: DataFrame, folders: DataFrame, roots: DataFrame, develop: DataFrame, since: str) -> DataFrame:
    """Catalog rows with their path and settings text, captured since a date."""
    j = images.join(files, images["root_file"] == files["file_id"]).join(folders, files["folder"] == folders["folder_key"]).join(roots, folders["root"] == roots["root_id"], "left").join(develop, images["image_id"] == develop["image"], "left")
    path = F.concat(F.coalesce("absolute_path", F.lit("")), F.coalesce("path_from_root", F.lit("")), F.col("base_name"), F.lit("."), F.col("extension"))
    return j.where(F.col("capture_time") >= since).select("image_id", path.alias("path"), "rating", "pick", "capture_time", "settings")


def parse_settings_blob(c: Column, fields: list[str]) -> Column:
    """``Key = number`` pairs of a settings text as a map; the last of a repeated key counts."""
    pattern = r"(\w+)\s*=\s*(-?\d+(?:\.\d+)?)"
    text = F.coalesce(c, F.lit(""))
    keys, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    last = lambda k: F.element_at(values, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int")).cast("double")
    wanted = F.array_intersect(F.array(*[F.lit(f) for f in fields]), keys)
    return F.map_from_entries(F.transform(wanted, lambda k: F.struct(k, last(k))))


def sidecar_harvest(df: DataFrame, xml: str = "packet") -> DataFrame:
    """Rating and label of XMP packets by XPath: an element before the attribute for ratings and over it
    for labels; rating 0 where nothing is said."""
    x = F.col(xml)
    node = lambda p: F.try_element_at(F.expr(f"xpath({xml}, \"{p}\")"), F.lit(1))
    rating = F.coalesce(F.when(node("//*[local-name()='Rating']/text()").rlike(r"^-?\d+$"), node("//*[local-name()='Rating']/text()")), node("//*[local-name()='Description']/@*[local-name()='Rating']"))
    label = F.coalesce(node("//*[local-name()='Label']/text()"), node("//*[local-name()='Description']/@*[local-name()='Label']"))
    return df.where(x.isNotNull()).withColumns({"rating": F.coalesce(rating.try_cast("int"), F.lit(0)), "label": label})


def incremental_worklist(files: DataFrame, cache: DataFrame, version: int = 10) -> DataFrame:
    """Files without a valid cached analysis: another version, another time, or faces without attributes."""
    ok = cache.where((F.col("version") == version) & ~((F.col("face_count") > 0) & F.coalesce(F.col("n_attrs") == 0, F.lit(True)))).select("path", "mtime")
    return files.join(ok, ["path", "mtime"], "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last write of each key wins; columns that an update lacks go back to null."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return target.unionByName(updates, allowMissingColumns=True).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def refresh_mtimes(cache: DataFrame, files: DataFrame) -> DataFrame:
    new = files.select("path", F.col("mtime").alias("_m")).groupBy("path").agg(F.max("_m").alias("_m"))
    return cache.join(new, "path", "left").withColumn("mtime", F.coalesce("_m", "mtime")).drop("_m")


def build_snapshot(decisions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Labelled rows without an error, and their linked RAW files with the same label, develop, crop and
    identities, as far as the table has these, and the columns ``carry``."""
    same = [c for c in ("label", "develop", "crop", "identities", *carry) if c in decisions.columns]
    return decisions.where("label is not null and not error").select(F.explode(F.array_compact(F.array("photo_id", "linked_raw"))).alias("photo_id"), *same)


def export_outcomes(decisions: DataFrame, mapping: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """What an export does with each photo; the label table is a dimension of a few rows."""
    j = decisions.join(mapping, "label", "left").join(existing.select("photo_id", F.col("rating").alias("has_rating")), "photo_id", "left")
    outcome = F.when(F.col("error"), "error").when(F.col("label").isNull(), "skipped").when(F.coalesce(F.col("has_rating") > 0, F.lit(False)) & F.lit(not overwrite), "skipped").otherwise("written")
    return j.withColumn("outcome", outcome)


def load_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tolerant_decode(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON decodes; the others are counted by ``df.observe`` under ``dropped``."""
    got = df.withColumn("_j", F.from_json(column, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col(column).isNull() | F.col("_j._bad").isNotNull()
    return got.observe("tolerant_decode", F.count_if(bad).alias("dropped")).where(~bad).select("*", "_j.*").drop("_j", "_bad")


def capture_state(paths: DataFrame, current: DataFrame) -> DataFrame:
    return paths.select("path").distinct().join(current.select("path", F.col("packet").alias("previous")), "path", "left")


def restore_state(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Each captured path gets its packet back, or is cleared if it had none; missing files fail."""
    j = manifest.join(current.select("path").withColumn("here", F.lit(True)), "path", "left")
    return j.withColumn("outcome", F.when(F.col("here").isNull(), "failed").when(F.col("previous").isNull(), "cleared").otherwise("restored")).drop("here")


def delivered_ingest(files: DataFrame, history: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Delivered files not yet in the history, as positives of their parent folder's scene."""
    f = files.select("path").distinct()
    for p in ignore:
        f = f.where(~F.contains(F.lower("path"), F.lit(p.lower())))
    return f.join(history.select("path"), "path", "left_anti").withColumns({"label": F.lit("positive"), "rating": F.lit(3), "pick": F.lit(1), "scene": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})


def rehydrate_session(snapshot: DataFrame, analysis: DataFrame, mapping: DataFrame) -> DataFrame:
    j = snapshot.join(analysis, "photo_id", "left").join(mapping, "label", "left")
    return j.withColumns({"stars": F.coalesce("stars", F.lit(1)), "blur_score": F.coalesce("blur_score", F.lit(0.0)), "representative": F.col("label").isin("selected", "highlighted", "recommended")})
