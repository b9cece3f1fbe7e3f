"""Readers and writers of the file forms (SRC1-SRC16, SNK1, SNK2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import to_centre
from ..operators.projection import every_nth_frame
from ..operators.windows import global_rank

MOT = "frame int, track_id bigint, x double, y double, w double, h double, conf double, a double, b double, c double"
DETECTIONS = "frame int, x double, y double, w double, h double, conf double"


def _sequence() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]+)?$", 1)


def mot(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC1, SRC3: tracks with feet and box centre; a frame window is filtered in the scan."""
    rows = spark.read.schema(MOT).csv(path).where("frame is not null").withColumn("seq", _sequence())
    if first is not None:
        rows = rows.where(F.col("frame") >= first)
    if last is not None:
        rows = rows.where(F.col("frame") <= last)
    return rows.select("seq", "frame", "track_id", "x", "y", "w", "h", "conf", (F.col("x") + F.col("w") / 2).alias("foot_x"), (F.col("y") + F.col("h")).alias("foot_y"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))


def detections(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: cached detections by their centre."""
    rows = spark.read.schema(DETECTIONS).csv(path).where("frame is not null").withColumn("seq", _sequence())
    return rows.select("seq", "frame", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), "w", "h", "conf")


def game_state(spark: SparkSession, path: str, categories: tuple[int, ...] = (1, 2)) -> DataFrame:
    """SRC4: annotations of nested game-state JSON with their frame, of the categories asked for."""
    box = "struct<x:double,y:double,w:double,h:double>"
    schema = f"images array<struct<image_id:string,file_name:string>>, annotations array<struct<image_id:string,track_id:bigint,category_id:int,bbox_image:{box},bbox_pitch:struct<x_bottom_middle:double,y_bottom_middle:double>,attributes:struct<team:string,role:string>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("seq", _sequence())
    images = doc.select("seq", F.explode("images").alias("i")).select("seq", "i.image_id", F.regexp_extract("i.file_name", r"(\d+)", 1).cast("int").alias("frame"))
    rows = doc.select("seq", F.explode("annotations").alias("a")).select("seq", "a.*").where(F.col("category_id").isin(*categories))
    return rows.join(images, ["seq", "image_id"]).select("seq", "frame", "track_id", "category_id", "bbox_image.*", "bbox_pitch.*", "attributes.*")


def action_frame(position_ms: Column, clip_start_ms: Column, fps: float = 25.0) -> Column:
    """SRC5: frame of an action, halves to even."""
    return F.bround((position_ms - clip_start_ms) / 1000 * fps).cast("bigint")


def sensors(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: sensor samples; lines that don't parse go."""
    raw = spark.read.option("mode", "PERMISSIVE").csv(path)
    rows = raw.select(F.coalesce(F.try_to_timestamp("_c0", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp("_c0", F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"), *[F.expr(f"try_cast({c} as {t})").alias(n) for c, n, t in (("_c1", "tag", "bigint"), ("_c2", "x", "double"), ("_c3", "y", "double"), ("_c7", "speed", "double"))])
    return rows.where("ts is not null and tag is not null and x is not null and y is not null").sort("ts")


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: lines of exactly five tokens."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("image", _sequence()).withColumn("t", t).where("size(t) = 5")
    return rows.select("image", F.col("t")[0].cast("double").cast("int").alias("cls"), *[F.col("t")[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def sequence_info(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: key=value lines of one ini file for each sequence."""
    text = spark.read.text(path, wholetext=True)
    m = F.str_to_map(F.regexp_replace("value", r"(?m)^\[.*\]\s*|\r", ""), F.lit("\n"), F.lit("="))
    rows = text.select(m.alias("m"))
    return rows.select(F.trim(F.col("m")["name"]).alias("seq"), *[F.expr(f"try_cast(m['{k}'] as {t})").alias(n) for k, n, t in (("seqLength", "n_frames", "int"), ("imWidth", "width", "int"), ("imHeight", "height", "int"), ("frameRate", "fps", "double"))])


def annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: boxes of ball tracks that aren't outside the picture."""
    rows = spark.read.format("xml").option("rowTag", "track").load(path)
    boxes = rows.where(F.col("_label") == "ball").select(F.explode("box").alias("b")).where(F.col("b._outside").cast("int") == 0)
    return boxes.select(F.col("b._frame").cast("int").alias("frame"), *[F.col(f"b._{k}").cast("double").alias(k) for k in ("xtl", "ytl", "xbr", "ybr")])


def retimed_ball(spark: SparkSession, path: str, ratio: float) -> DataFrame:
    """SRC11: ball places keyed by source frame, on the frames of the tracks; the last of several wins."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("src", "p")).select(F.col("src").cast("bigint").alias("src"), "p")
    rows = rows.withColumn("frame", F.bround(F.col("src") / ratio).cast("bigint"))
    return rows.groupBy("frame").agg(F.max_by("p", "src").alias("p")).select("frame", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("conf"))


def class_code(name: Column) -> Column:
    """SRC13: 0 for a ball, 1 for people, null for the rest."""
    low = F.lower(name)
    return F.when(low.contains("ball"), 0).when(low.rlike("player|goalkeeper|referee|person"), 1)


def write_mot(tracks: DataFrame, path: str) -> None:
    """SNK1: one folder for each sequence, rows by frame and track."""
    tracks.repartition("seq").sortWithinPartitions("seq", "frame", "track_id").select("seq", mot_line().alias("value")).write.mode("overwrite").partitionBy("seq").text(path)


def unseen(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SRC14: what is listed, once, and not done yet."""
    return listed.distinct().join(done, key, "left_anti")


def ball_truth(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: true ball places, from a JSON map of frames to points or from lines of frame, x and y parted by commas or blanks; lines that don't parse go."""
    text = spark.read.text(path, wholetext=True)
    places = F.from_json("value", "map<string,array<double>>")
    asis = text.where(F.ltrim("value").startswith("{")).select(F.explode(places).alias("k", "p")).select(F.expr("try_cast(k as bigint)").alias("frame"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    lines = text.where(~F.ltrim("value").startswith("{")).select(F.explode(F.split("value", r"\r?\n")).alias("line"))
    t = F.split(F.trim(F.regexp_replace("line", ",", " ")), r"\s+")
    parts = lines.select(t.alias("t")).where("size(t) >= 3").select(F.expr("cast(try_cast(t[0] as double) as bigint)").alias("frame"), F.expr("try_cast(t[1] as double)").alias("x"), F.expr("try_cast(t[2] as double)").alias("y"))
    return asis.unionByName(parts).where("frame is not null and x is not null and y is not null")


def annotated_images(boxes: DataFrame, listing: DataFrame) -> DataFrame:
    """SRC9: every listed image (frame, image, width, height) with its ball box, normalised, or without one."""
    b = boxes.groupBy("frame").agg(F.min(F.struct("xtl", "ytl", "xbr", "ybr")).alias("b"))
    rows = listing.join(b, "frame", "left")
    return rows.select("frame", "image", ((F.col("b.xtl") + F.col("b.xbr")) / 2 / F.col("width")).alias("cx"), ((F.col("b.ytl") + F.col("b.ybr")) / 2 / F.col("height")).alias("cy"), ((F.col("b.xbr") - F.col("b.xtl")) / F.col("width")).alias("w"), ((F.col("b.ybr") - F.col("b.ytl")) / F.col("height")).alias("h"))


def reindexed(rows: DataFrame, track: str, frame: str, name: str) -> DataFrame:
    """SRC12: gapless track numbers from 1 in the order in which tracks are first seen."""
    first = rows.groupBy(track).agg(F.min(frame).alias("__first"))
    return rows.join(global_rank(first, ["__first", track], name).drop("__first"), track)


def to_yolo(boxes: DataFrame, width: float, height: float, stride: int, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """SRC12: boxes of every ``stride``-th frame, normalised; those without extent go."""
    cx, cy, w, h = to_centre("x", "y", "w", "h", width, height)
    rows = every_nth_frame(boxes, keys, "frame", stride).where("w > 0 and h > 0")
    return rows.withColumns({"cx": cx, "cy": cy, "nw": w, "nh": h}).drop("x", "y", "w", "h").withColumnsRenamed({"nw": "w", "nh": "h"})


def train_or_val(seq: Column, val: list[str]) -> Column:
    """SRC12: which part of the data a sequence belongs to."""
    return F.when(seq.isin(*val), "val").otherwise("train")


def split_listing(paths: DataFrame, root: str, split: str) -> DataFrame:
    """SRC16: images and labels of a split, laid out as ``split/images`` or as ``images/split``; the first layout wins where both are there."""
    rel = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    rows = paths.where(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("rel", rel)
    kind = F.when(F.col("rel").rlike(f"^{split}/(images|labels)/"), 1).when(F.col("rel").rlike(f"^(images|labels)/{split}/"), 2)
    rows = rows.withColumn("layout", kind).where("layout is not null")
    best = rows.agg(F.min("layout").alias("__best"))
    what = F.regexp_extract("rel", r"(images|labels)/", 1)
    return rows.join(best, F.col("layout") == F.col("__best")).select("path", what.alias("what"), F.regexp_extract("rel", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"))


def write_records(rows: DataFrame, path: str, form: str, order: tuple[str, ...] = ("frame", "track_id")) -> None:
    """SNK1: JSON, CSV or Parquet, a folder for each sequence, its rows in order."""
    rows.repartition("seq").sortWithinPartitions("seq", *order).write.mode("overwrite").partitionBy("seq").format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


def mot_line() -> Column:
    """SNK1: a row in the text form of tracks."""
    f = lambda c: F.format_string("%.2f", F.col(c))
    return F.concat_ws(",", F.col("frame").cast("string"), F.col("track_id").cast("string"), f("x"), f("y"), f("w"), f("h"), f("conf"), F.lit("-1,-1,-1"))


def stream_mot(tracks: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """SNK2: a stream of track rows as text files by sequence, written at every trigger, or once for all that has arrived; returns the running query."""
    out = tracks.select("seq", mot_line().alias("value")).writeStream.format("text").partitionBy("seq").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
