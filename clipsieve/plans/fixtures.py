"""Driver tables read as the engine's domain relations, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsieve.functions.vocab import Vocabulary

NOUNS = ("gear", "gizmo", "plate", "rod", "ring", "bolt", "widget", "anvil")
#: The vocabulary of part names; anvil plays the generic noun.
PARTS = Vocabulary(nouns=NOUNS, plurals={f"{n}s": n for n in NOUNS}, generic=("anvil",))
WIDTH, HEIGHT = 15, 10
#: A frame of real size, for masks as runs.
HD_WIDTH, HD_HEIGHT = 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, questions_and_answers): an order is a video, each of its lines an item."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    noun, adjective = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    item = (
        F.when(F.col("l_quantity") == 50, F.concat(F.lit("no brackets "), "p_name"))
        .when((flag == "R") & (status == "F"), F.concat(F.lit("[CW] why did two "), "p_name", F.lit("s run -> y")))
        .when((flag == "R") & (status == "O"), F.concat(F.lit("[TN] what is the "), noun, F.lit(" in "), adjective, F.lit(" doing -> x")))
        .when((flag == "A") & (status == "F"), F.lit("[DC] where did they go -> z"))
        .when((flag == "A") & (status == "O"), F.concat(F.lit("[DL] what does the "), "p_name", F.lit(" do after the big anvil falls -> x")))
        .otherwise(F.concat(F.lit("[TN] what does the "), "p_name", F.lit(" do -> x")))
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", item.alias("item"))
    # Dealt by video before they are packed: lists that are begun in each task are sorted and moved as often.
    rows = line.join(part, "l_partkey").repartition("l_orderkey").select(F.col("l_orderkey").alias("video"), order.alias("o"))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["item"]), " ||| ")
    return rows.groupBy("video").agg(packed.alias("questions_and_answers"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame_idx, event_type, score, value): a user's events in order of time are a video's frames."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video"), idx.cast("long").alias("frame_idx"), "event_type", F.least(F.col("value") / 200.0, F.lit(1.0)).alias("score"), "value")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))


def masks(spark: SparkSession, sf_dir: str, by: str = "day") -> DataFrame:
    """(frame, obj, px): days or hours are frames, event types objects, user ids pixels of a 15 by 10 image."""
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hours = F.timestamp_diff("HOUR", start, F.date_trunc("hour", "ts").cast("timestamp_ntz")).cast("long")
    frame = F.floor(hours / 24).cast("long") if by == "day" else hours
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    obj = F.array_position(kinds, F.col("event_type")).cast("int")
    px = F.pmod("user_id", F.lit(WIDTH * HEIGHT)).cast("long")
    return e.select(frame.alias("frame"), obj.alias("obj"), px.alias("px")).distinct()


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, prompt_word, frame_count, input_pos, status): orders as the prompt mapping."""
    o = table(spark, sf_dir, "orders")
    prompt = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), prompt.alias("prompt_word"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("frame_count"), F.col("o_orderkey").alias("input_pos"), "o_orderstatus")


def video_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(key.alias("video_id"), F.concat(F.lit("/videos/"), key, F.lit(".mp4")).alias("path")).distinct()


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("video_id"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, det, score, px): a day is a video, its hours are frames, event types detections with made-up scores."""
    m = masks(spark, sf_dir, "hour")
    video, frame, det = F.floor(F.col("frame") / 24).cast("long"), F.col("frame") % 24, F.col("obj") - 1
    return m.select(video.alias("video"), frame.alias("frame"), det.alias("det"), (((frame * 7 + det * 13 + video) % 20) / 20.0).alias("score"), "px")


def detected_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, n): as many frames as the last detection needs."""
    return detections(spark, sf_dir).groupBy("video").agg((F.max("frame") + 1).alias("n"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame_idx, h, w, rgb): a picture of made-up colours for each day with masks, a week one video."""
    days = masks(spark, sf_dir).select("frame").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))))
    value = lambda k: (F.col("px") * k + F.col("frame")) % 256
    sign = F.format_string("%02x%02x%02x", value(7), value(11), value(13))
    rgb = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("px", sign.alias("s")))), lambda x: x["s"]), ""))
    rows = days.groupBy("frame").agg(rgb.alias("rgb"))
    return rows.select(F.floor(F.col("frame") / 7).cast("long").alias("video"), F.col("frame").alias("frame_idx"), F.lit(HEIGHT).alias("h"), F.lit(WIDTH).alias("w"), "rgb")


def picture_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, obj, px): the masks of the pictures."""
    return masks(spark, sf_dir).withColumn("video", F.floor(F.col("frame") / 7).cast("long"))


def hd_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, obj, y, x0, x1): an hour is a frame of real size, four kinds of users and five types of events are objects.

    Each event is a spot of 6 to 16 ragged lines, 20 to 60 pixels wide, at a place made up from its numbers. Not merged.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    frame = F.timestamp_diff("HOUR", start, F.date_trunc("hour", "ts").cast("timestamp_ntz")).cast("long")
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    obj = F.array_position(kinds, F.col("event_type")).cast("long") + 5 * (F.col("user_id") % 4)
    high, wide = 6 + F.col("user_id") % 11, 20 + F.col("event_id") % 41
    left, top = (F.col("user_id") * 7919 + F.col("event_id") * 104_729) % (HD_WIDTH - 70), (F.col("user_id") * 6_007 + F.col("event_id") * 75_011) % (HD_HEIGHT - 20)
    spots = e.select(frame.alias("frame"), obj.alias("obj"), left.alias("x"), top.alias("y"), wide.alias("w"), high.alias("h"))
    # Dealt by frame as spots: their lines are ten times as many rows.
    spots = spots.repartition("frame").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    x0 = F.col("x") + F.col("k") * F.col("k") % 5
    return spots.select("frame", "obj", (F.col("y") + F.col("k")).alias("y"), x0.alias("x0"), (x0 + F.col("w") - F.col("k") % 3).alias("x1"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, content): an MP4 file without pictures for each part, its frames and size made up; each 13th is cut off."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("n"), (F.col("p_size") * 16).alias("w"), (F.col("p_size") * 9).alias("h"))
    zeros = lambda n: "00" * n
    head = "000000106674797069736f6d00000000" "000000ec6d6f6f76" "000000e47472616b" "0000005c746b6864" + zeros(12) + "00000001" + zeros(60)
    mdia = "000000806d646961" "0000001c6d646864" + zeros(12) + "00007530%08x" "0000002068646c72" + zeros(8) + "76696465" + zeros(12)
    table_ = "0000003c6d696e66" "000000347374626c" "0000001873747473" "0000000000000001%08x000003e9" "000000147374737a" "0000000000000001%08x"
    n = F.col("n").cast("int")
    text = F.format_string(head + "%04x0000%04x0000" + mdia + table_, F.col("w").cast("int"), F.col("h").cast("int"), n * 1001, n, n)
    whole = F.unhex(text)
    return p.select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, F.substring(whole, 1, 200)).otherwise(whole).alias("content"))
