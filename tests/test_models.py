import json

import pandas as pd
from pyspark.sql import functions as F

from loomdoc.operators import models


def test_model_slot_loads_once_per_worker(spark):
    def load():
        calls = {"n": 0}

        def model(b: pd.DataFrame) -> pd.DataFrame:
            calls["n"] += 1
            return pd.DataFrame({"i": b["i"], "y": b["i"] * 2})

        return model

    df = spark.range(100).select(F.col("id").alias("i"))
    assert models.run_model(df, load, "i long, y long").agg(F.sum("y")).first()[0] == 9900
    assert models.run_model(df.limit(0), load, "i long, y long").count() == 0


def test_routes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(models.route_speech(F.lit(None).cast("string"), F.lit(""), F.lit("de"), F.lit(None).cast("string")))) == ("de", "qwen3-asr")
    assert tuple(one(models.route_speech(F.lit("en-GB"), F.lit("fr"), F.lit("de"), F.lit("mine")))) == ("en-GB", "mine")
    shares = F.create_map(F.lit("de"), F.lit(0.7), F.lit("fr"), F.lit(0.3))
    assert one(models.detect_language(shares, F.lit(9.0))) == "de" and one(models.detect_language(shares, F.lit(3.0))) == "en"
    assert one(models.resolve_alias(F.lit("parakeet-ctc"))) == "mlx-community/parakeet-ctc-0.6b" and one(models.resolve_alias(F.lit("x"))) == "x"
    assert tuple(one(models.route_pages(F.lit(""), F.lit(True), F.lit("read"), ocr=True))) == ("read", True)
    assert tuple(one(models.route_pages(F.lit("own"), F.lit(False), F.lit("read"), ocr=True))) == ("own", False)
    assert tuple(one(models.route_pages(F.lit("own"), F.lit(False), F.lit(""), force=True))) == ("own", False)
    assert one(models.speed(F.lit(391.27), F.lit(5.96))) == "65.6x" and one(models.is_streaming_model(F.lit("a/Streaming_Sortformer-v2")))


def test_video_metadata(spark):
    info = {"id": "abc", "title": "T", "uploader": "U", "upload_date": "20240131", "duration": 3725.0, "tags": ["a"], "chapters": [{"start_time": 61.0, "title": "C"}], "subtitles": {"en": "x"}}
    m = spark.createDataFrame([(json.dumps(info),)], "j string").select(models.video_metadata(F.col("j")).alias("m")).first().m
    assert (m.channel, m.upload_date, m.duration_human, m.subtitles) == ("U", "2024-01-31", "01:02:05", ["en"]) and m.chapters[0].time == "01:01"
