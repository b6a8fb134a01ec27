"""Slots for models: the contract around an inference call, with the routing before and after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which speech models may be called, what English and other speech goes to, and the bounds of language detection.
ALIASES = {
    "parakeet-v3": "mlx-community/parakeet-tdt-0.6b-v3", "parakeet-v2": "mlx-community/parakeet-tdt-0.6b-v2", "parakeet-1.1b": "mlx-community/parakeet-tdt-1.1b",
    "parakeet-ctc": "mlx-community/parakeet-ctc-0.6b", "qwen3-asr": "mlx-community/Qwen3-ASR-1.7B-bf16", "qwen3-asr-bf16": "mlx-community/Qwen3-ASR-1.7B-bf16",
    "qwen3-asr-8bit": "mlx-community/Qwen3-ASR-1.7B-8bit", "qwen3-asr-4bit": "mlx-community/Qwen3-ASR-1.7B-4bit",
}
ENGLISH_MODEL, OTHER_MODEL = "parakeet-v3", "qwen3-asr"
LEAST_SECONDS, LEAST_SHARE = 5.0, 0.5


def run_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a model that ``load`` brings up once per worker; batches are Arrow-sized.

    The engine ships no weights: ``load`` is the user's, and the tests use a stand-in.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(scan, schema)


def resolve_alias(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), name), name)


def detect_language(shares: Column, seconds: Column) -> Column:
    """The most probable language of a map of shares; English for short clips and uncertain ones."""
    top = F.array_max(F.transform(F.map_entries(shares), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    return F.when((seconds < LEAST_SECONDS) | (top["p"] < LEAST_SHARE) | top.isNull(), "en").otherwise(top["k"])


def route_speech(flag: Column, stated: Column, detected: Column, model_flag: Column) -> Column:
    """Language by flag, metadata, then detection; the model by flag, else by language."""
    lang = F.coalesce(F.nullif(flag, F.lit("")), F.nullif(stated, F.lit("")), detected)
    model = F.coalesce(F.nullif(model_flag, F.lit("")), F.when(lang.startswith("en"), ENGLISH_MODEL).otherwise(OTHER_MODEL))
    return F.struct(lang.alias("language"), model.alias("model"))


def is_streaming_model(name: Column) -> Column:
    return F.lower(name).contains("streaming_sortformer")


def route_pages(text: Column, is_thin: Column, read: Column, *, ocr: bool = False, force: bool = False) -> Column:
    """Text and origin of a page: what was read from the image if the page is routed there and anything was read, else its own text."""
    wanted = F.lit(force) | (F.lit(ocr) & F.coalesce(is_thin, F.lit(False)))
    used = wanted & F.coalesce(read != "", F.lit(False))
    return F.struct(F.when(used, read).otherwise(text).alias("text"), used.alias("ocr_used"))


def reader_prompt(page: Column, limit: int = 200_000) -> Column:
    return F.concat(F.lit("Convert the following HTML to Markdown:\n\n"), F.substring(page, 1, limit))


def video_metadata(info: Column) -> Column:
    """Typed fields of a video's JSON: dates and durations in readable form, chapters, caption languages."""
    schema = "id string, title string, channel string, uploader string, upload_date string, duration double, language string, view_count bigint, like_count bigint, categories array<string>, tags array<string>, chapters array<struct<start_time: double, title: string>>, subtitles map<string, string>, automatic_captions map<string, string>, description string"
    v = F.from_json(info, schema)
    from loomdoc.functions.meta import clock

    d = v["upload_date"]
    return F.struct(
        v["title"].alias("title"), v["id"].alias("video_id"), F.coalesce(v["channel"], v["uploader"]).alias("channel"),
        F.when(d.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(d).alias("upload_date"),
        v["duration"].alias("duration"), clock(v["duration"]).alias("duration_human"), v["language"].alias("language"), v["view_count"].alias("view_count"),
        v["categories"].alias("categories"), v["tags"].alias("tags"), F.map_keys(v["subtitles"]).alias("subtitles"), F.map_keys(v["automatic_captions"]).alias("auto_captions"),
        F.transform(v["chapters"], lambda c: F.struct(clock(c["start_time"]).alias("time"), c["title"].alias("title"))).alias("chapters"), v["description"].alias("description"),
    )


def repo_totals(files: DataFrame, path: str, content: str) -> DataFrame:
    """One row: files, characters and words (the stand-in for tokens) of a source tree."""
    return files.agg(F.count(path).alias("n_files"), F.sum(F.length(content)).alias("n_chars"), F.sum(F.size(F.regexp_extract_all(content, F.lit(r"\S+"), 0))).alias("n_words"))


def speed(audio_s: Column, taken_s: Column) -> Column:
    """Multiple of real time, one decimal, with an ``x``."""
    return F.concat(F.format_number(audio_s / taken_s, 1), F.lit("x"))
