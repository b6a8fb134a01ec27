"""Queries on documents, e-mails and transcripts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.leakage import leaked_items
from loomdoc.llm.lookalike import lookalike_classes, lookalike_pairs
from loomdoc.llm.newmail import new_lines
from loomdoc.llm.packing import fill, pack
from loomdoc.llm.turns import speaker_turns
from loomdoc.session import table


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same links in one row a document: its class and how many strings and documents the class has."""
    return lookalike_classes(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    mails = table(spark, sf, "emails").select("email_id", "message_id", "in_reply_to", "msg_from", "body")
    return new_lines(mails).select("email_id", "line_no").distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "transcript_segments").select("seg_id", "clip_id", "start_s", "end_s", "speaker", "text")
    turns = speaker_turns(segments, table(spark, sf, "clip_speakers"))
    return turns.where("speaker_no is not null").select("clip_id", "first_seg", "speaker_no", "n_words").distinct()


def p6_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns split at long pauses as well, with their times and text."""
    segments = table(spark, sf, "transcript_segments").select("seg_id", "clip_id", "start_s", "end_s", "speaker", "text")
    turns = speaker_turns(segments, table(spark, sf, "clip_speakers"), pauses=True)
    return turns.select("clip_id", "first_seg", "speaker_no", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n_words", F.md5("text").alias("text_md5"))


#: The tokenizer's vocabulary file; a parameter, never part of this repository.
VOCABULARY = os.environ.get("LOOMDOC_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", VOCABULARY, capacity=2048)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each bucket are."""
    return fill(p8_pack(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items").select("item_id", "passage")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "passage", n_words=12)


def p9_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with twelve words of a passage in which one character may be altered, missing or too many."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items").select("item_id", "passage")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "passage", n_words=12, edits=1)


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p6_turns": p6_turns, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p9_edits": p9_edits, "p10_found": p10_found, "p10_classes": p10_classes}
SQL: dict[str, str] = {}


def _form_sql(column: str) -> str:
    """The canonical form in SQL, written for itself: what the statement counts as looking the same, as literals."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", ""), "".join(map(chr, range(0x21, 0x7F))).replace("'", "")
    twins = "АВЕЅІЈКМНОРСТХаеѕіјорсхԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΧοινϲϳУуΥёЁѐЀїЇӓӒӧӦӑӐӗӖ", "ABESIJKMHOPCTXaesijopcxdqwhlABEZHIKMNOPTXoivcjYyYëËèÈïÏäÄöÖăĂĕĔ"
    text = f"regexp_replace({column}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{115F}}\\x{{1160}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}\\x{{E0000}}-\\x{{E0FFF}}]', '', 'g')"
    text = f"regexp_replace({text}, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    text = f"regexp_replace({text}, '[\\x{{2010}}\\x{{2011}}\\x{{FE63}}\\x{{FF0D}}]', '-', 'g')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("＇", "''"), ("µ", "μ")):
        text = f"replace({text}, '{a}', '{b}')"
    return f"nfc_normalize(translate(nfc_normalize(translate({text}, '{wide[0]}', '{wide[1]}')), '{twins[0]}', '{twins[1]}'))"


SQL["p10_found"] = f"""
WITH f AS (SELECT doc_id, text, {_form_sql("text")} AS form FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.form <> ''"""

SQL["p9_found"] = f"""
WITH t AS (
  SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(regexp_replace({_form_sql("text")}, '</?[a-zA-Z][^<>]{{0,200}}>|&(?:nbsp|amp|lt|gt|quot|#[0-9]+);', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text <> ''
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower({_form_sql("passage")}), '[\\p{{L}}\\p{{N}}]+') FROM eval_items),
g AS (SELECT k, id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT k, id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.k = 'd' AND i.k = 'i'"""

SQL["p10_classes"] = f"""
WITH f AS (SELECT doc_id, text, {_form_sql("text")} AS form FROM documents WHERE text <> ''),
c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_strings, CAST(count(*) AS BIGINT) AS n_documents FROM f WHERE form <> '' GROUP BY form HAVING count(DISTINCT text) > 1)
SELECT doc_id, class_id, n_strings, n_documents FROM f JOIN c USING (form)"""
