"""Sinks: transcripts as plain text, subtitles and documents; drafts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import store, summary

MIN_CUE_S = 0.5


def _final(segments: DataFrame) -> DataFrame:
    return segments.where(~F.coalesce(F.col("interim"), F.lit(False)) & ~X.is_blank(F.col("text")))


def _joined(rows: DataFrame, part, name: str) -> DataFrame:
    """Parts of each session in order with an empty line between."""
    listed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seg_ord", part.alias("part")))).alias("_parts"))
    return listed.select("session_id", F.array_join(F.transform("_parts", lambda x: x["part"]), "\n\n").alias(name))


def txt(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``session_id, txt``: lines '[m:ss] name: text', below the meeting summary if there is one."""
    line = F.concat(F.lit("["), X.clock(F.col("start_s")), F.lit("] "), F.col("speaker_name"), F.lit(": "), F.col("text"))
    body = _joined(store.named(_final(segments), speakers), line, "body")
    found = summary.summary(segments, "meeting")
    head = summary.summary_text(found, speakers).join(summary.sessions_with_summary(found), "session_id", "left_semi")
    sessions = segments.select("session_id").distinct()
    rows = sessions.join(body, "session_id", "left").join(head, "session_id", "left")
    text = F.coalesce("body", F.lit(""))
    whole = F.concat(F.col("summary"), F.lit("\n\n" + "=" * 40 + "\nTRANSCRIPT\n\n"), text)
    return rows.select("session_id", F.coalesce(whole, text).alias("txt"))


def cues(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``session_id, seg_ord, cue``: numbered subtitle cues of half a second at least."""
    from pyspark.sql import Window

    rows = store.named(_final(segments), speakers)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seg_ord"))
    times = F.concat(X.srt_time(F.col("start_s")), F.lit(" --> "), X.srt_time(F.greatest(F.col("end_s"), F.col("start_s") + MIN_CUE_S)))
    line = F.concat(F.col("speaker_name"), F.lit(": "), F.col("text"))
    return rows.select("session_id", "seg_ord", F.concat_ws("\n", number.cast("string"), times, line).alias("cue"))


def srt(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``session_id, srt``."""
    return _joined(cues(segments, speakers), F.col("cue"), "srt")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _run(text: str, look: str = "") -> str:
    return f'<w:r><w:rPr>{look}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def _paragraph(*runs: str, style: str = "") -> str:
    return f"<w:p><w:pPr>{style}</w:pPr>{''.join(runs)}</w:p>"


def docx_bytes(lines: list[dict]) -> bytes:
    """A Word file of lines with ``style``, ``text`` and, for transcript lines, ``name`` and ``clock``."""
    heading = lambda n: f'<w:pStyle w:val="Heading{n}"/>'
    bullet = '<w:ind w:left="360" w:hanging="180"/>'
    out = []
    for x in lines:
        if x["style"] in ("h1", "h2"):
            out.append(_paragraph(_run(x["text"], "<w:b/>"), style=heading(x["style"][1])))
        elif x["style"] == "bullet":
            owner = [_run(f" — {x['name']}", '<w:i/><w:color w:val="666666"/>')] if x["name"] else []
            out.append(_paragraph(_run(f"• {x['text']}"), *owner, style=bullet))
        elif x["style"] == "line":
            clock = _run(f"[{x['clock']}]", '<w:color w:val="888888"/><w:sz w:val="18"/>')
            out.append(_paragraph(_run(f"{x['name']} ", "<w:b/>"), clock, _run(f"  {x['text']}")))
        else:
            out.append(_paragraph(_run(x["text"])))
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(out)}</w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as file:
        for name, content in {**_PARTS, "word/document.xml": document}.items():
            file.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), content)
    return buffer.getvalue()


def docx(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``session_id, content``: Word files with the summary, but its questions, and the transcript."""
    found = store.named(summary.summary(segments, "meeting"), speakers, speaker="owner_id")
    sections = (("overview", "", "text"), ("key_points", "Key points", "bullet"), ("action_items", "Action items", "bullet"), ("decisions", "Decisions", "bullet"))
    spoken = store.named(_final(segments), speakers)
    line = lambda place, order, style, text, name, clock: F.struct(
        F.lit(place).alias("place"), order.cast("long").alias("ord"), F.lit(style).alias("style"), text.alias("text"), name.alias("name"), clock.alias("clock")
    )
    none = F.lit("")
    rows = spoken.select("session_id", line(101, F.col("seg_ord"), "line", F.col("text"), F.col("speaker_name"), X.clock(F.col("start_s"))).alias("x"))
    rows = rows.unionByName(segments.select("session_id").distinct().select("session_id", line(100, F.lit(0), "h1", F.lit("Meeting transcript"), none, none).alias("x")))
    titled = summary.sessions_with_summary(found)
    rows = rows.unionByName(titled.select("session_id", line(0, F.lit(0), "h1", F.lit("Summary"), none, none).alias("x")))
    for k, (section, title, style) in enumerate(sections):
        own = found.where(F.col("section") == section)
        name = F.col("speaker_name") if section == "action_items" else none
        rows = rows.unionByName(own.select("session_id", line(2 * k + 2, F.col("ord"), style, F.col("text"), name, none).alias("x")))
        if title:
            rows = rows.unionByName(own.select("session_id").distinct().select("session_id", line(2 * k + 1, F.lit(0), "h2", F.lit(title), none, none).alias("x")))
    listed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [docx_bytes([x if isinstance(x, dict) else x.asDict() for x in lines]) for lines in b["lines"]]
            yield pd.DataFrame({"session_id": b["session_id"], "content": content})

    return listed.mapInPandas(run, "session_id string, content binary")


def docx_texts(files: DataFrame) -> DataFrame:
    """``session_id, document``: the paragraphs of Word files, one a line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as file:
                    body = ElementTree.fromstring(file.read("word/document.xml"))
                texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{{{_W}}}t")) for p in body.iter(f"{{{_W}}}p")))
            yield pd.DataFrame({"session_id": b["session_id"], "document": texts})

    return files.select("session_id", "content").mapInPandas(run, "session_id string, document string")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One directory for each session with its text, for reading by people; :func:`write_texts` keeps many sessions."""
    rows.select("session_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("session_id").text(path)


def write_texts(rows: DataFrame, column: str, path: str) -> int:
    """Texts of any number of sessions as a session table; those that were there and aren't in ``rows`` stay."""
    return store.written_sessions(rows.select("session_id", F.col(column).alias("value")), path)


def write_drafts(drafts: DataFrame, path: str) -> bool:
    """Whether the drafts could be saved."""
    try:
        drafts.write.mode("overwrite").json(path)
        return True
    except Exception:  # storage that is full or away is an answer here
        return False
