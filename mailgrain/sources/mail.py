"""Raw RFC 822 messages to rows of the message table."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from datetime import UTC
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.schemas import RAW_MAIL

# Executors receive these functions by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED = ("path string, modificationTime timestamp, sender string, subject string, "
          "content string, sent timestamp, list_unsubscribe string, error string")


def decoded(header) -> str:
    """A header as text: encoded words decoded, absent empty, undecodable as it is."""
    if not header:
        return ""
    try:
        return "".join(
            part if isinstance(part, str)
            else part.decode(charset) if charset
            else part.decode("utf-8", "ignore")
            for part, charset in decode_header(header))
    except Exception:
        return str(header)


def _text(part: Message) -> str:
    return (part.get_payload(decode=True) or b"").decode("utf-8", "ignore")


def body(message: Message) -> str:
    """All text parts that are no attachments, each followed by a line break.

    HTML parts lose their tags, but a message that is a single HTML part keeps
    them.  The charset is always read as UTF-8.
    """
    if not message.is_multipart():
        return _text(message).strip()
    lines = []
    for part in message.walk():
        kind = part.get_content_type()
        if kind not in ("text/plain", "text/html"):
            continue
        if "attachment" in str(part.get("Content-Disposition")):
            continue
        found = _text(part)
        if part.get_payload(decode=True):
            lines.append(re.sub(r"<[^>]+>", "", found) if kind == "text/html" else found)
    return "".join(line + "\n" for line in lines).strip()


def _sent(message: Message):
    try:
        when = parsedate_to_datetime(message["Date"])
        return when.astimezone(UTC).replace(tzinfo=None) if when.tzinfo else when
    except Exception:
        return None


def _parse(raw: bytes) -> tuple:
    try:
        message = message_from_bytes(raw)
        unsubscribe = message.get("List-Unsubscribe")
        return (decoded(message["From"]), decoded(message["Subject"]), body(message),
                _sent(message), None if unsubscribe is None else str(unsubscribe), None)
    except Exception as problem:
        return None, None, None, None, None, str(problem)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["sender", "subject", "content", "sent", "list_unsubscribe", "error"]
    for batch in batches:
        rows = pd.DataFrame([_parse(c) for c in batch["content"]], columns=names, index=batch.index)
        rows["sent"] = pd.to_datetime(rows["sent"], errors="coerce").dt.tz_localize("UTC")
        yield pd.concat([batch[["path", "modificationTime"]], rows], axis=1)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_raw_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(RAW_MAIL).load(path)


def parse_mail(raw: DataFrame) -> DataFrame:
    """Message rows from raw bytes; an unreadable or missing date becomes the file time.

    The uid is the file name without its extension; a numeric uid is also the
    mailbox sequence number, otherwise the file time is.
    """
    parsed = raw.select("path", "modificationTime", "content").mapInPandas(_parse_batches, PARSED)
    uid = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?\z", 1)
    seq = F.coalesce(F.col("uid").try_cast("bigint"), F.unix_micros("modificationTime"))
    return parsed.withColumn("uid", uid).select(
        "uid", seq.alias("seq"), "sender", "subject", "content",
        F.coalesce("sent", "modificationTime").alias("received_date"), "list_unsubscribe", "error")
