"""Raw mail to message rows."""

from datetime import datetime

from mailgrain.sources import mail

PLAIN = (b"From: =?utf-8?b?SsO8cmdlbg==?= <j@x.org>\r\nSubject: =?iso-8859-1?q?Caf=E9?= today\r\n"
         b"Date: Fri, 05 Jan 2024 10:00:00 +0200\r\nList-Unsubscribe: <https://x.org/u>\r\n\r\n  Hello\nthere \n")
MULTI = (b"From: a@x.org\r\nSubject: two\r\nDate: never\r\nMIME-Version: 1.0\r\n"
         b'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nfirst\r\n'
         b"--b\r\nContent-Type: text/html\r\n\r\n<p>second <b>part</b></p>\r\n"
         b"--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nhidden\r\n--b--\r\n")
HTML = b"From: a@x.org\r\nContent-Type: text/html\r\n\r\n<p>kept</p>"
LATIN = b"From: a@x.org\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\ncaf\xe9!"
BARE = b"\r\n"


def rows(spark, tmp_path, mails):
    for name, raw in mails.items():
        (tmp_path / name).write_bytes(raw)
    return {r["uid"]: r for r in mail.parse_mail(mail.read_raw(spark, str(tmp_path))).collect()}


def test_parse(spark, tmp_path):
    got = rows(spark, tmp_path, {"11.eml": PLAIN, "m2.eml": MULTI, "m3": HTML, "m4.x.eml": LATIN, "m5.eml": BARE})
    plain = got["11"]
    assert (plain["sender"], plain["subject"]) == ("Jürgen <j@x.org>", "Café today")
    assert plain["content"] == "Hello\nthere" and plain["seq"] == 11
    assert plain["received_date"] == datetime(2024, 1, 5, 8) and plain["list_unsubscribe"] == "<https://x.org/u>"
    assert got["m2"]["content"] == "first\nsecond part" and got["m2"]["list_unsubscribe"] is None
    assert got["m2"]["received_date"] is not None and got["m2"]["seq"] > 10**12
    assert got["m3"]["content"] == "<p>kept</p>" and got["m3"]["subject"] == ""
    assert got["m4.x"]["content"] == "caf!"
    assert got["m5"]["content"] == "" and got["m5"]["error"] is None


def test_undecodable_header_stays():
    assert mail.decoded("=?no-such-charset?b?SGk=?=") == "=?no-such-charset?b?SGk=?="
    assert mail.decoded(None) == "" and mail.decoded("plain") == "plain"


def test_stream_source_reads_raw_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.eml").write_bytes(PLAIN)
    stream = mail.parse_mail(mail.read_raw_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("raw_mail").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["uid"] for r in spark.table("raw_mail").collect()] == ["7"]
