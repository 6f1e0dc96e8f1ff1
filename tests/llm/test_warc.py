from __future__ import annotations

import base64
import hashlib
import struct

import zstandard

from dayweave.llm import warc

PAGES = "page_id long, url string, html string, key string, payload string, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], PAGES)


ROWS = [(3, "http://a/é?x=1", "same"), (1, None, "same"), (7, "http://b\r\nX: y", "same"), (4, "http://c", None), (5, "http://d", ""), (6, "u", "é" * 100_000), (8, "u", "small"), (8, "u", "small")]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in warc.archive(pages(spark, ROWS)).collect())
    first = {sha(h): min(i for i, _, g in ROWS if sha(g) == sha(h)) for _, _, h in ROWS}
    wanted = sorted((i, len((h or "").encode()), sha(h), "response" if first[sha(h)] == i else "revisit", None if first[sha(h)] == i else first[sha(h)], None) for i, _, h in ROWS)
    assert found == wanted


def test_small_payloads_are_no_revisits(spark):
    found = {r.page_id: r.record_type for r in warc.archive(pages(spark, ROWS), smallest=5).collect()}
    assert found == {1: "response", 3: "response", 7: "response", 4: "response", 5: "response", 6: "response", 8: "response"}


def test_null_keys_and_empty_table(spark):
    assert [r.page_id for r in warc.archive(pages(spark, [(None, "u", "x"), (1, "u", "x")])).collect()] == [1]
    assert warc.archive(pages(spark, [])).collect() == []


def contents(records, dictionary=b"", packed=False):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    lead = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = struct.pack("<II", warc.DICTIONARY_FRAME, len(lead)) + lead if dictionary else b""
    return head + b"".join(zstandard.ZstdCompressor(dict_data=held, write_checksum=True).compress(r) for r in records)


def test_dictionary_plain_and_packed():
    records = [warc.record(i, f"http://site/{i}", f"<p>page {i} of the same kind</p>".encode() * 5, "D", None) for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, records).as_bytes()
    for packed in (False, True):
        assert [raw for _, raw, _ in warc.frames(contents(records, dictionary, packed))] == records
    assert [raw for _, raw, _ in warc.frames(contents(records))] == records


def test_damage_is_reported_and_the_rest_is_read():
    good = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    raw = contents([good]) + b"\x28\xb5\x2f\xfdbroken" + contents([good])
    found = list(warc.frames(raw))
    assert found[0][1] == good and found[-1][1] == good and any(p for _, _, p in found)
    cut = list(warc.frames(contents([good])[:-3]))
    assert cut[0][1] is None and "frame" in cut[0][2]


def test_headers_and_lengths_are_checked():
    good = warc.record(1, "u", b"payload", "D", None)
    assert warc.parse(good)[1:] == (b"payload", None)
    for bad, word in (
        (good.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (good.replace(b"Content-Length: 7", b"Content-Length: 9"), "content-length"),
        (good.replace(b"Content-Length: 7", b"Content-Length: x"), "number"),
        (good.replace(b"WARC-Date", b"Other"), "warc-date"),
        (good.replace(b"WARC-Type: ", b"WARC-Type "), "colon"),
        (good[: good.index(b"\r\n\r\n")], "headers"),
        (good[:-2], "content-length"),
    ):
        assert word in (warc.parse(bad)[2] or "")
    assert "\r\nX:" not in warc.record(1, "http://b\r\nX: y", b"", "D", None).decode()


def test_wrong_digest_is_reported(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(contents([warc.record(1, "u", b"payload", "WRONG", None), warc.record(2, "u", b"p", warc.base32_sha1(b"p"), None)]))
    found = {r.key: r.problem for r in warc.read(spark, str(tmp_path)).collect()}
    assert found == {1: "payload digest differs", 2: None}
