import base64
import hashlib

from tablescope.llm.warc import archived_pages, read_archive, record_bytes, write_archive

BODIES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, "<p>one</p>"),
          (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "<p>one</p>"), (6, "http://a/6", "<p>one</p>"),
          (None, "http://a/7", "x" * 200_000), (8, "http://a/8", "x" * 200_000)]


def digest(body):
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


def test_digests_and_references(spark):
    pages = spark.createDataFrame([(*r, 7, "z") for r in BODIES], "page_id bigint, url string, html string, bytes int, address string")
    got = archived_pages(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len((b or "").encode()), digest(b)) for i, _, b in BODIES)
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[1] == [("revisit", 6)] == kinds[3] and sorted(kinds[6]) == [("response", None), ("revisit", 6)]
    assert kinds[2] == [("response", None)] and kinds[4] == [("revisit", 5)] and kinds[None] == [("revisit", 8)]
    assert archived_pages(pages.where("false")).collect() == []


def test_records_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame(BODIES, "page_id bigint, url string, html string")
    write_archive(pages, f"{tmp_path}/w", min_bytes=5)
    records = read_archive(spark, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 4  # each payload once
    for r in record_bytes(records).collect():
        head, _, rest = r.record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert rest[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        body = next(b for i, _, b in BODIES if i == r.id) or ""
        if fields[b"WARC-Type"] == b"response":
            assert rest[:size] == body.encode()
        else:
            assert size == 0 and b"WARC-Refers-To" in fields
        assert fields[b"WARC-Payload-Digest"].decode() == f"sha1:{digest(body)}"
    small = [r.record_type for r in records.where("payload_bytes < 5").collect()]
    assert small == ["response"] * 2  # below the least size nothing is a revisit
    whole = {r.id: bytes(r.payload).decode() for r in records.collect()}
    assert all(whole[i] == (b or "") for i, _, b in BODIES)


def test_urls_and_text_ids_forge_no_header(spark):
    forged = "u\r\nWARC-Refers-To: <urn:page:99>\r\nWARC-Type: revisit"
    rows = [("a>\r\nb %41", forged, "x"), ("a", "http://a/ b\u007f", "x"), ("+z", "v", "y"), ("+z%2B", "v", "y"), ("", None, "w")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in archived_pages(pages).collect()}
    assert got == {"a>\r\nb %41": ("response", None), "a": ("revisit", "a>\r\nb %41"), "+z%2B": ("response", None),
                   "+z": ("revisit", "+z%2B"), "": ("response", None)}
    numbers = spark.createDataFrame([(1, forged, "x"), (2, forged, "y")], "page_id bigint, url string, html string")
    assert [(r.record_type, r.refers_to) for r in archived_pages(numbers).collect()] == [("response", None)] * 2
