import base64
import hashlib
import re

from meterflow.llm import warc

PAGE = ('<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no -->'
        '<p>One  <b>two</b><br>three &eacute;&#233;&#xe9;</p><a href="/x?a=1&amp;b=2">link</a><p>x < y</p></body></html>')


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nOne two\nthree ééé\nlink\nx < y"


def test_linked_records(spark, tmp_path):
    rows = [(1, "http://a.example/x", PAGE, "k"), (2, None, None, "k"), (3, "http://b.example/", "", None),
            (4, "u", "long <p>" * 20_000, "k"), (1, "http://a.example/x", PAGE, "k"), (None, "n", "<p>t", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    source = warc.responses(pages)
    records = warc.build_derivatives(source, keep=("page_id",))
    responses = {r.record_id: r for r in source.collect()}
    got = records.collect()
    assert len(got) == 12 and len({r.record_id for r in got}) == 10  # the repeated page repeats its records
    for r in got:
        response = responses[r.refers_to]
        block = r.block.encode()
        assert r.block_digest == sha(block) and r.length == len(block)
        assert r.source_digest == sha((response.payload or "").encode())
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == response.record_id and fields["WARC-Type"] == r.kind
        assert int(fields["Content-Length"]) == len(block) and rest == r.block + "\r\n\r\n"
        if r.kind == "metadata":
            assert "source-header: HTTP/1.1 200 OK" in r.block and r.source_digest in r.block
        else:
            assert r.block == warc.plain_text(response.payload or "")
    first = next(r for r in got if r.page_id == 1 and r.kind == "metadata")
    assert "title: A & B\r\n" in first.block and "outlink: /x?a=1&b=2\r\n" in first.block
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id) for r in got)
    warc.write_warc(records, str(tmp_path / "out"))
    written = b"".join(x.content for x in spark.read.format("binaryFile").load(str(tmp_path / "out/*.gz")).select("content").collect())
    import gzip

    assert sorted(gzip.decompress(written).decode().split("WARC/1.1\r\n")[1:]) == sorted(
        r.record.removeprefix("WARC/1.1\r\n") for r in got)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.build_derivatives(warc.responses(pages)).count() == 0
