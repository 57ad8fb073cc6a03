import json

from quarry.llm.warc import build_record, derivatives, derive, digest, parse_record, plain_text, response_record, responses

PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><p>a &amp; b<br>c</p><!-- x --><div>d  <b>e</b></div></body></html>"


def test_plain_text():
    assert plain_text(PAGE) == "T\na & b\nc\nd e"
    assert plain_text("") == "" and plain_text("1 < 2") == "1 < 2"


def test_records_link_and_keep_the_source():
    raw = response_record(5, "http://x.example/é?a=1", PAGE, "2024-01-01T00:00:00Z")
    headers, block = parse_record(raw)
    source = dict(headers)
    assert source["WARC-Block-Digest"] == digest(block) and source["WARC-Payload-Digest"] == digest(PAGE.encode())
    metadata, conversion = derive(raw)
    for row in (metadata, conversion):
        own, body = parse_record(row["record"])
        own = dict(own)
        assert own["WARC-Refers-To"] == source["WARC-Record-ID"] == row["refers_to"]
        assert own["WARC-Target-URI"] == "http://x.example/é?a=1" and own["WARC-Date"] == source["WARC-Date"]
        assert own["WARC-Block-Digest"] == digest(body) == row["block_digest"] and own["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
    about = json.loads(parse_record(metadata["record"])[1])
    assert about["conversion"] == conversion["record_id"] and [list(h) for h in headers] == about["source-headers"]
    assert parse_record(conversion["record"])[1].decode() == plain_text(PAGE)
    assert derive(raw) == derive(raw)


def test_a_table_with_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 1), (3, "u", "x" * 200_000, 1)], "page_id long, url string, html string, record int")
    made = derivatives(responses(pages)).collect()
    assert len(made) == 8 and {r.record_type for r in made} == {"metadata", "conversion"}
    assert derivatives(responses(pages.limit(0))).count() == 0
    broken = response_record(1, "u", "x", "d").replace(b"\r\n\r\nx", b"\r\n\r\ny")
    odd = spark.createDataFrame([(1, b""), (2, None), (3, broken), (4, build_record("request", [], b""))], "id long, record binary")
    got = {r.id: (r.record_type, r.reason) for r in derivatives(odd).collect()}
    assert all(t == "invalid" and why for t, why in got.values()) and "digest" in got[3][1]


def test_two_captures_of_a_page_differ_and_broken_markup_is_linear(spark):
    import time

    pages = spark.createDataFrame([(1, "http://h/", "<p>a", 9), (1, "http://h/", "<p>b", 9), (None, None, None, 9), (2, "http://h/", "<!" * 300_000, 9)], "page_id long, url string, html string, record long")
    began = time.time()
    rows = derivatives(responses(pages)).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 8 and time.time() - began < 60
    assert plain_text("a<!-- open <p>x") == "a" and plain_text("<b>x</b> 1 < 2 <!-- t") == "x 1 < 2" and plain_text("a<script>q</script>c<p>d") == "a c\nd"
