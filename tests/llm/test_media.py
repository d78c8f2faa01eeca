import hashlib
import zlib

from spotflow.llm.media import decode_png, document_media, encode_png, interleaved, media_features, media_store, padded, parse_page, read_features


def test_round_trip():
    for text in [None, "", "a", "é" * 96, "x" * 192, "\x00\n" * 5000]:
        assert decode_png(encode_png(padded(text))).tobytes() == padded(text)
        assert len(padded(text)) % 192 == 0 and padded(text)


def test_documents(spark):
    texts = [None, "", "abc", "abc", "é" * 200_000, "x" * 192]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in document_media(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, raw = rows[i or None], (t or "").encode()
        p = padded(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == len(encode_png(p)) and r.media_sha256 == hashlib.sha256(encode_png(p)).hexdigest()
        assert r.caption == f"document {i or ''}".strip()
    assert rows[2].feature == rows[3].feature
    assert document_media(df.where("false")).collect() == []


def test_feature_and_file_against_loops():
    """The file as a reader of the format's specification sees it, and the feature by plain loops."""
    payload = padded("Grüße, " * 70)
    media = encode_png(payload)
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        chunks.append((media[at + 4 : at + 8], media[at + 8 : at + 8 + n]))
        assert int.from_bytes(media[at + 8 + n : at + 12 + n], "big") == zlib.crc32(media[at + 4 : at + 8 + n])
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    head = chunks[0][1]
    assert (int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), list(head[8:])) == (64, len(payload) // 192, [8, 2, 0, 0, 0])
    lines = zlib.decompress(chunks[1][1])
    assert b"".join(lines[i + 1 : i + 193] for i in range(0, len(lines), 193)) == payload and not any(lines[::193])
    sums = [sum(payload[c::3]) for c in range(3)]
    step = sum(abs(payload[i + 3] - payload[i]) for row in range(0, len(payload), 192) for i in range(row, row + 189))
    assert media_features(media)[5] == f"rgb8 64x{len(payload) // 192} sum={sums[0]},{sums[1]},{sums[2]} distinct={len(set(payload))} step={step}"


def test_one_digest_in_half_of_all_rows(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(5)
    got = document_media(df).collect()
    assert len(got) == 4000 and len({r.media_sha256 for r in got}) == 2001 and len({r.feature for r in got if r.doc_id % 2}) == 1


def test_pages_that_come_out_of_a_join(spark):
    pages = [(i, f"<p>page {i}<img src=x{i}><p>end") for i in range(600)]
    right = spark.createDataFrame([(i, "x" * 3000) for i, _ in pages], "page_id long, wide string").repartition(7)
    features = read_features(media_store(spark.createDataFrame([("abc",)], "text string")))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = interleaved(spark.createDataFrame(pages, "page_id long, html string").repartition(40).hint("merge").join(right, "page_id"), features).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 600 and all([x.text or x.ref for x in r.sequence] == [f"page {r.page_id}", f"x{r.page_id}", "end"] for r in got)


def test_order_and_captions(spark):
    digest = hashlib.sha256(padded("abc")).hexdigest()
    html = f"<head><title>t</title></head><p>one <b>two</b><figure><figcaption>cap &amp; x</figcaption><img src='sha256:{digest}'></figure>three<script>no</script><img alt='alt' src='http://x/y.png'><p>four"
    assert [(x["kind"], x["text"], x["caption"]) for x in parse_page(html)] == [("text", "one two", None), ("img", None, "cap & x"), ("text", "three", None), ("img", None, "alt"), ("text", "four", None)]
    features = read_features(media_store(spark.createDataFrame([("abc",)], "text string")))
    pages = spark.createDataFrame([(1, html), (1, html), (2, None), (3, ""), (4, "<figure><img src=q><figcaption>open")], "page_id long, html string")
    got = sorted(interleaved(pages, features).collect(), key=lambda r: r.page_id)
    assert [len(r.sequence) for r in got] == [5, 5, 0, 0, 1]
    assert [x.position for x in got[0].sequence] == list(range(5))
    assert got[0].sequence[1].payload_bytes == 192 and got[0].sequence[3].payload_bytes is None
    assert got[4].sequence[0].caption == "open"


def test_head_without_end_and_figure_without_media():
    short = lambda html: [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in parse_page(html)]
    assert short('<html><head><title>t</title><style>p {}</style><body><p>shown</p><img src="a">') == [("text", "shown", None), ("img", "a", None)]
    assert short("<head><meta charset=x><noscript><p>no</p></noscript><p>one</p></head><p>two") == [("text", "one", None), ("text", "two", None)]
    assert short("<p>a</p><figure><figcaption>table <b>one</b></figcaption><pre>1 2</pre></figure>b") == [("text", "a", None), ("text", "table one", None), ("text", "1 2", None), ("text", "b", None)]
    assert short('<figure><figcaption>c</figcaption><img src="a" alt="x"></figure><figure><figcaption>d') == [("img", "a", "c"), ("text", "d", None)]
