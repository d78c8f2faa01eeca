"""Media columns: pages become ordered text and media references, references find their payloads by digest.

Payloads are kept losslessly as PNG images of 64 RGB pixels a row (192 payload bytes). A page is parsed to
structs in reading order; each media struct carries its digest and caption with its position, so that the
join which resolves payloads can bring rows in any order.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, numbered, stored

#: Payload bytes in one image row; a payload is padded with blanks to a positive multiple of it.
ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PREFIX = "sha256:"
ITEM = "position int, kind string, text string, ref string, caption string"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def padded_column(text: Column) -> Column:
    """The same, as a column."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / ROW), F.lit(1)) * ROW
    return F.rpad(raw, size.cast("int"), F.lit(b" "))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """8-bit RGB, 64 pixels wide, every row unfiltered."""
    height = len(payload) // ROW
    if not height or len(payload) % ROW:
        raise ValueError(f"{len(payload)} bytes fill no rows of {ROW}")
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Rows of payload bytes; every chunk's checksum is verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, height = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind.decode()} chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width * 3, depth, colour) != (ROW, 8, 2):
                raise ValueError("not 64 pixels of 8-bit RGB")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def image_feature(rows: np.ndarray) -> str:
    """Size, channel sums, distinct values and summed absolute horizontal differences, all whole numbers."""
    pixels = rows.reshape(rows.shape[0], ROW // 3, 3)
    sums = pixels.sum(axis=(0, 1), dtype=np.int64)
    steps = int(np.abs(np.diff(pixels.astype(np.int16), axis=1)).sum(dtype=np.int64))
    distinct = int(np.count_nonzero(np.bincount(rows.ravel(), minlength=256)))
    return f"rgb8 64x{rows.shape[0]} sum={','.join(map(str, sums.tolist()))} distinct={distinct} step={steps}"


def media_features(media: bytes) -> tuple:
    rows = decode_png(media)
    payload = rows.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(rows)


def media_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest (SHA-256 of the padded payload) and media (PNG) of every distinct text; a null text is empty.

    A task encodes equal texts once; equal texts of different tasks give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, media = [], []
            for x in batch.column(0).to_pylist():
                payload = padded(x)
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(encode_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return map_rows(docs.select(text), run, "digest string, media binary", rows=500)


def read_features(store: DataFrame) -> DataFrame:
    """One row of features for each digest of a stored media table, computed from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            found = [media_features(m) for m in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["digest", *(f.split()[0] for f in FEATURES.split(", "))])

    made = map_rows(store.select("digest", "media"), run, f"digest string, {FEATURES}", rows=500)
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return made.groupBy("digest").agg(*(F.first(n).alias(n) for n in names))


class Sequence(HTMLParser):
    """Reading order of a page: text runs between block tags, and media with the captions of their figures."""

    BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th tr ul".split())
    HIDDEN = frozenset("script style template noscript head".split())
    #: What a head can hold; any other tag ends one whose end tag is left out.
    IN_HEAD = frozenset("html head title base meta link script style noscript template".split())
    MEDIA = {"img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "object": "data"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden == ["head"] and tag not in self.IN_HEAD:
            self.hidden.pop()
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in self.MEDIA:
            named = dict(attrs)
            if ref := named.get(self.MEDIA[tag]):
                self.flush()
                self.items.append({"kind": tag, "text": None, "ref": ref, "caption": named.get("alt") or named.get("title")})
                if self.figures:
                    self.figures[-1]["media"].append(self.items[-1])
        elif tag in self.BLOCK:
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "caption": None, "texts": []})
            elif tag == "figcaption" and self.figures:
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in self.BLOCK:
            if self.caption is not None and tag in ("figcaption", "figure"):
                self.figures[-1]["caption"] = " ".join("".join(self.caption).split()) or None
                self.caption = None
                if text := self.figures[-1]["caption"]:
                    self.flush()
                    self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
                    self.figures[-1]["texts"].append(self.items[-1])
            self.flush()
            if tag == "figure" and self.figures:
                self.close_figure()

    def close_figure(self) -> None:
        """A caption belongs to the figure's media, or is a text of its own where there are none."""
        figure = self.figures.pop()
        for item in figure["texts"] if figure["media"] else []:
            item["kind"] = None
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        if self.caption is not None:
            self.handle_endtag("figcaption")
        self.flush()
        while self.figures:
            self.close_figure()
        return [{"position": k, **x} for k, x in enumerate(x for x in self.items if x["kind"])]


def parse_page(html: str | None) -> list[dict]:
    page = Sequence()
    page.feed(html or "")
    return page.done()


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every column of pages but html, and `sequence`: the page's text and media structs in reading order.

    Null and empty pages have an empty sequence; malformed markup is read as far as it goes; script, style
    and head are no content; a column named sequence is replaced. Repeated rows stay repeated.
    """
    kept = [c for c in pages.columns if c not in (html, "sequence")]
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = pa.array([parse_page(x) for x in batch.column(batch.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], parsed], [*kept, "sequence"])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema), f"sequence array<struct<{re.sub(r' (int|string)', r':\1', ITEM)}>>"])
    return map_rows(pages.select(*kept, html), run, columns)


def resolve(refs: DataFrame, features: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with the features of the payload that each reference names by digest; null where there is none.

    features should be stored, with one row for each digest: a join of plain shuffles lets adaptive execution
    split the references to one digest, however many they are.
    """
    names = [c for c in features.columns if c != "digest"]
    clean = refs.drop(*names, "_digest").withColumn("_digest", F.when(F.col(ref).startswith(PREFIX), F.substring(F.col(ref), len(PREFIX) + 1, 64)))
    # a reference without a digest matches nothing: spread by what the row holds, so that such rows don't meet in one task
    clean = clean.withColumn("_digest", F.coalesce("_digest", F.concat(F.lit("?"), F.xxhash64(*(c for c in clean.columns if c != "_digest")).cast("string"))))
    return clean.join(features.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def interleaved(pages: DataFrame, features: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their sequence, each media struct resolved: position, kind, text, ref, caption and payload features.

    Pages without content have an empty sequence; references to payloads that aren't there keep null features.
    Rows are numbered once and stored; features has one row for each digest.
    """
    kept = [c for c in pages.columns if c not in (html, "sequence")]
    row = free_name(pages, "_row")
    parsed = stored(sequences(numbered(pages.select(*kept, html), row), html), "parsed")
    items = resolve(parsed.select(F.col(row).alias("row"), F.explode("sequence").alias("i")).select("row", "i.*"), features)
    names = [c for c in items.columns if c != "row"]
    lists = items.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("sequence"))
    return parsed.drop("sequence").join(lists, row, "left").withColumn("sequence", F.coalesce("sequence", F.array().cast(lists.schema["sequence"].dataType))).drop(row)


def document_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text as the one image of a page of its own, resolved by digest: key, n_bytes, features, caption.

    Null texts are empty (one row of 192 blanks); null keys and repeated rows give a result each.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    digest = F.sha2(padded_column(F.col("text")), 256)
    html = F.concat(F.lit('<article><p>Text as samples.</p><figure><img alt="" src="'), F.lit(PREFIX), digest, F.lit('"><figcaption>document '), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    pages = base.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), html.alias("html"))
    refs = sequences(pages).select("key", "n_bytes", F.explode("sequence").alias("i")).where("i.ref IS NOT NULL").select("key", "n_bytes", "i.*")
    features = stored(read_features(stored(media_store(base), "media")), "features")
    found = resolve(refs, features)
    return found.select(F.col("key").alias(key), "n_bytes", *(f.split()[0] for f in FEATURES.split(", ")), "caption")
