"""Media columns: pages as interleaved sequences of text and media, resolved by digest.

HTML becomes an ordered array of text and media-reference structs, each with its position and, for media, its
caption. Media live in a table of their own, named by the SHA-256 of their stored bytes. References meet them in a
join on that digest, and each page's items come back in the order of their positions, captions beside their media.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, python_batches, table

ITEM = "position int, kind string, text string, ref string, caption string"
SCHEME = "media:"
#: Payloads are images of this width, 8 bits a sample.
WIDTH = 64
_MEDIA = ("img", "audio", "video", "source", "embed")
_SILENT = ("script", "style", "template")
#: What can stand in a head; any other element or text ends it, since its end tag may be left out.
_HEAD = (*_SILENT, "html", "head", "title", "meta", "link", "base")
_BREAKS = ("p", "div", "br", "li", "ul", "ol", "tr", "td", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "blockquote", "pre", "hr", "title", "body")


class _Sequence(HTMLParser):
    """Collects items; a figure's caption goes to the media in it that has none of its own, else it is text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.head = self.title = self.quiet = False  # quiet: inside a head's noscript
        self.figures: list[list[dict]] = []
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def _open_caption(self) -> None:
        """A caption that isn't closed is text where it stands."""
        if self.caption is not None:
            self.words += self.caption
            self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.quiet = False
        if self.quiet or tag == "noscript":
            self.quiet = self.quiet or self.head
            return
        if tag == "head":
            self.head = True
        elif tag not in _HEAD and not self.silent:
            self.head = False
        self.title = tag == "title"
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self._open_caption()
            self.caption = []
        elif tag in _BREAKS and self.caption is not None and tag != "figure":
            self.caption.append(" ")
        elif tag in _BREAKS:
            self._open_caption()
            self._flush()
            if tag == "figure":
                self.figures.append([])
        elif tag in _MEDIA:
            values = dict(attrs)
            if values.get("src"):
                self._open_caption()
                self._flush()
                item = {"kind": "media", "text": None, "ref": values["src"].removeprefix(SCHEME), "caption": values.get("alt") or values.get("title")}
                self.items.append(item)
                for figure in self.figures[-1:]:
                    figure.append(item)

    def handle_endtag(self, tag):
        if self.quiet or tag == "noscript":
            self.quiet = self.quiet and tag not in ("noscript", "head")
            return
        if tag == "head":
            self.head = False
        self.title = self.title and tag != "title"
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            open_ = [x for x in (self.figures[-1] if self.figures else []) if not x["caption"]]
            if open_:
                for item in open_:
                    item["caption"] = text or None
            else:
                self.words.append(f" {text} ")
            self.caption = None
        elif tag in _BREAKS and self.caption is not None and tag not in ("figure", "body"):
            self.caption.append(" ")
        elif tag in _BREAKS:
            self._open_caption()
            self._flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data):
        if self.quiet:
            return
        if not self.silent and not self.title and data.strip():
            self.head = False
        if not self.silent and not self.head:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered items of a page; a null page has none, broken markup gives what can be read."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._open_caption()
    parser._flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(html: Column) -> Column:
    """HTML to array<struct<position, kind, text, ref, caption>>."""

    @F.pandas_udf(f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(sequence)

    return parsed(html)


def interleave(pages: DataFrame, media: DataFrame, columns: tuple[str, ...] = ("media",), html: str = "html") -> DataFrame:
    """Pages with ``items``: their sequence, each item with the ``columns`` of the medium of its digest.

    ``media`` has one row per digest. Items without a medium have nulls there; positions and captions stay as they
    were parsed; a page without items has an empty array. Repeated pages are rows of their own; a medium that very
    many pages share is a skewed join, which adaptive execution splits. An input column named items gives way.
    """
    pages = pages.drop("items")
    parsed = materialize(pages.withColumns({"__ls_page": F.monotonically_increasing_id(), "__ls_items": sequences(F.col(html))}), "sequences")
    resolved = resolve(parsed.select("__ls_page", "__ls_items"), media, columns)
    item = F.struct("position", "kind", "text", "ref", "caption", *columns)
    grouped = resolved.groupBy("__ls_page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.array().cast(grouped.schema["items"].dataType)
    return parsed.drop("__ls_items").join(grouped, "__ls_page", "left").withColumn("items", F.coalesce("items", empty)).drop("__ls_page")


def resolve(parsed: DataFrame, media: DataFrame, columns: tuple[str, ...] = ("media",)) -> DataFrame:
    """One row per item of ``__ls_items``, with its page's other columns and its medium's ``columns``.

    Only references are joined; texts, which have none, don't meet under one null key. Pages without items give no row;
    repeated pages give their rows each; the page's own columns keep their names.
    """
    items = parsed.select(*[c for c in parsed.columns if c != "__ls_items"], F.inline("__ls_items"))
    named = media.select(F.col("digest").alias("__ls_digest"), *columns)  # a written table, so a hot digest can be split
    found = items.where("ref is not null").join(named, F.col("ref") == F.col("__ls_digest"), "left").drop("__ls_digest")
    return found.unionByName(items.where("ref is null"), allowMissingColumns=True)


# ---- payloads: bytes as 8-bit images


def stored(payload: bytes) -> bytes:
    """A binary PGM image of WIDTH columns whose samples are the payload's bytes."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def loaded(medium: bytes) -> bytes:
    """The samples of a stored image."""
    magic, size, most, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit image")
    return samples


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def feature(samples: bytes) -> str:
    """Mean, spread, mean step between neighbours in a row, and the shares of eight brightness bands."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    steps = np.abs(np.diff(image.astype(np.int16), axis=1)).mean()
    bands = np.bincount(image.ravel() >> 5, minlength=8) / image.size
    return f"{image.mean():.4f},{image.std():.4f},{steps:.4f}," + ",".join(f"{x:.4f}" for x in bands)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, digest, media): each text's UTF-8 as a stored image, padded with zeros to whole rows.

    A null text is empty, and an empty one is one row of zeros; equal texts have equal media; repeated rows are stored
    each; the key is cast to long, so it must be a number or text of one; a text of any length is one image; an empty
    table gives none; other columns are left out.
    """
    python_batches(docs.sparkSession)

    def store(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                part = texts[a : a + 200]
                media = [stored(padded(t)) for t in part]
                columns = [keys.slice(a, len(part)), pa.array([len((t or "").encode()) for t in part], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "digest", "media"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(store, f"{key} long, n_bytes long, digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """(digest, media) to one row per digest: sizes, digests and a feature of the bytes as stored.

    Repeated digests are described each and folded by a partial minimum; a medium that isn't an 8-bit image is an error;
    an empty table gives none; other columns are left out.
    """

    def describe(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for digest, medium in zip(*(c.to_pylist() for c in batch.columns)):
                samples = loaded(medium)
                out.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(samples)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema=kinds)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])))
    each = media.select("digest", "media").mapInArrow(describe, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return each.groupBy("digest").agg(*(F.min(c).alias(c) for c in names[1:]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of texts around its text's image; the images' table is written, read back, described and
    joined, and the page's items come back in order with their captions."""
    kept = materialize(store_texts(table(spark, sf_dir, "documents")), "media")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without a name"))
    html = F.concat(F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="' + SCHEME), F.col("digest"), F.lit('"><figcaption>The text of document '), name, F.lit("</figcaption></figure><p>of "), F.col("n_bytes").cast("string"), F.lit(" bytes</article>"))
    facts = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    pages = interleave(kept.select("doc_id", "n_bytes", html.alias("html")), materialize(described(kept), "described"), facts)
    shown = pages.select("doc_id", "n_bytes", F.size("items").alias("n_items"), F.get(F.filter("items", lambda x: x["kind"] == "media"), F.lit(0)).alias("shown"))
    return shown.select("doc_id", "n_bytes", *(f"shown.{c}" for c in facts), "shown.position", "shown.caption", "n_items")
