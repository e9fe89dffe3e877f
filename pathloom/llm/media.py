"""Interleaved documents: ordered text and media references out of HTML, payloads resolved by digest.

`interleave` parses HTML into elements (position, kind, text, ref, caption) in reading order. `store_media` keeps payloads
as 8-bit greyscale PNG images, 64 samples wide, keyed by the SHA-256 of the payload. `media_features` reads the stored bytes back,
checks them and computes features; `resolve` joins elements and media by digest, so positions and captions stay.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.lineage import checkpointed

WIDTH = 64
REF = "media:"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ELEMENT = "position int, kind string, text string, ref string, caption string"
MEDIA_TAGS = {"img", "audio", "video", "embed", "iframe", "object"}
#: Elements whose source children name what they show.
HOLDERS = {"audio", "video", "picture"}
SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[int] = []
        self.skip = 0
        self.holders: list[tuple[str, dict]] = []

    def flush(self):
        text, self.text = "".join(self.text), []
        if text.strip():
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in MEDIA_TAGS:
            given = dict(attrs)
            self.flush()
            ref = given.get("data" if tag == "object" else "src")
            if not ref and tag == "img":
                ref = self._first(given) or (self.holders[-1][1]["ref"] if self.holders else None)
            self.out.append({"kind": "media", "text": None, "ref": ref, "caption": given.get("alt") or None})
            if tag in HOLDERS:
                self.holders.append((tag, self.out[-1]))
        elif tag == "picture":
            self.flush()
            self.holders.append((tag, {"ref": None}))
        elif tag == "source":
            if self.holders and not self.holders[-1][1]["ref"]:
                given = dict(attrs)
                self.holders[-1][1]["ref"] = given.get("src") or self._first(given)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.out))
            elif tag == "figcaption" and self.figures:
                self.caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.skip -= 1
        if tag in HOLDERS:
            self._close(tag)

    @staticmethod
    def _first(given: dict) -> str | None:
        """The first reference of a srcset."""
        return next(iter((given.get("srcset") or "").split(",")[0].split()), None)

    def _close(self, tag: str) -> None:
        """Ends the innermost open holder of that name and those inside it; an end tag without one ends nothing."""
        for i in range(len(self.holders) - 1, -1, -1):
            if self.holders[i][0] == tag:
                del self.holders[i:]
                return

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in HOLDERS:
            self._close(tag)
        elif tag in BLOCKS:
            if tag == "figcaption" and self.caption is not None:
                self._caption()
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def _caption(self):
        said, self.caption = "".join(self.caption).strip(), None
        for x in self.out[self.figures[-1] :] if self.figures else []:
            if x["kind"] == "media":
                x["caption"] = said

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """Elements of one page in reading order; a figure's caption goes to its media, else the alt text does. Null: none.

    A video, audio or picture without a reference of its own has that of its first source that names one.
    """
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    if reader.caption is not None:
        reader._caption()
    reader.flush()
    return [{"position": i, **x} for i, x in enumerate(reader.out)]


def interleave(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep` and elements: array of (position, kind, text, ref, caption). One row per row of pages."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for b in batches:
            parsed = pa.array([parse(x) for x in b.column("_html").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), parsed], names=[*keep, "elements"])

    bound_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, elements array<struct<{', '.join(x.replace(' ', ':') for x in ELEMENT.split(', '))}>>")


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Payload bytes, a positive multiple of 64, as 8-bit grey samples in rows of 64; no row is filtered."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image that to_png made. Raises ValueError if a checksum or the form is wrong."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest (SHA-256 of the payload, hex), media (stored bytes), written to the shared checkpoint folder. Repeated rows store the same; an empty table stores nothing.

    The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of 64. A task stores a payload once per batch of
    rows; copies that several batches store are equal and count once when they are read.
    """

    def run(batches):
        for b in batches:
            seen = {}
            for t in b.column("text").to_pylist():
                payload = padded((t or "").encode())
                key = hashlib.sha256(payload).hexdigest()
                if key not in seen:
                    seen[key] = to_png(payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], names=["digest", "media"])

    bound_batches(docs.sparkSession)
    return checkpointed(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest string, media binary"))


def features(samples: bytes) -> str:
    """Size, mean, deviation and the shares (in 1/255) of eight equal ranges of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} std={x.std():.4f} hist={bytes((bins * 255 // len(x)).astype(np.uint8)).hex()}"


def media_features(store: DataFrame) -> DataFrame:
    """One row per digest of store(digest, media): payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the bytes read."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(digest, media):
        payload = from_png(media)
        read = hashlib.sha256(payload).hexdigest()
        if read != digest:
            raise ValueError(f"media {digest} does not hold its payload")
        return digest, len(payload), read, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)

    def run(batches):
        for b in batches:
            rows = [one(*x) for x in zip(b.column("digest").to_pylist(), b.column("media").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    bound_batches(store.sparkSession)
    read = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(F.min(F.struct(*names[1:])).alias("f")).select("digest", "f.*")


def resolve(elements: DataFrame, media: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, position, caption, ref and the columns of media for every media element; these are null where the reference is missing, is no digest, or is not in media.

    Media rows are small here; payloads need not move with the references.
    """
    refs = elements.select(*keep, F.explode("elements").alias("e")).where("e.kind = 'media'")
    digest = F.when(F.col("e.ref").startswith(REF), F.expr(f"substring(e.ref, {len(REF) + 1})"))
    refs = refs.select(*keep, F.col("e.position").alias("position"), F.col("e.caption").alias("caption"), F.col("e.ref").alias("ref"), digest.alias("_digest"))
    return refs.join(media, F.col("_digest") == F.col("digest"), "left").drop("_digest")


def sequences(pages: DataFrame, media: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep` and elements: the page's texts and media in reading order, (position, kind, text, ref, caption, media). media is the row of media(digest, ...) that the
    reference names, null for texts and for references that are missing, no digests, or not in media. One row per row of pages, repeated ones too; a null page has no elements.

    Only references move to the digests; texts stay in their page's row, to which what was resolved is joined by position.
    """
    rows = checkpointed(interleave(pages, html_col, keep).withColumn("_row", F.monotonically_increasing_id()))
    found = resolve(rows, media, keep=("_row",)).where("digest IS NOT NULL").select("_row", F.struct("position", F.struct(*media.columns).alias("media")).alias("m"))
    by_page = found.groupBy("_row").agg(F.map_from_entries(F.collect_list("m")).alias("_found"))
    held = lambda e: F.struct(*[e[c.split()[0]].alias(c.split()[0]) for c in ELEMENT.split(", ")], F.try_element_at(F.col("_found"), e["position"]).alias("media"))
    return rows.join(by_page, "_row", "left").select(*keep, F.transform("elements", held).alias("elements"))


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, html: every text as a page that shows the text and refers to its payload in a captioned figure."""

    def run(batches):
        for b in batches:
            sizes, pages = [], []
            for t in b.column("text").to_pylist():
                raw = (t or "").encode()
                sizes.append(len(raw))
                ref = REF + hashlib.sha256(padded(raw)).hexdigest()
                pages.append(f'<article><p>{html.escape(t or "", quote=False)}</p><figure><img src="{ref}"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, html string")


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    elements = interleave(as_pages(docs), keep=("doc_id", "n_bytes"))
    found = resolve(elements, media_features(store_media(docs)), keep=("doc_id", "n_bytes"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
