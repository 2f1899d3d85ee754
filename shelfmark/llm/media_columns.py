"""Media columns: interleaved document sequences.

HTML parsing turns a page into an ordered array of structs: text, or a media
reference with its caption. Media are stored by digest as a table of binary
columns in a plain grey-map form (one 8-bit sample per payload byte, 64 to a
row). Joins on the digest resolve references to the stored bytes, or to what
was read back from them; positions and captions stay with their references.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, fresh, materialise

#: Samples in a row of the stored form; payloads are padded with zero bytes to whole rows.
ROW = 64
#: Digests that a task of the store remembers, so as to write equal media once.
REFS_KEPT = 50_000
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style template".split())
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


class _Interleaved(HTMLParser):
    """Collects runs of text and media references in document order.

    Figures nest: a caption goes to the media of its own figure; one whose
    figure has no media is text. Captions and figures that are left open end
    with what encloses them, or with the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figures: list[list[int]] = []

    @staticmethod
    def _flat(parts: list[str]) -> str:
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def end_run(self) -> None:
        text, self.run = self._flat(self.run), []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = self._flat(self.caption), None
        media = self.figures[-1] if self.figures else []
        for i in media:
            self.items[i][3] = text or self.items[i][3]
        if text and not media:
            self.items.append(["text", text, None, None])

    def end_figure(self) -> None:
        self.end_caption()
        self.end_run()
        if self.figures:
            self.figures.pop()

    def finish(self) -> list[list]:
        self.close()
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.end_run()
        return self.items

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.end_caption()
            self.end_run()
            self.figures.append([])
        elif tag == "figcaption":
            self.end_caption()
            self.end_run()
            self.caption = []
        elif tag in ("img", "audio", "video", "source") and values.get("src"):
            self.end_run()
            self.items.append(["media", None, values["src"], values.get("alt") or None])
            if self.figures:
                self.figures[-1].append(len(self.items) - 1)
        elif tag not in _VOID or tag in ("br", "hr"):
            (self.run if self.caption is None else self.caption).append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag not in _VOID:
            (self.run if self.caption is None else self.caption).append(" ")

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_interleaved(html: str | None) -> list[dict]:
    """Ordered text and media structs of a page; a figure's caption goes to its media.

    A caption stands where its media do: text after it follows it.
    """
    parser = _Interleaved()
    parser.feed(html or "")
    return [
        {"pos": i, "kind": kind, "text": text, "ref": ref, "caption": caption}
        for i, (kind, text, ref, caption) in enumerate(parser.finish())
    ]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``sequence``, the page's ordered structs, to the other columns (but one of that name).

    Null or empty html: an empty array.
    """
    names = [c for c in pages.columns if c not in (html, "sequence")]
    source = fresh(pages, "_html")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select([F.col(f"`{c}`") for c in names]).schema)
    arrow = pa.list_(
        pa.struct(
            [("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]
        )
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media_columns")
        for batch in batches:
            for low in range(0, len(batch), 200):
                part = batch.slice(low, 200)
                found = [parse_interleaved(x) for x in part.column(len(names)).to_pylist()]
                columns = [part.column(i) for i in range(len(names))]
                yield pa.record_batch([*columns, pa.array(found, arrow)], names=[*names, "sequence"])

    kept = [F.col(f"`{c}`") for c in names]
    return pages.select(*kept, F.col(f"`{html}`").alias(source)).mapInArrow(parse, f"{kinds}sequence {SEQUENCE}")


def encode_media(payload: bytes) -> bytes:
    """The stored form: a grey map of 64 samples a row whose samples are the payload, padded with zeros."""
    padded = payload + bytes(-len(payload) % ROW or (0 if payload else ROW))
    return b"P5\n%d %d\n255\n" % (ROW, len(padded) // ROW) + padded


def decode_media(media: bytes) -> bytes:
    """The samples of a stored grey map, from its bytes alone."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if not head:
        raise ValueError("not a grey map")
    samples = media[head.end() :]
    if len(samples) != int(head[1]) * int(head[2]):
        raise ValueError("grey map of wrong length")
    return samples


def describe(samples: bytes) -> str:
    """Features of decoded samples: rows, mean, deviation, and a 64-bit hash of block means."""
    values = np.frombuffer(samples, np.uint8).astype(np.int64)
    n = len(values)
    mean = int(values.sum()) * 1_000 // n
    spread = (int((values * values).sum()) * n - int(values.sum()) ** 2) // (n * n)
    edges = np.linspace(0, n, 65).astype(np.int64)
    sums = np.r_[0, np.cumsum(values)]
    width = np.maximum(np.diff(edges), 1)
    blocks = np.diff(sums[edges]) * 1_000 // width
    bits = np.packbits(blocks > mean).tobytes().hex()
    return f"rows={n // ROW};mean={mean};var={spread};hash={bits}"


def payload_of(text: str | None) -> bytes:
    return (text or "").encode()


def store_media(docs: DataFrame) -> DataFrame:
    """The media table: every text's payload in the stored form, by digest. Columns: ref, media.

    Written into the shared folder, without a shuffle: a task writes a digest
    once (as far as it remembers), so a digest can be stored by several tasks.
    A null text is an empty payload. An empty table gives an empty store.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media_columns")
        seen: set[bytes] = set()
        for batch in batches:
            for low in range(0, len(batch), 200):
                refs, kept = [], []
                for text in batch.column(0).slice(low, 200).to_pylist():
                    media = encode_media(payload_of(text))
                    digest = hashlib.sha256(media)
                    if digest.digest() not in seen:
                        if len(seen) >= REFS_KEPT:
                            seen.clear()
                        seen.add(digest.digest())
                        refs.append(digest.hexdigest())
                        kept.append(media)
                yield pa.record_batch([pa.array(refs, pa.string()), pa.array(kept, pa.binary())], names=["ref", "media"])

    return materialise(docs.select("text").mapInArrow(store, "ref string, media binary"), "media")


def page_of(text: str | None) -> str:
    """A page with the text's first half, a figure of its payload, a figure of an icon, and the second half."""
    text, payload = text or "", payload_of(text)
    ref = hashlib.sha256(encode_media(payload)).hexdigest()
    middle = (text.find(" ", len(text) // 2) + 1) or len(text)
    return (
        f"<html><body><p>{markup.escape(text[:middle])}</p>"
        f'<figure><img src="sha256:{ref}" alt="payload"><figcaption>{len(payload)} bytes</figcaption></figure>'
        f'<img src="/icon.png" alt="icon"><p>{markup.escape(text[middle:])}</p></body></html>'
    )


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and html of every row: its text around a figure that refers to the stored payload."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media_columns")
        for batch in batches:
            for low in range(0, len(batch), 200):
                texts = batch.column(1).slice(low, 200).to_pylist()
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, 200),
                        pa.array([len(payload_of(t)) for t in texts], pa.int64()),
                        pa.array([page_of(t) for t in texts], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "html"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(make, "doc_id long, n_bytes long, html string")


FEATURES = (
    "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def read_media(media: DataFrame) -> DataFrame:
    """(ref, media) to what the stored bytes decode to: digests and features, no bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("media_columns")
        for batch in batches:
            for low in range(0, len(batch), 200):
                part = batch.slice(low, 200)
                rows: list[tuple] = []
                for ref, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    samples = decode_media(stored)
                    rows.append(
                        (
                            ref,
                            len(samples),
                            hashlib.sha256(samples).hexdigest(),
                            zlib.crc32(samples[-ROW:]),
                            len(stored),
                            hashlib.sha256(stored).hexdigest(),
                            describe(samples),
                        )
                    )
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [c.split()[0] for c in FEATURES.split(", ")]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("ref", "media").mapInArrow(read, FEATURES)


def references(sequences: DataFrame) -> DataFrame:
    """One row per media reference: the other columns, pos, ref and caption (in place of columns of these names).

    ref is the digest of a stored medium, or the address as it stands in the page.
    """
    kept = [F.col(f"`{c}`") for c in sequences.columns if c.lower() not in ("sequence", "pos", "ref", "caption")]
    item = fresh(sequences, "_item")
    items = sequences.select(*kept, F.explode("sequence").alias(item)).where(F.col(item)["kind"] == "media")
    digest = F.regexp_replace(F.col(item)["ref"], "^sha256:", "")
    return items.select(*kept, F.col(item)["pos"].alias("pos"), digest.alias("ref"), F.col(item)["caption"].alias("caption"))


def resolve(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Left join of references to one row per digest of (ref, ...); unknown digests keep nulls.

    ``stored`` is the media table itself, for payloads, or what
    :func:`read_media` found in it.
    """
    return refs.join(stored.dropDuplicates(["ref"]), "ref", "left")


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's payload stored, referred to from its page, read back and resolved by digest.

    One row per row of ``docs``; equal texts share one digest. Stored bytes
    are read back from the media table; what is joined are features. Null and
    empty texts are one row of zeros. An empty table gives no rows.
    """
    features = read_media(store_media(docs))
    refs = references(interleave(document_pages(docs))).where("ref NOT LIKE '/%'")
    return resolve(refs, features).select(
        "doc_id",
        "n_bytes",
        *[c.split()[0] for c in FEATURES.split(", ")[1:]],
        "pos",
        "caption",
    )
