"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response is one row: record id, target URI, date, the HTTP header block and the payload. Each makes two records:
`metadata` (application/warc-fields: title, language, declared character set, out-links and payload size) and
`conversion` (text/plain: the page's text). Both refer to the response by its record id (WARC-Refers-To, with target
URI and date), carry the source's own headers that describe the page, and have block and payload digests
(sha1 in base 32). Record ids are name-based UUIDs, so a repeated task makes the same records.

A null payload or header block counts as empty: its records have no title and an empty text. A null URI, date or record id gives an
empty header value. Rows that repeat give equal records. Line ends in a header value become spaces. An empty table has no records.
A very long page is one string in one task, scanned once from left to right. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name:string,value:string>>, block binary, block_digest string, payload_digest string"

# A tag that ends a block is a line end, a cell a space, any other tag nothing; the content of raw elements goes whole.
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody tfoot thead title tr ul".split())
_CELLS = frozenset(("td", "th"))
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript")}
_TITLE_END = re.compile(r"</title\s*>", re.I)
_OPENING = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def squeeze(text: str) -> str:
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def _tag_end(page: str, at: int, gone: set[str]) -> int:
    """The place after a tag's end; `>` inside quotes is none. A quote that nothing closes is a plain character, and `gone` keeps that for the rest of the page."""
    while m := _STOP.search(page, at):
        mark, at = m.group(), m.end()
        if mark == ">":
            return at
        if mark not in gone:
            close = page.find(mark, at)
            if close < 0:
                gone.add(mark)
            else:
                at = close + 1
    return len(page)


def attributes(tag: str) -> Iterator[tuple[str, str]]:
    """Lower-case names and values of a tag's attributes, entities decoded."""
    for m in _ATTRIBUTE.finditer(tag):
        yield m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or "")


def parsed(page: str) -> tuple[list[tuple[str, str]], str]:
    """The fields (title, language, charset, out-links in order) and the text of a page, one line a block.

    One scan from left to right: no place is looked at again, whatever tags, quotes or comments are left open. What is left open
    ends with the page. Entities are decoded after the tags are gone.
    """
    text: list[str] = []
    first: dict[str, str] = {}
    links: list[str] = []
    gone: set[str] = set()
    at, n = 0, len(page)
    titles = True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        text.append(page[at:start])
        if start == n:
            break
        m = _OPENING.match(page, start)
        if not m:
            comment = page.startswith("<!--", start)
            if not comment and page[start + 1 : start + 2] not in ("!", "?"):
                text.append("<")
                at = start + 1
                continue
            end = page.find("-->" if comment else ">", start + (4 if comment else 1))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        name, closing = m.group(1).lower(), page[start + 1] == "/"
        at = _tag_end(page, m.end(), gone)
        text.append("\n" if name in _BLOCKS else " " if name in _CELLS else "")
        if closing:
            continue
        tag = page[m.end() : at]
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
        elif name == "title" and titles and "title" not in first:
            end = _TITLE_END.search(page, at)
            if end:
                first["title"] = squeeze(html.unescape(page[at : end.start()])).replace("\n", " ")
            titles = bool(end)
        elif name == "a":
            links += [one_line(v) for k, v in attributes(tag) if k == "href"][:1]
        elif name == "html" and "languages-html" not in first:
            first.update([("languages-html", one_line(v)) for k, v in attributes(tag) if k == "lang" and v][:1])
        elif name == "meta" and "charset-html" not in first and (c := _CHARSET.search(tag)):
            first["charset-html"] = c.group(1)
    fields = [(k, first[k]) for k in ("title", "languages-html", "charset-html") if k in first]
    return fields + [("outlink", x) for x in links], squeeze(html.unescape("".join(text)))


def decoded(header: str, payload: bytes) -> str:
    """The payload in the charset that the header names, or else the page's first 1,024 bytes; UTF-8 where that is missing or unknown. Bytes that are no characters become U+FFFD."""
    named = [v for k, v in source_headers(header) if k == "WARC-Source-Content-Type"]
    m = _CHARSET.search(named[-1]) if named else None
    m = m or _CHARSET.search(payload[:1024].decode("ascii", "replace"))
    try:
        return payload.decode(m.group(1) if m else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def one_line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def responses(df: DataFrame, key: str, url: str, page: str, date: str = DATE) -> DataFrame:
    """Response rows for stored pages: page_id, record_id, target_uri, date, http_header, payload. Extra columns go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            uris = [one_line(u) for u in b["_url"]]
            yield pd.DataFrame({
                "page_id": pd.array([None if k is None else int(k) for k in b["_key"]], dtype="Int64"),
                "record_id": [record_id("response", str(k), u) for k, u in zip(b["_key"], uris, strict=True)],
                "target_uri": uris, "date": date, "http_header": b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", "payload": [(p or "").encode() for p in b["_page"]],
            })

    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_page"))
    return rows.mapInPandas(run, "page_id long, record_id string, target_uri string, date string, http_header binary, payload binary")


def source_headers(http_header: str) -> list[tuple[str, str]]:
    """Every header of the response, in its order; a folded line belongs to the header before it."""
    out = []
    for line in re.sub(r"\r\n[ \t]+", " ", http_header).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.append((f"WARC-Source-{one_line(name.strip()).title()}", one_line(value.strip())))
    return out


def derived(page_id: int | None, rid: str | None, uri: str | None, date: str | None, header: bytes | None, payload: bytes | None, payload_digest: str | None = None, block_digest: str | None = None) -> Iterator[tuple]:
    """The metadata and conversion records of a response, in the order of SCHEMA. Digests of the response are carried over if given, or else made."""
    rid, uri, date, header, payload = rid or "", one_line(uri), date or "", bytes(header or b""), bytes(payload or b"")
    head = header.decode("iso-8859-1")
    fields, text = parsed(decoded(head, payload))
    fields.append(("payload-bytes", str(len(payload))))
    kept = source_headers(head) + [("WARC-Source-Payload-Digest", payload_digest or digest(payload)), ("WARC-Source-Block-Digest", block_digest or digest(header + payload))]
    both = (("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in fields)), ("conversion", "text/plain; charset=utf-8", text))
    for kind, content, body in both:
        block = body.encode("utf-8", "replace")
        own = digest(block)
        yield page_id, kind, record_id(kind, rid), rid, uri, date, content, [{"name": n, "value": v} for n, v in [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), *kept]], block, own, own


def derive(df: DataFrame) -> DataFrame:
    """Both records of every response row, as SCHEMA. df: as `responses` gives it, and payload_digest and block_digest if it has them."""
    names = [part.split()[0] for part in re.sub(r"<.*?>>", "", SCHEMA).split(", ")]
    given = ["record_id", "target_uri", "date", "http_header", "payload", "payload_digest", "block_digest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [None if k is None else int(k) for k in b["_key"]]
            step = 256
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                rows = [r for k, x in zip(keys[at : at + step], part[given].itertuples(index=False), strict=True) for r in derived(k, *x)]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    rows = df.select(F.col("page_id").cast("string").alias("_key"), *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in given])
    return rows.mapInPandas(run, SCHEMA)


def to_bytes(r) -> bytes:
    """One record as a gzip member, with headers in a fixed order and no time stamp."""
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"])]
    head += [(h["name"], h["value"]) for h in r["headers"]]
    head += [("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(len(r["block"])))]
    text = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head) + "\r\n"
    return gzip.compress(text.encode() + r["block"] + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in the bytes of a compressed WARC file."""
    raw, at = gzip.decompress(data), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, raw[start : start + size]
        at = start + size + 4


def write(records: DataFrame, directory: str, records_per_file: int = 50_000) -> DataFrame:
    """Write records as .warc.gz files in a folder all executors share; returns file, records from a checkpoint."""
    from larkspur.llm.store import cut
    from larkspur.llm.tokenfiles import _open

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, count, out = TaskContext.get().partitionId(), 0, 0, []
        store, root = _open(directory)
        store.create_dir(root, recursive=True)

        def flush() -> pd.DataFrame:
            nonlocal made, count
            name = f"part-{part:08d}-{made:06d}.warc.gz"
            hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden, compression=None) as f:
                f.write(b"".join(out))
            store.move(hidden, f"{root}/{name}")
            row = pd.DataFrame({"file": [name], "records": [count]})
            out.clear()
            made, count = made + 1, 0
            return row

        for b in batches:
            for r in b.to_dict("records"):
                out.append(to_bytes(r))
                count += 1
                if count >= records_per_file:
                    yield flush()
        if out:
            yield flush()

    return cut(records.mapInPandas(run, "file string, records long"))


def read(spark: SparkSession, directory: str) -> DataFrame:
    """headers (map) and block of every record in the folder's files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = [(h, block) for h, block in parse(bytes(data))]
                yield pd.DataFrame(rows, columns=["headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(directory).select("content")
    return files.mapInPandas(run, "headers map<string,string>, block binary")
