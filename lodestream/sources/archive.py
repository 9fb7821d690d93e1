"""Containers: a manifest and a payload in a tar, compressed; and bounded decoding of zstd files."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestream.sources.spread import pieces

LEVEL = 3


def seal(manifest: bytes, payload: bytes) -> bytes:
    """A USTAR archive of both, manifest first, compressed with zstd."""
    import zstandard

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in (("manifest.json", manifest), ("payload", payload)):
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(data), 0o600, 0
            tar.addfile(info, io.BytesIO(data))
    return zstandard.ZstdCompressor(level=LEVEL).compress(out.getvalue())


def unseal(sealed: bytes) -> tuple[bytes, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj().decompress(sealed)
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        return tuple(tar.extractfile(m).read() for m in tar.getmembers())


def sealed(rows: DataFrame, key: str) -> DataFrame:
    """(key, sealed) of rows (key, manifest: string, payload: string)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            done = [seal((m.as_py() or "").encode(), (t.as_py() or "").encode()) for m, t in zip(b.column("manifest"), b.column("payload"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(done, pa.binary())], names=[key, "sealed"])

    return rows.select(key, "manifest", "payload").mapInArrow(run, f"{key} {kind}, sealed binary")


def opened(rows: DataFrame, key: str) -> DataFrame:
    """(key, manifest, payload_size, payload_sha256) of rows (key, sealed)."""
    kind = rows.schema[key].dataType.simpleString()

    def told(sealed_: bytes) -> tuple[str, int, str]:
        manifest, payload = unseal(sealed_)
        return manifest.decode(), len(payload), hashlib.sha256(payload).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [told(s.as_py()) for s in b.column("sealed")]
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], names=[key, "manifest", "payload_size", "payload_sha256"])

    return rows.select(key, "sealed").mapInArrow(run, f"{key} {kind}, manifest string, payload_size bigint, payload_sha256 string")


def unsealed(rows: DataFrame, key: str) -> DataFrame:
    """(key, manifest, payload) of rows (key, content)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            both = [unseal(c.as_py()) for c in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([m.decode() for m, _ in both], pa.string()), pa.array([d for _, d in both], pa.binary())], names=[key, "manifest", "payload"])

    return rows.select(key, "content").mapInArrow(run, f"{key} {kind}, manifest string, payload binary")


def decoded(files: DataFrame, most: int) -> DataFrame:
    """(path, content, too_large) of zstd files (path, content); a file that decodes to more than ``most`` bytes has no content."""
    import zstandard

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for c in p["content"]:
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(c)), read_across_frames=True) as r:
                    data = r.read(most + 1)
                out.append(None if len(data) > most else data)
            yield pd.DataFrame({"path": p["path"], "content": out, "too_large": [x is None for x in out]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, too_large boolean")
