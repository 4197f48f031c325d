"""Word recordings in ZIP archives: one archive a task, members one at a time."""

from __future__ import annotations

import hashlib
import io
import wave
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.functions.hashing import hmac_sha256, unit_interval
from echolark.functions.signal import decode_wav

MOST_BYTES, MOST_RATIO = 20 << 20, 200
LEAST_SALT = 16
MEMBERS = "archive string, member string, word string, speaker string, source_hash string, pcm binary, problem string"


def is_recording(name: str) -> bool:
    path = PurePosixPath(name)
    return not name.endswith("/") and "__MACOSX" not in path.parts and not path.name.startswith("._") and path.suffix.lower() == ".wav"


def unsafe(name: str) -> bool:
    """Names that leave the archive's own folder."""
    return "\\" in name or name.startswith("/") or ".." in PurePosixPath(name).parts


def _member(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[str | None, bytes | None, str | None]:
    """(hash, PCM, problem) of one member; sizes are checked before and after it is unpacked."""
    if unsafe(info.filename):
        return None, None, "unsafe path"
    if info.file_size > MOST_BYTES or info.file_size > MOST_RATIO * max(info.compress_size, 1):
        return None, None, "too large"
    try:
        with z.open(info) as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) != info.file_size:
            return None, None, "size differs"
        return hashlib.sha256(data).hexdigest(), decode_wav(data), None
    except (ValueError, EOFError, RuntimeError, NotImplementedError, zlib.error, zipfile.BadZipFile, wave.Error) as e:
        return None, None, f"unreadable: {e}"


def read_archives(spark: SparkSession, path: str, salt: str, seed: str = "seed") -> DataFrame:
    """One row a WAV member `speaker/word.wav` of the archives under `path`, any path Spark can read.

    Members that fail a check, and archives that are none, keep their row with `problem` set and no
    audio. Speakers, in lower case, are kept as digests keyed by `salt` (of LEAST_SALT bytes or more)
    only; the split depends on the digest, so no speaker is in two. An archive has to fit in a task, as binary files do; members are unpacked one by one.
    """

    if len(salt.encode()) < LEAST_SALT:
        raise ValueError(f"the salt needs {LEAST_SALT} bytes")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(name, None, None, None, None, None, "not a ZIP archive")], columns=columns)
                    continue
                for info in z.infolist():
                    if is_recording(info.filename):
                        parts = PurePosixPath(info.filename).parts
                        key, pcm, problem = _member(z, info)
                        if problem is None and len(parts) < 2:
                            pcm, problem = None, "no speaker folder"
                        yield pd.DataFrame([(name, info.filename, PurePosixPath(parts[-1]).stem.casefold(), parts[-2] if len(parts) > 1 else None, key, pcm, problem)], columns=columns)

    columns = [c.split()[0] for c in MEMBERS.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInPandas(unpack, MEMBERS).withColumn("speaker_hash", hmac_sha256(salt.encode(), F.lower("speaker"))).drop("speaker")
    u = unit_interval(F.concat(F.lit(seed + ":"), F.col("speaker_hash")))
    return found.withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "validation").when(u >= 0.9, "test"))


def read_wavs(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, source_hash, pcm, problem) of the WAV files under all paths; files that are no mono 16-bit
    16 kHz audio keep their row without it."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows.append((name, hashlib.sha256(content).hexdigest(), decode_wav(content), None))
                except (ValueError, EOFError, wave.Error) as e:
                    rows.append((name, None, None, f"unreadable: {e}"))
            yield pd.DataFrame(rows, columns=["path", "source_hash", "pcm", "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    return files.mapInPandas(decode, "path string, source_hash string, pcm binary, problem string")
