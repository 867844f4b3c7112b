"""Media files as rows, and features of sound from WAV files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.text import mime

DIM, MELS = 512, 64


def assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, bytes, modified) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", mime(F.col("path")).alias("kind"), F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("modified"))


def frames_of(rows: DataFrame, parent: int) -> DataFrame:
    return rows.filter(F.col("parent_id") == parent).orderBy("ts")


def mel_filters(rate: int, size: int, mels: int = MELS) -> np.ndarray:
    """Triangles that are evenly spaced on the mel scale."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(size, 1 / rate)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - left) / np.maximum(mid - left, 1e-9), (right - bins) / np.maximum(right - mid, 1e-9)))


def sound_vector(data: bytes, dim: int = DIM) -> list[float]:
    """Mean log mel spectrum of a 16-bit WAV file, repeated to ``dim`` and normalised."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels = w.getframerate(), w.getnchannels()
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
    x = x.reshape(-1, channels).mean(axis=1)
    size, hop = 400, 160
    x = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    mean = np.log1p(power @ mel_filters(rate, size).T).mean(axis=0)
    v = np.resize(mean, dim)
    length = np.linalg.norm(v)
    return (v / length if length else v).tolist()


def sound_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, embedding) of WAV files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "embedding": [sound_vector(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, embedding array<double>")


def gray_pixels(data: bytes) -> np.ndarray:
    """Rows of brightness, 0 to 255, of a PGM, PPM or PNG image (8 bits, not interlaced)."""
    if data[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            line_end = data.index(b"\n", at) if data[at : at + 1] == b"#" else None
            if line_end is not None:
                at = line_end + 1
                continue
            start = at
            while at < len(data) and not data[at : at + 1].isspace():
                at += 1
            if at > start:
                head.append(int(data[start:at]))
            at += 1
        width, height, _ = head
        channels = 3 if data[:2] == b"P6" else 1
        raw = np.frombuffer(data, np.uint8, width * height * channels, at).reshape(height, width, channels)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        raw = _png(data)
    else:
        raise ValueError("images are PGM, PPM or PNG files")
    if raw.shape[2] < 3:
        return raw[:, :, 0]
    return np.rint(raw[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    import struct
    import zlib

    at, packed, palette = 8, b"", None
    width = height = kind = 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("PNG images have 8 bits and aren't interlaced")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.int64)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        above = out[y - 1] if y else np.zeros(width * step, np.int64)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + above) % 256
        else:
            row = out[y]
            for x in range(width * step):
                left, corner = (row[x - step], above[x - step]) if x >= step else (0, 0)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    near = (abs(p - left), abs(p - above[x]), abs(p - corner))
                    guess = left if near[0] <= near[1] and near[0] <= near[2] else above[x] if near[1] <= near[2] else corner
                row[x] = (line[x] + guess) % 256
    pixels = out.astype(np.uint8).reshape(height, width, step)
    return palette[pixels[:, :, 0]] if kind == 3 and palette is not None else pixels[:, :, :1] if step == 2 else pixels


def image_vector(data: bytes, dim: int = DIM) -> list[float]:
    """Shares of sixteen steps of brightness, repeated to ``dim``."""
    bins = np.bincount((gray_pixels(data) >> 4).ravel(), minlength=16)
    return np.resize(bins / max(bins.sum(), 1), dim).tolist()


def frames_vector(frames: list[bytes], dim: int = DIM) -> list[float]:
    """A clip by its frames, images in order: brightness steps and the lowest cosine transform of each, averaged and normalised."""
    parts = []
    for data in frames:
        gray = gray_pixels(data).astype(np.float64)
        rows, columns = (np.linspace(0, n - 1, 32).astype(int) for n in gray.shape)
        small = gray[np.ix_(rows, columns)] / 255
        k = np.arange(32)
        basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
        low = (basis @ small @ basis.T)[:8, :8].ravel() / 32
        parts.append(np.concatenate([np.bincount((small * 15.999).astype(int).ravel(), minlength=16) / small.size, low]))
    v = np.resize(np.mean(parts, axis=0), dim) if parts else np.zeros(dim)
    length = np.linalg.norm(v)
    return (v / length if length else v).tolist()


def image_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, embedding) of images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pgm,ppm,png}").load(path)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "embedding": [image_vector(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, embedding array<double>")


def clip_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(clip, n, embedding) of clips given as folders of frames, named in order; a video file itself needs a decoder, and none is installed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pgm,ppm,png}").load(path)
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("clip"), "path", "content")

    def run(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("path")
        return pd.DataFrame({"clip": [key[0]], "n": [len(frames)], "embedding": [frames_vector([bytes(c) for c in frames["content"]])]})

    return rows.groupBy("clip").applyInPandas(run, "clip string, n long, embedding array<double>")
