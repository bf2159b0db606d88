"""WAV files as envelopes: the header is checked, channels are mixed, and only frame levels leave the task, never samples as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Sample rates and channels that are taken, least samples, frame.
RATE_LEAST, RATE_MOST, CHANNELS_MOST, SAMPLES_LEAST, FRAME_MS = 6_000, 192_000, 8, 800, 20.0


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(16-bit mono samples, rate) of a PCM file; ValueError with a code otherwise."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not_wav")
    at, shape, pcm = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            shape = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            pcm = body
        at += 8 + size + size % 2
    if shape is None or pcm is None:
        raise ValueError("bad_header")
    kind, channels, rate, _, align, depth = shape
    if kind != 1:
        raise ValueError("not_pcm")
    if depth not in (8, 16):
        raise ValueError("bad_depth")
    if not 1 <= channels <= CHANNELS_MOST:
        raise ValueError("bad_channels")
    if align != channels * depth // 8:
        raise ValueError("bad_align")
    if not RATE_LEAST <= rate <= RATE_MOST:
        raise ValueError("bad_rate")
    n = len(pcm) // align * align
    x = np.frombuffer(pcm[:n], dtype="<i2").astype(np.int64) if depth == 16 else (np.frombuffer(pcm[:n], dtype=np.uint8).astype(np.int64) - 128) * 256
    mono = x.reshape(-1, channels).sum(axis=1) // channels
    return mono, rate


def levels_of(samples: np.ndarray, rate: int) -> np.ndarray:
    frame = max(1, round(rate * FRAME_MS / 1000))
    n = len(samples) // frame
    x = samples[: n * frame].reshape(n, frame).astype(np.float64)
    return np.sqrt((x * x).sum(axis=1) / frame) / 32768.0


def read_levels(files: DataFrame) -> DataFrame:
    """path, code (null if the file was read), rate, samples, levels. files: ``binaryFile`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x, rate = read_wav(bytes(content))
                    if len(x) < SAMPLES_LEAST:
                        raise ValueError("too_short")
                    out.append((path, None, rate, len(x), levels_of(x, rate).tolist()))
                except (ValueError, struct.error) as e:
                    out.append((path, str(e), None, None, None))
            yield pd.DataFrame(out, columns=["path", "code", "rate", "samples", "levels"]).astype({"rate": "Int64", "samples": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, code string, rate long, samples long, levels array<double>")
