"""Extractors of PDF, image, audio and video files around injectable libraries, and OCR image preprocessing."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import collapse_all, strip

#: Characters of text from which on a PDF counts as not scanned.
SCANNED_BELOW = 50
AUDIO_TIMEOUT_S = 300
#: Foreground pixels and degrees from which on an image is deskewed.
DESKEW_PIXELS, DESKEW_DEGREES = 100, 0.5

#: content -> texts of the pages; content -> (text, confidence) of each page's image; content -> (text, confidence)
PageTexts = Callable[[bytes], list[str]]
PageScans = Callable[[bytes], list[tuple[str, float]]]
Recogniser = Callable[[bytes], tuple[str, float]]


def joined_pages(pages: list[str]) -> str:
    return "\n\n".join(p for p in pages if p)


def scanned_pages(scans: list[tuple[str, float]]) -> tuple[str, float]:
    """Texts of the pages that have any, by blank lines, and the mean confidence of these pages alone."""
    found = [(t.strip(), c) for t, c in scans if t.strip()]
    return "\n\n".join(t for t, _ in found), (sum(c for _, c in found) / len(found) if found else 0.0)


def pdf_extractor(page_texts: PageTexts, ocr: PageScans | None) -> Recogniser:
    """Page texts with confidence 1 if they hold SCANNED_BELOW characters or more, else what OCR reads."""

    def extract(content: bytes) -> tuple[str, float]:
        direct = joined_pages(page_texts(content))
        if len(direct.strip()) >= SCANNED_BELOW:
            return direct, 1.0
        if ocr is None:
            raise RuntimeError("the PDF is scanned and there is no OCR")
        return scanned_pages(ocr(content))

    return extract


def pdf_route(pages: Column, scans: Column) -> Column:
    """The same rule for pages that are read already: struct(text, confidence, method). pages: array of texts; scans: array
    of struct(text, confidence)."""
    direct = F.array_join(F.filter(pages, lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")
    kept = F.filter(scans, lambda s: strip(s["text"]) != "")
    mean = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.greatest(F.size(kept), F.lit(1))
    whole = F.length(strip(direct)) >= SCANNED_BELOW
    return F.when(whole, F.struct(direct.alias("text"), F.lit(1.0).alias("confidence"), F.lit("direct").alias("method"))).otherwise(
        F.struct(F.array_join(F.transform(kept, lambda s: strip(s["text"])), "\n\n").alias("text"), mean.alias("confidence"), F.lit("ocr").alias("method"))
    )


def image_extractor(decode: Callable[[bytes], np.ndarray], words: Callable[[np.ndarray], list[tuple[str, float]]], prepare: bool = True) -> Recogniser:
    """decode: content -> pixels (rows, columns[, RGB]); words: pixels -> (word, confidence 0 to 100)."""

    def extract(content: bytes) -> tuple[str, float]:
        pixels = decode(content)
        found = [(w.strip(), c) for w, c in words(preprocessed(pixels) if prepare else pixels) if c > 0 and w.strip()]
        mean = sum(c for _, c in found) / len(found) / 100 if found else 0.0
        return " ".join(" ".join(w for w, _ in found).split()), min(max(mean, 0.0), 1.0)

    return extract


def video_extractor(speech: Recogniser, program: str = "ffmpeg", timeout: int = AUDIO_TIMEOUT_S) -> Recogniser:
    """The sound track as mono 16 kHz PCM by an outside program, then speech recognition. Files live in the task's own
    temporary folder and are gone when it ends."""

    def extract(content: bytes) -> tuple[str, float]:
        exe = shutil.which(program)
        if exe is None:
            raise RuntimeError(f"{program} isn't installed")
        with tempfile.TemporaryDirectory() as tmp:
            Path(tmp, "in").write_bytes(content)
            done = subprocess.run([exe, "-i", f"{tmp}/in", "-vn", "-acodec", "pcm_s16le", "-ar", "16000", "-ac", "1", "-y", f"{tmp}/out.wav"], capture_output=True, timeout=timeout)
            if done.returncode or not Path(tmp, "out.wav").is_file():
                raise RuntimeError(f"{program} failed: {done.stderr.decode(errors='replace')[-300:]}")
            return speech(Path(tmp, "out.wav").read_bytes())

    return extract


def transcript(segments: list[str], mean_logprob: float | None, language: float | None) -> tuple[str, float]:
    """Segments by spaces; confidence is exp of the mean log probability, else the language's probability, else 0."""
    score = np.exp(mean_logprob) if mean_logprob is not None else language or 0.0
    return " ".join(s.strip() for s in segments if s.strip()), float(min(max(score, 0.0), 1.0))


def clean_ocr(text: Column) -> Column:
    return collapse_all(text)


# --- images -------------------------------------------------------------------------------------------------------------


def median3(x: np.ndarray) -> np.ndarray:
    """Median of each pixel's 3 x 3 neighbourhood, edges repeated; each colour by itself."""
    p = np.pad(x, ((1, 1), (1, 1), *((0, 0),) * (x.ndim - 2)), mode="edge")
    h, w = x.shape[:2]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def gray(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else np.rint(x[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu(x: np.ndarray) -> np.ndarray:
    """Black or white by the threshold that parts the gray levels with the largest variance between the classes."""
    n = np.bincount(x.ravel(), minlength=256).astype(float)
    below, level = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.nan_to_num(below * above * (level / below - (level[-1] - level) / above) ** 2)
    return np.where(x > int(spread.argmax()), 255, 0).astype(np.uint8)


def skew(x: np.ndarray) -> float:
    """Degrees by which lines of dark pixels lean (clockwise positive): those whose row sums vary most, to a tenth."""
    rows, columns = np.nonzero(x < 128)
    if len(rows) < DESKEW_PIXELS:
        return 0.0
    centre = columns.mean()

    def sharpness(degrees: float) -> float:
        level = np.rint(rows - np.tan(np.radians(degrees)) * (columns - centre)).astype(int)
        return float((np.bincount(level - level.min()).astype(float) ** 2).sum())

    coarse = max(np.arange(-15, 15.5, 0.5), key=sharpness)
    return round(float(max(np.arange(coarse - 0.5, coarse + 0.55, 0.1), key=sharpness)), 1)


def rotated(x: np.ndarray, degrees: float) -> np.ndarray:
    """Turned back by so many degrees around the centre, nearest pixels, edges repeated."""
    h, w = x.shape
    a, (cy, cx) = np.radians(degrees), (h // 2, w // 2)
    yy, xx = np.mgrid[0:h, 0:w]
    sy = np.rint((yy - cy) * np.cos(a) + (xx - cx) * np.sin(a) + cy).astype(int).clip(0, h - 1)
    sx = np.rint((xx - cx) * np.cos(a) - (yy - cy) * np.sin(a) + cx).astype(int).clip(0, w - 1)
    return x[sy, sx]


def preprocessed(x: np.ndarray, denoise: bool = True, threshold: bool = True, deskew: bool = True) -> np.ndarray:
    """Median of 3, gray, black and white, straight: what OCR reads best."""
    x = gray(median3(x) if denoise else x)
    x = otsu(x) if threshold else x
    lean = skew(x) if deskew else 0.0
    return rotated(x, lean) if abs(lean) >= DESKEW_DEGREES else x
