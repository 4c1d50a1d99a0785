"""Defaults of the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_separator: str = "\n\n"
    words_per_minute: int = 238
    model_chars: int = 4000
    max_upload_bytes: int = 500 * 1024 * 1024
    history_size: int = 360
    cache_ttl_s: float = 3600.0
    cache_budget_mb: float = 500.0
    retry_base_s: float = 1.0
    retry_cap_s: float = 60.0
    retry_factor: float = 2.0
    overlap_threshold: float = 0.4


DEFAULTS = Defaults()

#: Category and media type of each accepted extension.
FILE_KINDS = {
    ".pdf": ("pdf", "application/pdf"),
    ".png": ("image", "image/png"),
    ".jpg": ("image", "image/jpeg"),
    ".jpeg": ("image", "image/jpeg"),
    ".tiff": ("image", "image/tiff"),
    ".tif": ("image", "image/tiff"),
    ".bmp": ("image", "image/bmp"),
    ".mp3": ("audio", "audio/mpeg"),
    ".wav": ("audio", "audio/wav"),
    ".ogg": ("audio", "audio/ogg"),
    ".flac": ("audio", "audio/flac"),
    ".m4a": ("audio", "audio/mp4"),
    ".mp4": ("video", "video/mp4"),
    ".avi": ("video", "video/avi"),
    ".mov": ("video", "video/quicktime"),
    ".mkv": ("video", "video/x-matroska"),
    ".webm": ("video", "video/webm"),
    ".txt": ("text", "text/plain"),
    ".csv": ("data", "text/csv"),
    ".json": ("data", "application/json"),
}
