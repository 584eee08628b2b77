"""Video tools: probing, frame extraction and rendering through ffmpeg, and image kernels in NumPy.

The tools are external programs; a call without them fails with a message that names them.
"""

from __future__ import annotations

import json
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y


class MediaError(RuntimeError):
    """A video tool is missing or failed."""


def tools() -> dict[str, str | None]:
    return {name: shutil.which(name) for name in ("ffmpeg", "ffprobe")}


def _tool(name: str) -> str:
    found = shutil.which(name)
    if not found:
        raise MediaError(f"{name} is not installed")
    return found


def _run(command: Sequence[str]) -> str:
    done = subprocess.run(command, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise MediaError(f"{command[0]} failed: {done.stderr.strip()[-500:]}")
    return done.stdout


def probe(video: str) -> dict:
    """What ffprobe says of format and streams; ``recognition.media_info`` reads it."""
    return json.loads(_run([_tool("ffprobe"), "-v", "error", "-print_format", "json", "-show_format", "-show_streams", video]))


def _slice(start: float | None, duration: float | None) -> list[str]:
    return [*(["-ss", f"{start:.3f}"] if start is not None else []), *(["-t", f"{duration:.3f}"] if duration is not None else [])]


def _filters(fps: float | None, crop: str | None) -> list[str]:
    chain = ",".join([*([f"fps={fps:g}"] if fps else []), *([f"crop={crop}"] if crop else [])])
    return ["-vf", chain] if chain else []


def extract_frames(video: str, pattern: str, *, fps: float, crop: str | None = None, start: float | None = None, duration: float | None = None) -> None:
    _run([_tool("ffmpeg"), "-y", *_slice(start, duration), "-i", video, *_filters(fps, crop), pattern])


def extract_frame(video: str, output: str, timestamp: float, crop: str | None = None) -> None:
    _run([_tool("ffmpeg"), "-y", "-ss", f"{timestamp:.3f}", "-i", video, *_filters(None, crop), "-frames:v", "1", output])


def extract_audio(video: str, output: str, sample_rate: int = 16_000) -> None:
    _run([_tool("ffmpeg"), "-y", "-i", video, "-vn", "-ac", "1", "-ar", str(sample_rate), "-c:a", "pcm_s16le", output])


def iter_frames(video: str, *, width: int, height: int, fps: float, crop: str | None = None, start: float | None = None, duration: float | None = None) -> Iterator[np.ndarray]:
    """Frames as (height, width, 3) BGR arrays, decoded as they are asked for; MediaError if ffmpeg fails or ends within a frame."""
    if crop and (m := re.match(r"\s*(\d+):(\d+):", crop)):
        width, height = int(m[1]), int(m[2])
    command = [_tool("ffmpeg"), "-v", "error", *_slice(start, duration), "-i", video, *_filters(fps, crop), "-f", "rawvideo", "-pix_fmt", "bgr24", "pipe:1"]
    size = width * height * 3
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said) as process:  # a file never blocks the tool
        try:
            while len(raw := process.stdout.read(size)) == size:
                yield np.frombuffer(raw, np.uint8).reshape(height, width, 3)
            if process.wait():
                said.seek(0)
                raise MediaError(said.read()[-2000:].decode("utf-8", "replace").strip() or f"ffmpeg ended with {process.returncode}")
            if raw:
                raise MediaError(f"the last frame has {len(raw)} of {size} bytes")
        finally:
            process.kill()


def render(video: str, segments: Sequence[tuple[float, float]], output: str, *, work: str, reencode: bool = True) -> None:
    """Cut the kept segments out and join them."""
    if not segments:
        raise MediaError("there is nothing to keep")
    codec = ["-c:v", "libx264", "-preset", "veryfast", "-crf", "18", "-c:a", "aac", "-b:a", "192k"] if reencode else ["-c", "copy"]
    names = []
    for i, (start, end) in enumerate(segments):
        names.append(f"{work}/part_{i:04d}.mp4")
        _run([_tool("ffmpeg"), "-y", "-ss", f"{start:.3f}", "-i", video, "-t", f"{end - start:.3f}", *codec, names[-1]])
    listing = f"{work}/parts.txt"
    with open(listing, "w", encoding="utf-8") as f:
        f.writelines("file '{}'\n".format(n.replace("'", "'\\''")) for n in names)
    _run([_tool("ffmpeg"), "-y", "-f", "concat", "-safe", "0", "-i", listing, "-c", "copy", output])


def bright_mask(frame: np.ndarray) -> np.ndarray:
    """Pixels of subtitle colour: light, and nearly without saturation."""
    b, g, r = (frame[..., i].astype(np.int32) for i in range(3))
    gray = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    high, low = frame.max(axis=2).astype(np.int32), frame.min(axis=2).astype(np.int32)
    saturation = np.where(high > 0, np.rint(255.0 * (high - low) / np.maximum(high, 1)), 0)
    return (gray > 175) & (saturation < 90)


def _area_weights(size: int, cells: int) -> np.ndarray:
    """(cells, size) weights of an area mean."""
    edges = np.linspace(0, size, cells + 1)
    at = np.arange(size)
    cover = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.clip(cover, 0, 1) * (cells / size)


def frame_signature(frame: np.ndarray, *, min_white_pixels: int = 120) -> list[int] | None:
    """The bright pixels' 64 x 16 outline as 16 longs, or null for a frame with too few."""
    mask = bright_mask(frame)
    if int(mask.sum()) < min_white_pixels:
        return None
    small = _area_weights(mask.shape[0], 16) @ (mask * 255.0) @ _area_weights(mask.shape[1], 64).T
    packed = np.packbits(np.rint(small) > 24, axis=1)
    return packed.view(">i8").reshape(16).astype(np.int64).tolist()


def _labels(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected parts of a mask, 0 outside: the least pixel number spreads until nothing changes."""
    none = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), none)
    while True:
        wide = np.pad(label, 1, constant_values=none)
        near = np.minimum.reduce([wide[1 + y : 1 + y + label.shape[0], 1 + x : 1 + x + label.shape[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)])
        new = np.where(mask, near, none)
        flat = np.append(new.ravel(), none)
        new = np.where(mask, flat[np.minimum(new, none) - 1], none)  # follow the label's own label
        if (new == label).all():
            return np.where(mask, label, 0)
        label = new


def subtitle_box(frame: np.ndarray, *, min_white_pixels: int = 80, padding_x: int = 2, padding_y: int = 2) -> tuple[int, int, int, int] | None:
    """(x1, y1, x2, y2) around the bright parts that can be text; specks and parts at the borders do not count."""
    mask = bright_mask(frame)
    height, width = mask.shape
    labels, keep = _labels(mask), np.zeros_like(mask)
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    for part in np.unique(of):
        y, x = ys[of == part], xs[of == part]
        x1, x2, y1, y2 = x.min(), x.max() + 1, y.min(), y.max() + 1
        if len(x) >= 3 and y2 - y1 >= 3 and y1 >= height * 0.1 and x1 >= width * 0.05 and x2 <= width * 0.95:
            keep[y, x] = True
    if int(keep.sum()) < min_white_pixels:
        return None
    ys, xs = np.nonzero(keep)
    return max(0, int(xs.min()) - padding_x), max(0, int(ys.min()) - padding_y), min(width, int(xs.max()) + padding_x + 1), min(height, int(ys.max()) + padding_y + 1)


def _frames(frames: pd.Series, heights: pd.Series, widths: pd.Series) -> Iterator[np.ndarray]:
    for raw, h, w in zip(frames, heights, widths, strict=True):
        yield np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)


@F.pandas_udf(Y.ArrayType(Y.LongType()))
def signature_of(frames: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([frame_signature(f) for f in _frames(frames, heights, widths)], dtype=object)


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def box_of(frames: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([(b := subtitle_box(f)) and list(b) for f in _frames(frames, heights, widths)], dtype=object)
