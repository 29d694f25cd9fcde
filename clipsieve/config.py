"""Settings of the steps around models, as frozen dataclasses that go into log records."""

from __future__ import annotations

from dataclasses import asdict, dataclass

EDITS = ("remove", "swap")
BACKENDS = ("model", "fill")


@dataclass(frozen=True)
class InpaintSettings:
    """How masks are prepared for an inpainting model, and how it runs."""

    erode_px: int = 0
    dilate_px: int = 0
    feather_sigma: float = 0.0
    device: str = "auto"
    code_path: str = "third_party/inpaint"
    weights_path: str = "third_party/inpaint/weights"
    chunk: int = 50
    context: int = 0

    def record(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class SegmentSettings:
    """Thresholds of segmentation and tracking."""

    threshold: float = 0.5
    mask_threshold: float = 0.5
    select_largest: bool = True
    multi_object: bool = False
    proximity: int = 50
    stride: int = 5
    sure: float = 0.9
    least: float = 0.3
    cap: int = 500
    max_area_ratio: float = 3.0
    similarity: float = 0.35
    batch_frames: int = 4


def check_request(edit: str, backend: str, swap_target: str | None = None) -> None:
    """Raises ValueError for an unknown kind of edit or backend, or a swap without its target."""
    if edit not in EDITS:
        raise ValueError(f"edit must be one of {EDITS}, not {edit!r}")
    if edit == "swap" and not swap_target:
        raise ValueError("a swap needs a target")
    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {BACKENDS}, not {backend!r}")
