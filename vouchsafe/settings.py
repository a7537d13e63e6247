"""Tunable limits; every operator takes them as explicit parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class GuardrailSettings:
    today: dt.date
    confidence_threshold: float = 0.80
    max_age_days: int = 3650
    future_days: int = 1
    amount_basis: str = "net"


MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MAX_PAGES = 200
RENDER_DPI = 300
MAX_RENDER_MEGAPIXELS = 40
MAX_IMAGE_MEGAPIXELS = 50
MAX_MODEL_ATTEMPTS = 2
SCHEMA_VERSION = "1"
NAME_THRESHOLD = 0.85
LINE_THRESHOLD = 0.45
