"""Sizes and durations for people, as columns and on the driver."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def fmt_bytes(size) -> Column:
    b = F.col(size) if isinstance(size, str) else size
    out = F.when(b < 1024, F.format_string("%d B", b.cast("long")))
    for i, unit in enumerate(UNITS[1:], 1):
        value = F.format_string(f"%.2f {unit}", b.cast("double") / float(1024**i))
        out = out.when(b < 1024 ** (i + 1), value) if i < len(UNITS) - 1 else out.otherwise(value)
    return out


def fmt_dur(seconds) -> Column:
    s = F.coalesce((F.col(seconds) if isinstance(seconds, str) else seconds).cast("long"), F.lit(0).cast("long"))
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(h > 0, F.format_string("%dh%02dm", h, m))
        .otherwise(F.format_string("%dm%02ds", m, F.pmod(s, F.lit(60))))
    )


def bytes_text(size: float) -> str:
    power = 0
    while size >= 1024 ** (power + 1) and power < len(UNITS) - 1:
        power += 1
    return f"{size / 1024**power:.2f} {UNITS[power]}" if power else f"{int(size)} B"


def duration_text(seconds: float | None) -> str:
    m, s = divmod(int(seconds or 0), 60)
    h, m = divmod(m, 60)
    return f"{h}h{m:02d}m" if h else f"{m}m{s:02d}s" if m else f"{s}s"


def eta_text(label: str, done: int, total: int, started: float, now: float | None = None) -> str:
    spent = max(1.0, (time.time() if now is None else now) - started)
    rate = done / spent
    left = (total - done) / rate if rate > 0 and done < total else 0
    share = 100 * done / total if total else 0.0
    return f"{label}: {done} / {total} done ({share:.1f}%, {rate:.0f}/s, {duration_text(spent)} elapsed, ETA {duration_text(left)})"
