"""Small charts as SVG, from rows whose number doesn't grow with the data."""

from __future__ import annotations

import html
from collections.abc import Sequence

WIDTH, HEIGHT, MARGIN = 520, 300, 46
COLOURS = ("#1f5a99", "#c0561a", "#2d7d46", "#8a3d8f", "#a98600", "#2f8f95", "#b03052", "#5b5b5b", "#6a8f1f", "#7a5c3a")


def _figure(title: str, inner: list[str], x_label: str = "", y_label: str = "", height: int = HEIGHT) -> str:
    said = [f'<text x="{WIDTH / 2}" y="16" text-anchor="middle" font-weight="bold">{html.escape(title)}</text>']
    said += [f'<text x="{WIDTH / 2}" y="{height - 6}" text-anchor="middle">{html.escape(x_label)}</text>'] if x_label else []
    said += [f'<text transform="translate(12 {height / 2}) rotate(-90)" text-anchor="middle">{html.escape(y_label)}</text>'] if y_label else []
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" viewBox="0 0 {WIDTH} {height}" font-family="sans-serif" font-size="11">{"".join(said + inner)}</svg>'


class Scale:
    """From values to places between two ends; a single value stands in the middle."""

    def __init__(self, values: Sequence[float], start: float, end: float):
        self.low, self.high = (min(values), max(values)) if values else (0.0, 1.0)
        self.start, self.end = start, end

    def __call__(self, v: float) -> float:
        share = (v - self.low) / (self.high - self.low) if self.high > self.low else 0.5
        return round(self.start + share * (self.end - self.start), 1)


def _axes(x: Scale, y: Scale) -> list[str]:
    left, right, top, bottom = MARGIN, WIDTH - 12, 26, HEIGHT - MARGIN
    out = [f'<path d="M{left} {top}V{bottom}H{right}" fill="none" stroke="#333"/>']
    for v in dict.fromkeys((x.low, x.high)):
        out.append(f'<text x="{x(v)}" y="{bottom + 14}" text-anchor="middle">{v:.4g}</text>')
    for v in dict.fromkeys((y.low, y.high)):
        out.append(f'<text x="{left - 4}" y="{y(v) + 4}" text-anchor="end">{v:.4g}</text>')
    return out


def lines(title: str, series: dict[str, Sequence[tuple[float, float]]], x_label: str = "", y_label: str = "", dots: Sequence[str] = ()) -> str:
    """Series of points as lines, those named in ``dots`` as circles; points without a value are left out."""
    series = {k: [(float(a), float(b)) for a, b in p if a is not None and b is not None and b == b] for k, p in series.items()}
    points = [p for s in series.values() for p in s]
    if not points:
        return _figure(title, ['<text x="60" y="60">no values</text>'])
    x = Scale([a for a, _ in points], MARGIN + 6, WIDTH - 18)
    y = Scale([0.0, *(b for _, b in points)] if min(b for _, b in points) >= 0 else [b for _, b in points], HEIGHT - MARGIN - 4, 32)
    inner = _axes(x, y)
    for k, (name, s) in enumerate(series.items()):
        colour = COLOURS[k % len(COLOURS)]
        if name in dots:
            inner += [f'<circle cx="{x(a)}" cy="{y(b)}" r="3" fill="{colour}"/>' for a, b in s]
        else:
            inner.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.6" points="{" ".join(f"{x(a)},{y(b)}" for a, b in sorted(s))}"/>')
        inner.append(f'<text x="{WIDTH - 16}" y="{34 + 13 * k}" text-anchor="end" fill="{colour}">{html.escape(name)}</text>')
    return _figure(title, inner, x_label, y_label)


def bars(title: str, values: Sequence[tuple[str, float]], x_label: str = "", y_label: str = "") -> str:
    """Upright bars from 0 in the given order."""
    values = [(n, float(v or 0)) for n, v in values]
    if not values:
        return _figure(title, ['<text x="60" y="60">no values</text>'])
    y = Scale([0.0, *(v for _, v in values)], HEIGHT - MARGIN - 4, 32)
    step = (WIDTH - MARGIN - 20) / len(values)
    inner = [f'<path d="M{MARGIN} 26V{HEIGHT - MARGIN}H{WIDTH - 12}" fill="none" stroke="#333"/>', f'<text x="{MARGIN - 4}" y="{y(y.high) + 4}" text-anchor="end">{y.high:.4g}</text>']
    for k, (name, v) in enumerate(values):
        a = MARGIN + 4 + k * step
        inner.append(f'<rect x="{a:.1f}" y="{min(y(v), y(0)):.1f}" width="{max(1, step - 3):.1f}" height="{abs(y(0) - y(v)):.1f}" fill="{COLOURS[0]}"><title>{html.escape(name)}: {v:.6g}</title></rect>')
        inner.append(f'<text x="{a + step / 2:.1f}" y="{HEIGHT - MARGIN + 13}" text-anchor="middle" font-size="9">{html.escape(shortened(name))}</text>')
    return _figure(title, inner, x_label, y_label)


def matrix(title: str, names: Sequence[str], values: dict[tuple[str, str], float | None]) -> str:
    """Coefficients between -1 and 1 as coloured squares, from one value for each pair."""
    side = min(30.0, 380 / max(1, len(names)))
    inner = []
    for i, a in enumerate(names):
        inner.append(f'<text x="{128}" y="{44 + (i + 0.6) * side:.1f}" text-anchor="end" font-size="9">{html.escape(shortened(a))}</text>')
        for j, b in enumerate(names):
            v = 1.0 if a == b else values.get((a, b), values.get((b, a)))
            red, blue = (int(255 * (1 - max(0.0, s * v))) for s in (-1, 1)) if v is not None and v == v else (200, 200)
            fill = f"rgb({blue},{min(red, blue)},{red})"
            inner.append(f'<rect x="{132 + j * side:.1f}" y="{44 + i * side:.1f}" width="{side:.1f}" height="{side:.1f}" fill="{fill}" stroke="#fff"><title>{html.escape(f"{a}, {b}")}: {"" if v is None else f"{v:.4f}"}</title></rect>')
    return _figure(title, inner, height=int(70 + side * len(names)))


def shortened(name: str) -> str:
    return name if len(name) <= 20 else name[:18] + "..."
