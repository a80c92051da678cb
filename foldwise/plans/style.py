"""How a chart is to look, as a plain dictionary that goes beside its frame: there is no drawing library here to set it in.

Each function changes the dictionary that it is given and returns it, so that calls can follow one another.
"""

from __future__ import annotations

from collections.abc import Sequence

#: The colours by the names that charts use.
COLOURS = {"blue": "#4e79a7", "orange": "#f28e2b", "red": "#e15759", "teal": "#76b7b2", "green": "#59a14f", "grey": "#79706e"}


def muted_color(color: str, saturation: float = 0.7) -> str:
    """A named colour or #rrggbb, drawn towards the grey of its own brightness; 1 leaves it as it is."""
    code = COLOURS.get(color, color)
    parts = [int(code[k : k + 2], 16) for k in (1, 3, 5)]
    grey = 0.299 * parts[0] + 0.587 * parts[1] + 0.114 * parts[2]
    return "#" + "".join(f"{round(grey + saturation * (p - grey)):02x}" for p in parts)


def create_tufte_figure(nrows: int = 1, ncols: int = 1, figsize: tuple[float, float] | None = None, **options) -> dict:
    """A figure of nrows x ncols panels without frames or grids."""
    panels = [apply_tufte_style({"row": r, "column": c}) for r in range(nrows) for c in range(ncols)]
    return {"size": figsize or (6.0 * ncols, 4.0 * nrows), "panels": panels, **options}


def apply_tufte_style(panel: dict) -> dict:
    """No grid, no box, ticks outwards, muted colours."""
    panel |= {"grid": None, "legend": False, "ticks": "out", "colors": [muted_color(c) for c in COLOURS]}
    return minimal_spines(panel)


def minimal_spines(panel: dict, left: bool = True, bottom: bool = True) -> dict:
    panel["spines"] = [name for name, shown in (("left", left), ("bottom", bottom)) if shown]
    return panel


def range_frame(panel: dict, x: Sequence[float], y: Sequence[float]) -> dict:
    """Axis lines that reach over the data and no further."""
    panel["range"] = {"x": (min(x), max(x)), "y": (min(y), max(y))} if len(x) and len(y) else None
    return panel


def direct_label(panel: dict, x: float, y: float, text: str, offset: tuple[float, float] = (5, 5), **options) -> dict:
    panel.setdefault("labels", []).append({"x": x, "y": y, "text": text, "offset": offset, **options})
    return panel


def direct_label_line(panel: dict, x: Sequence[float], y: Sequence[float], text: str, position: str = "end", **options) -> dict:
    """A line's label at its start, middle or end instead of in a legend."""
    if position not in ("start", "middle", "end"):
        raise ValueError(f"unknown position {position!r}")
    k = {"start": 0, "middle": len(x) // 2, "end": len(x) - 1}[position]
    return direct_label(panel, x[k], y[k], text, **options)


def add_subtle_grid(panel: dict, axis: str = "y", **options) -> dict:
    panel["grid"] = {"axis": axis, "color": "#e0e0e0", "width": 0.5, **options}
    return panel


def set_tufte_title(panel: dict, title: str, **options) -> dict:
    panel["title"] = {"text": title, "align": "left", "weight": "normal", **options}
    return panel


def set_tufte_labels(panel: dict, xlabel: str | None = None, ylabel: str | None = None, **options) -> dict:
    panel["axis_labels"] = {"x": xlabel, "y": ylabel, **options}
    return panel
