"""Vector markup from page-description logs: one SVG document for each page or layer.

A painted path becomes one element that carries its own paint, matrix and clip, so elements don't
depend on each other and can be filtered afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: line caps and joins by number
CAPS, JOINS = ("butt", "round", "square"), ("miter", "round", "bevel")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def number(v: float) -> str:  # F20
    if not np.isfinite(v):
        return "0"
    return str(int(v)) if v == int(v) else f"{v:.8f}".rstrip("0").rstrip(".")


def css_color(args: list) -> str:  # F22
    if isinstance(args[0], str):
        return args[0]
    v = [float(x) for x in args[:3]]
    k = 255 if all(0 <= x <= 1 for x in v) else 1
    return "#" + "".join(f"{int(max(0, min(255, np.floor(x * k + 0.5)))):02x}" for x in v)


def times(m, n):  # M2
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def page_box(m, width: float, height: float) -> tuple[float, float, float, float]:  # M3, G12, M31
    """The page's rectangle seen through the inverse of a matrix, as x, y, width, height."""
    det = m[0] * m[3] - m[1] * m[2]
    inv = IDENTITY if det == 0 else (m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[4] * m[3]) / det, (m[4] * m[1] - m[5] * m[0]) / det)
    xs = [inv[0] * x + inv[2] * y + inv[4] for x in (0, width) for y in (0, height)]
    ys = [inv[1] * x + inv[3] * y + inv[5] for x in (0, width) for y in (0, height)]
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def path_data(ops: list[str], args: list[float], at: tuple[float, float] = (0.0, 0.0)) -> tuple[str, tuple[float, float]]:  # M25
    """SVG path data and the last point; curveTo2 starts its first control at the last point, curveTo3 ends its second at the end."""
    out, i = [], 0
    for op in ops:
        n = {"moveTo": 2, "lineTo": 2, "curveTo": 6, "curveTo2": 4, "curveTo3": 4, "closePath": 0, "rectangle": 4}[op]
        v, i = list(args[i : i + n]), i + n
        if op == "rectangle":
            x, y, w, h = v
            out.append(" ".join(f"{c} {number(p)} {number(q)}" for c, p, q in (("M", x, y), ("L", x + w, y), ("L", x + w, y + h), ("L", x, y + h))) + " Z")
            at = (x, y)
        elif op == "closePath":
            out.append("Z")
        else:
            v = [*at, *v] if op == "curveTo2" else [*v, *v[2:]] if op == "curveTo3" else v
            out.append({"moveTo": "M", "lineTo": "L"}.get(op, "C") + " " + " ".join(map(number, v)))
            at = (v[-2], v[-1])
    return " ".join(out), at


@dataclass(frozen=True)
class State:
    matrix: tuple = IDENTITY
    fill: str = "#000000"
    stroke: str = "#000000"
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    width: float = 1.0
    cap: str = ""
    join: str = ""
    miter: float = 0.0
    dash: tuple = ()
    phase: float = 0.0
    blend: str = "normal"
    clip: str = ""


@dataclass
class Drawing:
    """Folds a log into elements and definitions."""

    width: float
    height: float
    state: State = State()
    stack: list = field(default_factory=list)
    path: str = ""
    at: tuple = (0.0, 0.0)
    pending: str = ""
    defs: list = field(default_factory=list)
    body: list = field(default_factory=list)

    def set(self, **kv) -> None:
        self.state = replace(self.state, **kv)

    def _add(self, tag: str, attrs: dict, blend: bool = True) -> None:
        s = self.state
        if s.matrix != IDENTITY:
            attrs["transform"] = f"matrix({' '.join(map(number, s.matrix))})"
        if blend and s.blend != "normal":
            attrs["style"] = f"mix-blend-mode:{s.blend}"
        one = f"<{tag} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in attrs.items()) + "/>"
        self.body.append(f'<g clip-path="{s.clip}">{one}</g>' if s.clip else one)

    def _stroke(self, full: bool) -> dict:
        s = self.state
        a = {"stroke": s.stroke, "stroke-opacity": number(s.stroke_alpha), "stroke-width": number(s.width)}
        if s.cap:
            a["stroke-linecap"] = s.cap
        if s.join:
            a["stroke-linejoin"] = s.join
        if full and s.miter > 0:
            a["stroke-miterlimit"] = number(s.miter)
        if full and s.dash:
            a |= {"stroke-dasharray": " ".join(map(number, s.dash)), "stroke-dashoffset": number(s.phase)}
        return a

    def paint(self, fill: bool, stroke: bool, even_odd: bool, close: bool) -> None:  # M30
        if self.path:
            if close:
                self.path += " Z"
            a = {"d": self.path} | ({"fill": self.state.fill, "fill-opacity": number(self.state.fill_alpha)} if fill else {"fill": "none"})
            if fill and even_odd:
                a["fill-rule"] = "evenodd"
            self._add("path", a | (self._stroke(full=not fill) if stroke else {}))
        self.end_path()

    def end_path(self) -> None:  # M29
        if self.pending and self.path:
            i = f"clip-{len(self.defs)}"
            outer = f' clip-path="{self.state.clip}"' if self.state.clip else ""
            self.defs.append(f'<clipPath id="{i}"{outer}><path d={quoteattr(self.path)} clip-rule="{self.pending}" transform="matrix({" ".join(map(number, self.state.matrix))})"/></clipPath>')
            self.set(clip=f"url(#{i})")
        self.pending, self.path = "", ""

    def shading(self, p: dict) -> None:  # M28, M31
        i = f"shade-{len(self.defs)}"
        kind = p.get("kind")
        names = {"axial": ("linearGradient", ("x1", "y1", "x2", "y2")), "radial": ("radialGradient", ("fx", "fy", "fr", "cx", "cy", "r"))}.get(kind)
        if not names:
            return
        at = " ".join(f'{k}="{number(v)}"' for k, v in zip(names[1], p["at"], strict=True))
        stops = "".join(f'<stop offset="{o}" stop-color="{c}"/>' for o, c in p["stops"])
        self.defs.append(f'<{names[0]} id="{i}" gradientUnits="userSpaceOnUse" {at}>{stops}</{names[0]}>')
        x, y, w, h = page_box(self.state.matrix, self.width, self.height)
        self._add("rect", {"x": number(x), "y": number(y), "width": number(w), "height": number(h), "fill": f"url(#{i})", "fill-opacity": number(self.state.fill_alpha)})

    def run(self, op: str, a: list) -> None:  # M26, M27
        num = lambda i: float(a[i]) if len(a) > i and a[i] is not None else 0.0
        paints = {"fill": (1, 0, 0, 0), "eoFill": (1, 0, 1, 0), "stroke": (0, 1, 0, 0), "closeStroke": (0, 1, 0, 1), "fillStroke": (1, 1, 0, 0), "eoFillStroke": (1, 1, 1, 0), "closeFillStroke": (1, 1, 0, 1), "closeEOFillStroke": (1, 1, 1, 1)}
        if op in paints:
            self.paint(*map(bool, paints[op]))
        elif op == "save":
            self.stack.append(self.state)
        elif op == "restore":
            self.state, self.pending = self.stack.pop() if self.stack else State(), ""
        elif op == "transform" and len(a) >= 6:
            self.set(matrix=times(self.state.matrix, tuple(map(float, a[:6]))))
        elif op == "constructPath":
            self.path, self.at = path_data(a[0], a[1], self.at)
        elif op == "closePath" and self.path:
            self.path += " Z"
        elif op == "endPath":
            self.end_path()
        elif op in ("clip", "eoClip"):
            self.pending = "nonzero" if op == "clip" else "evenodd"
        elif op == "setFillRGBColor":
            self.set(fill=css_color(a))
        elif op == "setStrokeRGBColor":
            self.set(stroke=css_color(a))
        elif op == "setLineWidth":
            self.set(width=max(0.0, num(0)))
        elif op == "setLineCap":
            self.set(cap=CAPS[int(num(0))] if 0 <= num(0) < 3 else "")
        elif op == "setLineJoin":
            self.set(join=JOINS[int(num(0))] if 0 <= num(0) < 3 else "")
        elif op == "setMiterLimit":
            self.set(miter=num(0))
        elif op == "setDash":
            self.set(dash=tuple(a[0] or ()), phase=num(1))
        elif op == "setGState":
            for key, v in a[0] or ():
                change = {"LW": ("width", "setLineWidth"), "LC": ("cap", "setLineCap"), "LJ": ("join", "setLineJoin"), "ML": ("miter", "setMiterLimit")}.get(key)
                if change:
                    self.run(change[1], [v])
                elif key == "CA":
                    self.set(stroke_alpha=float(v))
                elif key == "ca":
                    self.set(fill_alpha=float(v))
                elif key == "BM":
                    self.set(blend="normal" if not isinstance(v, str) or v == "source-over" else v)
                elif key == "D":
                    self.run("setDash", list(v))
        elif op == "shadingFill" and a and isinstance(a[0], dict):
            self.shading(a[0])
        elif op == "paintFormXObjectBegin":
            if a[0] is not None and len(a[0]) == 6:
                self.run("transform", a[0])
            if len(a) > 1 and a[1] is not None and len(a[1]) >= 4:
                x, y, r, b = a[1][:4]
                self.path, self.pending = path_data(["rectangle"], [x, y, r - x, b - y])[0], "nonzero"
                self.end_path()

    def markup(self) -> str:  # M32, F23
        defs = f"<defs>{''.join(self.defs)}</defs>" if self.defs else ""
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{number(self.width)}" height="{number(self.height)}">{defs}{"".join(self.body)}</svg>'


def draw(log: list[tuple[str, list]], width: float, height: float) -> str | None:
    """The markup of a log, or null where nothing is painted."""
    d = Drawing(width, height)
    for op, args in log:
        d.run(op, args)
    return d.markup() if d.body else None


def layer_markup(ops: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # P36
    """keys, markup of each log. ops: keys, idx, op, args (JSON array), page_w, page_h. A log that fails gives null markup and its error."""
    import json

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        try:
            svg, error = draw([(o, json.loads(a) if a else []) for o, a in zip(pdf.op, pdf.args, strict=True)], float(pdf.page_w.iloc[0]), float(pdf.page_h.iloc[0])), None
        except Exception as e:  # noqa: BLE001 - a broken layer becomes a report row, the others go on
            svg, error = None, f"{type(e).__name__}: {e}"
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), svg, error)], columns=[*keys, "markup", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in ops.schema}
    return ops.groupBy(*keys).applyInPandas(fold, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "markup string", "error string"]))
