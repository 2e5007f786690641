"""Drawings and meshes in open text or simple binary forms: DXF, OBJ, STL, Gerber, drill files, SVG, STEP and IFC."""

from __future__ import annotations

import gzip
import io
import math
import re
import tarfile
import zlib
from xml.etree import ElementTree as ET

import numpy as np

from .formats import Unreadable, decode_bytes, zip_entries


#: Bytes that an archive may expand to, with all archives inside.
MOST_EXPANDED = 1 << 30


def unpacked(data: bytes, depth: int = 3, most: int = MOST_EXPANDED) -> list[tuple[str, bytes]]:
    """Files of a zip, gzip or tar, archives inside included; TOO_LARGE beyond `most` bytes in all."""
    try:
        if data.startswith(b"PK"):
            found = zip_entries(data, most)
        elif data.startswith(b"\x1f\x8b"):
            with gzip.open(io.BytesIO(data)) as f:
                found = [("", f.read(most + 1))]
        elif data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        else:
            return [("", data)]
    except (zlib.error, EOFError, OSError, tarfile.TarError) as e:
        raise Unreadable("UNREADABLE", "archive is damaged") from e
    most -= sum(len(b) for _, b in found)
    if most < 0:
        raise Unreadable("TOO_LARGE", "the archive expands beyond its limit")
    out = []
    for name, body in found:
        inner = unpacked(body, depth - 1, most) if depth else [("", body)]
        if inner != [("", body)]:
            most -= sum(len(b) for _, b in inner)
        out += [("/".join(filter(None, (name, n))), b) for n, b in inner]
    return out


def items_of(data: bytes) -> list[dict]:
    """Items of the first form whose signature fits."""
    text = decode_bytes(data)[0]
    for fits, read in ((is_dxf, dxf_items), (is_gerber, gerber_items), (is_drill, drill_items), (is_svg, svg_items)):
        if fits(text):
            return [{"item_no": i} | r for i, r in enumerate(read(text))]
    raise Unreadable("UNSUPPORTED", "no drawing reader fits these bytes")


def _item(kind, layer, xs, ys, text=None, sheet=0):
    return {"sheet": sheet, "item_kind": kind, "layer": layer, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "text": text}


# --- DXF --------------------------------------------------------------------------------------------------


def is_dxf(text: str) -> bool:
    return bool(re.match(r"\s*(999\s*\n.*\n\s*)*0\s*\r?\n\s*SECTION", text))


def dxf_pairs(text: str) -> list[tuple[int, str]]:
    lines = text.splitlines()
    return [(int(lines[i]), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2) if lines[i].strip().lstrip("-").isdigit()]


def plain_mtext(text: str) -> str:
    """Text without inline formatting."""
    text = re.sub(r"\\[ACcFfHQTWp][^;\\{}]*;", "", text)
    text = re.sub(r"\\S([^;]*)[#^/]([^;]*);", r"\1/\2", text)
    text = re.sub(r"\\[LlOoKk]", "", text).replace("\\P", "\n").replace("\\~", " ")
    text = re.sub(r"(?<!\\)[{}]", "", text)
    return re.sub(r"\\([\\{}])", r"\1", text).replace("%%d", "°").replace("%%c", "⌀").replace("%%p", "±")


def dxf_items(text: str) -> list[dict]:
    """Lines, circles, arcs, polylines, points, solids, texts and inserted blocks of model space."""
    entities, blocks, section, block = [], {}, None, None
    current: list[tuple[int, str]] | None = None

    def close():
        if current:
            (blocks[block] if block is not None else entities).append(current) if section in ("ENTITIES", "BLOCKS") else None

    pairs, i = dxf_pairs(text), 0
    while i < len(pairs):
        code, value = pairs[i]
        if code == 0:
            close()
            current = None
            if value == "SECTION":
                section = pairs[i + 1][1] if i + 1 < len(pairs) else None
            elif value == "ENDSEC":
                section = None
            elif value == "BLOCK" and section == "BLOCKS":
                name = next((v for c, v in pairs[i + 1 : i + 12] if c == 2), "")
                block = name
                blocks[name] = []
            elif value == "ENDBLK":
                block = None
            elif section == "ENTITIES" or (section == "BLOCKS" and block is not None):
                current = [(0, value)]
        elif current is not None:
            current.append((code, value))
        i += 1
    close()
    out: list[dict] = []
    _draw(entities, blocks, out, (0.0, 0.0, 1.0, 1.0, 0.0), 0)
    return out


def _draw(entities, blocks, out, place, depth):
    dx, dy, sx, sy, turn = place
    cos, sin = math.cos(turn), math.sin(turn)
    at = lambda x, y: (dx + x * sx * cos - y * sy * sin, dy + x * sx * sin + y * sy * cos)
    poly: list | None = None
    for e in entities:
        kind, first = e[0][1], {}
        for c, v in e:
            first.setdefault(c, v)
        num = lambda c, d=0.0: float(first.get(c, d))  # noqa: E731, B023
        layer = first.get(8, "0")
        if first.get(67) == "1":
            continue  # paper space
        if kind == "VERTEX" and poly is not None:
            poly[1].append(at(num(10), num(20)))
        elif kind == "POLYLINE":
            poly = [layer, []]
        elif kind == "SEQEND" and poly is not None:
            if poly[1]:
                out.append(_item("line", poly[0], *zip(*poly[1], strict=True)))
            poly = None
        elif kind in ("LINE", "SOLID", "TRACE", "3DFACE"):
            points = [at(float(first[10 + j]), num(20 + j)) for j in range(4) if 10 + j in first]
            out.append(_item("line" if kind == "LINE" else "fill", layer, *zip(*points, strict=True)))
        elif kind == "LWPOLYLINE":
            xs, ys = [float(v) for c, v in e if c == 10], [float(v) for c, v in e if c == 20]
            points = [at(x, y) for x, y in zip(xs, ys, strict=False)]
            if points:
                out.append(_item("line", layer, *zip(*points, strict=True)))
        elif kind in ("CIRCLE", "ARC"):
            r, (cx, cy) = num(40), (num(10), num(20))
            a, b = (0.0, 360.0) if kind == "CIRCLE" else (num(50), num(51, 360.0))
            b += 360.0 if b <= a else 0.0
            angles = [a, b, *[q for q in range(-360, 1081, 90) if a <= q <= b]]
            points = [at(cx + r * math.cos(math.radians(q)), cy + r * math.sin(math.radians(q))) for q in angles]
            out.append(_item("arc", layer, *zip(*points, strict=True)))
        elif kind == "POINT":
            x, y = at(num(10), num(20))
            out.append(_item("line", layer, [x], [y]))
        elif kind in ("TEXT", "MTEXT", "ATTDEF", "ATTRIB"):
            x, y = at(num(10), num(20))
            said = "".join(v for c, v in e if c == 3) + first.get(1, "") if kind == "MTEXT" else first.get(1, "")
            out.append(_item("text", layer, [x], [y], plain_mtext(said)))
        elif kind == "INSERT" and depth < 8 and first.get(2) in blocks:
            x, y = at(num(10), num(20))
            _draw(blocks[first[2]], blocks, out, (x, y, sx * num(41, 1), sy * num(42, 1), turn + math.radians(num(50))), depth + 1)


# --- boards -----------------------------------------------------------------------------------------------


def is_gerber(text: str) -> bool:
    return "%FS" in text[:4000] or bool(re.search(r"%MO(IN|MM)\*%", text[:4000]))


def gerber_items(text: str) -> list[dict]:
    """Draws, flashes and arcs in millimetres, sized by their aperture; without a unit, inches."""
    inch = "%MOMM*%" not in text
    unit = 25.4 if inch else 1.0
    spec = re.search(r"%FS([LT])A?X(\d)(\d)Y(\d)(\d)", text)
    zeros, digits = (spec[1], (int(spec[2]), int(spec[3]))) if spec else ("L", (2, 4))

    def coordinate(v):
        if "." in v:
            return float(v) * unit
        sign, v = (-1, v[1:]) if v[:1] == "-" else (1, v.lstrip("+"))
        if zeros == "T":
            v = v.ljust(sum(digits), "0")
        return sign * int(v) / 10 ** digits[1] * unit

    sizes = {int(m[1]): float(m[3]) * unit for m in re.finditer(r"%ADD(\d+)([A-Za-z_.$][\w.$]*),?([\d.]*)[^*]*\*%", text) if m[3]}
    layer = (m[1] if (m := re.search(r"TF\.FileFunction,([^*]*)\*", text)) else "")
    out, x, y, tool, draw = [], 0.0, 0.0, 0, 2
    for word in re.findall(r"(?:^|\*)\s*([^*%]+)(?=\*)", re.sub(r"%[^%]*%", "", text)):
        if m := re.fullmatch(r"\s*(?:G54)?D(\d{2,})\s*", word):
            if int(m[1]) >= 10:
                tool = int(m[1])
                continue
        parts = dict(re.findall(r"([XYIJD])([+-]?[\d.]+)", word))
        if "D" in parts:
            draw = int(parts["D"])
        if not {"X", "Y"} & parts.keys():
            continue
        nx, ny = (coordinate(parts[c]) if c in parts else old for c, old in (("X", x), ("Y", y)))
        half = sizes.get(tool, 0.0) / 2
        if draw in (1, 3):
            xs, ys = ([x, nx], [y, ny]) if draw == 1 else ([nx], [ny])
            out.append(_item("track" if draw == 1 else "pad", layer, [min(xs) - half, max(xs) + half], [min(ys) - half, max(ys) + half]))
        x, y = nx, ny
    return out


def is_drill(text: str) -> bool:
    return text.lstrip().startswith("M48") or bool(re.search(r"(?m)^T\d+C[\d.]+", text[:4000]))


def drill_items(text: str) -> list[dict]:
    """Holes in millimetres with their tool as layer; without a unit, inches; default digits 2.4 and 3.3."""
    metric = bool(re.search(r"(?m)^(METRIC|M71)", text))
    unit, digits = (1.0, (3, 3)) if metric else (25.4, (2, 4))
    keep_leading = bool(re.search(r"(?m)^(INCH|METRIC),LZ", text))

    def coordinate(v):
        if "." in v:
            return float(v) * unit
        sign, v = (-1, v[1:]) if v[:1] == "-" else (1, v.lstrip("+"))
        if keep_leading:
            v = v.ljust(sum(digits), "0")
        return sign * int(v) / 10 ** digits[1] * unit

    sizes = {int(t): float(c) * unit for t, c in re.findall(r"(?m)^T(\d+)[^C\n]*C([\d.]+)", text)}
    out, x, y, tool = [], 0.0, 0.0, 0
    for line in text.splitlines():
        if m := re.fullmatch(r"T(\d+)\s*", line):
            tool = int(m[1])
        elif re.match(r"[XY]", line):
            parts = dict(re.findall(r"([XY])([+-]?[\d.]+)", line))
            x, y = (coordinate(parts[c]) if c in parts else old for c, old in (("X", x), ("Y", y)))
            half = sizes.get(tool, 0.0) / 2
            out.append(_item("hole", f"T{tool}", [x - half, x + half], [y - half, y + half]))
    return out


# --- SVG, meshes, STEP ------------------------------------------------------------------------------------


def is_svg(text: str) -> bool:
    return "<svg" in text[:4000]


def svg_items(text: str) -> list[dict]:
    out = []
    for e in ET.fromstring(text).iter():
        tag, num = e.tag.rpartition("}")[2], lambda k: float(re.match(r"[-\d.]*", e.get(k, "0"))[0] or 0)  # noqa: B023
        layer = e.get("id", "")
        if tag == "rect":
            out.append(_item("fill", layer, [num("x"), num("x") + num("width")], [num("y"), num("y") + num("height")]))
        elif tag == "line":
            out.append(_item("line", layer, [num("x1"), num("x2")], [num("y1"), num("y2")]))
        elif tag in ("circle", "ellipse"):
            rx, ry = (num("r"),) * 2 if tag == "circle" else (num("rx"), num("ry"))
            out.append(_item("arc", layer, [num("cx") - rx, num("cx") + rx], [num("cy") - ry, num("cy") + ry]))
        elif tag in ("polyline", "polygon"):
            v = list(map(float, re.findall(r"-?[\d.]+", e.get("points", ""))))
            if v:
                out.append(_item("line", layer, v[::2], v[1::2]))
        elif tag == "text":
            out.append(_item("text", layer, [num("x")], [num("y")], "".join(e.itertext())))
    return out


def mesh_elements(data: bytes) -> list[dict]:
    if data.lstrip()[:5].lower() == b"solid" or (b"\0" in data and is_binary_stl(data)):
        return stl_elements(data)
    text = decode_bytes(data)[0]
    if re.search(r"(?m)^v\s+-?[\d.]", text):
        return obj_elements(text)
    raise Unreadable("UNSUPPORTED", "no mesh reader fits these bytes")


def _mesh(element, triangles, vertices, points, dropped=0):
    box = {"x0": None, "y0": None, "z0": None, "x1": None, "y1": None, "z1": None}
    if len(points):
        low, high = np.min(points, 0), np.max(points, 0)
        box = dict(zip(box, [*map(float, low), *map(float, high)], strict=True))
    return {"element": element, "vertices": vertices, "triangles": triangles, "dropped": dropped} | box


def obj_elements(text: str) -> list[dict]:
    """Elements by object and group: fan triangles, faces with bad references or under three corners dropped."""
    vertices, found, name, group = [], {}, "", ""
    for line in re.sub(r"\\\r?\n", " ", text).splitlines():
        word, *rest = line.split() or [""]
        if word == "v":
            vertices.append(tuple(map(float, rest[:3])))
        elif word == "o":
            name = " ".join(rest)
        elif word == "g":
            group = " ".join(rest)
        elif word == "f":
            e = found.setdefault((name, group), [0, set(), 0])
            ids = []
            for r in rest:
                k = int(r.split("/")[0])
                ids.append(k - 1 if k > 0 else len(vertices) + k)
            if len(ids) < 3 or any(not 0 <= k < len(vertices) for k in ids):
                e[2] += 1
            else:
                e[0] += len(ids) - 2
                e[1].update(ids)
    return [_mesh("/".join(filter(None, k)), t, len(used), [vertices[i] for i in used], bad) for k, (t, used, bad) in found.items()]


def is_binary_stl(data: bytes) -> bool:
    """By shape, whatever the first word says: a count that fits the length, or bytes that are no text."""
    if len(data) < 84:
        return False
    count = int.from_bytes(data[80:84], "little")
    return 84 + 50 * count == len(data) or (len(data) >= 134 and (b"\0" in data[84:] or not data.lstrip()[:5].lower() == b"solid"))


def stl_elements(data: bytes) -> list[dict]:
    """One element; of a binary file whose count goes beyond its end, the facets that are there."""
    if is_binary_stl(data):
        count = min(int.from_bytes(data[80:84], "little"), (len(data) - 84) // 50)
        facets = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), count, offset=84)
        points = facets["v"].reshape(-1, 3)
    else:
        points = np.array(re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data.decode("latin-1")), float).reshape(-1, 3)
    return [_mesh("", len(points) // 3, len(np.unique(points, axis=0)), points)]


def step_entities(data: bytes) -> list[dict]:
    """Entities of the data section; text in quotes may hold any sign."""
    text = decode_bytes(data)[0]
    if not text.lstrip().startswith("ISO-10303-21"):
        raise Unreadable("UNSUPPORTED", "not an ISO-10303-21 file")
    pattern = r"#(\d+)\s*=\s*([A-Za-z0-9_]*)\s*\(((?:'(?:[^']|'')*'|[^';])*)\)\s*;"
    return [{"id": int(m[1]), "type": m[2].upper(), "args": m[3].strip()} for m in re.finditer(pattern, text)]
