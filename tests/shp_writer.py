"""Tiny shapefile writer used only by the tests (polygons / points + dbf)."""

import struct


def _write(path, stype, records, fields, rows, encoding="cp932"):
    contents = []
    for rec in records:
        if stype == 1:
            contents.append(struct.pack("<i2d", 1, *rec))
        else:
            parts, pts = [], []
            for ring in rec:
                parts.append(len(pts))
                pts.extend(ring)
            xs = [p[0] for p in pts]
            ys = [p[1] for p in pts]
            body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(pts))
            body += struct.pack(f"<{len(parts)}i", *parts)
            body += struct.pack(f"<{2 * len(pts)}d", *[c for p in pts for c in p])
            contents.append(body)
    shp, shx, off = b"", b"", 50
    for i, c in enumerate(contents):
        shp += struct.pack(">2i", i + 1, len(c) // 2) + c
        shx += struct.pack(">2i", off, len(c) // 2)
        off += 4 + len(c) // 2
    def header(total_len):
        return (struct.pack(">7i", 9994, 0, 0, 0, 0, 0, total_len // 2) + struct.pack("<2i", 1000, stype)
                + struct.pack("<8d", 0, 0, 0, 0, 0, 0, 0, 0))
    with open(path + ".shp", "wb") as f:
        f.write(header(100 + len(shp)) + shp)
    with open(path + ".shx", "wb") as f:
        f.write(header(100 + len(shx)) + shx)
    widths = [w for _, w in fields]
    rlen = 1 + sum(widths)
    hlen = 32 + 32 * len(fields) + 1
    dbf = struct.pack("<B3BIHH20x", 3, 25, 1, 1, len(rows), hlen, rlen)
    for name, w in fields:
        dbf += name.encode("ascii").ljust(11, b"\x00") + b"C" + b"\x00" * 4 + bytes([w, 0]) + b"\x00" * 14
    dbf += b"\x0D"
    for r in rows:
        dbf += b" " + b"".join(str(v).encode(encoding).ljust(w)[:w] for v, w in zip(r, widths))
    dbf += b"\x1A"
    with open(path + ".dbf", "wb") as f:
        f.write(dbf)


def write_polygons(path, polys, fields, rows):
    _write(path, 5, polys, fields, rows)


def write_points(path, pts, fields, rows):
    _write(path, 1, pts, fields, rows)
