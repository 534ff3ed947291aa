"""Binary model files: dense (FBZ1), sparse (FBZ2), flat and TMPY layouts, to and from ``ClauseModel``.

The layouts are fixed by the files themselves; each is read through one cursor and written through one buffer.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

from bitballot.operators.clauses import ClauseModel

#: Magic, version, thresholds, classes, clamp, clauses, packed size, plain size.
HEADER = "4sBHHBIII"
DENSE, SPARSE, TMPY = b"FBZ1", b"FBZ2", b"TMPY"


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def array(self, dtype: str, n: int):
        return np.frombuffer(self.take(np.dtype(dtype).itemsize * n), dtype).copy()

    def strings(self) -> list[str]:
        return [self.take(self.unpack("H")[0]).decode() for _ in range(self.unpack("H")[0])]


def packed_strings(items: list[str]) -> bytes:
    raw = [s.encode() for s in items]
    if len(raw) > 65_535 or any(len(b) > 65_535 for b in raw):
        raise ValueError("at most 65 535 strings of 65 535 bytes")
    return struct.pack("<H", len(raw)) + b"".join(struct.pack("<H", len(b)) + b for b in raw)


def string_table(data: bytes) -> list[str]:
    return Cursor(data).strings()


def mask(bits: list[int], size: int) -> bytes:
    on = np.zeros(8 * size, np.uint8)
    on[bits] = 1
    return np.packbits(on, bitorder="little").tobytes()


def unmask(data: bytes, n: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n]).tolist()


def groups(model: ClauseModel):
    """Clauses by class, the positive before the negative, in order."""
    rows = model.rows()
    for k in range(model.classes):
        for sign in (1, -1):
            yield sorted((r for r in rows if r[0] == k and r[1] == sign), key=lambda r: r[2])


def encode(model: ClauseModel, sparse: bool = False, clamp_max: int | None = None, level: int = 22) -> bytes:
    n, size = len(model.feat), (len(model.feat) + 7) // 8
    if n > 65_535:
        raise ValueError("at most 65 535 thresholds")
    body = bytearray()
    for group in groups(model):
        if len(group) > 65_535:
            raise ValueError("at most 65 535 clauses of a class and sign")
        body += struct.pack("<H", len(group))
        for _, _, _, clamp, pos, neg in group:
            body.append(min(clamp, 255))
            if sparse:
                for bits in (pos, neg):
                    body += struct.pack(f"<H{len(bits)}H", len(bits), *bits)
            else:
                body += mask(pos, size) + mask(neg, size)
    small = zstandard.ZstdCompressor(level=level).compress(bytes(body))
    top = clamp_max if clamp_max is not None else min(255, int(model.clamp.max(initial=0)))
    head = struct.pack("<" + HEADER, SPARSE if sparse else DENSE, 1, n, model.classes, top, len(model.cls), len(small), len(body))
    return head + model.feat.astype("<i4").tobytes() + model.thresh.astype("<f4").tobytes() + packed_strings(model.feature_names) + packed_strings(model.class_names) + small


def decode(data: bytes) -> ClauseModel:
    """Either of the compressed layouts, by its magic."""
    c = Cursor(data)
    magic, version, n, classes, _, total, small, plain = c.unpack(HEADER)
    if magic not in (DENSE, SPARSE) or version != 1:
        raise ValueError(f"not a model file: {magic!r}, version {version}")
    feat, thresh = c.array("<i4", n), c.array("<f4", n)
    features, names = c.strings(), c.strings()
    body = zstandard.ZstdDecompressor().decompress(c.take(small), max_output_size=plain)
    if len(body) != plain:
        raise ValueError(f"{len(body)} bytes unpacked, {plain} announced")
    b, size, rows = Cursor(body), (n + 7) // 8, []
    for k in range(classes):
        for sign in (1, -1):
            for i in range(b.unpack("H")[0]):
                clamp = b.unpack("B")[0]
                if magic == DENSE:
                    pos, neg = (unmask(b.take(size), n) for _ in range(2))
                else:
                    pos, neg = (list(b.unpack(f"{b.unpack('H')[0]}H")) for _ in range(2))
                rows.append((k, sign, i, clamp, pos, neg))
    if len(rows) != total:
        raise ValueError(f"{len(rows)} clauses, {total} announced")
    return ClauseModel.of(feat, thresh, rows, classes, features, names)


def encode_flat(model: ClauseModel) -> bytes:
    head = struct.pack("<4I", len(model.feat), model.classes, len(model.cls), model.words)
    parts = [model.feat.astype("<i4"), model.thresh.astype("<f4"), model.pos.astype("<u8"), (model.pos ^ model.neg).astype("<u8"), *(a.astype("<i4") for a in (model.clamp, model.sign, model.cls))]
    return head + b"".join(p.tobytes() for p in parts)


def numbered(cls, sign) -> np.ndarray:
    """The place of each clause among those of its class and sign."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for key in zip(cls.tolist(), sign.tolist()):
        out.append(seen.get(key, 0))
        seen[key] = out[-1] + 1
    return np.array(out, np.int64)


def decode_flat(data: bytes) -> ClauseModel:
    c = Cursor(data)
    n, classes, total, words = c.unpack("4I")
    feat, thresh = c.array("<i4", n), c.array("<f4", n)
    pos, xor = (c.array("<u8", total * words).reshape(total, words) for _ in range(2))
    clamp, sign, cls = (c.array("<i4", total).astype(np.int64) for _ in range(3))
    return ClauseModel(feat, thresh, cls, sign, numbered(cls, sign), clamp, pos, pos ^ xor, classes, [], [str(k) for k in range(classes)])


def encode_tmpy(model: ClauseModel, labels: list[int] | None = None) -> bytes:
    """Needs as many clauses in every class and sign."""
    parts = list(groups(model))
    per = len(parts[0]) if parts else 0
    if any(len(g) != per for g in parts):
        raise ValueError("this layout has one number of clauses")
    index = {(int(k), int(s), int(c)): i for i, (k, s, c) in enumerate(zip(model.cls, model.sign, model.clause))}
    out = bytearray(TMPY + struct.pack("<8I", 1, model.classes, per, model.words, len(model.feat), 0, 0, 0))
    for i, group in enumerate(parts):
        if i % 2 == 0:
            out += struct.pack("<i", labels[i // 2] if labels else i // 2)
        for r in group:
            at = index[r[:3]]
            out += struct.pack("<i", r[3]) + model.pos[at].astype("<u8").tobytes() + model.neg[at].astype("<u8").tobytes()
    return bytes(out) + model.feat.astype("<i4").tobytes() + model.thresh.astype("<f4").tobytes()


def decode_tmpy(data: bytes) -> ClauseModel:
    c = Cursor(data)
    if c.take(4) != TMPY or (version := c.unpack("I")[0]) != 1:
        raise ValueError("not a TMPY file")
    classes, per, words, n = c.unpack("4I")
    c.unpack("3I")
    names, meta, pos, neg = [], [], [], []
    for k in range(classes):
        names.append(str(c.unpack("i")[0]))
        for sign in (1, -1):
            for i in range(per):
                meta.append((k, sign, i, c.unpack("i")[0]))
                pos.append(c.array("<u8", words))
                neg.append(c.array("<u8", words))
    feat, thresh = c.array("<i4", n), c.array("<f4", n)
    m = np.array(meta, np.int64).reshape(-1, 4)
    stack = lambda a: np.array(a, np.uint64).reshape(len(meta), words)
    return ClauseModel(feat, thresh, m[:, 0], m[:, 1], m[:, 2], m[:, 3], stack(pos), stack(neg), classes, [], names)


#: Where the two JSON shapes keep the rules of the classes, the clauses for and against a class, the
#: literals, the negated literals and the clamp of clauses without one.
LISTED = {"rules": "class_rules", "for": "positive_clauses", "against": "negative_clauses", "in": "include", "out": "exclude", "clamp": ("config", "LF")}
MAPPED = {"rules": "classes", "for": "positive", "against": "negative", "in": "include", "out": "include_inverted", "clamp": ("LF",)}
#: The clamp where a file names none.
USUAL_CLAMP = 15


def within(spec, path: tuple[str, ...]):
    for key in path:
        spec = (spec or {}).get(key)
    return spec


def rules_json(text: str, feat, thresh) -> ClauseModel:
    """Either JSON shape: classes listed beside their rules, or mapped to them.  The shape's own place of the clamp counts before the other's."""
    spec = json.loads(text)
    shape, other = (LISTED, MAPPED) if isinstance(spec["classes"], list) else (MAPPED, LISTED)
    clamps = [c for c in (within(spec, s["clamp"]) for s in (shape, other)) if c]
    usual = int(clamps[0]) if clamps else USUAL_CLAMP
    names, table = [str(n) for n in spec["classes"]], spec[shape["rules"]]
    rows = [
        (k, sign, i, min(255, int(c.get("clamp") or usual)), c.get(shape["in"]) or [], c.get(shape["out"]) or [])
        for k, name in enumerate(names)
        for sign, side in ((1, "for"), (-1, "against"))
        for i, c in enumerate((table.get(name) or {}).get(shape[side]) or [])
    ]
    return ClauseModel.of(feat, thresh, rows, len(names), class_names=names)


def to_rules_json(model: ClauseModel, listed: bool = True) -> str:
    """The clauses of a model in either shape, each with its clamp."""
    shape = LISTED if listed else MAPPED
    names = model.class_names or [str(k) for k in range(model.classes)]
    rules = {n: {shape["for"]: [], shape["against"]: []} for n in names}
    for k, sign, _, clamp, pos, neg in sorted(model.rows(), key=lambda r: (r[0], -r[1], r[2])):
        rules[names[k]][shape["for" if sign > 0 else "against"]].append({"clamp": clamp, shape["in"]: pos, shape["out"]: neg})
    return json.dumps({"classes": names, shape["rules"]: rules} if listed else {shape["rules"]: rules})


def binariser_json(feat, thresh, n_features: int, n_bins: int, quantise: bool = False) -> str:
    t = np.asarray(thresh, np.float64)
    out = {"version": "2", "n_features_in": n_features, "n_bits": len(t), "feat_idx": [int(f) for f in feat], "n_bins_param": n_bins, "quantised": quantise}
    if quantise:
        low, high = (float(t.min()), float(t.max())) if len(t) else (0.0, 0.0)
        scale = (high - low) / 65535 if high > low else 1.0
        out |= {"thresh_q": np.clip(np.rint((t - low) / scale), 0, 65535).astype(int).tolist(), "thresh_scale": scale, "thresh_zp": low}
    else:
        out["thresh"] = [float(np.float32(x)) for x in t]
    return json.dumps(out)


def read_binariser_json(text: str):
    p = json.loads(text)
    values = np.array(p["thresh_q"], np.float64) * p["thresh_scale"] + p["thresh_zp"] if p.get("quantised") else np.array(p["thresh"], np.float64)
    return np.array(p["feat_idx"], np.int32), values.astype(np.float32)
