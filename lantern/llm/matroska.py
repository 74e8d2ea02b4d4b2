"""Media columns: Matroska files written from and read back into packet tables.

Reading parses variable-length EBML ids and sizes, the header, Info, Tracks, Cues and
Clusters with SimpleBlocks and BlockGroups in all four lacing modes (none, Xiph,
fixed-size, EBML), unknown-size Segments and Clusters included, and gives a packet
table: track, timestamp, byte range.  Writing stores a payload as unsigned 8-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import id_text
from lantern.llm.token_count import slices

EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SIMPLE, GROUP, BLOCK, TIMESTAMP = 0xA3, 0xA0, 0xA1, 0xE7
_TOP = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}
RATE = 8000
FRAME = 64
#: Frames of a block and blocks of a cluster in files that this module writes.
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 32, 64
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Broken(ValueError):
    """The bytes are not a readable Matroska file."""


def vint(n: int, width: int = 0) -> bytes:
    """A size; the all-ones pattern of each width means unknown and is never made."""
    w = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * w)).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_id(b, at: int) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        raise Broken(f"no element id at {at}")
    w = 9 - b[at].bit_length()
    if w > 4 or at + w > len(b):
        raise Broken(f"no element id at {at}")
    return int.from_bytes(b[at : at + w], "big"), at + w


def read_size(b, at: int) -> tuple[int | None, int]:
    """The value of a size, None where it is unknown, and the place after it."""
    if at >= len(b) or not b[at]:
        raise Broken(f"no size at {at}")
    w = 9 - b[at].bit_length()
    if at + w > len(b):
        raise Broken(f"a size is cut short at {at}")
    n = int.from_bytes(b[at : at + w], "big") & ((1 << 7 * w) - 1)
    return (None if n == (1 << 7 * w) - 1 else n), at + w


def lace(frames: list[bytes], mode: int) -> bytes:
    """The body of a block after its flags."""
    if mode == NO_LACING:
        return frames[0]
    out = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif mode == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            out += vint(d + (1 << (7 * w - 1)) - 1, w)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return bytes(out) + b"".join(frames)


def unlace(b, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """The byte ranges of the frames of a block."""
    if mode == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Broken("a laced block without a frame count")
    n, at = b[at] + 1, at + 1
    sizes = []
    if mode == XIPH:
        for _ in range(n - 1):
            s = 0
            while True:
                if at >= end:
                    raise Broken("a lace is cut short")
                s, at = s + b[at], at + 1
                if b[at - 1] != 255:
                    break
            sizes.append(s)
    elif mode == EBML_LACING:
        for k in range(n - 1):
            w = 9 - b[at].bit_length() if at < end and b[at] else 0
            s, at = read_size(b, at)
            if s is None:
                raise Broken("an unknown size in a lace")
            sizes.append(s if not k else sizes[-1] + s - ((1 << (7 * w - 1)) - 1))
    else:
        if (end - at) % n:
            raise Broken("a fixed-size lace that doesn't divide")
        sizes = [(end - at) // n] * (n - 1)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Broken("laced frames are longer than their block")
    out = []
    for s in [*sizes, rest]:
        out.append((at, at + s))
        at += s
    return out


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float | None = None
    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (cluster, track, timestamp in ticks, keyframe, lacing, start, end)
    packets: list[tuple] = field(default_factory=list)
    #: (time, track, cluster position in the segment)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    segment_at: int = 0


def _children(b, at: int, end: int, stop: set[int] = frozenset()):
    """(id, start of body, end of body, start of element); an unknown size ends at an element of `stop` or at `end`."""
    while at < end:
        start = at
        ident, at = read_id(b, at)
        size, at = read_size(b, at)
        if size is None:
            if ident == SEGMENT:
                last = end
            elif ident == CLUSTER:
                last = at
                while last < end:
                    k, p = read_id(b, last)
                    if k in _TOP:
                        break
                    s, p = read_size(b, p)
                    if s is None:
                        raise Broken("an unknown size below a cluster")
                    last = p + s
            else:
                raise Broken(f"an unknown size for element {ident:x}")
        else:
            last = at + size
        if last > end:
            raise Broken(f"element {ident:x} at {start} is cut short")
        yield ident, at, last, start
        at = last


def _number(b, at: int, end: int) -> int:
    return int.from_bytes(b[at:end], "big")


def _real(b, at: int, end: int) -> float:
    if end == at:
        return 0.0
    if end - at not in (4, 8):
        raise Broken(f"a float of {end - at} bytes")
    return struct.unpack(">f" if end - at == 4 else ">d", b[at:end])[0]


def _block(b, at: int, end: int, m: Media, time: int, key: bool | None) -> None:
    track, at = read_size(b, at)
    if track is None or at + 3 > end:
        raise Broken("a block without its head")
    rel, flags = struct.unpack_from(">hB", b, at)
    mode = flags >> 1 & 3
    frames = unlace(b, at + 3, end, mode)
    step = m.tracks.get(track, {}).get("step", 0)
    for k, (s, e) in enumerate(frames):
        m.packets.append((len(m.clusters) - 1, track, time + rel + (k * step) // m.scale, bool(flags & 0x80) if key is None else key, mode, s, e))


def demux(b: bytes) -> Media:
    """The packet table of a whole file."""
    m, seen = Media(), False
    for ident, at, end, _ in _children(b, 0, len(b)):
        if ident == EBML:
            seen = True
            for k, s, e, _ in _children(b, at, end):
                if k == 0x4282:
                    m.doc_type = bytes(b[s:e]).decode("ascii", "replace").rstrip("\0")
        elif ident == SEGMENT:
            m.segment_at = at
            for k, s, e, start in _children(b, at, end):
                if k == INFO:
                    for x, p, q, _ in _children(b, s, e):
                        if x == 0x2AD7B1:
                            m.scale = _number(b, p, q) or 1_000_000
                        elif x == 0x4489:
                            m.duration = _real(b, p, q)
                elif k == TRACKS:
                    for x, p, q, _ in _children(b, s, e):
                        if x == 0xAE:
                            _track(b, p, q, m)
                elif k == CLUSTER:
                    _cluster(b, s, e, start - at, m)
                elif k == CUES:
                    _cues(b, s, e, m)
    if not seen:
        raise Broken("no EBML header")
    return m


def _track(b, at: int, end: int, m: Media) -> None:
    t: dict = {"number": 0, "type": 0, "codec": "", "step": 0}
    for k, s, e, _ in _children(b, at, end):
        if k == 0xD7:
            t["number"] = _number(b, s, e)
        elif k == 0x83:
            t["type"] = _number(b, s, e)
        elif k == 0x86:
            t["codec"] = bytes(b[s:e]).decode("ascii", "replace").rstrip("\0")
        elif k == 0x23E383:
            t["step"] = _number(b, s, e)
        elif k == 0xE1:
            for x, p, q, _ in _children(b, s, e):
                if x == 0xB5:
                    t["rate"] = _real(b, p, q)
                elif x == 0x9F:
                    t["channels"] = _number(b, p, q)
                elif x == 0x6264:
                    t["bits"] = _number(b, p, q)
    m.tracks[t["number"]] = t


def _cluster(b, at: int, end: int, position: int, m: Media) -> None:
    time = 0
    m.clusters.append((position, 0))
    for k, s, e, _ in _children(b, at, end):
        if k == TIMESTAMP:
            time = _number(b, s, e)
            m.clusters[-1] = (position, time)
        elif k == SIMPLE:
            _block(b, s, e, m, time, None)
        elif k == GROUP:
            parts = [(x, p, q) for x, p, q, _ in _children(b, s, e)]
            key = all(x != 0xFB for x, _, _ in parts)
            for x, p, q in parts:
                if x == BLOCK:
                    _block(b, p, q, m, time, key)


def _cues(b, at: int, end: int, m: Media) -> None:
    for k, s, e, _ in _children(b, at, end):
        if k != 0xBB:
            continue
        time, places = 0, []
        for x, p, q, _ in _children(b, s, e):
            if x == 0xB3:
                time = _number(b, p, q)
            elif x == 0xB7:
                place = {y: _number(b, u, v) for y, u, v, _ in _children(b, p, q)}
                places.append((place.get(0xF7, 0), place.get(0xF1, 0)))
        m.cues += [(time, t, pos) for t, pos in places]


def mux(payload: bytes, frame: int = FRAME, lacing: int = FIXED, rate: int = RATE) -> bytes:
    """A file with one track of unsigned 8-bit PCM whose frames, in order, are the payload."""
    header = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    step = frame * 1_000_000_000 // rate  # nanoseconds of a frame; a tick is one frame
    n = -(-len(payload) // frame)
    info = element(INFO, uint(0x2AD7B1, step) + element(0x4489, struct.pack(">d", float(n))) + element(0x4D80, b"lantern") + element(0x5741, b"lantern"))
    audio = element(0xE1, element(0xB5, struct.pack(">d", float(rate))) + uint(0x9F, 1) + uint(0x6264, 8))
    tracks = element(TRACKS, element(0xAE, uint(0xD7, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + uint(0x23E383, step) + element(0x86, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    per = frame * (1 if lacing == NO_LACING else FRAMES_PER_BLOCK)
    for start in range(0, len(payload), per * BLOCKS_PER_CLUSTER):
        tick = start // frame
        blocks = [uint(TIMESTAMP, tick)]
        stop = min(len(payload), start + per * BLOCKS_PER_CLUSTER)
        for s in range(start, stop, per):
            piece = payload[s : min(stop, s + per)]
            head = b"\x81" + struct.pack(">hB", s // frame - tick, 0x80 | (lacing << 1))
            if lacing in (NO_LACING, FIXED) and len(piece) % frame == 0:
                laced = piece if lacing == NO_LACING else bytes([len(piece) // frame - 1]) + piece
                blocks.append(element(SIMPLE, head + laced))
            else:
                mode = XIPH if lacing == FIXED else lacing  # a short last frame can't be laced at fixed size
                head = b"\x81" + struct.pack(">hB", s // frame - tick, 0x80 | (mode << 1))
                blocks.append(element(SIMPLE, head + lace([piece[i : i + frame] for i in range(0, len(piece), frame)], mode)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(0xBB, uint(0xB3, tick) + element(0xB7, uint(0xF7, 1) + uint(0xF1, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def describe(m: Media) -> str:
    """One line on a packet table: track format, counts, end of time, and how many cues point at a cluster of theirs."""
    t = m.tracks.get(1, {})
    there = set(m.clusters)
    good = sum((pos, time) in there for time, _, pos in m.cues)
    last = max((p[2] for p in m.packets), default=-1) + 1
    sizes = sum(p[6] - p[5] for p in m.packets)
    return f"{m.doc_type};{t.get('codec')};{t.get('rate', 0):.0f}Hz;{t.get('channels')}ch;{t.get('bits')}bit;clusters={len(m.clusters)};packets={len(m.packets)};bytes={sizes};cues={good}/{len(m.cues)};ticks={last};ns={last * m.scale}"


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text as a Matroska file, padded with zero bytes to a positive multiple of 64."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 128):
                pairs = [padded(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([mux(p) for _, p in pairs], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "media_id long, cluster int, track long, timestamp_ns long, keyframe boolean, lacing int, byte_start long, byte_end long, error string"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file.

    A file that is null, empty or can't be read to its end has one row instead, with its
    id and what is wrong; a readable file without packets has none.  Repeated rows stay.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, 64):
                rows: list[tuple] = []
                for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        if not blob:
                            raise Broken("no bytes")
                        m = demux(blob)
                        rows += [(i, c, t, at * m.scale, k, lacing, s, e, None) for c, t, at, k, lacing, s, e in m.packets]
                    except (Broken, struct.error, IndexError) as e:
                        rows.append((i, None, None, None, None, None, None, None, str(e) or type(e).__name__))
                cols = list(zip(*rows)) or [()] * 9
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PACKETS.split(", ")])

    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(run, PACKETS)


def media_features(docs: DataFrame) -> DataFrame:
    """Per row: what went in, what was stored, and what came back out of the stored bytes.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  A null text is empty: a payload of 64 zero bytes.  Equal
    texts have equal values; rows stay rows.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, 128):
                out: list[tuple] = []
                for t in b.column(1).to_pylist():
                    n, payload = padded(t)
                    stored = mux(payload)
                    m = demux(stored)
                    view = memoryview(stored)
                    back = b"".join(view[p[5] : p[6]] for p in m.packets if p[1] == 1)
                    out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(m)))
                cols = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
