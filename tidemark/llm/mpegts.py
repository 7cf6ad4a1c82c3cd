"""Media columns: payloads stored as MPEG transport streams, parsed back with timestamps and random-access points.

``store_media`` muxes a text or binary column into a binary column of 188-byte transport packets: a program
association table and a program map table before each random-access point, then one PES packet per access unit
with a presentation timestamp, and a clock reference in an adaptation field. ``media_features`` demuxes such
a column: it checks sync bytes, table checksums and continuity counters, reassembles the elementary stream and
keeps (timestamp, packet) of every random-access point. Damaged streams do not raise: what fails is counted.

Null and empty values become a payload of 64 zero bytes. Equal payloads give equal streams, so ties and repeated rows are alike. Very long
texts are whole streams, some ten times their bytes in one task. Rows keep their order and number; null ids and repeated rows pass
through; an empty table gives an empty one; other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts_of

PACKET = 188
#: Fixed values of the format (ISO/IEC 13818-1) and this muxer's choice of ids.
SYNC, PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x47, 0x0000, 0x0100, 0x0101, 0x06, 0xBD
#: Access unit: 22 packets, of which the first carries 8 bytes of adaptation field and 14 of PES header.
UNIT_PACKETS, HEADER, ADAPT = 22, 14, 8
UNIT = 184 * UNIT_PACKETS - ADAPT - HEADER
#: Units from one random-access point to the next; ticks of the 90 kHz clock per unit.
GROUP, TICKS = 8, 3003
WRAP = 1 << 33


@lru_cache(1)
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        out = ((out << np.uint64(1)) ^ np.where(out & np.uint64(0x80000000), np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    return out.astype(np.int64)


@lru_cache(4096)
def section_crc(section: bytes) -> int:
    """CRC-32 of table sections: most significant bit first, all ones at the start, no final inversion."""
    crc, rows = 0xFFFFFFFF, _crc_table()
    for byte in section:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(rows[(crc >> 24) ^ byte])
    return crc


def _section_packet(pid: int, section: bytes) -> np.ndarray:
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The packets of the association table (program 1) and of its map (one private stream, which is also the clock's)."""
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])
    es = bytes([STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])
    pmt = bytes([0x02, 0xB0, 13 + len(es), 0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]) + es
    return _section_packet(PAT_PID, pat), _section_packet(PMT_PID, pmt)


def _stamps(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five timestamp bytes and the six clock bytes of each unit."""
    t = (units.astype(np.int64) * TICKS) % WRAP
    pts = np.stack([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1], 1)
    pcr = np.stack([t >> 25 & 0xFF, t >> 17 & 0xFF, t >> 9 & 0xFF, t >> 1 & 0xFF, (t & 1) << 7 | 0x7E, t * 0], 1)
    return pts.astype(np.uint8), pcr.astype(np.uint8)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one private elementary stream that holds the payload."""
    n = max(1, -(-len(payload) // UNIT))
    full = n - 1 if len(payload) < n * UNIT else n
    tail = payload[full * UNIT :]
    tail_packets = 0
    if full < n:
        tail_packets = 1 + max(0, -(-(len(tail) + HEADER + ADAPT - 184) // 184))
    groups = -(-n // GROUP)
    out = np.full((full * UNIT_PACKETS + tail_packets + 2 * groups, PACKET), 0xFF, np.uint8)
    units = np.arange(n)
    at = UNIT_PACKETS * units + 2 * (units // GROUP + 1)
    for k, packet in enumerate(_tables()):
        rows = at[::GROUP] - 2 + k
        out[rows] = packet
        out[rows, 3] = 0x10 | np.arange(groups) & 15
    es = np.ones(len(out), bool)
    es[at[::GROUP] - 1] = es[at[::GROUP] - 2] = False
    es = np.flatnonzero(es)
    out[es, 0], out[es, 1], out[es, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[es, 3] = 0x10 | np.arange(len(es)) & 15
    out[at, 1] |= 0x40
    out[at, 3] |= 0x20
    pts, pcr = _stamps(units)
    out[at, 4], out[at, 5] = ADAPT - 1, np.where(units % GROUP == 0, 0x50, 0x10)
    out[at, 6:12] = pcr
    head = 4 + ADAPT
    sizes = np.full(n, UNIT)
    if full < n:
        sizes[-1] = len(tail)
        if tail_packets == 1:  # stuffing goes into the adaptation field
            head = 184 + 4 - HEADER - len(tail)
    heads = np.full(n, 4 + ADAPT)
    heads[-1] = head if full < n else 4 + ADAPT
    out[at, 4] = heads - 5
    for k, byte in enumerate((0, 0, 1, STREAM_ID)):
        out[at, heads + k] = byte
    out[at, heads + 4], out[at, heads + 5] = sizes + 8 >> 8, sizes + 8 & 0xFF
    for k, byte in enumerate((0x84, 0x80, 5)):
        out[at, heads + 6 + k] = byte
    for k in range(5):
        out[at, heads + 9 + k] = pts[:, k]
    if full:
        body = np.frombuffer(payload, np.uint8, full * UNIT).reshape(full, UNIT)
        first = 184 - ADAPT - HEADER
        out[at[:full], PACKET - first :] = body[:, :first]
        rows = (at[:full, None] + np.arange(1, UNIT_PACKETS)).ravel()
        out[rows, 4:] = body[:, first:].reshape(-1, 184)
    if full < n:
        row, start = at[-1], heads[-1] + HEADER
        data = np.frombuffer(tail, np.uint8)
        room = PACKET - start
        out[row, start : start + min(room, len(data))] = data[:room]
        rest = data[room:]
        while len(rest):
            row += 1
            if len(rest) >= 184:
                out[row, 4:] = rest[:184]
            else:
                out[row, 3] |= 0x20
                gap = 184 - len(rest)
                out[row, 4] = gap - 1
                if gap > 1:
                    out[row, 5] = 0
                out[row, 4 + gap :] = rest
            rest = rest[184:]
    return out.tobytes()


#: Stream ids whose PES packets have no header beyond their length, and that of padding.
_PLAIN, _PADDING = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF), 0xBE


def _sections(bodies: Iterator[tuple[bytes, bool]]) -> Iterator[bytes | None]:
    """Table sections of one id's payloads, which may go on over packets; None for each that is cut off or too long."""
    open_ = b""
    for body, start in bodies:
        if start:
            pointer = body[0] if body else 0
            open_ += body[1 : 1 + pointer] if open_ else b""
            parts = [open_, body[1 + pointer :]] if open_ else [body[1 + pointer :]]
        elif open_:
            parts = [open_ + body]
        else:
            continue
        open_ = b""
        for k, rest in enumerate(parts):
            while rest and rest[0] != 0xFF:  # stuffing up to the end
                size = 3 + ((rest[1] & 0x0F) << 8 | rest[2]) if len(rest) >= 3 else 4096
                if size > len(rest):
                    break
                yield rest[:size]
                rest = rest[size:]
            if rest and rest[0] != 0xFF:
                if k + 1 < len(parts) or len(rest) >= 4096:
                    yield None  # another section begins where this one should go on
                else:
                    open_ = rest
    if open_:
        yield None


def demux(media: bytes) -> dict:
    """Parse a transport stream. Returns the payload of its first elementary stream and what was found on the way.

    payload bytes, packets, sync_errors, table_errors, cc_errors, pmt_pid, es_pid, stream_type, pes (count),
    pes_errors, first_pts, last_pts, access: (timestamp, packet number) of each random-access point.

    A packet may be sent twice (same counter, same payload): the second is left out; a third is an error. A marked
    discontinuity may jump in the counter. Table sections and PES headers may go on in the next packet; a PES length of 0 means no length.
    """
    whole = len(media) // PACKET
    rows = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    found = {
        "payload": b"", "packets": whole, "sync_errors": int(whole - good.sum()) + (len(media) % PACKET > 0), "table_errors": 0, "cc_errors": 0,
        "pmt_pid": -1, "es_pid": -1, "stream_type": -1, "pes": 0, "pes_errors": 0, "first_pts": -1, "last_pts": -1, "access": [],
    }
    numbers = np.flatnonzero(good)
    rows = rows[numbers]
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    starts = rows[:, 1] & 0x40 > 0
    control = rows[:, 3] >> 4 & 3
    begin = np.where(control & 2 > 0, 5 + rows[:, 4].astype(np.int64), 4)
    has = control & 1 > 0
    flags = np.where((control & 2 > 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    bad = begin > PACKET
    begin = np.minimum(begin, PACKET)
    found["sync_errors"] += int(bad.sum())

    def in_order(pid: int) -> np.ndarray:
        """Packets of an id that carry payload, without repeated ones; counters that do not follow the one before are counted."""
        own = np.flatnonzero((pids == pid) & has)
        if len(own) < 2:
            return own
        step = (rows[own[1:], 3].astype(np.int64) - rows[own[:-1], 3]) & 15
        again = np.zeros(len(own), bool)
        for k in np.flatnonzero(step == 0).tolist():
            a, b = own[k], own[k + 1]
            again[k + 1] = begin[a] == begin[b] and rows[a, begin[a] :].tobytes() == rows[b, begin[b] :].tobytes()
        kept = own[~again]
        thrice = int((again[1:] & again[:-1]).sum())
        step = (rows[kept[1:], 3].astype(np.int64) - rows[kept[:-1], 3]) & 15
        found["cc_errors"] += thrice + int(((step != 1) & (flags[kept[1:]] & 0x80 == 0)).sum())
        return kept

    def section(pid: int, kind: int) -> bytes | None:
        out = None
        for body in _sections((rows[k, begin[k] :].tobytes(), bool(starts[k])) for k in in_order(pid).tolist()):
            if body is None or len(body) < 12 or body[0] != kind or section_crc(body[:-4]) != int.from_bytes(body[-4:], "big"):
                found["table_errors"] += 1
            elif out is None:
                out = body
        return out

    pat = section(PAT_PID, 0x00)
    for i in range(8, len(pat) - 4 if pat else 0, 4):
        if pat[i] << 8 | pat[i + 1]:  # program 0 is the network table
            found["pmt_pid"] = (pat[i + 2] & 0x1F) << 8 | pat[i + 3]
            break
    pmt = section(found["pmt_pid"], 0x02) if found["pmt_pid"] >= 0 else None
    i = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11]) if pmt else 0
    if pmt and i + 5 <= len(pmt) - 4:
        found["stream_type"], found["es_pid"] = pmt[i], (pmt[i + 1] & 0x1F) << 8 | pmt[i + 2]
    own = in_order(found["es_pid"])
    lead = np.flatnonzero(starts[own])
    if not len(lead):
        return found
    own = own[lead[0] :]  # bytes before the first start can't be placed
    lead = lead - lead[0]
    data = rows[own][np.arange(PACKET) >= begin[own][:, None]]
    at = (np.cumsum(PACKET - begin[own]) - (PACKET - begin[own]))[lead]  # where each PES packet begins
    sizes = np.diff(np.append(at, len(data)))
    wide = np.append(data, np.zeros(14, np.uint8))
    b = [wide[at + k].astype(np.int64) for k in range(14)]
    plain = np.isin(b[3], _PLAIN)
    header = np.where(plain, 6, 9 + b[8])
    code = (b[0] == 0) & (b[1] == 0) & (b[2] == 1) & (sizes >= header)
    length = b[4] << 8 | b[5]
    found["pes_errors"] += int((~code).sum()) + int((code & (length > 0) & (sizes != length + 6)).sum())
    gone = np.where(~code | (b[3] == _PADDING), sizes, np.minimum(header, sizes))  # bytes of each packet that are no payload
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + gone, -1)
    found["payload"] = data[np.cumsum(edge[:-1]) == 0].tobytes()
    keep = np.flatnonzero(code)
    found["pes"] = len(keep)
    if not len(keep):
        return found
    stamped = ~plain & (b[7] & 0x80 > 0)
    pts = np.where(stamped, (b[9] >> 1 & 7) << 30 | b[10] << 22 | b[11] >> 1 << 15 | b[12] << 7 | b[13] >> 1, -1)
    found["first_pts"], found["last_pts"] = int(pts[keep[0]]), int(pts[keep[-1]])
    random = keep[flags[own[lead[keep]]] & 0x40 > 0]
    found["access"] = list(zip(pts[random].tolist(), numbers[own[lead[random]]].tolist(), strict=True))
    return found


def feature(found: dict) -> str:
    """What the stream holds, in one line."""
    access = ",".join(f"{t}@{k}" for t, k in found["access"])
    return (
        f"packets={found['packets']} pmt={found['pmt_pid']} es={found['es_pid']} type={found['stream_type']} pes={found['pes']}"
        f" errors={found['sync_errors']}/{found['table_errors']}/{found['cc_errors']}/{found['pes_errors']}"
        f" pts={found['first_pts']}-{found['last_pts']} access={access}"
    )


def store_media(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each value's UTF-8 or binary data as a transport stream; n_bytes without padding."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data = texts_of(batch.column(1))
            sizes = pa.array([len(x) for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([mux(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

        return each

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).alias("data"))
    return map_batches(rows, make, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """Demux a ``store_media`` table: digests of the payload read back and of the stored form, counts, and random-access points."""
    point = pa.struct([("pts", pa.int64()), ("packet", pa.int64())])
    kinds = [
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("feature", pa.string()), ("cc_errors", pa.int64()), ("first_pts", pa.int64()), ("last_pts", pa.int64()), ("access_points", pa.list_(point)),
    ]

    def make():  # noqa: ANN202
        def one(media: bytes) -> tuple:
            found = demux(media)
            payload = found["payload"]
            return (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                feature(found), found["cc_errors"], found["first_pts"], found["last_pts"], [{"pts": t, "packet": k} for t, k in found["access"]],
            )

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            columns = zip(*map(one, texts_of(batch.column(2))), strict=True)
            arrays = [pa.array(list(c), kind) for c, (_, kind) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "n_bytes", *(n for n, _ in kinds)])

        return each

    return map_batches(
        df.select("doc_id", "n_bytes", "media"),
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
        " feature string, cc_errors long, first_pts long, last_pts long, access_points array<struct<pts: long, packet: long>>",
    )


def op1_media_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through a transport stream and back."""
    return media_features(store_media(table(spark, sf_dir, "documents")))
