"""WAV bytes of 16-bit mono sound, and image sizes from JPEG headers: small helpers on binary columns."""

from __future__ import annotations

import struct


def wav(samples: bytes, rate: int = 24_000) -> bytes:
    """Raw little-endian 16-bit samples as a RIFF file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(samples))
    return head + samples


def samples_of(data: bytes) -> bytes:
    """The samples of a RIFF file, or data itself where it is raw; only 16-bit mono is accepted."""
    if data[:4] != b"RIFF":
        return data
    at, out = 12, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            _, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if (channels, bits) != (1, 16):
                raise ValueError("only 16-bit mono sound is read")
        elif name == b"data":
            out = body
        at += 8 + size + size % 2
    return out


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the frame header; None if there is none."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None
