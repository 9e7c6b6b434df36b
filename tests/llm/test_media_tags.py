"""Tags of other writers in MPEG audio."""

from __future__ import annotations

import struct

from cisloom.llm import media


def test_unit_beyond_any_number():
    plain = media.write_audio(b"abc" * 192, 576)
    tag = b"\0unit\0" + b"9" * 5000
    frame = b"TXXX" + struct.pack(">IH", len(tag), 0) + tag
    size = len(frame)
    blob = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame + plain[media.read_audio(plain).offsets[0] :]
    assert media.read_audio(blob).tags["unit"] == "9" * 5000
