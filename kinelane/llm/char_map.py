"""The normaliser stored in a piece model: a compiled map of strings, applied by longest prefix, with source positions."""

from __future__ import annotations

import struct

import numpy as np

PREFIX = "▁".encode()


def wire_fields(blob: bytes):
    """(field, value) pairs of a protocol-buffer message; bytes for nested values, int for the rest."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, blob[at : at + size]
            at += size


# Fixed values of the model file format: field numbers of the model and of its normaliser.
MODEL_NORMALISER, CHAR_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 3, 2, 3, 4, 5


def normaliser_of(path: str) -> Normaliser:
    with open(path, "rb") as file:
        spec = next((v for k, v in wire_fields(file.read()) if k == MODEL_NORMALISER), b"")
    found = dict(wire_fields(spec))
    return Normaliser(
        found.get(CHAR_MAP, b""), bool(found.get(DUMMY_PREFIX, 1)), bool(found.get(REMOVE_SPACES, 1)), bool(found.get(ESCAPE_SPACES, 1))
    )


class Normaliser:
    """Text to normalised bytes plus, for every normalised byte, the byte of the source that it stands for."""

    def __init__(self, compiled: bytes = b"", dummy_prefix: bool = True, remove_spaces: bool = True, escape_spaces: bool = True):
        self.dummy_prefix, self.remove_spaces, self.escape_spaces = dummy_prefix, remove_spaces, escape_spaces
        self.nodes, self.strings = [], b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.nodes = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.strings = compiled[4 + size :]

    @property
    def identity(self) -> bool:
        return not self.nodes and not self.remove_spaces and self.escape_spaces

    def longest(self, source: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest key of the map that begins at ``at``, and its replacement; 0 if none does.

        A node is 32 bits: its label in the low byte, a flag for values (bit 31), one for a value below it (bit 8) and
        the distance to its children (bits 10 up, times 256 where bit 9 is set).
        """
        nodes, here, found = self.nodes, 0, (0, b"")
        unit = nodes[0]
        here ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(source)):
            here ^= source[k]
            if here >= len(nodes):
                break
            unit = nodes[here]
            if unit & (1 << 31 | 255) != source[k]:
                break
            here ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = nodes[here] & (1 << 31) - 1
                found = (k + 1 - at, self.strings[begin : self.strings.index(b"\0", begin)])
        return found

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and their source offsets; one offset more than bytes (the end of the source)."""
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.identity:
            width = np.where(np.frombuffer(source, np.uint8) == 32, 3, 1)
            lead = len(PREFIX) * self.dummy_prefix
            starts = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(source)), width), [len(source)]])
            return PREFIX * self.dummy_prefix + source.replace(b" ", PREFIX), starts
        out, starts, at = bytearray(), [], 0
        spaced = self.remove_spaces  # true where another space would be removed
        space = PREFIX if self.escape_spaces else b" "
        while at < len(source):
            size, made = self.longest(source, at) if self.nodes else (0, b"")
            if not size:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                made = source[at : at + size]
            for k in range(len(made)):
                if made[k] == 32:
                    if not spaced:
                        out += space
                        starts += [at] * len(space)
                    spaced = self.remove_spaces
                else:
                    out.append(made[k])
                    starts.append(at)
                    spaced = False
            at += size
        if self.remove_spaces:
            while out.endswith(space):
                del out[-len(space) :], starts[-len(space) :]
        if self.dummy_prefix and out:
            out[:0], starts[:0] = space, [starts[0]] * len(space)
        return bytes(out), np.array([*starts, len(source)], np.int64)
