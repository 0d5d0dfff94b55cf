"""Reading a SentencePiece model file: its pieces, their scores and kinds, and the normaliser's settings. Nothing is trained."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import cached_property

#: The symbol that stands for a space inside pieces; fixed value of the format.
SPACE = "▁"
#: Kinds of pieces; fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Kinds of models; fixed values of the format.
UNIGRAM, BPE = 1, 2


class Memo(dict):
    """Remembers what solve gives for short segments, in two generations of at most `limit` each, so the frequent ones stay."""

    def __init__(self, solve, limit: int):
        super().__init__()
        self.solve, self.limit, self.old = solve, limit, {}

    def __missing__(self, segment: str):
        found = self.old.get(segment)
        if found is None:
            found = self.solve(segment)
        if len(segment) <= 64:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[segment] = found
        return found


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """The (number, value) pairs of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool
    collapse_spaces: bool
    escape_spaces: bool
    charsmap: bytes = b""

    @cached_property
    def ids(self) -> dict[str, int]:
        """The pieces that text can match."""
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @cached_property
    def byte_ids(self) -> list[int] | None:
        """The piece of each byte, or None if any is missing."""
        found = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
        out = [found.get(f"<0x{b:02X}>") for b in range(256)]
        return None if None in out else out

    @cached_property
    def segment(self) -> re.Pattern:
        """What cuts a normalised text where no piece can span the cut: before a space symbol that follows anything else, and around line
        ends and tabs if no piece has them. Without such cuts the whole text is one segment."""
        return self._cuts(SPACE)

    @cached_property
    def raw_segment(self) -> re.Pattern:
        """The same for a text whose spaces aren't SPACE yet."""
        return self._cuts(f"{SPACE} " if self.escape_spaces else SPACE)

    def _cuts(self, spaces: str) -> re.Pattern:
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(".+", re.S)
        hard = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        return re.compile(f"[{spaces}]*[^{spaces}{hard}]+|[{spaces}]+" + (f"|[{hard}]" if hard else ""))

    @cached_property
    def rewriter(self) -> "Rewriter | None":
        return Rewriter(self.charsmap) if self.charsmap else None

    def prepare(self, text: str) -> str:
        """The normaliser up to its last rule, which writes spaces as SPACE: the character map, spaces collapsed, an optional space before the text."""
        if self.rewriter:
            text = self.rewriter.rewrite(text)
        if self.collapse_spaces:
            text = re.sub(" +", " ", text).lstrip(" ").rstrip(f" {SPACE}" if self.escape_spaces else " ")
        return (" " + text if self.dummy_prefix else text) if text else ""

    def normalise(self, text: str) -> str:
        text = self.prepare(text)
        return text.replace(" ", SPACE) if self.escape_spaces else text


class Rewriter:
    """A normaliser's character map as a transducer over UTF-8 bytes: at each place the longest rule applies, a character without a rule is copied. The
    map comes compiled: the size of a double array, the array, and the replacements, each ended by a zero."""

    def __init__(self, charsmap: bytes):
        size = int.from_bytes(charsmap[:4], "little")
        self.units = struct.unpack(f"<{size // 4}I", charsmap[4 : 4 + size])
        self.replacements = charsmap[4 + size :]

    def _longest(self, data: bytes, start: int) -> tuple[int, int] | None:
        """The end of the longest rule that starts here and where its replacement stands. A unit: the lowest byte is the label, bit 8 tells a leaf,
        bits 10 and up are the offset, shifted by 8 more if bit 9 is set; a leaf's unit holds the value."""
        at, found = 0, None
        unit = self.units[0]
        at ^= unit >> 10 << ((unit & 512) >> 6)
        for end in range(start, len(data)):
            at ^= data[end]
            if at >= len(self.units):
                break
            unit = self.units[at]
            if unit & 0x800000FF != data[end]:
                break
            at ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = end + 1, self.units[at] & 0x7FFFFFFF
        return found

    def rewrite(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            rule = self._longest(data, at)
            if rule is None:
                size = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + size])
                at += size
            else:
                at, value = rule
                out.append(self.replacements[value : self.replacements.index(0, value)])
        return b"".join(out).decode()


def load(path: str) -> Vocabulary:
    """Reads a .model file on the driver. Models with user-defined or unused pieces, whose matching has rules of its own, raise ValueError."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, model, rules = [], [], [], UNIGRAM, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            model = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
    if USER_DEFINED in kinds or UNUSED in kinds:
        raise ValueError(f"{path}: user-defined and unused pieces aren't supported")
    return Vocabulary(pieces, scores, kinds, model, bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)), rules.get(2, b""))
