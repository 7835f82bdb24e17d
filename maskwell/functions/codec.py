"""Rice-coded neighbour lists, as stored in graph files: count (16 bits, little-endian), parameter, then gaps in bits."""

from __future__ import annotations

# Fixed values of the format: bytes before the body, and the longest list.
HEADER, LONGEST = 3, 65535


def parameter(ids: list[int]) -> int:
    """How many low bits of a gap are written plainly: the whole binary logarithm of the mean gap."""
    return max(1, (ids[-1] - len(ids) + 1) // len(ids)).bit_length() - 1 if ids else 0


def encode(ids: list[int]) -> bytes:
    """Strictly ascending ids as their first one and the gaps less one: zeros for the high part, a one, the low bits."""
    if len(ids) > LONGEST or any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("ids must ascend strictly, and number at most 65,535")
    b, bits = parameter(ids), []
    for gap in (x - before - 1 for before, x in zip([-1, *ids], ids, strict=False)):
        bits.append("0" * (gap >> b) + "1" + (f"{gap & (1 << b) - 1:0{b}b}" if b else ""))
    text = "".join(bits)
    body = int(text, 2) << -len(text) % 8 if text else 0
    return len(ids).to_bytes(2, "little") + bytes([b]) + body.to_bytes(-(-len(text) // 8), "big")


def decode(data: bytes) -> list[int]:
    n, b = int.from_bytes(data[:2], "little"), data[2]
    text, at, last, out = "".join(f"{x:08b}" for x in data[HEADER:]), 0, -1, []
    for _ in range(n):
        one = text.index("1", at)
        low = text[one + 1 : one + 1 + b]
        last += (one - at << b) + (int(low, 2) if b else 0) + 1
        at = one + 1 + b
        out.append(last)
    return out
