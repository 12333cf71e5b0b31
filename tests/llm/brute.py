"""Plain versions of the operators on rows in memory, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (
        [m.span() for m in re.finditer(assign, text) if len(m[2]) >= 12],
        [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16],
    )
    spans = sorted((a, i, b) for i, found in enumerate(kinds) for a, b in found)
    return *map(len, kinds), sha(",".join(f"{('assign', 'access', 'hex')[i]}:{a}:{b}" for a, i, b in spans))


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    parent = {i: i for i in prints}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def exact(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return {i: (max(ids), len(ids), i == max(ids), sha(text)) for text, ids in groups.items() for i in ids}


def licenses(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(want)] == want]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def repeats(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - window + 1):
            first.setdefault(texts[i][p:p + window], i)
    out = {}
    for i, raw in texts.items():
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if first[raw[p:p + window]] < i:
                gone[p:p + window] = b"\1" * window
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(raw), sum(gone), len(spans), sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def shards(rows: list[tuple], shards: int = 40, seed: int = 7) -> dict[int, tuple]:
    """rows: (doc_id, text, source)."""
    by_source = defaultdict(list)
    for i, text, source in rows:
        raw = (text or "").encode()
        key = int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15], 16)
        by_source["null" if source is None else "s" + source].append((key, i, zlib.crc32(raw), len(raw) + 16))
    placed = []
    for source, members in by_source.items():
        for rank, (key, i, crc, size) in enumerate(sorted(members)):
            placed.append(((2 * rank + 1) / (2 * len(members)), source, key, i, crc, size))
    out, slots = {}, defaultdict(int)
    for position, (_, _, _, i, crc, size) in enumerate(sorted(placed)):
        shard = position * shards // len(placed)
        out[i] = (size, crc, shard, slots[shard])
        slots[shard] += 1
    return out
