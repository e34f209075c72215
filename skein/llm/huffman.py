"""Canonical length-limited Huffman codes over token ids, and files of independent blocks with bit-offset checkpoints."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np

#: Longest code; 2 ** LIMIT entries make the decoding table.
LIMIT = 18
#: Ids between two checkpoints, and in a block.
STEP, BLOCK = 256, 1 << 16
MAGIC, ENDING = b"SKHUF001", b"SKHUFEND"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Each id's code length (0 for ids that don't occur), optimal among codes of at most `limit` bits, by package-merge."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n < 2:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        level = np.concatenate([weights, packages])
        by = np.argsort(level, kind="stable")
        level = level[by]
        leaves.append(by < n)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaves):
        k = int(np.count_nonzero(is_leaf[:need]))
        lengths[:k] += 1
        need = 2 * (need - k)
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: by length, then by id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    size = lengths[order].astype(np.int64)
    if len(order):
        # Left-aligned, each code is the sum of the room that those before it take.
        room = np.int64(1) << (int(size.max()) - size)
        first = np.cumsum(room) - room
        out[order] = (first >> (int(size.max()) - size)).astype(np.uint64)
    return out


@lru_cache(2)
def _table(packed: bytes) -> tuple[np.ndarray, int]:
    """For every `width` bits: id << 8 | code length."""
    lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths.max()) if len(used) else 1
    room = 1 << (width - lengths[order].astype(np.int64))
    table = np.repeat((order.astype(np.uint64) << np.uint64(8)) | lengths[order], room)
    return np.pad(table, (0, (1 << width) - len(table))), width


def _pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, most significant first, in big-endian 32-bit words, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    words = np.zeros(int(end[-1] + 31) // 32 + 2, np.uint64)
    value = code[ids] << (64 - (at & 31) - size).astype(np.uint64)
    where = at >> 5
    first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
    words[where[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[where[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), at[::STEP].astype("<u4")


def write(header: dict, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> bytes:
    """A file's bytes: magic, header, tables, blocks, and the closing magic number."""
    blocks = [_pack(ids[i : i + BLOCK], lengths, code) for i in range(0, len(ids), BLOCK)]
    tables = [
        zlib.compress(lengths.tobytes()),
        zlib.compress(json.dumps(doc_ids).encode(), 1),
        zlib.compress(sizes.astype("<i8").tobytes(), 1),
        np.array([len(b) for b, _ in blocks], "<u4").tobytes(),
        b"".join(c.tobytes() for _, c in blocks),
    ]
    head = json.dumps(header | {"ids": len(ids), "step": STEP, "block": BLOCK, "tables": [len(t) for t in tables]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *tables, *(b for b, _ in blocks), ENDING])


def header(data: bytes) -> dict:
    if data[:8] != MAGIC or data[-8:] != ENDING:
        raise ValueError("not a token file, or cut short")
    return json.loads(data[12 : 12 + int.from_bytes(data[8:12], "little")])


def read(data: bytes) -> tuple[dict, list, np.ndarray, np.ndarray]:
    """Header, document ids, sizes and ids of a file. All checkpoints of all blocks are decoded side by side."""
    head = header(data)
    at = 12 + int.from_bytes(data[8:12], "little")
    tables = []
    for n in head["tables"]:
        tables.append(data[at : at + n])
        at += n
    doc_ids = json.loads(zlib.decompress(tables[1]))
    sizes = np.frombuffer(zlib.decompress(tables[2]), "<i8")
    n, step = head["ids"], head["step"]
    out = np.zeros(n, np.uint32)
    if n:
        table, width = _table(tables[0])
        block_bytes = np.frombuffer(tables[3], "<u4").astype(np.int64)
        start = np.concatenate([[0], np.cumsum(block_bytes)[:-1]]) * 8
        offsets = np.frombuffer(tables[4], "<u4").astype(np.int64)
        per = head["block"] // step
        pos = offsets + np.repeat(start, per)[: len(offsets)]
        words = np.frombuffer(data, ">u4", count=int(block_bytes.sum()) // 4, offset=at).astype(np.uint64)
        words = (words[:-1] << np.uint64(32)) | words[1:]
        first = np.arange(len(pos)) * step
        mask = np.uint64((1 << width) - 1)
        full = len(pos) - (n % step > 0)
        for k in range(step):
            if k == n % step and full < len(pos):
                pos, first = pos[:full], first[:full]
            if not len(pos):
                break
            got = table[(words[pos >> 5] >> (64 - width - (pos & 31)).astype(np.uint64)) & mask]
            out[first + k] = got >> np.uint64(8)
            pos = pos + (got & np.uint64(255)).astype(np.int64)
    return head, doc_ids, sizes, out
