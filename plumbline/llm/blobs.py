"""Questions that blocks of documents ask all blocks about hashes, answered by Spark's groups of hash ranges.

A block sends its distinct hashes as one binary value for each range of hash values (a bucket); a bucket's task sees
those of all blocks and sends each block one answer a hash, in the order it was asked. So a hash takes 8 bytes on the
way there and a bit or a few bytes back, and a hash that is everywhere takes one entry a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ASKED = "bucket int, block long, flow int, hashes binary, extra binary"
ANSWER = "block long, bucket int, flow int, bits binary"
#: Bytes of text in a block and of questions in a bucket, at most (a block: plus one document).
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20


def sizes(total_bytes: int, text_per_asked: float) -> tuple[int, int]:
    """Bytes of text in a block, and the number of buckets.

    Both have bounded sizes, so a task's memory doesn't grow with the input; small inputs get smaller ones, to be spread.
    A message has a hash at least, so there are never more messages than hashes; at 1 TB there are some twenty hashes to
    each message, at 10 TB two, and beyond that the exchange is one of single hashes, as a plain join of them is.
    """
    return max(1 << 16, min(BLOCK_BYTES, total_bytes // 8)), max(8, int(total_bytes / text_per_asked / BUCKET_BYTES), min(48, total_bytes >> 20))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted buckets: those that are met, and where each of them begins, with the end."""
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
    return where[first], np.append(first, len(where))


def ask(block: int, flow: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows of ASKED for sorted distinct hashes; extra: a value of fixed width for each."""
    some, at = cuts(bucket_of(hashes, buckets))
    parts = [hashes[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]
    more = [extra[a:z].tobytes() if extra is not None else b"" for a, z in zip(at, at[1:], strict=False)]
    n = len(some)
    return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array(np.full(n, block), pa.int64()), "flow": pa.array(np.full(n, flow), pa.int32()), "hashes": pa.array(parts, pa.binary()), "extra": pa.array(more, pa.binary())})


def gathered(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: blocks of the questions, where each question's hashes begin, all hashes, the question of each."""
    parts = [np.frombuffer(x, np.uint64) for x in asked.column("hashes").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return asked.column("block").to_numpy(), starts, hashes, np.repeat(np.arange(len(parts)), np.diff(starts))


def answers(asked: pa.Table, values: np.ndarray, starts: np.ndarray) -> pa.Table:
    bits = [np.packbits(values[starts[i] : starts[i + 1]]).tobytes() if values.dtype == bool else values[starts[i] : starts[i + 1]].tobytes() for i in range(len(starts) - 1)]
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "flow": asked.column("flow"), "bits": pa.array(bits, pa.binary())})


def read_values(replies: pa.Table, flow: int, hashes: np.ndarray, buckets: int, kind=np.uint32) -> np.ndarray:
    some, at = cuts(bucket_of(hashes, buckets))
    out = np.zeros(len(hashes), dtype=kind)
    place = np.searchsorted(some, replies.column("bucket").to_numpy())
    for b, f, bits in zip(place.tolist(), replies.column("flow").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        if f == flow:
            out[at[b] : at[b + 1]] = np.frombuffer(bits, kind)
    return out
