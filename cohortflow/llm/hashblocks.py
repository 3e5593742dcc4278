"""Which of very many hashes occur in more than one document, block by block.

Texts are packed into blocks of a few megabytes.  A block sends each of its
hashes once, as five bytes, to the hash's bucket; the bucket answers with one
bit for each: whether another block, or another document of the same block,
has it.  A hash that a third of all documents hold costs each block one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from cohortflow.llm.textops import utf8

#: Text bytes of a block, and text bytes whose hashes one bucket gets.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
PACKED = "ids binary, sizes binary, packed binary, bytes long"
SENT = "bucket long, block long, hashes binary"
ANSWERED = "block long, bucket long, bits binary"
_U = np.uint64


def pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of about BLOCK_BYTES of (doc_id, text), compressed; doc_id is not null."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids: list[int] = []
    raws: list[bytes] = []
    size = 0

    def block() -> pd.DataFrame:
        return pd.DataFrame({"ids": [np.array(ids, "<i8").tobytes()], "sizes": [np.array([len(r) for r in raws], "<i8").tobytes()], "packed": [squeeze(b"".join(raws))], "bytes": [size]})

    for b in batches:
        for i, raw in zip(b["doc_id"].tolist(), utf8(b["text"])):
            ids.append(i)
            raws.append(raw)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield block()
                ids, raws, size = [], [], 0
    if ids:
        yield block()


def unpack_block(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, bounds of the texts, and the texts one after the other."""
    import zstandard

    ids = np.frombuffer(row["ids"], "<i8")
    offs = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))))
    return ids, offs, zstandard.ZstdDecompressor().decompress(row["packed"]) if row["bytes"] else b""


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and the order that sorts by bucket (then by hash)."""
    bucket = (hashes % _U(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def send(hashes: np.ndarray, many: np.ndarray, block: int, buckets: int) -> pd.DataFrame:
    """Rows for the distinct, sorted ``hashes`` of a block; ``many``: several
    documents of the block have it.  The bucket is one part of the hash, 39
    more bits and the flag are sent: with as many hashes as a bucket gets, two
    hashes are taken for one in a millionth of all cases."""
    bucket, by = _by_bucket(hashes, buckets)
    rest = (((hashes // _U(buckets)) & _U((1 << 39) - 1)) << _U(1) | many.astype(_U))[by].astype("<u8")
    five = rest.view(np.uint8).reshape(-1, 8)[:, :5]
    cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) != 0))) if len(by) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(by))
    return pd.DataFrame({"bucket": bucket[by][cut], "block": np.full(len(cut), block, np.int64), "hashes": [five[s:e].tobytes() for s, e in zip(cut, ends)][: len(cut)]})


def answer(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """For each block a bit for each hash it sent, in its order."""
    parts = []
    for raw in g["hashes"]:
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        parts.append(wide.view("<u8").ravel())
    both = np.concatenate(parts)
    h, many = both >> _U(1), (both & _U(1)).astype(bool)
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
    sizes = np.diff(np.append(starts, len(h)))
    flag = np.empty(len(h), bool)
    flag[order] = np.repeat((sizes > 1) | np.maximum.reduceat(many[order], starts), sizes)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pd.DataFrame({"block": g["block"].values, "bucket": int(key[0]), "bits": [np.packbits(x).tobytes() for x in np.split(flag, cuts)]})


def shared(hashes: np.ndarray, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """Whether more than one document has each of the distinct, sorted hashes of a block."""
    bucket, by = _by_bucket(hashes, buckets)
    out = np.zeros(len(hashes), bool)
    keys = answers["bucket"].to_numpy(np.int64)
    low, high = np.searchsorted(bucket[by], keys), np.searchsorted(bucket[by], keys, "right")
    for s, e, bits in zip(low, high, answers["bits"]):
        out[by[s:e]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
    return out
