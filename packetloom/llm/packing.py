"""Token sequences for training by vector bin packing.

Every task tokenizes its rows and packs them where they are, so no token is
shuffled. What a row has beyond full sequences waits in a pool of bounded size.
A sequence is filled by the dot-product heuristic: of the pool, take the piece whose
demand vector (tokens, segments, loss-bearing tokens, each over its limit) has the
largest product with what the sequence has left, among those that fit; when none
fits, cut one to size. What would be padded is handed back to the pool by closing
short sequences at a power of two.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


#: Texts of these characters are split alike by both libraries; others take the tokenizer file itself.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞₠-₿]*")


@functools.lru_cache(4)
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by a byte-level BPE tokenizer file, without special tokens being added.

    Where ids are in merge order, plain texts go through a byte-pair encoder built
    from the same file, which is several times faster and gives the same ids.
    """
    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    marks = {x["content"] for x in spec["added_tokens"]}
    pairs = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
    usual = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    if not usual or any(vocab[p] != 256 + i for i, p in enumerate(pairs)):
        return slow
    # the printable stand-ins of bytes: printable Latin-1 stays, the others follow from U+0100 on
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in marks}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    quick = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> np.ndarray:
        if any(m in text for m in marks) or not _PLAIN.fullmatch(text):
            return slow(text)
        return quick.encode_to_numpy(text)

    return fast


class Packer:
    """Packs the pieces of one task; rows (piece, sequence, offset) come out as sequences close."""

    def __init__(self, limits: Limits, pool: int):
        self.limits, self.pool = limits, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        #: doc, start, tokens, loss 0/1 of waiting pieces
        self.items: list[tuple[int, int, int, int]] = []
        self.closed: list[list[tuple[int, int, int]]] = []

    def add(self, doc: int, tokens: int, loss: bool) -> None:
        whole = min(self.limits.tokens, self.limits.loss if loss else self.limits.tokens)
        start = 0
        while tokens - start >= whole:
            size = whole if whole == self.limits.tokens else 1 << (whole.bit_length() - 1)
            self.closed.append([(doc, start, size)])
            start += size
        if tokens > start:
            self.items.append((doc, start, tokens - start, int(loss)))
        if len(self.items) >= self.pool:
            self.drain(self.pool // 2)

    def drain(self, keep: int = 0) -> None:
        """Close sequences until ``keep`` pieces at most wait."""
        left = np.array(self.items, np.int64).reshape(-1, 4)
        while len(left) > keep and (keep == 0 or left[:, 2].sum() >= self.limits.tokens):
            left = self._fill(left)
        self.items = [tuple(map(int, x)) for x in left]

    def _fill(self, pool: np.ndarray) -> np.ndarray:
        room, taken, alive = self.cap.copy(), [], np.ones(len(pool), bool)
        need = np.stack([pool[:, 2], np.ones(len(pool), np.int64), pool[:, 2] * pool[:, 3]], 1).astype(float)
        unit = need / self.cap
        back: list[tuple[int, int, int, int]] = []
        while room[0] >= 1 and room[1] >= 1 and alive.any():
            fits = alive & (need <= room).all(1)
            if fits.any():
                i = int(np.argmax(np.where(fits, unit @ (room / self.cap), -1.0)))
                size = int(pool[i, 2])
            else:  # cut the piece that leaves the least behind
                most = np.where(pool[:, 3] > 0, min(room[0], room[2]), room[0])
                size_of = np.where(alive, np.minimum(most, pool[:, 2]), 0)
                i = int(np.lexsort((pool[:, 2], -size_of))[0])
                size = int(size_of[i])
                if size < 1:
                    break
                if size < pool[i, 2]:
                    back.append((int(pool[i, 0]), int(pool[i, 1]) + size, int(pool[i, 2]) - size, int(pool[i, 3])))
            alive[i] = False
            taken.append([int(pool[i, 0]), int(pool[i, 1]), size, int(pool[i, 3])])
            room -= (size, 1, size * pool[i, 3])
        full = sum(x[2] for x in taken)
        if full != self.limits.tokens:
            extra = full - (1 << (full.bit_length() - 1))
            while extra:  # hand back what would make padding
                doc, start, size, loss = taken.pop()
                give = min(extra, size)
                extra -= give
                back.append((doc, start + size - give, give, loss))
                if give < size:
                    taken.append([doc, start, size - give, loss])
        self.closed.append([(d, s, n) for d, s, n, _ in taken])
        rest = pool[alive]
        return np.concatenate([rest, np.array(back, np.int64)]) if back else rest


def pack(
    docs: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(),
    doc_id: str = "doc_id",
    text: str = "text",
    loss: str | None = None,
    end_id: int = 0,
    pool: int = 512,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    * A document is its token ids followed by ``end_id``; a NULL text is empty and
      gives that id alone. Each id lies in one piece; a piece lies in one sequence.
    * ``loss`` names a boolean column: do the row's tokens bear loss (NULL: no)?
      Without it all do.
    * Rows that repeat a ``doc_id`` are packed each for itself. Other columns are
      ignored; an empty table gives an empty result.
    * ``pool`` bounds the pieces a task holds back. Sequence ids carry the number of
      the input partition: read ``docs`` from a stored table, whose partitions are the
      same on every attempt.
    """
    flag = F.lit(True) if loss is None else F.coalesce(F.col(loss), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), flag.alias("loss"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(tokenizer), Packer(limits, pool)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        held: dict[int, tuple[object, np.ndarray, int]] = {}
        number = 0

        def emit() -> pa.RecordBatch:
            nonlocal serial
            out: list[tuple] = []
            for pieces in packer.closed:
                at = 0
                for doc, start, size in pieces:
                    ident, ids, left = held[doc]
                    part = ids[start : start + size].astype("<u4", copy=False)
                    out.append((ident, start, size, zlib.crc32(part.tobytes()), len(ids), serial, at, part if with_ids else None))
                    at += size
                    if left == size:
                        del held[doc]
                    else:
                        held[doc] = (ident, ids, left - size)
                serial += 1
            packer.closed.clear()
            cols = list(zip(*out)) if out else [()] * 8
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            return pa.record_batch(arrays + ([pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32()))] if with_ids else []), names=names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for ident, body, bears in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(body.as_py() or "")
                held[number] = (ident, ids := np.append(ids, np.uint32(end_id)), len(ids))
                packer.add(number, len(ids), bears)
                number += 1
                if len(packer.closed) >= 4096:
                    yield emit()
            yield emit()
        if id_type is not None:
            packer.drain()
            yield emit()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
