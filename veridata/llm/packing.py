"""Harmonic packing of token sequences.

A document's ids are cut into exact reciprocals of the capacity: whole sequences, then
capacity / 2, / 4, ... as they fit, down to ``min_cut``. What is left is shorter than
``min_cut`` and falls into the class ``k`` of lengths in (capacity / (k + 1), capacity / k].
Every class has its own open bin, which takes exactly ``k`` pieces (the cuts belong to the
classes k = 1, 2, 4, ... and fill their bins without a gap). Workers fill the bins of their
own partitions independently; nothing is shuffled. When a partition ends, the pieces in its
unfilled bins are laid end to end and cut at the capacity, and the one short sequence that
is left is cut at powers of two, which need no padding.

A worker holds, beside one batch of texts, fewer than one capacity of piece records per
class.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare

CAPACITY = 1024
MIN_CUT = 64
# fixed value: where byte-level BPE files part a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit numbers, those that the file's
    own tokenizer gives; the strings of special tokens become their ids.

    The tokenizer of a plain byte-level BPE file is rebuilt from its vocabulary as ranks, which
    encodes a text several times faster: where every merge makes the id that its place in the
    list says, the lowest rank is the first merge. Any other file is read by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            self.ranked = ranked(json.load(f))
        if self.ranked is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            return [self.ranked.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


def ranked(file: dict):
    """A tiktoken encoding of the same ids as the tokenizer in ``file``, None where the file is
    more than a byte-level BPE whose merges follow its ids."""
    import tiktoken
    model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
    added = file.get("added_tokens") or []
    plain = (model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space") and not file.get("normalizer") and not file.get("truncation")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and all(t["special"] and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added))
    if not plain:
        return None
    # byte-level files write bytes that do not print as the characters from 256 on
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printed}))}
    special = {t["content"]: t["id"] for t in added}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(i for w, i in vocab.items() if len(w) == 1) != list(range(256)) or len(vocab) != 256 + len(merges) or any(
            vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cuts(total: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of the pieces that ``total`` ids are cut into, in order."""
    out, size = [], capacity
    while size >= min_cut and total >= min_cut:
        out += [size] * (total // size)
        total %= size
        if size % 2:
            break
        size //= 2
    return out + [total] * (total > 0)


class Packer:
    """Bins of one worker. ``put`` takes pieces and gives rows ``(piece, sequence, offset)``
    of filled bins; ``close`` gives the rest, with pieces cut further where need be."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.next = capacity, {}, 0

    def put(self, piece: tuple, length: int):
        k = self.capacity // length
        bin_ = self.open.setdefault((k, length) if k * length == self.capacity else (k, 0), [])
        bin_.append(piece)
        if len(bin_) < k:
            return
        at = 0
        for p in bin_:
            yield p, self.next, at
            at += p[2]
        bin_.clear()
        self.next += 1

    def close(self):
        rest = [p for key in sorted(self.open) for p in self.open[key]]
        left = sum(p[2] for p in rest)
        room = at = 0
        for doc, start, length in rest:
            while length:
                if not room:
                    # a whole sequence, or at the end one of a power of two
                    room, at = min(self.capacity, 1 << (left.bit_length() - 1)), 0
                    self.next += 1
                take = min(room, length)
                yield (doc, start, take), self.next - 1, at
                start, length, room, at, left = start + take, length - take, room - take, at + take, left - take


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, min_cut: int = MIN_CUT, end_id: int = 0,
         with_ids: bool = True) -> DataFrame:
    """Rows ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``:
    every id of every row of ``docs (doc_id, text)``, with ``end_id`` after it, in exactly
    one piece; sequences of at most ``capacity`` ids, each gapless from offset 0.

    A null or empty text is its end id alone; a null doc_id stays null; repeated rows are
    packed each by itself; very long texts are cut into as many pieces as needed; an empty
    table gives an empty one; other columns are ignored. Sequence ids are unique, not gapless.
    """
    if capacity < 2 or capacity & (capacity - 1) or not 1 <= min_cut <= capacity:
        raise ValueError("capacity must be a power of two and min_cut between 1 and it")
    prepare(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def rows(batches):
        from pyspark import TaskContext
        encoder, packer = Encoder(tokenizer), Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        end, data, serial = np.array([end_id], "<u4").tobytes(), {}, 0

        def batch(placed):
            columns = [[] for _ in names]
            for (no, start, length), sequence, offset in placed:
                doc, first, piece, total = data[no][:4]
                ids = piece[4 * (start - first):4 * (start - first + length)]
                for column, value in zip(columns, (doc, start, length, zlib.crc32(ids), total, base + sequence, offset)):
                    column.append(value)
                if with_ids:
                    columns[-1].append(np.frombuffer(ids, "<i4"))
                data[no][4] -= length
                if not data[no][4]:
                    del data[no]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for given in batches:
            ids = given.column(0).to_pylist()
            texts = [t or "" for t in given.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                placed = []
                for doc, coded in zip(ids[at:at + 256], encoder.encode(texts[at:at + 256])):
                    coded += end
                    start, total = 0, len(coded) // 4
                    for length in cuts(total, capacity, min_cut):
                        # of a document only the bytes of its unplaced pieces are held
                        data[serial] = [doc, start, coded[4 * start:4 * (start + length)], total, length]
                        placed += packer.put((serial, start, length), length)
                        start, serial = start + length, serial + 1
                if placed:
                    yield batch(placed)
        if placed := list(packer.close()):
            yield batch(placed)

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<int>" * with_ids)
    text = free_name(docs, "text_string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(text)) \
        .mapInArrow(rows, schema)
