"""Packing by concatenate and cut.

Pass one tokenizes each partition once, keeps every document's ids with its place inside the partition, and stages them. The partitions' totals,
one number each, give every partition its first place in the whole; pass two cuts the line of ids at every multiple of the sequence length. A
document that crosses a cut yields one piece on either side. Nothing is shuffled, and no task sees more than its own partition.

A null text counts as empty: its only id is the end mark. A very long text is tokenized whole and cut into as many pieces as it needs. Repeated rows are
packed as often as they occur; null or repeated ids make no difference. Columns other than doc_id and text are not looked at. An empty table gives no
pieces. Of the partitions' totals the driver holds one number per input partition, some 16 bytes for each 128 MB of a large table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import map_texts, stage

_LOADED: dict[str, Callable[[str], np.ndarray]] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id of a plain byte-level BPE whose merges are numbered in order; None for any other tokenizer."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or model.get("type", "BPE") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    # byte-level alphabet: bytes that print stand for themselves, the others follow from U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in added}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> the ids that ``tokenizers`` gives with the file ``path`` and add_special_tokens=False.

    A plain byte-level BPE runs through ``tiktoken``, which gives the same ids several times faster; texts that hold the string of an added token,
    texts that ``tiktoken`` gives up on (runs of half a million blanks and more), and other kinds of tokenizer, go to ``tokenizers`` itself.
    """
    if path not in _LOADED:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        ranks = _ranks(json.loads(Path(path).read_text(encoding="utf-8")))
        if ranks is None:
            _LOADED[path] = slow
        else:
            import tiktoken
            from public_tokenizers import PATTERN

            fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            added = [t.content for t in whole.get_added_tokens_decoder().values()]

            def encode(text: str) -> np.ndarray:
                if any(t in text for t in added):
                    return slow(text)
                try:
                    return fast.encode_to_numpy(text)
                except ValueError:  # its pattern ran out of stack
                    return slow(text)

            _LOADED[path] = encode
    return _LOADED[path]


def _tokenizer(path: str, end_id: int) -> Callable[[list[str]], list]:
    encode, part, end, place = encoder(path), TaskContext.get().partitionId(), np.array([end_id], np.uint32), 0

    def run(texts: list[str]) -> list:
        nonlocal place
        ids = [np.concatenate((encode(t), end)) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        places, place = place + np.cumsum(sizes) - sizes, place + int(sizes.sum())
        return [np.full(len(ids), part, np.int32), places, sizes, [_small(x) for x in ids]]

    return run


def _small(ids: np.ndarray) -> bytes:
    """16-bit ids behind a byte 2, or 32-bit ids behind a byte 4."""
    return b"\x02" + ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, part, place, doc_tokens, ids): every document's ids, ``place`` being how many ids come before it in its partition; staged."""
    path = path or default_vocabulary()
    return stage(map_texts(docs, lambda: _tokenizer(path, end_id), "part int, place long, doc_tokens long, ids binary"), "tokens")


def _cut(batches: Iterator[pa.RecordBatch], first: dict[int, int], length: int, digest: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            few = batch.slice(i, 512)
            out: list[tuple] = []
            for k, (part, place, n, raw) in enumerate(zip(*(few.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                ids, at, start = _large(raw), first[part] + place, 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    piece = ids[start : start + size].tobytes()
                    out.append((k, start, size, (at + start) // length, (at + start) % length, n, zlib.crc32(piece) if digest else piece))
                    start += size
            which, *rest = zip(*out, strict=True)
            kinds = [pa.int64()] * 5 + [pa.int64() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(which, pa.int32())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=names)


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, sequence_id, offset, doc_tokens and its ids (little-endian uint32), or their CRC-32 with ``digest``.

    Only the last sequence can be short; ``padding`` says how many fill ids a sequence needs.
    """
    tokens = tokenize(docs, path, end_id)
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())  # one row per input partition
    first, at = {}, 0
    for part, n in totals:
        first[part], at = at, at + n
    made = T.StructType.fromDDL("start long, length long, sequence_id long, offset long, doc_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    shape = T.StructType([tokens.schema["doc_id"], *made])
    bases = tokens.sparkSession.sparkContext.broadcast(first)
    return tokens.select("doc_id", "part", "place", "doc_tokens", "ids").mapInArrow(lambda b: _cut(b, bases.value, length, digest, shape.names), shape)


def padding(total: int, length: int = 2048) -> int:
    """Fill ids of the last sequence: none if its size is a power of two, otherwise up to ``length``."""
    rest = total % length
    return 0 if rest & (rest - 1) == 0 else length - rest
