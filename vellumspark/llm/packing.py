"""Packing token sequences by the sum-of-squares rule.

Documents are tokenised and packed in the partition that reads them: no shuffle. A
document's whole windows fill sequences of their own; what remains is placed online
where the sum, over fill levels, of squared numbers of open sequences grows least.
Sequences still open at the end of a partition are cut together anew, so at most one
sequence a partition is padded.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

WINDOW, END_ID = 2048, 1
END = END_ID.to_bytes(4, "little")
#: Words whose ids a worker remembers in each of two generations; longer ones in bytes
#: are encoded each time.
REMEMBERED, LONGEST = 100_000, 64
#: Bytes of text that are looked up together.
TOGETHER = 2 << 20
#: Bytes of ids in a batch that is handed on.
BATCH_BYTES = 4 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Rules of a tokenizers file under which a text's ids are those of its words (fixed values).
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: Classes of bytes in words; ODD ones leave the word to the tokenizer.
ODD, SPACE, LETTER, DIGIT, SIGN = range(5)


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x20] = SPACE
    for b in range(0x21, 0x7F):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
    kinds[list(b"<|>")] = ODD  # of special tokens
    return kinds


CLASSES = _classes()
#: Contractions are pieces of their own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _printable() -> dict[str, int]:
    """Character by which a byte-level vocabulary writes a byte -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte pairs merged, lowest rank first."""
    while len(symbols) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(pairwise(symbols)))
        if rank == len(ranks):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


def piece_ranks(rules: dict) -> dict[bytes, int] | None:
    """Bytes of a piece's tokens, a piece ending in a line feed, -> id by which pairs
    merge; None if the rules are others, or merging by the tokens' ids could differ.

    If merging any token's own symbols gives that token, a pair whose union is a token
    meets only where the listed pair of that token meets, so unions tell as much as
    pairs do.
    """
    model = rules["model"]
    if any(rules[k] != v for k, v in BY_WORD.items()) or any(model[k] != v for k, v in BPE.items()):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not {"<", "|", ">"} & set(t["content"]) or t["content"].split() != [t["content"]] for t in rules["added_tokens"]):
        return None
    vocab, end, byte_of = model["vocab"], model["end_of_word_suffix"], _printable()
    pairs = [tuple(p) for p in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    ids = [vocab[a + b] for a, b in pairs]
    single = [*byte_of, *(c + end for c in byte_of)]
    if any(x >= y for x, y in pairwise(ids)) or any(vocab.get(c, len(vocab)) >= ids[0] for c in single):
        return None
    for a, b in pairs:
        token = a + b
        bare = token.removesuffix(end)
        if _merged([*bare[:-1], bare[-1] + token[len(bare) :]], ranks) != [token]:
            return None
    joined = {*single, *(a + b for a, b in pairs)}
    return {bytes(byte_of[c] for c in t.removesuffix(end)) + b"\n" * t.endswith(end): vocab[t] for t in joined if t != "Ċ"} | {b"\n": len(vocab)}


class WordIds:
    """Ids of texts, as bytes of little-endian 32-bit ids.

    Under the rules BY_WORD the tokenizer's pieces never cross ASCII white space and its
    normaliser changes nothing across it, so ids are remembered by word. New words of
    Latin letters, digits and ASCII signs are lower-cased and cut into pieces many at a
    time; words of anything else, and texts under other rules, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            ranks = piece_ranks(json.load(f))
        self.by_word = ranks is not None
        if self.by_word:
            self.pieces = tiktoken.Encoding("pieces", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
            self.last = np.zeros(max(ranks.values()) + 1, bool)
            self.last[[i for token, i in ranks.items() if token.endswith(b"\n")]] = True

    def _alone(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) of distinct words."""
        data = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8).copy()
        kind = CLASSES[data]
        lead = np.flatnonzero(data == 0xC3)  # of Latin-1 letters; what follows them tells which
        after = data[lead + 1]
        good = (after != 0x97) & (after != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = LETTER
        upper = lead[good & (after < 0x9F)] + 1
        data[upper] += 0x20
        capital = (data >= 0x41) & (data <= 0x5A)
        data[capital] += 0x20

        gaps = np.flatnonzero(kind == SPACE)
        odd = np.logical_or.reduceat(kind == ODD, gaps)[:-1] | (np.diff(gaps) > LONGEST + 1)
        fresh = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        fresh = np.concatenate([[False], fresh])
        mark = np.flatnonzero((data == 0x27) & fresh)
        for tail in CONTRACTIONS:
            at = mark[mark + len(tail) < len(data)]
            for k, c in enumerate(tail, 1):
                at = at[data[at + k] == c]
            fresh[at + 1] = False
            at = at + len(tail) + 1
            fresh[at] |= kind[at] == LETTER
        plain = kind != SPACE
        plain &= np.repeat(np.append(~odd, False), np.diff(np.append(gaps, len(data))))
        starts = fresh & plain
        counts = np.add.reduceat(starts, gaps, dtype=np.int64)[:-1][~odd]
        starts = starts[plain]
        text = np.full(len(starts) + int(counts.sum()), 0x0A, np.uint8)
        text[np.arange(len(starts)) + np.cumsum(starts) - 1] = data[plain]
        ids = self.pieces.encode_to_numpy(text.tobytes().decode()).astype("<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        cuts = (4 * np.concatenate([[0], ends[np.cumsum(counts) - 1]])).tolist() if len(counts) else []
        packed = ids.tobytes()
        yield from zip((w for w, o in zip(words, odd.tolist(), strict=True) if not o), (packed[i:j] for i, j in pairwise(cuts)), strict=True)
        yield from ((w, self._alone(w)) for w, o in zip(words, odd.tolist(), strict=True) if o)

    def learn(self, words: set[bytes]) -> None:
        fresh = words.difference(self.words)
        if len(self.words) + len(fresh) > REMEMBERED:  # what is still in use moves on
            self.before, self.words = self.words, {}
            fresh = words
        again = fresh.intersection(self.before) if self.before else set()
        self.words.update((w, self.before[w]) for w in again)
        fresh = list(fresh - again)
        if fresh:
            self.words.update(self.encoded(fresh))

    def many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text, END_ID last."""
        if not self.by_word:
            return [np.frombuffer(self._alone(t or b"") + END, "<u4") for t in texts]
        cut = [t.split() if t else [] for t in texts]
        self.learn(set().union(*cut))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, words)) + END, "<u4") for words in cut]

    def ids(self, text: bytes | None) -> np.ndarray:
        return self.many([text])[0]


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class SumOfSquares:
    """Open sequences by fill level; ``levels[h]`` is how many are filled to h."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The level to put ``size`` (below the window) on; 0 opens a sequence. Ties go
        to the fuller level."""
        n, w = self.levels, self.window
        best, at = 2 * int(n[size]) + 1, 0
        upper = w - size
        if n[upper] and 1 - 2 * int(n[upper]) <= best:
            best, at = 1 - 2 * int(n[upper]), upper
        if upper > 1:
            here = n[1:upper]
            change = np.where(here > 0, 2 * (n[1 + size : w] - here) + 2, np.iinfo(np.int64).max)
            k = upper - 2 - int(np.argmin(change[::-1]))
            if change[k] < best or change[k] == best and at == 0:
                at = k + 1
        return at

    def put(self, size: int, fresh: int) -> tuple[int, int, bool]:
        """(sequence, offset, full) of a piece; ``fresh`` is the id of a new sequence."""
        at = self.place(size)
        sequence = fresh
        if at:
            sequence = self.open[at].pop()
            self.levels[at] -= 1
        if at + size < self.window:
            self.open.setdefault(at + size, []).append(sequence)
            self.levels[at + size] += 1
        return sequence, at, at + size == self.window


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], window: int = WINDOW) -> Iterator[tuple]:
    """(doc_id, ids) -> (doc_id, start, length, doc_tokens, sequence, offset, ids)."""
    rule, held, made = SumOfSquares(window), {}, 0
    for doc, ids in docs:
        total, whole = len(ids), len(ids) // window * window
        for start in range(0, whole, window):
            yield doc, start, window, total, made, 0, ids[start : start + window]
            made += 1
        if whole == total:
            continue
        sequence, offset, full = rule.put(total - whole, made)
        made += sequence == made
        held.setdefault(sequence, []).append((doc, whole, total, offset, ids[whole:]))
        if full:
            for doc_, start, of, at, part in held.pop(sequence):
                yield doc_, start, len(part), of, sequence, at, part
    sequence, at = made, 0
    for _, pieces in sorted(held.items()):
        for doc, start, total, _, part in pieces:
            while len(part):
                cut = part[: window - at]
                yield doc, start, len(cut), total, sequence, at, cut
                start, part, at = start + len(cut), part[len(cut) :], at + len(cut)
                if at == window:
                    sequence, at = sequence + 1, 0


def padding(length: int, window: int = WINDOW) -> int:
    """Ids that pad a sequence: none at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the packed sequences of (doc_id, text): SCHEMA's columns, ids as
    little-endian unsigned 32-bit.

    A document's ids end with END_ID; null or blank text has only that id. Every id
    lies in exactly one piece. Repeated rows and null doc_ids are packed like others;
    other columns are not read; an empty table gives none. ``tokenizer`` is the path of
    a tokenizers file that every executor has.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = word_ids(tokenizer), TaskContext.get().partitionId() << 32

        def read() -> Iterator[tuple]:
            docs, texts, held = [], [], 0
            for b in it:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                    docs.append(doc), texts.append(text.as_py())
                    held += len(texts[-1] or b"")
                    if held >= TOGETHER:
                        yield from zip(docs, known.many(texts), strict=True)
                        docs, texts, held = [], [], 0
            yield from zip(docs, known.many(texts), strict=True)

        rows, held = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for doc, start, length, total, sequence, offset, ids in pack_stream(read(), window):
            rows.append((doc, start, length, total, base + sequence, offset, ids.tobytes()))
            held += 4 * length
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: trimmed(batches(it)), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
