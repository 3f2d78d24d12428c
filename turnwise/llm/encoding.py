"""Tokenizer files, and the ids of many texts.

``Encoder`` gives what the file's library gives. For word-level BPE files whose normalizer and splitter are the ones
below, texts of plain Latin characters are split here, all of a batch at once over their bytes, and each distinct piece is
encoded by the library once and remembered, since pieces are encoded independently of their neighbours. A piece of up to
16 bytes is known by these bytes as two numbers, in a table of open addresses; longer ones are rare and looked up one by
one. All other texts go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from turnwise.llm.common import text_slices

#: The only normalizer and splitter for which pieces are remembered (fixed by the format of such files).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Endings that are pieces of their own behind an apostrophe, of one letter and of two (fixed by the splitter).
_ENDINGS = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")

#: Characters that NFC leaves alone and that lower-case one by one, to as many bytes, in every version of Unicode.
_PLAIN = [9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Pieces remembered by one worker before it starts afresh, and the slots of its table.
REMEMBERED, SLOTS = 1_500_000, 1 << 22


def _kind(point: int) -> int:
    if point in (9, 10, 11, 12, 13, 32):
        return BLANK
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER)


_plain = np.zeros(0x180, bool)
_plain[_PLAIN] = True
_kinds = np.array([_kind(p) for p in range(0x180)], np.uint8)
_lower = np.array([ord(chr(p).lower()) if p in _PLAIN else p for p in range(0x180)], np.uint16)
#: Byte to kind, lower-case byte, and whether a text that holds it may be split here; bytes of longer characters are told apart below.
_byte_kind = np.concatenate([_kinds[:128], np.full(128, OTHER, np.uint8)])
_byte_lower = np.concatenate([_lower[:128].astype(np.uint8), np.arange(128, 256).astype(np.uint8)])
_byte_plain = np.concatenate([_plain[:128], np.ones(64, bool), np.zeros(2, bool), np.ones(4, bool), np.zeros(58, bool)])
#: The lowest bytes of a number, by how many count.
_low_bytes = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, first and last byte of every piece, texts that may be split so) of a run of texts.

    Pieces of other texts mean nothing and are left out.
    """
    size = len(data)
    lower, kind, plain = _byte_lower[data], _byte_kind[data], _byte_plain[data]
    if size and data[-1] >= 0xC0:
        plain[-1] = False  # a character cut short, which no valid text has
    leads = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xC5))
    points = ((data[leads].astype(np.uint16) & 0x1F) << 6) | (data[leads + 1] & 0x3F)
    plain[leads] = _plain[points]
    kind[leads] = kind[leads + 1] = _kinds[points]
    small = _lower[points]
    lower[leads], lower[leads + 1] = 0xC0 | (small >> 6), 0x80 | (small & 0x3F)
    plain[:-1] &= ~((data[:-1] == ord("<")) & (data[1:] == ord("|")))

    # A piece begins where the kind of character changes, at every number, and at the head of a text.
    heads = np.zeros(size + 1, bool)
    heads[offsets] = True
    cut = heads.copy()
    cut[1:size] |= kind[1:] != kind[:-1]
    cut[:size] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    at = np.flatnonzero(cut[:size] & (lower == ord("'")))
    at = at[~heads[at + 1]]
    one = np.isin(lower[at + 1], [e[0] for e in _ENDINGS[0]])
    longer = at[~one]
    longer = longer[~heads[longer + 2]] if len(longer) else longer
    two = np.zeros(len(longer), bool)
    for ending in _ENDINGS[1]:
        two |= (lower[longer + 1] == ending[0]) & (lower[longer + 2] == ending[1])
    for found, length in ((at[one], 2), (longer[two], 3)):
        cut[found + 1] = False
        cut[found + length] = True
    cuts = np.flatnonzero(cut)
    starts, ends = cuts[:-1], cuts[1:]
    may = np.ones(len(offsets) - 1, bool)
    may[np.searchsorted(offsets, np.flatnonzero(~plain), "right") - 1] = False
    real = (kind[starts] != BLANK) & may[np.searchsorted(offsets, starts, "right") - 1]
    return lower, starts[real], ends[real], may


class _Known:
    """Pieces met so far: two numbers hold the bytes of one, and its ids stand together in one array."""

    def __init__(self) -> None:
        self.low, self.high, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.begin, self.ids, self.count = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it is not known."""
        slot = self._slot(low, high)
        number = self.number[slot]
        wrong = np.flatnonzero((number >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (SLOTS - 1)
            there = slot[wrong]
            number[wrong] = self.number[there]
            wrong = wrong[(number[wrong] >= 0) & ((self.low[there] != low[wrong]) | (self.high[there] != high[wrong]))]
        return number

    def add(self, ids: list[list[int]]) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        first = self.count
        self.count += len(ids)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(i) for i in ids], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([t for i in ids for t in i], np.uint32)])
        return np.arange(first, self.count, dtype=np.int32)

    def store(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Enter different pieces that are not known yet."""
        slot, left = self._slot(low, high), np.arange(len(low))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.low[slot[put]], self.high[slot[put]], self.number[slot[put]] = low[put], high[put], numbers[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (SLOTS - 1)


class Encoder:
    """Ids of texts without begin, end or padding, as the library of the file gives them by default."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            self.by_piece = False
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._encode = lambda texts: [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and splits[0].get("pattern") == {"Regex": _SPLIT}
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and not splits[1].get("add_prefix_space")
            and not splits[1].get("use_regex")
            # Other added tokens could stand in a plain text, and normalized ones are looked for after lower-casing.
            and all(t["content"].startswith("<|") and not t.get("normalized") for t in spec.get("added_tokens", []))
        )
        self.known = _Known()

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has); a null text is empty."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = [self._slice(column.slice(first, last - first), data, offsets) for first, last, data, offsets in text_slices(column)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        ids, counts = self.encoded(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]

    def _slice(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            return _flat(self._encode([t or "" for t in column.to_pylist()]))
        if self.known.count > REMEMBERED:
            self.known = _Known()
        lower, starts, ends, may = split_pieces(data, offsets)
        numbers = self._numbers(lower, starts, ends)
        sizes = np.diff(self.known.begin)[numbers] if len(numbers) else np.zeros(0, np.int64)
        # Ids of piece after piece: the place of a piece's first id, and how far behind it each one is.
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.known.ids[np.repeat(self.known.begin[numbers] - (upto - sizes), sizes) + np.arange(total)]
        # A piece lies in the text that its first byte is in.
        behind = np.searchsorted(starts, offsets[1:], "left")
        reached = np.concatenate([[0], upto])[behind]
        counts = np.diff(reached, prepend=0)
        if may.all():
            return ids, counts
        hard = np.flatnonzero(~may)
        whole = self._encode([t or "" for t in column.take(pa.array(hard)).to_pylist()])
        counts[hard] = [len(i) for i in whole]
        places = reached[hard]
        cut, out = 0, []
        for place, own in zip(places.tolist(), whole):
            out += [ids[cut:place], np.asarray(own, np.uint32)]
            cut = place
        return np.concatenate([*out, ids[cut:]]), counts

    def _numbers(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pieces among the known ones; new ones are encoded and added."""
        known, sizes = self.known, ends - starts
        padded = np.concatenate([lower, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(lower) + 9,), (1,))
        low = words[starts] & _low_bytes[np.minimum(sizes, 8)]
        high = words[starts + 8] & _low_bytes[np.clip(sizes - 8, 0, 8)]
        numbers = known.find(low, high)
        short = sizes <= 16
        new = np.flatnonzero((numbers < 0) & short)
        if len(new):
            new = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(new), bool)
            first[1:] = (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])
            once = new[first]
            added = known.add(self._encode([lower[a:b].tobytes().decode() for a, b in zip(starts[once].tolist(), ends[once].tolist())]))
            known.store(low[once], high[once], added)
            numbers[new] = added[np.cumsum(first) - 1]
        long = np.flatnonzero(~short)
        if len(long):
            texts = [lower[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            unknown = [t for t in dict.fromkeys(texts) if t not in known.long]
            if unknown:
                known.long.update(zip(unknown, known.add(self._encode([t.decode() for t in unknown])).tolist()))
            numbers[long] = [known.long[t] for t in texts]
        return numbers


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([t for i in ids for t in i], np.uint32), np.array([len(i) for i in ids], np.int64)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once per worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another version of a vocabulary is another tokenizer."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
