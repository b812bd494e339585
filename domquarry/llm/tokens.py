"""Token ids of whole texts by a byte-level BPE vocabulary file, in array operations over slices of a column.

The vocabulary's pattern never joins a piece over a blank that a non-blank follows, so texts are cut there and each piece is
encoded by itself: the same ids as encoding the text whole. Pieces are told apart by 64-bit hashes; a table of bounded size
holds the ids of pieces seen before, and all new pieces of a slice are encoded in one call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import slices, span_hash

#: Slots of a worker's table (12 bytes each), half of which may hold pieces; later new pieces are encoded in each slice.
TABLE_SLOTS = 1 << 21

#: A blank cuts unless one of these bytes follows: ASCII white space, or the first byte of white space beyond ASCII.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[0x20, 9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ENCODERS: dict[str, PieceEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    def __init__(self, path: str):
        self.path, self._whole, self.fast = path, None, self._ranks(path)
        if self.fast is not None:
            self.width = np.zeros(1 << 16, np.int64)
            for i in self.fast._mergeable_ranks.values():
                self.width[i] = len(self.fast.decode_single_token_bytes(i))
        self.keys, self.values = np.zeros(TABLE_SLOTS, np.uint64), np.zeros(TABLE_SLOTS, np.int32)
        self.n, self.ptr, self.ids = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16)

    @property
    def whole(self):
        """The library that reads any such file; slower, and only loaded if needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True  # their strings in a text are ordinary text
        return self._whole

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary for the faster library; None if the file isn't of that kind."""
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("byte_fallback"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[ch] for ch in w): i for w, i in model["vocab"].items() if w not in special}
        if len(ranks) > 1 << 16 or max(ranks.values()) >= 1 << 16:
            return None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # the faster library merges by rank of the result: only right if results come in the order of the merges
        made = [ranks.get(bytes(back[ch] for ch in a + b), -1) for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            return None
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for those not in the table."""
        mask = np.uint64(TABLE_SLOTS - 1)
        out, live, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & mask).astype(np.int64)
        while len(live):
            k = self.keys[at]
            hit = k == h[live]
            out[live[hit]] = self.values[at[hit]]
            go = ~hit & (k != 0)
            live, at = live[go], (at[go] + 1) & (TABLE_SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct hashes that aren't in the table."""
        mask = np.uint64(TABLE_SLOTS - 1)
        live, at = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(live):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[live[free]]
            won = self.keys[at] == h[live]  # of several that want a slot, the last got it
            self.values[at[won]] = number[live[won]]
            live, at = live[~won], (at[~won] + 1) & (TABLE_SLOTS - 1)

    def _encode_new(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces, and where each one's begin (one more entry than pieces)."""
        inner = np.array([data[a : a + 1] == b" " for a in start.tolist()], bool) if len(start) else np.zeros(0, bool)
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(start), np.int64)
        at = np.flatnonzero(inner)
        if len(at):
            joined = b"".join(data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True))
            ids = np.array(self.fast.encode_ordinary(joined.decode("utf-8", "replace")), np.uint16)
            reach = np.cumsum(self.width[ids])
            upto = np.searchsorted(reach, np.cumsum(end[at] - start[at]), "left") + 1
            sizes[at] = np.diff(upto, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~inner)  # at the start of a text
        firsts = [np.array(self.fast.encode_ordinary(data[a:b].decode("utf-8", "replace")), np.uint16) for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        sizes[rest] = [len(x) for x in firsts]
        order = np.concatenate([at, rest])
        flat = np.concatenate([*parts, *firsts]) if len(order) else np.zeros(0, np.uint16)
        source = np.zeros(len(start) + 1, np.int64)
        source[order] = np.cumsum(sizes[order]) - sizes[order]
        ptr = np.zeros(len(start) + 1, np.int64)
        np.cumsum(sizes, out=ptr[1:])
        return flat[np.arange(ptr[-1]) + np.repeat(source[:-1] - ptr[:-1], sizes)], ptr

    def _keep(self, h: np.ndarray, ids: np.ndarray, ptr: np.ndarray) -> None:
        room = min(len(h), TABLE_SLOTS // 2 - self.n)
        if room <= 0:
            return
        base = self.ptr[self.n]
        while self.n + room + 1 > len(self.ptr):
            self.ptr = np.concatenate([self.ptr, np.zeros_like(self.ptr)])
        while base + ptr[room] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[base : base + ptr[room]] = ids[: ptr[room]]
        self.ptr[self.n + 1 : self.n + room + 1] = base + ptr[1 : room + 1]
        self._insert(h[:room], np.arange(self.n, self.n + room))
        self.n += room

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows of the slice, and where each row's begin (one more entry than rows)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
        bounds = offsets[(offsets > 0) & (offsets < n)]
        cut[bounds - 1] = False  # a blank that ends a text belongs to it
        cut[bounds] = True
        cut[0] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = span_hash(data, start, end)
        h[h == 0] = 1
        number = self._find(h)
        miss = np.flatnonzero(number < 0)
        ids, ptr = self.ids, self.ptr
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            rows = miss[first]
            new_ids, new_ptr = self._encode_new(data.tobytes(), start[rows], end[rows])
            before = self.n
            self._keep(new, new_ids, new_ptr)
            ids, ptr = self.ids, self.ptr
            kept = self.n - before
            number[miss] = before + back
            if kept < len(new):  # the table is full: these serve this slice only
                base = ptr[self.n]
                ids = np.concatenate([ids[:base], new_ids[new_ptr[kept] :]])
                ptr = np.concatenate([ptr[: self.n + 1], base + new_ptr[kept + 1 :] - new_ptr[kept]])
        size = ptr[number + 1] - ptr[number]
        place = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=place[1:])
        out = ids[np.arange(place[-1]) + np.repeat(ptr[number] - place[:-1], size)]
        return out, place[np.searchsorted(start, offsets)]

    def encode(self, text: str) -> np.ndarray:
        return next(encode_rows(pa.array([text]), self))


def encoder(path: str) -> PieceEncoder:
    """One a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_rows(column: pa.Array, e: PieceEncoder):
    """ids of each row's text, in order; null as empty."""
    if e.fast is None:  # another kind of file: each text whole
        for text in column:
            yield np.array(e.whole.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32)
        return
    for _, _, data, off in slices(column):
        ids, first = e.encode_slice(data, off)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield ids[a:b]


def count_rows(column: pa.Array, e: PieceEncoder) -> np.ndarray:
    """Number of ids of each row's text."""
    if e.fast is None:
        return np.array([len(x) for x in encode_rows(column, e)], np.int64)
    return np.concatenate([np.diff(e.encode_slice(data, off)[1]) for _, _, data, off in slices(column)] or [np.zeros(0, np.int64)])
