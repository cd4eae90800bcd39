"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

Both vocabularies split a text into pieces before any merge, and a piece's ids do
not depend on what surrounds it.  The texts are cut where such a split surely
lies: at plain white space, and between letters and other signs in words of ASCII
and Latin-1 letters without an apostrophe.  All pieces of a run of texts are
found and hashed in numpy; each distinct piece is encoded by the library once per
worker process and remembered by its hash, so known pieces cost a lookup in an
array.  Texts with other kinds of white space, or with a string of one of the
vocabulary's added tokens, go to the library whole.

Pieces are told apart by 64-bit hashes and their lengths; of n remembered pieces
a new one is taken for another with a chance of about n / 2**64.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import utf8_buffer
from .wordblock import SpanHashes

#: White space besides the six plain ones.
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: First bytes of the above.
_ODD_BLANK_LEADS = (*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF)
#: Pieces of more bytes are not remembered.
_LONG = 100
#: Pieces of letters that are encoded in one call.
_TOGETHER = 256
_BLANK, _LETTER, _SIGN = 0, 1, 2


def _byte_table(kind, *values) -> np.ndarray:
    table = np.zeros(256, kind)
    table[list(values)] = 1
    return table


_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
#: The Latin-1 letters are 0xC3 and one byte more.
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
#: Bytes whose words are cut at white space only: apostrophes (contractions), and all outside ASCII and the Latin-1 letters (the two signs among those too).
_WHOLE_WORD = _byte_table(bool, 0x27, 0x97, 0xB7, *(x for x in range(0xC0, 0x100) if x != 0xC3))
_FOREIGN = _byte_table(bool, 0x97, 0xB7, *(x for x in range(0xC0, 0x100) if x != 0xC3))
_MAYBE_ODD = _byte_table(bool, *_ODD_BLANK_LEADS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32


class _Memo:
    """Ids by piece hash: buckets of two slots, a pool of ids; full, it stays as it is."""

    def __init__(self, pieces: int, kind: np.dtype):
        bits = max(8, int(pieces).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._at = np.zeros(1 << bits, np.int64)
        self._lengths = np.zeros(1 << bits, np.int32)
        self._pool = np.zeros(1 << 16, kind)
        self._limit, self.count, self._used = pieces, 0, 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids; -1 for pieces that are not known."""
        slot = (keys >> self._shift).astype(np.int64)
        missing = np.flatnonzero(self._keys[slot] != keys)
        other = slot[missing] ^ 1
        known = self._keys[other] == keys[missing]
        slot[missing[known]] = other[known]
        at, lengths = self._at[slot], self._lengths[slot]
        at[missing[~known]] = -1
        return at, lengths

    def add(self, keys: np.ndarray, keep: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lay ids into the pool and remember those to keep; the rest stay until the next call.  Gives their places."""
        end = self._used + len(ids)
        if end > len(self._pool):
            grown = np.zeros(max(end, len(self._pool) * 3 // 2), self._pool.dtype)
            grown[: self._used] = self._pool[: self._used]
            self._pool = grown
        at = self._used + np.cumsum(lengths) - lengths
        self._pool[self._used : end] = ids
        if self.count < self._limit:
            left = np.flatnonzero(keep)
            for flip in (0, 1):
                slot = (keys[left] >> self._shift).astype(np.int64) ^ flip
                free = np.flatnonzero(self._keys[slot] == 0)
                slots, first = np.unique(slot[free], return_index=True)
                mine = left[free[first]]
                self._keys[slots], self._at[slots], self._lengths[slots] = keys[mine], at[mine], lengths[mine]
                self.count += len(mine)
                left = np.delete(left, free[first])
            self._used = end
        return at

    def gather(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of pieces end to end."""
        ends = np.cumsum(lengths)
        source = np.repeat(at - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self._pool[source]


class PieceEncoder:
    """Texts to ids.

    path: a tokenizer file.  spaced: whether white space takes part in the ids
    (byte-level vocabularies) or is dropped; in the latter case the vocabulary
    must lower-case its input.  width: bytes of an id.  memo: pieces
    remembered, about.
    """

    def __init__(self, path: str, spaced: bool, width: int = 4, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._spaced, self._kind = spaced, np.dtype(f"<u{width}")
        self._added = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        if any(x.normalized for x in self._tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must match as they are written")
        self._memo = _Memo(memo, self._kind)
        # Where one piece of letters ends and the next begins shows in the ids alone: with white space in the ids, its
        # first token has the blank; without, its last token has the mark of a word's end.
        vocab = self._tokenizer.get_vocab()
        self._edge = np.zeros(max(vocab.values()) + 1, bool)
        self._edge[[i for token, i in vocab.items() if (token.startswith("Ġ") if spaced else token.endswith("</w>"))]] = True

    def _together(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pieces of letters, many in one call, and the number of each piece's."""
        chunks = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        joined = [("" if self._spaced else " ").join(x) for x in chunks]
        all_ids, lengths = [], []
        for chunk, encoding in zip(chunks, self._tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, self._kind)
            at = np.flatnonzero(self._edge[ids])
            own = np.diff(np.append(at, len(ids)) if self._spaced else np.append(0, at + 1))
            if len(own) != len(chunk):
                raise ValueError("pieces don't show in the ids")
            all_ids.append(ids)
            lengths.append(own)
        return all_ids, lengths

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self._kind) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct new pieces; their places in the pool and numbers of ids."""
        raw = data.tobytes()
        pieces = [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = np.argsort(~letters, kind="stable")
        n = int(letters.sum())
        ids, lengths = self._together([pieces[i] for i in order[:n].tolist()])
        rest = self._direct([pieces[i] for i in order[n:].tolist()])
        lengths = np.concatenate([*lengths, np.array([len(x) for x in rest], np.int64)]).astype(np.int64)
        at = self._memo.add(keys[order], (ends - starts)[order] <= _LONG, np.concatenate([*ids, *rest, np.zeros(0, self._kind)]), lengths)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return at[back], lengths[back]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes as they are hashed, starts and ends of the pieces, and which are letters alone (after their blank)."""
        n = len(data)
        kind = _CLASS[data]
        blank = kind == _BLANK
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        cut = edge.copy()  # where one word or run of blanks ends and the next begins
        cut[1:n] |= blank[1:] != blank[:-1]
        change = cut.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        whole = np.flatnonzero(_WHOLE_WORD[data])
        cuts = np.flatnonzero(cut)
        if len(whole):
            # No cut inside words that hold such a byte.
            words = np.unique(np.searchsorted(cuts, whole, side="right") - 1)
            length = cuts[words + 1] - cuts[words]
            inside = np.repeat(cuts[words] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            kind[inside] = _SIGN
            change[inside] = cut[inside]
        if not self._spaced:
            lowered = _LOWER[data]
            foreign = np.flatnonzero(_FOREIGN[data])
            if len(foreign):
                words = np.unique(np.searchsorted(cuts, foreign, side="right") - 1)
                length = cuts[words + 1] - cuts[words]
                inside = np.repeat(cuts[words] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                lowered[inside] = data[inside]
            data = lowered
        begin = np.zeros(n + 1, bool)
        begin[:n] = change[:n] & ~blank
        stop = np.zeros(n + 1, bool)
        stop[1:] = change[1:] & ~blank
        if self._spaced:
            first = np.flatnonzero(cut[:n] & blank)
            last = np.flatnonzero(cut[1:] & blank) + 1
            final = edge[last]
            space = (data[last - 1] == 0x20) & ~final
            # All but the last blank are a piece; the last one goes to the word after it if it is a space.
            several = (last - first > 1) & ~final
            begin[first[several | final]] = True
            stop[(last - 1)[several]] = True
            begin[(last - 1)[~final]] = True
            begin[last[space]] = False
            stop[last[~space]] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
        letters = kind[np.maximum(ends - 1, 0)] == _LETTER
        if self._spaced:
            letters &= data[starts] == 0x20
        return data, starts, ends, letters

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is the empty text."""
        data, offsets = utf8_buffer(column)
        plain = np.ones(len(column), bool)
        for x in np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_ODD[data]), side="right") - 1).tolist():
            plain[x] = not _ODD_BLANK.search(column[x].as_py())
        raw = data.tobytes()
        for token in map(str.encode, self._added):
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        data, starts, ends, letters = self._pieces(data, offsets)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if not plain.all():
            mine = plain[owner]
            starts, ends, letters, owner = starts[mine], ends[mine], letters[mine], owner[mine]
        keys = SpanHashes(data).span_hash(starts, ends)
        at, lengths = self._memo.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            one = new[first]
            places, sizes = self._learn(data, starts[one], ends[one], distinct, letters[one])
            at[new], lengths[new] = places[back], sizes[back]
        ids = self._memo.gather(at, lengths)
        before = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=lengths, minlength=len(column)).astype(np.int64))])
        out = [ids[s:e] for s, e in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        other = np.flatnonzero(~plain).tolist()
        for i, own in zip(other, self._direct([column[i].as_py() for i in other]), strict=True):
            out[i] = own
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, spaced: bool, width: int = 4, memo: int = 1_000_000) -> PieceEncoder:
    """One encoder a worker process and vocabulary."""
    key = (path, spaced, width, memo)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, spaced, width, memo)
    return _encoders[key]


def forget_encoders() -> None:
    _encoders.clear()


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
