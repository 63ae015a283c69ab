"""Whole texts to token ids with the tokenizers library, a chunk of text at a time.

A byte-level BPE never merges across the pieces its splitting pattern makes, and the
pattern always ends a piece before a blank that has a non-blank on at least one side, before
a sign that follows a letter, and around a line feed between two characters that are not
white space. Texts are cut there (at signs and line feeds next to ASCII only); each distinct
chunk is encoded once per worker by the library and remembered. Texts with longer runs of
white space around a blank are encoded whole. The ids are those of encoding every text whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Chunks one worker remembers before it forgets the rarer ones; a memory bound, results don't depend on it.
REMEMBERED = 600_000
_LONG_RUN = re.compile(r"\s (?:\s|\Z)")
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Encodes texts to ids.

    Known chunks are entries: rows of ``starts`` and ``sizes`` that say where their ids lie in
    ``pool``. ``uses`` counts the calls they came in, ``spaced`` marks blanks that go on with
    white space. Entry 0 has no ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, at in vocabulary.items():
            self.widths[at] = len(token)  # one character stands for one byte
        # Added tokens are found before the pattern splits: no cut at what they hold.
        added = set("".join(x.content for x in self.tokenizer.get_added_tokens_decoder().values()))
        self.letters, self.signs, self.solid = (np.zeros(256, bool) for _ in range(3))
        for c in map(chr, range(33, 127)):
            self.solid[ord(c)] = True
            self.letters[ord(c)] = c.isalpha()
            self.signs[ord(c)] = not c.isalnum() and c not in added
        self._start()

    def _start(self) -> None:
        self.pool, self.spaced, self.starts, self.sizes, self.uses = (np.zeros(0, t) for t in ("<u4", bool, *[np.int64] * 3))
        self.n_ids = self.n_entries = 0
        self.chunks: dict[str, int] = {}
        self._add_each([np.zeros(0, "<u4")])

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _add(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> range:
        """New entries, which begin at ``starts`` in ``ids``."""
        at, n = self.n_entries, self.n_entries + len(sizes)
        self.pool = _room(self.pool, self.n_ids + len(ids))
        self.spaced, self.starts, self.sizes, self.uses = (_room(x, n) for x in (self.spaced, self.starts, self.sizes, self.uses))
        self.pool[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[at:n], self.sizes[at:n] = starts + self.n_ids, sizes
        self.spaced[at:n], self.uses[at:n] = False, 0
        self.n_ids, self.n_entries = self.n_ids + len(ids), n
        return range(at, n)

    def _add_each(self, parts: list[np.ndarray]) -> range:
        sizes = np.array([len(x) for x in parts], np.int64)
        return self._add(np.concatenate([np.zeros(0, "<u4"), *parts]), np.cumsum(sizes) - sizes, sizes)

    def _ids(self, entries: np.ndarray) -> np.ndarray:
        """Ids of entries laid end to end."""
        sizes = self.sizes[entries]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[entries] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.pool[at]

    def _batch(self, words: list[str], lead: str) -> range:
        """New entries for chunks that, a first blank aside, have no white space at their ends,
        many a call. What leads each, a line feed, is a token of its own, left out."""
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        texts = [lead + lead.join(part) for part in parts]
        skip, n = len(lead), 0
        found, starts, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(coded.ids, "<u4")
            ends = np.cumsum(self.widths[ids])
            bounds = np.cumsum(pc.binary_length(pa.array(part, pa.large_string())).to_numpy() + skip)
            cut = np.searchsorted(ends, bounds) + 1
            if not len(ends) or cut[-1] > len(ends) or (ends[cut - 1] != bounds).any():
                own = [self.whole(w) for w in part]
                ids, size = np.concatenate(own), np.array([len(x) for x in own], np.int64)
                start = np.cumsum(size) - size
            else:
                size = np.diff(cut, prepend=0) - skip
                start = cut - size
            found.append(ids)
            starts.append(start + n)
            sizes.append(size)
            n += len(ids)
        return self._add(*map(np.concatenate, (found, starts, sizes)))

    def _learn(self, words: list[str]) -> None:
        """Entries of chunks."""
        kinds: tuple[list[str], ...] = [], [], []
        for w in words:
            bare = w[1:] if w[0] == " " else w
            kinds[2 if not bare or bare.strip() is not bare else bare is w].append(w)
        led, bare, rest = kinds
        for own, entries in ((led, self._batch(led, "")), (bare, self._batch(bare, "\n")), (rest, self._add_each([self.whole(w) for w in rest]))):
            self.chunks.update(zip(own, entries, strict=True))
        self.spaced[[self.chunks[w] for w in rest if w == " " or w[0] == " " and w[1].isspace()]] = True

    def _forget(self) -> None:
        """Keep the chunks that came in more calls than others, half as many as may be remembered."""
        names, entries = list(self.chunks), np.array(list(self.chunks.values()), np.int64)
        uses = self.uses[entries]
        kept = np.argsort(-uses, kind="stable")[: REMEMBERED // 2]
        kept = kept[uses[kept] > 1]
        entries, uses, names = entries[kept], uses[kept], [names[i] for i in kept.tolist()]
        ids, sizes, spaced = self._ids(entries), self.sizes[entries], self.spaced[entries]
        self._start()
        added = self._add(ids, np.cumsum(sizes) - sizes, sizes)
        self.uses[added.start : added.stop], self.spaced[added.start : added.stop] = uses // 2, spaced
        self.chunks.update(zip(names, added, strict=True))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and where each text's begin and end among them."""
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(ends), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = data == 32
        cut[1:-1] |= self.signs[data[1:]] & self.letters[data[:-1]]
        feeds = np.flatnonzero(data[1:-1] == 10) + 1
        feeds = feeds[self.solid[data[feeds - 1]] & self.solid[data[feeds + 1]]]
        cut[feeds] = cut[feeds + 1] = True
        cut[ends - ends[0]] = True
        at = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        return chunks, np.searchsorted(at, ends - ends[0])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. ``end_id`` comes after each."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        pieces, borders = self._cut(texts)
        pieces = pieces.dictionary_encode()
        words, codes = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        known = self.chunks.get
        entries = np.array([known(w, -1) for w in words], np.int64)
        unknown = np.flatnonzero(entries < 0).tolist()
        new = [words[i] for i in unknown]
        self._learn(new)
        entries[unknown] = [self.chunks[w] for w in new]
        self.uses[entries] += 1
        which = entries[codes]
        # Entries of this call alone.
        n_entries, n_ids = self.n_entries, self.n_ids
        spaced = self.spaced[which]
        if spaced.any():
            for i in np.unique(np.searchsorted(borders, np.flatnonzero(spaced), "right") - 1).tolist():
                text = texts[i].as_py()
                if _LONG_RUN.search(text):
                    which[borders[i] : borders[i + 1]] = 0
                    which[borders[i]] = self._add_each([self.whole(text)])[0]
        if end_id is not None:
            which = np.insert(which, borders[1:], self._add_each([np.array([end_id], "<u4")])[0])
            borders = borders + np.arange(len(borders))
        ids, ends = self._ids(which), np.concatenate([[0], np.cumsum(self.sizes[which])])
        self.n_entries, self.n_ids = n_entries, n_ids
        return ids, np.diff(ends[borders])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of it that is larger by half, where it has not ``n`` places."""
    if len(x) >= n:
        return x
    out = np.zeros(n + n // 2, x.dtype)
    out[: len(x)] = x
    return out
