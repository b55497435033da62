"""Exact encoding of whole texts by a public tokenizer, with a bounded memory of pieces.

Both pre-tokenizers in use never join characters across the cuts made here,
so the ids of a text are those of its pieces put together. Cutting, counting
and putting together are done by Arrow over a group of texts at a time; the
library sees each piece once while it is remembered. What is remembered lies
in two Arrow arrays, some 20 bytes a piece.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode White_Space, as the pre-tokenizers' \s has it.
_WS = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"[^{_WS}]+")
_SPACED = regex.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Where a long text may be cut in two: before a single space between words.
_SEAM = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
#: White space but space and line feed, for Arrow's patterns.
_RARE = r"\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that Arrow's cuts do not serve: the separators are white space to Arrow but not to the
#: pre-tokenizers; where runs of white space are kept, those whose last character goes with the next word.
_ODD_WORDS = r"[\x1c-\x1f]"
_ODD_SPACED = rf"  | \n|\n\n\n|\n\n |\n\n$|[\x00\x1c-\x1f{_RARE}]"
#: Letters that lower case and normal form C map one to one, maybe after a space.
_LETTERS = r"^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Punctuation that both pre-tokenizers cut off behind a letter, as one run.
_TRAILING = ".,;:!?"


def cut_words(text: str) -> list[str]:
    """Runs without white space."""
    return _WORDS.findall(text)


def cut_spaced(text: str) -> list[str]:
    """Pieces that hold all of the text: words with the space before them, and white space."""
    return _SPACED.findall(text)


def _byte_names() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """Ids of texts as the library's plain call gives them. ``spaced``: white space belongs to the pieces (byte-level BPE); else it is dropped.

    At most ``remembered`` pieces are kept, none over 64 bytes; texts are
    taken in groups of about ``group`` bytes, longer ones cut at a space.
    ``specials_as_text``: the strings of special tokens are ordinary text;
    else, as the library does by default, they give their special ids.
    """

    def __init__(self, path: str, spaced: bool, remembered: int = 500_000, group: int = 1 << 22, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces never hold a special token, see below
        self.plain.encode_special_tokens = specials_as_text
        specials = [] if specials_as_text else [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.specials = "|".join(regex.escape(s, special_only=True) for s in specials)
        self.spaced, self.cut, self.odd = spaced, (cut_spaced if spaced else cut_words), (_ODD_SPACED if spaced else _ODD_WORDS)
        self.remembered, self.group = remembered, group
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # a character that stands between pieces and whose one id no other character gives
        self.mark, self.between = ("\n", "\n") if spaced else ("\x01", " \x01 ")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.names = _byte_names()
        self.endings: dict[str, list[int]] = {"": []}
        self.kind = pa.list_(pa.from_numpy_dtype(self.dtype))
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], self.kind)

    # -- pieces -------------------------------------------------------------------------------

    def _encode(self, new: pa.Array) -> pa.Array:
        """The ids of pieces, as a list for each."""
        texts = new.to_pylist()
        out: list[list[int]] = [[]] * len(texts)
        stems = pc.utf8_rtrim(new, characters=_TRAILING)
        letters = pc.match_substring_regex(stems, _LETTERS).to_numpy(zero_copy_only=False)
        tokenize, names = self.tokenizer.model.tokenize, self.names
        for i, stem in zip(np.flatnonzero(letters).tolist(), stems.filter(pa.array(letters)).to_pylist()):
            # one word to the pre-tokenizer, so that the model can be asked at once
            ending = texts[i][len(stem) :]
            word = stem if self.spaced else stem.lower()
            if not word.isascii() or self.spaced:
                word = word.encode().decode("latin-1").translate(names)
            if ending not in self.endings:
                if len(self.endings) > 10_000:
                    self.endings = {"": []}
                self.endings[ending] = self.tokenizer.encode(ending, add_special_tokens=False).ids
            out[i] = [t.id for t in tokenize(word)] + self.endings[ending]
        rest = np.flatnonzero(~letters).tolist()
        together = [i for i in rest if self.mark not in texts[i] and texts[i] and not texts[i].isspace()]
        for at in range(0, len(together), 512):
            self._encode_together(texts, out, together[at : at + 512])
        if len(together) < len(rest):
            self._encode_singly(texts, out, sorted({*rest} - {*together}))
        ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(out), self.dtype, int(ends[-1]))))

    def _encode_together(self, texts: list[str], out: list[list[int]], which: list[int]) -> None:
        """One call for many pieces: the library is slow on many short texts."""
        (e,) = self.tokenizer.encode_batch_fast([self.between.join([texts[i] for i in which])], add_special_tokens=False)
        ids = e.ids
        cuts = np.flatnonzero(np.array(ids) == self.mark_id).tolist()
        if len(cuts) != len(which) - 1:
            return self._encode_singly(texts, out, which)
        for i, a, b in zip(which, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]):
            out[i] = ids[a:b]
        return None

    def _encode_singly(self, texts: list[str], out: list[list[int]], which: list[int]) -> None:
        for i, e in zip(which, self.tokenizer.encode_batch_fast([texts[i] for i in which], add_special_tokens=False)):
            out[i] = e.ids

    def _lookup(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """A list array of ids, and for each piece its row there."""
        found = pc.index_in(distinct, value_set=self.pieces)
        rows = found.fill_null(-1).to_numpy().astype(np.int32)
        new = rows < 0
        if not new.any():
            return self.ids, rows
        fresh = distinct.filter(pa.array(new))
        pieces, ids = self.pieces, self.ids
        if len(pieces) + len(fresh) > self.remembered:  # only what this group has met goes on
            met = pa.array(rows[~new])
            pieces, ids = pieces.take(met), ids.take(met)
            rows[~new] = np.arange(len(met))
        rows[new] = len(pieces) + np.arange(len(fresh))
        pieces, ids = pa.concat_arrays([pieces, fresh]), pa.concat_arrays([ids, self._encode(fresh)])
        short = pc.less_equal(pc.binary_length(pieces), 64)
        if len(pieces) > self.remembered:
            self.pieces, self.ids = pa.array([], pa.string()), pa.array([], self.kind)
        elif pc.all(short).as_py():
            self.pieces, self.ids = pieces, ids
        else:
            self.pieces, self.ids = pieces.filter(short), ids.filter(short)
        return ids, rows

    # -- texts --------------------------------------------------------------------------------

    def _of_pieces(self, flat: pa.Array, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts whose pieces are flat[bounds[i]:bounds[i + 1]]."""
        met = flat.dictionary_encode()
        ids, rows = self._lookup(met.dictionary)
        every = ids.take(pa.array(rows).take(met.indices))
        ends = every.offsets.to_numpy()[bounds].tolist()
        values = every.values.to_numpy()
        return [values[a:b] for a, b in zip(ends, ends[1:])]

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of a few texts."""
        odd = pc.match_substring_regex(texts, self.odd)
        if pc.any(odd).as_py():
            hard = texts.filter(odd).to_pylist()
            cuts = [self.cut(t) for t in hard]
            slow = self._of_pieces(pa.array(list(chain.from_iterable(cuts)), pa.string()), np.cumsum([0, *map(len, cuts)]))
            fast = self._group(texts.filter(pc.invert(odd))) if len(hard) < len(texts) else []
            a, b = iter(slow), iter(fast)
            return [next(a) if o else next(b) for o in odd.to_pylist()]
        if self.spaced:
            ready = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
            lists = pc.split_pattern(ready, "\x00")
        else:
            lists = pc.utf8_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        return self._of_pieces(lists.flatten(), ends - ends[0])

    def _segments(self, text: str) -> Iterator[str]:
        """A long text, cut at single spaces; where it has none, it stays whole."""
        at, step = 0, max(self.group // 4, 1)
        while len(text) - at > step:
            seam = _SEAM.search(text, at + step)
            if seam is None:
                break
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def encode_each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, however long, in order; none for null."""
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        special = pc.match_substring_regex(texts, self.specials).to_numpy(zero_copy_only=False) if self.specials else np.zeros(len(texts), bool)
        at, before = 0, 0
        while at < len(texts):
            if special[at]:
                yield np.array(self.plain.encode(texts[at].as_py(), add_special_tokens=False).ids, self.dtype)
                end = at + 1
            else:
                end = max(int(np.searchsorted(sizes, before + self.group, side="right")), at + 1)
                stop = np.flatnonzero(special[at:end])
                end = at + int(stop[0]) if len(stop) else end
                if sizes[end - 1] - before > self.group:
                    parts = [self._group(pa.array([s], pa.string()))[0] for s in self._segments(texts[at].as_py())]
                    yield np.concatenate(parts)
                else:
                    yield from self._group(texts.slice(at, end - at))
            at, before = end, int(sizes[end - 1])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text; none for null."""
        (ids,) = self.encode_each(pa.array([text], pa.string()))
        return ids


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def release() -> None:
    """Lets go of the encoders when a task ends: an idle worker must not hold memory."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
