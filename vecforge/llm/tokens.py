"""Fast batch encoding with the tokenizers library.

Both vocabularies used here never join characters across a blank that is followed by another character than
white space. A text is cut at such blanks; each distinct piece is encoded once by the library, and whole texts are
put together from the pieces' ids with array operations. ``keep_blank`` says whether the blank belongs to the piece
after it (byte-level BPE) or is dropped (word BPE). A text that holds the string of an added token, such as an end
mark, goes through the library as a whole, so that all texts get the ids of a plain call without special tokens added.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = 700_000
BATCH_CHARS = 1 << 20
GROUP_BYTES = 1 << 22
_ODD_BLANK = re.compile(r" (?:\s|$)")
#: The same for Arrow's expressions, with all that Python takes for white space.
_ODD_BLANK_RE2 = r" (?:[\s\v\pZ\x1c-\x1f\x{85}]|$)"
_CUT = re.compile(r"(?= \S)")
_NEXT = re.compile(r" \S")
#: Latin letters below U+0250, but for one whose small form is two characters, then ASCII punctuation.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")
_WORD = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")
#: The same of ASCII letters on one line, for Arrow.
_ASCII_WORD_RE2 = r"\A(?P<word>[A-Za-z]+)(?P<after>[!-/:-@\[-`{-~]*)\z"
#: Byte-level vocabularies write each byte as one visible character: unprintable ones follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_BLANK, _LINE = chr(_VISIBLE[32]), chr(_VISIBLE[10])
_ID = attrgetter("id")


class _Pieces(dict):
    """Numbers of known pieces; an unknown one gets the next number and waits for the library."""

    def __init__(self, owner: Encoder, blank: str):
        super().__init__()
        self.owner, self.blank = owner, blank

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.owner.lengths) + len(self.owner.waiting)
        self.owner.waiting.append(self.blank + piece)
        return n


class _Atoms(dict):
    """Numbers, from ``top`` on, of strings that the model has merged in one call of ``_learn``."""

    def __init__(self, tokenize, top: int):
        super().__init__()
        self.tokenize, self.top = tokenize, top
        self.ids: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, text: str) -> int:
        own = self.tokenize(text)
        self.ids += map(_ID, own)
        self[text] = n = self.top + len(self.sizes)
        self.sizes.append(len(own))
        return n


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    def __init__(self, path: str, keep_blank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.keep_blank = keep_blank
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.waiting: list[str] = []
        self.first, self.spaced = _Pieces(self, ""), _Pieces(self, " " if self.keep_blank else "")
        self.flat, self.starts, self.lengths = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came more often than most, at most half of what there is room for."""
        least = max(2, int(np.partition(self.uses, -(PIECES // 2))[-(PIECES // 2)]) + 1)
        stays = self.uses >= least
        number = np.cumsum(stays) - 1
        for pieces in (self.first, self.spaced):
            kept = {p: int(number[n]) for p, n in pieces.items() if stays[n]}
            pieces.clear()
            pieces.update(kept)
        self.flat = gather(self.flat, self.starts[stays], self.lengths[stays])
        self.lengths = self.lengths[stays]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = self.uses[stays]

    def _learn(self) -> None:
        """Encode the pieces that wait: words and their punctuation by the library's model, others by the whole library."""
        new, self.waiting = self.waiting, []
        if not new:
            return
        atoms = _Atoms(self.model.tokenize, len(self.lengths))
        parts, sizes = self._words(new, atoms) if self.keep_blank else self._plain_words(new, atoms)
        size, at = np.array(sizes, np.int64), np.array(parts, np.int64)
        first = np.cumsum(size) - size
        n = np.array(atoms.sizes, np.int64)
        flat, grown = [self.flat, np.array(atoms.ids, self.kind)], len(self.flat) + len(atoms.ids)
        starts, lengths = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n]), np.concatenate([self.lengths, n])
        # a piece of one part shares its ids, one of several gets a stretch of its own
        own_starts, own_lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        one, more = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
        own_starts[one], own_lengths[one] = starts[at[first[one]]], lengths[at[first[one]]]
        if len(more):
            several = at[np.repeat(size > 1, size)]
            flat.append(gather(np.concatenate(flat), starts[several], lengths[several]))
            own_lengths[more] = np.add.reduceat(lengths[several], np.cumsum(size[more]) - size[more])
            own_starts[more] = grown + np.cumsum(own_lengths[more]) - own_lengths[more]
            grown += len(flat[-1])
        if len(odd := np.flatnonzero(size == 0)):
            ids = [e.ids for e in self.library.encode_batch([new[i] for i in odd.tolist()], add_special_tokens=False)]
            own_lengths[odd] = np.fromiter(map(len, ids), np.int64, len(ids))
            own_starts[odd] = grown + np.cumsum(own_lengths[odd]) - own_lengths[odd]
            flat.append(np.fromiter(chain.from_iterable(ids), self.kind, int(own_lengths[odd].sum())))
        self.starts, self.lengths = np.concatenate([self.starts, own_starts]), np.concatenate([self.lengths, own_lengths])
        self.flat = np.concatenate(flat)

    def _plain_words(self, new: list[str], atoms: _Atoms) -> tuple[np.ndarray, np.ndarray]:
        """As ``_words``: Arrow takes ASCII words from their punctuation and makes both distinct; other pieces go one by one."""
        found = pc.extract_regex(pa.array(new, pa.large_string()), _ASCII_WORD_RE2)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        top, known = len(self.lengths), self.spaced
        words, after = (found.filter(pa.array(plain)).field(i).dictionary_encode() for i in (0, 1))
        lower = pc.ascii_lower(words.dictionary).to_pylist()
        word = np.array([n if (n := known.get(w, top)) < top else atoms[w] for w in lower], np.int64)[words.indices.to_numpy()]
        mark = np.array([atoms[a] if a else -1 for a in after.dictionary.to_pylist()], np.int64)[after.indices.to_numpy()]
        odd = np.flatnonzero(~plain)
        parts, n = self._words([new[i] for i in odd.tolist()], atoms)
        sizes = np.zeros(len(new), np.int64)
        sizes[plain], sizes[odd] = 1 + (mark >= 0), n
        starts, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.int64)
        at = starts[plain]
        out[at], out[at[mark >= 0] + 1] = word, mark[mark >= 0]
        n = sizes[odd]
        out[np.arange(len(parts)) + np.repeat(starts[odd] - (np.cumsum(n) - n), n)] = parts
        return out, sizes

    def _words(self, new: list[str], atoms: _Atoms) -> tuple[list[int], list[int]]:
        """(numbers of the parts of all pieces, number of parts of each) of pieces made of Latin words, each with
        punctuation after it or none, on lines of their own; other pieces have no parts.

        Such words and runs of punctuation are just what both vocabularies cut a text into before merging. A part is a
        piece that has been learnt before or one of ``atoms``."""
        keep, top = self.keep_blank, len(self.lengths)
        spaced, first, match = self.spaced, self.first, _WORD.fullmatch
        out: list[int] = []
        sizes: list[int] = []
        for piece in new:
            if not keep and piece.isascii() and piece.isalpha():
                word = piece.lower()
                known = spaced.get(word, top)
                out.append(known if known < top else atoms[word])
                sizes.append(1)
                continue
            blank, begin = piece[:1] == " ", len(out)
            for i, line in enumerate(piece.split("\n") if "\n" in piece else (piece,)):
                after_blank = blank and not i
                m = match(line, 1) if after_blank else match(line)
                if m is None:
                    del out[begin:]
                    break
                word, after = m.groups()
                if not keep:
                    word = word.lower()
                    known = spaced.get(word, top)
                else:
                    if i:
                        out.append(atoms[_LINE])
                    known = (spaced if after_blank else first).get(word, top)
                if known < top:  # the bare word has been learnt before
                    out.append(known)
                elif keep:
                    mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)
                    out.append(atoms[_BLANK + mapped if after_blank else mapped])
                else:
                    out.append(atoms[word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)])
                if after:
                    out.append(atoms[after])
            sizes.append(len(out) - begin)
        return out, sizes

    def _numbers(self, text: str, begins: bool) -> np.ndarray:
        if not self.keep_blank:
            parts = text.split(" ")
            return np.fromiter(map(self.spaced.__getitem__, parts), np.int32, len(parts))
        if _ODD_BLANK.search(text):
            parts = [p[1:] if i or not begins else p for i, p in enumerate(_CUT.split(text))]
            if begins and not parts[0]:
                parts = parts[1:]
                begins = False
        else:
            parts = text.split(" ")
            if not parts[0]:  # the text begins with its blank
                parts, begins = parts[1:], False
        out = np.empty(len(parts), np.int32)
        if begins:
            out[0] = self.first[parts[0]]
        out[begins:] = np.fromiter(map(self.spaced.__getitem__, parts[begins:]), np.int32, len(parts) - begins)
        return out

    def _windows(self, text: str) -> Iterator[str]:
        """Very long texts in stretches that can be encoded one by one."""
        at = 0
        while len(text) - at > BATCH_CHARS and (m := _NEXT.search(text, at + BATCH_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield from self._group(column.slice(a, b - a), sizes[a:b])

    def _group(self, column: pa.Array, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Texts with plain blanks are cut and their pieces made distinct by Arrow; others go one by one."""
        odd = sizes > BATCH_CHARS
        if self.keep_blank:
            odd = odd | pc.match_substring_regex(column, _ODD_BLANK_RE2).to_numpy(zero_copy_only=False)
        marked = np.zeros(len(odd), bool)
        for mark in self.marks:
            marked |= pc.match_substring(column, mark, ignore_case=True).to_numpy(zero_copy_only=False)
        rows: list[np.ndarray | None] = [None] * len(odd)
        plain, odd = np.flatnonzero(~odd & ~marked), odd & ~marked
        if len(plain):
            lists = pc.split_pattern(column.take(pa.array(plain)), " ")
            first = np.array(lists.offsets)
            words = lists.flatten().dictionary_encode()
            at, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
            numbers = np.fromiter(map(self.spaced.__getitem__, distinct), np.int32, len(distinct))[at]
            begins = first[:-1] - first[0]
            if self.keep_blank:
                numbers[begins] = [self.first[distinct[i]] for i in at[begins].tolist()]
            for i, a, b in zip(plain.tolist(), begins.tolist(), (first[1:] - first[0]).tolist(), strict=True):
                rows[i] = numbers[a:b]
        for i in np.flatnonzero(odd).tolist():
            rows[i] = np.concatenate([self._numbers(part, j == 0) for j, part in enumerate(self._windows(column[i].as_py()))])
        if not marked.any():
            yield from self._flush(rows, [len(r) for r in rows])
            return
        pieced = self._flush([r for r in rows if r is not None], [len(r) for r in rows if r is not None])
        for i, r in enumerate(rows):
            yield next(pieced) if r is not None else np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, self.kind)

    def _flush(self, numbers: list[np.ndarray], sizes: list[int]) -> Iterator[np.ndarray]:
        self._learn()
        at = np.concatenate([*numbers, np.zeros(0, np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(self.lengths) - len(self.uses), np.int64)]) + np.bincount(at, minlength=len(self.lengths))
        n = self.lengths[at]
        ids = gather(self.flat, self.starts[at], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]
        if len(self.lengths) > PIECES:
            self._forget()


@functools.lru_cache(maxsize=4)
def encoder(path: str, keep_blank: bool) -> Encoder:
    """One encoder for each Python worker, so that later tasks find its pieces known."""
    return Encoder(path, keep_blank)
