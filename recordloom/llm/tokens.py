"""Public subword tokenizers over Arrow batches, one encoding per distinct piece of a word.

The tokenizers this serves (a JSON file whose pre-tokenizer drops white space) never let a token reach over white
space, nor from a letter or digit to an ASCII punctuation character other than an apostrophe's contraction, which
starts at the punctuation. So a text's ids are the ids of its words, and a word's ids are those of its stem and of
its run of trailing punctuation, if the stem ends in a letter or digit after the tokenizer's own normaliser (some
capitals become a letter and a mark, and marks join punctuation). Words that hold the opening of a special token are encoded whole; lower-casing
before look-up is done on pure ASCII only, where it commutes with the tokenizer's own normaliser.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recordloom.llm.textblocks import split_words

#: ASCII punctuation that can end a word without touching the token before it.
TAIL = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~>"
SPECIAL = "<|"
#: Words whose lower-case form is as many letters, so one pre-token; and the vocabulary's mark of a pre-token's end.
LETTERS, END_OF_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", "</w>"


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts by their pieces; keeps the ids of about ``kept`` pieces between batches, then starts anew.

    Words of letters only are encoded many at a time, joined by spaces: the vocabulary's end-of-word mark tells where
    each ends. Results don't depend on what is kept.
    """

    def __init__(self, path: str, kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(END_OF_WORD) for k in range(size)])
        self.apart: dict[str, bool] = {}
        self._forget()

    def _ends_apart(self, stem: str) -> bool:
        """Whether punctuation after the stem is a pre-token of its own."""
        last = self.tokenizer.normalizer.normalize_str(stem)[-1:]
        if last not in self.apart:
            self.apart[last] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{last}:")) == 2
        return self.apart[last]

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        joined = pa.array(pieces, pa.string())
        single = pc.match_substring_regex(joined, LETTERS).to_numpy(zero_copy_only=False)
        flats, lengths, order = [self.flat], [], []
        letters = np.flatnonzero(single)
        for at in range(0, len(letters), 5_000):
            part = letters[at : at + 5_000]
            text = " ".join([pieces[k] for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            bounds = np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) != len(part):
                raise ValueError("the tokenizer does not end every word with its mark")
            flats.append(ids)
            lengths.append(np.diff(bounds, prepend=0))
            order.append(part)
        others = np.flatnonzero(~single)
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False)]
            flats.append(np.fromiter(chain.from_iterable(found), np.uint32))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            order.append(part)
        length = np.concatenate(lengths)
        first = len(self.known)
        self.known.update(zip([pieces[k] for k in np.concatenate(order).tolist()], range(first, first + len(length)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(length) - length])
        self.lengths = np.concatenate([self.lengths, length])
        self.flat = np.concatenate(flats)

    def _places(self, pieces: list[str]) -> np.ndarray:
        places = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(places < 0)
        if len(new):
            words = [pieces[k] for k in new.tolist()]
            self._learn(words)
            places[new] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return places

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text with ``end`` after each, and where each text's ids begin (one bound more than texts)."""
        if len(self.known) > self.kept:
            self._forget()
        words = split_words(texts, lower=False)
        vocabulary = words.vocabulary
        special = pc.match_substring(vocabulary, SPECIAL)
        plain = pc.and_(pc.string_is_ascii(vocabulary), pc.invert(special))
        vocabulary = pc.if_else(plain, pc.ascii_lower(vocabulary), vocabulary)
        stems = pc.ascii_rtrim(vocabulary, TAIL)
        cut = pc.and_(pc.invert(special), pc.match_substring_regex(stems, r"[\p{L}\p{N}]$"))
        unsure = pc.and_(pc.and_(cut, pc.not_equal(pc.binary_length(stems), pc.binary_length(vocabulary))), pc.invert(pc.match_substring_regex(stems, "[a-z0-9]$")))
        if (at := np.flatnonzero(unsure.to_numpy(zero_copy_only=False))).size:
            apart = cut.to_numpy(zero_copy_only=False).copy()
            apart[at] = [self._ends_apart(stem) for stem in _strings(stems.take(pa.array(at)))]
            cut = pa.array(apart)
        stems = pc.if_else(cut, stems, vocabulary)
        tail_length = pc.subtract(pc.binary_length(vocabulary), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        coded = stems.dictionary_encode()
        tailed = np.flatnonzero(tail_length)
        tails = [w[-n:] for w, n in zip(_strings(vocabulary.take(pa.array(tailed))), tail_length[tailed].tolist(), strict=True)]
        distinct = list(dict.fromkeys(tails))
        stem = self._places(_strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)] if len(vocabulary) else np.zeros(0, np.int64)
        tail = np.zeros(len(stem), np.int64)
        of = dict(zip(distinct, self._places(distinct).tolist(), strict=True))
        tail[tailed] = np.fromiter(map(of.__getitem__, tails), np.int64, len(tails))
        last = len(self.begins)  # the piece that holds the end id
        flat, begins, lengths = np.append(self.flat, np.uint32(end)), np.append(self.begins, len(self.flat)), np.append(self.lengths, 1)
        n_docs = len(words.starts) - 1
        pieces = np.stack([stem[words.codes], tail[words.codes]], axis=1).ravel()
        pieces = np.insert(pieces, 2 * words.starts[1:], last)
        n = lengths[pieces]
        bounds = np.cumsum(n)
        shift = (begins[pieces] - (bounds - n)).astype(np.int32)
        at = np.repeat(shift, n)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        closing = 2 * words.starts[1:] + np.arange(n_docs)
        return ids, np.concatenate([[0], bounds[closing]]).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each tokenizer in a Python worker, with what it has kept from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The runs of ``values`` as little-endian binary values."""
    values = np.ascontiguousarray(values)
    offsets = (starts * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
