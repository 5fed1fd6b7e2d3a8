"""Token ids of whole Arrow batches, with a bounded memory of words already seen."""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of Latin letters that stay one piece when lower-cased and normalised, and marks that are a piece of their own behind them.
PLAIN, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ȹ]+"), ".,!?;:#$%&*"
#: Stems and marks in one text.
TOGETHER = 100


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts under a tokenizer that never joins characters across a blank.

    The tokenizer drops white space and splits at it, so a text's ids are those of its blank-separated words one after
    the other, and each word is handed to the tokenizer once. About `room` words are remembered: their ids lie in one
    array, where a word's number tells begin and size.
    """

    def __init__(self, path: str, room: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as NoChange
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary and merges for words that are lower-cased and split already
        self.merges_only = Tokenizer.from_file(path)
        self.merges_only.normalizer = NoChange([])
        self.merges_only.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.room = room
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.sizes = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def ids_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers, one word after the other, and how many each has."""
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], sizes

    def learn(self, new: list[str]) -> None:
        """Add words to the memory. A plain word is its lower-cased stem and its marks; stems and marks that are not known go
        through the merges, many in one text, told apart by the word ends."""
        plain, pieces, rest = [], [], []
        for word in new:
            stem = word.rstrip(MARKS)
            if PLAIN.fullmatch(stem):
                plain.append(word)
                pieces += (stem.lower(), word[len(stem) :])
            else:
                rest.append(word)
        unmet = [x for x in dict.fromkeys(pieces) if x not in self.known]
        texts = [" ".join(unmet[k : k + TOGETHER]) for k in range(0, len(unmet), TOGETHER)]
        ids = _flat([x.ids for x in self.merges_only.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(unmet):
            self.add(unmet, np.diff(ends, prepend=0), ids)
            which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            rest = [word for word in rest if word not in self.known]  # marks by themselves
            made = np.array([word not in self.known for word in plain], bool)
            ids, sizes = self.ids_of(which.reshape(-1, 2)[made].ravel())
            self.add([word for word, own in zip(plain, made.tolist(), strict=True) if own], sizes.reshape(-1, 2).sum(1), ids)
        else:
            rest = new
        each = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self.add(rest, np.fromiter(map(len, each), np.int64, len(each)), _flat(each))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more than there are texts)."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > self.room:
            self.forget()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(unmet := np.flatnonzero(number < 0)):
            new = words[unmet].tolist()
            self.learn(new)
            number[unmet] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, sizes = self.ids_of(number[coded.indices.to_numpy()])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]]


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.uint32)


@cache
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks that a Python worker runs."""
    return WordIds(path)
