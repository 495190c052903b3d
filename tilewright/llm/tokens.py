"""Token ids of texts by a public tokenizer file, with bounded caches of words."""

from __future__ import annotations

import json
import os
import re

import numpy as np

CACHED_WORDS = 400_000
# The word-end BPE's own split of a text, as its file states it (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of ASCII without apostrophes and of Latin-1 letters: split and lower-cased here just as by the tokenizer.
LETTERS, DIGIT, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[0-9]", r"[!-&(-/:-@\[-`{-~]+"
CORE = re.compile(f"{LETTERS}|{DIGIT}|{SIGNS}")
PLAIN = re.compile(f"(?:{LETTERS}|{DIGIT}|{SIGNS})+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text, joined from the ids of its words (UTF-8 words between ASCII spaces).

    Valid for tokenizers that drop white space and never merge across it, as the word-end BPE does: a text's ids are
    then its words' ids in a row. Where the file has the split above, the parts of plain words are encoded many at a
    time without the normaliser and told apart by their word-end ids; all other words go through the whole tokenizer. Caches
    are emptied when full; that changes speed only.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.cached_words = cached_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        split = self.tokenizer.pre_tokenizer
        steps = json.loads(split.__getstate__()).get("pretokenizers") or [{}] if split else [{}]
        self.plain = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>" and steps[0].get("pattern") == {"Regex": SPLIT}
        if self.plain:
            self.parts = Tokenizer(self.tokenizer.model)  # the same model, without normaliser and special tokens
            self.parts.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn_cores(self, cores: list[str]) -> None:
        lines = [" ".join(cores[i:i + 64]) for i in range(0, len(cores), 64)]
        ids = np.array([i for e in self.parts.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        raw, at = ids.tobytes(), 0
        assert len(ends) == len(cores)
        for core, end in zip(cores, ends.tolist()):
            self.cores[core] = raw[at:end]
            at = end

    def _learn(self, new: list[bytes]) -> None:
        other, split = [], []
        joined = b" ".join(new).decode()
        special = [s for s in self.special if s in joined] if self.plain else []
        for w, text in zip(new, joined.split(" ")):
            if self.plain and PLAIN.fullmatch(text) and not (special and any(s in text for s in special)):
                split.append((w, CORE.findall(text.lower())))
            else:
                other.append((w, text))
        if len(self.cores) > self.cached_words:
            self.cores.clear()
        self._learn_cores(list(dict.fromkeys(c for _, cores in split for c in cores if c not in self.cores)))
        for w, cores in split:
            self.words[w] = b"".join([self.cores[c] for c in cores])
        for (w, _), e in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """For every list of words its ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.cached_words:
            self.words.clear()
        known = self.words
        new = list(set().union(*texts).difference(known))
        for i in range(0, len(new), 20_000):
            self._learn(new[i:i + 20_000])
        get = known.__getitem__
        return [b"".join(map(get, w)) for w in texts]
