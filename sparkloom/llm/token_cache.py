"""Token ids of words, remembered by each Python worker. The tokenizer splits at white space, so texts are the sum of their words."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps, and their characters at most; others are encoded again each time, which changes no result.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: Words encoded together: what the tokenizer returns for a word is far larger than its ids.
TOGETHER = 20_000
#: Places for hashes of words met before: most words are met once, and only those met again are kept.
MET = 1 << 23
#: Letters of Latin-1, and a mark that always parts from them.
LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[.,]?$"
_OPEN: dict[str, "WordIds"] = {}


class WordIds:
    """For tokenizers that lower the case and drop white space (so space and newline always part pre-tokens)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encode = Tokenizer.from_file(path).encode
        self.words: dict[str, bytes] = {}
        self.met = bytearray(MET)
        # lower-case letters of Latin-1 are in normal form and one pre-token each word: where runs of letters are pre-tokens, bytes and merges are all they need
        self.letters = None
        if self._runs_of_letters(path):
            plain = Tokenizer.from_file(path)
            plain.normalizer = None
            plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = plain.encode
        self.ends = self._encoded(self.encode, ["", ".", ","])

    @staticmethod
    def _runs_of_letters(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        forms = [n["type"] for n in (held.get("normalizer") or {}).get("normalizers", [])]
        steps = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s["pattern"].get("Regex", "") for s in steps if s["type"] == "Split"]
        marks = {a["content"] for a in held.get("added_tokens", []) if a["content"].isalpha()}
        return (
            forms == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            # a letter alone begins no other branch of the pattern
            and [b for b in patterns[0].split("|") if not b.startswith("'")][0] == "[\\p{L}]+"
            and not marks
        )

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    @staticmethod
    def _encoded(encode, words: list[str]) -> list[bytes]:
        if not words:
            return []
        e = encode(words, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(e.ids, np.uint32).tobytes()
        cut = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(words) + 1))).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _words(self, words: list[str], letters: np.ndarray) -> list[bytes]:
        """The ids of distinct words; ``letters`` tells those of nothing but lower-case letters of Latin-1."""
        held = list(map(self.words.get, words))
        new = np.array([i for i, ids in enumerate(held) if ids is None], np.int64)
        for kind, encode in ((True, self.letters or self.encode), (False, self.encode)):
            of = new[letters[new] == kind].tolist()
            for k in range(0, len(of), TOGETHER):
                part = of[k : k + TOGETHER]
                for i, ids in zip(part, self._encoded(encode, [words[i] for i in part]), strict=True):
                    held[i] = ids
                    self._keep(words[i], ids)
        return held

    def _keep(self, word: str, ids: bytes) -> None:
        at = hash(word) % MET
        if not self.met[at]:
            self.met[at] = 1
        elif len(self.words) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self.words[word] = ids

    @staticmethod
    def _joined(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` are runs of ``size`` ids: (those of runs ``which`` one after another, where each of them begins and the last ends)."""
        at, size = (np.cumsum(size) - size)[which], size[which]
        until = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(at - until[:-1], size) + np.arange(until[-1])], until

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of distinct chunks one after another, where each begins and the last ends)."""
        plain = pc.match_substring_regex(chunks, LETTERS)
        # others as they are: other letters may end in a mark when normalized, which joins what follows
        words = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(chunks, characters=".,")), chunks).dictionary_encode()
        plain, which = plain.to_numpy(zero_copy_only=False), words.indices.to_numpy()
        letters = np.zeros(len(words.dictionary), bool)
        letters[which] = plain
        held = self._words(words.dictionary.to_pylist(), letters)
        end = [pc.ends_with(chunks, mark).to_numpy(zero_copy_only=False) * k for k, mark in enumerate(".,", 1)]
        both = np.stack([which, len(held) + plain * sum(end)], axis=1).ravel()  # each word and the mark after it, or none
        held += self.ends
        ids, until = self._joined(np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) // 4, both)
        return ids, until[::2]

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column (null: empty), as unsigned 32-bit numbers."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds, split = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        ids, until = self._chunks(split.dictionary)
        ids, until = self._joined(ids, np.diff(until), split.indices.to_numpy())
        cut = until[bounds - bounds[0]].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        return [ids.tobytes() for ids in self.column(pa.array(texts, pa.string()))]
