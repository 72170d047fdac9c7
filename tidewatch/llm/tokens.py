"""Token ids of whole texts with a word-ended BPE of the tokenizers library.

Such a tokenizer parts texts at white space and keeps nothing of it, so a text's ids are those of its words one after
the other. Texts of usual characters are parted into words by Arrow, and each distinct word of some texts is looked up once:
as a piece met before in the task, else as the pieces that the tokenizer cuts it into; new pieces are encoded together. In
other texts a plain word (letters, then marks) is encoded as its two parts, each of which ends with one token that ends a word.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORD_CACHE, give_back

#: Pieces that are encoded together; the library takes about a KB for each until it is done.
PIECES = 10_000
#: Anything but white space, printable ASCII and the letters of Latin-1 that have both cases there.
_UNUSUAL = re.compile("[^\\t-\\r\x20-~À-ÖØ-öø-þ]")
#: How the tokenizer cuts lower-cased texts of such characters; its own rule is the value below, for all characters.
_PIECES = re.compile("[a-zß-öø-þ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-zß-öø-þ0-9]+")
_CUT = re.compile(_PIECES.pattern + "| ")
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: How a byte-level model writes bytes: those that show as themselves, all others as the characters from 256 on; spaces stay.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_LEVEL = np.arange(256, dtype="<u2")
_LEVEL[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_LEVEL[0x20] = 0x20
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def _cuts_like_that(tokenizer) -> bool:
    """The tokenizer lower-cases, and cuts texts by the rule above and nothing else."""
    normalizer, cutter = (json.loads(part.__getstate__()) if part else {} for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = [n["type"] for n in normalizer.get("normalizers", [])]
    rules = [p["pattern"].get("Regex") for p in cutter.get("pretokenizers", []) if p["type"] == "Split"]
    levels = [(p["add_prefix_space"], p["use_regex"]) for p in cutter.get("pretokenizers", []) if p["type"] == "ByteLevel"]
    return steps == _NORMALIZERS and rules == [_RULE] and levels == [(False, False)] and len(cutter["pretokenizers"]) == 2


class WordTokenizer:
    """ids(text) for UTF-8 texts, as little-endian 16-bit numbers; equal to the library's on the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 2**16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.ends = np.zeros(2**16, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.cuts = _cuts_like_that(self.tokenizer)
        #: For pieces that are cut and written as the model does already: the same model (shared), without doing it again.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        del vocabulary
        give_back()

    def clear(self) -> None:
        self.words.clear()
        self.parts.clear()

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str], cut: bool = False) -> None:
        for i in range(0, len(parts), PIECES):
            self._encode_some(parts[i : i + PIECES], cut)

    def _encode_some(self, parts: list[str], cut: bool) -> None:
        tokenizer, joined = self.tokenizer, " ".join(parts)
        if cut:
            tokenizer, joined = self.plain, _LEVEL[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
        ends = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
        if len(ends) == len(parts):
            codes = ids.tobytes()
            self.parts.update(zip(parts, [codes[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        else:
            self.parts.update(zip(parts, self._encode(parts), strict=True))

    def _learn(self, new: set[bytes]) -> None:
        plain, other, need = {}, [], {}
        for word in new:
            if match := _PLAIN.fullmatch(word.decode()):
                letters, marks = match.groups()
                plain[word] = letters, marks = letters.lower(), marks
                need |= {p: None for p in (letters, marks) if p and p not in self.parts}
            else:
                other.append(word)
        self._encode_parts(list(need))
        self.words.update((word, self.parts[a] + self.parts[b] if b else self.parts[a]) for word, (a, b) in plain.items())
        self.words.update(zip(other, self._encode([w.decode() for w in other]), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 1000):
            some = texts[i : i + 1000]
            strings = [text.decode("utf-8", "replace") for text in some] if self.cuts else []
            usual = [not ("<|" in string or _UNUSUAL.search(string)) for string in strings] or [False] * len(some)
            by_piece = iter(self._by_piece([s for s, u in zip(strings, usual, strict=False) if u]))
            by_word = iter(self._by_word([t for t, u in zip(some, usual, strict=True) if not u]))
            out += [next(by_piece if u else by_word) for u in usual]
        return out

    def _cut(self, words: list[str], whole: np.ndarray) -> tuple[list[str], set[str]]:
        """(pieces, new ones) of the words that are not whole pieces met before; a space follows each word."""
        others = [word for word, one in zip(words, whole.tolist(), strict=True) if not one]
        pieces = _CUT.findall(" ".join([*others, ""]))
        return pieces, set(pieces).difference(self.parts, " ")

    def _by_piece(self, strings: list[str]) -> list[bytes]:
        """Each distinct word is looked up once: as a piece, else as the pieces that it is cut into."""
        if not strings:
            return []
        words = pc.ascii_split_whitespace(pa.array([string.lower() for string in strings], pa.large_string()))
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = np.fromiter(map(self.parts.__contains__, distinct), bool, len(distinct))
        pieces, new = self._cut(distinct, whole)
        if len(self.parts) + len(new) > WORD_CACHE:
            self.words.clear()
            self.parts.clear()
            whole[:] = False
            pieces, new = self._cut(distinct, whole)
        self._encode_parts(list(new), cut=True)
        # The ids of the distinct words one after the other, those that are cut first, and from there those of all words.
        known = [self.parts[word] for word, one in zip(distinct, whole.tolist(), strict=True) if one]
        self.parts[" "] = b""
        codes = [*map(self.parts.__getitem__, pieces), *known]
        table = np.frombuffer(b"".join(codes), "<u2")
        after = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) // 2)
        ends = after[[*(i for i, piece in enumerate(pieces) if piece == " "), *range(len(pieces), len(codes))]]
        sizes, first = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        order = np.argsort(whole, kind="stable")
        sizes[order] = np.diff(ends, prepend=0)
        first[order] = ends - sizes[order]
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.append(0, np.cumsum(counts))
        ids = table[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], counts)]
        bounds = ends[words.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        out = []
        if texts:
            parted = [text.split() for text in texts]
            distinct = {word for words in parted for word in words}
            new = distinct - self.words.keys()
            if len(self.words) + len(new) > WORD_CACHE:
                self.words.clear()
                self.parts.clear()
                new = distinct
            if new:
                self._learn(new)
            out += [b"".join(map(self.words.__getitem__, words)) for words in parted]
        return out
