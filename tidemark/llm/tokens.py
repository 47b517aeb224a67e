"""Token ids of whole texts by a public tokenizer file, fast for tokenizers that drop blanks.

A tokenizer that cuts at blanks and drops them gives a text the ids of its blank-separated
chunks in order. Chunks repeat: each batch works on its different chunks only. Chunks of printable
Latin text without apostrophes are lowered and cut into words, digits and runs of marks as the
file's pattern does; each worker keeps the ids of the pieces it has met, in a memory of bounded
size, and new pieces go through the tokenizer many at a time. Other chunks go through it as they
are. Whether a file is of this kind is probed once; other files encode whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT_FILE = "word_bpe_49k.json"
#: Pieces and ids that a worker keeps.
KEEP_PIECES = 700_000
KEEP_IDS = 6_000_000
_END = "</w>"
_TOGETHER = 1000
#: The pattern whose cuts ``_CUT`` reproduces on chunks that ``_OTHER`` does not match.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OTHER = "[^!-&(-~¡-¬®-įı-ɏ]|<\\|"
_CUT = r"(\p{N}|[^\p{L}\p{N}]+)"


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            settings = json.load(file)
        steps = [x["type"] for x in (settings.get("normalizer") or {}).get("normalizers", ())]
        cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("behavior") == "Removed"
            and bool(cuts[0].get("invert")) and cuts[0]["pattern"].get("Regex") == _PATTERN
            and settings["model"].get("end_of_word_suffix") == _END)
        self.by_chunk = self._drops_blanks()
        if self.by_piece:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in settings["model"]["vocab"].items() if t.endswith(_END)]] = True
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _drops_blanks(self) -> bool:
        parts = ["Ab", "cd,", "it's", "12", "<x>", "é"]
        alone = [i for ids in self._ids(parts) for i in ids]
        return self._ids(["\n "]) == [[]] and all(
            ids == alone for ids in self._ids([sep.join(parts) for sep in (" ", "\n", "  \n ")]))

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.count = np.zeros(1, np.int64)

    def _learn(self, new: list[str], single: bool) -> None:
        """Keep the ids of new pieces; ``single`` ones are one word to the tokenizer each."""
        counts, found = [], []
        for at in range(0, len(new), _TOGETHER):
            group = new[at:at + _TOGETHER]
            together = np.array(self._ids([" ".join(group)])[0] if single else [], np.uint32)
            stops = np.flatnonzero(self.ends[together]) + 1 if single else together
            if len(stops) == len(group):
                counts.append(np.diff(stops, prepend=0))
                found.append(together)
            else:
                each = self._ids(group)
                counts.append(np.array([len(x) for x in each]))
                found.append(np.array([i for x in each for i in x], np.uint32))
        count = np.concatenate(counts).astype(np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.known.update(zip(new, range(len(self.first), len(self.first) + len(new))))
        self.ids = np.concatenate([self.ids, *found])
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])

    def _numbers(self, texts: pa.Array, single: bool) -> np.ndarray:
        """Places of texts in the memory, after learning the new ones."""
        texts = texts.to_pylist()
        new = [t for t in texts if t not in self.known]
        if new:
            self._learn(new, single)
        return np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different chunks, and their number by chunk."""
        if not self.by_piece:
            place = self._numbers(chunks, False)
            count = self.count[place]
            return self.ids[_spread(self.first[place], count)], count
        other = pc.match_substring_regex(chunks, _OTHER)
        lowered = pc.utf8_lower(pc.if_else(other, "", chunks))
        lists = pc.split_pattern(pc.replace_substring_regex(lowered, _CUT, r" \1 "), " ")
        coded = lists.values.dictionary_encode()
        place = self._numbers(coded.dictionary, True)[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        whole = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        if len(whole):
            # Such a chunk has one empty piece by now: the whole chunk takes its place.
            place[np.searchsorted(owner, whole)] = self._numbers(chunks.take(pa.array(whole)), False)
        count = self.count[place]
        return self.ids[_spread(self.first[place], count)], np.bincount(
            owner, count, minlength=len(lists)).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and the offset of each row's first id (rows + 1)."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_chunk:
            found = self._ids(column.to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.array([i for x in found for i in x], np.uint32), offsets
        if len(self.known) > KEEP_PIECES or len(self.ids) > KEEP_IDS:
            self._clear()
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        rows = np.asarray(lists.offsets)
        words = lists.values.slice(rows[0], rows[-1] - rows[0]).dictionary_encode()
        ids, count = self._of_chunks(words.dictionary)
        first = np.cumsum(count) - count
        place = words.indices.to_numpy()
        count = count[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids[_spread(first[place], count)], ends[rows - rows[0]]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of runs: ``count`` from each ``first`` on."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - count), count) + np.arange(total)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_FILE)
