"""Whole-text encoding with the ``tokenizers`` library at the cost of its distinct chunks.

Both vocabularies split a text before any merge is looked up, and no piece of that
split crosses the borders below: an added token such as ``<|endoftext|>``, which the
library takes out first, a blank between two other signs than white space, and those of
CHUNKS. So ids of a text are the ids of its chunks put together. Texts are cut at blanks
and their distinct pieces found in Arrow, by part of PART_CHARS; only these are looked up
in Python, and what is not known yet is encoded by the library. The chunks that are kept
are bounded by their number and their bytes. The tests hold this against whole-text
encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the vocabularies' patterns (Unicode White_Space).
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-/:;=-@\[-`{-~"  # ASCII punctuation without "<", which may begin a special token
#: Runs of Latin letters, of signs (an apostrophe may begin a suffix piece) and of digits end where
#: ASCII of another kind follows; where anything else follows, a chunk is all up to white space.
RUNS = (
    rf" ?[{LATIN}]++(?![^\x00-\x7f])|(?: |(?!'))[{SIGNS}]++(?![^\t-\r\x20-;=-~])| ?[0-9]++(?![^\x00-\x7f])"
)
#: byte_bpe: one blank may lead a chunk, other white space stands alone. word_bpe: white space goes.
CHUNKS = {
    "byte_bpe_50k.json": f"{RUNS}| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+",
    "word_bpe_49k.json": f"{RUNS.replace(' ?', '').replace('(?: |', '(?:')}|[^{SPACES}]+",
}
#: What stands next to a blank that is no border of byte_bpe: longer white space.
NEAR_BLANK = "[{0}] | [{0}]".format(SPACES.encode().decode("unicode_escape"))
#: Between a Latin letter and a sign there is a border, whatever follows.
LETTER_SIGN = f"([{LATIN}])([!-/:;=-@\\[-`{{-~])"
#: Bytes of chunks (counted with 150 for the objects of each) that an encoder keeps between parts.
KEPT_BYTES = 64 << 20
#: Code points that are encoded at a time; a longer text is a part of its own.
PART_CHARS = 4_000_000


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Runs that the vocabulary's split leaves whole, so that they can go to its model at once.
WHOLE = {"byte_bpe_50k.json": f" ?[{LATIN}]+| ?[{SIGNS}]+| ?[0-9]+", "word_bpe_49k.json": f"[{LATIN}]+|[{SIGNS}]+"}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts to little-endian uint32 ids. ``kept``: bytes of chunks that stay between parts."""

    def __init__(self, name: str, path: str | None = None, kept: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_file(name))
        self.model = Tokenizer(self.tokenizer.model)  # the same without normaliser and split
        self.lower = name.startswith("word_bpe")
        self.letters = byte_letters()
        spelled = [(i, t.removesuffix("</w>") if self.lower else t) for t, i in self.tokenizer.get_vocab(True).items()]
        self.spans = np.zeros(max(i for i, _ in spelled) + 1, dtype=np.int64)
        for i, t in spelled:
            self.spans[i] = len(t)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = set(added)
        self.parts = re.compile(f"({'|'.join(map(re.escape, added))})").split if added else None
        self.marks = re.escape(added[0][:2]) if added else None  # what every added token begins with
        if added and any(t[:2] != added[0][:2] for t in added):
            self.marks = "|".join(map(re.escape, added))
        self.cut = re.compile(CHUNKS[name]).findall
        self.whole = re.compile(f"^(?:{WHOLE[name]})$", re.M).findall
        self.kept = kept
        self.held = 0
        self.ids: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; added tokens stand alone, and what is between two of them is cut by itself."""
        if text in self.added:
            return [text]
        pieces = self.parts(text) if self.parts else [text]
        return [c for p in pieces for c in ([p] if p in self.added else self.cut(p))]

    def learn(self, missing: list[str]) -> None:
        """Encodes pieces that the library's split leaves whole by its model alone, the chunks of the others in full."""
        # one line each: no such piece holds a line break
        whole = list(dict.fromkeys(self.whole("\n".join(missing))))
        if whole:
            lines = "\n".join(whole)
            spelled = (lines.lower() if self.lower else lines).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
            got, = self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            reach = np.cumsum(self.spans[ids])  # letters spelled up to each token's end
            self._put(whole, ids, np.searchsorted(reach, np.cumsum(list(map(len, spelled))), "left") + 1)
        rest = {c for p in missing if p not in self.ids for c in self.chunks(p)}
        if rest := [c for c in rest if c not in self.ids]:
            got = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            words = np.array(got.word_ids, dtype=np.int64)
            self._put(rest, np.array(got.ids, dtype="<u4"), np.searchsorted(words, np.arange(len(rest)), "right"))

    def _put(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the ids of each chunk; ``ends`` counts the tokens up to the chunk's last."""
        packed, ends = ids.tobytes(), (4 * ends).tolist()
        self.ids.update(zip(chunks, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        self.held += len(packed) + 150 * len(chunks) + sum(map(len, chunks))

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text in turn; a null counts as empty."""
        for ids, ends in self.encode_parts(texts):
            for a, b in zip([0, *ends], ends):
                yield ids[a:b].tobytes()

    def encode_parts(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The ids of some texts put together, and where each one's end, part by part in the order of ``texts``."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        reach = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PART_CHARS, "right"))
            stop = max(stop, at + 1)
            yield self._part(texts.slice(at, stop - at))
            at = stop

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in a row, and where each text's end."""
        odd = pc.match_substring(texts, "\0")
        if self.marks:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.marks))
        if not self.lower:
            odd = pc.or_(odd, pc.match_substring_regex(texts, NEAR_BLANK))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        plain = pc.replace_substring(plain, " ", "\0" if self.lower else "\0 ")
        split = pc.split_pattern(pc.replace_substring_regex(plain, LETTER_SIGN, "\\1\0\\2"), "\0")
        flat, ends = split.flatten(), np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        if not odd.any():
            return flat, ends
        # the other texts are cut in full, and stand behind
        sizes = np.diff(ends, prepend=0)
        cut = [self.chunks(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        own = np.array([len(c) for c in cut], dtype=np.int64)
        order = np.argsort(odd, kind="stable")
        flat = pa.concat_arrays([flat.filter(pa.array(np.repeat(~odd, sizes))), pa.array([c for t in cut for c in t], flat.type)])
        now = np.concatenate([sizes[~odd], own])
        begins = np.empty(len(now), dtype=np.int64)
        begins[order] = np.cumsum(now) - now
        sizes = np.empty(len(now), dtype=np.int64)
        sizes[order] = now
        ends = np.cumsum(sizes)
        return flat.take(pa.array(spread(begins, sizes))), ends

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        flat, ends = self._pieces(texts)
        named = flat.dictionary_encode()
        del flat
        found = self._known(named.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        every = np.frombuffer(b"".join(found), dtype="<u4")
        begins = np.cumsum(sizes) - sizes
        which = named.indices.to_numpy(zero_copy_only=False)
        ids = every[spread(begins[which], sizes[which])]
        reach = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, reach[ends].tolist()

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from its chunks."""
        if self.held > self.kept:
            # what was met first is met most: half stays
            self.ids = dict(islice(self.ids.items(), len(self.ids) // 2))
            self.held = sum(map(len, self.ids.values())) + sum(map(len, self.ids)) + 150 * len(self.ids)
        found = list(map(self.ids.get, pieces))
        if missing := [p for p, ids in zip(pieces, found) if ids is None]:
            self.learn(missing)
            found = list(map(self.ids.get, pieces))
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = b"".join([self.ids[c] for c in self.chunks(pieces[i])])
        return found


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, in a row."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and begins.max(initial=0) < 1 << 30 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((begins - (ends - sizes)).astype(kind), sizes)


def release() -> None:
    """Drops this worker's encoders, for a job whose later stages need the memory."""
    import ctypes
    import gc

    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


@cache
def encoder(name: str, path: str | None = None) -> ChunkEncoder:
    """One encoder per Python worker."""
    return ChunkEncoder(name, path)
