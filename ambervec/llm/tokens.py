"""Token ids and token counts by public vocabulary files, made to run fast on
large corpora without changing a single id."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

_SIMPLE = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")
_ALL_SIMPLE = re.compile("(?:[a-zß-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+)*")


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """Ids of a `tokenizers` file, with a bounded cache per white-space chunk.

    Where the file's normaliser and splitter are the ones for which the chunks
    are independent of each other (NFC, runs of white space to one, lower case;
    pieces that never hold white space), a text's ids are those of its chunks in
    order. Chunks of Latin-1 letters and marks go straight to the file's BPE
    model, all other chunks through the whole tokenizer. Any other file encodes
    whole texts.
    """

    MAX_CACHE = 700_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = (
            norm == ["NFC", "Replace", "Lowercase"]
            and split[0].get("pattern", {}).get("Regex") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
            and split[0].get("behavior") == "Removed"
            and [p.get("type") for p in split[1:]] == ["ByteLevel"]
            and not split[1].get("add_prefix_space")
            and all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        )
        self.model = self.full.model
        self.chars = _byte_chars()
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            word = piece if piece.isascii() else "".join(self.chars[b] for b in piece.encode())
            got = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            if len(self.pieces) >= self.MAX_CACHE:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        low = text.lower()
        if "<|" not in text and _ALL_SIMPLE.fullmatch(low):
            got = b"".join([self._piece(p) for p in _SIMPLE.findall(low)])
        else:
            got = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) >= self.MAX_CACHE:
            self.chunks.clear()
        self.chunks[chunk] = got
        return got

    def ids(self, text: bytes) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_chunk:
            return np.array(self.full.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        get, slow = self.chunks.get, self._chunk
        chunks = text.split()
        out = [get(c) for c in chunks]
        if None in out:
            out = [x if x is not None else (get(c) or slow(c)) for x, c in zip(out, chunks)]
        return b"".join(out)


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class PieceCounts:
    """Token counts of a sentencepiece model for whole texts.

    A long text is encoded in overlapping chunks;
    neighbouring chunks are spliced at a boundary that both encodings have and
    that no piece of the vocabulary can cross. A chunk pair without such a
    boundary in its overlap is encoded again with the overlap doubled, until the
    text ends. A boundary is proven for a model if none of its pieces holds a
    space after another character: then a space that follows one starts a piece
    in every encoding, whatever stands before it, so the parts on either side
    are encoded alike alone and together. The same holds on both sides of a
    character that occurs in no piece but itself (line ends in such models).
    Other texts are cut at the same proven boundaries into single words, whose
    counts are kept in a bounded cache; texts with runs of spaces are encoded
    whole.
    """

    MAX_CACHE = 700_000

    def __init__(self, path: str, chunk: int = 8192, overlap: int = 128):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.sp.get_piece_size()
        width, inner = np.zeros(n, np.int64), set()
        self.proven = True
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                width[i] = not 0x80 <= int(piece[3:5], 16) < 0xC0
            elif self.sp.is_control(i):
                width[i] = 0
            else:
                width[i] = len(piece)
                if not self.sp.is_unknown(i):
                    inner.update(piece)
                    self.proven &= "▁" not in piece.lstrip("▁")
        self.width = width
        # the model must keep texts as they are: then widths add up to the text
        probe = "a  b\n\té ﬁ Ａ́ x "
        self.plain = int(width[self.sp.encode(probe)].sum()) == len(probe) + 1
        self.line_alone = "\n" not in inner
        self.by_word = self.proven and self.plain and self.line_alone and len(self.sp.encode("\n")) == 2
        self.words: dict[str, int] = {}

    def boundary(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Proven boundaries in text[lo:hi]: positions p between p-1 and p."""
        part = text[max(lo - 1, 0) : hi]
        base = max(lo - 1, 0)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (code == 0x20) | (code == 0x2581)
        ok = ~space[:-1] & (code[1:] == 0x20)
        if self.line_alone:
            ok |= (code[:-1] == 0x0A) | (code[1:] == 0x0A)
        return np.flatnonzero(ok) + 1 + base

    def _cuts(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Ends of the tokens of text[lo:hi], as positions in text."""
        ids = np.array(self.sp.encode(text[lo:hi]), np.int64)
        return np.cumsum(self.width[ids]) - 1 + lo  # -1: the space put in front

    def _long(self, text: str) -> int:
        n, lo, total, start = len(text), 0, 0, 0
        hi = min(n, self.chunk)
        left = self._cuts(text, 0, hi)
        while hi < n:
            overlap = self.overlap
            while True:
                nxt_lo = max(hi - overlap, start + 1)
                nxt_hi = min(n, nxt_lo + max(self.chunk, 2 * overlap))
                right = self._cuts(text, nxt_lo, nxt_hi)
                both = np.intersect1d(left, right)
                # the chunk's own first character may have merged with the space put in front
                both = both[(both > nxt_lo) & (both < hi)]
                good = np.intersect1d(both, self.boundary(text, nxt_lo + 1, hi))
                if len(good):
                    break
                if nxt_lo == start + 1 or overlap > n:
                    # no proven boundary in the whole chunk: read the left chunk on
                    hi = min(n, hi + max(self.chunk, hi - lo))
                    left = self._cuts(text, lo, hi)
                    if hi == n:
                        return total + int((left > start).sum() if start else len(left))
                    overlap = self.overlap
                    continue
                overlap *= 2
            p = int(good[len(good) // 2])
            # tokens of the left chunk that end in (start, p]
            total += int(((left > start) & (left <= p)).sum()) if start else int((left <= p).sum())
            start, lo, hi, left = p, nxt_lo, nxt_hi, right
        return total + int((left > start).sum() if start else len(left))

    def _learn(self, new: list[str]) -> None:
        """Counts of words (each with the space or line end before it), encoded in one go."""
        if len(self.words) + len(new) > self.MAX_CACHE:
            self.words.clear()
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            joined = "".join(part)
            lead = joined[:1] != " "  # else the space put in front is the word's own
            cuts = self._cuts(joined if lead else joined[1:], 0, len(joined)) + (not lead)
            n = np.diff(np.searchsorted(cuts, np.cumsum([len(u) for u in part]), "right"), prepend=0)
            n[0] -= lead  # the token of the space put in front
            self.words.update(zip(part, n.tolist()))

    def count(self, texts: list[str]) -> list[int]:
        out, whole, cut = [0] * len(texts), [], {}
        for k, t in enumerate(texts):
            if self.proven and self.plain and len(t) > 2 * self.chunk:
                out[k] = self._long(t)
            elif t:
                units = t.replace("\n", " \n").split(" ") if self.by_word and "▁" not in t else [""]
                # the text's first word gets the space that the model puts in front
                if "" in units:
                    whole.append(k)
                else:
                    cut[k] = [" " + u if u[0] != "\n" else u for u in units]
        if cut:
            known = self.words
            new = list({u for units in cut.values() for u in units if u not in known})
            if new:
                self._learn(new)
            for k, units in cut.items():
                try:
                    out[k] = sum([known[u] for u in units])
                except KeyError:  # the cache was cleared meanwhile
                    whole.append(k)
        for k, ids in zip(whole, self.sp.encode([texts[k] for k in whole], num_threads=1)):
            out[k] = len(ids)
        return out


@lru_cache(4)
def piece_counts(path: str, chunk: int = 8192, overlap: int = 128) -> PieceCounts:
    return PieceCounts(path, chunk, overlap)
