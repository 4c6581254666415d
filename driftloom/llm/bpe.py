"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. For any prefix of a word there is one last token that a merge-by-rank encoder can leave there: a token whose
neighbour before it, itself the last token of a shorter prefix, would not be merged into it or with a part of it. The
transducer keeps that last token for the prefixes of a short window only. Tokens on which all live prefixes agree can no
longer change, whatever follows, and are emitted; ``lookahead`` is computed from the merge list (the longest chain of
merges of falling rank, each able to take a part from the one before it) and says when it is worth looking for them.
So a word of any length passes in constant memory. White space ends every pre-token; the encoding of a
run without white space is remembered in a table of bounded size.

Decoding is a state machine that takes ids one after another: with the file's decoder (none) it joins token strings by
spaces, as the tokenizers library does; ``TextMachine`` turns the same ids back to text, holding at most the bytes of
one unfinished character.

Defined results: a null id passes; ties don't arise (merges are ranked); a very long text is encoded in pieces, only a run without white
space is held as a whole; null counts as empty; an empty text has no ids and decodes to an empty text; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import tidy

END = "</w>"
#: Entries of the tables of remembered runs and pairs; a full table is emptied.
REMEMBERED = 200_000
#: Characters of a text that are taken at once.
PIECE = 1 << 16


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Codec:
    """A tokenizer file of the kind ``word_bpe``: byte-level symbols, merges by rank, and a suffix for word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(size, "", object)
        for table in (self.vocab, self.special):
            for token, i in table.items():
                self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        symbols = byte_symbols()
        self.to_symbols = {b: s for b, s in enumerate(symbols)}
        made = {a + b for a, b in pairs}
        base = {s for s in symbols} | {s + END for s in symbols}
        # only what merges can make may be a token of a text
        # (a table of each onto itself, so that what is remembered shares these strings)
        self.usable = {t: t for t in self.vocab if t in made or t in base}
        self.longest = max(len(t.removesuffix(END)) for t in self.usable)
        self.tails = {t[i:] for t in self.usable for i in range(len(t.removesuffix(END)))}
        self.lookahead = self._lookahead(pairs)
        self.room = self.lookahead + 2 * self.longest
        self.span = {t: len(t.removesuffix(END)) for t in self.usable}
        self.raw = {t: self.vocab[t].to_bytes(4, "little") for t in self.usable}
        self._fits: dict[tuple[str, str], bool] = {}
        self._runs: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._shown = {b: s for b, s in enumerate(symbols)}

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols after a merge that may still decide on it.

        A merge (a, b) is undone only if a merge of lower rank takes the right end of b away with what follows. Those are
        merges whose left part ends b; their own lookahead adds to the length of their right part.
        """
        best: dict[str, int] = {}
        right: dict[str, str] = {}
        most = 0
        for a, b in pairs:
            need, part = 0, b
            while part:
                need = max(need, best.get(part, 0))
                part = right.get(part, "")
            need += len(b.removesuffix(END))
            best[a] = max(best.get(a, 0), need)
            right.setdefault(a + b, b)
            most = max(most, need)
        return most + self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first, until none is left; for short sequences."""
        while len(symbols) > 1:
            rank, pair = min((self.ranks.get(p, 1 << 60), p) for p in zip(symbols, symbols[1:], strict=False))
            if rank == 1 << 60:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _split(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        out = list(body)
        if len(body) < len(token):
            out[-1] += END
        return out

    def fits(self, left: str, right: str) -> bool:
        """May the two tokens stand side by side?"""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(self._split(left) + self._split(right)) == [left, right]
        return known

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one word, given symbol by symbol: the transducer, in a window that doesn't grow with the word."""
        tokens, before = [""], ""  # tokens[i]: the last token of the first i symbols of the window; before: the token before the window
        source = iter(symbols)
        window, ahead = "".join(itertools.islice(source, self.room)), next(source, None)
        while ahead is not None:
            self._extend(window, tokens, before, False)
            stable = self._agreed(tokens)
            if stable:
                out = self._path(tokens, stable)
                yield from out
                before, window, tokens = out[-1], window[stable:], ["", *tokens[stable + 1 :]]
            window += ahead + "".join(itertools.islice(source, self.lookahead))
            ahead = next(source, None)
        self._extend(window, tokens, before, True)
        yield from self._path(tokens, len(window))

    def _extend(self, window: str, tokens: list[str], before: str, ends: bool) -> None:
        """The transducer's steps: the last token of each prefix of the window that has none yet."""
        tails, usable, known, n = self.tails, self.usable.get, self._fits.get, len(window)
        for j in range(len(tokens), n + 1):
            end = END if ends and j == n else ""
            last = ""  # no way to end a token here
            for i in range(j - 1, -1, -1):
                piece = window[i:j] + end
                if piece not in tails:
                    break
                token = usable(piece)
                if token:
                    left = tokens[i] if i else before
                    if left:
                        fit = known((left, token))
                        if self.fits(left, token) if fit is None else fit:
                            last = token
                            break
                    elif not i:
                        last = token
                        break
            tokens.append(last)

    def _agreed(self, tokens: list[str]) -> int:
        """The last place that lies on the paths of all live prefixes."""
        live = {i for i in range(max(1, len(tokens) - self.longest), len(tokens)) if tokens[i]}
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            live.add(i - self.span[tokens[i]])
        return live.pop() if live else 0

    def _path(self, tokens: list[str], i: int) -> list[str]:
        out, span = [], self.span
        while i > 0:
            token = tokens[i]
            out.append(token)
            i -= span[token]
        out.reverse()
        return out

    def word_ids(self, word: str) -> bytes:
        """The ids of one pre-token."""
        shown = word.encode().decode("latin-1").translate(self._shown)
        if len(shown) > self.room:
            return b"".join([self.raw[t] for t in self.stream(shown)])
        tokens = [""]  # the window holds the word as a whole
        self._extend(shown, tokens, "", True)
        out = b"".join([self.raw[t] for t in self._path(tokens, len(shown))])
        if len(shown) <= 64:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            self._words[word] = out
        return out

    def run_ids(self, run: str) -> bytes:
        """The ids, as little-endian 32-bit integers, of normalised text without white space."""
        known = self._runs.get(run)
        if known is None:
            get, new = self._words.get, self.word_ids
            words = self.words.findall(run)
            if words == [run]:
                words = [run]  # one string and one value for both tables
            known = b"".join([x if (x := get(w)) is not None else new(w) for w in words])
            if len(run) <= 64:
                if len(self._runs) >= REMEMBERED:
                    self._runs.clear()
                self._runs[run] = known
        return known

    def _plain(self, text: str) -> Iterator[bytes]:
        for piece in _cut(text):
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ").lower()
            else:
                piece = piece.lower()
            if any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # Python splits at these, the tokenizer doesn't
                parts = [p for p in regex.split(r"\p{White_Space}+", piece) if p]
            else:
                parts = piece.split()
            get, new = self._runs.get, self.run_ids
            yield b"".join([x if (x := get(p)) is not None else new(p) for p in parts])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_parts(text or ""))

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """The same, part by part."""
        at = 0
        if self.specials is not None and any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield np.array([self.special[m[0]]], "<u4").tobytes()
                at = m.end()
        yield from self._plain(text[at:] if at else text)


def _cut(text: str) -> Iterator[str]:
    """Pieces of a text that end at white space before a letter or digit of any script, where nothing crosses."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not (text[end - 1] in " \n\t" and text[end].isalnum()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class JoinMachine:
    """Decoding without a decoder: token strings joined by spaces, part by part."""

    def __init__(self, codec: Codec):
        self.codec, self.begun = codec, False

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        out = " ".join(self.codec.tokens[ids].tolist())
        out, self.begun = (" " + out if self.begun else out), True
        return out


class TextMachine:
    """Decoding to text: bytes of token after token through an incremental UTF-8 decoder; word ends become spaces."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.back = {s: b for b, s in codec.to_symbols.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.gap = ""

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            token = self.codec.tokens[int(i)]
            if self.gap:
                out.append(self.gap)
                self.gap = ""
            body = token.removesuffix(END)
            out.append(self.state.decode(bytes(self.back[c] for c in body)) if token not in self.codec.special else token)
            if body != token:
                out.append(self.state.decode(b"", True))
                self.state.reset()
                self.gap = " "
        return "".join(out)

    def close(self) -> str:
        return self.state.decode(b"", True)


@functools.cache
def shared_codec(path: str) -> Codec:
    """One codec for all tasks of a worker, with what it remembers."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ``keep`` may add ``ids`` (little-endian 32-bit integers) and ``decoded``."""
    kept = "".join(f", {c} {'binary' if c == 'ids' else 'string'}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in batches:
            counts, shas, back, ids, decoded = [], [], [], [], []
            texts = batch.column(1)
            for k in range(batch.num_rows):
                n, sha, other, machine, raw, words = 0, hashlib.sha256(), hashlib.sha256(), JoinMachine(codec), [], []
                for part in codec.encode_parts(texts[k].as_py() or ""):
                    n += len(part) // 4
                    sha.update(part)
                    text = machine.feed(np.frombuffer(part, "<u4"))
                    other.update(text.encode())
                    if "ids" in keep:
                        raw.append(part)
                    if "decoded" in keep:
                        words.append(text)
                counts.append(n)
                shas.append(sha.hexdigest())
                back.append(other.hexdigest())
                if keep:
                    ids.append(b"".join(raw))
                    decoded.append("".join(words))
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            cols |= {c: pa.array(ids, pa.binary()) if c == "ids" else pa.array(decoded, pa.string()) for c in keep}
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + kept)
