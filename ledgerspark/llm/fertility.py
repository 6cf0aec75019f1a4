"""Quality rules by tokeniser fertility, on top of word-based base rules.

Two public vocabularies are applied to each word: characters per token come from a byte-level BPE,
byte-fallback share and token entropy from a piece BPE with byte fallback. A text is rejected where one
of them leaves the band of its main script (or of its language, if bands are given for languages).
"""

from __future__ import annotations

import base64
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Recent, resident

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of measured words that a worker remembers at most.
WORDS_BYTES = 48 << 20

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 0.2, 5


@dataclass(frozen=True)
class Band:
    """Rejection bounds. entropy scales the floors below, in bits per token, for the text's token count."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float = 1.0


#: Fewest bits of token entropy by the binary logarithm of the token count, linear in between.
ENTROPY_FLOOR = ([3, 5, 6, 7, 8, 9, 10, 12], [1.5, 4.0, 4.8, 5.4, 5.75, 6.1, 6.25, 6.4])


# Code point ranges of scripts, and the bands of each.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
BANDS = {
    "latin": Band((1.2, 9.0), 0.15),
    "greek": Band((0.4, 6.0), 0.5, 0.9),
    "cyrillic": Band((0.4, 7.0), 0.3, 0.9),
    "hebrew": Band((0.3, 6.0), 0.9, 0.7),
    "arabic": Band((0.3, 6.0), 0.9, 0.7),
    "indic": Band((0.2, 6.0), 0.98, 0.6),
    "thai": Band((0.2, 6.0), 0.98, 0.6),
    "kana": Band((0.2, 6.0), 0.8, 0.8),
    "han": Band((0.2, 6.0), 0.8, 0.8),
    "hangul": Band((0.2, 6.0), 0.9, 0.7),
    "none": Band((0.8, 9.0), 0.5, 0.6),
}


class Measure:
    """Token counts of words under both vocabularies, remembered by word."""

    def __init__(self, byte_bpe: str, piece_bpe: str, words_bytes: int = WORDS_BYTES):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        self.begins_piece = np.array([self.pieces.IdToPiece(i).startswith("\u2581") for i in range(self.pieces.GetPieceSize())])
        self.begins_token = np.zeros(max(ranks.values()) + 1, bool)
        self.begins_token[[n for token, n in ranks.items() if token.startswith(b" ")]] = True
        self.words = Recent(words_bytes)

    def _learn(self, words: list[bytes]) -> None:
        """Measure new words, many in one call: both vocabularies mark where a word begins."""
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            text = b" ".join(some).decode()
            pieces, tokens = np.array(self.pieces.encode(text), "<u2"), np.array(self.bpe.encode_ordinary(" " + text), np.int64)
            starts, cuts = np.flatnonzero(self.begins_piece[pieces]), np.flatnonzero(self.begins_token[tokens])
            if len(starts) == len(some) == len(cuts):
                raw, ends = pieces.tobytes(), [*starts[1:].tolist(), len(pieces)]
                counts = np.diff([*cuts.tolist(), len(tokens)]).tolist()
                for w, n, i, j in zip(some, counts, starts.tolist(), ends, strict=True):
                    self.words.put(w, n.to_bytes(4, "little") + raw[2 * i : 2 * j])
                continue
            for w in some:  # a word that a vocabulary's normaliser splits or drops
                t = w.decode()
                self.words.put(w, len(self.bpe.encode_ordinary(" " + t)).to_bytes(4, "little") + np.array(self.pieces.encode(t), "<u2").tobytes())

    def prepare(self, texts: list[list[bytes]]) -> None:
        """Measure the new words of several texts together."""
        new = self.words.unknown(set().union(*texts))
        if new:
            self._learn(new)

    def of(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        """(byte-BPE tokens, piece ids) of all words together; prepare() has seen them."""
        got = list(map(self.words.now.__getitem__, words))
        flat = np.frombuffer(b"".join(got), "<u2")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 2
        at = np.cumsum(size) - size  # a word's number of byte-BPE tokens takes two places, then come its pieces
        pieces = np.ones(len(flat), bool)
        pieces[at] = pieces[at + 1] = False
        return int(flat[at].sum(dtype=np.int64)) + (int(flat[at + 1].sum(dtype=np.int64)) << 16), flat[pieces]


def _measure(byte_bpe: str, piece_bpe: str) -> Measure:
    return resident(("fertility", byte_bpe, piece_bpe), lambda: Measure(byte_bpe, piece_bpe))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = code * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(31)))
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    grams = [tuple(words[i : i + window]) for i in at]  # equal hashes are checked as words
    counts = Counter(grams)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, g in zip(at, grams, strict=True):
        if counts[g] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


_NOT_LETTERS = bytes(c for c in range(256) if not chr(c).isalpha() or c > 127)


def script_of(raw: bytes) -> str:
    """The script of most letters of a text, "none" if it has no letters of a known script."""
    if 2 * len(raw.translate(None, _NOT_LETTERS)) > len(raw):
        return "latin"
    codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    best, most = "none", 0
    for name, low, high in SCRIPTS:
        inside = (codes >= low) & (codes <= high)
        if name == "latin":
            inside &= ~((codes > 0x5A) & (codes < 0x61)) & ~((codes > 0x7A) & (codes < 0xC0))
        n = int(inside.sum())
        if n > most:
            best, most = name, n
        if 2 * most > len(codes):
            break
    return best


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text and its words."""
    joined = b"".join(words)
    chars = len(joined) - int(((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80).sum())
    symbols = sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("script", T.StringType()), ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType())]


def judge(raw: bytes, words: list[bytes], measure: Measure, bands: dict[str, Band], lang: str | None = None) -> tuple:
    chars, symbols, dup_lines, repeat = base_counts(raw, words)
    failed = len(words) < MIN_WORDS or repeat > MAX_REPEATED * len(words)
    script = script_of(raw)
    per_token = byte_share = entropy = None
    inside = True
    if words:
        n, pieces = measure.of(words)
        counts = np.bincount(pieces)
        counts = counts[counts > 0]
        p = counts / len(pieces)
        per_token = chars / n
        byte_share = float(measure.is_byte[pieces].mean())
        entropy = float(-(p * np.log2(p)).sum())
        band = bands.get(lang) if lang in bands else bands.get(script, bands["none"])
        inside = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and byte_share <= band.byte_share and entropy >= band.entropy * np.interp(np.log2(len(pieces)), *ENTROPY_FLOOR)
    return len(words), chars, symbols, dup_lines, repeat, failed, bool(not failed and inside), script, per_token, byte_share, entropy


def rate(docs: DataFrame, bands: dict[str, Band] | None = None, lang_column: str | None = None, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, only_kept: bool = False) -> DataFrame:
    """docs(doc_id, text) with the base counts, base_failed, kept and the three measures; with only_kept
    the kept rows of docs in docs' own columns instead.

    bands are by script; with lang_column also by that column's values, which go first. Null text: no
    words. Texts without words have null measures and are base_failed. Null doc_id, repeated rows: judged
    row by row. Empty table: no rows.
    """
    bands = bands or BANDS
    source = docs if only_kept else docs.select("doc_id", "text", *([lang_column] if lang_column else []))
    schema = docs.schema if only_kept else T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in COLUMNS)])

    def run(batches):
        measure = _measure(byte_bpe, piece_bpe)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                raws = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                words = [t.split() for t in raws]
                measure.prepare(words)
                langs = part.column(lang_column).to_pylist() if lang_column else [None] * part.num_rows
                rows = [judge(t, w, measure, bands, g) for t, w, g in zip(raws, words, langs, strict=True)]
                if only_kept:
                    yield part.filter(pa.array([r[6] for r in rows]))
                else:
                    kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), COLUMNS, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
