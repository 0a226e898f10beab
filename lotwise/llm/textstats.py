"""Exact per-document text statistics over Arrow batches (numpy inside Spark tasks).

A batch is handled as one byte buffer, so the cost is a few vector passes per
byte and a few hash look-ups per word; nothing outlives the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: ASCII white space, the symbols that count as noise.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Bytes of text that one vector pass holds at most (a longer text is a pass of its own).
PASS_BYTES = 1_000_000


def table_of(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


_SPACE, _SYMBOL = table_of(SPACE), table_of(SYMBOLS)
_UPPER = table_of(bytes(range(65, 91)))
_LOWER = table_of(bytes(range(97, 123)))
_DIGIT = table_of(b"0123456789")
_END = table_of(b".!?")
_BANG = table_of(b"!")


def passes(texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive rows; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        last = min(last, n)
        yield row, last - row, data[at[row] : at[last]], (at[row : last + 1] - at[row])
        row = last


def pieces(data: np.ndarray, keep: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes (and how many there are) of the strings that the kept bytes form, by exact content."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = np.ascontiguousarray(data[keep])
    made = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    coded = made.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, document and exact code of each word; documents never share a word."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    codes, _ = pieces(data, word, ends - starts)
    return starts, ends, doc, codes


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def window_codes(codes: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of the windows of `size` words (equal windows, equal codes) and their first words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    code = codes.copy()
    for step in range(1, size):
        code = pd.factorize(code[: len(codes) - step] * (int(codes.max()) + 1) + codes[step:])[0].astype(np.int64)
    return code[inside], inside


def statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of one pass."""
    n = len(at) - 1
    space = _SPACE[data]
    starts, ends, doc, codes = words_of(data, at)
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_doc(~space & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_doc(_SYMBOL[data], at),
        "n_upper": per_doc(_UPPER[data], at),
        "n_lower": per_doc(_LOWER[data], at),
        "n_digit": per_doc(_DIGIT[data], at),
        "n_wide": per_doc(data >= 0xC0, at),
        "n_end": per_doc(_END[data], at),
        "n_bang": per_doc(_BANG[data], at),
    }
    # lines: a document's last line ends at the document's end
    breaks = data == 10
    stops = np.union1d(np.flatnonzero(breaks), at[1:]) if n else np.zeros(0, np.int64)
    # a break is one line's end; a document that ends in a break has an empty last line, which has no word
    line_from = np.concatenate([[0], stops[:-1] + breaks[np.minimum(stops[:-1], max(0, len(data) - 1))] * (stops[:-1] < len(data))]) if len(stops) else stops
    if len(stops):
        # where a document starts right at a break, the line before it ended with its document
        line_doc = np.searchsorted(at, np.minimum(line_from, max(0, len(data) - 1)), "right") - 1
        filled = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~space, out=filled[1:])
        has_word = filled[stops] > filled[np.minimum(line_from, stops)]
        lengths = np.maximum(stops - line_from, 0)
        line_codes, n_lines = pieces(data, ~breaks, lengths)
        real = np.flatnonzero(has_word)
        again = pd.Series(line_doc[real] * n_lines + line_codes[real]).duplicated().to_numpy()
        out["n_dup_lines"] = np.bincount(line_doc[real][again], minlength=n)
        out["n_lines"] = np.bincount(line_doc[real], minlength=n)
    else:
        out["n_dup_lines"] = out["n_lines"] = np.zeros(n, np.int64)
    grams, first = window_codes(codes, doc)
    if len(grams):
        own = pd.factorize(doc[first] * (int(grams.max()) + 1) + grams)[0]
        twice = np.bincount(own)[own] >= 2
        cover = np.zeros(len(codes), bool)
        for k in range(WINDOW):
            cover[first[twice] + k] = True
        out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(codes):
        kinds = ~pd.Series(doc * (int(codes.max()) + 1) + codes).duplicated().to_numpy()
        out["n_distinct"] = np.bincount(doc[kinds], minlength=n)
    else:
        out["n_distinct"] = np.zeros(n, np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_digit", "n_wide", "n_end", "n_bang", "n_lines", "n_distinct",
)


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """All COUNTS of a column of texts (null: an empty text)."""
    done = [statistics(data, at) for _, _, data, at in passes(texts)]
    return {k: np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in COUNTS}
