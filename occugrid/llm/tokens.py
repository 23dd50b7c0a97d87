"""Token ids of texts inside tasks."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: The pattern of the vocabulary gives up on blanks of very great length, so such runs are cut
#: out first. White space as Unicode has it, a fixed set of characters.
_LONG_BLANK = re.compile(
    "[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}"
)

#: The one added token of the vocabulary. Its string is cut out before the pattern is applied.
END_OF_TEXT, END_OF_TEXT_STRING = 50256, "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Byte-level BPE over a file of ranks; read once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@functools.lru_cache(maxsize=2)
def sentence_tables(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every id: does it end a sentence, begin with a blank, end with a line feed."""
    enc = encoder(vocabulary)
    size = max(enc.n_vocab, END_OF_TEXT + 1)
    ends, blank, feed = (np.zeros(size, bool) for _ in range(3))
    for token in range(size):
        try:
            raw = enc.decode_single_token_bytes(token)
        except KeyError:
            continue
        ends[token] = raw[-1:] in (b".", b"!", b"?")
        blank[token] = raw[:1] in (b" ", b"\n", b"\t", b"\r")
        feed[token] = raw[-1:] == b"\n"
    return ends, blank, feed


def encode(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; strings of special tokens are ordinary text.

    A run of blanks is one piece, but for its last one if text follows, which opens the next
    piece; so a long run can be encoded apart without changing any id.
    """
    enc = encoder(vocabulary)
    ids: list[int] = []
    at = 0
    for run in _LONG_BLANK.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._core_bpe.encode_single_piece(text[run.start() : stop].encode())
        at = stop
    ids += enc.encode_ordinary(text[at:])
    return np.array(ids, np.uint32)


def encode_with_added(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a text as by ``encode``, but each string of the added token is that token."""
    if END_OF_TEXT_STRING not in text:
        return encode(text, vocabulary)
    parts = text.split(END_OF_TEXT_STRING)
    between = np.array([END_OF_TEXT], np.uint32)
    out = [encode(parts[0], vocabulary)]
    for part in parts[1:]:
        out += [between, encode(part, vocabulary)]
    return np.concatenate(out)


def decode(ids: np.ndarray, vocabulary: str) -> str:
    return encoder(vocabulary).decode(ids.tolist())
