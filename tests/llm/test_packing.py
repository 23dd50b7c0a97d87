import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import NASTY
from tokenizers import Tokenizer

from occugrid.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, wanted):
    """Every token in exactly one piece, sequences gapless and of at most 1024 tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    got = {
        key: b"".join(bytes(p["ids"]) for p in sorted(found, key=lambda p: p["start"]))
        for key, found in by_doc.items()
    }
    assert got == {key: np.array(ids, "<u4").tobytes() for key, ids in wanted.items()}
    for p in pieces:
        assert p["doc_tokens"] == len(wanted[p["id"]])
        assert len(p["ids"]) == 4 * p["length"] > 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return {k: sum(p["length"] for p in v) for k, v in by_sequence.items()}


def test_pieces_are_the_tokens(documents, rows, tokenizer):
    pieces = packing.pack(documents, block=4096).collect()
    filled = check(pieces, {i: ids_of(tokenizer, text) for i, text, _ in rows})
    last = {}
    for sequence, n in filled.items():
        last[sequence >> 40] = max(last.get(sequence >> 40, 0), sequence)
    inner = [1024 - n for s, n in filled.items() if s != last[s >> 40]]
    assert sum(inner) < 0.01 * sum(filled.values())


def test_digest_is_the_checksum_of_the_tokens(documents, rows, tokenizer):
    digests = packing.digests(packing.pack(documents)).collect()
    texts = {i: text for i, text, _ in rows}
    for d in digests[:300]:
        ids = ids_of(tokenizer, texts[d["doc_id"]])[d["start"] : d["start"] + d["length"]]
        assert d["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_order_is_kept(documents):
    pieces = packing.pack(documents).collect()
    place = [(p["sequence_id"], p["offset"]) for p in sorted(pieces, key=lambda p: (p["id"], p["start"]))]
    assert place == sorted(place)


def test_awkward_rows(nasty, empty, make_docs, tokenizer):
    assert packing.pack(empty).count() == 0
    distinct = {}
    for i, text, source in NASTY:
        distinct.setdefault(i, (i, text, source))
    pieces = packing.pack(make_docs(list(distinct.values()))).collect()
    check(pieces, {i: ids_of(tokenizer, text) for i, text, _ in distinct.values()})
    total = sum(len(ids_of(tokenizer, text)) for _, text, _ in NASTY)
    assert sum(p["length"] for p in packing.pack(nasty).collect()) == total


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    vocabulary = tokens.default_vocabulary()
    blanks = [" " * 5000, "a" + " \n" * 3000 + "b", "x." + "\t" * 2500, "\u3000" * 2100 + " 5"]
    plain = ["", "a  b\n\n c\t", "I'll we've 123 3.14", "é　ß<|endoftext|>", "\x1c\x1f a"]
    for text in plain + blanks:
        assert tokens.encode(text, vocabulary).tolist() == ids_of(tokenizer, text)[:-1]


def test_very_long_runs():
    vocabulary = tokens.default_vocabulary()
    for text in (" " * 1_000_000 + "x", "a" * 1_000_000, "\n" * 300_000, "é" * 300_000):
        assert tokens.decode(tokens.encode(text, vocabulary), vocabulary) == text


def test_cuts_cost_least():
    """Against a plain search over all sets of cuts."""
    random.seed(3)
    for _ in range(200):
        length = random.randint(3, 9)
        gaps = [random.randint(1, length) for _ in range(random.randint(1, 9))]
        places = np.cumsum([0, *gaps])
        costs = np.array([0, *[random.choice([0, 1, 6]) for _ in gaps]])

        def total(cuts, places=places, costs=costs, length=length):
            edges = [0, *[places[i] for i in cuts]]
            widths = [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if max(widths) > length:
                return float("inf")
            return sum(length - w for w in widths) + sum(costs[i] for i in cuts)

        n = len(gaps)
        best = min(
            total([i for i in range(1, n) if mask >> i & 1] + [n]) for mask in range(0, 2**n, 2)
        )
        assert total(packing.choose_cuts(places, costs, length)) == best
