"""Texts scanned in pieces give the anchors of whole texts."""

import random

import pyarrow as pa

from tessella.llm import repeats

LENGTH = 200


def scan(texts: list[bytes], piece: int, monkeypatch) -> tuple[set, list]:
    monkeypatch.setattr(repeats, "FAR", piece)
    monkeypatch.setattr(repeats, "PIECE", 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["key", "text"])
    rows = {row for b in repeats.find_anchors([batch], LENGTH) for row in zip(*(c.to_pylist() for c in b.columns))}
    ordered = sorted(rows, key=lambda x: (x[0], x[1], x[2], x[4]))
    known = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ordered), repeats.FOUND)], schema=repeats.FOUND)
    judged = [row for b in repeats.judge_contexts([known], LENGTH) for row in zip(*(c.to_pylist() for c in b.columns)) if row[2] is None]
    return rows, judged


def test_pieces_give_the_anchors_of_the_whole(monkeypatch):
    r = random.Random(8)
    one = bytes(r.choices(b"abcdefgh ", k=9000))
    two = bytearray(one)
    for edge in range(1000, 9000, 1000):  # near copies: edits just outside a piece
        for at in (edge - LENGTH - 3, edge + 2 * LENGTH + 3):
            if at < len(two):
                two[at] = ord("X")
    texts = [one, bytes(two)]
    whole, _ = scan(texts, 1 << 22, monkeypatch)
    cut, judged = scan(texts, 1000, monkeypatch)
    assert cut == whole and judged
    for key, _, _, start, end in judged:
        assert texts[1 - key].find(texts[key][start:end]) >= 0
