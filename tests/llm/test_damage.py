"""Token files with flipped bits: named, or passed over with no more lost than what the bits belong to."""

from __future__ import annotations

import io

import numpy as np
import pytest

from bipartrix.llm import rangecoder, tokenfile


def groups() -> tuple[list[bytes], list[list[np.ndarray]]]:
    rng, raw, docs, before = np.random.default_rng(3), [], [], 0
    for g in range(3):
        own = [rng.integers(0, 300, n).astype("<u4") for n in (700, 900, 0, 1500, 40)]
        out = io.BytesIO()
        tokenfile.write_group(out, [10 * g + i for i in range(5)], [len(x) for x in own], np.concatenate(own), before)
        before += sum(map(len, own))
        raw.append(out.getvalue())
        docs.append(own)
    return raw, docs


def read(raw: bytes, on_damage: str = "raise") -> dict[int, tuple[int, bytes | None]]:
    got = {}
    for names, counts, ids, sound, before in tokenfile.read_groups(io.BytesIO(raw), on_damage):
        ends = np.cumsum(counts)
        got |= {i: (before + int(e) - n, ids[e - n : e].tobytes() if ok else None) for i, n, e, ok in zip(names, counts, ends, sound, strict=True)}
    return got


def test_a_flipped_bit_anywhere_loses_what_it_belongs_to():
    raw, docs = groups()
    whole = read(b"".join(raw))
    at = 0
    for g, own in enumerate(docs):
        for i, x in enumerate(own):
            assert whole[10 * g + i] == (at, x.tobytes())
            at += len(x)
    head = tokenfile.HEAD.unpack(raw[1][: tokenfile.HEAD.size])
    blocks = tokenfile.HEAD.size + head[1] + head[2] + 16 * head[3]
    for place in [*range(0, blocks, 61), *range(blocks, len(raw[1]), 501), len(raw[1]) - 1]:
        hurt = bytearray(raw[1])
        hurt[place] ^= 1 << place % 8
        file = raw[0] + bytes(hurt) + raw[2]
        with pytest.raises(tokenfile.Damaged):
            read(file)
        got = read(file, "skip")
        assert all(got[i] == whole[i] for i in [*range(5), *range(20, 25)])
        if place < blocks:
            assert not any(10 <= i < 15 for i in got)
        else:
            sizes = np.frombuffer(raw[1][blocks - 16 * head[3] : blocks], "<u4").reshape(-1, 4)[:, 1]
            j = int(np.searchsorted(np.cumsum(sizes), place - blocks, side="right"))
            start = whole[10][0]
            for i in range(10, 15):
                a, z = whole[i][0] - start, whole[i][0] - start + len(docs[1][i - 10])
                inside = a < min(z, (j + 1) * rangecoder.BLOCK) and z > j * rangecoder.BLOCK
                assert got[i] == (whole[i][0], None if inside else whole[i][1])


def test_a_file_cut_short():
    raw, _ = groups()
    for left in (1, 30, 60, len(raw[2]) - 1):
        file = raw[0] + raw[1] + raw[2][:left]
        with pytest.raises(tokenfile.Damaged):
            read(file)
        got = read(file, "skip")
        assert set(range(5)) | set(range(10, 15)) <= set(got)
