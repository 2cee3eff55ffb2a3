"""An adaptive range coder for token ids that codes many independent blocks in step.

A block is a lane of numpy vectors; a step codes one id of every block. The
model predicts the id from the last two ids, from the last one, and from the
id counts of the group of blocks (orders 2, 1 and 0). Orders 2 and 1 start
empty in each block and name the id that followed their context before; what
their records say of these guesses is mixed in the logistic domain with weights
that each block learns. The mix is the chance of order 2's guess; orders 1 and
0 share what is left. Order 0 gives every id its share of the group's counts,
which the group's head carries, so a block needs no other block to be read.
All of it is integer arithmetic, so any machine decodes what another wrote.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block, and the cells of its prediction table: one for an id as last, three for what came before it.
BLOCK = 1024
CELLS, CELL = 128, 4
#: Blocks coded in step; bounds the coder's memory (about 10 kB each).
LANES = 4096
#: Bits of order 0's shares, and of those of the three orders.
SHARE_BITS, MIX_BITS = 20, 12
#: Different ids that a group may hold.
MOST_IDS = 1 << (SHARE_BITS - 1)

U = np.uint64
TOP, BOTTOM, UNIT, SCALE, TOP_SHIFT = U(1 << 48), U(1 << 32), U(16), U(SHARE_BITS + MIX_BITS), U(48)
WHOLE, LITERAL = 1 << MIX_BITS, U(SHARE_BITS)

_p = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_p / (1 - _p)) * 256).astype(np.int32)  # fixed values: ln(p / (1 - p)), 8 fractional bits
SQUASH = np.round(4095 / (1 + np.exp(-(np.arange(-2048, 2048) / 256)))).astype(np.int32).clip(1, 4094)
#: Chances in 4096 that a guess of some confidence starts with.
FIRST = np.array([64, 512, 1024, 1536, 2048, 2560, 3072, 3584], np.int32)
#: Weights are held in bounds once in so many steps; in between they can't leave 32 bits.
BOUND_EVERY = 16


class Shares:
    """Order 0: ids by rank in ascending order, with their shares of 1 << SHARE_BITS."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share.astype(U)
        self.first = np.cumsum(self.share, dtype=U) - self.share

    @classmethod
    def of(cls, counts: np.ndarray) -> Shares:
        """From the number of times that each id from 0 on occurs: every id that does gets 1 at least."""
        ids = np.flatnonzero(counts)
        if len(ids) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} different ids in a group")
        n = counts[ids].astype(np.int64)
        share = np.maximum(1, n * ((1 << SHARE_BITS) - len(ids)) // max(1, int(n.sum())))
        if len(ids):
            share[int(n.argmax())] += (1 << SHARE_BITS) - int(share.sum())
        return cls(ids, share)

    def by_place(self) -> np.ndarray:
        """The rank at each place of 1 << SHARE_BITS."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.share.astype(np.int64))


class Model:
    """Guesses and adaptive statistics of n lanes; axis 0 is order 2, then order 1."""

    def __init__(self, n: int):
        two = np.arange(2, dtype=np.int64)[:, None] * n + np.arange(n)
        # An entry is a guess above 3 bits of confidence. Both orders' entries lie in one cell, so in one cache line.
        self.table, self.base = np.zeros(n * CELLS * CELL, np.int32), np.arange(n, dtype=np.int64) * (CELLS * CELL)
        self.right, self.rbase = np.tile(FIRST, 2 * n), two * 8  # 12-bit chances by confidence
        self.weight = np.full((2, n), 1 << 15, np.int32)
        self.context, self.last = np.zeros((2, n), np.int32), np.ones(n, np.int32)
        self.step = 0

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses (2, k) of the first k lanes, and the shares of order 2 and of order 1 in WHOLE, and what they leave."""
        self.at = self.base[:k] + self.context[:, :k]
        self.entry = self.table.take(self.at)
        self.sure = self.entry & 7
        guess = self.entry >> 3
        self.c = self.rbase[:, :k] + self.sure
        self.chance = self.right.take(self.c)
        s = self.inputs = STRETCH.take(self.chance)
        # If the guesses agree, order 1's record speaks for the same id.
        apart = guess[0] != guess[1]
        s[1] *= apart
        w = self.weight
        dot = w[0, :k] * s[0]
        dot += w[1, :k] * s[1]
        dot >>= 16
        dot += 2048
        self.mixed = SQUASH.take(dot, mode="clip")
        rest = WHOLE - self.mixed
        # Whatever can be coded has a share of at least 1: rest is 2 or more.
        f1 = rest - 2
        f1 *= self.chance[1]
        f1 >>= 12
        f1 += 1
        f1 *= apart
        rest -= f1
        return guess, self.mixed, f1, rest

    def update(self, k: int, x: np.ndarray, hit: np.ndarray) -> None:
        goal = hit * np.int32(4095)
        err = goal[0] - self.mixed
        goal -= self.chance
        goal >>= 4
        goal += self.chance
        self.right[self.c] = goal
        w, pull = self.weight[:, :k], self.inputs
        pull *= err
        pull >>= 10
        w += pull
        self.step += 1
        if self.step % BOUND_EVERY == 0:
            np.clip(w, -(1 << 17), 1 << 17, out=w)
        # A hit adds confidence, a miss halves it; a guess of little confidence gives way.
        sure, new = self.sure, self.entry
        less = sure >> 1
        up = np.where(hit, sure < 7, less - sure)
        new += up
        np.copyto(new, (x << 3) | less, where=~(hit | (sure > 1)))
        self.table[self.at] = new
        context, last = self.context[:, :k], self.last[:k]
        np.right_shift(x * np.int32(40503), 2, out=context[1])
        context[1] &= (CELLS - 1) * CELL
        np.add(context[1], last, out=context[0])
        last[:] = x
        last *= np.int32(30011)
        last >>= 5
        last &= 255
        last *= 3
        last >>= 8
        last += 1


def span(x: np.ndarray, hit: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: np.ndarray, shares: Shares) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of what codes the ids of rank x, in 1 << SCALE."""
    u0, u1, u2 = f0.astype(U), f1.astype(U) << LITERAL, f2.astype(U) << LITERAL
    start, size = u0 * shares.first.take(x), u0 * shares.share.take(x)
    start += u1
    start += u2
    second = hit[1] & ~hit[0]
    np.copyto(start, u2, where=second)
    np.copyto(size, u1, where=second)
    np.copyto(start, U(0), where=hit[0])
    np.copyto(size, u2, where=hit[0])
    return start, size


def settled(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which lanes have their upper 16 bits settled."""
    end = low + wide
    end ^= low
    return end < TOP


def too_narrow(low: np.ndarray, wide: np.ndarray) -> np.ndarray | None:
    """Which lanes must give up 16 bits before the next id, if any is too narrow; such a one ends its range at the next border."""
    short = wide < BOTTOM
    if not short.any():
        return None
    same = settled(low, wide)
    short &= ~same
    wide[short] = (~low[short] + U(1)) & (BOTTOM - U(1))
    return same | short


def encode(blocks: list[np.ndarray], shares: Shares) -> list[bytes]:
    """A string of 16-bit little-endian words for each block of up to BLOCK ranks; the longest blocks first."""
    n, size = len(blocks), [len(b) for b in blocks]
    ids = np.zeros((max(size, default=0), n), np.int32)
    for i, b in enumerate(blocks):
        ids[: size[i], i] = b
    alive = np.searchsorted(-np.array(size), -np.arange(len(ids)), side="left")  # lanes with an id at each step
    model, low, wide = Model(n), np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    cap = 2 * len(ids) + 8
    out, pos = np.zeros(n * cap, np.uint16), np.arange(n, dtype=np.int64) * cap
    with np.errstate(over="ignore"):
        for t in range(len(ids)):
            k = int(alive[t])
            x = ids[t, :k]
            guess, f2, f1, f0 = model.predict(k)
            hit = guess == x
            start, size_ = span(x, hit, f2, f1, f0, shares)
            lo, wi, at = low[:k], wide[:k], pos[:k]
            unit = wi >> SCALE
            start *= unit
            lo += start
            np.multiply(unit, size_, out=wi)
            same = settled(lo, wi)
            while same is not None:
                out[at] = lo >> TOP_SHIFT  # where nothing is settled, the next word takes the place
                at += same
                shift = same.astype(U)
                shift <<= U(4)
                lo <<= shift
                wi <<= shift
                same = too_narrow(lo, wi)
            model.update(k, x, hit)
        for _ in range(4):
            out[pos] = low >> TOP_SHIFT
            pos += 1
            low <<= UNIT
    return [out[i * cap : p].astype("<u2").tobytes() for i, p in enumerate(pos.tolist())]


def decode(coded: list[bytes], sizes: list[int], shares: Shares) -> list[np.ndarray]:
    """The blocks again, from their strings and numbers of ids; longest first."""
    n, steps = len(coded), max(sizes, default=0)
    words = np.concatenate([np.frombuffer(c, "<u2") for c in coded] + [np.zeros(8, np.uint16)]) if n else np.zeros(8, np.uint16)
    pos = np.cumsum([0, *[len(c) // 2 for c in coded]])[:-1].astype(np.int64)
    alive = np.searchsorted(-np.array(sizes), -np.arange(steps), side="left")
    model, low, wide, code = Model(n), np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U), np.zeros(n, U)
    ids, by_place, most = np.zeros((steps, n), np.int32), shares.by_place(), U((1 << SHARE_BITS) - 1)
    for _ in range(4):
        code = code << UNIT | words[pos]
        pos += 1
    with np.errstate(over="ignore"):
        for t in range(steps):
            k = int(alive[t])
            guess, f2, f1, f0 = model.predict(k)
            lo, wi, co, at = low[:k], wide[:k], code[:k], pos[:k]
            unit = wi >> SCALE
            v = np.minimum((co - lo) // unit, U((1 << 32) - 1))
            part = (v >> LITERAL).astype(np.int32)
            e1 = f2 + f1
            place = np.minimum((v - (e1.astype(U) << LITERAL)) // f0.astype(U), most)
            x = np.where(part < f2, guess[0], np.where(part < e1, guess[1], by_place[place]))
            hit = guess == x
            start, size_ = span(x, hit, f2, f1, f0, shares)
            start *= unit
            lo += start
            np.multiply(unit, size_, out=wi)
            same = settled(lo, wi)
            while same is not None:
                shift = same.astype(U)
                next_ = words.take(at) * shift
                at += same
                shift <<= U(4)
                co <<= shift
                co |= next_
                lo <<= shift
                wi <<= shift
                same = too_narrow(lo, wi)
            ids[t, :k] = x
            model.update(k, x, hit)
    return [ids[:s, i].copy() for i, s in enumerate(sizes)]
