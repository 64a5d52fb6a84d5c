"""A static range asymmetric numeral system over token ids, with interleaved lanes (numpy).

All blocks share one table of frequencies that sum to 2**BITS. A block's tokens are dealt over LANES lanes in turn, and
every STRETCH tokens a checkpoint holds the lanes' states and where in the words their reading goes on: from each
checkpoint decoding may start, and the stretches of many blocks are coded side by side, one step of all lanes at a time.

A lane's state lies in [2**31, 2**63); where a token would push it beyond, its low 32 bits go out as a word. Words stand in
the order in which a decoder takes them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BITS, LANES, STEPS = 20, 32, 1024
STRETCH = LANES * STEPS
LOW = np.uint64(1 << 31)
_32, _MASK32, _BITS = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(BITS)
_SLOTS = np.uint64((1 << BITS) - 1)
#: A block: number of tokens, words of each stretch, states of its lanes, words.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def frequencies(counts: Sequence[int]) -> np.ndarray:
    """Counts as shares of 2**BITS: what occurs gets 1 at least; the remainders go to the largest counts."""
    total, scale = sum(counts), 1 << BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    out = [max(1, c * scale // total) if c else 0 for c in counts]
    order = sorted((i for i, c in enumerate(counts) if c), key=lambda i: (-counts[i], i))
    if len(order) > scale:
        raise ValueError(f"more than {scale} kinds of tokens")
    rest = scale - sum(out)
    while rest:
        for i in order:
            step = 1 if rest > 0 else -min(-rest, max(0, out[i] // 2)) if out[i] > 1 else 0
            out[i] += step
            rest -= step
            if not rest:
                break
    return np.array(out, np.uint64)


class Tables:
    """What coder and decoder look up, from the shared frequencies."""

    def __init__(self, freq: np.ndarray):
        none = len(freq)  # stands where a lane has no token: it takes all slots, so it leaves a state as it is
        self.freq = np.append(freq.astype(np.uint64), np.uint64(1 << BITS))
        self.start = np.append(np.concatenate(([0], np.cumsum(freq[:-1]))).astype(np.uint64) if none else np.zeros(0, np.uint64), np.uint64(0))
        self.limit = self.freq << np.uint64(63 - BITS)
        self.kind = np.repeat(np.arange(none, dtype=np.uint32), freq.astype(np.int64))
        self.none = none

    def encode(self, blocks: Sequence[np.ndarray]) -> list[Block]:
        """Blocks of token ids, coded side by side."""
        spans = [(b, at) for b, tokens in enumerate(blocks) for at in range(0, len(tokens), STRETCH)]
        if not spans:
            return [(0, np.zeros(0, np.uint32), np.zeros((0, LANES), np.uint64), np.zeros(0, np.uint32)) for _ in blocks]
        dealt = np.full((len(spans), STRETCH), self.none, np.int64)
        for i, (b, at) in enumerate(spans):
            some = blocks[b][at : at + STRETCH]
            if len(some) and not self.freq[some].all():
                raise ValueError("a token that the frequencies don't know")
            dealt[i, : len(some)] = some
        steps = -(-max(min(STRETCH, len(blocks[b]) - at) for b, at in spans) // LANES)
        dealt = np.ascontiguousarray(dealt.reshape(len(spans), STEPS, LANES)[:, :steps].transpose(1, 0, 2)).reshape(steps, -1)
        x = np.full(dealt.shape[1], LOW, np.uint64)
        out, over = np.zeros(dealt.shape, np.uint32), np.zeros(dealt.shape, bool)
        for s in range(steps - 1, -1, -1):
            kinds = dealt[s]
            f = self.freq[kinds]
            np.greater_equal(x, self.limit[kinds], out=over[s])
            out[s] = x & _MASK32
            x = np.where(over[s], x >> _32, x)
            whole = x // f
            x = (whole << _BITS) + (x - whole * f) + self.start[kinds]
        states = x.reshape(len(spans), LANES)
        out, over = (a.reshape(steps, len(spans), LANES) for a in (out, over))
        found: list[Block] = []
        at = 0
        for tokens in blocks:
            n = -(-len(tokens) // STRETCH)
            words = [out[:, i][over[:, i]] for i in range(at, at + n)]
            found.append((len(tokens), np.array([len(w) for w in words], np.uint32), states[at : at + n], np.concatenate(words) if words else np.zeros(0, np.uint32)))
            at += n
        return found

    def decode(self, blocks: Sequence[Block]) -> list[np.ndarray]:
        """The token ids of blocks, decoded side by side from all their checkpoints."""
        sizes = [min(STRETCH, n - at) for n, _, _, _ in blocks for at in range(0, n, STRETCH)]
        if not sizes:
            return [np.zeros(0, np.uint32) for _ in blocks]
        words = np.append(np.concatenate([w for _, _, _, w in blocks]), np.uint32(0))
        lengths = np.concatenate([k for _, k, _, _ in blocks]).astype(np.int64)
        last = np.cumsum(lengths)
        at = last - lengths
        x = np.concatenate([s for _, _, s, _ in blocks]).reshape(-1).astype(np.uint64)
        steps, left = -(-max(sizes) // LANES), np.array(sizes, np.int64)
        lane = np.arange(LANES)
        out = np.empty((steps, len(sizes), LANES), np.uint32)
        short = int(left.min()) // LANES  # steps in which all lanes of all stretches have a token
        for s in range(steps):
            slot = x & _SLOTS
            kinds = self.kind[slot]
            after = self.freq[kinds] * (x >> _BITS) + slot - self.start[kinds]
            if s >= short:
                after = np.where((left[:, None] > s * LANES + lane).reshape(-1), after, x)
            need = after < LOW
            rank = np.cumsum(need.reshape(-1, LANES), axis=1)
            place = (at[:, None] + rank - 1).reshape(-1)
            x = np.where(need, (after << _32) | words[np.where(need, place, -1)].astype(np.uint64), after)
            at += rank[:, -1]
            out[s] = kinds.reshape(-1, LANES)
        if (x != LOW).any() or (at != last).any():
            raise ValueError("a block doesn't end in the state that it was begun with")
        flat = out.transpose(1, 0, 2).reshape(len(sizes), -1)
        found, i = [], 0
        for n, _, _, _ in blocks:
            k = -(-n // STRETCH)
            found.append(np.concatenate([flat[j, : sizes[j]] for j in range(i, i + k)]) if k else np.zeros(0, np.uint32))
            i += k
        return found
