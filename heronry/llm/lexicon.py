"""A minimal acyclic transducer over words, as arrays in one file that workers map into memory.

Words that end alike share their states (Daciuk et al., 2000). The outputs on
the arcs of a word's path add up to the word's place in sorted order, where its
ids stand. States lie in two arrays, each state's arcs at its base plus the
byte, so many words walk at once, a byte a step.
"""

from __future__ import annotations

import numpy as np

#: Longest word, in bytes, that is looked up.
MOST_BYTES = 32


class Automaton:
    """States of the sorted words `words`; equal right languages are one state."""

    def __init__(self, words: list[bytes]):
        self.arcs: list[dict[int, int]] = [{}]
        self.final: list[bool] = [False]
        self.known: dict[tuple, int] = {}
        path, before = [0], b""  # states of the last word, not yet shared
        for word in words:
            if word <= before and before:
                raise ValueError("words have to be sorted and different")
            same = next((k for k, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
            self.close(path, before, same)
            for byte in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][byte] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        self.close(path, before, 0)
        self.renumber()

    def close(self, path: list[int], word: bytes, upto: int) -> None:
        """Replaces the states below `upto` by equal ones that are known."""
        while len(path) > upto + 1:
            state = path.pop()
            mark = (self.final[state], tuple(self.arcs[state].items()))
            self.arcs[path[-1]][word[len(path) - 1]] = self.known.setdefault(mark, state)

    def renumber(self) -> None:
        """Keeps the states in reach, each after those it leads to, and counts the words below each."""
        order, seen, stack = [], set(), [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                order.append(state)
            elif state not in seen:
                seen.add(state)
                stack.append((state, True))
                stack.extend((t, False) for t in self.arcs[state].values())
        self.order, self.below = order, {}
        for state in order:
            self.below[state] = self.final[state] + sum(self.below[t] for t in self.arcs[state].values())


def compiled(words: list[bytes], ids: list[list[int]]) -> np.ndarray:
    """The transducer of sorted words with their ids, as one array of 32-bit numbers."""
    a = Automaton(words)
    slots = sum(map(len, a.arcs)) + 512
    check, target, out = (np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32))
    new = {state: k for k, state in enumerate(sorted(a.order, key=lambda s: (s != 0, -len(a.arcs[s]))))}  # the root is 0; full states first
    base, final, taken, low = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32), bytearray(slots), 0
    for state, k in new.items():
        final[k] = a.final[state]
        arcs = sorted(a.arcs[state].items())
        if not arcs:
            continue
        while taken[low]:
            low += 1
        at = max(0, low - arcs[0][0])
        while any(taken[at + byte] for byte, _ in arcs):
            at = max(at + 1, (taken.find(0, at + 1 + arcs[0][0])) - arcs[0][0])
            if at + 512 > len(taken):
                taken.extend(bytes(1024))
        base[k], before = at, int(a.final[state])
        if at + 256 > len(check):
            more = at + 1024 - len(check)
            check, target, out = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((check, -1), (target, 0), (out, 0)))
        for byte, t in arcs:
            taken[at + byte] = 1
            check[at + byte], target[at + byte], out[at + byte] = k, new[t], before
            before += a.below[t]
    edges = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    parts = [base, final, check, target, out, edges, flat]
    return np.concatenate([np.array([len(parts), *map(len, parts)], np.int32), *parts])


class Lexicon:
    """A transducer in use; `data` may be a memory map."""

    def __init__(self, data: np.ndarray):
        sizes = data[1 : 1 + int(data[0])]
        ends = np.cumsum(sizes) + 1 + int(data[0])
        self.base, self.final, self.check, self.target, self.out, self.edges, self.ids = (data[int(e - n) : int(e)] for e, n in zip(ends, sizes))

    def places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word raw[start:end] among the lexicon's, or -1."""
        size, place = ends - starts, np.full(len(starts), -1, np.int64)
        live = np.nonzero((size > 0) & (size <= MOST_BYTES))[0]
        state, total, at = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), starts[live].copy()
        for step in range(MOST_BYTES + 1):
            done = size[live] == step
            if done.any():
                found = done & (self.final[state] == 1)
                place[live[found]] = total[found]
                live, state, total, at = live[~done], state[~done], total[~done], at[~done]
            if not len(live):
                break
            slot = np.minimum(self.base[state] + raw[at], len(self.check) - 1)
            there = self.check[slot] == state
            live, slot, at = live[there], slot[there], at[there] + 1
            total = total[there] + self.out[slot]
            state = self.target[slot].astype(np.int64)
        return place
