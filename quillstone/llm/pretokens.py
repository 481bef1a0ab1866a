"""Pre-token boundaries without regular expressions.

Each code point becomes a class, each class a function from automaton state
to automaton state. Functions compose associatively, so the state before
every character comes from a blocked scan over whole arrays: functions are
composed inside fixed-size blocks for all blocks at once, the totals of the
blocks are scanned in the same way, and each block then starts from its own
state. The closure of the sixteen functions under composition is small, so
a composition is one table lookup.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken

# Automaton states: what the current pre-token is.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, GLUE, ONE_LEFT, TWO_LEFT = range(8)
# Classes of characters. SPACE_LAST and SPACE_GLUE are white space before
# something else, the latter U+0020, which opens the next pre-token.
# SHORT and LONG are apostrophes before 's 't 'm 'd and 're 've 'll.
LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, SPACE_GLUE, SHORT, LONG = range(8)
RESET = 8  # added to the class of a text's first character
BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at this character."""
    if kind >= RESET:
        return _step(FRESH, kind - RESET)[0], True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if kind in (SHORT, LONG):
        if state in (OTHERS, GLUE):
            return OTHERS, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == SPACE:
        return SPACES, state != SPACES
    if kind == SPACE_LAST:
        return FRESH, True
    if kind == SPACE_GLUE:
        return GLUE, True
    own = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[kind]
    return own, state not in (own, GLUE)


@lru_cache(maxsize=1)
def _tables():
    steps = [[_step(s, k) for s in range(8)] for k in range(16)]
    functions = [tuple(range(8))]
    index = {functions[0]: 0}

    def number(f: tuple) -> int:
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
        return index[f]

    generators = [number(tuple(s for s, _ in row)) for row in steps]
    done = 0
    while done < len(functions):
        for g in generators:
            number(tuple(functions[g][s] for s in functions[done]))
        done += 1
    m = len(functions)
    compose = np.array([[index[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    apply = np.array(functions, np.uint8)
    starts = np.array([[b for _, b in row] for row in steps], bool)
    return np.array(generators, np.uint16), compose.ravel(), np.uint32(m), apply.ravel(), starts.ravel()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of each code point, by the Unicode tables of the library whose ids are wanted.

    Libraries differ in the Unicode version they know, so tiktoken itself is
    asked, with a pattern that matches one class and a vocabulary of bytes.
    test_bpe.py holds the classes against both libraries, for every code point.
    """
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        kinds[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return kinds


def _before(functions: np.ndarray) -> np.ndarray:
    """For each element, the composition of all elements before it."""
    _, compose, m, _, _ = _tables()
    n = len(functions)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    before = np.empty((BLOCK, blocks), np.uint16)
    total = np.zeros(blocks, np.uint16)
    for j in range(BLOCK):
        before[j] = total
        total = compose.take(total * m + columns[j])
    if blocks > 1:
        at = _before(total).astype(np.uint32) * m
        before = compose.take(at[None, :] + before)
    return before.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, the places where pre-tokens start, and for each text the number of its first pre-token.

    The last array has one more entry, the number of all pre-tokens. An
    empty text has no pre-token.
    """
    joined = "".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    generators, _, _, apply, starts = _tables()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    n = len(points)
    begins = np.unique(np.concatenate([[0], ends[:-1]]))
    begins = begins[begins < n]
    last = np.zeros(n, bool)
    last[begins[1:] - 1] = True
    last[-1] = True
    following = np.full(n, SPACE, np.uint8)
    following[:-1] = kinds[1:]
    before_other = (kinds == SPACE) & (following != SPACE) & ~last
    kinds[before_other] = SPACE_LAST
    kinds[before_other & (points == 0x20)] = SPACE_GLUE
    for i in np.flatnonzero(points == 0x27).tolist():
        if not last[i]:
            if joined[i + 1] in "stmd":
                kinds[i] = SHORT
            elif not last[i + 1] and joined[i + 1 : i + 3] in ("re", "ve", "ll"):
                kinds[i] = LONG
    kinds[begins] += RESET
    state = apply.take(_before(generators[kinds]).astype(np.uint32) * 8)
    places = np.flatnonzero(starts.take(kinds.astype(np.uint16) * 8 + state))
    first = np.searchsorted(places, np.concatenate([[0], ends]))
    return joined, places, first


def split(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    joined, places, first = boundaries(texts)
    cuts = [*places.tolist(), len(joined)]
    pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [pieces[a:b] for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
