"""URL filters by a bit-parallel wildcard automaton.

Rules are globs over the canonical URL, ``.`` host path: ``*`` stands for any
characters but ``/``, ``**`` for any characters, ``?`` for one character. All
patterns are packed into one row of 64-bit words, a bit for each state, and all
URLs of a block step through their bytes together: the states shift by one bit,
with the carry into the next word, and stay where the byte's mask allows it
(Shift-And); a star keeps its state alive. A URL is held by the rules whose last
state is alive after its last byte.

The longest rule that holds decides, of equally long ones the first one given;
without any, the method's own globs decide in the same way, and then the
default, which is to block a URL without a host and to allow any other.

Null URLs and those without ``://`` have neither host nor path. Empty and
repeated URLs are judged like others, every row for itself; there are no ties
beyond those above. A very long URL is a block of its own, stepped through to
its end. Input columns named like a result column are replaced by it, others
are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words

ALLOW, BLOCK = "allow", "block"
# Patterns of a block of rules have so many states at most; more rules take more blocks.
STATES = 1 << 16
BLOCK_BYTES = 1 << 18
_ONE, _TOP = np.uint64(1), np.uint64(63)


@dataclass(frozen=True)
class Rule:
    """``glob`` over the canonical URL; ``name`` and its length are what a result shows and compares."""

    name: str
    glob: str
    verdict: str


def site(name: str, verdict: str) -> Rule:
    """A rule for a host and its subdomains, and the paths that start with the rule's: ``example.org/es/``."""
    return Rule(name, f"*.{name}**", verdict)


def states(glob: str) -> tuple[list[bytes], list[str]]:
    """The bytes each state after the first takes, and the star after each state: '', '*' or '**'."""
    takes, stars, i = [], [""], 0
    data = glob.encode("utf-8")
    while i < len(data):
        if data[i:i + 1] == b"*":
            wide = data[i:i + 2] == b"**"
            stars[-1] = "**" if wide or stars[-1] == "**" else "*"
            i += 2 if wide else 1
            continue
        takes.append(b"?" if data[i:i + 1] == b"?" else data[i:i + 1])
        stars.append("")
        i += 1
    return takes, stars


class Automaton:
    """Packed masks of some rules: the states a byte leads to, those it leaves alive, the first and last ones."""

    def __init__(self, globs: Sequence[str]):
        split = [states(g) for g in globs]
        n = sum(len(stars) for _, stars in split)
        self.words = -(-max(n, 1) // 64)
        step = np.zeros((256, self.words * 64), dtype=bool)
        stay = np.zeros((256, self.words * 64), dtype=bool)
        first, last, at = np.zeros(self.words * 64, dtype=bool), [], 0
        slash, tail = ord("/"), np.arange(128, 192)
        for takes, stars in split:
            first[at] = True
            for k, star in enumerate(stars):
                if k and takes[k - 1] == b"?":  # one character: its first byte, then the others
                    step[:, at + k] = True
                    step[tail, at + k] = False
                    stay[tail, at + k] = True
                elif k:
                    step[takes[k - 1][0], at + k] = True
                if star:
                    stay[:, at + k] = True
                    stay[slash, at + k] = star == "**"
            at += len(stars)
            last.append(at - 1)
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view(np.uint64)
        self.step, self.stay, self.first = pack(step), pack(stay), pack(first)
        self.last = np.array(last, dtype=np.int64)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text and rule whether the rule holds the whole text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        start, alive = offsets[:-1][order], np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        state = np.repeat(self.first[None, :], len(size), axis=0)
        for k, m in enumerate(alive):
            c = data[start[:m] + k]
            now = state[:m]
            moved = now << _ONE
            moved[:, 1:] |= now[:, :-1] >> _TOP
            state[:m] = (moved & self.step[c]) | (now & self.stay[c])
        bit = (state[:, self.last >> 6] >> (self.last & 63).astype(np.uint64)) & _ONE
        out = np.zeros((len(size), len(self.last)), dtype=bool)
        out[order] = bit.astype(bool)
        return out


class Filter:
    """Rules in the order of their rank, longest first, in automata of bounded states."""

    def __init__(self, rules: Sequence[Rule], limit: int = STATES):
        self.rules = sorted(rules, key=lambda r: -len(r.name.encode("utf-8")))
        self.parts: list[tuple[int, Automaton]] = []
        block, held = [], 0
        for i, r in enumerate(self.rules):
            block.append(r.glob)
            held += len(r.glob.encode("utf-8")) + 1
            if held >= limit or i == len(self.rules) - 1:
                self.parts.append((i + 1 - len(block), Automaton(block)))
                block, held = [], 0

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text the number of the rule that decides, or -1."""
        out = np.full(len(offsets) - 1, -1, dtype=np.int64)
        for first, automaton in self.parts:
            open_ = np.flatnonzero(out < 0)  # blocks come by rank
            size = (offsets[1:] - offsets[:-1])[open_]
            ends = np.concatenate([[0], np.cumsum(size)])
            own = data[np.repeat(offsets[:-1][open_] - ends[:-1], size) + np.arange(ends[-1])] if len(open_) < len(out) else data
            holds = automaton.match(own, ends)
            hit = holds.any(axis=1)
            out[open_[hit]] = first + holds[hit].argmax(axis=1)
        return out


_built: dict[tuple, tuple[Filter, Filter]] = {}


def _judge(rules: tuple[Rule, ...], own: tuple[Rule, ...], text: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rules, own) not in _built:  # kept for the next task of this worker
            _built.clear()
            _built[rules, own] = Filter(rules), Filter(own)
        given, method = _built[rules, own]
        for b in words.blocks(batches, text, max(BLOCK_BYTES // max([a.words for _, a in given.parts + method.parts], default=1), 1 << 12)):
            data, offsets = words.text_bytes(b.column(text))
            by_rule, by_method = given.decide(data, offsets), method.decide(data, offsets)
            names = pa.array([given.rules[i].name if i >= 0 else None for i in by_rule], pa.string())
            no_host = (b.column("host").to_numpy(zero_copy_only=False) == "").tolist()
            verdicts = pa.array([given.rules[i].verdict if i >= 0 else method.rules[j].verdict if j >= 0 else BLOCK if none else ALLOW
                                 for i, j, none in zip(by_rule, by_method, no_host)], pa.string())
            at = b.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays(
                [*[c for k, c in enumerate(b.columns) if k != at], names, verdicts],
                [*[x for k, x in enumerate(b.schema.names) if k != at], "rule", "verdict"])

    return run


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: str = "url") -> tuple:
    """Host (lower-cased) and path of a URL; both empty without ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(part(r"://([^/?#]*)"), _UPPER, _LOWER), part(r"://[^/?#]*([^?#]*)")


def judged(pages: DataFrame, rules: Sequence[Rule], own: Sequence[Rule] = (), url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none holds) and verdict.

    ``rules`` decide first; ``own``, the method's globs, where none of them holds.
    """
    host, path = canonical(url)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    text = "_url"
    while text in {c.lower() for c in kept}:
        text += "_"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "rule string, verdict string"])
    return rows.withColumn(text, F.concat(F.lit("."), "host", "path")).mapInArrow(_judge(tuple(rules), tuple(own), text), schema)
