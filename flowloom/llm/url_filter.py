"""URL rules as one bit-parallel automaton.

Each rule is a sequence of symbols, some with a wildcard before them; all rules are packed side by side
into the words of a Shift-And mask. One step takes a character of every URL of a batch and moves the states of all
rules at once: ``D = ((D << 1) & step[c]) | (D & stay[c])``. Rules see a canonical text: ``.`` + host + separator + path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import slices

SEPARATOR = "\0"


@dataclass(frozen=True)
class UrlRule:
    """A rule for a host and all its subdomains (``subdomains``), or for hosts like a glob, whose path begins like ``path``.

    In ``host`` and ``path``, ``*`` is any run of characters (in a host: of the host) and ``?`` any one. A rule with
    ``named`` false is one of the method's own: it decides only where no named rule fits, and is not shown as rule.
    """

    action: str
    host: str
    path: str = ""
    subdomains: bool = True
    named: bool = True

    @property
    def text(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[tuple[str, bool, bool]]:
        """(symbol, wildcard before it, that wildcard may cross the separator); a ``?`` symbol is the empty string."""
        found, star = [], self.subdomains
        for part, inside, text in ((0, False, (".", *self.host)), (1, True, (SEPARATOR, *self.path))):
            for i, c in enumerate(text):
                if c == "*":
                    star = True
                else:
                    found.append(("" if c == "?" and (part or i) else c, star, inside and i > 0))
                    star = False
        return [*found, ("end", True, True)]


class Automaton:
    """The rules' masks. Bit j of a rule's part: its first j symbols are read."""

    def __init__(self, rules: list[UrlRule]):
        self.rules = sorted(rules, key=lambda r: (not r.named, -len(r.text)))  # the first that fits wins; ties: as given
        parts = [r.symbols() for r in self.rules]
        self.alphabet = np.array(sorted({ord(c) for p in parts for c, _, _ in p[:-1] if c}), np.uint32)
        width, classes = sum(map(len, parts)), len(self.alphabet) + 1  # the last class: characters of no rule
        step, stay, start, self.final, at = [0] * classes, [0] * classes, 0, [], 0
        separator = int(np.searchsorted(self.alphabet, ord(SEPARATOR)))
        for p in parts:
            start |= 1 << at
            for j, (c, star, crosses) in enumerate(p):
                for k in range(classes):
                    if star and (crosses or k != separator):
                        stay[k] |= 1 << (at + j)
                    if c != "end" and (k != separator if c == "" else k < classes - 1 and self.alphabet[k] == ord(c)):
                        step[k] |= 1 << (at + j + 1)
            self.final.append(at + len(p) - 1)
            at += len(p)
        self.words = max(1, -(-width // 64))
        self.start, self.step_int, self.stay_int = start, step, stay
        self.step, self.stay = (np.array([self.split(x) for x in xs]) for xs in (step, stay))

    def split(self, mask: int) -> list[np.uint64]:
        return [np.uint64((mask >> (64 * w)) & (2**64 - 1)) for w in range(self.words)]

    def match(self, texts: list[str]) -> np.ndarray:
        """The index of the first rule that fits each text; -1: none."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        classes = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        classes = np.where(self.alphabet[classes] == codes, classes, len(self.alphabet))
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        states = np.tile(np.array(self.split(self.start), np.uint64), (len(texts), 1))
        position, live = 0, int(np.searchsorted(-lengths, 0, "left"))
        while live > 3:  # all URLs that are longer than position, one character each
            d, c = states[:live], classes[begins[:live] + position]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            states[:live] = (moved & self.step[c]) | (d & self.stay[c])
            position += 1
            live = int(np.searchsorted(-lengths, -position, "left"))
        for i in range(live):  # the few longest ones: whole masks as integers
            d = sum(int(x) << (64 * w) for w, x in enumerate(states[i]))
            for c in classes[begins[i] + position : begins[i] + lengths[i]].tolist():
                d = ((d << 1) & self.step_int[c]) | (d & self.stay_int[c])
            states[i] = self.split(d)
        found = np.full(len(texts), -1)
        for r in range(len(self.rules) - 1, -1, -1):
            word, bit = divmod(self.final[r], 64)
            found[(states[:, word] >> np.uint64(bit)) & np.uint64(1) == 1] = r
        out = np.empty(len(texts), np.int64)
        out[order] = found
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _judge(rules: list[UrlRule], default: str, carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for part in slices(batches, "path", 1 << 18):
            plain = lambda x: x.replace(SEPARATOR, "\1")
            found = automaton.match(["." + plain(h) + SEPARATOR + plain(p) for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)])
            hit = [automaton.rules[i] if i >= 0 else None for i in found.tolist()]
            out = [[r.text if r and r.named else None for r in hit], [r.action if r else default for r in hit], [r.text if r and not r.named else None for r in hit]]
            yield pa.record_batch([*part.columns, *(pa.array(x, pa.string()) for x in out)], names=[*part.schema.names, "rule", "verdict", "glob"])

    return run


def judge_urls(pages: DataFrame, rules: list[UrlRule], url_col: str = "url", carry: list[str] | None = None, default: str = "allow") -> DataFrame:
    """Every row's ``carry`` columns with host, path, rule (the named one that fits, the longest), verdict and glob.

    A null URL and one without ``://`` have an empty host and path, which only a rule for such can fit. Rows
    that repeat are each judged. URLs of any length are read whole.
    """
    carry = ["page_id"] if carry is None else carry
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*(F.col(c) for c in carry), F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))).toDF(*(f"c{i}" for i in range(len(carry))), "host", "path")
    schema = ", ".join([*(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)), "host string, path string, rule string, verdict string, glob string"])
    return rows.mapInArrow(_judge(rules, default, len(carry)), schema).toDF(*carry, "host", "path", "rule", "verdict", "glob")
