"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton of as many 64-bit words as they
need: one bit for the start of each rule and one for each character it consumes. For each
byte of a URL two masks say which bits the shifted state may enter and which bits stay
(a wildcard run that takes this byte), so every rule advances at once; vectorised over the
URLs of a batch. In a glob ``?`` is any byte but ``/``, ``*`` any run without ``/``, ``**``
any run, and a backslash makes the next character plain.

The canonical URL is host + path: the host is what stands between the first ``://`` and the
next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``, ``#`` or
the end. A site rule ``host/path`` fits its host and all subdomains where the path starts
with the rule's; the longest fitting rule decides (ties: the smaller text), else the
verdict is ``block`` if a block glob fits and ``allow`` otherwise.

Defined results: null urls and urls without ``://`` have an empty host and path; very long
urls are run to their end; of globs that fit the first given is named; repeated rows stay
repeated; a null id keeps its row; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Globs that block where no site rule fits.
BLOCK_GLOBS = ("ads.*/**", "ad.*/**", "*.doubleclick.net/**", "**/ads/**", "**/wp-admin/**", "**/cgi-bin/**", "**/login", "**/login/**", "**/*.exe", "**/*.zip", "**/*.iso", "**/cart", "**/cart/**", "**/*casino*/**", "**/*porn*/**")


class Automaton:
    """Packed globs; ``match`` gives a boolean row of rules for each byte string."""

    def __init__(self, globs: list[str]):
        enter: list[tuple[int, int]] = []  # (bit, byte)
        stay: list[tuple[int, int]] = []
        first, last, bit = [], [], 0
        for glob in globs:
            raw, k = glob.encode(), 0
            first.append(bit)
            while k < len(raw):
                c = raw[k : k + 1]
                if c == b"*":
                    deep = raw[k : k + 2] == b"**"
                    stay += [(bit, b) for b in range(256) if deep or b != 47]
                    k += 1 + deep
                    continue
                bit += 1
                if c == b"?":
                    enter += [(bit, b) for b in range(256) if b != 47]
                elif c == b"\\":
                    k += 1
                    enter.append((bit, raw[k]))
                else:
                    enter.append((bit, raw[k]))
                k += 1
            last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.enter, self.stay = (self._masks(x) for x in (enter, stay))
        self.start = self._masks([(b, 0) for b in first])[0]
        self.last = np.array(last, np.int64)

    def _masks(self, bits: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for b, byte in bits:
            out[byte, b // 64] |= np.uint64(1 << b % 64)
        return out

    def match(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(strings[k] for k in order), np.uint8)
        sizes = sizes[order]
        begins = np.cumsum(sizes) - sizes
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if n else 0), side="left")
        for at, m in enumerate(live):
            byte, now = flat[begins[:m] + at], state[:m]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:m] = moved & self.enter[byte] | now & self.stay[byte]
        hit = state[:, self.last // 64] >> (self.last % 64).astype(np.uint64) & np.uint64(1)
        out = np.empty((n, len(self.last)), bool)
        out[order] = hit.astype(bool)
        return out


def plain(text: str) -> str:
    """A glob that fits this text alone."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def judged(pages: DataFrame, rules: dict[str, str], globs: tuple[str, ...] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, glob). ``rules``: site rule -> allow or block."""
    ranked = sorted(rules, key=lambda r: (-len(r), r))
    packed = [p + plain(r) + "**" for r in ranked for p in ("", "*.")] + list(globs)
    rest = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"(?s)://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), low.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, n = Automaton(packed), len(ranked)
        for batch in batches:
            urls = [(h + p).encode("utf-8", "surrogatepass") for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            hits = machine.match(urls)
            site = hits[:, : 2 * n].reshape(len(urls), n, 2).any(axis=2)
            rule = [ranked[k] if ok else None for k, ok in zip(site.argmax(axis=1), site.any(axis=1))]
            glob = [globs[k] if ok else None for k, ok in zip(hits[:, 2 * n :].argmax(axis=1), hits[:, 2 * n :].any(axis=1))] if globs else [None] * len(urls)
            verdict = [rules[r] if r is not None else "block" if g is not None else "allow" for r, g in zip(rule, glob)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())], ["id", "host", "path", "rule", "verdict", "glob"])

    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string, glob string")
