"""Secret scanning with a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: a formula of ANDs and ORs that any matching text
satisfies. Texts are indexed in segments: one pass over the bytes of all texts, in ASCII lower case, gives for each trigram
that a query names the sorted list of texts that hold it.
A query's postings are united and intersected, and only the texts left are searched with the pattern. Rules whose
formula is trivially true (no trigram is mandatory) search all texts. A segment is built, asked and dropped within
one task, so that neither texts nor postings are shuffled, and its size is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, chunks, text_buffers

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """least: characters that `group` of a match must have; others are dropped, and what they took stays taken."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, True),
    Rule("hook", r"https://hooks\.[a-z.]+/[A-Za-z0-9/_-]+", 0, 40),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)

# --- Boolean trigram queries ------------------------------------------------------------------------------------
# A query is True, a trigram, ("and", frozenset) or ("or", frozenset).


def _join(kind: str, parts) -> object:
    parts, flat = list(parts), set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_string(s: str) -> object:
    return _join("and", (s[i : i + 3] for i in range(len(s) - 2)))


#: Sets of more strings than this are not multiplied out further.
MOST = 64


@dataclass
class _Info:
    """What a part of a pattern matches: `exact` is all its strings, if these are few, and `query` holds anyway."""

    exact: set[str] | None
    query: object
    prefix: set[str]
    suffix: set[str]


def _known(strings: set[str]) -> _Info:
    return _Info(strings, True, strings, strings)


def _ends(strings: set[str], last: bool) -> set[str]:
    return {s[-2:] if last else s[:2] for s in strings}


_ANY = _Info(None, True, {""}, {""})


def _closed(x: _Info) -> _Info:
    """Gives the exact strings up for their query and their ends."""
    if x.exact is None:
        return x
    return _Info(None, _join("or", map(_of_string, x.exact)) if x.exact else True, _ends(x.exact, False), _ends(x.exact, True))


def _then(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _known({x + y for x in a.exact for y in b.exact})
    # strings across the seam: the known end of a with the known start of b
    left = a.exact if a.exact is not None else a.suffix
    right = b.exact if b.exact is not None else b.prefix
    seam = _join("or", (_of_string(x[-2:] + y[:2]) for x in left for y in right)) if len(left) * len(right) <= 4 * MOST else True
    ca, cb = _closed(a), _closed(b)
    prefix = _ends({x + y for x in a.exact for y in cb.prefix}, False) if a.exact is not None and len(a.exact) * len(cb.prefix) <= 4 * MOST else ca.prefix
    suffix = _ends({x + y for x in ca.suffix for y in b.exact}, True) if b.exact is not None and len(b.exact) * len(ca.suffix) <= 4 * MOST else cb.suffix
    return _Info(None, _join("and", (ca.query, seam, cb.query)), prefix, suffix)


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _known(a.exact | b.exact)
    a, b = _closed(a), _closed(b)
    return _Info(None, _join("or", (a.query, b.query)) if a.query is not True and b.query is not True else True, a.prefix | b.prefix, a.suffix | b.suffix)


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MOST:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _info(items) -> _Info:
    total = _known({""})
    for op, arg in items:
        if op is C.LITERAL:
            part = _known({chr(arg).lower()}) if arg < 128 else _ANY
        elif op is C.IN:
            chars = _chars(arg)
            low = {c.lower() for c in chars} if chars and max(chars) < "\x80" else set()
            part = _known(low) if 0 < len(low) <= MOST // 4 else _ANY
        elif op is C.SUBPATTERN:
            part = _info(arg[3])
        elif op is C.BRANCH:
            part = _info(arg[1][0])
            for x in arg[1][1:]:
                part = _either(part, _info(x))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _info(inner)
            if (low, high) == (0, 1):
                part = _either(one, _known({""}))
            elif low == 0:
                part = _ANY
            else:
                part = _known({""})
                for _ in range(min(low, 4)):
                    part = _then(part, one)
                if high != low or low > 4:
                    part = _closed(part)
                    part = _Info(None, part.query, part.prefix, {""})
        elif op is C.AT:
            continue
        else:
            part = _ANY
        total = _then(total, part)
    return total


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that any text in which the pattern occurs satisfies."""
    return _closed(_info(parser.parse(pattern, re.ASCII))).query


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- segments ---------------------------------------------------------------------------------------------------

#: Bytes of text that are indexed together; a longer text is a segment of its own.
SEGMENT = 1 << 22


class Index:
    """Inverted index of a segment: for each wanted trigram, in order, the numbers of the texts that hold it."""

    def __init__(self, texts: pa.Array, wanted: list[str]):
        self.size = len(texts)
        data, offsets = text_buffers(texts)
        lo, hi = int(offsets[0]), int(offsets[-1])
        low, offsets = _LOWER[data[lo:hi]], offsets - lo
        number = np.zeros(1 << 24, np.uint16)
        number[[int.from_bytes(g.encode(), "big") for g in wanted]] = np.arange(1, len(wanted) + 1)
        gram = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
        of = number[gram]
        at = np.flatnonzero(of)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]  # not over the edge of two texts
        entries = np.unique(of[at[inside]].astype(np.int64) << 32 | text[inside])
        cuts = np.searchsorted(entries >> 32, np.arange(1, len(wanted) + 2))
        self.postings = {g: entries[i:j] & 0xFFFFFFFF for g, i, j in zip(wanted, cuts, cuts[1:])}

    def candidates(self, query: object) -> np.ndarray:
        """Numbers of the texts that satisfy the query: postings intersected and united."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        found = lists[0]
        for other in lists[1:]:
            if not len(found):
                break
            found = np.intersect1d(found, other, assume_unique=True)
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        # a search that finds nothing shorter than `least` where the pattern is one repeated set of characters
        self.wanted = sorted(set().union(*(trigrams_of(q) for *_, q in self.rules)))
        self.quick = {r.kind: re.compile(r.pattern[:-1] + f"{{{r.least},}}", re.ASCII) for r in rules if re.fullmatch(r"\[[^\]]+\]\+", r.pattern)}

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end), sorted; nulls are empty."""
        texts, index, found = column.to_pylist(), Index(column, self.wanted), [[] for _ in range(len(column))]
        for number, (rule, pattern, query) in enumerate(self.rules):
            pattern = self.quick.get(rule.kind, pattern)
            for i in index.candidates(query):
                for m in pattern.finditer(texts[i] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        return [sorted(x) for x in found]


def _spans(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], base: int) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    for batch in batches:
        counts, digests, spans = [], [], []
        for first, last in chunks(text_buffers(batch.column(1))[1], SEGMENT):
            for found in scanner.scan(batch.column(1)[first:last]):
                counts.append([sum(k == n for _, k, _ in found) for n in range(base)])
                said = [f"{kinds[k]}:{s}:{e}" for s, k, e in found if k < base]
                digests.append(hashlib.sha256(",".join(said).encode()).hexdigest())
                spans.append(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found))
        n = np.array(counts, np.int64).reshape(-1, base)
        yield pa.record_batch({"doc_id": batch.column(0), **{f"n_{kinds[k]}": n[:, k] for k in range(base)}, "base_sha256": digests, "spans": spans})


def find_secrets(documents: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of documents: doc_id, n_<kind> of each base rule, base_sha256 and spans.

    spans: `kind:start:end` of every match by start, then kind as listed, comma-joined; ends exclusive, in code points.
    base_sha256: of the same for base rules only. A null text is empty: no spans, and the digest of nothing. Rows that
    repeat an id, or have none, are documents of their own; further columns are left out. No documents: no rows.
    """
    rules = tuple(base) + tuple(added)
    spec = ", ".join(["doc_id long", *[f"n_{r.kind} long" for r in base], "base_sha256 string", "spans string"])
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lambda it: _spans(it, rules, len(base)), spec)


def redactor(rules: tuple[Rule, ...] = BASE + ADDED, mark: str = "<secret>"):
    """A column function that puts `mark` in place of every match; overlapping matches get one mark. Null stays null."""
    @F.pandas_udf("string")
    def redact(column: pd.Series) -> pd.Series:
        scanner, out = Scanner(rules), []
        texts = pa.array(column, pa.large_string(), from_pandas=True)
        for first, last in chunks(text_buffers(texts)[1], SEGMENT):
            for text, found in zip(texts[first:last].to_pylist(), scanner.scan(texts[first:last])):
                text = text or ""
                parts, done = [], 0
                for start, _, end in found:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append("".join(parts) + text[done:] if found else text)
        return pd.Series([None if t is None else x for t, x in zip(column, out)], index=column.index, dtype=object)

    return redact
